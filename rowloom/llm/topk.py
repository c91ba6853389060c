"""Exact top-k inner products through an index of pivot distances.

Every vector is keyed by its nearest pivot and its distance to it.  A pivot's vectors are cut into
annuli of equal width, and an annulus into blocks of bounded size.  Each query first searches
the block it lies in, which gives a score that its k-th best can't be under.  For a vector v at distance
d from pivot p and a query q at distance e from p, |q - v| >= |e - d|, so

    q.v = (|q|^2 + |v|^2 - |q - v|^2) / 2  <=  (|q|^2 + |v|^2 - (e - d)^2) / 2.

A query goes on to the annuli in the order of this bound, a few in the first round and more in each
following one.  After a round its k-th best score is known better, and it stops at the annuli whose bound is under that;
within an annulus it expands from its own distance outwards as far as the bound allows.  Queries that lie together travel
together, and a block of vectors is sent only to those groups of queries that come to it.  Scores are integers
and compared exactly: in float64 where sums stay below 2^53, else as int64 or Python integers; the bound is loosened by more than the rounding of distances.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.common import Scratch, materialise

PIVOTS = 32  # vectors, of the least hashes of their ids
ANNULI = 16  # of the range of distances
BLOCK = 4096  # vectors, or queries, of a block
ROUNDS = (8, 64, PIVOTS * (ANNULI + 1))  # annuli that a query may have gone to after each round, in the order of their bounds
TOGETHER = 64  # queries whose annuli are ordered at a time
LIMIT = float(1 << 63)  # scaled components from it on don't fit a long
MOST = (1 << 63) - 1  # scores beyond it are held at it and refused if they are among the results
SLACK = 1e-6
NONE = -(1 << 63)  # below all scores


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column of longs, with zeros after a shorter one's end."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    off = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(off)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(off[0], off[-1]) - np.repeat(off[:-1], sizes)] = values[off[0] : off[-1]]
    return out


def packed(rows: np.ndarray) -> list[bytes]:
    """Each row of integers in the least of 2, 4 or 8 bytes that hold them all."""
    most = np.maximum(rows.max(1, initial=0), -1 - rows.min(1, initial=0))
    width = np.where(most < 1 << 15, 2, np.where(most < 1 << 31, 4, 8))
    out: list[bytes] = [b""] * len(rows)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        data, size = rows[at].astype(f"<i{w}").tobytes(), rows.shape[1] * w
        for k, i in enumerate(at.tolist()):
            out[i] = data[k * size : (k + 1) * size]
    return out


def unpacked(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The rows of ``width`` integers that ``packed`` made."""
    values = column.to_pylist()
    size = np.array([len(x) for x in values], np.int64) // width
    out = np.empty((len(values), width), np.int64)
    for w in np.unique(size).tolist():
        at = np.flatnonzero(size == w)
        out[at] = np.frombuffer(b"".join(values[i] for i in at.tolist()), f"<i{w}").reshape(len(at), width)
    return out


def products(v: np.ndarray, norm: np.ndarray, q: np.ndarray, floats: np.ndarray | None = None) -> np.ndarray:
    """Exact inner products of rows of integers with one, held within MOST.  ``norm`` are the rows' squared lengths, ``floats`` the rows as such.

    Every partial sum lies within the product of the lengths, which tells what arithmetic is exact.
    """
    size = np.sqrt(norm) * np.sqrt(np.square(q.astype(np.float64)).sum())
    if not len(size) or size.max() < 1 << 52:
        return ((v.astype(np.float64) if floats is None else floats) @ q.astype(np.float64)).astype(np.int64)
    out = v @ q  # wraps around where the next lines put it right
    for i in np.flatnonzero(size >= 1 << 62).tolist():
        out[i] = max(-MOST, min(MOST, sum(map(int.__mul__, v[i].tolist(), q.tolist()))))
    return out


def loose(width: int) -> float:
    """A factor of lengths by which distances may be off: the root of the relative rounding of their squares, and more."""
    return 8 * float(np.sqrt(np.finfo(np.float64).eps * (width + 8)))


def reach(norm_q: np.ndarray, norm_v: np.ndarray, score: np.ndarray, fuzz: np.ndarray) -> np.ndarray:
    """How far a vector's distance to the pivot may lie from the query's, for a score of at least ``score``."""
    far = np.sqrt(np.maximum(norm_q + norm_v - 2.0 * score, 0)) * (1 + SLACK) + SLACK + fuzz
    return np.where(score == NONE, np.inf, far)


def best(scores: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((uids[at], ids[at], -scores[at]))[:k]]


FOUND = "q_uid bigint, query_id bigint, uid bigint, vec_id bigint, score bigint"


def result(rows: list[tuple]) -> pa.Table:
    """Rows of q_uid, query_id, uids, ids, scores."""
    n = [len(r[2]) for r in rows]
    cat = lambda k: np.concatenate([r[k] for r in rows]).astype(np.int64) if rows else np.zeros(0, np.int64)
    return pa.table({"q_uid": np.repeat(np.array([r[0] for r in rows], np.int64), n), "query_id": np.repeat(np.array([r[1] for r in rows], np.int64), n), "uid": cat(2), "vec_id": cat(3), "score": cat(4)})


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row whose key is divisible by ``every``, the ``k`` other rows of highest score.

    Components x become floor(scale * x), x as double; the score is the inner product.  Returns ``query_id``,
    ``rank`` from 1, ``vec_id`` and ``score``; equal scores by smaller key.

    Vectors that are null or hold a null or non-finite component, and rows of null key take no part.  A component that
    doesn't fit a long after scaling, or a score among the results, is an error, as in SQL.  Vectors of different lengths are compared as if zeros followed the shorter.
    Equal vectors and repeated rows are rows of their own: each is a candidate for the other, and a query
    that occurs twice is answered twice.  Fewer than k candidates: all of them.  Other columns aren't read.
    Empty table: empty result.
    """
    with Scratch(vectors.sparkSession, "topk") as scratch:
        return _top_k(vectors, k, every, scale, key, vector, scratch)


def _top_k(vectors: DataFrame, k: int, every: int, scale: int, key: str, vector: str, scratch: Scratch) -> DataFrame:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(finite)
    large = F.raise_error(F.lit("a component doesn't fit a long: scale the vectors down")).cast("long")
    whole = lambda x: F.when(F.abs(x.cast("double") * scale) < LIMIT, F.floor(x.cast("double") * scale).cast("long")).otherwise(large)
    rows = rows.select(F.col(key).cast("long").alias("id"), F.transform(vector, whole).alias("v"))
    # ids first, so that a task sends a few numbers and not a few vectors to the driver
    ids = [r.id for r in rows.select("id").orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()]
    pivots = [r.v for r in rows.where(F.col("id").isin(ids)).groupBy("id").agg(F.min("v").alias("v")).orderBy("id").collect()]
    width = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 0)
    points = np.zeros((max(len(pivots), 1), width))
    for i, p in enumerate(pivots):
        points[i, : len(p)] = p
    off, longest = loose(width), float(np.sqrt((points * points).sum(1).max()))

    def to_pivots(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = v.astype(np.float64)
        norm = (v * v).sum(1)
        return norm, np.maximum(norm[:, None] + (points * points).sum(1) - 2 * v @ points.T, 0)

    def place(batches):
        for b in batches:
            v = matrix(b.column("v"), width)
            norm, far = to_pivots(v)
            near = far.argmin(1) if len(far) else np.zeros(0, np.int64)
            dist = np.sqrt(far[np.arange(len(near)), near])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(packed(v), pa.binary()), pa.array(near.astype(np.int32)), pa.array(dist), pa.array(norm)], ["id", "v", "pivot", "dist", "norm"])

    placed = rows.mapInArrow(place, "id bigint, v binary, pivot int, dist double, norm double")
    placed = scratch.write(placed.withColumn("uid", F.monotonically_increasing_id()), "placed")
    step = max(placed.agg(F.max("dist")).first()[0] or 0.0, 1.0) / ANNULI
    is_query = F.col("id") % every == 0
    annulus = placed.withColumn("annulus", F.floor(F.col("dist") / step).cast("int"))
    # PIVOTS * (ANNULI + 1) rows at most, at the driver and in the broadcast
    cells = annulus.groupBy("pivot", "annulus").agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("queries"), F.min("dist").alias("low"), F.max("dist").alias("high"), F.max("norm").alias("most"))
    cells = sorted(cells.collect())
    parts = vectors.sparkSession.createDataFrame([(c.pivot, c.annulus, -(-c.n // BLOCK)) for c in cells], "pivot int, annulus int, parts int")
    index = annulus.join(F.broadcast(parts), ["pivot", "annulus"]).withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))
    cell = {name: np.array([c[name] for c in cells], kind) for name, kind in (("pivot", np.int32), ("annulus", np.int32), ("n", np.int64), ("low", float), ("high", float), ("most", float))}
    block = ["pivot", "annulus", "part"]

    def seed(group: pa.Table) -> pa.Table:
        """Best scores within the block of each of its queries."""
        ids, uids = group["id"].to_numpy(), group["uid"].to_numpy()
        v, norm = unpacked(group["v"], width), group["norm"].to_numpy()
        floats = v.astype(np.float64)
        found = []
        for q in np.flatnonzero(ids % every == 0).tolist():
            scores = products(v, norm, v[q], floats)
            others = np.flatnonzero(uids != uids[q])
            at = others[best(scores[others], ids[others], uids[others], k)]
            found.append((uids[q], ids[q], uids[at], ids[at], scores[at]))
        return result(found)

    order = Window.partitionBy("q_uid").orderBy(F.desc("score"), "vec_id", "uid")
    found = scratch.write(index.select(*block, "id", "uid", "v", "norm").groupBy(*block).applyInArrow(seed, FOUND), "found")
    # queries of a pivot are numbered after those of the ones before it, and cut into groups that travel together
    before, total = [0] * (PIVOTS + 1), [1] * (PIVOTS + 1)
    for p in range(PIVOTS):
        total[p] = max(sum(c.queries for c in cells if c.pivot == p), 1)
        before[p + 1] = before[p] + total[p]
    of_pivot = lambda numbers: F.get(F.array(*(F.lit(x) for x in numbers)), F.col("pivot"))
    chunk = F.floor((of_pivot(before) + F.pmod(F.xxhash64("uid"), of_pivot(total))) / BLOCK).cast("int")
    own = index.where(is_query).select(F.col("uid").alias("q_uid"), F.col("id").alias("query_id"), F.col("v").alias("q"), F.col("norm").alias("q_norm"), chunk.alias("chunk"), *(F.col(c).alias(f"own_{c}") for c in block))
    own = scratch.write(own, "queries")

    def spread(first: int, last: int):
        """The annuli that each query goes to in a round: from the ``first`` on in the order of their bounds, those at its floor or above."""

        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, TOGETHER):
                    some = b.slice(at, TOGETHER)
                    norm, far = to_pivots(unpacked(some.column("q"), width))
                    e, floor = np.sqrt(far)[:, cell["pivot"]], some.column("floor").to_numpy()[:, None].astype(np.float64)
                    norm = norm[:, None]
                    gap = np.maximum(np.maximum(cell["low"] - e, e - cell["high"]), 0)
                    room = reach(norm, cell["most"], floor, off * (np.sqrt(norm) + np.sqrt(cell["most"]) + longest))
                    turn = np.argsort(np.argsort(-(norm + cell["most"] - gap * gap), axis=1, kind="stable"), axis=1, kind="stable")
                    q, c = np.nonzero((gap <= room) & (turn >= first) & (turn < last))
                    again = pa.array(q)
                    plain = [some.column(x).take(again) for x in ("q_uid", "chunk", "floor", "own_pivot", "own_annulus", "own_part")]
                    yield pa.RecordBatch.from_arrays([*plain, pa.array(cell["pivot"][c]), pa.array(cell["annulus"][c]), pa.array((-(-cell["n"][c] // BLOCK)).astype(np.int32)), pa.array(e[q, c])], ["q_uid", "chunk", "floor", "own_pivot", "own_annulus", "own_part", "pivot", "annulus", "parts", "q_dist"])

        return run

    def expand(left: pa.Table, right: pa.Table) -> pa.Table:
        """Best scores in a block of the queries that visit it."""
        if not left.num_rows or not right.num_rows:
            return result([])
        left = left.sort_by("dist")
        v, dist, ids, uids = unpacked(left["v"], width), left["dist"].to_numpy(), left["id"].to_numpy(), left["uid"].to_numpy()
        norm, floats = left["norm"].to_numpy(), v.astype(np.float64)
        most = norm.max()
        q = unpacked(right["q"], width)
        e, floors, q_norm = right["q_dist"].to_numpy(), right["floor"].to_numpy(), right["q_norm"].to_numpy()
        far = reach(q_norm, most, floors, off * (np.sqrt(q_norm) + np.sqrt(most) + longest))
        lows, highs = np.searchsorted(dist, e - far, "left"), np.searchsorted(dist, e + far, "right")
        found = []
        for i, (q_uid, query_id) in enumerate(zip(right["q_uid"].to_pylist(), right["query_id"].to_pylist())):
            a, b = lows[i], highs[i]
            scores = products(v[a:b], norm[a:b], q[i], floats[a:b])
            ok = np.flatnonzero((scores >= floors[i]) & (uids[a:b] != q_uid))
            if len(ok):
                at = ok[best(scores[ok], ids[a:b][ok], uids[a:b][ok], k)]
                found.append((q_uid, query_id, uids[a:b][at], ids[a:b][at], scores[at]))
        return result(found)

    is_own = (F.col("pivot") == F.col("own_pivot")) & (F.col("annulus") == F.col("own_annulus")) & (F.col("part") == F.col("own_part"))
    went = "q_uid bigint, chunk int, floor bigint, own_pivot int, own_annulus int, own_part int, pivot int, annulus int, parts int, q_dist double"
    first = 0
    for last in ROUNDS:
        if first >= len(cells):
            break
        floor = found.groupBy("q_uid").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(NONE)).alias("floor"))
        queries = own.join(floor, "q_uid", "left").withColumn("floor", F.coalesce("floor", F.lit(NONE)))
        visits = queries.drop("query_id", "q_norm").mapInArrow(spread(first, last), went)
        visits = visits.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where(~is_own)
        visits = scratch.write(visits.select("q_uid", "chunk", "floor", *block, "q_dist"), "visits")
        needed = visits.select(*block, F.col("chunk").alias("to")).distinct()
        stored = index.select(*block, "id", "uid", "v", "dist", "norm").join(needed, block)
        coming = visits.join(own.select("q_uid", "query_id", "q", "q_norm"), "q_uid")
        more = stored.groupBy(*block, "to").cogroup(coming.groupBy(*block, "chunk")).applyInArrow(expand, FOUND)
        both = found.unionByName(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = scratch.write(both.drop("rank"), "found")
        first = last
    score = F.when(F.abs("score") < MOST, F.col("score")).otherwise(F.raise_error(F.lit("a score doesn't fit a long: scale the vectors down")).cast("long"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return materialise(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score")), "topk")
