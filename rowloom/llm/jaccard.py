"""Jaccard self-join of documents on word n-grams, and its connected components.

1.  Each text becomes a set of 64-bit shingle hashes.  Texts of equal sets are one class from here on.
2.  Prefix filter: of a set of n in an order common to all, the first n - ceil(t n) + 1 hashes are its keys; sets
    that link share a key.  The order is that of the hashes, but for frequent keys, which go last.  Keys that one class
    alone has are dropped.
3.  Within a key, classes may link if their sizes fit and if their parity sketches (512 bits, each
    the parity of the hashes that fall on it) differ in no more bits than linked sets can differ
    in.  A spanning forest of these candidates is kept, never all pairs; its components over
    all keys are coarse clusters.  A link lies within one cluster.  Clusters are split once more in the same
    way, with sketches of a bit or two for each hash, which tell long texts apart as well.  Of a key that very many classes have,
    those may link only that share another key of prefixes longer by one, so they are compared by such pairs of keys.
4.  Within a cluster the links are searched by T-occurrence with DivideSkip: a set's inverted lists
    are ordered by length, the short ones are merged, and the long ones, T - 1 at most, are
    probed by binary search for the candidates met so far.  A pair that reaches the needed overlap is checked
    exactly.  Classes that are joined already are skipped, as only components are wanted.
A cluster too large for a task is compared with its least class first, which joins most of a group of near copies; only what
that leaves is dealt out in pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.common import Scratch, filled, fresh, materialise, pieces, slices
from rowloom.llm.components import components

SKETCH_BITS = 512
KEY_BLOCK = 8192  # classes of a key handled together
CLUSTER_BLOCK = 2048  # classes of a cluster handled together
FREQUENT = 32  # documents of a shingle that goes last in the order of keys
MOST_FREQUENT = 100_000  # of such shingles
BLOCK_SHINGLES = 1 << 20  # of the classes of a cluster handled together

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes, ascending: of ``width`` words, or of all words if fewer."""
    off, words = pieces(pc.ascii_split_whitespace(pc.ascii_lower(texts)))
    coded = words.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], np.uint64)
    code = coded.indices.to_numpy(zero_copy_only=False)
    real = np.array([bool(w) for w in distinct], bool)[code] if len(code) else np.zeros(0, bool)
    kept = np.concatenate([[0], np.cumsum(real)])[off]
    h = hashes[code[real]] if len(code) else np.zeros(0, np.uint64)
    n = max(len(h) - width + 1, 0)
    every = np.zeros(n, np.uint64)
    for k in range(width):
        every += h[k : k + n] * _C[k % 5] + np.uint64(k // 5)
    every = mix(every)
    for a, b in zip(kept[:-1].tolist(), kept[1:].tolist()):
        if b - a >= width:
            yield np.unique(every[a : b - width + 1])
        elif b > a:
            yield mix((h[a:b] * np.array(_C, np.uint64)[np.arange(b - a) % 5]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield h[:0]


def prefix_length(n: int, percent: int) -> int:
    return n + (-percent * n) // 100 + 1 if n else 0


def whole_groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``column``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        value = batch.column(column)
        if value[0] == value[-1] and held[0].column(column)[0] == value[0]:
            continue
        table = pa.Table.from_batches(held)
        keys = value.to_numpy(zero_copy_only=False)
        cut = table.num_rows - batch.num_rows + int(np.searchsorted(keys, keys[-1])) if keys[0] <= keys[-1] else 0
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parity of the hashes at each bit: a power of two of bits, SKETCH_BITS at least, and as many as there are hashes at least."""
    bits = max(SKETCH_BITS, 1 << max(len(hashes) - 1, 0).bit_length())
    flags = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flags.astype(np.uint8), bitorder="little").view("<u8")


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch of fewer bits that the same hashes give."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


class Sketches:
    """Sketches of several widths; two are compared at the lesser width."""

    def __init__(self, own: list[np.ndarray]) -> None:
        self.own = own
        self.words = np.array([len(x) for x in own], np.int64)
        self.rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w in np.unique(self.words).tolist():
            at = np.flatnonzero(self.words >= w)  # also the wider, folded
            place = np.full(len(own), -1, np.int64)
            place[at] = np.arange(len(at))
            self.rows[w] = (np.stack([own[i] if len(own[i]) == w else folded(own[i], w) for i in at.tolist()]), place)

    def apart(self, x: int, others: np.ndarray) -> np.ndarray:
        """In how many bits the sketch of x differs from each other one."""
        out = np.zeros(len(others), np.int64)
        width = np.minimum(self.words[others], self.words[x])
        for w in np.unique(width).tolist():
            some = width == w
            rows, place = self.rows[w]
            out[some] = np.bitwise_count(rows[place[others[some]]] ^ rows[place[x]]).sum(1, dtype=np.int64)
        return out


def candidate_forest(n: np.ndarray, sketches: Sketches, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Root and members of each component of classes that may link; ``n`` ascends."""
    left = np.arange(len(n))
    while len(left) > 1:
        root, left = int(left[0]), left[1:]
        frontier, found = [root], []
        while frontier and len(left):
            x = frontier.pop()
            a, b = np.searchsorted(n[left], [-(-percent * n[x] // 100), 100 * n[x] // percent + 1])
            near = left[a:b]
            ok = sketches.apart(x, near) * (100 + percent) <= (n[near] + n[x]) * (100 - percent)
            if ok.any():
                hit = near[ok]
                found.append(hit)
                frontier += hit.tolist()
                left = np.concatenate([left[:a], near[~ok], left[b:]])
        if found:
            yield root, np.concatenate(found)


class Forest:
    """Union-find over 0..n-1; a root is the least of its tree."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def t_occurrence(sets: list[np.ndarray], percent: int, sides: np.ndarray | None = None) -> Forest:
    """Components of links among ``sets``, ascending in size.  With ``sides``, sets of one side aren't compared."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    shingles, first, length = np.unique(flat[order], return_index=True, return_counts=True)
    lists = owner[order]  # of each shingle, ascending
    forest = Forest(len(sets))
    at = np.searchsorted(shingles, flat)
    ends = np.cumsum(sizes)
    roots = np.arange(len(sets))
    for x in range(1, len(sets)):
        need = -(-percent * int(sizes[x]) // 100)
        low = int(np.searchsorted(sizes, need))  # partners are no larger than x, and no smaller than this
        if low >= x:
            continue
        own = at[ends[x] - sizes[x] : ends[x]]
        own = own[np.argsort(length[own], kind="stable")]
        n_short = len(own) - (need - 1)
        short = np.concatenate([lists[first[s] : first[s] + length[s]] for s in own[:n_short].tolist()])
        short = short[(short >= low) & (short < x)]
        if sides is not None:
            short = short[sides[short] != sides[x]]
        mine = forest.root(x)
        short = short[roots[short] != mine]
        if not len(short):
            continue
        short.sort(kind="stable")  # merges the lists' runs
        cand, count = np.unique(short, return_counts=True)
        rest = own[n_short:].tolist()
        for k, s in enumerate(rest):
            keep = count + (len(rest) - k) >= need
            if not keep.all():
                cand, count = cand[keep], count[keep]
                if not len(cand):
                    break
            own_list = lists[first[s] : first[s] + length[s]]
            count = count + (own_list[np.minimum(np.searchsorted(own_list, cand), len(own_list) - 1)] == cand)
        joined = False
        for y, both in zip(cand.tolist(), count.tolist()):
            if 100 * both >= percent * (int(sizes[x] + sizes[y]) - both):
                forest.join(x, y)
                joined = True
        if joined:
            roots = np.array([forest.root(i) for i in range(x + 1)] + list(range(x + 1, len(sets))))
    return forest


def near_pivot(percent: int, exact: bool) -> Callable:
    """Marks rows of large clusters whose set (or sketch, if not ``exact``) links, or may link, with the pivot's."""

    def run(batches):
        for batch in batches:
            n, p_n = batch.column("n").to_numpy(), batch.column("p_n").to_numpy()
            core = []
            for x, p, a, b in zip(batch.column("data").to_pylist(), batch.column("p_data").to_pylist(), n.tolist(), p_n.tolist()):
                if exact:
                    both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(p, np.uint64), assume_unique=True))
                    core.append(100 * both >= percent * (a + b - both))
                else:
                    apart = int(Sketches([np.frombuffer(x, "<u8"), np.frombuffer(p, "<u8")]).apart(0, np.array([1]))[0])
                    core.append(100 * min(a, b) >= percent * max(a, b) and apart * (100 + percent) <= (a + b) * (100 - percent))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "root", "n", "weight", "data")), pa.array(core, pa.bool_())], ["id", "root", "n", "weight", "data", "core"])

    return run


def filled_clusters(members: DataFrame, scratch: Scratch) -> DataFrame:
    """With ``fill``, the sum of the weights in each row's cluster."""
    members = scratch.write(members, "members")
    return scratch.write(members.join(members.groupBy("root").agg(F.sum("weight").alias("fill")), "root"), "filled")


def dealt_out(rows: DataFrame, percent: int, exact: bool, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows of clusters dealt out into tasks, and links found on the way.

    ``rows`` have id, root, n, data, ``weight``, their part of a task's fill, and ``fill``, that of the cluster.  A cluster that fills one task at
    most is a task.  Of a larger one every row is compared with its pivot, the root.  Those that link with
    it are joined by that, so they needn't meet each other: only the rest is dealt out as pairs of blocks,
    and as blocks against blocks of the linked ones.  A large group of copies of one text is so dealt out in proportion to its size.
    """
    columns = ["id", "n", "data"]
    small = rows.where("fill <= 1").select(F.xxhash64("root").alias("task"), *columns, F.lit(0).alias("side"), F.lit(False).alias("paired"))
    large = rows.where("fill > 1")
    pivots = large.where("id = root").dropDuplicates(["root"]).select("root", F.col("n").alias("p_n"), F.col("data").alias("p_data"))
    flagged = large.join(pivots, "root").select("id", "root", "n", "weight", "data", "p_n", "p_data").mapInArrow(near_pivot(percent, exact), "id bigint, root bigint, n bigint, weight double, data binary, core boolean")
    flagged = scratch.write(flagged, "flagged")
    links = flagged.where("core and id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
    blocks = lambda which: F.ceil(F.coalesce(F.sum(F.when(which, F.col("weight"))), F.lit(0.0))).cast("int")
    parts = flagged.groupBy("root").agg(blocks(F.col("core")).alias("cores"), blocks(~F.col("core")).alias("rests")).where("rests > 0")
    placed = flagged.join(parts, "root").withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("core"), F.col("cores")).otherwise(F.col("rests"))).cast("int"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    core = placed.where("core").withColumn("other", upto("rests"))
    core = core.select(F.xxhash64("root", "own", "other", F.lit("core")).alias("task"), *columns, F.lit(-1).alias("side"), F.lit(True).alias("paired"))
    rest = placed.where("not core")
    against = rest.where("cores > 0").withColumn("other", upto("cores")).select(F.xxhash64("root", "other", "own", F.lit("core")).alias("task"), *columns, F.col("own").alias("side"), F.lit(True).alias("paired"))
    among = rest.withColumn("other", upto("rests")).select(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("task"), *columns, F.col("own").alias("side"), (F.col("own") != F.col("other")).alias("paired"))
    return small.unionByName(core).unionByName(against).unionByName(among), links


def frequent_keys(docs: DataFrame, text: str, width: int, percent: int, scratch: Scratch) -> np.ndarray:
    """Shingles that are keys of many documents, MOST_FREQUENT at most: they go last in the order of keys.

    Any order common to all documents finds all links; this one keeps the shingles of passages that many documents
    share out of the keys of documents that aren't alike.  A task passes on what it has met twice or more.
    """

    def run(batches):
        held = [np.zeros(0, np.uint64)]
        for part in slices(batches):
            held += [s[: prefix_length(len(s), percent)] for s in shingle_sets(filled(part), width)]
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        again = counts > 1
        yield pa.RecordBatch.from_arrays([pa.array(keys[again].view(np.int64)), pa.array(counts[again].astype(np.int64))], ["key", "n"])

    met = docs.select(docs[text].alias("text")).mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    met = scratch.write(met.where(F.col("n") >= FREQUENT), "frequent")
    # how many keys have each order of magnitude, from the top; it tells from where on all can be taken
    steps = met.groupBy(F.floor(F.log2("n")).cast("int").alias("step")).count().orderBy(F.desc("step")).collect()
    total, least = 0, None
    for r in steps:
        total += r["count"]
        if total > MOST_FREQUENT:
            break
        least = 1 << r["step"]
    rows = [] if least is None else met.where(F.col("n") >= least).select("key").collect()
    return np.sort(np.array([r.key for r in rows], np.int64).view(np.uint64))


def shingled(docs: DataFrame, key: str, text: str, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """``id``, ``n``, ``sig`` (digest of the set), ``sketch``, ``wide`` (sketch) and ``prefix`` (keys in their order, and one more) of every document."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_keys(docs, text, width, percent, scratch))  # 800 KB at most

    def keys_of(s: np.ndarray) -> np.ndarray:
        n = prefix_length(len(s), percent) + 1  # one more, for pairs of keys
        known = frequent.value
        late = known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s if len(known) else np.zeros(len(s), bool)
        return np.concatenate([s[~late][:n], s[late]])[:n]

    def run(batches):
        for part in slices(batches):
            n, sig, sketch, wide, prefix = [], [], [], [], []
            for s in shingle_sets(filled(part), width):
                n.append(len(s))
                sig.append(xxhash.xxh3_128_digest(s.tobytes()))
                own = parity_sketch(s)
                sketch.append(folded(own, SKETCH_BITS // 64).tobytes())
                wide.append(own.tobytes())
                prefix.append(keys_of(s).view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(key).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(sketch, pa.binary()), pa.array(wide, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))], ["id", "n", "sig", "sketch", "wide", "prefix"])

    return docs.select(key, docs[text].alias("text")).mapInArrow(run, "id bigint, n bigint, sig binary, sketch binary, wide binary, prefix array<bigint>")


def candidates(percent: int) -> Callable:
    def run(batches):
        for table in whole_groups(batches, "task"):
            task = table["task"].to_numpy()
            ids, n = table["id"].to_numpy(), table["n"].to_numpy()
            sketch = [np.frombuffer(x, "<u8") for x in table["data"].to_pylist()]
            starts = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(task)]]))
            two = starts[sizes == 2]  # most keys have two classes
            low, high = np.minimum(n[two], n[two + 1]), np.maximum(n[two], n[two + 1])
            fits = two[100 * low >= percent * high]
            apart = [Sketches(sketch[i : i + 2]).apart(0, np.array([1]))[0] if len(sketch[i]) != len(sketch[i + 1]) else int(np.bitwise_count(sketch[i] ^ sketch[i + 1]).sum()) for i in fits.tolist()]
            fits = fits[np.array(apart, np.int64) * (100 + percent) <= (n[fits] + n[fits + 1]) * (100 - percent)]
            a, b = [ids[fits]], [ids[fits + 1]]
            for s, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                order = s + np.argsort(n[s : s + size], kind="stable")
                for root, members in candidate_forest(n[order], Sketches([sketch[i] for i in order.tolist()]), percent):
                    a.append(ids[order[members]])
                    b.append(np.full(len(members), ids[order[root]]))
            links = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    return run


def searched(percent: int) -> Callable:
    def run(batches):
        for table in whole_groups(batches, "task"):
            task, ids, sides, paired = (table[c].to_numpy() for c in ("task", "id", "side", "paired"))
            starts = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1], [True]]))
            a, b = [], []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                sets = [np.frombuffer(x, np.uint64) for x in table["data"].slice(s, e - s).to_pylist()]
                order = sorted(range(e - s), key=lambda i: (len(sets[i]), ids[s + i]))
                forest = t_occurrence([sets[i] for i in order], percent, sides[s:e][order] if paired[s] else None)
                for i, x in enumerate(order):
                    r = forest.root(i)
                    if r != i:
                        a.append(int(ids[s + x]))
                        b.append(int(ids[s + order[r]]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def searched_groups(dealt: DataFrame, search: Callable) -> DataFrame:
    return dealt.repartition("task").sortWithinPartitions("task").mapInArrow(search, "a bigint, b bigint")


def clustered(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``id`` and ``root`` of every id of a link, roots too."""
    found = components(links, "a", "b", scratch.write)
    return found.select(F.col("node").alias("id"), "root").unionByName(found.select(F.col("root").alias("id"), "root").distinct())


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text", key_block: int = KEY_BLOCK, cluster_block: int = CLUSTER_BLOCK) -> DataFrame:
    """Key, ``n_shingles`` and ``component_id`` (the least key reachable by links) of every document.

    Words are separated by ASCII white space, A-Z lower-cased.  Two documents link when
    100 * |intersection| >= percent * |union| of their sets of ``width``-word shingles.

    A text of fewer words has its whole sequence as one shingle.  null and empty text: an empty set,
    linked with nothing.  A null key: n_shingles as usual, component_id null, no links.  Repeated rows:
    a row each, all of the component of their key.  Very long texts are taken whole.  Columns beside the
    two named aren't read.  Empty table: empty result.
    """
    with Scratch(docs.sparkSession, "jaccard") as scratch:
        return _jaccard_components(docs, width, percent, key, text, key_block, cluster_block, scratch)


def _jaccard_components(docs: DataFrame, width: int, percent: int, key: str, text: str, key_block: int, cluster_block: int, scratch: Scratch) -> DataFrame:
    base = scratch.write(shingled(docs, key, text, width, percent, scratch), "shingles")
    usable = base.where(F.col("id").isNotNull() & (F.col("n") > 0))
    classes = usable.groupBy("sig").agg(F.min("id").alias("rep"))
    member = usable.select("id", "sig").join(classes, "sig").where("id <> rep").select("id", "rep")
    reps = usable.join(classes, "sig").where("id = rep").dropDuplicates(["id", "sig"])

    upto = F.least(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1, F.size("prefix"))  # keys proper
    keys = reps.select("id", F.explode(F.slice("prefix", F.lit(1), upto.cast("int"))).alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    held = scratch.write(keys.join(shared.hint("shuffle_hash"), "key"), "held")
    # a key of very many classes: two that link share another one of the longer prefixes, but for sets of which one shingle is enough
    crowded = held.where(F.col("held") > key_block).select("id", "key").join(reps.select("id", "n", "prefix"), "id")
    alone = F.when(F.col("n") * percent <= 100, F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    second = F.concat(F.transform(F.filter("prefix", lambda x: x != F.col("key")), lambda x: F.xxhash64(F.least(x, F.col("key")), F.greatest(x, F.col("key")))), F.transform(alone, lambda x: F.xxhash64("key", x, F.lit("alone"))))
    pairs = crowded.select("id", F.explode(second).alias("key")).distinct()
    paired = pairs.groupBy("key").agg(F.count("*").alias("held"), F.min("id").alias("least")).where("held > 1")
    held_pairs = scratch.write(pairs.join(paired, "key"), "pairs")
    # a pair of keys of very many classes makes one cluster of them, which the next step splits
    joined = held_pairs.where((F.col("held") > key_block) & (F.col("id") != F.col("least"))).select(F.col("id").alias("a"), F.col("least").alias("b"))
    tasks = held.where(F.col("held") <= key_block).select("id", F.col("key").alias("task")).unionByName(held_pairs.where(F.col("held") <= key_block).select("id", F.col("key").alias("task")))
    described = tasks.join(reps.select("id", "n", F.col("sketch").alias("data")), "id")
    coarse = clustered(searched_groups(described, candidates(percent)).unionByName(joined), scratch)
    wide = filled_clusters(coarse.withColumn("weight", F.lit(1.0 / key_block)), scratch).join(reps.select("id", "n", F.col("wide").alias("data")), "id")
    dealt, near = dealt_out(wide, percent, False, scratch)
    fine = clustered(searched_groups(dealt, candidates(percent)).unionByName(near), scratch)
    weight = F.greatest(F.lit(1.0 / cluster_block), F.col("n") / BLOCK_SHINGLES)
    clusters = filled_clusters(fine.join(reps.select("id", "n"), "id").select(F.col("id").alias("node"), "root", weight.alias("weight")), scratch)

    def sets_of(batches):
        for part in slices(batches):
            sets = list(shingle_sets(filled(part), width))
            yield pa.RecordBatch.from_arrays([part.column("node"), *(part.column(c) for c in ("root", "weight", "fill")), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["id", "root", "weight", "fill", "n", "data"])

    texts = docs.select(F.col(key).cast("long").alias("node"), F.col(text).alias("text")).join(clusters, "node")
    sets = scratch.write(texts.mapInArrow(sets_of, "id bigint, root bigint, weight double, fill double, n bigint, data binary").where("n > 0"), "sets")
    dealt, near = dealt_out(sets, percent, True, scratch)
    links = searched_groups(dealt, searched(percent)).unionByName(near)
    links = links.unionByName(member.select(F.col("id").alias("a"), F.col("rep").alias("b")))
    final = components(links, "a", "b", scratch.write).select(F.col("node").alias("id"), "root")
    found = base.select("id", F.col("n").alias("n_shingles")).join(final, "id", "left")
    return materialise(found.select(F.col("id").alias(key), "n_shingles", F.coalesce("root", "id").alias("component_id")), "components")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, the one of least key, with all its columns.

    Of repeated rows of a key and text one stays.  Different texts of one key are documents of their own; a further one
    counts as of a key beyond all.  Rows of null key stay all.  Texts without words are no group, so they stay.  Very long texts are taken
    whole.  Empty table: empty result.  What goes is listed and joined, so that texts stay where they are while the list is short.
    """
    node, nth, digest, gone = (fresh(docs.columns, c) for c in ("_node", "_nth", "_digest", "_gone"))
    rows = docs.where(F.col(key).isNotNull())
    several = materialise(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias(gone)), "several")
    if several.isEmpty():
        named = docs.withColumn(node, F.col(key).cast("long"))
    else:
        again = rows.join(several, F.col(key) == F.col(gone), "left_semi").withColumn(digest, F.coalesce(F.md5(text), F.lit("")))
        same = Window.partitionBy(key, digest).orderBy(*(F.xxhash64(c) for c in docs.columns))
        again = again.withColumn(nth, F.row_number().over(same)).where(F.col(nth) == 1)
        again = again.withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(digest)))
        other = F.xxhash64(key, digest).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
        again = again.withColumn(node, F.when(F.col(nth) == 1, F.col(key).cast("long")).otherwise(other)).drop(digest, nth)
        once = docs.join(several, F.col(key) == F.col(gone), "left_anti").withColumn(node, F.col(key).cast("long"))
        named = once.unionByName(again)
    found = jaccard_components(named, width, percent, node, text)
    far = materialise(found.where(F.col("component_id") != F.col(node)).select(F.col(node).alias(gone)).distinct(), "far")
    return named.join(far, F.col(node) == F.col(gone), "left_anti").select(*docs.columns)
