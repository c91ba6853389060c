"""Splits and folds, as columns computed from ``_obs`` and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.operators.order import OBS, ranked_within


def _parts(n: int, shares: list[float]) -> list[int]:
    """Sizes of all parts but the last: each share is cut from what is left, the others rescaled to the rest."""
    if not shares:
        return []
    head, tail = shares[0], shares[1:]
    if not 0 <= head <= 1:
        raise ValueError(f"a share of {head} isn't between 0 and 1")
    size = round(n * head)
    rest = n - size
    if tail and rest:
        tail = [(s * n) / rest for s in tail]
    return [size, *_parts(rest, tail)]


def split_bounds(n: int, at: float | int | Sequence[float] | Sequence[int]) -> list[tuple[int, int]]:
    """First and last observation of each part of n, by shares or counts; halves are rounded to even.

    Every share after the first is taken of what is left, so a tuple isn't the rounding of each product.
    """
    many = list(at) if isinstance(at, (tuple, list)) else [at]
    kinds = {isinstance(x, int) and not isinstance(x, bool) for x in many}
    if len(kinds) > 1:
        raise TypeError("at must be shares or counts, not both")
    if kinds == {True}:
        if n == 0:
            raise ValueError("counts can't be taken of no observation")
        many = [x / n for x in many]
    bounds, start = [], 1
    for size in _parts(n, [float(x) for x in many]):
        bounds.append((start, start + size - 1))
        start += size
    return [*bounds, (start, n)]


def _split_case(number: Column, bounds: Sequence[tuple[Column | int, Column | int]]) -> Column:
    out = None
    for k, (_, stop) in enumerate(bounds[:-1], 1):
        hit = number <= stop
        out = F.when(hit, F.lit(k)) if out is None else out.when(hit, F.lit(k))
    return (F.lit(1) if out is None else out.otherwise(F.lit(len(bounds)))).cast("int")


def splitobs(data: DataFrame, at: float | int | Sequence, stratified: str | None = None, name: str = "_split") -> DataFrame:
    """``data`` with the number of its part, from 1.  Shuffle first for a random split.

    With ``stratified`` the shares hold within each label.  Labels are counted (a row each); their bounds
    are joined to the rows.
    """
    if stratified is None:
        bounds = split_bounds(data.count(), at)
        return data.withColumn(name, _split_case(F.col(OBS), bounds))
    counts = data.groupBy(stratified).count()
    total = data.count()
    many = list(at) if isinstance(at, (tuple, list)) else [at]
    shares = [x / total for x in many] if all(isinstance(x, int) and not isinstance(x, bool) for x in many) else [float(x) for x in many]
    left, bounds, rest = F.col("count").cast("double"), [], [F.lit(s) for s in shares]
    stop = F.lit(0.0)
    for k in range(len(shares)):
        size = F.rint(left * rest[k])
        stop = stop + size
        bounds.append(stop.cast("long"))
        after = left - size
        rest = [r if i <= k else F.when(after > 0, r * left / after).otherwise(r) for i, r in enumerate(rest)]
        left = after
    table = counts.select(F.col(stratified).alias("_label"), *(b.alias(f"_stop{k}") for k, b in enumerate(bounds)))
    ranked = ranked_within(data, stratified)
    joined = ranked.join(table, F.col(stratified).eqNullSafe(F.col("_label")))
    case = _split_case(F.col("_rank"), [*((0, F.col(f"_stop{k}")) for k in range(len(shares))), (0, 0)])
    return joined.withColumn(name, case).drop("_rank", "_label", *(f"_stop{k}" for k in range(len(shares))))


def fold_column(number: Column, n: int | Column, k: int) -> Column:
    """The fold of an observation number: n div k each, the first n mod k one more; closed form."""
    if isinstance(n, int):
        if not 2 <= k <= n:
            raise ValueError(f"k must be between 2 and n={n}, not {k}")
        n = F.lit(n)
    q, r = F.floor(n / k), n % k
    cut = r * (q + 1)
    return F.when(number <= cut, F.floor((number - 1) / (q + 1)) + 1).otherwise(r + F.floor((number - 1 - cut) / q) + 1).cast("int")


def kfolds(data: DataFrame, k: int = 5, stratified: str | None = None, name: str = "_fold") -> DataFrame:
    """``data`` with its fold.  Fold i is validated by ``_fold == i`` and trained by ``_fold != i``."""
    if stratified is None:
        return data.withColumn(name, fold_column(F.col(OBS), data.count(), k))
    if k < 2:
        raise ValueError("k must be 2 at least")
    counts = data.groupBy(F.col(stratified).alias("_label")).agg(F.count("*").alias("_n"))
    least = counts.agg(F.min("_n")).first()[0]
    if least is None or least < k:
        raise ValueError(f"a label has fewer rows than k={k}")
    ranked = ranked_within(data, stratified).join(counts, F.col(stratified).eqNullSafe(F.col("_label")))
    return ranked.withColumn(name, fold_column(F.col("_rank"), F.col("_n"), k)).drop("_rank", "_n", "_label")


def kfolds_long(folded: DataFrame, k: int, name: str = "_fold") -> DataFrame:
    """A row per observation and round, with ``_round`` and ``_role`` (train or val)."""
    rounds = folded.withColumn("_round", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return rounds.withColumn("_role", F.when(F.col(name) == F.col("_round"), "val").otherwise("train"))


def leavepout(data: DataFrame, p: int = 1, name: str = "_fold") -> DataFrame:
    """Folds of p observations, or a few more; p=1 leaves one out, where the fold is ``_obs``."""
    n = data.count()
    if not 1 <= p <= n // 2:
        raise ValueError(f"p must be between 1 and n/2, not {p}")
    return data.withColumn(name, fold_column(F.col(OBS), n, n // p).cast("long"))


def timeseries_bounds(n: int, k: int = 5, gap: int = 0, max_train_size: int | None = None) -> list[tuple[int, int, int, int]]:
    """First and last observation of training and validation in each round; validation follows training."""
    if not 2 <= k <= n - 1:
        raise ValueError(f"k must be between 2 and n-1={n - 1}, not {k}")
    if gap < 0:
        raise ValueError("gap can't be negative")
    if max_train_size is not None and max_train_size < 1:
        raise ValueError("max_train_size must be 1 at least")
    size = n // (k + 1)
    if size < 1:
        raise ValueError(f"{n} observations are too few for k={k}")
    out = []
    for i in range(k, 0, -1):
        start = n - i * size + 1
        last = start - 1 - gap
        if last < 1:
            raise ValueError(f"gap={gap} leaves no training in a round")
        out.append((1 if max_train_size is None else max(1, last - max_train_size + 1), last, start, start + size - 1))
    return out


def timeseries_kfolds(data: DataFrame, k: int = 5, gap: int = 0, max_train_size: int | None = None) -> DataFrame:
    """A row per observation and round it takes part in, with ``_round`` and ``_role``.

    The k rounds' bounds are literals, so a row is exploded where it stands: no join, no exchange.
    """
    bounds = timeseries_bounds(data.count(), k, gap, max_train_size)
    roles = [F.struct(F.lit(i).alias("_round"), F.when(F.col(OBS).between(a, b), "train").when(F.col(OBS).between(c, d), "val").alias("_role")) for i, (a, b, c, d) in enumerate(bounds, 1)]
    return data.withColumn("_r", F.explode(F.array(*roles))).where("_r._role is not null").select(*data.columns, "_r._round", "_r._role")
