"""Observations: a table, an order of its rows, and a dense 1-based number ``_obs`` in that order.

Every other operator is a column expression over ``_obs``.  Numbers are given without gathering the
rows in one place: the order key is cut at a few bounds, rows are numbered within each range, and
the range's offset is added.  Any bounds give the same numbers, so they may come from a sample.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBS = "_obs"
#: Up to so many rows one task numbers them all; beyond it they are numbered by range.
ONE_TASK = 250_000
ROWS_PER_RANGE = 1_000_000
MOST_RANGES = 4096
SAMPLE = 20_000
STEP = 64  # bounds between two that a row is compared with first

Key = str | Sequence[str]


def names(key: Key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def numobs(data: DataFrame) -> int:
    """How many observations there are."""
    return data.count()


def seeded_key(key: Key, seed: int, epoch: int = 0) -> Column:
    """A pseudo-random order key that depends on the row's own key, the seed and the epoch alone."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), *(F.col(c).cast("string") for c in names(key))))


def _range_of(df: DataFrame, columns: Sequence[Column], n: int, hexadecimal: bool) -> tuple[Column, int]:
    """The number of a row's range of the order by all ``columns``, and how many ranges there are.

    Bounds are quantiles of a sample, one constant of the plan; a row is compared with every 64th of them and then with
    those between two.
    """
    ranges = min(MOST_RANGES, n // ROWS_PER_RANGE + 2)
    if hexadecimal:  # the first digits of a digest are uniform
        ranges = 1 << (ranges - 1).bit_length()
        return (F.conv(F.substring(columns[0], 1, 3), 16, 10).cast("int") * ranges / 4096).cast("int"), ranges
    place = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(columns)))
    sample = df.select(place.alias("k")).sample(min(1.0, SAMPLE / max(n, 1)), seed=1)
    found = [r.j for r in sample.orderBy("k").select(F.to_json("k").alias("j")).collect()]
    bounds = list(dict.fromkeys(found[len(found) * i // ranges] for i in range(1, ranges))) if found else []
    if not bounds:
        return F.lit(0), 1
    kind = T.ArrayType(df.select(place.alias("k")).schema["k"].dataType)
    constant = lambda some: F.from_json(F.lit(f"[{','.join(some)}]"), kind)
    below = lambda bs: F.size(F.filter(bs, lambda b: b < place))
    coarse = below(constant(bounds[STEP - 1 :: STEP])) * STEP if len(bounds) >= STEP else F.lit(0)
    return coarse + below(F.slice(constant(bounds), coarse + 1, STEP)), len(bounds) + 1


def with_obs(df: DataFrame, order_by: Key, seed: int | None = None, epoch: int = 0, name: str = OBS, one_task: int = ONE_TASK) -> DataFrame:
    """``df`` with its dense observation number in the order of ``order_by``, or in a seeded random order.

    With ``seed`` the permutation is the same at any parallelism; another ``epoch`` gives another.  Order
    keys should identify a row; equal keys are numbered in no particular order.
    """
    keys = [F.col(c) for c in names(order_by)]
    if seed is not None:
        df = df.withColumn("_shuffle", seeded_key(order_by, seed, epoch))
        keys = [F.col("_shuffle"), *keys]
    n = df.count()
    if n <= one_task:
        out = df.withColumn(name, F.row_number().over(Window.orderBy(*keys)).cast("long"))
        return out.drop("_shuffle") if seed is not None else out
    part, _ = _range_of(df, keys, n, seed is not None)
    df = df.withColumn("_range", part)
    counts = {r["_range"]: r["count"] for r in df.groupBy("_range").count().collect()}  # MOST_RANGES rows at most
    offsets, total = [], 0
    for r in range(max(counts, default=0) + 1):
        offsets.append(total)
        total += counts.get(r, 0)
    offset = F.get(F.from_json(F.lit(str(offsets)), "array<bigint>"), F.col("_range"))
    numbered = df.withColumn(name, F.row_number().over(Window.partitionBy("_range").orderBy(*keys)).cast("long") + offset)
    return numbered.drop("_range", "_shuffle") if seed is not None else numbered.drop("_range")


def ranked_within(data: DataFrame, group: str, order_by: Key | None = None, seed: int | None = None, name: str = "_rank", one_task: int = ONE_TASK) -> DataFrame:
    """``data`` with each row's 1-based rank within its group, by ``_obs`` or ``order_by``, or at random by ``seed``.

    A group of very many rows isn't ranked in one task: rows are ranked by group and range of the order, and the
    counts of the group's ranges before are added.  null is a group.
    """
    by = OBS if order_by is None else order_by
    keys = [F.col(c) for c in names(by)]
    if seed is not None:
        data = data.withColumn("_order", seeded_key(by, seed))
        keys = [F.col("_order"), *keys]
    n = data.count()
    if n <= one_task:
        return data.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*keys)).cast("long")).drop("_order")
    part, _ = _range_of(data, keys, n, seed is not None)
    data = data.withColumn("_range", part)
    counts = data.groupBy(F.col(group).alias("_g"), F.col("_range").alias("_r")).agg(F.count("*").alias("_c"))  # a row per group and range
    before = Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    local = data.withColumn("_local", F.row_number().over(Window.partitionBy(group, "_range").orderBy(*keys)))
    joined = local.join(counts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn(name, F.col("_local") + F.col("_before")).drop("_local", "_before", "_g", "_r", "_range", "_order")


def shuffleobs(df: DataFrame, order_by: Key, seed: int = 0, epoch: int = 0) -> DataFrame:
    """A random permutation: ``_obs`` is the place in it.  All columns of a row move together."""
    return with_obs(df, order_by, seed, epoch)


def _check(indices: Sequence[int], n: int) -> None:
    out = [i for i in indices if not 1 <= i <= n]
    if out:
        raise IndexError(f"observation {out[0]} is outside 1..{n}")


def getobs(data: DataFrame, indices: int | Sequence[int] | None = None) -> DataFrame:
    """All observations, one, or those at ``indices`` with their order and repetitions kept (column ``_pos``)."""
    if indices is None:
        return data
    n = data.count()
    if isinstance(indices, int):
        _check([indices], n)
        return data.where(F.col(OBS) == indices)
    _check(indices, n)
    spark = data.sparkSession
    wanted = spark.createDataFrame([(p, int(i)) for p, i in enumerate(indices, 1)], f"_pos long, {OBS} long")
    return wanted.join(data, OBS).orderBy("_pos")


def obsview(data: DataFrame, indices: int | range | Sequence[int] | None = None) -> DataFrame:
    """A lazy subset, numbered anew from 1; views of views are one filter for the optimiser.

    A range stays a predicate on ``_obs``; a list becomes a join.
    """
    if indices is None:
        return data
    if isinstance(indices, int):
        indices = [indices]
    if isinstance(indices, range) and len(indices) and indices.step > 0:
        low, high, step = indices[0], indices[-1], indices.step
        _check([low, high], data.count())
        inside = F.col(OBS).between(low, high)
        if step > 1:
            inside = inside & ((F.col(OBS) - low) % step == 0)
        return data.where(inside).withColumn(OBS, ((F.col(OBS) - low) / step).cast("long") + 1)
    gathered = getobs(data, list(indices))
    return gathered.drop(OBS).withColumnRenamed("_pos", OBS)


def obsdim(data: DataFrame, column: str, level: int = 1, key: Key | None = None, rows: bool = False) -> DataFrame:
    """Observations along an inner dimension of an array column.

    ``level`` 1 is the outermost level of the array: observation i holds, in the rows' order, every row's
    i-th element.  Level 2 takes the i-th element of each inner array, and so on inwards.  With ``rows`` an observation's elements stay
    rows of their own, with the key of the row they come from: for tables whose rows don't fit in an array.
    """
    if level < 1:
        raise ValueError("level must be 1 at least")
    order = names(key) if key is not None else [OBS]
    pos = data.select(*order, F.col(column).alias("_v"))
    for k in range(1, level):
        pos = pos.select(*order, F.posexplode("_v").alias(f"_o{k}", "_v"))
        order = [*order, f"_o{k}"]
    pos = pos.select(*order, F.posexplode("_v").alias("_p", "_v"))
    if rows:
        return pos.select((F.col("_p") + 1).cast("long").alias("_dim"), *order, F.col("_v").alias(column))
    entry = F.struct(*(F.col(c) for c in order), F.col("_v").alias("_v"))
    grouped = pos.groupBy("_p").agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    return grouped.select((F.col("_p") + 1).cast("long").alias(OBS), F.transform("_e", lambda e: e["_v"]).alias(column))


def randobs(data: DataFrame, n: int = 1, seed: int = 0) -> DataFrame:
    """n observations drawn uniformly with replacement, in columns of ``data`` and ``_pos``."""
    total = data.count()
    if total == 0:
        raise ValueError("there is no observation to draw from")
    draws = data.sparkSession.range(1, n + 1).select(F.col("id").alias("_pos"), (F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), 1, 13), 16, 10).cast("long"), F.lit(total)) + 1).alias(OBS))
    return draws.join(data, OBS)


class Obs:
    """A data container: a table of observations in a declared order."""

    def __init__(self, df: DataFrame, order_by: Key, seed: int | None = None) -> None:
        self.order_by = order_by
        self.df = with_obs(df, order_by, seed)
        self._n: int | None = None

    @classmethod
    def _of(cls, df: DataFrame, order_by: Key) -> Obs:
        new = cls.__new__(cls)
        new.df, new.order_by, new._n = df, order_by, None
        return new

    def __len__(self) -> int:
        if self._n is None:
            self._n = self.df.count()
        return self._n

    def __getitem__(self, index: int | slice | Sequence[int]) -> Row | Obs:
        if isinstance(index, int):
            _check([index], len(self))
            return self.df.where(F.col(OBS) == index).drop(OBS).first()
        if isinstance(index, slice):
            index = range(index.start or 1, (index.stop or len(self)) + 1, index.step or 1)  # both ends count
            _check([index[0], index[-1]] if len(index) else [], len(self))
        return self._of(obsview(self.df, index), self.order_by)

    def __iter__(self) -> Iterator[Row]:
        return self.df.orderBy(OBS).drop(OBS).toLocalIterator(prefetchPartitions=True)

    def __eq__(self, other: object) -> bool:
        if not isinstance(other, Obs):
            return NotImplemented
        return self.df.schema == other.df.schema and len(self) == len(other) and self.df.exceptAll(other.df).isEmpty()

    __hash__ = None

    def __repr__(self) -> str:
        return f"Obs({self.df.drop(OBS)!r}, order_by={self.order_by!r})"

    def shuffled(self, seed: int = 0, epoch: int = 0) -> Obs:
        return self._of(with_obs(self.df.drop(OBS), self.order_by, seed, epoch), self.order_by)
