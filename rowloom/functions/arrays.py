"""Array functions.

A value of shape (d1, .., dk) is a nested array whose outermost level is dk.  So ``flatten`` reads it with the first
dimension running fastest, a new last dimension is one more level around, and a new first one a level inside.
Functions named ``*_rows`` treat a column's rows as the dimension instead.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.operators.order import OBS, ONE_TASK, _range_of

EPS = 1e-5


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _field(structs: str, name: str) -> Column:
    return F.transform(structs, lambda e: e[name])


# -- shape ---------------------------------------------------------------------------------------


def unsqueeze(x: Column | str, dims: int, ndims: int = 1) -> Column:
    """A dimension of size 1 at place ``dims`` of an array of ``ndims`` dimensions."""
    if not 1 <= dims <= ndims + 1:
        raise ValueError(f"dims must be between 1 and {ndims + 1}")
    x = _col(x)
    if dims == ndims + 1:
        return F.array(x)
    return F.transform(x, lambda e: unsqueeze(e, dims, ndims - 1) if ndims > 1 else F.array(e))


def stack(*xs: Column | str, dims: int = 2, ndims: int = 1) -> Column:
    """Arrays of ``ndims`` dimensions and equal sizes as one: a new dimension at place ``dims``, counted from the innermost.

    For plain arrays ``dims=2`` sets them side by side, ``dims=1`` zips their elements.
    """
    if not 1 <= dims <= ndims + 1:
        raise ValueError(f"dims must be between 1 and {ndims + 1}")
    columns = [_col(x) for x in xs]
    if dims == ndims + 1:
        return F.array(*columns)
    zipped = F.arrays_zip(*(c.alias(f"c{i}") for i, c in enumerate(columns)))
    return F.transform(zipped, lambda e: stack(*(e[f"c{i}"] for i in range(len(columns))), dims=dims, ndims=ndims - 1))


def unstack(data: DataFrame, column: str, dims: int = 2, ndims: int = 2) -> DataFrame:
    """A row per slice along dimension ``dims``, counted from the innermost, of an array of ``ndims`` dimensions, numbered in ``_pos`` from 1."""
    if not 1 <= dims <= ndims:
        raise ValueError(f"dims must be between 1 and {ndims}")

    def slice_at(x: Column, i: Column, depth: int) -> Column:
        return F.get(x, i) if depth == 0 else F.transform(x, lambda inner: slice_at(inner, i, depth - 1))

    x = F.col(column)
    if dims < ndims:
        first = x
        for _ in range(ndims - dims):
            first = F.get(first, F.lit(0))
        x = F.transform(F.sequence(F.lit(1), F.size(first)), lambda i: slice_at(F.col(column), i - 1, ndims - dims))
        x = F.when(F.size(first) > 0, x)
    others = [c for c in data.columns if c != column]
    return data.select(*others, F.posexplode(x).alias("_p", column)).select(*others, (F.col("_p") + 1).cast("long").alias("_pos"), column)


def flatten(x: Column | str, ndims: int = 2) -> Column:
    """An array of ``ndims`` dimensions as one of a single dimension: with the rows, all dimensions but the rows as one."""
    out = _col(x)
    for _ in range(ndims - 1):
        out = F.flatten(out)
    return out


def rpad_constant(x: Column | str, n: int, val: object = 0, kind: str = "double") -> Column:
    """``x`` filled up on its right to n elements; a longer one stays."""
    x = _col(x)
    return F.concat(x, F.array_repeat(F.lit(val).cast(kind), F.greatest(F.lit(n) - F.size(x), F.lit(0))))


def rpad_constant2(x: Column | str, n: tuple[int, int], val: object = 0, kind: str = "double") -> Column:
    """An array of arrays filled up to n[0] inner elements and n[1] arrays."""
    inner = F.transform(_col(x), lambda e: rpad_constant(e, n[0], val, kind))
    empty = F.array_repeat(F.lit(val).cast(kind), n[0])
    return F.concat(inner, F.array_repeat(empty, F.greatest(F.lit(n[1]) - F.size(inner), F.lit(0))))


# -- chunks --------------------------------------------------------------------------------------


def chunk_array(x: Column | str, n: int | None = None, size: int | Sequence[int] | None = None) -> Column:
    """Parts of an array: ``n`` of equal size (fewer, if that rounds up), of ``size`` each, or of given sizes."""
    x = _col(x)
    if (n is None) == (size is None):
        raise ValueError("give n or size")
    if n is not None or isinstance(size, int):
        step = F.ceil(F.size(x) / n).cast("int") if n is not None else F.lit(size)
        starts = F.when(F.size(x) > 0, F.sequence(F.lit(1), F.size(x), F.greatest(step, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.slice(x, i, step))
    parts, at = [], 1
    for s in size:
        parts.append(F.slice(x, at, s))
        at += s
    fits = F.when(F.size(x) != at - 1, F.raise_error(F.lit("sizes must sum to the array's length")))
    return F.when(fits.isNull(), F.array(*parts))


def chunk_rows(data: DataFrame, n: int | None = None, size: int | Sequence[int] | None = None, name: str = "_chunk") -> DataFrame:
    """Rows with the number of their chunk in observation order."""
    if (n is None) == (size is None):
        raise ValueError("give n or size")
    if n is not None or isinstance(size, int):
        step = size if size is not None else max(1, -(-data.count() // n))
        return data.withColumn(name, F.floor((F.col(OBS) - 1) / step).cast("long") + 1)
    total = data.count()
    if sum(size) != total:
        raise ValueError(f"sizes sum to {sum(size)}, not to {total}")
    out, stop = F.lit(len(size)), total
    for k in range(len(size) - 1, 0, -1):
        stop -= size[k]
        out = F.when(F.col(OBS) <= stop, F.lit(k)).otherwise(out)
    return data.withColumn(name, out.cast("long"))


def chunk_by_partition(data: DataFrame, part: str, columns: Sequence[str], npartitions: int | None = None) -> DataFrame:
    """A row per partition number from 1, with arrays of its rows' columns; empty partitions have empty arrays.

    Partition numbers must not fall along the observations.
    """
    late = data.agg(F.max(F.struct(OBS, part))[part].alias("last"), F.max(part).alias("most")).first()
    if late["last"] is not None and late["last"] != late["most"]:
        raise ValueError("partition numbers must be sorted")
    m = npartitions or late["most"] or 0
    entry = F.struct(F.col(OBS), *(F.col(c) for c in columns))
    rows = data.groupBy(F.col(part).cast("long").alias("_chunk")).agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    every = data.sparkSession.range(1, m + 1).select(F.col("id").alias("_chunk")).join(rows, "_chunk", "left")
    return every.select("_chunk", *(F.coalesce(_field("_e", c), F.array().cast(T.ArrayType(data.schema[c].dataType))).alias(c) for c in columns))


# -- scaling -------------------------------------------------------------------------------------


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, also where ``f`` uses it for every element."""
    return F.transform(F.array(value), f)[0]


def normalise(x: Column | str, eps: float = EPS) -> Column:
    """An array less its mean, by its population deviation + eps."""
    x = _col(x).cast("array<double>")
    mean = F.aggregate(x, F.lit(0.0), lambda a, e: a + e) / F.size(x)
    spread = lambda m: F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, e: a + (e - m) * (e - m)) / F.size(x))
    return _let(mean, lambda m: _let(spread(m), lambda d: F.transform(x, lambda e: (e - m) / (d + eps))))


def rescale(x: Column | str, eps: float = EPS) -> Column:
    """An array from 0 to just under 1."""
    x = _col(x).cast("array<double>")
    return _let(F.array_min(x), lambda low: _let(F.array_max(x), lambda high: F.transform(x, lambda e: (e - low) / (high - low + eps))))


def normalise_rows(data: DataFrame, column: str, name: str | None = None, eps: float = EPS) -> DataFrame:
    """A numeric column less its mean over the rows, by its population deviation + eps; two numbers are aggregated first."""
    mean, spread = data.agg(F.avg(column), F.stddev_pop(column)).first()
    return data.withColumn(name or column, (F.col(column) - F.lit(mean)) / (F.lit(spread) + F.lit(eps)))


def rescale_rows(data: DataFrame, column: str, name: str | None = None, eps: float = EPS) -> DataFrame:
    low, high = data.agg(F.min(column), F.max(column)).first()
    return data.withColumn(name or column, (F.col(column) - F.lit(low)) / (F.lit(high) - F.lit(low) + F.lit(eps)))


# -- arrays like others --------------------------------------------------------------------------


def fill_like(x: Column | str, val: object, kind: str = "double", size: int | None = None) -> Column:
    """``val`` as often as ``x`` has elements, or ``size`` times; a fraction can't fill an integral type."""
    if kind in ("tinyint", "smallint", "int", "bigint", "long", "integer") and isinstance(val, float) and val != int(val):
        raise ValueError(f"{val} isn't a {kind}")
    filler = F.lit(val).cast(kind)
    return F.array_repeat(filler, size) if size is not None else F.transform(_col(x), lambda _: filler)


def zeros_like(x: Column | str, kind: str = "double", size: int | None = None) -> Column:
    return fill_like(x, 0, kind, size)


def ones_like(x: Column | str, kind: str = "double", size: int | None = None) -> Column:
    return fill_like(x, 1, kind, size)


def trues_like(x: Column | str, size: int | None = None) -> Column:
    return fill_like(x, True, "boolean", size)


def falses_like(x: Column | str, size: int | None = None) -> Column:
    return fill_like(x, False, "boolean", size)


def _uniform(row: Column, i: Column, seed: int, salt: int) -> Column:
    """In [0, 1), from the row's key and the element's place alone."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(salt)), row.cast("string"), i.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def rand_like(x: Column | str, key: Column | str, seed: int = 0, size: int | None = None) -> Column:
    """Uniform numbers in [0, 1) that depend on seed, the row's key and place: the same at any parallelism."""
    places = F.sequence(F.lit(1), F.lit(size) if size is not None else F.size(_col(x)))
    return F.transform(places, lambda i: _uniform(_col(key), i, seed, 0))


def randn_like(x: Column | str, key: Column | str, seed: int = 0, size: int | None = None) -> Column:
    """Standard normal numbers, likewise."""
    places = F.sequence(F.lit(1), F.lit(size) if size is not None else F.size(_col(x)))
    return F.transform(places, lambda i: F.sqrt(-2 * F.log(1 - _uniform(_col(key), i, seed, 1))) * F.cos(2 * F.pi() * _uniform(_col(key), i, seed, 2)))


# -- search and order ----------------------------------------------------------------------------


def _less(a: Column, b: Column) -> Column:
    return (a < b) & ~F.isnan(a.cast("double")) & ~F.isnan(b.cast("double"))


def _no_more(a: Column, b: Column) -> Column:
    return (a <= b) & ~F.isnan(a.cast("double")) & ~F.isnan(b.cast("double"))


def searchsortedfirst(xp: Column, x: Column | str, rev: bool = False) -> Column:
    """1 + how many of the sorted ``xp`` come before ``x``; NaN comes neither before nor after."""
    x = _col(x)
    return F.size(F.filter(xp, lambda e: _less(x, e) if rev else _less(e, x))) + 1


def searchsortedlast(xp: Column, x: Column | str, rev: bool = False) -> Column:
    """How many of the sorted ``xp`` aren't after ``x``."""
    x = _col(x)
    return F.size(F.filter(xp, lambda e: _no_more(x, e) if rev else _no_more(e, x)))


def searchsorted_rows(data: DataFrame, column: str, bounds: DataFrame, bound: str, name: str = "_first") -> DataFrame:
    """``searchsortedfirst`` of each row in a long column of bounds: 1 + how many bounds lie below, null and NaN ones left out.

    Different values and bounds are sorted together within ranges, each adds the bounds of those before it, and rows
    take their value's place: bounds needn't fit in an array, and a value of very many rows is one to sort.
    A null or NaN value has no bound below.
    """
    def real(df: DataFrame) -> Column:
        floating = isinstance(df.schema["_x"].dataType, (T.FloatType, T.DoubleType))
        return F.col("_x").isNotNull() & ~F.isnan("_x") if floating else F.col("_x").isNotNull()

    some, values = bounds.select(F.col(bound).alias("_x")), data.select(F.col(column).alias("_x"))
    some = some.where(real(some)).groupBy("_x").agg(F.count("*").alias("_b"))
    values = values.where(real(values)).distinct().withColumn("_b", F.lit(0).cast("long"))
    both = some.unionByName(values).groupBy("_x").agg(F.sum("_b").alias("_b"))
    n = both.count()
    part, _ = _range_of(both, [F.col("_x")], n, False) if n > ONE_TASK else (F.lit(0), 1)
    both = both.withColumn("_r", part)
    per = {r["_r"]: r["n"] for r in both.groupBy("_r").agg(F.sum("_b").alias("n")).collect()}  # MOST_RANGES rows at most
    before, offsets = 0, []
    for r in range(max(per, default=0) + 1):
        offsets.append(before)
        before += per.get(r, 0)
    order = Window.partitionBy("_r").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.get(F.from_json(F.lit(str(offsets)), "array<bigint>"), F.col("_r"))
    found = both.select("_x", (F.coalesce(F.sum("_b").over(order), F.lit(0)) + offset + 1).alias("_place"))
    return data.join(found, F.col(column) == F.col("_x"), "left").withColumn(name, F.coalesce("_place", F.lit(1).cast("long"))).drop("_x", "_place")


def topk(x: Column | str, k: int, rev: bool = True) -> Column:
    """Struct of ``values`` and 1-based ``indices`` of the k largest (``rev=False``: smallest) elements, best first; ties by index."""
    if k < 1:
        raise ValueError("k must be 1 at least")
    x = _col(x)
    sign = -1 if rev else 1
    order = F.slice(F.array_sort(F.transform(x, lambda v, i: F.struct((v * sign).alias("o"), (i + 1).cast("long").alias("i"), v.alias("v")))), 1, k)
    few = F.when(F.size(x) < k, F.raise_error(F.lit(f"k={k} is more than the array's length")))
    return F.when(few.isNull(), F.struct(F.transform(order, lambda e: e["v"]).alias("values"), F.transform(order, lambda e: e["i"]).alias("indices")))


def topk_rows(data: DataFrame, column: str, k: int, rev: bool = True) -> DataFrame:
    """The k rows of largest (smallest) value, ties by ``_obs``: a bounded heap in each task."""
    if k < 1:
        raise ValueError("k must be 1 at least")
    return data.orderBy(F.desc(column) if rev else F.asc(column), OBS).limit(k)


def topk_per_group(data: DataFrame, column: str, k: int, group: str, rev: bool = True) -> DataFrame:
    """The k best rows of each group with ``_rank``; each task cuts its groups to k rows before the exchange."""
    order = Window.partitionBy(group).orderBy(F.desc(column) if rev else F.asc(column), OBS)
    return data.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)
