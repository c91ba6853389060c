"""Batches, collation, sequences, windows, and loops over them."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.operators.order import OBS, Key, with_obs

BATCH = "_batch"


def _field(structs: str, name: str) -> Column:
    return F.transform(structs, lambda e: e[name])


def batched(data: DataFrame, size: int, partial: bool = True) -> DataFrame:
    """``data`` with its batch number from 1; without ``partial`` the last, smaller batch goes."""
    if size < 1:
        raise ValueError("size must be 1 at least")
    numbered = data.withColumn(BATCH, F.floor((F.col(OBS) - 1) / size).cast("long") + 1)
    return numbered if partial else numbered.where(F.col(BATCH) <= data.count() // size)


def collate(data: DataFrame, columns: Sequence[str], how: str = "columns", by: str = BATCH) -> DataFrame:
    """A row per batch: an array per column in observation order, or with ``how="rows"`` one array of structs.

    A batch is bounded by its size, so its arrays are too.
    """
    entry = F.struct(F.col(OBS), *(F.col(c) for c in columns))
    rows = data.groupBy(by).agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    if how == "rows":
        return rows.select(by, F.transform("_e", lambda e: F.struct(*(e[c].alias(c) for c in columns))).alias("batch"))
    if how != "columns":
        raise ValueError("how must be columns or rows")
    return rows.select(by, *(_field("_e", c).alias(c) for c in columns))


def collate_with(data: DataFrame, by: str = BATCH, **aggregates: Column) -> DataFrame:
    """A row per batch of aggregates of the caller's."""
    return data.groupBy(by).agg(*(c.alias(k) for k, c in aggregates.items()))


class BatchView:
    """A table as a vector of batches.  ``collate``: None or False keeps rows, True stacks columns, a function maps the batch's table."""

    def __init__(self, data: DataFrame, batchsize: int = 1, partial: bool = True, collate: bool | Callable[[DataFrame], DataFrame] | None = None) -> None:
        if batchsize < 1:
            raise ValueError("batchsize must be 1 at least")
        self.n = data.count()
        if self.n < batchsize and self.n:
            warnings.warn(f"there are {self.n} observations, fewer than a batch of {batchsize}", stacklevel=2)
            batchsize = self.n
        self.data, self.batchsize, self.partial, self.collate = data, batchsize, partial, collate
        self.df = batched(data, batchsize, partial)

    def __len__(self) -> int:
        return -(-self.n // self.batchsize) if self.partial else self.n // self.batchsize

    def __getitem__(self, index: int | Sequence[int]) -> DataFrame:
        """A batch, or several as one; repeated numbers count once."""
        wanted = [index] if isinstance(index, int) else sorted(set(index))
        for i in wanted:
            if not 1 <= i <= len(self):
                raise IndexError(f"batch {i} is outside 1..{len(self)}")
        rows = self.df.where(F.col(BATCH).isin(wanted))
        if callable(self.collate):
            return self.collate(rows)
        if self.collate:
            columns = [c for c in self.data.columns if c != OBS]
            return collate(rows.withColumn(BATCH, F.lit(1)), columns).drop(BATCH)
        return rows

    def getobs(self) -> DataFrame:
        """All observations, also of a batch that is left out."""
        return self.data

    def __iter__(self) -> Iterator[list[Row]]:
        current, rows = None, []
        for row in self.df.orderBy(OBS).toLocalIterator(prefetchPartitions=True):
            if current is not None and row[BATCH] != current:
                yield rows
                rows = []
            current = row[BATCH]
            rows.append(row)
        if rows:
            yield rows

    def __repr__(self) -> str:
        return f"BatchView({self.data!r}, batchsize={self.batchsize}, partial={self.partial})"


class DataLoader:
    """Epochs of mini-batches; with ``shuffle`` each epoch has a permutation of its own, the same for the same seed.

    ``table(epoch)`` is the distributed form: a table with a batch number.  Iteration streams the rows of an epoch to
    the driver, partition by partition.  ``collate``: None or False yields a batch as a list of rows, True as a dict
    of lists, one for each column, and a function what it makes of the list of rows.  A batchsize of 0 or less yields rows.
    """

    def __init__(self, data: DataFrame, order_by: Key, batchsize: int = 1, shuffle: bool = False, partial: bool = True, collate: bool | Callable[[list[Row]], object] | None = None, seed: int = 0) -> None:
        self.data, self.order_by, self.batchsize, self.shuffle, self.partial, self.collate, self.seed = data, order_by, batchsize, shuffle, partial, collate, seed
        self.epoch = 0
        self._then: list[Callable] = []

    def __len__(self) -> int:
        n = self.data.count()
        if self.batchsize <= 0:
            return n
        return -(-n // self.batchsize) if self.partial else n // self.batchsize

    def table(self, epoch: int = 0) -> DataFrame:
        numbered = with_obs(self.data, self.order_by, self.seed if self.shuffle else None, epoch)
        return batched(numbered, self.batchsize, self.partial) if self.batchsize > 0 else numbered

    def map(self, f: Callable) -> DataLoader:
        """A loader whose batches go through ``f`` after collation, which must be set."""
        if self.batchsize <= 0:
            raise ValueError("batchsize must be 1 at least to map over batches")
        if self.collate is None:
            raise ValueError("set collate to True, False or a function to map over batches")
        new = DataLoader(self.data, self.order_by, self.batchsize, self.shuffle, self.partial, self.collate, self.seed)
        new._then = [*self._then, f]
        return new

    def __iter__(self) -> Iterator:
        epoch, self.epoch = self.epoch, self.epoch + 1
        frame = self.table(epoch)
        if self.batchsize <= 0:
            yield from frame.orderBy(OBS).toLocalIterator(prefetchPartitions=True)
            return
        rows: list[Row] = []
        current = None
        for row in frame.orderBy(OBS).toLocalIterator(prefetchPartitions=True):
            if current is not None and row[BATCH] != current:
                yield self._made(rows)
                rows = []
            current = row[BATCH]
            rows.append(row)
        if rows:
            yield self._made(rows)

    def _made(self, rows: list[Row]) -> object:
        out: object = rows
        if callable(self.collate):
            out = self.collate(rows)
        elif self.collate:
            out = {c: [r[c] for r in rows] for c in self.data.columns}
        for f in self._then:
            out = f(out)
        return out


def eachobs(data: DataFrame, order_by: Key, batchsize: int = -1, **options) -> DataLoader:
    """Observations one by one, or in batches."""
    return DataLoader(data, order_by, batchsize, **options)


def batch(data: DataFrame, columns: Sequence[str], by: str | None = None) -> DataFrame:
    """Rows stacked along a new outermost dimension: an array per column, names sorted.

    Without ``by`` the whole table becomes one row, which is for small tables.
    """
    entry = F.struct(F.col(OBS), *(F.col(c) for c in columns))
    grouped = data.groupBy(by) if by else data.groupBy()
    rows = grouped.agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    return rows.select(*([by] if by else []), *(_field("_e", c).alias(c) for c in sorted(columns)))


def unbatch(data: DataFrame, column: str) -> DataFrame:
    """A row per element of an array column, numbered in ``_pos`` from 1."""
    others = [c for c in data.columns if c != column]
    return data.select(*others, F.posexplode(column).alias("_p", column)).select(*others, (F.col("_p") + 1).cast("long").alias("_pos"), column)


def _element(data: DataFrame, column: str) -> T.DataType:
    return data.schema[column].dataType.elementType


def batch_sequence(data: DataFrame, column: str, pad: object = 0) -> DataFrame:
    """Every sequence padded on the right to the longest one."""
    longest = data.agg(F.max(F.size(column))).first()[0] or 0
    filler = F.lit(pad).cast(_element(data, column)) if not isinstance(pad, Column) else pad
    return data.withColumn(column, F.concat(column, F.array_repeat(filler, F.lit(longest) - F.size(column))))


def batchseq(data: DataFrame, column: str, pad: object = 0) -> DataFrame:
    """A row per step: ``_step`` from 1 and an array of all sequences' elements there, padded, in observation order."""
    padded = batch_sequence(data, column, pad).select(OBS, F.posexplode(column).alias("_p", "_v"))
    steps = padded.groupBy("_p").agg(F.array_sort(F.collect_list(F.struct(OBS, "_v"))).alias("_e"))
    return steps.select((F.col("_p") + 1).cast("long").alias("_step"), F.transform("_e", lambda e: e["_v"]).alias(column))


def slidingwindow(data: DataFrame, size: int, stride: int = 1) -> DataFrame:
    """A row per observation and complete window it lies in: ``_win`` from 1 and ``_pos`` in it from 1.

    A row is exploded into its windows by arithmetic on ``_obs``: no exchange, no frame in one task.
    Aggregate or collate by ``_win``; combining before the exchange keeps that light.
    """
    n = data.count()
    if size < 1 or stride < 1:
        raise ValueError("size and stride must be 1 at least")
    if size > n:
        raise ValueError(f"size {size} is more than the {n} observations")
    windows = (n - size) // stride + 1
    first = F.greatest(F.ceil((F.col(OBS) - size) / stride), F.lit(0))
    last = F.least(F.floor((F.col(OBS) - 1) / stride), F.lit(windows - 1))
    inside = data.where(first <= last).withColumn("_win", F.explode(F.sequence(first.cast("long") + 1, last.cast("long") + 1)))
    return inside.withColumn("_pos", F.col(OBS) - (F.col("_win") - 1) * stride)
