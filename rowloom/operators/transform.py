"""Maps, filters, groups and concatenation of observations; all lazy."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.operators.order import OBS


def _kept(data: DataFrame) -> list[str]:
    return [OBS] if OBS in data.columns else []


def mapobs(
    f: Callable | Mapping[str, Callable | Column | str] | Sequence[Callable],
    data: DataFrame,
    batched: str = "auto",
    schema: str | T.StructType | None = None,
) -> DataFrame | list[DataFrame]:
    """``f`` applied to every observation.

    *   ``batched="auto"``: ``f`` takes the table and returns columns (or a mapping of names to them); the same
        expression serves one observation and many, and stays in generated code.
    *   ``batched="always"``: ``f`` takes and returns a pandas DataFrame of many observations; ``schema`` names its columns.
    *   ``batched="never"``: ``f`` takes one Row and returns a tuple; ``schema`` as before.
    *   a mapping gives named columns, of which unused ones are pruned; a sequence gives a list of tables.
    """
    if isinstance(f, Mapping):
        made = {k: F.expr(v) if isinstance(v, str) else v if isinstance(v, Column) else v(data) for k, v in f.items()}
        return data.select(*_kept(data), *(c.alias(k) for k, c in made.items()))
    if isinstance(f, (list, tuple)):
        return [mapobs(g, data, batched, schema) for g in f]
    if batched == "auto":
        made = f(data)
        if isinstance(made, Mapping):
            return mapobs(made, data)
        return data.select(*_kept(data), *(made if isinstance(made, (list, tuple)) else [made]))
    if schema is None:
        raise ValueError("schema must name the columns that f returns")
    if batched == "always":

        def many(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield f(frame)

        return data.mapInPandas(many, schema)
    if batched == "never":
        kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        columns = data.columns

        @F.udf(kind, useArrow=True)
        def one(*values):
            return f(Row(*columns)(*values))

        return data.select(one(*columns).alias("_r")).select("_r.*")
    raise ValueError("batched must be auto, always or never")


def filterobs(f: Callable[[DataFrame], Column] | Column | str, data: DataFrame) -> DataFrame:
    """Observations for which ``f`` holds; those for which it is null are dropped."""
    return data.where(f(data) if callable(f) and not isinstance(f, Column) else f)


def groupobs(f: Callable[[DataFrame], Column] | Column | str, data: DataFrame, name: str = "_group") -> DataFrame:
    """Each observation with its group; aggregate over ``name``, or take one group with ``in_group``.  null is a group."""
    column = f(data) if callable(f) and not isinstance(f, Column) else F.expr(f) if isinstance(f, str) else f
    return data.withColumn(name, column)


def in_group(grouped: DataFrame, value, name: str = "_group") -> DataFrame:
    """The observations of one group, in their order."""
    return grouped.where(F.col(name).eqNullSafe(F.lit(value)))


def joinobs(*datas: DataFrame) -> DataFrame:
    """Concatenation: observations of the first table, then the second's; ``_obs`` goes on, ``_src`` tells the table.

    Columns that one table lacks are null there.  Sizes are counted once to offset the numbers.
    """
    if not datas:
        raise ValueError("joinobs needs a table at least")
    out, offset = None, 0
    for k, data in enumerate(datas, 1):
        part = data.withColumn("_src", F.lit(k))
        if OBS in data.columns:
            part = part.withColumn(OBS, F.col(OBS) + offset)
            if k < len(datas):
                offset += data.count()
        if out is not None and "_src" in data.columns:
            part = part.withColumn("_src", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
