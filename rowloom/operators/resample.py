"""Over- and undersampling by label.

Labels are counted once; a label's count is joined to its rows, and each row decides by its rank within the label.
Ranking is the one exchange of the rows; a label of very many rows is ranked by ranges of the order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.operators.order import Key, ranked_within


def oversample(data: DataFrame, label: str, fraction: float = 1.0, seed: int | None = 0, order_by: Key | None = None) -> DataFrame:
    """Each label brought up to ``round(fraction * largest count)`` rows (half to even); larger ones stay.

    Rows are copied as often as they go into the target, and the remainder is drawn without replacement, at random by
    ``seed`` or in order where it is None.  ``_copy`` numbers a row's copies from 1.
    """
    counts = data.groupBy(label).agg(F.count("*").alias("_c"))
    most = counts.agg(F.max("_c")).first()[0] or 0
    target = round(fraction * most)
    table = counts.select(F.col(label).alias("_l"), "_c")
    ranked = ranked_within(data, label, order_by, seed).join(table, F.col(label).eqNullSafe(F.col("_l")))
    copies = F.when(F.lit(target) > F.col("_c"), F.floor(F.lit(target) / F.col("_c")) + F.when(F.col("_rank") <= F.lit(target) % F.col("_c"), 1).otherwise(0)).otherwise(1)
    return ranked.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies.cast("int")))).drop("_rank", "_c", "_l")


def undersample(data: DataFrame, label: str, seed: int | None = 0, order_by: Key | None = None) -> DataFrame:
    """Each label brought down to the smallest one's count, at random by ``seed`` or the first rows where it is None."""
    least = data.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    return ranked_within(data, label, order_by, seed).where(F.col("_rank") <= least).drop("_rank")
