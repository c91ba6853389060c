"""Small datasets for examples and tests, generated as columns of ``spark.range``.

Noise depends on seed and row number alone, so a dataset is the same at any parallelism.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IRIS = "sepal_length double, sepal_width double, petal_length double, petal_width double, species string"


def _uniform(seed: int, salt: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(salt)), F.col("id").cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _normal(seed: int, salt: int) -> Column:
    return F.sqrt(-2 * F.log(1 - _uniform(seed, 2 * salt))) * F.cos(2 * math.pi * _uniform(seed, 2 * salt + 1))


def load_iris(spark: SparkSession, path: str) -> DataFrame:
    """The iris measurements from a CSV file without header: four numbers and the species."""
    return spark.read.schema(IRIS).csv(path)


def make_sin(spark: SparkSession, n: int = 50, start: float = 0.0, stop: float = 2 * math.pi, noise: float = 0.3, seed: int = 0) -> DataFrame:
    """n points of a noisy sine, ``x`` evenly spaced with both ends."""
    step = (stop - start) / (n - 1) if n > 1 else 0.0
    points = spark.range(n).select("id", (F.lit(start) + F.col("id") * F.lit(step)).alias("x"))
    return points.select((F.col("id") + 1).alias("_obs"), "x", (F.sin("x") + F.lit(noise) * _normal(seed, 0)).alias("y"))


def make_poly(data: DataFrame, coef: Sequence[float], x: str = "x", noise: float = 0.1, seed: int = 0, key: str = "_obs") -> DataFrame:
    """Column ``y``: the polynomial of ``coef`` (highest degree first) at ``x``, with noise."""
    value = functools.reduce(lambda a, c: a * F.col(x) + F.lit(float(c)), coef, F.lit(0.0))
    return data.withColumn("id", F.col(key)).withColumn("y", value + F.lit(noise) * _normal(seed, 0)).drop("id")


def make_spiral(spark: SparkSession, n: int = 97, a: float = 6.5, theta: float = 16.0, b: float = 104.0, noise: float = 0.1, seed: int = 0) -> DataFrame:
    """Two spirals of n points each: label 1, and label 0 mirrored at the origin."""
    i = F.when(F.col("id") < n, F.col("id")).otherwise(F.col("id") - n)
    sign = F.when(F.col("id") < n, 1.0).otherwise(-1.0)
    angle, radius = i * F.lit(math.pi / theta), F.lit(a) * (F.lit(b) - i) / F.lit(b)
    points = spark.range(2 * n)
    return points.select(
        (F.col("id") + 1).alias("_obs"),
        (sign * radius * F.sin(angle) + F.lit(noise) * _normal(seed, 0)).alias("x1"),
        (sign * radius * F.cos(angle) + F.lit(noise) * _normal(seed, 1)).alias("x2"),
        F.when(F.col("id") < n, 1).otherwise(0).alias("y"),
    )


def make_moons(spark: SparkSession, n: int | tuple[int, int] = 100, noise: float = 0.0, shuffle: bool = True, seed: int = 0) -> DataFrame:
    """Two half circles: n[0] points of label 1 on the outer, n[1] of label 2 on the inner one.

    A single n is halved, the odd point going to the inner circle.  Labels go by circle also where the sizes differ.
    """
    n1, n2 = (n // 2, n - n // 2) if isinstance(n, int) else n
    outer, t = F.col("id") < n1, F.lit(math.pi) * _uniform(seed, 100)
    points = spark.range(n1 + n2).select(
        "id",
        (F.when(outer, F.cos(t)).otherwise(1 - F.cos(t)) + F.lit(noise) * _normal(seed, 0)).alias("x1"),
        (F.when(outer, F.sin(t)).otherwise(0.5 - F.sin(t)) + F.lit(noise) * _normal(seed, 1)).alias("x2"),
        F.when(outer, 1).otherwise(2).alias("y"),
        (F.col("id") + 1).alias("_obs"),
    )
    if shuffle:
        from rowloom.operators.order import with_obs

        points = with_obs(points.drop("_obs"), "id", seed)
    return points.select("_obs", "x1", "x2", "y")
