"""Connected components of a table of links, without a driver-side graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import materialise

HOT = 1_000_000  # links of a node that are joined where they stand


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first()
    return int(row[0]), int(row[1] or 0)


def with_one(many: DataFrame, one: DataFrame, links: int) -> DataFrame:
    """``many`` joined with the only row of ``one`` (u, m, n: how many links u has) for each u.

    Nodes of over ``HOT`` links, of which there can't be more than ``2 * links / HOT``, are joined where their links stand.
    """
    if links <= HOT:
        return many.join(one.select("u", "m"), "u")
    hot = one.where(F.col("n") > HOT).select("u", F.col("m").alias("hot"))
    marked = many.join(F.broadcast(hot), "u", "left")
    rest = marked.where("hot is null").drop("hot").join(one.where(F.col("n") <= HOT).select("u", "m"), "u")
    return rest.unionByName(marked.where("hot is not null").withColumnRenamed("hot", "m"))


def components(links: DataFrame, a: str, b: str, write: Callable[[DataFrame, str], DataFrame] = materialise) -> DataFrame:
    """Columns ``node`` and ``root`` (the least node reachable) for every node of ``links`` but roots.

    Alternating large-star and small-star steps; each links every node to the least of its
    neighbourhood.  Minima are pre-aggregated, and the links of a node of very many aren't gathered in one place.  The
    number of rounds is logarithmic in the longest path; ``write`` cuts the lineage after each.  A null id takes no part.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    edges = write(edges, "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = with_one(both.where("v > u"), least, state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = with_one(large, low, state[0]).select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = write(small, "links")
        new = _state(edges)
        if new == state:
            break
        state = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
