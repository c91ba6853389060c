import pytest
from pyspark.sql import functions as F

from rowloom import operators as O
from rowloom.operators.order import Obs, ranked_within, with_obs


def xs(df, column="x", by="_obs"):
    return [r[0] for r in df.orderBy(by).select(column).collect()]


@pytest.mark.parametrize("kind", ["bigint", "string", "double"])
def test_numbers_by_range_are_dense_and_ordered(spark, kind):
    df = spark.range(500).select((F.col("id") * 37 % 500).cast(kind).alias("k")).unionByName(spark.sql(f"select cast(null as {kind}) k"))
    one, many = with_obs(df, "k"), with_obs(df, "k", one_task=0)
    assert sorted(map(tuple, one.collect()), key=lambda r: r[1]) == sorted(map(tuple, many.collect()), key=lambda r: r[1])
    assert sorted(r._obs for r in many.collect()) == list(range(1, 502))


@pytest.mark.parametrize("step", [1, 3, 64])
def test_ranges_by_all_columns_of_the_order(spark, monkeypatch, step):
    """One value of the first column for all rows, nulls, and quotes in strings."""
    from rowloom.operators import order

    monkeypatch.setattr(order, "ROWS_PER_RANGE", 20)
    monkeypatch.setattr(order, "STEP", step)
    df = spark.range(400).selectExpr("1 as a", "case when id % 5 = 0 then null else cast(id * 37 % 7 as string) || '\"' end as b", "id * 11 % 400 as c", "timestamp_micros(id * 1001) as t")
    keys = ["a", "b", "c", "t"]
    many = with_obs(df, keys, one_task=0)
    assert sorted(map(tuple, many.collect()), key=repr) == sorted(map(tuple, with_obs(df, keys).collect()), key=repr)
    part, ranges = order._range_of(df, [F.col(c) for c in keys], 400, False)
    sizes = [r["count"] for r in df.groupBy(part.alias("r")).count().collect()]
    assert ranges > 15 and len(sizes) == ranges and max(sizes) < 60


def test_seeded_order_is_the_same_at_any_parallelism(spark):
    df = spark.range(300).withColumnRenamed("id", "k")
    first = with_obs(df, "k", seed=3).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert sorted(with_obs(df.repartition(5), "k", seed=3, one_task=0).collect()) == sorted(first)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(first) != sorted(with_obs(df, "k", seed=4).collect())
    assert sorted(first) != sorted(with_obs(df, "k", seed=3, epoch=1).collect())


def test_empty_table(spark):
    empty = spark.range(0).withColumnRenamed("id", "k")
    assert with_obs(empty, "k", one_task=-1).count() == 0
    assert O.numobs(empty) == 0


def test_getobs_keeps_order_and_repetitions(numbers):
    data = numbers(15)
    assert [r.x for r in O.getobs(data, [2, 1, 4, 2]).orderBy("_pos").collect()] == [2, 1, 4, 2]
    assert O.getobs(data, 3).first().x == 3
    assert O.getobs(data).count() == 15
    for bad in (0, 16, [1, 99]):
        with pytest.raises(IndexError):
            O.getobs(data, bad)


def test_views_of_views(numbers):
    view = O.obsview(numbers(100), range(21, 61))
    assert xs(O.obsview(view, range(1, 11, 3))) == [21, 24, 27, 30]
    assert xs(O.obsview(view, [5, 2])) == [25, 22]
    for bad in (range(3, 42), range(0, 4), [41], 0):
        with pytest.raises(IndexError):
            O.obsview(view, bad)
    assert xs(O.obsview(view, range(5, 5))) == []
    assert xs(O.obsview(view, 3)) == [23]


def test_obsdim(spark):
    df = spark.createDataFrame([(1, [[1, 2], [3, 4], [5, 6]]), (2, [[7, 8], [9, 10], [11, 12]])], "_obs long, x array<array<int>>")
    assert [r.x for r in O.obsdim(df, "x").orderBy("_obs").collect()] == [[[1, 2], [7, 8]], [[3, 4], [9, 10]], [[5, 6], [11, 12]]]
    assert [(r._dim, r._obs, r.x) for r in O.obsdim(df, "x", rows=True).orderBy("_dim", "_obs").collect()][:2] == [(1, 1, [1, 2]), (1, 2, [7, 8])]
    assert [r.x for r in O.obsdim(df, "x", 2).orderBy("_obs").collect()] == [[1, 3, 5, 7, 9, 11], [2, 4, 6, 8, 10, 12]]


def test_randobs_draws_with_replacement(numbers):
    data = numbers(5)
    drawn = [r.x for r in O.randobs(data, 200, seed=1).orderBy("_pos").collect()]
    assert len(drawn) == 200 and set(drawn) == {1, 2, 3, 4, 5}
    assert drawn == [r.x for r in O.randobs(data.repartition(3), 200, seed=1).orderBy("_pos").collect()]


def test_container(spark):
    data = Obs(spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, v string"), "k")
    assert len(data) == 3 and data[2].v == "b" and [r.v for r in data] == ["a", "b", "c"]
    assert [r.v for r in data[2:3]] == ["b", "c"] and len(data[[1, 1]]) == 2
    assert sorted(r.v for r in data.shuffled(1)) == ["a", "b", "c"]
    assert data == Obs(data.df.drop("_obs"), "k") and "order_by" in repr(data)
    with pytest.raises(IndexError):
        data[4]


@pytest.mark.parametrize("seed", [None, 7])
def test_ranks_within_large_groups(spark, seed):
    data = spark.range(1, 901).select(F.col("id").alias("_obs"), F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 9 == 0, F.lit(None)).otherwise(F.lit("cold")).alias("g"))
    one, many = (ranked_within(data, "g", seed=seed, one_task=n).collect() for n in (10_000, 0))
    assert sorted(one, key=lambda r: r._obs) == sorted(many, key=lambda r: r._obs)
    assert sorted(r._rank for r in many if r.g == "hot") == list(range(1, 601))
