import pytest
from pyspark.sql import functions as F

from rowloom import operators as O
from rowloom.operators.transform import in_group


def test_mapobs_modes_agree(numbers):
    data = numbers(10)
    auto = O.mapobs(lambda d: [(d.x * 2).alias("y")], data)
    always = O.mapobs(lambda f: f.assign(y=f.x * 2)[["_obs", "y"]], data, "always", "_obs long, y long")
    never = O.mapobs(lambda r: (r._obs, r.x * 2), data, "never", "_obs long, y long")
    want = [(i, 2 * i) for i in range(1, 11)]
    for got in (auto, always, never):
        assert sorted(map(tuple, got.collect())) == want
    with pytest.raises(ValueError):
        O.mapobs(lambda r: r, data, "always")
    with pytest.raises(ValueError):
        O.mapobs(lambda r: r, data, "sometimes", "x int")


def test_named_maps_are_pruned(spark, tmp_path):
    spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").write.parquet(str(tmp_path / "t"))
    made = O.mapobs({"p": lambda d: d.a + 1, "q": "b * 2"}, spark.read.parquet(str(tmp_path / "t")))
    assert made.first() == (2, 4)
    plan = made.select("p")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<a:int>" in plan


def test_tuple_of_maps(numbers):
    first, second = O.mapobs((lambda d: [d.x], lambda d: [(-d.x).alias("x")]), numbers(3))
    assert sorted(r.x for r in first.collect()) == [1, 2, 3] and sorted(r.x for r in second.collect()) == [-3, -2, -1]


def test_filter_and_groups(spark, numbers):
    assert O.filterobs(lambda d: d.x > 5, numbers(10)).count() == 5
    nulls = spark.createDataFrame([(1, None), (2, 3)], "_obs long, x int")
    assert O.filterobs("x > 0", nulls).count() == 1
    data = spark.range(-10, 11).select(F.col("id").alias("x"), (F.col("id") + 11).alias("_obs"))
    grouped = O.groupobs(lambda d: d.x > 0, data)
    assert {r._group: r["count"] for r in grouped.groupBy("_group").count().collect()} == {True: 10, False: 11}
    assert in_group(O.groupobs("x", nulls), None).first()._obs == 1


def test_joinobs(numbers, spark):
    both = O.joinobs(numbers(5), numbers(5).withColumn("x", F.col("x") + 5))
    assert [r.x for r in O.getobs(both, [5, 6]).orderBy("_pos").collect()] == [5, 6]
    nested = O.joinobs(O.joinobs(numbers(10), numbers(10)), numbers(10))
    assert nested.count() == 30 and O.getobs(nested, 25).first().x == 5
    mixed = O.joinobs(numbers(1), spark.createDataFrame([(1, "a")], "_obs long, y string"))
    assert [(r.x, r.y) for r in mixed.orderBy("_obs").collect()] == [(1, None), (None, "a")]


def test_shuffle_moves_columns_together(spark):
    data = spark.range(50).select("id", (F.col("id") * 2).alias("y"))
    moved = O.shuffleobs(data, "id", 5).orderBy("_obs").collect()
    assert all(r.y == 2 * r.id for r in moved) and sum(r.id for r in moved) == 1225 and [r.id for r in moved] != list(range(50))
