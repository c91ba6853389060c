import math

import pytest
from pyspark.sql import functions as F

from rowloom import sources as S
from rowloom.streaming import each_batch, event_windows


def test_make_sin(spark):
    rows = S.make_sin(spark, 5, 0.0, 4.0, noise=0.0).orderBy("_obs").collect()
    assert [r.x for r in rows] == [0.0, 1.0, 2.0, 3.0, 4.0] and all(abs(r.y - math.sin(r.x)) < 1e-12 for r in rows)
    noisy = [r.y for r in S.make_sin(spark, 100, seed=1).orderBy("_obs").collect()]
    assert noisy == [r.y for r in S.make_sin(spark, 100, seed=1).repartition(3).orderBy("_obs").collect()]


def test_make_poly(spark):
    xs = spark.range(201).select((F.col("id") + 1).alias("_obs"), ((F.col("id") - 100) / 10).alias("x"))
    assert all(abs(r.y - (0.8 * r.x**2 + 0.5 * r.x + 2)) < 1e-9 for r in S.make_poly(xs, [0.8, 0.5, 2], noise=0).collect())


def test_make_spiral_and_moons(spark):
    rows = S.make_spiral(spark, 10, noise=0).orderBy("_obs").collect()
    assert len(rows) == 20 and all((a.x1, a.x2, a.y) == (-b.x1, -b.x2, 1) for a, b in zip(rows[:10], rows[10:]) if (a.x1, a.x2) != (0.0, 0.0))
    moons = S.make_moons(spark, (30, 50), seed=3).collect()
    assert sum(r.y == 1 for r in moons) == 30 and len(moons) == 80
    assert all(abs(math.hypot(r.x1, r.x2) - 1) < 1e-9 for r in moons if r.y == 1)
    assert all(abs(math.hypot(1 - r.x1, 0.5 - r.x2) - 1) < 1e-9 for r in moons if r.y == 2)


def test_iris_file(spark, tmp_path):
    (tmp_path / "iris.csv").write_text("5.1,3.5,1.4,0.2,setosa\n6.0,2.9,4.5,1.5,versicolor\n")
    assert [r.species for r in S.load_iris(spark, str(tmp_path / "iris.csv")).collect()] == ["setosa", "versicolor"]


def test_containers(spark, tmp_path):
    made = S.from_arrays(spark, {"a": [1, 2, 3], "y": ["a", "b", "c"]}, "a long, y string")
    assert [(r._obs, r.a, r.y) for r in made.orderBy("_obs").collect()] == [(1, 1, "a"), (2, 2, "b"), (3, 3, "c")]
    with pytest.raises(ValueError):
        S.from_arrays(spark, {"a": [1], "b": [1, 2]})
    assert S.from_rows(spark, [(1, "x")], "a int, b string").first().b == "x"
    S.register_container(spark, "squares", lambda: 15, lambda i: (i * i,), "x long")
    read = spark.read.format("squares").load()
    assert sorted(map(tuple, read.collect())) == [(i, i * i) for i in range(1, 16)]
    S.write_table(made, str(tmp_path / "out"), by=["y"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_streams(spark, tmp_path):
    data = spark.createDataFrame([(i, f"2024-01-01 00:{i:02d}:00", float(i)) for i in range(30)], "id long, t string, v double").withColumn("t", F.to_timestamp("t"))
    data.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    each_batch(stream(), lambda d: d.where("v > 10"), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 19
    windows = event_windows(stream(), "t", "10 minutes", n=F.count("*"))
    q = windows.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    assert [r.n for r in spark.sql("select n from windows").collect()] == [10, 10, 10]
