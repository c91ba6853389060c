import math

import pytest
from pyspark.sql import functions as F

from rowloom import functions as A
from rowloom.functions.arrays import rpad_constant2


@pytest.fixture
def one(spark):
    return lambda value, kind="array<double>": spark.createDataFrame([(1, value)], f"_obs long, x {kind}")


def get(df, column):
    return df.select(column.alias("v")).first().v


def test_unsqueeze_and_flatten(one):
    x = one([1.0, 2.0])
    assert get(x, A.unsqueeze("x", 2)) == [[1.0, 2.0]] and get(x, A.unsqueeze("x", 1)) == [[1.0], [2.0]]
    y = one([[1.0, 2.0], [3.0, 4.0]], "array<array<double>>")
    assert get(y, A.unsqueeze("x", 2, 2)) == [[[1.0, 2.0]], [[3.0, 4.0]]] and get(y, A.flatten("x")) == [1.0, 2.0, 3.0, 4.0]
    with pytest.raises(ValueError):
        A.unsqueeze("x", 4, 2)


def test_stack_and_unstack(one):
    x = one([1.0, 2.0])
    assert get(x, A.stack("x", "x")) == [[1.0, 2.0], [1.0, 2.0]]
    assert get(x, A.stack("x", "x", dims=1)) == [[1.0, 1.0], [2.0, 2.0]]
    y = one([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], "array<array<double>>")
    assert [r.x for r in A.unstack(y, "x").orderBy("_pos").collect()] == [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]
    assert [r.x for r in A.unstack(y, "x", 1).orderBy("_pos").collect()] == [[1.0, 3.0, 5.0], [2.0, 4.0, 6.0]]


def test_chunks(one, numbers):
    x = one([float(i) for i in range(1, 11)])
    assert [len(c) for c in get(x, A.chunk_array("x", n=3))] == [4, 4, 2]
    assert len(get(x, A.chunk_array("x", n=6))) == 5
    assert [len(c) for c in get(x, A.chunk_array("x", size=2))] == [2] * 5
    assert get(x, A.chunk_array("x", size=[1, 9]))[0] == [1.0]
    assert get(one([]), A.chunk_array("x", size=2)) == []
    with pytest.raises(Exception, match="sizes must sum"):
        get(x, A.chunk_array("x", size=[1, 2]))
    rows = lambda **k: [r[1] for r in sorted(map(tuple, A.chunk_rows(numbers(10), **k).groupBy("_chunk").count().collect()))]
    assert rows(n=3) == [4, 4, 2] and rows(size=4) == [4, 4, 2] and rows(size=[2, 3, 5]) == [2, 3, 5]
    with pytest.raises(ValueError):
        A.chunk_rows(numbers(10), size=[1, 2])


def test_chunk_by_partition(spark):
    data = spark.createDataFrame([(i, p, i * 10) for i, p in enumerate([1, 1, 3, 3, 4], 1)], "_obs long, p int, x int")
    assert [r.x for r in A.chunk_by_partition(data, "p", ["x"]).orderBy("_chunk").collect()] == [[10, 20], [], [30, 40], [50]]
    assert A.chunk_by_partition(data, "p", ["x"], 6).count() == 6
    with pytest.raises(ValueError):
        A.chunk_by_partition(data.withColumn("p", 5 - F.col("p")), "p", ["x"])


def test_rpad(one):
    x = one([1.0, 2.0])
    assert get(x, A.rpad_constant("x", 4, -1)) == [1.0, 2.0, -1.0, -1.0] and get(x, A.rpad_constant("x", 1)) == [1.0, 2.0]
    assert get(one([[1.0]], "array<array<double>>"), rpad_constant2("x", (2, 2))) == [[1.0, 0.0], [0.0, 0.0]]


def test_scaling(one, spark):
    z = get(one([1.0, 2.0, 3.0, 6.0]), A.normalise("x", eps=0.0))
    assert abs(sum(z)) < 1e-12 and abs(sum(v * v for v in z) / 4 - 1) < 1e-12
    r = get(one([1.0, 2.0, 5.0]), A.rescale("x", eps=0.0))
    assert r == [0.0, 0.25, 1.0] and get(one([1.0, 5.0]), A.rescale("x"))[1] < 1
    rows = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    assert sorted(v.x for v in A.normalise_rows(rows, "x", eps=0.0).collect()) == [-1.0, 1.0]
    assert sorted(v.x for v in A.rescale_rows(rows, "x", eps=0.0).collect()) == [0.0, 1.0]


def test_like(one):
    x = one([1.0, 2.0])
    assert get(x, A.zeros_like("x")) == [0.0, 0.0] and get(x, A.ones_like("x", "int", 3)) == [1, 1, 1]
    assert get(x, A.fill_like("x", 2.5)) == [2.5, 2.5] and get(x, A.trues_like("x")) == [True, True] and get(x, A.falses_like("x", 1)) == [False]
    with pytest.raises(ValueError):
        A.fill_like("x", 2.5, "int")
    u, n = get(x, A.rand_like("x", "_obs", 1, 2000)), get(x, A.randn_like("x", "_obs", 1, 2000))
    assert all(0 <= v < 1 for v in u) and abs(sum(u) / 2000 - 0.5) < 0.05
    assert abs(sum(n) / 2000) < 0.1 and abs(sum(v * v for v in n) / 2000 - 1) < 0.15
    assert u == get(x.repartition(2), A.rand_like("x", "_obs", 1, 2000))


def test_searchsorted(spark):
    bins, down = F.array(*map(F.lit, [1.0, 3.0, 5.0, 7.0, 9.0])), F.array(*map(F.lit, [9.0, 7.0, 5.0, 3.0, 1.0]))
    data = spark.createDataFrame([(4.0,), (5.0,), (8.0,), (math.nan,)], "x double")
    got = [tuple(r) for r in data.select(A.searchsortedfirst(bins, "x"), A.searchsortedlast(bins, "x"), A.searchsortedfirst(down, "x", True), A.searchsortedlast(down, "x", True)).collect()]
    assert got == [(3, 2, 4, 3), (3, 3, 3, 3), (5, 4, 2, 1), (1, 0, 1, 0)]


def test_searchsorted_rows(spark):
    bounds = spark.createDataFrame([(float(b),) for b in range(0, 1000, 7)], "b double")
    data = spark.createDataFrame([(i, float(i * 3 - 50)) for i in range(400)], "k long, x double")
    got = {r.k: r._first for r in A.searchsorted_rows(data, "x", bounds, "b").collect()}
    assert got == {i: 1 + sum(b < i * 3 - 50 for b in range(0, 1000, 7)) for i in range(400)}


def test_searchsorted_rows_with_nulls_repeats_and_ranges(spark, monkeypatch):
    from rowloom.operators import order

    nan = float("nan")
    bounds = [1.0, None, 3.0, 3.0, nan, 7.5]
    rows = [(1, 0.5), (2, 3.0), (2, 3.0), (None, 4.0), (5, None), (6, nan), (7, 1e9), (8, 1.0)]
    want = sorted(((k, 1 + sum(b is not None and x is not None and b < x for b in bounds)) for k, x in rows), key=repr)
    for one_task in (1000, 0):
        monkeypatch.setattr("rowloom.functions.arrays.ONE_TASK", one_task)
        monkeypatch.setattr(order, "ROWS_PER_RANGE", 1)
        found = A.searchsorted_rows(spark.createDataFrame(rows, "k long, x double"), "x", spark.createDataFrame([(b,) for b in bounds], "b double"), "b")
        assert found.columns == ["k", "x", "_first"]
        assert sorted(((r.k, r._first) for r in found.collect()), key=repr) == want


def test_shapes_of_three_dimensions(spark, one):
    deep = spark.sql("select array(array(array(1, 2), array(3, 4)), array(array(5, 6), array(7, 8))) as x")
    assert get(deep, A.flatten("x", ndims=3)) == list(range(1, 9)) and len(get(deep, A.flatten("x"))) == 4
    assert [r.x for r in A.unstack(deep, "x", dims=1, ndims=3).orderBy("_pos").collect()] == [[[1, 3], [5, 7]], [[2, 4], [6, 8]]]
    assert [r.x for r in A.unstack(deep, "x", dims=2, ndims=3).orderBy("_pos").collect()] == [[[1, 2], [5, 6]], [[3, 4], [7, 8]]]
    assert [r.x for r in A.unstack(deep, "x", dims=3, ndims=3).orderBy("_pos").collect()] == [[[1, 2], [3, 4]], [[5, 6], [7, 8]]]
    flat = spark.sql("select array(array(1, 2), array(3, 4)) as x, array(array(5, 6), array(7, 8)) as y")
    assert get(flat, A.stack("x", "y", dims=1, ndims=2)) == [[[1, 5], [2, 6]], [[3, 7], [4, 8]]]
    assert get(flat, A.stack("x", "y", dims=2, ndims=2)) == [[[1, 2], [5, 6]], [[3, 4], [7, 8]]]
    assert get(flat, A.stack("x", "y", dims=3, ndims=2)) == [[[1, 2], [3, 4]], [[5, 6], [7, 8]]]
    with pytest.raises(ValueError):
        A.stack("x", "y", dims=4, ndims=2)
    with pytest.raises(ValueError):
        A.unstack(deep, "x", dims=4, ndims=3)


def test_topk(one, numbers, spark):
    x = one([5.0, 1.0, 4.0, 2.0, 3.0])
    assert tuple(get(x, A.topk("x", 3))) == ([5.0, 4.0, 3.0], [1, 3, 5]) and tuple(get(x, A.topk("x", 2, False))) == ([1.0, 2.0], [2, 4])
    assert get(one([1.0, 1.0, 1.0]), A.topk("x", 2)).indices == [1, 2]
    with pytest.raises(ValueError):
        A.topk("x", 0)
    with pytest.raises(Exception, match="more than the array"):
        get(x, A.topk("x", 6))
    assert [r.x for r in A.topk_rows(numbers(20), "x", 2).collect()] == [20, 19]
    grouped = A.topk_per_group(numbers(10).withColumn("g", F.col("x") % 2), "x", 2, "g")
    assert sorted(r.x for r in grouped.collect()) == [7, 8, 9, 10]
