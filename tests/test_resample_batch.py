import warnings

import pytest
from pyspark.sql import functions as F

from rowloom import operators as O


def labelled(spark, classes):
    return spark.createDataFrame(list(enumerate(classes, 1)), "_obs long, y string")


@pytest.mark.parametrize("classes, want", [("accab", [1, 2, 3, 4, 5, 5]), ("cccab", [1, 2, 3, 4, 4, 4, 5, 5, 5])])
def test_oversample_in_order(spark, classes, want):
    got = O.oversample(labelled(spark, classes), "y", seed=None)
    assert sorted(r._obs for r in got.collect()) == want


def test_oversample_counts(spark):
    data = labelled(spark, "a" * 7 + "b" * 3 + "c" * 2)
    got = {r.y: r["count"] for r in O.oversample(data, "y", 1.5, seed=1).groupBy("y").count().collect()}
    assert got == {"a": 10, "b": 10, "c": 10}  # 10.5 rounds to even
    small = {r.y: r["count"] for r in O.oversample(data, "y", 0.4, seed=1).groupBy("y").count().collect()}
    assert small == {"a": 7, "b": 3, "c": 3}
    assert sorted(O.oversample(data, "y", seed=1).collect()) == sorted(O.oversample(data.repartition(3), "y", seed=1).collect())


@pytest.mark.parametrize("classes, want", [("accab", [1, 2, 5]), ("cccab", [1, 4, 5]), ("abbbba", [1, 2, 3, 6])])
def test_undersample_in_order(spark, classes, want):
    assert sorted(r._obs for r in O.undersample(labelled(spark, classes), "y", seed=None).collect()) == want


def test_null_label_is_a_class(spark):
    data = labelled(spark, ["a", "a", None])
    assert O.undersample(data, "y").count() == 2 and O.oversample(data, "y").count() == 4


def test_batchview(numbers):
    view = O.BatchView(numbers(12), 5, partial=False)
    assert len(view) == 2 and sorted(r.x for r in view[2].collect()) == [6, 7, 8, 9, 10] and view.getobs().count() == 12
    assert [len(b) for b in O.BatchView(numbers(12), 5)] == [5, 5, 2]
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        small = O.BatchView(numbers(15), 16)
    assert caught and len(small) == 1 and small.batchsize == 15
    merged = O.BatchView(numbers(15), 5)[[1, 3, 1]]
    assert sorted(r.x for r in merged.collect()) == [1, 2, 3, 4, 5, 11, 12, 13, 14, 15]
    assert O.BatchView(numbers(4), 2, collate=True)[2].first().x == [3, 4]
    assert O.BatchView(numbers(4), 2, collate=lambda d: d.agg(F.sum("x")))[2].first()[0] == 7
    with pytest.raises(IndexError):
        O.BatchView(numbers(4), 2)[3]


def test_collate(numbers):
    data = O.batched(numbers(5).withColumn("y", -F.col("x")), 2)
    got = {r._batch: (r.x, r.y) for r in O.collate(data, ["x", "y"]).collect()}
    assert got == {1: ([1, 2], [-1, -2]), 2: ([3, 4], [-3, -4]), 3: ([5], [-5])}
    rows = {r._batch: [tuple(x) for x in r.batch] for r in O.collate(data, ["x", "y"], "rows").collect()}
    assert rows[2] == [(3, -3), (4, -4)]


def test_dataloader(spark):
    data = spark.range(10).withColumnRenamed("id", "k")
    plain = O.DataLoader(data, "k", 4)
    assert len(plain) == 3 and [[r.k for r in b] for b in plain] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    assert [len(b) for b in O.DataLoader(data, "k", 4, partial=False)] == [4, 4]
    loader = O.DataLoader(data, "k", 5, shuffle=True, seed=2)
    first, second = [[r.k for r in b] for b in loader], [[r.k for r in b] for b in loader]
    assert first != second and sorted(sum(first, [])) == sorted(sum(second, [])) == list(range(10))
    again = O.DataLoader(data.repartition(3), "k", 5, shuffle=True, seed=2)
    assert [[r.k for r in b] for b in again] == first
    assert list(O.DataLoader(data, "k", 5, collate=lambda rows: sum(r.k for r in rows)).map(lambda s: s + 1)) == [11, 36]
    assert list(O.DataLoader(data, "k", 4, collate=True)) == [{"k": [0, 1, 2, 3]}, {"k": [4, 5, 6, 7]}, {"k": [8, 9]}]
    assert list(O.DataLoader(data, "k", 4, collate=True).map(lambda b: sum(b["k"]))) == [6, 22, 17]
    assert list(O.DataLoader(data, "k", 4, collate=False).map(len)) == [4, 4, 2] and [len(b) for b in O.DataLoader(data, "k", 4, collate=False)] == [4, 4, 2]
    with pytest.raises(ValueError, match="collate"):
        plain.map(len)
    assert [r.k for r in O.eachobs(data, "k")] == list(range(10))
    assert list(O.DataLoader(spark.range(0).withColumnRenamed("id", "k"), "k", 3)) == []
    with pytest.raises(ValueError):
        O.DataLoader(data, "k", 0).map(len)


def test_batch_and_unbatch(spark):
    data = spark.createDataFrame([(1, 1, 2), (2, 3, 4)], "_obs long, b int, a int")
    row = O.batch(data, ["b", "a"]).first()
    assert row.a == [2, 4] and row.b == [1, 3] and row.__fields__ == ["a", "b"]
    assert [(r._pos, r.a) for r in O.unbatch(O.batch(data, ["a"]), "a").orderBy("_pos").collect()] == [(1, 2), (2, 4)]


def test_sequences(spark):
    data = spark.createDataFrame([(1, [1, 2, 3]), (2, [4, 5])], "_obs long, s array<int>")
    assert [r.s for r in O.batchseq(data, "s").orderBy("_step").collect()] == [[1, 4], [2, 5], [3, 0]]
    assert [r.s for r in O.batch_sequence(data, "s", -1).orderBy("_obs").collect()] == [[1, 2, 3], [4, 5, -1]]


@pytest.mark.parametrize("size, stride, count, last", [(5, 1, 16, [16, 17, 18, 19, 20]), (5, 3, 6, [16, 17, 18, 19, 20]), (20, 7, 1, list(range(1, 21))), (2, 5, 4, [16, 17])])
def test_slidingwindow(numbers, size, stride, count, last):
    got: dict = {}
    for r in O.slidingwindow(numbers(20), size, stride).orderBy("_win", "_pos").collect():
        got.setdefault(r._win, []).append(r.x)
    assert len(got) == count and got[count] == last and all(len(w) == size for w in got.values())


def test_slidingwindow_errors(numbers):
    for size, stride in ((0, 1), (21, 1), (5, 0)):
        with pytest.raises(ValueError):
            O.slidingwindow(numbers(20), size, stride)


def test_group_counts_and_indices(spark):
    data = labelled(spark, ["yes", "no", "maybe", "yes"])
    assert {r.y: r["count"] for r in O.group_counts(data, "y").collect()} == {"yes": 2, "no": 1, "maybe": 1}
    assert {r.y: r.indices for r in O.group_indices(data, "y").collect()} == {"yes": [1, 4], "maybe": [3], "no": [2]}
