import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rowloom import operators as O


def sizes(bounds):
    return [b - a + 1 for a, b in bounds]


@pytest.mark.parametrize(
    "n, at, want",
    [
        (10, 0.7, [7, 3]), (10, 0.5, [5, 5]), (10, (0.5, 0.3), [5, 3, 2]), (150, 0.7, [105, 45]), (150, (0.2, 0.3), [30, 45, 75]), (150, (0.1, 0.2, 0.3), [15, 30, 45, 60]),
        (15, 10, [10, 5]), (15, (0.2, 0.3), [3, 4, 8]), (15, (0.11, 0.2, 0.3), [2, 3, 4, 6]), (15, (2, 3, 4), [2, 3, 4, 6]), (25, (0.5, 0.3), [12, 7, 6]), (5, 0.0, [0, 5]), (5, 1.0, [5, 0]),
    ],
)
def test_split_bounds(n, at, want):
    assert sizes(O.split_bounds(n, at)) == want


@pytest.mark.parametrize("n, at", [(10, 1.5), (10, -0.1), (10, 11), (3, (0.5, 0.5))])
def test_split_errors(n, at):
    with pytest.raises(ValueError):
        O.split_bounds(n, at)


def test_split_kinds_are_not_mixed():
    with pytest.raises(TypeError):
        O.split_bounds(10, (0.5, 2))


@given(st.integers(1, 500), st.lists(st.floats(0, 0.3), min_size=1, max_size=3))
def test_split_covers_all(n, at):
    bounds = O.split_bounds(n, tuple(at))
    assert bounds[0][0] == 1 and bounds[-1][1] == n and all(a[1] + 1 == b[0] for a, b in zip(bounds, bounds[1:]))


def test_splitobs(numbers):
    got = O.splitobs(numbers(150), (0.2, 0.3)).groupBy("_split").agg(F.count("*"), F.min("_obs")).collect()
    assert sorted(map(tuple, got)) == [(1, 30, 1), (2, 45, 31), (3, 75, 76)]


@pytest.mark.parametrize("at, want", [(0.5, {1: [0, 0, 1, 1, 1], 2: [0, 0, 1, 1, 1]}), (0.25, {1: [0, 1, 1], 2: [0, 0, 0, 1, 1, 1, 1]}), (0.0, {2: [0] * 4 + [1] * 6}), (1.0, {1: [0] * 4 + [1] * 6})])
def test_splitobs_stratified(spark, at, want):
    data = spark.createDataFrame([(i, int(i > 4)) for i in range(1, 11)], "_obs long, b int")
    got: dict = {}
    for r in O.splitobs(data, at, stratified="b").orderBy("b").collect():
        got.setdefault(r._split, []).append(r.b)
    assert got == want


def test_kfolds(numbers):
    got = O.kfolds(numbers(10), 5).collect()
    assert {r._obs: r._fold for r in got} == {i: (i + 1) // 2 for i in range(1, 11)}
    uneven = [r[1] for r in sorted(map(tuple, O.kfolds(numbers(11), 3).groupBy("_fold").count().collect()))]
    assert uneven == [4, 4, 3]
    long = O.kfolds_long(O.kfolds(numbers(10), 5), 5)
    assert long.count() == 50 and long.where("_role = 'val'").count() == 10
    for k in (1, 11):
        with pytest.raises(ValueError):
            O.kfolds(numbers(10), k)


@given(st.integers(2, 60), st.integers(2, 60))
def test_fold_sizes(n, k):
    if k <= n:
        q, r = divmod(n, k)
        assert [q + (i < r) for i in range(k)] == [q + 1] * r + [q] * (k - r)


def test_kfolds_stratified(spark):
    data = spark.createDataFrame([(i, int(i > 10)) for i in range(1, 31)], "_obs long, y int")
    got = {(r._fold, r.y): r["count"] for r in O.kfolds(data, 5, stratified="y").groupBy("_fold", "y").count().collect()}
    assert got == {(f, y): (2, 4)[y] for f in range(1, 6) for y in (0, 1)}
    with pytest.raises(ValueError):
        O.kfolds(data.where("_obs > 7"), 5, stratified="y")


def test_leavepout(numbers):
    assert [r._fold for r in O.leavepout(numbers(15)).orderBy("_obs").collect()] == list(range(1, 16))
    assert O.leavepout(numbers(15), 5).select("_fold").distinct().count() == 3
    with pytest.raises(ValueError):
        O.leavepout(numbers(15), 8)


def test_timeseries_bounds():
    assert O.timeseries_bounds(10, 3) == [(1, 4, 5, 6), (1, 6, 7, 8), (1, 8, 9, 10)]
    assert [b[:2] for b in O.timeseries_bounds(10, 3, gap=1)] == [(1, 3), (1, 5), (1, 7)]
    assert [b[:2] for b in O.timeseries_bounds(10, 3, max_train_size=2)] == [(3, 4), (5, 6), (7, 8)]
    assert O.timeseries_bounds(12, 3, 1, 2) == [(1, 2, 4, 6), (4, 5, 7, 9), (7, 8, 10, 12)]
    for n, options in ((10, {"k": 1}), (10, {"k": 10}), (3, {"k": 3}), (10, {"k": 3, "gap": 10}), (10, {"k": 3, "gap": -1}), (10, {"k": 3, "max_train_size": 0})):
        with pytest.raises(ValueError):
            O.timeseries_bounds(n, **options)


def test_timeseries_rows(numbers):
    got = O.timeseries_kfolds(numbers(10), 3).where("_round = 1 and _role = 'val'").orderBy("_obs").collect()
    assert [r.x for r in got] == [5, 6]
