import itertools
import random
import re

import numpy as np
import pytest

from rowloom.llm import jaccard
from rowloom.llm.components import components

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if None not in (i, j) and a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = root(i), root(j)
            up[max(x, y)] = min(x, y)
    return sorted(((i, len(s), root(i) if i is not None else None) for i, s in sets), key=repr)


def near_copies(words):
    rng = random.Random(3)
    rows = []
    for g in range(6):
        base = words(150, g).split()
        for k in range(12):
            text = list(base)
            for _ in range(k % 5):
                text[rng.randrange(len(text))] = f"w{rng.random()}"
            rows.append((1000 - len(rows), " ".join(text)))
    passage = words(30, 50)
    rows += [(2000 + i, words(100 + i, 100 + i) + " " + passage) for i in range(30)]
    rows += [(3000, rows[0][1].upper()), (3001, "one two"), (3002, "One\ttwo"), (3003, "one"), (3004, "two one"), (3005, "")]
    return rows


@pytest.mark.parametrize("width, percent, block", [(3, 90, 8192), (3, 90, 2), (5, 80, 8192), (5, 80, 3), (1, 60, 4)])
def test_equals_brute_force(make_docs, odd_rows, words, width, percent, block):
    rows = near_copies(words) + [(r[0], r[1]) for r in odd_rows]
    got = jaccard.jaccard_components(make_docs(rows, extra=True).repartition(3), width, percent, key_block=block, cluster_block=block).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, width, percent)


def test_chain_of_links(make_docs, words):
    """Neighbours link, ends don't."""
    w = words(400, 9).split()
    rows = [(i, " ".join(w[4 * i : 4 * i + 120])) for i in range(20)]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(make_docs(rows)).collect()}
    assert sorted(got.items()) == [(i, c) for i, _, c in sorted(brute(rows, 3, 90))] and set(got.values()) == {0}


def test_one_of_each(make_docs, words, odd_rows):
    rows = near_copies(words) + [(r[0], r[1]) for r in odd_rows]
    docs = make_docs(rows, extra=True)
    out = jaccard.one_of_each(docs, 3, 90)
    want = sorted(i for i, _, c in brute(list(dict(rows).items()), 3, 90) if i is not None and i == c)
    got = [r.doc_id for r in out.collect()]
    assert out.columns == docs.columns and got.count(None) == 2
    assert sorted(i for i in got if i is not None and i not in (5, 6)) == [i for i in want if i not in (5, 6)] and got.count(5) == 1 and got.count(6) == 2


def test_different_texts_of_one_id_are_documents_of_their_own(make_docs, words):
    rows = [(1, words(60, 1)), (1, words(60, 2)), (1, words(60, 2)), (2, words(60, 2)), (3, words(60, 3)), (3, words(60, 4)), (4, words(60, 5))]
    got = [(r.doc_id, r.text) for r in jaccard.one_of_each(make_docs(rows, extra=True)).collect()]
    assert sorted(t for _, t in got) == sorted({t for _, t in rows}) and sorted(i for i, _ in got if i > 2) == [3, 3, 4]


def test_hot_nodes(spark, monkeypatch):
    from rowloom.llm import components as module

    monkeypatch.setattr(module, "HOT", 3)
    links = spark.createDataFrame([(0, i) for i in range(1, 30)] + [(i, i + 100) for i in range(1, 30)] + [(500 + i, 400) for i in range(9)], "a long, b long")
    got = {r.node: r.root for r in components(links, "a", "b").collect()}
    assert got == {i: 0 for i in (*range(1, 30), *range(101, 130))} | {500 + i: 400 for i in range(9)}


def test_empty_table(make_docs):
    assert jaccard.jaccard_components(make_docs([])).count() == 0 and jaccard.one_of_each(make_docs([])).count() == 0


def test_t_occurrence_of_long_lists():
    rng = np.random.default_rng(0)
    common = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    sets = sorted((np.unique(np.concatenate([common[: 60 - i % 7], rng.integers(0, 1 << 62, i % 5).astype(np.uint64)])) for i in range(40)), key=len)
    forest = jaccard.t_occurrence(sets, 90)
    up = list(range(40))
    root = lambda x: x if up[x] == x else root(up[x])
    for i, j in itertools.combinations(range(40), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
            up[max(root(i), root(j))] = min(root(i), root(j))
    assert [forest.root(i) for i in range(40)] == [root(i) for i in range(40)]


def test_sketches_never_tell_linked_sets_apart():
    rng = np.random.default_rng(1)
    for n in (20, 700, 5000):
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[len(a) // 20 :], rng.integers(0, 1 << 62, n // 30).astype(np.uint64)]))
        apart = jaccard.Sketches([jaccard.parity_sketch(a), jaccard.parity_sketch(b)]).apart(0, np.array([1]))[0]
        assert apart <= len(np.setxor1d(a, b))


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (8, 7), (5, 5), (None, 4), (20, 19), (19, 18), (18, 17), (17, 16), (16, 15)], "a long, b long")
    assert {(r.node, r.root) for r in components(links, "a", "b").collect()} == {(2, 1), (3, 1), (9, 7), (8, 7), *((i, 15) for i in range(16, 21))}
    assert components(links.where("a = 5"), "a", "b").count() == 0
