import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowloom.llm import repeats


def brute(rows, length):
    """Row results by the definition: strings that start in a document of smaller id."""
    least: dict = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        if i is not None:
            for k in range(len(b) - length + 1):
                w = b[k : k + length]
                least[w] = min(least.get(w, i), i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        if i is not None:
            for k in range(len(b) - length + 1):
                if least[b[k : k + length]] < i:
                    gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def rows_with_repeats(words):
    base, line = words(120, 1), words(14, 2)
    rng = random.Random(4)
    rows = [(10, base), (11, base), (12, base[:300] + "X" + base[300:]), (13, base[20:400]), (9, base[100:220] + line), (14, line + "\n" + words(50, 5)), (15, words(30, 6) + line + line + line)]
    for i in range(16, 40):
        text = list(base)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(len(text))] = "Z"
        rows.append((i, "".join(text)))
    return rows + [(40, "ab" * 80), (41, "ab" * 60 + "c"), (42, "é" * 60), (43, "xé" + "é" * 70), (44, "k" * 49), (45, "k" * 49), (46, "k" * 50), (47, "k" * 51)]


@pytest.mark.parametrize("length", [50, 12])
def test_equals_brute_force(make_docs, odd_rows, words, length):
    rows = rows_with_repeats(words) + [(r[0], r[1]) for r in odd_rows if len(r[1] or "") < 5000]
    got = repeats.removal_digest(make_docs(rows, extra=True).repartition(3), length).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, length)


def test_long_text_and_empty_table(make_docs, odd_rows):
    rows = [(r[0], r[1]) for r in odd_rows]
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in repeats.removal_digest(make_docs(rows)).collect()}
    assert got[4, len(odd_rows[3][1])] == 0
    assert repeats.removal_digest(make_docs([])).count() == 0 and repeats.remove_repeats(make_docs([])).count() == 0
    with pytest.raises(ValueError):
        repeats.removal_digest(make_docs([]), 4)


def test_texts_without_repeats(make_docs, words):
    rows = rows_with_repeats(words)
    docs = make_docs(rows + [(50, None)], extra=True)
    out = repeats.remove_repeats(docs)
    assert out.schema == docs.schema
    left = {r.doc_id: r.text for r in out.collect()}
    assert left[9] == dict(rows)[9] and 11 not in left and left[50] is None and left[10] != dict(rows)[10] and 47 not in left and left[44] == "k" * 49


TEXTS = st.lists(st.binary(min_size=1, max_size=60).map(lambda b: bytes(97 + c % 3 for c in b)), min_size=1, max_size=8, unique=True)


@given(TEXTS, TEXTS)
@settings(max_examples=80, deadline=None)
def test_index_finds_least_ids_for_texts_of_its_own_and_others(texts, others):
    length = 9
    ids = np.arange(len(texts))[::-1] + 5
    every = texts + others
    found = repeats.RunIndex.build(texts, ids, length).least_ids(every, length, -1)
    for t, got in zip(every, found):
        assert got.tolist() == [min((i for u, i in zip(texts, ids) if t[k : k + length] in u), default=-1) for k in range(len(t) - length + 1)]


@given(TEXTS, st.binary(min_size=1, max_size=80).map(lambda b: bytes(97 + c % 4 for c in b)))
@settings(max_examples=80, deadline=None)
def test_matching_statistics(texts, pattern):
    length = 12
    index = repeats.RunIndex.build([*texts, b"a" * len(pattern)], np.arange(len(texts) + 1), length)
    grid = np.frombuffer(pattern, np.uint8)[::-1].astype(np.int64)[:, None] + 1
    lost = 0
    for step, matched, _ in index.statistics(grid, np.ones(len(pattern), np.int64), length):
        rest = pattern[len(pattern) - 1 - step :]
        longest = max(k for k in range(len(rest) + 1) if any(rest[:k] in t for t in [*texts, b"a" * len(pattern)]))
        assert min(int(matched[0]), length) == min(longest, length)
        lost += matched[0] <= step
    assert lost or pattern in b"a" * len(pattern) or any(pattern in t for t in texts)


def test_patterns_that_are_not_in_the_index():
    index = repeats.RunIndex.build([b"abcabcabcabd", b"bbbbbbbbbb"], np.array([3, 4]), 5)
    assert index.least_ids([b"zabcabz", b"bbbbbb", b"zzzzz"], 5, -1)[0].tolist() == [-1, 3, -1]
    assert index.least_ids([b"bbbbbb"], 5, -1)[0].tolist() == [4, 4]
    # the transform is run-compressed: every run has its ends sampled
    assert len(index.run_key) == len(index.run_end) == len(index.run_head) < len(index.symbol)


def test_texts_that_agree_to_their_ends_keep_their_order():
    rng = random.Random(3)
    c, d = (bytes(rng.choices(range(97, 123), k=k)) for k in (60, 51))
    # the texts after those that end alike agree as well, and differ against the order of places
    index = repeats.RunIndex.build([b"qx" + c, d + b"z", b"ry" + c, d + b"a", b"kx" + c[:48], b"ky" + c[:48]], np.arange(6), 50)
    assert index.least_ids([b"kx" + c], 50, -1)[0].tolist() == [4] + [0] * 12
    assert index.least_ids([b"ky" + c], 50, -1)[0].tolist() == [5, 2] + [0] * 11


@pytest.mark.parametrize("most", [0, 400, 1 << 18])
def test_no_index_grows_with_the_contexts_of_an_anchor(monkeypatch, make_docs, words, most):
    """A passage in documents that all differ beside it: its groups are parted until they are small."""
    passage, rng = words(16, 1), random.Random(6)
    other = lambda n: "".join(rng.choices("ab", k=n))
    rows = [(i, other(rng.randint(0, 60)) + passage[rng.randint(0, 3) :] + other(rng.randint(0, 60))) for i in range(400)]
    h, built = np.zeros(len(rows), np.uint64), []
    monkeypatch.setattr(repeats, "GROUP_BYTES", most)
    monkeypatch.setattr(repeats, "INDEX_BYTES", 2000)
    build = repeats.RunIndex.build
    monkeypatch.setattr(repeats.RunIndex, "build", lambda texts, *a: built.append(sum(map(len, texts))) or build(texts, *a))
    # all contexts of one place of the passage, as one anchor's
    texts = [t.encode() for _, t in rows]
    at = [t.index(passage[10:30].encode()) for t in texts]
    places = [max(a - 30, 0) for a in at]
    parts = repeats.pa.array([t[p : a + 50] for t, p, a in zip(texts, places, at)], repeats.pa.binary()).dictionary_encode()
    ids = np.arange(len(rows))
    gone = [bytearray(len(t)) for t in texts]
    for x, begin, end in repeats.spans_of(h, ids, np.array(places), np.array(at) - places, parts.indices.to_numpy(), parts.dictionary, 50):
        for i, a, b in zip(x.tolist(), begin.tolist(), end.tolist()):
            gone[i][a:b] = b"\1" * (b - a)
    seen: set = set()
    for t, a, p, g in zip(texts, at, places, gone):
        windows = [(k, t[k : k + 50]) for k in range(p, min(a, len(t) - 50) + 1)]
        want = bytearray(len(t))
        for k, w in windows:
            if w in seen:
                want[k : k + 50] = b"\1" * 50
        seen |= {w for _, w in windows}
        assert g == want
    assert max(built, default=0) <= 2000 + most if most < 1 << 18 else max(built) > 4000


def test_blocks_are_small_however_many_buckets():
    """Copies send no anchors, a block has about 5 bytes for each of the others, and contexts are read as they were sent."""
    pa, rng = repeats.pa, random.Random(9)
    texts = ["".join(rng.choices("abcdefgh ", k=3000)) for _ in range(300)]
    ids = [(k * 7919 - 1000) << 20 for k in range(300)]
    schema = pa.schema({"_id": pa.int64(), "_text": pa.string(), "_nth": pa.int32(), "_copy": pa.bool_(), "anchors": pa.list_(pa.binary())})
    every = [np.unique(repeats.anchors(np.frombuffer(t.encode(), np.uint8), 50)[0]) & repeats.MASK for t in texts]
    rows = [{"_id": i, "_text": t, "_nth": 0, "_copy": c, "anchors": [repeats.packed(h)]} for c in (False, True) for i, t, h in zip(ids, texts, every)]
    batch = pa.RecordBatch.from_pylist(rows, schema)
    sent = pa.Table.from_batches(repeats.anchor_blocks(50, 40)(iter([batch])))
    n = sum(map(len, every))
    assert sum(sent["n"].to_pylist()) == n and sum(map(len, sent["block"].to_pylist())) < 6.5 * n
    blocks = pa.Table.from_batches(repeats.context_blocks(50, 40)(iter([batch])))
    seen = set()
    for row in zip(*(blocks[c].to_pylist() for c in ("least", "n", "size", "block"))):
        h, i, nth, place, ahead, code, distinct = repeats.read_blocks([row])
        seen |= set(zip(h.tolist(), i.tolist(), place.tolist(), ahead.tolist(), distinct.take(pa.array(code)).to_pylist()))
    want = set()
    for i, t in zip(ids, texts):
        h, a, b, p = repeats.anchors(np.frombuffer(t.encode(), np.uint8), 50)
        want |= {(int(x & repeats.MASK), i, u, v - u, t[u : w + 50].encode()) for x, u, w, v in zip(h, a.tolist(), b.tolist(), p.tolist())}
    assert seen == want


def test_a_match_is_shortened_from_the_right():
    x, y, z = (bytes(random.Random(k).choices(range(97, 123), k=60)) for k in range(3))
    index = repeats.RunIndex.build([b"Y" + x[:55], b"Z" + x[:49] + y], np.array([7, 3]), 50)
    assert index.least_ids([b"Z" + x[:55]], 50, -1)[0].tolist() == [3] + [7] * 6
    assert index.least_ids([z + x[:52] + z], 50, -1)[0].tolist() == [-1] * 60 + [7] * 3 + [-1] * 60


def test_anchors_do_not_depend_on_segments(monkeypatch):
    data = np.frombuffer(bytes(random.Random(1).choices(range(97, 101), k=5000)), np.uint8)
    whole = repeats.anchors(data, 50)
    monkeypatch.setattr(repeats, "SEGMENT", 333)
    parts = repeats.anchors(data, 50)
    every = lambda x: {(int(h), int(p), s) for h, a, b, p in zip(*x) for s in range(a, b + 1)}
    assert every(whole) == every(parts) and len(every(whole)) == 5000 - 49
