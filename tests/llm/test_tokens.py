import hashlib
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from rowloom.llm import packing, sentencepieces  # noqa: E402

RANKS, MODEL = P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model")
TEXTS = ["", " ", "a", "  two  spaces ", "a\n\n b\tc \r\n", "▁ mark ▁▁x", "é漢字 🙂 \u3000wide", "<s> </s> <|endoftext|>x", "12345 678", "don't we'll", "\x00\x01", "a" * 3000, "x " * 500]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def want(sp, text):
    ids = sp.encode(text or "") + [sp.eos_id()]
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_pieces_equal_the_library(spark, make_docs, odd_rows, library):
    rows = [*[(r[0], r[1]) for r in odd_rows], *((100 + i, t) for i, t in enumerate(TEXTS))]
    got = sentencepieces.encode_pieces(make_docs(rows, extra=True), MODEL, digest=True).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, *want(library, t)) for i, t in rows), key=repr)


def test_ids_and_decoded_text(make_docs, library):
    rows = {r.doc_id: r for r in sentencepieces.encode_pieces(make_docs(list(enumerate(TEXTS))), MODEL).collect()}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t) + [library.eos_id()]
        assert rows[i].ids == ids and rows[i].decoded == library.decode(ids) and rows[i].n_tokens == len(ids)


def test_empty_tables(make_docs):
    assert sentencepieces.encode_pieces(make_docs([]), MODEL).count() == 0
    assert packing.pack(make_docs([]), RANKS).count() == 0


def test_a_full_table_starts_anew(library, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(sentencepieces, "KEPT_CHUNKS", 3)
    table = sentencepieces.ChunkTable(MODEL)
    for text in ("one two three four five", "two six seven"):
        [(ids, n, decoded)] = sentencepieces.encode_slice(pa.array([text]), table)
        assert ids.split()[:-1] == [str(i) for i in library.encode(text)] and decoded == text


def test_encoding_equals_the_tokenizer_file():
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(P.path("byte_bpe_50k.json")), packing.encoder(RANKS)
    for t in TEXTS:
        assert packing.encode(t, enc) == tok.encode(t, add_special_tokens=False).ids


def check_packing(rows, pieces, size):
    """Every id in one piece, sequences gapless and within size."""
    enc = packing.encoder(RANKS)
    by_seq: dict = {}
    for p in pieces:
        by_seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= size
    streams: dict = {}
    for p in sorted(pieces, key=lambda p: p.start):
        streams.setdefault(p.doc_id, []).append(p)
    for i, t in rows:
        ids = np.array([*packing.encode(t or "", enc), 0], "<u4")
        own = [p for p in streams[i] if p.doc_tokens == len(ids)]
        assert {(p.start, p.length, p.ids_crc32) for p in own} >= {(p.start, p.length, zlib.crc32(ids[p.start : p.start + p.length].tobytes())) for p in own if list(p.ids) == ids[p.start : p.start + p.length].tolist()}
    assert sum(p.length for p in pieces) == sum(len(packing.encode(t or "", enc)) + 1 for _, t in rows)
    return by_seq


@pytest.mark.parametrize("size", [16, 1024])
def test_packing_is_whole(make_docs, odd_rows, words, size):
    rows = [*[(r[0], r[1]) for r in odd_rows], *((50 + i, words(20 + 30 * i, i) + ". " + words(10, i)) for i in range(20))]
    pieces = packing.pack(make_docs(rows, extra=True), RANKS, size).collect()
    by_seq = check_packing(rows, pieces, size)
    total = sum(p.length for p in pieces)
    lengths = [sum(n for _, n in s) for s in by_seq.values()]
    padding = sum(0 if n & (n - 1) == 0 else size - n for n in lengths)
    assert padding <= 0.15 * total
    assert padding == sum({p.sequence_id: p.padding for p in pieces}.values())


def test_order_is_kept(make_docs, words):
    rows = [(i, words(30, i)) for i in range(30)]
    pieces = packing.pack(make_docs(rows).coalesce(1), RANKS, 64).orderBy("sequence_id", "offset").collect()
    assert [(p.doc_id, p.start) for p in pieces] == sorted((p.doc_id, p.start) for p in pieces)


def exhaustive(at, penalty, size):
    at, penalty = at.tolist(), penalty.tolist()
    cost = [0.0]
    for j in range(1, len(at)):
        found = []
        for i in range(j):
            n = at[j] - at[i]
            if n <= size:
                found.append(cost[i] + (0 if n & (n - 1) == 0 else size - n))
        cost.append(min(found) + penalty[j])
    return cost[-1]


@pytest.mark.parametrize("seed", range(12))
def test_cuts_are_optimal(seed):
    rng = np.random.default_rng(seed)
    size = 32
    at = np.unique(np.concatenate([[0], np.cumsum(rng.integers(1, 20, 80))]))
    penalty = rng.choice([0.0, 0.125, 1.0, 5.0], len(at))
    cuts = packing.best_cuts(at, penalty, size)
    lost = {int(a): p for a, p in zip(at, penalty)}
    got = sum((0 if n & (n - 1) == 0 else size - n) + lost[b] for b, n in zip(cuts[1:], np.diff(cuts).tolist()))
    assert abs(got - exhaustive(at, penalty, size)) < 1e-9 and cuts[0] == 0 and cuts[-1] == at[-1]


def test_size_is_checked(make_docs):
    with pytest.raises(ValueError):
        packing.pack(make_docs([]), RANKS, 1)
