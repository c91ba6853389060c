"""Order-preserving packing of tokenised documents by dynamic programming.

The documents of an input partition form one stream of ids in their order.  Windows are cut from it
at document ends and sentence ends; only a stretch longer than a window without either may be cut
elsewhere.  The cuts minimise padding plus a penalty for each cut inside a document.  With f(j) the least
cost of a stream cut at boundary j at position p(j),

    f(j) = penalty(j) + min(  min over p(j)-p(i) <= size of  f(i) + size - (p(j) - p(i)),
                              min over powers of two L with a boundary at p(j) - L of  f(i) ).

The first minimum is one over a sliding window of f(i) + p(i), kept in a monotone queue, so each
boundary enters and leaves it once; the second takes log2(size) look-ups.  A window whose length is
a power of two has no padding.  The stream is handled in blocks of about ``BLOCK`` ids that end at
a document's end, so memory doesn't grow with the partition; no row moves between machines.
"""

from __future__ import annotations

import functools
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from rowloom.llm.common import filled, slices

HARD_STEP = 128  # ids between cuts in a stretch without natural boundary that is longer than a sequence, or a sequence's size if that is less
BLOCK = 1 << 18  # ids
CUT_SENTENCE, CUT_HARD = 0.125, 256.0  # penalties in ids of padding, for a cut inside a document
SPECIAL = "<|endoftext|>"


@functools.lru_cache(maxsize=2)
def encoder(ranks: str):
    """The rank file's encoder; its vocabulary and splitting are those of the tokenizer file beside it."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def encode(text: str, enc, special: int = 50256) -> list[int]:
    """Ids of a text; the special token's own string is one id, as the tokenizer library reads it."""
    if SPECIAL not in text:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for k, part in enumerate(text.split(SPECIAL)):
        if k:
            out.append(special)
        out += enc.encode_ordinary(part)
    return out


@functools.lru_cache(maxsize=2)
def sentence_ends(ranks: str) -> np.ndarray:
    """For each id whether it ends a sentence: '.', '!', '?' or a line feed, and closing quotes or brackets after it."""
    enc = encoder(ranks)
    flags = np.zeros(max(enc.n_vocab, 50257) + 1, bool)
    for i in range(enc.n_vocab):
        word = enc.decode_single_token_bytes(i)
        flags[i] = word[-1:] == b"\n" or word.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?")
    return flags


def boundaries(lengths: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a stream of documents may be cut, ascending from 0 to its end, and each one's penalty."""
    total = int(lengths.sum())
    kind = np.zeros(total + 1, np.int8)
    kind[np.flatnonzero(ends) + 1] = 1
    kind[np.cumsum(lengths)] = 2
    kind[0] = kind[total] = 2
    at = np.flatnonzero(kind)
    step = min(HARD_STEP, size)
    more = [np.arange(at[g] + step, at[g + 1], step) for g in np.flatnonzero(np.diff(at) > size)]
    at = np.union1d(at, np.concatenate(more)) if more else at
    return at, np.array([CUT_HARD, CUT_SENTENCE, 0.0])[kind[at]]


def best_cuts(at: np.ndarray, penalty: np.ndarray, size: int) -> list[int]:
    """Positions of the cuts of least cost, from 0 to the stream's end."""
    p, pen = at.tolist(), penalty.tolist()
    index = {x: i for i, x in enumerate(p)}
    powers = [1 << k for k in range(size.bit_length()) if 1 << k <= size]
    cost, came = [0.0] * len(p), [0] * len(p)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, len(p)):
        here = p[j]
        while p[queue[0][1]] < here - size:
            queue.popleft()
        value, i = queue[0]
        best, come = value + size - here, i
        for length in powers:
            i = index.get(here - length)
            if i is not None and cost[i] < best:
                best, come = cost[i], i
        cost[j], came[j] = best + pen[j], come
        entry = cost[j] + here
        while queue and queue[-1][0] >= entry:
            queue.pop()
        queue.append((entry, j))
    cuts = [len(p) - 1]
    while cuts[-1]:
        cuts.append(came[cuts[-1]])
    return [p[i] for i in reversed(cuts)]


def pack_block(ids: list[np.ndarray], enders: np.ndarray, size: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces of a block's documents: (document, start, length, sequence, offset)."""
    lengths = np.array([len(x) for x in ids], np.int64)
    stream = np.concatenate(ids)
    cuts = best_cuts(*boundaries(lengths, enders[stream], size), size)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    edges = np.union1d(starts, cuts)
    docs = np.searchsorted(starts, edges[:-1], "right") - 1
    seqs = np.searchsorted(cuts, edges[:-1], "right") - 1
    for a, b, d, s in zip(edges[:-1].tolist(), edges[1:].tolist(), docs.tolist(), seqs.tolist()):
        yield d, a - int(starts[d]), b - a, s, a - cuts[s]


def pack(docs: DataFrame, ranks: str, size: int = 1024, end_id: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """Pack all documents, each followed by ``end_id``, into sequences of at most ``size`` ids.

    Returns a row per piece: key, ``start``, ``length``, ``ids_crc32`` (of little-endian unsigned
    32-bit ids), ``doc_tokens``, ``sequence_id``, ``offset``, ``padding`` of its sequence, and
    ``ids`` unless ``with_ids`` is false.  Each id lies in one piece; pieces fill a sequence gapless
    from 0.  ``sequence_id`` holds the input partition in its upper bits, so a task that runs again
    gives the same rows.

    null text: as empty, which is ``end_id`` alone.  A text of any length is packed whole.  Repeated
    rows are packed as often as they occur; a null key is kept.  Empty table: no pieces.
    """
    if size < 2:
        raise ValueError("size must be 2 at least")
    kind = docs.schema[key].dataType.simpleString()
    fields = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padding"]
    schema = f"`{key}` {kind}, " + ", ".join(f"{x} bigint" for x in fields) + (", ids array<int>" if with_ids else "")

    def run(batches):
        enc, enders = encoder(ranks), sentence_ends(ranks)
        sequence = TaskContext.get().partitionId() << 36
        keys: list = []
        block: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, keys, block, held
            rows = list(pack_block(block, enders, size))
            seqs = np.array([r[3] for r in rows])
            filled_to = np.bincount(seqs, [r[2] for r in rows]).astype(np.int64)
            pad = np.where((filled_to & (filled_to - 1)) == 0, 0, size - filled_to)
            own = [block[r[0]][r[1] : r[1] + r[2]] for r in rows]
            columns = [pa.array([keys[r[0]] for r in rows], key_type)]
            columns += [pa.array(x, pa.int64()) for x in ([r[1] for r in rows], [r[2] for r in rows], [zlib.crc32(x.tobytes()) for x in own], [len(block[r[0]]) for r in rows], seqs + sequence, [r[4] for r in rows], pad[seqs])]
            names = [key, *fields]
            if with_ids:
                columns.append(pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())))
                names.append("ids")
            sequence += int(seqs[-1]) + 1
            keys, block, held = [], [], 0
            return pa.RecordBatch.from_arrays(columns, names)

        key_type = None
        for part in slices(batches):
            key_type = part.column(key).type
            for k, t in zip(part.column(key).to_pylist(), filled(part).to_pylist()):
                ids = encode(t, enc)
                ids.append(end_id)
                keys.append(k)
                block.append(np.array(ids, "<u4"))
                held += len(ids)
                if held >= BLOCK:
                    yield flush()
        if block:
            yield flush()

    return docs.select(key, docs[text].alias("text")).mapInArrow(run, schema)
