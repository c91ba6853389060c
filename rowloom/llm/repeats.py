"""Removal of byte strings that an earlier document also has, through run-length compressed indexes.

A string of ``length`` bytes is removed from a document if it also starts in a document of smaller id.

1.  Documents equal to one of smaller id are removed whole, if long enough; the rest of the work is
    over one document of each content.
2.  Winnowing: of each window of ``length`` bytes the least k-gram hash is its anchor, so equal windows
    have equal anchors.  Anchors travel as packed blocks to the task of their hash, one for each content at most;
    those of one document alone are dropped.
3.  Documents with a shared anchor give the contexts of these anchors: the bytes of all windows that have
    it.  Contexts are gathered by anchor, and equal ones are kept once with their smallest id: the context of
    any larger id is marked whole.  Those that differ are parted once more, by longer strings that their windows hold,
    and large groups again and again.
4.  The distinct contexts of such a string are ordered by id, and later ones streamed against a run-length index of
    earlier ones: of each two neighbouring contexts, pairs, fours and so on the second half against the first, so that each
    meets all before it.  The index is the Burrows-Wheeler transform as runs, with the suffix position sampled at both
    ends of each run, and the least id of each interval of suffixes that share ``length`` bytes.  Streaming goes from right to
    left, a byte of all contexts at a step: where the transform doesn't go on with the byte, the match moves to the nearer end of
    a run that does, and the samples tell how much of it is left.  That gives the matching statistics; a match of
    ``length`` or more whose interval has a smaller id than the document's own marks its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm.common import filled, give_back, materialise, slices

GRAM = 20  # bytes of an anchor
SEGMENT = 2 << 20  # windows whose anchors are found at a time
FLUSH = 1 << 20  # anchors, or half the contexts, held before they are sent
FIRST = 7  # characters that are sorted at once
INDEX_BYTES = 1 << 20  # of contexts under one index
GROUP_BYTES = 1 << 18  # of contexts that are parted by longer strings once more
HASH_BYTES = 4  # of an anchor beside its bucket; a false match costs time only
MASK = np.uint64((1 << 8 * HASH_BYTES) - 1)
_BYTE = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A mixed polynomial hash of each k bytes, composed from those of powers of two."""
    n = len(data) - k + 1
    power, width, part = _BASE, 1, _BYTE[data]
    out, done = None, 0
    while True:
        if k & width:
            piece = part[done : done + n]
            out = piece if out is None else out * np.uint64(power) + piece
            done += width
        width *= 2
        if width > k:
            break
        half = width // 2
        part = part[:-half] * np.uint64(power) + part[half:]
        power = power * power % (1 << 64)
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last window start, and the anchor's place, of each run of windows that share an anchor."""
    k = min(GRAM, length)
    reach = length - k + 1  # k-grams of a window
    found = []
    for at in range(0, len(data) - length + 1, SEGMENT):
        part = data[at : at + SEGMENT + length - 1]
        h = gram_hashes(part, k)
        low = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal hashes
        width = 1
        least = low
        while width * 2 <= reach:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < reach:
            least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
        where = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(where) - 1]])
        found.append((h[where[first]], first + at, last + at, where[first] + at))
    if not found:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found))


def joined_anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of several texts at once: owner, anchor hash, first and last window start in the joined bytes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    h, a, b, _ = anchors(np.frombuffer(b"".join(texts), np.uint8), length)
    owner = np.searchsorted(ends, a, "right")
    # windows that reach into the next text belong to none: runs are cut at each text's last window
    pieces = [(owner, h, a, np.minimum(b, ends[owner] - length))]
    over = b >= ends[np.minimum(owner, len(ends) - 1)]
    while over.any():  # a run that goes on into following texts
        own, hh, bb = owner[over] + 1, h[over], b[over]
        pieces.append((own, hh, ends[own] - sizes[own], np.minimum(bb, ends[own] - length)))
        h, b, owner = hh, bb, own
        over = b >= ends[owner]
    owner, h, a, b = (np.concatenate(x) for x in zip(*pieces))
    ok = b >= a
    return owner[ok], h[ok], a[ok], b[ok]


def packed(x: np.ndarray) -> bytes:
    """The low HASH_BYTES of each hash."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // HASH_BYTES, 8), np.uint8)
    out[:, :HASH_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, HASH_BYTES)
    return out.view("<u8").ravel()


def planes(x: np.ndarray) -> bytes:
    """Integers from 0 as planes of their bytes, as many as the greatest has; they compress well, each plane on its own."""
    x = x.astype("<u8")
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """n integers written by ``planes`` at a place, and the place after them."""
    width, out = data[at], np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, width * n, at + 1).reshape(width, n).T
    return out.view("<u8").ravel(), at + 1 + width * n


def steps(x: np.ndarray) -> np.ndarray:
    """Of ascending values the first and the differences."""
    return np.diff(x, prepend=x.dtype.type(0))


def parts(order_by: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Indexes of each value 0..n-1 that occurs."""
    order = np.argsort(order_by, kind="stable")
    edges = np.searchsorted(order_by[order], np.arange(n + 1))
    for k in np.flatnonzero(np.diff(edges)).tolist():
        yield k, order[edges[k] : edges[k + 1]]


def unique_pairs(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((owner, h))
    h, owner = h[order], owner[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]) if len(h) else np.zeros(0, bool)
    return h[new], owner[new]


@dataclass
class RunIndex:
    """A run-length compressed Burrows-Wheeler transform with what matching statistics need."""

    symbol: np.ndarray  # the texts: bytes + 1, with a 0 after each text
    first: np.ndarray  # of each symbol: how many smaller ones the text has
    run_key: np.ndarray  # of each run, ordered by symbol, then place: symbol * (size + 1) + start
    run_before: np.ndarray  # of each run: how often its symbol stands before it
    run_length: np.ndarray
    run_head: np.ndarray  # suffix position at each run's first place
    run_end: np.ndarray  # and at its last
    top: int  # the suffix at the first place of all
    class_start: np.ndarray  # of each interval of suffixes with ``length`` equal bytes
    class_least: np.ndarray  # least id there

    @classmethod
    def build(cls, texts: list[bytes], ids: np.ndarray, length: int) -> RunIndex:
        """Of texts with an id each; every text ends with a separator of its own."""
        data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        ends = np.cumsum(sizes) - 1
        n = len(data)
        symbol = data.astype(np.int16) + np.int16(1)
        symbol[ends] = 0
        # order by the first characters, then by prefix doubling of those still tied; suffixes that agree up to their
        # separators stand in the order of their texts, or else the steps of the transform would part from the samples
        key, padded = np.zeros(n, np.int64), np.concatenate([symbol, np.zeros(FIRST, np.int16)])
        rest = np.repeat(ends, sizes) - np.arange(n)  # characters before the separator
        for k in range(FIRST):
            key = (key << 9) | np.where(rest >= k, padded[k : k + n], 0)
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        head = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        del key, padded, sorted_key
        depth, held = FIRST, None
        while True:
            start = np.maximum.accumulate(np.where(head, np.arange(n), 0))  # a group's rank is its first place
            rank = np.empty(n, np.int64)
            rank[order] = start
            if depth <= length <= 2 * depth:
                held = (depth, rank)
            tied = ~head
            tied[:-1] |= ~head[1:]
            at = np.flatnonzero(tied)
            if not len(at):
                break
            suffix = order[at]
            after = np.where(rest[suffix] < depth, suffix, rank[np.minimum(suffix + depth, n - 1)])
            key = (start[at] << 32) | after
            by = np.argsort(key, kind="stable")
            order[at] = suffix[by]
            key = key[by]
            head[at] = np.concatenate([[True], key[1:] != key[:-1]])
            depth *= 2
        if held is None:
            held = (depth, rank)
        depth, early = held
        there = np.minimum(order + max(length - depth, 0), n - 1)
        same = (early[order[1:]] == early[order[:-1]]) & (early[there[1:]] == early[there[:-1]])
        class_start = np.flatnonzero(np.concatenate([[True], ~same]))
        class_least = np.minimum.reduceat(np.repeat(ids, sizes)[order], class_start)
        bwt = symbol[order - 1]
        starts = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        lengths = np.diff(np.concatenate([starts, [n]]))
        by = np.argsort(bwt[starts], kind="stable")
        heads, lens = bwt[starts][by].astype(np.int64), lengths[by]
        total = np.cumsum(lens) - lens
        counts = np.bincount(symbol, minlength=257)
        first = np.cumsum(counts) - counts
        return cls(symbol, first, heads * (n + 1) + starts[by], total - first[heads], lens, order[starts][by], order[starts + lengths - 1][by], int(order[0]), class_start, class_least)

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, length: int) -> np.ndarray:
        """How many bytes the suffixes at a and b have in common, ``most`` or ``length`` at most."""
        n, out = len(self.symbol), np.minimum(most, length)
        for at in range(0, length, 8):  # most differ soon
            some = np.flatnonzero(out > at)
            if not len(some):
                break
            step = np.arange(at, min(at + 8, length))
            same = self.symbol[np.minimum(a[some][:, None] + step, n - 1)] == self.symbol[np.minimum(b[some][:, None] + step, n - 1)]
            differ = ~same.all(1)
            out[some[differ]] = np.minimum(out[some[differ]], at + same[differ].argmin(1))
        return out

    def statistics(self, grid: np.ndarray, live: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """After each step from the right, the length of each text's match that begins there, and a suffix of the index that has it.

        ``grid`` has a step's symbols in each row, ``live`` how many texts go on so far.  A match is counted up to
        ``length`` where it is cut, so it may be told shorter than it is, but not as under ``length`` if it isn't.
        """
        n, runs = len(self.symbol), len(self.run_key)
        start, heads = self.run_key % (n + 1), self.run_key // (n + 1)
        row, where, matched = (np.full(grid.shape[1], x, np.int64) for x in (0, self.top, 0))
        for step in range(len(grid)):
            m = int(live[step])
            c, r = grid[step, :m], row[:m]
            run = np.searchsorted(self.run_key, c * (n + 1) + r, "right") - 1
            at = np.maximum(run, 0)
            before = (run >= 0) & (heads[at] == c)  # a run of this byte that begins here or before
            inside = before & (r < start[at] + self.run_length[at])
            place = r - start[at]
            cut = np.flatnonzero(~inside)
            if len(cut):
                low, high = at[cut], np.minimum(run[cut] + 1, runs - 1)
                has_low, has_high = before[cut], (run[cut] + 1 < runs) & (heads[high] == c[cut])
                here, held = where[cut], matched[cut]
                left = np.where(has_low, self.common(here, self.run_end[low], np.where(has_low, held, 0), length), -1)
                right = np.where(has_high, self.common(here, self.run_head[high], np.where(has_high, held, 0), length), -1)
                up = right > left
                at[cut] = np.where(up, high, low)
                place[cut] = np.where(up, 0, self.run_length[low] - 1)
                where[cut] = np.where(up, self.run_head[high], self.run_end[low])
                matched[cut] = np.maximum(left, right)  # -1, and 0 after the byte, if the index doesn't have it
            known = ~(~inside & (matched[:m] < 0))
            row[:m] = np.where(known, self.first[c] + self.run_before[at] + place, 0)
            where[:m] = np.where(known, where[:m] - 1, self.top)
            matched[:m] += 1
            yield step, matched[:m], row[:m]

    def least_ids(self, texts: list[bytes], length: int, none: int) -> list[np.ndarray]:
        """For each text and each of its windows the least id of an indexed text with that window; ``none`` if there is none.

        The matching statistics of all texts are streamed together, a byte of each at a step.
        """
        sizes = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-sizes, kind="stable")
        width = int(sizes.max(initial=0))
        grid = np.zeros((width, len(texts)), np.int64)  # from the right
        for k, i in enumerate(order.tolist()):
            grid[: sizes[i], k] = np.frombuffer(texts[i], np.uint8)[::-1].astype(np.int64) + 1
        live = np.searchsorted(-sizes[order], -np.arange(width), "left")  # texts longer than each step
        out = np.full((max(width - length + 1, 0), len(texts)), none, np.int64)
        for step, matched, row in self.statistics(grid, live, length):
            if step >= length - 1:
                long = np.flatnonzero(matched >= length)
                out[step - length + 1, long] = self.class_least[np.searchsorted(self.class_start, row[long], "right") - 1]
        found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
        for k, i in enumerate(order.tolist()):
            found[i] = out[: max(sizes[i] - length + 1, 0), k][::-1]
        return found


def anchor_blocks(length: int, buckets: int):
    """Blocks of anchors by bucket: compressed planes of the ascending hashes' steps, and of ids less the block's least.  Copies send none."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def flush():
            nonlocal held, count
            h, ids = (np.concatenate(x) for x in zip(*held))
            held, count = [], 0
            least = int(ids.min())
            away, kept = (ids - least).astype("<u8"), h & MASK
            rows: tuple[list, ...] = ([], [], [], [], [])
            for k, at in parts((h >> np.uint64(48)).astype(np.int64) % buckets, buckets):
                at = at[np.argsort(kept[at], kind="stable")]
                data = planes(steps(kept[at])) + planes(away[at])
                for row, value in zip(rows, (k, least, len(at), len(data), pa.compress(data, "zstd", asbytes=True))):
                    row.append(value)
            return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["bucket", "least", "n", "size", "block"])

        for part in slices(batches, "_text", limit=SEGMENT):
            texts, ids = [], []
            for i, t, copy in zip(part.column("_id").to_pylist(), filled(part, "_text").to_pylist(), part.column("_copy").to_pylist()):
                data = t.encode()
                if i is not None and not copy and len(data) >= length:
                    texts.append(data)
                    ids.append(i)
            if not texts:
                continue
            owner, h, _, _ = joined_anchors(texts, length)
            h, owner = unique_pairs(h, owner)
            held.append((h, np.array(ids, np.int64)[owner]))
            count += len(h)
            if count >= FLUSH:
                yield flush()
        if held:
            yield flush()

    return run


def shared(rows: list[tuple]) -> pa.RecordBatch:
    """The anchors of two documents or more in a bucket, by document."""
    hashes, ids = [], []
    for least, n, size, block in rows:
        data = pa.decompress(block, size, "zstd", asbytes=True)
        step, at = from_planes(data, 0, n)
        hashes.append(np.cumsum(step, dtype=np.uint64))
        ids.append(from_planes(data, at, n)[0].astype(np.int64) + least)
    h, i = np.concatenate(hashes), np.concatenate(ids)
    order = np.argsort(h, kind="stable")
    h, i = h[order], i[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    several = np.minimum.reduceat(i, starts) != np.maximum.reduceat(i, starts)
    keep = np.repeat(several, np.diff(np.concatenate([starts, [len(h)]])))
    h, i = h[keep], i[keep]
    docs, inverse = np.unique(i, return_inverse=True)
    edges = np.searchsorted(inverse[order := np.argsort(inverse, kind="stable")], np.arange(len(docs) + 1))
    flat, edges = packed(h[order]), (edges * HASH_BYTES).tolist()
    blobs = [flat[a:b] for a, b in zip(edges, edges[1:])]
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(blobs, pa.binary())], ["id", "anchors"])


def shared_anchors(batches):
    """For each bucket, the anchors of two documents or more, by document.  What a bucket takes is given back before the next."""
    for _, rows in _by_bucket(batches):
        yield shared(rows)
        give_back()


def _by_bucket(batches) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of each bucket, from batches sorted by it, without the bucket."""
    bucket, rows = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns):
            if row[0] != bucket:
                if rows:
                    yield bucket, rows
                bucket, rows = row[0], []
            rows.append(row[1:])
    if rows:
        yield bucket, rows


def context_blocks(length: int, buckets: int):
    """Contexts of shared anchors by bucket: compressed columns of anchor, id, row of the id, place, bytes before the anchor, and context, and the different contexts' sizes and bytes, each once."""

    def run(batches):
        held: list[tuple] = []
        count = 0

        def flush():
            nonlocal held, count
            h, ids, nth, place, ahead = (np.concatenate([x[k] for x in held]) for k in range(5))
            coded = pa.array([c for x in held for c in x[5]], pa.binary()).dictionary_encode()
            codes, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
            held, count = [], 0
            rows: tuple[list, ...] = ([], [], [], [], [])
            least = int(ids.min())
            for k, at in parts((h % np.uint64(buckets)).astype(np.int64), buckets):
                at = at[np.argsort(h[at], kind="stable")]
                own, local = np.unique(codes[at], return_inverse=True)
                texts = distinct.take(pa.array(own)).to_pylist()
                sizes = np.array([*map(len, texts)], np.int64)
                columns = steps(h[at]), ids[at] - least, nth[at], place[at], ahead[at], local
                data = b"".join([len(own).to_bytes(4, "little"), planes(sizes), *map(planes, columns), *texts])
                for row, value in zip(rows, (k, least, len(at), len(data), pa.compress(data, "zstd", asbytes=True))):
                    row.append(value)
            return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["bucket", "least", "n", "size", "block"])

        for part in slices(batches, "_text", limit=SEGMENT):
            columns = [part.column(c).to_pylist() for c in ("_id", "_text", "_nth", "_copy", "anchors")]
            for i, t, nth, copy, blobs in zip(*columns):
                data = (t or "").encode()
                if i is None or copy or len(data) < length:
                    continue
                h, a, b, p = anchors(np.frombuffer(data, np.uint8), length)
                own = np.isin(h & MASK, unpacked(b"".join(blobs)))
                if not own.any():
                    continue
                h, a, b, p = h[own], a[own], b[own], p[own]
                held.append((h & MASK, np.full(len(h), i), np.full(len(h), nth), a, p - a, [data[x : y + length] for x, y in zip(a.tolist(), b.tolist())]))
                count += len(h)
                if count >= FLUSH // 2:
                    yield flush()
        if held:
            yield flush()

    return run


def read_blocks(rows: list[tuple]) -> tuple[np.ndarray, ...]:
    """Anchor, id, row of the id, place, bytes before the anchor and distinct context of each context of a bucket, and the distinct ones."""
    columns: list[list[np.ndarray]] = [[] for _ in range(6)]
    texts, before = [], 0
    for least, n, size, block in rows:
        data = pa.decompress(block, size, "zstd", asbytes=True)
        m = int.from_bytes(data[:4], "little")
        own, at = from_planes(data, 4, m)
        off = np.concatenate([[0], np.cumsum(own)]).astype("<i4")
        for k in range(6):
            x, at = from_planes(data, at, n)
            columns[k].append(np.cumsum(x, dtype=np.uint64) if not k else x.astype(np.int64) + least if k == 1 else x.astype(np.int32))
        columns[5][-1] += before
        before += m
        texts.append(pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(off), pa.py_buffer(data[at:])]))
    coded = pa.chunked_array(texts).combine_chunks().dictionary_encode()
    h, ids, nth, place, ahead, local = (np.concatenate(c) for c in columns)
    return h, ids, nth, place, ahead, coded.indices.to_numpy()[local], coded.dictionary


def parted(group: np.ndarray, code: np.ndarray, ahead: np.ndarray, distinct: pa.Array, low: int, high: int, length: int) -> Iterator[tuple]:
    """Parts of contexts that may have a window in common with another's, for either half of the windows ``low`` to ``high``.

    Windows are told by their start from the anchor on.  Those of a half all hold the bytes from its last start to its
    first end, so they are dealt out by these: a string longer than what all of them hold, which splits a group
    that very many different contexts have.  Of a half of one window that is the window itself.  Parts that are alone in their group are dropped.
    Yields new groups, the contexts, the parts' places in them, their bytes before the anchor, their bytes, and the half.
    """
    sizes = pa.compute.binary_length(distinct).to_numpy(zero_copy_only=False)
    data = np.frombuffer(distinct.buffers()[2], np.uint8)
    off = np.frombuffer(distinct.buffers()[1], np.int32)[distinct.offset : distinct.offset + len(distinct)].astype(np.int64)
    raw = memoryview(distinct.buffers()[2])
    last = sizes[code] - length - ahead  # the last window's start
    mid = (low + high) // 2
    for a, b in ((low, mid), (mid + 1, high)):
        x = np.flatnonzero(np.maximum(-ahead, a) <= np.minimum(last, b))
        if not len(x):
            continue
        begin, end = np.maximum(ahead[x] + a, 0), ahead[x] + np.minimum(last[x], b) + length
        at = off[code[x]]
        core = at + ahead[x] + b
        digest = np.zeros(len(x), np.uint64)
        for i in range(a + length - b):
            digest = (digest ^ _BYTE[data[core + i]]) * np.uint64(_BASE)
            digest ^= digest >> np.uint64(29)
        order = np.lexsort((digest, group[x]))
        gs, ds = group[x][order], digest[order]
        number = np.cumsum(np.concatenate([[True], (gs[1:] != gs[:-1]) | (ds[1:] != ds[:-1])])) - 1
        several = np.bincount(number)[number] > 1
        order, number = order[several], number[several]
        if not len(order):
            continue
        x, at, begin, end = x[order], at[order], begin[order], end[order]
        texts = pa.array([bytes(raw[u:v]) for u, v in zip((at + begin).tolist(), (at + end).tolist())], pa.binary()).dictionary_encode()
        yield number, x, begin, ahead[x] - begin, texts.indices.to_numpy(zero_copy_only=False), texts.dictionary, a, b


def firsts_and_copies(group: np.ndarray, code: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the contexts of each group, those that no smaller id has, in the order of groups and ids; and the others.  A document may have one at several places."""
    order = np.lexsort((ids, code, group))
    new = np.concatenate([[True], (group[order][1:] != group[order][:-1]) | (code[order][1:] != code[order][:-1])]) if len(order) else np.zeros(0, bool)
    least = ids[order][new][np.cumsum(new) - 1]
    whole, rest = order[ids[order] > least], order[ids[order] == least]
    return rest[np.lexsort((ids[rest], group[rest]))], whole


def partial_marks(h, ids, place, code, distinct: pa.Array, sizes: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Contexts and window starts that a smaller id has too, for one context of each sort in each group ``h``.

    Contexts are given in order of their groups and ids.  Those of a group are numbered, and for each power of two
    the ones whose number has that bit are streamed against those before them that differ in it first; many groups
    stand under one index.
    """
    new = np.concatenate([[True], h[1:] != h[:-1]])
    anchor = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    nth = np.arange(len(h)) - first[anchor]
    last = (np.concatenate([first[1:], [len(h)]]) - first - 1)[anchor]  # greatest number of the anchor
    none = np.iinfo(np.int64).max
    for bit in range(int(last.max()).bit_length()):
        later = (nth >> bit) & 1 == 1
        earlier = ~later & ((nth >> bit) + 1 << bit <= last)  # with a half beside them
        some = np.flatnonzero(later | earlier)
        # an index holds whole pairs of halves; more than its size only where one pair does
        pair = np.concatenate([[0], np.cumsum((anchor[some][1:] != anchor[some][:-1]) | (nth[some][1:] >> bit + 1 != nth[some][:-1] >> bit + 1))])
        fill = np.cumsum(sizes[code[some]])
        part = (fill // INDEX_BYTES)[np.searchsorted(pair, pair)]
        for _, at in parts(part, int(part[-1]) + 1):
            at = some[at]
            old, streamed = at[earlier[at]], at[later[at]]
            own, local = np.unique(code[old], return_inverse=True)
            least = np.full(len(own), none)
            np.minimum.at(least, local, ids[old])
            index = RunIndex.build(distinct.take(pa.array(own)).to_pylist(), least, length)
            own, local = np.unique(code[streamed], return_inverse=True)
            by_window = index.least_ids(distinct.take(pa.array(own)).to_pylist(), length, none)
            counts = np.array([len(x) for x in by_window], np.int64)
            begin = np.cumsum(counts) - counts
            flat = np.concatenate(by_window)
            n = counts[local]
            row = np.repeat(np.arange(len(streamed)), n)
            step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            hit = flat[begin[local][row] + step] < ids[streamed][row]
            yield streamed[row[hit]], (place[streamed][row] + step)[hit]


def of_several(group: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether the group of each has more than one id; given in order of groups and ids."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    ends = np.concatenate([first[1:], [len(group)]])
    return np.repeat(ids[first] < ids[ends - 1], ends - first)


def spans_of(h, ids, place, ahead, code, distinct: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Contexts that have windows of smaller ids at their anchor, and where these begin and end.

    Of contexts that are equal those of larger ids are marked whole.  The others are parted by longer strings;
    groups that are still larger than ``GROUP_BYTES`` are so again, down to single windows if need be, and an index decides
    the rest: none is for much more than ``INDEX_BYTES``, however many contexts an anchor has.
    """
    k = min(GRAM, length)
    todo = [(h, np.arange(len(h)), place, ahead, code, distinct, k - length, 0, True)]
    while todo:
        group, x, at, ahead, code, distinct, low, high, whole = todo.pop()
        sizes = pa.compute.binary_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
        left, equal = firsts_and_copies(group, code, ids[x])
        yield x[equal], at[equal], at[equal] + sizes[code[equal]]
        if not len(left):
            continue
        left = left[of_several(group[left], ids[x[left]])]
        if not len(left):
            continue
        large = np.ones(len(left), bool)
        if not whole:
            new = np.concatenate([[True], group[left][1:] != group[left][:-1]])
            large = np.add.reduceat(sizes[code[left]], np.flatnonzero(new))[np.cumsum(new) - 1] > GROUP_BYTES
            large &= low < high
        small, left = left[~large], left[large]
        if len(small):
            for y, start in partial_marks(group[small], ids[x[small]], at[small], code[small], distinct, sizes, length):
                yield x[small[y]], start, start + length
        if len(left):
            for number, y, begin, *part in parted(group[left], code[left], ahead[left], distinct, low, high, length):
                y = left[y]
                todo.append((number, x[y], at[y] + begin, *part, False))


def marked(length: int):
    """Marked runs of each document, from the contexts of a bucket."""

    def marks(rows: list[tuple]) -> pa.RecordBatch:
        h, ids, nth, place, ahead, code, distinct = read_blocks(rows)
        spans = [np.stack([ids[x], nth[x], begin, end], 1) for x, begin, end in spans_of(h, ids, place, ahead, code, distinct, length)]
        found = np.concatenate(spans)
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        # runs of spans that touch are joined
        if len(found):
            doc = np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(1)])
            number = np.cumsum(doc) - 1
            reach = np.maximum.accumulate(found[:, 3] + number * (1 << 40)) - number * (1 << 40)
            fresh = np.concatenate([[True], doc[1:] | (found[1:, 2] > reach[:-1])])
            ends = np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(found) - 1]])
            found = np.concatenate([found[fresh][:, :3], reach[ends][:, None]], 1)
        doc = np.flatnonzero(np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(1)])) if len(found) else np.zeros(0, np.int64)
        data = np.ascontiguousarray(found[:, 2:].astype("<i4")).tobytes()
        edges = [*(doc * 8).tolist(), len(data)]
        return pa.RecordBatch.from_arrays([pa.array(found[doc, 0], pa.int64()), pa.array(found[doc, 1], pa.int32()), pa.array([data[a:b] for a, b in zip(edges, edges[1:])], pa.binary())], ["_id", "nth", "spans"])

    def run(batches):
        for _, rows in _by_bucket(batches):
            yield marks(rows)
            give_back()

    return run


def union(blobs: list[bytes]) -> np.ndarray:
    """Disjoint ascending spans that cover what the given ones cover; touching ones are joined."""
    spans = np.frombuffer(b"".join(blobs), "<i4").reshape(-1, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.concatenate([[True], spans[1:, 0] > reach[:-1]]))
    return np.stack([spans[new, 0], reach[np.concatenate([new[1:] - 1, [len(spans) - 1]])]], 1)


def without(data: bytes, spans: np.ndarray) -> bytes:
    edges = [0, *spans.ravel().tolist(), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def with_spans(docs: DataFrame, length: int, key: str, text: str) -> DataFrame:
    """A row per row of ``docs``: ``_row`` (its other columns), ``_id``, ``_text``, ``_nth``, ``_copy`` (a smaller id has the same text) and ``spans``.

    ``spans`` is a list of the row number ``nth`` among the different texts of one id, and packed spans.
    """
    if length < 8:
        raise ValueError("length must be 8 at least")
    source = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = materialise(source.select("id", F.md5("text").alias("digest")).where("id is not null").distinct(), "contents")
    least = base.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1")
    copies = base.join(least, "digest").where(F.col("id") > F.col("least")).select("id", "digest", F.lit(True).alias("copy"))
    several = base.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    odd = base.join(several, "id").select("id", "digest", F.lit(False).alias("copy"))
    odd = odd.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("digest"))).unionByName(copies.withColumn("nth", F.lit(0)))
    odd = odd.groupBy("id", "digest").agg(F.max("copy").alias("copy"), F.max("nth").alias("nth"))
    # by id alone, so that the texts stay dealt out as they are
    odd = odd.groupBy(F.col("id").alias("_odd")).agg(F.map_from_entries(F.collect_list(F.struct("digest", F.struct("copy", "nth")))).alias("odd"))
    odd = materialise(odd, "copies")

    buckets = source.rdd.getNumPartitions() + 16
    # the texts are dealt out by id once, and read from there for their anchors, for their contexts and for the outcome
    texts = docs.select(F.struct(*(c for c in docs.columns if c != text)).alias("_row"), F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"))
    plain = F.coalesce("_text", F.lit(""))
    texts = texts.withColumn("_salt", F.coalesce("_id", F.xxhash64("_text"))).repartition(max(buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "_salt")
    own = F.get(F.array(F.col("odd")[F.md5(plain)]), F.lit(0))
    noted = texts.join(odd, F.col("_salt") == F.col("_odd"), "left").withColumns({"_copy": F.coalesce(own["copy"], F.lit(False)), "_nth": F.coalesce(own["nth"], F.lit(0))}).drop("odd", "_odd")
    sent = noted.mapInArrow(anchor_blocks(length, buckets), "bucket int, least bigint, n int, size int, block binary")
    shared = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(shared_anchors, "id bigint, anchors binary")
    shared = shared.groupBy(F.col("id").alias("_shared")).agg(F.collect_list("anchors").alias("anchors"))
    some = noted.join(shared, F.col("_salt") == F.col("_shared"))
    contexts = some.mapInArrow(context_blocks(length, buckets), "bucket int, least bigint, n int, size int, block binary")
    spans = contexts.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(marked(length), "_id bigint, nth int, spans binary")
    spans = spans.groupBy(F.col("_id").alias("_spanned")).agg(F.collect_list(F.struct("nth", "spans")).alias("spans"))
    return noted.join(spans, F.col("_salt") == F.col("_spanned"), "left").drop("_salt", "_spanned")


def kept_bytes(batch: pa.RecordBatch, length: int) -> Iterator[tuple[bytes, bytes, np.ndarray]]:
    """For each row its bytes, what is left of them, and the removed spans."""
    none = np.zeros((0, 2), np.int64)
    for t, copy, nth, i, blobs in zip(*(batch.column(c).to_pylist() for c in ("_text", "_copy", "_nth", "_id", "spans"))):
        data = (t or "").encode()
        if copy and len(data) >= length:
            yield data, b"", np.array([[0, len(data)]])
            continue
        own = [b["spans"] for b in blobs or () if b["nth"] == nth] if i is not None else []
        spans = union(own) if own else none
        yield data, without(data, spans), spans


def removal_digest(docs: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of the bytes left.

    null text: as empty.  A text of fewer than ``length`` bytes loses nothing.  Rows of one key and
    different texts are judged each on its own; repeated rows give a row each.  A null key isn't
    smaller than any, nor has any smaller: it loses and marks nothing.  Very long texts are taken whole.
    Columns beside the two named aren't read.  Empty table: empty result.
    """

    def run(batches):
        for batch in slices(batches, "_text"):
            rows = [(len(d), int((s[:, 1] - s[:, 0]).sum()), len(s), hashlib.sha256(k).hexdigest()) for d, k, s in kept_bytes(batch, length)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))], [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = with_spans(docs.select(key, text), length, key, text)
    return found.mapInArrow(run, f"`{key}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without repeated bytes; characters that lose a byte go, and documents that lose all.

    Other columns stay as they are.  Nulls, repeats and short texts as in ``removal_digest``; an empty or null
    text stays.
    """
    names, others = docs.columns, [c for c in docs.columns if c != text]

    def run(batches):
        for batch in slices(batches, "_text"):
            left = [None if not len(s) else k.decode("utf-8", "ignore") for _, k, s in kept_bytes(batch, length)]
            old = batch.column("_text")
            new = pa.compute.coalesce(pa.array(left, old.type), old)
            keep = pa.array([x is None or bool(x) for x in left], pa.bool_())
            columns = dict(zip(others, batch.column("_row").flatten())) | {text: new}
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names).filter(keep)

    return with_spans(docs, length, key, text).mapInArrow(run, docs.schema)
