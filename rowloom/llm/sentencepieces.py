"""SentencePiece encoding and decoding through a table of distinct chunks.

A chunk is a run of white-space markers with the characters up to the next marker.  No piece of a
vocabulary trained with ``split_by_whitespace`` has a marker after another character, so no merge
crosses from one chunk into the next: each distinct chunk is segmented once for a slice of texts
(and kept for the next slices), and the ids are joined by position.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from rowloom.llm.common import filled, pieces, slices

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
KEPT_CHUNKS = 400_000  # of each worker's table; beyond it the table starts anew


class ChunkTable:
    """Ids and decoded text of distinct chunks."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        names = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in names):
            raise ValueError("a piece of this model crosses a white-space marker; chunks can't be segmented alone")
        if [self.sp.id_to_piece(i) for i in self.sp.encode("a  a ")][-1] != MARK:
            raise ValueError("this model's normaliser drops white space; chunks can't be segmented alone")
        self.lone = self.sp.piece_to_id(MARK)
        self.eos = self.sp.eos_id()
        self.known: dict[str, tuple[str, int, str]] = {}

    def rows(self, chunks: list[str]) -> list[tuple[str, int, str]]:
        """For each chunk without its first marker: ids as text, their number, and the decoded text."""
        if len(self.known) + len(chunks) > KEPT_CHUNKS:
            self.known = {}
        new = [c for c in chunks if c not in self.known]
        if new:
            # the encoder itself sets one marker before a text, which is the chunk's first
            ids = [x or [self.lone] for x in self.sp.encode([c.replace(MARK, " ") for c in new], num_threads=1)]
            for c, x, text in zip(new, ids, self.sp.decode(ids, num_threads=1)):
                self.known[c] = (" ".join(map(str, x)), len(x), text)
        return [self.known[c] for c in chunks]


@functools.lru_cache(maxsize=2)
def chunk_table(model: str) -> ChunkTable:
    return ChunkTable(model)


def encode_slice(texts: pa.Array, chunks: ChunkTable) -> Iterator[tuple[str, int, str]]:
    """Ids joined by one space with the end id, their number, and the decoded text, for each text."""
    off, words = pieces(pc.split_pattern(texts, pattern=" "))
    coded = words.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    code = coded.indices.to_numpy(zero_copy_only=False)
    # a split at single spaces gives the chunks, unless it left an empty one or the text has a marker of its own
    odd = np.array([not w or MARK in w for w in distinct], bool)
    bad = np.add.reduceat(odd[code], off[:-1]) if len(code) else np.zeros(len(texts), int)
    rows = chunks.rows(distinct)
    ids, counts, surface = [r[0] for r in rows], np.array([r[1] for r in rows], np.int64), [r[2] for r in rows]
    for i in range(len(texts)):
        if not bad[i]:
            own = code[off[i] : off[i + 1]]
            at = own.tolist()
            yield f"{' '.join([ids[c] for c in at])} {chunks.eos}", int(counts[own].sum()) + 1, " ".join([surface[c] for c in at])
            continue
        text = texts[i].as_py()
        if not text:
            yield str(chunks.eos), 1, ""
            continue
        own_rows = chunks.rows([c[1:] for c in CHUNK.findall(MARK + text.replace(" ", MARK))])
        yield f"{' '.join([r[0] for r in own_rows])} {chunks.eos}", sum(r[1] for r in own_rows) + 1, " ".join([r[2] for r in own_rows])


def encode_pieces(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Encode ``text`` as the library does, with an end id only, and decode it again.

    Returns key, ``n_tokens``, and ``ids`` and ``decoded``; with ``digest`` their SHA-256 instead
    (of the decimal ids joined by one space, and of the decoded text in UTF-8).

    null text: as empty.  Empty text: the end id alone, decoded ''.  A text of any length is encoded
    whole.  Repeated rows each give a row; a null key is returned as null; other columns are not read.
    An empty table gives an empty table.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string")

    def run(batches):
        chunks = chunk_table(model)
        for part in slices(batches):
            n, first, second = [], [], []
            for ids, count, decoded in encode_slice(filled(part), chunks):
                n.append(count)
                first.append(hashlib.sha256(ids.encode()).hexdigest() if digest else np.array(ids.split(" "), np.int32))
                second.append(hashlib.sha256(decoded.encode()).hexdigest() if digest else decoded)
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(n, pa.int64()), pa.array(first, pa.string() if digest else pa.list_(pa.int32())), pa.array(second, pa.string())], [key, "n_tokens", "ids_sha256" if digest else "ids", "decoded_sha256" if digest else "decoded"])

    return docs.select(key, docs[text].alias("text")).mapInArrow(run, schema)
