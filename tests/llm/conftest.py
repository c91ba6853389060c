import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def words():
    """Reproducible prose: words(n, seed)."""

    def make(n, seed=0):
        rng = random.Random(seed)
        pool = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(max(40, n))]
        return " ".join(rng.choice(pool) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table of (doc_id, text) pairs, or of whole rows; with columns of clashing names beside its own."""

    def make(rows, extra=False):
        rows = [(*r, "en", "src0", len(r[1] or "")) if len(r) == 2 else r for r in rows]
        df = spark.createDataFrame(rows, DOCS)
        if extra:
            from pyspark.sql import functions as F

            for c in ("id", "n", "key", "root", "sig", "spans", "_id", "_text", "_row", "kept", "rank", "task", "anchors", "_nth", "salt", "_digest", "_key", "start", "length", "ids"):
                df = df.withColumn(c, F.lit("clash"))
        return df

    return make


@pytest.fixture(scope="session")
def odd_rows(words):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and one id with two texts."""
    long = words(30_000, 1)
    return [
        (1, None, None, None, None),
        (2, "", "en", None, 0),
        (3, " \n\t ", None, "s", 4),
        (4, long, "en", "s", len(long)),
        (5, words(60, 2), "en", "s", 1),
        (5, words(60, 2), "en", "s", 1),
        (6, words(60, 3), "en", "s", 1),
        (6, words(60, 4), "de", "s", 1),
        (None, words(60, 5), "en", "s", 1),
        (None, None, None, None, None),
        (7, "é" * 40 + " ßñ 漢字 \u00a0 \u2028 x\x00y <|endoftext|> ▁▁ a", "fr", "s", 1),
        (8, "a a a a a a a a a a a a a a a a a a a a a a a a a", "en", "s", 1),
    ]
