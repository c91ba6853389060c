import re
from collections import Counter

import pytest

from rowloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(grams)
    covered = set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), sum(a == b for a, b in zip(words, words[1:]))


def test_counts_match_brute_force(spark, make_docs, odd_rows, words):
    rows = [*odd_rows, (20, "x y\nx y\n \nx y z\n\n", "en", "s", 1), (21, words(12, 1) + " " + words(12, 1), "en", "s", 1), (22, "# <b> $5 | & 100%* " + words(40, 7), "en", "s", 1)]
    got = [tuple(r) for r in quality.measure(make_docs(rows)).collect()]
    want = [(r[0], r[2], r[3], *brute(r[1])) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_odd_rows_and_clashing_columns(spark, make_docs, odd_rows):
    plain = quality.quality_rules(make_docs(odd_rows))
    assert plain.count() == len(odd_rows)
    assert sorted(plain.collect(), key=repr) == sorted(quality.quality_rules(make_docs(odd_rows, extra=True)).collect(), key=repr)
    base = {(r.doc_id, r.n_words): r.base_failed for r in plain.collect()}
    assert base[1, 0] and base[2, 0] and base[8, 25]
    assert not any(r.kept and r.base_failed for r in plain.collect())
    kept = quality.keep_good(make_docs(odd_rows, extra=True))
    assert kept.columns == make_docs(odd_rows, extra=True).columns
    assert kept.count() == sum(r.kept for r in plain.collect())


def test_empty_table(make_docs):
    assert quality.quality_rules(make_docs([])).count() == 0
    assert quality.keep_good(make_docs([])).count() == 0


def test_junk_goes_and_clean_texts_stay(make_docs, words):
    clean = [(i, words(80, i)) for i in range(100)]
    junk = [(200, " ".join(w + "###$$" for w in words(80, 1).split())), (201, " ".join(w for w in words(10, 2).split() for _ in range(7))), (202, " | ".join(words(80, 3).split()))]
    verdict = {r.doc_id: r.kept for r in quality.quality_rules(make_docs(clean + junk)).collect()}
    assert all(verdict[i] for i, _ in clean) and not any(verdict[i] for i, _ in junk)


@pytest.mark.parametrize("v", [0, 1, 63, 64, 65, 100, 1023, 1024, 123_456_789])
def test_bins_are_close(spark, v):
    from pyspark.sql import functions as F

    b = spark.range(1).select(quality.bin_floor(quality.to_bin(F.lit(v).cast("long")))).first()[0]
    assert b <= v < b * (1 + 1 / 32) + 1


def test_sketches_merge_in_any_order(spark, make_docs, words):
    from pyspark.sql import functions as F

    docs = make_docs([(i, words(40 + i, i), "en", f"s{i % 5}", 1) for i in range(60)])
    measured = quality.measure(docs).withColumn("base_failed", F.lit(False))
    parts = quality.merge(quality.sketch(measured, ("lang", "source")), ("lang",))
    assert sorted(parts.collect()) == sorted(quality.sketch(measured, ("lang",)).select(*parts.columns).collect())


def fences(docs):
    measured = quality.measure(docs).selectExpr("*", "n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed")
    return {(r.lang, r.source): r.asDict() for r in quality.thresholds(measured).collect()}


def test_small_groups_borrow_thresholds(make_docs, words):
    rows = [(i, words(60, i), "en", "big", 1) for i in range(80)] + [(100, words(60, 100), "en", "small", 1), (101, words(60, 101), "xx", "tiny", 1)]
    limits = fences(make_docs(rows))
    assert len(limits) == 3
    merged = fences(make_docs([(r[0], r[1], "en", "one", 1) for r in rows if r[2] == "en"]))["en", "one"]
    assert {k: v for k, v in limits["en", "small"].items() if k != "source"} == {k: v for k, v in merged.items() if k != "source"}


def noisy(words, i):
    """A text with some of all that is counted, more of it with rising i."""
    line = words(10, 1000 + i)
    some = " ".join(w + "ing" + "#" * (k % 20 < 1 + i % 5) for k, w in enumerate(words(150, i).split()))
    return "\n".join([some, *([line] * (2 + i % 2)), "so so " * (1 + i % 4)])


def test_every_fence_follows_its_group(make_docs, words):
    rows = [(i, words(200, i), "en", "plain", 1) for i in range(100)] + [(200 + i, noisy(words, i), "en", "noisy", 1) for i in range(100)]
    limits = fences(make_docs(rows))
    for name, *_ in quality.RATIOS:
        assert limits["en", "noisy"][f"{name}_high"] > limits["en", "plain"][f"{name}_high"], name
    verdict = {r.doc_id: r.kept for r in quality.quality_rules(make_docs(rows + [(400, noisy(words, 3), "en", "plain", 1)])).collect()}
    assert all(v for i, v in verdict.items() if i < 400) and not verdict[400]


def brute_fence(values, ranks, step, sign):
    """The quantile before the first leap, by the definition, over exact values below 64."""
    values = sorted(values)
    at = lambda r: values[max(-(-r * len(values) // 1000), 1) - 1]
    origin, *q = [at(r if sign > 0 else 1000 - r) for r in (quality.ORIGIN, *ranks)]
    for last, new in zip(q, q[1:]):
        if (new - origin) * sign > quality.LEAP * (last - origin) * sign + step:
            return last
    return q[-1]


def test_fences_by_definition(spark):
    import random

    rng = random.Random(3)
    groups = {f"s{k}": [min(int(rng.expovariate(0.2)) + (40 if rng.random() < k / 20 else 0), 63) for _ in range(60 + 17 * k)] for k in range(8)}
    rows = [(g, "echoes", v, 1) for g, vs in groups.items() for v in vs] + [(g, "word_length", v, 1) for g, vs in groups.items() for v in vs]
    made = spark.createDataFrame(rows, "source string, ratio string, bin long, one long").groupBy("source", "ratio", "bin").count().withColumnRenamed("count", "n")
    steps = {name: least for name, *_, least in quality.RATIOS}
    for r in quality.fences(made, ("source",)).collect():
        assert r.docs == len(groups[r.source])
        assert r.high == brute_fence(groups[r.source], quality.RANKS, steps[r.ratio], 1)
        assert r.low == (brute_fence(groups[r.source], quality.RANKS, steps[r.ratio], -1) if r.ratio == "word_length" else -1)


def test_repeats_alone_reject_below_the_fixed_rule(make_docs, words):
    clean = [(i, words(200, i)) for i in range(100)]
    passage, line = words(28, 500), words(9, 501)
    rows = [(200, f"{words(72, 502)} {passage} {words(72, 503)} {passage}"), (201, f"{words(31, 504)} {line} {words(31, 505)} {line}")]
    got = {r.doc_id: r for r in quality.quality_rules(make_docs(clean + rows)).collect()}
    assert got[200].n_repeat_words == 56 and got[200].n_words == 200 and got[200].n_dup_lines == 0 and not got[200].base_failed
    assert not got[200].kept and got[201].n_repeat_words == 18 and got[201].kept and all(got[i].kept for i, _ in clean)
