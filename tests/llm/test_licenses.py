import itertools

import pytest

from rowloom.llm import licenses


def found(make_docs, text, **options):
    return licenses.license_scan(make_docs([(1, text)]), **options).first()


@pytest.mark.parametrize("name, notice", licenses.TEMPLATES)
def test_each_notice_is_found_in_other_text(make_docs, words, name, notice):
    row = found(make_docs, words(60, 1) + "\n" + notice.upper().replace(" ", "\n", 3) + "\n" + words(60, 2))
    assert name in row.licenses.split(",") and row.dice >= 800


def test_changed_and_clean_texts(make_docs, words):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 200)
    assert found(make_docs, words(20, 3) + " " + mit.replace("Software", "Program", 2)).license == "MIT"
    for text in (words(500, 4), "the license is here", "all rights", "under the", None, "", "MIT"):
        row = found(make_docs, text)
        assert (row.license, row.dice, row.licenses) == (None, 0, "")


def dice(a, b):
    x, y = (set(itertools.pairwise(w for w in map(licenses.normal, t.split()) if w)) for t in (a, b))
    return 2000 * len(x & y) // (len(x) + len(y)) if x or y else 0


def test_whole_texts_against_brute_force(make_docs):
    base = "one two three four five six seven eight nine ten".split()
    templates = (("A", " ".join(base)), ("B", " ".join(base[:4])), ("C", " ".join(base[4:])))
    texts = [" ".join(base[i:j]) for i in range(10) for j in range(i + 2, 11)]
    got = licenses.license_scan(make_docs(list(enumerate(texts))), templates=templates, need=700).collect()
    for r in got:
        best = {n: dice(texts[r.doc_id], t) for n, t in templates}
        for n, d in best.items():
            if d >= 700:
                assert n in r.licenses.split(",")


def test_size_bounds_never_prune_a_match():
    for a in range(1, 60):
        for b in range(1, 60):
            reach = 2000 * min(a, b) / (a + b)  # the most that sets of these sizes can have
            assert licenses.fits(a, b, 800) == (reach >= 800)


def test_table(make_docs, odd_rows):
    rows = [(r[0], r[1]) for r in odd_rows]
    assert licenses.license_scan(make_docs(rows, extra=True)).count() == len(rows)
    assert licenses.license_scan(make_docs([])).count() == 0


@pytest.mark.parametrize(
    "notice",
    [
        "this work is licensed under the terms of the GNU General Public License version 3",
        "this work is licensed under the terms\nof the GNU General Public\n   License version 3",
        "This work is licensed under the terms of the\nGNU General Public License, version 3.",
        "This work is licensed\tunder the terms of\tthe\r\nGNU General Public License, version 3.",
    ],
)
def test_inserted_words_and_wrapped_lines(make_docs, words, notice):
    text = words(12, 5) + " as " + notice + " and " + words(12, 6)
    row = found(make_docs, text)
    gpl = next(t for n, t in licenses.TEMPLATES if n == "GPL-3.0")
    assert row.license == "GPL-3.0" and row.dice == dice(notice, gpl) >= 800


def test_best_part_against_brute_force(make_docs):
    import random

    templates = (("A", "a b c d e f a c"), ("B", "c d b"), ("C", "e a"))
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefxyz   \n") for _ in range(40)).replace("", " ") for _ in range(150)]
    texts += [" ".join(rng.choices(("a b c d", "e f a c", "x", "a b", "c d b"), k=9)) for _ in range(150)]
    for need in (600, 800, 1000):
        got = {r.doc_id: r for r in licenses.license_scan(make_docs(list(enumerate(texts))), templates=templates, need=need).collect()}
        for i, text in enumerate(texts):
            w = text.split()
            parts = [" ".join(w[x:y]) for x in range(len(w)) for y in range(x + 2, len(w) + 1)]
            best = {n: max((dice(p, t) for p in parts), default=0) for n, t in templates}
            assert got[i].licenses == ",".join(n for n in sorted(best) if best[n] >= need)
            assert got[i].dice == max((d for d in best.values() if d >= need), default=0)
