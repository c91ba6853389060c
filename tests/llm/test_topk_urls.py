import math

import numpy as np
import pytest

from rowloom.llm import topk, urls

VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, k, every):
    v = [(i, np.floor(np.array(x, np.float64) * 1024)) for i, x in rows]
    dim = max((len(x) for _, x in v), default=0)
    v = [(i, np.pad(x, (0, dim - len(x)))) for i, x in v]
    out = []
    for a, (i, q) in enumerate(v):
        if i % every == 0:
            found = sorted((-int(q @ x), j) for b, (j, x) in enumerate(v) if b != a)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("n, k, every", [(0, 3, 2), (1, 3, 1), (5, 10, 1), (400, 10, 20), (300, 1, 7)])
def test_top_k_equals_brute_force(spark, n, k, every):
    rng = np.random.default_rng(n)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(n)]
    got = topk.top_k(spark.createDataFrame([(*r, 0) for r in rows], VECTORS), k, every).collect()
    assert sorted(map(tuple, got)) == brute(rows, k, every)


def test_ties_copies_and_rows_that_take_no_part(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    rng = np.random.default_rng(5)
    same = rng.normal(size=6).astype(np.float32).tolist()
    rows = [(i, same) for i in range(60)] + [(100, same), (100, rng.normal(size=6).astype(np.float32).tolist()), (101, [1.0]), (102, [])]
    rows += [(200 + i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(100)]
    none = [(300, None), (None, same), (400, [1.0, None]), (500, [float("nan")] * 6), (600, [float("inf")] * 6)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(*r, 0) for r in rows + none], VECTORS).withColumn("id", F.lit("clash")).withColumn("rank", F.lit("clash")).withColumn("pivot", F.lit(1))
    got = topk.top_k(df.repartition(4), 10, 50).collect()
    assert sorted(map(tuple, got)) == brute(rows, 10, 50)


def exact(rows, k, every):
    v = [(i, [math.floor(float(np.float32(c)) * 1024) for c in x]) for i, x in rows]
    out = []
    for i, q in v:
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in v if j != i)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("size", [2e4, 3e5, 4e5])
def test_large_vectors_take_part_and_score_exactly(spark, monkeypatch, size):
    monkeypatch.setattr(topk, "BLOCK", 32)
    monkeypatch.setattr(topk, "ROUNDS", (1, 2, 5, 1000))
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=64) * (size if i % 2 else 1) * 0.7).astype(np.float32).tolist()) for i in range(300)]
    rows += [(400 + i, (np.array(rows[1][1]) + i).astype(np.float32).tolist()) for i in range(40)]
    got = topk.top_k(spark.createDataFrame([(*r, 0) for r in rows], VECTORS), 5, 7).collect()
    assert sorted(map(tuple, got)) == exact(rows, 5, 7)


def test_a_component_that_fits_no_long_is_an_error(spark):
    with pytest.raises(Exception, match="doesn't fit a long"):
        topk.top_k(spark.createDataFrame([(0, [1.0], 0), (700, [1e30], 0)], VECTORS), 5, 7).collect()


def test_products_beyond_each_arithmetic():
    rng = np.random.default_rng(2)
    for bits in (10, 24, 28, 40, 62):
        v = rng.integers(-(1 << bits), 1 << bits, (20, 8))
        want = [max(-topk.MOST, min(topk.MOST, sum(a * b for a, b in zip(x, v[3].tolist())))) for x in v.tolist()]
        assert topk.products(v, np.square(v.astype(float)).sum(1), v[3]).tolist() == want


PAGES = "page_id long, url string, html string"


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([k for k in (rest.find(c) for c in "/?#") if k >= 0], default=len(rest))
    path = rest[cut:]
    end = min([k for k in (path.find(c) for c in "?#") if k >= 0], default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), path[:end]


def longest_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [None, "", "no scheme", "http://", "http://A.Example.COM/en/7x", "https://b.com/en/5", "x://com/en/", "https://example.net/de/80", "https://w.example.net/de/9", "http://org/es/1?x=/a#b", "http://h?q://z/en/", "http://h#f", "ftp://É.Com/en/", "http://com.evil/en/1", "http://xcom/en/1", "http://a.com/EN/1", "a://b://c/d", "http://" + "p" * 5000 + ".com/en/" + "q/" * 3000]


def test_hosts_paths_and_rules(spark):
    rows = [(i, u, "") for i, u in enumerate(URLS)] + [(None, "http://a.com/en/1", None), (3, URLS[3], "")]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, PAGES).withColumn("host", F.lit("clash")).withColumn("n", F.lit(1))
    got = urls.filter_urls(df)
    assert got.count() == len(rows)
    for r in got.collect():
        if r.page_id is not None:
            host, path = host_path(URLS[r.page_id])
            rule, verdict = longest_rule(host, path)
            assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert urls.filter_urls(spark.createDataFrame([], PAGES)).count() == 0


def test_templates_learn_from_rules(spark):
    rows = [(i, f"http://spam.org/offer/{i}/buy", "") for i in range(60)] + [(100 + i, f"http://spam.org/offer/item{i}x{i}/buy/now", "") for i in range(5)] + [(200 + i, f"http://good.org/news/{i}", "") for i in range(40)]
    rules = [("block", "spam.org", f"/offer/{d}") for d in range(1, 6)] + [("allow", "good.org", "/news/1")]
    got = {r.page_id: (r.verdict, r.rule, r.template) for r in urls.filter_urls(spark.createDataFrame(rows, PAGES), rules).collect()}
    assert got[7][1] is None and got[7][0] == "block" and got[60 - 1][0] == "block"  # /offer/7: like the others of its template
    assert all(got[200 + i][0] == "allow" for i in range(40))
    assert got[7][2] == got[10][2]


def test_many_children_become_a_wildcard(spark):
    rows = [(i, f"http://h.com/user/{'abcdefghijklmnopqrstuvwxyz'[i]}{'zyxwvu'[i % 6]}/home", "") for i in range(26)]
    got = urls.filter_urls(spark.createDataFrame(rows, PAGES), [])
    assert {r.template for r in got.collect()} == {"user/*/home"}


def test_alike_branches_are_merged_at_every_level_and_others_are_not(spark):
    """Two branches of other children share a template's labels; one of another purity, one without labels and a mixed one don't."""
    paths = [f"/{top}/{a}/{leaf}/p" for top in ("t", "u") for a, leaves in (("a", "xy"), ("b", "xz"), ("c", "xw"), ("d", "xv")) for leaf in leaves]
    rows = [(i, f"http://h.org{p}{'?'}{i}", "") for i, p in enumerate(paths * 8)]
    rules = [(word, "h.org", f"/{top}/{a}/{leaf}") for top in ("t", "u") for word, a, leaf in (("block", "a", "x"), ("block", "b", "x"), ("allow", "c", "x"))]
    judged = {r.path: r for r in urls.filter_urls(spark.createDataFrame(rows, PAGES), rules).collect()}
    assert judged["/t/a/x/p"].purity == judged["/t/b/x/p"].purity == judged["/u/a/x/p"].purity > 0.8
    assert judged["/t/c/x/p"].purity < 0.2 and judged["/t/d/x/p"].rule is None and judged["/t/d/x/p"].verdict == "allow"
    # of what has no labels nothing is known
    assert {judged[f"/t/{p}/p"].verdict for p in ("a/y", "b/z", "c/w", "d/v")} == {"allow"}


@pytest.mark.parametrize("seed", range(4))
def test_branches_by_definition(spark, seed):
    import random

    rng = random.Random(seed)
    kids = [(f"n{i}", "p", f"s{i}", *(lambda n: (min(n, int(n * rng.choice([0, 0.1, 0.5, 1]) + 0.5)), n))(rng.choice([0, 3, 20, 60])), 1) for i in range(12)]

    def like(b, n, all_b, all_n):
        return all_b in (0, all_n) or n == all_n or all_n * (b * all_n - all_b * n) ** 2 <= urls.DIFFERENT * (n * (all_n - n) * all_b * (all_n - all_b))

    everything = sum(k[3] for k in kids), sum(k[4] for k in kids)
    side = {k[0]: "?" if not k[4] else "~" if like(k[3], k[4], *everything) else "+" if k[3] * everything[1] > everything[0] * k[4] else "-" for k in kids}
    want = {}
    for k in kids:
        same = [o for o in kids if side[o[0]] == side[k[0]]]
        sums = sum(o[3] for o in same), sum(o[4] for o in same)
        want[k[0]] = side[k[0]] if side[k[0]] in "?~" or like(k[3], k[4], *sums) else f"={k[2]}"
    made = spark.createDataFrame(kids, "node string, up string, seg string, b long, l long, size long")
    assert {r.node: r.branch for r in urls.merged_branches(made, 12).collect()} == want


def test_wildcards_at_any_depth_and_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(urls, "HOT", 5)
    deep = "/a" * 6
    rows = [(i, f"http://h.com{deep}/{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'zyxw'[i // 26]}/home", "") for i in range(60)] + [(100 + i, "http://h.com/a/a/b", "") for i in range(30)]
    got = urls.filter_urls(spark.createDataFrame(rows, PAGES), [("block", "h.com", "/a/a/a")]).collect()
    assert len(got) == 90 and {r.template for r in got if r.page_id < 100} == {deep[1:] + "/*/home"} and {r.verdict for r in got if r.page_id >= 100} == {"allow"}
