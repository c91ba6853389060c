import itertools
import math

import pytest

from rowloom.llm import html

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header><p>Site</p></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice"><p>We use cookies</p></div>{}<aside><p>Side</p></aside><form><p>Join</p><input><button>Go</button></form><section id="comments"><h2>Comments</h2><p>I like it very much, thanks.</p></section><footer>&copy; me</footer></body></html>"""
BODY = '<h1>A &amp; B</h1><p>First <b>bold</b>\n  text<br>with <a href="x">a link</a>.<!-- no --><p>Second&nbsp;one &#233;<ul><li>x<li>y</ul><div class="ad">Buy</div><table><tr><td>c<td>d</table>'
TEXT = "A & B\n\nFirst bold text with a link.\n\nSecond one é\n\nx\n\ny\n\nc\n\nd"


@pytest.fixture(scope="module")
def model():
    return html.train([])


@pytest.mark.parametrize("shell", ["<article>{}</article>", "<main>{}</main>", '<div id="content">{}</div>', '<div class="post-content">{}</div>', "<main><article><div>{}</div></article></main>"])
def test_layouts(model, shell):
    assert html.main_text(PAGE.format(shell.format(BODY)), model) == TEXT


@pytest.mark.parametrize(
    "source, text",
    [
        ("", ""), ("<p>one<p>two", "one\n\ntwo"), ("plain", "plain"), ("<article><p>cut &am", "cut &am"), ("<article><p>cut &lt", "cut <"), ("<article><p>x</div></p>y</article>", "x\n\ny"),
        ("<article><p>a</p><!-- open", "a"), ("<nav>menu</nav>", ""), ("<script>x", ""), ("<article><h1>t</h1><script>1</script><p>a<script>2</script>b</p></article>", "t\n\nab"),
        ("<ARTICLE><P CLASS=x>up</P></ARTICLE>", "up"), ("<article><pre> a\n  b </pre></article>", "a b"), ("<article><p>a < b</p></article>", "a < b"),
    ],
)
def test_broken_markup(model, source, text):
    assert html.main_text(source, model) == text


def test_marginals_are_exact(model):
    """Sum-product against the sum over all labellings of a small page."""
    page = html.parse('<div class="post"><p>some words here</p><div class="ad"><p>x</p></div></div><footer>y</footer>')
    n = len(page.nodes)
    weight = [0.0] * n
    total = 0.0
    for labels in itertools.product(html.STATES, repeat=n - 1):
        y = (html.NEUTRAL, *labels)
        p = 1.0
        for i, node in enumerate(page.nodes[1:], 1):
            p *= (model.ties.get(html.kind(node)) or model.ties["*"])[y[node.parent]][y[i]]
            for f in (*node.features[1:], *html.shape(node)):
                p *= model.odds.get(f, (1, 1, 1))[y[i]]
        total += p
        for i in range(n):
            weight[i] += p * (y[i] == html.CONTENT)
    for got, w in zip(model.marginals(page), weight):
        assert math.isclose(got, w / total, rel_tol=1e-6, abs_tol=1e-9)


def test_held_out_pages():
    """Trained on two thirds of the generated pages, the model labels the blocks of the rest."""
    pages = list(html.generated_pages())
    model = html.Model()
    for k, p in enumerate(pages):
        if k % 3:
            model.learn(html.labelled(p))
    frozen = model.frozen()
    right = total = 0
    for p in pages[::3]:
        page = html.labelled(p)
        for m, (node, _) in ((frozen.marginals(page), b) for b in page.blocks):
            right += (m[node] > 0.5) == (page.nodes[node].label == html.CONTENT)
            total += 1
    assert right / total > 0.97


def test_table(spark):
    from pyspark.sql import functions as F

    long = "<article>" + "<p>word word</p>" * 20_000 + "</article>"
    rows = [(1, "u", PAGE.format(f"<article>{BODY}</article>")), (2, None, None), (None, "v", ""), (1, "u", PAGE.format(f"<article>{BODY}</article>")), (3, "w", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash"))
    got = html.extract(df).collect()
    assert len(got) == 5 and [r.text for r in got if r.page_id == 1] == [TEXT, TEXT] and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got}[2] == "" and {r.page_id: r.text for r in got}[3].count("\n\n") == 19_999
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("piece", ["<div>", "<p><b>", "</section>", "<ul><li>", "<table><tr><td>", "<svg/>", "<span></div>", "<a href='", "<em></b>"])
def test_parsing_takes_time_in_proportion(piece):
    import time

    def seconds(n):
        took = []
        for _ in range(3):
            began = time.perf_counter()
            html.parse("<div>" * 50 + piece * n)
            took.append(time.perf_counter() - began)
        return min(took)

    assert seconds(16_000) < 12 * seconds(4_000) + 0.05
