"""Main text of web pages by a tree-structured graphical model.

The block elements of a page are the nodes of a tree; each is neutral (what only holds others), content or
junk.  The model is P(root) * prod P(node | parent, kind of node) * prod P(features | node), trained by smoothed counts.  Messages are
passed up from the leaves and down again (sum-product), which gives each node's exact marginal; the
text of nodes with a content marginal of over one half is kept.

Training pages are of two sorts: generated ones with every usual kind of block and its label, and a bounded sample of
the pages at hand that mark their article themselves (``<article>`` or ``<main>``), labelled by that.
"""

from __future__ import annotations

import functools
import html
import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import filled, slices

SAMPLE = 200  # pages at hand that training may use, of the least hashes of their keys
SMOOTH = 0.02
NEUTRAL, CONTENT, JUNK = STATES = (0, 1, 2)
DAMPED = {"chars": 0.15, "links": 0.5}  # exponents of features that say little by themselves

#: Elements by their part in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture source track area map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math canvas object audio video".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: Open elements that a start tag ends, up to the container named last.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
    "body": (("head",), ("html",)),
}
HEAD_ONLY = frozenset("meta link base title style script noscript template head html".split())
#: Words of class, id and role that tell what a block is.
CONTENT_WORDS = "article content main post entry story body text page single blog hentry articlebody markdown prose".split()
OTHER_WORDS = (
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead banner topbar footer bottom copyright legal sidebar aside widget related recommended "
    "promo ad ads advert adverts advertisement sponsor sponsored comment comments reply replies respond disqus thread cookie cookies consent notice alert popup modal overlay gdpr "
    "form search subscribe newsletter signup login share sharing social tags pagination pager toc author byline meta skip hidden print toolbar"
).split()

#: Elements that are junk by themselves.
PLAIN = "nav aside footer header form menu dialog search".split()

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


@dataclass
class Node:
    tag: str
    parent: int
    features: list[str]
    chars: int = 0
    linked: int = 0
    label: int = 0


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)  # node and text, in page order


def parse(source: str) -> Page:
    """The block tree of a page and its blocks of text; unclosed and stray tags are put up with."""
    page = Page([Node("#root", -1, ["tag=#root"])])
    open_: list[tuple[str, int]] = [("#root", 0)]  # tag, node of it or of the block it stands in
    places: dict[str, list[int]] = {}  # of each open tag, where it stands in ``open_``
    blocks: list[int] = [0]  # where open tags of blocks stand
    run: list[str] = []
    links = 0

    def flush() -> None:
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if text:
                node = open_[-1][1]
                page.blocks.append((node, text))
                page.nodes[node].chars += len(text)

    def begin(tag: str, node: int) -> None:
        places.setdefault(tag, []).append(len(open_))
        if tag not in INLINE:
            blocks.append(len(open_))
        open_.append((tag, node))

    def close(upto: int) -> None:
        nonlocal links
        if blocks[-1] >= upto:
            flush()
        while len(open_) > upto:
            tag, _ = open_.pop()
            places[tag].pop()
            links -= tag == "a"
        while blocks[-1] >= upto:
            blocks.pop()

    def last(tags: Iterable[str]) -> int:
        """Where the innermost of some open tags stands, 0 if none is open."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def text(part: str) -> None:
        run.append(part)
        if links:
            page.nodes[open_[-1][1]].linked += len(part.strip())

    at, n = 0, len(source)
    while at < n:
        m = TOKEN.search(source, at)
        if not m:
            text(source[at:])
            break
        if m.start() > at:
            text(source[at : m.start()])
        at = m.end()
        if not m.group(2):
            continue
        tag, end = m.group(2).lower(), bool(m.group(1))
        if end:
            found = last((tag,))
            if tag == "p" and not found:
                flush()
            if found and (tag not in INLINE or blocks[-1] < found):
                close(found)
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag in RAW:
            if not m.group(3).rstrip().endswith("/") or tag not in ("svg", "math"):
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                at = stop.end() if stop else n
            if tag not in ("script", "style", "template", "svg", "math", "noscript"):
                flush()
            continue
        if tag in INLINE:
            if tag not in VOID:
                begin(tag, open_[-1][1])
                links += tag == "a"
            continue
        if tag in CLOSES_P:
            found = last(("p",))
            if found > last(("table", "td", "th", "button", "object")):
                close(found)
        if tag in IMPLIED:
            ended, within = IMPLIED[tag]
            while last(ended) > last(within):
                close(last(ended))
                if tag != "tr" or open_[-1][0] not in ("tr", "td", "th"):
                    break
        flush()
        if tag in HEAD_ONLY and tag not in ("head", "html"):
            continue
        features = [f"tag={tag}"]
        for name, value in ATTRIBUTE.findall(m.group(3)):
            name = name.lower()
            value = value.strip("\"'")
            if name in ("class", "id", "role", "itemprop"):
                features += [f"word={w}" for w in set(WORD.findall(CAMEL.sub(" ", value).lower()))]
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "none" in value and "display" in value:
                features.append("word=hidden")
        if tag in VOID:
            continue
        page.nodes.append(Node(tag, open_[-1][1], features))
        begin(tag, len(page.nodes) - 1)
    flush()
    return page


def kind(node: Node) -> str:
    """What the node's tie to its parent depends on."""
    known = [f[5:] for f in node.features if f.startswith("word=")]
    if any(w in _OTHER for w in known):
        return "other-word"
    if any(w in _CONTENT for w in known):
        return "content-word"
    return node.tag


_OTHER, _CONTENT = frozenset(OTHER_WORDS), frozenset(CONTENT_WORDS)


def shape(node: Node) -> list[str]:
    """Features of a node's own text, beside those of its tag."""
    if not node.chars:
        return []
    share = min(node.linked / node.chars, 1.0)
    return [f"links={int(share * 4)}", f"chars={min(node.chars.bit_length(), 10)}"]


@dataclass
class Model:
    """Counts of labels by parent's label and kind, and of features by label."""

    ties: Counter = field(default_factory=Counter)
    seen: Counter = field(default_factory=Counter)
    labels: Counter = field(default_factory=Counter)

    def learn(self, page: Page, weight: float = 1.0) -> None:
        for node in page.nodes:
            above = page.nodes[node.parent].label if node.parent >= 0 else 0
            self.ties[above, kind(node), node.label] += weight
            self.ties[above, "*", node.label] += weight
            self.labels[node.label] += weight
            for f in (*node.features[1:], *shape(node)):
                self.seen[f, node.label] += weight

    def tie(self, above: int, what: str) -> tuple[float, ...]:
        """P(label | parent's label, kind), smoothed towards all kinds."""
        every = sum(self.ties[above, "*", y] for y in STATES)
        counts = [self.ties[above, what, y] for y in STATES]
        prior = [(self.ties[above, "*", y] + 0.5) / (every + 1.5) for y in STATES]
        return tuple((c + SMOOTH * q) / (sum(counts) + SMOOTH) for c, q in zip(counts, prior))

    def frozen(self) -> Frozen:
        ties = {what: tuple(self.tie(a, what) for a in STATES) for what in {k[1] for k in self.ties}}
        odds = {}
        for f in {k[0] for k in self.seen}:
            p = [(self.seen[f, y] + 0.5) / (self.labels[y] + 1) for y in STATES]
            odds[f] = tuple((x / max(p)) ** DAMPED.get(f.split("=")[0], 1.0) for x in p)
        return Frozen(ties, odds)


def scaled(a: float, b: float, c: float) -> tuple[float, float, float]:
    top = max(a, b, c)
    return max(a / top, 1e-30), max(b / top, 1e-30), max(c / top, 1e-30)


@dataclass
class Frozen:
    """A trained model: potentials of ties by kind and parent's label, and of features."""

    ties: dict[str, tuple[tuple[float, ...], ...]]
    odds: dict[str, tuple[float, ...]]

    def marginals(self, page: Page) -> list[float]:
        """P(content) of each node, by sum-product over the tree."""
        nodes, odds = page.nodes, self.odds
        n = len(nodes)
        belief = [(1.0, 1.0, 1.0)] * n
        tie = []
        for i, node in enumerate(nodes):
            a, b, c = 1.0, 1.0, 1.0
            for f in (*node.features[1:], *shape(node)):
                if o := odds.get(f):
                    a, b, c = a * o[0], b * o[1], c * o[2]
            belief[i] = scaled(a, b, c)
            tie.append(self.ties.get(kind(node)) or self.ties["*"])
        up = [(1.0, 1.0, 1.0)] * n  # message to the parent
        for i in range(n - 1, 0, -1):  # a parent stands before its children
            x, y, z = belief[i]
            up[i] = u = scaled(*[t[0] * x + t[1] * y + t[2] * z for t in tie[i]])
            p = nodes[i].parent
            v = belief[p]
            belief[p] = scaled(v[0] * u[0], v[1] * u[1], v[2] * u[2])
        belief[0] = (1.0, 1e-30, 1e-30)  # the root is neutral
        for i in range(1, n):
            v, u, t, b = belief[nodes[i].parent], up[i], tie[i], belief[i]
            x, y, z = scaled(v[0] / u[0], v[1] / u[1], v[2] / u[2])
            belief[i] = scaled(*[b[k] * (x * t[0][k] + y * t[1][k] + z * t[2][k]) for k in STATES])
        return [b[CONTENT] / sum(b) for b in belief]


def main_text(source: str, model: Frozen) -> str:
    page = parse(source)
    if len(page.nodes) == 1:  # no markup, all text
        return "\n\n".join(text for _, text in page.blocks)
    p = model.marginals(page)
    return "\n\n".join(text for node, text in page.blocks if p[node] > 0.5)


# -- training ------------------------------------------------------------------------------------


def generated_pages() -> Iterator[str]:
    """Pages with labelled blocks: content elements carry the attribute ``data-y``, roots of junk ``data-j``."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    prose = lambda n, seed: " ".join(words[(seed * 7 + i * i) % 10] for i in range(n)) + "."
    links = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in words[:6])
    body = lambda k: (f'<h1 data-y>{prose(8, k)}</h1><p data-y>{prose(60, k)}</p><h2 data-y>{prose(5, k + 1)}</h2><p data-y><b>{prose(12, k)}</b></p><ul data-y><li data-y>{prose(9, k)}</li><li data-y>{prose(4, k)}</li></ul><ol data-y><li data-y>{prose(7, k)}</li></ol><blockquote data-y><p data-y>{prose(20, k)}</p></blockquote><pre data-y>{prose(14, k)}</pre><table data-y><tbody data-y><tr data-y><th data-y>{words[1]}</th><td data-y>{words[0]}</td><td data-y>{prose(3, k)}</td></tr></tbody></table><figure data-y><figcaption data-y>{prose(6, k)}</figcaption></figure><dl data-y><dt data-y>{words[2]}</dt><dd data-y>{prose(6, k)}</dd></dl><section data-y><h3 data-y>{prose(3, k)}</h3><p data-y>{prose(2, k)}</p><div data-y>{prose(30, k)}</div></section>')
    shells = ['<article data-y>{}</article>', '<main data-y>{}</main>', '<main data-y><article data-y>{}</article></main>', '<article data-y><div data-y>{}</div></article>']
    shells += [f'<div class="{w}" data-y>{{}}</div>' for w in CONTENT_WORDS] + [f'<div id="{w}" data-y><div data-y>{{}}</div></div>' for w in CONTENT_WORDS]
    shells += ["{}", "<div data-y>{}</div>", "<div><div data-y>{}</div></div>"]
    shells += ['<div id="main-content" data-y>{}</div>', '<section class="post-content" data-y>{}</section>', '<div role="main" data-y>{}</div>', '<div class="article-body" data-y>{}</div>', '<td class="content" data-y>{}</td>']

    def junk(w: str, k: int, tag: str = "div", attr: str = "class") -> str:
        inner = (f"<ul>{links}</ul>", f"<p>{prose(6 + k % 20, k)}</p>", f"<h3>{words[k % 10]}</h3><p>{prose(25, k)}</p><ul><li>{prose(4, k)}</li></ul>", f"<form><label>{words[0]}</label><button>{words[1]}</button><fieldset><legend>{words[2]}</legend></fieldset></form><div>{prose(5, k)}</div>", prose(9, k), f"<div><p>{prose(40, k)}</p><section><p>{prose(12, k)}</p></section></div><table><tr><td>{words[3]}</td></tr></table><blockquote>{prose(5, k)}</blockquote>")
        name = f' {attr}="{w}"' if w else ""
        return f"<{tag}{name} data-j>{inner[k % len(inner)]}</{tag}>"

    k = 0
    for shell in shells:
        for within in (False, True):
            for _ in range(6):
                k += 1
                some = [junk(OTHER_WORDS[(k * 5 + i) % len(OTHER_WORDS)], k + i, ("div", "section", "div", "aside")[(k + i) % 4], ("class", "id")[i % 2]) for i in range(6)]
                bare = [junk("", k + i, PLAIN[(k + i) % len(PLAIN)]) for i in range(4)]
                inner = body(k)
                if within:
                    inner = bare[3] + some[4] + inner + some[5] + junk("", k, ("aside", "nav", "footer", "form", "header")[k % 5])
                yield "<html><body>" + shell.format(inner) + "</body></html>" if k % 6 == 0 else "<html><body>" + bare[0] + some[0] + some[1] + shell.format(inner) + some[2] + some[3] + bare[1] + bare[2] + "</body></html>"


MARKS_ARTICLE = "(?i)<(article|main)[ >]"
MARKED = re.compile(r"<([a-zA-Z][^\s/>]*)([^>]*)>")


def labelled(source: str) -> Page:
    """A generated page with its labels; what lies in junk is junk."""
    marks = [(m.group(1).lower(), CONTENT if "data-y" in m.group(2) else JUNK if "data-j" in m.group(2) else NEUTRAL) for m in MARKED.finditer(source)]
    marks = [(t, y) for t, y in marks if t not in INLINE and t not in VOID]
    page = parse(source)
    for node, (t, y) in zip(page.nodes[1:], marks, strict=True):
        if node.tag != t:
            raise ValueError(f"a generated page is read otherwise than meant at <{t}>")
        node.label = JUNK if page.nodes[node.parent].label == JUNK else y
    return page


def self_labelled(source: str) -> Page | None:
    """A page that marks its article: what lies in it, but for blocks named otherwise, is content."""
    page = parse(source)
    marked = [i for i, n in enumerate(page.nodes) if n.tag in ("article", "main")]
    if not marked:
        return None
    above = set()
    for i in marked:
        while i >= 0:
            i = page.nodes[i].parent
            above.add(i)
    for i, node in enumerate(page.nodes[1:], 1):
        parent = page.nodes[node.parent].label
        other = node.tag in PLAIN or kind(node) == "other-word"
        if node.tag in ("article", "main") or parent == CONTENT:
            node.label = JUNK if other else CONTENT
        else:
            node.label = NEUTRAL if i in above else JUNK
    return page


@functools.lru_cache(maxsize=1)
def generated_model() -> Model:
    model = Model()
    for source in generated_pages():
        model.learn(labelled(source))
    return model


def train(pages: Iterable[str]) -> Frozen:
    base = generated_model()
    model = Model(Counter(base.ties), Counter(base.seen), Counter(base.labels))
    for source in itertools.islice(pages, SAMPLE):
        page = self_labelled(source)
        if page:
            model.learn(page)
    return model.frozen()


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html_column: str = "html", sample: int = SAMPLE) -> DataFrame:
    """Key, url, ``text`` and ``n_chars`` (code points) of every page's main text.

    Character references are decoded, white space in a block becomes one space, blocks are joined in page
    order by an empty line.

    null html: as empty.  No content block: text ''.  Broken markup is read as browsers do, where that
    bears on blocks; a page cut off keeps what it has.  Very long pages are taken whole.  Repeated rows give a row
    each; null keys and urls are kept.  Other columns aren't read.  Empty table: empty result.
    """
    some = pages.where(F.col(html_column).rlike(MARKS_ARTICLE) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(html_column).alias("h"))
    # keys first, so that a task sends a few numbers and not a few pages to the driver
    keys = [r.k for r in some.select("k").orderBy(F.xxhash64("k"), "k").limit(sample).collect()]
    chosen = pages.where(F.col(key).isin(keys)).where(F.col(html_column).rlike(MARKS_ARTICLE)).select(F.col(key).alias("k"), F.col(html_column).alias("h"))
    model = train(r.h for r in chosen.groupBy("k").agg(F.min("h").alias("h")).orderBy("k").collect())
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}

    def run(batches):
        for part in slices(batches, "html"):
            texts = [main_text(h, model) for h in filled(part, "html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(key), part.column(url), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [key, url, "text", "n_chars"])

    return pages.select(key, url, F.col(html_column).alias("html")).mapInArrow(run, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars bigint")
