"""Main text of web pages: boosted trees over DOM nodes, decoded without contradictions.

A page becomes a tree of its block elements. Each node has features of its own and of its place: the
density of its subtree (text, links, tags), tokens of its tag, class, id and role and of its ancestors',
its depth, and how it compares with its siblings. Gradient-boosted trees give the probability that a
node holds main text. Decoding takes the most probable labels over the whole tree under one rule: below a
node that is not main, nothing is. A block of text counts if the node that it stands in does.

Learning: pages have no labels, so a bounded sample of pages (``sample_pages``, the first by a hash of their
id) labels itself by meaningful elements (article, main and the like against nav, footer, forms and so
on). Each sample page also comes in varied forms, with more boilerplate and renamed containers, and some
written pages join in, so that a model exists even for an empty sample. Spark trains the trees; their
splits, a few hundred numbers, travel to the tasks that read the pages.

Text rules: character references are decoded, white space inside a block becomes one space, blocks are
joined in page order by a blank line. A line break inside a block is white space. Scripts, styles, form
controls and the head have no text.

Defined cases: a null or empty page, or one without main text, gives an empty text. Markup may be broken
in any way: end tags without a start are skipped, open elements end with their parent. Repeated rows
are extracted each; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import pick, stage

SAMPLE_PAGES = 300
ROUNDS = 12
DEPTH = 4

BLOCKS = frozenset(
    "html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th section article main "
    "nav aside header footer form fieldset blockquote pre figure figcaption address details summary dialog center hgroup "
    "search menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Their content is text up to their end tag; none of it is shown as text of the page.
RAW = frozenset("script style textarea title noscript template iframe svg select object noembed noframes".split())
SILENT = frozenset("head button label option datalist audio video canvas".split())
ENDS_P = BLOCKS - {"html", "body"}
# An element of the key ends an open one of the values, up to the nearest element that holds them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
GROUPS = (
    {"p"}, HEADINGS, {"li", "dt", "dd"}, {"ul", "ol", "dl", "menu"}, {"div", "center"}, {"section"}, {"article", "main"},
    {"nav"}, {"aside"}, {"header"}, {"footer", "address"}, {"form", "fieldset", "search"},
    {"table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"}, {"blockquote", "pre", "figure", "figcaption"},
)
# Words of tags, classes, ids and roles that tell what an element is for.
GOOD = frozenset("article main content post entry story text body prose copy hentry articlebody maincontent".split())
BAD = frozenset(
    "nav navbar navigation menu header masthead banner footer foot bottom sidebar side aside rail widget notice cookie "
    "consent gdpr alert popup modal overlay newsletter subscribe signup login ad ads advert advertisement advertising "
    "sponsor sponsored promo promotion form search breadcrumb breadcrumbs pager pagination share sharing social comment "
    "comments commentlist reply replies respond discussion disqus feedback related recommended recommend copyright legal "
    "disclaimer toolbar tags tagcloud hidden contentinfo complementary skip toc".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-label|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    words: frozenset = frozenset()
    blocks: list = field(default_factory=list)  # places in the page's list of blocks
    children: list = field(default_factory=list)
    chars: int = 0
    linked: int = 0
    tags: int = 0
    controls: int = 0
    stops: int = 0
    paragraphs: int = 0


class Page:
    """Block elements of a page in order, and its blocks of text with the node that each stands in."""

    def __init__(self, source: str):
        self.nodes = [Node("html", -1, 0)]
        self.texts: list[tuple[int, str]] = []
        self.open: list[tuple[str, int]] = [("html", 0)]  # name and the node it stands in
        self.run: list[str] = []
        self.run_linked = self.silent = self.links = 0
        at, lowered = 0, None
        for m in TOKEN.finditer(source):
            if m.start() < at:
                continue
            if m.start() > at:
                self._text(source[at:m.start()])
            at = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if m[1]:
                self._end(name)
            elif name in RAW:
                self.nodes[self.open[-1][1]].controls += name in ("select", "textarea")
                lowered = source.lower() if lowered is None else lowered
                stop = lowered.find("</" + name, at)
                if stop < 0:
                    at = len(source)
                    break
                at = source.find(">", stop) + 1 or len(source)
            else:
                self._start(name, m[3])
        if at < len(source):
            self._text(source[at:])
        self._flush()
        self._sum()

    def _text(self, piece: str) -> None:
        if not self.silent:
            self.run.append(piece)
            if self.links:
                self.run_linked += len(piece)

    def _flush(self) -> None:
        if self.run:
            joined = "".join(self.run)
            text = " ".join((html.unescape(joined) if "&" in joined else joined).split())
            if text:
                node = self.nodes[self.open[-1][1]]
                node.blocks.append(len(self.texts))
                node.chars += len(text)
                node.linked += min(self.run_linked, len(text))
                node.stops += text.count(". ") + text.count(", ") + (text[-1] in ".!?")
                self.texts.append((self.open[-1][1], text))
            self.run, self.run_linked = [], 0

    def _start(self, name: str, attributes: str) -> None:
        node = self.open[-1][1]
        if name in VOID:
            self.nodes[node].tags += 1
            if name == "br" or name == "hr":
                if name == "hr":
                    self._flush()
                else:
                    self._text(" ")
            elif name == "input":
                self.nodes[node].controls += 1
            return
        if name in ("html", "body") and any(o == name for o, _ in self.open):
            return
        if name in BLOCKS:
            self._flush()
            if name in ENDS_P:
                self._pop({"p"}, {"table", "td", "th", "button", "li", "div", "section", "article", "blockquote"})
            if name in ENDS:
                self._pop(*ENDS[name])
            node = self.open[-1][1]
            parent = self.nodes[node]
            parent.children.append(len(self.nodes))
            self.nodes.append(Node(name, node, parent.depth + 1, _words(name, attributes), tags=1))
            node = len(self.nodes) - 1
        else:
            self.nodes[node].tags += 1
            self.nodes[node].controls += name in ("button", "label")
            self.links += name == "a"
            self.silent += name in SILENT
        self.open.append((name, node))

    def _pop(self, names: set, until: set) -> None:
        """Ends the nearest open element of these names, if no element of ``until`` is nearer."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] in names:
                self._cut(i)
                return
            if self.open[i][0] in until:
                return

    def _end(self, name: str) -> None:
        if name in ("html", "body"):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == name:
                if name in BLOCKS or any(o in BLOCKS for o, _ in self.open[i:]):
                    if name not in BLOCKS:  # an inline end tag does not end the blocks inside it
                        self.links -= name == "a"
                        self.silent -= name in SILENT
                        del self.open[i]
                        return
                    self._flush()
                self._cut(i)
                return

    def _cut(self, i: int) -> None:
        if any(o in BLOCKS for o, _ in self.open[i:]):
            self._flush()
        for name, _ in self.open[i:]:
            self.links -= name == "a"
            self.silent -= name in SILENT
        del self.open[i:]

    def _sum(self) -> None:
        """Adds each subtree up; children stand after their parents."""
        for node in reversed(self.nodes):
            node.paragraphs += node.chars if node.tag == "p" else 0
            if node.parent >= 0:
                up = self.nodes[node.parent]
                for name in ("chars", "linked", "tags", "controls", "stops", "paragraphs"):
                    setattr(up, name, getattr(up, name) + getattr(node, name))


def _words(tag: str, attributes: str) -> frozenset:
    words = {tag}
    if "=" in attributes or "hidden" in attributes:
        for name, value in ATTRIBUTE.findall(attributes):
            name = name.lower()
            if name == "hidden" or (name == "aria-hidden" and "true" in value) or (
                    name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                words.add("hidden")
            elif name not in ("style", "aria-hidden"):
                words.update(WORD.findall(CAMEL.sub(" ", value).lower()))
    return frozenset(words)


FEATURES = 16 + len(GROUPS)


def features(page: Page) -> np.ndarray:
    """A row for each node."""
    out = np.zeros((len(page.nodes), FEATURES))
    total = max(1, page.nodes[0].chars)
    good, bad = [0] * len(page.nodes), [0] * len(page.nodes)  # among a node and its ancestors
    place = [0] * len(page.nodes)  # among a node's siblings
    for node in page.nodes:
        for nth, child in enumerate(node.children):
            place[child] = nth
    for i, node in enumerate(page.nodes):
        own_good, own_bad = len(node.words & GOOD), len(node.words & BAD)
        if node.tag in ("body", "html"):
            own_good = own_bad = 0
        up = node.parent
        above_good, above_bad = (good[up], bad[up]) if up >= 0 else (0, 0)
        good[i], bad[i] = above_good + own_good, above_bad + own_bad
        siblings = page.nodes[up].children if up >= 0 else [0]
        of_siblings = max(1, page.nodes[up].chars) if up >= 0 else total
        chars = max(1, node.chars)
        out[i, :16] = (
            np.log1p(node.chars), node.linked / chars, node.tags / chars, node.depth, node.chars / total,
            node.chars / of_siblings, len(siblings), place[i] / len(siblings),
            node.stops / chars, node.paragraphs / chars, node.controls, own_good, own_bad, above_good, above_bad,
            len(node.children),
        )
        for g, group in enumerate(GROUPS):
            if node.tag in group:
                out[i, 16 + g] = 1
                break
    return out


def weak_labels(page: Page) -> np.ndarray | None:
    """1 for nodes that hold main text, as told by meaningful elements; None if a page does not tell."""
    inside, held = np.zeros(len(page.nodes), bool), np.zeros(len(page.nodes), bool)
    for i, node in enumerate(page.nodes):
        if node.tag in ("html", "body"):
            continue
        above = inside[node.parent]
        marked = node.tag in ("article", "main") or bool(node.words & GOOD)
        inside[i] = (above or marked) and not (node.words & BAD - {node.tag} | ({node.tag} & BAD - {"header"}) | (
            {node.tag} & {"header"} if not above else set()))
        held[i] = inside[i] and node.chars > 0
    if not held.any():
        return None
    for i in range(len(page.nodes) - 1, 0, -1):
        held[page.nodes[i].parent] |= held[i]
    return held.astype(float)


@dataclass(frozen=True)
class Tree:
    """A regression tree as arrays; a leaf has itself as both children."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray


@dataclass(frozen=True)
class Model:
    trees: tuple[Tree, ...]
    weights: tuple[float, ...]

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for tree, weight in zip(self.trees, self.weights, strict=True):
            at = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH + 1):
                goes_left = rows[np.arange(len(rows)), tree.feature[at]] <= tree.threshold[at]
                at = np.where(goes_left, tree.left[at], tree.right[at])
            total += weight * tree.value[at]
        return 2 * total


def decode(page: Page, log_odds: np.ndarray) -> np.ndarray:
    """The most probable labels with nothing main below a node that is not. A node's weight is its text's,
    so that a wrapper with little of its own does not outvote what is in it."""
    logs = np.logaddexp(0, -log_odds), np.logaddexp(0, log_odds)  # costs of calling a node main, and not main
    n = len(page.nodes)
    yes, no = logs[0].copy(), logs[1].copy()
    for i in range(n - 1, 0, -1):
        up = page.nodes[i].parent
        yes[up] += min(yes[i], no[i])
        no[up] += no[i]
    main = np.zeros(n, bool)
    main[0] = yes[0] < no[0]
    for i in range(1, n):
        main[i] = main[page.nodes[i].parent] and yes[i] < no[i]
    return main


def varied(source: str, spare: str, chance: random.Random) -> str:
    """A page with more boilerplate, and containers under other names."""
    def block(words: str) -> str:
        name = chance.choice(words.split())
        tag = name if name in BLOCKS else chance.choice(("div", "section", "aside", "ul"))
        attribute = "" if tag == name else f' {chance.choice(("class", "id"))}="{name}{chance.choice(("", "-box", " wide"))}"'
        text = " ".join(chance.sample(spare.split() or ["word"], k=min(len(spare.split()) or 1, chance.randint(3, 60))))
        inner = chance.choice((f"<p>{text}</p>", f"<ul><li><a href='#'>{text}</a></li></ul>", text,
                               f"<h3>{text[:20]}</h3><p>{text}</p><p>{text[::-1]}</p>"))
        if "form" in name or "login" in name or "search" in name or "subscribe" in name:
            inner += "<label>Name</label><input name=q><button>Go</button>"
        return f"<{tag}{attribute}>{inner}</{tag}>"

    before = "".join(block("header nav menu banner cookie notice ad breadcrumb") for _ in range(chance.randint(0, 3)))
    inside = "".join(block("ad share newsletter related promo") for _ in range(chance.randint(0, 2)))
    after = "".join(block("sidebar aside comments comment related footer form login subscribe") for _ in range(chance.randint(0, 4)))
    if inside and "</p>" in source:
        cut = source.rfind("</p>", 0, max(5, int(len(source) * chance.random()))) + 4
        source = source[:cut] + inside + source[cut:] if cut > 3 else source
    source = re.sub(r"(<body[^>]*>)", lambda m: m[1] + before, source, count=1)
    source = source.replace("</article>", "</article>" + after, 1)
    name = chance.choice(("article", "main", 'div class="content"', 'div id="main"', 'div class="post"', 'section class="entry"'))
    return source.replace("<article>", f"<{name}>", 1).replace("</article>", f"</{name.split()[0]}>", 1)


def written_page(chance: random.Random) -> str:
    """A page for lessons, when there are few others."""
    words = [chr(97 + i % 26) * (1 + i % 7) for i in range(200)]

    def sentence(n: int) -> str:
        return " ".join(chance.choices(words, k=n)).capitalize() + "."

    body = "".join(f"<p>{sentence(chance.randint(4, 60))}</p>" for _ in range(chance.randint(1, 12)))
    links = "".join(f'<li><a href="/{i}">{chance.choice(words)}</a></li>' for i in range(chance.randint(2, 8)))
    return (f"<html><head><title>{sentence(4)}</title></head><body><nav><ul>{links}</ul></nav><article><h1>{sentence(5)}</h1>"
            f"{body}</article><footer>&copy; {sentence(6)}</footer></body></html>")


def lessons(pages: DataFrame, sample_pages: int, seed: int = 7) -> DataFrame:
    """Features and labels of the nodes of the sample, each page as it is and in two varied forms."""
    rows = pick(pages, html="html", id="id").where("html IS NOT NULL").select("html", F.xxhash64("id").alias("draw"))
    # The ids alone are sorted; only the pages that are drawn travel with their html.
    last = rows.select("draw").orderBy("draw").limit(sample_pages).agg(F.max("draw").alias("last")).head()["last"]
    rows = rows.where(F.col("draw") <= (last if last is not None else 0)).limit(sample_pages).select("html")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chance = random.Random(seed)
        sources = [h for b in batches for h in b.column(0).to_pylist()]
        sources = sources + [written_page(chance) for _ in range(40)]
        found = []
        for i, source in enumerate(sources):
            spare = re.sub(r"<[^>]*>", " ", sources[i - 1])[:3000]
            for form in (source, varied(source, spare, chance), varied(source, spare, chance)):
                page = Page(form)
                if (labels := weak_labels(page)) is not None:
                    found.append((features(page), labels))
        x, y = np.concatenate([f for f, _ in found]), np.concatenate([lab for _, lab in found])
        yield pa.RecordBatch.from_arrays([
            pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), FEATURES).cast(pa.list_(pa.float64())), pa.array(y),
        ], names=["x", "label"])

    # The sample is a few hundred pages at most: one task.
    return rows.coalesce(1).mapInArrow(label, "x array<double>, label double")


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, rounds: int = ROUNDS) -> Model:
    """``pages``: id, html."""
    rows = stage(lessons(pages, sample_pages), "lessons").select(array_to_vector("x").alias("features"), "label")
    if rows.isEmpty():  # no page, nothing to learn and nothing to read
        return Model((), ())
    # Labels tell by elements and classes alone: each tree sees but some features, so that text counts too.
    model = GBTClassifier(
        maxIter=rounds, maxDepth=DEPTH, stepSize=0.3, seed=1, featureSubsetStrategy="0.6", minInstancesPerNode=10,
    ).fit(rows.coalesce(1))
    return Model(tuple(_tree(t._java_obj if hasattr(t, "_java_obj") else t) for t in model.trees), tuple(model.treeWeights))


def _tree(java_tree) -> Tree:
    rows: list[list] = []

    def walk(node) -> int:
        at = len(rows)
        rows.append([0, 0.0, at, at, node.prediction()])
        if "InternalNode" in node.getClass().getSimpleName():
            split = node.split()
            rows[at][:2] = split.featureIndex(), split.threshold()
            rows[at][2:4] = walk(node.leftChild()), walk(node.rightChild())
        return at

    walk(getattr(java_tree, "rootNode")())
    columns = list(zip(*rows, strict=True))
    return Tree(*(np.array(c) for c in columns))


def main_text(source: str, model: Model) -> str:
    page = Page(source)
    main = decode(page, model.log_odds(features(page)))
    return "\n\n".join(text for node, text in page.texts if main[node])


def extract(
    pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    sample_pages: int = SAMPLE_PAGES,
) -> DataFrame:
    """Per row: id, url, text, n_chars."""
    rows = pick(pages, id=id_col, url=url_col, html=html_col)
    own = train(rows.select("id", "html"), sample_pages) if model is None else model
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, own) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["id", "url", "text", "n_chars"])

    out = rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars bigint")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
