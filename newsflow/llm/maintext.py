"""Main text of web pages by gradient-boosted trees over DOM nodes and hierarchical decoding.

A page is parsed into a tree of elements (tags that close themselves, that imply the end of others, or that are never
closed are handled as browsers do).  Every element gets features: tag and attribute tokens (its own
and its ancestors'), depth, density of text, links and words in its subtree, and how it stands among its siblings.
Trees boosted on the logistic loss (``pyspark.ml``) give each element the log odds that its subtree is main text.  Decoding
works from the leaves up: the best gain of a subtree is either that of keeping it whole with the best choices for the
nodes in it, or that of dropping it whole, in which case nothing below it can be kept; so no kept
node stands in a dropped one.

The model is trained on pages built from a seeded grammar of layouts, in which the parts are known.  Its size is a
documented parameter and does not depend on the pages that are read.

Text: character references are decoded, white space in a block becomes one space, blocks are trimmed and
joined by an empty line.  Defined results: null or empty html gives an empty text; a page without
an element gives its plain text; text outside any part that is dropped is kept; equal rows give equal results; further
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.llm import arrow

#: Pages the model is trained on, trees and their depth.
TRAINING_PAGES, TREES, DEPTH = 500, 16, 5

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("script style title head noscript template iframe noembed noframes svg math object audio video canvas select option textarea button".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag closes these open ones, up to the nearest of the elements that bound it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tbody", "tfoot", "thead", "tr", "td", "th"}, {"table"}), "tbody": ({"tbody", "tfoot", "thead", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "tfoot", "thead", "tr", "td", "th"}, {"table"}),
}
#: Names of parts in class, id and role attributes, by what they speak for.
NAMES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc skip",
    "edge": "header masthead banner footer foot bottom top copyright",
    "side": "sidebar aside side rail widget related recommended more popular trending tags",
    "notice": "cookie consent notice alert popup modal gdpr privacy warning newsletter subscribe signup promo",
    "advert": "ad ads advert advertisement sponsor sponsored promoted banner",
    "share": "share social follow toolbar tools meta byline",
    "reader": "comment comments reply replies discussion respond disqus feedback",
    "form": "form search login signin register",
    "main": "article content main post entry story body text prose",
}
_NAME_OF = {word: kind for kind, words in NAMES.items() for word in words.split()}
KINDS = list(NAMES)
TAGS = "nav header footer aside form article main section div p ul ol li table h1 h2 h3 a span figure blockquote pre dl button script style".split()

_TAG = re.compile(r"<(?:!--.*?(?:-->|$)|!\[CDATA\[.*?(?:\]\]>|$)|[!?][^>]*(?:>|$)|/([a-zA-Z][^\s/>]*)[^>]*(?:>|$)|([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$))", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"[ \t\n\r\f\v   -     　\u0085]+")


@dataclass
class Page:
    """The elements of a page that are judged (units): blocks, hidden ones and those with a telling name, in page order.

    Other elements belong to the unit around them.  Unit 0 stands for the page.
    """

    parent: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: ["#page"])
    depth: list[int] = field(default_factory=lambda: [0])
    order: list[int] = field(default_factory=lambda: [0])
    children: list[int] = field(default_factory=lambda: [0])
    #: bits of the own and of the ancestors' names and tags
    names: list[int] = field(default_factory=lambda: [0])
    above_names: list[int] = field(default_factory=lambda: [0])
    tags: list[int] = field(default_factory=lambda: [0])
    above_tags: list[int] = field(default_factory=lambda: [0])
    hidden: list[bool] = field(default_factory=lambda: [False])
    anchors: list[int] = field(default_factory=lambda: [0])
    elements: list[int] = field(default_factory=lambda: [1])
    #: own text: characters, words, sentence ends, characters in links
    own: list[list[int]] = field(default_factory=lambda: [[0, 0, 0, 0]])
    #: (unit, text), or (unit, None) for a line break
    runs: list[tuple[int, str | None]] = field(default_factory=list)


_TAG_BIT = {tag: 1 << k for k, tag in enumerate(TAGS)}
_NAME_BIT = {word: 1 << KINDS.index(kind) for word, kind in _NAME_OF.items()}
_LABELLING = frozenset(("class", "id", "role", "aria-label", "itemprop"))


def _attributes(raw: str) -> tuple[int, bool]:
    """Name bits of the attributes, and whether they hide the element."""
    names, hidden = 0, False
    for match in _ATTRIBUTE.finditer(raw):
        name, value = match[1].lower(), (match[2] or "").strip("\"'")
        if name in _LABELLING:
            for token in _TOKEN.findall(value):
                names |= _NAME_BIT.get(token.lower(), 0)
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
    return names, hidden


class _Builder:
    """Open elements while a page is read: their tags, units and whether they stand in a link."""

    def __init__(self) -> None:
        self.page = Page()
        self.tags, self.units, self.linked = ["#page"], [0], [False]

    def text(self, value: str) -> None:
        if not value:
            return
        page, unit = self.page, self.units[-1]
        if page.hidden[unit]:
            return
        if "&" in value:
            value = html.unescape(value)
        page.runs.append((unit, value))
        size = len(value.strip())
        if size:
            own = page.own[unit]
            own[0] += size
            own[1] += value.count(" ") + 1
            own[2] += value.count(". ") + value.rstrip().endswith((".", "!", "?"))
            own[3] += size * self.linked[-1]

    def line_break(self) -> None:
        self.page.runs.append((self.units[-1], None))

    def close(self, depth: int) -> None:
        del self.tags[depth:], self.units[depth:], self.linked[depth:]

    def end(self, name: str) -> None:
        tags = self.tags
        for depth in range(len(tags) - 1, 0, -1):
            if tags[depth] == name:
                self.close(depth)
                return
            if name not in BLOCKS and tags[depth] in BLOCKS and tags[depth] not in ("p", "div", "li"):
                return

    def imply_ends(self, name: str) -> None:
        """What the start of a block ends: an open paragraph, a list item before it, and so on."""
        tags = self.tags
        if name in BLOCKS and name not in ("body", "html"):
            for depth in range(len(tags) - 1, 0, -1):
                if tags[depth] == "p":
                    self.close(depth)
                    break
                if tags[depth] in BLOCKS:
                    break
        if name in CLOSES:
            closed, bounds = CLOSES[name]
            for depth in range(len(tags) - 1, 0, -1):
                if tags[depth] in bounds:
                    break
                if tags[depth] in closed:
                    self.close(depth)
                    if name not in ("tr", "thead", "tbody", "tfoot"):
                        break
        if name == "body":
            while len(tags) > 1 and tags[-1] != "html":
                self.close(len(tags) - 1)

    def start(self, name: str, raw: str, stays: bool) -> None:
        page, around = self.page, self.units[-1]
        names, hides = _attributes(raw) if "=" in raw or "hidden" in raw else (0, False)
        hides = hides or name in HIDDEN
        unit = around
        if name in BLOCKS or names or hides:
            unit = len(page.tag)
            page.parent.append(around)
            page.tag.append(name)
            page.depth.append(page.depth[around] + 1)
            page.order.append(page.children[around])
            page.children[around] += 1
            page.children.append(0)
            page.names.append(names)
            page.above_names.append(page.above_names[around] | page.names[around])
            page.tags.append(_TAG_BIT.get(name, 0))
            page.above_tags.append(page.above_tags[around] | page.tags[around])
            page.hidden.append(hides or page.hidden[around])
            page.anchors.append(0)
            page.elements.append(1)
            page.own.append([0, 0, 0, 0])
        else:
            page.elements[unit] += 1
        page.anchors[unit] += name == "a"
        if stays:
            self.tags.append(name)
            self.units.append(unit)
            self.linked.append(self.linked[-1] or name == "a")


def parse(source: str) -> Page:
    """The units of a page.  Never fails: what is not a tag is text."""
    build, at, lower = _Builder(), 0, None
    while True:
        low = source.find("<", at)
        if low < 0:
            build.text(source[at:])
            return build.page
        match = _TAG.match(source, low)
        if match is None:
            after = source.find("<", low + 1)
            build.text(source[at : after if after >= 0 else len(source)])
            if after < 0:
                return build.page
            at = after
            continue
        build.text(source[at:low])
        at = match.end()
        name = (match[1] or match[2] or "").lower()
        if name == "br":
            build.line_break()
        elif match[1]:
            build.end(name)
        elif name:
            raw = match[3]
            build.imply_ends(name)
            open_ended = name not in VOID and not (raw.endswith("/") and name not in BLOCKS)
            if name in RAW and open_ended:
                build.start(name, raw, False)
                lower = lower if lower is not None else source.lower()
                end = lower.find(f"</{name}", at)
                close = source.find(">", end) if end >= 0 else -1
                at = len(source) if close < 0 else close + 1
            else:
                build.start(name, raw, open_ended)


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """One row per unit of all pages, and the pages' offsets in the rows."""
    sizes = np.array([len(p.tag) for p in pages])
    cuts = np.concatenate([[0], np.cumsum(sizes)])

    def flat(name: str) -> np.ndarray:
        return np.array([v for p in pages for v in getattr(p, name)])

    parent = flat("parent") + np.repeat(cuts[:-1], sizes)
    depth, order, children = flat("depth"), flat("order"), flat("children")
    own = flat("own").reshape(-1, 4).astype(np.float64)
    is_p = np.array([t == "p" for p in pages for t in p.tag], dtype=np.float64)
    total = np.column_stack([own, flat("elements"), flat("anchors"), is_p]).astype(np.float64)
    for level in range(int(depth.max(initial=0)), 0, -1):
        here = np.flatnonzero(depth == level)
        np.add.at(total, parent[here], total[here])
    chars, words, ends, in_links, elements, anchors, paragraphs = total.T
    whole = np.repeat(np.maximum(1, chars[cuts[:-1]]), sizes)
    siblings = np.maximum(0, children[parent] - 1)
    shape = np.column_stack(
        [
            depth, np.log1p(chars), np.log1p(words), chars / elements, in_links / np.maximum(1, chars), ends / np.maximum(1, words / 15), chars / whole,
            np.log1p(elements), np.log1p(anchors), np.log1p(paragraphs), children, siblings, order / np.maximum(1, siblings),
            chars / np.maximum(1, chars[parent]), own[:, 0] / np.maximum(1, chars), words / np.maximum(1, anchors),
        ]
    )
    bits = lambda name, n: (flat(name)[:, None] >> np.arange(n)) & 1
    k, t = len(KINDS), len(TAGS)
    return np.column_stack([shape, bits("names", k), bits("above_names", k), bits("tags", t), bits("above_tags", t)]), cuts


# --- training pages -------------------------------------------------------------------------

_SYLLABLES = "ka lo mi ren tas vo del pra shu in er ou al ten sor bi".split()


def _words(rng: np.random.Generator, n: int) -> str:
    return " ".join("".join(rng.choice(_SYLLABLES, rng.integers(1, 4))) for _ in range(n))


def _sentences(rng: np.random.Generator, n: int) -> str:
    return " ".join(_words(rng, int(rng.integers(3, 18))).capitalize() + rng.choice([".", ".", ".", "?", "!"]) for _ in range(n))


def _named(rng: np.random.Generator, tag: str, kind: str, inner: str) -> str:
    """A part under its own tag or a div, with or without a telling class, unless only the class tells it."""
    word = rng.choice(NAMES[kind].split())
    style = rng.integers(4)
    label = "" if style == 0 and tag != "div" else f' {rng.choice(["class", "id"])}="{word if style < 3 else "page-" + word}"'
    return f"<{tag}{label}>{inner}</{tag}>"


def _part(rng: np.random.Generator, kind: str) -> str:
    links = lambda n: "".join(f'<li><a href="/x">{_words(rng, int(rng.integers(1, 4)))}</a></li>' for _ in range(n))
    prose = lambda a, b: _sentences(rng, int(rng.integers(a, b)))
    wrap = lambda body: body if rng.random() < 0.4 else f"<p>{body}</p>"
    count = int(rng.integers(2, 9))
    if kind == "menu":
        return _named(rng, rng.choice(["nav", "nav", "div", "ul"]), kind, f"<ul>{links(count)}</ul>")
    if kind == "head":
        return _named(rng, rng.choice(["header", "header", "div"]), "edge", rng.choice([f"<h2>{_words(rng, 3)}</h2>", wrap(_words(rng, 5)), f"<ul>{links(3)}</ul>"]))
    if kind == "foot":
        return _named(rng, rng.choice(["footer", "footer", "div"]), "edge", wrap("&copy; " + _words(rng, 2) + " &middot; " + prose(1, 3)))
    if kind == "side":
        return _named(rng, rng.choice(["aside", "aside", "div"]), kind, f"<h3>{_words(rng, 2)}</h3>" + rng.choice([f"<ul>{links(count)}</ul>", wrap(prose(1, 5))]))
    if kind == "form":
        return _named(rng, "form", kind, f"<label>{_words(rng, 2)}</label><input name=q>" + wrap(_words(rng, 4)) + f"<button>{_words(rng, 1)}</button>")
    if kind == "reader":
        one = lambda: rng.choice(["<div>{}</div>", "<li>{}</li>", "<p>{}</p>", "<article>{}</article>"]).format(wrap(prose(1, 5)))
        return _named(rng, rng.choice(["section", "div", "div", "ol"]), kind, f"<h3>{_words(rng, 1)}</h3>" + "".join(one() for _ in range(count)))
    return _named(rng, rng.choice(["div", "div", "section", "aside"] if kind != "share" else ["div", "div", "ul"]), kind, wrap(prose(1, 5)))


_CUT = re.compile(" data-cut")


def training_page(seed: int) -> str:
    """A page whose unwanted parts bear the attribute ``data-cut`` at their top."""
    rng = np.random.default_rng(seed)

    def unwanted(kind: str) -> str:
        return re.sub(r"^<(\w+)", r"<\1 data-cut", _part(rng, kind))

    extra = "menu side notice advert share form".split()
    body = [f"<h1>{_words(rng, int(rng.integers(3, 9)))}</h1>"]
    short = rng.random() < 0.2
    for _ in range(int(rng.integers(1, 3 if short else 12))):
        prose = _sentences(rng, int(rng.integers(1, 3 if short else 9)))
        form = rng.integers(14)
        body.append(
            f"<h2>{_words(rng, 3)}</h2>" if form == 0 else f"<ul>{''.join(f'<li>{_sentences(rng, 1)}</li>' for _ in range(3))}</ul>" if form == 1
            else f"<blockquote>{prose}</blockquote>" if form == 2 else f"<p>{prose} <a href='/y'>{_words(rng, 2)}</a> {_words(rng, 4)}.</p>" if form == 3
            else f"<p><b>{prose}<br>" if form == 4 else f"<div>{prose}</div>" if form == 5 else f"<table><tr><td>{_words(rng, 2)}</td><td>{_words(rng, 3)}</td></tr></table>" if form == 6
            else f"<section><h3>{_words(rng, 2)}</h3><p>{prose}</p></section>" if form == 7 else f"<p>{prose}</p>"
        )
        if rng.random() < 0.12:
            body.append(unwanted(str(rng.choice(extra))))
    shell = rng.choice(['<article>{}</article>', '<main>{}</main>', '<div class="content">{}</div>', '<main><article class="post">{}</article></main>', '<div id="main">{}</div>', "<div>{}</div>", "{}"])
    before = [unwanted(k) for k in rng.permutation(["menu", "head", *extra]).tolist() if rng.random() < 0.35]
    after = [unwanted(k) for k in rng.permutation(["foot", "reader", *extra]).tolist() if rng.random() < 0.35]
    inner = shell.format("".join(body) + (unwanted("reader") if rng.random() < 0.15 else ""))
    content = "".join(before) + inner + "".join(after)
    if rng.random() < 0.3:
        content = f'<div class="{rng.choice(["page", "wrapper", "container"])}">{content}</div>'
    return f"<html><head><title>{_words(rng, 3)}</title></head><body>{content}</body></html>"


def labelled(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: main text) of the units with text of a training page."""
    source = training_page(seed)
    page, marked = parse(_CUT.sub("", source)), parse(_CUT.sub(" hidden", source))
    rows, _ = features([page])
    plain = {k: v for k, v in enumerate(page.hidden)}
    # marking hides whole parts; a part whose tag is no block is a unit in the marked page only, so texts are matched in order
    wanted = [t for _, t in marked.runs if t is not None]
    good, bad, k = np.zeros(len(page.tag)), np.zeros(len(page.tag)), 0
    for unit, value in page.runs:
        if value is None or plain[unit]:
            continue
        if k < len(wanted) and wanted[k] == value:
            good[unit] += len(value.strip())
            k += 1
        else:
            bad[unit] += len(value.strip())
    for unit in range(len(page.tag) - 1, 0, -1):
        good[page.parent[unit]] += good[unit]
        bad[page.parent[unit]] += bad[unit]
    share = good / np.maximum(1, good + bad)
    use = (good + bad > 0) & ((share > 0.8) | (share == 0))  # shells around both kinds of text have no label
    return rows[use], (share[use] > 0.8).astype(np.float64)


@dataclass(frozen=True)
class Trees:
    """Boosted trees as arrays: feature (-1 for a leaf), threshold, left and right child, value; and tree weights."""

    nodes: list[tuple[np.ndarray, ...]]
    weights: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for (feature, threshold, left, right, value), weight in zip(self.nodes, self.weights):
            at = np.zeros(len(rows), dtype=np.int64)
            for _ in range(DEPTH):
                inner = feature[at] >= 0
                goes_left = rows[np.arange(len(rows)), np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
            total += weight * value[at]
        return total


def train(spark: SparkSession, pages: int = TRAINING_PAGES, first_seed: int = 1) -> Trees:
    """Fit boosted trees on the elements of training pages made in the tasks."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [labelled(seed) for seed in batch.column("id").to_pylist()]
            rows = np.concatenate([r for r, _ in parts])
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(rows), pa.list_(pa.float64())), pa.array(np.concatenate([y for _, y in parts]))], ["row", "label"]
            )

    seeds = spark.range(first_seed, first_seed + pages, numPartitions=4)
    rows = seeds.mapInArrow(run, "row array<double>, label double").select(array_to_vector("row").alias("features"), "label")
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=3, maxBins=32).fit(rows)
    trees = []
    for tree in model.trees:
        feature, threshold, left, right, value = [], [], [], [], []

        def walk(node) -> int:
            place = len(feature)
            for column in (feature, threshold, left, right, value):
                column.append(0)
            value[place] = node.prediction()
            feature[place] = -1
            if node.subtreeDepth() > 0:
                feature[place], threshold[place] = node.split().featureIndex(), node.split().threshold()
                left[place], right[place] = walk(node.leftChild()), walk(node.rightChild())
            return place

        walk(tree._call_java("rootNode"))
        trees.append(tuple(np.array(c) for c in (feature, threshold, left, right, value)))
    return Trees(trees, np.array(model.treeWeights))


#: What share of its parent's evidence a unit inherits, for and against, and the most it can inherit.
INHERITED_FOR, INHERITED_AGAINST, INHERITED_MOST = 0.25, 0.25, 1.5
#: Weight of a unit's own evidence against all text below it.
WHOLE = 0.5


def decode(page: Page, score: np.ndarray) -> list[bool]:
    """Marks the units whose own text is kept, by the best total gain over the tree.

    From the top, a unit's evidence is its score and a share of its parent's.  Then, from the leaves up, a unit's own
    text gains its length times its evidence if it is kept, evidence against a unit counts against all text below it,
    and a subtree is dropped whole where that gains more than the best choices inside it; below a dropped unit
    nothing is kept.
    """
    n = len(page.tag)
    evidence = score.tolist()
    evidence[0] = 0.0
    for k in range(1, n):
        above = evidence[page.parent[k]]
        share = INHERITED_FOR if above > 0 else INHERITED_AGAINST
        evidence[k] += share * max(-INHERITED_MOST, min(INHERITED_MOST, above))
    best = [own[0] * max(-3.0, min(3.0, e)) for own, e in zip(page.own, evidence)]
    best[0] = max(best[0], 0.0)
    kept, below = [True] * n, [own[0] for own in page.own]
    for k in range(n - 1, 0, -1):
        below[page.parent[k]] += below[k]
        best[k] += WHOLE * (below[k] - page.own[k][0]) * min(0.0, evidence[k])
        kept[k] = best[k] > 0 and not page.hidden[k]
        if kept[k]:
            best[page.parent[k]] += best[k]
    if best[0] <= 0 and not page.own[0][0]:  # no part stands out: the best one that has text
        seen = [k for k in range(1, n) if page.own[k][0] and not page.hidden[k]]
        top = max(seen, key=lambda k: evidence[k], default=0)
        while top:
            kept[top] = True
            top = page.parent[top]
    for k in range(1, n):
        kept[k] = kept[k] and kept[page.parent[k]]
    return kept


def blocks(page: Page, kept: list[bool]) -> list[str]:
    """Texts of the kept blocks in page order."""
    out, now, at = [], [], None
    block = [0] * len(page.tag)
    for k in range(1, len(page.tag)):
        block[k] = k if page.tag[k] in BLOCKS else block[page.parent[k]]
    for unit, value in page.runs:
        if not kept[unit]:
            continue
        if block[unit] != at:
            out.append("".join(now))
            now, at = [], block[unit]
        now.append(" " if value is None else value)
    out.append("".join(now))
    return [t for t in (_SPACE.sub(" ", b).strip() for b in out) if t]


def main_texts(sources: list[str | None], trees: Trees) -> list[str]:
    """The main text of each page."""
    pages = [parse(source or "") for source in sources]
    rows, cuts = features(pages)
    scores = trees.score(rows)
    return ["\n\n".join(blocks(p, decode(p, scores[a:b]))) for p, a, b in zip(pages, cuts[:-1].tolist(), cuts[1:].tolist())]


def extracted(pages: DataFrame, trees: Trees) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.slices(batches, "html", limit=2 << 20):
            texts = main_texts(batch.column("html").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
