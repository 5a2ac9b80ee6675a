"""Main text of web pages by gradient-boosted trees over DOM nodes.

Each block element of a page is a node with features: attribute tokens of its own
and of its ancestors, depth, text, link and punctuation density of its subtree,
and sibling statistics. Boosted trees, trained here, give each node a probability
of being article. A Viterbi search down the tree decides: on every path nodes are
before the article, in it, or behind it, in that order, so an advert inside the
article stays out, nothing inside an advert comes back, and no ancestor and
descendant contradict each other.

The trees are fitted on nodes of at most ``TRAIN_PAGES`` pages (those with the
smallest hash of their html) whose markup names its regions, each also with the
names hidden, so that unnamed pages are judged by density. Every page is scored.
"""

from __future__ import annotations

import html as entities
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from plantgauge.llm.common import keeps_names, stored, whole_text

TRAIN_PAGES = 2_000
TREES, DEPTH = 20, 4

# what a tag holds: a quote opens a value only after an equals sign, and one that is never
# closed ends with the page, as does a tag; nothing is ever tried twice
INSIDE = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|textarea|title)\b{INSIDE}(?:>|\Z).*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({INSIDE})(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[a-z]+")
# How HTML nests.
BLOCKS = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre "
    "figure figcaption header footer nav aside form fieldset address details summary hr center dialog menu".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# left out with all they hold; one without an end tag of its own ends at the next block
DROPPED = frozenset("noscript template select svg iframe button object canvas".split())
# a head ends at its end tag or at the first element that is none of these
IN_HEAD = frozenset("base basefont bgsound link meta noscript template noframes script style title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS
ENDS_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
# Words in names of regions.
GOOD_WORDS = frozenset("article main content post entry story body text articlebody prose".split())
BAD_WORDS = frozenset(
    "ad ads advert advertisement adverts sponsor sponsored promo promotion banner nav navigation navbar menu breadcrumb breadcrumbs header masthead "
    "footer sidebar aside related recommended widget share social comment comments reply replies discussion disqus respond cookie cookies consent "
    "notice alert warning popup modal overlay newsletter subscribe signup login search form copyright legal disclaimer tags pagination pager toc skip "
    "complementary contentinfo".split()
)
GOOD_TAGS = frozenset(["article", "main"])
BAD_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
PUNCTUATION = re.compile(r"[.,;:!?]")

FEATURES = (
    "paragraph heading list table container good bad good_above bad_above depth own_text subtree_text page_share link_share "
    "punctuation blocks text_per_block child_blocks sibling_at siblings same_tag before_text after_text place"
).split()
MASKED = [FEATURES.index(n) for n in ("good", "bad", "good_above", "bad_above")]


def dropped_ends(tokens: list[re.Match]) -> dict[int, int]:
    """The token that ends each dropped element with an end tag, by its first token."""
    open_: dict[str, list[int]] = {}
    ends = {}
    for k, m in enumerate(tokens):
        name = m[3].lower() if m[3] else ""
        if name in DROPPED:
            if not m[2]:
                if not m[4].endswith("/"):
                    open_.setdefault(name, []).append(k)
            elif open_.get(name):
                ends[open_[name].pop()] = k
    return ends


class Page:
    """Block nodes of a page in document order, and its pieces of text."""

    __slots__ = ("tag", "parent", "good", "bad", "own", "links", "marks", "pieces")

    def __init__(self, source: str):
        self.tag, self.parent, self.good, self.bad = ["html"], [-1], [0], [0]
        self.own, self.links, self.marks = [0], [0], [0]
        self.pieces: list[tuple[int, int, str]] = []  # node, block number, text
        stack, block, anchors, at = [0], 0, 0, 0
        tokens = list(TOKEN.finditer(source))
        ends = dropped_ends(tokens)
        skip, unended, head = -1, False, False
        for k, m in enumerate(tokens):
            piece, at = source[at : m.start()], m.end()
            head = head and not piece.strip()
            if piece and k > skip and not unended and not head:
                self.text(piece, stack[-1], block, anchors)
            name = m[3]
            if not name or k <= skip:
                continue
            name = name.lower()
            if name == "head":
                head = not m[2]
                continue
            head = head and name in IN_HEAD
            unended = unended and name not in BLOCKS
            if unended:
                continue
            if name in DROPPED:
                if not m[2] and not m[4].endswith("/"):
                    skip, unended = ends.get(k, skip), k not in ends
            elif name in ("a",):
                anchors = 0 if m[2] else 1
            elif name == "br":
                self.pieces.append((stack[-1], block, " "))
            elif name in BLOCKS:
                block += 1
                if m[2]:
                    anchors = 0
                    for i in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[i]] == name:
                            del stack[i:]
                            break
                elif name in ("html", "body"):
                    continue
                else:
                    if self.tag[stack[-1]] == "p" or self.tag[stack[-1]] in HEADINGS and name in HEADINGS:
                        stack.pop()
                    if name in ENDS_SAME:
                        for i in range(len(stack) - 1, 0, -1):
                            open_ = self.tag[stack[i]]
                            if open_ in ENDS_SAME[name]:
                                break
                            if open_ == name or {open_, name} <= {"dt", "dd"} or {open_, name} <= {"td", "th"}:
                                del stack[i:]
                                break
                    self.open(name, m[4], stack)
                    if name in VOID or m[4].endswith("/"):
                        stack.pop()
        if at < len(source) and not unended and not (head and source[at:].isspace()):
            self.text(source[at:], stack[-1], block, anchors)

    def open(self, name: str, attributes: str, stack: list[int]) -> None:
        words = [w for a in ATTRIBUTE.findall(attributes) for w in WORD.findall("".join(a).lower())] if attributes else ()
        self.tag.append(name)
        self.parent.append(stack[-1])
        self.good.append((name in GOOD_TAGS) + sum(w in GOOD_WORDS for w in words))
        self.bad.append((name in BAD_TAGS) + sum(w in BAD_WORDS for w in words))
        self.own.append(0)
        self.links.append(0)
        self.marks.append(0)
        stack.append(len(self.tag) - 1)

    def text(self, piece: str, node: int, block: int, anchors: int) -> None:
        if "&" in piece:
            piece = entities.unescape(piece)
        self.pieces.append((node, block, piece))
        n = len(piece) - piece.count(" ") if not piece.isspace() else 0
        self.own[node] += n
        self.marks[node] += len(PUNCTUATION.findall(piece)) if n else 0
        if anchors:
            self.links[node] += n

    def labels(self) -> list[int] | None:
        """1 for nodes in a named article and in no named other region; None for a
        page whose markup names no article."""
        inside, out = [0] * len(self.tag), []
        for i, p in enumerate(self.parent):
            state = inside[p] if p >= 0 else 0
            if self.bad[i]:
                state = 2
            elif state == 0 and self.good[i]:
                state = 1
            inside[i] = state
            out.append(int(state == 1))
        return out if any(out) else None

    def features(self) -> np.ndarray:
        n = len(self.tag)
        parent = self.parent
        depth, good_above, bad_above = [0] * n, [0] * n, [0] * n
        children: list[list[int]] = [[] for _ in range(n)]
        for i in range(1, n):
            p = parent[i]
            depth[i] = depth[p] + 1
            good_above[i] = good_above[p] + (self.good[p] > 0)
            bad_above[i] = bad_above[p] + (self.bad[p] > 0)
            children[p].append(i)
        total, links, marks, blocks = self.own[:], self.links[:], self.marks[:], [1] * n
        for i in range(n - 1, 0, -1):
            p = parent[i]
            total[p] += total[i]
            links[p] += links[i]
            marks[p] += marks[i]
            blocks[p] += blocks[i]
        all_text = max(1, total[0])
        place = [0.0] * n
        at, same, before, after = [0] * n, [1.0] * n, [0] * n, [0] * n
        for own in children:
            tags: dict[str, int] = {}
            for c in own:
                tags[self.tag[c]] = tags.get(self.tag[c], 0) + 1
            for k, c in enumerate(own):
                at[c], same[c] = k, tags[self.tag[c]] / len(own)
                before[c] = total[own[k - 1]] if k else 0
                after[c] = total[own[k + 1]] if k + 1 < len(own) else 0
        passed = 0
        for i in range(n):
            place[i] = passed / all_text
            passed += self.own[i]
        log = math.log1p
        return np.array(
            [
                (
                    t == "p" or t == "blockquote" or t == "pre", t in HEADINGS, t in ("li", "ul", "ol", "dl", "dt", "dd"), t in ("table", "tr", "td", "th"),
                    t in ("div", "section", "article", "main"), self.good[i], self.bad[i], good_above[i], bad_above[i], depth[i], log(self.own[i]),
                    log(total[i]), total[i] / all_text, links[i] / max(1, total[i]), marks[i] / max(1, total[i]), log(blocks[i]),
                    total[i] / blocks[i], len(children[i]), at[i], len(children[parent[i]]) if i else 1, same[i], log(before[i]), log(after[i]), place[i],
                )
                for i, t in enumerate(self.tag)
            ],
            dtype=np.float32,
        )

    def article(self, p: np.ndarray) -> str:
        """The article's text under node probabilities ``p``."""
        states = decode(self.parent, p, np.log1p(np.array(self.own, dtype=np.float64)))
        blocks: dict[int, list[str]] = {}
        for node, block, piece in self.pieces:
            if states[node] == 1:
                blocks.setdefault(block, []).append(piece)
        texts = (" ".join("".join(parts).split()) for parts in blocks.values())
        return "\n\n".join(t for t in texts if t)


def decode(parent: list[int], p: np.ndarray, weight: np.ndarray) -> list[int]:
    """Best states (0 before, 1 in, 2 behind the article) of a tree given in
    document order. A node counts with its text; children of a node in state s may
    only be in s or a later state."""
    n = len(parent)
    p = np.clip(p, 1e-6, 1 - 1e-6)
    weight = weight + 0.05
    inside, outside = (weight * np.log(p)).tolist(), (weight * np.log(1 - p)).tolist()
    gains = [[outside[i], inside[i], outside[i]] for i in range(n)]
    for i in range(n - 1, 0, -1):
        a, b, c = gains[i]
        bc = b if b > c else c
        top = gains[parent[i]]
        top[0] += a if a > bc else bc
        top[1] += bc
        top[2] += c
    states = [0] * n
    for i in range(n):
        least = states[parent[i]] if i else 0
        states[i] = max(range(least, 3), key=lambda s: gains[i][s])
    return states


class Trees:
    """Boosted regression trees as arrays, for scoring many nodes at once."""

    def __init__(self, trees: list[list[tuple[int, float, int, int, float]]], weights: list[float]):
        self.trees, self.weights = [tuple(map(np.array, zip(*t))) for t in trees], weights

    @classmethod
    def of(cls, model) -> Trees:
        """From a fitted Spark model, read from its printed form."""
        out = []
        for tree in model.trees:
            nodes: list = []
            lines = [x for x in tree.toDebugString.split("\n")[1:] if x.strip()]

            def build(at: int) -> tuple[int, int]:
                line = lines[at].strip()
                me = len(nodes)
                nodes.append(None)
                if line.startswith("Predict:"):
                    nodes[me] = (0, 0.0, me, me, float(line.split(":")[1]))
                    return me, at + 1
                m = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
                left, at = build(at + 1)
                right, at = build(at + 1)
                nodes[me] = (int(m[1]), float(m[2]), left, right, 0.0)
                return me, at

            build(0)
            out.append(nodes)
        return cls(out, list(model.treeWeights))

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        rows = np.arange(len(x))
        for (feature, cut, left, right, value), weight in zip(self.trees, self.weights):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                at = np.where(x[rows, feature[at]] <= cut[at], left[at], right[at])
            margin += weight * value[at]
        return 1 / (1 + np.exp(-2 * np.clip(margin, -20, 20)))


def training_nodes(pages: DataFrame, html: str) -> DataFrame:
    """(label, features) of the nodes of the training pages, named and masked."""

    def nodes(batches):
        for batch in batches:
            label, rows = [], []
            for source in batch.column(0).to_pylist():
                page = Page(source)
                marks = page.labels()
                if marks is None:
                    continue
                x = page.features()
                hidden = x.copy()
                hidden[:, MASKED] = 0
                for version in (x, hidden):
                    label += marks
                    rows += version.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.float64()), pa.array(rows, pa.list_(pa.float64()))], names=["label", "features"])

    def named(batches):
        for batch in batches:
            known = pa.array([Page(source).labels() is not None for source in batch.column(0).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(1).filter(known)], names=["h"])

    # only hashes are ordered; the pages below the last of them stay where they are
    rows = pages.select(whole_text(html).alias("html")).where("html <> ''").withColumn("h", F.xxhash64("html"))
    first = rows.mapInArrow(named, "h long").distinct().orderBy("h").limit(TRAIN_PAGES)
    last = first.agg(F.max("h")).first()[0]
    held = rows.where(F.col("h") <= last) if last is not None else rows.where("false")
    return held.dropDuplicates(["h"]).select("html").mapInArrow(nodes, "label double, features array<double>")


def fit_trees(pages: DataFrame, html: str = "html") -> Trees | None:
    """Trees fitted on the training nodes; None where no page names an article."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    nodes = stored(training_nodes(pages, html), "nodes")
    if len(nodes.select("label").distinct().limit(2).collect()) < 2:
        return None
    rows = nodes.select("label", array_to_vector("features").alias("features"))
    return Trees.of(GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=4, stepSize=0.3).fit(rows))


def prior(x: np.ndarray) -> np.ndarray:
    """Node probabilities where nothing could be fitted: names, then link share."""
    good, bad = x[:, FEATURES.index("good_above")] + x[:, FEATURES.index("good")], x[:, FEATURES.index("bad_above")] + x[:, FEATURES.index("bad")]
    return np.where(bad > 0, 0.05, np.where(good > 0, 0.95, np.where(x[:, FEATURES.index("link_share")] > 0.5, 0.2, 0.7)))


@keeps_names("_h_")
def extract_articles(pages: DataFrame, html: str = "html", trees: Trees | None = None) -> DataFrame:
    """``pages`` with ``text``, the article of each whole page: blocks joined by two
    line feeds, white space in a block as one space, character references decoded.

    Null and empty html, and pages without an article, give the empty text. Rows
    are independent; repeated rows get equal texts; an empty table stays empty. A
    column named text is replaced.
    """
    trees = trees or fit_trees(pages, html)
    rows = pages.drop("text").withColumn("_h_html", whole_text(html))
    schema = T.StructType(rows.schema.fields[:-1] + [T.StructField("text", T.StringType())])

    def extract(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                parsed = [Page(s) for s in batch.column(batch.num_columns - 1).to_pylist()]
                x = [p.features() for p in parsed]
                every = np.concatenate(x)
                p = prior(every) if trees is None else trees.probability(every)
                cuts = np.cumsum([0] + [len(f) for f in x])
                texts = [page.article(p[a:b]) for page, a, b in zip(parsed, cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays(batch.columns[:-1] + [pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(extract, schema)
