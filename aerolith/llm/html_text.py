"""Main text of web pages by gradient-boosted trees over the nodes of the document tree (op5).

Method: a page is read into a tree of elements and text nodes. For every node there are features of
its subtree (length, density, links, punctuation), its attribute tokens and those of its ancestors,
its depth and its siblings. Boosted trees give each node's log-odds of being part of the article or
around it. Decoding is over the whole tree: the kept nodes are the set of the largest sum in which no
node is kept whose parent is not, so an ancestor and its descendants cannot contradict each other.

The trees are fitted on a bounded sample of TRAIN_PAGES pages that label themselves, by an <article>
or <main> element; in half of the copies the tags and attributes that tell are blanked, so that shape
alone must do. Without any such page, only what a tag or attribute marks as no article is left out.

Edge cases: null or empty html has no text; unclosed and stray tags are closed or skipped as browsers
do for the common cases; svg, math, noscript, template and iframe are elements like any other, marked as no
article. They are empty where the tag closes itself or nothing ends it, but an svg or math that nothing ends
goes on to the next element that it cannot have. Pages of any length are read whole; repeated rows give a row each.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import table

TRAIN_PAGES, TREES, DEPTH, RATE, BINS = 400, 30, 4, 0.3, 32

# Element and attribute names.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_RAW = {"script", "style", "textarea", "title", "xmp"}
_FOREIGN = {"svg", "math"}
_ASIDE = {"noscript", "iframe", "template", "noembed", "noframes", *_FOREIGN}
#: Elements of svg and math in which there is HTML again.
_HTML_INSIDE = {"foreignobject", "desc", "annotation-xml"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "body": {"head"}}
_ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_SCOPES = {"table", "ul", "ol", "dl", "div", "article", "section", "main", "aside", "nav", "body", "html", "td", "th", "select", "footer", "header", "form"}
#: Elements that svg and math cannot have, so they end them.
_BREAKS_OUT = {*_ENDS_P, "b", "big", "body", "br", "center", "code", "dd", "dt", "em", "embed", "head", "i", "img", "li", "menu", "meta", "ruby", "s", "small", "span", "strike", "strong", "sub", "sup", "tt", "u", "var"}
_GOOD_TAGS = {"article", "main"}
_BAD_TAGS = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "object", "canvas", *_RAW, *_ASIDE}
_GOOD = {"article", "body", "content", "entry", "main", "post", "story", "text"}
_BAD = {"ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "footer", "form", "header", "login", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "promoted", "related", "reply", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
_HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}

#: A comment, a tag whose quotes are closed before the next "<", any other tag (it ends at the first ">"), a declaration.
#: Nothing is given back once read, and up to the last ">" of a page the third always ends, so a page is read in linear time.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>"']*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/<>"']*+)([^>]*+)>|<[!?][^>]*+>""", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
TEXT = "#text"


class Tree(NamedTuple):
    """Nodes in page order; end: one past the last of the subtree."""

    tag: list[str]
    parent: list[int]
    end: list[int]
    tokens: list[str]
    text: list[str]


def parsed(page: str) -> Tree:
    tag, parent, end, tokens, text = ["#root"], [-1], [0], [""], [""]
    # of each open element also the svg or math that it is in, or 0; and how many of each name are open
    stack, within, names, at, last = [0], [0], Counter(), 0, {}

    def close(to: int) -> None:
        while len(stack) > to:
            within.pop()
            k = stack.pop()
            names[tag[k]] -= 1
            end[k] = len(tag)

    def add_text(piece: str) -> None:
        if piece:
            tag.append(TEXT)
            parent.append(stack[-1])
            end.append(len(tag))
            tokens.append("")
            text.append(piece)

    def ends_later(name: str) -> bool:
        if name not in last:
            last[name] = max((m.start() for m in re.finditer(rf"</{re.escape(name)}\s*>", page, re.I)), default=-1)
        return last[name] >= at

    find, stop = _TOKEN.search, page.rfind(">") + 1
    while (m := find(page, at, stop)) is not None:
        if m.start() > at:
            add_text(page[at : m.start()])
        at = m.end()
        strict = m[2] is not None
        name = m[2] if strict else m[5]
        if name is None:
            if page.startswith("<!--", m.start()) and not page.endswith("-->", m.start(), at):
                at = len(page)
            continue
        name = name.lower()
        if m[1] if strict else m[4]:
            if names[name]:
                close(max(i for i in range(len(stack)) if tag[stack[i]] == name) if tag[stack[-1]] != name else len(stack) - 1)
            continue
        while within[-1] and name in _BREAKS_OUT:
            close(within[-1])
        closes = _CLOSES.get(name)
        if closes or name in _ENDS_P:
            closes = (closes or set()) | ({"p"} if name in _ENDS_P else set())
            for i in range(len(stack) - 1, 0, -1) if any(names[x] for x in closes) else ():
                here = tag[stack[i]]
                if here in closes:
                    close(i)
                    if len(closes) < 3:
                        break
                elif here in _SCOPES and name != "body":
                    break
        attributes, foreign = m[3] if strict else m[6], within[-1]
        tag.append(name)
        parent.append(stack[-1])
        end.append(len(tag))
        tokens.append(" ".join(x[1].strip("\"'") for x in _ATTRIBUTE.findall(attributes)) if "=" in attributes else "")
        text.append("")
        if (foreign or name in _ASIDE) and (attributes.endswith("/") or name in _ASIDE - _FOREIGN and not ends_later(name)):
            continue
        if name in _RAW and not foreign:
            raw = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = raw.end() if raw else len(page)
        elif name not in _VOID:
            within.append(len(stack) if name in _FOREIGN else 0 if name in _HTML_INSIDE else foreign)
            stack.append(len(tag) - 1)
            names[name] += 1
    if at < len(page):
        add_text(page[at:])
    close(0)
    return Tree(tag, parent, end, tokens, text)


# ---------------------------------------------------------------- features

FEATURES = ["is_text", "inline", "heading", "paragraph", "list", "link", "good_tag", "bad_tag", "good_token", "bad_token", "good_above", "bad_above", "depth", "length", "words", "density", "link_share", "punctuation", "capitals", "elements", "children", "siblings", "place_among_siblings", "same_tag_siblings", "place_in_page", "share_of_page", "paragraphs", "parent_length", "parent_density", "parent_link_share"]
_TELLS = [FEATURES.index(x) for x in ("good_tag", "bad_tag", "good_token", "bad_token", "good_above", "bad_above")]
_PUNCTUATION, _CAPITAL = re.compile(r"[.,;:!?]"), re.compile("[A-ZÀ-ÖØ-ÞА-Я]")


def features(t: Tree) -> tuple[np.ndarray, np.ndarray]:
    """A row of FEATURES per node; and which nodes a tag or attribute marks as no article, themselves or above."""
    n = len(t.tag)
    parent, end, at = np.array(t.parent), np.array(t.end), np.arange(n)
    is_text = np.array([x == TEXT for x in t.tag])
    sizes = np.array([len(x) for x in t.text], np.float64)
    below = lambda x: (c := np.concatenate(([0.0], np.cumsum(x))))[end] - c[at]
    marks = [set(x for x in _SPLIT.split(k.lower()) if x) if k else () for k in t.tokens]
    flag = lambda names: np.array([x in names for x in t.tag], np.float64)
    good_token, bad_token = (np.array([bool(m) and not names.isdisjoint(m) for m in marks], np.float64) for names in (_GOOD, _BAD))
    good_tag, bad_tag, link = flag(_GOOD_TAGS), flag(_BAD_TAGS), flag({"a"})
    body = flag({"body", "html"})
    bad_token *= 1 - body
    inside = lambda x: (np.cumsum(np.bincount(at[x > 0], minlength=n + 1) - np.bincount(end[x > 0], minlength=n + 1))[:n] > 0).astype(np.float64)
    length, elements = below(sizes), below(1.0 - is_text)
    in_link = inside(link)
    words = below(np.array([x.count(" ") + 1 if x.strip() else 0 for x in t.text], np.float64))
    punctuation = below(np.array([len(_PUNCTUATION.findall(x)) if x else 0 for x in t.text], np.float64))
    capitals = below(np.array([len(_CAPITAL.findall(x)) if x else 0 for x in t.text], np.float64))
    link_share = below(sizes * in_link) / np.maximum(length, 1)
    depth = np.zeros(n)
    up = parent.tolist()
    levels = [0] * n
    for i in range(1, n):
        levels[i] = levels[up[i]] + 1
    depth[:] = levels
    children = np.bincount(parent[1:], minlength=n).astype(np.float64) if n > 1 else np.zeros(n)
    order = np.argsort(parent, kind="stable")
    place = np.empty(n)
    place[order] = np.arange(n) - np.searchsorted(parent[order], parent[order])
    _, code = np.unique(np.array(t.tag), return_inverse=True)
    _, kin = np.unique(parent * (code.max() + 1) + code, return_inverse=True)
    density = np.log1p(length / (elements + 1))
    above = np.maximum(parent, 0)
    before = np.concatenate(([0.0], np.cumsum(sizes)))[at]
    whole = max(float(sizes.sum()), 1.0)
    siblings = children[above]
    columns = [is_text, flag(_INLINE), flag(_HEADS), flag({"p"}), flag({"ul", "ol", "li"}), link, good_tag, bad_tag, good_token, bad_token, inside(np.maximum(good_tag, 0)), inside(np.maximum(bad_tag, bad_token)), depth, np.log1p(length), np.log1p(words), density, link_share, punctuation / np.maximum(words, 1), capitals / np.maximum(length, 1), np.log1p(elements), children, siblings, place / np.maximum(siblings, 1), np.bincount(kin)[kin], before / whole, length / whole, below(flag({"p"})), np.log1p(length[above]), density[above], link_share[above]]
    out = np.stack([np.asarray(c, np.float32) for c in columns], axis=1)
    return out, out[:, FEATURES.index("bad_above")] > 0


def labels(t: Tree, rows: np.ndarray) -> np.ndarray | None:
    """1 for nodes of the article, and for those around it; None if the page doesn't tell."""
    if not rows[:, FEATURES.index("good_tag")].any():
        return None
    inside = (rows[:, FEATURES.index("good_above")] > 0) & (rows[:, FEATURES.index("bad_above")] == 0)
    count = np.concatenate(([0], np.cumsum(inside)))
    return (count[np.array(t.end)] - count[:-1] > 0) & ((rows[:, FEATURES.index("is_text")] == 0) | inside)


# ---------------------------------------------------------------- boosted trees


class Boosted(NamedTuple):
    """Complete trees of DEPTH levels: of inner nodes the feature and threshold, of leaves the value."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.base)
        flat, line = rows.ravel(), np.arange(len(rows)) * rows.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (flat[line + f[node]] > t[node])
            out += v[node - len(f)]
        return out


def fit(rows: np.ndarray, label: np.ndarray, trees: int = TREES) -> Boosted:
    """Logistic boosting with second-order leaf values on binned features."""
    label = label.astype(np.float64)
    edges = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(rows.shape[1])]
    binned = np.stack([np.searchsorted(e, rows[:, j], "left") for j, e in enumerate(edges)], axis=1)
    p = min(0.99, max(0.01, float(label.mean())))
    base = float(np.log(p / (1 - p)))
    score, inner = np.full(len(rows), base), 2**DEPTH - 1
    features_, thresholds, values = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, inner + 1))
    gain_of = lambda g, h: g * g / (h + 1.0)
    for k in range(trees):
        prob = 1 / (1 + np.exp(-score))
        g, h = label - prob, prob * (1 - prob)
        node = np.zeros(len(rows), np.int64)
        for level in range(DEPTH):
            n, first = 2**level, 2**level - 1
            best = np.full(n, 1e-6)
            cut = np.full(n, BINS, np.int64)
            for j, e in enumerate(edges):
                key = (node - first) * BINS + binned[:, j]
                gs, hs = (np.cumsum(np.bincount(key, x, n * BINS).reshape(n, BINS), axis=1) for x in (g, h))
                gain = gain_of(gs, hs) + gain_of(gs[:, -1:] - gs, hs[:, -1:] - hs) - gain_of(gs[:, -1:], hs[:, -1:])
                gain[:, len(e) :] = 0
                top = gain.argmax(1)
                better = gain[np.arange(n), top] > best
                best = np.where(better, gain[np.arange(n), top], best)
                cut = np.where(better, top, cut)
                for i in np.flatnonzero(better):
                    features_[k, first + i], thresholds[k, first + i] = j, e[top[i]]
            own = features_[k, node]
            right = binned[np.arange(len(rows)), own] > cut[node - first]
            node = 2 * node + 1 + right
        leaf = node - inner
        values[k] = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1.0)
        score += values[k][leaf]
    return Boosted(base, features_, thresholds, values)


# ---------------------------------------------------------------- decoding


def kept(t: Tree, odds: np.ndarray) -> list[bool]:
    """The set of nodes with the largest sum of log-odds in which each but the root has its parent."""
    best, parent = odds.tolist(), t.parent
    for i in range(len(best) - 1, 0, -1):
        if best[i] > 0:
            best[parent[i]] += best[i]
    keep = [True] * len(best)
    for i in range(1, len(best)):
        keep[i] = best[i] > 0 and keep[parent[i]]
    return keep


def text_of(t: Tree, keep: list[bool]) -> str:
    """Kept text: blocks end where an element that is not inline begins or ends."""
    blocks: list[str] = []
    here: list[str] = []
    ends: list[tuple[int, str]] = []
    for i, name in enumerate(t.tag):
        while ends and ends[-1][0] <= i:
            ends.pop()
            blocks.append("".join(here))
            here = []
        if name == TEXT:
            if keep[i]:
                here.append(html.unescape(t.text[i]))
        elif name not in _INLINE:
            blocks.append("".join(here))
            here = []
            ends.append((t.end[i], name))
    blocks.append("".join(here))
    return " ".join(y for x in blocks if (y := " ".join(x.split())))


def main_texts(pages: list[str | None], model: Boosted | None, together: int = 128) -> Iterator[str]:
    """The main text of each page; the trees look at the nodes of many pages at once."""
    for i in range(0, len(pages), together):
        trees = [parsed(x) if x else None for x in pages[i : i + together]]
        found = [features(t) for t in trees if t is not None]
        if not found:
            yield from ("" for _ in trees)
            continue
        odds = model.log_odds(np.concatenate([f for f, _ in found])) if model is not None else np.concatenate([np.where(m, -1.0, 1.0) for _, m in found])
        parts = iter(np.split(odds, np.cumsum([len(f) for f, _ in found])[:-1]))
        for t in trees:
            yield "" if t is None else text_of(t, kept(t, next(parts)))


def train(pages: DataFrame, *, train_pages: int = TRAIN_PAGES, html_col: str = "html", seed: int = 5) -> Boosted | None:
    """Fits the trees on the train_pages self-labelled pages of the smallest hash."""

    def example(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.column(0).to_pylist():
                t = parsed(page)
                rows, _ = features(t)
                label = labels(t, rows)
                if label is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([rows.tobytes()], pa.binary()), pa.array([label.tobytes()], pa.binary())], ["rows", "label"])

    sample = pages.select(F.col(html_col).alias("page")).where(F.col("page").rlike("(?i)<(article|main)[ >]")).orderBy(F.xxhash64("page"), "page").limit(train_pages)
    found = sample.mapInArrow(example, "rows binary, label binary").collect()
    if not found:
        return None
    rows = np.concatenate([np.frombuffer(bytes(r.rows), np.float32).reshape(-1, len(FEATURES)) for r in found])
    label = np.concatenate([np.frombuffer(bytes(r.label), bool) for r in found])
    blank = rows.copy()
    blank[:, _TELLS] = 0
    return fit(np.concatenate((rows, blank)), np.concatenate((label, label)))


def extracted(pages: DataFrame, model: Boosted | None, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars."""
    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(main_texts(batch.column(2).to_pylist(), model))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], [id_col, "url", "text"])

    return pages.select(id_col, F.col("url").cast("string"), F.col(html_col).cast("string")).mapInArrow(run, schema).withColumn("n_chars", F.char_length("text").cast("long"))


def op5_boosted_dom(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extracted(pages, train(pages))


QUERIES = {"op5_boosted_dom": op5_boosted_dom}
ORACLE_SQL: dict[str, str] = {}
