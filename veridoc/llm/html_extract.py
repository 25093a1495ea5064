"""Main text of web pages: boosted trees over DOM-node features, then hierarchical decoding.

A page is read into its block-level nodes.  A gradient-boosted tree model (Spark ML) gives each node the probability that
its subtree holds main text, from the subtree's text density, link density, tag and attribute tokens, depth and sibling
statistics.  A dynamic programme over the tree then picks the likeliest labelling in which no main-text node has a
boilerplate ancestor.  The text of main-text nodes is emitted block by block.

Training needs no hand labels: on a bounded sample (SAMPLE_PAGES pages, by a hash of the id) the article element and the
elements outside it give the labels, and copies of each page with renamed elements and inserted boilerplate (side bars,
notices, forms, adverts, comments) teach the model not to rely on one mark-up.

Defined cases: null, empty and unreadable html gives an empty text; broken or unclosed mark-up is closed with the element
around it, only raw text (RAW) runs to its end tag or the end of the page; what stands in formulas, drawings, objects, menus,
templates and noscript elements is judged like any other node and stays in its line; repeated rows give equal texts; without a training page of both classes every block is kept; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

import html
import math
import random
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

SAMPLE_PAGES = 500
TREES, DEPTH = 14, 5
PAGES_AT_ONCE = 200
COHESION = 1.0
TAG = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S
)
ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
RAW = {"script", "style", "textarea", "title", "iframe"}
INLINE = {"math", "svg", "object", "select", "template", "noscript"}  # nodes that do not break the line
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "html", "body", "main", "article", "section", "div", "header", "footer", "nav", "aside", "p", "h1", "h2", "h3", "h4",
    "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "pre",
    "blockquote", "figure", "figcaption", "form", "fieldset", "legend", "label", "button", "address", "details", "summary",
    "dialog", "menu", "hgroup", "center", "head", "search", "option",
}
#: An opening tag closes an open element of these kinds, up to the nearest container.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tbody", "thead", "tr", "td", "th"}, "option": {"option"}, "body": {"head"},
}
SCOPE = {"ul", "ol", "menu", "table", "dl", "div", "section", "article", "body", "html", "main"}
#: Attribute tokens, grouped by what they usually mark.
TOKENS = {
    "menu": "nav menu navbar breadcrumb breadcrumbs toc pagination pager tabs",
    "frame": "header footer masthead banner head foot copyright bottom top topbar",
    "side": "sidebar side aside related widget rail promo recommended popular trending share social tags",
    "notice": "cookie consent notice alert popup modal overlay gdpr newsletter subscribe paywall toast warning",
    "advert": "ad ads advert adverts advertisement sponsor sponsored commercial banner-ad dfp",
    "form": "form search login signup register input button contact",
    "comment": "comment comments reply replies disqus discussion respond thread reader-comments",
    "main": "article content main post entry story body text page-content post-content entry-content blog prose",
}
GROUP_OF = {w: g for g, words in TOKENS.items() for w in words.split()}
GROUPS = tuple(TOKENS)
TAG_KINDS = ("p", "h", "li", "list", "nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "table", "quote", "other")
FEATURES = (
    "log_text", "log_words", "link_share", "density", "tags", "paragraphs", "stops", "depth", "place", "siblings",
    "text_share", "sibling_share", "own_share", "near_head", "same_tag", "up_log_text", "up_link_share", "sibling_mean",
    *(f"tag_{k}" for k in TAG_KINDS), *(f"own_{g}" for g in GROUPS), *(f"up_{g}" for g in GROUPS), *(f"up_tag_{k}" for k in TAG_KINDS),
)


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    groups: set = field(default_factory=set)
    place: int = 0
    children: int = 0
    own: int = 0  # characters of its own blocks
    linked: int = 0
    words: int = 0
    stops: int = 0
    tags: int = 0
    paragraphs: int = 0


@lru_cache(maxsize=512)
def kind(tag: str) -> str:
    if re.fullmatch(r"h[1-6]|hgroup", tag):
        return "h"
    if tag in ("ul", "ol", "dl", "menu"):
        return "list"
    if tag in ("dt", "dd"):
        return "li"
    if tag in ("blockquote", "pre", "figure", "figcaption"):
        return "quote"
    if tag in ("form", "button", "label", "fieldset", "legend", "dialog", "option", "search", "select"):
        return "form"
    if tag in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"):
        return "table"
    return tag if tag in TAG_KINDS else "other"


def attribute_groups(attributes: str) -> set:
    found = set()
    for name, *values in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            for w in re.split(r"[^a-z-]+", "".join(values).lower()):
                for part in (w, *w.split("-")):
                    if part in GROUP_OF:
                        found.add(GROUP_OF[part])
    return found


def read_page(source: str | None) -> tuple[list[Node], list[tuple[int, str, int, bool]]]:
    """Block-level and INLINE nodes in page order, and the page's blocks as (node, text, line, whether space precedes)."""
    nodes = [Node("html", -1, 0)]
    stack: list[tuple[str, int]] = [("html", 0)]
    blocks: list[tuple[int, str, int, bool]] = []
    text: list[str] = []
    link = linked = line = 0
    spaced = False
    source = source or ""

    def flush(same_line: bool = False) -> None:
        nonlocal linked, line, spaced
        if text:
            raw = "".join(text)
            whole = " ".join(raw.split())
            text.clear()
            spaced |= raw[:1].isspace()
            if whole:
                n = nodes[stack[-1][1]]
                n.own += len(whole)
                n.linked += min(linked, len(whole))
                n.words += whole.count(" ") + 1
                n.stops += sum(map(whole.count, ".!?"))
                blocks.append((stack[-1][1], whole, line, spaced))
                spaced = raw[-1:].isspace()
        if not same_line:
            line, spaced = line + 1, False
        linked = 0

    def pop_to(k: int, same_line: bool = False) -> None:
        flush(same_line)
        del stack[k:]

    def push(tag: str, attributes: str) -> None:
        parent = stack[-1][1]
        up = nodes[parent]
        nodes.append(Node(tag, parent, up.depth + 1, attribute_groups(attributes) if "=" in attributes else set(), up.children))
        up.children += 1
        up.tags += 1
        up.paragraphs += tag == "p"
        stack.append((tag, len(nodes) - 1))

    at, end = 0, len(source)
    while at < end:
        m = TAG.search(source, at)
        start = m.start() if m else end
        if start > at:
            piece = source[at:start]
            piece = html.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if link:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        closing, tag, attributes = m.group(1), (m.group(2) or "").lower(), m.group(3) or ""
        if not tag:
            continue
        if tag in RAW and not (tag == "title" and any(t == "svg" for t, _ in stack)):
            if not closing and not attributes.endswith("/"):
                over = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                at = over.end() if over else end
            continue
        if tag == "a":
            link = 0 if closing else 1
        if tag in ("br", "hr"):
            text.append(" ")
        if tag in VOID:
            continue
        if tag in INLINE:
            if closing:
                opened = [k for k in range(1, len(stack)) if stack[k][0] == tag]
                if opened:
                    pop_to(opened[-1], True)
            elif tag not in ("math", "svg") or not attributes.endswith("/"):
                flush(True)
                push(tag, attributes)
            continue
        if tag not in BLOCK:
            nodes[stack[-1][1]].tags += not closing
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if tag not in SCOPE and stack[k][0] in SCOPE:
                    flush()
                    break
            else:
                flush()
            continue
        flush()
        if tag == "html" or tag == "body" and any(t == "body" for t, _ in stack):
            continue
        shut = CLOSES.get(tag, set()) | {"p"}
        while len(stack) > 1 and stack[-1][0] in shut and (stack[-1][0] != "p" or tag not in ("label", "button")):
            pop_to(len(stack) - 1)
        push(tag, attributes)
    flush()
    heads = {i for i, n in enumerate(nodes) if n.tag == "head"}
    return nodes, [b for b in blocks if b[0] not in heads]


def node_features(nodes: list[Node]) -> np.ndarray:
    """One row of FEATURES per node."""
    n = len(nodes)
    parent = np.array([x.parent for x in nodes])
    sums = np.array([[x.own, x.linked, x.words, x.stops, x.tags, x.paragraphs] for x in nodes], float)
    own = sums[:, 0].copy()
    for i in range(n - 1, 0, -1):
        sums[parent[i]] += sums[i]
    text, linked, words, stops, tags, paragraphs = sums.T
    up = np.maximum(parent, 0)
    index = np.arange(n)
    big_child = np.zeros(n)
    np.maximum.at(big_child, up[1:], text[1:])
    kinds = {k: i for i, k in enumerate(TAG_KINDS)}
    tag_hot = np.zeros((n, len(TAG_KINDS)))
    tag_hot[index, [kinds[kind(x.tag)] for x in nodes]] = 1
    group_hot = np.array([[g in x.groups for g in GROUPS] for x in nodes], float).reshape(n, len(GROUPS))
    above_group, above_tag = np.zeros_like(group_hot), np.zeros_like(tag_hot)
    heading = np.zeros(n)
    for i in range(1, n):  # parents come before children
        above_group[i] = np.maximum(above_group[up[i]], group_hot[up[i]])
        above_tag[i] = np.maximum(above_tag[up[i]], tag_hot[up[i]])
        heading[i] = kind(nodes[i - 1].tag) == "h" and nodes[i - 1].parent == nodes[i].parent
    counts = np.bincount(up[1:], minlength=n)
    alike: dict[tuple[int, str], int] = {}
    for i in range(1, n):
        alike[up[i], nodes[i].tag] = alike.get((up[i], nodes[i].tag), 0) + 1
    same = np.array([alike.get((up[i], nodes[i].tag), 1) for i in range(n)]) / np.maximum(counts[up], 1)
    basic = np.column_stack([
        np.log1p(text), np.log1p(words), linked / np.maximum(text, 1), text / (1 + tags), np.log1p(tags), np.log1p(paragraphs),
        stops / np.maximum(words, 1), [x.depth for x in nodes], [x.place for x in nodes], [nodes[p].children for p in up],
        text / max(text[0], 1), text / np.maximum(big_child[up], 1), own / np.maximum(text, 1), heading,
        same, np.log1p(text[up]), linked[up] / np.maximum(text[up], 1), np.log1p(text[up] / np.maximum(counts[up], 1)),
    ])
    return np.column_stack([basic, tag_hot, group_hot, above_group, above_tag])


def decode(nodes: list[Node], probability: np.ndarray) -> np.ndarray:
    """Likeliest labels in which every ancestor of a main-text node holds main text.

    A node below a main-text element other than the page's body is likelier main text too, by COHESION in log-odds.
    """
    p = np.clip(probability, 1e-4, 1 - 1e-4)
    yes, no = np.log(p), np.log1p(-p)  # best of the subtree with the node labelled 1, and with the whole subtree 0
    gain = np.zeros(len(nodes))
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[i].parent
        held = 0.0 if nodes[up].tag in ("html", "body") else COHESION
        gain[i] = held
        yes[up] += max(yes[i] + held, no[i])
        no[up] += no[i]
    keep = np.zeros(len(nodes), bool)
    for i, x in enumerate(nodes):
        keep[i] = (x.parent < 0 or keep[x.parent]) and yes[i] + gain[i] >= no[i]
    return keep


# --- training ---------------------------------------------------------------------------------------------------------

OUT_TAGS = {"nav", "header", "footer", "aside", "form", "button", "label", "menu", "dialog", "fieldset", "search"}
OUT_GROUPS = set(GROUPS) - {"main", "frame"}


def teacher_labels(nodes: list[Node], blocks: list[tuple[int, str, int, bool]]) -> np.ndarray | None:
    """1 for nodes whose subtree holds text of an article or main element outside its marked boilerplate."""
    inside = np.zeros(len(nodes), int)  # 0 outside, 1 in the article, 2 in boilerplate
    for i, x in enumerate(nodes):
        above = inside[x.parent] if x.parent >= 0 else 0
        out = x.tag in OUT_TAGS or x.groups & OUT_GROUPS and x.tag not in ("article", "main")
        inside[i] = 2 if above == 2 or out else 1 if above == 1 or x.tag in ("article", "main") else 0
    if not (inside == 1).any():
        return None
    label = np.zeros(len(nodes), int)
    for n, *_ in blocks:
        while inside[n] == 1 and n >= 0 and not label[n]:
            label[n] = 1
            n = nodes[n].parent
    for i in range(len(nodes) - 1, 0, -1):
        label[nodes[i].parent] |= label[i]
    return label


def _boiler(rng: random.Random, words: list[str]) -> tuple[str, str, str]:
    """(html of a boilerplate block, where it goes: inside, before or after the article)."""
    say = lambda a, b: html.escape(" ".join(rng.choices(words, k=rng.randint(a, b))))
    name = lambda g: rng.choice(TOKENS[g].split())
    links = lambda n: "".join(f'<li><a href="#">{say(1, 4)}</a></li>' for _ in range(n))
    any_where = rng.choice(["before", "inside", "after"])
    g = rng.choice(["menu", "frame", "side", "notice", "advert", "form", "comment", "comment"])
    hint = rng.choice([f'class="{name(g)}"', f'id="{name(g)}"', f'class="x {name(g)}-box"'])
    if g == "menu":
        return f"<{(t := rng.choice(['nav', 'div', 'div']))} {hint}><ul>{links(rng.randint(3, 9))}</ul></{t}>", any_where, "out"
    if g == "frame":
        t = rng.choice(["header", "footer", "div"])
        return f"<{t} {hint}><p>{say(3, 25)}</p><a href='#'>{say(1, 3)}</a></{t}>", rng.choice(["before", "after"]), "out"
    if g == "side":
        t = rng.choice(["aside", "div", "section"])
        return f"<{t} {hint}><h3>{say(1, 4)}</h3><ul>{links(rng.randint(2, 6))}</ul><p>{say(5, 40)}</p></{t}>", any_where, "out"
    if g == "notice":
        return f"<div {hint}><p>{say(5, 40)}</p><button>{say(1, 2)}</button></div>", any_where, "out"
    if g == "advert":
        return f"<div {hint}>{rng.choice(['', '<p>'])}{say(3, 30)}</div>", any_where, "out"
    if g == "form":
        return f"<form {hint}><label>{say(1, 4)}</label><input><p>{say(3, 15)}</p><button>{say(1, 2)}</button></form>", any_where, "out"
    t = rng.choice(["section", "div", "ul"])
    one = lambda: f"<{'li' if t == 'ul' else 'div'} {rng.choice(['', hint])}><b>{say(1, 2)}</b><p>{say(5, 90)}</p></{'li' if t == 'ul' else 'div'}>"
    return f"<{t} {hint}><h3>{say(1, 3)}</h3>{''.join(one() for _ in range(rng.randint(1, 6)))}</{t}>", rng.choice(["after", "after", "inside"]), "out"


def _prose(rng: random.Random, words: list[str]) -> str:
    """A piece of main text in an uncommon shape: short paragraph, list, quotation, table or heading."""
    say = lambda a, b: html.escape(" ".join(rng.choices(words, k=rng.randint(a, b))))
    shape = rng.choice(["short", "short", "list", "quote", "table", "head"])
    if shape == "short":
        return f"<p>{say(1, 6)}</p>"
    if shape == "list":
        return "<ul>" + "".join(f"<li>{say(2, 20)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
    if shape == "quote":
        return f"<blockquote><p>{say(5, 40)}</p></blockquote>"
    if shape == "table":
        return f"<table><tr><td>{say(1, 5)}</td><td>{say(1, 5)}</td></tr></table>"
    return f"<h2>{say(1, 6)}</h2><p>{say(3, 40)}</p>"


def variants(source: str, seed: int) -> list[str]:
    """The page and copies of it with inserted boilerplate; the article keeps its element so the labels stay known."""
    rng = random.Random(seed)
    words = [w for w in re.sub(r"<[^>]*>", " ", source).split() if "&" not in w][:400] or ["a"]
    found = re.search(r"<(article|main)\b[^>]*>", source)
    close = source.rfind(f"</{found[1]}>") if found else -1
    if close < 0:
        return [source]
    pages = [source]
    for _ in range(3):
        before, inside, after = [], [], []
        for _ in range(rng.randint(1, 5)):
            block, where, _ = _boiler(rng, words)
            {"before": before, "inside": inside, "after": after}[where].append(block)
        body = source[found.end() : close]
        paragraphs = [m.start() for m in re.finditer(r"<p\b", body)]
        if len(paragraphs) > 2 and rng.random() < 0.35:  # a short article
            body = body[: paragraphs[rng.randint(1, 2)]]
        else:
            inside += [_prose(rng, words) for _ in range(rng.randint(0, 4))]
        spots = [m.start() for m in re.finditer(r"<p\b", body)] + [len(body)]
        for block in inside:
            k = rng.choice(spots)
            body, spots = body[:k] + block + body[k:], [s + len(block) * (s >= k) for s in spots]
        pages.append(source[: found.start()] + "".join(before) + found[0] + body + source[close : close + len(found[1]) + 3] + "".join(after) + source[close + len(found[1]) + 3 :])
    return pages


def _disguise(nodes: list[Node], rng: random.Random) -> None:
    """Rename semantic elements to plain ones, with or without a telling attribute."""
    for x in nodes:
        if x.tag in ("article", "main") and rng.random() < 0.7:
            x.tag, x.groups = rng.choice(["div", "div", "section", "td"]), rng.choice([set(), {"main"}, {"main"}])
        elif x.tag in ("nav", "header", "footer", "aside") and rng.random() < 0.5:
            own = {"nav": "menu", "header": "frame", "footer": "frame", "aside": "side"}[x.tag]
            x.tag, x.groups = "div", rng.choice([x.groups, {own}, {own}])


TRAINING = StructType([StructField("x", ArrayType(ArrayType(DoubleType()))), StructField("y", ArrayType(DoubleType()))])


@F.pandas_udf(TRAINING)
def training_nodes(pages: pd.Series, seeds: pd.Series) -> pd.DataFrame:
    """Feature rows and labels of a page's nodes and its variants'."""
    rows = []
    for source, seed in zip(pages, seeds, strict=True):
        xs, ys = [], []
        for k, page in enumerate(variants(source or "", int(seed))):
            nodes, blocks = read_page(page)
            labels = teacher_labels(nodes, blocks)
            if labels is None:
                continue
            if k:
                _disguise(nodes, random.Random(int(seed) * 7 + k))
            x = node_features(nodes)
            text = x[:, 0] > 0
            xs += x[text].tolist()
            ys += labels[text].astype(float).tolist()
        rows.append((xs, ys))
    return pd.DataFrame(rows, columns=["x", "y"])


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES):
    """Trees as arrays (feature, threshold, left, right, value), tree weights; None without both classes."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    seed = F.xxhash64(F.col(id_col), F.lit(3))
    share = min(1.0, 2 * sample / max(pages.select(id_col).count(), 1))  # so that the sort sees few pages of any input
    likely = F.pmod(seed, F.lit(1 << 30)) < F.lit(math.ceil(share * (1 << 30)))
    some = pages.filter(likely).select(F.col(html_col).alias("html"), seed.alias("seed")).orderBy("seed", F.xxhash64("html")).limit(sample)
    nodes = some.repartition(8).select(training_nodes("html", "seed").alias("t")).select(F.explode(F.arrays_zip("t.x", "t.y")).alias("t"))
    data = nodes.select(array_to_vector(F.col("t.x")).alias("features"), F.col("t.y").alias("label")).persist()
    if data.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1, cacheNodeIds=False).fit(data)
    data.unpersist()
    return [flatten(t) for t in model.trees], list(model.treeWeights)


def flatten(tree) -> tuple[list, list, list, list, list]:
    """A fitted tree as parallel arrays; a leaf has feature -1."""
    feature, threshold, left, right, value = [], [], [], [], []

    def add(node) -> int:
        i = len(feature)
        leaf = node.subtreeDepth() == 0
        feature.append(-1 if leaf else node.split().featureIndex())
        threshold.append(0.0 if leaf else node.split().threshold())
        value.append(node.prediction())
        left.append(i)
        right.append(i)
        if not leaf:
            left[i] = add(node.leftChild())
            right[i] = add(node.rightChild())
        return i

    add(tree._java_obj.rootNode())
    return feature, threshold, left, right, value


def probability(model, x: np.ndarray) -> np.ndarray:
    """Probability of main text for feature rows: the logistic of twice the weighted sum of trees."""
    total = np.zeros(len(x))
    row = np.arange(len(x))
    for (feature, threshold, left, right, value), weight in zip(*model, strict=True):
        feature, threshold, left, right, value = map(np.asarray, (feature, threshold, left, right, value))
        at = np.zeros(len(x), int)
        for _ in range(DEPTH):
            go = x[row, np.maximum(feature[at], 0)] <= threshold[at]
            at = np.where(go, left[at], right[at])
        total += weight * value[at]
    return 1 / (1 + np.exp(-2 * total))


def lines_of(blocks: list[tuple[int, str, int, bool]], keep: np.ndarray | None = None) -> str:
    """Kept blocks (all without ``keep``), those of one line in one paragraph."""
    out: list[str] = []
    last = at = -1
    gap = False
    for n, text, line, spaced in blocks:
        gap = spaced or gap and line == at
        at = line
        if keep is not None and not keep[n]:
            continue
        if line == last:
            out[-1] += " " * gap + text
        else:
            out.append(text)
        last, gap = line, False
    return "\n\n".join(out)


def main_texts(sources: list[str | None], model) -> list[str]:
    """Main text of each page; the trees see the nodes of many pages at once."""
    pages = [read_page(s) for s in sources]
    if model is None:
        return [lines_of(blocks) for _, blocks in pages]
    scores = probability(model, np.concatenate([node_features(nodes) for nodes, _ in pages])) if pages else []
    out, at = [], 0
    for nodes, blocks in pages:
        keep = decode(nodes, scores[at : at + len(nodes)])
        at += len(nodes)
        out.append(lines_of(blocks, keep))
    return out


def extract_main_text(pages: DataFrame, model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and text of every page."""

    @F.pandas_udf(StringType())
    def texts(sources: pd.Series) -> pd.Series:
        pages, some = sources.tolist(), range(0, len(sources), PAGES_AT_ONCE)
        return pd.Series([t for k in some for t in main_texts(pages[k : k + PAGES_AT_ONCE], model)], dtype=object)

    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), texts(F.col(html_col)).alias("text"))
