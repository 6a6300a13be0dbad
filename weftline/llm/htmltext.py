"""HTML main-text extraction by minimum-cut labelling of text blocks.

A page becomes text blocks in page order (text between block-level tags; inline tags stay inside). Each block has two
kinds of evidence, both of the size of the edges so that neighbours can overrule it: the log-odds of a linear classifier of
text and DOM features (length, links, sentences, place), within CLIP, and a term for the markup around it (sectioning tags,
roles, words of class and id), of which the innermost that says something counts. Their sum is the block's terminal
capacity: towards the source if it speaks for content, towards the sink if for boilerplate. Neighbouring blocks and blocks
that are near in the DOM are joined by smoothness edges. The maximum flow separates content from boilerplate; blocks
whose own score outweighs all their edges are settled before, which never changes the minimum cut.

The classifier is logistic regression fitted here on at most SAMPLE pages (by hash of page_id). Sectioning tags give silver
labels, taken as wrong at a rate of NOISE, and are no features themselves; a penalty pulls towards documented prior weights,
so features that the sample lacks keep them. Pages are extracted in one pass without a shuffle.

Defined cases: null and empty pages give ''; a page without markup is one block of text; unclosed elements end with the
page, an unfinished tag at the end is dropped, one whose quotes don't close goes up to its >, a < that starts no tag is text; formulas are text; long pages are whole; repeated rows are
extracted one by one; other input columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import bounded_sample, text_table

#: Pages that the classifier is fitted on, at most.
SAMPLE = 1000
PENALTY = 50.0
#: Share of silver labels that is taken as wrong.
NOISE = 0.1

#: Element classes of HTML, and words of class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg object canvas audio video select annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins del kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br".split())
#: Elements of formulas, which are part of the text around them.
MATH = frozenset("math mrow mi mo mn ms mtext mspace mfrac msqrt mroot mstyle mpadded mphantom mfenced menclose merror msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics".split())
CONTENT_TAGS = frozenset("article main".split())
PLAIN_TAGS = frozenset("nav aside footer menu dialog button fieldset".split())
CONTENT_WORDS = frozenset("article content post entry main story body text".split())
COMMENT_WORDS = frozenset("comment comments commentlist respond responses replies reply discussion disqus".split())
PLAIN_WORDS = COMMENT_WORDS | frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner nav navbar navigation menu menus "
    "breadcrumb breadcrumbs footer header masthead sidebar aside rail widget widgets "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay share sharing social related recommended recommendations "
    "subscribe subscription newsletter signup login search pagination pager toolbar topbar copyright legal disclaimer toc form".split()
)
PLAIN_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
UNLESS = frozenset("has with without no not".split())

FEATURES = ("bias", "heading", "list_item", "link_share", "length", "sentence")
#: Log-odds for content before any data is seen, and the most that they count for.
PRIOR = np.array([-1.1, 0.3, -0.7, -3.0, 0.6, 0.5])
CLIP = 1.5
#: What the markup around a block says: nothing, content tag, plain tag, plain words, comments, hidden; and content words.
NEUTRAL, CONTENT, PLAIN, WORDED, COMMENTS, HIDDEN = range(6)
MARKUP = (0.0, 1.0, -2.5, -3.0, -4.0, -8.0)
GOOD_WORDS = 1.0
#: Smoothness of neighbours in one container, of other neighbours, and of the next blocks in a container or its parent.
NEXT_SAME, NEXT_OTHER, SAME_PARENT, NEAR_PARENT = 1.0, 0.3, 0.5, 0.25

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(>|$)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|$)", re.S)
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Element:
    __slots__ = ("tag", "says", "number", "parent")

    def __init__(self, tag: str, says: tuple[int, bool], number: int, parent: int):
        self.tag, self.says, self.number, self.parent = tag, says, number, parent


def _tokens(value: str) -> Iterator[set[str]]:
    """The words of each name in a class or id attribute."""
    for name in value.split():
        words = {w.lower() for w in _WORDS.findall(name)}
        if words and not words & UNLESS:
            yield words


def _says(tag: str, attributes: str, above: tuple[int, bool]) -> tuple[int, bool]:
    """What an element's markup says of the blocks in it, and whether content words do, given what the one above it says.

    Comments and what is hidden stay so all the way down. An article inside a navigation or a footer is part of that; inside
    an element that only its names call boilerplate, it is content. A name that mixes words (search-engines) counts against an
    element only where no name of the element is all content words.
    """
    kind, good = above
    if kind in (COMMENTS, HIDDEN):
        return above
    names: list[set[str]] = []
    role, hidden = "", False
    if len(attributes) > 3 and tag not in ("html", "body"):
        for m in _ATTR.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                names += _tokens(value)
            elif name == "role":
                role = value.lower()
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
                hidden = True
    if hidden:
        return HIDDEN, False
    content_name = any(w <= CONTENT_WORDS for w in names)
    article = tag in CONTENT_TAGS or role in ("main", "article")
    plain = [w for w in names if w & PLAIN_WORDS and (w <= PLAIN_WORDS or not content_name)]
    if tag in ("h1", "h2", "header") or kind == CONTENT or content_name:
        plain = [w for w in plain if w & PLAIN_WORDS != {"header"}]  # an article's own header holds its title
    if any(w & COMMENT_WORDS for w in plain) and not (article and content_name):
        return COMMENTS, False
    if article:
        return (kind, good) if kind == PLAIN else (CONTENT, good or content_name)
    if tag in PLAIN_TAGS or role in PLAIN_ROLES or (tag == "header" and kind != CONTENT):
        return PLAIN, False
    if plain:
        return (WORDED, False) if kind != PLAIN else above
    if tag == "form" and kind in (NEUTRAL, CONTENT):
        return WORDED, False
    return kind, good or (content_name and kind in (NEUTRAL, CONTENT))


class Block:
    __slots__ = ("text", "features", "says", "container", "parent")

    def __init__(self, text: str, features: list[float], says: tuple[int, bool], container: int, parent: int):
        self.text, self.features, self.says, self.container, self.parent = text, features, says, container, parent


def _behind(page: str, tag: str, at: int) -> int:
    """The place behind the end tag of an element whose content begins at a place, with elements of its kind inside."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(tag)}(?![\w-])[^>]*>", re.I).finditer(page, at):
        depth += -1 if m[1] else not m[0].endswith("/>")
        if not depth:
            return m.end()
    return len(page)


def blocks_of(page: str | None) -> list[Block]:
    """The text blocks of a page in order, with their features and places in the DOM."""
    if not page:
        return []
    out: list[Block] = []
    stack = [_Element("", (NEUTRAL, False), 0, 0)]
    parts: list[tuple[str, bool]] = []
    numbers = links = 0

    def close_block() -> None:
        nonlocal parts
        if parts:
            text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
            if text:
                linked = sum(len(p) for p, a in parts if a)
                top = stack[-1]
                words = text.count(" ") + 1
                share = linked / max(1, sum(len(p) for p, _ in parts))
                f = [1.0, float(top.tag in ("h1", "h2", "h3", "h4", "h5", "h6")), float(top.tag in ("li", "dt", "dd")), share, math.log1p(words), float(text[-1] in ".!?:;\"'”»…")]
                box = top
                at = len(stack) - 1
                while at > 0 and box.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "tr"):
                    at -= 1
                    box = stack[at]
                out.append(Block(text, f, top.says, box.number, box.parent))
            parts = []

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            parts.append((page[at:], links > 0))
            break
        if m.start() > at:
            parts.append((page[at : m.start()], links > 0))
        at = m.end()
        # the second form is a tag whose quotes don't close: it goes up to its >
        closing, tag, attributes, end_mark = m.group(1, 2, 3, 4) if m[2] else m.group(5, 6, 7, 8)
        if tag is None or not end_mark:
            continue
        tag = tag.lower()
        if tag in INLINE or tag in MATH:
            if tag == "a":
                links = max(0, links - 1) if closing else links + 1
            elif tag == "br":
                parts.append((" ", False))
            if not closing and attributes and tag not in VOID and _says(tag, attributes, (NEUTRAL, False))[0] == HIDDEN:
                at = _behind(page, tag, at)  # hidden inline text goes up to its own end tag
            continue
        if tag in RAW or tag == "head":
            if not closing and not attributes.endswith("/"):
                close_block()
                stop = re.compile(rf"</{re.escape(tag)}\s*>" + (r"|<body\b" if tag == "head" else ""), re.I).search(page, at)
                if tag == "head":
                    at = (stop.start() if stop[0].lower().startswith("<body") else stop.end()) if stop else at
                else:
                    at = stop.end() if stop else end
            continue
        close_block()
        links = 0
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in VOID:
            continue
        if stack[-1].tag == "p" or (stack[-1].tag == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
            del stack[-1]
        numbers += 1
        stack.append(_Element(tag, _says(tag, attributes, stack[-1].says), numbers, stack[-1].number))
    close_block()
    return out


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours in page order, and the next block of the container or of its parent."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            out.append((i - 1, i, NEXT_SAME if blocks[i - 1].container == b.container else NEXT_OTHER))
        for key, weight in ((b.container, SAME_PARENT), (b.parent, NEAR_PARENT)):
            j = last.get(key)
            if j is not None and j != i - 1:
                out.append((j, i, weight))
        last[b.container] = i
    return out


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source side of the minimum cut: capacity score from the source, or -score to the sink.

    Dinic's algorithm on the nodes that their own scores don't settle.
    """
    n = len(scores)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    pull, label = list(scores), [None] * n
    weight = [sum(w for _, w in x) for x in near]
    ready = [i for i in range(n) if abs(pull[i]) > weight[i]]
    while ready:
        i = ready.pop()
        if label[i] is not None:
            continue
        label[i] = pull[i] > 0
        for j, w in near[i]:
            if label[j] is None:
                pull[j] += w if label[i] else -w
                weight[j] -= w
                if abs(pull[j]) > weight[j]:
                    ready.append(j)
    open_ = [i for i in range(n) if label[i] is None]
    if not open_:
        return label
    place = {i: k for k, i in enumerate(open_)}
    s, t = len(open_), len(open_) + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(t + 1)]

    def add(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(forth)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in open_:
        if pull[i] > 0:
            add(s, place[i], pull[i], 0.0)
        elif pull[i] < 0:
            add(place[i], t, -pull[i], 0.0)
        for j, w in near[i]:
            if j > i and label[j] is None:
                add(place[i], place[j], w, w)
    tiny = 1e-9
    while True:
        level = [-1] * (t + 1)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            for i in open_:
                label[i] = level[place[i]] >= 0
            return label
        tried = [0] * (t + 1)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                push = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push
                for k, e in enumerate(path):
                    if cap[e] <= tiny:
                        a = to[e ^ 1]
                        del path[k:]
                        break
                continue
            while tried[a] < len(out[a]):
                e = out[a][tried[a]]
                if cap[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                tried[a] += 1
            else:
                if a == s:
                    break
                level[a] = -1
                e = path.pop()
                a = to[e ^ 1]
                tried[a] += 1
                continue
            path.append(e)
            a = to[e]


def scores_of(blocks: list[Block], weights: np.ndarray = PRIOR, silent: float = MARKUP[NEUTRAL]) -> list[float]:
    """The terminal capacity of each block: towards content if positive. silent: what markup counts for that says nothing."""
    own = np.clip(np.array([b.features for b in blocks]) @ weights, -CLIP, CLIP)
    return (own + np.array([(MARKUP[b.says[0]] or silent) + GOOD_WORDS * b.says[1] for b in blocks])).tolist()


def main_text(page: str | None, weights: np.ndarray = PRIOR) -> str:
    blocks = blocks_of(page)
    if not blocks:
        return ""
    kept = minimum_cut(scores_of(blocks, weights), edges_of(blocks))
    if not any(kept) and not any(b.says[0] > CONTENT for b in blocks):
        # nothing was found, and no markup calls anything boilerplate: its silence speaks for content
        kept = minimum_cut(scores_of(blocks, weights, MARKUP[CONTENT]), edges_of(blocks))
    return "\n".join(b.text for b, k in zip(blocks, kept, strict=True) if k)


def n_decided(page: str | None, weights: np.ndarray = PRIOR) -> int:
    """How many blocks of a page the cut labels other than their own scores would."""
    blocks = blocks_of(page)
    scores = scores_of(blocks, weights) if blocks else []
    return sum(k != (s > 0) for k, s in zip(minimum_cut(scores, edges_of(blocks)), scores, strict=True)) if blocks else 0


def _silver(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features (in tenths) and labels of blocks that a sectioning tag decides."""
    for batch in batches:
        rows, labels = [], []
        for page in batch.column(0).to_pylist():
            for b in blocks_of(page):
                if b.says[0] in (CONTENT, PLAIN):
                    rows.append([round(10 * x) for x in b.features])
                    labels.append(int(b.says[0] == CONTENT))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int64())), pa.array(labels, pa.int64())], names=["f", "label"])


def fitted_weights(pages: DataFrame, sample: int = SAMPLE, penalty: float = PENALTY) -> np.ndarray:
    """Logistic regression with a penalty towards PRIOR, on the counts of the sample's distinct feature rows."""
    # sample ids at most: a proven bound for the broadcast, and no page travels for the choice
    some = pages.select("page_id", "html").join(F.broadcast(bounded_sample(pages.select("page_id").distinct(), ["page_id"], sample)), "page_id").select("html")
    counts = some.mapInArrow(_silver, "f array<bigint>, label bigint").groupBy("f", "label").count().collect()
    w = PRIOR.copy()
    if not counts:
        return w
    x = np.array([r["f"] for r in counts], float) / 10
    y = np.array([r["label"] for r in counts], float) * (1 - 2 * NOISE) + NOISE
    n = np.array([r["count"] for r in counts], float)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + penalty * (w - PRIOR)
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def extracted(pages: DataFrame, weights: np.ndarray = PRIOR) -> DataFrame:
    """page_id, url and the main text of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, weights) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = text_table(spark, sf_dir, "pages")
    return extracted(pages, fitted_weights(pages)).withColumn("n_chars", F.length("text").cast("bigint"))
