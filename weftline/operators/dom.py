"""Pages as a table of DOM nodes, parsed once.

A subtree is an interval: nodes are numbered in document order, and subtree_end is the last one below a node. So the nodes in
chosen elements are found by spelling out the elements' numbers and joining on (page_id, node_id), and an element's text is a
slice of its page's texts, whose places come from the parse. Work and bytes are linear in the nodes, however deep they nest, plus what is asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.tables import FEW_ROWS, few, stored

#: Nodes of an Arrow batch, which bound what a worker holds besides a page's own.
NODES_AT_ONCE = 10_000
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SCHEMA = "page_id bigint, node_id int, parent_id int, depth int, tag string, attrs map<string,string>, own_text string, subtree_end int, part_from int, part_to int, text_len bigint"
#: Which open elements a start tag ends, up to the nearest of the elements behind them.
LISTS, ROWS = ("ul", "ol", "menu", "dl"), ("table", "thead", "tbody", "tfoot")
IMPLIED = {
    "li": (("li",), LISTS), "dt": (("dt", "dd"), LISTS), "dd": (("dt", "dd"), LISTS), "tr": (("tr", "td", "th"), ROWS), "td": (("td", "th"), ("tr", *ROWS)), "th": (("td", "th"), ("tr", *ROWS)),
    "option": (("option",), ("select", "datalist", "optgroup")), "optgroup": (("option", "optgroup"), ("select",)),
}
#: Block elements, which end an open paragraph; what a paragraph may lie in ends the search for one.
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
AROUND_P = ("button", "td", "th", "table", "li", "dd", "div", "section", "article", "body")


#: Plain tags, which are most: lower-case names, values in double quotes without references. All others go the parser's own way.
_START = re.compile(r'<([a-z][a-z0-9]*)((?: [a-z][a-z0-9:_-]*(?:="[^"&<>]*")?)*)>')
_ATTRIBUTE = re.compile(r' ([a-z][a-z0-9:_-]*)(?:="([^"]*)")?')
_END = re.compile(r"</([a-z][a-z0-9]*)>")
#: Elements whose content is text, which the parser reads in a mode of its own.
_RAW = frozenset("script style title textarea iframe noembed noframes noscript plaintext xmp".split())


class _Nodes(HTMLParser):
    """Open-element stack: an end tag closes its nearest open match, others are ignored. implied: start tags also end what they imply."""

    def __init__(self, implied: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []
        self.open: list[int] = []
        self.count: dict[str, int] = {}  # open elements by tag, so that an end tag without one is known at once
        self.implied = implied

    def parse_starttag(self, i: int) -> int:
        m = _START.match(self.rawdata, i)
        if m is None or m[1] in _RAW:
            return super().parse_starttag(i)
        self.lasttag = m[1]
        self.handle_starttag(m[1], _ATTRIBUTE.findall(m[2]) if m[2] else ())
        return m.end()

    def parse_endtag(self, i: int) -> int:
        m = _END.match(self.rawdata, i) if self.cdata_elem is None else None
        if m is None:
            return super().parse_endtag(i)
        self.handle_endtag(m[1])
        return m.end()

    def updatepos(self, i: int, j: int) -> int:
        return j  # lines and columns are not asked for

    def _imply(self, tag: str) -> None:
        ends, stops = IMPLIED.get(tag, (("p",), AROUND_P) if tag in BLOCKS else ((), ()))
        if not any(self.count.get(t) for t in ends):
            return
        at = None
        for i in range(len(self.open) - 1, -1, -1):
            above = self.nodes[self.open[i]][3]
            if above in ends:
                at = i
            elif above in stops:
                break
        if at is not None:
            self._close(at)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.implied:
            self._imply(tag)
        n = len(self.nodes)
        self.nodes.append([n, self.open[-1] if self.open else -1, len(self.open), tag, {k: v or "" for k, v in attrs}, [], n])
        if tag not in VOID:
            self.open.append(n)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(len(self.open) - 1)

    def _close(self, at: int) -> None:
        for n in self.open[at:]:
            self.nodes[n][6] = len(self.nodes) - 1
            self.count[self.nodes[n][3]] -= 1
        del self.open[at:]

    def handle_endtag(self, tag: str) -> None:
        if self.count.get(tag):
            i = len(self.open) - 1
            while self.nodes[self.open[i]][3] != tag:
                i -= 1
            self._close(i)

    def handle_data(self, data: str) -> None:
        if self.open:
            self.nodes[self.open[-1]][5].append(data)


def parsed(html: str | None, cap: int | None = None, implied: bool = False) -> Iterator[tuple]:
    """The nodes of a page in document order, as the columns of dom_nodes after page_id (attrs as pairs)."""
    p = _Nodes(implied)
    p.feed((html or "")[:cap])
    p.close()
    p._close(0)
    texts = ["".join(x[5]) for x in p.nodes]
    parts, chars = [0], [0]  # before each node: texts that hold something, and their characters
    for t in texts:
        n = len(t.strip(" "))
        parts.append(parts[-1] + (n > 0))
        chars.append(chars[-1] + n)
    for (n, parent, depth, tag, attrs, _, end), text in zip(p.nodes, texts, strict=True):
        yield n, parent, depth, tag, list(attrs.items()), text, end, parts[n], parts[end + 1], chars[end + 1] - chars[n]


def _parse(cap: int | None, implied: bool):
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    names = [x.split()[0] for x in SCHEMA.replace("map<string,string>", "map").split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        # attributes as offsets, names and values: three plain arrays instead of a list of pairs for each node
        offsets = list(accumulate(map(len, cols[5]), initial=0))
        attrs = pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([k for a in cols[5] for k, _ in a], pa.string()), pa.array([v for a in cols[5] for _, v in a], pa.string()))
        return pa.RecordBatch.from_arrays([attrs if i == 5 else pa.array(c, k) for i, (c, k) in enumerate(zip(cols, kinds, strict=True))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            # a page becomes a Python string when its turn comes, not a batch of pages at once
            for page, html in zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1)), strict=True):
                for node in parsed(html, cap, implied):
                    rows.append((page, *node))
                    if len(rows) > NODES_AT_ONCE:
                        yield batch_of(rows)
                        rows = []
        if rows:
            yield batch_of(rows)

    return run


def dom_nodes(pages: DataFrame, cap: int | None = None, implied_ends: bool = False) -> DataFrame:
    """A row per element in document order: node_id, parent_id (-1: none), depth, tag, attrs, own text, the last node of its
    subtree, and which of the page's texts lie in it, from part_from to before part_to, with text_len characters.

    cap: characters of a page that are parsed (none: all). implied_ends: a start tag also ends what it implies, as browsers have
    it (li, dt, dd, tr, td, th, option, and p before blocks), so that unclosed items are siblings and don't nest.
    """
    return pages.select("page_id", "html").mapInArrow(_parse(cap, implied_ends), SCHEMA)


def inside(heads: DataFrame, nodes: DataFrame, itself: bool = True) -> DataFrame:
    """The nodes (page_id, node_id, more) that lie in heads (page_id, head, subtree_end, more): a row for each pair. itself: a head lies in itself."""
    first = F.col("head") if itself else F.col("head") + 1
    numbers = heads.where(first <= F.col("subtree_end")).withColumn("node_id", F.explode(F.sequence(first, F.col("subtree_end")))).drop("subtree_end")
    return numbers.join(nodes.hint("merge"), ["page_id", "node_id"])


def outermost(heads: DataFrame) -> DataFrame:
    """Those of heads (page_id, head, subtree_end) that lie in no other."""
    before = Window.partitionBy("page_id").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    return heads.withColumn("_end", F.max("subtree_end").over(before)).where("_end is null or head > _end").drop("_end")


def with_text(nodes: DataFrame, heads: Column) -> DataFrame:
    """The heads with text: the stripped text parts of their subtrees, in order, joined without a separator; null where there are none.

    The order is document order of the elements that hold the text. A page's texts and heads are gathered in one pass, and each head takes its slice.
    """
    own = F.trim("own_text")
    parts = F.transform(F.sort_array(F.collect_list(F.when(own != "", F.struct("node_id", own.alias("t"))))), lambda x: x["t"])
    row = F.struct(*[c for c in nodes.columns if c != "page_id"])
    pages = nodes.where(heads | (own != "")).groupBy("page_id").agg(parts.alias("parts"), F.collect_list(F.when(heads, row)).alias("heads"))
    each = pages.where(F.size("heads") > 0).select("page_id", "parts", F.explode("heads").alias("h"))
    first, end = F.col("h.part_from"), F.col("h.part_to")
    text = F.when(end > first, F.array_join(F.slice("parts", first + 1, end - first), ""))
    return each.select(*[F.col(c) if c == "page_id" else F.col("h")[c].alias(c) for c in nodes.columns], text.alias("text"))


def subtree_text(nodes: DataFrame, heads: Column) -> DataFrame:
    """page_id, node_id and text of the heads whose subtree has text, as with_text."""
    return with_text(nodes, heads & (F.col("part_to") > F.col("part_from"))).select("page_id", "node_id", "text")


def tag_census(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


def subtree_signature(nodes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Every node with sig: its tag and its children's tags with up to five grandchildren each, sorted at both levels. of: the nodes asked for, or all."""
    narrow = nodes.select("page_id", "node_id", "parent_id", "tag")
    if of is None:
        of, below = nodes, narrow
        kids = narrow
    else:
        # only the children and grandchildren of those asked for are read on
        of = few(of, "of")
        kids = few(narrow.join(of.select("page_id", F.col("node_id").alias("parent_id")), ["page_id", "parent_id"], "left_semi"), "kids")
        below = narrow.join(kids.select("page_id", F.col("node_id").alias("parent_id")), ["page_id", "parent_id"], "left_semi")
    inner = below.groupBy("page_id", F.col("parent_id").alias("node_id")).agg(F.array_join(F.slice(F.sort_array(F.collect_list("tag")), 1, 5), ",").alias("inner"))
    spelled = kids.join(inner.hint("merge"), ["page_id", "node_id"], "left").select("page_id", F.col("parent_id").alias("node_id"), F.concat("tag", F.lit("["), F.coalesce("inner", F.lit("")), F.lit("]")).alias("one"))
    both = spelled.groupBy("page_id", "node_id").agg(F.array_join(F.sort_array(F.collect_list("one")), ",").alias("below"))
    return of.join(both.hint("merge"), ["page_id", "node_id"], "left").withColumn("sig", F.concat("tag", F.lit("("), F.coalesce("below", F.lit("")), F.lit(")"))).drop("below")


def _bare_parents(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("tag").isin("head", "script", "style", "noscript")).select("page_id", F.col("node_id").alias("parent_id"))


def repeating_groups(nodes: DataFrame, least: int = 3, signed: DataFrame | None = None) -> DataFrame:
    """(page_id, parent_id, sig, n, first_node, depth): siblings of one signature, least or more, outside head, script and the like.

    signed: the nodes' signatures, where they are there already.
    """
    signed = subtree_signature(nodes) if signed is None else signed
    groups = signed.where("parent_id >= 0").groupBy("page_id", "parent_id", "sig").agg(F.count("*").alias("n"), F.min("node_id").alias("first_node"), F.min("depth").alias("depth"))
    return groups.where(F.col("n") >= least).join(_bare_parents(nodes).hint("merge"), ["page_id", "parent_id"], "left_anti")


def cluster_members(nodes: DataFrame, least: int = 3) -> DataFrame:
    """(page_id, cluster, position, node_id, subtree_end, depth, n, text_len): the members of each repeating group in order.

    Members of a group have one tag, so only nodes with so many siblings of their tag get a signature.
    """
    twins = nodes.where("parent_id >= 0").groupBy("page_id", "parent_id", "tag").count().where(F.col("count") >= least).drop("count")
    twins = few(twins.join(_bare_parents(nodes).hint("merge"), ["page_id", "parent_id"], "left_anti"), "twins")
    asked = nodes.select("page_id", "parent_id", "tag", "node_id", "subtree_end", "depth", "text_len").join(twins, ["page_id", "parent_id", "tag"], "left_semi")
    signed = stored(subtree_signature(nodes, asked).select("page_id", "parent_id", "sig", "node_id", "subtree_end", "depth", "text_len"), "signed")
    groups = signed.groupBy("page_id", "parent_id", "sig").agg(F.count("*").alias("n"), F.min("node_id").alias("cluster")).where(F.col("n") >= least)
    members = signed.join(groups.hint("merge"), ["page_id", "parent_id", "sig"])
    place = F.row_number().over(Window.partitionBy("page_id", "cluster").orderBy("node_id"))
    return members.select("page_id", "cluster", place.alias("position"), "node_id", "subtree_end", "depth", "n", "text_len")


def rank_clusters(nodes: DataFrame, top: int = 5) -> DataFrame:
    """The clusters of each page by depth times size times mean text length; short-text ones (under 10 on average) are out."""
    # of a member's text only the length is asked for, which its node has
    scored = cluster_members(nodes).groupBy("page_id", "cluster").agg(F.avg("text_len").alias("avg_text"), F.avg("depth").alias("avg_depth"), F.count("*").alias("n")).where("avg_text >= 10")
    scored = scored.withColumn("quality", F.col("avg_depth") * F.col("n") * F.col("avg_text"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("quality"), "cluster"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top)


def _first_of(values: Column, most: int | None) -> Column:
    return values if most is None else F.slice(values, 1, most)


def cluster_items(nodes: DataFrame, snippets: int | None = None, most_numbers: int | None = None) -> DataFrame:
    """An item per cluster member: heading, first link, first image, text snippets, distinct numbers, labelled pairs; up to so many, or all."""
    members = stored(cluster_members(nodes).select("page_id", "cluster", "position", F.col("node_id").alias("head"), "subtree_end", "n"), "members")
    spelled = members.select(F.coalesce(F.sum(F.col("subtree_end") - F.col("head") + 1), F.lit(0)).alias("n")).first()["n"]
    members = F.broadcast(members) if spelled <= FEW_ROWS else members
    # what an item shows is in its nodes with a text, links, images and properties; others are not joined
    telling = (F.trim("own_text") != "") | F.col("tag").isin("a", "img") | F.col("attrs")["itemprop"].isNotNull()
    below = inside(members, nodes.where(telling).select("page_id", "node_id", "tag", "attrs", "own_text"))
    t, low = F.trim("own_text"), F.col("tag")
    heading, link, image = low.isin("h1", "h2", "h3", "h4", "h5", "h6") & (t != ""), low == "a", low == "img"
    first = lambda value, when: F.min_by(F.when(when, value), F.when(when, F.col("node_id")))
    src = F.coalesce(F.col("attrs")["src"], F.col("attrs")["data-src"])
    ordered = lambda value, when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("node_id", value.alias("v"))))), lambda x: x["v"])
    pair = t.rlike(r"^[^:]{2,40}:\s*\S")
    items = below.groupBy("page_id", "cluster", "position", "n").agg(
        first(t, heading).alias("heading"),
        first(t, link & (t != "")).alias("link_text"),
        first(F.col("attrs")["href"], link & F.col("attrs")["href"].isNotNull()).alias("link_href"),
        first(src, image & src.isNotNull()).alias("image_src"),
        _first_of(ordered(t, t != ""), snippets).alias("snippets"),
        F.to_json(ordered(t, pair)).alias("pairs"),
        F.count_if(F.col("attrs")["itemprop"].isNotNull()).alias("n_itemprops"),
    )
    numbers = _first_of(F.array_distinct(F.regexp_extract_all(F.array_join("snippets", " "), F.lit(r"\b(\d+(?:\.\d+)?)\b"), F.lit(1))), most_numbers)
    return items.withColumn("numbers", numbers).where("heading is not null or link_text is not null")


def cluster_quality(items: DataFrame) -> DataFrame:
    """Quality of each cluster from 0 to 1: number of items, richness, different headings, their length."""
    filled = sum((F.when(c, 1).otherwise(0) for c in (F.coalesce(F.col("heading") != "", F.lit(False)), F.coalesce(F.col("link_text") != "", F.lit(False)), F.coalesce(F.col("image_src") != "", F.lit(False)), F.size("numbers") > 0, F.col("pairs") != "[]", F.col("n_itemprops") > 0)), F.lit(0))
    name = F.coalesce("heading", "link_text", F.lit(""))
    per = items.withColumn("_filled", filled).withColumn("_name", name).groupBy("page_id", "cluster").agg(
        F.count("*").alias("n"), F.avg("_filled").alias("rich"), F.countDistinct(F.when(F.trim("_name") != "", F.lower(F.trim("_name")))).alias("names"), F.coalesce(F.avg(F.when(F.col("_name") != "", F.length("_name"))), F.lit(0.0)).alias("len")
    )
    score = F.least(F.col("n") / 10, F.lit(1.0)) * 0.25 + F.least(F.col("rich") / 6, F.lit(1.0)) * 0.35 + F.col("names") / F.col("n") * 0.2 + F.least(F.greatest(F.col("len") - 5, F.lit(0.0)) / 30, F.lit(1.0)) * 0.2
    return per.select("page_id", "cluster", "n", F.round(score, 4).alias("quality"))


def best_cluster(nodes: DataFrame, least_quality: float = 0.05) -> DataFrame:
    """The items of each page's best cluster (two items or more, above the least quality; the earlier wins a tie)."""
    items = cluster_items(nodes)
    scored = cluster_quality(items).where((F.col("n") >= 2) & (F.col("quality") > least_quality))
    best = scored.groupBy("page_id").agg(F.max_by("cluster", F.struct("quality", -F.col("cluster"))).alias("cluster"))
    return items.join(best.hint("merge"), ["page_id", "cluster"])
