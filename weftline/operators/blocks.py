"""DOM blocks and selector candidates of a page, from the node table."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.dom import inside, subtree_text, with_text
from weftline.sources.tables import stored

#: Words that attributes of a field's element may hold.
SYNONYMS = {
    "title": ("title", "name", "heading", "headline"),
    "year": ("year", "date", "release"),
    "rating": ("rating", "score", "vote", "aggregate"),
    "director": ("director", "filmmaker", "directed"),
    "genre": ("genre", "category", "type"),
    "synopsis": ("synopsis", "description", "overview", "summary", "plot"),
    "poster_url": ("poster", "image", "thumbnail", "cover", "artwork"),
    "cast": ("cast", "actor", "star", "credit"),
    "runtime_minutes": ("runtime", "duration", "length", "time"),
}
HEADINGS, SEMANTIC = ("h1", "h2", "h3", "h4"), ("section", "article", "aside", "main", "nav", "footer")


def _lines(df: DataFrame, keys: list[str], order: str, value: str, most: int | None) -> DataFrame:
    """One text per key: the first values in order (most, or all), a line each."""
    kept = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    kept = kept if most is None else kept.where(F.col("_n") <= most)
    return kept.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(value).alias("v")))), lambda x: x["v"]), "\n").alias("text"), F.min(order).alias("ord"))


def _numbered(df: DataFrame, most: int | None) -> DataFrame:
    """The first nodes of each page (most, or all), numbered from 0."""
    df = df.withColumn("_i", F.row_number().over(Window.partitionBy("page_id").orderBy("node_id")) - 1)
    return df if most is None else df.where(F.col("_i") < most)


def heading_blocks(nodes: DataFrame, texts: DataFrame, lines: int | None = None) -> DataFrame:
    """section:<heading> with the texts of the siblings up to the next heading."""
    w = Window.partitionBy("page_id", "parent_id").orderBy("node_id")
    is_head = F.col("tag").isin(*HEADINGS)
    under = nodes.withColumn("head", F.last(F.when(is_head, F.col("node_id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    named = texts.select("page_id", F.col("node_id").alias("head"), F.col("text").alias("title")).where("length(title) <= 120")
    content = under.where(~is_head & F.col("head").isNotNull()).join(texts.hint("merge"), ["page_id", "node_id"]).where("length(text) > 2").select("page_id", "head", "node_id", "text")
    joined = content.join(named.hint("merge"), ["page_id", "head"])
    return _lines(joined, ["page_id", "head", "title"], "node_id", "text", lines).select("page_id", F.concat(F.lit("section:"), "title").alias("key"), "ord", "text")


def table_blocks(nodes: DataFrame, texts: DataFrame, most: int | None = None, rows_of_each: int | None = None) -> DataFrame:
    """table:<i> with a line per row, cells parted by bars."""
    tables = _numbered(nodes.where("tag = 'table'"), most).select("page_id", F.col("node_id").alias("head"), "subtree_end", "_i")
    rows = inside(tables, nodes.where("tag = 'tr'").select("page_id", "node_id", F.col("subtree_end").alias("end"))).select("page_id", "_i", F.col("node_id").alias("head"), F.col("end").alias("subtree_end"))
    cells = nodes.where("tag in ('td', 'th')").join(texts.hint("merge"), ["page_id", "node_id"], "left").withColumn("cell", F.coalesce("text", F.lit("")))
    lines = inside(rows, cells.select("page_id", "node_id", "cell")).groupBy("page_id", "_i", F.col("head").alias("r")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "cell"))), lambda x: x["cell"]), " | ").alias("line"))
    return _lines(lines, ["page_id", "_i"], "r", "line", rows_of_each).select("page_id", F.concat(F.lit("table:"), F.col("_i").cast("string")).alias("key"), "ord", "text")


def deflist_blocks(nodes: DataFrame, texts: DataFrame, most: int | None = None) -> DataFrame:
    """deflist:<i> with label: value lines."""
    lists = _numbered(nodes.where("tag = 'dl'"), most).select("page_id", F.col("node_id").alias("parent_id"), "_i")
    items = nodes.where("tag in ('dt', 'dd')").join(lists.hint("merge"), ["page_id", "parent_id"]).join(texts.hint("merge"), ["page_id", "node_id"], "left")
    w = Window.partitionBy("page_id", "parent_id").orderBy("node_id").rowsBetween(1, Window.unboundedFollowing)
    pairs = items.withColumn("value", F.first(F.when(F.col("tag") == "dd", F.col("text")), ignorenulls=True).over(w)).where("tag = 'dt' and text <> '' and value <> ''")
    return _lines(pairs.withColumn("line", F.concat_ws(": ", "text", "value")), ["page_id", "_i"], "node_id", "line", None).select("page_id", F.concat(F.lit("deflist:"), F.col("_i").cast("string")).alias("key"), "ord", "text")


def list_blocks(nodes: DataFrame, texts: DataFrame, most: int | None = None, longest: int = 40) -> DataFrame:
    """list:<first label> with a label: value line per item of a list: the first and last span of an item, or its one span and the text besides."""
    lists = _numbered(nodes.where("tag in ('ul', 'ol')"), most).select("page_id", F.col("node_id").alias("parent_id"), "_i")
    items = nodes.where("tag = 'li'").join(lists.hint("merge"), ["page_id", "parent_id"]).select("page_id", "_i", F.col("node_id").alias("head"), "subtree_end")
    spans = nodes.where("tag = 'span'").select("page_id", "node_id").join(texts.hint("merge"), ["page_id", "node_id"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    per = inside(items, spans).groupBy("page_id", "_i", F.col("head").alias("node_id")).agg(F.min_by("text", "node_id").alias("label"), F.max_by("text", "node_id").alias("last"), F.count("*").alias("n"))
    full = per.join(texts.withColumnRenamed("text", "whole").hint("merge"), ["page_id", "node_id"])
    at = F.instr("whole", F.col("label"))
    rest = F.trim(F.concat(F.substring("whole", F.lit(1), at - 1), F.substring("whole", at + F.length("label"), F.length("whole"))))
    value = F.when(F.col("n") > 1, F.col("last")).when(F.length(rest) > 1, rest)
    lines = full.withColumn("value", value).where("label <> '' and value <> '' and (n = 1 or label <> value)").withColumn("line", F.concat_ws(": ", "label", "value"))
    first = lines.groupBy("page_id", "_i").agg(F.substring(F.trim(F.substring_index(F.min_by("label", "node_id"), ":", 1)), 1, longest).alias("name"))
    return _lines(lines, ["page_id", "_i"], "node_id", "line", None).join(first.hint("merge"), ["page_id", "_i"]).select("page_id", F.concat(F.lit("list:"), "name").alias("key"), "ord", "text")


def attribute_blocks(nodes: DataFrame, texts: DataFrame, ids_of_each: int | None = None, longest: int | None = None, longest_key: int | None = None) -> DataFrame:
    """testid:<id> and containers that are semantic or named by id, role or label (10 to 2000 characters)."""
    a = lambda n: F.nullif(F.coalesce(F.col("attrs")[n], F.lit("")), F.lit(""))
    full = nodes.join(texts.hint("merge"), ["page_id", "node_id"]).withColumn("n", F.length("text"))
    ids = _numbered(full.where(a("data-testid").isNotNull()), ids_of_each).where("n > 5 and n < 500").select("page_id", F.concat(F.lit("testid:"), a("data-testid")).alias("key"), F.col("node_id").alias("ord"), "text")
    named = F.when(a("aria-label").isNotNull(), F.concat("tag", F.lit(":"), a("aria-label"))).when(a("id").isNotNull(), F.concat("tag", F.lit(":"), a("id"))).when(a("role").isNotNull(), F.concat("tag", F.lit("[role="), a("role"), F.lit("]"))).when(F.col("tag").isin(*SEMANTIC), F.col("tag"))
    boxes = full.withColumn("key", named if longest_key is None else F.substring(named, 1, longest_key)).where("key is not null and n between 10 and 2000").select("page_id", "key", F.col("node_id").alias("ord"), "text")
    once = boxes.groupBy("page_id", "text").agg(F.min(F.struct("ord", "key")).alias("r")).select("page_id", "r.key", "r.ord", F.col("text") if longest is None else F.substring("text", 1, longest).alias("text"))
    return ids.withColumn("rank", F.lit(4)).union(once.withColumn("rank", F.lit(5)))


def dom_blocks(nodes: DataFrame, most: int | None = None, lines: int | None = None, tables: int | None = None, rows: int | None = None, ids: int | None = None, longest: int | None = None) -> DataFrame:
    """(page_id, key, text): sections, tables, definition lists, lists of labelled items, then identified containers of a text that is new; the first of a key.

    Up to most blocks a page, lines a section, tables and lists, rows a table, test ids, and characters of a container; all without.
    """
    texts = stored(subtree_text(nodes, F.col("depth") >= 0), "texts")
    kinds = [heading_blocks(nodes, texts, lines), table_blocks(nodes, texts, tables, rows), deflist_blocks(nodes, texts, tables), list_blocks(nodes, texts, None if tables is None else 2 * tables)]
    ranked = reduce(DataFrame.union, [*(k.select("page_id", "key", "ord", "text").withColumn("rank", F.lit(i)) for i, k in enumerate(kinds)), attribute_blocks(nodes, texts, ids, longest)])
    keyed = ranked.groupBy("page_id", "key").agg(F.min(F.struct("rank", "ord", "text")).alias("r")).select("page_id", "key", "r.*")
    same = F.row_number().over(Window.partitionBy("page_id", "text").orderBy("rank", "ord", "key"))
    once = keyed.withColumn("_same", same).where("rank < 5 or _same = 1")
    if most is not None:
        once = once.withColumn("_n", F.row_number().over(Window.partitionBy("page_id").orderBy("rank", "ord", "key"))).where(F.col("_n") <= most)
    return once.select("page_id", "key", "text")


def selector(tag: Column, attrs: Column) -> Column:
    """A CSS selector of an element by id, test id, class or tag."""
    first_class = F.substring_index(F.trim(attrs["class"]), " ", 1)
    return F.when(attrs["id"] != "", F.concat(tag, F.lit("#"), attrs["id"])).when(attrs["data-testid"] != "", F.concat(F.lit('[data-testid="'), attrs["data-testid"], F.lit('"]'))).when(attrs["class"] != "", F.concat(tag, F.lit("."), first_class)).otherwise(tag)


_NAME = re.compile(r"-?[A-Za-z_][\w-]*$")


#: Steps of a path, at most: elements that nest deeper in their own like have none.
MOST_STEPS = 32


def _named(tag: str, attrs: dict[str, str]) -> list[str]:
    """The selectors of a node by its id and its classes, where those are plain names."""
    ids = [attrs["id"]] if _NAME.match(attrs.get("id", "")) else []
    return [f"{tag}#{x}" for x in ids] + [f"{tag}.{x}" for x in dict.fromkeys(attrs.get("class", "").split()) if _NAME.match(x)]


def shortest_paths(parents: list[int], tags: list[str], nth: list[int], named: list[list[str]], most: int = MOST_STEPS) -> list[str | None]:
    """For each node of a page the shortest selector that selects it alone: its tag with an id or class, else a path of child steps, tags before
    tags with :nth-of-type. The paths of all nodes grow upwards together and are counted, and a node leaves when its path is its own.
    None where no path of up to most steps is."""
    counts = Counter(x for own in named for x in own)
    out: list[str | None] = [next((x for x in own if counts[x] == 1), None) for own in named]
    exact = [f"{t}:nth-of-type({i})" for t, i in zip(tags, nth, strict=True)]
    both: list[tuple[str, str] | None] = list(zip(tags, exact, strict=True))
    above = list(parents)  # the node above each path's first step
    open_ = [i for i, x in enumerate(out) if x is None]
    for _ in range(most):
        for kind in (0, 1):
            # every node that has so many steps counts, also those that have their selector already
            counts = Counter(p[kind] for p in both if p is not None)
            for i in open_:
                if out[i] is None and both[i] is not None and counts[both[i][kind]] == 1:
                    out[i] = both[i][kind]
        open_ = [i for i in open_ if out[i] is None and above[i] >= 0]
        if not open_:
            break
        wanted = {both[i][0] for i in open_}
        for i, p in enumerate(both):
            if p is None:
                continue
            if above[i] < 0 or p[0] not in wanted:  # too short for a longer path, or none that is still sought ends like it
                both[i] = None
                continue
            a = above[i]
            both[i] = (f"{tags[a]} > {p[0]}", f"{exact[a]} > {p[1]}")
            above[i] = parents[a]
    return out


def _paths(table: pa.Table) -> pa.Table:
    """shortest_paths of one page's nodes."""
    table = table.sort_by("node_id")
    parents, tags = table["parent_id"].to_pylist(), table["tag"].to_pylist()
    named = [_named(t, dict(a or ())) for t, a in zip(tags, table["attrs"].to_pylist(), strict=True)]
    seen: Counter = Counter()
    nth = []
    for p, t in zip(parents, tags, strict=True):
        seen[p, t] += 1
        nth.append(seen[p, t])
    return pa.table({"page_id": table["page_id"], "node_id": table["node_id"], "path": pa.array(shortest_paths(parents, tags, nth, named), pa.string())})


def selector_paths(nodes: DataFrame) -> DataFrame:
    """(page_id, node_id, path): a CSS selector of child steps that selects the node alone on its page, null if none of MOST_STEPS does. A group is a page."""
    return nodes.select("page_id", "node_id", "parent_id", "tag", "attrs").groupBy("page_id").applyInArrow(_paths, "page_id bigint, node_id int, path string")


def _by_meaning(field: str) -> tuple[Column, Column, float] | None:
    """Which elements stand for a field by their tag, what they say, and the score: times that hold a year, spans like 8.8 or 8/10, posters."""
    attr = lambda n: F.coalesce(F.col("attrs")[n], F.lit(""))
    if field == "year":
        year = F.trim(F.when(attr("datetime") != "", F.substring(attr("datetime"), 1, 4)).otherwise(F.col("text")))
        return (F.col("tag") == "time") & year.rlike(r"^(19|20)\d{2}$"), year, 0.85
    if field == "rating":
        return (F.col("tag") == "span") & F.col("text").rlike(r"^(\d\.?\d?\s*/\s*10|\d\.\d)$"), F.col("text"), 0.75
    if field in ("poster_url", "image"):
        return (F.col("tag") == "img") & (attr("src") != "") & (F.lower(attr("alt")).rlike("poster|cover|movie") | F.lower(attr("class")).rlike("poster")), attr("src"), 0.7
    return None


def selector_candidates(nodes: DataFrame, fields: dict[str, tuple[str, ...]] = SYNONYMS, most: int = 3, unique: bool = False, longest: int | None = None) -> DataFrame:
    """(page_id, field, rank, selector, sample, score): elements whose attributes name a field, itemprop first, the main heading, and
    the first element that stands for a field by its tag. unique: selectors that select their element alone, where it has one. longest: characters of a sample, or all.

    The few fields are an array inside the row, so the nodes are read once and nothing is joined.
    """
    # others than these match no field, so that most nodes need no text and meet no rule
    named = "(?i)" + "|".join(w for words in fields.values() for w in words)
    heads = reduce(Column.__or__, [F.coalesce(F.col("attrs")[a].rlike(named), F.lit(False)) for a in ("itemprop", "data-testid", "aria-label", "class")], F.col("tag").isin("h1", "time", "span", "img"))
    full = with_text(nodes.select("page_id", "node_id", "tag", "attrs", "own_text", "part_from", "part_to"), heads).withColumn("text", F.coalesce("text", F.lit("")))
    rows = []
    for field, words in fields.items():
        has = lambda a, p="(?i)" + "|".join(words): F.coalesce(F.col("attrs")[a].rlike(p), F.lit(False)) & (F.col("text") != "")
        score = F.when(has("itemprop"), 0.9).when(has("data-testid"), 0.8).when(has("aria-label"), 0.7).when(has("class"), 0.6)
        score = F.coalesce(score, F.when((F.col("tag") == "h1") & (F.col("text") != ""), 0.75)) if field == "title" else score
        means, says, least = _by_meaning(field) or (F.lit(False), F.lit(None).cast("string"), 0.0)
        rows.append(F.struct(F.lit(field).alias("field"), F.coalesce(score, F.when(means, least)).alias("score"), (score.isNull() & means).alias("meant"), F.when(score.isNull() & means, says).otherwise(F.col("text")).alias("sample")))
    own = selector(F.col("tag"), F.col("attrs"))
    if unique:
        full = full.join(selector_paths(nodes).hint("merge"), ["page_id", "node_id"], "left")
        own = F.coalesce("path", own)
    found = full.select("page_id", "node_id", own.alias("selector"), F.explode(F.array(*rows)).alias("f")).where("f.score is not null").select("page_id", "node_id", "selector", "f.*")
    first = F.min(F.when(F.col("meant"), F.col("node_id"))).over(Window.partitionBy("page_id", "field"))
    found = found.withColumn("_first", first).where("not meant or node_id = _first")
    once = found.groupBy("page_id", "field", "selector").agg(F.min(F.struct((-F.col("score")).alias("s"), "node_id", (F.col("sample") if longest is None else F.substring("sample", 1, longest)).alias("sample"))).alias("r"))
    rank = F.row_number().over(Window.partitionBy("page_id", "field").orderBy("r.s", "r.node_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= most).select("page_id", "field", "rank", "selector", "r.sample", (-F.col("r.s")).alias("score"))


def extract_items(jsonld: DataFrame, microdata: DataFrame, clusters: DataFrame) -> DataFrame:
    """The source of a page's items: (page_id, source, n) by confidence, then number; sources need two items or more.

    jsonld, microdata: page_id, position; clusters: page_id, n, quality (over 0.05 to count).
    """
    parts = [
        jsonld.groupBy("page_id").agg(F.count("*").alias("n")).select("page_id", F.lit("json_ld").alias("source"), "n", F.lit(0.95).alias("confidence")),
        microdata.groupBy("page_id").agg(F.countDistinct("position").alias("n")).select("page_id", F.lit("microdata").alias("source"), "n", F.lit(0.85).alias("confidence")),
        clusters.where("quality > 0.05").groupBy("page_id").agg(F.max_by("n", "quality").alias("n"), F.max("quality").alias("confidence")).select("page_id", F.lit("cluster").alias("source"), "n", "confidence"),
    ]
    both = reduce(DataFrame.union, parts).where("n >= 2")
    return both.groupBy("page_id").agg(F.max_by(F.struct("source", "n", "confidence"), F.struct("confidence", "n")).alias("r")).select("page_id", "r.*")
