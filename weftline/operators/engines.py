"""Structured-data engines: long rows (page_id, engine, key, ord, value) from DOM nodes or raw HTML, and their merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.dom import inside, subtree_text, with_text
from weftline.sources.tables import stored

#: Engines by priority, and the confidence of each.
ENGINES = (("json_ld", 0.95), ("microdata", 0.85), ("opengraph", 0.75), ("twitter_cards", 0.70), ("heuristic", 0.50))
#: Extra engines by name: (priority, function of nodes or pages); see register_engine.
EXTRA: dict[str, tuple[int, object]] = {}


def register_engine(name: str, priority: int, fn) -> None:
    """Adds an engine: fn(pages, nodes) -> (page_id, key, ord, value) rows; merged after those of smaller priority."""
    EXTRA[name] = (priority, fn)


def _attr(name: str) -> Column:
    return F.col("attrs")[name]


def _eav(df: DataFrame, engine: str) -> DataFrame:
    return df.select("page_id", F.lit(engine).alias("engine"), "key", F.col("ord").cast("int").alias("ord"), "value")


def jsonld_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, ord, block): JSON-LD objects as text; arrays are flattened, @graph unwrapped, bad JSON skipped."""
    scripts = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_SCRIPTS), F.lit(1))).alias("s", "body"))
    body = F.trim("body")
    good = scripts.where(F.try_parse_json(body).isNotNull()).select("page_id", "s", body.alias("body"))
    listed = good.select("page_id", "s", F.posexplode(F.when(F.col("body").startswith("["), F.from_json("body", "array<string>")).otherwise(F.array("body"))).alias("i", "one"))
    graph = F.get_json_object("one", "$['@graph']")
    flat = listed.select("page_id", "s", "i", F.posexplode(F.when(F.coalesce(graph.startswith("["), F.lit(False)), F.from_json(graph, "array<string>")).otherwise(F.array("one"))).alias("j", "block"))
    return flat.where(F.col("block").startswith("{")).select("page_id", F.struct("s", "i", "j").alias("ord"), "block")


_SCRIPTS = r'(?is)<script[^>]*type=["\']application/ld\+json["\'][^>]*>(.*?)</script>'
_NONE = "array<string>"


def _elements(text: Column) -> Column:
    """The elements of a JSON array as texts; none where it is no array."""
    return F.coalesce(F.from_json(text, _NONE), F.array().cast(_NONE))


def page_blocks(html: Column) -> Column:
    """The blocks of jsonld_blocks of a page in their order, as one array: nothing is shuffled or joined for them."""
    opened = lambda x, test: F.when(F.coalesce(test.startswith("["), F.lit(False)), _elements(test)).otherwise(F.array(x))
    bodies = F.filter(F.transform(F.regexp_extract_all(html, F.lit(_SCRIPTS), F.lit(1)), lambda b: F.trim(b)), lambda b: F.try_parse_json(b).isNotNull())
    listed = F.flatten(F.transform(bodies, lambda b: opened(b, b)))
    flat = F.flatten(F.transform(listed, lambda one: opened(one, F.get_json_object(one, "$['@graph']"))))
    return F.filter(flat, lambda b: b.startswith("{"))


def _pairs(block: str) -> Column:
    """A JSON object's top-level (key, value text) pairs in their order."""
    return F.map_entries(F.from_json(block, "map<string,string>"))


def engine_jsonld(pages: DataFrame) -> DataFrame:
    """The pairs of each page's richest JSON-LD object (most non-null keys without @; the first wins)."""
    blocks = jsonld_blocks(pages).withColumn("n", F.size(F.filter(_pairs("block"), lambda p: ~p["key"].startswith("@") & p["value"].isNotNull())))
    best = blocks.groupBy("page_id").agg(F.min_by("block", F.struct(-F.col("n"), "ord")).alias("block"))
    pairs = best.select("page_id", F.posexplode(_pairs("block")).alias("ord", "p")).where("p.value is not null")
    return _eav(pairs.select("page_id", "ord", F.col("p.key").alias("key"), F.col("p.value").alias("value")), "json_ld")


def _texts(nodes: DataFrame, heads: Column, texts: DataFrame | None) -> DataFrame:
    """The heads with the texts of their subtrees: of those given, which may hold others too, or computed here."""
    return with_text(nodes, heads) if texts is None else texts.where(heads)


def element_values(nodes: DataFrame, heads: Column, texts: DataFrame | None = None) -> DataFrame:
    """Nodes with value: content, src, datetime, href or value attribute by tag, else the text of the subtree; '' is null."""
    found = _texts(nodes, heads, texts).withColumnRenamed("text", "_text")
    text = F.coalesce("_text", F.lit(""))
    value = (
        F.when(F.col("tag") == "meta", F.trim(_attr("content")))
        .when(F.col("tag") == "img", F.trim(F.coalesce(_attr("src"), _attr("data-src"))))
        .when(F.col("tag") == "time", F.coalesce(_attr("datetime"), text))
        .when(F.col("tag") == "link", F.trim(_attr("href")))
        .when(F.col("tag") == "data", F.coalesce(_attr("value"), text))
        .otherwise(text)
    )
    return found.withColumn("value", F.nullif(value, F.lit(""))).drop("_text")


def _has_itemprop() -> Column:
    return F.coalesce(_attr("itemprop") != "", F.lit(False))


def engine_microdata(nodes: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """itemprop pairs; values of a repeated property become a JSON list in document order."""
    found = element_values(nodes, _has_itemprop(), texts).where("value is not null")
    per = found.groupBy("page_id", _attr("itemprop").alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "value"))), lambda x: x["value"]).alias("v"), F.min("node_id").alias("ord"))
    return _eav(per.withColumn("value", F.when(F.size("v") == 1, F.get("v", F.lit(0))).otherwise(F.to_json("v"))), "microdata")


def _metas(nodes: DataFrame, attribute: str, prefix: str) -> DataFrame:
    content = F.trim(_attr("content"))
    metas = nodes.where((F.col("tag") == "meta") & _attr(attribute).startswith(prefix) & (content != ""))
    return metas.groupBy("page_id", _attr(attribute).alias("key")).agg(F.max_by(content, F.col("node_id")).alias("value"), F.min("node_id").alias("ord"))


def engine_opengraph(nodes: DataFrame) -> DataFrame:
    """og: properties; the last content of a property wins."""
    return _eav(_metas(nodes, "property", "og:"), "opengraph")


def engine_twitter(nodes: DataFrame) -> DataFrame:
    """twitter: names, and label1..9 with data1..9 as one JSON object under _labeled_pairs."""
    cards = _metas(nodes, "name", "twitter:")
    number = lambda kind: F.regexp_extract("key", rf"^twitter:{kind}([1-9])$", 1)
    sides = cards.withColumn("i", F.greatest(number("label"), number("data"))).where("i <> ''")
    both = sides.groupBy("page_id", "i").agg(F.max(F.when(F.col("key").startswith("twitter:label"), F.col("value"))).alias("label"), F.max(F.when(F.col("key").startswith("twitter:data"), F.col("value"))).alias("data")).where("label is not null and data is not null")
    last = both.groupBy("page_id", "label").agg(F.max_by("data", "i").alias("data"), F.min("i").alias("i"))
    pairs = last.groupBy("page_id").agg(F.to_json(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("i", "label", "data"))), lambda x: F.struct(x["label"], x["data"])))).alias("value"))
    return _eav(cards, "twitter_cards").union(_eav(pairs.select("page_id", F.lit("_labeled_pairs").alias("key"), F.lit(1 << 30).alias("ord"), "value"), "twitter_cards"))


def _head(cap: int | None) -> Column:
    return F.col("html") if cap is None else F.substring("html", 1, cap)


def engine_meta(pages: DataFrame, cap: int | None = None) -> DataFrame:
    """_page_title and meta:<name> pairs in either order of attributes (name first wins over content first; later over earlier),
    of a page's first cap characters or all."""
    head = _head(cap)
    title = pages.select("page_id", F.lit("_page_title").alias("key"), F.lit(0).alias("ord"), F.trim(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)).alias("value")).where("value <> ''")

    def found(pattern: str, name: int, content: int, rank: int) -> DataFrame:
        # one search of the page; what it finds is short, and is taken apart by the same pattern
        tags = pages.select("page_id", F.posexplode(F.regexp_extract_all(head, F.lit(pattern), F.lit(0))).alias("ord", "m"))
        rows = tags.select("page_id", F.lit(rank).alias("rank"), "ord", F.trim(F.regexp_extract("m", pattern, name)).alias("n"), F.trim(F.regexp_extract("m", pattern, content)).alias("value"))
        return rows.where((F.col("value") != "") & ~F.col("n").rlike("^(og:|twitter:)"))

    forth = found(r'(?i)<meta[^>]*name="([^"]+)"[^>]*content="([^"]*)"', 1, 2, 0)
    back = found(r'(?i)<meta[^>]*content="([^"]*)"[^>]*name="([^"]+)"', 2, 1, 1)
    best = forth.union(back).groupBy("page_id", "n").agg(F.min_by("value", F.struct("rank", F.when(F.col("rank") == 0, -F.col("ord")).otherwise(F.col("ord")))).alias("value"), F.min("ord").alias("ord"))
    metas = best.select("page_id", F.concat(F.lit("meta:"), "n").alias("key"), (F.col("ord") + 1).alias("ord"), "value")
    return _eav(title.union(metas), "heuristic")


def engine_label_value(pages: DataFrame, cap: int | None = None, longest: int | None = None) -> DataFrame:
    """text:<label> lines of label: value; the first of a label (in any case) wins. cap, longest: characters of a page and of a value, or all."""
    text = F.regexp_replace(_head(cap), "<[^>]+>", "\n")
    pattern = r"(?md)^\s*([A-Za-z0-9 _-]{2,40})\s*:\s*(.+)$"
    lines = pages.select("page_id", F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("ord", "m"))
    label, value = F.trim(F.regexp_extract("m", pattern, 1)), F.trim(F.regexp_extract("m", pattern, 2))
    rows = lines.select("page_id", "ord", label.alias("label"), (value if longest is None else F.substring(value, 1, longest)).alias("value")).where("length(value) >= 2")
    first = rows.groupBy("page_id", F.lower("label").alias("l")).agg(F.min_by(F.struct("label", "value", "ord"), "ord").alias("r"))
    return _eav(first.select("page_id", F.concat(F.lit("text:"), "r.label").alias("key"), F.col("r.ord").alias("ord"), F.col("r.value").alias("value")), "heuristic")


def engine_deflist(nodes: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """text:<dt> pairs of definition lists: a dd belongs to the dt just before it."""
    named = _texts(nodes, F.col("tag").isin("dt", "dd"), texts)
    lists = nodes.where("tag = 'dl'").select("page_id", F.col("node_id").alias("parent_id"))
    items = named.join(lists.hint("merge"), ["page_id", "parent_id"], "left_semi")
    before = Window.partitionBy("page_id", "parent_id").orderBy("node_id")
    pairs = items.withColumn("label", F.when(F.lag("tag").over(before) == "dt", F.lag("text").over(before))).where("tag = 'dd' and label <> '' and text <> ''")
    first = pairs.groupBy("page_id", "label").agg(F.min_by("text", "node_id").alias("value"), F.min("node_id").alias("ord"))
    return _eav(first.withColumn("key", F.concat(F.lit("text:"), "label")), "heuristic")


def engine_sections(nodes: DataFrame, most: int | None = None, texts: DataFrame | None = None) -> DataFrame:
    """text:<heading> - <label> pairs of list items under h2-h4 headings (50 characters at most), up to most a section, or all."""
    heads = _texts(nodes, F.col("tag").isin("h1", "h2", "h3", "h4"), texts)
    following = Window.partitionBy("page_id", "parent_id").orderBy("node_id")
    bounds = heads.withColumn("next_head", F.lead("node_id").over(following))
    sections = bounds.where(F.col("tag").isin("h2", "h3", "h4")).where("text <> '' and length(text) <= 50")
    sections = sections.select("page_id", "parent_id", F.col("node_id").alias("head"), "next_head", F.col("text").alias("section"))
    boxes = nodes.where(F.col("tag").isin("ul", "ol", "div", "dl")).select("page_id", "parent_id", F.col("node_id").alias("box"), "subtree_end")
    under = sections.join(boxes.hint("merge"), ["page_id", "parent_id"]).where("box > head and (next_head is null or box < next_head)")
    items = _texts(nodes, F.col("tag").isin("li", "div", "span", "dd"), texts)
    lines = items.select("page_id", "node_id", "text").where("length(text) > 3 and text like '%:%'")
    split = inside(under.select("page_id", F.col("head").alias("heading"), "section", F.col("box").alias("head"), "subtree_end"), lines, itself=False)
    pairs = split.select("page_id", F.col("heading").alias("head"), "section", "node_id", F.trim(F.substring_index("text", ":", 1)).alias("label"), F.trim(F.regexp_replace("text", "(?s)^[^:]*:", "")).alias("value")).where("label <> '' and value <> ''")
    keyed = pairs.withColumn("key", F.concat(F.lit("text:"), "section", F.lit(" - "), "label")).groupBy("page_id", "key").agg(F.min_by(F.struct("head", "value", "node_id"), "node_id").alias("r"))
    kept = keyed
    if most is not None:
        place = F.row_number().over(Window.partitionBy("page_id", "r.head").orderBy("r.node_id"))
        kept = keyed.withColumn("place", place).where(F.col("place") <= most)
    return _eav(kept.select("page_id", "key", F.col("r.node_id").alias("ord"), F.col("r.value").alias("value")), "heuristic")


def engine_heuristic(pages: DataFrame, nodes: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """All heuristic pairs; of equal keys the earlier source wins: meta, label lines, definition lists, sections."""
    parts = [engine_meta(pages), engine_label_value(pages), engine_deflist(nodes, texts), engine_sections(nodes, texts=texts)]
    ranked = reduce(DataFrame.union, [p.withColumn("rank", F.lit(i)) for i, p in enumerate(parts)])
    first = ranked.groupBy("page_id", "engine", "key").agg(F.min_by(F.struct("ord", "value"), F.struct("rank", "ord")).alias("r"))
    return first.select("page_id", "engine", "key", "r.ord", "r.value")


def extract(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """All engines' pairs, with the registered extra ones. The texts that several engines read are computed and stored once."""
    texts = stored(with_text(nodes, _has_itemprop() | F.col("tag").isin("dt", "dd", "h1", "h2", "h3", "h4", "li", "div", "span")), "texts")
    parts = [engine_jsonld(pages), engine_microdata(nodes, texts), engine_opengraph(nodes), engine_twitter(nodes), engine_heuristic(pages, nodes, texts)]
    parts += [_eav(fn(pages, nodes), name) for name, (_, fn) in EXTRA.items()]
    return reduce(DataFrame.union, parts)


def _priority() -> Column:
    names = [n for n, _ in ENGINES] + [n for n, _ in sorted(EXTRA.items(), key=lambda x: x[1][0])]
    return F.array_position(F.array(*[F.lit(n) for n in names]), F.col("engine"))


def merge_engines(eav: DataFrame) -> DataFrame:
    """(page_id, key, value, engine): per key the value of the first engine in priority."""
    best = eav.where("value is not null").groupBy("page_id", "key").agg(F.min_by(F.struct("value", "engine"), F.struct(_priority(), "ord")).alias("r"))
    return best.select("page_id", "key", "r.value", "r.engine")


def discoverable(eav: DataFrame) -> DataFrame:
    """(page_id, n_keys): distinct keys over all engines, one at least."""
    return eav.groupBy("page_id").agg(F.greatest(F.countDistinct("key"), F.lit(1)).alias("n_keys"))


def engine_confidence(eav: DataFrame) -> DataFrame:
    """(page_id, engine, n_fields, confidence): the engine's base times the share of the page's keys that it has, to 4 places."""
    per = eav.where("value is not null").groupBy("page_id", "engine").agg(F.countDistinct("key").alias("n_fields"))
    base = F.create_map(*[x for n, c in ENGINES for x in (F.lit(n), F.lit(c))])[F.col("engine")]
    joined = per.join(discoverable(eav).hint("merge"), "page_id")
    return joined.select("page_id", "engine", "n_fields", F.round(F.coalesce(base, F.lit(0.5)) * F.least(F.col("n_fields") / F.col("n_keys"), F.lit(1.0)), 4).alias("confidence"))


def page_result(eav: DataFrame, low: float = 0.40) -> DataFrame:
    """Per page: the contributing engines in priority order, the first one's confidence, a low flag and the number of fields."""
    merged = merge_engines(eav)
    used = merged.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(_priority().alias("p"), "engine"))), lambda x: x["engine"]), "+").alias("methods"), F.min_by("engine", _priority()).alias("engine"), F.count("*").alias("n_fields"))
    conf = engine_confidence(eav).select("page_id", "engine", "confidence")
    return used.join(conf.hint("merge"), ["page_id", "engine"]).select("page_id", "methods", "confidence", (F.col("confidence") < low).alias("low_confidence"), "n_fields")


def items_jsonld(pages: DataFrame) -> DataFrame:
    """(page_id, position, item): ItemList elements; without a list the largest group of objects of one @type, two or more."""
    typed = pages.select("page_id", page_blocks(F.col("html")).alias("b")).select("page_id", F.transform("b", lambda b: F.struct(F.get_json_object(b, "$['@type']").alias("type"), b.alias("block"))).alias("b"))
    item = lambda e, i: F.struct(F.coalesce(F.get_json_object(e, "$.position").try_cast("int"), i + 1).alias("position"), F.coalesce(F.get_json_object(e, "$.item"), e).alias("item"))
    lists = F.flatten(F.transform(F.filter("b", lambda x: x["type"] == "ItemList"), lambda x: F.transform(_elements(F.get_json_object(x["block"], "$.itemListElement")), item)))
    both = typed.select("page_id", lists.alias("listed"), F.filter("b", lambda x: x["type"] != "ItemList").alias("b")).withColumn("types", F.transform("b", lambda x: x["type"]))
    # the first of the types with the most objects
    counted = F.transform(F.array_distinct("types"), lambda t: F.struct(F.size(F.filter("types", lambda x: x == t)).alias("n"), (-F.array_position("types", t)).alias("at"), t.alias("type")))
    top = F.array_max(F.filter(counted, lambda c: c["n"] >= 2))["type"]
    both = both.withColumn("top", F.when(F.size("listed") == 0, top))
    grouped = F.transform(F.filter("b", lambda x: x["type"] == F.col("top")), lambda x, i: F.struct((i + 1).alias("position"), x["block"].alias("item")))
    return both.select("page_id", F.explode(F.when(F.size("listed") > 0, F.col("listed")).otherwise(grouped)).alias("r")).select("page_id", "r.position", "r.item")


def items_microdata(nodes: DataFrame) -> DataFrame:
    """(page_id, position, key, value): properties of the itemscopes of the page's largest itemtype, two or more scopes."""
    scopes = nodes.where(_attr("itemscope").isNotNull() & _attr("itemtype").isNotNull()).withColumn("type", _attr("itemtype"))
    top = scopes.groupBy("page_id", "type").agg(F.count("*").alias("n"), F.min("node_id").alias("first")).where("n >= 2").groupBy("page_id").agg(F.min_by("type", F.struct(-F.col("n"), "first")).alias("type"))
    kept = scopes.join(top.hint("merge"), ["page_id", "type"]).select("page_id", F.col("node_id").alias("head"), "subtree_end", F.row_number().over(Window.partitionBy("page_id").orderBy("node_id")).alias("position"))
    nodes = nodes.select("page_id", "node_id", "tag", "attrs", "own_text", "part_from", "part_to")
    props = element_values(nodes, _has_itemprop()).where("value is not null").withColumn("key", _attr("itemprop"))
    return inside(kept, props.select("page_id", "node_id", "key", "value"), itself=False).groupBy("page_id", "position", "key").agg(F.min_by("value", "node_id").alias("value"))


def fragment_fields(fragments: DataFrame, nodes: DataFrame, heading: int = 200) -> DataFrame:
    """(page_id, key, value): the fields of page fragments (page_id numbers a fragment) by the generic engines: heuristic, microdata,
    opengraph, then every JSON-LD object's keys; the first that has a key wins. A fragment without _page_title and name gets
    _fragment_title: the text of its first h2, else h3, h1, h4 or a, of 3 to heading - 1 characters.
    """
    pairs = jsonld_blocks(fragments).select("page_id", "ord", F.posexplode(_pairs("block")).alias("i", "p")).where("not startswith(p.key, '@') and p.value is not null")
    objects = pairs.groupBy("page_id", F.col("p.key").alias("key")).agg(F.min_by(F.struct("i", "p.value"), F.struct("ord", "i")).alias("r")).select("page_id", F.lit("json_ld").alias("engine"), "key", F.col("r.i").alias("ord"), "r.value")
    parts = [engine_heuristic(fragments, nodes), engine_microdata(nodes), engine_opengraph(nodes), objects]
    both = reduce(DataFrame.union, [p.where("value is not null").withColumn("rank", F.lit(i)) for i, p in enumerate(parts)])
    first = both.groupBy("page_id", "key").agg(F.min_by("value", F.struct("rank", "ord")).alias("value"))
    order = F.array_position(F.array(*[F.lit(t) for t in ("h2", "h3", "h1", "h4", "a")]), F.col("tag"))
    heads = nodes.where(F.col("tag").isin("h2", "h3", "h1", "h4", "a")).groupBy("page_id", "tag").agg(F.min("node_id").alias("node_id"))
    texts = subtree_text(nodes, F.col("tag").isin("h2", "h3", "h1", "h4", "a"))
    titles = heads.join(texts.hint("merge"), ["page_id", "node_id"]).where((F.length("text") > 2) & (F.length("text") < heading))
    titles = titles.groupBy("page_id").agg(F.min_by("text", order).alias("value"))
    named = first.where(F.col("key").isin("_page_title", "name") & (F.col("value") != "")).select("page_id").distinct()
    return first.union(titles.join(named.hint("merge"), "page_id", "left_anti").select("page_id", F.lit("_fragment_title").alias("key"), "value"))


def discover_fields(eav: DataFrame) -> DataFrame:
    """(page_id, keys): the sorted key inventory of a page over all engines."""
    return eav.groupBy("page_id").agg(F.array_sort(F.collect_set("key")).alias("keys"))


def extract_longest(first: DataFrame, again: DataFrame) -> DataFrame:
    """Of two extractions the longer value of each (page_id, key); the first wins a tie."""
    both = first.select("page_id", "key", "value", F.lit(1).alias("rank")).union(again.select("page_id", "key", "value", F.lit(0).alias("rank")))
    return both.groupBy("page_id", "key").agg(F.max_by("value", F.struct(F.length("value"), "rank")).alias("value"))
