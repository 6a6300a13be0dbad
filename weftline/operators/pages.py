"""Page-level signals straight from the HTML column: profiles, links, triggers, search pages, cleaned HTML, Markdown."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import visible_text
from weftline.functions.urls import abs_url, netloc, path, registrable_domain
from weftline.operators.dom import inside, outermost, subtree_text

#: Link labels and path segments of site-wide navigation, attributes that cleaned HTML keeps, what Markdown leaves out.
STOP_LABELS = ("home", "menu", "search", "login", "sign in", "register", "about", "contact", "privacy", "terms", "help", "faq", "settings", "close", "back", "next", "more")
SITE_SEGMENTS = (
    "/chart/", "/calendar/", "/news/", "/showtimes/", "/interest/", "/trailers/", "/originals/", "/whats-on-tv/", "/what-to-watch/", "/awards/", "/event/", "/poll/", "/registration/", "/ap/", "/preferences/", "/search/",
)
KEPT_ATTRIBUTES = ("href", "src", "data-src", "class", "data-testid", "aria-label", "alt", "title", "datetime", "type", "itemprop", "itemscope", "itemtype", "property", "content")
JUNK_TAGS = ("script", "style", "head", "title", "noscript", "svg", "iframe", "form", "button", "nav", "footer", "aside")
JUNK_CLASSES = (
    "navbox", "sidebar", "reflist", "references", "catlinks", "printfooter", "mw-footer", "mw-editsection", "noprint", "mw-empty-elt", "sistersitebox", "vector-header-container", "vector-sticky-header",
    "ad-slot", "ad-container", "ad-wrapper", "ad_", "sponsor", "promoted", "cookie-banner", "cookie-consent", "gdpr", "social-share", "share-bar", "share-buttons", "newsletter-signup", "subscribe-banner", "breadcrumb",
)
JUNK_IDS = ("toc", "catlinks", "References", "toc-References", "External_links", "toc-External_links", "See_also", "toc-See_also", "mw-navigation", "footer")


def tag_text(html: Column, tag: str, n: int | None = None) -> Column:
    """The content of the first element of a tag, or its first n characters."""
    content = F.trim(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1))
    return content if n is None else F.substring(content, 1, n)


def _squeezed(html: Column) -> Column:
    return F.trim(F.regexp_replace(visible_text(html, ""), r"\s+", " "))


def _first(values: Column, most: int | None) -> Column:
    return values if most is None else F.slice(values, 1, most)


def page_links(pages: DataFrame, longest: int | None = None) -> DataFrame:
    """(page_id, ord, href, label): anchors in order, the label without tags, whole or its first longest characters."""
    pattern = r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)).alias("h"), F.regexp_extract_all("html", F.lit(pattern), F.lit(2)).alias("t"))
    return pages.select("page_id", F.posexplode(both).alias("ord", "m")).select("page_id", "ord", F.col("m.h").alias("href"), (F.trim(visible_text(F.col("m.t"), "")) if longest is None else F.substring(F.trim(visible_text(F.col("m.t"), "")), 1, longest)).alias("label"))


def page_profile(pages: DataFrame, most: int | None = None) -> DataFrame:
    """Title, h1s (up to most, or all), counts of links and images, and whether there is JSON-LD."""
    h1 = F.transform(_first(F.regexp_extract_all("html", F.lit("(?is)<h1[^>]*>(.*?)</h1>"), F.lit(1)), most), lambda x: F.trim(visible_text(x, "")))
    return pages.select(
        "page_id", tag_text(F.col("html"), "title").alias("title"), F.array_join(h1, " | ").alias("h1s"),
        F.regexp_count("html", F.lit(r"(?i)<a\s")).cast("bigint").alias("n_links"), F.regexp_count("html", F.lit(r"(?i)<img\b")).cast("bigint").alias("n_images"), F.contains("html", F.lit("application/ld+json")).alias("has_jsonld"),
    )


def escalation(html: Column) -> Column:
    """Which trigger asks for a rendered page; null if none."""
    text = F.length(_squeezed(html))
    body = F.regexp_extract(html, r"(?is)<body[^>]*>(.*?)</body>", 1)
    has_body = html.rlike(r"(?is)<body[^>]*>.*?</body>")
    return (
        F.when(F.length(html) < 5000, "small")
        .when(~F.contains(html, F.lit("application/ld+json")) & (F.length(html) < 50_000), "no_jsonld")
        .when(html.rlike(r'(?i)<div\s+id="(root|__next|app)"') & (text < 500), "spa_shell")
        .when((F.contains(html, F.lit("data-reactroot")) | F.contains(html, F.lit("data-server-rendered"))) & (text < 1000), "hydration")
        .when(has_body & (F.length(_squeezed(body)) < 200) & (F.regexp_count(F.lower(html), F.lit("<script")) > 5), "empty_body")
    )


def is_search_page(url: Column, html: Column, most: int | None = None) -> Column:
    """A search URL whose page says so in title or headings (up to most of them, or all), or has no JSON-LD and more than 15 links."""
    words = "search|find|results"
    h1 = F.array_join(_first(F.regexp_extract_all(html, F.lit("(?is)<h1[^>]*>(.*?)</h1>"), F.lit(1)), most), " ")
    dense = ~F.contains(html, F.lit('<script type="application/ld+json">')) & (F.regexp_count(F.lower(html), F.lit("<a ")) > 15)
    return F.lower(url).rlike(r"[/\?](search|find|query|results)[/\?=&]") & (F.lower(tag_text(html, "title")).rlike(words) | F.lower(visible_text(h1, "")).rlike(words) | dense)


def site_signals(pages: DataFrame, cap: int | None = None, most: int | None = None) -> DataFrame:
    """Headings, schema types, search capability and first path segments of links; cap, most: characters of a page that are read and headings, or all."""
    head = F.col("html") if cap is None else F.substring("html", 1, cap)
    heads = F.transform(F.regexp_extract_all(head, F.lit("(?is)<h[1-3][^>]*>(.*?)</h[1-3]>"), F.lit(1)), lambda x: F.trim(visible_text(x, "")))
    heads = heads if most is None else F.slice(heads, 1, most)
    types = F.array_distinct(F.regexp_extract_all(head, F.lit(r'"@type"\s*:\s*"([^"]+)"'), F.lit(1)))
    first = F.array_sort(F.array_distinct(F.regexp_extract_all(head, F.lit(r'href="(/[^"/?#]+)/'), F.lit(1))))
    return pages.select("page_id", heads.alias("headings"), types.alias("schema_types"), head.rlike(r'(?i)type="search"|name="q"|role="search"').alias("has_search"), first.alias("link_patterns"))


def relevance_hint(queries: DataFrame, signals: DataFrame) -> DataFrame:
    """Per query and page of its request: 0.8 of the share of keywords in the headings plus 0.2 for schema types, to 3 places."""
    both = queries.join(signals.hint("merge"), "page_id")
    text = F.lower(F.array_join("headings", " "))
    found = F.size(F.filter("keywords", lambda k: F.contains(text, F.lower(k)))) / F.greatest(F.size("keywords"), F.lit(1))
    return both.withColumn("hint", F.round(F.least(F.lit(1.0), found * 0.8 + F.when(F.size("schema_types") > 0, 0.2).otherwise(0.0)), 3))


#: Path parts of detail pages, and of pages that are none though their path is long.
DETAIL_PARTS = ("/title/", "/movie/", "/film/", "/movies/", "/m/", "/tv/", "/series/", "/show/")
OTHER_PARTS = ("/search", "/find", "/login", "/register", "/api/")


def is_detail_link(href: Column) -> Column:
    """A link that looks like a detail page: a known part, or two plain path segments that are no search, sign-in or interface."""
    low = F.lower(href)
    known = reduce(Column.__or__, [F.contains(low, F.lit(p)) for p in DETAIL_PARTS])
    other = reduce(Column.__or__, [F.contains(low, F.lit(p)) for p in OTHER_PARTS])
    return known | (low.rlike(r"^/[a-z0-9\-]+/[a-z0-9\-]+") & ~other)


def resolve_entity(pages: DataFrame) -> DataFrame:
    """The best detail link of a search page for a title and year: title words of three letters or more in label or target, two more for the
    year; of equal ones the first. pages: page_id, url, html, title, year. Targets are absolute or begin with /."""
    links = page_links(pages).where("href like '/%' or lower(href) like 'http%'").where(is_detail_link(F.col("href")))
    df = links.join(pages.select("page_id", "url", "title", "year").hint("merge"), "page_id")
    words = F.filter(F.split(F.lower("title"), r"\W+"), lambda w: F.length(w) > 2)
    text = F.lower(F.concat_ws(" ", "label", "href"))
    score = F.size(F.filter(words, lambda w: F.contains(text, w))) + F.when(F.contains(text, F.col("year").cast("string")), 2).otherwise(0)
    return df.withColumn("score", score).where("score > 0").groupBy("page_id").agg(F.max_by(F.struct(abs_url(F.col("url"), F.col("href")).alias("entity_url"), "score"), F.struct("score", -F.col("ord"))).alias("r")).select("page_id", "r.*")


def content_links(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page_id, node_id, url, target, label): links to other pages of the same registrable domain that are content.

    Out are links without a label or target, stop labels, links inside nav, header, footer or role=navigation, targets with a site-wide path segment and links to the page itself.
    """
    href = F.col("attrs")["href"]
    a = nodes.where("tag = 'a'").withColumn("href", href).where("href <> '' and href not like '#%' and lower(href) not like 'javascript:%'")
    menus = nodes.where(F.col("tag").isin("nav", "header", "footer") | F.coalesce(F.col("attrs")["role"] == "navigation", F.lit(False))).select("page_id", F.col("node_id").alias("head"), "subtree_end")
    menu_links = inside(outermost(menus), a.select("page_id", "node_id")).select("page_id", "node_id")
    labels = subtree_text(nodes, F.col("tag") == "a").withColumnRenamed("text", "label")
    shown = a.select("page_id", "node_id", "href").join(menu_links.hint("merge"), ["page_id", "node_id"], "left_anti").join(labels.hint("merge"), ["page_id", "node_id"])
    df = shown.where(~F.lower("label").isin(*STOP_LABELS)).join(pages.select("page_id", "url").hint("merge"), "page_id").withColumn("target", abs_url(F.col("url"), F.col("href")))
    wide = F.exists(F.array(*[F.lit(x) for x in SITE_SEGMENTS]), lambda x: F.contains(path(F.col("target")), x))
    bare = lambda c: F.regexp_replace(c, "/+$", "")
    same = registrable_domain(netloc(F.col("target"))) == registrable_domain(netloc(F.col("url")))
    return df.where(same & ~wide & (bare("target") != bare("url"))).select("page_id", "node_id", "url", "target", "label")


def discover_navigation(pages: DataFrame, nodes: DataFrame, most: int | None = None) -> DataFrame:
    """Content links once per URL (with or without a slash at its end), those under the page's own path first; up to most a page, or all."""
    links = content_links(pages, nodes)
    under = F.startswith(path(F.col("target")), F.regexp_replace(path(F.col("url")), "/+$", ""))
    once = links.groupBy("page_id", F.regexp_replace("target", "/+$", "").alias("bare")).agg(F.min(F.struct((~under).alias("away"), "node_id", "target", "label")).alias("r"))
    df = once.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy("r.away", "r.node_id"))).select("page_id", "rank", "r.target", "r.label")
    return df if most is None else df.where(F.col("rank") <= most)


_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Cleaner(HTMLParser):
    """A page's markup without styles, SVG, noscript, links, scripts other than JSON-LD and metas of the head; only kept attributes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.front: dict[str, list[str]] = {"ld": [], "og": []}
        self.title: list[str] = []
        self.skip: str | None = None
        self.depth = 0
        self.in_head = self.in_title = False
        self.block: list[str] | None = None
        self.html, self.lines = "", [0]

    def feed(self, data: str) -> None:
        self.lines += [len(self.html) + m.end() for m in re.finditer("\n", data)]
        self.html += data
        super().feed(data)

    def _put(self, text: str) -> None:
        if self.block is not None:
            self.block.append(text)
        if not self.skip:
            self.out.append(text)

    def handle_starttag(self, tag: str, attrs: list, closed: bool = False) -> None:
        if self.skip:
            self.depth += tag == self.skip and not closed
            return
        found = dict(attrs)
        kept = "".join(f' {k}="{(v or "").replace(chr(34), "&quot;")}"' for k, v in attrs if k in KEPT_ATTRIBUTES)
        text = f"<{tag}{kept}>"
        ld = tag == "script" and (found.get("type") or "") == "application/ld+json"
        if tag == "meta" and (found.get("property") or "").startswith("og:"):
            self.front["og"].append(text)
        self.in_head = (self.in_head or tag == "head") and tag != "body"
        if tag in ("style", "svg", "noscript") or (tag == "script" and not ld):
            if not closed:
                self.skip, self.depth = tag, 1
            return
        if tag == "link" or (tag == "meta" and self.in_head):
            return
        if ld:
            self.block = []
        self.in_title = self.in_title or (tag == "title" and not self.title)
        self._put(text)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs, True)

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            self.depth -= tag == self.skip
            if not self.depth:
                self.skip = None
            return
        if tag == "title":
            self.in_title = False
        if tag == "head":
            self.in_head = False
        if tag not in _VOID:
            self._put(f"</{tag}>")
        if tag == "script" and self.block is not None:
            self.front["ld"].append("".join(self.block))
            self.block = None

    def handle_data(self, data: str) -> None:
        if self.in_title and not self.skip:
            self.title.append(data)
        self._put(data)

    def _reference(self, text: str) -> None:
        """A character reference as the page has it: with a semicolon only where one stands."""
        line, column = self.getpos()
        self.handle_data(text + ";" * self.html.startswith(";", self.lines[line - 1] + column + len(text)))

    def handle_entityref(self, name: str) -> None:
        self._reference(f"&{name}")

    def handle_charref(self, name: str) -> None:
        self._reference(f"&#{name}")

    def handle_comment(self, data: str) -> None:
        self._put(f"<!--{data}-->")

    def handle_decl(self, decl: str) -> None:
        self._put(f"<!{decl}>")

    def text(self) -> str:
        title = "".join(self.title).strip()
        parts = [*self.front["ld"], *self.front["og"], *([f"<title>{title}</title>"] if title else []), "".join(self.out)]
        return re.sub(r"\s+", " ", "\n".join(parts))


def _per_page(name: str, convert):
    """An Arrow pass that gives each page's html a text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([convert(h or "") for h in batch.column(1).to_pylist()], pa.string())], names=["page_id", name])

    return run


def clean_html(pages: DataFrame, cap: int | None = None) -> DataFrame:
    """(page_id, html): HTML for reading by a model, with JSON-LD, og metas and title in front, white space collapsed; beyond cap
    characters it is cut, with a marker. In one Arrow pass without a shuffle."""

    def convert(html: str) -> str:
        p = _Cleaner()
        p.feed(html)
        p.close()
        text = p.text()
        return text if cap is None or len(text) <= cap else text[:cap] + "\n<!-- TRUNCATED -->"

    return pages.select("page_id", "html").mapInArrow(_per_page("html", convert), "page_id bigint, html string")


_PARAGRAPHS = frozenset("p div section article header main table ul ol h1 h2 h3 h4 h5 h6 blockquote pre dl form nav footer aside".split())


class _Open:
    """An open element of a page that becomes Markdown: its parts so far, and the items or rows that it collects."""

    __slots__ = ("tag", "junk", "parts", "items")

    def __init__(self, tag: str, junk: bool):
        self.tag, self.junk, self.parts, self.items = tag, junk, [], []


class _Markdown(HTMLParser):
    """Markdown of a page: headings, lists, tables, link labels and image texts. Elements are turned into text as they close; an end tag
    closes its nearest open element and what is open in it, so an unclosed junk element ends with its parent."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open = [_Open("", False)]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in _PARAGRAPHS:
            self._end("p", _PARAGRAPHS - {"p"})
        elif tag == "li":
            self._end("li", {"ul", "ol"})
        elif tag in ("td", "th", "tr"):
            for t in ("td", "th", *(["tr"] if tag == "tr" else [])):
                self._end(t, {"table"})
        top = self.open[-1]
        names = (a.get("class") or "").lower()
        junk = top.junk or tag in JUNK_TAGS or any(x in names for x in JUNK_CLASSES) or (a.get("id") or "") in JUNK_IDS or (tag == "sup" and "reference" in names.split())
        if tag in _VOID:
            if not junk and tag == "br":
                top.parts.append("\n")
            elif not junk and tag == "img" and (a.get("alt") or "").strip():
                top.parts.append(f" {a['alt'].strip()} ")
            return
        self.open.append(_Open(tag, junk))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def _end(self, tag: str, within: set[str] | frozenset[str]) -> None:
        """Closes an open element of the tag that stands above any of within."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._close(i)
                return
            if self.open[i].tag in within:
                return

    def handle_endtag(self, tag: str) -> None:
        self._end(tag, frozenset())

    def _close(self, at: int) -> None:
        while len(self.open) > at:
            e = self.open.pop()
            if not e.junk:
                self._turn(e, self.open[-1])

    def _turn(self, e: _Open, above: _Open) -> None:
        text = "".join(e.parts)
        bare = text.strip()
        tag = e.tag
        if tag in ("td", "th"):
            next(x for x in reversed(self.open) if x.tag in ("tr", "table", "")).items.append(bare.replace("|", "\\|"))
        elif tag == "tr":
            if e.items:
                next(x for x in reversed(self.open) if x.tag in ("table", "")).items.append(e.items)
        elif tag == "table":
            lines = [f"| {' | '.join(row)} |" for row in e.items if isinstance(row, list)]
            if lines:
                lines.insert(1, "| " + " | ".join("---" for _ in e.items[0]) + " |")
            above.parts.append("\n\n" + "".join(x + "\n" for x in lines) + "\n")
        elif tag == "li" and above.tag in ("ul", "ol"):
            above.items.append(("- " if above.tag == "ul" else "1. ") + bare)
        elif tag in ("ul", "ol"):
            above.parts.append("\n" + "".join(x + "\n" for x in e.items) + "\n")
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            above.parts.append(f"\n{'#' * int(tag[1])} {' '.join(bare.split())}\n\n")
        elif tag in ("p", "div", "section", "article", "header", "main"):
            if bare:
                above.parts.append(f"\n{bare}\n")
        elif tag == "a":
            if bare:
                above.parts.append(f" [{bare}] ")
        else:
            above.parts.append(text)

    def handle_data(self, data: str) -> None:
        text = data.replace("\n", " ").strip()
        if text and not self.open[-1].junk:
            self.open[-1].parts.append(text + " ")

    def text(self) -> str:
        self._close(1)
        return re.sub(r"\n{3,}", "\n\n", "".join(self.open[0].parts)).strip()


def _markdown(html: str) -> str:
    p = _Markdown()
    p.feed(html)
    p.close()
    return p.text()


def to_markdown(pages: DataFrame) -> DataFrame:
    """(page_id, markdown), in one Arrow pass without a shuffle."""
    return pages.select("page_id", "html").mapInArrow(_per_page("markdown", _markdown), "page_id bigint, markdown string")
