"""Table functions for SQL: the DOM nodes of HTML text, with a lateral join or over a whole partitioned table."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from weftline.operators.dom import SCHEMA, parsed

_NODE = SCHEMA.split(", ", 1)[1]


@udtf(returnType=_NODE)
class DomNodes:
    """dom_nodes(html): the columns of operators.dom.dom_nodes but page_id, a row per element. A null page has none."""

    def eval(self, html: str) -> Iterator[tuple]:
        for n, parent, depth, tag, attrs, *rest in parsed(html):
            yield n, parent, depth, tag, dict(attrs), *rest


@udtf(returnType=SCHEMA)
class PageNodes:
    """page_nodes(TABLE(pages)): the same for every row (page_id, html) of a table argument, which may be partitioned."""

    def eval(self, page: Row) -> Iterator[tuple]:
        for n, parent, depth, tag, attrs, *rest in parsed(page["html"]):
            yield page["page_id"], n, parent, depth, tag, dict(attrs), *rest


def register_tables(spark: SparkSession) -> None:
    """Makes dom_nodes and page_nodes known to spark.sql."""
    spark.udtf.register("dom_nodes", DomNodes)
    spark.udtf.register("page_nodes", PageNodes)
