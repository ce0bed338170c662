"""The engine in SQL: temporary views over a table of pages, and functions over html."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import css
from ..operators import extract as E
from ..operators.html_tree import parse_document
from ..operators.render import FORMATS, convert
from ..operators.rules import RuleBook
from .registry import NOW, dealt, query, table


def register_sql_functions(spark: SparkSession, opts: E.Options | None = None) -> None:
    """``extract_article(url, html)``, ``page_texts(html, selector)``, ``page_attrs(html, selector, name)``, ``render(html, format)``, ``has_rule(host)``."""
    E.register_functions(spark, opts)
    rules = opts.rules if opts else ()

    @F.arrow_udf("array<string>")
    def page_texts(pages: pa.Array, selectors: pa.Array) -> pa.Array:
        found = [[n.text() for n in css.select(parse_document(p.as_py() or ""), s.as_py())] if s.is_valid else None for p, s in zip(pages, selectors)]
        return pa.array(found, pa.list_(pa.string()))

    @F.arrow_udf("array<string>")
    def page_attrs(pages: pa.Array, selectors: pa.Array, names: pa.Array) -> pa.Array:
        found = []
        for p, s, name in zip(pages, selectors, names):
            nodes = css.select(parse_document(p.as_py() or ""), s.as_py()) if s.is_valid else ()
            found.append([n.attrs[name.as_py()] for n in nodes if name.as_py() in n.attrs])
        return pa.array(found, pa.list_(pa.string()))

    @F.arrow_udf("string")
    def render(contents: pa.Array, forms: pa.Array) -> pa.Array:
        known = lambda form: form if form in FORMATS else "html"
        return pa.array([convert(c.as_py(), known(f.as_py())) for c, f in zip(contents, forms)], pa.string())

    @F.arrow_udf("boolean")
    def has_rule(hosts: pa.Array) -> pa.Array:
        book = RuleBook(rules)
        return pa.array([book.has(h.as_py()) for h in hosts], pa.bool_())

    for function in (page_texts, page_attrs, render, has_rule):
        spark.udf.register(function.__name__, function)


def register_views(pages: DataFrame, opts: E.Options | None = None, prefix: str = "") -> None:
    """Temporary views ``pages``, ``articles`` and ``nodes`` over ``pages(page_id, url, html)``; nothing runs until they are read."""
    rows = pages.select("page_id", "url", "html")
    rows.createOrReplaceTempView(f"{prefix}pages")
    E.extract_articles(rows, opts).createOrReplaceTempView(f"{prefix}articles")
    E.explode_nodes(rows).createOrReplaceTempView(f"{prefix}nodes")


@query(
    r"""
    SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS domain, len(regexp_extract_all(html, '<li>'))::BIGINT AS items,
      replace(replace(replace(replace(regexp_extract(html, '<a href="[^"]*">([^<]*)</a>', 1), '&quot;', '"'), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&') AS first_link,
      FALSE AS ruled FROM pages
    """
)
def sql_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and functions in one SQL statement."""
    opts = E.Options(now=NOW, fields=("domain",))
    register_views(table(spark, sf_dir, "pages").repartition(dealt(spark)), opts, "pressmill_")
    register_sql_functions(spark, opts)
    return spark.sql(
        """
        SELECT a.page_id, a.domain, n.items, page_texts(p.html, 'nav a')[0] AS first_link, has_rule(a.domain) AS ruled
        FROM pressmill_articles a JOIN pressmill_pages p ON p.page_id = a.page_id
        JOIN (SELECT page_id, count(*) AS items FROM pressmill_nodes WHERE tag = 'li' GROUP BY page_id) n ON n.page_id = a.page_id
        """
    )
