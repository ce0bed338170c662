"""Articles over several pages: follow next-page links through a table of pages and join their contents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from . import metadata as M
from .extract import FIELDS, Options, extract_articles
from .render import convert

MAX_PAGES = 26
ON_ERROR = ("fail", "stop")
#: From a table of different addresses to (address, html) of those that are there.
Lookup = Callable[[DataFrame], DataFrame]


def page_break(number: Column) -> Column:
    return F.concat(F.lit("<hr><h4>Page "), number.cast("string"), F.lit("</h4>"))


def chain_links(links: DataFrame, most: int = MAX_PAGES) -> DataFrame:
    """(start, number, url): the pages reached from every page of ``links(url, next_url)``, in order.

    A round joins the ends of all chains with the links once; chains that have ended drop
    out, and a chain stops before a page it has already been to. Rounds are
    ``most`` less one at most, and stop as soon as no chain goes on.
    """
    steps = links.select(F.col("url").alias("here"), F.col("next_url").alias("onward"))
    front = links.select(F.col("url").alias("start"), F.lit(1).alias("number"), "url", "next_url", F.array("url").alias("seen"))
    found = front.select("start", "number", "url")
    for number in range(2, most + 1):
        ahead = front.filter("next_url is not null")
        joined = ahead.join(steps, ahead.next_url == steps.here)
        front = joined.filter(~F.array_contains("seen", F.col("next_url"))).select(
            "start", F.lit(number).alias("number"), F.col("here").alias("url"), F.col("onward").alias("next_url"),
            F.concat("seen", F.array("here")).alias("seen"),
        )
        front = _cut(front)
        if front.isEmpty():
            break
        found = found.unionByName(front.select("start", "number", "url"))
    return found


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a folder of our own only where it is unset and all runs on one machine."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not (sc.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="pressmill-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def _cut(df: DataFrame) -> DataFrame:
    """End the growing lineage of a loop with a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table_lookup(pages: DataFrame) -> Lookup:
    """Look addresses up in ``pages(url, html)``, without fragment and trailing slash; of several pages that of the smallest url.

    Only the pages asked for are grouped: the html of all others meets no shuffle where the addresses fit a broadcast.
    """
    addressed = pages.select(C.remove_anchor(F.col("url")).alias("address"), "url", "html")

    def find(wanted: DataFrame) -> DataFrame:
        hits = addressed.join(wanted, "address", "left_semi")
        return hits.groupBy("address").agg(F.min_by("html", "url").alias("html"))

    return find


def collect_pages(articles: DataFrame, pages: DataFrame | Lookup, opts: Options | None = None, on_error: str = "fail", most: int = MAX_PAGES) -> DataFrame:
    """Articles with the contents of their following pages, up to ``most`` pages in all.

    ``pages`` is a table to look addresses up in (see table_lookup), or a function from different addresses to
    (address, html), such as one that fetches them. Every page of a chain is read knowing the addresses
    before it, so a chain never turns back. A missing page fails the article (``on_error="fail"``: error
    and message) or ends its chain (``"stop"``). The word count is that of the whole.
    """
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error is one of {ON_ERROR}")
    opts = opts or Options()
    if opts.now is None:
        opts = replace(opts, now=datetime.now(UTC))
    inner = replace(opts, content_type="html", fields=("content", "next_page_url", "error"))
    find = table_lookup(pages) if isinstance(pages, DataFrame) else pages
    front = articles.filter("next_page_url is not null and not error").select(
        "page_id", F.col("next_page_url").alias("address"), F.array(C.remove_anchor(F.col("url"))).alias("previous_urls")
    )
    parts, failed = None, None
    for number in range(2, most + 1):
        found = front.join(find(front.select("address").distinct()), "address", "left")
        missing = found.filter("html is null").select("page_id")
        failed = missing if failed is None else failed.unionByName(missing)
        ready = found.filter("html is not null").select("page_id", F.col("address").alias("url"), "html", "previous_urls")
        got = _cut(extract_articles(ready, inner, key=("page_id", "previous_urls", "url")))
        piece = got.select("page_id", F.lit(number).alias("number"), "content")
        parts = piece if parts is None else parts.unionByName(piece)
        front = got.filter("next_page_url is not null").select(
            "page_id", F.col("next_page_url").alias("address"), F.concat("previous_urls", F.array("url")).alias("previous_urls")
        )
        if front.isEmpty():
            break
    if parts is None:
        return articles
    piece = F.concat(page_break(F.col("number")), F.col("content"))
    texts = parts.groupBy("page_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("number", piece.alias("html"))))), lambda x: x["html"]), "").alias("__more"),
        F.max("number").alias("__last"),
    )  # at most ``most`` - 1 pieces an article
    return _merge(articles, texts, failed.distinct(), opts, on_error)


def _merge(articles: DataFrame, texts: DataFrame, failed: DataFrame, opts: Options, on_error: str) -> DataFrame:
    names = articles.columns
    merged = articles.join(texts, "page_id", "left").join(failed.withColumn("__failed", F.lit(True)), "page_id", "left")

    @F.arrow_udf("int")
    def count(contents: pa.Array) -> pa.Array:
        return pa.array([M.word_count(c.as_py()) for c in contents], pa.int32())

    @F.arrow_udf("string")
    def render(contents: pa.Array) -> pa.Array:
        return pa.array([convert(c.as_py(), opts.content_type) for c in contents], pa.string())

    whole = F.when(F.col("__last").isNotNull(), F.concat(F.coalesce("content", F.lit("")), F.col("__more"))).otherwise(F.col("content"))
    merged = merged.withColumn("content", whole)
    if "word_count" in names:
        merged = merged.withColumn("word_count", F.when(F.col("__last").isNotNull(), count("content")).otherwise(F.col("word_count")))
    for name in ("total_pages", "rendered_pages"):
        if name in names:
            merged = merged.withColumn(name, F.coalesce("__last", F.lit(1)))
    if opts.content_type != "html":
        merged = merged.withColumn("content", render("content"))
    if on_error == "fail":
        broken = F.coalesce(F.col("__failed"), F.lit(False))
        for name in names:
            if name in FIELDS and name not in ("error", "message"):
                merged = merged.withColumn(name, F.when(~broken, F.col(name)))
        merged = merged.withColumn("error", F.col("error") | broken)
        merged = merged.withColumn("message", F.when(broken, F.lit("Unable to fetch content. Original exception was no such page")).otherwise(F.col("message")))
    return merged.select(*names)


def extract_whole_articles(pages: DataFrame, opts: Options | None = None, on_error: str = "fail", most: int = MAX_PAGES, find: Lookup | None = None) -> DataFrame:
    """extract_articles and then collect_pages over the same table of pages, or over what ``find`` gives."""
    opts = opts or Options()
    first = replace(opts, content_type="html", now=opts.now or datetime.now(UTC))
    return collect_pages(_cut(extract_articles(pages, first)), find or pages, opts, on_error, most)
