"""The engine over tables: extraction, page chains, sources, streams, SQL and registered queries."""

import json

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from pressmill.functions import columns as C
from pressmill.functions import scalar as S
from pressmill.operators import extract as E
from pressmill.operators import pages as P
from pressmill.plans import catalog
from pressmill.sources import crawl
from pressmill.streaming import articles as stream

SF = "/root/testdata/sf0.001"
TEXT = "A long enough sentence, with commas, for a page of an article that goes on and on. " * 4


@pytest.fixture(scope="module")
def duck():
    import glob
    import os

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows_of(frame, names):
    plain = lambda v: None if pd.isna(v) else v if isinstance(v, str) or not hasattr(v, "__float__") else round(float(v), 6)
    return sorted((tuple(str(plain(v)) for v in row) for row in frame[names].itertuples(index=False)))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_queries_equal_their_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = duck.sql(catalog.oracle_sql()[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert rows_of(got, names) == rows_of(want, names)


def made_page(title, paragraph, ad, foot):
    menu = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("Ouwhea", "the", "of", "rend", "and", "threlyes"))
    return (
        f'<!DOCTYPE html><html lang="en"><head><title>{title}</title></head><body><nav><ul>{menu}</ul></nav><div class="ad">{ad}</div>'
        f"<article><h1>{title}</h1><p><b>{paragraph}<br></article><footer>&copy; {foot}</footer></body></html>"
    )


#: Pages as the tables have them, all of whose texts are too short for a score, with a footer that is short or long.
SHORT_PAGES = [
    (1, "https://tionsh.example.net/en/7498", made_page("Ed, ble. En rees.", "Ed, ble. En rees.", "Ieau, uerge und.", "tionsh &middot; Ch du.")),
    (2, "http://blog.example.org/en/43583", made_page("And en, are.", "And en, are.", "Zu und. Die der.", "blog.example.org &middot; " + "Et leau. " * 20)),
]


@pytest.mark.parametrize("name", ["article_full", "article_text", "article_markdown", "whole_articles"])
def test_pages_of_short_texts_equal_their_sql(spark, tmp_path, name):
    spark.createDataFrame(SHORT_PAGES, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = catalog.queries()[name](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()[name]).df()
    names = sorted(want.columns)
    assert rows_of(got, names) == rows_of(want, names)


def test_titles_by_rules_equal_their_sql(spark, tmp_path):
    title = "Oninheer | thedntst, | thantire | ndaner | oninheonhation | "  # as a rule's text, without the last space, its end is no splitter
    long = "A sentence that is long enough, with commas, to have a score."
    made = [(1, "https://blog.example.com/en/1", made_page(title, long, long, "x")), (2, "https://blog.example.org/en/1", made_page(title, "Short.", "Too short as well.", "x"))]
    spark.createDataFrame(made, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = catalog.queries()["article_rules"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()["article_rules"]).df()
    names = sorted(want.columns)
    assert rows_of(got, names) == rows_of(want, names)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_run(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    got = __spark_entry__.entry(spark)
    assert got.columns == ["page_id", *E.FIELDS] and got.count() == 50
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_results_do_not_depend_on_partitions(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    opts = E.Options(now=catalog.NOW, fields=("title", "content", "word_count"))
    one, many = (sorted(map(tuple, E.extract_articles(pages, opts, parts=n).collect())) for n in (1, 7))
    assert one == many
    for _, title, content, count in one:
        assert title and "<script" not in content and "<form" not in content and count >= 0


def test_scan_reads_only_what_is_used(spark):
    plan = catalog.url_domain(spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan and "html" not in plan.split("ReadSchema")[1]


def test_rows_that_are_no_pages(spark):
    rows = [(1, None, "<p>x"), (2, "nothing", "<p>x"), (3, "http://a.com/x", None), (4, "http://a.com/x", ""), (4, "http://a.com/x", "")]
    got = E.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.error) for r in got) == [(1, True), (2, True), (3, True), (4, False), (4, False)]
    empty = spark.createDataFrame([], "page_id long, url string, html string, title string")
    assert E.extract_articles(empty).count() == 0


def chain_page(k, last):
    url = "https://www.example.com/news/long-story"
    link = f'<div class=paging><a href="{url}?page={k + 1}">{k + 1}</a></div>' if k < last else ""
    return (k, url if k == 1 else f"{url}?page={k}", f"<div class=article><p>{TEXT} Number {k}.</p><p>{TEXT}</p></div>{link}")


def test_page_chains(spark):
    pages = spark.createDataFrame([chain_page(k, 4) for k in range(1, 5)], "page_id long, url string, html string")
    got = {r.page_id: r for r in P.extract_whole_articles(pages, E.Options(now=catalog.NOW)).collect()}
    first = got[1]
    assert first.rendered_pages == first.total_pages and first.error is False
    assert [f"<h4>Page {k}</h4>" in first.content for k in (2, 3)] == [True, True] or first.next_page_url is None
    broken = pages.filter("page_id <> 3")
    failed = {r.page_id: r for r in P.extract_whole_articles(broken, E.Options(now=catalog.NOW)).collect()}
    stopped = {r.page_id: r for r in P.extract_whole_articles(broken, E.Options(now=catalog.NOW), on_error="stop").collect()}
    assert failed[1].error is True and failed[1].content is None and stopped[1].error is False and "Number 2" in stopped[1].content
    with pytest.raises(ValueError, match="on_error"):
        P.extract_whole_articles(pages, on_error="x")


def test_chains_of_links_end(spark):
    links = [("a", "b"), ("b", "a"), ("c", None)] + [(f"x{k}", f"x{k + 1}") for k in range(40)]
    got = P.chain_links(spark.createDataFrame(links, "url string, next_url string")).collect()
    size = lambda s: sum(r.start == s for r in got)
    assert (size("a"), size("c"), size("x0"), size("x39")) == (2, 1, 26, 1)


def test_chains_start_from_every_page(spark, tmp_path):
    ids = [k for k in range(260) if k != 150]
    spark.createDataFrame([(k,) for k in ids], "page_id long").write.parquet(str(tmp_path / "pages.parquet"))
    want = []
    for k in ids:
        at = k
        while True:
            want.append((f"p{k}", at - k + 1, f"p{at}"))
            if at % 7 == 6 or at + 1 not in ids:
                break
            at += 1
    assert sorted(map(tuple, catalog.queries()["page_chain"](spark, str(tmp_path)).collect())) == sorted(want)


def test_directions_of_whole_texts(spark, tmp_path):
    texts = [(0, "plain"), (3, "\u05d0\u05d1"), (6, "a \u05d0"), (9, "12"), (1, "12 x"), (12, "12")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.direction for r in catalog.queries()["direction"](spark, str(tmp_path)).collect()}
    assert got == {0: "bidi", 3: "rtl", 6: "bidi", 9: "ltr", 1: "ltr", 12: "rtl"}


def test_responses(spark):
    rows = [
        (1, "http://a", 200, "text/html; charset=iso-8859-1", 10, "caf\xe9".encode("latin-1")),
        (2, "http://a", 404, "text/html", None, b"x"),
        (3, "http://a", 200, "image/gif", None, b"x"),
        (4, "http://a", 200, "text/html", 6_000_000, b"x"),
        (5, "http://a", 200, None, None, b"x"),
        (6, "http://a", 200, "text/html", None, '<meta http-equiv="Content-Type" content="text/html; charset=windows-1251">пр'.encode("cp1251")),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, status int, content_type string, content_length long, body binary")
    got = {r.page_id: r for r in crawl.pages_from_responses(frame).collect()}
    assert got[1].html == "caf\xe9" and got[6].html.endswith("пр")
    assert got[2].message == E.NON_200.format(404) and got[3].message == E.BAD_TYPE.format("image/gif") and got[4].message == E.TOO_LARGE and got[5].message == E.NOT_TEXT
    assert all(got[k].html is None for k in (2, 3, 4, 5))


def test_charset_is_found_anywhere_in_a_page():
    page = "<style>" + "a{} " * 20_000 + '</style><meta http-equiv="Content-Type" content="text/html; charset=windows-1251"><p>\u043f\u0440'
    assert crawl.decode_page(page.encode("cp1251"), "text/html; charset=utf-8").endswith("\u043f\u0440")


def test_files_and_json(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.html").write_text(f"<title>T</title><p>{TEXT}</p>")
    pages = crawl.pages_from_files(spark, str(tmp_path / "in"))
    assert pages.count() == 1 and pages.first().html.startswith("<title>")
    crawl.write_articles(E.extract_articles(spark.read.parquet(f"{SF}/pages.parquet").limit(3)), str(tmp_path / "out"))
    got = spark.read.json(str(tmp_path / "out"))
    assert got.count() == 3 and "title" in got.columns and "error" not in got.columns


def test_fetching_a_place_that_is_none(spark):
    spark.dataSource.register(crawl.FetchSource)
    got = spark.read.format("fetched_pages").option("urls", "http://127.0.0.1:9/x").load().collect()
    assert [(r.url, r.status, r.body) for r in got] == [("http://127.0.0.1:9/x", 0, None)]


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "pages"
    spark.read.parquet(f"{SF}/pages.parquet").repartition(3).write.parquet(str(source))
    opts = E.Options(now=catalog.NOW, fields=("title", "domain"))
    made = stream.article_stream(stream.page_stream(spark, str(source)), opts)
    stream.write_stream(made, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    want = E.extract_articles(spark.read.parquet(f"{SF}/pages.parquet"), opts)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, want.collect()))


def test_streamed_articles_of_a_folder_of_files(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    table.repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = __spark_entry__.queries()["streamed_articles"](spark, str(tmp_path))
    assert sorted(r.page_id for r in got.collect()) == sorted(r.page_id for r in table.collect())
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        __spark_entry__.queries()["streamed_articles"](spark, str(tmp_path / "none"))


def test_repeats_in_streams_are_dropped(spark, tmp_path):
    rows = [(1, "http://a/x#1", "h", 0), (2, "http://a/x/", "h", 5), (3, "http://a/y", "h", 6)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, s int").selectExpr("page_id", "url", "html", "timestamp_seconds(s) AS seen")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    stream.write_stream(stream.first_of_each_address(live, "seen"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_sql_function(spark):
    E.register_functions(spark)
    got = spark.sql("SELECT extract_article('http://a.com/x', '<title>Hello there</title><p>x') AS a").first().a
    assert got.title == "Hello there" and got.domain == "a.com"


def test_columns_agree_with_the_kernel(spark):
    urls = ["http://a.com/x/2/index.html", "https://A.b.com/p/3?page=2#z", "http://x.org", "http://x.org/story.html", "http://x.org/a/b/12/", "http://x.org/abc/pagination/4"]
    u = F.col("u")
    got = spark.createDataFrame([(x,) for x in urls], "u string").select(
        "u", C.remove_anchor(u).alias("r"), C.page_number(u).alias("n"), C.article_base_url(u).alias("b")
    )
    for r in got.collect():
        assert (r.r, r.n, r.b) == (S.remove_anchor(r.u), S.page_number(r.u), S.article_base_url(r.u))


def test_command_line_arguments():
    from pressmill.cli import arguments

    got = arguments(["http://a", "--format", "text", "--header", "A=B", "--no-fallback"])
    assert (got.url, got.format, got.header, got.no_fallback, got.file) == ("http://a", "text", ["A=B"], True, None)


def test_rules_file_is_plain_json():
    from pressmill.operators.rules import BUILT_IN

    assert len(json.loads(BUILT_IN.read_text())["rules"]) == 146
