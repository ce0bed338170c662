"""Registered queries of the page kernel over pages made from whole tables, so that SQL can say what must come out.

A query writes a page for every row of a table, with the row's values in the places that an operator reads, and gives
what the operator finds; its SQL twin states the same from the values alone, without any page.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..operators import extract as E
from ..operators import pages as P
from ..operators.page_columns import rendered, select_attrs, select_texts
from ..sources import crawl
from ..streaming import articles as S
from .registry import NOW, dealt, query, table, work_folder

_WS = r"[\s\x0b\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_LEAD = "The first paragraph of the story says, at some length, what happened and where, so that it counts."
_TAIL = "The last paragraph, which is as long as the first one, says again what happened, and to whom."


def escaped(text: Column) -> Column:
    """Text as HTML that reads as the same text."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def html(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def made(rows: DataFrame, key: str, url: Column, page: Column, *fields: str, **opts) -> DataFrame:
    pages = rows.select(key, url.alias("url"), page.alias("html"))
    return E.extract_articles(pages, E.Options(now=NOW, fields=fields, **opts), key=key, parts=dealt(rows.sparkSession))


# -- metadata -------------------------------------------------------------------------------


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 < 4 THEN s_name END AS author FROM supplier")
def made_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors from a meta tag, from a selector where a tag has two values, from an entry, from a byline, from nowhere."""
    k, name = F.col("s_suppkey") % 5, F.col("s_name")
    page = (
        F.when(k == 0, html('<meta name="byl" content="By ', name, '"><p>x'))
        .when(k == 1, html('<meta name="byl" content="A"><meta name="byl" content="B"><p class="byline"><b class="author">', name, "</b>"))
        .when(k == 2, html('<div class="entry"><i class="entry-author">Posted by: ', name, "</i></div>"))
        .when(k == 3, html('<p id="byline">By ', name, "</p>"))
        .otherwise(html("<p>", name))
    )
    return made(table(spark, sf_dir, "supplier"), "s_suppkey", F.lit("https://www.example.com/a"), page, "author")


@query(
    """
    WITH t AS (SELECT o_orderkey, o_orderkey % 6 AS k, o_orderdate + to_years(20) + to_seconds(o_orderkey % 86400) AS m FROM orders)
    SELECT o_orderkey, strftime(CASE k WHEN 0 THEN m - to_hours(2) WHEN 1 THEN date_trunc('day', m) WHEN 2 THEN date_trunc('day', m) WHEN 3 THEN m
      WHEN 4 THEN date_trunc('minute', m) ELSE TIMESTAMP '2024-01-01' - to_days(CAST(o_orderkey % 28 + 1 AS INTEGER)) END, '%Y-%m-%dT%H:%M:%S.%gZ') AS date_published FROM t
    """
)
def made_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates with an offset, as words, in the address, as milliseconds, behind an ambiguous tag, and relative ones."""
    k = F.col("o_orderkey") % 6
    at = F.timestamp_add("SECOND", F.col("o_orderkey") % 86400, F.add_months(F.col("o_orderdate"), 240).cast("timestamp"))
    form = lambda pattern: F.date_format(at, pattern)
    page = (
        F.when(k == 0, html('<meta property="article:published_time" content="', form("yyyy-MM-dd'T'HH:mm:ss"), '+02:00">'))
        .when(k == 1, html('<meta name="pubdate" content="', form("MMMM d, yyyy"), '">'))
        .when(k == 2, "<p>x")
        .when(k == 3, html('<p class="dateline">', F.unix_millis(at).cast("string"), "</p>"))
        .when(k == 4, html('<meta name="date" content="a"><meta name="date" content="b"><p class="pubdate">', form("yyyy-MM-dd HH:mm"), "</p>"))
        .otherwise(html('<meta name="date" content="', (F.col("o_orderkey") % 28 + 1).cast("string"), ' days ago">'))
    )
    url = html("https://www.example.com/", F.when(k == 2, form("yyyy/MM/dd")).otherwise("news"), "/story")
    return made(table(spark, sf_dir, "orders"), "o_orderkey", url, page, "date_published")


_ZONE_RULE = {
    "domain": "example.org",
    "date_published": {"selectors": [{"select": "time", "attr": "title"}, "time"], "timezone": "Asia/Tokyo", "format": "MMM D, YYYY [at] h:mm A"},
}


@query(
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 6 THEN strftime(date_trunc('minute', o_orderdate + to_seconds(o_orderkey % 86400)) - to_hours(9), '%Y-%m-%dT%H:%M:%S.%gZ') END AS date_published
    FROM orders
    """
)
def made_zone_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates by a rule's own format and time zone, from an attribute or a text; those of another form are none."""
    k = F.col("o_orderkey")
    at = F.timestamp_add("SECOND", k % 86400, F.col("o_orderdate").cast("timestamp"))
    raw = F.when(k % 7 == 6, F.date_format(at, "yyyy.MM.dd")).otherwise(html(F.date_format(at, "MMM d, yyyy"), " at ", F.date_format(at, "h:mm a")))
    page = F.when(k % 2 == 0, html('<p><time title="', raw, '">today</time>')).otherwise(html("<p><time>", raw, "</time>"))
    return made(table(spark, sf_dir, "orders"), "o_orderkey", F.lit("https://example.org/a"), page, "date_published", rules=(_ZONE_RULE,), fallback=False)


@query(
    """
    SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Title ' || s_name WHEN 1 THEN 'Entry ' || s_name WHEN 2 THEN 'Post ' || s_name ELSE 'Entry ' || s_name END AS title,
      CASE s_suppkey % 4 WHEN 0 THEN 'Meta ' || s_name WHEN 2 THEN 'Name ' || s_name ELSE 'Card ' || s_name END AS author FROM supplier
    """
)
def made_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules found by the marks of three publishing systems, whatever the host; a page without a mark has the generic fields."""
    k, name = F.col("s_suppkey") % 4, F.col("s_name")
    mark = (
        F.when(k == 0, '<meta property="al:ios:app_name" content="Medium">')
        .when(k == 1, '<meta name="generator" content="WordPress 6.1">')
        .when(k == 2, '<meta name="generator" content="blogger">')
        .otherwise('<meta name="generator" content="other">')
    )
    page = html(
        "<head>", mark, '<meta name="author" content="Meta ', name, '"></head><body><h1>Title ', name, '</h1><div class="post"><h2 class="title">Post ', name, '</h2><h3 class="entry-title">Entry ', name,
        '</h3><i class="post-author-name">Name ', name, '</i><p class="card"><span class="author vcard"><b class="fn">Card ', name, "</b></span></p></div></body>",
    )
    return made(table(spark, sf_dir, "supplier"), "s_suppkey", F.lit("https://www.example.com/a"), page, "title", "author", fallback=False)


@query(
    """
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'https://img.example.com/' || p_partkey || '.jpg' WHEN 1 THEN 'https://img.example.com/photo-' || p_partkey || '.jpg'
      WHEN 2 THEN 'ftp://img.example.com/' || p_partkey END AS lead_image_url FROM part
    """
)
def made_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images from a meta tag, the best of three in the content, from a link, and none."""
    k, name = F.col("p_partkey") % 4, F.col("p_partkey").cast("string")
    images = html(
        '<p><img src="https://img.example.com/icon-', name, '.gif"></p><figure><img alt="a" src="https://img.example.com/photo-', name,
        '.jpg" width="600" height="400"></figure><p><img src="https://img.example.com/other-', name, '.png"></p>',
    )
    body = html(f'<div class="story"><p>{_LEAD}</p>', F.when(k == 1, images).otherwise(""), f"<p>{_TAIL}</p></div>")
    head = (
        F.when(k == 0, html('<meta property="og:image" content=" https://img.example.com/', name, '.jpg ">'))
        .when(k == 1, html('<meta property="og:image" content="photo.jpg">'))
        .when(k == 2, html('<link rel="image_src" href="ftp://img.example.com/', name, '">'))
        .otherwise("")
    )
    return made(table(spark, sf_dir, "part"), "p_partkey", F.lit("https://www.example.com/a"), html(head, body), "lead_image_url")


@query(
    r"""
    WITH t AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host FROM pages)
    SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://canon.' || host || '/c/' || page_id WHEN 1 THEN 'https://og.' || host || '/o/' || page_id ELSE url END AS url,
      CASE page_id % 3 WHEN 0 THEN 'canon.' WHEN 1 THEN 'og.' ELSE '' END || host AS domain FROM t
    """
)
def made_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page's own html with a canonical link (and an og:url, which it goes before), with an og:url, and as it is."""
    k, name, host = F.col("page_id") % 3, F.col("page_id").cast("string"), C.url_host(F.col("url"))
    og = html('<meta property="og:url" content="https://og.', host, "/o/", name, '">')
    canonical = html('<link rel="canonical" href="https://canon.', host, "/c/", name, '">')
    head = F.when(k == 0, html(og, canonical)).when(k == 1, og).otherwise("")
    page = F.replace("html", F.lit("<title>"), html(head, "<title>"))
    return made(table(spark, sf_dir, "pages"), "page_id", F.col("url"), page, "url", "domain")


@query(
    """
    SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN 'https://www.example.com/news/' || lower(c_mktsegment) || '/story-' || c_custkey || '?page=2' END AS next_page_url FROM customer
    """
)
def made_next_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next pages by a link's words, by the numbers of several links, and none beside a link back."""
    k = F.col("c_custkey") % 3
    base = html("https://www.example.com/news/", F.lower("c_mktsegment"), "/story-", F.col("c_custkey").cast("string"))
    link = lambda n, text: html('<a href="', base, f'?page={n}">{text}</a> ')
    links = F.when(k == 0, html(link(2, "next page"), link(9, "last"))).when(k == 1, html(link(2, "2"), link(3, "3"))).otherwise(link(1, "previous page"))
    page = html(f'<div class="story"><p>{_LEAD}</p><p>{_TAIL}</p></div><div class="pagination">', links, '</div><a href="/about">About</a>')
    return made(table(spark, sf_dir, "customer"), "c_custkey", base, page, "next_page_url")


_BARE = "replace(replace(text, '<', '('), '&', '+')"
_PACKED = f"trim(regexp_replace({_BARE}, '{_WS}+', ' ', 'g'))"


def bare(text: Column) -> Column:
    """Text that neither tags nor entities are in."""
    return F.replace(F.replace(text, F.lit("<"), F.lit("(")), F.lit("&"), F.lit("+"))


@query(
    f"""
    WITH t AS (SELECT doc_id, {_PACKED} AS p FROM documents),
    fit AS (SELECT doc_id, p, (SELECT max(k) FROM range(0, 201) r(k) WHERE k <= length(p) AND strlen(left(p, k)) <= 200) AS k FROM t)
    SELECT doc_id, CASE WHEN strlen(p) <= 200 THEN p
      WHEN left(p, k) LIKE '% %' THEN regexp_extract(left(p, k), '^(.*) ', 1) || '&hellip;' ELSE left(p, k) || '&hellip;' END AS excerpt FROM fit
    """
)
def made_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts from a meta tag that holds the whole text."""
    page = html('<meta property="og:description" content="', escaped(bare(F.col("text"))), f'"><p>{_LEAD}</p>')
    return made(table(spark, sf_dir, "documents"), "doc_id", F.lit("https://www.example.com/a"), page, "excerpt")


# -- content ----------------------------------------------------------------------------------


@query(
    f"""
    WITH t AS (SELECT doc_id, '{_LEAD}' || {_BARE} || '{_TAIL}' AS t FROM documents), p AS (SELECT doc_id, trim(regexp_replace(t, '{_WS}+', ' ', 'g')) AS p FROM t)
    SELECT doc_id, md5(p) AS digest, len(string_split(p, ' '))::INTEGER AS word_count FROM p
    """
)
def made_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The story of a page between a side bar, a menu, a form and comments, with the whole text as a paragraph."""
    text = escaped(bare(F.col("text")))
    page = html(
        f'<html><head><title>Story</title><script>var p = "<p>{_LEAD}</p>"</script></head><body><div class="sidebar"><p>{_TAIL}</p></div><ul id="menu"><li><a href="/a">A</a></li></ul>',
        f'<div class="story"><p>{_LEAD}</p><p>', text, f"</p><p>{_TAIL}</p><form><p>{_LEAD}</p></form><script>1</script><!-- {_LEAD} --></div>",
        f'<div id="comments" class="comment"><p>{_LEAD}</p></div></body></html>',
    )
    got = made(table(spark, sf_dir, "documents"), "doc_id", F.lit("https://www.example.com/a"), page, "content", "word_count", content_type="text")
    return got.select("doc_id", F.md5("content").alias("digest"), "word_count")


_SHOWN = f"replace({_BARE}, '>', '&gt;')"


@query(
    f"""
    SELECT doc_id, md5('<div class="story"><p>{_LEAD}</p><h4>Part</h4>' || CASE WHEN t = '' THEN '' ELSE '<p>' || t || '</p>' END
      || '<img alt="A" src="https://img.example.com/' || doc_id || '.jpg" width="300"><p>{_TAIL} <a href="https://www.example.com/up/x?y=1">up</a> '
      || '<a href="https://www.example.com/news/story#here">here</a></p><iframe src="https://www.youtube.com/embed/1"></iframe></div>') AS digest
    FROM (SELECT doc_id, regexp_replace({_SHOWN}, '{_WS}{{2,}}', ' ', 'g') AS t FROM documents)
    """
)
def made_clean_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The HTML of a story: without headlines that say the title or come before the text, empty paragraphs, tiny images and spacers, strange
    frames, rules, lists of links and attributes that show or run something; with absolute links and the text as it is."""
    name = F.col("doc_id").cast("string")
    page = html(
        "<html><head><title>Story of ", name, '</title></head><body><div class="story" onclick="x()" style="a"><h1>Story of ', name, "</h1><h2>Story of ", name, "</h2><h3>Early</h3>",
        f'<p style="b">{_LEAD}</p><p></p><p> &nbsp; </p><h4>Part</h4><p>', escaped(bare(F.col("text"))), '</p><img src="https://img.example.com/', name, '.jpg" width="300" height="200" alt="A">',
        '<img src="https://img.example.com/dot.gif" width="1" height="1"><img src="https://img.example.com/spacer.png">', f'<p>{_TAIL} <a href="../up/x?y=1">up</a> <a href="#here">here</a></p>',
        '<iframe src="https://ads.example.com/x"></iframe><iframe src="https://www.youtube.com/embed/1"></iframe><hr><ul class="links"><li><a href="/1">one</a></li><li><a href="/2">two</a></li></ul>',
        "</div></body></html>",
    )
    got = made(table(spark, sf_dir, "documents"), "doc_id", F.lit("https://www.example.com/news/story"), page, "content")
    return got.select("doc_id", F.md5("content").alias("digest"))


_RULE = {
    "domain": "example.org",
    "title": ["h2.head"],
    "author": {"value": "Example"},
    "content": {"selectors": [{"all": ["p.intro", "section.body"]}], "clean": [".promo"], "transforms": [["b", {"tag": "strong"}]], "default_cleaner": False},
    "extend": {"tags": {"selectors": ["a.tag"], "allow_multiple": True}},
}


@query(
    f"""
    SELECT doc_id, 'Head ' || doc_id AS title, 'Example' AS author, '["' || lang || '", "two"]' AS tags,
      md5('<div><p class="intro">Intro ' || source || '</p><section class="body" id="s"><p>{_LEAD} <strong>' || {_SHOWN} || '</strong> <a href="https://news.example.org/more?a=' || doc_id
      || '#b">more</a></p></section></div>') AS digest FROM documents
    """
)
def made_rule_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's rule, found by base domain: several elements as content, a part cleaned away, a tag changed, a constant, extra fields."""
    name = F.col("doc_id").cast("string")
    page = html(
        '<h2 class="head">Head ', name, '</h2><p class="intro" onclick="x">Intro ', F.col("source"), f'</p><section class="body" id="s" style="color:red"><p>{_LEAD} <b>', escaped(bare(F.col("text"))),
        '</b> <a href="/more?a=', name, '#b">more</a></p><div class="promo">Buy</div><p></p></section><a class="tag" href="x">', F.col("lang"), '</a><a class="tag">two</a>',
    )
    got = made(table(spark, sf_dir, "documents"), "doc_id", F.lit("https://news.example.org/a/b"), page, "title", "author", "content", "extend", rules=(_RULE,))
    return got.select("doc_id", "title", "author", F.col("extend")["tags"].alias("tags"), F.md5("content").alias("digest"))


@query(
    f"""
    WITH t AS (SELECT *, '{_LEAD}' || {_BARE} || '{_TAIL}' AS t FROM documents), p AS (SELECT *, trim(regexp_replace(t, '{_WS}+', ' ', 'g')) AS p FROM t),
    fit AS (SELECT *, (SELECT max(k) FROM range(0, 201) r(k) WHERE k <= length(p) AND strlen(left(p, k)) <= 200) AS k FROM p)
    SELECT doc_id, 'No. ' || doc_id || ' & more' AS title, 'Ann Writer' AS author, 'https://img.example.com/' || doc_id || '.jpg' AS lead_image_url,
      strftime(TIMESTAMP '2020-01-02 03:04:05' + to_hours(doc_id), '%Y-%m-%dT%H:%M:%S.%gZ') AS date_published,
      CASE WHEN doc_id % 2 = 0 THEN 'About ' || source || ', in short.' END AS dek, md5(p) AS digest, len(string_split(p, ' '))::INTEGER AS word_count,
      CASE WHEN strlen(p) <= 200 THEN p WHEN left(p, k) LIKE '% %' THEN regexp_extract(left(p, k), '^(.*) ', 1) || '&hellip;' ELSE left(p, k) || '&hellip;' END AS excerpt FROM fit
    """
)
def made_rule_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields by a built-in rule; a dek with an address in it is none."""
    k, name = F.col("doc_id"), F.col("doc_id").cast("string")
    at = F.date_format(F.timestamp_add("HOUR", k, F.lit("2020-01-02 03:04:05").cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    dek = F.when(k % 2 == 0, html("About ", F.col("source"), ", in short.")).otherwise("See http://www.example.com for more.")
    page = html(
        '<html><head><meta name="author" content="Ann Writer"><meta property="article:published_time" content="', at, '"><meta property="og:image" content="https://img.example.com/', name, '.jpg"></head><body><h1>No. ',
        name, ' &amp; more</h1><p class="p-dek">', dek, f'</p><div class="c-entry-content" style="x"><p>{_LEAD}</p><p>', escaped(bare(F.col("text"))),
        f'</p><div class="aside">{_TAIL}</div><noscript><img src="https://img.example.com/x.jpg"></noscript><p>{_TAIL}</p></div></body></html>',
    )
    fields = ("title", "author", "date_published", "lead_image_url", "dek", "content", "word_count", "excerpt")
    got = made(table(spark, sf_dir, "documents"), "doc_id", F.lit("https://www.theverge.com/2020/1/2/7/story"), page, *fields, content_type="text")
    return got.withColumn("digest", F.md5("content")).drop("content")


def _points(text: str) -> str:
    """SQL of a paragraph's score."""
    return f"""(SELECT CASE WHEN strlen(b) < 25 THEN 0.0 ELSE 1.0 + length(b) - length(replace(b, ',', '')) + least(greatest(strlen(b) / 50.0 - 2.0, 0.0), 3.0)
      - CASE WHEN b LIKE '%:' THEN 1.0 ELSE 0.0 END END FROM (SELECT regexp_replace({text}, '^{_WS}+|{_WS}+$', '', 'g') AS b))"""


@query(
    f"""
    WITH s AS (SELECT doc_id, {_points("text")} AS own, {_points(f"'{_LEAD}'")} AS lead, {_points(f"'{_TAIL}'")} AS tail FROM (SELECT doc_id, {_BARE} AS text FROM documents)),
    n AS (SELECT doc_id, unnest(['alpha', 'photo', 'story', 'body']) AS name,
      unnest([5 + 1.25 * own, 15 + 1.25 * (lead + own), 30 + 1.25 * (lead + tail), 0.25 * (5 + 15 + 30) + 0.5 * (2 * own + 2 * lead + tail)]) AS score FROM s)
    SELECT doc_id, name, round(score, 6)::DOUBLE AS score FROM n
    """
)
def made_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of three parts of a page, by their paragraphs and classes, and what the body gets of them."""
    text = escaped(bare(F.col("text")))
    page = html(
        '<body><div class="alpha"><p>', text, f'</p></div><div class="photo"><p>{_LEAD}</p><p>', text, f'</p></div><div class="story"><p>{_LEAD}</p><p>{_TAIL}</p></div></body>'
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", page.alias("html")).repartition(dealt(spark))
    scores = E.scored_nodes(rows, "doc_id").filter("tag IN ('div', 'body')")
    return scores.select("doc_id", F.when(F.col("tag") == "body", "body").otherwise(F.col("class")).alias("name"), F.round("score", 6).alias("score"))


@query(
    """
    SELECT p_partkey, (CASE p_partkey % 3 WHEN 0 THEN 30 WHEN 1 THEN -30 ELSE 0 END + CASE WHEN p_partkey % 2 = 0 THEN 5 ELSE 0 END
      + CASE p_partkey % 4 WHEN 0 THEN 50 WHEN 1 THEN 15 ELSE 0 END - CASE WHEN w <= 50 THEN 50 ELSE 0 END - CASE WHEN h <= 50 THEN 50 ELSE 0 END
      + CASE WHEN w * h < 5000 THEN -100 ELSE floor(w * h / 1000.0 + 0.5) END + 0.5)::DOUBLE AS score
    FROM (SELECT p_partkey, p_size * 10 AS w, p_size * 20 AS h FROM part)
    """
)
def made_image_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of images by their address, description, figure, caption, surroundings and size."""
    k, size = F.col("p_partkey"), F.col("p_size")
    name = F.when(k % 3 == 0, "photo-1.jpg").when(k % 3 == 1, "icon-1.gif").otherwise("one.png")
    image = html(
        "<img", F.when(k % 2 == 0, ' alt="a"').otherwise(""), ' src="https://img.example.com/', name, '" width="', (size * 10).cast("string"), '" height="', (size * 20).cast("string"), '">'
    )
    page = F.when(k % 4 == 0, html("<figure>", image, "<figcaption>A</figcaption></figure>")).when(k % 4 == 1, html('<div class="photo">', image, "</div>")).otherwise(html("<p>", image, "</p>"))
    rows = table(spark, sf_dir, "part").select("p_partkey", page.alias("html")).repartition(dealt(spark))
    return E.scored_images(rows, "p_partkey").select("p_partkey", "score")


@query(f"SELECT doc_id, md5(trim(regexp_replace(text || '1' || source || '2' || lang, '{_WS}+', ' ', 'g'))) AS digest FROM documents")
def rendered_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph and list as text: white space collapses, blocks add none."""
    page = html("<div><p>", escaped(F.col("text")), "</p><ol><li>1</li><li><b>", F.col("source"), "</b></li></ol><p>2<i>", F.col("lang"), "</i></p></div>")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(rendered(page, "text")).alias("digest"))


@query(
    f"""
    SELECT doc_id, md5('## No. ' || doc_id || chr(10) || chr(10) || CASE WHEN t = '' THEN '' ELSE t || chr(10) || chr(10) END
      || '- **' || lang || '**' || chr(10) || '- [' || source || '](/s?a=' || source || ')' || chr(10) || chr(10) || '1. one' || chr(10) || chr(10)
      || '> quoted' || chr(10) || '`code`---' || chr(10)) AS digest
    FROM (SELECT doc_id, lang, source, regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g') AS t FROM documents)
    """
)
def rendered_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline, paragraph, both kinds of lists, a link, a quotation, code and a rule as Markdown."""
    source = F.col("source")
    page = html(
        "<h2>No. ", F.col("doc_id").cast("string"), "</h2><p>", escaped(F.col("text")), "</p><ul><li><strong>", F.col("lang"), '</strong></li><li><a href="/s?a=', source, '">', source,
        "</a></li></ul><ol><li>one</li></ol><blockquote>quoted</blockquote><code>code</code><hr>",
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(rendered(page, "markdown")).alias("digest"))


@query(
    """
    SELECT doc_id, CASE doc_id % 5 WHEN 3 THEN NULL ELSE md5('<title>T</title>' || CASE doc_id % 5 WHEN 2 THEN '<meta http-equiv="content-type" content="text/html; charset=UTF-8">'
      WHEN 4 THEN '<meta charset="utf-8">' ELSE '' END || '<p>' || text) END AS digest,
      CASE WHEN doc_id % 5 = 3 THEN 'Content for this resource was too large. Maximum content length is 5242880.' END AS message FROM documents
    """
)
def decoded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies by the header's charset, with a byte order mark, by the page's own charset in two forms, and one too large."""
    k = F.col("doc_id") % 5
    own = F.when(k == 2, '<meta http-equiv="content-type" content="text/html; charset=UTF-8">').when(k == 4, '<meta charset="utf-8">').otherwise("")
    body = F.concat(F.when(k == 1, F.lit(b"\xef\xbb\xbf")).otherwise(F.lit(b"")), F.encode(html("<title>T</title>", own, "<p>", F.col("text")), "UTF-8"))
    kind = F.when(k == 0, "text/html; charset=utf-8").when(k == 2, "text/html; charset=iso-8859-1").otherwise("text/html; charset=nonsense")
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("page_id"), F.lit("https://www.example.com/a").alias("url"), F.lit(200).alias("status"), kind.alias("content_type"),
        F.when(k == 3, F.lit(5_242_881)).cast("long").alias("content_length"), body.alias("body"),
    )
    return crawl.pages_from_responses(rows).select(F.col("page_id").alias("doc_id"), F.md5("html").alias("digest"), "message")


_OWN = "CASE c_custkey % 4 WHEN 3 THEN 1 ELSE c_custkey % 4 + 1 END"


@query(
    f"""
    SELECT c_custkey * 10 + n AS page_id, (last - n + 1)::INTEGER AS total_pages, (last - n)::INTEGER AS breaks, (last - n + 1)::INTEGER AS parts
    FROM (SELECT c_custkey, {_OWN} AS last, unnest(range(1, {_OWN} + 1)) AS n FROM customer)
    """
)
def made_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of one to three pages, joined from every page of theirs on."""
    customers = table(spark, sf_dir, "customer")
    last = F.when(F.col("c_custkey") % 4 == 3, 1).otherwise(F.col("c_custkey") % 4 + 1).cast("int")
    pages = customers.select("c_custkey", last.alias("last"), F.explode(F.sequence(F.lit(1), last)).alias("n"))
    base = html("https://www.example.com/news/long-story-", F.col("c_custkey").cast("string"))
    onward = html('<div class="paging"><a href="', base, "?page=", (F.col("n") + 1).cast("string"), '">next page</a></div>')
    page = html('<div class="story"><p>', _LEAD, "</p><p>Part ", F.col("n").cast("string"), f" of it. {_TAIL}</p></div>", F.when(F.col("n") < F.col("last"), onward).otherwise(""))
    address = F.when(F.col("n") == 1, base).otherwise(html(base, "?page=", F.col("n").cast("string")))
    rows = pages.select((F.col("c_custkey") * 10 + F.col("n")).alias("page_id"), address.alias("url"), page.alias("html")).repartition(dealt(spark))
    got = P.extract_whole_articles(rows, E.Options(now=NOW, fields=("content", "next_page_url", "url", "total_pages", "error", "message")))
    count = lambda mark: F.regexp_count("content", F.lit(mark))
    return got.select("page_id", "total_pages", count("<h4>Page [0-9]+</h4>").alias("breaks"), count("Part [0-9] of it").alias("parts"))


# -- selection and relations ------------------------------------------------------------------

_PLAIN = "replace(replace(replace(replace({}, '&quot;', '\"'), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&')"
_NAV = f"""SELECT page_id, unnest(list_transform(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1), lambda x: {_PLAIN.format('x')})) AS text,
  generate_subscripts(regexp_extract_all(html, '<li><a href="[^"]*">'), 1)::INTEGER AS place FROM pages"""


def nav_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = select_texts(F.col("html"), "nav > ul li a[href]")
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("at", "text")).select("page_id", "text", (F.col("at") + 1).alias("place"))


@query(_NAV)
def selected_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nav_texts(spark, sf_dir)


@query(f"SELECT page_id, text, place FROM ({_NAV}) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY strlen(text) DESC, place) <= 3")
def longest_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three longest link texts of every page (a top-k report)."""
    order = Window.partitionBy("page_id").orderBy(F.desc(F.octet_length("text")), "place")
    return nav_texts(spark, sf_dir).withColumn("r", F.row_number().over(order)).filter("r <= 3").drop("r")


@query(
    r"""
    SELECT page_id, len(list_filter(h, lambda x: regexp_matches(x, '^/[A-Z]')))::INTEGER AS capital, len(list_filter(h, lambda x: ends_with(x, 'e')))::INTEGER AS ending,
      len(list_filter(h, lambda x: contains(x, 'an')))::INTEGER AS holding
    FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages)
    """
)
def selected_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute selectors, beside the same by the values of attributes."""
    count = lambda selector: F.size(select_attrs(F.col("html"), selector, "href"))
    capital = F.size(F.filter(select_attrs(F.col("html"), "a", "href"), lambda x: x.rlike("^/[A-Z]")))
    return table(spark, sf_dir, "pages").select("page_id", capital.alias("capital"), count('a[href$="e"]').alias("ending"), count('nav a[href*="an"]').alias("holding"))


@query(
    rf"""
    SELECT page_id, trim(regexp_extract(html, '<!--(.*?)-->', 1)) AS comment, {_PLAIN.format("regexp_extract(html, '<footer>([^<]*)', 1)")} AS footer,
      len(regexp_extract_all(html, '<li><a '))::BIGINT AS li_a, len(regexp_extract_all(html, '<li>'))::BIGINT AS ul_li FROM pages
    """
)
def node_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes joined with their parents, and texts with the footer whose range of node ids they lie in."""
    nodes = E.explode_nodes(table(spark, sf_dir, "pages").repartition(dealt(spark)))
    above = nodes.select("page_id", F.col("node_id").alias("parent_id"), F.col("tag").alias("above"))
    pair = lambda up, down: F.count_if((F.col("above") == up) & (F.col("tag") == down))
    below = nodes.join(above, ["page_id", "parent_id"]).groupBy("page_id").agg(
        F.max(F.when(F.col("kind") == "comment", F.trim("text"))).alias("comment"), pair("li", "a").alias("li_a"), pair("ul", "li").alias("ul_li")
    )
    footers = nodes.filter("tag = 'footer'").select("page_id", F.col("node_id").alias("opens"), F.col("last_id").alias("closes"))
    texts = nodes.filter("kind = 'text'").select("page_id", "node_id", "text")
    inside = texts.join(footers, ["page_id"]).filter("node_id > opens AND node_id <= closes")
    ordered = F.sort_array(F.collect_list(F.struct("node_id", "text")))
    footer = inside.groupBy("page_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("footer"))
    return below.join(footer, "page_id", "left").select("page_id", "comment", F.coalesce("footer", F.lit("")).alias("footer"), "li_a", "ul_li")


_HREFS = """SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages"""


def hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang")
    return table(spark, sf_dir, "pages").select("page_id", lang, F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))


@query(f"WITH h AS ({_HREFS}) SELECT href FROM h WHERE lang = 'en' INTERSECT SELECT href FROM h WHERE lang = 'de' EXCEPT SELECT href FROM h WHERE lang = 'fr'")
def shared_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages in two languages and not in a third, as set operations."""
    of = lambda lang: hrefs(spark, sf_dir).filter(F.col("lang") == lang).select("href")
    return of("en").intersect(of("de")).subtract(of("fr"))


@query(f"WITH h AS ({_HREFS}) SELECT lang, count(*) AS n, count(DISTINCT href) AS addresses FROM h ANTI JOIN (SELECT href FROM h GROUP BY href HAVING count(DISTINCT lang) > 1) r USING (href) GROUP BY lang")
def lone_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to addresses that only pages of one language link to, by an anti join."""
    found = hrefs(spark, sf_dir)
    spread = found.groupBy("href").agg(F.countDistinct("lang").alias("langs")).filter("langs > 1")
    return found.join(spread, "href", "left_anti").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("href").alias("addresses"))


@query(
    r"""
    SELECT lang, top, count(*) AS pages, count(DISTINCT host) AS hosts, grouping(lang) * 2 + grouping(top) AS level
    FROM (SELECT regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host,
      regexp_extract(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '([a-z]+)$', 1) AS top FROM pages) GROUP BY ROLLUP (lang, top)
    """
)
def host_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and hosts by language and top-level domain, with subtotals."""
    host = C.url_host(F.col("url"))
    rows = table(spark, sf_dir, "pages").select(F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), host.alias("host"), F.regexp_extract(host, r"([a-z]+)\z", 1).alias("top"))
    return rows.rollup("lang", "top").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("host").alias("hosts"), F.grouping_id().alias("level"))


@query(f"SELECT lang, count(DISTINCT href) AS addresses, TRUE AS near FROM ({_HREFS}) GROUP BY lang")
def sketched_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different addresses by language, and whether a sketch of 1 % error comes within 5 % of them."""
    exact, sketch = F.countDistinct("href"), F.approx_count_distinct("href", 0.01)
    return hrefs(spark, sf_dir).groupBy("lang").agg(exact.alias("addresses"), (F.abs(sketch - exact) <= 0.05 * exact + 1).alias("near"))


@query(r"SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS domain FROM pages")
def streamed_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of a stream over the table, one file or a folder of them, written by the stream and read again."""
    base = f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"
    there = table(spark, sf_dir, "pages")  # a stream over a table that is not there would wait instead of failing
    # As a pattern the path may be a file, which a stream's plain path may not.
    pages = spark.readStream.schema(there.select("page_id", "url", "html").schema).parquet(f"{sf_dir}/[p]ages.parquet")
    S.write_stream(S.article_stream(pages, E.Options(now=NOW, fields=("url", "domain"))), f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.schema("page_id long, url string, domain string").parquet(f"{base}/out")
