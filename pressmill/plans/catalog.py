"""Registered queries of the page engine, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..functions import dates
from ..functions.scalar import IMAGE_BAD, IMAGE_GOOD
from ..operators import extract as E
from ..operators import pages as P
from ..operators import rules as R
from ..operators.scoring import NEGATIVE, POSITIVE
from . import made_pages, views
from .registry import NOW, dealt, oracle_sql, queries, query, table

__all__ = ["NOW", "flagship", "made_pages", "oracle_sql", "queries", "views"]


def articles(spark: SparkSession, sf_dir: str, **opts) -> DataFrame:
    return E.extract_articles(table(spark, sf_dir, "pages"), E.Options(now=NOW, **opts), parts=dealt(spark))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir)


# -- kernel -----------------------------------------------------------------------


_WS = r"[\s\x0b\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_RTL = r"\x{0592}-\x{05FD}\x{0602}-\x{06FD}\x{07C2}-\x{07FD}\x{0702}-\x{074D}\x{0782}-\x{07BD}\x{2D32}-\x{2D7D}"

_TEXT = "regexp_replace(replace(replace(replace({}, '&quot;', '\"'), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;?', '&', 'g')"
_HOST = r"lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1))"
_JSON = """'"' || replace(replace({}, '\\', '\\\\'), '"', '\\"') || '"'"""


@query(
    f"""
    SELECT page_id, '[' || list_aggregate(list_transform(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1), lambda x: {_JSON.format(_TEXT.format("x"))}), 'string_agg', ', ') || ']' AS links,
      {_JSON.format("trim(regexp_replace(" + _TEXT.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)") + ", '[\\s]{2,}', ' ', 'g'))")} AS headline FROM pages
    """
)
def article_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra fields of the caller: a list of link texts, and a headline, as JSON."""
    extend = {"links": {"selectors": ["nav a"], "allow_multiple": True}, "headline": {"selectors": ["article h1"]}}
    made = articles(spark, sf_dir, extend=extend, fields=("extend",))
    return made.select("page_id", F.col("extend")["links"].alias("links"), F.col("extend")["headline"].alias("headline"))


#: Titles from headings: parts at splitters, with the splitters, decide what goes (a breadcrumb's ends, or a site's name).
_TITLES = rf"""
    heads AS (SELECT page_id, url, {_HOST} AS host, {_TEXT.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} AS t FROM pages),
    split AS (SELECT *, string_split_regex(t, ': | - | \| ') AS texts, regexp_extract_all(t, ': | - | \| ') AS marks FROM heads),
    title_parts AS (SELECT *, list_filter(flatten(list_transform(range(1, len(texts) + 1), lambda k: [texts[k], coalesce(marks[k], '')])), lambda x: x <> '') AS p FROM split),
    term AS (SELECT page_id, arg_max(x, n * 1000 - place) AS term, max(n) AS n FROM (
        SELECT page_id, x, count(*) AS n, min(place) AS place FROM (SELECT page_id, unnest(p) AS x, generate_subscripts(p, 1) AS place FROM title_parts) GROUP BY page_id, x) GROUP BY page_id),
    trail AS (SELECT page_id, CASE WHEN n >= 2 AND strlen(term) <= 4 THEN string_split(t, term) ELSE p END AS pieces FROM title_parts JOIN term USING (page_id)),
    ends AS (SELECT page_id, CASE WHEN strlen(pieces[1]) > strlen(pieces[-1]) THEN pieces[1] ELSE pieces[-1] END AS longest FROM trail),
    slugs AS (SELECT page_id, regexp_replace(host, '\.com$|\.net$|\.org$|\.co\.uk$', '') AS site, lower(replace(p[1], ' ', '')) AS a, lower(replace(p[-1], ' ', '')) AS b FROM title_parts),
    near AS (SELECT page_id, strlen(a) > 5 AND 1 - levenshtein(regexp_replace(a, '[^ -~]', '?', 'g'), site) / greatest(length(a), length(site)) > 0.4 AS opens,
        strlen(b) >= 5 AND 1 - levenshtein(regexp_replace(b, '[^ -~]', '?', 'g'), site) / greatest(length(b), length(site)) > 0.4 AS closes FROM slugs),
    chosen AS (SELECT page_id, url, host, CASE WHEN len(p) <= 1 THEN t WHEN len(p) >= 6 THEN CASE WHEN strlen(longest) > 10 THEN longest ELSE t END
        WHEN opens THEN list_aggregate(p[3:], 'string_agg', '') WHEN closes THEN list_aggregate(p[1:len(p) - 2], 'string_agg', '') ELSE t END AS t
      FROM title_parts JOIN ends USING (page_id) JOIN near USING (page_id)),
    titles AS (SELECT page_id, url, host, trim(regexp_replace(t, '[\s]{{2,}}', ' ', 'g')) AS title FROM chosen)
"""


@query(f"WITH {_TITLES} SELECT page_id, title FROM titles")
def title_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles by the kernel, split ones resolved."""
    return articles(spark, sf_dir, fields=("title",))


@query(
    f"""
    WITH {_TITLES}
    SELECT page_id, title, NULL::VARCHAR AS author, NULL::VARCHAR AS date_published, NULL::VARCHAR AS next_page_url, url, host AS domain,
      CASE WHEN title = '' THEN NULL WHEN l AND r THEN 'bidi' WHEN l THEN 'ltr' WHEN r THEN 'rtl' END AS direction
    FROM (SELECT *, regexp_matches(title, '[{_RTL}]') AS r,
      regexp_matches(title, '[^{_WS[1:-1]}\\x00''"\\-+?!0-9{_RTL}]') OR (NOT regexp_matches(title, '[{_RTL}]') AND regexp_matches(title, '[0-9]')) AS l FROM titles)
    """
)
def article_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that need no content: the content passes are not run for them. These pages name no author and no date, and link to no next page."""
    return articles(spark, sf_dir, fields=("title", "author", "date_published", "next_page_url", "url", "domain", "direction"))




def _clear(x: str) -> str:
    """SQL of a text with its white space collapsed."""
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


def _shown(x: str) -> str:
    """SQL of a raw text as HTML says it again."""
    return f"replace(replace({_TEXT.format(x)}, '&', '&amp;'), '>', '&gt;')"


def _bare(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _packed(x: str) -> str:
    return _bare(f"regexp_replace({x}, '{_WS}{{2,}}', ' ', 'g')")


_FLAT = _TEXT.format("regexp_replace({}, '<[^>]*>', '', 'g')")
_SCORE = "CASE WHEN strlen({0}) < 25 THEN 0.0 ELSE 1.0 + length({0}) - length(replace({0}, ',', '')) + least(greatest(strlen({0}) / 50.0 - 2.0, 0.0), 3.0) - CASE WHEN {0} LIKE '%:' THEN 1.0 ELSE 0.0 END END"
_ENCODED = "list_aggregate(list_transform(string_split({}, ''), lambda c: CASE WHEN ord(c) < 128 THEN c ELSE url_encode(c) END), 'string_agg', '')"
#: The contents of the table's pages, from their parts: a menu, an advertisement, a headline, paragraphs and a footer. The article wins over the
#: body unless the advertisement scores more than half of all paragraphs; it takes the advertisement in where that scores at all; a body keeps a menu of
#: a middling size. No b is ever closed: every paragraph opens again those before it, three at most.
_CONTENTS = f"""
    raw AS (SELECT page_id, regexp_extract(url, '^([a-zA-Z]+)://', 1) || '://' || {_HOST} AS site, regexp_extract(html, '<article><h1>[^<]*</h1>(.*)</article>', 1, 's') AS inner_html,
      regexp_extract_all(html, '<li><a href="([^"]*)">', 1) AS hrefs, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1) AS words,
      regexp_extract(html, '<div class=.ad.>([^<]*)</div>', 1) AS ad_html, regexp_extract(html, '<footer>([^<]*)', 1) AS foot_html FROM pages),
    pieces AS (SELECT page_id, unnest(string_split(inner_html, '<p>')[2:]) AS piece, generate_subscripts(string_split(inner_html, '<p>')[2:], 1) AS place FROM raw),
    said AS (SELECT page_id, place, piece LIKE '<b>%' AS opens, piece LIKE '%<br>%' AS breaks, regexp_replace(piece, '<[^>]*>', '', 'g') AS t FROM pieces),
    deep AS (SELECT *, least(coalesce(sum(opens::INTEGER) OVER (PARTITION BY page_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3)::INTEGER + opens::INTEGER AS n FROM said),
    told AS (SELECT page_id, place, n, opens, {_bare(_TEXT.format("t"))} AS plain, {_TEXT.format("t")} AS flat, {_shown("t")} || CASE WHEN breaks THEN '<br>' ELSE '' END AS shown FROM deep),
    gathered AS (SELECT page_id, string_agg(flat, '' ORDER BY place) AS body, sum({_SCORE.format("plain")}) AS whole, least(count(*) FILTER (WHERE opens), 3)::INTEGER AS bs,
      string_agg('<p>' || repeat('<b>', n) || shown || repeat('</b>', n) || '</p>', '' ORDER BY place) FILTER (WHERE plain <> '') AS paragraphs,
      string_agg(repeat('**', n) || plain || repeat('**', n), chr(10) || chr(10) ORDER BY place) FILTER (WHERE plain <> '') AS marked FROM told GROUP BY page_id),
    parts AS (SELECT page_id, coalesce(body, '') AS body, coalesce(whole, 0) AS whole, coalesce(bs, 0) AS bs, coalesce(paragraphs, '') AS paragraphs, coalesce(marked, '') AS marked,
      {_TEXT.format("ad_html")} AS ad, {_shown("ad_html")} AS ad_shown, {_SCORE.format("(" + _clear(_TEXT.format("ad_html")) + ")")} AS own, {_TEXT.format("foot_html")} AS foot, {_shown("foot_html")} AS foot_shown,
      {_TEXT.format("list_aggregate(words, 'string_agg', '')")} AS nav, list_transform(range(1, len(words) + 1), lambda k: site || {_ENCODED.format("hrefs[k]")}) AS links, words
      FROM raw LEFT JOIN gathered USING (page_id)),
    kinds AS (SELECT *, CASE WHEN whole = 0 OR 0.5 * whole + 1.25 * own >= 1.25 * whole THEN 'body' WHEN own > 0 THEN 'both' ELSE 'article' END AS kind, strlen(nav) BETWEEN 25 AND 75 AS menu FROM parts),
    made AS (SELECT page_id, kind, CASE kind WHEN 'body' THEN CASE WHEN menu THEN nav ELSE '' END || ad || body || foot WHEN 'both' THEN ad || body ELSE body END AS t,
      {_packed("""CASE kind WHEN 'article' THEN '<article>' || paragraphs || '</article>' WHEN 'both' THEN '<div><p class="ad">' || ad_shown || '</p><article>' || paragraphs || '</article></div>'
        ELSE '<div><nav>' || CASE WHEN menu THEN '<ul>' || list_aggregate(list_transform(range(1, len(words) + 1), lambda k: '<li><a href="' || links[k] || '">' || """ + _shown("words[k]") + """ || '</a></li>'), 'string_agg', '') || '</ul>' ELSE '' END
          || '</nav><p class="ad">' || ad_shown || '</p><article>' || paragraphs || '</article><footer>' || repeat('<b>', bs) || foot_shown || repeat('</b>', bs) || '</footer></div>' END""")} AS html,
      {_bare("""CASE kind WHEN 'article' THEN '' WHEN 'both' THEN trim(ad) || chr(10) || chr(10) ELSE CASE WHEN menu THEN
        list_aggregate(list_transform(range(1, len(words) + 1), lambda k: '- [' || """ + _TEXT.format("words[k]") + """ || '](' || links[k] || ')' || chr(10)), 'string_agg', '') || chr(10) ELSE '' END || trim(ad) || chr(10) || chr(10) END
        || marked || chr(10) || chr(10) || CASE kind WHEN 'body' THEN repeat('**', bs) || trim(foot) || repeat('**', bs) ELSE '' END""")} || chr(10) AS markdown,
      '<div><article>' || replace(replace(paragraphs, '<b>', '<strong>'), '</b>', '</strong>') || '</article></div>' AS ruled FROM kinds),
    packed AS (SELECT *, {_clear("t")} AS p FROM made),
    fit AS (SELECT *, (SELECT max(k) FROM range(0, 201) r(k) WHERE k <= length(p) AND strlen(left(p, k)) <= 200) AS k FROM packed),
    contents AS (SELECT page_id, kind, p, html, markdown, ruled, CASE WHEN kind = 'article' OR p = '' THEN 0 ELSE len(string_split(p, ' ')) END::INTEGER AS word_count, CASE WHEN strlen(p) <= 200 THEN p
      WHEN left(p, k) LIKE '% %' THEN regexp_extract(left(p, k), '^(.*) ', 1) || '&hellip;' ELSE left(p, k) || '&hellip;' END AS excerpt FROM fit)
"""
_DIRECTION = f"""CASE WHEN title = '' THEN NULL WHEN regexp_matches(title, '[^{_WS[1:-1]}\\x00''"\\-+?!0-9{_RTL}]') OR (NOT regexp_matches(title, '[{_RTL}]') AND regexp_matches(title, '[0-9]'))
      THEN CASE WHEN regexp_matches(title, '[{_RTL}]') THEN 'bidi' ELSE 'ltr' END WHEN regexp_matches(title, '[{_RTL}]') THEN 'rtl' END"""


def _articles_sql(pages: str) -> str:
    """All fields but the extra ones; these pages name no author, date, image, dek or next page."""
    nothing = ", ".join(f"NULL::VARCHAR AS {name}" for name in ("author", "date_published", "lead_image_url", "dek", "next_page_url", "message"))
    return f"""WITH {_CONTENTS}, {_TITLES}
      SELECT page_id, title, html AS content, {nothing}, url, host AS domain, excerpt, word_count, {_DIRECTION} AS direction, {pages}::INTEGER AS total_pages, {pages}::INTEGER AS rendered_pages, FALSE AS error
      FROM contents JOIN titles USING (page_id)"""


@query(_articles_sql("NULL"))
def article_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of every page; extra fields, of which there are none, are left out (see article_extend)."""
    return articles(spark, sf_dir).drop("extend")


@query(_articles_sql("1"))
def whole_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after following next pages, which these pages do not have (see made_chains)."""
    pages = table(spark, sf_dir, "pages").repartition(dealt(spark))
    return P.extract_whole_articles(pages, E.Options(now=NOW), on_error="stop").drop("extend")


@query(f"WITH {_CONTENTS}, {_TITLES} SELECT page_id, title, markdown AS content, word_count, FALSE AS error, NULL::VARCHAR AS message FROM contents JOIN titles USING (page_id)")
def article_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir, content_type="markdown", fields=("title", "content", "word_count", "error", "message"))


@query(f"WITH {_CONTENTS} SELECT page_id, p AS content, excerpt FROM contents")
def article_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir, content_type="text", fields=("content", "excerpt"))


@query(
    f"""
    WITH {_CONTENTS}, {_TITLES}
    SELECT page_id, title, CASE WHEN ours THEN 'Example' END AS author, CASE WHEN ours THEN ruled ELSE html END AS content, host AS domain
    FROM (SELECT *, regexp_matches(host, '(^|[.])example[.]com$') AS ours FROM contents JOIN titles USING (page_id))
    """
)
def article_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's rule for some hosts, by their base domain."""
    rule = {"domain": "example.com", "title": ["article h1"], "author": {"value": "Example"}, "content": {"selectors": ["article"], "clean": ["h1"], "transforms": [["b", {"tag": "strong"}]]}}
    return articles(spark, sf_dir, rules=(rule,), fields=("title", "author", "content", "domain"))


@query(
    r"""
    SELECT page_id, 'li' AS tag, len(regexp_extract_all(html, '<li>'))::BIGINT AS n FROM pages WHERE html LIKE '%<li>%'
    UNION ALL SELECT page_id, 'h1', len(regexp_extract_all(html, '<h1>'))::BIGINT FROM pages WHERE html LIKE '%<h1>%'
    UNION ALL SELECT page_id, 'article', len(regexp_extract_all(html, '<article>'))::BIGINT FROM pages WHERE html LIKE '%<article>%'
    """
)
def node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = E.explode_nodes(table(spark, sf_dir, "pages").repartition(dealt(spark)))
    return nodes.filter(F.col("tag").isin("li", "h1", "article")).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


_INNER = """SELECT page_id, '{0}' AS tag, regexp_extract(html, '<{0}>(.*?)</{0}>', 1, 's') AS inner_html FROM pages"""
_SIZE = "coalesce(list_sum(list_transform({}, lambda x: strlen(trim(" + _TEXT.format("x") + ")))), 0)"


@query(
    f"""
    SELECT page_id, tag, round(CASE WHEN whole > 0 THEN linked / whole END, 9) AS density FROM (
      SELECT page_id, tag, {_SIZE.format("string_split_regex(inner_html, '<[^>]*>')")}::DOUBLE AS whole,
        {_SIZE.format("regexp_extract_all(inner_html, '<a [^>]*>([^<]*)</a>', 1)")}::DOUBLE AS linked
      FROM ({_INNER.format("article")} UNION ALL {_INNER.format("nav")}))
    """
)
def link_density_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link density of every article and nav, relationally: what lies below a node is a range of node ids.

    Sizes are summed along a page's nodes once, and a range is the difference of two sums, so no node meets another but its last one.
    """
    nodes = E.explode_nodes(table(spark, sf_dir, "pages").repartition(dealt(spark)))
    along = Window.partitionBy("page_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.when(F.col("kind") == "text", F.octet_length(F.trim("text"))).otherwise(0)
    reach = F.max(F.when(F.col("tag") == "a", F.col("last_id"))).over(along)
    sized = nodes.select("page_id", "node_id", "last_id", "tag", size.alias("size"), (F.coalesce(reach, F.lit(-1)) >= F.col("node_id")).alias("in_link"))
    summed = sized.withColumn("whole", F.sum("size").over(along)).withColumn("linked", F.sum(F.when(F.col("in_link"), F.col("size")).otherwise(0)).over(along))
    ends = summed.select("page_id", F.col("node_id").alias("last_id"), F.col("whole").alias("whole_to"), F.col("linked").alias("linked_to"))
    boxes = summed.filter(F.col("tag").isin("article", "nav")).join(ends, ["page_id", "last_id"])
    density = F.try_divide(F.col("linked_to") - F.col("linked"), F.col("whole_to") - F.col("whole"))
    return boxes.select("page_id", "tag", F.round(density, 9).alias("density"))


_KEYS = [(key, rule["domain"], k) for k, rule in enumerate(R.built_in_rules()) for key in [rule["domain"], *rule.get("aliases", ())]]
_LEADS = ["", "www.", "m.blog."]


@query(
    f"""
    WITH keys(key, rule, place) AS (VALUES {", ".join(f"('{key}', '{rule}', {k})" for key, rule, k in _KEYS)}),
    book AS (SELECT key, arg_min(rule, place) AS rule FROM keys GROUP BY key), names AS (SELECT row_number() OVER (ORDER BY key) - 1 AS n, key AS name FROM book),
    hosts AS (SELECT page_id, CASE WHEN page_id % 4 < 3 THEN CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'www.' ELSE 'm.blog.' END || name ELSE {_HOST} END AS host
      FROM pages JOIN names ON names.n = page_id % (SELECT count(*) FROM book))
    SELECT page_id, host, coalesce(e.rule, b.rule) AS rule FROM hosts LEFT JOIN book e ON e.key = host
      LEFT JOIN book b ON b.key = list_aggregate(list_slice(string_split(host, '.'), -2, -1), 'string_agg', '.')
    """
)
def rule_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule of every page's host, exact or by base domain, as two joins with the rules' keys (below 200).

    Three pages of four are given the host of a rule, with labels before it or without.
    """
    keys = spark.createDataFrame(_KEYS, "key string, rule string, place int").groupBy("key").agg(F.min_by("rule", "place").alias("rule"))
    book = F.broadcast(keys)
    names = F.array(*[F.lit(k) for k in sorted({key for key, _, _ in _KEYS})])
    lead = F.element_at(F.array(*[F.lit(x) for x in _LEADS]), (F.col("page_id") % 4 + 1).cast("int"))
    made = F.concat(lead, F.element_at(names, (F.col("page_id") % len({key for key, _, _ in _KEYS}) + 1).cast("int")))
    host = F.when(F.col("page_id") % 4 < 3, made).otherwise(C.url_host(F.col("url")))
    pages = table(spark, sf_dir, "pages").select("page_id", host.alias("host"))
    exact = pages.join(book.select(F.col("key").alias("host"), F.col("rule").alias("exact")), "host", "left")
    based = exact.withColumn("base", C.base_domain(F.col("host"))).join(book.select(F.col("key").alias("base"), F.col("rule").alias("by_base")), "base", "left")
    return based.select("page_id", "host", F.coalesce("exact", "by_base").alias("rule"))


# -- columns over addresses ---------------------------------------------------------------


@query(r"SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS domain FROM pages")
def url_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", C.url_host(F.col("url")).alias("domain"))


@query(
    r"""
    SELECT list_aggregate(list_slice(string_split(h, '.'), -2, -1), 'string_agg', '.') AS base_domain, count(*) AS n
    FROM (SELECT lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS h FROM pages) GROUP BY 1
    """
)
def base_domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = C.url_host(F.col("url"))
    return table(spark, sf_dir, "pages").groupBy(C.base_domain(host).alias("base_domain")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, rtrim(split_part(url, '#', 1), '/') AS address FROM pages")
def remove_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", C.remove_anchor(F.col("url")).alias("address"))


_PAGE = r"(page|paging|(p(a|g|ag)?(e|enum|ewanted|ing|ination)))?(=|/)([0-9]{1,3})"


@query(
    f"""
    SELECT page_id, CASE WHEN n < 100 THEN n END AS page_number
    FROM (SELECT page_id, TRY_CAST(regexp_extract(url, '{_PAGE}', 6) AS INTEGER) AS n FROM pages)
    """
)
def page_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", C.page_number(F.col("url")).alias("page_number"))


@query(
    f"""
    WITH parts AS (
      SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host,
        list_reverse(string_split(CASE WHEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/'
          ELSE regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) END, '/')) AS segs FROM pages),
    named AS (SELECT page_id, scheme, host, i, CASE WHEN regexp_matches(s, '^[^.]*\\.[a-z]+$') THEN split_part(s, '.', 1) ELSE s END AS s
      FROM (SELECT page_id, scheme, host, unnest(segs) AS s, generate_subscripts(segs, 1) - 1 AS i FROM parts)),
    cut AS (SELECT page_id, scheme, host, i, CASE WHEN i < 2 THEN regexp_replace(s, '{_PAGE}', '') ELSE s END AS s FROM named),
    led AS (SELECT *, max(CASE WHEN i = 0 AND regexp_matches(s, '[a-z]') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id) AS letters FROM cut)
    SELECT page_id, any_value(scheme) || '://' || any_value(host) || coalesce(string_agg(s, '/' ORDER BY i DESC)
      FILTER (NOT (i = 0 AND lower(s) = 'index') AND NOT (i < 2 AND strlen(s) < 3 AND letters = 0)), '') AS base_url
    FROM led GROUP BY page_id
    """.replace("\\\\", "\\")
)
def article_base_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", C.article_base_url(F.col("url")).alias("base_url"))


@query(
    f"""
    SELECT page_id, (CASE WHEN regexp_matches(u, '(?i){IMAGE_GOOD}') THEN 20 ELSE 0 END
      - CASE WHEN regexp_matches(u, '(?i){IMAGE_BAD}') THEN 20 ELSE 0 END
      - CASE WHEN regexp_matches(u, '(?i)\\.gif(\\?.*)?$') THEN 10 ELSE 0 END
      + CASE WHEN regexp_matches(u, '(?i)\\.jpe?g(\\?.*)?$') THEN 10 ELSE 0 END)::INTEGER AS score
    FROM (SELECT page_id, trim(url) || CASE WHEN page_id % 2 = 0 THEN '/photo.jpg' ELSE '/icon.gif?x=1' END AS u FROM pages)
    """
)
def image_url_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("page_id") % 2 == 0, "/photo.jpg").otherwise("/icon.gif?x=1")
    image = F.concat(F.trim("url"), name)
    return table(spark, sf_dir, "pages").select("page_id", C.image_url_score(image).alias("score"))


@query(
    r"""
    SELECT page_id, round(1.0 - levenshtein(a, b) / greatest(length(a), length(b)), 9) AS ratio
    FROM (SELECT page_id, lower(regexp_replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '[^!-~]', '', 'g')) AS a,
      regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '\.com$|\.net$|\.org$|\.co\.uk$', '') AS b FROM pages)
    """
)
def title_domain_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the ASCII part of titles, as SQL counts bytes where this counts characters."""
    slug = F.lower(F.regexp_replace(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), "[^!-~]", ""))
    site = F.regexp_replace(C.url_host(F.col("url")), r"\.com\z|\.net\z|\.org\z|\.co\.uk\z", "")
    return table(spark, sf_dir, "pages").select("page_id", F.round(C.levenshtein_ratio(slug, site), 9).alias("ratio"))


_LINKS = r"""SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href,
  generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">', 1), 1) AS place FROM pages"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("at", "href")).select("page_id", "href", (F.col("at") + 1).cast("long").alias("place"))


@query(f"SELECT page_id, count(*) AS links, count(DISTINCT href) AS addresses FROM ({_LINKS}) GROUP BY page_id")
def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir).groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("href").alias("addresses"))


@query(f"SELECT page_id, href, max(place) AS place FROM ({_LINKS}) GROUP BY page_id, href")
def link_last_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated addresses keep their last place."""
    last = Window.partitionBy("page_id", "href").orderBy(F.desc("place"))
    return links(spark, sf_dir).withColumn("r", F.row_number().over(last)).filter("r = 1").drop("r")


_CHAIN = """SELECT 'p' || page_id AS url, CASE WHEN page_id % 7 <> 6 AND page_id + 1 IN (SELECT page_id FROM pages)
  THEN 'p' || (page_id + 1) END AS next_url FROM pages"""


@query(
    f"""
    WITH RECURSIVE links AS ({_CHAIN}), chain AS (
      SELECT url AS start, 1 AS number, url, next_url FROM links
      UNION ALL SELECT c.start, c.number + 1, l.url, l.next_url FROM chain c JOIN links l ON c.next_url = l.url WHERE c.number < 26)
    SELECT start, number, url FROM chain
    """
)
def page_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains over a table of links made up from the ids of all pages: sevens of consecutive ones; a link to a page that is not there ends its chain."""
    at = F.col("page_id")
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    made = table(spark, sf_dir, "pages").select(name(at).alias("url"), F.when(at % 7 != 6, name(at + 1)).alias("next_url"))
    return P.chain_links(made)


# -- columns over texts ---------------------------------------------------------------------

_PACKED = f"trim(regexp_replace(text, '{_WS}+', ' ', 'g'))"


@query(f"SELECT doc_id, list_aggregate(list_slice(string_split({_PACKED}, ' '), 1, 10), 'string_agg', ' ') AS words FROM documents")
def excerpt_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", C.first_words(F.col("text"), 10).alias("words"))


@query(f"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '{_WS}{{2,}}', ' ', 'g'), '^{_WS}+|{_WS}+$', '', 'g')) AS digest FROM documents")
def normalize_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(C.normalize_spaces(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, CASE WHEN {_PACKED} = '' THEN 0 ELSE len(string_split({_PACKED}, ' ')) END::INTEGER AS words FROM documents")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", C.word_count(F.col("text")).alias("words"))


@query(
    f"""
    WITH t AS (SELECT doc_id, {_PACKED} AS p FROM documents),
    fit AS (SELECT doc_id, p, (SELECT max(k) FROM range(0, 201) r(k) WHERE k <= length(p) AND strlen(left(p, k)) <= 200) AS k FROM t)
    SELECT doc_id, CASE WHEN strlen(p) <= 200 THEN p
      WHEN left(p, k) LIKE '% %' THEN regexp_extract(left(p, k), '^(.*) ', 1) || '&hellip;' ELSE left(p, k) || '&hellip;' END AS excerpt FROM fit
    """
)
def clean_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", C.clean_excerpt(F.col("text")).alias("excerpt"))


@query(
    f"""
    SELECT doc_id, CASE WHEN l AND r THEN 'bidi' WHEN l THEN 'ltr' WHEN r THEN 'rtl' END AS direction FROM (
      SELECT doc_id, r, regexp_matches(t, '[^{_WS[1:-1]}\\x00''"\\-+?!0-9{_RTL}]') OR (NOT r AND regexp_matches(t, '[0-9]')) AS l FROM (
        SELECT doc_id, t, regexp_matches(t, '[{_RTL}]') AS r
        FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN chr(1488) || chr(1489) ELSE '' END || text AS t FROM documents)))
    """
)
def direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every whole text; some have Hebrew letters put before."""
    made = F.concat(F.when(F.col("doc_id") % 4 == 0, chr(1488) + chr(1489)).otherwise(""), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", C.direction(made).alias("direction"))


@query(
    f"""
    SELECT doc_id, round(CASE WHEN n < 25 THEN 0.0 ELSE 1.0 + c + least(greatest(n / 50.0 - 2.0, 0.0), 3.0) - CASE WHEN t LIKE '%:' THEN 1.0 ELSE 0.0 END END, 9)::DOUBLE AS score
    FROM (SELECT doc_id, t, strlen(t) AS n, length(t) - length(replace(t, ',', '')) AS c
      FROM (SELECT doc_id, regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g') AS t FROM documents))
    """
)
def paragraph_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(C.paragraph_score(F.col("text")).cast("double"), 9).alias("score"))


@query(
    f"""
    SELECT p_partkey, (CASE WHEN regexp_matches(p_name, '{POSITIVE}') THEN 25 ELSE 0 END
      - CASE WHEN regexp_matches(p_name, '{NEGATIVE}') THEN 25 ELSE 0 END)::INTEGER AS weight FROM part
    """
)
def hint_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", C.hint_weight(F.col("p_name")).alias("weight"))


@query(
    """
    SELECT o_orderkey, strftime(CASE o_orderkey % 4 WHEN 1 THEN date_trunc('minute', o_orderdate) WHEN 2 THEN date_trunc('day', o_orderdate)
      ELSE date_trunc('second', o_orderdate) END, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM orders
    """
)
def iso_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in four of the plain formats, and read again."""
    at, kind = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 4
    raw = (
        F.when(kind == 0, F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
        .when(kind == 1, F.date_format(at, "MMM d, yyyy HH:mm"))
        .when(kind == 2, F.date_format(at, "MMMM d, yyyy"))
        .otherwise(F.unix_seconds(at).cast("string"))
    )
    odd = F.when(raw.rlike("^[0-9]{1,9}$"), F.date_format(at, "yyyy-MM-dd HH:mm:ss")).otherwise(raw)
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.iso_date(odd).alias("iso"))


@query(
    f"""
    SELECT o_orderkey, CASE WHEN status <> 200 THEN '{E.NON_200.split("{}")[0]}' || status || '{E.NON_200.split("{}")[1]}'
      WHEN lower(trim(kind)) IN ('audio/mpeg', 'image/gif', 'image/jpeg', 'image/jpg') THEN '{E.BAD_TYPE.split("{}")[0]}' || kind || '{E.BAD_TYPE.split("{}")[1]}'
      WHEN size > 5242880 THEN '{E.TOO_LARGE}'
      WHEN NOT (kind LIKE '%html%' OR kind LIKE '%text%') THEN '{E.NOT_TEXT}' END AS message
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 404 ELSE 200 END AS status, o_orderkey * 1000 AS size,
      CASE o_orderkey % 3 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN ' image/JPEG' ELSE 'application/pdf' END AS kind FROM orders)
    """
)
def response_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.when(k % 3 == 0, "text/html; charset=utf-8").when(k % 3 == 1, " image/JPEG").otherwise("application/pdf")
    status = F.when(k % 5 == 0, 404).otherwise(200)
    return table(spark, sf_dir, "orders").select("o_orderkey", C.validation_message(status, kind, k * 1000).alias("message"))


@query(
    """
    SELECT conv_id, count(*)::INTEGER AS pages, string_agg(CASE WHEN n = 1 THEN t ELSE '<hr><h4>Page ' || n || '</h4>' || t END, '' ORDER BY n) AS content
    FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, coalesce(text, '') AS t FROM conversations)
    WHERE n <= 26 GROUP BY conv_id
    """
)
def merged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as pages of an article: at most 26, with a break before each but the first."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = table(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= P.MAX_PAGES)
    text = F.coalesce("text", F.lit(""))
    piece = F.when(F.col("n") == 1, text).otherwise(F.concat(P.page_break(F.col("n")), text))
    pieces = F.sort_array(F.collect_list(F.struct("n", piece.alias("html"))))
    return turns.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("pages"), F.array_join(F.transform(pieces, lambda x: x["html"]), "").alias("content"))


@query("SELECT event_id, json_extract_string(replace(props, '\"k\"', '\"src\"'), '$.src') AS src FROM events")
def json_src(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", C.json_src(F.replace("props", F.lit('"k"'), F.lit('"src"'))).alias("src"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_name WHEN 1 THEN s_name ELSE 'x by ' || s_name END AS author FROM supplier")
def clean_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    raw = F.concat(F.when(k == 0, "  By: ").when(k == 1, "Posted by ").otherwise("x by "), F.col("s_name"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", C.clean_author(raw).alias("author"))
