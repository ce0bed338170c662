"""Articles of a table of pages: one kernel call a page, in Arrow batches, between column expressions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import css
from . import metadata as M
from . import rules as R
from .cleaning import absolute_links, clean_article, prepare
from .html_tree import Node, parse_document, serialize
from .next_page import next_page_url
from .render import FORMATS, convert
from .scoring import choose_article, score_page, stored

FIELDS = {
    "title": "string",
    "content": "string",
    "author": "string",
    "date_published": "string",
    "lead_image_url": "string",
    "dek": "string",
    "next_page_url": "string",
    "url": "string",
    "domain": "string",
    "excerpt": "string",
    "word_count": "int",
    "direction": "string",
    "total_pages": "int",
    "rendered_pages": "int",
    "extend": "map<string,string>",
    "error": "boolean",
    "message": "string",
}
#: What each field is made from; nothing else is worked out for it.
_NEEDS = {
    "content": {"title"},
    "lead_image_url": {"content"},
    "excerpt": {"content"},
    "word_count": {"content"},
    "direction": {"title"},
    "dek": {"excerpt"},
}
# Messages of rows that have no article.
INVALID_URL = "The url parameter passed does not look like a valid URL. Please check your URL and try again."
NON_200 = "Resource returned a response status code of {} and resource was instructed to reject non-200 status codes."
BAD_TYPE = "Content-type for this resource was {} and is not allowed."
TOO_LARGE = "Content for this resource was too large. Maximum content length is 5242880."
NOT_TEXT = "Content does not appear to be text."
NO_CHILDREN = "No children, likely a bad parse."
FETCH_FAILED = "Unable to fetch content. Original exception was {}"
UNKNOWN_FORMAT = "Unsupported content type: {}"
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string())}


@dataclass(frozen=True)
class Options:
    """How articles are made: content format, fall back to generic fields, extra fields, rules, and fields wanted.

    ``last_resort`` gets a page's html and url where the generic content is empty, and gives content or None; see densest_part.
    """

    content_type: str = "html"
    fallback: bool = True
    extend: dict[str, Any] = field(default_factory=dict)
    rules: tuple[R.Rule, ...] = ()
    fields: tuple[str, ...] = tuple(FIELDS)
    now: datetime | None = None
    last_resort: Callable[[str, str], str | None] | None = None

    def __post_init__(self):
        form = self.content_type.lower()
        if form not in FORMATS:
            raise ValueError(UNKNOWN_FORMAT.format(self.content_type))
        object.__setattr__(self, "content_type", form)
        for rule in self.rules:
            R.check_rule(rule)
        if unknown := set(self.fields) - FIELDS.keys():
            raise ValueError(f"no such fields: {', '.join(sorted(unknown))}")

    def wanted(self) -> frozenset[str]:
        found = set(self.fields)
        while more := {n for f in found for n in _NEEDS.get(f, ())} - found:
            found |= more
        return frozenset(found)


# -- one page -------------------------------------------------------------------


def densest_part(html: str, url: str) -> str | None:
    """A last resort: the deepest element that holds half or more of the page's text outside links, cleaned lightly."""
    root = parse_document(html)
    for node in css.select(root, "script, style, noscript, nav, form, head"):
        node.detach()
    size = lambda node: S.nbytes(S.trim(node.text())) - sum(S.nbytes(S.trim(a.text())) for a in css.select(node, "a"))
    best, whole = root, size(root)
    if whole <= 0:
        return None
    while (deeper := next((c for c in best.child_elements() if 2 * size(c) >= whole), None)) is not None:
        best = deeper
    if best is root:
        return None
    absolute_links(best, url, None)
    return f"<div>{serialize(best)}</div>" if best.tag not in ("html", "body") else f"<div>{''.join(map(serialize, best.children))}</div>"


def generic_content(page: M.Page, last_resort: Callable[[str, str], str | None] | None = None) -> str | None:
    """The best-scored part of the page; thin results are tried again without stripping, then without weights.

    A pass works on a copy of the tree. The last result stays, thin or not; where nothing has a score in it, that is the whole body, as an
    empty article would lose texts that are merely short.
    """
    found = None
    for strip, weigh in ((True, True), (False, True), (False, False)):
        copy = page.root.clone()
        chosen = choose_article(copy, strip, weigh, not (strip or weigh))
        if chosen is None:
            continue
        tree, article = chosen
        clean_article(tree, article, "", page.url, True, page.base())
        found = serialize(tree)
        if tree.children and S.nbytes(S.trim(tree.children[0].text())) >= 100:
            break
    if not found and last_resort is not None:
        return last_resort(serialize(page.root), page.url) or None
    return S.normalize_spaces(found) if found else None


def article_of(page: M.Page, book: R.RuleBook, opts: Options, wanted: frozenset[str]) -> dict[str, Any]:
    """The fields of one prepared page, in the order they need each other."""
    rule = book.find(S.host_of(page.url)) or book.detect(page.view)
    if rule is not None and rule["domain"] == "*":
        rule = None
    out: dict[str, Any] = dict.fromkeys(FIELDS)
    generic = {
        "title": lambda: M.title(page),
        "author": lambda: M.author(page),
        "date_published": lambda: M.date_published(page),
        "next_page_url": lambda: next_page_url(page),
        "content": lambda: generic_content(page, opts.last_resort),
        "lead_image_url": lambda: M.lead_image_url(page, out["content"]),
        "excerpt": lambda: M.excerpt(page, out["content"]),
        "dek": lambda: None,
    }
    for name, make in generic.items():
        if name not in wanted:
            continue
        value = None
        if rule is not None:
            value = R.select_content(page, rule, out["title"]) if name == "content" else R.select_value(page, rule, name, out["excerpt"])
        if not value and (rule is None or opts.fallback or name == "title"):
            value = make()
        out[name] = value if value or name == "title" else None
    if "word_count" in wanted:
        out["word_count"] = M.word_count(out["content"])
    if "direction" in wanted:
        out["direction"] = S.direction(out["title"])
    out["url"], out["domain"] = M.url_and_domain(page)
    if "extend" in wanted:
        extra = R.select_extended(page, opts.extend)
        if rule is not None:
            extra |= R.select_extended(page, rule.get("extend", {}))
        out["extend"] = {k: json.dumps(v, ensure_ascii=False) for k, v in extra.items()}
    return out


def read_page(url: str | None, html: str | None, opts: Options, visited: list[str] | None = None) -> M.Page | str:
    """The prepared page, or the message why there is none."""
    if not S.is_valid_url(url):
        return INVALID_URL
    if html is None:
        return FETCH_FAILED.format("no html")
    root = parse_document(html)
    return M.Page(prepare(root), url, opts.now, [url] if visited is None else visited)


def extract_one(url: str | None, html: str | None, opts: Options, book: R.RuleBook, visited: list[str] | None = None) -> dict[str, Any]:
    """One article record; a page that cannot be read gives its message, and never stops the job."""
    try:
        page = read_page(url, html, opts, visited)
        if isinstance(page, str):
            return dict.fromkeys(FIELDS) | {"error": True, "message": page}
        out = article_of(page, book, opts, opts.wanted())
        return out | {"content": convert(out["content"], opts.content_type), "error": False}
    except Exception as e:  # noqa: BLE001 - one page never stops a job
        return dict.fromkeys(FIELDS) | {"error": True, "message": FETCH_FAILED.format(type(e).__name__)}


# -- tables of pages ----------------------------------------------------------------


def output_schema(df: DataFrame, keys: Iterable[str], fields: Iterable[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{f} {FIELDS[f]}" for f in fields)])


def article_columns(rows: list[dict[str, Any]], schema: pa.Schema) -> list[pa.Array]:
    """Article records as columns of the schema; maps become lists of their items."""
    plain = lambda v: list(v.items()) if isinstance(v, dict) else v
    return [pa.array([plain(row[f.name]) for row in rows], f.type) for f in schema]


def extract_articles(pages: DataFrame, opts: Options | None = None, key: str | Sequence[str] | None = "page_id", parts: int | None = None) -> DataFrame:
    """Article records of ``pages(page_id, url, html)``, a row for a row, without a shuffle of its own.

    ``parts`` deals the pages to that many partitions first, which a few large
    input files need. An optional column ``previous_urls`` (array of strings) has
    addresses that are no next pages. ``key`` names the columns that stay beside the fields. Only the columns used are read; the rules are
    closed over (about 100 KB), as they do not grow with the data.
    """
    opts = opts or Options()
    keys = [key] if isinstance(key, str) else list(key or ())
    visited = "previous_urls" in pages.columns
    seen_before = [F.col("previous_urls").alias("__seen")] if visited else []
    rows = pages.select(*keys, F.col("url").alias("__url"), F.col("html").alias("__html"), *seen_before)
    if parts:
        rows = rows.repartition(parts)
    if opts.now is None:  # one moment for the whole job, whichever task or attempt reads it
        opts = replace(opts, now=datetime.now(UTC))
    schema = pa.schema([(f, _ARROW[FIELDS[f]]) for f in opts.fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = R.RuleBook(opts.rules)
        for batch in batches:
            names = batch.schema.names
            urls, bodies = batch.column(names.index("__url")), batch.column(names.index("__html"))
            seen = batch.column(names.index("__seen")).to_pylist() if visited else [None] * batch.num_rows
            got = [extract_one(u.as_py(), h.as_py(), opts, book, v) for u, h, v in zip(urls, bodies, seen)]
            columns = [batch.column(names.index(k)) for k in keys] + article_columns(got, schema)
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, *schema.names])

    return rows.mapInArrow(work, output_schema(rows, keys, opts.fields))


def register_functions(spark: SparkSession, opts: Options | None = None) -> None:
    """``extract_article(url, html)`` for SQL: a struct of all fields."""
    opts = opts or Options(now=datetime.now(UTC))
    kind = "struct<" + ",".join(f"{k}:{v}" for k, v in FIELDS.items()) + ">"
    schema = pa.schema([(f, _ARROW[k]) for f, k in FIELDS.items()])

    @F.arrow_udf(kind)
    def extract_article(urls: pa.Array, bodies: pa.Array) -> pa.Array:
        book = R.RuleBook(opts.rules)
        got = [extract_one(u.as_py(), h.as_py(), opts, book) for u, h in zip(urls, bodies)]
        return pa.StructArray.from_arrays(article_columns(got, schema), fields=list(schema))

    spark.udf.register("extract_article", extract_article)


def node_rows(root: Node) -> Iterator[tuple]:
    """(node_id, parent_id, last_id, depth, kind, tag, attrs, text) in document order; ids of what is below run to last_id."""
    number, stack = 0, [(root, None, -1)]
    rows: list[list] = []
    open_: list[int] = []
    while stack:
        node, parent, depth = stack.pop()
        if node is None:
            rows[open_.pop()][2] = number - 1
            continue
        if node is not root:
            kind = {"#text": "text", "#comment": "comment"}.get(node.tag, "element")
            rows.append([number, parent, number, depth, kind, node.tag if kind == "element" else None, node.attrs or None, node.data or None])
            open_.append(number)
            stack.append((None, None, 0))
            parent = number
            number += 1
        stack.extend((c, parent, depth + 1) for c in reversed(node.children))
    return (tuple(r) for r in rows)


NODE_SCHEMA = "node_id int, parent_id int, last_id int, depth int, kind string, tag string, attrs map<string,string>, text string"


def explode_nodes(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """The tree of every page as rows, for relational work on parents, siblings and what lies below."""
    kinds = [pa.int32()] * 4 + [pa.string()] * 2 + [pa.map_(pa.string(), pa.string()), pa.string()]
    names = [c.split()[0] for c in NODE_SCHEMA.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, html in enumerate(batch.column(1)):
                got = list(node_rows(parse_document(html.as_py() or "")))
                at += [k] * len(got)
                rows += got
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            arrays = [pa.array([None if c is None else list(c.items()) for c in col] if pa.types.is_map(t) else col, t) for col, t in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *arrays], names=[key, *names])

    rows = pages.select(key, "html")
    return rows.mapInArrow(work, f"`{key}` {rows.schema[0].dataType.simpleString()}, {NODE_SCHEMA}")


def _rows_of(pages: DataFrame, key: str, schema: str, kinds: list[pa.DataType], make: Callable[[str], list[tuple]]) -> DataFrame:
    """The rows that ``make`` gives for each page's html, with the page's key."""
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, html in enumerate(batch.column(1)):
                got = make(html.as_py() or "")
                at += [k] * len(got)
                rows += got
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *arrays], names=[key, *names])

    rows = pages.select(key, "html")
    return rows.mapInArrow(work, f"`{key}` {rows.schema[0].dataType.simpleString()}, {schema}")


def scored_nodes(pages: DataFrame, key: str = "page_id", weigh: bool = True) -> DataFrame:
    """(place, tag, class, id, score) of every element of a page that gets a score, before an article is chosen."""

    def make(html: str) -> list[tuple]:
        root = prepare(parse_document(html))
        score_page(root, weigh)
        nodes = [(k, n, stored(n)) for k, n in enumerate(root.elements())]
        return [(k, n.tag, n.get("class"), n.get("id"), score) for k, n, score in nodes if score is not None]

    schema = "place int, tag string, class string, id string, score double"
    return _rows_of(pages, key, schema, [pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64()], make)


def scored_images(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(place, src, score) of every image with a source in a content's html, as the lead image is chosen by."""

    def make(html: str) -> list[tuple]:
        images = css.select(M.content_tree(html), "img")
        return [(k, img.get("src"), M.image_score(img, k, len(images))) for k, img in enumerate(images) if "src" in img.attrs]

    return _rows_of(pages, key, "place int, src string, score double", [pa.int32(), pa.string(), pa.float64()], make)
