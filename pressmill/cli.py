"""One article at the command line: ``python -m pressmill.cli URL --file page.html``."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import UTC, datetime

from .operators.extract import FIELDS, Options, extract_articles
from .operators.pages import extract_whole_articles
from .session import build_session
from .sources.crawl import fetch_lookup, fetch_pages, pages_from_responses


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Extract an article from a web page.")
    parser.add_argument("url")
    parser.add_argument("--format", default="html", help="html, markdown or text")
    parser.add_argument("--header", action="append", default=[], metavar="NAME=VALUE")
    parser.add_argument("--no-fetch-all-pages", action="store_true")
    parser.add_argument("--no-fallback", action="store_true")
    parser.add_argument("--file", help="a saved page instead of fetching the address; its following pages are fetched unless told not to")
    return parser.parse_args(args)


def main(args: list[str] | None = None) -> int:
    got = arguments(args)
    try:
        opts = Options(content_type=got.format, fallback=not got.no_fallback, now=datetime.now(UTC))
    except ValueError as e:
        print(json.dumps({"error": True, "message": str(e)}), file=sys.stderr)
        return 1
    spark = build_session("article", master="local[2]")
    headers = dict(h.split("=", 1) for h in got.header if "=" in h)
    if got.file:
        with open(got.file, encoding="utf-8", errors="replace") as f:
            pages = spark.createDataFrame([(0, got.url, f.read())], "page_id long, url string, html string")
    else:
        page = pages_from_responses(fetch_pages(spark.createDataFrame([(0, got.url)], "page_id long, url string"), headers)).first()
        if page["message"]:
            print(json.dumps({"error": True, "message": page["message"]}), file=sys.stderr)
            return 1
        pages = spark.createDataFrame([(0, got.url, page["html"])], "page_id long, url string, html string")
    if got.no_fetch_all_pages:
        row = extract_articles(pages, opts).first()
    else:  # following pages are fetched; one that cannot be fails the article, as its text would lack a part
        row = extract_whole_articles(pages, opts, find=fetch_lookup(headers)).first()
    if row["error"]:
        print(json.dumps({"error": True, "message": row["message"]}), file=sys.stderr)
        return 1
    record = {k: row[k] for k in FIELDS if k not in ("extend", "error", "message")}
    record |= {k: json.loads(v) for k, v in (row["extend"] or {}).items()}
    print(json.dumps(record, indent=2, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
