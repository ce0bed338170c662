"""Fetching from a server of our own: packed bodies, following pages, the command line; odd dates."""

import gzip
import json
import threading
import zlib
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from pressmill import cli
from pressmill.functions import dates
from pressmill.operators import extract as E
from pressmill.plans import catalog
from pressmill.sources import crawl

TEXT = "A long enough sentence, with commas, for a page of an article that goes on and on. " * 4


@pytest.fixture(scope="module")
def server():
    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            path, _, query = self.path.partition("?")
            number = int(query.removeprefix("page=") or 1) if path == "/news/long-story" else 0
            if not 1 <= number <= 3:
                self.send_error(404)
                return
            base = f"http://{self.headers['Host']}/news/long-story"
            link = f'<div class=paging><a href="{base}?page={number + 1}">next page</a></div>' if number < 3 or self.headers.get("X-More") else ""
            body = f"<title>Long story</title><div class=article><p>{TEXT} Number {number}.</p><p>{TEXT}</p></div>{link}".encode()
            packed = [("gzip", gzip.compress), ("deflate", zlib.compress), ("deflate", lambda b: zlib.compress(b, wbits=-15))][number - 1]
            self.send_response(200)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.send_header("Content-Encoding", packed[0])
            self.end_headers()
            self.wfile.write(packed[1](body))

        def log_message(self, *args):
            pass

    held = ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=held.serve_forever, daemon=True).start()
    yield f"http://localhost:{held.server_port}/news/long-story"
    held.shutdown()


def test_packed_bodies(spark, server):
    asked = spark.createDataFrame([(k, f"{server}?page={k}") for k in range(1, 5)], "page_id long, url string")
    got = {r.page_id: r for r in crawl.pages_from_responses(crawl.fetch_pages(asked)).collect()}
    assert all(f"Number {k}." in got[k].html for k in (1, 2, 3)) and got[4].message == E.NON_200.format(404)
    with pytest.raises(ValueError):
        crawl.unpack(b"x", "zstd")


def test_command_fetches_following_pages(spark, server, capsys, monkeypatch):
    monkeypatch.setattr(cli, "build_session", lambda *a, **k: spark)
    assert cli.main([server]) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["total_pages"] == 3 and [f"Number {k}." in got["content"] for k in (1, 2, 3)] == [True] * 3
    assert got["word_count"] > 100 and "<h4>Page 3</h4>" in got["content"]
    assert cli.main([server, "--no-fetch-all-pages"]) == 0
    assert "Number 2." not in json.loads(capsys.readouterr().out)["content"]
    # a following page that is not there fails the article
    assert cli.main([server, "--header", "X-More=1"]) == 1
    assert json.loads(capsys.readouterr().err)["error"] is True
    assert cli.main([server + "?page=9"]) == 1


ODD = ["0001-01-01T00:00:00+05:00", "9999-12-31T23:59:00-05:00", "Mon, 01 Jan 0001 00:00:00 +0500", "0001-01-01 00:00 +0500", "99999 years ago", "9999-12-31T23:59:59-0100", "now", "32/13/2020", "١٢"]


def test_odd_dates_are_rows(spark):
    rows = [(k, "https://www.example.com/a", f'<meta name="pubdate" content="{d}"><h1>Title {k}</h1><p>{TEXT}</p>') for k, d in enumerate(ODD)]
    got = E.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string"), E.Options(now=catalog.NOW)).collect()
    assert sorted(r.page_id for r in got) == list(range(len(ODD))) and not any(r.error for r in got)
    assert all(r.title for r in got)
    assert dates.clean_date("0150-02-03T04:05:06Z") == "0150-02-03T04:05:06.000Z"
    for zone in ("Asia/Tokyo", "America/New_York"):
        for d in ("0001-01-01 00:00", "9999-12-31 23:59"):
            dates.clean_date(d, zone)


def test_any_failure_is_a_row(monkeypatch):
    def broken(*args):
        raise KeyError("x")

    monkeypatch.setattr(E, "article_of", broken)
    got = E.extract_one("http://a.com/x", "<p>x", E.Options(), None)
    assert got["error"] is True and got["message"] == E.FETCH_FAILED.format("KeyError")
