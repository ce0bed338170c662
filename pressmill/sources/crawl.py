"""Where pages come from and where articles go."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import columns as C
from ..functions import scalar as S
from ..operators import css
from ..operators.html_tree import parse_document
from ..operators.pages import Lookup

# Fixed values of requests.
USER_AGENT = "Mozilla/5.0 (Windows NT 6.1) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/41.0.2228.0 Safari/537.36"
TIMEOUT_SECONDS = 10


def pages_from_files(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html) of saved pages, one file each; a file's own address stands for its url."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))
    return files.select(F.xxhash64("url").alias("page_id"), "url", "html")


def pages_from_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")


def decode_page(body: bytes, content_type: str) -> str:
    """Bytes by the header's charset, then by the page's own where that is another."""
    charset = S.charset_of(content_type)
    html = S.decode_body(body, charset)
    root = parse_document(html)
    meta = css.first(root, "meta[http-equiv=content-type i]")
    declared = meta.attrs.get("content") if meta is not None else None
    if declared is None:
        meta = css.first(root, "meta[charset]")
        declared = meta.attrs.get("charset") if meta is not None else None
    if declared is not None and (own := S.charset_of(declared)) != charset:
        html = S.decode_body(body, own)
    return html


def pages_from_responses(responses: DataFrame) -> DataFrame:
    """(page_id, url, html, message) of ``responses(page_id, url, status, content_type, content_length, body)``.

    A response that is not read has no html and the reason as message; checks run before any body is decoded.
    """
    checked = responses.withColumn(
        "message", C.validation_message(F.col("status"), F.coalesce("content_type", F.lit("")), F.col("content_length"))
    )

    @F.arrow_udf("string")
    def decode(bodies: pa.Array, kinds: pa.Array) -> pa.Array:
        return pa.array([None if not b.is_valid else decode_page(b.as_py(), k.as_py() or "") for b, k in zip(bodies, kinds)], pa.string())

    body = F.when(F.col("message").isNull(), F.col("body"))
    return checked.select("page_id", "url", decode(body, F.col("content_type")).alias("html"), "message")


def unpack(body: bytes, encoding: str) -> bytes:
    """A body without its transfer packing; ValueError for one that cannot be read here."""
    import gzip
    import zlib

    match encoding.strip().lower():
        case "" | "identity":
            return body
        case "gzip" | "x-gzip":
            return gzip.decompress(body)
        case "deflate":
            try:
                return zlib.decompress(body)
            except zlib.error:  # some servers leave the wrapper out
                return zlib.decompress(body, -zlib.MAX_WBITS)
        case "br":
            try:
                import brotli
            except ImportError as e:
                raise ValueError("no decoder for br") from e
            return brotli.decompress(body)
    raise ValueError(encoding)


class Fetcher:
    """One session with cookies; a failed request is a response with status 0 and no body."""

    def __init__(self, headers: dict[str, str] | None = None):
        import http.cookiejar
        import importlib.util
        import urllib.request

        packings = ["gzip", "deflate", *(["br"] if importlib.util.find_spec("brotli") else [])]
        self.headers = {"User-Agent": USER_AGENT, "Accept-Encoding": ", ".join(packings), **(headers or {})}
        self.opener = urllib.request.build_opener(urllib.request.HTTPCookieProcessor(http.cookiejar.CookieJar()))

    def get(self, url: str) -> tuple[int, str, int | None, bytes | None]:
        """(status, content type, stated length, body)."""
        import urllib.error
        import urllib.request
        import zlib

        try:
            with self.opener.open(urllib.request.Request(url, headers=self.headers), timeout=TIMEOUT_SECONDS) as got:
                head, body = got.headers, unpack(got.read(), got.headers.get("Content-Encoding", ""))
                length = head.get("Content-Length")
                return got.status, head.get("Content-Type", ""), int(length) if length else None, body
        except urllib.error.HTTPError as e:
            return e.code, e.headers.get("Content-Type", ""), None, None
        except (OSError, EOFError, ValueError, zlib.error):
            return 0, "", None, None


RESPONSES = "page_id long, url string, status int, content_type string, content_length long, body binary"


def fetch_pages(addresses: DataFrame, headers: dict[str, str] | None = None) -> DataFrame:
    """Responses (see pages_from_responses) of ``addresses(page_id, url)``: each partition fetches its own, in one session."""
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in RESPONSES.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetcher = Fetcher(headers)
        for batch in batches:
            for page, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                row = (page, url, *fetcher.get(url or ""))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)

    return addresses.select(F.col("page_id").cast("long"), "url").mapInArrow(work, RESPONSES)


def fetch_lookup(headers: dict[str, str] | None = None) -> Lookup:
    """Fetches the addresses of following pages, for collect_pages; a page that cannot be read is not there."""

    def find(wanted: DataFrame) -> DataFrame:
        asked = wanted.select(F.xxhash64("address").alias("page_id"), F.col("address").alias("url"))
        pages = pages_from_responses(fetch_pages(asked, headers))
        return pages.filter("html is not null").select(F.col("url").alias("address"), "html")

    return find


class FetchSource(DataSource):
    """``spark.read.format("fetched_pages").option("urls", "\\n".join(urls))``: pages over HTTP, for small lists.

    Each partition gets its addresses and one session with cookies. A failed
    request is a row with status 0 and no body. Extra headers: option ``headers`` as JSON. For addresses in a table see fetch_pages.
    """

    @classmethod
    def name(cls) -> str:
        return "fetched_pages"

    def schema(self) -> str:
        return RESPONSES

    def reader(self, schema) -> DataSourceReader:
        return FetchReader(self.options)


class FetchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        import json

        self.urls = [u for u in options.get("urls", "").split("\n") if u.strip()]
        self.parts = max(1, min(len(self.urls), int(options.get("partitions", "8"))))
        self.headers = json.loads(options.get("headers", "{}"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(self.parts)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fetcher = Fetcher(self.headers)
        for k in range(partition.value, len(self.urls), self.parts):
            yield k, self.urls[k], *fetcher.get(self.urls[k])


def write_articles(articles: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Articles as JSON lines; rows in error have ``error`` and ``message``, others neither."""
    names = [c for c in articles.columns if c not in ("error", "message")]
    shown = articles.select(*names, F.when(F.col("error"), True).alias("error"), "message")
    shown.write.mode(mode).json(path)
