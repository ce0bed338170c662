"""Shared pieces of the training-data operators: checkpoints, even ranks, stable word hashes."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII white space between words; other Unicode spaces stay inside a word.
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The URI of the folder that driver and executors share.

    It is read from ``spark.checkpoint.dir``; only where that is unset and all
    runs on one machine, a folder of our own is made and registered.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not (sc.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pressmill-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI; plain paths and file: URIs are local."""
    from pyarrow import fs

    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parsed.path) if parsed.scheme else os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions in force: what an even salt should spread over."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def plan_bytes(df: DataFrame) -> int:
    """The plan's own estimate of a table's size; 0 where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 50 else 0


#: Size of a range of documents, by the plan's estimate, where that asks for more ranges than there are shuffle partitions.
RANGE_BYTES = 128 << 20


def in_id_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in partitions that follow one another in ascending doc_id, null ids first, rows of one id by text.

    Ranges are cut by Spark's sample of ids and of the first characters of texts, so that rows of
    one doc_id, or without any, need not fall into one range.
    """
    parts = max(parallelism(docs.sparkSession), -(-plan_bytes(docs) // RANGE_BYTES))
    rows = columns_of(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    by = F.col("doc_id").asc_nulls_first()
    dealt = rows.repartitionByRange(parts, by, F.left("text", F.lit(24)).asc_nulls_first())
    return dealt.sortWithinPartitions(by, F.col("text").asc_nulls_first())


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a table of its own in the shared folder, and read again."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession, rows: int = 512) -> None:
    """Send at most so many whole texts to Python at a time.

    The session's limit is lowered, never raised: batches of thousands of long
    texts stand in memory several times over, in the JVM and in the worker. Every operator
    that sends texts calls this, so its memory does not depend on what ran before it;
    ``build_session`` sets the same limit from the start.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that does not clash with those of ``df``."""
    names = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in names:
        name = "_" + name
    return name


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra or clashing ones cannot interfere."""
    return df.select(*[F.col(f"`{n}`").alias(n) for n in names])


def salted_rank(df: DataFrame, keys: list[str], order: list[Column], salt: Column, out: str) -> DataFrame:
    """``df`` with ``out``: a gapless rank from 0 within ``keys``, computed without one task per key.

    Rows are ranked within (keys, salt); the counts of those small groups,
    of which there are keys x salts however many rows come in, give each its
    first rank. The salt must be a function of the row alone.
    """
    spot, size, first = "__salt", "__size", "__first"
    part = df.withColumn(spot, salt)
    sizes = part.groupBy(*keys, spot).agg(F.count(F.lit(1)).alias(size))
    before = Window.partitionBy(*keys).orderBy(spot).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, spot, F.coalesce(F.sum(size).over(before), F.lit(0)).alias(first))
    own = Window.partitionBy(*keys, spot).orderBy(*order)
    ranked = part.withColumn(out, F.row_number().over(own).cast("long") - 1)
    return (
        ranked.join(sizes, [*keys, spot])
        .withColumn(out, F.col(out) + F.col(first))
        .drop(spot, first)
    )


def hot_keys(counts: DataFrame, key: str, n: str, total: int | None = None) -> list[int]:
    """Hashes of the keys of ``counts(key, n)`` that hold more than an even task's share of all rows: no more than there are tasks."""
    total = counts.agg(F.sum(n)).first()[0] or 0 if total is None else total
    share = total / parallelism(counts.sparkSession)
    return [r[0] for r in counts.filter(F.col(n) > share).select(F.xxhash64(key)).collect()]


def spread_join(left: DataFrame, right: DataFrame, key: str, hot: list[int], salt: Column | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key; rows of a hot key are dealt to as many tasks as there are.

    ``salt`` is what rows of one key are dealt by, a function of the row alone; without it they are numbered, for which ``left``
    must come from a checkpoint or a file, so that a row keeps its number when a task is run again.
    """
    if not hot:
        return left.join(right, key)
    salts, spot = parallelism(left.sparkSession), fresh(left, "__spot")
    is_hot = F.xxhash64(key).isin(hot)
    salt = F.monotonically_increasing_id() if salt is None else salt
    salted = left.withColumn(spot, F.when(is_hot, F.pmod(salt, F.lit(salts))).otherwise(0).cast("int"))
    copies = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    return salted.join(right.withColumn(spot, copies), [key, spot]).drop(spot)


_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_MULT), -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words of UTF-8 bytes, split at ASCII white space."""
    solid = np.ones(256, bool)
    solid[list(SPACE_BYTES)] = False
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = solid[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word that depends on its bytes only, the same on every machine.

    Words are read eight bytes at a time, all words in step, so the cost is a
    pass over the bytes whatever the number of words.
    """
    length = (ends - starts).astype(np.int64)
    out = mix64(length.astype(np.uint64) + np.uint64(0x51ED270B))
    if not len(starts):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    live = np.arange(len(starts))
    at = 0
    while len(live):
        block = np.ascontiguousarray(eight[starts[live] + at]).view("<u8").ravel()
        left = np.minimum(length[live] - at, 8).astype(np.uint64)
        keep = np.where(left == 8, ~np.uint64(0), (np.uint64(1) << (left * np.uint64(8))) - np.uint64(1))
        out[live] = mix64(out[live] * _MULT ^ (block & keep))
        at += 8
        live = live[length[live] > at]
    return out


def window_hashes(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A 64-bit hash of every ``width`` consecutive word hashes (shorter input: none)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, seed, np.uint64)
    factor = np.uint64((seed * 2 + 1) | 1)
    mult = np.uint64(0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        for k in range(width):
            total += words[k : k + n] * factor
            factor = factor * mult
    return mix64(total)
