"""Packing of token pieces into fixed windows by minimum bin slack over a histogram of lengths."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, columns_of, parallelism, salted_rank, text_batches
from .tokens import byte_bpe

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, copy_key long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Pieces of every document: full windows first, then what remains (below ``capacity``).

    A document is the ids of its whole text (null: empty) and ``end_id``, so
    every document has a piece. Rows are taken as they are: repeated doc_ids
    give pieces of their own.
    """
    schema = pa.schema(
        [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "copy_key")]
    )
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_bpe(tokenizer)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = codec.ids(text.as_py()) + end
                total, step = len(ids) // 4, 4 * capacity
                whole = zlib.crc32(ids)
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    rows.append((doc, at // 4, len(part) // 4, zlib.crc32(part), total, whole))
            columns = zip(*rows) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return columns_of(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def fill_once(counts: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, whose sum is closest to ``capacity`` from below.

    The longest length left is always in it, so that long pieces do not
    accumulate. Reachable sums are a bitset, one bit a sum; each length adds
    its copies by binary splitting (1, 2, 4, ... copies are one shift each).
    The bitset after each length is kept, and the counts are read off
    backwards from the best sum.
    """
    live = np.flatnonzero(counts)[::-1].tolist()
    longest = live[0]
    room = capacity - longest
    mask = (1 << (room + 1)) - 1
    reach = 1
    layers: list[tuple[int, int, int]] = []  # (length, copies of this step, sums before it)
    for length in live:
        if length > room:
            continue
        left = min(int(counts[length]) - (length == longest), room // length)
        step = 1
        while left > 0 and not reach >> room & 1:
            take = min(step, left)
            layers.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            step *= 2
        if reach >> room & 1:
            break
    best = reach.bit_length() - 1
    chosen = {longest: 1}
    for length, take, before in reversed(layers):
        if not before >> best & 1:
            chosen[length] = chosen.get(length, 0) + take
            best -= length * take
    return chosen


def window_plan(counts: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(number of windows, lengths in each) until no piece is left.

    The same filling is repeated for as many windows as its scarcest length
    allows, so the plan's size depends on the number of different lengths, not
    on the number of pieces.
    """
    left = counts.copy()
    plan = []
    while left.any():
        chosen = fill_once(left, capacity)
        times = min(int(left[n]) // k for n, k in chosen.items())
        for n, k in chosen.items():
            left[n] -= times * k
        plan.append((times, chosen))
    return plan


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Every token of ``docs(doc_id, text)`` in exactly one piece of one sequence of ``capacity``.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id and
    offset a piece. A null or empty text is the end id alone; null and
    repeated doc_ids are documents of their own; an empty table gives no
    rows; other columns are ignored. Pieces of equal length are exchangeable,
    so ties are settled by doc_id, then start, then the ids' checksum.

    Only the histogram of piece lengths, at most ``capacity`` counts, comes to
    the driver; there the windows are planned. The plan goes back as ranges
    of ranks within each length, and pieces meet it by that rank, which is
    counted in salted parts of each length.
    """
    spark = docs.sparkSession
    text_batches(spark)
    pieces = checkpoint(token_pieces(docs, tokenizer, capacity, end_id))
    full = pieces.filter(F.col("length") == capacity)
    rest = pieces.filter(F.col("length") < capacity)
    counts = np.zeros(capacity, np.int64)
    for length, n in rest.groupBy("length").count().collect():  # at most capacity - 1 rows
        counts[length] = n
    used = np.zeros(capacity, np.int64)
    ranges, sequence = [], 0
    for times, chosen in window_plan(counts, capacity):
        offset = 0
        for length, k in sorted(chosen.items(), reverse=True):
            # in each of these windows, k pieces of this length from this offset on
            ranges.append((length, int(used[length]), int(used[length]) + times * k, sequence, k, offset))
            used[length] += times * k
            offset += length * k
        sequence += times
    salt = F.pmod(F.xxhash64("doc_id", "start", "copy_key"), F.lit(parallelism(spark)))
    order = [F.col("doc_id"), F.col("start"), F.col("copy_key")]
    ranked = salted_rank(rest, ["length"], order, salt, "rank")
    placed = ranked.withColumn("spot", place(ranges, F.col("length"), F.col("rank"), spark))
    packed = placed.select(
        *pieces.columns,
        F.col("spot.sequence_id").alias("sequence_id"),
        F.col("spot.offset").alias("offset"),
    )
    even = salted_rank(full, ["length"], order, salt, "rank")
    whole = even.select(
        *pieces.columns,
        (F.col("rank") + sequence).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return packed.unionByName(whole).drop("copy_key")


def place(ranges: list[tuple], length, rank, spark):
    """Sequence and offset of the piece of this rank within its length, from the planned ranges.

    The ranges (at most a few for each length and filling) are closed over by
    an Arrow function; they are bounded by the capacity, not by the data.
    """
    table = np.array(sorted(ranges), np.int64).reshape(-1, 6)
    keys = table[:, 0] << 44 | table[:, 1]  # ranks of one length stay below 2**44
    shared = spark.sparkContext.broadcast((keys, table))

    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def spot(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        keys, table = shared.value
        n, r = lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
        found = table[np.searchsorted(keys, n.astype(np.int64) << 44 | r, side="right") - 1] if len(n) else table[:0]
        into = r - found[:, 1]
        return pa.StructArray.from_arrays(
            [pa.array(found[:, 3] + into // np.maximum(found[:, 4], 1)), pa.array(found[:, 5] + into % np.maximum(found[:, 4], 1) * n)],
            names=["sequence_id", "offset"],
        )

    return spot(length, rank)
