"""Exact repeats between documents, found by anchors at fixed blocks of words.

Every document is cut into non-overlapping reference blocks of half a window.
A repeated window holds a whole block of its first occurrence, so a rolling
window of block length, tried at every word, finds it. Such a hit is a candidate only: whole windows
are compared by 96 bits, two hashes of all their words that do not depend on one another,
so that even 10**13 windows are not expected to hold two unequal ones that pass for equal.

Documents are dealt to chunks by doc_id and text. A chunk sends each different block
hash once to the bucket of that hash, however often the passage occurs in it,
so a very common passage costs one entry a chunk. The buckets answer which
hashes are a block somewhere and occur elsewhere too. Around such hits the
chunk sends the hashes of whole windows the same way, and learns which occur elsewhere
and where the first one is. Runs of repeated windows are then the
maximal exact repeats. Nothing is emitted for pairs of documents.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from itertools import compress
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, fresh, parallelism, plan_bytes, text_batches, window_hashes, word_bounds, word_hashes

WINDOW = 20
#: Text of a chunk, and text whose hashes meet in a bucket, by the size that the plan's statistics give; parameters of memory only.
CHUNK_BYTES, BUCKET_BYTES = 3 << 20, 12 << 20
_NULL_ID = np.iinfo(np.int64).min


class Chunk:
    """The words of some documents in order, with their hashes and the windows within documents."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        blobs = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        keys = np.array([_NULL_ID if d is None else d for d in ids], np.int64)
        ties = np.fromiter(map(zlib.crc32, blobs), np.uint32, len(blobs))
        # a document's rank is its doc_id, then the checksum of its text; equal rows follow one another
        self.order = sorted(range(len(blobs)), key=lambda k: (keys[k], ties[k], blobs[k]))
        self.ids, self.ties = keys[self.order], ties[self.order]
        self.blobs = [blobs[k] for k in self.order]
        data = np.frombuffer(b"\n".join(self.blobs), np.uint8)
        self.data = data
        sizes = np.fromiter(map(len, self.blobs), np.int64, len(self.blobs))
        begins = np.concatenate([[0], np.cumsum(sizes + 1)])
        self.begins = begins
        self.starts, self.ends = word_bounds(data)
        self.first = np.searchsorted(self.starts, begins)  # first word of each document, and the end
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.blobs)), self.counts)
        with np.errstate(over="ignore"):
            self.words = word_hashes(data, self.starts, self.ends)

    def windows(self, width: int, seed: int, of_at_least: int) -> tuple[np.ndarray, np.ndarray]:
        """(first words, hashes) of the windows inside documents of ``of_at_least`` words or more."""
        hashes = window_hashes(self.words, width, seed)
        n = len(hashes)
        inside = (self.doc[:n] == self.doc[width - 1 :]) & (self.counts[self.doc[:n]] >= of_at_least) if n else np.zeros(0, bool)
        at = np.flatnonzero(inside)
        return at, hashes[at]

    def checks(self, width: int) -> np.ndarray:
        """A second hash of every window, of 32 bits, by its first word."""
        return (window_hashes(self.words, width, 3) >> np.uint64(32)).astype(np.uint32)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def pack_sorted(low: np.ndarray) -> bytes:
    """Ascending 32-bit values as byte planes of their differences, which compress well."""
    steps = np.diff(low, prepend=low[:1] * 0).astype("<u4")
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    steps = np.frombuffer(blob, np.uint8).reshape(4, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view("<u4").ravel(), dtype=np.uint32)


def _slices(buckets: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal values of an ascending array."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(buckets)) + 1, [len(buckets)]])
    for a, b in zip(edges.tolist(), edges[1:].tolist()):
        if b > a:
            yield int(buckets[a]), slice(a, b)


def probes(chunk: Chunk, number: int, window: int, buckets: int) -> Iterator[tuple]:
    """(bucket, chunk, hashes, is a block, occurs again) for each bucket: all rolling block hashes."""
    block = window // 2
    at, hashes = chunk.windows(block, 1, window)
    aligned = (at - chunk.first[chunk.doc[at]]) % block == 0
    key = bucket_of(hashes, buckets) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)
    order = np.argsort(key)
    key, aligned = key[order], aligned[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    counts = np.diff(np.append(edge, len(key)))
    blocks = np.add.reduceat(aligned.astype(np.int64), edge) > 0 if len(edge) else aligned
    key, again = key[edge], counts > 1
    for bucket, own in _slices(key >> np.uint64(32)):
        low = (key[own] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        yield bucket, number, pack_sorted(low), np.packbits(blocks[own]).tobytes(), np.packbits(again[own]).tobytes()


def shared_hashes(rows: list[tuple]) -> Iterator[tuple]:
    """(chunk, bucket, hashes) of a bucket: those that are a block somewhere and occur twice or more."""
    lows, blocks, again, owner = [], [], [], []
    for k, (_, _, low, block, more) in enumerate(rows):
        low = unpack_sorted(low)
        lows.append(low)
        blocks.append(np.unpackbits(np.frombuffer(block, np.uint8), count=len(low)))
        again.append(np.unpackbits(np.frombuffer(more, np.uint8), count=len(low)))
        owner.append(np.full(len(low), k, np.int32))
    low, block, more, owner = map(np.concatenate, (lows, blocks, again, owner))
    order = np.argsort(low, kind="stable")
    low, owner = low[order], owner[order]
    edge = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    size = np.diff(np.append(edge, len(low)))
    common = (np.add.reduceat(block[order].astype(np.int64), edge) > 0) & (
        (size > 1) | (np.add.reduceat(more[order].astype(np.int64), edge) > 0)
    )
    told = np.repeat(common, size)
    low, owner = low[told], owner[told]
    by_owner = np.argsort(owner, kind="stable")
    low, owner = low[by_owner], owner[by_owner]
    for k, own in _slices(owner):
        yield rows[k][1], rows[k][0], pack_sorted(low[own])


def candidates(chunk: Chunk, number: int, shared: list[tuple], window: int, buckets: int) -> Iterator[tuple]:
    """(bucket, chunk, window hashes, second hashes, first documents, their ties, occurs again) of the windows that hold a hit."""
    block = window // 2
    if not shared:
        return
    known = np.sort(np.concatenate([np.uint64(b) << np.uint64(32) | unpack_sorted(low).astype(np.uint64) for _, b, low in shared]))
    at, hashes = chunk.windows(block, 1, window)
    key = bucket_of(hashes, buckets) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)
    spot = np.minimum(np.searchsorted(known, key), len(known) - 1)
    hits = np.zeros(len(chunk.words) + 1, np.int64)
    hits[at[known[spot] == key] + 1] = 1
    hits = np.cumsum(hits)
    starts, whole = chunk.windows(window, 2, window)
    near = hits[starts + window - block + 1] > hits[starts]
    starts, whole = starts[near], whole[near]
    check = chunk.checks(window)[starts]
    order = np.lexsort((starts, check, whole))
    starts, whole, check = starts[order], whole[order], check[order]
    first = changes(whole, check)
    doc, whole, check = chunk.doc[starts[first]], whole[first], check[first]
    ids, ties = chunk.ids[doc], chunk.ties[doc]
    more = np.diff(np.append(np.flatnonzero(first), len(starts))) > 1
    for bucket, own in _slices(bucket_of(whole, buckets)):
        yield bucket, number, whole[own].tobytes(), check[own].tobytes(), ids[own].tobytes(), ties[own].tobytes(), np.packbits(more[own]).tobytes()


def changes(*keys: np.ndarray) -> np.ndarray:
    """Where a row of ascending keys is not the one before."""
    if not len(keys[0]):
        return np.zeros(0, bool)
    return np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])


def first_windows(rows: list[tuple]) -> Iterator[tuple]:
    """(chunk, bucket, repeated window hashes, second hashes, whether the first is in that chunk)."""
    rows = sorted(rows, key=lambda r: r[1])  # the last tie goes by chunk
    sizes = [len(r[2]) // 8 for r in rows]
    owner = np.repeat(np.arange(len(rows)), sizes)
    more = np.concatenate([np.unpackbits(np.frombuffer(r[6], np.uint8), count=n) for r, n in zip(rows, sizes)])
    key, check, ids, ties = (np.concatenate([np.frombuffer(r[k], t) for r in rows]) for k, t in ((2, np.uint64), (3, np.uint32), (4, np.int64), (5, np.uint32)))
    order = np.lexsort((owner, ties, ids, check, key))
    key, check, owner, more = key[order], check[order], owner[order], more[order]
    lead = changes(key, check)
    edge = np.flatnonzero(lead)
    size = np.diff(np.append(edge, len(key)))
    told = np.repeat((size > 1) | (np.maximum.reduceat(more, edge) > 0), size)
    key, check, owner, lead = key[told], check[told], owner[told], lead[told]
    by_owner = np.lexsort((check, key, owner))
    key, check, owner, lead = key[by_owner], check[by_owner], owner[by_owner], lead[by_owner]
    for k, own in _slices(owner):
        yield rows[k][1], rows[k][0], key[own].tobytes(), check[own].tobytes(), np.packbits(lead[own]).tobytes()


def covered(chunk: Chunk, told: list[tuple], window: int) -> np.ndarray:
    """For each word, whether a window over it starts earlier too: the union of repeated runs."""
    cover = np.zeros(len(chunk.words) + 1, np.int64)
    if told:
        keys = [np.frombuffer(r[2], np.uint64) for r in told]
        lead = np.concatenate([np.unpackbits(np.frombuffer(r[4], np.uint8), count=len(k)) for r, k in zip(told, keys)])
        known, checks = np.concatenate(keys), np.concatenate([np.frombuffer(r[3], np.uint32) for r in told])
        order = np.lexsort((checks, known))
        known, checks, lead = known[order], checks[order], lead[order].astype(bool)
        starts, whole = chunk.windows(window, 2, window)
        check = chunk.checks(window)[starts]
        spot = np.minimum(np.searchsorted(known, whole), len(known) - 1)
        while True:  # past unequal windows of one first hash
            pass_by = (known[spot] == whole) & (checks[spot] < check) & (spot + 1 < len(known))
            if not pass_by.any():
                break
            spot = spot + pass_by
        match = (known[spot] == whole) & (checks[spot] == check)
        starts, spot, whole, check = starts[match], spot[match], whole[match], check[match]
        by = np.lexsort((starts, check, whole))
        opens = changes(whole[by], check[by])
        stays = opens & lead[spot[by]]  # the first occurrence of all
        gone = starts[by][~stays]
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + window, -1)
    return np.cumsum(cover[:-1]) > 0


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


_PROBES = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("hashes", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])
_WINDOWS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), *[(n, pa.binary()) for n in ("hashes", "checks", "ids", "ties", "again")]])
_SHARED = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("hashes", pa.binary())])
_FIRSTS = pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("checks", pa.binary()), ("lead", pa.binary())])
_DDL = {pa.int32(): "int", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)


def _rows(table: pa.Table) -> list[tuple]:
    return list(zip(*(c.to_pylist() for c in table.columns)))


def chunk_count(docs: DataFrame, size: int) -> int:
    """Parts of about ``size`` bytes by the plan's own size estimate, and one a shuffle partition at least."""
    return max(parallelism(docs.sparkSession), ceil(plan_bytes(docs) / size))


def find_repeats(docs: DataFrame, window: int, finish: Callable[[Chunk, np.ndarray, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Run ``finish(chunk, repeated words, rows)`` on every chunk of ``docs``.

    All of it is one plan over one exchange of the texts, which the later steps reuse.
    """
    text_batches(docs.sparkSession)
    chunks = chunk_count(docs, CHUNK_BYTES)
    buckets = chunk_count(docs, BUCKET_BYTES)
    number = fresh(docs, "chunk_no")
    held = docs.withColumn(number, F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    by_chunk = held.groupBy(number)

    def read(table: pa.Table) -> tuple[int, Chunk]:
        return table.column(number)[0].as_py(), Chunk(table.column("doc_id").to_pylist(), table.column("text").to_pylist())

    def probe(table: pa.Table) -> pa.Table:
        no, chunk = read(table)
        return _batch(list(probes(chunk, no, window, buckets)), _PROBES)

    def meet(table: pa.Table) -> pa.Table:
        return _batch(list(shared_hashes(_rows(table))), _SHARED)

    def propose(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _batch([], _WINDOWS)
        no, chunk = read(left)
        return _batch(list(candidates(chunk, no, _rows(right), window, buckets)), _WINDOWS)

    def settle(table: pa.Table) -> pa.Table:
        return _batch(list(first_windows(_rows(table))), _FIRSTS)

    def end(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return finish(Chunk([], []), np.zeros(0, bool), left.drop([number]))
        _, chunk = read(left)
        return finish(chunk, covered(chunk, _rows(right), window), left.drop([number]))

    shared = by_chunk.applyInArrow(probe, _ddl(_PROBES)).groupBy("bucket").applyInArrow(meet, _ddl(_SHARED))
    proposed = by_chunk.cogroup(shared.groupBy("chunk")).applyInArrow(propose, _ddl(_WINDOWS))
    firsts = proposed.groupBy("bucket").applyInArrow(settle, _ddl(_FIRSTS))
    return by_chunk.cogroup(firsts.groupBy("chunk")).applyInArrow(end, schema)


def repeat_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of ``docs(doc_id, text)``.

    Words are runs without ASCII white space, unchanged. A null, empty or blank text
    has no words, and the digest of no bytes. Documents rank by doc_id (null first),
    rows of one doc_id by their texts' CRC-32, and each row is a document of its own. Other
    columns are ignored; an empty table gives no rows.
    """
    rows = columns_of(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def finish(chunk: Chunk, gone: np.ndarray, _: pa.Table) -> pa.Table:
        out = []
        for k, (doc, blob) in enumerate(zip(chunk.ids.tolist(), chunk.blobs)):
            own = gone[chunk.first[k] : chunk.first[k + 1]]
            words = blob.split()
            removed = int(own.sum())
            kept = b" ".join(compress(words, (~own).tolist())) if removed else b" ".join(words)
            out.append((None if doc == _NULL_ID else doc, len(words), removed, hashlib.sha256(kept).hexdigest()))
        return _batch(out, schema)

    return find_repeats(rows, window, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated words cut from ``text``; a text without any stays as it is.

    A cut takes the word and the white space after it. ``n_chars``, where
    present, follows the new text. Rows and other columns stay, those of null and empty texts too;
    of repeated rows the first keeps its words; an empty table stays empty.
    """

    def finish(chunk: Chunk, gone: np.ndarray, rows: pa.Table) -> pa.Table:
        texts = rows.column("text").to_pylist()
        for k, place in enumerate(chunk.order):
            a, b = int(chunk.first[k]), int(chunk.first[k + 1])
            if not gone[a:b].any():
                continue
            base, blob = int(chunk.begins[k]), chunk.blobs[k]
            starts = chunk.starts[a:b] - base
            stops = np.append(starts[1:], len(blob))
            cut = np.concatenate([[False], gone[a:b], [False]]).astype(np.int8)
            opens, closes = np.flatnonzero(np.diff(cut) == 1), np.flatnonzero(np.diff(cut) == -1)
            kept, at = [], 0
            for i, j in zip(opens.tolist(), closes.tolist()):
                kept.append(blob[at : int(starts[i])])
                at = int(stops[j - 1])
            kept.append(blob[at:])
            texts[place] = b"".join(kept).decode("utf-8", "surrogatepass")
        names = rows.column_names
        rows = rows.set_column(names.index("text"), "text", pa.array(texts, pa.string()))
        if "n_chars" in names:
            kind = rows.schema.field("n_chars").type
            sizes = pa.array([None if t is None else len(t) for t in texts], kind)
            rows = rows.set_column(names.index("n_chars"), "n_chars", sizes)
        return rows

    return find_repeats(docs, window, finish, docs.schema)
