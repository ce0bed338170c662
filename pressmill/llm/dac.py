"""Directly addressable codes: token ids in files that give any token without decoding a block.

An id is cut into chunks of eight bits, lowest first. Level k holds the k-th
chunks of all ids that have one, and a bit for each that tells whether a
higher chunk follows. The place of an id's chunk on the next level is the
number of such bits before it, which a rank directory (one count for each
``RANK_STEP`` bits) gives in constant time.

A file is: magic, number of documents, number of tokens, number of levels;
document ids and null flags; token offsets of documents; then for each level its length, its
chunks, its bitmap and its directory. Integers are little-endian, and sections
start at multiples of eight bytes, so a mapped file is read in place.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, in_id_order, shared_dir, text_batches
from .tokens import byte_bpe

MAGIC = b"DACIDS01"
#: A file ends with the document that brings it to so many ids.
FILE_IDS = 8_000_000
RANK_STEP = 512
_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def _section(out: io.BytesIO, values: np.ndarray) -> None:
    out.write(values.tobytes())
    out.write(b"\0" * (-out.tell() % 8))


def encode(doc_ids: list[int | None], offsets: np.ndarray, ids: np.ndarray) -> bytes:
    """The file of documents whose ids are ``ids[offsets[k]:offsets[k + 1]]``."""
    ids = np.asarray(ids, "<u4")
    levels, rest = [], ids
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (RANK_STEP // 8), np.uint8)])
        ones = _ONES[bits].reshape(-1, RANK_STEP // 8).sum(1, dtype=np.int64)
        directory = np.concatenate([[0], np.cumsum(ones)]).astype("<u8")
        levels.append(((rest & 255).astype(np.uint8), bits, directory))
        if not more.any():
            break
        rest = rest[more] >> 8
    out = io.BytesIO()
    out.write(MAGIC)
    _section(out, np.array([len(doc_ids), len(ids), len(levels)], "<u8"))
    _section(out, np.array([0 if d is None else d for d in doc_ids], "<i8"))
    _section(out, np.array([d is None for d in doc_ids], np.uint8))
    _section(out, np.asarray(offsets, "<u8"))
    for chunks, bits, directory in levels:
        _section(out, np.array([len(chunks), len(bits), len(directory)], "<u8"))
        _section(out, chunks)
        _section(out, bits)
        _section(out, directory)
    return out.getvalue()


class TokenFile:
    """Random access to a file's tokens; ``source`` is its bytes or a memory map of them."""

    def __init__(self, source):
        self.at = 8
        self.data = np.frombuffer(source, np.uint8)
        if self.data[:8].tobytes() != MAGIC:
            raise ValueError("not a file of directly addressable token ids")
        docs, self.tokens, levels = map(int, self._take("<u8", 3))
        self.doc_ids = self._take("<i8", docs)
        self.nulls = self._take(np.uint8, docs)
        self.offsets = self._take("<u8", docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(levels):
            n, b, d = map(int, self._take("<u8", 3))
            self.levels.append((self._take(np.uint8, n), self._take(np.uint8, b), self._take("<u8", d)))

    def _take(self, kind, n: int) -> np.ndarray:
        size = np.dtype(kind).itemsize * n
        found = self.data[self.at : self.at + size].view(kind)
        self.at += size + -size % 8
        return found

    def _rank(self, level: int, at: int) -> int:
        """Bits set before ``at``: a directory entry and less than one step of bitmap."""
        _, bits, directory = self.levels[level]
        step = at // RANK_STEP
        whole = bits[step * RANK_STEP // 8 : at // 8]
        part = _ONES[bits[at // 8] & ((1 << at % 8) - 1)] if at % 8 else 0
        return int(directory[step]) + int(_ONES[whole].sum()) + int(part)

    def token(self, at: int) -> int:
        """The id at a place of the file, from one chunk a level."""
        if not 0 <= at < self.tokens:
            raise IndexError(at)
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[at]) << (8 * level)
            if not bits[at // 8] >> (at % 8) & 1:
                break
            at = self._rank(level, at)
        return value

    def read(self, start: int, end: int) -> np.ndarray:
        """The ids of a range; each level's part is found by two ranks."""
        out = np.zeros(end - start, "<u4")
        places = np.arange(end - start)
        for level, (chunks, bits, _) in enumerate(self.levels):
            if start == end:
                break
            out[places] |= chunks[start:end].astype("<u4") << np.uint32(8 * level)
            low = start // 8
            flags = np.unpackbits(bits[low : -(-end // 8)], bitorder="little")[start - 8 * low : end - 8 * low]
            places = places[flags.astype(bool)]
            start = self._rank(level, start)
            end = start + len(places)
        return out


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Write the ids of all documents in ascending doc_id order; one row a file: (part, number, path, docs, tokens).

    A task writes the files of a range of doc_id, each of bounded size (or of one document), and holds no more than
    one of them. It writes under a name of its own and then moves the file to its final name,
    so a repeated or speculative task replaces a file by an equal one.
    """
    text_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])

    def save(part: int, number: int, doc_ids: list, blobs: list[bytes]) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in blobs])])
        ids = np.frombuffer(b"".join(blobs), "<u4")
        blobs.clear()
        data = encode(doc_ids, offsets, ids)
        store, base = filesystem(folder)
        name, trial = f"part-{part:06d}-{number:06d}.dac", f"{base}/.trial-{uuid.uuid4().hex}"
        store.create_dir(base, recursive=True)
        with store.open_output_stream(trial) as f:
            f.write(data)
        store.move(trial, f"{base}/{name}")
        row = [[part], [number], [f"{folder}/{name}"], [len(doc_ids)], [int(offsets[-1])]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, schema.types)], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part = byte_bpe(tokenizer), TaskContext.get().partitionId()
        number, size, doc_ids, blobs = 0, 0, [], []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids.append(doc)
                blobs.append(codec.ids(text.as_py()) + end)
                size += len(blobs[-1]) // 4
                if size >= FILE_IDS:
                    yield save(part, number, doc_ids, blobs)
                    number, size, doc_ids, blobs = number + 1, 0, [], []
        if doc_ids:
            yield save(part, number, doc_ids, blobs)

    return in_id_order(docs).mapInArrow(work, "part int, number int, path string, docs long, tokens long")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, tokens_before, doc_id, n_tokens, ids_crc32) of every document, from the files alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(folder).select("path", "content")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                held = TokenFile(content.as_buffer())
                bounds = held.offsets.tolist()
                docs = pa.array(held.doc_ids, pa.int64(), mask=held.nulls.astype(bool))
                crcs = [zlib.crc32(held.read(a, b).tobytes()) for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(docs), pa.string()),
                        pa.array(bounds[:-1], pa.int64()),
                        docs,
                        pa.array(np.diff(held.offsets), pa.int64()),
                        pa.array(crcs, pa.int64()),
                    ],
                    names=["path", "tokens_before", "doc_id", "n_tokens", "ids_crc32"],
                )

    return files.mapInArrow(work, "path string, tokens_before long, doc_id long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write the files, read them back, and give each document's place, length and checksum.

    A null or empty text is the end id alone. Rows are in ascending doc_id
    order, null ids first; repeated doc_ids are documents of their own, by text. An
    empty table writes no file and gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    written = write_token_files(docs, tokenizer, end_id, folder).collect()  # a row a file
    if not written:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    before, starts = 0, []
    for part, number, _, _, tokens in sorted(written):
        starts.append((part, number, before))
        before += tokens
    firsts = spark.createDataFrame(starts, "part int, number int, files_before long")
    place = lambda k: F.regexp_extract("path", r"part-(\d+)-(\d+)\.dac$", k).cast("int")
    rows = read_token_files(spark, folder).withColumn("part", place(1)).withColumn("number", place(2))
    return rows.join(firsts, ["part", "number"]).select(
        "doc_id", (F.col("tokens_before") + F.col("files_before")).alias("start"), "n_tokens", "ids_crc32"
    )
