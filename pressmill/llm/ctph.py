"""Context-triggered piecewise hashes of texts, compared by edit distance at compatible block sizes."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_id_order, stored, text_batches

#: Bytes that the rolling hash sees.
SPAN = 7
SMALLEST_BLOCK = 3
#: Signature characters that the block size aims at, and the most that it gives.
TARGET, MOST = 64, 256
#: Signatures without a common run of so many characters (or of the shorter one) are unlike.
RUN = 3
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def rolling(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: a sum, a weighted sum and a shifted xor of the last SPAN bytes."""
    n = len(data)
    padded = np.zeros(n + SPAN - 1, np.uint32)
    padded[SPAN - 1 :] = data
    plain, weighted, turned = (np.zeros(n, np.uint32) for _ in range(3))
    for back in range(SPAN):
        byte = padded[SPAN - 1 - back : SPAN - 1 - back + n]
        plain += byte
        weighted += byte * np.uint32(SPAN - back)
        turned ^= byte << np.uint32(5 * back)
    return plain + weighted + turned


def signature(data: bytes, ends: list[int]) -> str:
    """A character for each piece; the last piece runs to the end of the data."""
    out, at = [], 0
    for end in [*ends, len(data)]:
        if end > at:
            out.append(_ALPHABET[zlib.crc32(data[at:end]) * 2654435761 >> 26 & 63])
        at = end
    return "".join(out)


def fingerprint(text: str | None) -> str:
    """``block:signature:signature at twice the block`` of a whole text; null is the empty text.

    A piece ends where the rolling hash, modulo the block size, is the block
    size less one. The block size is the smallest 3 * 2**k whose expected
    number of pieces is TARGET or fewer, halved while it finds less than half of those (and the half not over MOST),
    doubled while it finds over MOST, as in texts of one repeated letter. Ends at a doubled size are ends at the size itself.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    block = SMALLEST_BLOCK
    while block * TARGET < len(data):
        block *= 2
    roll = rolling(np.frombuffer(data, np.uint8))
    found = lambda size: np.flatnonzero(roll % np.uint32(size) == size - 1)
    ends = found(block)
    while len(ends) > MOST:
        block *= 2
        ends = ends[roll[ends] % np.uint32(block) == block - 1]
    while len(ends) < TARGET // 2 and block > SMALLEST_BLOCK and len(finer := found(block // 2)) <= MOST:
        block, ends = block // 2, finer
    wide = ends[roll[ends] % np.uint32(2 * block) == 2 * block - 1]
    return f"{block}:{signature(data, (ends + 1).tolist())}:{signature(data, (wide + 1).tolist())}"


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance by bit-parallel columns, one big integer for the shorter string."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    mask, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = mask, 0, len(a)
    for c in b:
        eq = places.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        rise = down | ~(diagonal | up) & mask
        fall = up & diagonal
        distance += bool(rise & top) - bool(fall & top)
        rise = (rise << 1 | 1) & mask
        up = (fall << 1 & mask) | ~(diagonal | rise) & mask
        down = rise & diagonal
    return distance


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    run = min(RUN, len(a), len(b))
    if not run or {a[k : k + run] for k in range(len(a) - run + 1)}.isdisjoint(b[k : k + run] for k in range(len(b) - run + 1)):
        return 0.0
    return 1.0 - edit_distance(a, b) / max(len(a), len(b))


def likeness(left: str, right: str) -> float:
    """0 to 1: the best of the signatures at block sizes that both fingerprints have; equal ones: 1."""
    if left == right:
        return 1.0
    a, b = ((int(x[0]), x[1], x[2]) for x in (left.split(":"), right.split(":")))
    pairs = [(x, y) for p, x in ((a[0], a[1]), (2 * a[0], a[2])) for q, y in ((b[0], b[1]), (2 * b[0], b[2])) if p == q]
    return max((_alike(x, y) for x, y in pairs), default=0.0)


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of ``docs(doc_id, text)`` and of its edited text, with two likenesses.

    The edited text has its last floor(n / 2) code points replaced by the first
    as many (or all) of the next document in ascending doc_id order (null ids
    first, rows of one doc_id by text; after the last: the first). Null texts
    are empty, and an empty text's edited text is empty, so they are alike. One
    document alone is its own next. Other columns are ignored; an
    empty table gives no rows.

    Texts are dealt to ranges of doc_id once. The first and last document of each range are stored with the results;
    the last of a range then meets the first of the next, two texts a range.
    """
    spark = docs.sparkSession
    text_batches(spark)
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    edge_kinds = [pa.int32(), pa.bool_(), pa.string()]
    schema = pa.schema(list(zip([*names, "part", "opens", "text"], kinds + edge_kinds)))
    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def row(doc, text: str, own: str, after: str, then: str) -> tuple:
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        print_ = own if edited == text else fingerprint(edited)
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return doc, n, digest, own, print_, likeness(own, print_), likeness(own, then)

    def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None  # held: (doc_id, text, fingerprint) that waits for its next
        edge = lambda opens: (held[0], None, None, held[2], None, None, None, part, opens, held[1])
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                mark = fingerprint(text)
                if held is not None:
                    out.append((*row(*held, text, mark), None, None, None))
                first, held = held is None, (doc, text, mark)
                if first:
                    out.append(edge(True))
            yield batch_of(out, schema)
        if held is not None:
            yield batch_of([edge(False)], schema)

    made = stored(in_id_order(docs).mapInArrow(work, ddl + ", part int, opens boolean, text string"), "fingerprints")
    edges = made.filter("part is not null")
    parts = sorted(r["part"] for r in edges.filter("opens").select("part").collect())  # a number a range
    if not parts:
        return made.select(*names)
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    heads = edges.filter("opens").select(F.col("part").alias("next_part"), F.col("text").alias("after"), F.col("fingerprint").alias("then"))
    met = edges.filter("not opens").join(following, "part").join(heads, "next_part").select("doc_id", "text", "fingerprint", "after", "then")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [row(doc, *texts) for doc, *texts in zip(*(c.to_pylist() for c in batch.columns))]
            yield batch_of(found, pa.schema(list(zip(names, kinds))))

    return made.filter("part is null").select(*names).unionByName(met.mapInArrow(last, ddl))
