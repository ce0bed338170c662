"""SimHash fingerprints, linked by a self-join of binary tries and joined into components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, columns_of, fresh, hot_keys, parallelism, spread_join, text_batches

SHINGLE = 4
BUDGET = 4
SEED = 42
#: A-Z to a-z; every other byte stays.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Shingles hashed at a time, so that a very long text needs no more memory than another.
_SLICE = 200_000
#: Entries that a task joins at a time, or a single trie where that has more.
_TRIES = 500_000


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Bit k is 1 if it is set in over half the hashes of the text's shingles; no words: 0."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: 1 - width], ends[width - 1 :]
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _SLICE):
        a, b = starts[at : at + _SLICE].tolist(), ends[at : at + _SLICE].tolist()
        hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(a, b)], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64)
    over = (2 * total > len(starts)).astype(np.uint8)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE, *more: Column) -> DataFrame:
    """(doc_id, fp): the signed 64-bit form of every whole text's fingerprint; ``more`` are columns beside it."""

    @F.arrow_udf("long")
    def fp(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint(t.as_py(), width) for t in texts), np.uint64, len(texts))
        return pa.array(found.view(np.int64), pa.int64())

    text_batches(docs.sparkSession)
    rows = columns_of(docs, "doc_id", "text")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), fp("text").alias("fp"), *more)


class Forest:
    """Union-find over positions, joined in bulk; the root of a tree is its smallest position."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            above = self.up[self.up]
            if np.array_equal(above, self.up):
                return above
            self.up = above

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Link all pairs: hook larger roots under smaller ones until none is left to hook."""
        while len(a):
            root = self.roots()
            ra, rb = root[a], root[b]
            differ = ra != rb
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))


def trie_links(keys: np.ndarray, tops: np.ndarray, bits: int, budget: int, most: int = 2_000_000) -> np.ndarray:
    """The component root (position) of each key, linking keys at ``budget`` or fewer differing bits.

    ``keys`` are sorted within tries; ``tops`` are the bounds of the tries, and keys of
    different tries are not compared. A trie node is a range of sorted keys
    that agree on their first bits. Pairs of nodes start as (trie, trie, 0) and go down
    together, bit by bit: equal bits keep the number of differing bits, unequal
    ones add 1, and a pair beyond the budget is dropped. A pair of single keys is settled
    at once by counting the bits of their difference, a pair whose nodes lie in
    one component already is dropped as well, and nodes whose remaining bits
    cannot exceed the budget are linked whole.
    """
    forest = Forest(len(keys))
    tops = np.asarray(tops, np.int64)
    stack = [(bits - 1, tops[:-1], tops[1:], tops[:-1], tops[1:], np.zeros(len(tops) - 1, np.int8))]
    while stack:
        bit, a0, a1, b0, b1, used = stack.pop()
        if len(a0) > most:
            half = len(a0) // 2
            stack += [(bit, *(x[half:] for x in (a0, a1, b0, b1, used))), (bit, *(x[:half] for x in (a0, a1, b0, b1, used)))]
            continue
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            x, y = a0[single], b0[single]
            near = (x != y) & (np.bitwise_count(keys[x] ^ keys[y]) <= budget)
            forest.join(x[near], y[near])
        rest = ~single
        whole = rest & (used + bit + 1 <= budget)
        if whole.any():  # all below is within the budget: chain each range, then tie the two
            for lo, hi in ((a0, a1), (b0, b1)):
                n = hi[whole] - lo[whole]
                at = np.repeat(lo[whole], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                forest.join(np.repeat(lo[whole], n), at)
            forest.join(a0[whole], b0[whole])
            rest &= ~whole
        if not rest.any() or bit < 0:
            continue
        a0, a1, b0, b1, used = (x[rest] for x in (a0, a1, b0, b1, used))
        root = forest.roots()
        steps = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
        lone = (steps[a1 - 1] == steps[a0]) & (steps[b1 - 1] == steps[b0]) & (root[a0] == root[b0])
        a0, a1, b0, b1, used = (x[~lone] for x in (a0, a1, b0, b1, used))
        ones = np.concatenate([[0], np.cumsum((keys >> np.uint64(bit) & np.uint64(1)).astype(np.int64))])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        twin = (a0 == b0) & (a1 == b1)  # a node with itself: its cross pair is taken once
        parts = [
            (a0, am, b0, bm, used, None),
            (am, a1, bm, b1, used, None),
            (a0, am, bm, b1, used + 1, None),
            (am, a1, b0, bm, used + 1, ~twin),
        ]
        new = []
        for p0, p1, q0, q1, u, only in parts:
            keep = (p1 > p0) & (q1 > q0) & (u <= budget)
            keep &= ~((p0 == q0) & (p1 == q1) & (p1 - p0 == 1))
            if only is not None:
                keep &= only
            new.append([x[keep] for x in (p0, p1, q0, q1, u.astype(np.int8))])
        joined = [np.concatenate(x) for x in zip(*new)]
        if len(joined[0]):
            stack.append((bit - 1, *joined))
    return forest.roots()


def block_layout(budget: int, bits: int = 64) -> list[tuple[int, int]]:
    """(shift, width) of budget + 1 blocks that cover all bits: two keys within the budget agree on one."""
    edges = [round(k * bits / (budget + 1)) for k in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def block_value(fp, at: int, width: int):
    return fp if width == 64 else F.shiftrightunsigned(fp, at).bitwiseAND((1 << width) - 1)


def near_links(distinct: DataFrame, budget: int = BUDGET, name: str = "fp") -> DataFrame:
    """(fp, root): links between distinct fingerprints that join all within ``budget`` bits.

    Fingerprints within the budget agree on at least one of budget + 1 blocks.
    Each is sent once for each block to the trie of that block's value; a task
    joins the tries it got, some whole ones at a time, and emits a link from each key to the smallest of
    its component there. The links are a spanning forest, never the pairs of
    a group. Both ends are told by the column ``name``, which must differ between fingerprints.
    """
    layout = block_layout(budget)
    entries = distinct.select("fp", F.col(name).alias("name"), F.explode(F.array(*[
        F.struct(F.lit(k).alias("block"), block_value(F.col("fp"), at, width).alias("value"))
        for k, (at, width) in enumerate(layout)
    ])).alias("key")).select("fp", "name", "key.block", "key.value")

    def join(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """The links of whole tries."""
        fps, names = table.column("fp").to_numpy().view(np.uint64), table.column("name").combine_chunks()
        block, value = table.column("block").to_numpy(), table.column("value").to_numpy()
        for k, (at, width) in enumerate(layout):
            mine = np.flatnonzero(block == k)
            if not len(mine):
                continue
            # the trie's keys are the other bits, rotated so that the block is on top and equal
            own, top = fps[mine], value[mine].astype(np.uint64)
            turn = np.uint64(at + width)
            turned = own if at + width == 64 else (own << (np.uint64(64) - turn)) | (own >> turn)
            order = np.argsort(turned, kind="stable")
            turned, top, mine = turned[order], top[order], mine[order]
            tops = np.concatenate([[0], np.flatnonzero(np.diff(top)) + 1, [len(top)]])
            root = trie_links(turned, tops, 64 - width, budget)
            linked = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(mine[linked])), names.take(pa.array(mine[root[linked]]))], names=["fp", "root"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n > _TRIES:
                table = pa.Table.from_batches(held)
                block, value = table.column("block").to_numpy(), table.column("value").to_numpy()
                open_ = np.flatnonzero((block != block[-1]) | (value != value[-1]))
                whole = int(open_[-1]) + 1 if len(open_) else 0  # the last trie may go on
                if whole:
                    yield from join(table.slice(0, whole))
                held, n = table.slice(whole).to_batches(), table.num_rows - whole
        if n:
            yield from join(pa.Table.from_batches(held))

    parts = parallelism(distinct.sparkSession)
    kind = distinct.schema[name].dataType.simpleString()
    tries = entries.repartition(parts, "block", "value").sortWithinPartitions("block", "value")
    return tries.mapInArrow(work, f"fp {kind}, root {kind}")


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of a link between two nodes of any ordered type.

    Large-star and small-star rounds alternate until nothing changes: each
    node's larger neighbours, then its smaller ones, are tied to its smallest neighbour.
    A round shuffles the links twice and cuts its lineage with a
    checkpoint; the number of rounds grows with the logarithm of the longest chain. Links of a node with more than an
    even share of them are joined in salted parts; no node has more links within a round than at its start.
    """
    edges = links.select(F.col(left).alias("u"), F.col(right).alias("v")).filter("u <> v")
    edges = checkpoint(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = (edges.count(),)
    while True:
        both = edges.union(edges.select("v", "u"))
        hot = hot_keys(both.groupBy("u").agg(F.count(F.lit(1)).alias("n")), "u", "n", 2 * mark[0])
        least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
        # large star: a larger neighbour v of u is tied to the smallest around u
        large = spread_join(both, least, "u", hot, F.xxhash64("v")).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = large.filter("u <> v").distinct()
        # small star: u and its smaller neighbours are tied to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("least"))
        tied = spread_join(large, low, "u", hot, F.xxhash64("v"))
        small = tied.select("u", F.col("least").alias("v")).union(
            tied.filter("v > least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        )
        edges = checkpoint(small.distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            tops = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)
        mark = now


def with_tops(distinct: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``distinct(fp, name, ...)`` with ``top``: the smallest name of each one's component.

    The components are told by names from the start, so that no later step brings one of them together.
    """
    reached = components(near_links(distinct, budget, "name"), "fp", "root")
    found = distinct.join(reached, distinct.name == reached.node, "left")
    return found.select(*[distinct[c] for c in distinct.columns], F.coalesce("component", "name").alias("top"))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs(doc_id, text)``.

    ASCII letters are lower-cased; words are runs without ASCII white space.
    Texts with fewer words than a shingle use their whole sequence; null,
    empty and blank texts have fingerprint zero and link like any other. Equal
    fingerprints always link, so copies meet by grouping alone. component_id
    is the smallest doc_id reachable. Null doc_ids stay null rows and count
    after all others (a component of nulls alone has a null id); repeated rows
    are kept; other columns are ignored; an empty table gives no rows.
    """
    marked = checkpoint(fingerprints(docs, width))
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    # fingerprints are named by their smallest doc_id, then by themselves
    name = F.struct(F.col("first").isNull().alias("last"), "first", "fp").alias("name")
    distinct = checkpoint(distinct.select("fp", "n", name))
    named = with_tops(distinct, budget).select("fp", F.col("top.first").alias("component_id"))
    return spread_join(marked, named, "fp", hot_keys(distinct, "fp", "n")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, width: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest doc_id, and then of the smallest hash of its text.

    Null doc_ids come after all others. A doc_id alone never drops a row: rows of one doc_id with different
    texts stay or go by their own components. Rows equal in both doc_id and text count as copies; all columns stay.
    Null, empty and blank texts are one component; an empty table stays empty. Whole texts are shuffled once.
    """
    if not docs.columns:
        return docs
    # equal keys have equal texts, so equal fingerprints: a key lies in one component
    number = lambda: F.col("doc_id").cast("long")
    key = F.concat_ws(":", F.coalesce(number().cast("string"), F.lit("")), F.coalesce(F.md5(F.encode("text", "UTF-8")), F.lit("")))
    mark = fresh(docs, "kept_key")
    marked = fingerprints(docs, width, key.alias("key"))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    distinct = checkpoint(marked.groupBy("fp").agg(F.min(place).alias("name")))
    # of each component, the fingerprint whose name is the smallest
    firsts = with_tops(distinct, budget).filter("name = top").select(F.col("name.key").alias(mark))
    # rows of one key meet before the join, part by part, so that a very common one is not one task
    copies = docs.withColumn(mark, key).dropDuplicates([mark])
    return copies.join(firsts, mark, "left_semi").select(*docs.columns)
