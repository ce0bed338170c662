"""Approximate nearest neighbours by a permutation index with pivot inverted files."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, columns_of, parallelism

#: Vectors that pivots are chosen from, at most, by a hash of the vector; the index holds every vector.
FIT_ROWS = 4096
PIVOTS = 1024
#: Nearest pivots that represent a vector, in order: it is posted to their inverted files, and a query looks into those of its own.
PREFIX = 96
#: Share of a block that is reranked exactly, after ranking by footrule.
RERANK = 0.1
#: Bytes of the different vectors of a block, at least (where there are fewer blocks than tasks) and at most.
BLOCK_LEAST, BLOCK = 4 << 20, 32 << 20
#: Bytes of the different query vectors that meet a block in one task.
QUERIES = 16 << 20


def choose_pivots(sample: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Spread-out rows of a sample: each next one is farthest from those chosen before."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(pivots, len(sample)):
        k = int(far.argmax())
        if far[k] <= 0:
            break
        chosen.append(k)
        far = np.minimum(far, ((sample - sample[k]) ** 2).sum(1))
    return sample[chosen]


def lift(x: np.ndarray, longest: float) -> np.ndarray:
    """One more dimension that gives all vectors one length, so that the nearest has the largest inner product."""
    rest = np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))
    return np.hstack([x, rest[:, None]])


def prefixes(x: np.ndarray, pivots: np.ndarray, size: int, step: int = 4096) -> np.ndarray:
    """The numbers of each row's nearest pivots, nearest first (ties to the smaller number)."""
    out, square = np.empty((len(x), size), np.int32), (pivots * pivots).sum(1)
    for at in range(0, len(x), step):
        distance = square - 2 * x[at : at + step] @ pivots.T
        near = np.argpartition(distance, size - 1, axis=1)[:, :size]
        near.sort(axis=1)
        order = np.argsort(np.take_along_axis(distance, near, 1), axis=1, kind="stable")
        out[at : at + step] = np.take_along_axis(near, order, 1)
    return out


class InvertedFiles:
    """For each pivot, the rows that have it in their prefix and at which place."""

    def __init__(self, prefix: np.ndarray, pivots: int):
        rows, size = prefix.shape
        self.rows, self.size = rows, size
        order = np.argsort(prefix.ravel(), kind="stable")
        self.row, self.place = (order // size).astype(np.int32), (order % size).astype(np.int32)
        self.edges = np.searchsorted(prefix.ravel()[order], np.arange(pivots + 1))

    def footrule(self, prefix: np.ndarray) -> np.ndarray:
        """Spearman's footrule of every row to a prefix, a missing pivot standing just past its end.

        It starts from that of disjoint prefixes, and each pivot that both have takes its part off:
        only the files of the prefix's own pivots are read.
        """
        size, files = self.size, [(own, self.edges[p], self.edges[p + 1]) for own, p in enumerate(prefix.tolist())]
        rows = np.concatenate([self.row[a:b] for _, a, b in files])
        shared = np.concatenate([size - np.maximum(self.place[a:b], own) for own, a, b in files])
        return size * (size + 1) - 2 * np.bincount(rows, shared, self.rows).astype(np.int64)


def search_block(vectors: np.ndarray, first_ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, longest: float, k: int, share: float, prefix: int, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query numbers, row numbers, exact inner products) of each query's best rows among the reranked ones.

    Rows are ranked by footrule (ties to the smaller first id); the best share of the
    block, and at least twenty times those kept, is reranked in double precision. ``alone`` marks rows that
    hold no id but their first. Without those of any one id, ``k`` rows are left, or all the others.
    """
    order = np.argsort(first_ids, kind="stable")
    vectors, label, single = vectors[order], first_ids[order], alone[order]
    most = int(np.unique(label[single], return_counts=True)[1].max(initial=1))
    index = InvertedFiles(prefixes(lift(vectors, longest), pivots, prefix), len(pivots))
    asked = prefixes(np.hstack([queries, np.zeros((len(queries), 1))]), pivots, prefix)
    n = len(vectors)
    keep = k + min(k, most)
    budget = min(n, max(20 * keep, ceil(share * n)) + most - 1)
    numbers, rows, scores = [], [], []
    position = np.arange(n)
    for number, (query, own) in enumerate(zip(queries, asked)):
        far = index.footrule(own) * n + position
        near = np.argpartition(far, budget - 1)[:budget] if budget < n else position
        exact = inner(vectors[near], query)
        best = np.lexsort((near, -exact))
        if most > k:  # more than k rows of one id alone serve nobody
            held = near[best]
            best = best[~single[held] | (times_before(label[held], single[held]) < k)]
        best = best[:keep]
        numbers.append(np.full(len(best), number))
        rows.append(order[near[best]])
        scores.append(exact[best])
    return np.concatenate(numbers), np.concatenate(rows), np.concatenate(scores)


def times_before(values: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """How often each value stands before its place, among those counted; 0 for the others."""
    out = np.zeros(len(values), np.int64)
    own = values[counted]
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    before = np.empty(len(own), np.int64)
    before[order] = np.arange(len(own)) - np.searchsorted(ranked, ranked)
    out[counted] = before
    return out


def inner(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed one component after the other for any grouping of rows."""
    total = np.zeros(len(rows))
    for k in range(rows.shape[1]):
        total += rows[:, k] * query[k]
    return total


def vector_classes(embeddings: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """(rows: vec_id, key; classes: key, vector, ids): equal vectors are one class with its ``keep`` smallest different ids.

    Each of ``ids`` is (vec_id, n): n rows have it, counted up to ``keep``.
    A query's nearest never need more than so many of equal vectors; its class
    is searched once. Ids are ranked in salted parts, so a very common vector
    is not one task.
    """
    usable = columns_of(embeddings, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = usable.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", fine) & F.exists("vector", lambda x: x != 0))
    # adding zero makes minus zero zero, so equal vectors have equal bytes
    usable = usable.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    usable = usable.withColumn("key", F.sha2(F.array_join(F.transform("vector", lambda x: x.cast("string")), ","), 256))
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(parallelism(embeddings.sparkSession)))
    part = usable.groupBy("key", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(keep)).cast("int").alias("n")).withColumn("salt", salt)
    least = part.withColumn("r", F.row_number().over(Window.partitionBy("key", "salt").orderBy("vec_id"))).filter(F.col("r") <= keep)
    ids = least.groupBy("key").agg(F.slice(F.sort_array(F.collect_list(F.struct("vec_id", "n"))), 1, keep).alias("ids"))
    one = usable.groupBy("key").agg(F.first("vector").alias("vector"))
    return usable.select("vec_id", "key"), one.join(ids, "key")


def sample_of(classes: DataFrame, dims: int, rows: int = FIT_ROWS) -> dict[int, np.ndarray]:
    """Vectors of each length that pivots are chosen from, ``rows`` in all at most (one a length at least)."""
    each = max(1, rows // dims)
    place = Window.partitionBy("d").orderBy("key")
    held = classes.select(F.size("vector").alias("d"), "key", "vector").withColumn("r", F.row_number().over(place))
    found: dict[int, list] = {}
    for r in held.filter(F.col("r") <= each).select("d", "r", "vector").collect():
        found.setdefault(r["d"], []).append((r["r"], r["vector"]))
    return {d: np.array([v for _, v in sorted(own)]) for d, own in found.items()}


def nearest(embeddings: DataFrame, k: int = 20, every: int = 20, share: float = RERANK, pivots: int = PIVOTS, prefix: int = PREFIX) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products found for each query row.

    Queries are the rows whose vec_id is divisible by ``every``, candidates all
    rows but the query's own. Vectors null, zero, or with a null or
    non-finite component take no part, nor do null ids. Vectors of different lengths have no inner product:
    each length is an index of its own, and a query is answered from that of its length.
    Repeated rows with one vec_id count once for each. Fewer
    candidates than ``k`` are all returned; an empty table gives no rows.

    Different vectors are dealt to blocks of the index, and different query vectors to groups; every
    pair of block and group is a task of bounded size, and a block is sent once a group. Pivots come from a bounded sample.
    """
    spark = embeddings.sparkSession
    keep = k + 1  # the query's own id may be among them, once in a class
    rows, classes = vector_classes(embeddings, keep)
    classes = checkpoint(classes)
    asking = checkpoint(rows.filter(F.pmod("vec_id", F.lit(every)) == 0))
    size, norm = F.size("vector").alias("d"), F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    asked = classes.join(asking.select("key").distinct(), "key", "left_semi").select("key", "vector")
    counts = classes.groupBy(size).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("norm"))
    # a row for each length of vectors
    lengths = counts.join(asked.groupBy(size).agg(F.count(F.lit(1)).alias("q")), "d").collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    longest = {r["d"]: float(r["norm"]) ** 0.5 for r in lengths}
    chosen = {d: choose_pivots(lift(x, longest[d]), pivots) for d, x in sample_of(classes.filter(size.isin(list(longest))), len(lengths)).items()}
    shared = spark.sparkContext.broadcast(chosen)  # at most FIT_ROWS vectors

    tasks = parallelism(spark)
    size_of = lambda n, d: 8 * n * d
    blocks = {r["d"]: max(1, ceil(size_of(r["n"], r["d"]) / BLOCK), min(tasks, size_of(r["n"], r["d"]) // BLOCK_LEAST)) for r in lengths}
    groups = {r["d"]: ceil(size_of(r["q"], r["d"]) / QUERIES) for r in lengths}

    def parts(counted: dict[int, int]):
        book = F.create_map(*[F.lit(x) for pair in counted.items() for x in pair])
        return F.element_at(book, F.size("vector"))

    deal = lambda column, n: F.pmod(F.xxhash64(column), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    indexed = classes.filter(size.isin(list(longest)))
    held = indexed.select(size, "key", "vector", F.col("ids")[0]["vec_id"].alias("first_id"), (F.size("ids") == 1).alias("alone"), deal("key", parts(blocks)).alias("block"), all_of(parts(groups)).alias("part"))
    wanted = asked.select(size, F.col("key").alias("query"), F.col("vector").alias("asked"), deal("key", parts(groups)).alias("part"), all_of(parts(blocks)).alias("block"))
    names = pa.schema([("query", pa.string()), ("key", pa.string()), ("score", pa.float64())])

    def matrix(table: pa.Table, name: str) -> np.ndarray:
        flat = table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(table.num_rows, -1)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return names.empty_table()
        d = left.column("d")[0].as_py()
        own = shared.value[d]
        alone = left.column("alone").to_numpy()
        asking, found, score = search_block(matrix(left, "vector"), left.column("first_id").to_numpy(), matrix(right, "asked"), own, longest[d], k, share, min(prefix, len(own)), alone)
        return pa.Table.from_arrays([right.column("query").take(pa.array(asking)), left.column("key").take(pa.array(found)), pa.array(score)], schema=names)

    by = ["d", "block", "part"]
    near = held.groupBy(*by).cogroup(wanted.groupBy(*by)).applyInArrow(work, "query string, key string, score double")
    # classes to ids: at most k entries of one id, and 2 k of all, so that k are left without those of any one id
    listed = near.join(classes.select("key", "ids"), "key").select("query", "score", F.explode("ids").alias("id")).select("query", "score", "id.vec_id", "id.n")
    own = Window.partitionBy("query", "vec_id").orderBy(F.desc("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    few = listed.withColumn("o", F.row_number().over(own)).filter(F.col("o") <= k)
    top = few.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= 2 * k)
    lists = top.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score", "n"))).alias("found"))
    others = F.filter("found", lambda x: x["vec_id"] != F.col("vec_id"))
    rows_of = F.flatten(F.transform(others, lambda x: F.array_repeat(x, x["n"])))
    answers = asking.join(lists, asking.key == lists.query).select(
        F.col("vec_id").alias("query_id"), F.slice(rows_of, 1, k).alias("found")
    )
    return answers.select("query_id", F.posexplode("found").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")
    )
