"""Quality scores by a regularised quadratic discriminant over transformed text statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, columns_of, fresh, text_batches

#: Labelled rows used for fitting, at most; taken by a hash of doc_id, so from the whole table.
FIT_ROWS = 20_000
#: Weight of the pooled covariance, and of its diagonal, in each class covariance.
POOLED, DIAGONAL = 0.1, 0.1
THRESHOLD = 0.3

_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "stop": b".,;:'-",
    "shout": b"!?",
    "symbol": b'#$%&*|<>{}[]=_@~^\\/+`"()',
    "space": b" ",
    "line": b"\n\r",
    "control": [*range(9), 11, 12, *range(14, 32), 127],
    "wide": range(128, 256),
}
_MEMBER = np.zeros((256, len(_CLASSES)))
for _k, _bytes in enumerate(_CLASSES.values()):
    _MEMBER[list(_bytes), _k] = 1
FEATURES = ["size", "words", "word_mean", "word_spread", "distinct_words", "distinct_lines", "ended", "entropy", *_CLASSES]


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text: logs of sizes, log odds of shares.

    Null, empty and blank texts have those of no words.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    sizes = np.fromiter(map(len, words), np.float64, len(words))
    lines = [x for x in data.split(b"\n") if x.strip(SPACE_BYTES)]
    share = counts[counts > 0] / max(n, 1)
    odds = lambda k, of: np.log((k + 0.5) / (of - k + 0.5))
    shares = counts @ _MEMBER
    return [
        np.log1p(n),
        np.log1p(len(words)),
        np.log1p(sizes.mean() if len(words) else 0),
        np.log1p(sizes.std() if len(words) else 0),
        odds(len(set(words)), len(words)) - 0.5 * np.log1p(len(words)),
        odds(len(set(lines)), len(lines)) - 0.5 * np.log1p(len(lines)),
        odds(sum(w[-1] in b".!?" for w in words), len(words)),
        float(-(share * np.log2(share)).sum()),
        *(odds(k, n) for k in shares),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussian classes with cached inverse Cholesky factors, and a calibration of their log ratio."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    whiten: tuple[np.ndarray, np.ndarray]
    log_det: tuple[float, float]
    slope: float
    offset: float

    def ratio(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, from Mahalanobis distances."""
        z = np.clip((x - self.centre) / self.scale, -20, 20)
        logs = []
        for k in (0, 1):
            d = (z - self.means[k]) @ self.whiten[k].T
            logs.append(-0.5 * (d * d).sum(1) - 0.5 * self.log_det[k])
        return logs[1] - logs[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * squash(self.ratio(x)) + self.offset, -60, 60)))


def squash(ratio: np.ndarray) -> np.ndarray:
    """The sign times the log of 1 + the size: monotone, and calm for far points."""
    return np.sign(ratio) * np.log1p(np.abs(ratio))


def fit(x: np.ndarray, y: np.ndarray, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Discriminant | None:
    """The discriminant of labelled rows; None if a class has fewer than two rows."""
    if min((y == 0).sum(), (y == 1).sum()) < 2:
        return None
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.clip((x - centre) / scale, -20, 20)
    groups = [z[y == k] for k in (0, 1)]
    means = tuple(g.mean(0) for g in groups)
    own = [np.cov(g.T, bias=True) for g in groups]
    both = sum(len(g) * c for g, c in zip(groups, own)) / len(z)
    whiten, log_det = [], []
    for c in own:
        c = (1 - pooled) * c + pooled * both
        c = (1 - diagonal) * c + diagonal * np.diag(np.diag(c)) + 1e-3 * np.eye(len(c))
        factor = np.linalg.cholesky(c)
        whiten.append(np.linalg.inv(factor))
        log_det.append(2 * float(np.log(np.diag(factor)).sum()))
    model = Discriminant(centre, scale, means, tuple(whiten), tuple(log_det), 1.0, 0.0)
    r, slope, offset = squash(model.ratio(x)), 1.0, 0.0
    for _ in range(50):  # Newton steps of a one-variable logistic regression, lightly held
        p = 1 / (1 + np.exp(-np.clip(slope * r + offset, -60, 60)))
        w = p * (1 - p)
        g = np.array([((p - y) * r).sum() + 1e-2 * slope, (p - y).sum() + 1e-2 * offset])
        h = np.array([[(w * r * r).sum() + 1e-2, (w * r).sum()], [(w * r).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return Discriminant(centre, scale, means, tuple(whiten), tuple(log_det), float(max(slope, 1e-3)), float(offset))


def held_out(doc_id, folds: int = 5):
    """Whether a document is kept from fitting: crc32 of its doc_id as text mod ``folds`` is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Discriminant | None:
    """Fit on at most ``fit_rows`` labelled documents that are not held out.

    Documents whose labels disagree or are null or not 0 or 1 take no part. The
    sample is the smallest hashes of doc_id among all labels; its statistics, a
    few MB at that bound, come to the driver. Of documents with one doc_id, that of the smallest statistics is taken.
    """
    text_batches(docs.sparkSession)
    agreed = (
        columns_of(labels, "doc_id", "quality")
        .filter("doc_id is not null and quality in (0, 1)")
        .filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("y"), F.max("quality").alias("top"))
        .filter("y = top")
    )
    sample = agreed.select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    # at most fit_rows pairs of numbers are broadcast
    chosen = columns_of(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id").select("y", "text", "doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t.as_py()) for t in batch.column(1)]
            rows = [batch.column(0).cast(pa.int32()), pa.array(stats, pa.list_(pa.float64())), batch.column(2).cast(pa.int64())]
            yield pa.RecordBatch.from_arrays(rows, names=["y", "x", "doc_id"])

    found = chosen.mapInArrow(work, "y int, x array<double>, doc_id long")
    rows = found.groupBy("doc_id").agg(F.min("x").alias("x"), F.first("y").alias("y")).toPandas()
    if not len(rows):
        return None
    x, y = np.stack(rows["x"].to_list()), rows["y"].to_numpy()
    order = np.lexsort((*x.T, y))  # the same sums whatever order the rows came in
    return fit(x[order], y[order])


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs(doc_id, text)``.

    Only the text is scored. Without labels of both classes every score is
    0.5. Null and empty texts are scored by the statistics of no words; a
    null doc_id is held out; repeated rows are scored alike; an empty table
    gives no rows; other columns are ignored. Scoring is one pass without a shuffle.
    """
    model = train(docs, labels, fit_rows)
    score = scorer(model)
    rows = columns_of(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score")
    )
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def scorer(model: Discriminant | None):
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if model is None or not len(texts):
            return pa.array([0.5] * len(texts), pa.float64())
        x = np.array([statistics(t.as_py()) for t in texts])
        return pa.array(model.score(x), pa.float64())

    return score


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold; all columns stay.

    Null and empty texts go or stay by the score of no words, repeated rows alike; without labels of both classes all
    rows stay; an empty table stays empty.
    """
    mark = fresh(docs, "quality_score")
    scored = docs.withColumn(mark, scorer(train(docs, labels, fit_rows))("text"))
    return scored.filter(F.col(mark) >= threshold).drop(mark)
