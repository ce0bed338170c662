"""Secret scans: fixed patterns, and long tokens that pass a battery of randomness tests.

Besides the base patterns, every long run of encoding characters is a
candidate, or its long parts are where no one alphabet can hold it: a run is cut at '=' inside it, and a
run with marks of both base64 forms at those of either form, each way in turn. The encoding of a candidate
is inferred (the smallest alphabet that holds it), and two null hypotheses are tested. The first is that the token is a
series of uniform draws from that alphabet. That is the battery: chi-squared over the alphabet, runs about the middle and
serial correlation, combined. The second is that it is ordinary text: the likelihood ratio of
uniform draws against a character bigram model of the corpus's ordinary short words exceeds x with a
probability of 1/x at most if it is text, so its inverse is a p-value at any length.

Both kinds of p-values, weighted by length so that longer tokens get more of the error
budget, go through the Benjamini-Hochberg procedure over all candidates of the corpus. A secret is a token that is
discovered not to be text and not discovered to be patterned.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, columns_of, text_batches

# The base patterns and the least sizes of their matches, in the order of kinds.
KINDS = ["assign", "access", "hex", "random"]
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")

#: Shortest token that the battery tests; shorter ones make the model of ordinary text.
SHORTEST = 16
#: Share of false discoveries, both of what is no text and of what is patterned.
FALSE_SHARE = 1e-3
#: Characters of candidates that a task holds before it tells them.
_HELD = 16_000_000
#: Whole logarithms of p-values go down to this.
_FLOOR = -2000
#: Lower ends of the length classes.
LENGTHS = (16, 20, 24, 32, 48, 64)

_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_="
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
_BETWEEN = re.compile(r"[^=]+")
#: Parts without the marks of one base64 form, and of the other.
_FORMS = re.compile(r"[^-_]+"), re.compile(r"[^+/]+")
_WORD = re.compile(r"[A-Z]?(?:[a-z]+|[A-Z]+)(?:[-/_=+]+[A-Z]?(?:[a-z]+|[A-Z]+))*[-/_=+]*")
_CODE = np.zeros(256, np.int64)
_CODE[[ord(c) for c in _SYMBOLS]] = np.arange(1, len(_SYMBOLS) + 1)
_STATES = len(_SYMBOLS) + 1
_UPPER, _LOWER, _DIGIT = _SYMBOLS[:26], _SYMBOLS[26:52], _SYMBOLS[52:62]
#: Encodings from the smallest alphabet to the largest.
ENCODINGS = {
    "hex": _DIGIT + "abcdef",
    "HEX": _DIGIT + "ABCDEF",
    "base32": _UPPER + "234567",
    "base36": _DIGIT + _LOWER,
    "BASE36": _DIGIT + _UPPER,
    "letters": _UPPER + _LOWER,
    "base62": _UPPER + _LOWER + _DIGIT,
    "base64": _UPPER + _LOWER + _DIGIT + "+/",
    "base64url": _UPPER + _LOWER + _DIGIT + "-_",
}
_SETS = {name: frozenset(a) for name, a in ENCODINGS.items()}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base patterns, by start and then kind."""
    found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def infer_encoding(token: str) -> str | None:
    """The first encoding whose alphabet holds the token without its padding.

    Digits alone have none, nor have letters of one case (the first aside): those are numbers and words.
    """
    body = set(token.rstrip("="))
    if not body or body <= set(_DIGIT + "+-/_=") or _WORD.fullmatch(token):
        return None
    return next((name for name, letters in _SETS.items() if body <= letters), None)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of all runs and parts of runs to test, none shorter than SHORTEST.

    Padding at the end of a run stays with its last part. Parts of a run with marks of both forms may overlap:
    those free of '-' and '_' and those free of '+' and '/' are both tested.
    """
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        last = start + len(m[0].rstrip("="))
        for part in _BETWEEN.finditer(text, start, last):
            a, b = part.start(), end if part.end() == last else part.end()
            run = text[a:b]
            if ("+" in run or "/" in run) and ("-" in run or "_" in run):
                cut = [q.span() for form in _FORMS for q in form.finditer(text, a, b)]
            else:
                cut = [(a, b)]
            for a, b in cut:
                if b - a >= SHORTEST:
                    yield a, b


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi_tail(x: float, freedom: int) -> float:
    """Upper tail of chi-squared by the cube-root normal approximation."""
    z = ((x / freedom) ** (1 / 3) - (1 - 2 / (9 * freedom))) / math.sqrt(2 / (9 * freedom))
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str, encoding: str) -> float:
    """The combined p-value that the token is a uniform draw: three times the least of three tests.

    The alphabet is folded so that a cell expects four symbols or more,
    whatever the length.
    """
    letters = ENCODINGS[encoding]
    place = {c: k for k, c in enumerate(letters)}
    x = [place[c] for c in token.rstrip("=")]
    n, size = len(x), len(letters)
    cells = max(2, min(size, n // 4))
    counts, width = [0] * cells, [0] * cells
    for k in range(size):
        width[k * cells // size] += 1
    for k in x:
        counts[k * cells // size] += 1
    chi = sum((c - n * w / size) ** 2 / (n * w / size) for c, w in zip(counts, width))
    high = [2 * k >= size for k in x]
    ups, share = sum(high), (size - size // 2 - size % 2) / size
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    turn = 2 * share * (1 - share)
    spread = (n - 1) * turn * (1 - turn) + 2 * (n - 2) * (share * (1 - share) * (1 - 4 * share * (1 - share)))
    p_runs = _normal_tail((runs - 1 - (n - 1) * turn) / math.sqrt(max(spread, 1e-9)))
    if not 0 < ups < n:
        p_runs = min(p_runs, 2 * max(share, 1 - share) ** n)
    mean = sum(x) / n
    power = sum((k - mean) ** 2 for k in x)
    serial = sum((a - mean) * (b - mean) for a, b in zip(x, x[1:])) / power if power else 1.0
    p_serial = _normal_tail((serial + 1 / n) * math.sqrt(n))
    return min(1.0, 3 * min(_chi_tail(chi, cells - 1), p_runs, p_serial))


def bigram_counts(data: bytes) -> tuple[np.ndarray, bool]:
    """(counts of neighbouring symbols in runs shorter than a candidate, whether a longer one is there); state 0 is anything else."""
    code = _CODE[np.frombuffer(b" " + data + b" ", np.uint8)]
    gaps = np.flatnonzero(code == 0)
    long = np.diff(gaps) > SHORTEST
    if held := bool(long.any()):
        cover = np.zeros(len(code) + 1, np.int8)
        cover[gaps[:-1][long] + 1] += 1
        cover[gaps[1:][long]] -= 1
        code = np.where(np.cumsum(cover[:-1]) > 0, 0, code)
    return np.bincount(code[:-1] * _STATES + code[1:], minlength=_STATES * _STATES), held


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Log probabilities [symbol, next symbol]: bigrams mixed with single symbols and with equal shares, so that text of other words stays likely enough."""
    pair = counts.reshape(_STATES, _STATES).copy()
    pair[:, 0] = 0  # ends of words: a candidate's length is given
    single = pair.sum(0) + 1.0
    single[0] = 0
    single = single / single.sum()
    rows = pair.sum(1, keepdims=True)
    followed = np.where(rows > 0, pair / np.maximum(rows, 1), single)
    equal = np.full(_STATES, 1 / (_STATES - 1))
    return np.log(0.6 * followed + 0.3 * single + 0.1 * equal)


_PLACE = _CODE.tolist()


def length_class(token: str) -> int:
    return sum(len(token) >= n for n in LENGTHS) - 1


def text_log_p(token: str, encoding: str, log_model: list[list[float]]) -> float:
    """The log p-value that the token is ordinary text; 0 or more says nothing against it."""
    body = token.rstrip("=")
    before, log_text = 0, 0.0
    for c in body.encode():
        own = _PLACE[c]
        log_text += log_model[before][own]
        before = own
    return log_text + len(body) * math.log(len(ENCODINGS[encoding]))


def whole_log(p: float) -> int:
    """The logarithm of a p-value rounded up, so that a histogram of it errs to the safe side."""
    return max(_FLOOR, math.ceil(math.log(p))) if p > 0 else _FLOOR


def overlap(spans: list[tuple[int, int, int]]) -> Callable[[int, int], bool]:
    """Whether a range meets any of the spans, which come by start."""
    starts, reach = [s[0] for s in spans], []
    for s in spans:
        reach.append(max(s[1], reach[-1] if reach else 0))

    def meets(a: int, b: int) -> bool:
        k = bisect_left(starts, b)
        return k > 0 and reach[k - 1] > a

    return meets


_GATHERED = pa.schema([("pair", pa.int64()), ("token", pa.string()), ("taken", pa.bool_()), ("n", pa.int64())])


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n) of neighbouring symbols and (token, taken, n) of candidates of all texts, counted in a task.

    ``taken`` tells whether a base span meets the candidate.
    """
    total, tokens, held = np.zeros(_STATES * _STATES, np.int64), Counter(), 0

    def told() -> pa.RecordBatch:
        names, taken = zip(*tokens) if tokens else ([], [])
        rows = [[None] * len(names), names, taken, list(tokens.values())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _GATHERED.types)], schema=_GATHERED)

    for batch in batches:
        for text in batch.column(0):
            text = text.as_py() or ""
            counts, long = bigram_counts(text.encode("utf-8", "surrogatepass"))
            total += counts
            meets = None
            for a, b in candidates(text) if long else ():
                token = text[a:b]
                if infer_encoding(token) is not None:
                    meets = meets or overlap(base_spans(text))
                    tokens[token, meets(a, b)] += 1
                    held += b - a
            if held > _HELD:
                yield told()
                tokens.clear()
                held = 0
    yield told()
    some = np.flatnonzero(total)
    empty = [None] * len(some)
    rows = [some, empty, empty, total[some]]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _GATHERED.types)], schema=_GATHERED)


def discoveries(tested: np.ndarray, histogram: dict[tuple[int, int], int], share: float = FALSE_SHARE) -> list[float]:
    """The largest log p to reject in each length class, by weighted Benjamini-Hochberg.

    ``tested`` counts all candidates of each length class; ``histogram`` counts those with
    evidence by (length class, log p rounded up to a whole number), so its size is
    bounded and rounding errs to the safe side. Weights grow with length and
    average 1 over the candidates.
    """
    m = tested.sum()
    weight = np.array(LENGTHS, float)
    if not m:
        return [-math.inf] * len(LENGTHS)
    weight = weight * m / (weight * tested).sum()
    levels = sorted((step - math.log(weight[g]), n) for (g, step), n in histogram.items())
    below, cut = 0, -math.inf
    for value, n in levels:
        below += n
        if value <= math.log(share * below / m):
            cut = value
    return [cut + math.log(w) for w in weight]


class Rules:
    """What the corpus decided: the text model, and for each length class the cuts of both tests."""

    def __init__(self, model: list[list[float]], no_text: list[float], patterned: list[float]):
        self.model, self.no_text, self.patterned = model, no_text, patterned

    def secret(self, token: str) -> bool:
        """Discovered to be no text, and not discovered to be patterned."""
        encoding = infer_encoding(token)
        if encoding is None:
            return False
        group, log_p = length_class(token), text_log_p(token, encoding, self.model)
        if log_p >= 0 or max(_FLOOR, math.ceil(log_p)) > self.no_text[group]:
            return False
        return whole_log(battery(token, encoding)) > self.patterned[group]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, kind number) of base and added spans, by start, kind and end."""
        base = base_spans(text)
        added, meets = [], None
        for a, b in candidates(text):
            if self.secret(text[a:b]):
                meets = meets or overlap(base)
                if not meets(a, b):
                    added.append((a, b, KINDS.index("random")))
        return sorted(base + added, key=lambda s: (s[0], s[2], s[1])) if added else base


def learn(docs: DataFrame, share: float = FALSE_SHARE) -> Rules:
    """The rules of a corpus, from one pass over all of every text.

    Tasks tell non-zero pair counts and their candidates, each token once with its number; these are
    checkpointed. The pairs' sums, at most the square of the symbols, make the model. The candidates are
    tested where they lie, and only two histograms of whole logarithms come to the driver.
    """
    text_batches(docs.sparkSession)
    ddl = "pair long, token string, taken boolean, n long"
    gathered = checkpoint(columns_of(docs, "text").mapInArrow(gather, ddl))
    counts = np.zeros(_STATES * _STATES)
    for r in gathered.filter("pair is not null").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[r["pair"]] = r["n"]
    model = smoothed(counts).tolist()

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()  # (test, length class, whole log p); test 0 is the number tested
        for batch in batches:
            for token, taken, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
                encoding, group = infer_encoding(token), length_class(token)
                found[0, group, 0] += n
                found[1, group, whole_log(battery(token, encoding))] += n
                log_p = text_log_p(token, encoding, model)
                if log_p < 0 and not taken:
                    found[2, group, max(_FLOOR, math.ceil(log_p))] += n
        columns = [*zip(*found)] if found else [[], [], []]
        rows = [*(pa.array(c, pa.int32()) for c in columns), pa.array(list(found.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(rows, names=["test", "g", "step", "n"])

    tokens = gathered.filter("token is not null").select("token", "taken", "n")
    sums = tokens.mapInArrow(test, "test int, g int, step int, n long").groupBy("test", "g", "step").agg(F.sum("n").alias("n"))
    tested, histograms = np.zeros(len(LENGTHS)), ({}, {})
    for r in sums.collect():  # at most two whole logarithms' ranges a length class
        if r["test"] == 0:
            tested[r["g"]] = r["n"]
        else:
            histograms[r["test"] - 1][r["g"], r["step"]] = r["n"]
    return Rules(model, discoveries(tested, histograms[1], share), discoveries(tested, histograms[0], share))


def _text_of(spans) -> F.Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["k"] + 1), s["a"].cast("string"), s["b"].cast("string"))), ",")


def secret_digest(docs: DataFrame, share: float = FALSE_SHARE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of ``docs(doc_id, text)``.

    Null and empty texts have no spans, an empty ``spans`` and the digest of no bytes. Added spans never
    overlap a base one, but may overlap each other. Repeated rows and null doc_ids are rows of their own (copies of a token
    are tests of their own); other columns are ignored; an empty table gives no rows. Texts are read twice, without a shuffle.
    """
    rows = columns_of(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rules = learn(rows, share)

    @F.arrow_udf("array<struct<a:int,b:int,k:int>>")
    def spans(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("k", pa.int32())]))
        return pa.array([[{"a": a, "b": b, "k": k} for a, b, k in rules.spans(t.as_py() or "")] for t in texts], kind)

    found = rows.select("doc_id", spans("text").alias("spans"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["k"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_text_of(F.filter("spans", lambda s: s["k"] < KINDS.index("random"))), 256).alias("base_sha256"),
        _text_of(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, share: float = FALSE_SHARE, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mark``; overlapping spans get one mark.

    Rows and other columns stay; ``n_chars``, where present, follows the new text, and
    texts without a span, null and empty ones too, stay as they are. Repeated rows are changed alike; an empty table
    stays empty. Texts are read twice, without a shuffle.
    """
    rules = learn(docs, share)

    @F.arrow_udf("string")
    def cut(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            text = t.as_py()
            if text and (held := rules.spans(text)):
                parts, at = [], 0
                for a, b, _ in held:
                    if a >= at:
                        parts += [text[at:a], mark]
                    at = max(at, b)
                text = "".join([*parts, text[at:]])
            out.append(text)
        return pa.array(out, pa.string())

    changed = docs.withColumn("text", cut("text"))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


def digest(spans: list[tuple[int, int, int]]) -> str:
    """The base digest of spans, for checks outside Spark."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()
