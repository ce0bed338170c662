"""Added secret spans against a plain version, with patterned decoys that only the battery tells."""

import math
import re

import numpy as np

from pressmill.llm import secrets

SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_="
PLAIN = "the quick onset of another winter morning found 1984 people in the internationalisation department of 2001 "


def plain_model(texts):
    """{(before or "", symbol): probability} from runs below 16 symbols."""
    pair = {}
    for run in (r for t in texts for r in re.findall(r"[A-Za-z0-9+/_=-]+", t) if len(r) < 16):
        for a, b in zip(["", *run], run):
            pair[a, b] = pair.get((a, b), 0) + 1
    single = {c: 1 + sum(n for (_, b), n in pair.items() if b == c) for c in SYMBOLS}
    whole = sum(single.values())
    out = {}
    for a in ["", *SYMBOLS]:
        row = sum(n for (x, _), n in pair.items() if x == a)
        for c in SYMBOLS:
            alone = single[c] / whole
            followed = pair.get((a, c), 0) / row if row else alone
            out[a, c] = 0.6 * followed + 0.3 * alone + 0.1 / len(SYMBOLS)
    return out


def plain_battery(token, letters):
    x = np.array([letters.index(c) for c in token.rstrip("=")])
    n, size = len(x), len(letters)
    cells = max(2, min(size, n // 4))
    cell = np.arange(size) * cells // size
    expected = np.bincount(cell, minlength=cells) * n / size
    chi = ((np.bincount(cell[x], minlength=cells) - expected) ** 2 / expected).sum()
    k = cells - 1
    z = ((chi / k) ** (1 / 3) - 1 + 2 / (9 * k)) / math.sqrt(2 / (9 * k))
    tail = lambda v: math.erfc(abs(v) / math.sqrt(2))
    p_chi = math.erfc(z / math.sqrt(2)) / 2
    high = (2 * x >= size).astype(int)
    up = np.mean([2 * v >= size for v in range(size)])
    low = 1 - up
    turns, mean = np.abs(np.diff(high)).sum(), 2 * up * low * (n - 1)
    var = (n - 1) * 2 * up * low * (1 - 2 * up * low) + 2 * (n - 2) * up * low * (1 - 4 * up * low)
    p_runs = tail((turns - mean) / math.sqrt(max(var, 1e-9)))
    if high.all() or not high.any():
        p_runs = min(p_runs, 2 * max(up, low) ** n)
    d = x - x.mean()
    serial = (d[1:] * d[:-1]).sum() / (d * d).sum() if d.any() else 1.0
    p_serial = tail((serial + 1 / n) * math.sqrt(n))
    return min(1.0, 3 * min(p_chi, p_runs, p_serial))


def plain_cuts(tests, share):
    """Weighted Benjamini-Hochberg, hypothesis by hypothesis: ``tests`` holds (length class, rounded log p or None)."""
    m = len(tests)
    total = sum(secrets.LENGTHS[g] for g, _ in tests)
    weight = [v * m / total for v in secrets.LENGTHS]
    scaled = sorted(step - math.log(weight[g]) for g, step in tests if step is not None)
    cut = -math.inf
    for k, value in enumerate(scaled, 1):
        if value <= math.log(share * k / m):
            cut = value
    return [cut + math.log(w) for w in weight]


def plain_spans(texts, share=secrets.FALSE_SHARE, use_battery=True):
    model = plain_model(texts)
    found = []
    for t, text in enumerate(texts):
        base = secrets.base_spans(text)
        for a, b in secrets.candidates(text):
            token = text[a:b]
            if (encoding := secrets.infer_encoding(token)) is None:
                continue
            letters, body = secrets.ENCODINGS[encoding], token.rstrip("=")
            log_p = sum(math.log(model[x, y]) for x, y in zip(["", *body], body)) + len(body) * math.log(len(letters))
            p = plain_battery(token, letters)
            group = max(k for k, n in enumerate(secrets.LENGTHS) if n <= len(token))
            taken = any(x < b and a < y for x, y, _ in base)
            found.append((t, a, b, group, log_p, math.ceil(math.log(p)) if p > 0 else -2000, taken))
    if not found:
        return [set() for _ in texts]
    text_cut = plain_cuts([(g, math.ceil(lp) if lp < 0 and not taken else None) for *_, g, lp, _, taken in found], share)
    pattern_cut = plain_cuts([(g, step) for *_, g, _, step, _ in found], share)
    out = [set() for _ in texts]
    for t, a, b, g, lp, step, taken in found:
        if not taken and lp < 0 and math.ceil(lp) <= text_cut[g] and (step > pattern_cut[g] or not use_battery):
            out[t].add((a, b))
    return out


def corpus():
    rng = np.random.default_rng(21)
    draw = lambda name, n: "".join(rng.choice(list(secrets.ENCODINGS[name]), n))
    texts = [PLAIN * 3 + "key " + draw(name, n) + " " + PLAIN for name in ("base62", "base64", "base64url", "base36", "HEX") for n in (17, 22, 30, 44, 70)]
    decoys = ["Zx9" * 14, "Qw3Er5Ty7" * 5, "A1b2" * 10, "ZZZZZZZZZZZZZZZZ9999999999999999zzzzzzzzzzzzzzzz", "9Zk9Zk9Zk9Zk9Zk9Zk9Zk9Zk9Zk9Zk", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]
    texts += [PLAIN * 2 + "decoy " + d + " " + PLAIN for d in decoys]
    texts += [PLAIN + "counterrevolutionaries antidisestablishmentarianism-of_things Some-long_identifier2of3words/and-4more", "", "token: " + draw("base62", 40)]
    return texts, len(decoys)


def added(rows):
    return [{tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("random")} for r in rows]


def test_added_spans_are_those_of_the_plain_version(spark):
    texts, decoys = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = added(sorted(secrets.secret_digest(df).collect()))
    want = plain_spans(texts)
    assert got == want
    assert sum(map(bool, want[:25])) >= 22 and not any(want[25:])
    # without the battery the decoys would be secrets
    loose = plain_spans(texts, use_battery=False)
    assert sum(map(bool, loose[25 : 25 + decoys])) >= 4 and loose != want


def test_discoveries_are_those_of_the_plain_procedure():
    rng = np.random.default_rng(22)
    for _ in range(30):
        tests = [(int(g), -int(v)) for g, v in zip(rng.integers(0, len(secrets.LENGTHS), 200), rng.exponential(6, 200))]
        tested, histogram = np.zeros(len(secrets.LENGTHS)), {}
        for g, step in tests:
            tested[g] += 1
            histogram[g, step] = histogram.get((g, step), 0) + 1
        assert np.allclose(secrets.discoveries(tested, histogram, 0.01), plain_cuts(tests, 0.01))


def test_battery_equals_the_plain_one():
    rng = np.random.default_rng(23)
    for name, letters in secrets.ENCODINGS.items():
        for n in (16, 19, 33, 64, 200):
            token = "".join(rng.choice(list(letters), n))
            assert math.isclose(secrets.battery(token, name), plain_battery(token, letters), rel_tol=1e-9)


def test_long_texts_nulls_and_repeats(spark):
    rng = np.random.default_rng(24)
    blob = "".join(rng.choice(list(secrets.ENCODINGS["base64"]), 300_000))
    rows = [(1, blob), (1, blob), (None, None), (2, ""), (3, "g" * 200_000), (4, "password = " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.secret_digest(df).collect()}
    assert got[None] == got[2] == got[3] == ""
    assert secrets.redact(df).filter("doc_id = 1").select("text").distinct().count() == 1
