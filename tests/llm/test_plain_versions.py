"""Piecewise hashes, discriminant scores and token files against plain versions; long unspaced texts."""

import hashlib
import zlib

import numpy as np

from pressmill.llm import ctph, dac, packing, quality, sharding, simhash, substrings
from pressmill.llm.registry import vocabulary

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi".split()
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def plain_signature(data, block):
    """Byte by byte: the last seven bytes' sum, weighted sum and shifted xor decide where a piece ends."""
    out, piece = "", b""
    for k in range(len(data)):
        piece += data[k : k + 1]
        last = data[max(0, k - 6) : k + 1][::-1]
        turned = 0
        for back, byte in enumerate(last):
            turned ^= byte << (5 * back)
        value = (sum(last) + sum(b * (7 - back) for back, b in enumerate(last)) + turned) % 2**32
        if value % block == block - 1:
            out += LETTERS[(zlib.crc32(piece) * 2654435761 >> 26) & 63]
            piece = b""
    return out + (LETTERS[(zlib.crc32(piece) * 2654435761 >> 26) & 63] if piece else "")


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def plain_likeness(left, right):
    if left == right:
        return 1.0
    signs = lambda x: {int(x.split(":")[0]) * (1 + k): s for k, s in enumerate(x.split(":")[1:])}
    a, b = signs(left), signs(right)
    best = 0.0
    for size in a.keys() & b.keys():
        x, y = a[size], b[size]
        if x == y:
            best = 1.0
            continue
        run = min(3, len(x), len(y))
        if run and any(x[k : k + run] in y for k in range(len(x) - run + 1)):
            best = max(best, 1 - plain_distance(x, y) / max(len(x), len(y)))
    return best


def some_texts():
    rng = np.random.default_rng(51)
    texts = [" ".join(rng.choice(WORDS, n)) for n in (1, 5, 40, 200, 900)]
    near = texts[3].split()
    near[50] = "changed"
    return [*texts, " ".join(near), "", "d" * 5000, "ab" * 3000, "é漢" * 700, None]


def test_fingerprints_are_those_of_the_plain_version(spark):
    texts = some_texts()
    for text in texts:
        data = (text or "").encode()
        block, one, two = ctph.fingerprint(text).split(":")
        assert one == plain_signature(data, int(block)) and two == plain_signature(data, 2 * int(block))
        assert len(one) <= ctph.MOST + 1
        if int(block) > ctph.SMALLEST_BLOCK and len(one) < 20:  # no finer size would do
            assert not 32 <= len(plain_signature(data, int(block) // 2)) <= ctph.MOST
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(ctph.fingerprint_table(df).collect())
    for k, r in enumerate(got):
        own, after = texts[k] or "", texts[(k + 1) % len(texts)] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (k, len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (ctph.fingerprint(own), ctph.fingerprint(edited))
        assert r.near_edited == plain_likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == plain_likeness(r.fingerprint, ctph.fingerprint(after))


def test_repeated_and_null_ids_stay_in_order(spark):
    rng = np.random.default_rng(52)
    rows = [(int(d) if d >= 0 else None, " ".join(rng.choice(WORDS, 9))) for d in rng.integers(-20, 5, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (d, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        want.append((d is not None, d or 0, hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()))
    got = [(r.doc_id is not None, r.doc_id or 0, r.edited_sha256) for r in ctph.fingerprint_table(df).collect()]
    assert sorted(got) == sorted(want)


def test_many_token_files_a_range(spark, monkeypatch, tmp_path):
    from tokenizers import Tokenizer

    monkeypatch.setattr(dac, "FILE_IDS", 50)
    rng = np.random.default_rng(53)
    rows = [(int(d) if d >= 0 else None, " ".join(rng.choice(WORDS, rng.integers(0, 60)))) for d in rng.integers(-20, 30, 200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = vocabulary("byte_bpe_50k.json")
    codec = Tokenizer.from_file(path)
    at, want = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = codec.encode(t, add_special_tokens=False).ids + [2]
        want.append((d is not None, d or 0, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = [(r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in dac.token_digest(df, path, folder=f"file://{tmp_path}/t").collect()]
    assert sorted(got) == sorted(want)
    assert len(list((tmp_path / "t").glob("part-*.dac"))) > 30


def test_discriminant_equals_plain_densities():
    rng = np.random.default_rng(54)
    x = np.vstack([rng.normal(size=(80, 6)) @ rng.normal(size=(6, 6)), 1 + rng.normal(size=(120, 6)) @ rng.normal(size=(6, 6))])
    y = np.repeat([0, 1], [80, 120])
    model = quality.fit(x, y)
    z = (x - x.mean(0)) / x.std(0)
    covs = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    both = (80 * covs[0] + 120 * covs[1]) / 200
    log = []
    for k in (0, 1):
        c = 0.9 * covs[k] + 0.1 * both
        c = 0.9 * c + 0.1 * np.diag(np.diag(c)) + 1e-3 * np.eye(6)
        d = z - z[y == k].mean(0)
        inverse = np.linalg.inv(c)
        log.append([-0.5 * v @ inverse @ v - 0.5 * np.log(np.linalg.det(c)) for v in d])
    ratio = np.array(log[1]) - np.array(log[0])
    assert np.allclose(model.ratio(x), ratio)
    calm = np.sign(ratio) * np.log(1 + np.abs(ratio))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-(model.slope * calm + model.offset))))
    # the calibration is where the held logistic loss has no slope
    p = model.score(x)
    assert abs(((p - y) * calm).sum() + 1e-2 * model.slope) < 1e-6 and abs((p - y).sum() + 1e-2 * model.offset) < 1e-6


def test_scores_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(55)
    rows = [(k % 150, " ".join(rng.choice(WORDS, 30)) + (" !!" * 9 if k % 2 else ".")) for k in range(200)]
    labels = spark.createDataFrame([(k, (k + 1) % 2) for k in range(150)], "doc_id long, quality int")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [sorted((r.doc_id, r.score) for r in quality.quality_scores(df.repartition(n), labels, fit_rows=60).collect()) for n in (1, 7)]
    assert found[0] == found[1]


def test_long_unspaced_texts(spark):
    rng = np.random.default_rng(56)
    long = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 400_000))
    df = spark.createDataFrame([(1, long), (2, "d" * 300_000), (3, "é" * 200_000), (4, None), (5, "")], "doc_id long, text string")
    path = vocabulary("byte_bpe_50k.json")
    assert dac.token_digest(df, path).count() == 5
    assert sum(r.length for r in packing.pack_documents(df, path).collect()) > 100_000
    assert all(len(r.fingerprint) < 600 for r in ctph.fingerprint_table(df).collect())
    assert sharding.shard_table(df).count() == simhash.near_duplicates(df).count() == 5
    assert {r.doc_id: r.n_words for r in substrings.repeat_digest(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0}
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 6)], "doc_id long, quality int")
    assert quality.quality_scores(df, labels).count() == 5
