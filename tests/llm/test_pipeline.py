"""The whole pipeline against a plain version of every stage."""

import re
import zlib

import numpy as np
import pytest
from test_secrets import plain_spans
from test_simhash import plain as plain_groups

import corpus_pipeline
from pressmill.llm import quality, secrets
from pressmill.llm.registry import vocabulary

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def corpus():
    rng = np.random.default_rng(71)
    draw = lambda n: " ".join(f"{w}{v}" for w, v in zip(rng.choice(WORDS, n), rng.integers(0, 90, n)))
    shared = draw(60)
    base62 = list(secrets.ENCODINGS["base62"])
    rows = []
    for k in range(140):
        text = draw(int(rng.integers(30, 250))).capitalize() + "."
        if k % 5 == 0:
            text += " " + shared + " end."
        if k % 7 == 0:
            text += " token = " + "".join(rng.choice(base62, 20)) + " ok."
        if k % 11 == 0:
            text += " seen " + "".join(rng.choice(base62, 40)) + " there."
        if k % 3 == 2:
            text = " | ".join(w.upper() + "!!" for w in draw(40).split())
        rows.append((k, text))
    rows += [(200 + k, rows[3][1]) for k in range(30)] + [(230 + k, rows[4][1].replace("alpha", "Alpha")) for k in range(3)]
    rows += [(None, draw(50) + "."), (None, draw(50) + "."), (None, None), (300, ""), (301, "  \n"), (4, draw(45) + "."), rows[6], (302, draw(12_000) + ".")]
    return [(d, t, "en", "web", len(t or ""), f"extra{k % 3}", k) for k, (d, t) in enumerate(rows)]


NAMES = "doc_id long, text string, lang string, source string, n_chars int, fp string, part int"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    rows = corpus()
    spark.createDataFrame(rows, NAMES).repartition(5).write.parquet(f"{path}/documents.parquet")
    labels = [(d, int(d % 3 != 2), 0) for d in range(140) if d % 4] + [(1, 0, 0), (None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows, labels


def as_key(row):
    return tuple((v is not None, v) for v in row)


def plain_quality(rows, labels):
    votes = {}
    for d, y, _ in labels:
        if d is not None:
            votes.setdefault(d, set()).add(y)
    fit_on = {}
    for r in rows:
        d = r[0]
        if d in votes and len(votes[d]) == 1 and zlib.crc32(str(d).encode()) % 5:
            stats = quality.statistics(r[1])
            fit_on[d] = min(fit_on.get(d, (stats, None))[0], stats), min(votes[d])
    x, y = np.array([s for s, _ in fit_on.values()]), np.array([v for _, v in fit_on.values()])
    order = np.lexsort((*x.T, y))
    model = quality.fit(x[order], y[order])
    scores = model.score(np.array([quality.statistics(r[1]) for r in rows]))
    return [r for r, s in zip(rows, scores) if s >= 0.3]


def plain_near(rows):
    import hashlib

    _, group = plain_groups([r[:2] for r in rows])
    best = {}
    for r, g in zip(rows, group):
        digest = "" if r[1] is None else hashlib.md5(r[1].encode()).hexdigest()
        place = (r[0] is None, r[0] or 0, ("" if r[0] is None else str(r[0])) + ":" + digest)
        if g not in best or place < best[g][0]:
            best[g] = (place, r)
    return [r for _, r in best.values()]


def plain_repeats(rows, window=20):
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()))):
        text = r[1] or ""
        found = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
        words = [m[0] for m in found]
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            gone[k : k + window] = [True] * window if w in seen else gone[k : k + window]
            seen.add(w)
        if any(gone):
            stops = [m.start() for m in found[1:]] + [len(text)]
            text = text[: found[0].start()] + "".join(text[m.start() : e] for m, e, g in zip(found, stops, gone) if not g)
            r = (r[0], text, *r[2:4], len(text), *r[5:])
        out.append(r)
    return out


def plain_secrets(rows):
    added = plain_spans([r[1] or "" for r in rows])
    out = []
    for r, more in zip(rows, added):
        text = r[1] or ""
        spans = sorted([(a, b) for a, b, _ in secrets.base_spans(text)] + list(more))
        if not spans:
            out.append(r)
            continue
        cover = np.zeros(len(text) + 1, int)
        for a, b in spans:
            cover[a:b] = 1
        marks = "".join("\0" if c else x for x, c in zip(text, cover))
        text = re.sub("\0+", "[SECRET]", marks)
        out.append((r[0], text, *r[2:4], len(text), *r[5:]))
    return out


PLAIN = [lambda rows, labels: plain_quality(rows, labels), lambda rows, _: plain_near(rows), lambda rows, _: plain_repeats(rows), lambda rows, _: plain_secrets(rows)]


def test_every_stage_is_its_plain_version(spark, tables):
    path, rows, labels = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for (name, stage), plain in zip(corpus_pipeline.STAGES, PLAIN):
        got_df = stage(spark, spark.createDataFrame(rows, NAMES), path)
        assert got_df.columns == docs.columns, name
        got = sorted(map(tuple, got_df.collect()), key=as_key)
        rows_after = sorted(plain(rows, labels), key=as_key)
        assert [r[:2] for r in got] == [r[:2] for r in rows_after], name
        if name != "near_dedup":  # equal rows of one doc_id are one; which of them stays is open
            assert got == rows_after, name
        assert name != "quality" or 0 < len(got) < len(rows)
        rows = got
    texts = " ".join(r[1] or "" for r in rows)
    assert "[SECRET]" in texts and "token =" not in texts


def test_run_packs_what_the_stages_keep(spark, tables):
    from tokenizers import Tokenizer

    path, rows, labels = tables
    for plain in PLAIN:
        rows = plain(rows, labels)
    codec = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = sorted((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for ids in (codec.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in rows))
    pieces = corpus_pipeline.run(spark, path).collect()
    assert sum(r.length for r in pieces) == sum(n for n, _ in want)
    assert sorted(r.doc_tokens for r in pieces if r.start == 0) == [n for n, _ in want]
    whole = sorted((r.doc_tokens, r.ids_crc32) for r in pieces if r.length == r.doc_tokens)
    assert whole == [w for w in want if w[0] <= 2048]
    used = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 2048


def test_stages_of_empty_tables(spark, tables):
    path, _, _ = tables
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], NAMES), path).count() == 0, name
