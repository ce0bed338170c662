"""Repeats of windows: unequal windows of one hash, rows that share or lack a doc_id."""

import hashlib
import zlib

import numpy as np

from pressmill.llm import substrings


def plain(rows, window=20):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, zlib.crc32((x[1] or "").encode()))):
        words = (t or "").split()
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            if w in seen:
                gone[k : k + window] = [True] * window
            seen.add(w)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((d is not None, d or 0, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def corpus(seed, n, ids):
    rng = np.random.default_rng(seed)
    draw = lambda a, b: " ".join(f"w{v}" for v in rng.integers(0, 3000, rng.integers(a, b)))
    pool = [draw(20, 60) for _ in range(8)]
    return [(ids(k), " ".join([draw(0, 30), *(pool[i] for i in rng.integers(0, 8, rng.integers(0, 3)))])) for k in range(n)]


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    real = substrings.window_hashes
    # the first hash of whole windows takes 50 values only; the second one decides
    monkeypatch.setattr(substrings, "window_hashes", lambda words, width, seed: real(words, width, seed) % np.uint64(50) << np.uint64(58) if seed == 2 else real(words, width, seed))
    rows = corpus(61, 60, lambda k: k)
    parts = [rows[k::3] for k in range(3)]
    chunks = [substrings.Chunk([d for d, _ in p], [t for _, t in p]) for p in parts]
    meet = lambda found, tell: [r for b in {r[0] for r in found} for r in tell([r for r in found if r[0] == b])]
    shared = meet([r for k, c in enumerate(chunks) for r in substrings.probes(c, k, 20, 2)], lambda r: list(substrings.shared_hashes(r)))
    proposed = [r for k, c in enumerate(chunks) for r in substrings.candidates(c, k, [s for s in shared if s[0] == k], 20, 2)]
    firsts = meet(proposed, lambda r: list(substrings.first_windows(r)))
    got = []
    for k, c in enumerate(chunks):
        gone = substrings.covered(c, [f for f in firsts if f[0] == k], 20)
        for d, doc in enumerate(c.ids.tolist()):
            words, own = c.blobs[d].split(), gone[c.first[d] : c.first[d + 1]]
            kept = b" ".join(w for w, g in zip(words, own) if not g)
            got.append((True, doc, len(words), int(own.sum()), hashlib.sha256(kept).hexdigest()))
    assert sorted(got) == plain(rows) and sum(r[3] for r in got) > 500


def test_rows_that_share_or_lack_an_id(spark):
    rows = corpus(62, 150, lambda k: None if k % 3 == 0 else k % 20)
    df = spark.createDataFrame(rows + rows[:10], "doc_id long, text string").repartition(6)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.repeat_digest(df).collect())
    assert got == plain(rows + rows[:10])


def test_query_equals_its_sql(spark):
    import duckdb

    from pressmill.llm import registry

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    want = con.sql(f"SELECT {', '.join(names)} FROM ({registry.oracle_sql()['op9_fixed_block_anchors']})").fetchall()
    assert sorted(map(tuple, registry.op9_fixed_block_anchors(spark, path).select(*names).collect())) == sorted(want)
