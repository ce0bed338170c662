"""Near-duplicate components with a hot group of copies, and tries joined a few at a time."""

import re

import numpy as np
import pytest

from pressmill.llm import common, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = np.random.default_rng(41)
    texts = [" ".join(f"w{v}" for v in rng.integers(0, 500, rng.integers(3, 120))) for _ in range(60)]
    for k in range(40):  # near copies: one word changed in a long text
        words = [f"v{v}" for v in np.random.default_rng(k % 4).integers(0, 500, 400)]
        words[int(rng.integers(0, 400))] = f"x{k}"
        texts.append(" ".join(words))
    texts += [texts[3]] * 70 + [None, "", " \n"]
    ids = rng.permutation(len(texts)).tolist()
    ids[5] = ids[100] = None
    ids[7] = ids[8]
    return list(zip(ids, texts))


def plain(rows):
    import xxhash

    prints = []
    for _, t in rows:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))] if words else []
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return prints, group


@pytest.mark.parametrize("tries", [10, 500_000])
def test_components_with_a_hot_group(spark, monkeypatch, tries):
    monkeypatch.setattr(simhash, "_TRIES", tries)
    rows = corpus()
    prints, group = plain(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
    first = lambda g: min((d for (d, _), h in zip(rows, group) if h == g and d is not None), default=None)
    want = sorted((d is None, d or 0, f"{p:016x}", first(g)) for (d, _), p, g in zip(rows, prints, group))
    assert got == want
    kept = simhash.keep_one(df).collect()
    assert len(kept) == len(set(group))
    assert {(r.doc_id, r.text) for r in kept} <= set(rows)


def test_components_around_hubs(spark):
    hub = [(5000, k) for k in range(300)] + [(k, 6000 + k) for k in range(300)] + [(9000, 9001 + k) for k in range(400)]
    found = {r.node: r.component for r in simhash.components(spark.createDataFrame(hub, "a long, b long"), "a", "b").collect()}
    assert found == {5000: 0} | {k: 0 for k in range(300)} | {6000 + k: 0 for k in range(300)} | {9000 + k: 9000 for k in range(401)}


def test_hot_keys_meet_their_row_in_many_tasks(spark, tmp_path):
    rows = [(k, 1 if k < 900 else k) for k in range(1000)]
    spark.createDataFrame(rows, "id long, fp long").write.parquet(str(tmp_path / "left"))
    left = spark.read.parquet(str(tmp_path / "left"))
    counts = left.groupBy("fp").count()
    hot = common.hot_keys(counts, "fp", "count")
    assert len(hot) == 1
    got = common.spread_join(left, counts, "fp", hot)
    assert sorted((r.id, r.fp, r["count"]) for r in got.collect()) == [(k, f, 900 if f == 1 else 1) for k, f in rows]
