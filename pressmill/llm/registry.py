"""Queries of the training-data operators, by the names the driver uses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ctph, dac, lexicon, neighbours, packing, quality, secrets, sharding, simhash, sql, substrings


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of an installed vocabulary file, which is never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(_table(spark, sf_dir, "documents"))


def op2_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op3_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(
        _table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), capacity=2048, end_id=1
    )


def op4_addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.token_digest(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


def op5_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.bpe_digest(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op7_piecewise_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.fingerprint_table(_table(spark, sf_dir, "documents"))


def op8_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_table(_table(spark, sf_dir, "documents"), shards=24)


def op9_fixed_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeat_digest(_table(spark, sf_dir, "documents"), window=20)


def op10_trie_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, budget=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    """SQL where it can be said; the others need BPE, places of matches or numeric methods."""
    return {
        "op1_randomness_battery": sql.SECRETS,
        "op2_permutation_index": sql.NEAREST,
        "op7_piecewise_hashes": sql.PIECES,
        "op8_jump_sharding": sql.SHARDS,
        "op9_fixed_block_anchors": sql.REPEATS,
        "op10_trie_simhash": sql.NEAR,
    }
