"""The registry of queries and their SQL twins, and what the queries share."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

#: Relative dates count from here, so that results stay the same.
NOW = datetime(2024, 1, 1, tzinfo=UTC)

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession) -> int:
    """Partitions for kernel work on tables that come in few files."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of checkpoints."""
    from ..operators.pages import checkpoint_folder

    return checkpoint_folder(spark).rstrip("/")
