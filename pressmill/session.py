"""Session settings that the library's transforms assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "pressmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with AQE and Arrow batches small enough for wide text cells.

    ``conf`` entries use ``__`` for the dots of a Spark setting.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
