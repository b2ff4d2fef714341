"""Bounds of the Arrow batches that Python workers get."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def bound(spark: SparkSession, rows: int = 4096, size: int = 8 << 20) -> None:
    """Bound what a Python worker is handed at once by bytes and rows, if the session's bounds are wider."""
    for name, most in (("maxBytesPerBatch", size), ("maxRecordsPerBatch", rows)):
        now = re.fullmatch(r"(-?\d+)b?", spark.conf.get(f"spark.sql.execution.arrow.{name}"))
        if now is None or not 0 < int(now[1]) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
