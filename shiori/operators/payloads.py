"""Stored payloads and their index (A38, A39): read if there, used only while fresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from shiori.session import exists, listed, mark, modified, remove


def read_payload(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON payload; a missing or broken one is empty."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", True).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def fresh_index(spark: SparkSession, payload: str, index: str, version: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The index, if its mark names this version and isn't older than the payload; else it is built again."""
    mark_at = f"{index}.of/{version}"
    if not (exists(spark, mark_at) and listed(spark, f"{index}.of") == [version] and modified(spark, mark_at) >= modified(spark, payload)):
        remove(spark, f"{index}.of")
        build().write.mode("overwrite").parquet(index)
        mark(spark, mark_at)
    return spark.read.parquet(index)
