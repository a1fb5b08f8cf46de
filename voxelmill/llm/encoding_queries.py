"""Problem 9: garbled text from wrong character encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from .encodings import learn, restore


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    seen, garbled = learn(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
    return seen.join(garbled.select("run"), "run", "left_semi").select("doc_id").distinct()


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return restore(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


QUERIES = {"p9_found": p9_found, "p9_restored": p9_restored}
ORACLES: dict[str, str] = {}
