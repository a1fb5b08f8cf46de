"""Problem 7: encoding of the whole corpus with a public tokenizer."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from .tokens import encode

#: Where the public vocabularies are; the setting ``VOXELMILL_TOKENIZERS`` names another folder.
TOKENIZERS = "/opt/tokenizers"


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    folder = os.environ.get("VOXELMILL_TOKENIZERS", TOKENIZERS)
    return encode(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", f"{folder}/byte_bpe_50k.tiktoken")


QUERIES = {"p7_ids": p7_ids}
ORACLES: dict[str, str] = {}
