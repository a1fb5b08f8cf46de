"""Problem 8: evaluation texts leaking into training text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .leaks import dialogue, exact_phrases, near_phrases, positional_index, words_of


def _spoken() -> Column:
    return words_of(dialogue("text"))


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents, the items' words, and the index of the documents' dialogue."""
    documents = table(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL")
    items = table(spark, d, "eval_items", "item_id", "text").select("item_id", words_of(F.col("text")).alias("words"))
    return documents, items, positional_index(documents.select("doc_id", _spoken().alias("words")), items, "doc_id")


def _places(spark: SparkSession, d: str) -> DataFrame:
    documents, items, index = _index(spark, d)
    return exact_phrases(index, documents, _spoken(), items, "doc_id", "item_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Each leaked item with the number of its documents and places."""
    return _places(spark, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.count(F.lit(1)).alias("n_places"))


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    """Proximity matches: five of the six rarest terms of an item within sixty words."""
    _, items, index = _index(spark, d)
    return near_phrases(index, items, "doc_id", "item_id", span=60, least=5)


QUERIES = {"p8_found": p8_found, "p8_items": p8_items, "p8_near": p8_near}

_PLACES = r"""
WITH bare AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[^\r\n]*-->[^\r\n]*', '', 'g'),
    '(^|[\r\n])[ \t]*\p{Nd}+[ \t]*([\r\n])', '\1\2', 'g'), '<[^<>]*>|\{[^{}]*\}', '', 'g'), '\[[^\[\]]*\]|\([^()]*\)', '', 'g') AS t
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM bare),
g AS (SELECT doc_id, i AS place, list_slice(w, i, i + 7) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
e AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
p AS (SELECT DISTINCT item_id, list_slice(w, i, i + 7) AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM e WHERE len(w) >= 8)),
found AS (SELECT DISTINCT doc_id, item_id, place FROM g JOIN p USING (g))
"""
ORACLES = {
    "p8_found": _PLACES + "SELECT DISTINCT doc_id, item_id FROM found",
    "p8_near": _PLACES.rsplit("g AS (", 1)[0] + r"""e AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM eval_items),
x AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS place FROM w), t AS (SELECT term, count(*) AS n FROM x WHERE term IN (SELECT term FROM e) GROUP BY 1),
r AS (SELECT item_id, term FROM e JOIN t USING (term) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n, term) <= 6),
h AS (SELECT doc_id, item_id, term, place FROM x JOIN r USING (term)), k AS (SELECT a.doc_id, a.item_id, a.place, count(DISTINCT b.term) AS hits FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.place BETWEEN a.place AND a.place + 59 GROUP BY ALL)
SELECT doc_id, item_id, CAST(place AS INT) AS "at", CAST(hits AS INT) AS hits FROM k WHERE hits >= 5 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY hits DESC, place) = 1""",
    "p8_items": _PLACES + "SELECT item_id, count(DISTINCT doc_id) AS n_documents, count(*) AS n_places FROM found GROUP BY 1",
}
