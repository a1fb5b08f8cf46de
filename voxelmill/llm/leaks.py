"""Evaluation passages in training text, found by a positional inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Consecutive words that make a leak.
WORDS = 8
#: Rarest words of a phrase whose lists are intersected before the text itself is looked at.
LISTS = 2


def dialogue(text: Column | str) -> Column:
    """Subtitle text without timing lines, lines of digits, markup in ``<>`` or ``{}`` and text in brackets."""
    out = F.col(text) if isinstance(text, str) else text
    out = F.regexp_replace(out, r"[^\r\n]*-->[^\r\n]*", "")
    out = F.regexp_replace(out, r"(?<![^\r\n])[ \t]*\p{Nd}+[ \t]*(?![^\r\n])", "")
    out = F.regexp_replace(out, r"<[^<>]*>|\{[^{}]*\}", "")
    return F.regexp_replace(out, r"\[[^\[\]]*\]|\([^()]*\)", "")


def words_of(text: Column) -> Column:
    """Runs of letters and digits in lower case, in order; null stays null."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def positional_index(texts: DataFrame, items: DataFrame, identity: str) -> DataFrame:
    """``term, identity, at``: the stored positional index of all places where the ``words`` of ``texts`` have a word of ``items``.

    Written once, as one segment for each task, sorted by term: whatever a query asks for is read from it, and Parquet skips
    what it doesn't. Nothing is shuffled. Words that no item has are never stored.
    """
    vocabulary = items.where(F.col("words").isNotNull()).select(F.explode("words").alias("term")).distinct()
    every = texts.where(F.col(identity).isNotNull()).select(identity, F.posexplode_outer("words").alias("at", "term"))  # outer: no filter that makes the words once more
    places = every.join(vocabulary, "term", "left_semi")
    return written(places.select("term", identity, "at").sortWithinPartitions("term", identity, "at"), "index")


def phrases(items: DataFrame, counts: DataFrame, item: str, n: int, lists: int = LISTS) -> DataFrame:
    """``item, phrase, rare``: each run of ``n`` words of an item with the ``lists`` rarest of its words in the corpus (``offset, term``).

    Phrases with a word that the corpus lacks can't occur in it and are left out.
    """
    runs = items.where(F.size("words") >= n).select(item, "words", F.explode(F.sequence(F.lit(1), F.size("words") - n + 1)).alias("_first"))
    runs = runs.select(item, F.slice("words", F.col("_first"), n).alias("phrase")).distinct()
    spread = runs.select(item, "phrase", F.posexplode("phrase").alias("offset", "term")).join(counts, "term", "left")
    sorted_words = F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "offset", "term"))).alias("rare")
    return spread.groupBy(item, "phrase").agg(sorted_words).where("rare[0].count > 0").select(item, "phrase", F.slice("rare", 1, lists).alias("rare"))


def exact_phrases(index: DataFrame, documents: DataFrame, words: Column, items: DataFrame, identity: str, item: str, n: int = WORDS) -> DataFrame:
    """``identity, item, at``: where ``words`` of a row of ``documents`` hold ``n`` consecutive words of an item.

    ``index`` is the :func:`positional_index` of the same documents. Its lists of a phrase's rarest words, each adjusted by the word's
    place in the phrase, are intersected: a phrase may begin only where all of them agree. Only documents with such a place are read
    again, and the words there are held against the phrase one by one. Null identities and word lists take no part,
    empty ones hold nothing; repeated rows give repeated places only once.
    """
    asked = items.where(F.col(item).isNotNull() & F.col("words").isNotNull()).select(item, "words")
    wanted = written(phrases(asked, index.groupBy("term").count(), item, n).withColumn("_phrase", F.xxhash64(item, "phrase")), "phrases")
    rarest = wanted.select("_phrase", "rare", F.col("rare")[0]["term"].alias("term"))
    places = index.join(rarest, "term").select(identity, (F.col("at") - F.col("rare")[0]["offset"]).alias("at"), "_phrase", "rare").where("at >= 0")
    for i in range(1, min(LISTS, n)):
        word = F.col("rare")[i]
        others = wanted.select(F.col("rare")[i]["term"].alias("term")).distinct()
        mine = index.join(others, "term", "left_semi").select("term", identity, F.col("at").alias("_at"))  # what is read of the index
        places = places.withColumn("term", word["term"]).withColumn("_at", F.col("at") + word["offset"]).join(mine, ["term", identity, "_at"], "left_semi").drop("term", "_at")
    held = places.drop("rare").distinct().join(wanted.select("_phrase", item, "phrase"), "_phrase").groupBy(identity).agg(F.collect_list(F.struct("at", item, "phrase")).alias("_places"))
    held = written(held, "places")
    concerned = documents.join(written(held.select(identity), "concerned"), identity, "left_semi")  # numbers only, so few bytes decide
    found = concerned.select(identity, words.alias("_words")).join(held, identity).select(identity, "_words", F.explode("_places").alias("_place"))
    found = found.where(F.slice("_words", F.col("_place.at") + 1, n).eqNullSafe(F.col("_place.phrase")))  # null-safe: no filter on all texts' words
    return found.select(identity, F.col(f"_place.{item}").alias(item), F.col("_place.at").alias("at")).distinct()


def near_phrases(index: DataFrame, items: DataFrame, identity: str, item: str, span: int, least: int, rare: int = 6) -> DataFrame:
    """``identity, item, at, hits``: proximity matches, places from which ``span`` words hold ``least`` of an item's ``rare`` rarest terms.

    Terms that the corpus lacks don't count as rare. Only the index's lists of rare terms are merged, by document and item; the first
    place with most different terms is given. An item with fewer than ``least`` terms in the corpus can't be found.
    """
    terms = items.where(F.col(item).isNotNull()).select(item, F.explode("words").alias("term")).distinct()
    order = Window.partitionBy(item).orderBy("count", "term")
    wanted = written(terms.join(index.groupBy("term").count(), "term").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= rare).select(item, "term"), "rare-terms")
    hits = index.join(wanted, "term")
    ahead = Window.partitionBy(identity, item).orderBy("at").rangeBetween(0, span - 1)
    found = hits.withColumn("hits", F.size(F.collect_set("term").over(ahead))).where(F.col("hits") >= least)
    best = found.groupBy(identity, item).agg(F.max(F.struct("hits", (-F.col("at")).alias("at"))).alias("best"))
    return best.select(identity, item, (-F.col("best.at")).alias("at"), "best.hits")
