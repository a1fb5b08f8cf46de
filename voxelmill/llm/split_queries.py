"""Problem 4: splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from ..sources.tables import table
from .splits import grouped_split, together


def code_key(name: str) -> Column:
    """A batch or coverslip code without case, blanks, separators and leading zeros; null where it has no digit."""
    short = F.regexp_replace(F.regexp_replace(F.lower(F.col(name)), r"(?<![0-9])0+(?=[0-9])", ""), r"[^\p{L}\p{N}]+", "")
    return F.when(short.rlike("[0-9]"), short)


def day_key(name: str) -> Column:
    """The day that a date written in one of several ways means; null where it is none. Dotted dates are day.month.year."""
    bare = F.regexp_replace(F.regexp_replace(F.col(name), r"^\s+|\s+$", ""), r"[T ]\d{1,2}:.*$", "")
    ways = [
        (r"^\d{4}[-/.]\d{1,2}[-/.]\d{1,2}$", F.regexp_replace(bare, "[/.]", "-"), "y-M-d"),
        (r"^\d{1,2}\.\d{1,2}\.\d{4}$", bare, "d.M.y"),
        (r"^\d{8}$", bare, "yyyyMMdd"),
        (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", F.initcap(bare), "MMM d, y"),
        (r"^\d{1,2} [A-Za-z]{3} \d{4}$", F.initcap(bare), "d MMM y"),
    ]
    return F.coalesce(*[F.when(bare.rlike(shape), F.try_to_timestamp(text, F.lit(form)).cast("date")) for shape, text, form in ways])


def _split(spark: SparkSession, d: str) -> DataFrame:
    coverslip, day = code_key("coverslip"), day_key("experiment_date")
    rows = table(spark, d, "samples").select("sample_id", code_key("culture_batch").alias("batch"), F.when(coverslip.isNotNull() & day.isNotNull(), F.concat_ws("|", day.cast("string"), coverslip)).alias("slip"))
    return grouped_split(rows, "sample_id", ["batch", "slip"], table(spark, d, "split_targets"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of samples that the splits keep together."""
    return together(written(_split(spark, d), "splits"), "sample_id")


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each sample with the smallest of its group, and whether its group is in one split."""
    placed = written(_split(spark, d), "splits")
    whole = placed.groupBy("group_id").agg((F.min("split") == F.max("split")).alias("whole"))
    return placed.join(whole, "group_id").select("sample_id", "group_id", "whole")


QUERIES = {"p4_found": p4_found, "p4_splits": _split, "p4_groups": p4_groups}

_CODE = r"CASE WHEN regexp_matches({0}, '[0-9]') THEN regexp_replace(regexp_replace(lower({0}), '(^|[^0-9])0+([0-9])', '\1\2', 'g'), '[^\p{{L}}\p{{N}}]+', '', 'g') END"
_BARE = r"regexp_replace(trim(experiment_date), '[T ][0-9]{1,2}:.*$', '')"
_DAY = f"coalesce(try_strptime({_BARE}, '%Y-%m-%d'), try_strptime({_BARE}, '%Y/%m/%d'), try_strptime({_BARE}, '%d.%m.%Y'), try_strptime({_BARE}, '%Y%m%d'), try_strptime({_BARE}, '%b %d, %Y'))"
_REACH = f"""
WITH RECURSIVE r AS (SELECT sample_id AS s, {_CODE.format('culture_batch')} AS b, {_CODE.format('coverslip')} AS c, CAST({_DAY} AS DATE) AS t FROM samples),
k AS (SELECT DISTINCT s, 'b' || b AS k FROM r WHERE b IS NOT NULL UNION SELECT DISTINCT s, 'c' || c || '|' || t FROM r WHERE c IS NOT NULL AND t IS NOT NULL),
e AS (SELECT DISTINCT x.s AS u, y.s AS v FROM k x JOIN k y ON x.k = y.k WHERE x.s != y.s),
reach AS (SELECT u, v FROM e UNION SELECT reach.u, e.v FROM reach JOIN e ON reach.v = e.u)
"""
ORACLES = {
    "p4_found": _REACH + "SELECT u AS sample_id_a, v AS sample_id_b FROM reach WHERE u < v",
    "p4_groups": _REACH + "SELECT DISTINCT s AS sample_id, least(s, coalesce(m, s)) AS group_id, true AS whole FROM r LEFT JOIN (SELECT u, min(v) AS m FROM reach GROUP BY u) ON u = s WHERE s IS NOT NULL",
}
