"""Problem 2: far too many small files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compaction
from ..session import written
from ..sources.tables import table

RECORD_BYTES = 64


def _joined(spark: SparkSession, d: str, once: bool) -> DataFrame:
    """The intact files joined into shards, whole or with ``once`` each record a single time."""
    whole = compaction.record_files(table(spark, d, "patch_files"), RECORD_BYTES)
    total = whole.agg(F.sum(F.size("names").cast("bigint"))).first()[0] or 0
    pieces = compaction.without_repeats(whole, RECORD_BYTES) if once else whole
    size = total * RECORD_BYTES
    return written(compaction.concatenate(pieces, compaction.shard_size(size), total_bytes=size, names="names", version="version"), "shards", compaction.ROW_GROUP)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """What the index of the joined files, as far as their shards hold what it says, and the manifest's places tell of each patch."""
    shards = _joined(spark, d, once=False)
    good = compaction.verify(shards).where("intact").select("shard_id", "part")
    index = compaction.record_index(shards, RECORD_BYTES).join(good, ["shard_id", "part"], "left_semi")
    return compaction.record_fates(table(spark, d, "manifest", "patch_id", "shard_path", "shard_index"), index)


def p2_shards(spark: SparkSession, d: str) -> DataFrame:
    """Every record of the intact files once, in shards that were cut up and held against their index again."""
    return compaction.verify(_joined(spark, d, once=True))


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    """Each record as it lies in its shard: its key and the digest of its bytes."""
    records = compaction.read_records(_joined(spark, d, once=True), RECORD_BYTES).where("record_key IS NOT NULL")
    return records.select("record_key", F.md5(F.hex("record")).alias("digest"))


QUERIES = {"p2_found": p2_found, "p2_shards": p2_shards, "p2_records": p2_records}

ORACLES = {
    "p2_found": r"""
WITH files AS (
  SELECT regexp_replace(regexp_replace(regexp_replace(file_path, '[/\\]+', '/', 'g'), '/(\./)+', '/', 'g'), '^(\./)+', '') AS loc,
         patch_ids, written_at
  FROM patch_files
  WHERE size_bytes > 0 AND map2_mask IS NOT NULL AND octet_length(map2_mask) = 64 * len(patch_ids)),
one AS (SELECT loc, patch_ids FROM files QUALIFY row_number() OVER (PARTITION BY loc ORDER BY written_at DESC) = 1),
entries AS (SELECT lower(trim(id)) AS k, count(*) AS n FROM (SELECT unnest(patch_ids) AS id FROM one) GROUP BY 1),
given AS (
  SELECT DISTINCT patch_id, regexp_replace(regexp_replace(regexp_replace(shard_path, '[/\\]+', '/', 'g'), '/(\./)+', '/', 'g'), '^(\./)+', '') AS p, shard_index AS i
  FROM manifest WHERE patch_id IS NOT NULL),
places AS (SELECT patch_id, count(*) FILTER (WHERE p IS NOT NULL AND i IS NOT NULL) AS n FROM given GROUP BY 1)
SELECT patch_id, 'lost' AS fate FROM places WHERE lower(trim(patch_id)) NOT IN (SELECT k FROM entries WHERE k IS NOT NULL)
UNION ALL
SELECT patch_id, 'repeated' FROM places LEFT JOIN entries ON k = lower(trim(patch_id)) WHERE coalesce(entries.n, 0) > 1 OR places.n > 1
UNION ALL
SELECT DISTINCT patch_id, 'clash' FROM given WHERE p IS NOT NULL AND i IS NOT NULL
  AND (p, i) IN (SELECT (p, i) FROM given WHERE p IS NOT NULL AND i IS NOT NULL GROUP BY p, i HAVING count(DISTINCT patch_id) > 1)
""",
    "p2_records": r"""
WITH files AS (
  SELECT regexp_replace(regexp_replace(regexp_replace(file_path, '[/\\]+', '/', 'g'), '/(\./)+', '/', 'g'), '^(\./)+', '') AS loc,
         patch_ids, written_at, hex(map2_mask) AS h
  FROM patch_files
  WHERE size_bytes > 0 AND map2_mask IS NOT NULL AND octet_length(map2_mask) = 64 * len(patch_ids)),
one AS (SELECT * FROM files WHERE loc IS NOT NULL QUALIFY row_number() OVER (PARTITION BY loc ORDER BY written_at DESC) = 1),
entries AS (SELECT loc, written_at, h, lower(trim(unnest(patch_ids))) AS record_key, unnest(range(len(patch_ids))) AS i FROM one),
latest AS (SELECT * FROM entries WHERE record_key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record_key ORDER BY written_at DESC, loc DESC, i) = 1)
SELECT record_key, md5(substring(h, CAST(i * 128 + 1 AS BIGINT), 128)) AS digest FROM latest
""",
}
