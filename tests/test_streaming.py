import datetime

from voxelmill.streaming import ingest

SCHEMA = "patch_id string, sample_id string, loaded_at timestamp"


def test_each_patch_is_taken_once_over_two_runs(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    at = lambda h: datetime.datetime(2026, 1, 1, h, tzinfo=datetime.timezone.utc)
    for rows in ([("a", "s", at(1)), ("b", "s", at(2)), (None, "s", at(2))], [("a", "s", at(3)), ("c", "t", at(4))]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = ingest.first_deliveries(ingest.manifest_stream(spark, source, spark.createDataFrame([], SCHEMA).schema))
        ingest.append(stream, out, state).awaitTermination()
    assert sorted(r.patch_id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_arrivals(spark, tmp_path):
    rows = [("a", "s", datetime.datetime(2026, 1, 1, 1, 10)), ("b", "s", datetime.datetime(2026, 1, 1, 1, 50)), ("c", "s", datetime.datetime(2026, 1, 1, 2))]
    assert sorted(r.n for r in ingest.arrivals(spark.createDataFrame(rows, SCHEMA)).collect()) == [1, 2]
