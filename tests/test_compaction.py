import datetime
import zlib

import pytest
import zstandard

from voxelmill.operators import compaction as C

AT = datetime.datetime(2026, 1, 1)
FILES = "file_path string, patch_ids array<string>, map2_mask binary, size_bytes bigint, written_at timestamp_ntz, location string"


def rows(shards):
    return shards.collect()


def index(files):
    return C.record_index(C.concatenate(C.record_files(files, 64), 100, names="names", version="version"), 64)


def test_lines_are_joined_whole_and_once(spark):
    texts = {f"f{i:03d}": b"h\n" + b"x" * i + (b"" if i % 2 else b"\n") for i in range(40)}
    df = spark.createDataFrame([(k, bytearray(v), 1) for k, v in texts.items()] + [(None, bytearray(b"z"), 1), ("n", None, 1)], "path string, content binary, location int")
    shards = rows(C.concatenate(df, 200, "lines", header=b"h\n"))
    assert len(shards) > 1
    lines = sorted(line for s in shards for line in bytes(s.payload).split(b"\n")[1:-1])
    assert lines == sorted(b"x" * i for i in range(40))
    assert sorted(p.location for s in shards for p in s.pieces) == sorted(texts)


def test_frames_stay_readable(spark):
    pack = zstandard.ZstdCompressor().compress
    df = spark.createDataFrame([(f"p{i}", bytearray(pack(b"%d;" % i))) for i in range(30)], "path string, content binary")
    shards = C.concatenate(df, 100, "zstd")
    out = b"".join(zstandard.ZstdDecompressor().stream_reader(bytes(s.payload), read_across_frames=True).read() for s in rows(shards))
    assert sorted(out.split(b";")[:-1]) == sorted(b"%d" % i for i in range(30))
    assert all(r.intact for r in rows(C.verify(shards)))


def test_a_broken_frame_is_refused(spark):
    df = spark.createDataFrame([("a", bytearray(b"plain"))], "path string, content binary")
    with pytest.raises(Exception, match="zstandard frame"):
        C.concatenate(df, 100, "zstd").collect()
    with pytest.raises(ValueError):
        C.concatenate(df, 100, "other")


def test_only_complete_frames_are_whole():
    body = b"some text, some text, some text" * 20
    kinds = [zstandard.ZstdCompressor(write_checksum=c, write_content_size=s) for c in (False, True) for s in (False, True)]
    for pack in (k.compress for k in kinds):
        frame = pack(body)
        skippable = (0x184D2A53).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"abc"
        assert C.whole_frames(frame) and C.whole_frames(frame + skippable + pack(b"") + frame) and C.whole_frames(b"")
        assert not any(C.whole_frames(frame[:k]) for k in range(1, len(frame))) and not C.whole_frames(frame + b"x")
        assert not C.whole_frames(bytes([frame[0] ^ 1]) + frame[1:])
        assert not C.whole_frames(frame[:4] + bytes([frame[4] | 8]) + frame[5:])


def test_flipped_bits_are_seen_by_decoding(spark):
    frame = bytearray(zstandard.ZstdCompressor(write_checksum=True).compress(bytes(range(200)) * 3))
    frame[30] ^= 4
    df = spark.createDataFrame([("a", frame), ("b", bytearray(zstandard.ZstdCompressor().compress(b"fine")))], "path string, content binary")
    shards = C.concatenate(df, 1 << 20, "zstd")
    assert [r.intact for r in rows(C.verify(shards))] == [True] and [r.intact for r in rows(C.verify(shards, decode=True))] == [False]


def test_repeats_are_cut_and_all_else_is_joined_whole(spark):
    one = lambda k: bytearray([k]) * 64
    later = AT + datetime.timedelta(days=1)
    files = spark.createDataFrame(
        [("a", ["p1", "p2", None], one(1) + one(2) + one(3), 5, AT, "x"), ("b", ["P2"], one(4), 5, later, "x"), ("c", ["p3", "p3"], one(5) + one(6), 5, AT, "x"), ("c", ["p9"], one(7), 5, AT - datetime.timedelta(days=1), "x")], FILES
    )
    shards = C.concatenate(C.without_repeats(C.record_files(files, 64), 64), 100, names="names", version="version")
    got = {(r.record_key, bytes(r.record)) for r in C.read_records(shards, 64).collect()}
    assert got == {("p1", bytes(one(1))), (None, bytes(one(3))), ("p2", bytes(one(4))), ("p3", bytes(one(5)))}
    assert all(r.intact for r in rows(C.verify(shards)))
    assert C.shard_size(1 << 40) == C.SHARD_BYTES and C.shard_size(10) == 1 << 16


def test_verify_sees_damage(spark):
    df = spark.createDataFrame([("a", bytearray(b"abc")), ("b", bytearray(b"")), ("c", bytearray(b"def"))], "path string, content binary")
    shards = C.concatenate(df, 100)
    assert [r.intact for r in rows(C.verify(shards))] == [True]
    from pyspark.sql import functions as F

    assert not any(r.intact for r in rows(C.verify(shards.withColumn("payload", F.concat(F.lit(b"x"), F.expr("substring(payload, 2)"))))))


def test_empty_table_gives_no_shard(spark):
    assert rows(C.concatenate(spark.createDataFrame([], "path string, content binary"), 10)) == []


def test_fates(spark):
    m = bytearray(64)
    files = spark.createDataFrame(
        [
            ("a/b.npz", ["P1"], m, 5, AT, "x"), (".\\a//b.npz", ["p1 "], m, 5, AT, "x"),
            ("c", ["p2", "p2"], m + m, 5, AT, "x"), ("d", ["p3"], bytearray(63), 5, AT, "x"), ("e", ["p4"], m, 0, AT, "x"),
            ("f", ["p5"], m, 5, AT, "x"), (None, ["p6"], m, 5, AT, "x"), ("g", None, m, 5, AT, "x"), ("h", [None], m, 5, AT, "x"), ("i", ["p7"], None, 5, AT, "x"),
        ],
        FILES,
    )
    manifest = spark.createDataFrame(
        [("p1", "s", 0), ("p1", ".\\s", 0), ("p2", "s", 1), ("p3", "s", 2), ("p4", "s", 3), ("p5", "s", 4), ("p5", "t", 4), ("p6", "s", 2), ("p7", None, 9), (None, "s", 0)],
        "patch_id string, shard_path string, shard_index int",
    )
    found = {(r.patch_id, r.fate) for r in C.record_fates(manifest, index(files)).collect()}
    assert found == {("p2", "repeated"), ("p3", "lost"), ("p4", "lost"), ("p5", "repeated"), ("p6", "lost"), ("p7", "lost"), ("p3", "clash"), ("p6", "clash")}
    assert C.record_fates(manifest.limit(0), index(files.limit(0))).count() == 0


def test_folder_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    for i in range(20):
        (tmp_path / "in" / f"{i}.txt").write_bytes(b"row %d" % i)
    (tmp_path / "in" / "empty.txt").write_bytes(b"")
    made = C.compact_folder(spark, str(tmp_path / "in" / "*.txt"), str(tmp_path / "out"), 60, "lines").collect()
    assert all(zlib.crc32(open(r.file_path, "rb").read()) == r.crc32 for r in made)
    lines = [x for r in made for x in open(r.file_path, "rb").read().splitlines()]
    assert sorted(lines) == sorted(b"row %d" % i for i in range(20)) and len(made) < 20
    listed = spark.read.parquet(str(tmp_path / "out" / "_index")).collect()
    assert len(listed) == 20 and all(r.length for r in listed)
    first = listed[0]
    assert open(first.file_path, "rb").read()[first.offset :][: first.length].startswith(b"row ")


def test_a_large_shard_and_its_index_are_never_one_row(spark):
    texts = {f"f{i:05d}": b"%d;" % i * (1 + i % 3) for i in range(10_000)} | {"g": bytes(700_000), "h": b"", "i": b"end"}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in texts.items()], "path string, content binary")
    shards = C.concatenate(df, C.SHARD_BYTES).cache()
    held = sorted(rows(shards), key=lambda r: r.chunk)
    assert {(r.shard_id, r.part) for r in held} == {(0, 0)} and [r.last for r in held] == [False] * (len(held) - 1) + [True]
    assert max(len(r.pieces) for r in held) <= C.CHUNK_PIECES and max(len(r.payload) for r in held) <= C.CHUNK_BYTES + 700_000
    whole = b"".join(bytes(r.payload) for r in held)
    assert whole == b"".join(texts[k] for k in sorted(texts))
    assert {p.location: whole[p.offset :][: p.length] for r in held for p in r.pieces} == texts
    assert [tuple(r) for r in rows(C.verify(shards))] == [(0, 0, len(texts), len(whole), zlib.crc32(whole), True)]
    for gone in range(len(held)):
        assert not any(r.intact for r in rows(C.verify(shards.where(f"chunk != {gone}"))))
    assert not any(r.intact for r in rows(C.verify(shards.unionByName(shards.where("chunk = 1")))))


def test_files_of_many_rows_are_written_whole(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    texts = [b"%d\n" % i * 9 for i in range(300)] + [b"x" * 400_000 + b"\n", b"y" * 300_000 + b"\n"]
    for i, t in enumerate(texts):
        (tmp_path / "in" / f"{i:04d}.txt").write_bytes(t)
    made = C.compact_folder(spark, str(tmp_path / "in" / "*.txt"), str(tmp_path / "out"), 1 << 20, "lines").collect()
    (one,) = made
    body = open(one.file_path, "rb").read()
    assert body == b"".join(texts) and (one.n_bytes, one.crc32) == (len(body), zlib.crc32(body))
    listed = spark.read.parquet(str(tmp_path / "out" / "_index")).collect()
    assert len(listed) == len(texts) and all(zlib.crc32(body[p.offset :][: p.length]) == p.crc32 for p in listed)
    assert not list((tmp_path / "out").glob("*.tmp"))
