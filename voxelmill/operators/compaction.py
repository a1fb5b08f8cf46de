"""Consolidation of very many small files into few well-sized ones by joining their bytes.

Contents are never parsed: a piece is copied as it is, only its boundary is looked at. Three kinds of
content are known: ``raw`` (any bytes, or fixed-length records), ``lines`` (newline-delimited text, with an
optional header line that is kept once per shard) and ``zstd`` (complete zstandard frames, which may
follow one another in one file). Every piece keeps its offset, length and CRC-32 in an index, so that
what comes out can be held against what went in.

Defined cases: null paths and null contents are no files and are left out; an empty content adds no
bytes but keeps its index row; several rows of one location are one file, of which the newest intact one
counts; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import entry_key, path_key
from ..session import written

# Fixed values of the zstandard frame format: magic number of a frame, and of skippable frames (16 in a row).
ZSTD_FRAME = 0xFD2FB528
ZSTD_SKIPPABLE = 0x184D2A50

#: Bytes of a well-sized shard.
SHARD_BYTES = 128 << 20

#: Bytes and pieces from which a row of a shard is full. A shard is many rows, so that neither its bytes nor its index ever are in memory as a whole.
CHUNK_BYTES, CHUNK_PIECES = 256 << 10, 4096

#: Bytes of a row group of a written table of shards, as a reader has a whole one in memory.
ROW_GROUP = 16 << 20

PIECES = "array<struct<location: string, offset: bigint, length: bigint, crc32: bigint, names: array<string>>>"
SHARD_SCHEMA = f"shard_id bigint, part int, chunk int, start bigint, before bigint, n_files bigint, n_bytes bigint, crc32 bigint, last boolean, payload binary, pieces {PIECES}"


def _intact(record_bytes: int, path: str, ids: str, payload: str, size: str) -> Column:
    return (
        F.col(path).isNotNull() & F.col(ids).isNotNull() & F.col(payload).isNotNull()
        & (F.col(size) > 0) & (F.octet_length(payload) == F.size(ids) * record_bytes)
    )


def record_fates(
    manifest: DataFrame, index: DataFrame, record: str = "patch_id", place_path: str = "shard_path", place_index: str = "shard_index"
) -> DataFrame:
    """Records of the manifest for which consolidation is at risk: ``record, fate``.

    ``lost``: in no intact file. ``repeated``: more than one entry in intact files, or more than one place.
    ``clash``: a place that the manifest gives to another record too. Null records and incomplete places
    count for nothing.
    """
    given = manifest.where(F.col(record).isNotNull()).select(
        F.col(record).alias("record"),
        F.when(F.col(place_path).isNotNull() & F.col(place_index).isNotNull(), F.concat_ws("|", F.col(place_index).cast("string"), path_key(place_path))).alias("place"),
    )
    given = given.distinct()
    by_record = given.groupBy("record").agg(F.count("place").alias("places")).select("record", "places", entry_key("record").alias("record_key"))
    entries = index.groupBy("record_key").agg(F.count(F.lit(1)).alias("entries"))
    held = by_record.join(entries, "record_key", "left")
    single = F.expr("""filter(array(
        CASE WHEN entries IS NULL THEN 'lost' END,
        CASE WHEN coalesce(entries, 0) > 1 OR places > 1 THEN 'repeated' END), x -> x IS NOT NULL)""")
    alone = held.select("record", F.explode(single).alias("fate"))
    shared = given.where("place IS NOT NULL").groupBy("place").agg(F.min("record").alias("least"), F.max("record").alias("most")).where("least < most").select("place")
    clash = given.join(shared, "place", "left_semi").select("record").distinct().select("record", F.lit("clash").alias("fate"))
    return alone.unionByName(clash).withColumnRenamed("record", record)


def whole_frames(body: bytes) -> bool:
    """Whether ``body`` is complete zstandard frames one after another and nothing else, told by block headers without decompressing."""
    at, n = 0, len(body)
    while at < n:
        if at + 5 > n:
            return False
        magic = int.from_bytes(body[at : at + 4], "little")
        if magic & ~0xF == ZSTD_SKIPPABLE:
            if at + 8 > n:
                return False
            at += 8 + int.from_bytes(body[at + 4 : at + 8], "little")
            continue
        if magic != ZSTD_FRAME:
            return False
        described = body[at + 4]
        single, summed = described >> 5 & 1, described >> 2 & 1
        if described & 8:  # a reserved bit
            return False
        at += 5 + (not single) + (0, 1, 2, 4)[described & 3] + (single, 2, 4, 8)[described >> 6]
        last = 0
        while not last:
            if at + 3 > n:
                return False
            block = int.from_bytes(body[at : at + 3], "little")
            last, kind, size = block & 1, block >> 1 & 3, block >> 3
            if kind == 3:  # a reserved kind
                return False
            at += 3 + (1 if kind == 1 else size)
        at += 4 * summed
    return at == n


def _closed(body: bytes, kind: str, header: bytes | None) -> bytes:
    """The bytes of one piece with its boundary in order; ValueError where a piece isn't complete."""
    if kind == "lines" and body:
        if header and body.startswith(header):
            body = body[len(header):]
        if body and not body.endswith(b"\n"):
            body += b"\n"
    elif kind == "zstd" and not whole_frames(body):
        raise ValueError("a piece isn't made of complete zstandard frames")
    return body


def shard_size(total_bytes: int, most: int = SHARD_BYTES, least: int = 1 << 16, shards: int = 16) -> int:
    """Target bytes of a shard: ``most``, less where that would leave cores without work, but no less than ``least``."""
    return max(least, min(most, -(-total_bytes // shards)))


def concatenate(
    pieces: DataFrame,
    target_bytes: int = SHARD_BYTES,
    kind: str = "raw",
    header: bytes | None = None,
    path: str = "path",
    content: str = "content",
    total_bytes: int | None = None,
    names: str | None = None,
    version: str | None = None,
) -> DataFrame:
    """Shards of about ``target_bytes`` that hold every piece once, in the order of its location.

    A location goes to a shard by its hash; a shard that grows past the target is closed and goes on in its next
    part. A part is the ``payload`` of its rows in the order of ``chunk``: a row is full at :data:`CHUNK_BYTES` or :data:`CHUNK_PIECES`, so
    a task holds one row and one piece in memory, however large shards and their indexes are. ``start`` is the row's place in the part, ``n_bytes`` its
    length, ``before`` and ``crc32`` the checksums of the part up to the row and with it, ``last`` ends a part. ``pieces`` is the
    index of the row (offsets in the part), with what the column ``names`` (an array) says of the contents. Several rows of a location are versions of one
    piece, of which the one with the greatest ``version`` is taken. Contents are summed where they are read, and
    refused if other bytes arrive. ``total_bytes`` spares a pass over the contents where their size is known.
    """
    if kind not in ("raw", "lines", "zstd"):
        raise ValueError(f"unknown kind {kind!r}")
    if target_bytes <= 0:
        raise ValueError("target_bytes must be above 0")
    given = pieces.where(F.col(path).isNotNull() & F.col(content).isNotNull()).select(
        F.col(path).alias("location"), F.col(content).alias("content"), F.crc32(content).alias("sum"),
        (F.col(names) if names else F.lit(None).cast("array<string>")).alias("names"), (F.col(version) if version else F.lit(0)).alias("version"),
    )
    if total_bytes is None:
        total_bytes = given.agg(F.sum(F.octet_length("content").cast("bigint"))).first()[0] or 0
    shards = max(1, -(-total_bytes // target_bytes))
    laid = given.withColumn("shard_id", F.pmod(F.xxhash64("location"), F.lit(shards)).cast("bigint"))
    laid = laid.repartition(int(min(shards, 20_000)), "shard_id").sortWithinPartitions("shard_id", "location", F.desc_nulls_last("version"))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, part, chunk, start, summed, body, index, before = None, 0, 0, 0, 0, bytearray(header or b""), [], None

        def close(last: bool) -> pd.DataFrame:
            nonlocal part, chunk, start, summed, body, index
            done, was = bytes(body), summed
            summed = zlib.crc32(done, was)
            row = {"shard_id": at, "part": part, "chunk": chunk, "start": start, "before": was, "n_files": len(index), "n_bytes": len(done), "crc32": summed, "last": last, "payload": done, "pieces": index}
            part, chunk, start, summed, body, index = (part + 1, 0, 0, 0, bytearray(header or b""), []) if last else (part, chunk + 1, start + len(done), summed, bytearray(), [])
            return pd.DataFrame({k: [v] for k, v in row.items()})

        for batch in batches:
            for shard, location, content, crc, called in zip(*[batch[c] for c in ("shard_id", "location", "content", "sum", "names")], strict=True):
                if location == before:
                    continue
                before = location
                if index and (shard != at or start + len(body) >= target_bytes):
                    yield close(last=True)
                elif len(body) >= CHUNK_BYTES or len(index) >= CHUNK_PIECES:
                    yield close(last=False)
                if shard != at:
                    at, part = shard, 0
                if zlib.crc32(content) != crc:
                    raise ValueError(f"{location} arrived with other bytes than were read")
                piece = _closed(bytes(content), kind, header)
                index.append({"location": location, "offset": start + len(body), "length": len(piece), "crc32": zlib.crc32(piece), "names": called})
                body += piece
        if index:
            yield close(last=True)

    return laid.select("shard_id", "location", "content", "sum", "names").mapInPandas(join, SHARD_SCHEMA)


def verify(shards: DataFrame, decode: bool = False) -> DataFrame:
    """Each shard held against its index: ``shard_id, part, n_files, n_bytes, crc32, intact``.

    ``intact``: the lengths and checksums of all rows of a part, which follow one another without a gap, and those of every piece cut out by its offset, agree;
    with ``decode`` every piece, being zstandard frames, must also decompress (with the frames' own checksums).
    """
    def readable(piece: memoryview) -> bool:
        import zstandard

        try:
            with zstandard.ZstdDecompressor().stream_reader(piece, read_across_frames=True) as stream:
                while stream.read(1 << 20):
                    pass
        except zstandard.ZstdError:
            return False
        return True

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for body, start, before, n, crc, pieces in zip(*[batch.column(c) for c in ("payload", "start", "before", "n_bytes", "crc32", "pieces")], strict=True):
                view, first = memoryview(body.as_buffer()), start.as_py()
                fine = len(view) == n.as_py() and zlib.crc32(view, before.as_py()) == crc.as_py()
                for offset, length, own in zip(*[pieces.values.field(c).to_pylist() for c in ("offset", "length", "crc32")], strict=True):
                    cut = view[max(0, offset - first) :][:length]
                    fine = fine and offset >= first and len(cut) == length and zlib.crc32(cut) == own and (not decode or readable(cut))
                good.append(fine)
            yield batch.select(links).append_column("good", pa.array(good, pa.bool_()))

    links = ["shard_id", "part", "chunk", "start", "before", "n_files", "n_bytes", "crc32", "last"]
    summed = F.transform("pieces", lambda p: F.struct(p["offset"].alias("offset"), p["length"].alias("length"), p["crc32"].alias("crc32")))
    held = shards.select(*links, "payload", summed.alias("pieces")).mapInArrow(
        hold, "shard_id bigint, part int, chunk int, start bigint, before bigint, n_files bigint, n_bytes bigint, crc32 bigint, last boolean, good boolean"
    )
    each = F.array_sort(F.collect_list(F.struct("chunk", "start", "before", "n_bytes", "crc32", "last")))
    parts = held.groupBy("shard_id", "part").agg(
        F.sum("n_files").alias("n_files"), F.sum("n_bytes").alias("n_bytes"), F.max_by("crc32", "chunk").alias("crc32"), F.every("good").alias("good"), each.alias("each")
    )
    follows = """NOT exists(transform(each, (x, i) -> x.chunk = i AND x.last = (i = size(each) - 1)
        AND x.start = if(i = 0, 0, get(each, i - 1).start + get(each, i - 1).n_bytes) AND x.before = if(i = 0, 0, get(each, i - 1).crc32)), fine -> NOT fine)"""
    return parts.select("shard_id", "part", "n_files", "n_bytes", "crc32", (F.col("good") & F.expr(follows)).alias("intact"))


def record_files(files: DataFrame, record_bytes: int, path: str = "file_path", ids: str = "patch_ids", payload: str = "map2_mask", size: str = "size_bytes", moment: str = "written_at") -> DataFrame:
    """``path, content, names, version`` of the intact files of fixed-length records, for :func:`concatenate`: whole files, their records' keys as names."""
    keys = F.transform(ids, entry_key)
    return files.where(_intact(record_bytes, path, ids, payload, size)).select(
        path_key(path).alias("path"), F.col(payload).alias("content"), keys.alias("names"), F.struct(F.col(moment).alias("moment"), keys.alias("keys"), F.crc32(payload).alias("crc32")).alias("version")
    )


def without_repeats(whole: DataFrame, record_bytes: int) -> DataFrame:
    """The files of :func:`record_files` less the records of which a newer copy is elsewhere (then the one of the greater path, then the earlier entry).

    Ids alone decide which records go; only files that lose some are cut, all others stay as they are. Records without an id stay.
    """
    latest = whole.groupBy("path").agg(F.max("version").alias("one")).select("path", "one.moment", F.posexplode("one.keys").alias("entry", "record_key")).where("record_key IS NOT NULL")
    best = latest.groupBy("record_key").agg(F.max(F.struct("moment", "path", (-F.col("entry")).alias("place"))).alias("kept"))
    rest = latest.join(best, "record_key").where((F.col("path") != F.col("kept.path")) | (F.col("entry") != -F.col("kept.place")))
    gone = rest.groupBy("path").agg(F.collect_set("entry").alias("_gone"))
    kept = F.filter(F.sequence(F.lit(0), F.size("names") - 1), lambda i: ~F.array_contains("_gone", i))
    cut = F.aggregate(kept, F.lit(b""), lambda s, i: F.concat(s, F.substring(F.col("content"), i * record_bytes + 1, F.lit(record_bytes))))
    lessened = F.col("_gone").isNotNull()
    return whole.join(gone, "path", "left").select(
        "path", F.when(lessened, cut).otherwise(F.col("content")).alias("content"), F.when(lessened, F.transform(kept, lambda i: F.get("names", i))).otherwise(F.col("names")).alias("names"), "version"
    )


def record_index(shards: DataFrame, record_bytes: int) -> DataFrame:
    """``record_key, shard_id, part, location, entry, offset, length``: every record of every shard, out of the shards' index of pieces."""
    pieces = shards.select("shard_id", "part", F.explode("pieces").alias("p")).select("shard_id", "part", "p.location", "p.offset", F.posexplode("p.names").alias("entry", "record_key"))
    return pieces.select("record_key", "shard_id", "part", "location", "entry", (F.col("offset") + F.col("entry").cast("bigint") * record_bytes).alias("offset"), F.lit(record_bytes).cast("bigint").alias("length"))


def read_records(shards: DataFrame, record_bytes: int) -> DataFrame:
    """``record_key, record``: the bytes of every record, cut out of its shard by the index."""
    cut = shards.select("payload", "start", F.explode("pieces").alias("p")).select(F.substring(F.col("payload"), (F.col("p.offset") - F.col("start") + 1).cast("int"), F.col("p.length").cast("int")).alias("piece"), F.posexplode("p.names").alias("entry", "record_key"))
    return cut.select("record_key", F.substring(F.col("piece"), F.col("entry") * record_bytes + 1, F.lit(record_bytes)).alias("record"))


def write_shards(shards: DataFrame, folder: str, suffix: str = ".bin") -> DataFrame:
    """Write each shard to a file of ``folder``, which all executors must have mounted: ``file_path, n_bytes, crc32, last, pieces`` for each of its rows.

    Bytes and checksum are those of the file up to the row, of the whole file where it is the ``last``. The rows of a file must come one after another, as
    :func:`concatenate` gives them; ValueError where one is missing. A file is written under a name of its own and then renamed, so a task that runs
    again leaves one whole file.
    """
    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, at, summed, f = None, 0, 0, None
        for batch in batches:
            out = []
            for shard, part, start, before, last, body, pieces in zip(*[batch[c] for c in ("shard_id", "part", "start", "before", "last", "payload", "pieces")], strict=True):
                final = os.path.join(folder, f"shard-{int(shard):06d}-{int(part):04d}{suffix}")
                if f is None:
                    name, at, summed, f = final, 0, 0, open(f"{final}.{uuid.uuid4().hex}.tmp", "wb")  # noqa: SIM115
                if (final, start, before) != (name, at, summed):
                    raise ValueError(f"{name} came with other rows between or with gaps")
                f.write(body)
                at, summed = at + len(body), zlib.crc32(body, summed)
                if last:
                    f.close()
                    os.replace(f.name, final)
                    f = None
                out.append((final, at, summed, last, pieces))
            yield pd.DataFrame(out, columns=["file_path", "n_bytes", "crc32", "last", "pieces"])
        if f is not None:
            raise ValueError(f"{name} came without its end")

    return shards.select("shard_id", "part", "start", "before", "last", "payload", "pieces").mapInPandas(put, f"file_path string, n_bytes bigint, crc32 bigint, last boolean, pieces {PIECES}")


def compact_folder(spark, pattern: str, folder: str, target_bytes: int = SHARD_BYTES, kind: str = "lines", header: bytes | None = None) -> DataFrame:
    """Join the files that match ``pattern`` into shards in ``folder``: ``file_path, n_bytes, crc32`` of each.

    Their index, a row for each joined file, is written to ``folder/_index`` as Parquet (Spark's file source gives no rows for files of 0 bytes, of which nothing is to
    be joined). Contents are read once; the number of shards comes from the listing's lengths.
    """
    files = spark.read.format("binaryFile").load(pattern)
    total = files.agg(F.sum("length")).first()[0] or 0
    suffix = {"lines": ".txt", "zstd": ".zst"}.get(kind, ".bin")
    made = written(write_shards(concatenate(files.select("path", "content"), target_bytes, kind, header, total_bytes=total), folder, suffix), "compacted", ROW_GROUP)
    made.select("file_path", F.inline("pieces")).drop("names").write.mode("overwrite").parquet(f"{folder}/_index")
    return made.where("last").drop("pieces", "last")
