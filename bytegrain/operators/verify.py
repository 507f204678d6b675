"""ZIP archives read and verified: a row for each entry with ok and error, instead of stopping at the first fault."""

from __future__ import annotations

import io
import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytegrain.errors import ArchiveConsistency, EngineError, EntryNotFound, VerificationFailed, ZipStructure
from bytegrain.operators.archive import CENTRAL, CENTRAL_SIGNATURE, END, END_SIGNATURE, LOCAL, LOCAL_SIGNATURE, in_batches, spark_schema
from bytegrain.operators.deflate import inflate

_U16, _U32 = struct.Struct("<H"), struct.Struct("<I")


def u16(data: bytes, at: int) -> int:
    """A little-endian number, or ZipStructure beyond the end."""
    if at < 0 or at + 2 > len(data):
        raise ZipStructure("read beyond the end")
    return _U16.unpack_from(data, at)[0]


def u32(data: bytes, at: int) -> int:
    if at < 0 or at + 4 > len(data):
        raise ZipStructure("read beyond the end")
    return _U32.unpack_from(data, at)[0]


def find_end(data: bytes) -> dict:
    """The end record: searched backwards, through the longest possible comment."""
    at = data.rfind(_U32.pack(END_SIGNATURE), max(0, len(data) - 65557))
    while at >= 0 and at + END.size > len(data):
        at = data.rfind(_U32.pack(END_SIGNATURE), max(0, len(data) - 65557), at + 3)
    if at < 0:
        raise ZipStructure("no end of central directory")
    _, _, _, disk, total, size, offset, _ = END.unpack_from(data, at)
    if offset + size > at:
        raise ArchiveConsistency("central directory reaches past its end record")
    return {"eocd_offset": at, "disk_entries": disk, "total_entries": total, "central_size": size, "central_offset": offset}


def directory(data: bytes) -> list[dict]:
    """The central directory: name, method, crc32, sizes and local offset of each entry."""
    end = find_end(data)
    at, last, out = end["central_offset"], end["central_offset"] + end["central_size"], []
    for _ in range(end["total_entries"]):
        if at + CENTRAL.size > last:
            raise ZipStructure("central record is cut")
        f = CENTRAL.unpack_from(data, at)
        if f[0] != CENTRAL_SIGNATURE:
            raise ZipStructure("central signature")
        name_at = at + CENTRAL.size
        at = name_at + f[10] + f[11] + f[12]
        if at > last:
            raise ZipStructure("central name is cut")
        out.append({"name": data[name_at : name_at + f[10]].decode("utf-8", "replace"), "method": f[4], "crc32": f[7], "compressed_size": f[8], "uncompressed_size": f[9], "local_offset": f[16]})
    if at != last:
        raise ArchiveConsistency("central directory size")
    return out


def payload_bounds(data: bytes, entry: dict) -> tuple[int, int]:
    """Where the entry's payload lies."""
    at = entry["local_offset"]
    if at + LOCAL.size > len(data):
        raise ArchiveConsistency("local offset")
    f = LOCAL.unpack_from(data, at)
    if f[0] != LOCAL_SIGNATURE:
        raise ZipStructure("local signature")
    first = at + LOCAL.size + f[9] + f[10]
    if first + entry["compressed_size"] > len(data):
        raise ArchiveConsistency(f"payload of {entry['name']} is cut")
    return first, first + entry["compressed_size"]


def local_record(data: bytes, entry: dict) -> tuple[int, int, int]:
    """crc32 and sizes in the local header."""
    f = LOCAL.unpack_from(data, entry["local_offset"])
    return f[6], f[7], f[8]


def content_of(entry: dict, payload: bytes) -> bytes:
    """The entry's content, with its size and CRC checked."""
    name, size = entry["name"], entry["uncompressed_size"]
    if entry["method"] == 0:
        out = payload
        if len(out) != size:
            raise VerificationFailed("stored size", name)
    elif entry["method"] == 8:
        try:
            out = inflate(payload, size)
        except ValueError as e:
            raise VerificationFailed(str(e), name) from None
    else:
        raise VerificationFailed(f"unsupported method {entry['method']}", name)
    if (got := zlib.crc32(out)) != entry["crc32"]:
        raise VerificationFailed(f"crc {got:08x}, {entry['crc32']:08x} expected", name)
    return out


def read_entry(data: bytes, name: str) -> bytes:
    """One entry by its exact name, the first of that name; bounds, size and CRC are checked."""
    for e in directory(data):
        if e["name"] == name:
            first, last = payload_bounds(data, e)
            return content_of(e, data[first:last])
    raise EntryNotFound(name)


_SIZES = [(n, pa.int64()) for n in ("crc32", "compressed_size", "uncompressed_size")]
_ENTRY = pa.schema([("archive", pa.string()), ("name", pa.string()), ("method", pa.int32()), *_SIZES, ("local_offset", pa.int64()), *((f"local_{n}", k) for n, k in _SIZES), ("payload", pa.binary()), ("error", pa.string())])
_CHECKED = pa.schema([("archive", pa.string()), ("name", pa.string()), ("method", pa.int32()), *_SIZES, ("ok", pa.bool_()), ("error", pa.string()), ("content", pa.binary())])


def parse_archives(archives: DataFrame) -> DataFrame:
    """archives (path, content) -> a row for each central record, with what its local header says and its payload; a broken archive is one row with an error."""
    blank = dict.fromkeys(_ENTRY.names)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for path, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = held.as_py() or b""  # one archive at a time
                try:
                    found = directory(content)
                except EngineError as e:
                    yield blank | {"archive": path, "error": f"{type(e).__name__}: {e}"}
                    continue
                for entry in found:
                    row = blank | {"archive": path} | entry
                    try:
                        first, last = payload_bounds(content, entry)
                        row["payload"] = content[first:last]
                        row["local_crc32"], row["local_compressed_size"], row["local_uncompressed_size"] = local_record(content, entry)
                    except EngineError as e:
                        row["error"] = f"{type(e).__name__}: {e}"
                    yield row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(records(batches), _ENTRY, lambda r: len(r["payload"] or b""))

    return archives.select("path", "content").mapInArrow(run, spark_schema(_ENTRY))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Central records and payloads of all ZIP files under a path, through Spark's reader."""
    return parse_archives(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path))


def verify_entries(records: DataFrame, strict: bool = False, keep_content: bool = False) -> DataFrame:
    """read_archives()'s rows -> archive, name, method, crc32, sizes, ok, error (and content). strict also compares local with central records."""
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = _CHECKED if keep_content else _CHECKED.remove(len(_CHECKED) - 1)

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                error, content = r["error"], None
                if error is None and strict and any(r[n] != r[f"local_{n}"] for n in ("crc32", "compressed_size", "uncompressed_size")):
                    error = "ArchiveConsistency: local and central records differ"
                if error is None:
                    try:
                        content = content_of(r, r["payload"])
                    except EngineError as e:
                        error = f"{type(e).__name__}: {e}"
                yield r | {"ok": error is None, "error": error, "content": content if keep_content else None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(checked(batches), schema, lambda r: len(r["content"] or b""))

    return records.repartition(parts).mapInArrow(run, spark_schema(schema))


def verification_summary(checked: DataFrame) -> DataFrame:
    """One row: entries verified, bytes inflated, faults."""
    ok = F.col("ok")
    return checked.agg(F.count(F.when(ok, 1)).alias("entries_verified"), F.coalesce(F.sum(F.when(ok, F.col("uncompressed_size"))), F.lit(0)).cast("long").alias("inflated_bytes"), F.count(F.when(~ok, 1)).alias("failures"))


def round_trip(entries: DataFrame, checked: DataFrame) -> DataFrame:
    """logical_name, matched, reason: source entries against archived ones (with content), by name, both ways."""
    s = entries.select("logical_name", F.sha2("content", 256).alias("source"))
    a = checked.select(F.col("name").alias("logical_name"), F.sha2("content", 256).alias("archived"), "ok")
    both = s.join(a, "logical_name", "full_outer")
    reason = F.when(F.col("source").isNull(), "not in the source").when(F.col("ok").isNull(), "not in the archive").when(~F.col("ok"), "not readable").when(F.col("source") != F.col("archived"), "content differs").otherwise("")
    return both.select("logical_name", (reason == "").alias("matched"), reason.alias("reason"))


def extract(checked: DataFrame, folder: str) -> int:
    """Writes every verified entry (with content) below a folder that executors share; returns how many. Names that lead out of it are refused."""
    top = os.path.abspath(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                to = os.path.abspath(os.path.join(top, name))
                if not to.startswith(top + os.sep):
                    raise VerificationFailed("name leads out of the folder", name)
                os.makedirs(os.path.dirname(to), exist_ok=True)
                with open(to, "wb") as f:
                    f.write(content)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return checked.where("ok").select("name", "content").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def stock_zip(files: dict[str, bytes], level: int = 6) -> bytes:
    """The stock ZIP of the same files, to compare with."""
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=level) as z:
        for name, content in sorted(files.items()):
            z.writestr(zipfile.ZipInfo(name), content, zipfile.ZIP_DEFLATED, level)
    return out.getvalue()
