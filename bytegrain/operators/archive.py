"""Compressing entries and writing ZIP archives.

    entries -> signals -> decisions -> blocks -> tokens -> payloads -> archive

Blocks of all entries are one DataFrame, so a large entry uses as many tasks as it has
blocks. Only the tokens of entries of several blocks are brought together by entry, for
the entry's stream; an entry of one block is encoded where it is matched.
"""

from __future__ import annotations

import itertools
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from bytegrain.config import Profile
from bytegrain.errors import RepeatedName, ZipStructure
from bytegrain.functions import sql as S
from bytegrain.operators.codec import TOGETHER, Block, compress_each, cut_blocks, encode_entry, is_adaptive, match_adaptively, match_together
from bytegrain.operators.intel import archive_model, decide, signals
from bytegrain.operators.layout import layout_order, numbered
from bytegrain.operators.lz import Tokens
from bytegrain.operators.plan_entry import EntryPlan, Model
from bytegrain.operators.stored import new_path, scratch, shuffles_deleted, stored



def _fields(kind: pa.DataType, names: str) -> list[pa.Field]:
    return [pa.field(n, kind) for n in names.split()]


_PLAN = [
    *_fields(pa.float64(), "entropy_bits repeat_density bigram_proxy match_strength_proxy"), pa.field("predicted_stored", pa.bool_()), pa.field("predicted_deflate_path", pa.string()),
    pa.field("target_block_bytes", pa.int64()), pa.field("lz77_chain_mult", pa.float64()), pa.field("use_global_huffman", pa.bool_()),
]
_MODEL = [*_fields(pa.int64(), "m_entry_count m_total_uncompressed m_text_mass m_duplicate_mass m_suggested_block_bytes"), *_fields(pa.int32(), "m_lz77_max_chain m_lz77_nice_match m_index_stride")]
_DECIDED = [f.name for f in (*_PLAN, *_MODEL)]
_NAME = pa.field("logical_name", pa.string())
_BLOCK = pa.schema([_NAME, *_PLAN, *_MODEL, *_fields(pa.int64(), "block_id offset length blocks"), *_fields(pa.binary(), "data indexed")])
_TRACE = pa.struct([*_fields(pa.int64(), "block_id offset raw_bytes compressed_bytes token_count"), *_fields(pa.float64(), "predicted_ratio actual_ratio"), *_fields(pa.int64(), "matches_window matches_index"), pa.field("fallback_code", pa.int32())])
_PAYLOAD = pa.schema([_NAME, pa.field("method", pa.string()), pa.field("payload", pa.binary()), pa.field("trace", pa.list_(_TRACE))])
#: A block's tokens, or (of an entry that is encoded already) what _PAYLOAD has.
_TOKENS = pa.schema([*_PAYLOAD, *_PLAN, *_fields(pa.int64(), "block_id offset length"), *_fields(pa.binary(), "tokens values"), *_fields(pa.int64(), "from_window from_index")])
#: What compress() has, under a profile.
_PACKED = pa.schema([pa.field("profile", pa.string()), _NAME, *_fields(pa.int64(), "uncompressed_size"), pa.field("method", pa.string()), *_fields(pa.int64(), "crc32 compressed_size"), pa.field("stored_effective", pa.bool_()), pa.field("payload", pa.binary())])
_SUMMARY = pa.schema([pa.field("path", pa.string()), *_fields(pa.int64(), "central_directory_offset central_directory_size total_entries archive_size")])


def spark_schema(schema: pa.Schema) -> T.StructType:
    return from_arrow_schema(schema)


def _entry_plan(row: dict) -> EntryPlan:
    return EntryPlan(row["entropy_bits"], row["repeat_density"], row["bigram_proxy"], row["match_strength_proxy"], row["predicted_stored"], row["predicted_deflate_path"], row["target_block_bytes"], row["lz77_chain_mult"], row["use_global_huffman"])


def _model(row: dict) -> Model:
    return Model(row["m_entry_count"], row["m_total_uncompressed"], row["m_text_mass"], row["m_duplicate_mass"], block=row["m_suggested_block_bytes"], chain=row["m_lz77_max_chain"], nice=row["m_lz77_nice_match"], stride=row["m_index_stride"])


def _plan(row: dict) -> tuple[EntryPlan, Model]:
    return _entry_plan(row), _model(row)


def record_batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(schema.names, schema.types, strict=True)], names=schema.names)


def plan_blocks(decided: DataFrame, p: Profile = Profile()) -> DataFrame:
    """decided (with content) -> a row for each block of entries that are to be compressed: decisions, place, and its bytes with the window before them."""
    columns = decided.select("logical_name", *_DECIDED, "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            contents = batch.column("content")
            for row, content in zip(batch.drop_columns(["content"]).to_pylist(), contents, strict=True):
                plan, model = _plan(row)
                if plan.method(p) == "Stored":
                    continue
                cut = cut_blocks(content.as_py(), plan.target, p, model) or [Block(0, 0, 0, b"", None)]
                for b in cut:
                    out.append(row | {"block_id": b.number, "offset": b.offset, "length": b.length, "blocks": len(cut), "data": b.data, "indexed": b.indexed})
                    size += len(b.data)
                    if size >= TOGETHER:
                        yield record_batch(out, _BLOCK)
                        out, size = [], 0
        if out:
            yield record_batch(out, _BLOCK)

    return columns.mapInArrow(run, spark_schema(_BLOCK))


def _token_row(row: dict, t: Tokens) -> dict:
    return row | {"tokens": t.length.tobytes(), "values": t.value.tobytes(), "from_window": t.from_window, "from_index": t.from_index, "method": None, "payload": None, "trace": None}


def _block(row: dict) -> Block:
    return Block(row["block_id"], row["offset"], row["length"], row["data"], row["indexed"])


def _encoded(rows: list[dict], tokens: list[Tokens], p: Profile, trace: bool) -> dict:
    """What _PAYLOAD has, from an entry's blocks and their tokens."""
    cut = [Block(r["block_id"], r["offset"], r["length"], b"", None) for r in rows]
    e = encode_entry(b"", cut, tokens, _entry_plan(rows[0]), p, trace)
    return {"logical_name": rows[0]["logical_name"], "method": e.method, "payload": None if e.method == "Stored" else e.payload, "trace": e.trace}


def _whole(row: dict) -> dict:
    """A row of an entry that is encoded already."""
    return dict.fromkeys(_TOKENS.names) | row


def in_batches(rows: Iterator[dict], schema: pa.Schema, size: Callable[[dict], int]) -> Iterator[pa.RecordBatch]:
    """Batches of about TOGETHER bytes."""
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += size(row)
        if held >= TOGETHER or len(out) >= 4096:
            yield record_batch(out, schema)
            out, held = [], 0
    if out:
        yield record_batch(out, schema)


def match_blocks(blocks: DataFrame, p: Profile = Profile(), trace: bool = False) -> DataFrame:
    """Tokens of each block, or the payload of entries that are whole in a task. Blocks are independent, and dealt out one by one; with adaptive feedback an entry's blocks follow each other."""
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def together(rows: list[dict]) -> Iterator[dict]:
        plans = map(_plan, rows)
        found = itertools.chain.from_iterable(match_together([(_block(r), plan.chain(p, model), plan.nice(p, model)) for r, (plan, model) in zip(rows, plans, strict=True)]))
        for r, t in zip(rows, found, strict=True):
            yield _whole(_encoded([r], [t], p, trace)) if r["blocks"] == 1 else _token_row(r, t)

    def follow(rows: Iterator[dict]) -> dict:
        first = next(rows)
        plan, model = _plan(first)
        seen = []

        def cut() -> Iterator[Block]:
            for r in itertools.chain([first], rows):
                seen.append({n: v for n, v in r.items() if n not in ("data", "indexed")})
                yield _block(r)

        found = match_adaptively(cut(), plan.chain(p, model), plan.nice(p, model), plan.predicted_ratio(p))
        return _whole(_encoded(seen, found, p, trace))

    def matched(rows: Iterator[dict]) -> Iterator[dict]:
        waiting, size = [], 0
        for _, some in itertools.groupby(rows, key=lambda r: r["logical_name"]):
            first = next(some)
            some = itertools.chain([first], some)
            if is_adaptive(first["blocks"], _entry_plan(first), p):
                yield follow(some)
                continue
            for r in some:
                if waiting and size + len(r["data"]) > TOGETHER:
                    yield from together(waiting)
                    waiting, size = [], 0
                waiting.append(r)
                size += len(r["data"])
        yield from together(waiting)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (batch.slice(i, 64) for batch in batches for i in range(0, batch.num_rows, 64))
        return in_batches(matched(r for some in rows for r in some.to_pylist()), _TOKENS, lambda r: len(r["payload"] or b"") + len(r["tokens"] or b"") * 2)

    dealt = blocks.repartition(parts, "logical_name").sortWithinPartitions("logical_name", "block_id") if p.adaptive else blocks.repartition(parts, "logical_name", "block_id")
    return dealt.mapInArrow(run, spark_schema(_TOKENS))


def encode_payloads(tokens: DataFrame, p: Profile = Profile(), trace: bool = False) -> DataFrame:
    """logical_name, method, payload (null if it is the content itself) and block trace of the compressed entries."""
    # dealt out by name and sorted, so that one task reads an entry's blocks one after another; no task holds more than one entry and a batch
    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = tokens.repartition(parts, "logical_name").sortWithinPartitions("logical_name", "block_id")

    def encoded(found: list[dict]) -> dict:
        if found[0]["method"] is not None:
            return found[0]
        return _encoded(found, [Tokens(np.frombuffer(r["tokens"], np.uint16), np.frombuffer(r["values"], np.uint16), r["from_window"], r["from_index"]) for r in found], p, trace)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = (batch.slice(i, 64) for batch in batches for i in range(0, batch.num_rows, 64))
        each_row = (row for x in some for row in x.to_pylist())
        return in_batches((encoded(list(blocks)) for _, blocks in itertools.groupby(each_row, key=lambda r: r["logical_name"])), _PAYLOAD, lambda r: len(r["payload"] or b""))

    return rows.mapInArrow(run, spark_schema(_PAYLOAD))


def whole_model(entries: DataFrame, p: Profile = Profile()) -> DataFrame:
    """The model of an archive of the entries, stored. Blocks meet by name, so a repeated (or null) name is refused."""
    measured = stored(signals(entries, p))
    model = stored(archive_model(measured, p, shortcut=True))
    with shuffles_deleted(entries.sparkSession):
        repeated = measured.groupBy("logical_name").count().where("count > 1 or logical_name is null").take(1)
    if repeated:
        raise RepeatedName(f"{repeated[0]['logical_name']} names {repeated[0]['count']} entries")
    return model


def whole_models(entries: DataFrame, profiles: dict[str, Profile]) -> dict[str, DataFrame]:
    """whole_model() under each profile; the entries are measured once for profiles that measure alike."""
    found = {}
    keys = {name: (p.base_block, p.min_block, p.max_block, p.sample_cap) for name, p in profiles.items()}
    for name, p in profiles.items():
        if keys[name] not in found:
            found[keys[name]] = whole_model(entries, p)
    return {name: found[k] for name, k in keys.items()}


def encoded_entries(entries: DataFrame, p: Profile = Profile(), trace: bool = False, model: DataFrame | None = None) -> DataFrame:
    """encode_payloads()'s rows of those entries that are to be compressed. model: whole_model() of the archive, where the entries are a part of it."""
    model = whole_model(entries, p) if model is None else model
    decided = decide(signals(entries, p, keep_content=True), model, p)
    return encode_payloads(match_blocks(plan_blocks(decided, p), p, trace), p, trace)


def compress(entries: DataFrame, p: Profile = Profile(), trace: bool = False, model: DataFrame | None = None) -> DataFrame:
    """logical_name, uncompressed_size, method, crc32, compressed_size, stored_effective, payload, trace: one row for each entry. Blocks meet by name, so a repeated (or null) name is refused."""
    # sizes and checksums are taken before the join, so that contents meet payloads only for who reads payloads
    done = encoded_entries(entries, p, trace, model).withColumn("packed", F.octet_length("payload").cast("long"))
    whole = entries.select("logical_name", "uncompressed_size", F.crc32("content").alias("crc32"), "content").join(done, "logical_name", "left")
    method = F.coalesce("method", F.lit("Stored"))
    return whole.select("logical_name", "uncompressed_size", method.alias("method"), "crc32", F.coalesce("packed", "uncompressed_size").alias("compressed_size"), (method == "Stored").alias("stored_effective"), F.coalesce("payload", "content").alias("payload"), "trace")


#: Entries of so many bytes at most may be compressed by one task; and the bytes of entries that make a task.
WHOLE_ENTRY, TASK_BYTES = 4 << 20, 2 << 20


def compress_under(entries: DataFrame, profiles: dict[str, Profile], models: dict[str, DataFrame] | None = None, whole: int = WHOLE_ENTRY) -> DataFrame:
    """profile and compress()'s columns (but no trace) for each entry under each of several profiles. models: whole_models() of the archive, where the entries are a part of it.

    A task compresses entries of at most `whole` bytes under all profiles, and matches blocks once that profiles search alike: contents are dealt out once,
    and neither blocks with the bytes before them nor tokens are shuffled. Blocks of larger entries are dealt out as compress() does.
    """
    spark = entries.sparkSession
    models = whole_models(entries, profiles) if models is None else models
    rows = {name: model.first().asDict() for name, model in models.items()}
    runs = [(p, _model({f"m_{k}": v for k, v in rows[name].items()})) for name, p in profiles.items()]
    names, large = list(profiles), F.coalesce(F.col("uncompressed_size") > whole, F.lit(False))
    with shuffles_deleted(spark):
        size, larger = entries.agg(F.coalesce(F.sum(F.when(~large, F.col("uncompressed_size"))), F.lit(0)), F.count(F.when(large, 1))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES)

    def packed(waiting: list[tuple[str, bytes]]) -> Iterator[dict]:
        for (name, content), found in zip(waiting, compress_each([c for _, c in waiting], runs), strict=True):
            for profile, e in zip(names, found, strict=True):
                yield {"profile": profile, "logical_name": name, "uncompressed_size": len(content), "method": e.method, "crc32": e.crc32, "compressed_size": len(e.payload), "stored_effective": e.method == "Stored", "payload": e.payload}

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        waiting, held = [], 0
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                waiting.append((name.as_py(), content.as_py()))
                held += len(waiting[-1][1])
                if held >= TOGETHER:
                    yield from packed(waiting)
                    waiting, held = [], 0
        yield from packed(waiting)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_batches(compressed(batches), _PACKED, lambda r: len(r["payload"]))

    out = entries.where(~large).select("logical_name", "content").repartition(parts, "logical_name").mapInArrow(run, spark_schema(_PACKED))
    if larger:
        for name, p in profiles.items():
            out = out.unionByName(compress(entries.where(large), p, model=models[name]).select(F.lit(name).alias("profile"), *_PACKED.names[1:]))
    return out


def block_trace(entries: DataFrame, p: Profile = Profile()) -> DataFrame:
    """A row for each compressed block: sizes, tokens, matches, predicted and actual ratio."""
    return encoded_entries(entries, p, trace=True).select("logical_name", F.explode("trace").alias("t")).select("logical_name", "t.*")


# --- ZIP -------------------------------------------------------------------------

LOCAL, CENTRAL, END = struct.Struct("<IHHHHHIIIHH"), struct.Struct("<IHHHHHHIIIHHHHHII"), struct.Struct("<IHHHHIIH")
# Fixed values of the format.
LOCAL_SIGNATURE, CENTRAL_SIGNATURE, END_SIGNATURE = 0x04034B50, 0x02014B50, 0x06054B50
METHOD = {"Stored": 0, "Deflate": 8}
UTF8_NAMES, VERSION, MADE_BY = 0x800, 20, 0x0314
MOST = (1 << 32) - 1


class ZipWriter:
    """Writes local entries to a stream and the directory at the end; refuses what 32 bits can't hold."""

    def __init__(self, out):
        self.out, self.at, self.records = out, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, method: str, crc32: int, size: int, payload: bytes) -> None:
        raw = name.encode()
        if max(size, len(payload), self.at) > MOST or len(raw) > 0xFFFF or len(self.records) >= 0xFFFF:
            raise ZipStructure(f"{name}: sizes, offset, name or number of entries don't fit a ZIP archive")
        self.records.append((raw, METHOD[method], crc32, len(payload), size, self.at))
        self._put(LOCAL.pack(LOCAL_SIGNATURE, VERSION, UTF8_NAMES, METHOD[method], 0, 0, crc32, len(payload), size, len(raw), 0) + raw)
        self._put(payload)

    def finish(self) -> dict:
        begin = self.at
        for raw, method, crc32, packed, size, offset in self.records:
            self._put(CENTRAL.pack(CENTRAL_SIGNATURE, MADE_BY, VERSION, UTF8_NAMES, method, 0, 0, crc32, packed, size, len(raw), 0, 0, 0, 0, 0, offset) + raw)
        length = self.at - begin
        if begin > MOST:
            raise ZipStructure("the directory's offset doesn't fit a ZIP archive")
        n = len(self.records)
        self._put(END.pack(END_SIGNATURE, 0, 0, n, n, length, begin, 0))
        return {"central_directory_offset": begin, "central_directory_size": length, "total_entries": n, "archive_size": self.at}


#: Bytes of payloads and headers in one of several archives, so that a task can read it whole; and the most entries of a directory.
ARCHIVE_BYTES, ARCHIVE_ENTRIES = 32 << 20, 0xFFFF


def write_archives(packed: DataFrame, folder: str, layout: str = "lexical", archives: int | None = 1, bytes_each: int = ARCHIVE_BYTES, entries_each: int = ARCHIVE_ENTRIES, is_stored: bool = False) -> DataFrame:
    """Writes compress()'s rows as ZIP files in ranges of the layout; returns a row for each file.

    With archives=1 there is one file, refused if it doesn't fit the format. More are the least number of files, and with None one may do: a file is full
    at `entries_each` entries or `bytes_each` bytes (but holds one entry at least), and as many are written as the rows need. They are stored to be
    counted, unless they are read from a table already (is_stored).

    Each file is streamed by one task to a temporary name and then moved, so a lost task leaves nothing half written. A format with one directory
    at its end needs one writer; more archives are more writers.
    """
    order = layout_order(layout)
    parts = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = packed.select("logical_name", "method", "crc32", "uncompressed_size", "compressed_size", "payload")
    single, summary = archives == 1, new_path(packed.sparkSession, "table")

    def ranges() -> DataFrame:
        if single:
            # sorted by all tasks; the sorted partitions are then read in turn
            return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).coalesce(1)
        held = rows if is_stored else stored(rows)
        with shuffles_deleted(held.sparkSession):
            n, size = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("compressed_size"), F.lit(0))).first()
        return held.repartitionByRange(max(archives or 1, -(-n // entries_each), -(-size // bytes_each)), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, top = fs.FileSystem.from_uri(folder)
        system.create_dir(top, recursive=True)
        part, writer, out, temporary, files = TaskContext.get().partitionId(), None, None, "", 0

        def closed() -> pa.RecordBatch:
            summary = writer.finish()
            out.close()
            name = f"archive-{part:05d}{f'-{files:05d}' if files else ''}.zip"
            # an earlier attempt's file is the same; not every store lets a move replace it
            if system.get_file_info(to := f"{top}/{name}").type != fs.FileType.NotFound:
                system.delete_file(to)
            system.move(temporary, to)
            return record_batch([{"path": f"{folder}/{name}"} | summary], _SUMMARY)

        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if writer is not None and not single and (len(writer.records) >= entries_each or writer.at + len(r["payload"]) > bytes_each):
                    yield closed()
                    writer, files = None, files + 1
                if writer is None:
                    temporary = f"{top}/.{uuid.uuid4().hex}"
                    out = system.open_output_stream(temporary)
                    writer = ZipWriter(out)
                writer.add(r["logical_name"], r["method"], r["crc32"], r["uncompressed_size"], r["payload"])
        if writer is not None:
            yield closed()

    with scratch(packed.sparkSession):  # payloads are in the files
        return stored(ranges().mapInArrow(run, spark_schema(_SUMMARY)), summary)


def local_offsets(packed: DataFrame, layout: str = "lexical") -> DataFrame:
    """logical_name, entry_id, local_header_offset of each entry in a single archive: a running sum over names and sizes."""
    sized = packed.withColumn("_size", F.octet_length(F.encode("logical_name", "UTF-8")) + 30 + F.col("compressed_size"))
    return numbered(sized, layout, "_size").select("logical_name", "entry_id", F.col("before").alias("local_header_offset"))


def create_archive(entries: DataFrame, folder: str, p: Profile = Profile()) -> dict:
    """The whole run: compresses, writes, and verifies as the profile says. Returns a report of counts."""
    from bytegrain.errors import EmptyArchive, VerificationFailed
    from bytegrain.operators.verify import read_archives, verify_entries

    if entries.isEmpty():
        raise EmptyArchive(folder)
    packed = stored(compress(entries, p))
    totals = packed.agg(F.count(F.lit(1)).alias("entries"), F.sum("uncompressed_size").alias("uncompressed_bytes"), F.sum("compressed_size").alias("compressed_bytes")).first()
    summary = write_archives(packed, folder, p.layout).collect()
    report = totals.asDict() | summary[0].asDict()
    if p.verification != "Off":
        checked = verify_entries(read_archives(entries.sparkSession, folder), strict=p.verification == "Strict")
        bad = checked.where("not ok").select("name", "error").take(1)
        if bad:
            raise VerificationFailed(bad[0]["error"], bad[0]["name"])
        report |= checked.agg(F.count(F.lit(1)).alias("entries_verified"), F.sum("uncompressed_size").alias("inflated_bytes")).first().asDict()
    return report


def method_column(p: Profile):
    """The label an explained entry gets."""
    return S.method_label(F.col("predicted_stored"), F.col("predicted_deflate_path"))
