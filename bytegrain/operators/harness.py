"""The comparison matrix: workloads by modes, stock codecs beside them, and winners."""

from __future__ import annotations

import hashlib
import itertools
import time
import zlib
from collections.abc import Iterator
from zipfile import ZIP64_LIMIT, ZIP_FILECOUNT_LIMIT

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytegrain.config import MODE_TABLE, Profile
from bytegrain.operators.archive import CENTRAL, END, compress, record_batch
from bytegrain.operators.deflate import inflate, stock_deflate
from bytegrain.operators.stored import stored
from bytegrain.operators.verify import stock_zip

CANDIDATES = ("engine", "stock", "stock_fast", "stock_zip")


def modes(spark: SparkSession) -> DataFrame:
    """The mode table: a fixed number of rows."""
    rows = [(i, n, p.mode, p.verification, p.adaptive, p.global_huffman, p.planning) for i, (n, p) in enumerate(MODE_TABLE)]
    return spark.createDataFrame(rows, "ordinal int, mode_id string, prediction string, verification string, adaptive boolean, global_huffman boolean, planning string")


class _Stream:
    """A stock codec's raw stream of texts that come one by one: its length and milliseconds, decoded again and compared."""

    def __init__(self, level: int) -> None:
        self.packer, self.reader, self.bytes, self.seconds = zlib.compressobj(level, zlib.DEFLATED, -15), zlib.decompressobj(-15), 0, 0.0
        self.given, self.got = hashlib.sha256(), hashlib.sha256()

    def _took(self, out: bytes, begin: float) -> None:
        self.seconds += time.perf_counter() - begin
        self.bytes += len(out)
        self.got.update(self.reader.decompress(out))

    def add(self, data: bytes) -> None:
        self.given.update(data)
        t = time.perf_counter()
        self._took(self.packer.compress(data), t)

    def finish(self) -> None:
        t = time.perf_counter()
        self._took(self.packer.flush(), t)
        self.got.update(self.reader.flush())
        assert self.reader.eof and self.got.digest() == self.given.digest()


class _StockZip:
    """Size and milliseconds of the stock ZIP of files that come one by one, as verify.stock_zip() writes them."""

    def __init__(self, level: int) -> None:
        self.level, self.at, self.directory, self.files, self.seconds = level, 0, 0, 0, 0.0

    def add(self, name: str, content: bytes) -> None:
        t = time.perf_counter()
        file = stock_zip({name: content}, self.level)
        central = CENTRAL.size + len(name.encode())
        self.directory += central + (12 if self.at > ZIP64_LIMIT else 0)  # an offset of 64 bits
        self.at += len(file) - central - END.size
        self.files += 1
        self.seconds += time.perf_counter() - t

    @property
    def bytes(self) -> int:
        wide = self.files > ZIP_FILECOUNT_LIMIT or self.at > ZIP64_LIMIT or self.directory > ZIP64_LIMIT
        return self.at + self.directory + END.size + (76 if wide else 0)  # a wide end record and its locator


def stock_baselines(entries: DataFrame, level: int = 6) -> DataFrame:
    """workload_id, raw_bytes and sizes and milliseconds of the stock codecs over each workload's files joined in name order. entries: with workload_id.

    A workload's files are streamed in order through the codecs, so no task holds more than a batch of them. Of files of one name the last counts.
    """
    ddl = "workload_id string, raw_bytes long, stock_bytes long, stock_ms double, fast_bytes long, fast_ms double, zip_bytes long, zip_ms double"
    schema = pa.schema([("workload_id", pa.string()), ("raw_bytes", pa.int64()), *((f"{n}_{k}", t) for n in ("stock", "fast", "zip") for k, t in (("bytes", pa.int64()), ("ms", pa.float64())))])
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def measured(files: Iterator[tuple[str | None, str, bytes]]) -> pa.RecordBatch:
        size, named = 0, {"stock": _Stream(level), "fast": _Stream(1), "zip": _StockZip(level)}
        for _, some in itertools.groupby(files, key=lambda f: f[1]):
            for workload, name, content in some:
                pass
            size += len(content)
            named["stock"].add(content)
            named["fast"].add(content)
            named["zip"].add(name, content)
        named["stock"].finish()
        named["fast"].finish()
        row = {"workload_id": workload, "raw_bytes": size}
        for n, codec in named.items():
            row |= {f"{n}_bytes": codec.bytes, f"{n}_ms": float(max(1, int(codec.seconds * 1000)))}
        return record_batch([row], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(c[i].as_py() for c in batch.columns) for batch in batches for i in range(batch.num_rows))
        for _, files in itertools.groupby(rows, key=lambda f: f[0]):
            yield measured(files)

    rows = entries.select("workload_id", "logical_name", "content").repartition(parts, "workload_id").sortWithinPartitions("workload_id", "logical_name", "content")
    return rows.mapInArrow(run, ddl)


def stock_blobs(entries: DataFrame, level: int = 6) -> DataFrame:
    """workload_id, blob: the stock codec's stream of each workload's joined files, to be kept beside the reports."""
    def run(table: pa.Table) -> pa.Table:
        files = dict(sorted(zip(table.column("logical_name").to_pylist(), table.column("content").to_pylist(), strict=True)))
        return pa.Table.from_pylist([{"workload_id": table.column("workload_id")[0].as_py(), "blob": stock_deflate(b"".join(files.values()), level)}])

    return entries.select("workload_id", "logical_name", "content").groupBy("workload_id").applyInArrow(run, "workload_id string, blob binary")


def _rate(ms: str):
    return F.col("raw_bytes") / (1 << 20) / (F.greatest(ms, F.lit(1.0)) / 1000)


def best_of_modes(runs: DataFrame) -> DataFrame:
    """runs: workload_id, mode_id, raw_bytes, compressed_bytes, ms -> smallest ratio and greatest rate of each workload."""
    return runs.groupBy("workload_id").agg(F.min(F.col("compressed_bytes") / F.col("raw_bytes")).alias("engine_ratio"), F.max(_rate("ms")).alias("engine_mib_s"))


def winners(best: DataFrame, baselines: DataFrame) -> DataFrame:
    """Each workload's ratio winner (the first of equals) and speed winner (the last of equals)."""
    both = best.join(baselines, "workload_id")
    ratios = [F.col("engine_ratio"), *(F.col(f"{n}_bytes") / F.col("raw_bytes") for n in ("stock", "fast", "zip"))]
    rates = [F.col("engine_mib_s"), *(_rate(f"{n}_ms") for n in ("stock", "fast", "zip"))]
    low = F.array_min(F.array(*(F.struct(r.alias("v"), F.lit(i).alias("i")) for i, r in enumerate(ratios))))["i"]
    high = F.array_max(F.array(*(F.struct(r.alias("v"), F.lit(i).alias("i")) for i, r in enumerate(rates))))["i"]
    names = F.array(*map(F.lit, CANDIDATES))
    return both.select("workload_id", "engine_ratio", *(r.alias(f"{n}_ratio") for n, r in zip(CANDIDATES[1:], ratios[1:], strict=True)), F.get(names, low).alias("ratio_winner"), "engine_mib_s", rates[1].alias("stock_mib_s"), F.get(names, high).alias("speed_winner"))


def summary(runs: DataFrame) -> DataFrame:
    """One row over all runs: archives, mean ratio, best ratio and best rate with their workloads."""
    ratio = F.col("compressed_bytes") / F.col("raw_bytes")
    return runs.agg(F.count(F.lit(1)).alias("archives_built"), F.countDistinct("workload_id").alias("workloads"), F.countDistinct("mode_id").alias("modes_tested"), F.avg(F.col("verified").cast("double")).alias("verification_pass_rate"), F.avg(ratio).alias("average_ratio"), F.min(ratio).alias("best_ratio"), F.min_by("workload_id", F.struct(ratio, "workload_id")).alias("best_ratio_workload"), F.max(_rate("ms")).alias("best_mib_s"), F.max_by("workload_id", F.struct(_rate("ms"), "workload_id")).alias("best_mib_s_workload"))


def verified_payloads(packed: DataFrame, entries: DataFrame) -> DataFrame:
    """logical_name, verified: payloads decoded again and compared with the content."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, method, payload, content = (c.to_pylist() for c in batch.columns)
            ok = [(p if m == "Stored" else inflate(p, len(c))) == c for m, p, c in zip(method, payload, content, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(ok)], names=["logical_name", "verified"])

    return packed.select("logical_name", "method", "payload").join(entries.select("logical_name", "content"), "logical_name").mapInArrow(run, "logical_name string, verified boolean")


def run_matrix(workloads: dict[str, DataFrame], table: list[tuple[str, Profile]] = MODE_TABLE) -> DataFrame:
    """workload_id, mode_id, raw_bytes, compressed_bytes, ms, verified for each pair. The loop is over a fixed list of workloads and modes; each step is a Spark job."""
    out = None
    for workload, entries in sorted(workloads.items()):
        for mode, p in table:
            t = time.perf_counter()
            packed = stored(compress(entries, p))
            ms = max(1, int((time.perf_counter() - t) * 1000))
            ok = verified_payloads(packed, entries).agg(F.min("verified").alias("verified"))
            row = packed.agg(F.sum("uncompressed_size").alias("raw_bytes"), F.sum("compressed_size").alias("compressed_bytes")).crossJoin(ok)
            row = row.select(F.lit(workload).alias("workload_id"), F.lit(mode).alias("mode_id"), "raw_bytes", "compressed_bytes", F.lit(float(ms)).alias("ms"), "verified")
            out = row if out is None else out.unionByName(row)
    return stored(out)


def write_reports(folder: str, compared: DataFrame, totals: DataFrame) -> None:
    """The comparison table as TSV and the summary as text, from a row for each workload."""
    columns = compared.columns
    texts = [F.format_string("%.6f" if c.endswith("ratio") else "%.3f", c).alias(c) if c.endswith(("ratio", "mib_s")) else F.col(c) for c in columns]
    compared.select(*texts).orderBy("workload_id").coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{folder}/comparison_table")
    totals.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, totals.columns)), F.array(*(F.col(c).cast("string") for c in totals.columns)))).alias("k", "v")).select(F.concat_ws(": ", "k", "v").alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder}/summary")
    compared.write.mode("overwrite").json(f"{folder}/comparisons")
