"""The commands: create, bench, explain, analyze, debug, compare, validate, harness.

    python -m bytegrain.api create  DIR OUT  [--level N --stored --layout L --prediction P --planning G --verify V --global-huffman --adaptive]
    python -m bytegrain.api bench   DIR OUT  [--level N --prediction P --planning G --verify V]
    python -m bytegrain.api analyze DIR
    python -m bytegrain.api explain DIR [--no-run]
    python -m bytegrain.api debug   DIR
    python -m bytegrain.api compare DIR
    python -m bytegrain.api validate OUT [--strict]
    python -m bytegrain.api harness OUT [--large]
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytegrain.config import LAYOUTS, MODES, PLANNING, VERIFICATION, Profile
from bytegrain.operators import harness
from bytegrain.operators.archive import block_trace, compress, create_archive
from bytegrain.operators.deflate import stock_deflate
from bytegrain.operators.explain import as_json, explain
from bytegrain.operators.intel import intel, intel_summary
from bytegrain.operators.stored import stored
from bytegrain.operators.verify import read_archives, verification_summary, verify_entries
from bytegrain.sources import corpus
from bytegrain.sources.entries import from_tree


def create(spark: SparkSession, root: str, out: str, p: Profile = Profile()) -> dict:
    """Compresses a directory into a ZIP below the folder `out` (a URI) and returns the run's report."""
    t = time.perf_counter()
    report = create_archive(from_tree(spark, root), out, p)
    return report | {"elapsed_ms": int((time.perf_counter() - t) * 1000)}


def bench(spark: SparkSession, root: str, out: str, p: Profile = Profile()) -> str:
    """A timed create in one line: bytes before and after, cores and milliseconds."""
    report = create(spark, root, out, p)
    return f"raw={report['uncompressed_bytes']} compressed={report['compressed_bytes']} cores={spark.sparkContext.defaultParallelism} ms={report['elapsed_ms']}"


def analyze(spark: SparkSession, root: str, p: Profile = Profile()) -> tuple[DataFrame, DataFrame]:
    """Summary row and file rows."""
    rows = intel(from_tree(spark, root), p)
    return intel_summary(rows), rows


def compare(spark: SparkSession, root: str, p: Profile = Profile()) -> dict:
    """The engine against the stock codec over the files joined in name order; equal figures are a tie."""
    from bytegrain.operators.layout import layout_order

    entries = from_tree(spark, root)
    t = time.perf_counter()
    done = compress(entries, p.but(verification="Off")).agg(F.sum("uncompressed_size"), F.sum("compressed_size")).first()
    engine_ms, raw = max(1, int((time.perf_counter() - t) * 1000)), done[0]
    # the stock codec makes one stream of the whole directory, so it runs where one process can hold it
    flat = b"".join(bytes(r["content"]) for r in entries.orderBy(*layout_order("lexical")).select("content").toLocalIterator())
    t = time.perf_counter()
    stock = len(stock_deflate(flat, p.level))
    stock_ms = max(1, int((time.perf_counter() - t) * 1000))
    engine_rate, stock_rate = raw / (1 << 20) / (engine_ms / 1000), raw / (1 << 20) / (stock_ms / 1000)

    def winner(a: float, b: float, what: str) -> str:
        return f"engine_{what}" if a < b else f"stock_{what}" if a > b else f"tie_{what}"

    return {"kind": "compare", "raw_bytes": raw, "engine_ms": engine_ms, "engine_mib_s": round(engine_rate, 3), "engine_ratio": round(done[1] / raw, 5), "stock_ms": stock_ms, "stock_mib_s": round(stock_rate, 3), "stock_ratio": round(stock / raw, 5), "ratio_winner": winner(done[1], stock, "ratio"), "speed_winner": winner(-engine_rate, -stock_rate, "speed")}


def validate(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Summary row and entry rows of the archives under a path."""
    rows = verify_entries(read_archives(spark, path), strict)
    return verification_summary(rows), rows


def run_harness(spark: SparkSession, out: str, large: bool = False, level: int = 6) -> DataFrame:
    """Generates the corpus below the local folder `out`, runs all workloads in all modes, and writes reports."""
    manifest = corpus.generate(os.path.join(out, "corpus"), large)
    corpus.write_manifest(os.path.join(out, "manifest.json"), manifest)
    workloads = {os.path.basename(d): stored(from_tree(spark, d)) for d in corpus.workload_dirs(os.path.join(out, "corpus"))}
    runs = harness.run_matrix(workloads)
    rows = None
    for name, entries in workloads.items():
        own = entries.select(F.lit(name).alias("workload_id"), "logical_name", "content")
        rows = own if rows is None else rows.union(own)
    compared = stored(harness.winners(harness.best_of_modes(runs), harness.stock_baselines(rows, level)))
    harness.stock_blobs(rows, level).write.mode("overwrite").parquet(f"file://{os.path.abspath(out)}/baselines")
    harness.write_reports(f"file://{os.path.abspath(out)}/reports", compared, harness.summary(runs))
    return compared


def profile_of(a: argparse.Namespace) -> Profile:
    return Profile(method="Stored" if a.stored else "Deflate", level=a.level, layout=a.layout, mode=a.prediction, planning=a.planning, verification=a.verify, global_huffman=a.global_huffman, adaptive=a.adaptive)


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="bytegrain", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    top.add_argument("command", choices=["create", "bench", "analyze", "explain", "debug", "compare", "validate", "harness"])
    top.add_argument("path")
    top.add_argument("out", nargs="?")
    top.add_argument("--level", type=int, default=6)
    top.add_argument("--layout", choices=LAYOUTS, default="lexical")
    top.add_argument("--prediction", choices=MODES, default="Standard")
    top.add_argument("--planning", choices=PLANNING, default="Balanced")
    top.add_argument("--verify", choices=VERIFICATION, default="AfterWrite")
    for flag in ("stored", "global-huffman", "adaptive", "no-run", "strict", "large"):
        top.add_argument(f"--{flag}", action="store_true")
    a = top.parse_args(argv)
    spark = SparkSession.builder.appName("bytegrain").getOrCreate()
    p = profile_of(a)

    def show(df: DataFrame) -> None:
        for r in as_json(df).toLocalIterator():
            print(r["value"])

    if a.command == "create":
        print(json.dumps(create(spark, a.path, f"file://{os.path.abspath(a.out)}", p)))
    elif a.command == "bench":
        print(bench(spark, a.path, f"file://{os.path.abspath(a.out)}", p))
    elif a.command in ("analyze", "explain"):
        for df in analyze(spark, a.path, p) if a.command == "analyze" else explain(from_tree(spark, a.path), p, not a.no_run):
            show(df)
    elif a.command == "debug":
        show(block_trace(from_tree(spark, a.path), p.but(adaptive=True)))
    elif a.command == "compare":
        print(json.dumps(compare(spark, a.path, p)))
    elif a.command == "validate":
        summary, rows = validate(spark, f"file://{os.path.abspath(a.path)}", a.strict)
        show(rows)
        show(summary)
        return int(summary.first()["failures"] > 0)
    else:
        show(run_harness(spark, a.path, a.large, a.level))
    return 0


if __name__ == "__main__":
    sys.exit(main())
