"""The registered queries of the engine, each over whole tables, and the same in SQL.

Measures are checked against SQL that unfolds every byte; floats are rounded to nine
places on both sides, since sums are taken in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bytegrain.config import MODE_TABLE, MODES, PLANNING, Profile
from bytegrain.functions import sql as S
from bytegrain.operators import harness
from bytegrain.operators.archive import block_trace, compress, compress_under, local_offsets, plan_blocks, whole_models, write_archives
from bytegrain.operators.explain import as_json, explain, explain_files
from bytegrain.operators.intel import archive_model, decide, intel, intel_summary, pattern_counts, prior_matches, signals
from bytegrain.operators.layout import numbered
from bytegrain.operators.stored import new_path, scratch, shuffles_deleted, stored
from bytegrain.operators.verify import read_archives, round_trip, verification_summary, verify_entries
from bytegrain.sources.entries import from_table

#: table: key columns and payload.
PAYLOADS = {"documents": (["doc_id"], "text"), "pages": (["page_id"], "html"), "events": (["event_id"], "props"), "conversations": (["conv_id", "turn"], "text"), "benchmark": (["item_id"], "text")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return from_table(table(spark, sf_dir, name), *PAYLOADS[name])


def _nine(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _intel_of(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _nine(intel(entries(spark, sf_dir, name)))


def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every byte value over all documents: 256 rows from each task are summed."""
    counts = pattern_counts(entries(spark, sf_dir), None)
    return counts.groupBy("byte").agg(F.sum("n").alias("n")).select("byte", "n", S.byte_class(F.col("byte")).alias("byte_class"))


def byte_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nine(signals(entries(spark, sf_dir)).select("logical_name", "uncompressed_size", "entropy_bits", "repeat_density", "bigram_proxy", "zero", "ascii_text", "high_entropy"))


def archive_model_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_model(signals(entries(spark, sf_dir))).select("entry_count", "total_uncompressed", "mean_entry_bytes", "zero", "text_mass", "high_entropy", F.col("suggested_block_bytes"), F.col("lz77_max_chain").cast("long").alias("lz77_max_chain"), F.col("lz77_nice_match").cast("long").alias("lz77_nice_match"), F.col("index_stride").cast("long").alias("index_stride"), "use_index")


def decisions_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under every prediction mode and planning; signals are measured once."""
    measured = stored(signals(entries(spark, sf_dir)))
    out = None
    for mode in MODES:
        for planning in PLANNING:
            p = Profile(mode=mode, planning=planning)
            rows = decide(measured, archive_model(measured, p), p).select("logical_name", F.lit(mode).alias("mode"), F.lit(planning).alias("planning"), "predicted_stored", "predicted_deflate_path", "target_block_bytes", "lz77_chain_mult", "use_global_huffman")
            out = rows if out is None else out.unionByName(rows)
    return _nine(out)


def summary_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intel_summary(intel(entries(spark, sf_dir))).select("entry_count", "total_raw_bytes", F.round("global_entropy_bits", 6).alias("global_entropy_bits"), F.round("predicted_ratio", 6).alias("predicted_ratio"), "duplicate_cluster_score")


def manifest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select(F.col("logical_name").alias("path"), F.col("uncompressed_size").alias("bytes"), F.sha2("content", 256).alias("sha256_hex"))


def _layout(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: numbered(entries(spark, sf_dir).drop("content"), name)


def top_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 32 most frequent (position, byte) pairs: a top-k report, ties by position and byte."""
    pairs = pattern_counts(entries(spark, sf_dir), Profile().sample_cap).groupBy("pos", "byte").agg(F.sum("n").alias("n"))
    return pairs.orderBy(F.desc("n"), "pos", "byte").limit(32)


def fixed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts without looking at the content, 4096 bytes apart."""
    size, n = F.col("uncompressed_size"), 4096
    starts = F.when(size > 0, F.sequence(F.lit(0).cast("long"), size - 1, F.lit(n).cast("long"))).otherwise(F.array().cast("array<long>"))
    return entries(spark, sf_dir).select("logical_name", "uncompressed_size", F.posexplode(starts).alias("block_id", "offset")).select("logical_name", F.col("block_id").cast("long").alias("block_id"), "offset", F.least(F.lit(n).cast("long"), size - F.col("offset")).alias("length"))


def nearest_prior_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the buckets of its 3-byte strings, and how many positions have an earlier one of their bucket in reach, nearest first."""
    return prior_matches(entries(spark, sf_dir)).where("positions > 0")


def header_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document's local header lies in an archive of stored entries."""
    return local_offsets(entries(spark, sf_dir).drop("content").withColumn("compressed_size", F.col("uncompressed_size")))


def block_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of block rows, on counts taken from lineitem: dominance and fallback for each order line."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"), F.col("l_suppkey").alias("s"), "l_discount", "l_tax", "l_extendedprice")
    return li.select("l_orderkey", "l_linenumber", S.match_dominance(F.col("q"), F.pmod("s", F.lit(50))).alias("match_dominance"), S.block_fallback(F.pmod("s", F.lit(7)).cast("int") * 0, F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_extendedprice").cast("long")).alias("fallback_reason"))


def best_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winners as the comparison report picks them: for each order the first cheapest and the last dearest line."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return li.groupBy("l_orderkey").agg(F.min_by("l_linenumber", F.struct("l_extendedprice", "l_linenumber")).cast("long").alias("ratio_winner"), F.max_by("l_linenumber", F.struct("l_extendedprice", "l_linenumber")).cast("long").alias("speed_winner"), F.min("l_extendedprice").alias("best_ratio"), F.max("l_extendedprice").alias("best_rate"))


def explain_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = explain_files(intel(entries(spark, sf_dir)))
    return _nine(files.select("name", "size", "entropy", "predicted", "predicted_ratio", "actual", "actual_ratio", F.size("blocks").cast("long").alias("blocks")))


def explain_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The explained benchmark items after a run, as JSON rows."""
    return as_json(explain(entries(spark, sf_dir, "benchmark"))[1])


def crc32_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select("logical_name", F.crc32("content").alias("crc32"))


def compressed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(entries(spark, sf_dir)).select("logical_name", "method", "crc32", "uncompressed_size", "compressed_size")


def trace_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_trace(entries(spark, sf_dir), Profile(adaptive=True))


def adaptive_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document is cut, with its content looked at."""
    p = Profile(mode="Off")
    whole = signals(entries(spark, sf_dir), p, keep_content=True)
    decided = decide(whole, archive_model(whole.drop("content"), p), p)
    return plan_blocks(decided, p).select("logical_name", "block_id", "offset", "length", "blocks")


def archive_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items compressed, written, read back and compared: every row must match."""
    source = entries(spark, sf_dir, "benchmark")
    folder = new_path(spark, "archives")
    write_archives(compress(source), folder, archives=None)
    return round_trip(source, verify_entries(read_archives(spark, folder), strict=True, keep_content=True))


def verify_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in four archives of deflated entries (more, where four can't hold them), verified strictly."""
    folder = new_path(spark, "archives")
    write_archives(compress(entries(spark, sf_dir)), folder, archives=4)
    return verification_summary(verify_entries(read_archives(spark, folder), strict=True))


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of many blocks: the documents of 64 ids in a row, joined by line feeds."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.floor(F.col("doc_id") / 64).cast("string").alias("bundle"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return from_table(docs.groupBy("bundle").agg(F.array_join(F.array_sort(F.collect_list(F.struct("doc_id", "text")))["text"], "\n").alias("text")), "bundle", "text")


BUNDLE_PROFILES = {"default": Profile(), "adaptive": Profile(adaptive=True), "global_huffman": Profile(global_huffman=True), "both": Profile(adaptive=True, global_huffman=True), "fixed": Profile(strategy="Fixed", mode="Off"), "safe": Profile(planning="Safe", mode="Aggressive")}


#: The most rounds that bundles go round in, and the bytes of bundles that are worth one. In eight, a round needs less of the disk than making the bundles does.
ROUNDS, ROUND_BYTES = 8, 128 << 20


def bundles_round_trip(spark: SparkSession, sf_dir: str, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """Bundles compressed under each profile, written, read back, checked strictly and hashed.

    That is done in rounds, each with the bundles of a share of the names' hashes. What a round needs goes when its rows are stored, so that beside the
    bundles and the rows the disk holds a round's payloads and one profile's archives.
    """
    rows_at = new_path(spark, "table")
    with scratch(spark):
        source = stored(bundles(spark, sf_dir))
        models = whole_models(source, BUNDLE_PROFILES)
        with shuffles_deleted(spark):
            size = source.agg(F.coalesce(F.sum("uncompressed_size"), F.lit(0))).first()[0]
        rounds = min(ROUNDS, max(1, -(-size // round_bytes)))
        for i in range(rounds):
            with scratch(spark):
                packed = stored(compress_under(source.where(F.pmod(F.xxhash64("logical_name"), F.lit(rounds)) == i), BUNDLE_PROFILES, models))
                for name in BUNDLE_PROFILES:
                    with scratch(spark):
                        folder = new_path(spark, "archives")
                        write_archives(packed.where(F.col("profile") == name), folder, archives=2, is_stored=True)
                        read = verify_entries(read_archives(spark, folder), strict=True, keep_content=True)
                        rows = read.select(F.lit(name).alias("profile"), F.col("name").alias("logical_name"), "ok", "uncompressed_size", (F.col("compressed_size") < F.col("uncompressed_size")).alias("smaller"), F.sha2("content", 256).alias("sha256"))
                        stored(rows, f"{rows_at}/{i}-{name}")
    return spark.read.schema(rows.schema).parquet(*(f"{rows_at}/{i}-{name}" for i in range(rounds) for name in BUNDLE_PROFILES))


def bundle_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles cut with their content looked at: blocks must lie one after another and cover the bundle."""
    p = Profile(mode="Off")
    whole = signals(bundles(spark, sf_dir), p, keep_content=True)
    blocks = plan_blocks(decide(whole, archive_model(whole.drop("content"), p), p), p)
    w = Window.partitionBy("logical_name").orderBy("block_id")  # a bundle's few blocks
    placed = blocks.select("logical_name", "offset", "length", "blocks", (F.col("offset") - F.coalesce(F.lag(F.col("offset") + F.col("length")).over(w), F.lit(0))).alias("gap"), (F.col("length") > p.max_block).alias("over"))
    return placed.groupBy("logical_name").agg(F.sum("length").alias("covered"), F.sum(F.abs("gap")).alias("gaps"), F.count(F.when(F.col("over"), 1)).alias("oversized"), F.bool_and(F.col("blocks") > 1).alias("several"))


def bundle_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run told of bundles' blocks: their bytes add up, and no block has more tokens than bytes."""
    t = block_trace(stored(bundles(spark, sf_dir)), Profile(adaptive=True))
    return t.groupBy("logical_name").agg(F.sum("raw_bytes").alias("raw_bytes"), F.count(F.when(F.col("token_count") > F.col("raw_bytes"), 1)).alias("too_many_tokens"), F.count(F.when(F.abs(F.col("actual_ratio") * F.col("raw_bytes") - F.col("compressed_bytes")) > 1e-6, 1)).alias("wrong_ratios"))


def explain_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The explanation of bundles after a run: the actual side beside the predicted one."""
    files = explain(stored(bundles(spark, sf_dir)))[1]
    length = F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + b["length"])
    return files.select("name", "size", F.round("predicted_ratio", 9).alias("predicted_ratio"), "actual", ((F.col("actual_ratio") > 0) & (F.col("actual_ratio") < 1)).alias("smaller"), length.alias("explained_bytes"))


def harness_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison report over figures taken from order lines: orders are workloads, lines modes, and the order's own figures the stock codecs'."""
    li = table(spark, sf_dir, "lineitem")
    runs = li.select(F.col("l_orderkey").cast("string").alias("workload_id"), F.col("l_linenumber").cast("string").alias("mode_id"), F.lit(1 << 20).cast("long").alias("raw_bytes"), F.pmod(F.col("l_partkey") * 7919, F.lit(1 << 20)).cast("long").alias("compressed_bytes"), (F.col("l_suppkey") + 1).cast("double").alias("ms"))
    best = harness.best_of_modes(runs)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("workload_id"), F.lit(1 << 20).cast("long").alias("raw_bytes"), *(c for i, n in enumerate(("stock", "fast", "zip")) for c in (F.pmod(F.col("o_custkey") * (7919 + i), F.lit(1 << 20)).cast("long").alias(f"{n}_bytes"), F.pmod(F.col("o_custkey"), F.lit(17 + i)).cast("double").alias(f"{n}_ms"))))
    return _nine(harness.winners(best, orders))


def mode_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harness.modes(spark)


def stock_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock codec sizes by source of documents (times vary, so they are left out)."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("workload_id"), F.col("doc_id").cast("string").alias("logical_name"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return harness.stock_baselines(docs).select("workload_id", "raw_bytes", "stock_bytes", "fast_bytes", "zip_bytes")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "intel_documents": _intel_of("documents"),
    "intel_pages": _intel_of("pages"),
    "intel_conversations": _intel_of("conversations"),
    "intel_benchmark": _intel_of("benchmark"),
    "intel_events": _intel_of("events"),
    "intel_summary": summary_documents,
    "byte_histogram": byte_histogram,
    "byte_signals": byte_signals,
    "archive_model": archive_model_documents,
    "decisions": decisions_all,
    "manifest_sha256": manifest_documents,
    "layout_lexical": _layout("lexical"),
    "layout_size_desc": _layout("size_desc"),
    "top_patterns": top_patterns,
    "fixed_blocks": fixed_blocks,
    "nearest_prior_match": nearest_prior_match,
    "local_header_offsets": header_offsets,
    "block_outcomes": block_outcomes,
    "best_by_group": best_by_group,
    "explain_predicted": explain_predicted,
    "explain_json": explain_json,
    "crc32_documents": crc32_documents,
    "compress_documents": compressed_documents,
    "adaptive_blocks": adaptive_blocks,
    "block_trace": trace_documents,
    "archive_round_trip": archive_round_trip,
    "verify_summary": verify_summary,
    "mode_table": mode_table,
    "stock_codecs": stock_codecs,
    "bundles_round_trip": bundles_round_trip,
    "bundle_blocks": bundle_blocks,
    "bundle_trace": bundle_trace,
    "explain_run": explain_run,
    "harness_winners": harness_winners,
}


# --- SQL ---------------------------------------------------------------------------


def _payload_sql(name: str) -> str:
    keys, payload = PAYLOADS[name]
    return f"SELECT {' || chr(47) || '.join(f'CAST({k} AS VARCHAR)' for k in keys)} AS logical_name, hex(encode(coalesce({payload}, ''))) AS h FROM {name}"


def _signals_sql(name: str, payload: str | None = None) -> str:
    """CTEs: e (entries), s (signals)."""
    return f"""
e AS (SELECT logical_name, h, CAST(length(h) // 2 AS BIGINT) AS n FROM ({payload or _payload_sql(name)})),
b AS (SELECT logical_name, n, i, CAST('0x' || y AS INTEGER) AS x FROM (SELECT logical_name, n, unnest(range(n)) AS i, unnest(regexp_extract_all(h, '..')) AS y FROM e)),
l AS (SELECT *, lag(x) OVER w AS p, lag(x, 2) OVER w AS p2, lag(x, 3) OVER w AS p3 FROM b WINDOW w AS (PARTITION BY logical_name ORDER BY i)),
f AS (SELECT logical_name, x, count(*) AS c FROM b WHERE i < 262144 GROUP BY ALL),
t AS (SELECT logical_name, sum(c) AS c FROM f GROUP BY ALL),
hs AS (SELECT f.logical_name, -sum(f.c / t.c * log2(f.c / t.c)) AS ent FROM f JOIN t USING (logical_name) GROUP BY ALL),
r AS (SELECT logical_name, count(*) FILTER (i < 262144 AND x = p) AS r, count(*) FILTER (i < 131072 AND i >= 3 AND x = p2 AND p = p3) AS g,
        count(*) FILTER (i < 262144 AND x = 0) AS zero, count(*) FILTER (i < 262144 AND (x BETWEEN 33 AND 126 OR x IN (9, 10, 13))) AS txt, count(*) FILTER (i < 262144) AS capped FROM l GROUP BY ALL),
s AS (SELECT logical_name, n AS uncompressed_size, CASE WHEN n >= 16 THEN abs(coalesce(ent, 0)) ELSE 0.0 END AS entropy_bits,
        CASE WHEN n >= 2 THEN r / (least(n, 262144) - 1) ELSE 0.0 END AS repeat_density, CASE WHEN n >= 4 THEN g / (least(n, 131072) - 3) ELSE 0.0 END AS bigram_proxy,
        coalesce(zero, 0) AS zero, coalesce(txt, 0) AS ascii_text, coalesce(capped - zero - txt, 0) AS high_entropy
      FROM e LEFT JOIN hs USING (logical_name) LEFT JOIN r USING (logical_name))"""


_MODEL_SQL = """
m0 AS (SELECT count(*) AS entry_count, CAST(coalesce(sum(uncompressed_size), 0) AS BIGINT) AS total_uncompressed, CAST(coalesce(sum(zero), 0) AS BIGINT) AS zero, CAST(coalesce(sum(ascii_text), 0) AS BIGINT) AS text_mass, CAST(coalesce(sum(high_entropy), 0) AS BIGINT) AS high_entropy FROM s),
m AS (SELECT *, CASE WHEN entry_count = 0 THEN 0 ELSE total_uncompressed // entry_count END AS mean_entry_bytes FROM m0),
model AS (SELECT *, CAST(greatest(least(least(CASE WHEN mean_entry_bytes < 262144 THEN 65536 WHEN text_mass > 0 THEN 524288 ELSE 262144 END, 1048576), greatest(4194304 // greatest(entry_count, 1), 32768)), 32768) AS BIGINT) AS suggested_block_bytes,
            CAST(64 AS BIGINT) AS lz77_max_chain, CAST(CASE WHEN mean_entry_bytes > 1048576 THEN 128 ELSE 64 END AS BIGINT) AS lz77_nice_match, CAST(2 AS BIGINT) AS index_stride, entry_count <= 4 AS use_index FROM m)"""


def _decide_sql(mode: str, planning: str) -> dict[str, str]:
    """SQL of the decisions over s.* and the model's columns."""
    strength = "greatest(repeat_density * 2.4 + bigram_proxy * 1.6 + (8.0 - least(greatest(entropy_bits, 0.0), 8.0)) * 0.35, 0.0)"
    thr = {"Safe": 1.85, "Balanced": 1.35, "Aggressive": 0.95}[planning]
    lift, bias = {"Aggressive": 0.35, "Standard": 0.2, "Off": 0.0}[mode], {"Safe": 1.15, "Balanced": 1.0, "Aggressive": 0.85}[planning]
    gain = f"({strength}) / greatest(entropy_bits + 0.25, 0.25)"
    stored_ = "false" if mode == "Off" else f"uncompressed_size < 150 OR (uncompressed_size < 2048 AND entropy_bits > 7.2 AND {gain} < {thr} * 0.6) OR ({gain} < {thr} AND entropy_bits > 6.0)"
    path = "'Auto'" if mode == "Off" else f"CASE WHEN ({strength} + {lift}) * {bias} > 2.8 - entropy_bits * 0.12 THEN 'Dynamic' WHEN entropy_bits < 4.5 AND {strength} + {lift} > 1.1 THEN 'Fixed' ELSE 'Auto' END"
    block = "suggested_block_bytes"
    if mode != "Off":
        block = f"CASE WHEN repeat_density > 0.22 AND entropy_bits < 5.5 THEN least({block} * 3, 4194304) WHEN entropy_bits > 7.2 THEN greatest({block} // 2, 32768) ELSE {block} END"
        if mode == "Aggressive":
            block = f"CASE WHEN repeat_density > 0.12 THEN greatest(least(({block}) * 5, 4194304) // 4, 32768) ELSE {block} END"
        if planning == "Safe":
            block = f"least({block}, 2097152)"
    target = f"CAST(least(least(greatest({block}, 32768), 4194304), greatest(uncompressed_size, 1)) AS BIGINT)"
    mult = {"Off": 1.0, "Standard": 1.08, "Aggressive": 1.25}[mode] * {"Safe": 0.88, "Balanced": 1.0, "Aggressive": 1.12}[planning]
    chain = f"CAST(least(greatest(least(greatest({strength} * 0.08 + 0.85, 0.75), 1.35) * {mult!r}, 0.5), 1.75) AS DOUBLE)"
    huffman = "false" if mode == "Off" else f"uncompressed_size // greatest({target}, 1) >= 2 AND repeat_density > 0.08"
    return {"match_strength_proxy": strength, "predicted_stored": stored_, "predicted_deflate_path": path, "target_block_bytes": target, "lz77_chain_mult": chain, "use_global_huffman": huffman}


def _intel_sql(name: str) -> str:
    d = _decide_sql("Standard", "Balanced")
    return f"""WITH {_signals_sql(name)}, {_MODEL_SQL}
SELECT logical_name, uncompressed_size, round(entropy_bits, 9) AS entropy_bits, round(repeat_density, 9) AS repeat_density, round(bigram_proxy, 9) AS bigram_proxy,
  round(least(1.0 / greatest(text_mass, 1), 8.0), 9) AS duplicate_proxy, round({d["match_strength_proxy"]}, 9) AS match_strength_proxy, {d["predicted_stored"]} AS predicted_stored, {d["predicted_deflate_path"]} AS predicted_deflate_path,
  {d["target_block_bytes"]} AS target_block_bytes, round({d["lz77_chain_mult"]}, 9) AS lz77_chain_mult, {d["use_global_huffman"]} AS use_global_huffman,
  round(CAST(least(greatest(entropy_bits / 8, 0.05), 1.2) AS DOUBLE), 9) AS est_compressed_ratio, round(CAST(repeat_density * 6.0 + 2.5 AS DOUBLE), 9) AS est_decode_ns_per_byte
FROM s, (SELECT text_mass, suggested_block_bytes FROM model)"""


def _decisions_sql() -> str:
    parts = []
    for mode in MODES:
        for planning in PLANNING:
            d = _decide_sql(mode, planning)
            parts.append(f"SELECT logical_name, '{mode}' AS mode, '{planning}' AS planning, {d['predicted_stored']} AS predicted_stored, {d['predicted_deflate_path']} AS predicted_deflate_path, {d['target_block_bytes']} AS target_block_bytes, round({d['lz77_chain_mult']}, 9) AS lz77_chain_mult, {d['use_global_huffman']} AS use_global_huffman FROM x")
    return f"WITH {_signals_sql('documents')}, {_MODEL_SQL}, x AS (SELECT s.*, suggested_block_bytes FROM s, (SELECT suggested_block_bytes FROM model))\n" + "\nUNION ALL ".join(parts)


def _mode_sql() -> str:
    rows = ", ".join(f"({i}, '{n}', '{p.mode}', '{p.verification}', {p.adaptive}, {p.global_huffman}, '{p.planning}')" for i, (n, p) in enumerate(MODE_TABLE))
    return f"SELECT CAST(ordinal AS INTEGER) AS ordinal, mode_id, prediction, verification, adaptive, global_huffman, planning FROM (VALUES {rows}) t(ordinal, mode_id, prediction, verification, adaptive, global_huffman, planning)"


_BUNDLES = "SELECT CAST(doc_id // 64 AS VARCHAR) AS logical_name, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id, coalesce(text, '')) AS content FROM documents WHERE doc_id IS NOT NULL GROUP BY 1"


def crc32_sql(hexed: str) -> str:
    """CRC-32 of bytes given in hexadecimal, as a fold over a table made by the polynomial's rule."""
    entries_ = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        entries_.append(x)
    tab = "[" + ", ".join(map(str, entries_)) + "]::BIGINT[]"
    start = f"list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all({hexed}, '..'), lambda y: CAST('0x' || y AS BIGINT)))"
    return f"xor(4294967295::BIGINT, list_reduce({start}, lambda c, b: xor(c >> 8, ({tab})[CAST(xor(c, b) & 255 AS INTEGER) + 1])))"


def _winners_sql() -> str:
    names = ("stock", "fast", "zip")
    sizes = ", ".join(f"(o_custkey * {7919 + i}) % 1048576 / 1048576.0::DOUBLE AS r{i}, 1 / (greatest(o_custkey % {17 + i}, 1)::DOUBLE / 1000) AS m{i}" for i, _ in enumerate(names))
    first = "CASE WHEN er <= r0 AND er <= r1 AND er <= r2 THEN 'engine' WHEN r0 <= r1 AND r0 <= r2 THEN 'stock' WHEN r1 <= r2 THEN 'stock_fast' ELSE 'stock_zip' END"
    last = "CASE WHEN m2 >= m1 AND m2 >= m0 AND m2 >= em THEN 'stock_zip' WHEN m1 >= m0 AND m1 >= em THEN 'stock_fast' WHEN m0 >= em THEN 'stock' ELSE 'engine' END"
    return f"""WITH b AS (SELECT CAST(l_orderkey AS VARCHAR) AS workload_id, min(((l_partkey * 7919) % 1048576) / 1048576.0::DOUBLE) AS er, max(1 / (greatest(l_suppkey + 1, 1)::DOUBLE / 1000)) AS em FROM lineitem GROUP BY 1),
o AS (SELECT CAST(o_orderkey AS VARCHAR) AS workload_id, {sizes} FROM orders)
SELECT workload_id, round(er, 9) AS engine_ratio, round(r0, 9) AS stock_ratio, round(r1, 9) AS stock_fast_ratio, round(r2, 9) AS stock_zip_ratio, {first} AS ratio_winner, round(em, 9) AS engine_mib_s, round(m0, 9) AS stock_mib_s, {last} AS speed_winner
FROM b JOIN o USING (workload_id)"""


_SIZED = "SELECT CAST(doc_id AS VARCHAR) AS logical_name, CAST(strlen(coalesce(text, '')) AS BIGINT) AS uncompressed_size FROM documents"

ORACLE_SQL: dict[str, str] = {
    "intel_documents": _intel_sql("documents"),
    "intel_pages": _intel_sql("pages"),
    "intel_conversations": _intel_sql("conversations"),
    "intel_benchmark": _intel_sql("benchmark"),
    "intel_events": _intel_sql("events"),
    "intel_summary": f"""WITH {_signals_sql("documents")}
SELECT count(*) AS entry_count, CAST(sum(uncompressed_size) AS BIGINT) AS total_raw_bytes, round(sum(entropy_bits * uncompressed_size) / sum(uncompressed_size), 6) AS global_entropy_bits,
  round(sum(least(greatest(entropy_bits / 8, 0.05), 1.2) * uncompressed_size) / sum(uncompressed_size), 6) AS predicted_ratio, CAST(0 AS DOUBLE) AS duplicate_cluster_score FROM s""",
    "byte_histogram": f"""SELECT CAST(x AS BIGINT) AS byte, count(*) AS n, CASE WHEN x = 0 THEN 'zero' WHEN x BETWEEN 33 AND 126 OR x IN (9, 10, 13) THEN 'ascii_text' ELSE 'high_entropy' END AS byte_class
FROM (SELECT CAST('0x' || y AS INTEGER) AS x FROM (SELECT unnest(regexp_extract_all(h, '..')) AS y FROM ({_payload_sql("documents")}))) GROUP BY x""",
    "byte_signals": f"""WITH {_signals_sql("documents")}
SELECT logical_name, uncompressed_size, round(entropy_bits, 9) AS entropy_bits, round(repeat_density, 9) AS repeat_density, round(bigram_proxy, 9) AS bigram_proxy, zero, ascii_text, high_entropy FROM s""",
    "archive_model": f"""WITH {_signals_sql("documents")}, {_MODEL_SQL}
SELECT entry_count, total_uncompressed, CAST(mean_entry_bytes AS BIGINT) AS mean_entry_bytes, zero, text_mass, high_entropy, suggested_block_bytes, lz77_max_chain, lz77_nice_match, index_stride, use_index FROM model""",
    "decisions": _decisions_sql(),
    "manifest_sha256": "SELECT CAST(doc_id AS VARCHAR) AS path, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes, sha256(coalesce(text, '')) AS sha256_hex FROM documents",
    "layout_lexical": f"SELECT logical_name, uncompressed_size, row_number() OVER (ORDER BY logical_name) - 1 AS entry_id FROM ({_SIZED})",
    "layout_size_desc": f"SELECT logical_name, uncompressed_size, row_number() OVER (ORDER BY uncompressed_size DESC, logical_name) - 1 AS entry_id FROM ({_SIZED})",
    "top_patterns": f"""SELECT i AS pos, CAST(x AS BIGINT) AS byte, n FROM (SELECT i, x, count(*) AS n FROM (SELECT i, CAST('0x' || y AS INTEGER) AS x FROM (SELECT unnest(range(length(h) // 2)) AS i, unnest(regexp_extract_all(h, '..')) AS y FROM ({_payload_sql("documents")})) WHERE i < 262144) GROUP BY ALL) ORDER BY n DESC, i, x LIMIT 32""",
    "fixed_blocks": f"SELECT logical_name, block_id, block_id * 4096 AS \"offset\", least(4096, uncompressed_size - block_id * 4096) AS length FROM (SELECT *, unnest(range((uncompressed_size + 4095) // 4096)) AS block_id FROM ({_SIZED}))",
    "nearest_prior_match": f"""WITH e AS (SELECT logical_name, h, length(h) // 2 AS n FROM ({_payload_sql("documents")})),
x AS (SELECT logical_name, i, CAST('0x' || y AS INTEGER) AS x FROM (SELECT logical_name, unnest(range(n)) AS i, unnest(regexp_extract_all(h, '..')) AS y FROM e)),
k AS (SELECT logical_name, i - 2 AS i, (lag(x) OVER (PARTITION BY logical_name ORDER BY i) & 127) * 256 + x AS b FROM x QUALIFY i >= 2),
d AS (SELECT logical_name, b, i - lag(i) OVER (PARTITION BY logical_name, b ORDER BY i) AS dist FROM k)
SELECT logical_name, count(*) AS positions, count(DISTINCT b) AS buckets, count(*) FILTER (dist <= 32768) AS matches, coalesce(min(dist), -1) AS least_distance FROM d GROUP BY logical_name""",
    "local_header_offsets": f"""SELECT logical_name, row_number() OVER w - 1 AS entry_id, CAST(coalesce(sum(30 + strlen(logical_name) + uncompressed_size) OVER (ORDER BY logical_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS local_header_offset
FROM ({_SIZED}) WINDOW w AS (ORDER BY logical_name)""",
    "block_outcomes": """WITH x AS (SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS BIGINT) AS q, l_suppkey % 50 AS s, l_discount * 10 AS a, l_tax * 10 AS p, CAST(trunc(l_extendedprice) AS BIGINT) AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN abs(q - s) / CAST(greatest(q, s, 1) AS DOUBLE) <= 0.12 THEN 'balanced' WHEN q > s THEN 'window-dominant' ELSE 'index-dominant' END AS match_dominance,
  CASE WHEN a > p * 1.15 AND n >= 4096 THEN 'dynamic_not_beneficial' ELSE '' END AS fallback_reason FROM x""",
    "best_by_group": """SELECT l_orderkey, CAST(first(l_linenumber ORDER BY l_extendedprice, l_linenumber) AS BIGINT) AS ratio_winner, CAST(first(l_linenumber ORDER BY l_extendedprice DESC, l_linenumber DESC) AS BIGINT) AS speed_winner, min(l_extendedprice) AS best_ratio, max(l_extendedprice) AS best_rate FROM lineitem GROUP BY l_orderkey""",
    "explain_predicted": f"""WITH {_signals_sql("documents")}
SELECT logical_name AS name, uncompressed_size AS size, round(entropy_bits, 9) AS entropy, CASE WHEN {_decide_sql("Standard", "Balanced")["predicted_stored"]} THEN 'stored' ELSE 'deflate:' || {_decide_sql("Standard", "Balanced")["predicted_deflate_path"]} END AS predicted,
  round(CAST(least(greatest(entropy_bits / 8, 0.05), 1.2) AS DOUBLE), 9) AS predicted_ratio, '' AS actual, CAST(0 AS DOUBLE) AS actual_ratio, CAST(0 AS BIGINT) AS blocks FROM s""",
    "archive_round_trip": "SELECT CAST(item_id AS VARCHAR) AS logical_name, true AS matched, '' AS reason FROM benchmark",
    "verify_summary": "SELECT count(*) AS entries_verified, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS inflated_bytes, CAST(0 AS BIGINT) AS failures FROM documents",
    "mode_table": _mode_sql(),
    "crc32_documents": f"SELECT logical_name, {crc32_sql('h')} AS crc32 FROM ({_payload_sql('documents')})",
    "bundles_round_trip": f"SELECT profile, logical_name, true AS ok, CAST(strlen(content) AS BIGINT) AS uncompressed_size, true AS smaller, sha256(content) AS sha256 FROM ({_BUNDLES}), (VALUES {', '.join(f"('{n}')" for n in BUNDLE_PROFILES)}) t(profile)",
    "bundle_blocks": f"SELECT logical_name, CAST(strlen(content) AS BIGINT) AS covered, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS oversized, strlen(content) > 65536 AS several FROM ({_BUNDLES})",
    "bundle_trace": f"SELECT logical_name, CAST(strlen(content) AS BIGINT) AS raw_bytes, CAST(0 AS BIGINT) AS too_many_tokens, CAST(0 AS BIGINT) AS wrong_ratios FROM ({_BUNDLES})",
    "explain_run": f"""WITH {_signals_sql("bundles", f"SELECT logical_name, hex(encode(content)) AS h FROM ({_BUNDLES})")}
SELECT logical_name AS name, uncompressed_size AS size, round(CAST(least(greatest(entropy_bits / 8, 0.05), 1.2) AS DOUBLE), 9) AS predicted_ratio, 'deflate' AS actual, true AS smaller, uncompressed_size AS explained_bytes FROM s""",
    "harness_winners": _winners_sql(),
}
