import datetime as dt

from bytegrain.operators.intel import archive_model, intel, signals
from bytegrain.sources.entries import from_table
from bytegrain.streaming.intel import stream_intel, windowed_signals

ROWS = [(i, dt.datetime(2024, 1, 1, i % 5), "text %d " % i * 9) for i in range(40)]
DDL = "event_id long, ts timestamp, props string"


def drained(stream, spark, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_stream_agrees_with_batch(spark, tmp_path):
    batch = spark.createDataFrame(ROWS, DDL)
    batch.write.parquet(f"{tmp_path}/t")
    model = archive_model(signals(from_table(batch, "event_id", "props")))
    got = drained(stream_intel(spark.readStream.schema(DDL).parquet(f"{tmp_path}/t"), model, key="event_id", payload="props"), spark, "stream_intel")
    want = {r["logical_name"]: r["match_strength_proxy"] for r in intel(from_table(batch, "event_id", "props")).collect()}
    assert {r["logical_name"]: r["match_strength_proxy"] for r in got} == want


def test_windows_count_repeats_once(spark, tmp_path):
    spark.createDataFrame(ROWS + ROWS[:7], DDL).coalesce(1).write.parquet(f"{tmp_path}/t")
    got = drained(windowed_signals(spark.readStream.schema(DDL).parquet(f"{tmp_path}/t"), time="ts", key="event_id", payload="props"), spark, "stream_windows", "complete")
    assert sum(r["entries"] for r in got) == 40 and len(got) == 5 and all(r["entropy_bits"] > 0 for r in got)
