import pytest

from bytegrain.config import MODES, PLANNING, Profile
from bytegrain.operators.intel import archive_model, decide, intel, intel_summary, signals
from bytegrain.operators.layout import numbered
from bytegrain.operators.plan_entry import model_of, plan_entry
from bytegrain.sources.corpus import noise, recipes
from bytegrain.sources.entries import SCHEMA, from_table

FILES = {p: c for p, c in recipes().items() if len(c) < 90_000} | {"empty": b"", "n15": bytes(range(15)), "n16": bytes(range(16)), "n149": noise(149, 1), "n150": noise(150, 1), "n2047": noise(2047, 2), "edge": b"a" * 32768 + b"b"}


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame([(n, len(c), bytearray(c)) for n, c in FILES.items()], SCHEMA).cache()


# Entropy, repeats, pairs, strength, stored, path, target block of some files of their own workload.
GOLDEN = {
    "wl_02_medium_text/medium.txt": (4.487021, 0.009685, 0.0, 1.252787, False, "Fixed", 22200),
    "wl_08_log_like/app.log": (4.507782, 0.036130, 0.000362, 1.309567, False, "Auto", 65536),
    "wl_09_source_like/sample.rs": (4.455677, 0.152818, 0.066781, 1.714125, False, "Fixed", 65536),
    "wl_10_binary_like/bytes.dat": (8.0, 0.000032, 0.0, 0.000078, True, "Auto", 32768),
    "wl_04_highly_repetitive/repetition.txt": (0.0, 1.0, 1.0, 6.8, False, "Dynamic", 196608),
    "wl_12_duplicate_heavy/dup.txt": (4.001630, 0.0, 0.0, 1.399429, False, "Fixed", 524288),
}


def test_golden_signals(spark):
    for path, want in GOLDEN.items():
        c = recipes()[path]
        r = intel(spark.createDataFrame([(path, len(c), bytearray(c))], SCHEMA)).first()
        got = (r["entropy_bits"], r["repeat_density"], r["bigram_proxy"], r["match_strength_proxy"], r["predicted_stored"], r["predicted_deflate_path"], r["target_block_bytes"])
        assert tuple(round(x, 6) if isinstance(x, float) else x for x in got) == want


@pytest.mark.parametrize("mode", MODES)
@pytest.mark.parametrize("planning", PLANNING)
def test_columns_say_what_kernels_do(entries, mode, planning):
    p = Profile(mode=mode, planning=planning)
    measured = signals(entries, p)
    m = archive_model(measured, p, True).first()
    model = model_of(m["entry_count"], m["total_uncompressed"], m["zero"], m["text_mass"], m["high_entropy"], p, True)
    assert (model.block, model.chain, model.nice, model.stride, model.use_index) == (m["suggested_block_bytes"], m["lz77_max_chain"], m["lz77_nice_match"], m["index_stride"], m["use_index"])
    for r in decide(measured, archive_model(measured, p, True), p).collect():
        plan = plan_entry(FILES[r["logical_name"]], model, p)
        assert (plan.stored, plan.path, plan.target, plan.huffman) == (r["predicted_stored"], r["predicted_deflate_path"], r["target_block_bytes"], r["use_global_huffman"]), r
        assert abs(plan.multiplier - r["lz77_chain_mult"]) < 1e-12


def test_model_edges():
    p = Profile()
    assert model_of(1, 65535, 0, 5, 0, p, True).block == 262144 and model_of(1, 65536, 0, 5, 0, p, True).block == 65536
    assert model_of(1, 65535, 0, 5, 0, p, False).chain == 64 and model_of(200, 10**9, 0, 1, 0, p, True).block == 32768
    assert model_of(1, 3 << 20, 0, 1, 0, p, True).nice == 128 and model_of(0, 0, 0, 0, 0, p, False).entries == 0


def test_summary_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert intel(none).count() == 0
    r = intel_summary(intel(none)).first()
    assert (r["entry_count"], r["total_raw_bytes"], r["global_entropy_bits"]) == (0, 0, 0.0)


def test_from_table_and_layouts(spark):
    t = spark.createDataFrame([(1, 2, "é"), (1, 10, None), (2, 1, "")], "a int, b int, text string")
    e = from_table(t, ["a", "b"], "text")
    assert {r["logical_name"]: (r["uncompressed_size"], bytes(r["content"])) for r in e.collect()} == {"1/2": (2, "é".encode()), "1/10": (0, b""), "2/1": (0, b"")}
    assert [r["logical_name"] for r in numbered(e).orderBy("entry_id").collect()] == ["1/10", "1/2", "2/1"]
    got = numbered(e, "size_desc", "uncompressed_size").orderBy("entry_id").collect()
    assert [(r["logical_name"], r["entry_id"], r["before"]) for r in got] == [("1/2", 0, 0), ("1/10", 1, 2), ("2/1", 2, 2)]


def test_content_is_not_shuffled_or_kept(entries):
    plan = intel(entries)._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.split("\n")[0]


def test_profiles_are_checked():
    for bad in (dict(mode="x"), dict(level=0), dict(layout="x"), dict(method="x")):
        with pytest.raises(ValueError):
            Profile(**bad)
    assert Profile().but(level=9).level == 9
