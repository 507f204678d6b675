import io
import json
import os
import zipfile
from pathlib import Path

import pytest

from bytegrain.config import MODE_TABLE, Profile
from bytegrain.errors import ArchiveConsistency, EmptyArchive, EntryNotFound, InvalidPath, ZipStructure
from bytegrain.operators import harness
from bytegrain.operators.archive import ZipWriter, block_trace, compress, compress_under, create_archive, local_offsets, write_archives
from bytegrain.operators.deflate import stock_deflate
from bytegrain.operators.explain import as_json, explain
from bytegrain.operators.stored import stored
from bytegrain.operators.verify import directory, extract, find_end, read_archives, read_entry, round_trip, stock_zip, verification_summary, verify_entries
from bytegrain.sources.corpus import generate, noise, recipes, workload_dirs, write_manifest
from bytegrain.sources.entries import SCHEMA, from_binary_files, from_tree, list_tree

#: What rows have for recipes: small workloads with every kind of content.
CASES = {
    "single": ({"hello.txt": b"hello world"}, Profile()),
    "order": ({f"{i:02}.txt": f"x{i}".encode() for i in range(20)}, Profile()),
    "aggressive": ({"a.txt": b"the quick brown fox jumps over."}, Profile(mode="Aggressive", planning="Aggressive")),
    "off": ({"seven.bin": bytes([7]) * 4096}, Profile(mode="Off", verification="Strict")),
    "stored": ({"z.bin": bytes(512)}, Profile(method="Stored")),
    "fixed": ({"a.txt": b"aaaaaaaa"}, Profile(mode="Off", strategy="Fixed", verification="Strict")),
    "duplicates": ({f"d/{i}.txt": b"z" * 64 for i in range(24)}, Profile()),
    "mixed": ({"b.bin": bytes([255, 0, 254, 1, 2, 3]), "t.txt": b"hello\nworld\n", "empty": b"", "_under": b"x", "größe/ü.txt": "ö".encode() * 200}, Profile(verification="Strict")),
    "blocks": ({"big.txt": b"".join(b"line %d of text\n" % i for i in range(9000)), "n.bin": noise(50_000, 3)}, Profile(mode="Off")),
    "adaptive": ({"big.txt": b"".join(b"line %d of text\n" % i for i in range(9000)) + bytes(60_000)}, Profile(adaptive=True)),
    "global": ({"r.txt": (b"A" * 70_000 + b"some words here " * 3000)}, Profile(global_huffman=True)),
}


def tree(root, files):
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return str(root)


@pytest.mark.parametrize("case", CASES)
def test_round_trip(spark, tmp_path, folder, case):
    files, p = CASES[case]
    entries = from_tree(spark, tree(tmp_path / "in", files))
    report = create_archive(entries, folder, p)
    assert report["entries"] == report["total_entries"] == len(files) and report["uncompressed_bytes"] == sum(map(len, files.values()))
    (path,) = (tmp_path / "out").glob("*.zip")
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == files and z.namelist() == sorted(files, key=str.encode)
    found = round_trip(entries, verify_entries(read_archives(spark, folder), strict=True, keep_content=True)).collect()
    assert len(found) == len(files) and all(r["matched"] for r in found)


def test_layout_by_size_and_offsets(spark, tmp_path, folder):
    files = {"a": b"1", "b": b"333", "c": b"22", "d": b"4" * 3}
    packed = stored(compress(from_tree(spark, tree(tmp_path / "in", files))))
    write_archives(packed, folder, "size_desc")
    with zipfile.ZipFile(next((tmp_path / "out").glob("*.zip"))) as z:
        assert z.namelist() == ["b", "d", "c", "a"]
        assert {i.filename: i.header_offset for i in z.infolist()} == {r["logical_name"]: r["local_header_offset"] for r in local_offsets(packed, "size_desc").collect()}


def test_several_archives(spark, tmp_path, folder):
    files = {f"{i:03}": bytes([i]) * i for i in range(60)}
    written = write_archives(compress(from_tree(spark, tree(tmp_path / "in", files))), folder, archives=3).collect()
    assert sum(r["total_entries"] for r in written) == 60
    totals = verification_summary(verify_entries(read_archives(spark, folder), strict=True)).first()
    assert (totals["entries_verified"], totals["failures"]) == (60, 0)


def test_scan(spark, tmp_path):
    top = tree(tmp_path / "t", {"a/b.txt": b"1", ".hidden": b"2", ".dir/x": b"3", "_keep": b"", "z": b"4"})
    os.symlink(tmp_path / "t" / "z", tmp_path / "t" / "link")
    assert [n for _, n, _ in list_tree(top)] == ["_keep", "a/b.txt", "z"]
    assert {r["logical_name"]: bytes(r["content"]) for r in from_tree(spark, top).collect()} == {"_keep": b"", "a/b.txt": b"1", "z": b"4"}
    assert from_binary_files(spark, top).count() == 2 + 1  # the empty and hidden ones are not in it, links are followed
    with pytest.raises(InvalidPath):
        list_tree(str(tmp_path / "none"))
    (tmp_path / "void").mkdir()
    with pytest.raises(EmptyArchive):
        from_tree(spark, str(tmp_path / "void"))
    with pytest.raises(EmptyArchive):
        create_archive(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/out")


def archive(files):
    out = io.BytesIO()
    w = ZipWriter(out)
    import zlib

    for name, content in files.items():
        w.add(name, "Deflate", zlib.crc32(content), len(content), stock_deflate(content))
    w.finish()
    return out.getvalue()


def test_broken_archives(spark):
    good = archive({"a": b"hello" * 50, "b": b"x"})
    assert find_end(good)["total_entries"] == 2 and read_entry(good, "b") == b"x" and [e["name"] for e in directory(good)] == ["a", "b"]
    for bad, error in ((good[:-5], ZipStructure), (b"PK", ZipStructure), (b"", ZipStructure)):
        with pytest.raises(error):
            directory(bad)
    with pytest.raises(EntryNotFound):
        read_entry(good, "c")
    end = find_end(good)
    moved = bytearray(good)
    moved[end["eocd_offset"] + 12 : end["eocd_offset"] + 16] = (end["central_size"] + 500).to_bytes(4, "little")
    with pytest.raises(ArchiveConsistency):
        directory(bytes(moved))
    crc, local, payload = bytearray(good), bytearray(good), bytearray(good)
    crc[end["central_offset"] + 16] ^= 1
    local[14] ^= 1
    payload[33] ^= 255
    rows = spark.createDataFrame([("good", bytearray(good)), ("cut", bytearray(good[:-5])), ("crc", crc), ("local", local), ("payload", payload), ("null", None)], "path string, content binary")
    from bytegrain.operators.verify import parse_archives

    def faults(strict):
        return {(r["archive"], r["name"]) for r in verify_entries(parse_archives(rows), strict).collect() if not r["ok"]}

    assert faults(False) == {("cut", None), ("crc", "a"), ("payload", "a"), ("null", None)}
    assert faults(True) == faults(False) | {("local", "a")}


def test_limits():
    w = ZipWriter(io.BytesIO())
    with pytest.raises(ZipStructure):
        w.add("a", "Stored", 0, 1 << 32, b"")
    with pytest.raises(ZipStructure):
        w.add("n" * 70_000, "Stored", 0, 0, b"")


def test_extract_refuses_to_leave(spark, tmp_path):
    rows = spark.createDataFrame([("ok/file", True, bytearray(b"1"))], "name string, ok boolean, content binary")
    assert extract(rows, str(tmp_path / "x")) == 1 and (tmp_path / "x/ok/file").read_bytes() == b"1"
    with pytest.raises(Exception, match="leads out"):
        extract(spark.createDataFrame([("../evil", True, bytearray(b"1"))], "name string, ok boolean, content binary"), str(tmp_path / "x"))


def test_explain_and_trace(spark):
    files = {"a.txt": b"".join(b"line %d of text\n" % i for i in range(6000)), "b.bin": noise(30_000, 9), "c": b""}
    entries = spark.createDataFrame([(n, len(c), bytearray(c)) for n, c in files.items()], SCHEMA)
    archive_row, rows = explain(entries)
    found = {r["name"]: r for r in rows.collect()}
    a = archive_row.first()
    assert 0 < a["actual_ratio"] < 1 and found["b.bin"]["predicted"] == found["b.bin"]["actual"] == "stored" and found["c"]["actual_ratio"] == 0
    blocks = found["a.txt"]["blocks"]
    assert [b["id"] for b in blocks] == list(range(len(blocks))) and sum(b["length"] for b in blocks) == len(files["a.txt"])
    assert all(b["match_dominance"] in ("balanced", "window-dominant", "index-dominant") for b in blocks)
    quiet = explain(entries, run=False)
    assert quiet[0].first()["actual_ratio"] == 0 and all(r["actual"] == "" and not r["blocks"] for r in quiet[1].collect())
    assert {json.loads(r["value"])["name"] for r in as_json(rows).collect()} == set(files)
    assert {r["logical_name"] for r in block_trace(entries, Profile(adaptive=True)).collect()} == {"a.txt"}


def test_matrix(spark, tmp_path):
    names = ("wl_01_very_small_text", "wl_06_json_like", "wl_13_near_duplicate")
    files = {p: c for p, c in recipes().items() if p.startswith(names)}

    def entries(w):
        return spark.createDataFrame([(p.split("/", 1)[1], len(c), bytearray(c)) for p, c in files.items() if p.startswith(w)], SCHEMA)

    runs = harness.run_matrix({w: entries(w) for w in names}, MODE_TABLE[:2])
    got = {(r["workload_id"], r["mode_id"][:3]): r["compressed_bytes"] for r in runs.collect()}
    assert got == {(names[0], "m01"): 4, (names[0], "m02"): 27, (names[1], "m01"): 1563, (names[1], "m02"): 984, (names[2], "m01"): 1402, (names[2], "m02"): 1402}
    rows = spark.createDataFrame([(p.split("/")[0], p, bytearray(c)) for p, c in files.items()], "workload_id string, logical_name string, content binary")
    compared = harness.winners(harness.best_of_modes(runs), harness.stock_baselines(rows))
    best = {r["workload_id"]: r for r in compared.collect()}
    assert round(best[names[0]]["engine_ratio"], 6) == 1 and best[names[0]]["ratio_winner"] == "engine" and round(best[names[1]]["engine_ratio"], 6) == 0.077523
    from bytegrain.operators.deflate import inflate

    assert {r["workload_id"]: inflate(bytes(r["blob"])) for r in harness.stock_blobs(rows).collect()} == {w: b"".join(c for p, c in sorted(files.items()) if p.startswith(w)) for w in names}
    total = harness.summary(runs).first()
    assert total["archives_built"] == 6 and total["verification_pass_rate"] == 1 and total["modes_tested"] == 2
    harness.write_reports(f"file://{tmp_path}/r", compared, harness.summary(runs))
    assert "ratio_winner" in next((tmp_path / "r/comparison_table").glob("*.csv")).read_text().split("\n")[0]


def test_winner_ties(spark):
    best = spark.createDataFrame([("w", 0.5, 8.0)], "workload_id string, engine_ratio double, engine_mib_s double")
    base = spark.createDataFrame([("w", 1 << 20, 1 << 19, 125.0, 1 << 20, 125.0, 1 << 19, 125.0)], "workload_id string, raw_bytes long, stock_bytes long, stock_ms double, fast_bytes long, fast_ms double, zip_bytes long, zip_ms double")
    r = harness.winners(best, base).first()
    assert r["ratio_winner"] == "engine" and r["speed_winner"] == "stock_zip"


def test_corpus(tmp_path):
    import hashlib

    manifest = generate(str(tmp_path))
    by_path = {f["path"]: f for f in manifest["files"]}
    assert len(by_path) == 55 and sum(f["bytes"] for f in by_path.values()) == 2_780_541
    # The first digits of checksums.
    for path, digits in {"wl_02_medium_text/medium.txt": "d0f93f6f30613d87", "wl_11_random_entropy/rnd.bin": "22fd0b5e4c8474b1", "wl_13_near_duplicate/b.txt": "a0558fecf249f472", "wl_16_mixed_combined/csv/summary.csv": "ed10bc1896059a49"}.items():
        assert by_path[path]["sha256_hex"].startswith(digits) and hashlib.sha256((tmp_path / path).read_bytes()).hexdigest() == by_path[path]["sha256_hex"]
    assert len(workload_dirs(str(tmp_path))) == 15
    write_manifest(str(tmp_path / "manifest.json"), manifest)
    assert json.loads((tmp_path / "manifest.json").read_text()) == manifest
    assert len(stock_zip({"a": b"x"})) > 100


def test_repeated_names_are_refused(spark):
    from bytegrain.errors import RepeatedName
    from bytegrain.operators.archive import compress

    for names in (["a", "a"], ["a", None]):
        rows = spark.createDataFrame([(n, 300, bytearray(b"abc" * 100)) for n in names], "logical_name string, uncompressed_size long, content binary")
        with pytest.raises(RepeatedName):
            compress(rows)


def test_inflate_holds_no_more_than_expected():
    from bytegrain.operators.deflate import inflate, stock_deflate

    packed = stock_deflate(b"x" * 5_000_000)
    assert inflate(packed, 5_000_000) == b"x" * 5_000_000
    for size in (0, 10, 4_999_999, 5_000_001):
        with pytest.raises(ValueError):
            inflate(packed, size)
    assert inflate(stock_deflate(b""), 0) == b""


def test_archives_beyond_the_formats_entries(spark, folder):
    """More entries than two directories can hold: further files are written, and all are read back."""
    rows = spark.range(140_000).selectExpr("cast(id as string) logical_name", "'Stored' method", "crc32(encode(lpad(cast(id as string), 8, '0'), 'UTF-8')) crc32", "8L uncompressed_size", "8L compressed_size", "encode(lpad(cast(id as string), 8, '0'), 'UTF-8') payload")
    written = write_archives(rows, folder, archives=2).collect()
    assert len(written) > 2 and max(r["total_entries"] for r in written) <= 0xFFFF and sum(r["total_entries"] for r in written) == 140_000
    assert verification_summary(verify_entries(read_archives(spark, folder), strict=True)).first().asDict() == {"entries_verified": 140_000, "inflated_bytes": 8 * 140_000, "failures": 0}


def test_archives_are_bounded_by_bytes(spark, folder):
    rows = spark.range(400).selectExpr("cast(id as string) logical_name", "'Stored' method", "crc32(encode(repeat('x', 1000), 'UTF-8')) crc32", "1000L uncompressed_size", "1000L compressed_size", "encode(repeat('x', 1000), 'UTF-8') payload")
    written = write_archives(rows, folder, archives=None, bytes_each=50_000).collect()
    assert len(written) >= 8 and max(r["central_directory_offset"] for r in written) <= 60_000
    assert verification_summary(verify_entries(read_archives(spark, folder), strict=True)).first()["entries_verified"] == 400


def test_stock_baselines_stream_a_workload(spark):
    """The same sizes as of joined files, without a group of a whole workload in one task's Python."""
    import random

    from bytegrain.operators.deflate import stock_deflate

    r = random.Random(3)
    files = {f"{i}": b" ".join(r.choice((b"one", b"two", b"thr\xc3\xa9e", b"%d" % i)) for _ in range(r.randrange(900))) for i in range(400)} | {"ü/ä.txt": b"ab" * 40_000, "empty": b""}
    rows = harness.stock_baselines(spark.createDataFrame([("w", n, bytearray(c)) for n, c in files.items()] + [("v", "a", bytearray(b"x"))], "workload_id string, logical_name string, content binary"))
    got = {x["workload_id"]: x for x in rows.collect()}
    flat = b"".join(c for _, c in sorted(files.items()))
    assert [got["w"][f"{n}_bytes"] for n in ("raw", "stock", "fast", "zip")] == [len(flat), len(stock_deflate(flat)), len(stock_deflate(flat, 1)), len(stock_zip(files))]
    assert got["v"]["raw_bytes"] == 1 and "FlatMapGroups" not in rows._jdf.queryExecution().executedPlan().toString()


def test_size_of_a_stock_zip_of_many_files():
    z, files = harness._StockZip(6), {f"{i}": b"x" for i in range(70_000)}
    for n, c in files.items():
        z.add(n, c)
    assert z.bytes == len(stock_zip(files))


def test_adaptive_entries_need_no_group_each(spark):
    """Entries of one block are matched side by side; no Python group for each entry, and no second pass of the contents for the trace."""
    rows = block_trace(spark.createDataFrame([(f"{i}", 400, bytearray(b"some text, %d " % i * 40)) for i in range(20)], SCHEMA), Profile(adaptive=True))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "LeftOuter" not in plan


def test_a_run_is_made_once_for_its_explanation(spark):
    files = explain(spark.createDataFrame([(f"{i}", 400, bytearray(b"some text, %d " % i * 40)) for i in range(5)], SCHEMA))[1]
    assert "REPARTITION_BY_NUM" not in files._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["bundle_trace", "explain_run"])
def test_bundles_are_made_once(spark, name):
    from bytegrain.plans.queries import QUERIES

    assert "collect_list(struct(doc_id" not in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_a_round_trip_holds_one_profile_at_a_time(spark, monkeypatch):
    """Archives, payloads and shuffle files of a profile are gone when the next begins; what stays at the end are the rows."""
    from bytegrain.plans import queries

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    blocks = spark._jsc.sc().env().blockManager().diskBlockManager()

    def held() -> set[str]:
        found = {str(f) for f in shared.rglob("*") if f.is_file() and not f.name.startswith((".", "_"))}
        return found | {b for b in blocks.getAllBlocks().mkString("\n").split("\n") if b.startswith("shuffle_")}

    before, seen, write = held(), [], queries.write_archives
    monkeypatch.setattr(queries, "write_archives", lambda *a, **k: (seen.append(held() - before), write(*a, **k), seen.append(held() - before))[1])
    out = queries.bundles_round_trip(spark, "/root/testdata/sf0.001")
    left = held() - before
    assert not any("shuffle_" in f or f.endswith(".zip") for f in left)
    assert {f.rsplit("/", 1)[0] for f in left} == {p.removeprefix("file:").replace("///", "/").rsplit("/", 1)[0] for p in out.inputFiles()}
    assert sum(f.endswith(".zip") for x in seen[1::2] for f in x) == 2 * len(queries.BUNDLE_PROFILES)  # none but its own
    assert not any("shuffle_" in f for x in seen for f in x)
    assert out.count() == 4 * len(queries.BUNDLE_PROFILES)


def test_bundles_go_round_in_rounds(spark, monkeypatch):
    """A round has payloads of some bundles only; with all rounds every bundle comes back under each profile, as with one."""
    from bytegrain.plans import queries

    wanted = [tuple(r) for r in queries.bundles(spark, "/root/testdata/sf0.001").selectExpr("logical_name", "uncompressed_size", "sha2(content, 256)").collect()]
    sizes, write, size = [], queries.write_archives, sum(r[1] for r in wanted)
    monkeypatch.setattr(queries, "write_archives", lambda packed, *a, **k: (sizes.append(packed.count()), write(packed, *a, **k))[1])
    rows = queries.bundles_round_trip(spark, "/root/testdata/sf0.001", size // 2 + 1).collect()
    assert len(sizes) == 2 * len(queries.BUNDLE_PROFILES) and 0 < sizes[0] < len(wanted) and sum(sizes) == len(rows)
    assert {tuple(r) for r in rows} == {(p, n, True, size, True, sha256) for p in queries.BUNDLE_PROFILES for n, size, sha256 in wanted}


def test_compressing_under_several_profiles_is_compressing_under_each(spark):
    text = b"".join(b"line %d of some text, %d\n" % (i, i * i % 977) for i in range(9000))
    files = {"text": text, "empty": b"", "small": b"abc " * 50, "noise": noise(70_000, 3), "tiny": b"x", "zero": bytes(40_000), "both": text[:90_000] + noise(30_000, 5) + text[5000:60_000]}
    rows = spark.createDataFrame([(n, len(c), bytearray(c)) for n, c in files.items()], SCHEMA)
    profiles = {"adaptive": Profile(adaptive=True), "global_huffman": Profile(global_huffman=True), "small": Profile(strategy="Fixed", mode="Off", max_block=65536), "stored": Profile(method="Stored")}
    got = compress_under(rows, profiles, whole=150_000)  # `text` and `both` are dealt out by blocks
    wanted = {(name, *r) for name, p in profiles.items() for r in map(tuple, compress(rows, p).drop("trace").collect())}
    assert got.count() == len(wanted) and set(map(tuple, got.collect())) == wanted
    whole = compress_under(rows, profiles)
    assert whole._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 1 and set(map(tuple, whole.collect())) == wanted
