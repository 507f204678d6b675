import json

import pytest

from bytegrain import api
from bytegrain.config import Profile


@pytest.fixture
def top(tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_bytes(b"some words, some words, " * 300)
    (tmp_path / "in/sub/b.bin").write_bytes(bytes(range(256)) * 4)
    return tmp_path


def test_create_and_validate(spark, top, capsys):
    assert api.main(["create", f"{top}/in", f"{top}/out", "--verify", "Strict"]) == 0
    report = json.loads(capsys.readouterr().out)
    assert report["entries"] == 2 and report["entries_verified"] == 2 and report["elapsed_ms"] > 0
    assert api.main(["validate", f"{top}/out", "--strict"]) == 0
    rows = [json.loads(x) for x in capsys.readouterr().out.split("\n") if x]
    assert rows[-1] == {"entries_verified": 2, "inflated_bytes": 7200 + 1024, "failures": 0} and {r["name"] for r in rows[:-1]} == {"a.txt", "sub/b.bin"}
    path = next((top / "out").glob("*.zip"))
    path.write_bytes(path.read_bytes()[:-5])
    assert api.main(["validate", f"{top}/out"]) == 1


def test_bench(spark, top, capsys):
    assert api.main(["bench", f"{top}/in", f"{top}/out"]) == 0
    told = dict(x.split("=") for x in capsys.readouterr().out.split())
    assert told["raw"] == "8224" and int(told["compressed"]) < 8224 and int(told["cores"]) > 0 and int(told["ms"]) > 0


def test_analyze_explain_debug(spark, top, capsys):
    api.main(["analyze", f"{top}/in"])
    rows = [json.loads(x) for x in capsys.readouterr().out.split("\n") if x]
    assert rows[0]["entry_count"] == 2 and {r["logical_name"] for r in rows[1:]} == {"a.txt", "sub/b.bin"}
    api.main(["explain", f"{top}/in", "--no-run"])
    assert json.loads(capsys.readouterr().out.split("\n")[0])["actual_ratio"] == 0
    api.main(["debug", f"{top}/in"])
    assert json.loads(capsys.readouterr().out.split("\n")[0])["token_count"] > 0


def test_compare(spark, top):
    r = api.compare(spark, f"{top}/in", Profile())
    assert r["raw_bytes"] == 8224 and r["ratio_winner"] in ("engine_ratio", "stock_ratio", "tie_ratio") and r["stock_ms"] >= 1
