"""Token files, mixing, the pipeline, and rows of every odd kind through all operators."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from bytegrain.llm.mixing import DOMAINS, fit, mix, mixed_documents, quality_domains, rate_column
from bytegrain.llm.queries import QUERIES, tokenizer_path
from bytegrain.llm.token_files import Encoder, TokenFile, _tokenizer, bits_for, encode_file, encode_texts, pack, read_token_files, unpack, write_token_files

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string"
random.seed(13)


# --- packing -------------------------------------------------------------------------


@given(st.integers(1, 31), st.lists(st.integers(0, (1 << 31) - 1), max_size=70), st.integers(1, 20))
@settings(max_examples=80, deadline=None)
def test_pack(bits, values, block):
    ids = np.array(values, np.uint32) & np.uint32((1 << bits) - 1)
    assert unpack(pack(ids, bits), bits, len(ids)).tolist() == ids.tolist() and len(pack(ids, bits)) == -(-len(ids) * bits // 8)
    cut = sorted(random.randrange(len(ids) + 1) for _ in range(3))
    lengths = np.diff([0, *cut, len(ids)])
    f = TokenFile(pa.PythonFile(__import__("io").BytesIO(encode_file([5, None, -7, 9], lengths, ids, bits, block)), "r"))
    assert len(f) == 4 and f.ids(0).tolist() == ids[: cut[0]].tolist() and f.ids(3).tolist() == ids[cut[2] :].tolist() and f.slice(0, len(ids)).tolist() == ids.tolist()


def test_fewest_bits():
    assert [bits_for(n) for n in (1, 2, 3, 256, 257, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]
    with pytest.raises(ValueError):
        encode_file([1], np.array([1]), np.array([4], np.uint32), 2)


def test_pieces_encode_as_whole_texts():
    alphabet = list(" \n\t  　\u0085  \x0b\x1c\x1fa1é'.,日s") + ["<|endoftext|>", "don't", "  x"]
    rows = ["", None, " ", "trail \n", "<|endoftext|> x"] + ["".join(random.choice(alphabet) for _ in range(random.randint(0, 40))) for _ in range(3000)]
    got = []
    for ids, n in encode_texts(pa.array(rows), Encoder(tokenizer_path(), most=500), 0):
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    t = _tokenizer(tokenizer_path())
    assert got == [[*t.encode(r or "", add_special_tokens=False).ids, 0] for r in rows]


def expected(rows):
    t, at, out = _tokenizer(tokenizer_path()), 0, []
    for doc, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_files(spark):
    rows = [(i, "word " * random.randrange(40) + str(i)) for i in random.sample(range(1000), 60)] + [(2000, None), (2001, "")]
    files = write_token_files(spark.createDataFrame(rows, DDL).repartition(5), tokenizer_path(), bytes_each=1, block=64)
    got = [(r["id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in read_token_files(files).orderBy("id").collect()]
    assert got == expected(sorted(rows)) and files.count() > 1
    r = next(r for r in read_token_files(files).collect() if r["id"] == 2000)
    with open(r["path"].removeprefix("file://"), "rb") as f:
        one = TokenFile(pa.PythonFile(f, "r"))
        assert one.bits == 16 and one.ids(r["position"]).tolist() == [0] and one.doc_ids[r["position"]] == 2000


def test_files_of_odd_rows(spark):
    rows = [(None, "a"), (None, None), (3, "x"), (3, "x"), (3, "y"), (1, "é")]
    got = [(r["id"], r["start"], r["n_tokens"]) for r in read_token_files(write_token_files(spark.createDataFrame(rows, DDL), tokenizer_path())).orderBy("start").collect()]
    assert [g[0] for g in got] == [None, None, 1, 3, 3, 3] and [g[1] for g in got] == [sum(x[2] for x in got[:i]) for i in range(6)]
    assert read_token_files(write_token_files(spark.createDataFrame([], DDL), tokenizer_path())).count() == 0


# --- mixing --------------------------------------------------------------------------


def plain_rates(p, n, weights, least, rounds=4000):
    """Projected gradient on the same loss in plain numpy, a step at a time."""
    total = n.sum()
    m = (p * n[:, None]).T @ p / total
    inverse, target, r = np.linalg.pinv(m + 1e-9 * np.eye(len(weights))), np.array(weights), np.ones(len(n))
    for _ in range(rounds):
        r = np.maximum(least, r - p @ (inverse @ ((r * n) @ p / total - target)))
    return r


def test_fit_meets_targets(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.4, 0.3, 0.3], 300)
    n = rng.integers(1, 500, 300)
    table = spark.createDataFrame([(1, int(t), [float(x) for x in q]) for t, q in zip(n, p, strict=True)], "rows long, tokens long, p array<double>")
    steps, reached = fit(table, [0.6, 0.3, 0.1])
    assert np.allclose(reached["totals"], reached["targets"], rtol=1e-4) and abs(sum(reached["targets"]) - n.sum()) < 1e-6
    rates = np.array([r["r"] for r in table.select(rate_column(steps, 3, 0.0).alias("r")).collect()])
    assert (rates >= 0).all() and np.allclose((rates * n) @ p, reached["totals"], rtol=1e-9)
    want = plain_rates(p, n.astype(float), [0.6, 0.3, 0.1], 0.0)
    assert np.allclose((want * n) @ p, reached["targets"], rtol=1e-4)
    steps, reached = fit(table, [0.5, 0.3, 0.2], least_rate=1.0)
    rates = np.array([r["r"] for r in table.select(rate_column(steps, 3, 1.0).alias("r")).collect()])
    assert (rates >= 1).all() and np.allclose((rates * n) @ p, reached["totals"], rtol=1e-9)
    assert fit(table.limit(0), [1.0, 1.0, 1.0])[0] == []


def test_fit_without_loss_meets_targets_however_far(spark):
    """With a least rate of 1, domains far above their targets make the others grow until the shares are right."""
    share = np.array([0.87, 0.07, 0.06])
    rows = [(1, 100, [float(d == i % 3) for d in range(3)]) for i in range(300)]
    table = spark.createDataFrame(rows, "rows long, tokens long, p array<double>")
    steps, reached = fit(table, share.tolist(), least_rate=1.0)
    assert np.allclose(reached["totals"], share * 10_000 / 0.06, rtol=1e-4) and np.allclose(reached["targets"], reached["totals"], rtol=1e-4)
    assert min(r["r"] for r in table.select(rate_column(steps, 3, 1.0).alias("r")).collect()) >= 1


@pytest.fixture(scope="module")
def labelled(spark):
    kinds = ["good fine calm clear", "junk junk spam junk", "rude nasty vile rude"]
    rows = [(i, " ".join(random.choice(kinds[i % 3].split()) for _ in range(30))) for i in range(240)]
    docs = spark.createDataFrame(rows, DDL).repartition(3)
    labels = spark.createDataFrame([(i, (1, 0, 1)[i % 3], int(i % 3 == 2)) for i in range(120)] + [(9999, 1, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_posteriors_and_copies(spark, labelled):
    docs, labels = labelled
    table, reached = mix(docs, quality_domains(labels), [0.7, 0.2, 0.1])
    rows = table.collect()
    held_out = [r for r in rows if r["id"] >= 120]
    assert all(int(np.argmax(r["p"])) == r["id"] % 3 and abs(sum(r["p"]) - 1) < 1e-9 for r in held_out) and len(DOMAINS) == 3
    assert np.allclose(reached["totals"], reached["targets"], rtol=1e-4)
    assert all(r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in rows) and abs(sum(r["copies"] for r in rows) - sum(r["rate"] for r in rows)) < 40
    out = mixed_documents(docs.withColumn("copies", F.lit("own")), table)
    assert out.columns == ["doc_id", "text", "copies"] and out.count() == sum(r["copies"] for r in rows)


def test_mixing_odd_rows(spark, labelled):
    _, labels = labelled
    rows = [(1, None), (1, None), (2, ""), (None, "good fine"), (None, "good fine"), (3, "rude"), (3, "junk")]
    docs = spark.createDataFrame(rows, DDL)
    table, _ = mix(docs, quality_domains(labels), [0.7, 0.2, 0.1])
    got = {(r["id"], r["tokens"]): r["rows"] for r in table.collect()}
    assert got[1, 0] == 2 and got[None, 2] == 2 and sum(r["rows"] for r in table.collect()) == len(rows)
    assert mix(docs.limit(0), quality_domains(labels), [1, 1, 1])[0].count() == 0
    blind, _ = mix(docs, quality_domains(labels).limit(0), [1, 1, 1])
    assert all(np.allclose(r["p"], 1 / 3) for r in blind.collect())
    assert mixed_documents(docs, mix(docs, quality_domains(labels), [0.8, 0.1, 0.1], least_rate=1.0)[0]).count() >= len(rows)


# --- odd rows through every query ---------------------------------------------------------


def test_queries_on_odd_tables(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, extra columns with the operators' own names; and empty tables."""
    long_ = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [(1, "a b c"), (2, None), (3, ""), (None, "x y z"), (4, long_), (4, long_), (5, long_ + " end"), (6, "\x00 nul"), (None, None), (7, "🙂 é 日本")]
    docs = spark.createDataFrame([(i, t, None if i == 3 else "en", None, None, "c", "k", 1, [2], "s") for i, t in rows], DDL + ", lang string, source string, n_chars long, contamination string, key string, rows int, spans array<int>, secrets string")
    sets = {
        "documents": docs, "benchmark": spark.createDataFrame([(1, long_[:200]), (None, None)], "item_id long, text string"), "labels": spark.createDataFrame([(1, 1, 0), (None, None, None), (4, 0, 1), (4, 0, 1)], "doc_id long, quality int, toxic int"),
        "pages": spark.createDataFrame([(1, "http://a.com/en/1", None, "x"), (None, None, None, None)], "page_id long, url string, html string, host string"),
    }
    for name, df in sets.items():
        df.write.parquet(f"{tmp_path}/odd/{name}.parquet")
        df.limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    for name, query in QUERIES.items():
        table = "pages" if name in ("op4_url_filter", "url_rules") else "documents"
        assert query(spark, f"{tmp_path}/odd").count() == sets[table].count(), name
        assert query(spark, f"{tmp_path}/none").count() == 0, name
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("name", ["op3_remove_passages", "op5_decontaminate", "op6_jaccard_join", "op9_exact_dedup", "mixing_tokens", "secret_base_spans", "url_rules", "license_base_phrases", "language_folds"])
def test_against_sql(spark, name):
    import duckdb

    from bytegrain.llm.queries import ORACLE_SQL

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
