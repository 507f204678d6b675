"""Each stage of the pipeline against a plain version of what it should do with its own input."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_dedup import NEAR, joined
from test_files import expected, plain_rates
from test_texts import contaminated

import corpus_pipeline
from bytegrain.llm._shared import stored
from bytegrain.llm.language_id import identify, learn_profiles
from bytegrain.llm.mixing import mix, quality_domains
from bytegrain.llm.queries import held_out

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


# --- plain versions --------------------------------------------------------------------


def plain_grams(text):
    """n-grams as tuples of code points, a run of anything but letters being 0."""
    runs = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    s = [0]
    for r in runs:
        s += [ord(c) for c in r] + [0]
    found = Counter((c,) for c in s if c)
    found.update(tuple(s[i : i + 2]) for i in range(len(s) - 1) if runs)
    found.update(tuple(s[i : i + 3]) for i in range(len(s) - 2) if s[i + 1])
    return found


def plain_list(counts, top=300):
    def code(g):
        return g[0] if len(g) == 1 else 1 << 63 | g[0] << 21 | g[1] if len(g) == 2 else g[0] << 42 | g[1] << 21 | g[2]

    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:top]


def plain_languages(rows, learn, top=300):
    """doc_id: language and score by out-of-place distance. rows: doc_id, text, lang."""
    sums = defaultdict(Counter)
    for doc, text, lang in rows:
        if learn(doc) and text is not None and lang is not None:
            sums[lang].update(plain_grams(text))
    profiles = {lang: {g: i for i, g in enumerate(plain_list(c, top))} for lang, c in sorted(sums.items())}
    out = {}
    for doc, text, _ in rows:
        own = plain_list(plain_grams(text or ""), top)
        if not own:
            out[doc] = ("und", 0.0)
            continue
        distance = {lang: sum(abs(p[g] - i) if g in p else top for i, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(distance, key=lambda lang: (distance[lang], lang))
        out[doc] = best, 1 - distance[best] / (top * len(own))
    return out


def plain_mix(rows, labels, weights, slots=1 << 17, evidence=256):
    """Rate of each document by naive Bayes over hashed words and projected gradient. rows: doc_id, text."""
    def words(t):
        return [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in t or "").split(" ") if w]

    def slot(w):
        return xxhash.xxh64(w.encode(), seed=42).intdigest() % slots

    k, text = len(weights), dict(rows)
    counts, per = defaultdict(lambda: np.zeros(k)), Counter(d for _, d in labels)
    for doc, d in labels:
        for w in words(text.get(doc)):
            counts[slot(w)][d] += 1
    total = sum(counts.values(), np.zeros(k))
    prior = np.log(np.array([(per[d] + 1) / (len(labels) + k) for d in range(k)]))
    logs = {s: np.log((c + 0.1) / (total + 0.1 * slots)) for s, c in counts.items()}
    p, n = [], []
    for _, t in rows:
        own = words(t)
        x = sum((logs[s] - logs[s].mean() for s in map(slot, own) if s in logs), np.zeros(k)) * min(1, evidence / max(len(own), 1)) + prior
        e = np.exp(x - x.max())
        p.append(e / e.sum())
        n.append(len(own))
    rates = plain_rates(np.array(p), np.array(n, float), weights, 0.0, rounds=60)
    return {doc: r for (doc, _), r in zip(rows, rates, strict=True)}, np.array(p), np.array(n)


# --- stages ------------------------------------------------------------------------------


def test_stages(spark):
    assert list(STAGES) == ["language", "near_duplicates", "decontamination", "mixing", "tokens"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    odd = spark.createDataFrame([(10_000, "12 34 !", "en", "s", 7), (10_001, None, None, None, None), (10_002, "", "en", "s", 0), (10_003, "ξεσκεπάζω την ψυχοφθόρα βδελυγμία " * 9, None, "s", 300), (10_003, "ξεσκεπάζω την ψυχοφθόρα βδελυγμία " * 9, None, "s", 300)], docs.schema)
    docs = stored(docs.union(odd), "test")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    out = {r["doc_id"]: r["held"] for r in docs.select("doc_id", held_out().alias("held")).collect()}
    want = plain_languages(rows, lambda d: not out[d])
    got = {r["doc_id"]: (r["language"]["lang"], r["language"]["score"]) for r in identify(docs, learn_profiles(docs, learn=~held_out())).collect()}
    assert got.keys() == want.keys() and all(got[d][0] == want[d][0] and abs(got[d][1] - want[d][1]) < 1e-9 for d in want)

    one = stored(STAGES["language"](spark, docs, SF), "test")
    kept = {d for d, (lang, score) in want.items() if lang != "und" and score >= corpus_pipeline.LEAST_LANGUAGE_SCORE}
    assert one.columns == names and {r["doc_id"] for r in one.collect()} == kept
    assert {10_000, 10_001, 10_002, 10_003} == {d for d, _, _ in rows} - kept

    two = stored(STAGES["near_duplicates"](spark, one, SF), "test")
    near = joined([(r["doc_id"], r["text"]) for r in one.collect()], NEAR)
    assert two.columns == names and sorted(r["doc_id"] for r in two.collect()) == sorted({d for d, _, c in near if d == c})

    three = stored(STAGES["decontamination"](spark, two, SF), "test")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {x[0] for x in contaminated([(r["doc_id"], r["text"]) for r in two.collect()], items) if not x[4]}
    assert three.columns == names and {r["doc_id"] for r in three.collect()} == clean

    four = stored(STAGES["mixing"](spark, three, SF), "test")
    labels = [(r["doc_id"], r["domain"]) for r in quality_domains(spark.read.parquet(f"{SF}/labels.parquet")).collect() if r["domain"] is not None]
    texts = sorted((r["doc_id"], r["text"]) for r in three.collect())
    rates, _, _ = plain_mix(texts, labels, corpus_pipeline.WEIGHTS)
    copies = Counter(r["doc_id"] for r in four.collect())
    assert four.columns == names and copies.keys() <= rates.keys()
    assert all(abs(copies[d] - r) < 1 + 1e-6 and copies[d] >= int(r + 1e-6) for d, r in rates.items())
    table, _ = mix(three, quality_domains(spark.read.parquet(f"{SF}/labels.parquet")), corpus_pipeline.WEIGHTS)
    assert all(abs(rates[r["id"]] - r["rate"]) < 1e-3 for r in table.collect())

    last = STAGES["tokens"](spark, four, SF).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in last] == expected(sorted((r["doc_id"], r["text"]) for r in four.collect()))


@pytest.mark.parametrize("sf, close", [("/root/testdata/sf0.01", 0.02), ("/root/testdata/sf0.1", 0.01), ("/root/testdata/check_h", 0.01)])
def test_mixing_stage_meets_its_targets(spark, sf, close):
    """From the rows that the stage returns: shares of the tokens, and the corpus's own total."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = quality_domains(spark.read.parquet(f"{sf}/labels.parquet"))
    table, reached = mix(docs, labels, corpus_pipeline.WEIGHTS)
    assert max(abs(a - b) for a, b in zip(reached["totals"], reached["targets"], strict=True)) < 1e-4 * sum(reached["targets"])
    found = STAGES["mixing"](spark, docs, sf).groupBy("doc_id", F.xxhash64("text").alias("key")).count()
    rows = found.join(table, (F.col("doc_id") == F.col("id")) & (found["key"] == table["key"]))
    got = np.array(rows.agg(*(F.sum(F.col("count") * F.col("tokens") * F.col("p")[d]) for d in range(3))).first())
    assert np.abs(got / got.sum() - corpus_pipeline.WEIGHTS).max() < close and abs(got.sum() / sum(reached["targets"]) - 1) < 2 * close


def test_pipeline_on_odd_tables(spark, tmp_path):
    """A null id, nulls in all other columns, repeated rows, a very long text and columns with the operators' own names go through all stages."""
    rng = random.Random(3)
    letters = {"aa": "abcde", "bb": "vwxyz"}

    def prose(n, kind):
        return " ".join("".join(rng.choice(letters[kind]) for _ in range(rng.randint(2, 6))) for _ in range(n))

    rows = [(i, prose(60, "aa" if i % 2 else "bb"), "aa" if i % 2 else "bb") for i in range(40)]
    long_, same = prose(60_000, "aa"), prose(50, "bb")
    rows += [(100, long_, "aa"), (101, long_ + " end", None), (102, same, None), (102, same, None), (103, same, "bb"), (None, prose(70, "aa"), None), (104, None, None), (105, "", "aa"), (None, None, None), (106, rows[1][1] + " more", "bb")]
    docs = spark.createDataFrame([(*r, "k", 1, [2]) for r in rows], "doc_id long, text string, lang string, contamination string, rows int, spans array<int>")
    tables = {"documents": docs, "benchmark": spark.createDataFrame([(1, rows[2][1]), (None, None)], "item_id long, text string"), "labels": spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(21, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int")}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    now = docs
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stored(stage(spark, now, str(tmp_path)), "test")
        counts.append(Counter(r["doc_id"] for r in now.collect()))
        assert now.columns == docs.columns, name
    assert counts[0][None] == 1 and counts[0][102] == 2 and not {104, 105} & counts[0].keys()
    assert counts[1] == Counter({d: 1 for d in counts[0] if d not in (101, 103, 106)})
    assert counts[2] == Counter({d: 1 for d in counts[1] if d != 2})
    assert counts[3].keys() <= counts[2].keys()
    last = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in last] == expected(sorted(((r["doc_id"], r["text"]) for r in now.collect()), key=lambda x: (x[0] is not None, x[0] or 0)))
