import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from bytegrain.llm.components import components
from bytegrain.llm.exact_dedup import exact_dedup
from bytegrain.llm.jaccard_join import Rule, Sets, _split, jaccard_components, join_cluster, keep_one, region_keys
from bytegrain.llm.passages import remove_passages

DDL = "doc_id long, text string"
random.seed(11)
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(random.choice(VOCABULARY) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame(rows, DDL).repartition(3)


# --- exact -------------------------------------------------------------------------


def test_exact(spark):
    base = prose(50)
    rows = [(5, base), (3, base.replace(" ", "\n\t ")), (9, base + "."), (7, None), (8, ""), (2, " "), (4, "  "), (1, base[:64] + "x"), (None, base), (6, prose(9)), (6, "other")]
    got = {(r["id"], r["sha256"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(frame(spark, rows), digest=True).collect()}
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(i)
    want = set()
    for t, ids in groups.items():
        keep = min(i for i in ids if i is not None)
        want |= {(i, hashlib.sha256(t.encode()).hexdigest(), keep, len(ids), i == keep) for i in ids}
    assert got == want


def test_exact_reads_hashes_only_of_rivals(spark):
    got = {r["id"]: r for r in exact_dedup(frame(spark, [(1, "a"), (2, "a"), (3, "longer"), (4, "a" * 100), (5, "a" * 99 + "b")])).collect()}
    assert got[3]["sha256"] is None and got[1]["sha256"] and got[4]["sha256"] != got[5]["sha256"] and got[5]["kept"]


def test_exact_repeated_rows_and_nothing(spark):
    same = exact_dedup(frame(spark, [(1, "x")] * 5 + [(None, "y")] * 3))
    rows = same.collect()
    assert sum(r["kept"] for r in rows) == 2 and {r["group_size"] for r in rows if r["id"] == 1} == {5} and len(rows) == 8
    assert exact_dedup(spark.createDataFrame([], DDL)).count() == 0


def test_exact_saturated_bits(spark):
    rows = [(i, f"text {i % 7}") for i in range(40)]
    got = {r["id"]: r["keep_id"] for r in exact_dedup(frame(spark, rows), bits=6).collect()}
    assert got == {i: i % 7 for i in range(40)}


# --- passages ----------------------------------------------------------------------


def removed(rows, size):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    seen = defaultdict(int)
    for w in words:
        for i in range(len(w) - size + 1):
            seen[tuple(w[i : i + size])] += 1
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone |= set(range(i, i + size))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def check_passages(spark, rows, size=35, gram=8):
    got = [(r["id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in remove_passages(frame(spark, rows), size=size, gram=gram).collect()]
    assert sorted(got, key=repr) == removed(rows, size)


@pytest.mark.parametrize("most_log2", [28, 5])
def test_passages(spark, monkeypatch, most_log2):
    """With a sketch, and with one too small for the input."""
    import bytegrain.llm._sketch as sketch

    monkeypatch.setattr(sketch, "MOST_LOG2", most_log2)
    shared, line = prose(60), prose(20)
    rows = [(i, f"{prose(40)} {shared if i % 3 else line} {prose(30)}\n{line}") for i in range(20)]
    rows += [(50, shared), (51, "  " + shared + "\t"), (52, prose(34)), (53, "a " * 100), (54, None), (55, ""), (56, " \n "), (57, " ".join(shared.split()[5:45]) + " end"), (None, prose(50)), (None, shared), (58, "é ü " + shared + " ö")]
    rows += [(60, rows[0][1])] * 3
    check_passages(spark, rows)
    check_passages(spark, rows, 7, 3)
    check_passages(spark, rows, 4, 4)


@pytest.mark.parametrize("most_log2", [28, 5])
def test_passages_of_few_words(spark, monkeypatch, most_log2):
    """A tiny vocabulary, so that anchors tie and stretches of many kinds share them."""
    import bytegrain.llm._sketch as sketch

    monkeypatch.setattr(sketch, "MOST_LOG2", most_log2)
    rows = [(i, " ".join(random.choice("ab") for _ in range(random.randrange(60)))) for i in range(25)]
    check_passages(spark, rows, 9, 4)
    check_passages(spark, rows, 5, 1)


def test_passages_of_nothing(spark):
    assert remove_passages(spark.createDataFrame([], DDL)).count() == 0
    with pytest.raises(ValueError):
        remove_passages(spark.createDataFrame([], DDL), gram=40)


def test_share_of_unique_keys_that_pass(spark):
    """Up to half a key a cell, where log2_for() ends, the sketch lets 15 % of the unique keys pass; keys that occur twice always pass."""
    from bytegrain.llm._sketch import Sketch, Twice, log2_for

    rng = np.random.default_rng(7)
    for log2, keys in ((19, 1 << 16), (19, 1 << 18)):
        unique, twice = np.split(rng.integers(0, 1 << 63, keys + 1000, dtype=np.uint64), [keys])
        sketch = Sketch(log2)
        for part in np.split(np.concatenate((unique, twice, twice)), 5 if (keys + 2000) % 5 == 0 else 1):
            sketch.add(part)
        got = Twice(log2, sketch.twice)
        x = (keys + 1000) / (1 << log2)
        assert got.may(twice).all() and got.may(unique).mean() < (1 - np.exp(-x)) ** 2 + 0.02
    assert log2_for(1 << 27) == 28 and log2_for((1 << 27) + 1) is None


# --- Jaccard -------------------------------------------------------------------------


def shingles(t, n=3):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def joined(rows, rule=Rule()):
    sets = [shingles(t, rule.n) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and rule.den * both >= rule.num * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min([x for x in (least.get(find(i)), doc) if x is not None], default=None)
    return sorted(((doc, len(sets[i]), least[find(i)] if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=repr)


def varied(base, changes):
    w = base.split()
    for _ in range(changes):
        w[random.randrange(len(w))] = f"new{random.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def near():
    rows = []
    for size in (5, 9, 11, 14, 25, 60, 200, 700):
        for _ in range(2):
            base = prose(size)
            rows += [varied(base, random.randrange(max(1, size // 25) + 1)) for _ in range(14)] + [base.upper(), base + " x", base]
    rows += [prose(40) for _ in range(30)] + ["a b", "A\nB", "a", "", None, " ", "a a a a a a", "a a a a"]
    random.shuffle(rows)
    out = list(enumerate(rows))
    return out + [(None, rows[3]), (7, rows[3]), (7, rows[7])]


NEAR = Rule(5, 80, 100)


@pytest.mark.parametrize("how", [{}, {"rule": NEAR}, {"rule": Rule(2, 7, 10)}, {"rule": Rule(3, 1, 1)}, {"local": 300, "pivots": 3}, {"rule": NEAR, "local": 2000, "most_sets": 9}])
def test_jaccard(spark, near, how):
    got = [(r["id"], r["size"], r["component_id"]) for r in jaccard_components(frame(spark, near), **how).collect()]
    assert sorted(got, key=repr) == joined(near, how.get("rule", Rule()))


def test_keys_dealt_out_where_no_sketch_fits(spark, near, monkeypatch):
    import bytegrain.llm._sketch as sketch

    monkeypatch.setattr(sketch, "MOST_LOG2", 5)
    assert sketch.log2_for(100) is None
    got = [(r["id"], r["size"], r["component_id"]) for r in jaccard_components(frame(spark, near)).collect()]
    assert sorted(got, key=repr) == joined(near)


def clustered(spark, sets):
    """One cluster of the sets, as the split reads it."""
    return spark.createDataFrame([(b"c", i.to_bytes(4, "big"), np.sort(s).view(np.int64).tolist()) for i, s in enumerate(sets)], "cluster binary, name binary, shingles array<long>")


def test_unlike_sets_do_not_grow(spark):
    """Sets that are at distance 1 from all pivots are dealt to one region, once."""
    from bytegrain.llm._shared import Tables, stored

    rng = np.random.default_rng(5)
    rows = stored(clustered(spark, [np.unique(rng.integers(0, 1 << 63, 40, dtype=np.uint64)) for _ in range(300)]), "test")
    links, rest = _split(rows, Rule(), 8, 0, Tables(spark))
    assert links.count() == 0 and rest.count() == 300 - 8 and rest.select("cluster").distinct().count() == 1


def test_a_large_cluster_of_small_sets_ends(spark):
    """50,000 sets with common phrases: too many for one task, unlike but for chains of neighbours."""
    from bytegrain.llm._shared import Tables, stored
    from bytegrain.llm.jaccard_join import _cluster_links

    rng = np.random.default_rng(6)
    common = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    own = rng.integers(0, 1 << 63, (50_000, 16), dtype=np.uint64)
    sets = [np.concatenate((common, own[i if i % 100 else i - 1 if i else 0][: 16 if i % 100 else 15])) for i in range(50_000)]
    tables = Tables(spark)
    links = _cluster_links(stored(clustered(spark, sets).repartition(4), "test"), Rule(), 8 << 20, 8192, 8, tables)
    every = links[0]
    for x in links[1:]:
        every = every.union(x)
    got = {r["node"]: r["component"] for r in components(every).collect()}
    assert got == {i.to_bytes(4, "big"): (i - 1).to_bytes(4, "big") for j in range(100, 50_000, 100) for i in (j,)} | {(j - 1).to_bytes(4, "big"): (j - 1).to_bytes(4, "big") for j in range(100, 50_000, 100)}


def test_small_sets_have_enough_slices():
    """Sets of any size hardly ever lie in so few slices that they must be compared with all."""
    from bytegrain.llm._words import texts
    import pyarrow as pa

    for rule in (Rule(), NEAR):
        rows = [" ".join(f"{random.getrandbits(40):x}" for _ in range(n)) for n in range(rule.n, 120) for _ in range(300)]
        ((_, data, offsets),) = texts(pa.array(rows), 1 << 30)
        assert region_keys(Sets(data, offsets, rule.n), rule)[1].sum() <= 1


def test_orphans_are_compared_with_all(spark, near, monkeypatch):
    """Sets whose shingles leave too many slices empty find their links by comparison: here all sets, with no region keys at all."""
    import bytegrain.llm.jaccard_join as j

    nodes = j._nodes

    def orphaned(documents, rule, tables):
        from pyspark.sql import functions as F

        return nodes(documents, rule, tables).withColumns({"orphan": F.col("name").isNotNull(), "own": F.array().cast("array<long>"), "next": F.array().cast("array<long>")})

    monkeypatch.setattr(j, "_nodes", orphaned)
    got = [(r["id"], r["size"], r["component_id"]) for r in jaccard_components(frame(spark, near[:120])).collect()]
    assert sorted(got, key=repr) == joined(near[:120])


def test_keep_one(spark, near):
    rows = [(i, t, "en", j) for j, (i, t) in enumerate(near)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string, key int")
    got = keep_one(docs)
    assert got.columns == docs.columns
    want = joined(near, NEAR)
    assert sorted(r["doc_id"] for r in got.collect() if r["doc_id"] is not None) == sorted({i for i, _, c in want if i == c})


def test_jaccard_of_nothing(spark):
    assert jaccard_components(spark.createDataFrame([], DDL)).count() == 0 and keep_one(spark.createDataFrame([], DDL)).count() == 0
    assert [(r["id"], r["component_id"]) for r in jaccard_components(frame(spark, [(1, None), (2, ""), (3, "x y z")])).orderBy("id").collect()] == [(1, 1), (2, 2), (3, 3)]


@pytest.mark.parametrize("rule", [Rule(), NEAR, Rule(4, 7, 10)])
def test_linked_sets_share_a_region(rule):
    """Every pair at the threshold shares as many keys as told, at all sizes."""
    from bytegrain.llm._words import texts
    import pyarrow as pa

    for size in (5, 9, 10, 12, 19, 30, 57, 120, 400, 1000):
        for _ in range(20):
            n = size + rule.n - 1
            w = [f"{random.getrandbits(40):x}" for _ in range(n)]
            cut = max(1, int(size * (1 - rule.num / rule.den) / (1 + rule.num / rule.den)))
            rows = [" ".join(w), " ".join(w[cut:]), " ".join(w[: n - cut])]
            ((_, data, offsets),) = texts(pa.array(rows))
            sets = Sets(data, offsets, rule.n)
            found, orphan = region_keys(sets, rule)
            own = [set(sets.shingles[sets.ends[i] : sets.ends[i + 1]].tolist()) for i in range(3)]
            for a in range(3):
                for b in range(a):
                    if rule.den * len(own[a] & own[b]) >= rule.num * len(own[a] | own[b]) and not orphan[[a, b]].any():
                        shared = [np.intersect1d(x[0][x[1] == a], y[0][y[1] == b]).size for x in found for y in found]
                        assert own[a] == own[b] or any(n >= max(x[2][a], y[2][b]) for n, (x, y) in zip(shared, [(x, y) for x in found for y in found], strict=True))


def test_cluster_join_by_brute_force():
    for _ in range(40):
        sets = []
        for _ in range(random.randint(1, 4)):
            base = [random.getrandbits(63) for _ in range(random.randint(20, 100))]
            for _ in range(random.randint(1, 25)):
                s = list(base)
                for _ in range(random.randint(0, len(s) // 9)):
                    s[random.randrange(len(s))] = random.getrandbits(63)
                sets.append(np.unique(np.array(s, np.uint64)))
        up = list(range(len(sets)))

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        plain = [set(x.tolist()) for x in sets]
        for i in range(len(sets)):
            for j in range(i):
                if 100 * len(plain[i] & plain[j]) >= 90 * len(plain[i] | plain[j]):
                    a, b = find(i), find(j)
                    up[max(a, b)] = min(a, b)
        assert join_cluster(sets, block=random.choice([4, 256])) == [find(i) for i in range(len(sets))]


def test_cluster_join_of_overlapping_balls():
    """Links between sets that are each in the ball of another pivot: chains of sliding windows, and families with bridges."""
    flat = np.arange(5000, dtype=np.uint64)
    starts = [10 * i for i in range(21)]
    for first in range(21):
        for second in range(21):
            order = [starts[first], *([starts[second]] if second != first else []), *(x for i, x in enumerate(starts) if i not in (first, second))]
            assert set(join_cluster([flat[x : x + 1000] for x in order])) == {0}
    for _ in range(200):
        order = [10 * i for i in range(random.randint(17, 60)) if random.random() < 0.9]
        random.shuffle(order)
        got = join_cluster([flat[x : x + random.choice([1000, 1000, 990])] for x in order])
        assert len(set(got)) == 1
    for _ in range(60):  # copies around far centres, joined by one bridge between two of them
        left = [np.delete(flat[:1000], random.sample(range(1000), 40)) for _ in range(20)]
        right = [np.delete(flat[110:1110], random.sample(range(1000), 30)) for _ in range(20)]
        sets = [*left, *right, flat[55:1055]]
        random.shuffle(sets)
        plain = [set(x.tolist()) for x in sets]
        up = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                if up[i] != up[j] and 100 * len(plain[i] & plain[j]) >= 90 * len(plain[i] | plain[j]):
                    a, b = sorted((up[i], up[j]))
                    up = [a if x == b else x for x in up]
        assert join_cluster(sets) == up


def test_components(spark):
    edges = [(random.randrange(200), random.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
