"""N-gram Jaccard join in the metric space of shingle sets: links between texts whose sets have a similarity of `num` / `den` or more, and their components.

The Jaccard distance is a metric, for all shingles as for those of one slice of the
hash space. Pivots and triangle-inequality windows cut the space in three steps, and
every step keeps all linked pairs together:

1. Rings. The empty set is a pivot under the symmetric difference: sizes of linked
   sets differ by a factor of num / den at most. A set whose window reaches into the
   next ring is replicated there.
2. Slices. In a ring at most t = 2 * largest * (1 - s) / (1 + s) shingles differ
   between linked sets (s = num / den), so cut into k = t + 1 + e slices by hash, at
   least 1 + e slices hold the same shingles. In the metric of a slice the distinct
   contents are pivots, and the Voronoi region of radius 0 around each is an equality
   group: the region's key is a hash of ring, slice and content. Linked sets share
   1 + e regions less their empty slices, and sets that share fewer are not connected.
   A set with more than e empty slices (nearly impossible, but counted) is compared
   with all sets in blocks. A count-min sketch drops keys that occur once before anything is
   shuffled; where the input is too large for it, every key goes to the partition
   that owns its hash.
   (With documents as pivots on the whole space this step can't work: unrelated
   texts are all at distances near 1, inside every window of 2 * (1 - s).)
3. Pivot recursion. Sets connected through regions form a cluster. A cluster above
   `local` shingles or `most_sets` sets is cut by document pivots: what links to a
   pivot is connected, and only sets that may link to something outside its ball go
   on: each near set to its nearest pivot's Voronoi region and to all within the
   window, and sets that are far from all pivots to one region of their own, with
   the near ones at its border. Where regions don't shrink (all distances tie), the
   cluster is dealt out by rings of sizes and pairs of hash blocks instead, which
   always fit. What fits is joined exactly in one task each: by pivots, then by the
   rarest shingles, then by counting intersections.

Shingles are `n` consecutive words as 64-bit hashes; sets are named by 128-bit sums.
Equal sets are one node, so copies are never expanded into pairs.

Defined results: a null text, or one without words, has an empty set, links with
nothing and is its own component; a text of fewer than n words has its whole
sequence as one shingle; null ids count for no minimum; rows may repeat; other
columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bytegrain.llm._shared import Tables, bounded_batches, estimated_bytes, stored
from bytegrain.llm._sketch import log2_for, may_repeat, members
from bytegrain.llm._words import U, Words, freed, mixed, texts
from bytegrain.llm.components import components


@dataclass(frozen=True)
class Rule:
    """When texts are linked: den * intersection >= num * union of their sets of n-word shingles."""

    n: int = 3
    num: int = 90
    den: int = 100

    def __post_init__(self) -> None:
        if self.n < 1 or not 70 * self.den <= 100 * self.num <= 100 * self.den:
            raise ValueError("a shingle has a word or more, and a similarity lies between 0.7 and 1")

    @property
    def radius(self) -> float:
        """The greatest distance of linked sets."""
        return 1 - self.num / self.den

    def linked(self, intersection: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.den * intersection >= self.num * (a + b - intersection)


# --- sets ----------------------------------------------------------------------


class Sets:
    """The shingle sets of a piece: shingles sorted within each document, the document of each, sizes and names."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, n: int):
        words = Words(data, offsets, "space", True)
        docs = len(offsets) - 1
        sums = words.sums(0x3C6EF372)
        first = words.windows(n)
        short = np.flatnonzero((words.n_words > 0) & (words.n_words < n))
        begin = words.words_at[short]
        first_all = np.concatenate((first, begin))
        length = np.concatenate((np.full(len(first), n), words.n_words[short]))
        doc = words.doc[first_all] if len(first_all) else np.zeros(0, np.int64)
        order = np.argsort(doc, kind="stable")
        doc = doc[order]
        shingles = words.runs(sums, first_all, first_all + length)[order]
        ends = np.searchsorted(doc, np.arange(docs + 1))
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            shingles[a:b].sort()
        new = np.concatenate(([True], (shingles[1:] != shingles[:-1]) | (doc[1:] != doc[:-1]))) if len(doc) else np.zeros(0, bool)
        self.shingles, self.doc = shingles[new], doc[new]
        self.ends = np.searchsorted(self.doc, np.arange(docs + 1))
        self.size = np.diff(self.ends)

    def total(self, seed: int) -> np.ndarray:
        sums = np.concatenate(([U(0)], np.cumsum(mixed(self.shingles ^ U(seed)))))
        return sums[self.ends[1:]] - sums[self.ends[:-1]]

    def names(self) -> pa.Array:
        """16 bytes for each set; null for an empty one."""
        both = np.stack((mixed(self.total(0x1F83D9AB) + self.size.astype(np.uint64)), mixed(self.total(0x5BE0CD19))), axis=1)
        raw = np.ascontiguousarray(both.astype(">u8")).view("S16").ravel()
        out = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(self.size), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())
        return pa.compute.if_else(pa.array(self.size > 0), out, pa.scalar(None, pa.binary()))


@functools.cache
def _rings(rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First size of each ring, and its slices k and extra slices e. What links to a set lies in its own ring or in one beside it."""
    first = [1, 2]
    while first[-1] < 1 << 40:
        first.append(max(first[-1] + 1, first[-1] * 5 // 4, rule.den * (first[-1] - 1) // rule.num + 1))
    first = np.array(first)
    t = 2 * (first[1:] - 1) * (rule.den - rule.num) // (rule.den + rule.num)
    # more where slices are small: a set hardly ever lies in too few of them, and unlike sets hardly ever agree in so many
    extra = np.where(t == 0, 0, 8 + t // 12 if rule.radius < 0.15 else np.where(t > 2, 12 + t // 4, 37))
    return first, t + 1 + extra, extra


def _reaches(size: np.ndarray, ring: np.ndarray, first: np.ndarray, rule: Rule) -> np.ndarray:
    """Which sets may link to one of the next ring."""
    return rule.den * size >= rule.num * first[np.minimum(ring + 1, len(first) - 1)]


def region_keys(sets: Sets, rule: Rule = Rule()) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """For the own ring and for the next: region keys of all sets of a piece, the document of each, and how many of a document's keys each set linked to it has too. And which documents have too many empty slices."""
    first, slices, extras = _rings(rule)
    orphan = np.zeros(len(sets.size), bool)
    out = []
    ring = np.searchsorted(first, sets.size, "right") - 1
    for next_ring in (0, 1):
        some = (sets.size > 0) & (_reaches(sets.size, ring, first, rule) if next_ring else True)
        some &= extras[np.where(some, ring + next_ring, 0)] > 0  # no extra slices: only equal sets are linked, and these are one node
        r = np.where(some, ring + next_ring, 0)
        k = np.where(some, slices[r], 0)
        base = np.concatenate(([0], np.cumsum(k)))
        inside = some[sets.doc]
        h, doc = sets.shingles[inside], sets.doc[inside]
        at = base[doc] + ((mixed(h ^ U(0x6A09E667)) >> U(40)) * k[doc].astype(np.uint64) >> U(24)).astype(np.int64)
        count = np.bincount(at, minlength=base[-1])
        content = np.zeros(base[-1], np.uint64)
        np.add.at(content, at, mixed(h ^ U(0xBB67AE85)))
        owner = np.repeat(np.arange(len(k)), k)
        empty = np.bincount(owner[count == 0], minlength=len(k))
        orphan |= some & (empty > extras[r])
        needed = np.maximum(1 + extras[r] - empty, 1)  # 1 + extra slices agree; empty ones may be among them
        use = count > 0
        slot = (np.arange(base[-1]) - base[owner]).astype(np.uint64)
        out.append((mixed(content ^ mixed(r[owner].astype(np.uint64) << U(40) | slot))[use], owner[use], needed))
    return out, orphan


# --- exact join of a cluster in memory -------------------------------------------


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def _common(flat: np.ndarray, ends: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all sets (flat, ends) with the pivot (sorted)."""
    at = np.searchsorted(pivot, flat)
    at[at == len(pivot)] = 0
    hit = np.concatenate(([0], np.cumsum(pivot[at] == flat)))
    return hit[ends[1:]] - hit[ends[:-1]]


def join_cluster(sets: list[np.ndarray], rule: Rule = Rule(), pivots: int = 8, block: int = 256) -> list[int]:
    """The component of each set (the smallest position in it), exactly."""
    union = _Union(len(sets))
    size = np.array([len(s) for s in sets], np.int64)
    todo = np.arange(len(sets))  # may have links not seen yet
    open_ = np.ones(len(sets), bool)  # not in a pivot's ball
    for _ in range(pivots):
        if len(todo) <= 16 or not open_[todo].any():
            break
        p = int(todo[open_[todo]][0])
        ends = np.concatenate(([0], np.cumsum(size[todo])))
        common = _common(np.concatenate([sets[i] for i in todo]), ends, sets[p])
        distance = 1 - common / (size[todo] + size[p] - common)
        ball = rule.linked(common, size[todo], np.full(len(todo), size[p]))
        for i in todo[ball].tolist():
            union.join(p, i)
        open_[todo[ball]] = False
        roots = np.array([union.find(i) for i in todo.tolist()])
        other = roots != union.find(p)  # in no component of the pivot's: links to these may still be missing
        if not other.any():
            todo = todo[:0]
            break
        # a set of the pivot's component at distance d links to nothing outside of it that is farther than d + radius from the pivot
        todo = todo[other | (distance + rule.radius + 1e-9 >= distance[other].min())]
        todo = todo[todo != p]
    if len({union.find(i) for i in todo.tolist()}) > 1:
        for some in _by_rarest(sets, size, todo, rule):
            if len({union.find(i) for i in some.tolist()}) > 1:
                _count_all(sets, size, some, union, rule, block)
    return [union.find(i) for i in range(len(sets))]


def _shared_shingles(sets: list[np.ndarray], todo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles that at least two sets of todo have: number of the set and of the shingle (sorted by shingle), and how many sets have each."""
    flat = np.concatenate([sets[i] for i in todo])
    row = np.repeat(np.arange(len(todo)), [len(sets[i]) for i in todo])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    column = np.cumsum(np.concatenate(([True], flat[1:] != flat[:-1]))) - 1 if len(flat) else np.zeros(0, np.int64)
    often = np.bincount(column)[column] > 1 if len(flat) else np.zeros(0, bool)
    row, column = row[often], column[often]
    column = np.cumsum(np.concatenate(([True], column[1:] != column[:-1]))) - 1 if len(column) else column
    return row, column, np.bincount(column) if len(column) else np.zeros(0, np.int64)


def _by_rarest(sets: list[np.ndarray], size: np.ndarray, todo: np.ndarray, rule: Rule) -> list[np.ndarray]:
    """todo in parts that can't link to each other.

    With the shingles of all sets in one order, rarest first, linked sets share one of
    the first size - ceil(s * size) + 1 shingles of each. Unlike sets that only have
    common phrases in common fall apart.
    """
    row, column, n = _shared_shingles(sets, todo)
    order = np.lexsort((column, n[column], row)) if len(row) else row
    row, column = row[order], column[order]
    own = np.bincount(row, minlength=len(todo))
    begin = np.cumsum(own) - own
    prefix = size[todo] - -(-rule.num * size[todo] // rule.den) + 1 - (size[todo] - own)  # shingles of a single set come first
    early = np.arange(len(row)) - begin[row] < prefix[row]
    row, column = row[early], column[early]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    near = _Union(len(todo))
    same = column[1:] == column[:-1]
    for a, b in zip(row[:-1][same].tolist(), row[1:][same].tolist(), strict=True):
        near.join(a, b)
    roots = np.array([near.find(i) for i in range(len(todo))])
    order = np.argsort(roots, kind="stable")
    parts = np.split(todo[order], np.flatnonzero(np.diff(roots[order])) + 1)
    return [p for p in parts if len(p) > 1]


def _count_all(sets: list[np.ndarray], size: np.ndarray, todo: np.ndarray, union: _Union, rule: Rule, block: int) -> None:
    """Joins linked sets of todo by counting all intersections, as products of incidence blocks over shingles in at least two sets."""
    row, column, _ = _shared_shingles(sets, todo)
    if not len(column):
        return
    n, width, high = len(todo), 4096, 4096
    for top in range(0, n, block):
        for low in range(top, n, high):  # pairs with later sets
            common = np.zeros((min(block, n - top), min(high, n - low)), np.float32)
            for left in range(0, int(column[-1]) + 1, width):
                a, b = np.searchsorted(column, [left, left + width])
                parts = []
                for begin, count in ((top, len(common)), (low, common.shape[1])):
                    some = (row[a:b] >= begin) & (row[a:b] < begin + count)
                    part = np.zeros((count, width), np.float32)
                    part[row[a:b][some] - begin, column[a:b][some] - left] = 1
                    parts.append(part)
                common += parts[0] @ parts[1].T
            mine, theirs = size[todo[top : top + block]], size[todo[low : low + high]]
            for i, j in zip(*np.nonzero(rule.linked(common.astype(np.int64), mine[:, None], theirs[None, :])), strict=True):
                if top + i < low + j:
                    union.join(int(todo[top + i]), int(todo[low + j]))


# --- Spark -----------------------------------------------------------------------


def _pieces(batch: pa.RecordBatch, column: int, n: int) -> Iterator[tuple[int, Sets]]:
    for row, data, offsets in texts(batch.column(column)):
        yield row, Sets(data, offsets, n)


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Values as one list for each of len(ends) - 1 owners."""
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.view(np.int64)))


def _nodes(documents: DataFrame, rule: Rule, tables: Tables) -> DataFrame:
    """A stored row for each document: id, text_key, size, name, orphan, and for both rings the keys that may have a second member with the number that a linked set shares (no keys where there are fewer)."""
    spark = documents.sparkSession

    def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, sets in _pieces(batch, 0, rule.n):
            yield from (keys for keys, _, _ in region_keys(sets, rule)[0])

    # a key for each 40 stored bytes or so at a similarity of 0.9, twice as many at 0.8
    log2 = log2_for(int(estimated_bytes(documents) * rule.radius / 4))
    often = None if log2 is None else spark.sparkContext.broadcast(may_repeat(documents.select("text"), keys_of, log2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in _pieces(batch, 2, rule.n):
                found, orphan = region_keys(sets, rule)
                n = len(sets.size)
                columns = [batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.array(sets.size), sets.names(), pa.array(orphan)]
                for keys, docs, needed in found:
                    if often is not None:
                        some = often.value.may(keys)
                        keys, docs = keys[some], docs[some]
                        some = np.bincount(docs, minlength=n)[docs] >= needed[docs]
                        keys, docs = keys[some], docs[some]
                    columns += [_lists(keys, np.searchsorted(docs, np.arange(n + 1))), pa.array(needed)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "text_key", "size", "name", "orphan", "own", "own_needed", "next", "next_needed"])

    ddl = "id long, text_key long, size long, name binary, orphan boolean, own array<long>, own_needed long, next array<long>, next_needed long"
    return tables.stored(documents.select("id", "text_key", "text").mapInArrow(freed(run), ddl), "jaccard-nodes")


def _region_edges(nodes: DataFrame, tables: Tables) -> DataFrame:
    """Edges (a, b) that connect all sets that share enough regions to be linked.

    Linked sets share `needed` keys or more. With all keys in one order, the rarest
    first, they then share one that is left when each set drops its needed - 1 last.
    """
    # each set once: copies of one may be a third of all rows
    sets = tables.stored(nodes.where("size(own) + size(next) > 0").select("name", "own", "own_needed", "next", "next_needed").dropDuplicates(["name"]), "jaccard-keyed")
    both = F.array(F.struct(F.col("own").alias("keys"), F.col("own_needed").alias("needed"), F.lit(0).alias("ring")), F.struct(F.col("next").alias("keys"), F.col("next_needed").alias("needed"), F.lit(1).alias("ring")))
    keyed = sets.select("name", F.explode(both).alias("x")).select("name", "x.ring", "x.needed", F.explode("x.keys").alias("key"))
    # stored, here and below, so that both sides of a join are plain shuffles and Spark can split a hot region
    often = tables.stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "jaccard-often")
    own = keyed.join(often, "key").groupBy("name", "ring", "needed").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("keys")).where(F.size("keys") >= F.col("needed"))
    rarest = tables.stored(own.select("name", F.explode(F.slice("keys", 1, (F.size("keys") - F.col("needed") + 1).cast("int"))["key"]).alias("key")), "jaccard-rarest")
    first = tables.stored(rarest.groupBy("key").agg(F.min("name").alias("first"), F.max("name").alias("last")).where("first <> last").select("key", "first"), "jaccard-first")
    return rarest.join(first, "key").where("name <> first").select(F.col("name").alias("a"), F.col("first").alias("b"))


def _named_sets(documents: DataFrame, names: DataFrame, n: int, log2: int | None) -> DataFrame:
    """name, shingles (sorted as unsigned numbers) of the sets in `names`, and maybe of others; copies give several rows."""
    prefix = F.conv(F.hex(F.substring("name", 1, 8)), 16, -10).cast("long")
    wanted = None if log2 is None else documents.sparkSession.sparkContext.broadcast(members(names.select(prefix.alias("name")), "name", log2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _pieces(batch, 0, n):
                name = sets.names().to_pylist()
                near = wanted.value.may(np.array([int.from_bytes(x[:8]) if x else 0 for x in name], np.uint64)) if wanted is not None else np.ones(len(name), bool)
                some = {name[i]: i for i in np.flatnonzero(near & (sets.size > 0)).tolist()}
                own = [sets.shingles[sets.ends[i] : sets.ends[i + 1]] for i in some.values()]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in own])))
                yield pa.RecordBatch.from_arrays([pa.array(list(some), pa.binary()), _lists(np.concatenate(own) if own else np.zeros(0, np.uint64), ends)], names=["name", "shingles"])

    return documents.select("text").mapInArrow(freed(run), "name binary, shingles array<long>")


def _local(sets: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) inside clusters (cluster, name, shingles) that fit in memory: each set and its component's first set."""

    def joined(rows: pa.Table) -> pa.Table:
        column = rows.column("shingles").combine_chunks()
        ends, flat = np.asarray(column.offsets), np.asarray(column.values).view(np.uint64)
        # shingles are sorted as unsigned numbers already; a name may come from several tasks
        at = {name: flat[a:b] for name, a, b in zip(rows.column("name").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)}
        names = sorted(at)
        found = join_cluster([at[x] for x in names], rule)
        return pa.table([pa.array(names, pa.binary()), pa.array([names[i] for i in found], pa.binary())], names=["a", "b"])

    return sets.select("cluster", "name", "shingles").groupBy("cluster").applyInArrow(joined, "a binary, b binary")


#: A set farther than this from all pivots of its cluster goes to the region of far sets.
FAR = 0.5


def _large(sets: DataFrame, local: int, most_sets: int, tables: Tables) -> DataFrame:
    """cluster, sets, total (shingles) of the clusters that don't fit in one task."""
    return tables.stored(sets.groupBy("cluster").agg(F.count(F.lit(1)).alias("sets"), F.sum(F.size("shingles")).alias("total")).where((F.col("total") > local) | (F.col("sets") > most_sets)), "jaccard-large")


def _split(big: DataFrame, rule: Rule, pivots: int, round_: int, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """One Voronoi round over large clusters (cluster, name, shingles): links (a, b) to pivots, and the sets that go on, each in its regions.

    The rows that go on have cluster (the region), parent, name and shingles.
    """
    w = Window.partitionBy("cluster").orderBy("rank", "name")
    # stored, so that the join below has plain shuffles on both sides and a hot cluster can be split
    chosen = big.select("cluster", "name", F.xxhash64("name", F.lit(round_)).alias("rank")).withColumn("i", F.row_number().over(w)).where(F.col("i") <= pivots)
    chosen = tables.stored(chosen.select("cluster", "name").join(big, ["cluster", "name"]).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("name", "shingles"))).alias("pivots")), "jaccard-pivots")
    own = F.size("shingles")
    seen = F.transform("pivots", lambda p: F.struct(p["name"].alias("name"), F.size(p["shingles"]).alias("size"), F.size(F.array_intersect("shingles", p["shingles"])).alias("common")))
    measured = F.transform("seen", lambda p: F.struct(
        p["name"].alias("name"), (1 - p["common"] / (own + p["size"] - p["common"])).alias("distance"),
        (rule.den * p["common"].cast("long") >= rule.num * (own + p["size"] - p["common"]).cast("long")).alias("ball")))
    told = big.join(chosen, "cluster").select("cluster", "name", "shingles", seen.alias("seen")).select("cluster", "name", "shingles", measured.alias("seen"))
    told = tables.stored(told.withColumn("least", F.array_min(F.transform("seen", lambda p: p["distance"]))), "jaccard-measured")
    links = told.select("name", F.explode(F.filter("seen", lambda p: p["ball"] & (p["name"] != F.col("name")))).alias("p")).select(F.col("name").alias("a"), F.col("p.name").alias("b"))

    # a pivot was compared with its whole cluster, so it goes on in none of the regions
    rest = told.where(~F.exists("seen", lambda p: p["name"] == F.col("name")))
    window = 2 * rule.radius + 1e-9
    near = rest.where(F.col("least") <= FAR).select("cluster", "name", "shingles", F.explode(F.filter("seen", lambda p: p["distance"] <= F.col("least") + window)).alias("p")).select("cluster", "name", "shingles", F.col("p.name").alias("pivot"), "p.distance", "p.ball")
    outside = near.where("not ball").groupBy("cluster", "pivot").agg(F.min("distance").alias("outside"))
    # a set of the ball links to nothing outside of it that is farther than its own distance and the radius
    near = near.join(tables.stored(outside, "jaccard-outside"), ["cluster", "pivot"]).where(f"not ball or distance + {rule.radius + 1e-9!r} >= outside")
    far = rest.where(F.col("least") > FAR - rule.radius - 1e-9).withColumn("pivot", F.lit(b""))
    both = near.select("cluster", "pivot", "name", "shingles").union(far.select("cluster", "pivot", "name", "shingles"))
    return links, tables.stored(both.select(F.sha2(F.concat("cluster", "pivot"), 256).cast("binary").alias("cluster"), F.col("cluster").alias("parent"), "name", "shingles"), "jaccard-regions")


def _dealt(big: DataFrame, rule: Rule, local: int, most_sets: int) -> DataFrame:
    """Large clusters as groups of rings and pairs of hash blocks that fit: each set in as many groups as its ring has blocks."""
    first = _rings(rule)[0]
    size = F.size("shingles").cast("long")
    rings = [int(x) for x in first if x < 1 << 31]
    # the ring is found by counting the rings that begin at the size or before
    ring = F.size(F.filter(F.array(*map(F.lit, rings)), lambda x: x <= size)) - 1
    reaches = rule.den * size >= rule.num * F.element_at(F.array(*map(F.lit, rings)), F.least(F.col("ring") + 2, F.lit(len(rings))))
    in_rings = big.withColumn("ring", ring).withColumn("ring", F.explode(F.when(reaches, F.array("ring", F.col("ring") + 1)).otherwise(F.array("ring"))))
    blocks = in_rings.groupBy("cluster", "ring").agg(F.greatest(F.ceil(2.5 * F.sum(F.size("shingles")) / local), F.ceil(2.5 * F.count(F.lit(1)) / most_sets), F.lit(1)).alias("blocks"))
    own = F.pmod(F.xxhash64("name", F.lit("block")), F.col("blocks"))
    pair = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rows = in_rings.join(blocks, ["cluster", "ring"]).select("cluster", "ring", "name", "shingles", own.alias("own"), pair.alias("other"))
    return rows.select(F.sha2(F.concat_ws(":", F.hex("cluster"), "ring", F.least("own", "other"), F.greatest("own", "other")), 256).cast("binary").alias("cluster"), "name", "shingles")


def _cluster_links(sets: DataFrame, rule: Rule, local: int, most_sets: int, pivots: int, tables: Tables) -> list[DataFrame]:
    """Links (a, b) inside clusters (cluster, name, shingles; stored) of all sizes."""
    large = _large(sets, local, most_sets, tables)
    links, round_ = [_local(sets.join(large, "cluster", "left_anti"), rule)], 0
    big = sets
    while not large.isEmpty():
        big = tables.stored(big.select("cluster", "name", "shingles").join(large.select("cluster"), "cluster", "left_semi"), "jaccard-big")
        more, regions = _split(big, rule, pivots, round_, tables)
        links.append(more)
        # a cluster goes on by its regions where these are at most half of it each and half as much again together; else by blocks
        by_region = regions.groupBy("parent", "cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("shingles")).alias("t")).groupBy("parent").agg(F.max("n").alias("most_n"), F.sum("n").alias("n"), F.max("t").alias("most_t"), F.sum("t").alias("t"))
        shrunk = F.col("most_t") * 2 <= F.col("total"), F.col("most_n") * 2 <= F.col("sets"), F.col("t") * 2 <= F.col("total") * 3, F.col("n") * 2 <= F.col("sets") * 3
        fits = (F.col("most_t") <= local) & (F.col("most_n") <= most_sets)
        judged = tables.stored(by_region.join(large.withColumnRenamed("cluster", "parent"), "parent").select("parent", ((fits | (shrunk[0] & shrunk[1])) & shrunk[2] & shrunk[3]).alias("shrinks")), "jaccard-judged")
        tied = judged.where("not shrinks").select("parent")
        # what the round has connected already needn't go on: only sets that are still in a region do
        left = regions.join(tied, "parent", "left_semi").select(F.col("parent").alias("cluster"), "name").distinct().join(big, ["cluster", "name"])
        links.append(_local(_dealt(tables.stored(left, "jaccard-tied"), rule, local, most_sets), rule))
        big = regions.join(judged.where("shrinks").select("parent"), "parent", "left_semi").select("cluster", "name", "shingles")
        large = _large(big, local, most_sets, tables)
        links.append(_local(big.join(large, "cluster", "left_anti"), rule))
        round_ += 1
    return links


def _orphan_links(documents: DataFrame, nodes: DataFrame, rule: Rule, block: int = 256) -> DataFrame | None:
    """Links of sets with too many empty slices, found by comparing them, in blocks, with all sets."""
    spark = documents.sparkSession
    names = nodes.where("orphan").select("name").distinct()
    count = names.count()
    if not count:
        return None
    out = None
    blocks = -(-count // block)
    for b in range(blocks):
        some = names.where(F.pmod(F.xxhash64("name"), F.lit(blocks)) == b)
        sets = _named_sets(documents, some, rule.n, 19).join(some, "name", "left_semi").distinct().collect()
        known = spark.sparkContext.broadcast([(bytes(r["name"]), np.array(r["shingles"], np.int64).view(np.uint64)) for r in sets])

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, sets in _pieces(batch, 0, rule.n):
                    name, found = sets.names().to_pylist(), []
                    for other, s in known.value:
                        hit = (sets.size > 0) & rule.linked(_common(sets.shingles, sets.ends, s), sets.size, np.full(len(sets.size), len(s)))
                        found += [(name[i], other) for i in np.flatnonzero(hit).tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], names=["a", "b"])

        more = documents.select("text").mapInArrow(freed(run), "a binary, b binary").where("a <> b").distinct()
        out = more if out is None else out.union(more)
    return out


def jaccard_components(documents: DataFrame, *, id: str = "doc_id", text: str = "text", rule: Rule = Rule(), local: int = 8 << 20, most_sets: int = 512, pivots: int = 8) -> DataFrame:
    """One row per document: id, text_key (a hash of the text), size (of its set), name (of its set, null if empty), component (a name, null if empty), component_id (the smallest id reachable by links). id is a long."""
    spark = documents.sparkSession
    bounded_batches(spark)
    tables = Tables(spark)
    documents = documents.select(F.col(id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    nodes = _nodes(documents, rule, tables)
    clusters = tables.stored(components(_region_edges(nodes, tables), tables).withColumnsRenamed({"node": "name", "component": "cluster"}), "jaccard-clusters")

    sets = _named_sets(documents, clusters, rule.n, log2_for(estimated_bytes(documents) // 400))
    # copies of a set come from many tasks; the first of each is kept before its cluster is known
    sets = clusters.join(sets.groupBy("name").agg(F.first("shingles").alias("shingles")), "name").select("cluster", "name", "shingles")
    # each set once before the join: copies of one set may be a third of all rows
    sizes = nodes.select("name", "size").distinct().join(clusters, "name").groupBy("cluster").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("sets"))
    if sizes.where((F.col("total") > local) | (F.col("sets") > most_sets)).isEmpty():
        links = [_local(sets, rule)]
    else:
        links = _cluster_links(tables.stored(sets, "jaccard-sets"), rule, local, most_sets, pivots, tables)
    orphans = _orphan_links(documents, nodes, rule)
    if orphans is not None:
        links.append(orphans)
    if len(links) == 1:  # each cluster was joined in one task: its answer is final
        found = links[0].select(F.col("a").alias("name"), F.col("b").alias("component"))
    else:
        every = links[0]
        for x in links[1:]:
            every = every.union(x)
        found = components(every, tables).withColumnRenamed("node", "name")
    own = nodes.select("id", "text_key", "size", "name").join(found, "name", "left").withColumn("component", F.coalesce("component", "name"))
    own = stored(own, "jaccard-found")
    tables.drop()
    least = stored(own.where("name is not null").groupBy("component").agg(F.min("id").alias("component_id")), "jaccard-least")
    whole = own.where("name is not null").join(least, "component").select("id", "text_key", "size", "name", "component", "component_id")
    return whole.union(own.where("name is null").select("id", "text_key", "size", "name", "component", F.col("id").alias("component_id")))


def keep_one(documents: DataFrame, *, id: str = "doc_id", text: str = "text", rule: Rule = Rule(5, 80, 100), **how) -> DataFrame:
    """The rows of documents that stay when of each component only the one with the smallest id (nulls last) does.

    By default near duplicates: five-word shingles, a similarity of 0.8 or more. Rows
    equal in id and text are one document. A text without words is linked with nothing
    and stays.
    """
    found = jaccard_components(documents, id=id, text=text, rule=rule, **how)
    first = F.min(F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("text_key").alias("text_key")))
    kept = found.where("component is not null").groupBy("component").agg(first.alias("first")).select("first.id", "first.text_key").union(found.where("component is null").select("id", "text_key").distinct())
    k, d = stored(kept.select(F.col("id").alias("_id"), F.col("text_key").alias("_key")), "jaccard-kept").alias("_k"), documents.withColumn("_text_key", F.xxhash64(F.col(text))).alias("_d")
    rows = d.join(k, F.col(f"_d.{id}").cast("long").eqNullSafe(F.col("_k._id")) & (F.col("_d._text_key") == F.col("_k._key")), "left_semi")
    return rows.dropDuplicates([id, "_text_key"]).drop("_text_key")
