"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows, looked up from every training document.

Words are runs of ASCII digits, ASCII letters (A-Z lower-cased) and non-ASCII
characters. A benchmark item gives all its windows of `size` consecutive words;
an item with fewer words, but not none, is one window. Hash hits are verified
word by word.

The set is broadcast in blocks of at most `block_bytes` of benchmark text, so
what is broadcast at once has a fixed bound. One block needs no shuffle at all;
more blocks add one pass each, and a join of the (few) hits by document.

Defined results: a null or empty text has no words, no hits and is clean; a
null item text gives no window; an item with a null item_id hits words but has
no id to report; an item_id in several rows counts once; equal rows get equal
results, one row each.
"""

from __future__ import annotations

import functools
import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytegrain.llm._shared import bounded_batches, stored
from bytegrain.llm._words import Words, covered, freed, texts

RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<first: long, last: long>>, contaminated boolean"


class WindowSet:
    """Windows of some benchmark items: by length the sorted hashes, a bit table in front of them, and the words to verify."""

    BITS = 20

    def __init__(self, items: list[tuple[str | None, str]], size: int):
        self.owners: dict[tuple[int, int], dict[bytes, set[str | None]]] = defaultdict(lambda: defaultdict(set))
        row = 0
        names = [name for name, _ in items]
        for row, data, offsets in texts(pa.array([text for _, text in items], pa.large_string())):
            words = Words(data, offsets, "alnum", True)
            sums = words.sums()
            for i, (at, n) in enumerate(zip(words.words_at[:-1].tolist(), words.n_words.tolist(), strict=True)):
                length = min(n, size)
                first = np.arange(at, at + n - length + 1) if n else np.zeros(0, np.int64)
                for f, h in zip(first.tolist(), words.runs(sums, first, first + length).tolist(), strict=True):
                    self.owners[length, h][_spelled(words, f, length)].add(names[row + i])
        self.owners = {k: dict(v) for k, v in self.owners.items()}
        by_length: dict[int, list[int]] = defaultdict(list)
        for length, h in self.owners:
            by_length[length].append(h)
        self.hashes = {length: np.array(sorted(h), np.uint64) for length, h in sorted(by_length.items())}
        self.maybe = {}
        for length, h in self.hashes.items():
            self.maybe[length] = np.zeros(1 << self.BITS, bool)
            self.maybe[length][h >> np.uint64(64 - self.BITS)] = True

    def hits(self, words: Words) -> Iterator[tuple[int, int, set[str | None]]]:
        """First word, length and items of each occurrence of a window."""
        sums = words.sums()
        for length, known in self.hashes.items():
            first = words.windows(length)
            h = words.runs(sums, first, first + length)
            near = self.maybe[length][h >> np.uint64(64 - self.BITS)]
            first, h = first[near], h[near]
            at = np.searchsorted(known, h)
            same = known[np.minimum(at, len(known) - 1)] == h
            for f, x in zip(first[same].tolist(), h[same].tolist(), strict=True):
                owners = self.owners[length, x].get(_spelled(words, f, length))
                if owners:
                    yield f, length, owners


def _spelled(words: Words, first: int, n: int) -> bytes:
    return b" ".join(words.bytes_of(i).lower() for i in range(first, first + n))


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def judged(n_words: int, n_hit: int, share: int = 20) -> bool:
    """Contaminated: a hit, and at least one word in `share` is hit."""
    return n_hit > 0 and share * n_hit >= n_words


def _found(column: pa.Array, windows: WindowSet, share: int) -> Iterator[tuple[int, int, list[str], list[tuple[int, int]], bool]]:
    for _, data, offsets in texts(column):
        words = Words(data, offsets, "alnum", True)
        first, last, items = [], [], defaultdict(set)
        for f, n, owners in windows.hits(words):
            first.append(f)
            last.append(f + n)
            items[int(words.doc[f])] |= owners
        hit = covered(len(words), np.array(first, np.int64), np.array(last, np.int64))
        n_hit = np.bincount(words.doc[hit], minlength=len(words.n_words))
        for i, (n, k) in enumerate(zip(words.n_words.tolist(), n_hit.tolist(), strict=True)):
            spans = []
            if k:
                at = words.words_at[i]
                spans = list(zip(*(x.tolist() for x in _runs(hit[at : at + n])), strict=True))
            yield n, k, sorted(x for x in items.get(i, ()) if x is not None), spans, judged(n, k, share)


def _blocks(benchmark: DataFrame, item_id: str, text: str, size: int, block_bytes: int) -> Iterator[WindowSet]:
    """The benchmark in blocks of bounded text, fetched a block at a time; at least one."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    for i in range(n):
        yield WindowSet([tuple(r) for r in (rows.where(part == i) if n > 1 else rows).collect()], size)


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 13, share: int = 20, block_bytes: int = 8 << 20, into: str = "contamination") -> DataFrame:
    """documents with one struct column more, named `into` (RESULT): words, hit words, items, hit spans (words first..last-1), verdict.

    All other columns stay as they are; an existing column of that name is replaced.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    documents = documents.drop(into)
    blocks = _blocks(benchmark, item_id, item_text, size, block_bytes)
    result = T.StructType.fromDDL(RESULT)
    out = _with_struct(documents, text, spark.sparkContext.broadcast(next(blocks)), share, result, into)
    # further blocks: what a text is hit by depends on the text alone, so only hits are stored, by a hash of the text, and joined at the end
    whole = documents.select(F.sha2(F.col(text), 256).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    parts = []
    for block in blocks:
        found = _with_struct(whole, "text", spark.sparkContext.broadcast(block), share, result, "hit").where("hit.n_hit > 0").select("key", "hit.items", "hit.spans")
        parts.append(stored(found.dropDuplicates(["key"]), "decontaminate"))
    if not parts:
        return out
    # a text has at most one row a block here
    more = stored(functools.reduce(DataFrame.union, parts).groupBy("key").agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans")), "decontaminate").alias("_m")
    both = out.alias("_d").join(more, F.sha2(F.col(f"_d.`{text}`"), 256) == F.col("_m.key"), "left")
    own = F.col(f"_d.`{into}`")
    spans = F.array_sort(F.concat(own["spans"], F.coalesce("_m.spans", F.array().cast("array<struct<first:bigint,last:bigint>>"))))
    merged = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<first:bigint,last:bigint>>").alias("spans")),
        lambda a, s: F.when(
            s["first"] > F.coalesce(F.try_element_at(a["spans"], F.lit(-1))["last"], F.lit(-1)),
            F.struct((a["n"] + s["last"] - s["first"]).alias("n"), F.concat(a["spans"], F.array(s)).alias("spans")),
        ).otherwise(F.struct(
            (a["n"] + F.greatest(s["last"] - F.element_at(a["spans"], -1)["last"], F.lit(0))).alias("n"),
            F.concat(F.slice(a["spans"], 1, F.size(a["spans"]) - 1), F.array(F.struct(F.element_at(a["spans"], -1)["first"].alias("first"), F.greatest(s["last"], F.element_at(a["spans"], -1)["last"]).alias("last")))).alias("spans"),
        )),
    )
    items = F.array_sort(F.array_distinct(F.concat(own["items"], F.coalesce("_m.items", F.array().cast("array<string>")))))
    told = both.select(*(F.col(f"_d.`{c}`") for c in documents.columns), F.struct(own["n_words"].alias("n_words"), items.alias("items"), merged.alias("merged")).alias(into))
    hit = F.col(into)
    n, k = hit["n_words"], hit["merged"]["n"]
    return told.withColumn(into, F.struct(n.alias("n_words"), k.alias("n_hit"), hit["items"].alias("items"), hit["merged"]["spans"].alias("spans"), ((k > 0) & (share * k >= n)).alias("contaminated")))


def _with_struct(documents: DataFrame, text: str, windows: Broadcast, share: int, result: T.StructType, into: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [dict(n_words=n, n_hit=k, items=items, spans=[{"first": a, "last": b} for a, b in spans], contaminated=bad) for n, k, items, spans, bad in _found(batch.column(text_at), windows.value, share)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, into])

    text_at = documents.columns.index(text)
    return documents.mapInArrow(freed(run), T.StructType([*documents.schema.fields, T.StructField(into, result)]))


def remove_spans(documents: DataFrame, *, text: str = "text", into: str = "contamination") -> DataFrame:
    """documents with the hit words cut out of their texts (what stays is joined by single spaces), for callers that keep contaminated documents."""
    keep = F.filter(F.split(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")), " "), lambda w, i: ~F.exists(F.col(into)["spans"], lambda s: (s["first"] <= i) & (i < s["last"])))
    return documents.withColumn(text, F.when(F.size(F.col(into)["spans"]) > 0, F.array_join(keep, " ")).otherwise(F.col(text)))


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
