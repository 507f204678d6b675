"""Substring dedup: removes every word that lies in a window of `size` consecutive words whose words also start anywhere else.

Words are what lies between white space (space, tab to carriage return), unchanged.

1. Count-min prefilter. A window is represented by its anchor: the `gram`-word run
   inside it with the smallest hash. Equal windows have equal anchors at the same
   place, and an anchor serves about (size - gram) / 2 windows in a row, so counting
   anchor occurrences instead of windows costs a fourteenth and still never counts
   less than a window's own count. Each partition counts its anchors in a sketch;
   the merged sketch has a fixed size and is broadcast.
2. Exact grouping of the windows whose anchor may occur twice. All windows of one
   anchor occurrence form a stretch. Where an anchor has a single kind of stretch,
   one key stands for all its windows; where it has several (the ends of repeated
   passages), each window has its own key. Keys are 128 bits. Counts are aggregates
   with map-side combining; a semi-join finds the repeated stretches and windows.
3. The words they cover are cut from the texts, all judged on the input.

Where the input is too large for a sketch (see `log2_for`), every anchor goes to the
partition that owns its hash and is counted there; stretches of anchors with a single
kind are then repeated as a whole, and only texts with anchors of several kinds are
read again for their windows. Work and disk grow in proportion to the input.

No step collects a group: a passage in a third of all documents is one counter.

Defined results: a null or empty text has no words; a text of fewer than `size`
words keeps all; rows equal in id and text are copies of each other and lose what
they share; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytegrain.llm._shared import bounded_batches, estimated_bytes, stored
from bytegrain.llm._sketch import Twice, log2_for, may_repeat, members
from bytegrain.llm._words import U, Words, covered, freed, mixed, texts

_ANCHOR_SEED, _STRETCH_SEED = 0x51ED2701, 0x7F4A7C15
_PLACE = U((1 << 28) - 1)


class Stretches:
    """All windows of a piece, grouped by their anchors: anchor, key of the stretch, first window and number of windows."""

    def __init__(self, words: Words, size: int, gram: int):
        self.words, self.size = words, size
        first = words.windows(size)
        self.sums = words.sums(_STRETCH_SEED)
        if not len(first):
            self.anchor = self.key = np.zeros(0, np.uint64)
            self.first = self.count = np.zeros(0, np.int64)
            return
        at = np.arange(len(words) - gram + 1)
        grams = words.runs(words.sums(_ANCHOR_SEED), at, at + gram)
        least, width, span = (grams & ~_PLACE) | at.astype(np.uint64), 1, size - gram + 1
        while 2 * width <= span:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :]) if span > width else least
        place = (least[first] & _PLACE).astype(np.int64)
        new = np.concatenate(([True], (place[1:] != place[:-1]) | (first[1:] != first[:-1] + 1)))
        begins = np.flatnonzero(new)
        self.count = np.diff(np.concatenate((begins, [len(first)])))
        self.first = first[begins]
        self.anchor = grams[place[begins]]
        shape = (place[begins] - self.first).astype(np.uint64) * U(4096) + self.count.astype(np.uint64)
        self.key = mixed(words.runs(self.sums, self.first, self.first + self.count - 1 + size) ^ mixed(shape))

    def doc(self) -> np.ndarray:
        return self.words.doc[self.first]

    def windows(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the stretches `some`: each window's anchor, key and first word."""
        n = self.count[some]
        first = np.repeat(self.first[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(self.anchor[some], n), self.words.runs(self.sums, first, first + self.size), first


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _batch(names: list[str], *columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=names)


def _anchor_keys(size: int, gram: int):
    def keys_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, data, offsets in texts(batch.column(0)):
            yield Stretches(Words(data, offsets, "space", False), size, gram).anchor

    return keys_of


def _several(documents: DataFrame, repeated, size: int, gram: int, log2: int) -> Twice:
    """Anchors that may have more than one kind of stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in texts(batch.column(0)):
                s = Stretches(Words(data, offsets, "space", False), size, gram)
                some = repeated.value.may(s.anchor)
                yield _batch(["anchor", "key"], _signed(s.anchor[some]), _signed(s.key[some]))

    kinds = documents.select("text").mapInArrow(freed(run), "anchor long, key long").groupBy("anchor").agg(F.min("key").alias("a"), F.max("key").alias("b"))
    return members(kinds.where("a <> b"), "anchor", log2)


_KEYED = ["anchor", "key", "id", "text_key", "first", "windows"]
_KEYED_DDL = "anchor long, key long, id long, text_key long, first int, windows int"


def _keyed(documents: DataFrame, repeated, several, size: int, gram: int) -> DataFrame:
    """anchor, key, id, text_key, first (word in its document), windows: a row for each stretch or, where there are several kinds, for each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in texts(batch.column(2)):
                s = Stretches(Words(data, offsets, "space", False), size, gram)
                some = repeated.value.may(s.anchor)
                apart = some & several.value.may(s.anchor)
                whole = some & ~apart
                anchor, key, first = s.windows(np.flatnonzero(apart))
                first = np.concatenate((s.first[whole], first))
                doc = s.words.doc[first]
                at = pa.array(doc + row)
                yield _batch(
                    _KEYED, _signed(np.concatenate((s.anchor[whole], anchor))), _signed(np.concatenate((s.key[whole], key))), batch.column(0).take(at), batch.column(1).take(at),
                    pa.array((first - s.words.words_at[doc]).astype(np.int32)), pa.array(np.concatenate((s.count[whole], np.ones(len(anchor), np.int64))).astype(np.int32)),
                )

    return documents.select("id", "text_key", "text").mapInArrow(freed(run), _KEYED_DDL)


def _spans_by_sketch(documents: DataFrame, size: int, gram: int, log2: int) -> DataFrame:
    """id, text_key, first, windows: the repeated windows, by a sketch that is broadcast."""
    spark = documents.sparkSession
    repeated = spark.sparkContext.broadcast(may_repeat(documents.select("text"), _anchor_keys(size, gram), log2))
    several = spark.sparkContext.broadcast(_several(documents, repeated, size, gram, log2))
    return _repeated(_keyed(documents, repeated, several, size, gram))


def _repeated(keyed: DataFrame) -> DataFrame:
    # stored, so that the join's two sides are plain shuffles and Spark can split a hot passage
    again = stored(keyed.groupBy("anchor", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", "key"), "passages")
    return keyed.join(again, ["anchor", "key"], "left_semi").select("id", "text_key", "first", "windows")


def _spans_by_owner(documents: DataFrame, size: int, gram: int) -> DataFrame:
    """The same, with each anchor counted in the partition that owns its hash."""
    nothing = _Fixed(True), _Fixed(False)
    stretches = stored(_keyed(documents, *nothing, size, gram), "passages-stretches")
    kinds = stored(stretches.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).where("n > 1").select("anchor", (F.col("a") != F.col("b")).alias("several")), "passages-anchors")
    known = stretches.join(kinds, "anchor")
    apart = stored(known.where("several").groupBy("id", "text_key").agg(F.collect_set("first").alias("apart")), "passages-apart").alias("a")
    d = documents.alias("d")
    again = d.join(apart, F.col("d.id").eqNullSafe(F.col("a.id")) & (F.col("d.text_key") == F.col("a.text_key"))).select("d.id", "d.text_key", "d.text", "a.apart")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in texts(batch.column(2)):
                s = Stretches(Words(data, offsets, "space", False), size, gram)
                own = batch.column(3).slice(row, len(offsets) - 1)
                at = np.repeat(s.words.words_at[:-1], np.asarray(own.value_lengths())) + np.asarray(own.flatten(), dtype=np.int64)
                anchor, key, first = s.windows(np.flatnonzero(np.isin(s.first, at)))
                doc = s.words.doc[first]
                to = pa.array(doc + row)
                yield _batch(_KEYED, _signed(anchor), _signed(key), batch.column(0).take(to), batch.column(1).take(to), pa.array((first - s.words.words_at[doc]).astype(np.int32)), pa.array(np.ones(len(first), np.int32)))

    windows = again.mapInArrow(freed(run), _KEYED_DDL)
    return known.where("not several").select("id", "text_key", "first", "windows").union(_repeated(windows))


class _Fixed:
    """In a sketch's and its broadcast's place: all keys may repeat, or none."""

    def __init__(self, all_: bool):
        self.all, self.value = all_, self

    def may(self, keys: np.ndarray) -> np.ndarray:
        return np.full(len(keys), self.all)


def _cut(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """id, n_words, n_removed, kept_text from id, text and the repeated windows (a list of first, windows)."""
    spans = batch.column(2)
    for row, data, offsets in texts(batch.column(1)):
        words = Words(data, offsets, "space", False)
        own = spans.slice(row, len(offsets) - 1)
        found = own.flatten()
        n = np.asarray(own.value_lengths().fill_null(0))
        at = np.repeat(words.words_at[:-1], n)
        first = at + np.asarray(found.field("first"), dtype=np.int64)
        gone = covered(len(words), first, first + np.asarray(found.field("windows"), dtype=np.int64) - 1 + size)
        kept = np.flatnonzero(~gone)
        inside = covered(len(data), words.start[kept], words.end[kept])
        last = np.concatenate((words.doc[kept][1:] != words.doc[kept][:-1], [True])) if len(kept) else np.zeros(0, bool)
        between = words.end[kept][~last]
        data = data.copy()
        data[between] = 0x20
        inside[between] = True
        to = np.concatenate(([0], np.cumsum(inside)))[offsets].astype(np.int64)
        text = pa.LargeStringArray.from_buffers(len(to) - 1, pa.py_buffer(to.tobytes()), pa.py_buffer(data[inside].tobytes()))
        removed = np.bincount(words.doc[gone], minlength=len(offsets) - 1)
        yield _batch(["id", "n_words", "n_removed", "kept_text"], batch.column(0).slice(row, len(offsets) - 1), pa.array(words.n_words), pa.array(removed), text.cast(pa.string()))


def remove_passages(documents: DataFrame, *, id: str = "doc_id", text: str = "text", size: int = 35, gram: int = 8) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_text (the words that stay, joined by single spaces). id is a long."""
    if not 1 <= gram <= size < 4096:
        raise ValueError("gram is 1 to size words, size under 4096")
    bounded_batches(documents.sparkSession)
    documents = documents.select(F.col(id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    log2 = log2_for(estimated_bytes(documents) // 40)
    repeated = _spans_by_owner(documents, size, gram) if log2 is None else _spans_by_sketch(documents, size, gram, log2)
    spans = repeated.groupBy("id", "text_key").agg(F.collect_set(F.struct("first", "windows")).alias("spans")).alias("s")
    d = documents.alias("d")
    found = d.join(spans, F.col("d.id").eqNullSafe(F.col("s.id")) & (F.col("d.text_key") == F.col("s.text_key")), "left").select("d.id", "d.text", "s.spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _cut(batch, size)

    return found.mapInArrow(freed(run), "id long, n_words long, n_removed long, kept_text string")
