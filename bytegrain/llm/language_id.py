"""Language identification by rank-order profiles.

A profile is the list of the `top` most frequent character n-grams (1 to 3) of a
language's texts, most frequent first; a document's own list is compared with each
profile by out-of-place distance: the sum of rank differences, with the greatest
penalty for an n-gram that the profile lacks. The smallest distance wins.

N-grams are taken over lower-cased letters; a run of anything else is one boundary.
They are 63-bit codes of code points (21 bits each), so counting is sorting and no
alphabet is assumed. Ties of frequency go to the smaller code, ties of distance to
the language that sorts first.

Profiles are learned from at most `most_labelled` texts a language, those with the
smallest hashes of id and text: a stated bound, so the profiles are a few hundred
n-grams a language and are broadcast. Every text is classified in whole.

Defined results: a null text, and one without letters, is `und` with score 0; rows
with a null language are not learned from; with nothing to learn from every text is
`und`; rows equal in text get equal results; other columns are kept (a column with
the result's name is replaced).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from bytegrain.llm._shared import bounded_batches
from bytegrain.llm._words import freed

UNKNOWN = "und"
_BITS = np.uint64(21)


@functools.cache
def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else 0."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint32)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams (1 to 3) of a text and their counts, by code."""
    c = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    c = np.concatenate(([0], c, [0])).astype(np.uint64)
    c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]
    if len(c) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    two = (c[:-1] << _BITS) | c[1:]
    three = ((two[:-1] << _BITS) | c[2:])[c[1:-1] != 0]
    codes = np.concatenate((c[c != 0], two | np.uint64(1 << 63), three))
    codes.sort()
    at = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[at], np.diff(np.concatenate((at, [len(codes)])))


def ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The `top` most frequent codes, most frequent first."""
    if len(codes) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        some = counts >= least
        codes, counts = codes[some], counts[some]
    return codes[np.argsort(-counts, kind="stable")][:top]


class Profiles:
    def __init__(self, by_language: dict[str, list[int]], top: int):
        self.top, self.languages = top, sorted(by_language)
        self.codes = np.unique(np.array([c for codes in by_language.values() for c in codes], np.uint64))
        self.rank = np.full((len(self.languages), len(self.codes) + 1), -1, np.int64)
        for row, language in enumerate(self.languages):
            codes = np.array(by_language[language], np.uint64)
            self.rank[row, np.searchsorted(self.codes, codes)] = np.arange(len(codes))

    def classify(self, text: str | None) -> tuple[str, float]:
        """Language and score: 1 for equal lists, 0 where nothing agrees."""
        codes = ranked(*grams(text), self.top) if text else ()
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, codes)
        at[at == len(self.codes)] = 0
        at[self.codes[at] != codes] = len(self.codes)
        rank = self.rank[:, at]
        distance = np.where(rank >= 0, np.abs(rank - np.arange(len(codes))), self.top).sum(axis=1)
        best = int(distance.argmin())
        return self.languages[best], 1 - float(distance[best]) / (self.top * len(codes))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, gram, n: the n-grams of this partition's texts, summed by language."""
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            codes, counts = grams(text)
            if language in sums:
                codes, inverse = np.unique(np.concatenate((sums[language][0], codes)), return_inverse=True)
                counts = np.bincount(inverse, np.concatenate((sums[language][1], counts))).astype(np.int64)
            sums[language] = codes, counts
    for language, (codes, counts) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([language] * len(codes)), pa.array(codes.view(np.int64)), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])


def learn_profiles(documents: DataFrame, *, learn: Column, id: str = "doc_id", text: str = "text", lang: str = "lang", top: int = 300, most_labelled: int = 1000) -> Profiles:
    """Profiles from the rows where `learn` is true."""
    bounded_batches(documents.sparkSession)
    rows = documents.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.xxhash64(id, text).alias("key"), F.col(text).alias("text"))
    # a row a language is broadcast, as the profiles are;
    # a share of each language's rows by hash, twice as many as are wanted, so that no task meets all rows of a hot language
    share = F.shiftrightunsigned("key", 11) / F.lit(float(1 << 53))
    counts = rows.groupBy("lang").agg((2.0 * most_labelled / F.count(F.lit(1))).alias("most"))
    few = rows.select("lang", "key", share.alias("share")).join(F.broadcast(counts), "lang").where(F.col("share") < F.col("most"))
    w = Window.partitionBy("lang").orderBy("share")
    # a bounded list: most_labelled keys a language
    keys = few.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most_labelled).select("lang", "key").distinct()
    chosen = rows.join(F.broadcast(keys), ["lang", "key"], "left_semi").select("lang", "text")
    counts = chosen.mapInArrow(freed(_counted), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the code as an unsigned number: the sign bit first
    order = Window.partitionBy("lang").orderBy(F.desc("n"), (F.col("gram") < 0).cast("int"), "gram")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).orderBy("lang", "rank").collect()
    found: dict[str, list[int]] = {}
    for r in best:
        found.setdefault(r["lang"], []).append(r["gram"] & (1 << 64) - 1)
    return Profiles(found, top)


def identify(documents: DataFrame, profiles: Profiles, *, text: str = "text", into: str = "language") -> DataFrame:
    """documents with one struct column more: lang and score. It reads nothing but the text."""
    spark = documents.sparkSession
    bounded_batches(spark)
    documents = documents.drop(into)
    known, at = spark.sparkContext.broadcast(profiles), documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [known.value.classify(t) for t in batch.column(at).to_pylist()]
            found = pa.StructArray.from_arrays([pa.array([g for g, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=["lang", "score"])
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, into])

    result = T.StructType.fromDDL("lang string, score double")
    return documents.mapInArrow(freed(run), T.StructType([*documents.schema.fields, T.StructField(into, result)]))
