"""URL filter: fixed rules first, else logistic regression on hashed character n-grams of host and path.

The model is trained from a small labelled URL table (at most `most_labelled` distinct
rows: those with the smallest hashes), such as urls labelled by words in their hosts, and has a fixed number of weights, which are
broadcast; every url is judged in one pass without a shuffle.

Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path:
what follows, up to `?`, `#` or the end. A rule `verdict host path` fits its host
and all its subdomains if the path starts with the rule's path; the longest wins.

Defined results: a null url, and one without `://`, has an empty host and path and
no rule; a model trained on nothing, or on one class, allows or follows that class;
equal urls get equal results, one row each; other columns are kept (a column with
the result's name is replaced).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytegrain.llm._shared import bounded_batches
from bytegrain.llm._words import freed

# Verdict, host, path.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: str | None) -> tuple[str, str]:
    """Host and path."""
    m = _PARTS.search(url or "")
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def rule_for(host: str, path: str, rules: list[tuple[str, str, str]] = RULES) -> tuple[str, str] | None:
    """The longest rule that fits, as host and path together, and its verdict."""
    fits = [(h + p, verdict) for verdict, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=None)


def features(host: str, path: str, size: int, lengths: tuple[int, ...] = (3, 4)) -> np.ndarray:
    """Slots of the distinct character n-grams; host and path are told apart."""
    found = set()
    for mark, s in (("h", f"^{host}$"), ("p", f"^{path}$")):
        found |= {mark + s[i : i + n] for n in lengths for i in range(max(1, len(s) - n + 1))}
    return np.unique(np.array([zlib.crc32(x.encode("utf-8", "replace")) % size for x in found], np.int64))


class Model:
    """Weights and bias; chance() is the chance of `block`."""

    def __init__(self, rows: list[tuple[str, str, int]], size: int = 1 << 16, rounds: int = 60, rate: float = 0.5, decay: float = 1e-4):
        self.size, self.weights, self.bias = size, np.zeros(size), -1.0
        if not rows:
            return
        rows = sorted(rows)
        slots = [features(h, p, size) for h, p, _ in rows]
        y = np.array([label for _, _, label in rows], float)
        flat, n = np.concatenate(slots), np.array([len(s) for s in slots])
        row, value = np.repeat(np.arange(len(rows)), n), 1 / np.sqrt(np.repeat(n, n))
        squares = np.full(size, 1e-8)
        for _ in range(rounds):
            chance = 1 / (1 + np.exp(-(np.bincount(row, self.weights[flat] * value, len(rows)) + self.bias)))
            error = chance - y
            gradient = np.bincount(flat, error[row] * value, size) / len(rows) + decay * self.weights
            squares += gradient**2
            self.weights -= rate * gradient / np.sqrt(squares)
            self.bias -= rate * error.mean()

    def chance(self, host: str, path: str) -> float:
        s = features(host, path, self.size)
        return float(1 / (1 + np.exp(-(self.weights[s].sum() / np.sqrt(len(s)) + self.bias))))


def train(labelled: DataFrame, *, url: str = "url", label: str = "label", most_labelled: int = 5000, size: int = 1 << 16) -> Model:
    """labelled: urls and labels (1 is block); rows with a null label are left out, and repeated ones count once. Trained on the driver from at most most_labelled rows, half of them of each label."""
    rows = labelled.where(F.col(label).isNotNull()).select(F.col(url).alias("url"), (F.col(label) > 0).cast("int").alias("label"))
    # a share by hash, twice as many as are wanted, so that what reaches the driver doesn't grow with the table
    share = F.shiftrightunsigned(F.xxhash64("url"), 11) / F.lit(float(1 << 53))
    many = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.approx_count_distinct("url").alias("n")).collect()}
    chosen = []
    for y in (0, 1):
        some = rows.where((F.col("label") == y) & (share < float(most_labelled) / max(many.get(y, 1), 1))).distinct()
        chosen += some.orderBy(F.xxhash64("url"), "url").limit(most_labelled // 2).collect()
    return Model([(*parts(r["url"]), r["label"]) for r in chosen], size)


RESULT = "host string, path string, rule string, verdict string, score double"


def filter_urls(pages: DataFrame, model: Model, *, url: str = "url", rules: list[tuple[str, str, str]] = RULES, threshold: float = 0.5, into: str = "url_filter") -> DataFrame:
    """pages with one struct column more (RESULT): verdict is allow or block, score the model's chance of block."""
    spark = pages.sparkSession
    bounded_batches(spark)
    pages = pages.drop(into)
    known, at = spark.sparkContext.broadcast(model), pages.columns.index(url)
    result = T.StructType.fromDDL(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for u in batch.column(at).to_pylist():
                host, path = parts(u)
                fits, score = rule_for(host, path, rules), known.value.chance(host, path)
                rows.append((host, path, fits and fits[0], fits[1] if fits else "block" if score >= threshold else "allow", score))
            columns = zip(*rows, strict=True) if rows else [[]] * len(result)
            found = pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, [pa.string()] * 4 + [pa.float64()], strict=True)], names=result.names)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, into])

    return pages.mapInArrow(freed(run), T.StructType([*pages.schema.fields, T.StructField(into, result)]))


# Words in names of hosts that serve no text worth keeping.
BAD_WORDS = ("ads", "adult", "bet", "bets", "casino", "click", "crack", "malware", "phish", "pills", "poker", "porn", "spam", "track", "tracker", "warez", "xxx")


def labelled_by_words(pages: DataFrame, *, url: str = "url", words: tuple[str, ...] = BAD_WORDS) -> DataFrame:
    """url, label: a url with one of the words in its host's name, as letters between other characters, is labelled block, another with a host allow.

    The model learns n-grams of such names, paths and what goes with them, and judges hosts that spell them in other ways.
    """
    host = F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1))
    bad = F.arrays_overlap(F.split(host, "[^a-z]+"), F.array(*map(F.lit, words)))
    return pages.where(host != "").select(F.col(url).alias("url"), bad.cast("int").alias("label"))


def labelled_urls(spark) -> DataFrame:
    """A small labelled table: advertising, tracking, download and gambling addresses against articles and reference pages."""
    bad_hosts = ["ads.{0}.example.biz", "track{0}.example.click", "casino-{0}.example.win", "free-download{0}.example.top", "xxx{0}.example.cam", "pharma-{0}.example.shop"]
    bad_paths = ["/banner/{0}.gif", "/click/{0}", "/bonus/spin/{0}", "/crack/setup{0}.exe", "/pics/adult/{0}", "/cheap-pills/{0}"]
    good_hosts = ["news{0}.example.org", "www.library{0}.example.edu", "docs.example{0}.org", "blog.{0}.example.net", "example{0}.com", "m.town{0}.example.net"]
    good_paths = ["/article/{0}", "/wiki/page_{0}", "/manual/{0}.html", "/post/{0}/", "/en/{0}", "/de/{0}"]
    rows = [(f"https://{h.format(i)}{p.format(i * 37 % 1000)}", label) for label, hosts, paths in ((1, bad_hosts, bad_paths), (0, good_hosts, good_paths)) for i in range(20) for h in hosts for p in paths]
    return spark.createDataFrame(rows, "url string, label int")
