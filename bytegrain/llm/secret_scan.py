"""Secret scan: fixed base patterns, and probabilistic automata inferred from labelled credentials.

Base kinds (fixed patterns, see BASE) are always reported. The method learns the
format of credentials: labelled values of each kind build a prefix tree over
character classes with frequencies; states whose outgoing distributions are
compatible (Hoeffding bound, recursively) are merged, in the red-blue order of
state merging; the result is a probabilistic automaton for each kind. Every
candidate token of every text is scored by its log-likelihood a character under the
best automaton against a character model of ordinary tokens from the same texts
(words, numbers and names alike). Candidates are all runs of eight or more characters
of an assigned value's alphabet; those above the threshold become spans of the
automaton's kind.

Labels: the values found by the base patterns themselves in at most `most_labelled`
distinct texts (those with the smallest hashes), at most MOST_VALUES of each. This
sample is a stated bound; the scan covers all texts.

Defined results: a null or empty text has no spans; rows equal in text get equal
spans; other columns are kept as they are (a column with the result's name is
replaced). With no labels, only base spans are reported.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bytegrain.llm._shared import bounded_batches
from bytegrain.llm._words import freed

# The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
BASE = ("assign", "access", "hex")
#: An assignment can only be where one of these is, in lower case.
_WORDS = ("passw", "secret", "token", "apikey", "api_key")
#: The alphabet and the least length of an assigned value.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]+")
#: At most so many values, and so many ordinary tokens, are taken from one labelled text.
MOST_VALUES, MOST_WORDS = 64, 20


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind of the base spans, by start and then kind as listed."""
    found: list[tuple[int, int, str]] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], BASE.index(x[2])))


def values(text: str) -> list[tuple[str, str]]:
    """kind and value of the credentials in base spans: labelled examples."""
    found = []
    for start, end, kind in base_spans(text):
        span = text[start:end]
        found.append((kind, ASSIGN.match(span)[2] if kind == "assign" else span))
    return found


# --- automata ------------------------------------------------------------------

#: Symbols: hexadecimal digits apart from other letters, so that formats differ.
SYMBOLS = 7


def symbols(token: str) -> list[int]:
    return [0 if c.isdigit() else 1 if c in "abcdef" else 2 if c in "ABCDEF" else 3 if "a" <= c <= "z" else 4 if "A" <= c <= "Z" else 5 if c in "+/=" else 6 for c in token]


class Automaton:
    """A deterministic probabilistic automaton: to[state][symbol], chance of each symbol and of ending."""

    def __init__(self, words: list[list[int]], alpha: float = 0.05):
        self.to: list[dict[int, int]] = [{}]
        self.n: list[Counter] = [Counter()]
        self.end: list[int] = [0]
        for w in words:
            at = 0
            for s in w:
                self.n[at][s] += 1
                if s not in self.to[at]:
                    self.to.append({})
                    self.n.append(Counter())
                    self.end.append(0)
                    self.to[at][s] = len(self.to) - 1
                at = self.to[at][s]
            self.end[at] += 1
        self._merge(alpha)

    def _total(self, q: int) -> int:
        return self.end[q] + self.n[q].total()

    def _apart(self, a: int, na: int, b: int, nb: int, alpha: float) -> bool:
        return bool(na and nb) and abs(a / na - b / nb) > math.sqrt(0.5 * math.log(2 / alpha)) * (na**-0.5 + nb**-0.5)

    def _compatible(self, p: int, q: int, alpha: float) -> bool:
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            np_, nq = self._total(p), self._total(q)
            if self._apart(self.end[p], np_, self.end[q], nq, alpha) or any(self._apart(self.n[p][s], np_, self.n[q][s], nq, alpha) for s in range(SYMBOLS)):
                return False
            stack += [(self.to[p][s], self.to[q][s]) for s in self.to[p].keys() & self.to[q].keys() if self.to[p][s] != self.to[q][s]]
        return True

    def _fold(self, red: int, blue: int, parent: int, symbol: int) -> None:
        """Redirects blue's edge to red and adds blue's subtree to red's."""
        self.to[parent][symbol] = red
        stack = [(red, blue)]
        while stack:
            p, q = stack.pop()
            self.end[p] += self.end[q]
            self.n[p] += self.n[q]
            for s, child in self.to[q].items():
                if s in self.to[p]:
                    stack.append((self.to[p][s], child))
                else:
                    self.to[p][s] = child

    def _merge(self, alpha: float) -> None:
        red = [0]
        while True:
            known = set(red)
            blue = [(p, s, q) for p in red for s, q in sorted(self.to[p].items()) if q not in known]
            if not blue:
                return
            p, s, q = max(blue, key=lambda x: self._total(x[2]))
            for r in red:
                if self._compatible(r, q, alpha):
                    self._fold(r, q, p, s)
                    break
            else:
                red.append(q)

    def weights(self) -> tuple[list[list[int]], list[list[float]]]:
        """Transitions and log chances, smoothed; -1 is a state of unseen symbols, all of them unlikely."""
        number, order = {0: 0}, [0]
        for q in order:
            for child in self.to[q].values():
                if child not in number:
                    number[child] = len(order)
                    order.append(child)
        to = [[number[self.to[q][s]] if s in self.to[q] else -1 for s in range(SYMBOLS)] for q in order]
        chance = [[math.log((self.n[q][s] + 0.05) / (self._total(q) + 0.05 * (SYMBOLS + 1))) for s in range(SYMBOLS)] for q in order]
        return to, chance


class Formats:
    """An automaton for each kind, and a first-order character-class model of ordinary tokens."""

    UNSEEN = math.log(1e-3)

    def __init__(self, labelled: list[tuple[str, str]], words: list[str], least: float, alpha: float = 0.05):
        by_kind: dict[str, list[list[int]]] = defaultdict(list)
        for kind, value in sorted(set(labelled)):
            by_kind[kind].append(symbols(value))
        self.kinds = [(kind, *Automaton(w, alpha).weights()) for kind, w in sorted(by_kind.items())]
        pairs = [[1.0] * SYMBOLS for _ in range(SYMBOLS + 1)]
        for w in words:
            before = SYMBOLS
            for s in symbols(w):
                pairs[before][s] += 1
                before = s
        self.ordinary = [[math.log(x / sum(row)) for x in row] for row in pairs]
        self.least = least

    def score(self, token: str) -> tuple[float, str]:
        """The best kind's log-likelihood a character above that of ordinary words."""
        syms = symbols(token)
        base, before = 0.0, SYMBOLS
        for s in syms:
            base += self.ordinary[before][s]
            before = s
        best = (-math.inf, "")
        for kind, to, chance in self.kinds:
            at, total = 0, 0.0
            for s in syms:
                total += chance[at][s] if at >= 0 else self.UNSEEN
                at = to[at][s] if at >= 0 else -1
            best = max(best, ((total - base) / len(syms), kind))
        return best

    def spans(self, text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """Candidates that are likely credentials and touch no base span."""
        if not self.kinds:
            return []
        found, scored = [], {}
        for m in CANDIDATE.finditer(text):
            if any(a < m.end() and m.start() < b for a, b, _ in base):
                continue
            token = m[0]
            if token not in scored:
                scored[token] = self.score(token)
            score, kind = scored[token]
            if score >= self.least:
                found.append((m.start(), m.end(), f"like_{kind}"))
        return found


# --- Spark ---------------------------------------------------------------------

RESULT = "base array<struct<start: long, end: long, kind: string>>, spans array<struct<start: long, end: long, kind: string>>"


def ordinary(text: str) -> list[str]:
    """Tokens outside of base spans, those with the smallest hashes."""
    base = base_spans(text)
    found = {m[0] for m in TOKEN.finditer(text) if not any(a < m.end() and m.start() < b for a, b, _ in base)}
    return sorted(found, key=lambda w: (zlib.crc32(w.encode()), w))[:MOST_WORDS]


def learn_formats(documents: DataFrame, *, text: str = "text", most_labelled: int = 2000, least: float = 1.0, alpha: float = 0.05) -> Formats:
    """Formats from at most most_labelled distinct texts with base spans, those with the smallest hashes."""
    bounded_batches(documents.sparkSession)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order, found = [], []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if v := values(t):
                    order.append(key)
                    found.append([{"kind": k, "value": x} for k, x in v[:MOST_VALUES]] + [{"kind": "", "value": w} for w in ordinary(t)])
            yield pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())])))], names=["key", "found"])

    # the pattern is a cheap filter in the JVM for texts that may have a span
    near = documents.where(F.col(text).rlike(r"(?i)passw|secret|token|api_?key|AKIA|[0-9a-f]{32}")).select(F.xxhash64(text).alias("key"), F.col(text).alias("text"))
    # a share of them by hash, four times as many as are wanted, so that what reaches the driver doesn't grow with the input
    share = F.shiftrightunsigned("key", 11) / F.lit(float(1 << 53))
    many = near.agg(F.approx_count_distinct("key")).first()[0]
    some = near.where(share < 4.0 * most_labelled / max(many, 1)).dropDuplicates(["key"])
    rows = some.mapInArrow(freed(label), "key long, found array<struct<kind: string, value: string>>")
    got = [(x["kind"], x["value"]) for r in rows.orderBy("key").limit(most_labelled).collect() for x in r["found"]]
    return Formats([x for x in got if x[0]], sorted({v for k, v in got if not k}), least, alpha)


def secret_spans(documents: DataFrame, formats: Formats, *, text: str = "text", into: str = "secrets") -> DataFrame:
    """documents with one struct column more (RESULT): base spans, and all spans; offsets are code points, end exclusive."""
    spark = documents.sparkSession
    bounded_batches(spark)
    documents = documents.drop(into)
    known, at = spark.sparkContext.broadcast(formats), documents.columns.index(text)
    result = T.StructType.fromDDL(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(result)
        for batch in batches:
            rows = []
            for t in batch.column(at).to_pylist():
                base = base_spans(t or "")
                more = known.value.spans(t, base) if t else []
                both = sorted([*base, *more], key=lambda x: (x[0], (*BASE, x[2]).index(x[2]), x[2]))
                rows.append({n: [{"start": a, "end": b, "kind": k} for a, b, k in spans] for n, spans in (("base", base), ("spans", both))})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, into])

    return documents.mapInArrow(freed(run), T.StructType([*documents.schema.fields, T.StructField(into, result)]))
