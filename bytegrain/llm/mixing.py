"""Mixing to target weights with soft memberships.

1. A labelled-table classifier: a multinomial naive Bayes over hashed words, its
   counts taken from at most `most_labelled` labelled documents (those with the
   smallest hashes; a stated bound, so they are broadcast), predicts for every
   document the posterior of each domain. A text's evidence is scaled down beyond
   `evidence` words, so long texts keep soft memberships.
2. Projected-gradient least squares finds document rates r >= least_rate for which
   the expected domain totals, sum r * tokens * posterior, match the targets. The
   squared residual is weighted by the inverse of M = sum tokens * p p' / tokens,
   in which the gradient of r is p' M^-1 (totals - targets) and a step of 1 is safe.
   An iterate is a function of the posterior and a short list of coefficient
   vectors, so an iteration is one aggregate of K sums over a stored table of a few
   numbers a document; nothing else reaches the driver.
3. copies: the whole part of the rate, and one more with the chance of the rest, by
   a hash of id and text: the same rows on every run.

Only DataFrame functions run over the data.

Defined results: a null or empty text has no tokens and the prior as its posterior,
from which its rate follows; a document without labels is only predicted; labels of
unknown documents are ignored, several labels of one document all count; rows equal
in id and text get equal results, one row each; with no labels all posteriors are
equal; other columns are not read. A domain that no document can supply stays short.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bytegrain.llm._shared import stored

SPACE_RUN = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def _slot(word: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(slots).cast("long")).cast("int")


def learn(documents: DataFrame, labels: DataFrame, domains: int, *, id: str = "doc_id", text: str = "text", domain: str = "domain", most_labelled: int = 20_000, slots: int = 1 << 17) -> tuple[DataFrame, list[float]]:
    """weights (slot, w0..: log-likelihoods above the mean of the domains) and log priors. labels: id, domain (0..domains-1)."""
    few = labels.where(F.col(domain).isNotNull() & F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(domain).cast("int").alias("domain")).orderBy(F.xxhash64(id), "id", "domain").limit(most_labelled)
    few = stored(few, "mixing-labels")
    labelled = documents.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(few), "id")
    seen = labelled.select("domain", F.explode(words_of(F.col("text"))).alias("word")).select("domain", _slot(F.col("word"), slots).alias("slot"))
    counts = [F.count(F.when(F.col("domain") == d, 1)) for d in range(domains)]
    table = stored(seen.groupBy("slot").agg(*(c.alias(f"n{d}") for d, c in enumerate(counts))), "mixing-counts")
    totals = table.agg(*(F.coalesce(F.sum(f"n{d}"), F.lit(0)) for d in range(domains))).first()
    share = few.groupBy("domain").count().collect()  # a row for each domain
    per = {r["domain"]: r["count"] for r in share}
    prior = [float(np.log((per.get(d, 0) + 1) / (sum(per.values()) + domains))) for d in range(domains)]
    alpha = 0.1
    logs = [F.log((F.col(f"n{d}") + alpha) / (totals[d] + alpha * slots)) for d in range(domains)]
    mean = sum(logs[1:], logs[0]) / domains
    return table.select("slot", *((x - mean).alias(f"w{d}") for d, x in enumerate(logs))), prior


def posteriors(documents: DataFrame, weights: DataFrame, prior: list[float], *, id: str = "doc_id", text: str = "text", evidence: int = 256, slots: int = 1 << 17) -> DataFrame:
    """id, key (a hash of the text), tokens, p (an array of the domains' posteriors): one row for each distinct id and text, with `rows`, how often it occurs."""
    k = len(prior)
    whole = documents.select(F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("key"), words_of(F.col(text)).alias("words"))
    words = whole.select("id", "key", F.posexplode_outer("words").alias("at", "word")).withColumn("slot", _slot(F.col("word"), slots))
    # a row that occurs several times adds up several times: sums and counts are divided by the number of its first words
    scored = words.join(F.broadcast(weights), "slot", "left").groupBy("id", "key").agg(
        F.greatest(F.count(F.when(F.coalesce("at", F.lit(0)) == 0, 1)), F.lit(1)).alias("rows"), F.count("word").alias("words"), *(F.coalesce(F.sum(f"w{d}"), F.lit(0.0)).alias(f"s{d}") for d in range(k)))
    tokens = F.floor(F.col("words") / F.col("rows"))
    scale = F.least(F.lit(1.0), F.lit(float(evidence)) / F.greatest(tokens, F.lit(1)))
    logits = [F.col(f"s{d}") / F.col("rows") * scale + prior[d] for d in range(k)]
    top = F.greatest(*logits) if k > 1 else logits[0]
    odds = F.array(*(F.exp(x - top) for x in logits))
    total = F.aggregate("odds", F.lit(0.0), lambda a, x: a + x)
    return scored.select("id", "key", "rows", tokens.cast("long").alias("tokens"), odds.alias("odds")).select("id", "key", "rows", "tokens", F.transform("odds", lambda x: x / total).alias("p"))


def rate_column(steps: list[list[float]], k: int, least_rate: float) -> Column:
    """The rate after projected steps from 1: r <- max(least_rate, r - p . step)."""
    if not steps:
        return F.greatest(F.lit(1.0), F.lit(float(least_rate)))
    dots = [sum((F.col("p")[d] * float(c) for d, c in enumerate(step[1:], 1)), F.col("p")[0] * float(step[0])) for step in steps]
    return F.aggregate(F.array(*dots), F.lit(1.0), lambda r, dot: F.greatest(r - dot, F.lit(float(least_rate))))


def fit(table: DataFrame, weights: list[float], *, least_rate: float = 0.0, total: float | None = None, rounds: int = 30, close: float = 1e-6) -> tuple[list[list[float]], dict]:
    """Steps for rate_column() and what they reach. table: rows, tokens, p. weights: the targets' shares.

    total: target of all tokens; None takes the corpus as it is, or with least_rate 1 the smallest total at which no domain shrinks.
    """
    k = len(weights)
    pair = [(i, j) for i in range(k) for j in range(i, k)]
    n = F.col("rows") * F.col("tokens")
    p = [F.col("p")[d] for d in range(k)]
    row = table.agg(F.coalesce(F.sum(n), F.lit(0)).cast("double"), *(F.coalesce(F.sum(n * p[i] * p[j]), F.lit(0.0)) for i, j in pair), *(F.coalesce(F.sum(n * p[d]), F.lit(0.0)) for d in range(k))).first()
    tokens = float(row[0])
    if not tokens:
        return [], {"totals": [0.0] * k, "targets": [0.0] * k, "rounds": 0}
    m = np.zeros((k, k))
    for value, (i, j) in zip(row[1:], pair, strict=False):
        m[i, j] = m[j, i] = value / tokens
    now = np.array(row[1 + len(pair) :]) / tokens
    share = np.array(weights, float) / sum(weights)
    if total is None:
        total = tokens * (max([1.0, *(now[share > 0] / share[share > 0])]) if least_rate >= 1 else 1.0)
    target = share * (total / tokens)
    inverse = np.linalg.pinv(m + 1e-9 * np.eye(k))
    steps: list[list[float]] = []
    if least_rate > 1:
        now = least_rate * now
    for _ in range(rounds):
        if np.abs(now - target).max() <= close * target.sum():
            break
        steps.append((inverse @ (now - target)).tolist())
        rate = rate_column(steps, k, least_rate)
        new = np.array(table.select(n.alias("n"), "p", rate.alias("r")).agg(*(F.sum(F.col("n") * F.col("r") * F.col("p")[d]) for d in range(k))).first(), float) / tokens
        still = np.abs(new - now).max() <= close * target.sum()
        now = new
        if still:
            break
    return steps, {"totals": (now * tokens).tolist(), "targets": (target * tokens).tolist(), "rounds": len(steps)}


def mix(documents: DataFrame, labels: DataFrame, weights: list[float], *, id: str = "doc_id", text: str = "text", least_rate: float = 0.0, total: float | None = None, **how) -> tuple[DataFrame, dict]:
    """id, key, rows, tokens, p, rate, copies for each distinct document, as a table that is stored; and the totals reached.

    labels: id, domain (0..len(weights)-1).
    """
    classifier, prior = learn(documents, labels, len(weights), id=id, text=text, **how)
    table = stored(posteriors(documents, stored(classifier, "mixing-weights"), prior, id=id, text=text), "mixing-posteriors")
    steps, reached = fit(table, weights, least_rate=least_rate, total=total)
    chance = F.pmod(F.xxhash64("id", "key", F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    whole = F.floor("rate")
    return table.withColumn("rate", rate_column(steps, len(weights), least_rate)).withColumn("copies", (whole + (chance < F.col("rate") - whole).cast("int")).cast("long")), reached


def mixed_documents(documents: DataFrame, table: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """documents, each row as often as mix()'s table has copies."""
    t = table.select(F.col("id").alias("_id"), F.col("key").alias("_key"), "copies").alias("_t")
    d = documents.alias("_d")
    both = d.join(t, F.col(f"_d.{id}").eqNullSafe(F.col("_t._id")) & (F.xxhash64(F.col(f"_d.{text}")) == F.col("_t._key")))
    return both.where(F.col("_t.copies") > 0).select(*(F.col(f"_d.`{c}`") for c in documents.columns), F.explode(F.sequence(F.lit(1).cast("long"), F.col("_t.copies"))).alias("_copy")).select(*(F.col(f"`{c}`") for c in documents.columns))


# --- quality domains from the labels table -----------------------------------------

#: Domains of quality_domains(), in order.
DOMAINS = ("good", "poor", "toxic")


def quality_domains(labels: DataFrame, *, id: str = "doc_id") -> DataFrame:
    """id, domain: toxic documents are one domain, of the others quality tells."""
    return labels.select(id, F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).when(F.col("quality") == 0, 1).alias("domain"))
