"""The corpus pipeline: language ID, near-duplicate removal, decontamination, mixing, token files.

Each stage works on the rows its predecessor kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytegrain.llm._shared import stored
from bytegrain.llm.decontaminate import decontaminate
from bytegrain.llm.jaccard_join import keep_one
from bytegrain.llm.language_id import UNKNOWN, identify, learn_profiles
from bytegrain.llm.mixing import mix, mixed_documents, quality_domains
from bytegrain.llm.queries import held_out, tokenizer_path
from bytegrain.llm.token_files import read_token_files, write_token_files

#: A text whose n-gram list agrees less than this with every profile is in no learned language. Of held-out documents 0.04 % score less
#: (junk of one repeated word, capitals with marks between them, two languages in one text); the first percentile lies at 0.50 to 0.55.
LEAST_LANGUAGE_SCORE = 0.40
#: Target shares of good, poor and toxic text, at the tokens that there are: what is short is repeated, what is too much is thinned out by rates under 1.
WEIGHTS = [0.87, 0.07, 0.06]
#: Greatest miss of a target share that passes without a warning.
CLOSE = 0.01


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that docs don't have, so that a stage's own column replaces none of theirs."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that labelled documents teach."""
    profiles = learn_profiles(docs, learn=~F.coalesce(held_out(), F.lit(False)))
    into = _unused(docs, "language")
    found = F.col(into)
    return identify(docs, profiles, into=into).where((found["lang"] != UNKNOWN) & (found["score"] >= LEAST_LANGUAGE_SCORE)).drop(into)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, a similarity of 0.8 or more."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    into = _unused(docs, "contamination")
    return decontaminate(docs, benchmark, into=into).where(~F.col(into)["contaminated"]).drop(into)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate tells, for the target shares of the corpus's own tokens."""
    labels = quality_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    table, reached = mix(docs, labels, WEIGHTS)
    missed = max(abs(a - b) for a, b in zip(reached["totals"], reached["targets"], strict=True)) / (sum(reached["targets"]) or 1)
    if missed > CLOSE:
        warnings.warn(f"mixing misses a target share by {missed:.3f}: {reached}", stacklevel=2)
    return mixed_documents(docs, table)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the token files, read back."""
    return read_token_files(write_token_files(docs, tokenizer_path(), end=0)).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: Language ID, mixing and tokens can't be said in SQL; tests/llm/test_pipeline.py compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
