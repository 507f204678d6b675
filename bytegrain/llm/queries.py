"""The registered queries of this package: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytegrain.llm.decontaminate import decontaminate
from bytegrain.llm.exact_dedup import exact_dedup
from bytegrain.llm.jaccard_join import jaccard_components
from bytegrain.llm.language_id import identify, learn_profiles
from bytegrain.llm.license_scan import TEMPLATES, license_scan
from bytegrain.llm.mixing import mix, quality_domains
from bytegrain.llm.passages import remove_passages
from bytegrain.llm.secret_scan import learn_formats, secret_spans
from bytegrain.llm.token_files import read_token_files, write_token_files
from bytegrain.llm.url_filter import RULES, filter_urls, labelled_by_words, labelled_urls, train
from bytegrain.plans.queries import crc32_sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates that bring good, poor and toxic text to 90, 8 and 2 per cent of the tokens, at the corpus's own total."""
    table, _ = mix(_table(spark, sf_dir, "documents"), quality_domains(_table(spark, sf_dir, "labels")), [0.90, 0.08, 0.02])
    p = [F.round(F.col("p")[d], 9).alias(f"p_{name}") for d, name in enumerate(("good", "poor", "toxic"))]
    return table.select(F.col("id").alias("doc_id"), "tokens", *p, F.round("rate", 6).alias("rate"), "copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("_row")).drop("_row")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_spans(documents, learn_formats(documents))
    base, spans = F.col("secrets")["base"], F.col("secrets")["spans"]

    def told(s):
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(told(base), 256).alias("base_sha256"), told(spans).alias("spans"))


def op3_remove_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_passages(_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    f = F.col("url_filter")
    return filter_urls(pages, train(labelled_urls(spark).unionByName(labelled_by_words(pages)))).select("page_id", *(f[n].alias(n) for n in ("host", "path", "rule", "verdict", "score")))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark")
    c = F.col("contamination")
    return decontaminate(documents, benchmark).select(
        "doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), c["contaminated"].alias("contaminated"),
    )


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), "component_id")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def held_out():
    """Documents that language identification is tested on: never learned from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = F.coalesce(held_out(), F.lit(False))
    profiles = learn_profiles(documents, learn=~out)
    return identify(documents.select("doc_id", "text"), profiles).select("doc_id", out.alias("held_out"), F.col("language")["lang"].alias("lang_pred"), F.col("language")["score"].alias("score"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"), digest=True).withColumnsRenamed({"id": "doc_id", "sha256": "text_sha256"})


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(_table(spark, sf_dir, "documents"), tokenizer_path(), end=0)
    return read_token_files(files).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


# --- parts of the results that SQL can say -----------------------------------------


def mixing_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1's token counts, and that a document's posteriors add up to 1."""
    p = sum(F.col(f"p_{n}") for n in ("good", "poor", "toxic"))
    return op1_mixing(spark, sf_dir).select("doc_id", "tokens", (F.abs(p - 1) < 1e-6).alias("adds_up"), ((F.col("copies") == F.floor("rate")) | (F.col("copies") == F.floor("rate") + 1)).alias("copies_fit"))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4's hosts, paths and rules, and the verdict where a rule gives it."""
    return op4_url_filter(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


def license_base_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def language_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8's held-out rows, and which texts have no language."""
    return op8_language_id(spark, sf_dir).select("doc_id", "held_out", (F.col("lang_pred") == "und").alias("undetermined"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_secret_scan": op2_secret_scan,
    "op3_remove_passages": op3_remove_passages,
    "op4_url_filter": op4_url_filter,
    "op5_decontaminate": op5_decontaminate,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_license_scan": op7_license_scan,
    "op8_language_id": op8_language_id,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_token_files": op10_token_files,
    "mixing_tokens": mixing_tokens,
    "secret_base_spans": secret_base_spans,
    "url_rules": url_rules,
    "license_base_phrases": license_base_phrases,
    "language_folds": language_folds,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?"""
_SECRETS = {"assign": (_ASSIGN + "[A-Za-z0-9+/_.=-]+", f"length(regexp_extract(m, '{_ASSIGN.replace("'", "''")}([A-Za-z0-9+/_.=-]+)', 1)) >= 8"), "access": ("AKIA[A-Z0-9]+", "length(m) >= 16"), "hex": ("[0-9a-f]+", "length(m) >= 32")}


def _secret_sql() -> str:
    """Matches of a kind in order, each placed after the pieces between them."""
    parts = []
    for order, (kind, (pattern, keep)) in enumerate(_SECRETS.items()):
        quoted = pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, '{kind}' AS kind, {order} AS ord, s, s + length(m) AS e FROM (
  SELECT doc_id, m, CAST(sum(length(piece)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
  FROM (SELECT doc_id, unnest(range(len(found))) AS i, unnest(found) AS m, unnest(pieces[1:len(found)]) AS piece
        FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{quoted}') AS found, regexp_split_to_array(coalesce(text, ''), '{quoted}') AS pieces FROM documents))
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE {keep}""")
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{k}') AS BIGINT) AS n_{k}" for k in _SECRETS)
    return f"""WITH x AS ({" UNION ALL ".join(parts)}),
g AS (SELECT doc_id, {counts}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS told FROM x GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in _SECRETS)}, sha256(coalesce(told, '')) AS base_sha256 FROM documents d LEFT JOIN g USING (doc_id)"""


def _rules_sql() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return rf"""WITH u AS (SELECT page_id, translate(regexp_extract(url, '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(verdict, h, p) AS (VALUES {rules}),
best AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS rule_verdict FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, rule_verdict FROM u LEFT JOIN best USING (page_id)"""


def _base_licence_sql() -> str:
    phrases = ", ".join(f"(['{"', '".join(p.split())}'], '{label}')" for p, label, base in TEMPLATES if base)
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
t(phrase, label) AS (VALUES {phrases}),
h AS (SELECT doc_id, s - 1 AS s, label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM d), t WHERE w[s] = phrase[1] AND w[s:s + len(phrase) - 1] = phrase),
g AS (SELECT doc_id, count(*) AS n, min(s) AS a, max(s) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(b AS BIGINT) AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN g USING (doc_id)"""


ORACLE_SQL: dict[str, str] = {
    "mixing_tokens": r"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens, true AS adds_up, true AS copies_fit FROM documents",
    "secret_base_spans": _secret_sql(),
    "url_rules": _rules_sql(),
    "license_base_phrases": _base_licence_sql(),
    "language_folds": rf"SELECT doc_id, ({crc32_sql("hex(encode(CAST(doc_id AS VARCHAR)))")}) % 4 = 2 AS held_out, NOT regexp_matches(coalesce(text, ''), '\p{{L}}') AS undetermined FROM documents",
    "op3_remove_passages": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, sha256(array_to_string(w[s:s + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
rep AS (SELECT doc_id, s FROM win JOIN (SELECT h FROM win GROUP BY h HAVING count(*) > 1) USING (h)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM rep),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op5_decontaminate": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win
       FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM (SELECT item_id, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0))),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, ns WHERE len(w) >= n)),
h AS (SELECT doc_id, n, s, item_id FROM dw JOIN bw USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op6_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + n - 1], ' ') AS g
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT doc_id, w, least(len(w), 3) AS n FROM d WHERE len(w) > 0))),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * i >= 90 * (ca.n + cb.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN c USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) m USING (doc_id)""",
    "op9_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)""",
}
