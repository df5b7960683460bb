"""The queries opN_<name> that apply each operator to its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import decontamination, hmm_scoring, html_extract, language_id, minhash_dedup, mixing, pii, quality_classifier, quality_rules, suffix_dedup
from fathomline.llm._common import fraction_hash, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fraction_hash() % 3 == 1, F.lit(False))
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return quality_classifier.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixed(docs, mixing.Target(entropy=0.95, repeats=4.0)).drop("text")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), trusted)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), shingle_words=5, similarity=0.8).drop("text")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=400, words=50)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fraction_hash() % 5 == 0, F.lit(False))
    model = language_id.fit(docs, ~held_out)
    return language_id.identified(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op10_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scoring.language_model_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), fraction_hash() % 5 == 1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_mixing": op2_mixing,
    "op3_quality_rules": op3_quality_rules,
    "op4_decontamination": op4_decontamination,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_pii": op6_pii,
    "op7_html_extract": op7_html_extract,
    "op8_language_id": op8_language_id,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_hmm_scoring": op10_hmm_scoring,
}

#: Removed runs from the starts of repeated 400-byte windows; what is left of the hexadecimal text between them is hashed. Shared passages from windows of 51 words.
OP5_SQL = r"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS MATERIALIZED (SELECT r, doc_id, hex(b) AS x, octet_length(b) AS n FROM t),
w AS MATERIALIZED (SELECT r, p, md5_number(substr(x, 2 * p + 1, 800)) AS k FROM (SELECT r, x, unnest(range(n - 399)) AS p FROM h WHERE n >= 400)),
again AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
s AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM w WHERE k IN (SELECT k FROM again)),
g AS (SELECT r, p, sum(CASE WHEN before IS NULL OR p > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS run FROM s),
runs AS (SELECT r, run, min(p) AS a, max(p) + 400 AS z FROM g GROUP BY r, run),
cuts AS (SELECT r, run, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY run), 0) AS y FROM runs),
kept AS (SELECT r, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS tail, string_agg(substr(x, 2 * y + 1, 2 * (a - y)), '' ORDER BY run) AS x FROM cuts JOIN h USING (r) GROUP BY r),
v AS MATERIALIZED (SELECT r, list_filter(string_split_regex(decode(b), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM t),
q AS MATERIALIZED (SELECT r, p, md5_number(array_to_string(l[p:p + 50], ' ')) AS k FROM (SELECT r, l, unnest(range(1, len(l) - 49)) AS p FROM v WHERE len(l) > 50)),
both_rows AS (SELECT k FROM q GROUP BY k HAVING min(r) < max(r)),
u AS (SELECT r, least(51, coalesce(lead(p) OVER (PARTITION BY r ORDER BY p) - p, 51)) AS step FROM q WHERE k IN (SELECT k FROM both_rows)),
common AS (SELECT r, CAST(sum(step) AS BIGINT) AS n_shared_words FROM u GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN tail IS NULL THEN h.x ELSE kept.x || substr(h.x, 2 * tail + 1) END)) AS kept_sha256,
  coalesce(n_shared_words, 0) AS n_shared_words, n_shared_words IS NOT NULL AS shares_passage
FROM h LEFT JOIN kept USING (r) LEFT JOIN common USING (r)
"""
#: All pairs that share a shingle, by a join on shingles, and the closure of the links.
OP9_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS g FROM d),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 80 * (p.n + q.n - i)),
both_ways AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
least AS (SELECT x AS doc_id, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(least.y, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(least.y, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""

# The others rest on hashed models, sketches or keyed permutations that DuckDB has no functions for, or on
# a parser; tests/llm holds them to brute force, inversion or held-out accuracy.
ORACLES: dict[str, str] = {"op5_suffix_dedup": OP5_SQL, "op9_minhash_dedup": OP9_SQL}
