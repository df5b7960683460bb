"""Quality rules: text statistics, and a length-normalised log-likelihood ratio of hashed n-grams.

Two multinomials over BUCKETS hashed n-grams are counted, one over all documents (the raw corpus) and one
over the trusted documents (the target). A document's score is the mean over its n-grams of
ln P(n-gram | target) - ln P(n-gram | raw), with add-one smoothing, and every document whose score is at
least the threshold passes. N-grams are words and pairs of the endings (last three characters) of words
that follow one another. All of it is SQL functions: one plan counts, and the table of log ratios, of
BUCKETS numbers whatever the corpus, is a constant of the scoring plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
SMOOTHING = 1.0
#: Clean text has a mean log ratio near 0; text whose words the trusted documents lack lies well below.
THRESHOLD = -0.25
WINDOW = 8
SYMBOLS = "#*$%&|<>"
_SPACE, _WORD = "[\\x20\\x09-\\x0D]+", "[^\\x20\\x09-\\x0D]"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPACE), "")


def _let(value: Column, body) -> Column:
    """body over a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _follow(a: Column, k: int) -> Column:
    """Hashes of each element of an array of hashes with the one k places on."""
    n = lambda v: F.greatest(F.size(v) - k, F.lit(0))
    return _let(a, lambda v: F.zip_with(F.slice(v, 1, n(v)), F.slice(v, 1 + k, n(v)), lambda x, y: F.xxhash64(x, y)))


def _hashes(words: str) -> list[Column]:
    """Columns `one`, the hash of each word, and `ends`, of its last three characters."""
    w = F.col(words)
    return [F.transform(w, lambda x: F.xxhash64(x)).alias("one"), F.transform(w, lambda x: F.xxhash64(F.right(x, F.lit(3)))).alias("ends")]


def _ngrams(one: str, ends: str) -> Column:
    """Bucket numbers of word unigrams and ending bigrams, from the columns of _hashes."""
    bucket = lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int")
    return F.concat(F.transform(one, bucket), F.transform(_follow(F.col(ends), 1), bucket))


def _ratios(counted: DataFrame) -> DataFrame:
    """One row: the array of BUCKETS log ratios, by bucket number."""
    spark = counted.sparkSession
    every = spark.range(0, BUCKETS, 1, 1).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(counted, "bucket", "left").select("bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("target", "raw")))
    one = full.agg(F.sort_array(F.collect_list(F.struct("bucket", "target", "raw"))).alias("x"), F.sum("target").alias("t"), F.sum("raw").alias("r"))
    smooth, total = F.lit(SMOOTHING), F.lit(SMOOTHING * BUCKETS)
    shift = F.ln((F.col("r") + total) / (F.col("t") + total))
    return one.select(F.transform("x", lambda x: F.ln((x["target"] + smooth) / (x["raw"] + smooth)) + shift).alias("ratios"))


def _repeated_words(windows: str) -> Column:
    """Words in windows of WINDOW words that are found twice or more, from the array of window hashes in text order."""
    h = F.col(windows)
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def starts(p: Column) -> Column:
        again = F.filter(p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def covered(s: Column) -> Column:
        steps = F.transform(s, lambda x, k: F.least(F.coalesce(F.get(s, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(_let(pairs, starts), covered))


def quality_rules(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), score, base_failed, kept.

    trusted has the ids of the target's documents in doc_id; repeated and null ids in it have no effect.
    A null text has no words and no lines. A text without words has score 0 (and base_failed). Rows of
    docs with one id are scored each on its own; without trusted rows all scores follow the raw counts
    alone, and rare n-grams count for more. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    target = trusted.select(F.col("doc_id").alias("target_id")).where("target_id is not null").distinct().withColumn("in_target", F.lit(1))
    # The trusted ids have no bound, so they are not broadcast, at any size; the texts are joined, as they are smaller than their n-grams.
    flagged = base.join(target.hint("merge"), F.col("doc_id") == F.col("target_id"), "left").select(F.coalesce("in_target", F.lit(0)).alias("in_target"), words_of(F.col("text")).alias("words"))
    # explode_outer: for explode, Catalyst infers a filter that splits the text anew inside the lambdas.
    grams = flagged.select("in_target", *_hashes("words")).select("in_target", F.explode_outer(_ngrams("one", "ends")).alias("bucket"))
    ratios = _ratios(grams.groupBy("bucket").agg(F.sum("in_target").alias("target"), F.count("*").alias("raw")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(_WORD))
    w = F.col("words")
    # Windows of 2, 4 and 8 words from those of half their size: slice() or eight lookups in a lambda cost more.
    windows = F.when(F.size("one") > WINDOW, _follow(_follow(_follow(F.col("one"), 1), 2), 4)).otherwise(F.expr("array(0L)"))
    staged = base.select("doc_id", "text", words_of(F.col("text")).alias("words")).select("doc_id", "text", "words", *_hashes("words")).select(
        "doc_id",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.when(F.col("text").rlike(f"[{SYMBOLS}]"), F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).otherwise(0).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        windows.alias("windows"),
        _ngrams("one", "ends").alias("grams"),
    )
    # The table is BUCKETS numbers, whatever the corpus. It is folded into one constant: as a column, or a scalar
    # subquery, which no lambda may hold, each row would carry a copy of it.
    table = F.split(F.lit(",".join(map(repr, ratios.first().ratios))), ",").cast("array<double>")
    total = F.aggregate("grams", F.lit(0.0), lambda a, g: a + F.get(table, g))
    return (
        staged.select(
            "doc_id", "n_words", "word_chars", "n_symbols",
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            _repeated_words("windows").alias("n_repeat_words"),
            F.when(F.size("grams") > 0, total / F.size("grams")).otherwise(F.lit(0.0)).alias("score"),
        )
        .withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    )
