"""Quality rules, with DataFrame functions only.

Base figures of a text come first; then a likelihood ratio: words and word pairs are
hashed into ``buckets`` counters, once over a trusted target corpus and once over all
documents, and a document's score is the mean log ratio of the two smoothed
multinomials over its hashed n-grams. A document is kept when it fails no base rule
and its score reaches ``threshold``.

Words are runs of characters other than space and U+0009 to U+000D. Everything is
computed inside the row from arrays; only the counters (one row per bucket) and the
labels' join by id shuffle. The ratios form one array of ``buckets`` doubles.

Defined results. A null text counts as empty: all figures 0, score 0, not kept. Rows
are judged each for itself, so repeated rows get equal results. With no trusted rows
every score is 0. Result columns replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import col, free_name, with_result

BUCKETS = 1 << 16
WINDOW = 5
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def word_array(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), lambda w: w != "")


def once(x: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def repeated_words(hashes: Column, pairs: Column, width: int = WINDOW) -> Column:
    """Words covered by windows of ``width`` words that occur twice or more; from the hashes of words and pairs."""
    count = F.size(hashes) - width + 1
    # A window is hashed from the pairs side by side in it, and the last word if one is left.
    window = lambda i: [*[F.get(pairs, i + k) for k in range(0, width - 1, 2)], *[F.get(hashes, i + width - 1)] * (width % 2)]
    windows = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(*window(i)))

    def ordered(w: Column) -> Column:
        """Equal windows are neighbours in the sorted array."""
        return F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(a: Column) -> Column:
        again = F.filter(F.transform(a, lambda x, k: F.when((F.get(a, k - 1)["h"] == x["h"]) | (F.get(a, k + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull())
        return F.sort_array(again)

    def covered(a: Column) -> Column:
        return F.aggregate(F.transform(a, lambda i, k: F.least(F.lit(width), F.coalesce(F.get(a, k + 1) - i, F.lit(width)))), F.lit(0), lambda s, x: s + x)

    def in_windows(w: Column) -> Column:
        many = once(ordered(w), lambda a: once(places(a), covered))
        return F.when(F.size(F.array_distinct(w)) == count, 0).otherwise(many)

    return F.when(count < 2, 0).otherwise(once(windows, in_windows)).cast("long")


def word_hashes(text: Column) -> Column:
    """The words of a text by their hashes, in order; all later steps work on these."""
    return F.transform(word_array(F.coalesce(text, F.lit(""))), lambda w: F.xxhash64(w))


def pair_hashes(hashes: Column) -> Column:
    """Hashes of the neighbouring pairs, from the words' hashes."""
    most = F.greatest(F.size(hashes) - 1, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, most), F.slice(hashes, 2, most), lambda a, b: F.xxhash64(a, b))


def with_hashes(df: DataFrame, text_col: str) -> tuple[DataFrame, str, str]:
    """``df`` with the hashes of words and pairs, and these columns' names."""
    words, pairs = free_name(df, "_hashes"), free_name(df, "_pairs")
    out = df.select("*", word_hashes(col(df, text_col)).alias(words))
    return out.select("*", pair_hashes(F.col(words)).alias(pairs)), words, pairs


def base_figures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    held, words, pairs = with_hashes(df, text_col)
    return _figures(held, text_col, words, pairs).drop(words, pairs)


def _figures(held: DataFrame, text_col: str, words: str, pairs: str) -> DataFrame:
    text = F.coalesce(col(held, text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    chars = F.length(F.translate(text, SPACES, ""))
    out = with_result(held, n_words=F.size(F.col(words)).cast("long"), word_chars=chars.cast("long"),
                      n_symbols=(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
                      n_dup_lines=once(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
                      n_repeat_words=repeated_words(F.col(words), F.col(pairs)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return with_result(out, base_failed=failed)


def bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               buckets: int = BUCKETS, smoothing: float = 1.0) -> DataFrame:
    """One row: ``ratios``, an array of log(p_target / p_raw) by bucket.

    ``trusted`` names the target corpus by id. Counts cover all words of all documents.
    The list of names grows with the corpus, so it is never broadcast, at any size.
    """
    names = trusted.select(col(trusted, id_col).alias("_id")).where("_id IS NOT NULL").distinct().withColumn("_target", F.lit(1))
    held = docs.select(col(docs, id_col).alias("_id"), col(docs, text_col).alias("_text")).join(names.hint("merge"), "_id", "left")
    hashed, words, pairs = with_hashes(held, "_text")
    grams = hashed.select(F.coalesce("_target", F.lit(0)).alias("_target"), F.explode(F.concat(words, pairs)).alias("_h"))
    grams = grams.select("_target", bucket(F.col("_h"), buckets).alias("_b"))
    counted = grams.groupBy("_b").agg(F.count("*").alias("_raw"), F.sum("_target").alias("_hit"))
    # One row per bucket from here on.
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("_b"))
    full = every.join(counted, "_b", "left").select("_b", F.coalesce("_raw", F.lit(0)).alias("_raw"), F.coalesce("_hit", F.lit(0)).alias("_hit"))
    one = full.agg(F.sort_array(F.collect_list(F.struct("_b", "_raw", "_hit"))).alias("_all"), F.sum("_raw").alias("_r"), F.sum("_hit").alias("_t"))
    space = F.lit(float(buckets) * smoothing)
    ratio = lambda x: F.log((x["_hit"] + smoothing) / (F.col("_t") + space)) - F.log((x["_raw"] + smoothing) / (F.col("_r") + space))
    return one.select(F.when(F.col("_t") == 0, F.array_repeat(F.lit(0.0), buckets)).otherwise(F.transform("_all", ratio)).alias("ratios"))


def judge(docs: DataFrame, ratios: DataFrame, text_col: str = "text", buckets: int = BUCKETS, threshold: float = -0.25) -> DataFrame:
    """Adds the base figures, llr_score (mean log ratio) and kept."""
    hashed, words, pairs = with_hashes(docs, text_col)
    weights = free_name(hashed, "_weights")
    one = ratios.select(F.col("ratios").alias(weights))
    held = _figures(hashed, text_col, words, pairs).crossJoin(F.broadcast(one))  # a single row
    add = lambda s, h: s + F.get(F.col(weights), bucket(h, buckets))
    total = F.aggregate(F.col(pairs), F.aggregate(F.col(words), F.lit(0.0), add), add)
    n = F.greatest(2 * F.size(F.col(words)) - 1, F.lit(1))
    scored = with_result(held, llr_score=total / n).drop(weights, words, pairs)
    return with_result(scored, kept=~F.col("base_failed") & (F.col("llr_score") >= threshold))
