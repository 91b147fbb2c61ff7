"""Quality rules: repetition counts and a hashed n-gram log-likelihood ratio, in native expressions.

Words are runs of anything but the six ASCII blanks.  Words and pairs of words
are hashed into ``buckets`` buckets.  One multinomial over the buckets is
counted from the trusted-target documents, one from the whole corpus; a
document's score is the sum of ``log(target / corpus)`` over its n-grams divided by
their number.  It is kept if it passes the base rules and its score reaches the
threshold.

The target is fitted on all documents labelled good.  The threshold is their mean
score less ``spread`` standard deviations, on a grid of 1/10000; for it each is
scored by counts of the half of them that it isn't in (halves by a hash of the
id), so that no document vouches for itself.  The corpus counts cover all
documents.  The fitted tables have one number for each bucket, whatever the
input, and are part of the scoring plan as constants (some 300 KB each for
32,768 buckets).

Everything is a DataFrame expression.  Counts of repeated windows are made in
the row, by hashing each window of eight words and sorting the hashes, so no
text and no window is ever shuffled.

Edge cases: null and empty texts have no words and fail the base rules; a
document without n-grams scores 0; without trusted documents all weights are 0
and the base rules alone decide; repeated rows are judged each; extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.scratch import materialize

BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def repeat_words(w: Column, width: int = 8) -> Column:
    """Words of ``w`` inside windows of ``width`` words that occur at least twice in it."""

    def covered(h: Column) -> Column:
        by_hash = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda k, j: F.coalesce(F.get(s, k)["h"] == F.get(s, j)["h"], F.lit(False))
            twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
            return F.array_sort(F.transform(twice, lambda k: F.get(s, k)["i"]))

        total = lambda p: F.aggregate(F.sequence(F.lit(1), F.size(p)), F.lit(0).cast("long"), lambda acc, j: acc + F.least(F.lit(width), F.coalesce(F.get(p, j) - F.get(p, j - 1), F.lit(width))))
        return let(let(by_hash, places), total)

    windows = F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))
    counted = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(w) > width, counted).otherwise(F.lit(0).cast("long"))


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.coalesce(let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0)).cast("long")


def gram_buckets(w: Column, buckets: int) -> Column:
    """Buckets of all words and pairs of neighbouring words."""
    mask = F.lit(buckets - 1).cast("long")  # a power of two
    ones = F.transform(w, lambda x: F.xxhash64(x).bitwiseAND(mask).cast("int"))
    twos = F.transform(w, lambda x, i: F.xxhash64(F.get(w, i - 1), x).bitwiseAND(mask).cast("int"))
    return F.concat(ones, F.slice(twos, 2, F.greatest(F.size(w) - 1, F.lit(0))))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """All ids labelled good, each with the half it is in."""
    ids = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("trusted_id")).distinct()
    return ids.withColumn("half", F.pmod(F.shiftright(F.xxhash64("trusted_id"), 7), F.lit(2)))


def with_half(docs: DataFrame, trusted: DataFrame, most: int = 2_000_000) -> DataFrame:
    """``docs`` with the ``half`` of trusted ones; up to ``most`` ids are broadcast, more are joined by a shuffle."""
    known = F.broadcast(trusted) if trusted.count() <= most else trusted
    return docs.join(known, F.col("doc_id") == F.col("trusted_id"), "left").drop("trusted_id")


def gram_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """(b, n, t0, t1): how often each bucket occurs in the corpus (doc_id, text, half) and in both halves of the trusted documents.

    At most ``buckets`` rows; partial counts are made before the shuffle.
    """
    grams = docs.select("half", F.explode(let(split_words(F.col("text")), lambda w: gram_buckets(w, buckets))).alias("b"))
    return grams.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("half") == 0).alias("t0"), F.count_if(F.col("half") == 1).alias("t1"))


def gram_weights(counts: DataFrame, buckets: int, smooth: float, goods: tuple[str, ...]) -> list[Column]:
    """The log ratio of each bucket as a constant array, for each count of good occurrences in ``goods``.

    The table of counts has at most ``buckets`` rows; it comes to the driver
    and goes into the plan as strings that the optimizer folds to arrays.
    """
    total = counts.agg(*[F.coalesce(F.sum(F.expr(x)), F.lit(0)).alias(f"v{i}") for i, x in enumerate(("n", *goods))]).first()
    every = counts.sparkSession.range(buckets).withColumnRenamed("id", "b").join(counts, "b", "left").na.fill(0)

    def ratio(i: int, good: str) -> Column:
        log = F.log((F.expr(good) + smooth) / (total[i] + smooth * buckets)) - F.log((F.col("n") + smooth) / (total.v0 + smooth * buckets))
        return F.round(log if total[i] else F.lit(0.0), 6).alias(f"v{i}")

    found = every.select("b", *[ratio(i, x) for i, x in enumerate(goods, 1)]).collect()
    tables = [[0.0] * buckets for _ in goods]
    for r in found:
        for table, v in zip(tables, r[1:]):
            table[r.b] = v
    return [F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>") for table in tables]


def likelihood_scores(w: Column, buckets: int, whole: Column, half: Column, others: tuple[Column, Column]) -> Column:
    """Mean log ratios of the n-grams of ``w``, 0 if there are none: ``score`` by the weights ``whole``, for trusted documents ``cross`` by those of the other half."""
    mean = lambda g, weights: F.aggregate(g, F.lit(0.0), lambda acc, b: acc + F.get(weights, b)) / F.greatest(F.size(g), F.lit(1))
    cross = lambda g: F.when(half == 0, mean(g, others[0])).when(half == 1, mean(g, others[1]))
    return let(gram_buckets(w, buckets), lambda g: F.struct(mean(g, whole).alias("score"), cross(g).alias("cross")))


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 15, smooth: float = 0.5, spread: float = 4.0) -> DataFrame:
    """One row for each document.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, score, threshold, kept.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = with_half(docs, materialize(trusted_ids(labels), "trusted"))
    counts = materialize(gram_counts(docs, buckets), "grams")
    whole, zero, one = gram_weights(counts, buckets, smooth, ("t0 + t1", "t0", "t1"))
    scores = lambda w: likelihood_scores(w, buckets, whole, F.col("half"), (one, zero))

    text = F.coalesce(F.col("text"), F.lit(""))
    judged = let(split_words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"), scores(w).alias("s")))
    out = docs.select(
        "doc_id",
        judged.alias("j"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        dup_lines(text).alias("n_dup_lines"),
    )
    out = out.select("doc_id", "j.n_words", "word_chars", "n_symbols", "n_dup_lines", "j.n_repeat_words", "j.s.score", "j.s.cross")
    out = materialize(out, "scored")
    spread_of = out.agg(F.avg("cross").alias("m"), F.stddev_pop("cross").alias("d")).first()
    threshold = math.floor(((spread_of.m or 0.0) - spread * (spread_of.d or 0.0)) * 10_000) / 10_000
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    out = out.withColumn("base_failed", failed).withColumn("threshold", F.lit(threshold))
    return out.drop("cross").withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.col("threshold")))
