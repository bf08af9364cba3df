"""Document quality: counting rules, and a hashed n-gram likelihood ratio.

Words and pairs of neighbouring words are hashed into buckets. Two multinomials
over the buckets, one of trusted documents and one of the whole corpus, give
each bucket a log-ratio; a document's score is the mean over its n-grams.
Documents below ``threshold``, or outside the rules, are rejected.

Results for unusual rows: a null or empty text has no words and is rejected by
the rules. Rows are judged alike wherever their texts are equal. Without
trusted documents every score is zero and the rules alone decide. Extra columns
are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import SPACES, where_computed, words
from scrubline.staging import stage

BUCKETS = 1 << 14
WINDOW = 8


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more; windows are compared by 64-bit hash."""
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(F.slice(w, i + 1, window)))
    return F.when(n >= window, hashes).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: Column, window: int) -> Column:
    """Words that repeated windows cover."""
    ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _union(ranked, window)).otherwise(F.lit(0).cast("long"))


def _union(ranked: Column, window: int) -> Column:
    none = F.lit(None).cast("struct<h:bigint,i:int>")
    before = F.concat(F.array(none), F.slice(ranked, 1, F.size(ranked) - 1))
    after = F.concat(F.slice(ranked, 2, F.size(ranked)), F.array(none))
    same_before = F.zip_with(ranked, before, lambda x, y: F.when(x["h"] == y["h"], x["i"]))
    same_after = F.zip_with(ranked, after, lambda x, y: F.when(x["h"] == y["h"], x["i"]))
    places = F.array_sort(F.filter(F.zip_with(same_before, same_after, lambda x, y: F.coalesce(x, y)), lambda x: x.isNotNull()))
    zero = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(i - acc["last"], F.lit(window))).alias("n"))
    return F.aggregate(places, zero, step, lambda acc: acc["n"])


def counted(docs: DataFrame) -> DataFrame:
    """``row, words, text`` and the counts of the rules."""
    df = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).alias("text")).withColumn("words", words(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    df = df.withColumns({"windows": repeated_words(F.col("words")), "lines": lines})
    return df.select(
        "row", "words", F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("windows"), WINDOW).cast("long").alias("n_repeat_words"),
    )


def trusted_ids(labels: DataFrame, most: int) -> DataFrame:
    """At most ``most`` ids of documents labelled good, chosen by digest."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _slot(*parts: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")


def ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, most_trusted: int = 20_000, smoothing: float = 10.0) -> list[float]:
    """The log-ratio of every bucket, trusted against all documents; zero without trusted ones."""
    ids = F.broadcast(stage(trusted_ids(labels, most_trusted), "trusted").select("doc_id", F.lit(1).alias("trusted")))
    w = words(F.coalesce("text", F.lit("")))
    flat = docs.select("doc_id", "text").join(ids, "doc_id", "left").select("trusted", w.alias("w"))
    pairs = flat.select("trusted", F.explode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"))).alias("p"))
    slots = F.array(_slot(F.col("p.a"), buckets=buckets), F.when(F.col("p.b").isNotNull(), _slot(F.col("p.a"), F.col("p.b"), buckets=buckets)))
    grams = pairs.select("trusted", F.explode(slots).alias("slot")).where(F.col("slot").isNotNull())
    counts = grams.groupBy("slot").agg(F.count("*").alias("n"), F.count("trusted").alias("t"))
    found = counts.collect()  # a row per bucket at most
    n, t = sum(r.n for r in found), sum(r.t for r in found)
    weights = [0.0] * buckets
    for r in found if t else ():
        weights[r.slot] = math.log((r.t + smoothing) / (t + smoothing * buckets)) - math.log((r.n + smoothing) / (n + smoothing * buckets))
    return weights


def score(w: Column, weights: list[float]) -> Column:
    """Mean log-ratio of a document's words and pairs of words."""
    buckets, n = len(weights), F.size(w)
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in weights)), ",").cast("array<double>")  # folded to a constant
    weight = lambda *parts: F.get(table, _slot(*parts, buckets=buckets))
    each = F.zip_with(w, F.slice(w, 2, F.greatest(n, F.lit(1))), lambda a, b: weight(a) + F.when(b.isNull(), 0.0).otherwise(weight(a, b)))
    return F.when(n > 0, F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x) / (2 * n - 1)).otherwise(0.0)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = -0.1, least_words: int = 20, most_repeated: int = 30, **settings) -> DataFrame:
    """``row``, the counts, ``score``, ``base_failed``, ``kept``."""
    weights = ratios(docs, labels, **settings)
    out = counted(docs).withColumn("score", score(F.col("words"), weights)).drop("words")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def keep(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The documents that pass, with all their columns."""
    return where_computed(judge(docs, labels, **settings), F.col("kept")).select("row.*")
