"""Removal of lines that stand on many sites.

A HyperLogLog sketch of the sites of each line, merged by aggregation,
estimates how many distinct sites carry it. Lines whose estimate lies near the
threshold are counted exactly; lines far below it stay and lines far above it
are boilerplate. The first occurrence of a boilerplate line stays, by smallest
document id, then digest of id and text, then place; all others go. Long lines are
passages rather than navigation, and are boilerplate on fewer sites already.
Lines that occur fewer times than they would need sites are never sent further.
Digests of such lines are broadcast where Spark's limit holds all of them, each once;
more of them meet the lines in a shuffle, and none of their copies pass the driver.

Results for unusual rows: a line without a word is never boilerplate; a null
text has no lines and stays null; a null site is a site of its own; a null
``doc_id`` comes last; rows with equal id and text are treated alike; an
empty table gives an empty table; texts of any length are read whole, one line at a
time. Extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import few, keyed, salted_join, where_computed
from scrubline.staging import stage

WORD = "[^ \\t-\\r]"


LONG_WORDS = 50  # a line of more words is long
LONG_SITES = 2  # sites on which a long line is boilerplate
DIGEST_BYTES = 24  # of a row of two digests as Spark holds it


def line_rows(rows: DataFrame, site: str, long_words: int = LONG_WORDS) -> DataFrame:
    """``k1, k2, doc_id, site, place, h1, h2, long``: one row per line with a word; lines go as digests, not as texts."""
    long = lambda line: (F.length(line) > 2 * long_words) & (F.regexp_count(line, F.lit(WORD + "+")) > long_words)
    lines = F.transform(
        F.split("row.text", "\n"),
        lambda line, i: F.when(
            line.rlike(WORD),
            F.struct(i.alias("place"), F.xxhash64(F.lit(1), line).alias("h1"), F.xxhash64(F.lit(2), line).alias("h2"), long(line).alias("long")),
        ),
    )
    flat = rows.select("k1", "k2", F.col("row.doc_id").alias("doc_id"), F.col(f"row.{site}").cast("string").alias("site"), F.explode(lines).alias("line"))
    return flat.where(F.col("line").isNotNull()).select("k1", "k2", "doc_id", F.coalesce("site", F.lit("\0")).alias("site"), "line.*")


def among(lines: DataFrame, digests: DataFrame, spread_by: list[str]) -> DataFrame:
    """The rows of ``lines`` with one of ``digests``, each of which a stage table holds once.

    Spark would judge a salted join by ``digests`` as stored, and broadcast the copies of each.
    """
    if few(digests, DIGEST_BYTES):
        return lines.join(F.broadcast(digests), ["h1", "h2"])
    return salted_join(lines.hint("merge"), digests, ["h1", "h2"], spread_by)


def spread_lines(lines: DataFrame, min_sites: int, log_k: int, sigmas: float, long_sites: int = LONG_SITES) -> DataFrame:
    """``h1, h2``: lines on ``min_sites`` or more distinct sites, long ones on ``long_sites`` or more."""
    margin = lambda sites: max(1.0, sigmas * 1.04 / 2 ** (log_k / 2) * sites)
    by_length = lambda f: F.when(F.col("long"), F.lit(f(long_sites))).otherwise(F.lit(f(min_sites)))
    sketches = lines.groupBy("h1", "h2", "long").agg(F.hll_sketch_agg("site", log_k).alias("sketch"), F.count("*").alias("seen"))
    least = by_length(lambda sites: sites)
    often = sketches.where(F.col("seen") >= least).select("h1", "h2", "long", F.hll_sketch_estimate("sketch").alias("sites"))
    about = stage(often.where(F.col("sites") >= by_length(lambda sites: sites - margin(sites))), "sites")
    far = F.col("sites") > by_length(lambda sites: sites + margin(sites))
    near = about.where(~far).select("h1", "h2")
    pairs = among(lines.select("h1", "h2", "long", "site", "k1"), near, ["k1"]).select("h1", "h2", "long", "site").distinct()
    exact = pairs.groupBy("h1", "h2", "long").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("h1", "h2")
    return exact.union(about.where(far).select("h1", "h2"))


def remove(
    docs: DataFrame, site: str = "source", min_sites: int = 5, log_k: int = 12, sigmas: float = 4.0,
    long_words: int = LONG_WORDS, long_sites: int = LONG_SITES,
) -> DataFrame:
    """``row, n_lines, n_removed, text``: every document with its text after removal.

    A line goes if it stands on ``min_sites`` sites, one of more than ``long_words`` words
    on ``long_sites`` sites. ``n_lines`` counts lines, ``n_removed`` those that went; line breaks
    between the lines that stay are kept.
    """
    rows = keyed(docs, docs["doc_id"], docs["text"])
    lines = stage(line_rows(rows, site, long_words), "lines")
    spread = stage(spread_lines(lines, min_sites, log_k, sigmas, long_sites), "spread")
    places = ["k1", "k2", "place"]
    found = stage(among(lines, spread, ["k1", "place"]).select("h1", "h2", "doc_id", *places).distinct(), "found")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *places)
    first = found.groupBy("h1", "h2").agg(F.min(order).alias("first")).select("first.k1", "first.k2", "first.place")
    gone = found.join(first, places, "left_anti").groupBy("k1", "k2").agg(F.collect_set("place").alias("gone"))
    text, out = F.col("row.text"), rows.join(gone, ["k1", "k2"], "left")
    out = out.withColumn("lines", F.split(text, "\n"))
    # what stays are the stretches between one place and the next
    out = out.withColumn("cuts", F.concat(F.array(F.lit(-1)), F.array_sort("gone"), F.array(F.size("lines"))))
    cut = lambda i: F.get("cuts", i)
    stretches = F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), lambda i: F.slice("lines", cut(i) + 2, cut(i + 1) - cut(i) - 1))
    return out.select(
        "row", F.when(text.isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.flatten(stretches), "\n")).alias("text"),
    )


def clean(docs: DataFrame, site: str = "source", min_sites: int = 5, long_words: int = LONG_WORDS, long_sites: int = LONG_SITES, emptied: str = "drop") -> DataFrame:
    """Documents with boilerplate lines removed; those that had words and have none left go.

    With ``emptied="keep"`` these stay as they were. ``n_chars`` is counted anew
    where the documents have it.
    """
    out = remove(docs, site, min_sites, long_words=long_words, long_sites=long_sites)
    whole = (F.col("n_removed") == 0) | F.col("text").rlike(WORD)
    if emptied == "drop":
        out, same = where_computed(out, whole), F.col("n_removed") == 0
    else:
        same = (F.col("n_removed") == 0) | ~whole
    new = {
        "text": F.when(same, F.col("row.text")).otherwise(F.col("text")),
        "n_chars": F.when(same, F.col("row.n_chars")).otherwise(F.length("text").cast("long")) if "n_chars" in docs.columns else None,
    }
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
