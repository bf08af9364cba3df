"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has one bit for each bit of the shingles' hashes that is set in
over half of them. Two fingerprints at ``radius`` or fewer differing bits meet
in a variant that lies within half the radius of both: every distinct
fingerprint emits its variants, a shuffle brings equal variants together, and
neighbours among the colliding fingerprints are compared.

Results for unusual rows: a null or empty text has no words and gets
fingerprint zero, linked like any other. Repeated rows each get a result row
and share a group. A null ``doc_id`` never names a group unless all of its
members have none. Extra columns are ignored by :func:`groups` and kept by
:func:`keep_one`. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubline.llm.common import keyed, salted_join, utf8
from scrubline.staging import stage

BITS = 64
CHUNK = 1 << 16


def fingerprint(text: bytes, width: int, seed: int = 42) -> int:
    """SimHash of one text: shingles of ``width`` lower-cased words, repeats included."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    a, b = starts[:n].tolist(), ends[width - 1 :].tolist()
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        hashes = np.array([xxh64_intdigest(joined[i:j], seed) for i, j in zip(a[at : at + CHUNK], b[at : at + CHUNK])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return reduce(or_, (1 << i for i in range(BITS) if 2 * counts[i] > n), 0)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of 64-bit hashes; 0 of none."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return reduce(or_, (1 << i for i in range(BITS) if 2 * counts[i] > len(hashes)), 0)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, k1, k2, fp``: a row per document; ``(k1, k2)`` is a digest of id and text, ``fp`` signed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width) for t in utf8(batch.column("text"))], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "k1", "k2")], pa.array(fps)], ["doc_id", "k1", "k2", "fp"])

    rows = keyed(docs.select("doc_id", "text"), docs["doc_id"], docs["text"]).select("row.*", "k1", "k2")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, k1 long, k2 long, fp long")


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """``a, b``: links that join all distinct fingerprints at ``radius`` or fewer differing bits.

    ``radius`` is even. All fingerprints that meet in a variant lie within
    ``radius`` of each other, so linking each to the next one joins them all;
    a variant is met by at most as many fingerprints as it has variants itself.
    """
    if radius % 2 or not 0 <= radius <= 4:
        raise ValueError("radius must be 0, 2 or 4")
    masks = [sum(1 << i for i in c) for k in range(radius // 2 + 1) for c in combinations(range(BITS), k)]
    signed = ",".join(str(m - (1 << BITS) if m >> (BITS - 1) else m) for m in masks)
    mask = F.split(F.lit(signed), ",").cast("array<bigint>")
    near = fps.select("fp", F.explode(mask).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    met = near.select("fp", F.lag("fp").over(Window.partitionBy("variant").orderBy("fp")).alias("other"))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    return met.where(F.col("other").isNotNull() & (apart <= radius)).select(F.col("other").alias("a"), F.col("fp").alias("b")).distinct()


def components(edges: DataFrame, hubs: bool = False) -> DataFrame:
    """``node, label``: the smallest node reachable from each node of ``edges (a, b)``.

    Each round takes the smallest label among a node and its neighbours,
    passes it on to all nodes of the same label, and follows labels one step.
    Rounds go on until nothing changes; each is written, so lineage stays
    short. Joins on labels are salted, as one group may hold most nodes; those on
    nodes only with ``hubs``, where one node may have most links.
    """
    both = stage(edges.union(edges.select("b", "a")), "links")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        ends = labels.withColumnRenamed("node", "b")
        met = salted_join(both, ends, ["b"], ["a"]) if hubs else both.join(ends, "b")
        low = met.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        near = labels.join(low, "node").select("node", "label", F.least("label", "low").alias("low"))
        least = near.groupBy("label").agg(F.min("low").alias("least"))
        hooked = stage(
            salted_join(near, least, ["label"], ["node"]).select("node", "label", F.least("low", "least").alias("next")), "hooked"
        )
        ends = hooked.select(F.col("next").alias("node")).distinct().join(hooked.select("node", F.col("next").alias("end")), "node")
        ends = ends.withColumnRenamed("node", "next")
        moved = stage(
            salted_join(hooked, ends, ["next"], ["node"]).select("node", F.least("next", "end").alias("new"), "label"), "moved"
        )
        labels = moved.select("node", F.col("new").alias("label"))
        if moved.where(F.col("new") != F.col("label")).isEmpty():
            return labels


def groups(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id, k1, k2, fp, component_id, head``: near-duplicate groups.

    ``component_id`` is the smallest ``doc_id`` of the group; ``head`` is the
    ``(k1, k2)`` of the document that stands for the group, the one with the
    smallest id, then digest.
    """
    rows = stage(fingerprints(docs, width), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    fps = stage(rows.groupBy("fp").agg(F.min(order).alias("first")), "fps")
    labels = components(links(fps.select("fp"), radius))
    tied = fps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    tied = stage(tied, "tied")
    heads = tied.groupBy("label").agg(F.min("first").alias("head"))
    named = salted_join(tied.select("fp", "label"), heads, ["label"], ["fp"]).select("fp", "head")
    return salted_join(rows, stage(named, "named"), ["fp"], ["k1", "k2"]).select(
        "doc_id", "k1", "k2", "fp", F.col("head.doc_id").alias("component_id"), F.struct("head.k1", "head.k2").alias("head")
    )


def keep_one(docs: DataFrame, width: int = 5, radius: int = 2) -> DataFrame:
    """One document of each group, with all its columns."""
    heads = groups(docs, width, radius).select("head.k1", "head.k2").distinct()
    rows = keyed(docs, docs["doc_id"], docs["text"])
    return rows.join(heads, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("row.*")
