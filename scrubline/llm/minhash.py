"""Near-duplicates by the Jaccard similarity of their shingles.

Documents with equal shingle sets are one node. Each node has a SimHash
fingerprint of its shingles; nodes whose fingerprints differ in two bits or fewer
meet by ball hashing (:mod:`scrubline.llm.simhash`) and are joined if their sets are
alike. A similarity of 0.8 leaves more bits than that, so the search goes on
with a MinHash value for every band of ``ROWS`` hash functions; nodes of different groups
that share a band's value are candidates. Large groups of near copies are joined first, by rounds in which every
node is compared with one lead; what is still apart is found by prefix filtering,
so neither a group of copies nor a template that many unlike texts share is
compared pair by pair. All pairs are judged by their exact sets, as arrays of
digests.

At a similarity of 0.8 a pair shares no band with probability
``(1 - 0.8 ** ROWS) ** BANDS``, 0.003; at 0.9, 1e-8. All other steps are
exact but for digests of 64 bits that stand for shingles and nodes.

Results for unusual rows: texts without a word are copies of each other; a text
of ``width`` words or fewer is one shingle. Very long texts are read whole; their
digests take eight bytes a word. Repeated rows are one node. A null ``doc_id`` stands for a group
only if all of its members have none. Extra columns are kept. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubline.llm import simhash
from scrubline.llm.common import in_groups, keyed, salted_join, stage_and_free, utf8
from scrubline.llm.katz import mix
from scrubline.llm.simhash import components
from scrubline.staging import stage

BANDS, ROWS = 32, 8
FLOOR = 0.8  # a set of less than this share of another's size is no candidate of a star
CHUNK = 1 << 10
SKETCH = 512  # bits of a set's sketch
PAIRS = 256  # pairs of one node that a task compares with one copy of its set
_DRAWN = np.random.default_rng(42).integers(0, 1 << 32, (2, BANDS * ROWS, 1), np.uint32)
_TIMES, _PLUS = _DRAWN[0] | np.uint32(1), _DRAWN[1]


def shingles(text: bytes, width: int) -> np.ndarray:
    """Digests of the distinct shingles of ``width`` lower-cased words, in order."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    each = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    width = max(1, min(width, len(words)))
    n = max(0, len(words) - width + 1)
    out = each[:n]
    for k in range(1, width):
        out = mix(out, each[k : k + n])
    return np.unique(out)


def band_keys(digests: np.ndarray) -> np.ndarray:
    """For each band a key of the smallest values of its hash functions."""
    x = (digests >> np.uint64(32)).astype(np.uint32)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), CHUNK):
        low = np.minimum(low, (_TIMES * x[at : at + CHUNK] + _PLUS).min(axis=1))
    out = np.arange(BANDS, dtype=np.uint64)
    for row in low.reshape(BANDS, ROWS).T:
        out = mix(out, row.astype(np.uint64))
    return out


def nodes(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, k1, k2, node, n, fp, bands``: a row per document; ``node`` is a digest of its ``n`` shingles, ``fp`` their fingerprint."""
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_groups(batches):
            found = [shingles(t, width) for t in utf8(batch.column("text"))]
            node = np.array([xxh64_intdigest(x.tobytes()) for x in found], np.uint64).astype(np.int64)
            fps = np.array([simhash.majority(x) for x in found], np.uint64).astype(np.int64)
            bands = np.array([band_keys(x) for x in found], np.uint64).reshape(-1).astype(np.int64)
            ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * BANDS)
            columns = [*[batch.column(c) for c in ("doc_id", "k1", "k2")], pa.array(node), pa.array([len(x) for x in found], pa.int64()), pa.array(fps), pa.ListArray.from_arrays(ends, pa.array(bands))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "k1", "k2", "node", "n", "fp", "bands"])

    rows = keyed(docs.select("doc_id", "text"), docs["doc_id"], docs["text"]).select("row.*", "k1", "k2")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, k1 long, k2 long, node long, n long, fp long, bands array<long>")


def digest_sets(texts: DataFrame, width: int) -> DataFrame:
    """``node, set, bits`` of each text in ``texts`` (``node``, ``text``).

    ``set`` holds the sorted digests of its shingles. ``bits`` says of each of
    ``SKETCH`` classes of digests whether their number is odd: two sets that differ in
    ``k`` bits differ in ``k`` digests or more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_groups(batches):
            found = [shingles(t, width).astype(np.int64) for t in utf8(batch.column("text"))]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
            odd = [np.bincount(x & (SKETCH - 1), minlength=SKETCH) & 1 for x in found]
            packed = np.packbits(np.array(odd, np.uint8).reshape(-1, SKETCH), axis=1).view(np.int64)
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * packed.shape[1]), pa.array(packed.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), column, bits], ["node", "set", "bits"])

    return texts.select("node", "text").mapInArrow(run, "node long, set array<long>, bits array<long>")


def with_sets(pairs: DataFrame, side: str, sets: DataFrame) -> DataFrame:
    """``pairs`` with the set of their node ``side``; a node's set is copied once per ``PAIRS`` pairs that it is in."""
    counts = pairs.groupBy(side).agg(F.ceil(F.count("*") / PAIRS).alias("parts"))
    placed = salted_join(pairs, counts, [side], ["a", "b"]).withColumn("part", F.pmod(F.xxhash64("a", "b"), F.col("parts"))).drop("parts")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    own = sets.select(F.col("node").alias(side), F.col("set").alias(f"set_{side}")).join(counts, side)
    return placed.join(own.select(side, f"set_{side}", copies), [side, "part"]).drop("part")


def alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``a, b, linked``: whether the sets of ``a`` and ``b`` have a similarity of ``least`` or more."""
    both = with_sets(with_sets(pairs, "a", sets), "b", sets)
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.select("a", "b", (shared / (F.size("set_a") + F.size("set_b") - shared) >= F.lit(least)).alias("linked"))


def by_fingerprint(sets: DataFrame, radius: int) -> DataFrame:
    """``a, b``: nodes of equal fingerprints, and of fingerprints that meet within ``radius`` bits.

    One node stands for each fingerprint; the others of that fingerprint are paired with it.
    """
    fps = stage(sets.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("held")), "fps")
    met = stage_and_free(simhash.links(fps.select("fp"), radius), "met")
    for side in ("a", "b"):
        met = met.join(fps.select(F.col("fp").alias(side), F.col("head").alias(f"head_{side}")), side)
    equal = salted_join(sets.select("node", "fp"), fps.where("held > 1").select("fp", "head"), ["fp"], ["node"])
    return equal.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).union(met.select("head_a", "head_b"))


def stars(members: DataFrame, turn: int) -> DataFrame:
    """``a, b``: for each node one node of another group, the lead of one of its bands.

    First the lead is the node whose bands are the most crowded, which lies in
    the middle of its near copies; later it is drawn anew in each turn.
    """
    rank = F.struct(F.col("crowd") if turn == 0 else F.xxhash64(F.lit(turn), "band", "node"), "node", "n", "label")
    leads = members.groupBy("band").agg(F.max(rank).alias("lead"))
    met = salted_join(members, leads, ["band"], ["node"]).where(F.col("label") != F.col("lead.label"))
    met = met.where(F.least("n", "lead.n") >= F.lit(FLOOR) * F.greatest("n", "lead.n"))
    first = F.col("lead.crowd") if turn == 0 else F.xxhash64(F.lit(turn), "lead.node")
    return met.groupBy("node").agg(F.max(F.struct(first, F.col("lead.node").alias("other"))).alias("best")).select(F.col("node").alias("a"), F.col("best.other").alias("b"))


def by_prefix(held: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``a, b``: all pairs of nodes of different groups that may have a similarity of ``least`` or more.

    Shingles are ordered by the number of sets that hold them, rarest first. Two
    sets as similar as that share a shingle among the first
    ``n - ceil(least * n) + 1`` of the larger and the first
    ``n - ceil(2 * least / (1 + least) * n) + 1`` of the smaller. Sets that are less
    alike mostly begin with shingles of their own and meet nowhere; of those that
    meet, most can be told apart by their sketches.
    """
    each = held.join(sets, "node").select("node", "label", F.size("set").alias("n"), F.explode("set").alias("shingle"))
    counts = each.groupBy("shingle").agg(F.count("*").alias("held_by")).where(F.col("held_by") > 1)
    known = salted_join(each, counts, ["shingle"], ["node"])
    within = Window.partitionBy("node")
    place = F.col("n") - F.count("*").over(within) + F.row_number().over(within.orderBy("held_by", "shingle"))
    # rounding down what must be shared only lengthens a prefix
    after = lambda share: F.col("n") - F.ceil(F.lit(share) * F.col("n") - 1e-6) + 1
    placed = known.withColumn("place", place).where(F.col("place") <= after(least))
    placed = stage(placed.withColumn("indexed", F.col("place") <= after(2 * least / (1 + least))).drop("held_by"), "prefixes")
    mixed = placed.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.ceil(F.count("*") / PAIRS).alias("parts"))
    mixed = mixed.where(F.col("low") < F.col("high")).select("shingle", "parts")
    probes = salted_join(placed, mixed, ["shingle"], ["node"]).join(sets.select("node", "bits"), "node")
    probes = stage(probes.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))), "probes")
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    index = probes.where("indexed").select("shingle", *[F.col(c).alias(f"{c}_b") for c in ("node", "label", "n", "place", "bits")], copies)
    # what the sets can share at most, by the rest behind this shingle and by the bits they differ in
    both = F.col("n") + F.col("n_b")
    behind = 1 + F.least(F.col("n") - F.col("place"), F.col("n_b") - F.col("place_b"))
    apart = sum((F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("bits_b")[k])) for k in range(SKETCH // 64)), F.lit(0))
    needed = F.lit(least / (1 + least)) * both - 1e-6
    met = probes.join(index, ["shingle", "part"]).where(
        (F.col("label") != F.col("label_b")) & (F.struct("n_b", "node_b") < F.struct("n", "node")) & (F.col("n_b") >= F.lit(least) * F.col("n") - 1e-6)
        & (behind >= needed) & (both - apart >= 2 * needed)
    )
    return met.select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct()


def links(members: DataFrame, sets: DataFrame, met: DataFrame, least: float) -> DataFrame:
    """``node, label`` of the linked nodes.

    ``members`` has ``node, n, band`` of bands that several nodes share, ``met``
    the pairs whose fingerprints meet, ``sets`` the digests of all these nodes.
    The pairs of ``met`` are compared first. While at least half of the pairs it compares are
    linked, a round compares each node with one lead; the pairs still in
    different groups are then found by their prefixes.
    """
    crowd = salted_join(members, members.groupBy("band").agg(F.count("*").alias("held")), ["band"], ["node"]).groupBy("node").agg(F.sum("held").alias("crowd"))
    members = stage(members.join(crowd, "node"), "crowded")
    close = stage(alike(met, sets, least), "compared")
    labels = relabelled(members.sparkSession.createDataFrame([], "node long, label long"), close.where("linked"))
    turn = 0
    while True:
        # a band whose nodes are all in one group has nothing left to compare
        held = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = held.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where(F.col("low") < F.col("high")).select("band")
        held = stage(salted_join(held, mixed, ["band"], ["node"]), "held")
        new = stage(alike(stars(held, turn), sets, least), "compared")
        pairs, linked = new.agg(F.count("*"), F.count_if("linked")).first()
        labels = relabelled(labels, new.where("linked"))
        if 2 * linked < pairs or not pairs:
            break
        turn += 1
    held = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = held.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where(F.col("low") < F.col("high")).select("band")
    nodes_left = stage(salted_join(held, mixed, ["band"], ["node"]).select("node", "label").distinct(), "left")
    new = stage(alike(stage(by_prefix(nodes_left, sets, least), "candidates"), sets, least), "compared")
    return relabelled(labels, new.where("linked"))


def relabelled(labels: DataFrame, linked: DataFrame) -> DataFrame:
    """``labels`` after further links between nodes: groups are joined, not built anew."""
    group = lambda side: F.coalesce(f"label_{side}", side)
    for side in ("a", "b"):
        linked = salted_join(linked, labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}")), [side], ["a", "b"], "left")
    between = stage(linked.select("a", "b", group("a").alias("group_a"), group("b").alias("group_b")), "between")
    ties = between.select(F.col("group_a").alias("a"), F.col("group_b").alias("b")).where("a <> b").distinct()
    joined = components(ties, hubs=True).select(F.col("node").alias("label"), F.col("label").alias("next"))
    nodes_now = labels.union(between.select("a", "group_a")).union(between.select("b", "group_b")).distinct()
    out = salted_join(nodes_now, joined, ["label"], ["node"], "left")
    return stage(out.select("node", F.coalesce("next", "label").alias("label")), "labels")


def groups(docs: DataFrame, width: int = 5, least: float = 0.8, radius: int = 2) -> DataFrame:
    """``doc_id, k1, k2, head``: near-duplicate groups; ``head`` is the ``(doc_id, k1, k2)`` that stands for the group."""
    rows = stage(nodes(docs, width), "nodes")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    sets = stage(rows.groupBy("node").agg(F.min(order).alias("first"), F.any_value("n").alias("n"), F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands")), "sets")
    members = sets.select("node", "n", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.count("*").alias("held")).where(F.col("held") > 1).select("band")
    members = stage(salted_join(members, shared, ["band"], ["node"]), "members")
    met = stage(by_fingerprint(sets.select("node", "fp"), radius), "pairs")
    held = members.select("node").union(met.select("a")).union(met.select("b")).distinct()
    wanted = sets.select("first.k1", "first.k2", "node").join(held, "node", "left_semi")
    named = keyed(docs.select("doc_id", "text"), docs["doc_id"], docs["text"]).select("k1", "k2", "row.text")
    # equal rows share k1 and k2: any of them has the node's text
    texts = salted_join(named, wanted, ["k1", "k2"], ["text"])
    labels = links(members, stage(digest_sets(texts, width).dropDuplicates(["node"]), "digests"), met, least)
    tied = stage(sets.select("node", "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "tied")
    heads = tied.groupBy("label").agg(F.min("first").alias("head"))
    of_node = stage(salted_join(tied.select("node", "label"), heads, ["label"], ["node"]).select("node", "head"), "heads")
    return salted_join(rows.select("doc_id", "k1", "k2", "node"), of_node, ["node"], ["k1", "k2"]).select("doc_id", "k1", "k2", "head")


def keep_one(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """One document of each group, the one with the smallest id, then digest, with all its columns."""
    heads = groups(docs, width, least).select("head.k1", "head.k2").distinct()
    rows = keyed(docs, docs["doc_id"], docs["text"])
    return rows.join(heads, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("row.*")
