"""Best-fit packing of tokenised documents into sequences, planned on a histogram.

Documents become token ids plus an end id. Longer ones than a sequence are cut
into full pieces, a shorter piece first. Pieces of one length are alike, so the
plan needs only how many there are of each length: best-fit decreasing runs
over these counts, in whole groups of equally filled sequences. Each piece then
takes the slot that its rank within its length gives it.

The histogram has one row per length, at most ``capacity``; the plan's size is
bounded by ``capacity`` alone, whatever the number of documents.

Results for unusual rows: a null text is empty, and an empty text is a piece of
the end id alone. Repeated rows and rows without a ``doc_id`` are packed like
any other. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubline.llm.common import encoder, in_groups, utf8, vocabulary
from scrubline.staging import stage

RUNS = "length long, low long, high long, sequence_id long, offset long, times long"


def pieces(docs: DataFrame, vocabulary_path: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, part, place``; ``place`` counts a part's pieces of one length."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_path))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(shared.value), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in in_groups(batches):
            rows: list[tuple] = []
            for at, ids in enumerate(enc.encode(utf8(batch.column("text")))):
                ids = np.append(ids, end_id).astype("<u4")
                first = len(ids) % capacity or capacity
                start, stop, piece = 0, min(first, len(ids)), 0
                while start < len(ids):
                    n = stop - start
                    rows.append((at, piece, start, n, zlib.crc32(ids[start:stop].tobytes()), part, int(seen[n])))
                    seen[n] += 1
                    start, stop, piece = stop, stop + capacity, piece + 1
            cols = list(zip(*rows))
            ids_col = batch.column("doc_id").take(pa.array(cols[0], pa.int32()))
            yield pa.RecordBatch.from_arrays([ids_col, pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:]]], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part long, place long")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots in runs ``(length, low, high, sequence_id, offset, times)``.

    Ranks ``low`` to ``high - 1`` of a length fill sequences from
    ``sequence_id`` on, ``times`` of them in each, from ``offset`` on.
    """
    groups: dict[int, list[tuple[int, int]]] = {}  # free room: (first sequence, number of sequences)
    rooms: list[int] = []
    runs, opened = [], 0

    def put(room: int, first: int, many: int) -> None:
        if room and many:
            if room not in groups:
                insort(rooms, room)
            groups.setdefault(room, []).append((first, many))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, many = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, first, many = capacity, opened, -(-left // (capacity // length))
                opened += many
            times = room // length
            full = min(many, left // times)
            if full:
                runs.append((length, rank, rank + full * times, first, capacity - room, times))
                put(room - times * length, first, full)
                rank, left = rank + full * times, left - full * times
            if full < many:
                rest = min(left, times - 1)
                if rest:
                    runs.append((length, rank, rank + rest, first + full, capacity - room, rest))
                    put(room - rest * length, first + full, 1)
                    rank, left = rank + rest, left - rest
                put(room, first + full + bool(rest), many - full - bool(rest))
    return runs


def pack(docs: DataFrame, vocabulary_path: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: a row per piece."""
    spark = docs.sparkSession
    cut = stage(pieces(docs, vocabulary_path, end_id, capacity), "pieces")
    counts = stage(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.createDataFrame(plan(histogram, capacity), RUNS)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("place"))
    slot = F.broadcast(runs)  # bounded by the capacity
    hit = ranked.join(slot, (ranked["length"] == slot["length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    step = F.col("rank") - F.col("low")
    return hit.select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32",
        (F.col("sequence_id") + F.expr("(rank - low) div times")).alias("sequence_id"),
        (F.col("offset") + step % F.col("times") * ranked["length"]).alias("offset"),
    )
