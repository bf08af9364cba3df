"""Token ids in files compressed by a Re-Pair grammar.

Documents are tokenised in ascending order of ``doc_id`` and written in shards.
In each shard frequent pairs of neighbouring ids are replaced by new symbols,
again and again: in each round the pairs are counted, and at every place the
pair that is more frequent than those that overlap it gives way to its symbol.
No pair crosses the end of a document, so any document can be expanded alone.

A shard is one row of the table: ``body`` holds, as little-endian 32-bit
integers, the rules (two symbols each), the number of ids that each rule
expands to, the place of each document's first symbol and the symbols. Symbols
below ``base`` are ids; symbol ``base + k`` is rule ``k``.

Results for unusual rows: a null text is empty and is stored as the end id
alone; rows without a ``doc_id`` come first; rows with equal ids are ordered by
a digest of their text. Extra columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrubline.llm.common import encoder, in_groups, utf8, vocabulary
from scrubline.staging import stage

SHARD_IDS = 1 << 20
ROUNDS = 8
LEAST = 16
_BITS = 20


def _code(pairs: np.ndarray) -> np.ndarray:
    return ((pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).view(np.int64)


def compress(ids: np.ndarray, ends: np.ndarray, base: int, rounds: int = ROUNDS, least: int = LEAST):
    """``symbols, starts, left, right``; ``ends`` flags the last id of each document.

    A pair that was rare once stays rare, as its places only grow fewer. So a round looks
    only where the pair was not rare before or has a symbol of the round before in it.
    """
    seq, last = ids.astype(np.uint32), ends.copy()
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    rules = 0
    live = np.ones(len(seq), bool)
    # tables by code, made once; a round reads no more than it has written, and sets the counts back to zero
    count, there = np.zeros(1 << _BITS, np.int32), np.zeros(1 << _BITS, bool)
    chosen, number = np.empty(1 << _BITS, np.uint64), np.empty(1 << _BITS, np.uint32)
    weight, one = np.zeros(len(seq) + 1, np.int32), np.int32(1)
    for _ in range(rounds):
        live[-1:] = False
        at = np.flatnonzero(live & ~last)
        pairs = seq[at].astype(np.uint64)
        pairs <<= np.uint64(32)
        pairs |= seq[1:][at]
        here = _code(pairs)
        np.add.at(count, here, one)
        keep = np.flatnonzero(count[here] >= least)
        seen, at, here, pairs = here, at[keep], here[keep], pairs[keep]
        if not len(at):
            break
        # of the pairs that share a code, the last one stands for it
        chosen[here] = pairs
        same = chosen[here] == pairs
        np.subtract.at(count, here[np.flatnonzero(~same)], one)
        exact = count[here]
        count[seen] = 0
        frequent = exact >= least
        live[:] = False
        live[at[np.flatnonzero(frequent | ~same)]] = True
        keep = np.flatnonzero(same & frequent)
        at, here, exact = at[keep], here[keep], exact[keep]
        if not len(at):
            continue
        weight[1:][at] = exact
        top = np.flatnonzero((exact >= weight[at]) & (exact >= weight[2:][at]))
        weight[1:][at] = 0
        at, here = at[top], here[top]
        # equal neighbours: every other one, from the left
        fresh = np.ones(len(at), bool)
        fresh[1:] = np.diff(at) > 1
        run = np.maximum.accumulate(np.where(fresh, at, 0))
        odd = np.flatnonzero((at - run) & 1 == 0)
        at, here = at[odd], here[odd]
        there[here] = True
        used = np.flatnonzero(there)
        there[used] = False
        number[used] = np.arange(base + rules, base + rules + len(used), dtype=np.uint32)
        left.append((chosen[used] >> np.uint64(32)).astype(np.int32))
        right.append((chosen[used] & np.uint64(0xFFFFFFFF)).astype(np.int32))
        rules += len(used)
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq[at] = number[here]
        last[at] = last[at + 1]
        live[at] = True
        live[np.maximum(at - 1, 0)] = True
        stay = np.flatnonzero(stay)
        seq, last, live = seq[stay], last[stay], live[stay]
    starts = np.concatenate([[0], np.flatnonzero(last) + 1]).astype(np.int64)
    empty = np.zeros(0, np.int32)
    return seq.astype(np.int32), starts, np.concatenate([empty, *left]), np.concatenate([empty, *right])


def expansion_lengths(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule expands to; a rule uses earlier rules only."""
    sizes = np.ones(len(left), np.int64)
    known = np.zeros(len(left), bool)
    for _ in range(len(left)):
        def size(s):
            k = np.maximum(s - base, 0)
            return np.where(s < base, 1, sizes[k]), (s < base) | known[k]
        (x, ok_x), (y, ok_y) = size(left), size(right)
        new = ok_x & ok_y
        sizes = np.where(new, x + y, sizes)
        if (new == known).all():
            break
        known = new
    return sizes


def expand(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, base: int, sizes: np.ndarray | None = None) -> np.ndarray:
    """The ids that symbols stand for; any slice of a shard's symbols may be given.

    With the rules' ``sizes`` every rule is expanded once, and the symbols' ids are copied from there.
    """
    if sizes is None or len(symbols) <= len(left):
        return _unfold(symbols, left, right, base)
    rules = _unfold(np.arange(base, base + len(left), dtype=np.int32), left, right, base)
    # an id has a place of its own in front of the rules
    flat = np.concatenate([np.arange(base, dtype=np.int32), rules])
    length = np.concatenate([np.ones(base, np.int32), sizes.astype(np.int32)])
    first = np.concatenate([np.arange(base), base + np.cumsum(sizes, dtype=np.int64) - sizes])
    n = length[symbols]
    ends = np.cumsum(n, dtype=np.int64)
    return flat[np.repeat(first[symbols] - ends + n, n) + np.arange(ends[-1])]


def _unfold(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """Each rule gives way to its two symbols until only ids are left."""
    seq = symbols
    while True:
        rule = seq >= base
        if not rule.any():
            return seq
        counts = rule + 1
        first = np.cumsum(counts) - counts
        out = np.empty(int(first[-1] + counts[-1]), np.int32)
        out[first] = np.where(rule, left[np.maximum(seq - base, 0)], seq) if len(left) else seq
        out[first[rule] + 1] = right[seq[rule] - base]
        seq = out


def to_body(ids: np.ndarray, ends: np.ndarray, base: int) -> tuple[bytes, int]:
    symbols, starts, left, right = compress(ids, ends, base)
    sizes = expansion_lengths(left, right, base)
    return b"".join(x.astype("<i4").tobytes() for x in (left, right, sizes, starts, symbols)), len(left)


def from_body(body: bytes, n_rules: int, n_docs: int):
    """``left, right, sizes, starts, symbols``."""
    flat = np.frombuffer(body, "<i4")
    return np.split(flat, np.cumsum([n_rules, n_rules, n_rules, n_docs + 1]))


SHARDS = "part long, shard long, doc_ids array<{kind}>, n_tokens array<long>, n_rules long, total long, body binary"


def write(docs: DataFrame, path: str, vocabulary_path: str, end_id: int = 2, base: int = 1 << 16, shard_ids: int = SHARD_IDS) -> None:
    """Write the documents' ids as shards in ascending order of part, then shard."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_path))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, shard = encoder(shared.value), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        names: list[pa.Array] = []
        held = 0

        def flush() -> pa.RecordBatch:
            flat, sizes = np.concatenate(ids), np.array([len(x) for x in ids])
            ends = np.zeros(len(flat), bool)
            ends[np.cumsum(sizes) - 1] = True
            body, n_rules = to_body(flat, ends, base)
            doc_ids = pa.concat_arrays(names)
            row = [pa.array([part]), pa.array([shard]), pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids), pa.array([sizes.tolist()], pa.list_(pa.int64())), pa.array([n_rules]), pa.array([len(flat)]), pa.array([body], pa.binary())]
            return pa.RecordBatch.from_arrays(row, ["part", "shard", "doc_ids", "n_tokens", "n_rules", "total", "body"])

        for batch in in_groups(batches, most=enc.group, rows=max(512, enc.group >> 10)):
            for at, found in enumerate(enc.encode(utf8(batch.column("text")))):
                ids.append(np.append(found, np.int32(end_id)))
                names.append(batch.column("doc_id").slice(at, 1))
                held += len(ids[-1])
                if held >= shard_ids:
                    yield flush()
                    ids, names, held, shard = [], [], 0, shard + 1
        if ids:
            yield flush()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")
    ordered = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    ordered.mapInArrow(shards, SHARDS.format(kind=kind)).write.parquet(path)


def read(spark, path: str, base: int = 1 << 16) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``: every document, expanded from the files."""
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    names = ["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                doc_ids, sizes = row.column("doc_ids").flatten(), row.column("n_tokens").flatten().to_numpy()
                left, right, lengths, _, symbols = from_body(row.column("body")[0].as_py(), row.column("n_rules")[0].as_py(), len(sizes))
                ids = expand(symbols, left, right, base, lengths).astype("<u4").tobytes()
                ends = np.cumsum(sizes)
                view = memoryview(ids)
                crc = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                many = len(sizes)
                yield pa.RecordBatch.from_arrays([*[pa.array(np.full(many, row.column(c)[0].as_py())) for c in ("part", "shard")], doc_ids, pa.array(ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], names)

    docs = files.select("part", "shard", "doc_ids", "n_tokens", "n_rules", "body").mapInArrow(documents, f"part long, shard long, doc_id {kind}, inside long, n_tokens long, ids_crc32 long")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("total").alias("ids")).select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.select("part", "shard", F.coalesce(F.sum("total").over(inner), F.lit(0)).alias("first"))
    starts = shards.join(parts, "part").select("part", "shard", (F.col("base") + F.col("first")).alias("base"))
    return docs.join(starts, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def read_document(spark, path: str, doc_id, base: int = 1 << 16) -> list[int]:
    """Ids of one document, expanding its own symbols only."""
    row = spark.read.parquet(path).where(F.array_contains("doc_ids", doc_id)).first()
    if row is None:
        raise KeyError(doc_id)
    left, right, _, starts, symbols = from_body(row.body, row.n_rules, len(row.doc_ids))
    at = row.doc_ids.index(doc_id)
    return expand(symbols[starts[at] : starts[at + 1]], left, right, base).tolist()
