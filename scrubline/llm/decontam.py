"""Benchmark passages in documents, found by Wu-Manber multi-pattern search over words.

Every window of ``width`` words of an item is a pattern; an item of fewer words
is one pattern. Patterns of one length share a table of shifts: for the last
two words read, how far the window may move without missing a pattern. Where
the shift is zero, the patterns that end in these two words are compared word
by word. The items are a stated query set; they are split into blocks of bounded
size, and each block's tables are sent to every task, one block at a time.

Results for unusual rows: a null text has no words and is never hit; an item
without words has no pattern; a null ``item_id`` is written as the empty text;
repeated items count once per id; empty tables give no hits; a text of any length is
searched whole, in time linear in it but for compared windows. Extra columns are
kept by :func:`clean`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import in_groups, salted_join, utf8
from scrubline.staging import stage

BLOCK_BYTES = 16 << 20
# letters and digits: ASCII ones and every byte of other characters; the rest separates words
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def split_words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Searcher:
    """Shift and suffix tables of the patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple, set[str]]):
        self.length = length
        self.block = min(2, length)
        self.skip = length - self.block + 1
        self.shift: dict[object, int] = {}
        self.bucket: dict[object, list[tuple[list[bytes], frozenset[str]]]] = {}
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                key = self.key(pattern, end)
                self.shift[key] = min(self.shift.get(key, self.skip), length - end)
            self.bucket.setdefault(self.key(pattern, length), []).append((list(pattern), frozenset(items)))

    def key(self, words, end: int):
        return words[end - 1] if self.block == 1 else (words[end - 2], words[end - 1])

    def find(self, words: list[bytes]) -> Iterator[tuple[int, frozenset[str]]]:
        """Start and items of every occurrence."""
        length, skip, shift, one = self.length, self.skip, self.shift, self.block == 1
        end, n = length, len(words)
        while end <= n:
            key = words[end - 1] if one else (words[end - 2], words[end - 1])
            move = shift.get(key, skip)
            if move:
                end += move
                continue
            window = words[end - length : end]
            for pattern, items in self.bucket[key]:
                if pattern == window:
                    yield end - length, items
            end += 1


def searchers(items: Iterable[tuple[str, bytes]], width: int) -> list[Searcher]:
    by_length: dict[int, dict[tuple, set[str]]] = {}
    for item, text in items:
        words = split_words(text)
        n = min(width, len(words))
        for at in range(len(words) - n + 1) if n else ():
            by_length.setdefault(n, {}).setdefault(tuple(words[at : at + n]), set()).add(item)
    return [Searcher(n, patterns) for n, patterns in sorted(by_length.items())]


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans merged where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


HITS = "struct<n_words:bigint,spans:array<struct<start:bigint,stop:bigint>>,items:array<string>>"


def searched(docs: DataFrame, items: list[tuple[str, bytes]], width: int) -> tuple[DataFrame, Broadcast]:
    """``docs`` with ``text`` searched and taken off, and what it finds added to ``hits``; the tables that were sent."""
    shared = docs.sparkSession.sparkContext.broadcast({"items": items})
    schema = docs.drop("text").schema
    kept, at = schema.names, docs.columns.index("hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        if "tables" not in tables:  # kept in the worker from task to task
            tables["tables"] = searchers(tables["items"], width)
        for batch in in_groups(batches):
            found = []
            for text, before in zip(utf8(batch.column("text")), batch.column("hits").to_pylist()):
                words = split_words(text)
                spans = [(s["start"], s["stop"]) for s in before["spans"]] if before else []
                names = set(before["items"]) if before else set()
                for s in tables["tables"]:
                    for place, those in s.find(words):
                        spans.append((place, place + s.length))
                        names |= those
                found.append({"n_words": len(words), "spans": [{"start": a, "stop": b} for a, b in covered(spans)], "items": sorted(names)})
            batch = batch.set_column(at, batch.schema.field(at), pa.array(found, batch.schema.field(at).type))
            yield batch.select(kept)

    return docs.mapInArrow(run, schema), shared


def hits(docs: DataFrame, benchmark: DataFrame, carry: list[str], width: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``row, hits``: the columns ``carry`` of each document; its number of words, spans of hit words, and the items found.

    A benchmark of one block is searched in the pass that returns the rows. Of further
    blocks each has a pass of its own, which writes what it found by digest of the
    text and frees the block's tables before the next one is sent.
    """
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    none = F.lit(None).cast(HITS).alias("hits")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), none, "text")
    if blocks > 1:
        bench = stage(bench.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))).repartitionByRange("block"), "blocks")
        mine = lambda block: [(r.item, r.text.encode()) for r in bench.where(F.col("block") == block).collect()]
        keys = [F.xxhash64(F.lit(k), "text").alias(f"k{k}") for k in (1, 2)]
        texts, parts = docs.select(*keys, none, "text"), []
        for block in range(blocks - 1):
            found, shared = searched(texts, mine(block), width)
            parts.append(stage(found.where(F.size("hits.items") > 0), f"block-{block}"))
            shared.destroy()
        every = lambda field: F.flatten(F.collect_set(f"hits.{field}")).alias(field)
        seen = reduce(DataFrame.union, parts).groupBy("k1", "k2").agg(every("spans"), every("items"))
        before = seen.select("k1", "k2", F.struct(F.lit(0).cast("long").alias("n_words"), "spans", "items").cast(HITS).alias("hits"))
        rows = salted_join(rows.drop("hits").withColumns({f"k{i + 1}": k for i, k in enumerate(keys)}), before, ["k1", "k2"], ["row"], "left").select("row", "hits", "text")
    return searched(rows, mine(blocks - 1) if blocks > 1 else [(r.item, r.text.encode()) for r in bench.collect()], width)[0]


def report(docs: DataFrame, benchmark: DataFrame, carry: list[str], width: int = 13, parts: int = 20) -> DataFrame:
    """``row, n_words, n_hit, n_items, items_sha256, contaminated``; contaminated: a ``parts``-th of the words or more is hit."""
    h = hits(docs, benchmark, carry, width)
    n_hit = F.aggregate("hits.spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    out = h.select("row", "hits.n_words", n_hit.alias("n_hit"), F.size("hits.items").cast("long").alias("n_items"), F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (parts * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 13, parts: int = 20) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    return report(docs, benchmark, docs.columns, width, parts).where(~F.col("contaminated")).select("row.*")
