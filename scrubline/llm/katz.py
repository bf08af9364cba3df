"""Katz backoff language model: Good-Turing discounts, exactly normalised backoff weights.

Documents are encoded into blocks of about ``block_tokens`` tokens, written
once, by the partition that their answers are shuffled to. Order by order a block asks for the counts of its distinct n-grams: it
sends their 64-bit keys, as differences, and its own training counts to the parts of the n-gram
table, cut by key. A part sums what the blocks have sent and answers every block
in the order asked; its shuffle is freed before the next order. An n-gram that stands at one place of
all documents, a training one, is alone: what follows it is alone as well and has the count 1,
so longer n-grams after it are counted where they stand and never sent, nor is its backoff
weight, for which no document asks. Training documents hold all of their n-grams, so only
the others are sent weights, and a context of up to five places that only training
documents hold is not in the table of contexts. From the answers the blocks sum,
for each other context, the discounted mass and the lower-order probability of the
n-grams seen after it; the table of contexts turns these sums into backoff
weights. Then each token is scored: by its n-gram if the training documents
hold it, else by the backoff weight of its context times the probability after
the shorter context, down to single words.

An n-gram that occurs in many blocks is summed in each block first, so a
frequent word loads its part no more than a rare one. Every block has the same
number of tokens, so memory does not depend on the number of documents or on
their length: a document longer than a block is cut into several, with the
words before the cut as context.

The words are those of the training documents and one unknown word, to which
the unseen mass of the single-word distribution goes; so every distribution
sums to one over these words. The first token's context is the document's start.

Results for unusual rows: a null or empty text is the end token alone; a null
``doc_id`` has the empty text as its id text; repeated rows count and are scored
each. Without training documents every word is unknown, with probability one.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import in_groups, stage_and_free
from scrubline.staging import stage_in_buckets

BLOCK_TOKENS = 1 << 19
PART_KEYS = 1 << 20
MOST_WORDS = 400_000  # words of a block beyond this are merged where they are equal
TOP = 5  # counts above are not discounted
END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def held_out(id_text: str | None) -> bool:
    """Whether a document is kept from training."""
    return zlib.crc32((id_text or "").encode()) % 7 == 2


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of words, among them all of some texts; each text's words and its end as places among these; the tokens of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    coded = lists.flatten().dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    keys = np.fromiter(chain((int(END),), map(xxhash.xxh64_intdigest, distinct)), np.uint64, len(distinct) + 1)
    # white space at either end of a text leaves an empty word there
    full = np.array([bool(w) for w in distinct], bool)[coded.indices.to_numpy()]
    of_text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    sizes = np.bincount(of_text[full], minlength=len(texts)) + 1
    flat = np.zeros(int(sizes.sum()), np.int64)
    word = np.ones(len(flat), bool)
    word[np.cumsum(sizes) - 1] = False
    flat[word] = coded.indices.to_numpy()[full] + 1
    return keys, flat, sizes


def mix(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit key of a context's key and the word after it."""
    x = context * np.uint64(0xBF58476D1CE4E5B9) + word
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers, one byte each; those of 255 and above follow in full."""
    values = np.asarray(values, np.int64)
    large = values >= 255
    return np.where(large, 255, values).astype(np.uint8).tobytes() + values[large].astype("<i8").tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<i8", -1, n)
    return out


def squeeze(keys: np.ndarray) -> bytes:
    """Ascending keys: the first, then the differences byte by byte, highest bytes left out where all are zero."""
    gaps = np.diff(keys).astype("<u8")
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return keys[:1].astype("<u8").tobytes() + gaps.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def spread(data: bytes, n: int) -> np.ndarray:
    gaps = np.zeros((n, 8), np.uint8)
    gaps[0] = np.frombuffer(data, np.uint8, 8)
    if n > 1:
        planes = np.frombuffer(data, np.uint8, -1, 8).reshape(-1, n - 1)
        gaps[1:, : len(planes)] = planes.T
    return np.cumsum(gaps.view("<u8").reshape(-1), dtype=np.uint64)


def bits_of(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n) > 0


def few(values: np.ndarray) -> bytes:
    """Numbers of which many are equal: the distinct ones, then their places in one to four bytes each."""
    distinct, places = np.unique(values, return_inverse=True)
    code = "u1" if len(distinct) <= 1 << 8 else "<u2" if len(distinct) <= 1 << 16 else "<u4"
    return len(distinct).to_bytes(8, "little") + distinct.astype("<f8").tobytes() + places.astype(code).tobytes()


def from_few(data: bytes, n: int) -> tuple[np.ndarray, int]:
    """The numbers, and where they end."""
    many = int.from_bytes(data[:8], "little")
    code = np.dtype("u1" if many <= 1 << 8 else "<u2" if many <= 1 << 16 else "<u4")
    end = 8 + 8 * many
    return np.frombuffer(data, "<f8", many, 8)[np.frombuffer(data, code, n, end)], end + n * code.itemsize


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the place of each key among them, and where one of each lies."""
    # places in the lowest bits; keys alike in all others are rare and may come out of order
    low = np.uint64((1 << len(keys).bit_length()) - 1)
    order = (np.sort(keys & ~low | np.arange(len(keys), dtype=np.uint64)) & low).astype(np.int64)
    sorted_keys = keys[order]
    if (sorted_keys[1:] < sorted_keys[:-1]).any():
        order = np.argsort(keys)
        sorted_keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    places = np.empty(len(keys), np.int64)
    places[order] = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    return sorted_keys[heads], places, order[heads]


def ranked(keys: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys at ``chosen`` places, distinct and in order, and the place of each among them."""
    there = np.bincount(chosen, minlength=len(keys)) > 0
    used = np.flatnonzero(there)
    distinct, places, _ = grouped(keys[used])
    rank = np.zeros(len(keys), np.int64)
    rank[used] = places
    return distinct, rank[chosen]


# ── blocks ──

BLOCK = "block long, rows array<long>, doc_ids array<{kind}>, held array<boolean>, sizes array<long>, firsts array<boolean>, words binary, tokens binary, n_tokens long"


def encode(docs: DataFrame, block_tokens: int, order: int) -> DataFrame:
    """Blocks of pieces of documents. ``words`` has the keys of a block's words in order, ``tokens`` places in it.

    A piece that continues a document starts with the ``order - 1`` tokens
    before the cut, which are context and not scored again.
    """
    import zstandard

    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies: list[np.ndarray] = []
        part, number, row = TaskContext.get().partitionId(), 0, TaskContext.get().partitionId() << 32
        keys: list[np.ndarray] = []
        length = 0
        rows, ids, held, sizes, firsts = [], [], [], [], []

        def flush() -> pa.RecordBatch:
            flat = np.concatenate(keys)
            vocabulary, tokens = ranked(np.concatenate(vocabularies), flat)
            blob = zstandard.ZstdCompressor(level=1).compress(np.concatenate([(tokens >> s & 255).astype(np.uint8) for s in (0, 8, 16, 24)]).tobytes())
            cells = [(part << 32) + number, rows, None, held, sizes, firsts, len(vocabulary).to_bytes(8, "little") + squeeze(vocabulary), blob, len(flat)]
            kinds = [pa.int64(), pa.list_(pa.int64()), None, pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.int64()]
            names = ["block", "rows", "doc_ids", "held", "sizes", "firsts", "words", "tokens", "n_tokens"]
            id_array = pa.concat_arrays(ids)
            arrays = [pa.array([c], t) if t else pa.ListArray.from_arrays(pa.array([0, len(id_array)], pa.int32()), id_array) for c, t in zip(cells, kinds)]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in in_groups(batches):
            id_texts = batch.column("id_text").to_pylist()
            words, flat, many = numbered(batch.column("text"))
            base = sum(map(len, vocabularies))
            if base > MOST_WORDS:
                merged, places, _ = grouped(np.concatenate(vocabularies))
                keys, vocabularies, base = [places[k] for k in keys], [merged], len(merged)
            vocabularies.append(words)
            for at, text in enumerate(np.split(flat, np.cumsum(many)[:-1])):
                out, start, row = held_out(id_texts[at]), 0, row + 1
                while start < len(text):
                    before = min(start, order - 1)
                    stop = min(len(text), start + max(1, block_tokens - length))
                    keys.append(text[start - before : stop] + base)
                    length += stop - start + before
                    rows.append(row)
                    ids.append(batch.column("doc_id").slice(at, 1))
                    held.append(out)
                    sizes.append(stop - start + before)
                    firsts.append(start == 0)
                    start = stop
                    if length >= block_tokens:
                        yield flush()
                        length = 0
                        vocabularies, base = [words], 0
                        keys, rows, ids, held, sizes, firsts, number = [], [], [], [], [], [], number + 1
        if ids:
            yield flush()

    named = docs.select("doc_id", "text", F.col("doc_id").cast("string").alias("id_text"))
    return named.mapInArrow(run, BLOCK.format(kind=kind))


class Block:
    """A block's n-grams: for each order up to ``depth`` the key and context key at every place where it has one."""

    def __init__(self, row: dict, order: int, depth: int):
        import zstandard

        n = row["n_tokens"]
        self.words = spread(row["words"][8:], int.from_bytes(row["words"][:8], "little"))
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["tokens"]), np.uint8).reshape(4, n).astype(np.int64)
        token = planes[0] | planes[1] << 8 | planes[2] << 16 | planes[3] << 24
        sizes = np.array(row["sizes"], np.int64)
        self.pieces = len(sizes)
        self.piece = np.repeat(np.arange(self.pieces), sizes)
        first = np.array(row["firsts"], bool)
        place = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.scored = np.repeat(first, sizes) | (place >= order - 1)
        self.train = self.scored & ~np.repeat(np.array(row["held"], bool), sizes)
        # per order: which places have an n-gram, the distinct ones' keys, each place's among them, one place of each
        begin = (place == 0) & np.repeat(first, sizes)
        one = np.zeros(len(self.words), np.int64)
        one[token] = np.arange(n)
        self.at, self.keys, self.gram, self.one = [np.arange(n)], [self.words], [token], [one]
        # the number of each place's context among the n-grams of the order below; one more for the start
        self.context = [np.zeros(0, np.int64)]
        inner = np.flatnonzero(place > 0)
        for _ in range(2, depth + 1):
            below, known = np.full(n, -1), len(self.keys[-1])
            below[inner] = self.gram[-1][inner - 1]
            if len(self.keys) == 1:
                below[begin] = known
            context_keys = np.append(self.keys[-1], START)
            at = np.flatnonzero(below >= 0)
            keys, places, one = grouped(mix(context_keys[below[at]], self.words[token[at]]))
            gram = np.full(n, -1)
            gram[at] = places
            self.at.append(at)
            self.keys.append(keys)
            self.gram.append(gram)
            self.one.append(at[one])
            self.context.append(below)

    def distinct(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys in order, their training counts, and whether they also stand where they are not counted."""
        at, many = self.at[level], len(self.keys[level])
        counts = np.bincount(self.gram[level][at], self.train[at], many).astype(np.int64)
        return self.keys[level], counts, np.bincount(self.gram[level][at], minlength=many) > counts

    def after(self, level: int, alone: np.ndarray) -> np.ndarray:
        """Which distinct n-grams follow a context that is ``alone``."""
        return np.append(alone, False)[self.context[level][self.one[level]]]


def cut(keys: np.ndarray, bits: int) -> list[tuple[int, slice]]:
    """Slices of sorted keys by their highest ``bits`` bits."""
    if not len(keys):
        return []
    part = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
    return [(int(part[a]), slice(int(a), int(b))) for a, b in zip(edges[:-1], edges[1:])]


MESSAGE = "level int, part long, block long, n long, keys binary, a binary, b binary, c binary"


def messages(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
    cols = list(zip(*rows)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in MESSAGE.split(", ")])


class Counts:
    """Training counts of a block's distinct n-grams, from the answers it got, for as many orders as were answered.

    ``own`` has one place of each n-gram that this block sums, ``outside`` says which
    n-grams any block has where they are not counted, ``alone`` which ones stand at one
    place of all documents, in training.
    """

    def __init__(self, block: Block, answers: list[dict]):
        got = by_level(answers)
        self.known, self.own, self.outside, self.alone = [], [], [], []
        for level, one in enumerate(block.one[: max(got) + 1]):
            asked = np.flatnonzero(~block.after(level, self.alone[-1])) if level else np.arange(len(one))
            known, own, outside = np.ones(len(one), np.int64), np.ones(len(one), bool), np.zeros(len(one), bool)
            none = [np.zeros(0, np.int64)]
            known[asked] = np.concatenate([*none, *[unpack(a["a"], a["n"]) for a in got.get(level, [])]])
            own[asked] = np.concatenate([*none, *[bits_of(a["b"], a["n"]) for a in got.get(level, [])]])
            outside[asked] = np.concatenate([*none, *[bits_of(a["c"], a["n"]) for a in got.get(level, [])]])
            self.known.append(known)
            self.own.append(one[own])
            self.outside.append(outside)
            self.alone.append((known == 1) & ~outside)


def ask_counts(blocks: DataFrame, answers: list[DataFrame], level: int, order: int, bits: int) -> DataFrame:
    """Each block's distinct n-grams of one order with its training counts, cut into the parts of the table.

    Those after an n-gram that is alone are not sent; a message of their own says how many they are.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row = batch.drop_columns(["doc_ids"]).to_pylist()[0]
        block = Block(row, order, level + 1)
        keys, counts, elsewhere = block.distinct(level)
        if level:
            sent = np.flatnonzero(~block.after(level, Counts(block, row["answers"]).alone[level - 1]))
            keys, counts, elsewhere = keys[sent], counts[sent], elsewhere[sent]
        out = [(level, part, row["block"], s.stop - s.start, squeeze(keys[s]), pack(counts[s]), np.packbits(elsewhere[s]).tobytes(), b"") for part, s in cut(keys, bits)]
        if len(keys) < len(block.keys[level]):
            out.append((level, row["block"] % (1 << bits), row["block"], 0, b"", b"", b"", (len(block.keys[level]) - len(keys)).to_bytes(8, "little")))
        return messages(out)

    return _blocks_with(blocks, [answers] if answers else [], run, MESSAGE)


COUNTED = MESSAGE + ", known long, total long, " + ", ".join(f"r{r} long" for r in range(1, TOP + 2))


def count(asked: DataFrame) -> DataFrame:
    """Answers (``a``: counts, ``b``: whether the block is to sum the n-gram, ``c``: whether any block has it where it is not counted) and, as block -1, figures of the parts."""

    def merge(table: pa.Table) -> pa.Table:
        asked = sorted(table.to_pylist(), key=lambda r: r["block"])
        rows, left = [r for r in asked if r["n"]], sum(int.from_bytes(r["c"], "little") for r in asked if not r["n"])
        keys = np.concatenate([np.zeros(0, np.uint64), *[spread(r["keys"], r["n"]) for r in rows]])
        own = np.concatenate([np.zeros(0, np.int64), *[unpack(r["a"], r["n"]) for r in rows]])
        elsewhere = np.concatenate([np.zeros(0, bool), *[bits_of(r["b"], r["n"]) for r in rows]])
        known, inverse, _ = grouped(keys)
        total = np.bincount(inverse, own, len(known)).astype(np.int64)
        outside = np.bincount(inverse, elsewhere, len(known)) > 0
        # the last block that has an n-gram in training sums it
        held = np.flatnonzero(own > 0)
        last = np.full(len(known), -1)
        last[inverse[held]] = held
        owner = np.zeros(len(keys), bool)
        owner[last[last >= 0]] = True
        answer, out, at = total[inverse], [], 0
        blank = (0,) * (TOP + 3)
        for r in rows:
            s = slice(at, at + r["n"])
            out.append((r["level"], r["part"], r["block"], r["n"], b"", pack(answer[s]), np.packbits(owner[s]).tobytes(), np.packbits(outside[inverse[s]]).tobytes(), *blank))
            at += r["n"]
        seen = total > 0
        first_row = asked[0]
        ranks = [int((total == r).sum()) for r in range(1, TOP + 2)]
        ranks[0] += left
        out.append((first_row["level"], first_row["part"], -1, int(seen.sum()) + left, b"", b"", b"", b"", int(seen.sum()) + left, int(total.sum()) + left, *ranks))
        names = [x.split()[0] for x in COUNTED.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4, *[pa.int64()] * (TOP + 3)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return asked.groupBy("level", "part").applyInArrow(merge, COUNTED)


# ── model ──


def turing(n: np.ndarray) -> np.ndarray:
    """Katz's factors of the counts 1 to ``TOP``, unknown where a number is zero."""
    r = np.arange(1, TOP + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        beyond = (TOP + 1) * n[TOP] / n[0]
        return ((r + 1) * n[1:] / n[:-1] / r - beyond) / (1 - beyond)


def discounts(ranks: list[int]) -> np.ndarray:
    """Factor for each count up to ``TOP`` (one above) from the numbers of n-grams that occur 1, 2, ... times.

    Good-Turing's factors. Copies of documents raise the numbers of some
    counts, and factors that these enter may fall outside (0, 1). Then the
    number farthest from the line through all of them, in logarithms, among
    those that enter such a factor, is put on the line, until every factor is
    valid; the other numbers stay as counted. Numbers on a line steeper than
    -1 are always valid. Only where no such line exists, in corpora of a few
    documents, absolute discounting by n1 / (n1 + 2 n2) takes its place.
    """
    n = np.array(ranks, float)
    out = np.ones(TOP + 2)
    r = np.arange(1, TOP + 2)
    some = n > 0
    slope, height = np.polyfit(np.log(r[some]), np.log(n[some]), 1) if some.sum() > 1 else (0.0, 0.0)
    if slope < -1:
        line = np.exp(height + slope * np.log(r))
        moved = ~some
        n[moved] = line[moved]
        while True:
            factor = turing(n)
            wrong = ~((factor > 0) & (factor < 1))
            if not wrong.any():
                break
            entered = np.append(wrong, False) | np.append(False, wrong)
            left = entered & ~moved if (entered & ~moved).any() else ~moved
            if not left.any():
                break
            k = int(np.argmax(np.where(left, np.abs(np.log(n / line)), -1)))
            n[k], moved[k] = line[k], True
        if not wrong.any():
            out[1 : TOP + 1] = factor
            return out
    less = ranks[0] / (ranks[0] + 2 * ranks[1]) if ranks[0] and ranks[1] else 0.5
    out[1 : TOP + 1] = (r[:TOP] - less) / r[:TOP]
    return out


@dataclass(frozen=True)
class Statistics:
    """Figures of the whole corpus that every task needs: a few numbers for each order."""

    tokens: int
    known: int
    documents: int
    factors: list[np.ndarray]
    unknown: float  # probability of the unknown word
    denominator: int  # of single words

    def discounted(self, level: int, counts: np.ndarray) -> np.ndarray:
        return self.factors[level][np.minimum(counts, TOP + 1)] * counts

    def always_discounted(self, level: int) -> bool:
        """Whether contexts of up to ``TOP`` places always have mass left for other n-grams."""
        return bool((self.factors[level][1 : TOP + 1] < 1 - 1e-9).all())

    def word(self, counts: np.ndarray) -> np.ndarray:
        """log10 probability of single words of these counts."""
        return np.log10(np.where(counts > 0, self.discounted(0, counts) / self.denominator, self.unknown))

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 probability with one added to every count."""
        return np.log10((counts + 1) / (self.tokens + self.known + 1))


def statistics(blocks: DataFrame, counted: DataFrame, order: int) -> Statistics:
    sums = [F.sum(c).alias(c) for c in ("known", "total", *[f"r{r}" for r in range(1, TOP + 2)])]
    found = {r["level"]: r for r in counted.where(F.col("block") == -1).groupBy("level").agg(*sums).collect()}
    learned = F.size(F.filter(F.zip_with("firsts", "held", lambda f, h: f & ~h), lambda x: x))
    documents = int(blocks.agg(F.sum(learned)).first()[0] or 0)
    ranks = [[int(found[k][f"r{r}"] or 0) if k in found else 0 for r in range(1, TOP + 2)] for k in range(order)]
    tokens = int(found[0]["total"]) if 0 in found else 0
    factors = [discounts(r) for r in ranks]
    free = sum((1 - factors[0][r]) * r * ranks[0][r - 1] for r in range(1, TOP + 1))
    denominator = tokens if free > 1e-9 * tokens else tokens + 1
    unknown = float((free + denominator - tokens) / denominator)
    return Statistics(tokens, int(found[0]["known"]) if 0 in found else 0, documents, factors, unknown, denominator)


def by_level(answers: list[dict]) -> dict[int, list[dict]]:
    out: dict[int, list[dict]] = {}
    for a in sorted(answers, key=lambda a: (a["level"], a["part"])):
        out.setdefault(a["level"], []).append(a)
    return out


class Scores:
    """log10 probabilities of a block's tokens, order by order, from the answers that the block got."""

    def __init__(self, block: Block, counts: list[dict], stats: Statistics):
        self.block, self.stats = block, stats
        found = Counts(block, counts)
        self.known, self.own, self.outside, self.alone = found.known, found.own, found.outside, found.alone
        self.counts = self.known[0][block.gram[0]]
        self.log = stats.word(self.known[0])[block.gram[0]]

    def contexts(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places with a context that the training documents hold and that is sent; their contexts' keys in order, places among these, counts, whether documents not in training have them; the other places, whose contexts only training documents hold.

        Those of the other places need no weight, as every n-gram after them is known, and
        have a discounted one among these.
        """
        block = self.block
        counts = np.append(self.known[level - 1], self.stats.documents if level == 1 else 0)
        sent = np.append(self.outside[level - 1], True)
        if not self.stats.always_discounted(level):
            sent |= ~np.append(self.alone[level - 1], False)
        sent |= counts > TOP
        below = block.context[level]
        at = block.at[level]
        known, there = counts[below[at]] > 0, sent[below[at]]
        at, rest = at[np.flatnonzero(known & there)], at[np.flatnonzero(known & ~there)]
        all_keys = np.append(block.keys[level - 1], START)
        keys, places = ranked(all_keys, below[at])
        of_each = np.zeros(len(keys), np.int64)
        of_each[places] = counts[below[at]]
        return at, keys, places, of_each, np.bincount(places, (block.scored & ~block.train)[at], len(keys)) > 0, rest

    def sums(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each context: its count, whether its weight is wanted, discounted counts, and lower-order probability, of the n-grams that this block sums."""
        at, keys, inverse, counts, wanted, _ = self.contexts(level)
        place = np.full(len(self.block.piece), -1)
        place[at] = inverse
        own = self.own[level]
        own = own[np.flatnonzero(place[own] >= 0)]
        mass = np.bincount(place[own], self.stats.discounted(level, self.known[level][self.block.gram[level][own]]), len(keys))
        lower = np.bincount(place[own], 10 ** self.log[own], len(keys))
        return keys, counts, wanted, mass, lower

    def climb(self, level: int, answers: list[dict]) -> None:
        """Probabilities of the next order."""
        at, keys, inverse, counts, wanted, rest = self.contexts(level)
        none, alpha = np.zeros(0), np.zeros(len(keys))
        alpha[wanted] = np.concatenate([none, *[np.frombuffer(a["a"], "<f8") for a in answers if a["a"]]])
        more = np.concatenate([none, *[np.unpackbits(np.frombuffer(a["b"], np.uint8), count=a["n"]) for a in answers]])
        seen = self.known[level][self.block.gram[level][at]]
        mass = self.stats.discounted(level, np.maximum(seen, 1))
        self.log[at] = np.where(seen > 0, np.log10(mass / (counts + more)[inverse]), alpha[inverse] + self.log[at])
        below = self.known[level - 1][self.block.context[level][rest]]
        mass = self.stats.discounted(level, self.known[level][self.block.gram[level][rest]])
        self.log[rest] = np.log10(mass / (below + (below - mass <= 1e-9 * below)))


def _blocks_with(blocks: DataFrame, answers: list[list[DataFrame]], f, schema: str) -> DataFrame:
    """``f`` of each block and the answers to it, by rounds."""
    fields = [x.split()[0] for x in MESSAGE.split(", ")]
    sent = [a.where(F.col("block") >= 0).select(*fields, F.lit(k).alias("round")) for k, each in enumerate(answers) for a in each]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield f(batch.slice(i, 1))

    if not sent:
        return blocks.mapInArrow(run, schema)
    all_sent = sent[0]
    for a in sent[1:]:
        all_sent = all_sent.union(a)
    # one row per block, with its answers as a list: as many as parts that it has n-grams in
    listed = all_sent.groupBy("block").agg(F.collect_list(F.struct("round", "level", "part", "n", "a", "b", "c")).alias("answers"))
    return blocks.join(listed, "block").mapInArrow(run, schema)


def _scores(row: dict, order: int, stats: Statistics, rounds: int, depth: int) -> Scores:
    answers = [[a for a in row["answers"] if a["round"] == k] for k in range(rounds + 1)]
    scores = Scores(Block(row, order, depth), answers[0], stats)
    for level in range(1, rounds + 1):
        scores.climb(level, by_level(answers[level]).get(level, []))
    return scores


def ask_weights(blocks: DataFrame, answers: list[list[DataFrame]], level: int, order: int, bits: int, stats: Statistics) -> DataFrame:
    """Each block's contexts with their counts and what it has summed after them."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row = batch.drop_columns(["doc_ids"]).to_pylist()[0]
        keys, counts, wanted, mass, lower = _scores(row, order, stats, level - 1, level + 1).sums(level)
        out = []
        for part, s in cut(keys, bits):
            some = mass[s] > 0
            sums = few(mass[s][some]) + lower[s][some].astype("<f8").tobytes()
            out.append((level, part, row["block"], s.stop - s.start, squeeze(keys[s]), pack(counts[s]), np.packbits(np.append(some, wanted[s])).tobytes(), sums))
        return messages(out)

    return _blocks_with(blocks, answers, run, MESSAGE)


def weigh(asked: DataFrame) -> DataFrame:
    """Answers (``a``: log10 backoff weights of the contexts wanted, ``b``: whether the denominator is one more) and, as block -1, the table's parts."""

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        keys, inverse, _ = grouped(np.concatenate([spread(r["keys"], r["n"]) for r in rows]))
        counts, mass, lower, at = np.zeros(len(keys), np.int64), np.zeros(len(keys)), np.zeros(len(keys)), 0
        for r in rows:
            places = inverse[at : at + r["n"]]
            counts[places] = unpack(r["a"], r["n"])
            some = bits_of(r["b"], r["n"])
            first, end = from_few(r["c"], int(some.sum()))
            mass[places[some]] += first
            lower[places[some]] += np.frombuffer(r["c"][end:], "<f8")
            at += r["n"]
        more = counts - mass <= 1e-9 * counts  # nothing was discounted
        alpha = np.log10((1 - mass / (counts + more)) / (1 - lower))
        out, at = [], 0
        for r in rows:
            places = inverse[at : at + r["n"]]
            wanted = bits_of(r["b"], 2 * r["n"])[r["n"] :]
            out.append((r["level"], r["part"], r["block"], r["n"], b"", alpha[places[wanted]].astype("<f8").tobytes(), np.packbits(more[places]).tobytes(), b""))
            at += r["n"]
        out.append((rows[0]["level"], rows[0]["part"], -1, len(keys), squeeze(keys), alpha.astype("<f8").tobytes(), np.packbits(more).tobytes(), pack(counts)))
        return pa.Table.from_batches([messages(out)])

    return asked.groupBy("level", "part").applyInArrow(merge, MESSAGE)


def score(docs: DataFrame, order: int = 2, block_tokens: int = BLOCK_TOKENS, part_keys: int = PART_KEYS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``: a row per document.

    ``base_score`` is the unigram model with one added to each count;
    ``score`` the backoff model's log10 probability of the text.
    """
    blocks = stage_in_buckets(encode(docs, block_tokens, order), "blocks", "block")
    tokens = int(blocks.agg(F.sum("n_tokens")).first()[0] or 0)
    bits = max(0, (tokens // part_keys).bit_length())
    counts: list[DataFrame] = []
    for level in range(order):
        counts.append(stage_and_free(count(ask_counts(blocks, counts, level, order, bits)), "counts"))
    stats = statistics(blocks, reduce(DataFrame.union, counts), order)
    answers = [counts]
    for level in range(1, order):
        # the answers for longer n-grams are not read yet
        lower = [counts[: level + 1], *answers[1:]]
        answers.append([stage_and_free(weigh(ask_weights(blocks, lower, level, order, bits, stats)), "weights")])
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        row = batch.drop_columns(["doc_ids"]).to_pylist()[0]
        scores = _scores(row, order, stats, order - 1, order)
        block, counts = scores.block, scores.counts
        total = lambda x: np.bincount(block.piece, np.where(block.scored, x, 0), block.pieces)
        columns = [total(np.ones(len(counts))).astype(np.int64), total(counts > 0).astype(np.int64), total(stats.base(counts)), total(scores.log)]
        return pa.RecordBatch.from_arrays(
            [pa.array(row["rows"], pa.int64()), batch.column("doc_ids").flatten(), pa.array(row["held"], pa.bool_()), *map(pa.array, columns)],
            ["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
        )

    pieces = _blocks_with(blocks, answers, run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    return pieces.groupBy("row", "doc_id", "held_out").agg(*sums).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(stats.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
