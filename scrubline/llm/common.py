"""Small helpers shared by the operators: words, row keys, salted joins, tokenizers."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.staging import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"
SALTS = 16


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Runs of characters other than blank and the five ASCII line and tab characters."""
    return F.array_remove(F.split(text, "[ \\t-\\r]+"), "")


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8, null as empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def keyed(df: DataFrame, *parts: Column) -> DataFrame:
    """Every row packed into ``row``, beside a 128-bit digest ``(k1, k2)`` of ``parts``.

    Packing keeps columns of any name apart from ours; ``row.*`` gives them back.
    Rows with equal parts share a key.
    """
    return df.select(F.struct("*").alias("row"), F.xxhash64(F.lit(1), *parts).alias("k1"), F.xxhash64(F.lit(2), *parts).alias("k2"))


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """``df.where(condition)``, with the columns of ``df`` computed first and once.

    Spark would put their definitions into the condition, and evaluate costly
    ones again for each use. A condition on a task's number stays where it is.
    """
    return df.withColumn("_task", F.spark_partition_id()).where(condition & (F.col("_task") >= 0)).drop("_task")


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread_by: list[str], how: str = "inner") -> DataFrame:
    """Join ``big`` with ``small``, in which a key occurs once, when one key may hold a third of ``big``.

    ``big`` is dealt over ``SALTS`` copies of each row of ``small``, so no
    task gets all rows of a key.
    """
    big = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)))
    small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return big.join(small, [*keys, "_salt"], how).drop("_salt")


def few(df: DataFrame, row_bytes: int) -> bool:
    """Whether the rows of a stage table, counted, are within Spark's own limit for broadcasts."""
    return df.count() * row_bytes <= df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage_and_free(df: DataFrame, label: str) -> DataFrame:
    """Stage ``df``; its shuffle files go as soon as it is written, not when the driver next collects garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAN_UP, None)
    conf.set(CLEAN_UP, "true")
    try:
        return stage(df, label)
    finally:
        conf.unset(CLEAN_UP) if before is None else conf.set(CLEAN_UP, before)


# ── tokenizers ──

MAX_VOCABULARY_BYTES = 64 << 20
MARKS = (b" \x01 ", b"\x01")
_RARE = [bytes([c]) for c in b"\0\x01\t\x0b\x0c\r"]
_LEADS = [bytes([c]) for c in b"\xc2\xe1\xe2\xe3"]
_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2(?:\x80[\x80-\x8a\xa8\xa9\xaf]|\x81\x9f)|\xe3\x80\x80")


def _plain(text: bytes) -> bool:
    """Whether all white space of a text is single blanks and line feeds between other characters."""
    return bool(text) and text[0] not in b" \n" and text[-1] not in b" \n" and not (
        b"  " in text or b" \n" in text or b"\n " in text or b"\n\n" in text
        or any(c in text for c in _RARE) or (any(c in text for c in _LEADS) and _SPACE.search(text))
    )


def vocabulary(path: str) -> dict:
    """A tokenizer's file to broadcast, read on the driver; its size is checked."""
    with open(path, encoding="utf-8") as f:
        text = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(text) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} characters")
    return {"vocabulary": text}


class _Places(dict):
    """Numbers keys as they come; ``new`` holds those not yet encoded."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, key: bytes) -> int:
        self[key] = place = len(self)
        self.new.append(key)
        return place


class PieceEncoder:
    """Encodes texts piece by piece, keeping the ids of up to ``limit`` pieces seen before.

    A text is cut before each blank or line feed between two other characters.
    Both kinds of tokenizer used here cut there as well, so the ids of the
    pieces in a row are the ids of the text. Texts with other white space, or
    more of it in one place, are encoded whole.
    """

    group = 2 << 20

    def __init__(self, vocabulary_text: str, limit: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary_text)
        # where blanks are dropped the mark stands apart as a word, else blanks of its own would be tokens
        self.between = next(m for m in MARKS if len(self._ids([m.decode()])[0]) == 1)
        self.mark = self._ids([self.between.decode()])[0][0]
        self.limit = limit
        # pieces after a blank, and those at a text's start or after a line feed
        self.places = _Places()
        self.flat = np.zeros(0, np.int32)
        self.sizes = np.zeros(0, np.int64)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        """Encode the new pieces; their ids go behind those known.

        Pieces are encoded many to a text, with a control character between
        them that is a token of its own and in none of them.
        """
        new = self.places.new
        texts = [p[1:] if p[:1] == b"\0" else p if p[:1] == b"\n" else b" " + p for p in new]
        bulk = [self.between.join(texts[i : i + 1000]).decode("utf-8", "replace") for i in range(0, len(texts), 1000)]
        ids = [np.array(x, np.int32) for x in self._ids(bulk)]
        # one mark closes each text of a bulk but the last, which a mark of ours closes
        flat = np.concatenate([part for x in ids for part in (x, [self.mark])]).astype(np.int32)
        ends = np.flatnonzero(flat == self.mark)
        sizes = np.diff(ends, prepend=-1) - 1
        self.flat, self.sizes = np.concatenate([self.flat, flat[flat != self.mark]]), np.concatenate([self.sizes, sizes])
        self.places.new = []

    def _forget(self) -> None:
        """Drop the pieces beyond the limit; the earliest, which recur most, stay."""
        while len(self.places) > self.limit:
            self.places.popitem()
        self.sizes = self.sizes[: self.limit]
        self.flat = self.flat[: int(self.sizes.sum())]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        pieces: list[bytes] = []
        counts, at = [], []
        for k, text in enumerate(texts):
            if not _plain(text):
                out[k] = np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.int32)
                continue
            cut = (b"\0" + text).replace(b"\n", b" \n").split(b" ")
            pieces += cut
            counts.append(len(cut))
            at.append(k)
        if not pieces:
            return out
        place = np.fromiter(map(self.places.__getitem__, pieces), np.int64, len(pieces))
        if self.places.new:
            self._learn()
        n = self.sizes[place]
        ends = np.cumsum(n)
        first = (np.cumsum(self.sizes) - self.sizes)[place]
        ids = self.flat[np.repeat(first - ends + n, n) + np.arange(ends[-1])]
        for k, found in zip(at, np.split(ids, ends[np.cumsum(counts)[:-1] - 1])):
            out[k] = found
        if len(self.places) > self.limit:
            self._forget()
        return out


#: steps of the tokenizers that lower-case texts, drop white space and part letters, digits and other characters
_WORD_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
# Latin-1's letters are composed and have one lower case each
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_TAILS = ".,;:!?"


def cuts_words(vocabulary_text: str) -> bool:
    """Whether a tokenizer takes the steps above, with no added token that letters or white space may be in."""
    spec = json.loads(vocabulary_text)
    added = [t["content"] for t in spec["added_tokens"]]
    return all(spec[k] == v for k, v in _WORD_STEPS.items()) and all(t.startswith("<|") and not re.search(r"\s", t) for t in added)


class WordEncoder:
    """Encodes texts word by word, for tokenizers that ``cuts_words`` accepts.

    White space is dropped there, so a text is cut at ASCII white space of any
    kind and length. Arrow numbers the pieces of a group of texts. A piece of
    letters, with one of ``_TAILS`` behind them at most, stands for its
    lower-cased stem, which goes to the tokenizer's merges as it is, and the id
    of its tail. Other pieces take all steps. The ids of up to ``limit`` stems and
    other pieces are kept.
    """

    group = 16 << 20
    at_once = 1 << 18

    def __init__(self, vocabulary_text: str, limit: int = 800_000):
        from tokenizers import Tokenizer, pre_tokenizers

        # a task has one core, on which threads of the library only take time from each other
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole, self.merges = Tokenizer.from_str(vocabulary_text), Tokenizer.from_str(vocabulary_text)
        self.merges.normalizer, self.merges.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        written = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        # how the merges' alphabet writes the bytes of letters and of the mark between pieces
        self.letters = {c: written(chr(c))[0][0] for c in range(0xC0, 0x100)}
        (self.mark,), self.mark_written = self._ids(self.whole, ["\x01"])[0], written("\x01")[0][0]
        tails = {ord(c): ids for c, ids in zip(_TAILS, self._ids(self.whole, list(_TAILS))) if len(ids) == 1}
        self.tails = np.full(256, -1, np.int32)
        self.tails[list(tails)] = [ids[0] for ids in tails.values()]
        self.word = f"^[{_LETTERS}]+[{''.join(map(chr, tails))}]?$"
        self.limit = limit
        self.known = pa.array([], pa.string())
        self.flat = np.zeros(0, np.int32)
        self.sizes = np.zeros(0, np.int32)

    def _ids(self, tokenizer, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _many(self, tokenizer, mark: str, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of pieces, a thousand to a text with a mark behind each."""
        bulk = [f" {mark} ".join([*pieces[i : i + 1000], ""]) for i in range(0, len(pieces), 1000)]
        flat = np.fromiter(chain.from_iterable(self._ids(tokenizer, bulk)), np.int32)
        ends = np.flatnonzero(flat == self.mark)
        return flat[flat != self.mark], np.diff(ends, prepend=-1) - 1

    def _learn(self, new: pa.Array, stem: np.ndarray) -> np.ndarray:
        """Encode new pieces, of which some are stems; their ids go behind those known. The result is the order they are kept in."""
        marked = pc.match_substring(new, "\x01").to_numpy(zero_copy_only=False)
        kinds = [np.flatnonzero(m) for m in (stem, ~stem & ~marked, marked)]
        parts = [new.take(pa.array(k)) for k in kinds]
        stems, others, alone = ([p.decode("utf-8", "replace") for p in x.cast(pa.binary()).to_pylist()] for x in parts)
        single = [np.array(x, np.int32) for x in self._ids(self.whole, alone)]
        found = [
            self._many(self.merges, self.mark_written, [p if p.isascii() else p.translate(self.letters) for p in stems]),
            self._many(self.whole, "\x01", others),
            (np.concatenate([self.flat[:0], *single]), [len(x) for x in single]),
        ]
        self.known = pa.concat_arrays([self.known, *parts])
        self.flat = np.concatenate([self.flat, *[ids for ids, _ in found]])
        self.sizes = np.concatenate([self.sizes, *[np.asarray(n, np.int32) for _, n in found]])
        return np.concatenate(kinds)

    def _forget(self) -> None:
        """Drop the pieces beyond the limit; the earliest, which recur most, stay."""
        # concatenated, as a slice would hold on to all pieces
        self.known = pa.concat_arrays([self.known.slice(0, self.limit), self.known.slice(0, 0)])
        self.sizes = self.sizes[: self.limit]
        self.flat = self.flat[: int(self.sizes.sum())].copy()

    def _table(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct pieces one after the other, and where each piece's start and how many they are."""
        word = pc.match_substring_regex(pieces, self.word).to_numpy(zero_copy_only=False)
        order = np.concatenate([np.flatnonzero(word), np.flatnonzero(~word)])
        words, others = (pieces.filter(pa.array(m)) for m in (word, ~word))
        many = len(words)
        tail = np.full(len(pieces), -1, np.int32)
        if many:
            stops = np.frombuffer(words.buffers()[1], np.int32)[words.offset + 1 : words.offset + many + 1]
            tail[:many] = self.tails[np.frombuffer(words.buffers()[2], np.uint8)[stops - 1]]
        stems = pa.concat_arrays([pc.utf8_rtrim(pc.utf8_lower(words), _TAILS), others]).dictionary_encode()
        stand_for = stems.indices.to_numpy()
        place = pc.index_in(stems.dictionary, self.known).fill_null(-1).to_numpy().copy()
        new = np.flatnonzero(place < 0)
        if len(new):
            held = len(self.known)
            stem = np.zeros(len(place), bool)
            stem[stand_for[:many]] = True
            place[new[self._learn(stems.dictionary.take(pa.array(new)), stem[new])]] = np.arange(held, held + len(new))
        place = place[stand_for]
        tailed = tail >= 0
        n = self.sizes[place] + tailed
        stops = np.cumsum(n, dtype=np.int64)
        first = (np.cumsum(self.sizes, dtype=np.int64) - self.sizes)[place]
        flat = np.append(self.flat, np.int32(0))[np.repeat(first - stops + n, n) + np.arange(n.sum())]
        flat[stops[tailed] - 1] = tail[tailed]
        first, size = np.empty_like(stops), np.empty_like(n)
        first[order], size[order] = stops - n, n
        return flat, first, size

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text."""
        cut = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
        pieces = cut.flatten().dictionary_encode()
        flat, first, size = self._table(pieces.dictionary)
        codes, bounds = pieces.indices.to_numpy(), cut.offsets.to_numpy()
        out: list[np.ndarray] = []
        while len(out) < len(texts):
            low = len(out)
            high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + self.at_once, "right")) - 1)
            code = codes[bounds[low] : bounds[high]]
            n = size[code]
            stops = np.cumsum(n, dtype=np.int64)
            ids = flat[np.repeat(first[code] - stops + n, n) + np.arange(n.sum())]
            out += np.split(ids, np.append(0, stops)[bounds[low + 1 : high] - bounds[low]])
        if len(self.known) > self.limit:
            self._forget()
        return out


def encoder(shared: dict) -> PieceEncoder | WordEncoder:
    """The encoder of this worker process, kept beside the broadcast vocabulary from task to task."""
    if "encoder" not in shared:
        shared["encoder"] = (WordEncoder if cuts_words(shared["vocabulary"]) else PieceEncoder)(shared["vocabulary"])
    return shared["encoder"]


def in_groups(batches: Iterator[pa.RecordBatch], most: int = 8 << 20, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes, so that one slice's working arrays stay small."""
    for batch in batches:
        at = 0
        step = max(1, min(rows, int(most * batch.num_rows / max(1, batch.nbytes))))
        while at < batch.num_rows:
            yield batch.slice(at, step)
            at += step

