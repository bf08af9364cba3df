"""Licence notices in documents, found through a positional index of rare words.

The notices of ``NOTICES`` are indexed by word and place. Of every notice only the
``ANCHORS`` words of highest IDF over all documents are looked up, so a word that
most documents hold costs nothing. Each anchor in a document proposes the offset at
which a notice would begin; an offset that at least ``SHARE`` of a notice's anchors
agree on is a candidate. It counts if all mandatory phrases of the notice stand at
their places from there. The three phrases of ``PHRASES`` go the same way, with all
their words as anchors and as one mandatory phrase.

A document is read once for the document frequencies of the notices' few hundred
words, which are added up before the shuffle, and once for the search, which
shuffles nothing. The index and the frequencies have a size that does not depend on
the documents.

Unusual rows. A null or empty text has no words, no places and score 0. Repeated
rows and rows with null ids each get a result; ids are not looked at. Words of equal
document frequency rank by their spelling. Very long texts are searched whole; beside
the text, the search holds its words and the proposed offsets, which are at most
anchors times places. An empty table gives no rows. The row stays packed in ``row``,
so extra columns keep their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import LOWER, UPPER

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label, words of a published licence notice; mandatory phrases in brackets.
NOTICES = [
    ("agpl", "under the terms of the [gnu affero general public license] as published by the free software foundation"),
    ("apache", "[licensed under the apache license] version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache", "[licensed under the apache license version 2 0]"),
    ("bsd", "[redistribution and use in source and binary forms] with or without modification [are permitted provided that] the following conditions are met"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to [endorse or promote products] derived from this software"),
    ("cc-by", "[licensed under cc by 4 0]"),
    ("cc-by", "this work is licensed under a [creative commons attribution 4 0] international license"),
    ("cc-by-nc", "[licensed under cc by nc 4 0]"),
    ("cc-by-nc", "this work is licensed under a [creative commons attribution noncommercial 4 0] international license"),
    ("cc-by-sa", "[licensed under cc by sa 4 0]"),
    ("cc-by-sa", "this work is licensed under a [creative commons attribution sharealike 4 0] international license"),
    ("gpl", "this program is [free software you can redistribute it] and or modify it under the terms of the [gnu general public license] as published by the free software foundation"),
    ("gpl-3", "this work is [licensed under the gnu general public license version 3]"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose [with or without fee is hereby granted]"),
    ("lgpl", "under the terms of the [gnu lesser general public license] as published by the free software foundation"),
    ("mit", "[permission is hereby granted free of charge] to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "[released under the mit license]"),
    ("mpl", "this source code form is subject to the terms of the [mozilla public license] v 2 0"),
    ("unlicense", "this is [free and unencumbered software] released into the public domain"),
]

ANCHORS = 6
SHARE = 0.6
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = str.maketrans(UPPER, LOWER)


def parsed(notices=None) -> list[tuple[str, list[str], list[tuple[int, int]]]]:
    """``(label, words, mandatory)`` of each notice; ``mandatory`` holds stretches of word places."""
    out = []
    for label, text in NOTICES if notices is None else notices:
        words, mandatory = [], []
        for part in re.split(r"(\[[^]]*\])", text):
            found = part.strip("[]").split()
            if part.startswith("["):
                mandatory.append((len(words), len(words) + len(found)))
            words += found
        out.append((label, words, mandatory))
    return out


def _words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_LOWER))


def frequencies(docs: DataFrame, vocabulary: set[str], text_col: str = "text") -> dict[str, int]:
    """Number of documents that hold each word of ``vocabulary``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for word in vocabulary.intersection(_words(text)):
                    total[word] = total.get(word, 0) + 1
        yield pa.RecordBatch.from_pydict({"word": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())})

    counts = docs.select(F.col(f"`{text_col}`")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {w: 0 for w in vocabulary} | {r["word"]: r["n"] for r in counts.collect()}


def anchors(words: list[str], df: dict[str, int], most: int) -> list[str]:
    """The ``most`` words of highest IDF, that is lowest document frequency, ties by spelling."""
    return sorted(set(words), key=lambda w: (df[w], w))[:most]


class Index:
    """Postings of anchor words: for each word, the entries and places it stands at."""

    def __init__(self, entries: list[tuple[str, list[str], list[tuple[int, int]]]], chosen: list[list[str]], share: float):
        self.entries = entries
        self.need = [math.ceil(share * len(c)) for c in chosen]
        self.postings: dict[str, list[tuple[int, int]]] = {}
        for e, (_, words, _) in enumerate(entries):
            for place, word in enumerate(words):
                if word in chosen[e]:
                    self.postings.setdefault(word, []).append((e, place))

    def found(self, words: list[str]) -> Iterator[tuple[int, int, float]]:
        """``(entry, offset, share of the entry's words that stand at their place)``."""
        votes: dict[tuple[int, int], set[str]] = {}
        for at, word in enumerate(words):
            for e, place in self.postings.get(word, ()):
                votes.setdefault((e, at - place), set()).add(word)
        for (e, offset), agreed in votes.items():
            if len(agreed) < self.need[e]:
                continue
            _, entry, mandatory = self.entries[e]
            if all(offset + a >= 0 and words[offset + a : offset + b] == entry[a:b] for a, b in mandatory):
                same = sum(offset + i >= 0 and words[offset + i : offset + i + 1] == [w] for i, w in enumerate(entry))
                yield e, offset, same / len(entry)


def scan(docs: DataFrame, text_col: str = "text", notices=None, most_anchors: int = ANCHORS, share: float = SHARE) -> DataFrame:
    """Per row ``row``, ``n_words``, the places of base phrases and all labels.

    ``base`` and ``notices`` hold ``(label, start, stop)`` in words by start, and
    ``score`` the greatest share of a notice's words that stand at their place,
    over the notices found; 0 if there is none.
    """
    entries = parsed(notices)
    df = frequencies(docs, {w for _, words, _ in entries for w in words}, text_col)
    chosen = [anchors(words, df, most_anchors) for _, words, _ in entries]
    base = [(label, phrase.split(), [(0, len(phrase.split()))]) for phrase, label in PHRASES.items()]
    notice_index = Index(entries, chosen, share)
    base_index = Index(base, [words for _, words, _ in base], 1.0)
    places = "array<struct<label:string,start:long,stop:long>>"
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def placed(index: Index, words: list[str]) -> tuple[list[dict], float]:
            out, best = [], 0.0
            for e, offset, same in index.found(words):
                label, entry, _ = index.entries[e]
                out.append({"label": label, "start": max(0, offset), "stop": min(len(words), offset + len(entry))})
                best = max(best, same)
            return sorted(out, key=lambda p: (p["start"], p["stop"], p["label"])), best

        for batch in batches:
            counts, bases, found, scores = [], [], [], []
            for text in batch.column("_text").to_pylist():
                words = _words(text)
                counts.append(len(words))
                bases.append(placed(base_index, words)[0])
                spans, best = placed(notice_index, words)
                found.append(spans)
                scores.append(best)
            rows = batch.select(["row"])
            for name, values, kind in (("n_words", counts, pa.int64()), ("base", bases, span), ("notices", found, span), ("score", scores, pa.float64())):
                rows = rows.append_column(name, pa.array(values, kind))
            yield rows

    others = [_quoted(c) for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*others).alias("row"), F.col(_quoted(text_col)).alias("_text"))
    out = f"row {packed.schema['row'].dataType.simpleString()}, n_words long, base {places}, notices {places}, score double"
    return packed.mapInArrow(search, out)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def labels(*places: Column) -> Column:
    """The distinct labels of columns of places, sorted and comma-joined."""
    every = F.concat(*[F.transform(p, lambda x: x["label"]) for p in places])
    return F.array_join(F.array_sort(F.array_distinct(every)), ",")
