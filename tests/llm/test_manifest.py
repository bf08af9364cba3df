"""Merkle manifest against trees built in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from scrubline.llm import manifest
from scrubline.llm.common import ascii_lower
from tests.llm import brute, data

FIELDS = "doc_id long, source string, lang string, n_chars long, text string, tree string, lo long, path string, leaf string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, "p", "l") for r in rows], FIELDS).repartition(4)


def made(spark, rows):
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, ascii_lower(F.col("text")))
    return manifest.build(manifest.leaves(frame(spark, rows), altered=changed))


def results(m):
    out = manifest.check(m.proofs())
    rows = out.select("id", "leaf", "subroot", "root", F.sha2(manifest.siblings(F.col("path")), 256), "folded_root", "verified").collect()
    return sorted(map(tuple, rows), key=str)


def rows_of(sizes, seed=0):
    r = random.Random(seed)
    out = [(i, r.choice(["a", None, "é"]), lang, r.choice([None, 7]), r.choice(["Text A", "", None, "ÉZ x"]) if i % 5 else data.prose(i, 9)) for lang, n in sizes.items() for i in range(n)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("sizes", [
    {"en": 1}, {"en": 8}, {"en": 9}, {None: 1, "en": 1}, {"en": 600, None: 65, "de": 64, "fr": 1, "": 2, "é": 9, "z": 7, "Z": 8, "日": 3, "a": 1},
])
def test_like_plain_trees(spark, sizes):
    rows = rows_of(sizes)
    assert results(made(spark, rows)) == sorted(brute.manifest(rows), key=str)


def test_null_and_repeated_rows(spark):
    rows = [*rows_of({"en": 20, None: 9}), (None, None, "en", None, None), (3, "a", "en", 1, "Other")]
    rows += [rows[0]] * 12
    assert results(made(spark, rows)) == sorted(brute.manifest(rows), key=str)


def test_nodes_nest(spark):
    nodes = made(spark, rows_of({"en": 100, "de": 9})).nodes().collect()
    for lang, n in (("=en", 100), ("=de", 9)):
        own = [x for x in nodes if x.tree == lang]
        assert max(x.hi for x in own) == n
        for level in {x.level for x in own}:
            spans = sorted((x.lo, x.hi) for x in own if x.level == level)
            assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert {(x.lo, x.hi) for x in nodes if x.tree == "*"} == {(0, 1), (1, 2), (0, 2)}


def test_every_change_is_noticed(spark):
    rows = rows_of({"en": 70, "de": 3})
    out = manifest.check(made(spark, rows).proofs())
    text = {(r[0], r[2]): r[4] for r in rows}
    for r in out.select("id", "tree", "altered", "leaf", "verified").collect():
        before = text[r.id, r.tree[1:]]
        assert r.verified == (r.altered is None or before.translate(brute.LOWER) == before)


def test_empty_table(spark):
    m = made(spark, rows_of({"en": 1})[:0])
    assert m.proofs().count() == 0 and m.nodes().count() == 0
