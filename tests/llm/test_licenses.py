"""Licence search against a search at every offset."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from scrubline.llm import licenses
from tests.llm import brute, data

PROSE = data.prose(8, 40)


def results(df):
    starts = F.transform("base", lambda p: p["start"])
    out = df.select("row.doc_id", "n_words", F.size("base"), F.array_min(starts), F.array_max(starts), licenses.labels(F.col("base")), licenses.labels(F.col("base"), F.col("notices")), "score")
    return Counter(map(tuple, out.collect()))


def texts():
    plain = [text.replace("[", "").replace("]", "") for _, text in licenses.NOTICES]
    changed = [" ".join(w if k % 5 else "other" for k, w in enumerate(t.split())) for t in plain]
    cut = [t[len(t) // 3 :] for t in plain]
    return [
        *plain, *changed, *cut, *[f"{PROSE} {t.upper()}. {PROSE}" for t in plain], " ".join(plain),
        "MIT License mit-license MIT\nLICENSE", "general public license " * 50, "the mit licenses", "mit", "license mit", "MİT license", "Licensed under CC BY-NC 4.0.",
    ]


def test_like_a_search_at_every_offset(spark):
    rows = [*data.rows(), *[(1000 + i, t, "s") for i, t in enumerate(texts())]]
    got = results(licenses.scan(data.frame(spark, rows)))
    assert got == Counter(brute.licences([r[:2] for r in rows], licenses.PHRASES, licenses.NOTICES, licenses.ANCHORS, licenses.SHARE))


@pytest.mark.parametrize("most, share", [(1, 1.0), (3, 0.5), (100, 0.3)])
def test_other_parameters(spark, most, share):
    rows = [(i, t, "s") for i, t in enumerate(texts())]
    notices = [*licenses.NOTICES, ("own", "one two one three [one two] four")]
    rows += [(900, "one two one three one two four", "s"), (901, "x one two one three one two", "s"), (902, "one two", "s")]
    got = results(licenses.scan(data.frame(spark, rows), notices=notices, most_anchors=most, share=share))
    assert got == Counter(brute.licences([r[:2] for r in rows], licenses.PHRASES, notices, most, share))


def test_places_and_long_text(spark):
    text = "word " * 200_000 + "released under the MIT license"
    row = licenses.scan(data.frame(spark, [(1, text, "s")])).first()
    assert [tuple(p) for p in row.base] == [("mit", 200_003, 200_005)]
    assert [tuple(p) for p in row.notices] == [("mit", 200_000, 200_005)]
    assert (row.n_words, row.score) == (200_005, 1.0)


def test_empty_table(spark):
    assert licenses.scan(data.frame(spark, []).limit(0)).count() == 0
