"""The registered language model query."""

import zlib

import pytest

from scrubline.llm import katz, queries
from tests.llm import brute


def test_query_scores_by_triples(spark):
    """The registered query against dictionaries of words, pairs and triples."""
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    scored = {r.doc_id: r for r in queries.op7_katz(spark, sf).collect()}
    model = brute.Katz([(str(d), t) for d, t in docs], 3, katz.discounts)
    some = [(d, t) for d, t in docs if len(t or "") < 4000][:20]
    assert any(zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in some)
    for d, t in some:
        assert scored[d].score == pytest.approx(model.score(t), rel=1e-9)
