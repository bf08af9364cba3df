"""The pipeline against its stages done by brute force."""

import os
from collections import Counter

import corpus_pipeline as P
from scrubline.llm import quality
from scrubline.llm.common import load
from tests.llm import brute
from tests.llm.test_minhash import jaccard_groups

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = load(spark, SF, "documents")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    labels = [(r.doc_id, r.quality) for r in load(spark, SF, "labels").collect()]
    items = [(r.item_id, r.text) for r in load(spark, SF, "benchmark").collect()]
    verdicts = brute.quality([r[:2] for r in rows], labels, quality.BUCKETS, 10.0, -0.1)
    rows = [r for i, r in enumerate(rows) if verdicts[i][2]]
    cleaned = brute.line_dedup(rows, 5, long_sites=5)
    rows = [(r[0], c[0], r[2]) for r, c in zip(rows, cleaned) if not c[2] or brute.words(c[0])]
    group = jaccard_groups([t for _, t, _ in rows])
    first = {}
    for g, (d, _, _) in zip(group, rows):
        first[g] = min(d, first.get(g, d))
    rows = [r for g, r in zip(group, rows) if first[g] == r[0]]
    passages = brute.line_dedup(rows, 5)
    rows = [(r[0], c[0] if brute.words(c[0] or "") else r[1], r[2]) for r, c in zip(rows, passages)]
    found = brute.decontamination([t for _, t, _ in rows], items)
    rows = [r for r, f in zip(rows, found) if not f[3]]
    want = Counter()
    for d, t, _ in rows:
        for k, (start, ids) in enumerate(brute.cut(brute.encode(t, "byte_bpe_50k.json", 0))):
            want[d, k, start, len(ids), brute.crc(ids)] += 1
    got = P.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert len({r.sequence_id for r in got}) == brute.best_fit([r.length for r in got])


def test_stages_keep_the_columns(spark):
    docs = load(spark, SF, "documents")
    for name, step in P.STAGES[:-1]:
        assert step(spark, docs, SF).columns == docs.columns, name


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert os.path.exists(P.__file__)
