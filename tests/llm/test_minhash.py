"""Near copies by similarity of shingles, against all pairs compared."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from scrubline.llm import minhash, simhash
from scrubline.llm.common import load
from tests.llm import brute
from tests.llm.data import SCHEMA, frame, prose, rows


def jaccard_groups(texts, least=0.8, width=5):
    sets = []
    for t in texts:
        w = brute.words((t or "").translate(brute.LOWER))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    group = list(range(len(texts)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both and both >= least * len(sets[i] | sets[j]):
                group[top(i)] = top(j)
    return [top(i) for i in range(len(texts))]


def firsts(data):
    found = {}
    for g, (d, _, _) in zip(jaccard_groups([t for _, t, _ in data]), data):
        found.setdefault(g, []).append(d)
    return Counter(min((d for d in ids if d is not None), default=None) for ids in found.values())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_stage_finds_the_pairs_of_similarity(spark, sf):
    path = f"/root/testdata/{sf}"
    docs = load(spark, path, "documents")
    want = firsts([(r.doc_id, r.text, None) for r in docs.collect()])
    assert Counter(r.doc_id for r in P.near_dedup(spark, docs, path).collect()) == want


def test_keep_one_of_similar(spark):
    """Copies with one to eight words changed, on both sides of 0.8, in one large group; unusual rows."""
    base = prose(3, 140).split()
    near = [" ".join(w if (i * 37 + k * 11) % 140 >= 1 + k % 8 else f"new{k}" for i, w in enumerate(base)) for k in range(120)]
    data = [*rows(), *[(1000 + k, t, "s") for k, t in enumerate(near)]]
    want = firsts(data)
    assert 20 < len(want) < len(data) - 20
    assert Counter(r.doc_id for r in minhash.keep_one(frame(spark, data)).collect()) == want


def template(n, shared=300, own=75):
    """Texts that share three fifths of their shingles or more, none with a similarity of 0.8."""
    base = prose(4, shared).split()
    return [" ".join([*base, *(f"own{k}x{i}" for i in range(own))]) for k in range(n)]


def test_template_without_links(spark, monkeypatch):
    """A group whose members are all less than 0.8 alike is not compared pair by pair."""
    compared = []
    monkeypatch.setattr(minhash, "alike", lambda pairs, *rest, real=minhash.alike: compared.append(pairs.count()) or real(pairs, *rest))
    data = [(k, t, "s") for k, t in enumerate(template(300))]
    assert minhash.keep_one(frame(spark, data)).count() == 300
    assert sum(compared) <= 600


def test_links_across_leads(spark):
    """A chain in which each text is near to the next only, among copies of its first."""
    words = prose(6, 200).split()
    chain = [words]
    for k in range(12):
        chain.append([*chain[-1][: 15 * k], *(f"c{k}w{i}" for i in range(15)), *chain[-1][15 * k + 15 :]])
    data = [(k, " ".join(w), "s") for k, w in enumerate(chain)]
    data += [(100 + k, " ".join([*words[:100], f"z{k}", *words[101:]]), "s") for k in range(60)]
    assert Counter(r.doc_id for r in minhash.keep_one(frame(spark, data)).collect()) == firsts(data)


def test_fingerprints_find_near_copies(spark, monkeypatch):
    """Near copies meet by their fingerprints also where no two share a band; unlike sets that meet are told apart."""
    monkeypatch.setattr(minhash, "band_keys", lambda x: x[:1] + np.arange(minhash.BANDS, dtype=np.uint64))
    base = prose(8, 2000).split()
    near = [" ".join([*base[:k], f"other{k}", *base[k + 1 :]]) for k in (300, 900, 1500)]
    data = [(k, t, "s") for k, t in enumerate([" ".join(base), *near, "a single line", "another one of them", prose(9, 300)])]
    fps = [simhash.majority(minhash.shingles(t.encode(), 5)) for _, t, _ in data]
    assert all((fps[0] ^ f).bit_count() <= 2 for f in fps[1:4])
    assert Counter(r.doc_id for r in minhash.keep_one(frame(spark, data)).collect()) == Counter([0, 4, 5, 6])


def test_equal_fingerprints_are_compared(spark):
    """Texts of equal fingerprints are paired with one of them, and every fingerprint within two bits with the next."""
    sets = spark.createDataFrame([(1, 0), (2, 0), (3, 3), (4, 7), (5, 1 << 40 | 31)], "node long, fp long")
    met = {tuple(sorted(r)) for r in minhash.by_fingerprint(sets, 2).collect()}
    assert met == {(1, 2), (1, 3), (3, 4)}


def test_joins_on_nodes_are_salted(spark):
    """No join whose key is a node alone may have a side in which it recurs."""
    pairs = spark.range(100).select("id", (F.col("id") % 3).alias("b")).withColumnRenamed("id", "a")
    sets = spark.range(100).select(F.col("id").alias("node"), F.array("id").alias("set"))
    conf = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = minhash.alike(pairs, sets, 0.8)._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line or "ShuffledHashJoin" in line]
    assert joins and all("_salt" in line or "part" in line for line in joins if ", Inner" in line and "set_" in line)


def test_no_documents(spark):
    assert minhash.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0
