"""The language model's discounts, worked out apart from the model's own functions."""

import math

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from scrubline.llm import katz
from tests.llm import brute
from tests.llm.data import frame, prose

# numbers of words, pairs and triples that occur 1 to 6 times in the training documents of sf0.001 and sf0.01
COUNTED = {
    "sf0.001": [[16698, 3601, 1290, 594, 471, 213], [45315, 4880, 1537, 331, 336, 86], [51420, 4383, 1317, 106, 234, 25]],
    "sf0.01": [[49663, 12919, 5197, 2729, 2383, 1067], [193655, 25105, 6496, 2179, 2497, 618], [236165, 23946, 5206, 1219, 1924, 208]],
}


def factor(n, r):
    beyond = 6 * n[6] / n[1]
    return ((r + 1) * n[r + 1] / (r * n[r]) - beyond) / (1 - beyond)


def on_line(n):
    x, y = [math.log(r) for r in range(1, 7)], [math.log(n[r]) for r in range(1, 7)]
    mx, my = sum(x) / 6, sum(y) / 6
    slope = sum((a - mx) * (b - my) for a, b in zip(x, y)) / sum((a - mx) ** 2 for a in x)
    return {r: math.exp(my + slope * (x[r - 1] - mx)) for r in range(1, 7)}


@pytest.mark.parametrize("ranks", [x for found in COUNTED.values() for x in found])
def test_good_turing_with_copies(ranks):
    """One to five counts are repaired, the others have Good-Turing's factors; none is absolute discounting."""
    got = katz.discounts(ranks)
    assert all(0 < got[r] < 1 for r in range(1, 6)) and got[6] == 1
    n, line = dict(enumerate(ranks, 1)), on_line(dict(enumerate(ranks, 1)))
    for _ in range(7):
        wrong = [r for r in range(1, 6) if not 0 < factor(n, r) < 1]
        if not wrong:
            break
        near = {k for r in wrong for k in (r, r + 1) if n[k] != line[k]} or {k for k in n if n[k] != line[k]}
        worst = max(near, key=lambda k: abs(math.log(n[k] / line[k])))
        n[worst] = line[worst]
    assert [got[r] for r in range(1, 6)] == pytest.approx([factor(n, r) for r in range(1, 6)])
    assert sum(n[k] == ranks[k - 1] for k in n) >= 3
    less = ranks[0] / (ranks[0] + 2 * ranks[1])
    assert got[1] != pytest.approx(1 - less)


def test_valid_counts_stay_as_they_are():
    ranks = [6000, 1800, 800, 420, 250, 160]
    n = dict(enumerate(ranks, 1))
    assert katz.discounts(ranks)[1:6].tolist() == pytest.approx([factor(n, r) for r in range(1, 6)])


@pytest.mark.parametrize("ranks", [[0] * 6, [5, 0, 0, 0, 0, 0], [3, 3, 3, 3, 3, 3], [100, 20, 0, 3, 0, 0], [40, 9, 30, 2, 0, 1]])
def test_few_counts(ranks):
    assert all(0 < x < 1 for x in katz.discounts(ranks)[1:6])


@pytest.mark.parametrize("n", [1, 2, 60_000])
def test_keys_as_differences(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 64, n, np.uint64, endpoint=False) if n > 2 else np.array([3, (1 << 64) - 1][:n], np.uint64))
    data = katz.squeeze(keys)
    assert katz.spread(data, len(keys)).tolist() == keys.tolist()
    assert n < 60_000 or len(data) < 7.1 * n


def test_lone_contexts_are_not_sent(spark, monkeypatch):
    """N-grams after words that stand nowhere else are counted where they are; scores and numbers are those of all n-grams."""
    sent = []
    monkeypatch.setattr(katz, "count", lambda asked, real=katz.count: sent.append(asked.selectExpr("sum(n)").first()[0]) or real(asked))
    common = prose(5, 60)
    data = [(k, f"{common} " + " ".join(f"own{k}x{i}" for i in range(40)) + (f" own{k - 1}x7 own{k - 1}x8 end" if k else ""), "s") for k in range(30)]
    model = brute.Katz([(str(d), t) for d, t, _ in data], 3, katz.discounts)
    got = {r.doc_id: r for r in katz.score(frame(spark, data), order=3, block_tokens=1000, part_keys=500).collect()}
    assert [got[d].score for d, _, _ in data] == pytest.approx([model.score(t) for _, t, _ in data], rel=1e-9)
    assert max(sent[1:]) < 0.7 * sent[0]


def test_contexts_of_training_alone_are_not_sent(spark, monkeypatch):
    """Weights are worked out for contexts that other documents hold, or that stand too often to be discounted for certain."""
    sent = []
    monkeypatch.setattr(katz, "weigh", lambda asked, real=katz.weigh: sent.append(asked.selectExpr("sum(n)").first()[0] or 0) or real(asked))
    common = prose(6, 30)
    data = [(k, f"{common} " + (prose(50 + k // 3, 80) if katz.held_out(str(k)) else " ".join(f"pair{k // 2}x{i}" for i in range(200))), "s") for k in range(30)]
    assert any(katz.held_out(str(d)) for d, _, _ in data)
    model = brute.Katz([(str(d), t) for d, t, _ in data], 3, katz.discounts)
    got = {r.doc_id: r for r in katz.score(frame(spark, data), order=3, block_tokens=1000, part_keys=500).collect()}
    assert [got[d].score for d, _, _ in data] == pytest.approx([model.score(t) for _, t, _ in data], rel=1e-9)
    assert 0 < max(sent) < 2000  # of some 2000 words and pairs that two training documents share, none


def test_blocks_are_not_shuffled(spark, monkeypatch):
    """Only answers move to the blocks."""
    plans = []

    def explained(blocks, answers, f, schema, real=katz._blocks_with):
        out = real(blocks, answers, f, schema)
        plans.append((bool(answers), out._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(katz, "_blocks_with", explained)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        names = set(x.name for x in spark.catalog.listTables())
        assert katz.score(frame(spark), order=3, block_tokens=1000, part_keys=500).count() == len(frame(spark).collect())
        assert set(x.name for x in spark.catalog.listTables()) == names
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joined = [p for answered, p in plans if answered]
    assert len(joined) == 5 and all(p.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in p for p in joined)


def test_words_are_numbered_as_bytes_split():
    texts = ["left out", None, "", " ", "\n a", "A b\x0bC\x0c\r\x1cq  ", "x\x85y\u00a0z   w", "\u00c9 \u00e9\t\u00c0 \u2003", "b A b"]
    keys, flat, sizes = katz.numbered(pa.array(texts, pa.string()).slice(1))
    pieces = [keys[x].tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]
    assert pieces == [[xxhash.xxh64_intdigest(w) for w in (t or "").encode().lower().split()] + [int(katz.END)] for t in texts[1:]]


@pytest.mark.parametrize("spread", [1, 1 << 30])
def test_groups_of_keys_alike_in_their_high_bits(spread):
    """Places ride in the lowest bits while keys are sorted; keys that differ there alone are still apart."""
    keys = np.random.default_rng(5).integers(0, 50, 1000).astype(np.uint64) * np.uint64(spread) + np.uint64(1 << 60)
    distinct, places, one = katz.grouped(keys)
    assert distinct.tolist() == sorted(set(keys.tolist())) and distinct[places].tolist() == keys.tolist() and keys[one].tolist() == distinct.tolist()


@pytest.mark.parametrize("distinct", [1, 300, 70_000])
def test_numbers_of_which_many_are_equal(distinct):
    values = np.arange(150_000) % distinct / 7
    got, end = katz.from_few(katz.few(values) + b"rest", len(values))
    assert got.tolist() == values.tolist() and end == len(katz.few(values))
