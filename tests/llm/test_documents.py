"""Operators on documents against brute force, with unusual rows."""

from collections import Counter, defaultdict
from copy import copy
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scrubline.llm import decontam, katz, linededup, packing, privacy, quality, repair, simhash
from scrubline.staging import new_path
from tests.llm import brute
from tests.llm.data import SCHEMA, frame, prose, rows

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


def vocabulary(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def text_key(text):
    return (text is None, text or "")


# ── near duplicates ──


def simhash_groups(data, width, radius=2):
    fps = [brute.fingerprint(t, width) for _, t, _ in data]
    group = brute.components(fps, radius)
    ids = defaultdict(list)
    for g, (d, _, _) in zip(group, data):
        ids[g].append(d)
    name = {g: min((d for d in found if d is not None), default=None) for g, found in ids.items()}
    return fps, [name[g] for g in group]


def test_simhash_groups(spark):
    data = rows()
    fps, named = simhash_groups(data, 3)
    got = simhash.groups(frame(spark), width=3).collect()
    want = Counter((d, f, n) for (d, _, _), f, n in zip(data, fps, named))
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    assert len(set(named)) < len(data) - 5


def test_keep_one(spark):
    data = rows()
    _, named = simhash_groups(data, 5)
    kept = simhash.keep_one(frame(spark)).collect()
    assert Counter(r.doc_id for r in kept) == Counter(set(named))
    assert kept[0].asDict().keys() == {x.split()[0].strip("`") for x in SCHEMA.split(", ")}


def test_components_of_a_chain(spark):
    """A path whose labels have far to travel, beside a star."""
    chain = [(i * 37 % 1009, (i + 1) * 37 % 1009) for i in range(300)]
    star = [(5000, 5001 + i) for i in range(200)]
    edges = spark.createDataFrame(chain + star, "a long, b long")
    found = dict(map(tuple, simhash.components(edges).collect()))
    nodes = [x for e in chain for x in e]
    assert all(found[x] == min(nodes) for x in nodes)
    assert all(found[5001 + i] == 5000 for i in range(200))


def test_links_join_all_close_fingerprints(spark):
    base = 0x0123456789ABCDEF
    fps = [base, base ^ 1, base ^ 3, base ^ (1 << 63), base ^ (3 << 40), base ^ 0xFF, ~base & (1 << 64) - 1]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    group = {f: f for f in fps}
    for a, b in ((r.a % (1 << 64), r.b % (1 << 64)) for r in links):
        assert (a ^ b).bit_count() <= 2
        low, high = sorted((group[a], group[b]))
        group = {k: low if v == high else v for k, v in group.items()}
    want = brute.components(fps)
    assert len({group[f] for f in fps}) == len(set(want))


# ── lines ──


def test_line_dedup(spark):
    data = rows()[:-1]
    got = {r.row.doc_id: (r.text, r.n_lines, r.n_removed) for r in linededup.remove(frame(spark, data)).collect()}
    want = dict(zip((d for d, _, _ in data), brute.line_dedup(data, 5)))
    assert got == want
    assert sum(x[2] for x in want.values()) >= 7


def test_line_dedup_counts_near_the_threshold(spark):
    """Sites on both sides of the threshold, where sketches alone would err."""
    data = [(100 * k + s, f"line number {k} here", f"s{s}") for k in range(1, 60) for s in range(k)]
    got = linededup.remove(frame(spark, data), min_sites=30, log_k=4).where("n_removed > 0").count()
    assert got == sum(k - 1 for k in range(30, 60))


def test_line_dedup_drops_emptied_documents(spark):
    data = [(i, "the very same line", f"s{i}") for i in range(6)] + [(9, "", "s1"), (10, "own words", "s2")]
    kept = linededup.clean(frame(spark, data)).collect()
    assert sorted((r.doc_id, r.text, r.n_chars) for r in kept) == [(0, "the very same line", 18), (10, "own words", 9)] or sorted(r.doc_id for r in kept) == [0, 9, 10]


def passage_rows():
    """Passages of 51 words on one, two and four sites, one of them hot; one of 50 words on four."""
    long = {k: " ".join(f"{k}{i}" for i in range(51)) for k in "abc"}
    short = " ".join(f"d{i}" for i in range(50))
    own = lambda i: f"own words of {i}"
    data = [(i, f"{own(i)}\n{long['a']}", "hot") for i in range(300)]
    data += [(1000 + i, f"{long['b']}\n{own(i)}", "hot" if i else "cold") for i in range(300)]
    data += [(2000 + i, f"{long['c']}\n{own(i)}\n{short}", f"s{i % 4}") for i in range(40)]
    return data + [(3000, long["b"], "cold"), (3001, None, None), (3002, "", None)]


def test_long_lines_go_on_two_sites(spark):
    data = passage_rows()
    for log_k in (4, 12):
        got = {r.row.doc_id: (r.text, r.n_lines, r.n_removed) for r in linededup.remove(frame(spark, data), log_k=log_k).collect()}
        assert got == dict(zip((d for d, _, _ in data), brute.line_dedup(data, 5)))
    assert sum(x[2] for x in got.values()) == 299 + 39 + 1


def test_documents_of_one_passage_can_stay(spark):
    docs = frame(spark, passage_rows())
    left = {how: {r.doc_id: r.text for r in linededup.clean(docs, emptied=how).collect()} for how in ("drop", "keep")}
    assert set(left["keep"]) - set(left["drop"]) == {3000} and left["keep"][3000].startswith("b0 b1")


@pytest.mark.parametrize(("limit", "join"), [("10m", "BroadcastHashJoin"), ("44k", "SortMergeJoin"), ("-1", "SortMergeJoin")])
def test_salted_copies_of_lines_are_not_broadcast(spark, monkeypatch, limit, join):
    """2000 digests of 16 bytes are below 44 KB as stored; their 16 copies are not."""
    passage = lambda k: " ".join(f"p{k}" for _ in range(51))
    data = [(1000 * s + i, "\n".join(passage(10 * i + j) for j in range(10)), f"s{s}") for s in range(2) for i in range(200)]
    data += [(5000 + i, f"{passage(7)}\nown words of {i}", "s0") for i in range(300)] + [(None, None, None), (6000, "", "s1")]
    plans, stage = {}, linededup.stage

    def seen(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df, label)

    monkeypatch.setattr(linededup, "stage", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        got = {r.row.doc_id: (r.text, r.n_lines, r.n_removed) for r in linededup.remove(frame(spark, data)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == dict(zip((d for d, _, _ in data), brute.line_dedup(data, 5)))
    assert sum(x[2] for x in got.values()) == 2000 + 300
    joins = [line for label in ("spread", "found") for line in plans[label].splitlines() if "Join [h1" in line]
    assert len(joins) == 2 and all(join in line and ("_salt" in line) == (join == "SortMergeJoin") for line in joins)


# ── benchmark passages ──


def bench(spark):
    items = [(1, prose(300, 40)), (2, prose(301, 5)), (3, ""), (4, None), (5, "Alpha beta"), (10, prose(300, 40)), (None, prose(302, 20))]
    return items, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [1 << 20, 100])
def test_decontamination(spark, block):
    items, table = bench(spark)
    passage = brute.LETTER_WORD.findall(items[0][1])
    data = [*rows(), (900, prose(1, 100) + " ".join(passage[4:30]) + prose(2, 30), "s"), (901, items[1][1].upper(), "s"), (902, "x alpha, BETA y alpha beta beta", "s"), (903, prose(4, 2000) + " " + " ".join(passage[:13]), "s")]
    want = brute.decontamination([t for _, t, _ in data], items)
    h = decontam.hits(frame(spark, data), table, ["doc_id"], block_bytes=block)
    n_hit = F.aggregate("hits.spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    got = h.select("row.doc_id", "hits.n_words", n_hit.alias("n"), "hits.items").collect()
    assert Counter((r.doc_id, r.n_words, r.n, tuple(r["items"])) for r in got) == Counter((d, w[0], w[1], tuple(w[2])) for (d, _, _), w in zip(data, want))
    kept = decontam.clean(frame(spark, data), table)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for (d, _, _), w in zip(data, want) if not w[3])
    assert sum(w[3] for w in want) >= 2


def test_benchmark_blocks_are_held_one_at_a_time(spark, monkeypatch):
    """Twenty blocks: the tables of one are freed before those of the next are sent."""
    items = [(i, prose(50 + i, 30)) for i in range(40)]
    table = spark.createDataFrame(items, "item_id long, text string")
    data = [(i, prose(900 + i, 40) + " " + items[i % 40][1] + " " + items[(i * 7) % 40][1], "s") for i in range(60)] + [(99, None, None)] * 2
    held, most, sent = set(), [], decontam.searched

    def counted(docs, mine, width):
        out, shared = sent(docs, mine, width)
        held.add(shared.id if hasattr(shared, "id") else id(shared))
        most.append(len(held))
        free = shared.destroy
        shared.destroy = lambda: (held.clear(), free())
        return out, shared

    monkeypatch.setattr(decontam, "searched", counted)
    size = sum(len(t.encode()) for _, t in items)
    got = decontam.hits(frame(spark, data), table, ["doc_id"], block_bytes=-(-size // 20)).collect()
    want = brute.decontamination([t for _, t, _ in data], items)
    n_hit = lambda r: sum(s.stop - s.start for s in r.hits.spans)
    assert Counter((r.row.doc_id, r.hits.n_words, n_hit(r), tuple(r.hits["items"])) for r in got) == Counter((d, w[0], w[1], tuple(w[2])) for (d, _, _), w in zip(data, want))
    assert len(most) == 20 and max(most) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=7), min_size=1, max_size=6), st.lists(st.sampled_from("abcd"), max_size=60))
def test_search_finds_every_occurrence(items, words):
    text = " ".join(words).encode()
    tables = decontam.searchers(((str(i), " ".join(x).encode()) for i, x in enumerate(items)), 4)
    got = {(at, s.length) for s in tables for at, _ in s.find(decontam.split_words(text))}
    grams = {tuple(x[i : i + min(4, len(x))]) for x in items for i in range(len(x) - min(4, len(x)) + 1)}
    assert got == {(i, len(g)) for g in grams for i in range(len(words)) if tuple(words[i : i + len(g)]) == g}


# ── tokens ──


def test_packing(spark):
    data = rows()
    got = packing.pack(frame(spark), vocabulary(BYTE)).collect()
    want = Counter()
    for d, t, _ in data:
        for k, (start, ids) in enumerate(brute.cut(brute.encode(t, BYTE, 0))):
            want[d, k, start, len(ids), brute.crc(ids)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for slots in filled.values():
        slots.sort()
        assert [s[0] for s in slots] == [sum(x[1] for x in slots[:i]) for i in range(len(slots))]
        assert sum(x[1] for x in slots) <= 2048
    assert len(filled) == brute.best_fit([r.length for r in got])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_is_best_fit(lengths):
    runs = packing.plan(Counter(lengths), 40)
    slots = [(n, rank, first + (rank - low) // times, offset + (rank - low) % times * n) for n, low, high, first, offset, times in runs for rank in range(low, high)]
    assert Counter(s[0] for s in slots) == Counter(lengths) and len({s[:2] for s in slots}) == len(lengths)
    filled = defaultdict(list)
    for n, _, seq, offset in slots:
        filled[seq].append((offset, n))
    for x in filled.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))] and sum(n for _, n in x) <= 40
    assert len(filled) == brute.best_fit(lengths, 40)


def test_token_files(spark):
    data = rows()
    path = new_path(spark, "tokens")
    repair.write(frame(spark), path, vocabulary(WORD), shard_ids=3000)
    got = sorted(map(tuple, repair.read(spark, path).collect()), key=lambda r: r[1])
    order = sorted(range(len(data)), key=lambda i: (data[i][0] is not None, data[i][0] or 0))
    ids = [brute.encode(data[i][1], WORD, 2) for i in order]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).tolist()
    assert got == [(data[i][0], s, len(x), brute.crc(x)) for i, s, x in zip(order, starts, ids)]
    assert repair.read_document(spark, path, 24) == brute.encode(data[24][1], WORD, 2)
    with pytest.raises(KeyError):
        repair.read_document(spark, path, 12345)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=60), min_size=1, max_size=8))
def test_grammar_round_trip(docs):
    ids = np.array([x for d in docs for x in [*d, 9]], np.int32)
    ends = np.zeros(len(ids), bool)
    ends[np.cumsum([len(d) + 1 for d in docs]) - 1] = True
    seq, starts, left, right = repair.compress(ids, ends, 100, least=2)
    assert repair.expand(seq, left, right, 100).tolist() == ids.tolist()
    sizes = repair.expansion_lengths(left, right, 100)
    for k in range(len(left)):
        assert len(repair.expand(np.array([100 + k], np.int32), left, right, 100)) == sizes[k]
    for d, a, b in zip(docs, starts, starts[1:]):
        assert repair.expand(seq[a:b], left, right, 100).tolist() == [*d, 9]


def test_grammar_makes_files_smaller():
    ids = np.tile(np.arange(50, dtype=np.int32), 400)
    ends = np.zeros(len(ids), bool)
    ends[-1] = True
    assert len(repair.compress(ids, ends, 100)[0]) < len(ids) / 20


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=60), min_size=1, max_size=8), st.integers(0, 4))
def test_rules_are_expanded_once(docs, rounds):
    """By the rules' sizes a shard's symbols become the same ids as round by round."""
    ids = np.array([x for d in docs for x in [*d, 9]], np.int32)
    ends = ids == 9
    seq, _, left, right = repair.compress(ids, ends, 100, rounds, least=2)
    sizes = repair.expansion_lengths(left, right, 100)
    assert repair.expand(np.tile(seq, 9), left, right, 100, sizes).tolist() == ids.tolist() * 9


def test_rounds_leave_out_pairs_that_were_rare(monkeypatch):
    """A round looks again only at pairs that were frequent or have a new symbol."""
    seen = []
    monkeypatch.setattr(repair, "_code", lambda pairs, real=repair._code: seen.append(len(pairs)) or real(pairs))
    ids = np.concatenate([np.arange(100, 10_100), np.tile([1, 2, 3, 4], 500)]).astype(np.int32)
    ends = np.zeros(len(ids), bool)
    ends[-1] = True
    seq, _, left, right = repair.compress(ids, ends, 1 << 16)
    assert repair.expand(seq, left, right, 1 << 16).tolist() == ids.tolist()
    assert seen[0] == len(ids) - 1 and 0 < max(seen[1:]) <= 2000 and len(seq) < 10_100


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_pieces_encode_like_whole_texts(name):
    from scrubline.llm.common import PieceEncoder, vocabulary as read

    enc = PieceEncoder(read(vocabulary(name))["vocabulary"], limit=50)
    texts = [t or "" for _, t, _ in rows()] + ["a \u00a0b", "x\u2003 y", "it's we'll  DON'T", " lead", "trail ", "tab\t x", "e\u0301 \u0301x", "\u3000 a", "a\u200b b", "1 2 33 4,5"]
    got = enc.encode([t.encode() for t in texts])
    assert [g.tolist() for g in got] == [brute.encode(t, name, 0)[:-1] for t in texts]


@cache
def loaded():
    from scrubline.llm.common import WordEncoder, vocabulary as read

    return WordEncoder(read(vocabulary(WORD))["vocabulary"])


def word_encoder(limit=100):
    """One that knows nothing yet."""
    enc = copy(loaded())
    enc.limit = limit
    return enc


def test_words_are_learnt_once_in_any_case_and_before_any_mark():
    """The registered query's encoder takes these eight pieces for one stem and two others."""
    from scrubline.llm.common import encoder, vocabulary as read

    enc = encoder(read(vocabulary(WORD)))
    text = "Theastou theastou, THEASTOU. theastou!\ntheastou? theastou; #theastou theastou's"
    (got,) = enc.encode([text.encode()])
    assert got.tolist() == brute.encode(text, WORD, 0)[:-1]
    assert sorted(enc.known.to_pylist()) == ["#theastou", "theastou", "theastou's"]


def test_letters_and_tails_encode_like_whole_texts():
    letters = [chr(c) for c in [*range(33, 127), *range(160, 0x250), 0x1E9E, 0x212A, 0x3A3, 0x416]]
    texts = [f"{a}{c}{tail} {c}{tail} x{c}y\n{c}z{tail}{tail}" for c in letters for a in ("ha", "T") for tail in ("", ".", ",", "'s", "\u0308")]
    got = word_encoder().encode([t.encode() for t in texts])
    assert [g.tolist() for g in got] == [brute.encode(t, WORD, 0)[:-1] for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["T", "t", "st", "ea", "\u00c9", "\u00df", "\u0130", "\u0308", "'", "s", "LL", ".", ",", "!", "7", "<|endoftext|>", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\u0085", "\u00a0", "\u2003", "\x00", "\x01", "\u4e2d", "\U0001f600"]), max_size=25).map("".join), min_size=1, max_size=6), st.integers(0, 8))
def test_words_encode_like_whole_texts(texts, limit):
    enc = word_encoder(limit=limit)
    enc.at_once = 3
    for group in (texts, texts[::-1], ["", *texts]):
        assert [g.tolist() for g in enc.encode([t.encode() for t in group])] == [brute.encode(t, WORD, 0)[:-1] for t in group]
        assert len(enc.known) <= limit and len(enc.sizes) == len(enc.known) and enc.sizes.sum() == len(enc.flat)


def test_bytes_that_are_no_text():
    texts = [b"ab\xff cd\xc3 \xe2\x80.", b"\xc3\xa9t\xc3", b"\x80"]
    got = word_encoder().encode(texts)
    assert [g.tolist() for g in got] == [brute.encode(t.decode("utf-8", "replace"), WORD, 0)[:-1] for t in texts]


def test_other_tokenizers_keep_their_encoder():
    import json

    from scrubline.llm.common import PieceEncoder, cuts_words, encoder, vocabulary as read

    assert type(encoder(read(vocabulary(BYTE)))) is PieceEncoder
    spec = json.loads(read(vocabulary(WORD))["vocabulary"])
    assert cuts_words(json.dumps(spec))
    assert not cuts_words(json.dumps(spec | {"normalizer": None}))
    assert not cuts_words(json.dumps(spec | {"added_tokens": [{"content": "theastou"}]}))


# ── language model ──


@pytest.mark.parametrize("order, block, most", [(1, 1 << 20, 9), (2, 1 << 20, 10**6), (2, 64, 30), (3, 200, 50)])
def test_katz(spark, monkeypatch, order, block, most):
    monkeypatch.setattr(katz, "MOST_WORDS", most)
    data = [*rows()[:12], *rows()[-12:-2], (None, "one two", None)]
    data = [(d, " ".join((t or "").split()[:90]) if t is not None else None, s) for d, t, s in data]
    model = brute.Katz([(None if d is None else str(d), t) for d, t, _ in data], order, katz.discounts)
    got = katz.score(frame(spark, data), order=order, block_tokens=block, part_keys=500).collect()
    assert len(got) == len(data)
    want = sorted((str(d), len(brute.words(t)) + 1, model.base(t), model.score(t)) for d, t, _ in data)
    have = sorted((str(r.doc_id), r.n_tokens, r.base_score, r.score) for r in got)
    for a, b in zip(have, want):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], rel=1e-9)
    assert {r.train_tokens for r in got} == {model.total}
    known = {str(d): sum(model.counts[0][(w,)] > 0 for w in model.tokens(t)[1:]) for d, t, _ in data}
    assert all(known[str(r.doc_id)] == r.n_known for r in got)


def test_katz_distributions_sum_to_one():
    data = [(str(i), prose(i, 60)) for i in range(12)]
    model = brute.Katz(data, 3, katz.discounts)
    words = [g[0] for g in model.counts[0]]
    contexts = list(model.contexts)[:40] + [(), ("never",), ("<start>", "never")]
    for context in contexts:
        total = sum(model.p(context, w) for w in words) + model.p(context, "<unknown>")
        assert total == pytest.approx(1, abs=1e-9)


def test_katz_beats_single_words_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = katz.score(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert out[0] > 0.95 * out[1]


def test_integers_survive_packing():
    values = np.array([0, 1, 254, 255, 256, 10**12, 3])
    assert katz.unpack(katz.pack(values), len(values)).tolist() == values.tolist()


# ── quality ──


def test_quality(spark):
    data = rows() + [(700, "a b c d e f g h i " * 30, "s"), (701, "! ".join(prose(5, 60).upper().split()), "s"), (702, prose(6, 40) + "##$ <|> & *", "s")]
    labels = [(i, 1, 0) for i in range(0, 20)] + [(3, 1, 0), (701, 0, 0), (None, 1, 0)]
    docs = frame(spark, data)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = brute.quality([(d, t) for d, t, _ in data], [(d, q) for d, q, _ in labels], 512, 1.0, 0.0)
    got = quality.judge(docs, table, buckets=512, smoothing=1.0, threshold=0.0).collect()
    have = sorted(((str(r.row.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.base_failed, r.kept, r.score) for r in got)
    expect = sorted(((str(d), *want[i][0]), want[i][1], want[i][2], want[i][3]) for i, (d, _, _) in enumerate(data))
    for a, b in zip(have, expect):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-9)
    kept = quality.keep(docs, table, buckets=512, smoothing=1.0, threshold=0.0)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for i, (d, _, _) in enumerate(data) if want[i][2])
    assert 0 < sum(w[2] for w in want.values()) < len(data)


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.judge(frame(spark), none).collect()
    assert all(r.score == 0 and r.kept == (not r.base_failed) for r in got)


# ── personal data ──

ODD = [
    "mail a.b+c@d-e.f.g, x@y and p@q.r%s@t.u or a@b.c@d.e ...@-.-", "ip 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3 9.9.9.9999",
    "card 4111 1111 1111 1111 x 4111-1111-1111-1112 4111111111111111 1 2 3 79927398713", "tel +1 (555) 010-9999. +49 30 1234567890 +12 +1234567890123456",
    "+1.2.3.4.5.6.7.8.9.0 mixed 12.34.56.78@x.y", "\U0001f600 mail: \U0001f600a@b.cd \U0001f600", None, "", "@", "+", "9" * 3000, "a" * 5000 + "@", "1." * 4000, "a@" + "b." * 3000 + "c",
]


def test_base_spans(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD + [t for _, t, _ in rows()])], "doc_id long, text string")
    out = privacy.find(docs)
    got = {r.doc_id: r.b for r in out.select("doc_id", privacy.written(F.col("base")).alias("b")).collect()}
    for i, t in enumerate(ODD + [t for _, t, _ in rows()]):
        assert got[i] == brute.written(brute.base_spans(t)), (i, t)
    assert sum(bool(x) for x in got.values()) >= 6


def test_terms_that_reveal(spark):
    """A name that stands with one address alone goes, a frequent word stays, a rarer entity has no say."""
    told = [(i, f"please write to Ferdinand at ferdi{'@'}mail.example.org about the house number {i}", "s") for i in range(5)]
    clean = [(100 + i, f"please write about the house {prose(i, 30)}", "s") for i in range(60)]
    once = [(300, "Gisela can be reached at gisela@mail.example.org today", "s")]
    data = told + clean + once
    docs = frame(spark, data)
    out = {r.doc_id: r for r in privacy.find(docs).collect()}
    terms = {d: {data_text[t.start : t.stop] for t in r.terms} for d, r in out.items() for data_text in [next(x[1] for x in data if x[0] == d)]}
    assert all("Ferdinand" in terms[i] and not {"write", "house", "please"} & terms[i] for i in range(5))
    assert not any(terms[100 + i] for i in range(60)) and not terms[300]
    text = {r.doc_id: r.text for r in privacy.sanitise(docs).collect()}
    assert "Ferdinand" not in text[0] and "<EMAIL>" in text[0] and "house" in text[0]
    assert text[100] == clean[0][1] and "Gisela" in text[300]


# ── empty tables ──


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert simhash.groups(docs).count() == 0 and simhash.keep_one(docs).count() == 0
    assert linededup.clean(docs).count() == 0
    assert decontam.clean(docs, items).count() == 0 and decontam.clean(frame(spark), items).count() == len(rows())
    assert packing.pack(docs, vocabulary(BYTE)).count() == 0
    assert katz.score(docs).count() == 0
    assert quality.judge(docs, labels).count() == 0
    assert privacy.find(docs).count() == 0
    path = new_path(spark, "tokens")
    repair.write(docs, path, vocabulary(WORD))
    assert repair.read(spark, path).count() == 0
