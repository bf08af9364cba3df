"""Repair of conversations against a plain search, with conversations in one task and in many."""

import random

import pytest

from scrubline.llm import dialogue
from scrubline.llm.common import load
from scrubline.llm.queries import QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, rid int, edit string"
NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def rows_of(seed: int, n: int, longest: int) -> list[tuple]:
    r = random.Random(seed)
    out = []
    for c in range(n):
        for t in range(r.randint(1, longest)):
            role = r.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "apple", "User"])
            text = r.choice(["Yes.", "No!", "why", "", " \t", None, "a\nb?", f"said {r.random()}.", "é 😀.", "cut off", "x " * 3000])
            out.append((c, r.choice([t] * 8 + [None, t // 2]), role, text))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "e") for r in rows], SCHEMA).repartition(3)


def audited(df):
    return {r.conv_id: tuple(r[c] for c in NAMES) for r in df.collect()}


def test_query(spark):
    rows = [tuple(r) for r in load(spark, SF, "conversations").collect()]
    got = QUERIES["op13_conversations"](spark, SF).collect()
    assert {r.conv_id: tuple(r[c] for c in NAMES) for r in got} == brute.audits(rows)
    assert len(got) == len({r[0] for r in rows})


@pytest.mark.parametrize("most_rows, most_broadcast", [(4096, 1 << 20), (3, 1 << 20), (3, 0)])
def test_unusual_rows(spark, monkeypatch, most_rows, most_broadcast):
    rows = [*rows_of(1, 60, 9), (None, 1, "user", "Hi."), (None, 2, "assistant", "There"), (70, None, None, None)]
    rows += [rows[0]] * 3
    # conversations of which no message is left, or only blank ones
    rows += [(c, 0, "user", "Hello.") for c in range(100, 160)]
    monkeypatch.setattr(dialogue, "MOST_ROWS", most_rows)
    monkeypatch.setattr(dialogue, "MOST_BROADCAST", most_broadcast)
    df = frame(spark, rows)
    assert audited(dialogue.audit(dialogue.damage(df), df)) == brute.audits(rows)


def test_conversation_in_many_tasks(spark):
    """One conversation with most rows, and one message in most of them."""
    r = random.Random(5)
    rows = [(7, t, r.choice(["user", "user", "assistant", "system"]), r.choice(["Same.", "Same.", f"No {t}.", f"cut {t}"])) for t in range(3000)]
    rows += [(8, 2**40 * t, "user", "Bye.") for t in range(3)]
    df = frame(spark, rows)
    done = dialogue.repair(df, with_messages=True)
    want = {c: brute.audit([x for x in rows if x[0] == c]) for c in (7, 8)}
    assert audited(done.audit) == {c: w[0] for c, w in want.items()}
    for c, w in want.items():
        got = sorted(done.messages.where(f"conv_id = {c}").collect(), key=lambda m: tuple(m.place))
        assert [(m.role, m.text) for m in got] == w[1]


def test_empty_table(spark):
    df = frame(spark, []).limit(0)
    assert dialogue.audit(dialogue.damage(df), df).count() == 0
    assert dialogue.repair(df, with_messages=True).messages.count() == 0


def test_ties_take_the_least_audit():
    """Equal costs by way of different states, and hashes that collide."""
    for seed in range(300):
        r = random.Random(seed)
        rows = [(0, t, r.choice(["user", "assistant", "system", "x"]), r.choice(["Fine.", f"a {t}.", f"cut {t}", ""])) for t in range(r.randint(0, 12))]
        want = brute.audit(rows)[0]
        table = dialogue.Table()
        seen = set()
        in_order = sorted(rows, key=lambda x: x[1])
        for _, _, role, text in in_order:
            fault = dialogue.own_fault(text)
            fault = dialogue.DUPLICATE if fault != dialogue.BLANK and (role, text) in seen else fault
            seen.add((role, text))
            table.message(role[:1], fault)
        state, cost = table.end()
        assert (cost, table.audits.tail(table.node[state])) == want[5:7]


def test_colliding_hashes(monkeypatch):
    monkeypatch.setattr(dialogue, "MODULUS", 3)
    test_ties_take_the_least_audit()


def test_prefixes_compare_like_their_texts():
    r = random.Random(3)
    tree = dialogue.Audits()
    texts = [""]
    for _ in range(600):
        k = r.randrange(len(texts))
        label = r.choice(["D", "I", "K", "KK", "KKD", "R"])
        assert tree.add(k, label) == len(texts)
        texts.append(texts[k] + label)
    for _ in range(4000):
        a, b = r.randrange(len(texts)), r.randrange(len(texts))
        x, y = r.choice("DIKR"), r.choice("DIKR")
        assert tree.less(a, x, b, y) == (texts[a] + x < texts[b] + y)
