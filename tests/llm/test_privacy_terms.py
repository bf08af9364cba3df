"""Terms that reveal personal data, against counts over whole documents."""

import math
import re
from collections import defaultdict

from scrubline.llm import privacy, queries
from tests.llm import brute
from tests.llm.data import frame, prose, rows

TERM = re.compile(r"[^\W\d_]{3,}")


def entities(text):
    out = set()
    for _, _, kind, _, value in brute.base_spans(text):
        out.add((kind, re.sub("[^0-9]", "", value) if kind in ("card", "phone") else value.lower()))
    return out


def terms(data, threshold=0.9, least=3):
    """``{(doc_id, text): spans}`` of revealing terms of ``(doc_id, text)`` rows."""
    docs = list(dict.fromkeys(data))
    by_entity, by_term = defaultdict(set), defaultdict(set)
    for i, (_, t) in enumerate(docs):
        for e in entities(t):
            by_entity[e].add(i)
        for w in TERM.findall(t or ""):
            by_term[w.lower()].add(i)
    out = {}
    for i, (d, t) in enumerate(docs):
        spans = []
        base = brute.base_spans(t)
        mine = [by_entity[e] for e in entities(t) if least <= len(by_entity[e]) < len(docs)]
        for m in TERM.finditer(t or ""):
            if any(s[0] < m.end() and m.start() < s[3] for s in base):
                continue
            held = by_term[m[0].lower()]
            for e in mine:
                both = len(e & held)
                if both >= min(least, len(e)) and math.log(both * len(docs) / len(e) / len(held)) >= (threshold - 1e-12) * math.log(len(docs) / len(e)):
                    spans.append((m.start(), m.end()))
                    break
        out[d, t] = spans
    return out


def corpus():
    far = prose(5, 60)
    told = [(i, f"Ferdinand {far} writes from ferdi{'@'}mail.example.org. {prose(50 + i, 40)} {far} ferdinand", "s") for i in range(5)]
    clean = [(100 + i, f"please write about the house {prose(i, 30)}", "s") for i in range(60)]
    once = [(300, f"Gisela {prose(7, 50)} is at gisela@mail.example.org today {prose(8, 50)} Gisela", "s"), (301, "call +1 555 010 9999 for Theodora", "s")]
    return [*told, *clean, *once, (302, "Theodora again", "s")]


def test_terms_anywhere_in_the_document(spark):
    """A name more than 80 characters from the address goes, at every place."""
    data = [*[(1000 + d if d is not None else d, t, s) for d, t, s in rows()], *corpus()]
    text, want = {d: t for d, t, _ in data}, terms([(d, t) for d, t, _ in data])
    out = {r.doc_id: [(t.start, t.stop) for t in r.terms] for r in privacy.find(frame(spark, data)).collect()}
    assert out == {d: spans for (d, _), spans in want.items()}
    for d in range(5):
        found = [text[d][a:b] for a, b in out[d]]
        assert "Ferdinand" in found and "ferdinand" in found
    assert not out[300]


def test_query_judges_every_entity(spark, tmp_path):
    """Entities of one document are judged as well, and counted."""
    data = corpus()
    frame(spark, data).select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    want = terms([(d, t) for d, t, _ in data], least=1)
    text = {d: t for d, t, _ in data}
    for r in queries.op3_personal_data(spark, str(tmp_path)).collect():
        spans = [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("term")]
        assert spans == want[r.doc_id, text[r.doc_id]], r.doc_id
        if r.doc_id == 300:
            assert [text[300][a:b] for a, b in spans].count("Gisela") == 2
    found = {r.kind: (r.n_entities, r.n_assessed) for r in privacy.assessed(frame(spark, data), 1).collect()}
    assert found == {"email": (2, 2), "phone": (1, 1)}
