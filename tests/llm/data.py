"""Small tables with unusual rows."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, k1 string, `row` int, hits int, n_words int, label string, place int"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    parts = "the of and in re on ti er an ou ing éau ß sh".split()
    text = ""
    for i in range(n):
        word = "".join(r.choices(parts, k=r.randint(1, 3)))
        text += (word.capitalize() if r.random() < 0.1 else word) + r.choice([" "] * 12 + [". ", "\n", ", "])
    return text


def rows() -> list[tuple]:
    """``(doc_id, text, source)``: copies, near copies, empty, null, very long and repeated rows."""
    texts = [prose(i, 60 + 13 * i) for i in range(25)]
    copy = texts[3]
    near = [copy.replace(copy.split()[k], "changed", 1) for k in (5, 9, 40)]
    boiler = "All rights reserved by the site."
    shared = [f"{boiler}\n{prose(100 + i, 80)}" for i in range(8)]
    odd = ["", None, " \t\n ", "one", "two words", "x " * 300, "same line\nsame line\nother", "\n\n", "a  b c d İΣ é", "naïve 日本語 text 😀 end"]
    long = prose(999, 6000)
    texts = [*texts, copy, copy, *near, *shared, *odd, long]
    out = [(i, t, f"src{i % 7}") for i, t in enumerate(texts)]
    out.append((None, prose(77, 50), None))
    return [*out, out[4]]  # the last one is a repeated row


def frame(spark, data=None):
    """The documents with extra columns named like columns used inside."""
    data = rows() if data is None else data
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), 1, "x", 2, 3, 4, "l", 5) for d, t, s in data], SCHEMA).repartition(3)
