"""Personal data, and the terms that give it away.

E-mail addresses, IP addresses, card and phone numbers are found by pattern.
Co-occurrence in whole documents tells how strongly a term reveals an entity: the pointwise mutual information of the two over documents, as a share
of the entity's own information content. Terms at or above ``threshold`` are
generalised, those that occur with the entity alone are removed.

Results for unusual rows: a null text is empty and has no spans. Rows with
equal id and text count as one document and get equal spans. A null ``doc_id``
is an id like any other. Extra columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import keyed, salted_join
from scrubline.staging import stage

KINDS = ["email", "ip", "card", "phone", "term"]
# Possessive forms and the look-behinds keep the search linear; they match what the plain forms match.
_OCTETS = "[0-9]++" + "\\.[0-9]++" * 3
PATTERNS = {
    "email": "(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": f"(?:(?<![0-9])|\\G){_OCTETS}",
    "card": "[0-9](?:[\\x20-]?+[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TERM = "\\p{L}{3,}"
LABELS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "term": "<TERM>"}


def located(text: Column, found: Column, pattern: str) -> Column:
    """``start, stop, value`` of the matches ``found`` of ``pattern``, in code points."""
    gaps = F.transform(F.split(text, pattern), F.length)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,value:string>>").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + pair["gap"]
        stop = start + F.length(pair["value"])
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), stop.alias("stop"), pair["value"].alias("value")))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(found), F.lit(1))), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    return F.when(F.size(found) > 0, F.aggregate(pairs, zero, step, lambda acc: acc["out"])).otherwise(zero["out"])


def luhn(digits: Column) -> Column:
    at = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = 2 * d - F.when(d > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(at, F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(f"^{_BYTE}(?:\\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def entity(kind: Column, value: Column) -> Column:
    """One text for all spellings of an entity."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.concat(kind, F.lit(":"), F.when(kind.isin("card", "phone"), digits).otherwise(F.lower(value)))


def _named(kind: str, rank: int) -> Column:
    """The valid matches of a kind, with its name and rank."""

    def name(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"), F.lit(kind).alias("kind"), s["value"].alias("value"))

    return F.transform(F.filter(f"s_{kind}", lambda s: valid(kind, s["value"])), name)


def base_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, k1, k2, spans``: spans with their kind and value."""
    rows = keyed(docs.select("doc_id", "text"), docs["doc_id"], docs["text"])
    df = rows.select("row.doc_id", "k1", "k2", F.coalesce("row.text", F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    hit = {k: F.contains(F.col("text"), F.lit("@")) if k == "email" else F.col("text").rlike(HINTS[k]) for k in PATTERNS}
    df = df.withColumns({f"m_{k}": F.when(hit[k], F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none) for k, p in PATTERNS.items()})
    df = df.withColumns({f"s_{k}": located(F.col("text"), F.col(f"m_{k}"), p) for k, p in PATTERNS.items()})
    named = [_named(k, r) for r, k in enumerate(PATTERNS)]
    return df.select("doc_id", "k1", "k2", F.array_sort(F.concat(*named)).alias("spans"))


def document_terms(docs: DataFrame) -> DataFrame:
    """``k1, k2, text, terms``: a row per document, with its distinct terms."""
    rows = keyed(docs.select("doc_id", "text"), docs["doc_id"], docs["text"]).select("k1", "k2", F.coalesce("row.text", F.lit("")).alias("text"))
    found = F.regexp_extract_all("text", F.lit(TERM), F.lit(0))
    return rows.withColumn("terms", F.array_distinct(F.transform(found, F.lower)))


def mentions(spans: DataFrame) -> DataFrame:
    """``entity, k1, k2, kind``: the documents that hold each entity."""
    flat = spans.select("k1", "k2", F.explode("spans").alias("s"))
    return flat.select(entity(F.col("s.kind"), F.col("s.value")).alias("entity"), "k1", "k2", "s.kind").distinct()


def entity_counts(held: DataFrame, least_docs: int) -> DataFrame:
    """``entity, n_entity``: entities that are judged."""
    return held.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= least_docs)


def assessed(docs: DataFrame, least_docs: int = 3) -> DataFrame:
    """``kind, n_entities, n_assessed``: distinct entities, and those judged for terms that reveal them."""
    held = mentions(base_spans(docs))
    each = held.groupBy("kind", "entity").agg(F.count("*").alias("n"))
    return each.groupBy("kind").agg(F.count("*").alias("n_entities"), F.count_if(F.col("n") >= least_docs).alias("n_assessed"))


def revealing(docs: DataFrame, spans: DataFrame, threshold: float, least_docs: int) -> DataFrame:
    """``k1, k2, term, share``: terms that reveal an entity of their document, wherever they stand in it.

    Documents are counted whole. As no pair is seen in more documents than its
    entity, only a term in at most ``total ** (1 - threshold) * n_entity **
    threshold`` documents can reach ``threshold``; others are dropped before
    pairs are made. ``share`` is 1 where a term occurs with an entity alone.
    """
    total = float(max(spans.select("k1", "k2").distinct().count(), 1))
    held = stage(mentions(spans), "mentions")
    entities = stage(entity_counts(held, least_docs), "entities")
    judged = stage(salted_join(held.select("entity", "k1", "k2"), entities, ["entity"], ["k1", "k2"]), "judged")
    most = judged.groupBy("k1", "k2").agg(F.max("n_entity").alias("most"))
    bound = lambda n: (1 + 1e-9) * total ** (1 - threshold) * F.pow(n, F.lit(threshold))
    widest = entities.agg(F.max(bound(F.col("n_entity")))).first()[0] or 0.0
    # repeated rows are one document; their number beside each term costs less than telling rows apart
    once = spans.groupBy("k1", "k2").agg(F.count("*").alias("rows")).where(F.col("rows") > 1)
    rows = document_terms(docs)
    terms = rows.select("k1", "k2", F.explode("terms").alias("term"))
    more = rows.join(once, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select(F.explode("terms").alias("term"), (1 - F.col("rows")).alias("n"))
    counts = terms.select("term", F.lit(1).cast("long").alias("n")).union(more).groupBy("term").agg(F.sum("n").alias("n_term"))
    rare = counts.where(F.col("n_term") <= widest)
    near = rows.join(most, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("k1", "k2", "most", F.explode("terms").alias("term"))
    near = near.join(rare, "term").where(F.col("n_term") <= bound(F.col("most"))).select("k1", "k2", "term", "n_term")
    pairs = stage(near.join(judged, ["k1", "k2"]).where(F.col("n_term") <= bound(F.col("n_entity"))), "pairs")
    both = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_both"), F.first("n_term").alias("n_term"), F.first("n_entity").alias("n_entity"))
    information = F.log2(F.lit(total) / F.col("n_entity"))
    mutual = F.log2(F.col("n_both") * F.lit(total) / (F.col("n_entity") * F.col("n_term")))
    # with an entity alone: exactly 1, whatever the logarithms are rounded to
    share = F.when(information > 0, F.when(F.col("n_both") == F.col("n_term"), F.lit(1.0)).otherwise(mutual / information))
    enough = F.col("n_both") >= F.least(F.lit(least_docs), "n_entity")
    known = stage(both.where(enough).select("entity", "term", share.alias("share")).where(F.col("share") >= threshold), "revealing")
    told = pairs.select("k1", "k2", "entity", "term").join(known, ["entity", "term"])
    return told.groupBy("k1", "k2", "term").agg(F.max("share").alias("share"))


def _marked(text: Column, shares: Column) -> Column:
    """Spans of the words of ``text`` that ``shares`` has, in code points, with their share."""
    found = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    gaps = F.transform(F.split(text, TERM), F.length)
    kind = "array<struct<start:int,rank:int,stop:int,kind:string,share:double>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + pair["gap"]
        stop = start + F.length(pair["value"])
        new = F.struct(start.alias("start"), F.lit(len(PATTERNS)).alias("rank"), stop.alias("stop"), F.lit("term").alias("kind"), pair["share"].alias("share"))
        return F.struct(stop.alias("at"), F.when(pair["share"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(new))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(found), F.lit(1))), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value"), F.try_element_at(shares, F.lower(v)).alias("share")))
    return F.aggregate(pairs, zero, step, lambda acc: acc["out"])


def find(docs: DataFrame, threshold: float = 0.9, least_docs: int = 3) -> DataFrame:
    """``doc_id, k1, k2, base, terms``: spans of personal data, and of all terms in the document that reveal it.

    Entities in fewer than ``least_docs`` documents are not judged; 1 judges
    all. ``share`` of a term is the largest over the entities that it reveals there.
    """
    spans = stage(base_spans(docs), "spans")
    told = revealing(docs, spans, threshold, least_docs).groupBy("k1", "k2").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("shares"))
    texts = keyed(docs.select("doc_id", "text"), docs["doc_id"], docs["text"]).select("k1", "k2", "row.text")
    per_doc = texts.join(told, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("k1", "k2", _marked(F.col("text"), F.col("shares")).alias("terms"))
    base = F.transform("spans", lambda s: F.struct(*[s[c].alias(c) for c in ("start", "rank", "stop", "kind")]))
    out = spans.select("doc_id", "k1", "k2", base.alias("base")).join(per_doc, ["k1", "k2"], "left")
    apart = F.filter("terms", lambda t: ~F.exists("base", lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])))
    kind = "array<struct<start:int,rank:int,stop:int,kind:string,share:double>>"
    return out.select("doc_id", "k1", "k2", "base", F.array_sort(F.coalesce(apart, F.array().cast(kind))).alias("terms"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def sanitise(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id, text``: personal data and generalised terms as labels, terms that occur with an entity alone removed."""
    found = find(docs, **settings)
    rows = keyed(docs.select("doc_id", "text"), docs["doc_id"], docs["text"]).select("row.*", "k1", "k2")
    spans = found.select("k1", "k2", F.array_sort(F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))),
        F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.when(s["share"] < 1, "term").otherwise("gone").alias("kind"))),
    )).alias("spans")).dropDuplicates(["k1", "k2"])
    label = F.create_map(*[F.lit(x) for pair in [*LABELS.items(), ("gone", "")] for x in pair])
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substr(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        new = F.when(s["start"] >= acc["at"], F.concat(acc["out"], before, label[s["kind"]])).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), new.alias("out"))

    done = F.aggregate("spans", zero, step, lambda a: F.concat(a["out"], F.substr(F.col("text"), a["at"] + 1)))
    return rows.join(spans, ["k1", "k2"]).select("doc_id", F.when(F.col("text").isNotNull(), done).alias("text"))
