"""One query per operator, over its whole table, and equivalent SQL where there is any."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.llm import decontam, dialogue, katz, licenses, linededup, manifest, packing, privacy, quality, repair, simhash, urls, warc
from scrubline.llm.common import ascii_lower, load
from scrubline.staging import new_path

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of documents by SimHash."""
    out = simhash.groups(load(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    out = urls.judge(load(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("row.page_id", "host", "path", "rule", "verdict")


def _is_kind(kind: str):
    return lambda span: span["kind"] == kind


@query
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data and of the terms that reveal it."""
    out = privacy.find(load(spark, sf_dir, "documents"), least_docs=1)
    kinds = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{k}") for k in privacy.PATTERNS]
    plain = lambda c: F.transform(c, lambda s: F.struct(*[s[x].alias(x) for x in ("start", "rank", "stop", "kind")]))
    spans = F.array_sort(F.concat(F.col("base"), plain("terms")))
    return out.select("doc_id", *kinds, F.sha2(privacy.written(F.col("base")), 256).alias("base_sha256"), privacy.written(spans).alias("spans"))


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counting rules and likelihood-ratio verdict of every document."""
    out = quality.judge(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "labels"))
    return out.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


@query
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written in grammar-compressed files and read back."""
    path = new_path(spark, "tokens")
    repair.write(load(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return repair.read(spark, path)


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on five sites or more, and those of over 50 words on two, removed but for their first occurrence."""
    out = linededup.remove(load(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLES["op6_line_dedup"] = """
with lines as (
  select doc_id, coalesce(source, chr(1)) as site, unnest(string_split(text, chr(10))) as line,
         unnest(range(len(string_split(text, chr(10))))) as place
  from documents where text is not null),
worded as (select * from lines where regexp_matches(line, '[^ \\t-\\r]')),
spread as (
  select line from worded group by line
  having count(distinct site) >= case when len(regexp_extract_all(line, '[^ \\t-\\r]+')) > 50 then 2 else 5 end),
ranked as (
  select doc_id, place, row_number() over (partition by line order by doc_id, place) as nth
  from worded where line in (select line from spread)),
gone as (select doc_id, place from ranked where nth > 1),
left_lines as (
  select doc_id, string_agg(line, chr(10) order by place) as text
  from lines where (doc_id, place) not in (select doc_id, place from gone) group by doc_id)
select d.doc_id, case when d.text is null then 0 else len(string_split(d.text, chr(10))) end::bigint as n_lines,
  (select count(*) from gone g where g.doc_id = d.doc_id)::bigint as n_removed,
  sha256(coalesce(l.text, '')) as text_sha256
from documents d left join left_lines l on l.doc_id = d.doc_id
"""


@query
def op7_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under a backoff model of the training documents."""
    return katz.score(load(spark, sf_dir, "documents"), order=3)


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sequences packed from all documents."""
    return packing.pack(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    out = decontam.report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), ["doc_id"])
    return out.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[0-9a-z]|[^\\x00-\\x7F])+')"

ORACLES["op9_decontamination"] = f"""
with doc as (select doc_id, {_WORDS} as w from documents),
item as (select item_id, {_WORDS} as w from benchmark),
pattern as (
  select distinct item_id, least(len(w), 13) as n, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda i: array_to_string(w[i : i + least(len(w), 13) - 1], ' '))) as p
  from item where len(w) > 0),
sizes as (select distinct n from pattern),
wins as (
  select doc_id, n, unnest(range(1, len(w) - n + 2)) as pos,
         unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) as p
  from doc, sizes where len(w) >= n),
found as (select doc_id, pos, wins.n, item_id from wins join pattern using (n, p)),
hit as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(pos, pos + n)) as place from found) group by doc_id),
items as (
  select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256
  from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from doc left join hit using (doc_id) left join items using (doc_id)
"""


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to WARC archives and read back in the order of their merged index."""
    path = new_path(spark, "warc")
    pages = load(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType.simpleString()
    warc.write(pages, path)
    out = warc.history(spark, path)
    return out.select(
        F.col("page_id").cast(kind).alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "url_key", "captured",
    )


ORACLES["op10_warc"] = """
with p as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as hex,
    translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from pages),
q as (select *, max(page_id) over (partition by hex) as head, regexp_extract(low, '^[^:/?#]*://(.*)$', 1) as rest from p),
u as (select *, regexp_replace(regexp_extract(rest, '^([^/?#]*)', 1), '^www[0-9]*[.]', '') as host,
    regexp_extract(rest, '^[^/?#]*([^#]*)', 1) as tail from q)
select page_id, strlen(body) as payload_bytes,
  list_aggregate(list_transform([1, 11, 21, 31], lambda g: list_aggregate(list_transform([35, 30, 25, 20, 15, 10, 5, 0],
    lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, g, 10))::bigint >> b) & 31)::int + 1, 1)), 'string_agg', '')), 'string_agg', '') as payload_digest,
  case when page_id <> head then 'revisit' else 'response' end as record_type, case when page_id <> head then head end as refers_to,
  case when rest = '' then low else array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || tail end as url_key,
  strftime(timestamp '2024-01-01' + to_seconds(page_id::bigint % 1073741824), '%Y-%m-%dT%H:%M:%SZ') as captured
from u"""


@query
def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in every document."""
    out = licenses.scan(load(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.transform("base", lambda p: p["start"])
    return out.select(
        "row.doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        licenses.labels(F.col("base")).alias("base_labels"), licenses.labels(F.col("base"), F.col("notices")).alias("labels"), "score",
    )


def _licenses_sql() -> str:
    entries = licenses.parsed()
    entry = ", ".join(f"({e}, '{label}', {i}, '{w}', {any(a <= i < b for a, b in must)})" for e, (label, words, must) in enumerate(entries) for i, w in enumerate(words))
    phrase = ", ".join(f"('{label}', {i}, '{w}')" for text, label in licenses.PHRASES.items() for i, w in enumerate(text.split()))
    return f"""
with doc as (select row_number() over () as d, doc_id, coalesce({_WORDS}, []) as w from documents),
entry(e, label, place, word, must) as (values {entry}),
size as (select e, any_value(label) as label, count(*) as n, count(*) filter (where must) as n_must from entry group by e),
phrase(label, place, word) as (values {phrase}),
known as (select word from entry union select word from phrase),
token as (select d, unnest(w) as word, unnest(range(len(w))) as pos from doc),
hit as (select * from token where word in (from known)),
df as (select k.word, count(distinct d) as df from known k left join hit using (word) group by k.word),
anchor as (
  select e, word from (select e, word, row_number() over (partition by e order by df, word) as nth from (select distinct e, word from entry) join df using (word))
  where nth <= {licenses.ANCHORS}),
needed as (select e, ceil({licenses.SHARE} * count(*)) as need from anchor group by e),
vote as (
  select d, e, pos - place as shift from hit join entry using (word) join anchor using (e, word)
  group by d, e, shift having count(distinct word) >= (select need from needed n where n.e = entry.e)),
same as (
  select v.d, v.e, v.shift, count(*) as n_same, count(*) filter (where must) as n_must
  from vote v join entry x on x.e = v.e join hit h on h.d = v.d and h.word = x.word and h.pos = v.shift + x.place group by all),
notice as (select d, label, n_same / n as score from same join size using (e) where same.n_must = size.n_must),
base as (
  select d, label, pos - place as pos from hit join phrase using (word) join (select label, count(*) as n from phrase group by label) using (label)
  group by d, label, pos - place having count(*) = any_value(n)),
b as (select d, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, string_agg(distinct label, ',' order by label) as base_labels from base group by d),
l as (select d, string_agg(distinct label, ',' order by label) as labels, max(score) as score from (select d, label, score from notice union all select d, label, 0 from base) group by d)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word, last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score
from doc left join b using (d) left join l using (d)"""


ORACLES["op11_licenses"] = _licenses_sql()


@query
def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof of belonging to the manifest, checked on texts of which a third is altered."""
    docs = load(spark, sf_dir, "documents")
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, ascii_lower(F.col("text")))
    out = manifest.check(manifest.build(manifest.leaves(docs, altered=altered)).proofs())
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(manifest.siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", "verified")


#: Unsigned crc32 of an ASCII text, from its polynomial.
_CRC32 = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({0}, ''), lambda x: ascii(x)::bigint)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"


def _manifest_sql(depth: int = 8) -> str:
    """SQL of the manifest, for up to ``8 ** depth`` documents a language and ``8 ** 3`` languages."""
    part = lambda c: f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c} end"
    leaf = lambda text: "sha256(" + " || ".join(map(part, ["doc_id", "source", "lang", "n_chars", text])) + ")"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [f"""leaves as (
  select doc_id, coalesce('=' || lang, '') as tree, {leaf('text')} as leaf,
    case when {_CRC32.format('doc_id::varchar')} % 3 = 0 then {leaf(lower)} else {leaf('text')} end as altered
  from documents)""", """a0 as (
  select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as r, leaf as digest, altered as f from leaves)""",
        "an0 as (select tree, r as i, digest, count(*) over (partition by tree) as n from a0)"]

    def levels(tag: str, depth: int) -> None:
        for k in range(depth):
            ctes.append(f"""{tag}p{k} as (
  select x.tree, x.i, coalesce(string_agg(y.digest, '' order by y.i) filter (where y.i < x.i), '') as l,
    coalesce(string_agg(y.digest, '' order by y.i) filter (where y.i > x.i), '') as r
  from {tag}n{k} x join {tag}n{k} y on x.tree = y.tree and x.i // 8 = y.i // 8 group by x.tree, x.i)""")
            ctes.append(f"""{tag}n{k + 1} as (
  select tree, i // 8 as i, case when any_value(n) = 1 then any_value(digest) else sha256(string_agg(digest, '' order by i)) end as digest, (any_value(n) + 7) // 8 as n
  from {tag}n{k} group by tree, i // 8)""")

    levels("a", depth)
    ctes.append(f"tops as (select tree, digest, row_number() over (order by tree) - 1 as i from an{depth})")
    ctes.append("bn0 as (select 0 as tree, i, digest, count(*) over () as n from tops)")
    levels("b", 3)
    size = "select tree, count(*) as n from a0 group by tree"
    steps = [("a", k, "t.n", f"d.r // {8 ** k}", "d.tree", "d.tree") for k in range(depth)]
    steps += [("b", k, "(select count(*) from tops)", f"t.i // {8 ** k}", "0", "d.tree") for k in range(3)]
    ctes.append(f"trees as (select s.tree, s.n, tops.i, tops.digest as subroot from ({size}) s join tops using (tree))")
    ctes.append("f0 as (select doc_id, tree, r, leaf, altered as f, '' as proof from a0)")
    for j, (tag, k, n, place, tree, _) in enumerate(steps):
        ctes.append(f"""f{j + 1} as (
  select d.doc_id, d.tree, d.r, d.leaf, case when {n} > {8 ** k} then sha256(p.l || d.f || p.r) else d.f end as f, d.proof || case when {n} > {8 ** k} then p.l || p.r else '' end as proof
  from f{j} d join trees t on d.tree = t.tree join {tag}p{k} p on p.tree = {tree} and p.i = {place})""")
    return "with " + ",\n".join(ctes) + f"""
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, f as folded_root, f = root as verified
from f{len(steps)} join trees using (tree), (select digest as root from bn3)"""


ORACLES["op12_manifest"] = _manifest_sql()


@query
def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations and the cheapest audit that repairs their turns."""
    rows = load(spark, sf_dir, "conversations")
    return dialogue.audit(dialogue.damage(rows), rows)


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through all stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
