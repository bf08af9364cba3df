"""Whole runs over a table of contacts, where rules and roles fire that other tables leave silent.

Queries and their SQL. Findings are compared with their wording.
"""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from catalog.oracles import LINEITEM, ORACLES, compact, fences, finding, first_mode, pairs, r, shapiro, union
from catalog.queries import query, rounded
from catalog.views import table, with_views
from scrubline.config import INSIGHTS, LEGACY
from scrubline.operators import roles
from scrubline.plans import analysis, cleaning, insights, report
from scrubline.plans.report import METHODS
from scrubline.sources import tables
from scrubline.staging import new_path

NUMBERS = ("client_id", "level", "paid", "owed")
TEXTS = ("full_name", "write_to", "fax", "state")


def cleaned_contacts(spark, sf):
    return cleaning.clean(table(spark, sf, "contacts"), ["client_id"])


def worded(found):
    return found.select("rule", "category", "severity", "subject", "metric", "title", "detail")


# ── SQL of the cleaned table and its figures ──

CLEANED = with_views("contacts") + f""",
v as (select * replace (upper(state[1]) || state[2:] as state) from contacts),
f as (select distinct * replace (coalesce(state, {first_mode('v', 'state')}) as state,
  coalesce(level, (select {r('median(level)')} from v)) as level) from v),
k as (select * from f qualify row_number() over (partition by client_id order by paid) = 1),
b as ({fences('k', 'level')}),
c as (select k.* replace (greatest(lo, least(level, hi)) as level) from k, b),
o as (select count(*) as rows, count_if(level < lo or level > hi) as outside, any_value(lo) as lo, any_value(hi) as hi from k, b),
n as (select count(*) as rows, count(*) - count(state) as states, count(*) - count(level) as levels,
  2 * count(*) - count(write_to) - count(fax) as kept, count(*) - (select count(*) from (select distinct * from contacts)) as copies,
  (select count(*) from f) as distinct_rows from v),
a as (select ({' + '.join(f'cast(abs(skewness({c})) < 2 as int)' for c in NUMBERS)}) / 4 as calm,
  2 * count(*) - count(write_to) - count(fax) as nulls_after from c),
s as (select n.*, o.*, a.*, o.rows as after_rows, n.rows as before_rows, n.rows - distinct_rows as exact, distinct_rows - o.rows as repeats,
  states + levels as filled, states + levels + kept as nulls_before,
  round_even((1 - (states + levels + kept) / (n.rows * 8)) * 40 + (1 - copies / n.rows) * 20 + calm * 30 + 10, 1) as before_score,
  round_even((1 - nulls_after / (o.rows * 8)) * 40 + 20 + calm * 30 + 10, 1) as after_score from n, o, a)
"""


def worded_sql(rule, category, severity, subject, metric, title, detail, source="s", where="true"):
    base = finding(rule, category, severity, subject, metric, source, where)
    return base.replace(" from " + source, f", {title} as title, {detail} as detail from {source}", 1)


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def pair_list(where: str, source: str) -> str:
    return f"""(select string_agg(printf('%s & %s (r = %.2f)', a, b, r), '; ' order by ord)
      from (select * from ({source}) where {where} order by ord limit 3))"""


def most_frequent(source: str, col: str) -> str:
    return f"""(select string_agg(printf('%s (%d)', value, n), ', ' order by n desc, value)
      from (select {col} as value, count(*) as n from {source} where {col} is not null group by 1 order by 2 desc, 1 limit 3))"""


STRONG, MODERATE = "abs(r) >= 0.7", "abs(r) >= 0.4 and abs(r) < 0.7"
_PAIRS = pairs("c", NUMBERS)
_FIRST = f"(select *, (select count(*) from ({_PAIRS}) where {STRONG}) as n from ({_PAIRS}) where {STRONG} order by ord limit 1)"
_TOP = "(select max(n) as top, sum(n) as rows, arg_max(state, n) as value from (select state, count(*) as n from c group by 1))"

FINDINGS = union([
    worded_sql("I1", "Executive Overview", "info", "=", "after_rows", "format('{:,} records in 8 fields', after_rows)",
               """printf('4 numeric, 4 text and 0 date field(s); %.1f%% complete; quality score %s before, %s after cleaning.',
               (1 - nulls_after / (after_rows * 8)) * 100, before_score::varchar, after_score::varchar)"""),
    worded_sql("I2", "Data Quality", "success", "=", r("after_score - before_score", 1),
               "printf('Quality score up by %.1f points', after_score - before_score)",
               "printf('From %s to %s out of 100.', before_score::varchar, after_score::varchar)", where="after_score > before_score"),
    worded_sql("I3", "Data Quality", "warning", "=", "filled", "format('{:,} missing values filled in 2 field(s)', filled)",
               text("Fields: state, level. Strategies: median (skewed dist.), mode.")),
    worded_sql("I4", "Data Quality", "=case when exact + repeats < 10 then 'warning' else 'error' end", "=", "exact + repeats",
               "format('{:,} duplicate record(s) removed', exact + repeats)",
               "format('{} exact copies, {} repeats of the business key.', exact, repeats)", where="exact + repeats > 0"),
    worded_sql("I5", "Data Quality", "warning", "level", "outside", "format('{:,} outlier(s) capped in 1 field(s)', outside)",
               "printf('Level has the most: %d, %.1f%% of rows.', outside, outside * 100 / after_rows)", where="outside > 0"),
    worded_sql("I12", "Correlation Analysis", "=case when abs(r) > 0.9 then 'warning' else 'info' end", "=a || ',' || b", r("r", 2),
               "format('{} and {} are strongly correlated', upper(a[1]) || a[2:], upper(b[1]) || b[2:])",
               "printf('r = %.2f; %d more strong pair(s).', r, n - 1)", _FIRST),
    worded_sql("I13", "Correlation Analysis", "info", "=", "n", "format('{} moderate correlation(s)', n)", pair_list(MODERATE, _PAIRS),
               f"(select count(*) as n from ({_PAIRS}) where {MODERATE})", "n > 0"),
    worded_sql("I15", "Field Analysis", "info", "full_name", "d", text("Full Name identifies every record"),
               text("All values differ: leave it out of groupings."), "(select count(distinct full_name) as d, count(*) as rows from c)", "d = rows"),
    worded_sql("I17", "Field Analysis", "info", "state", r("top * 100.0::double / rows", 2), "'State has a dominant value: ' || value",
               f"'Most frequent: ' || {most_frequent('c', 'state')} || '.'", _TOP, "top * 2 > rows"),
    worded_sql("I19", "Recommendation", "success", "=", "4", text("Ready for classification or regression"), text("4 numeric and 4 text fields.")),
    worded_sql("I21", "Recommendation", "info", "=", "after_rows", text("Large table: explore a stratified sample first"),
               "format('{:,} rows.', after_rows)", where="after_rows > 50000"),
])


@query
def clean_contacts(spark, sf):
    """Protected mail, fax and id columns keep their missing values; copies and repeats of the id go."""
    return rounded(cleaned_contacts(spark, sf).table, 4, "level")


ORACLES["clean_contacts"] = CLEANED + f"select * replace ({r('level')} as level) from c"


@query
def contact_roles(spark, sf):
    df = table(spark, sf, "contacts")
    return roles.role_frame(df, roles.infer_roles(df, ["client_id"]))


# the first 50 addresses decide; names decide on client_id and fax
_DISTINCT = "select {i} as ord, '{c}' as \"column\", case when count(distinct {c}) <= 50 and count(distinct {c}) < 0.5 * count(*) then 'categorical' else 'text' end as role, false as protected from contacts"
ORACLES["contact_roles"] = with_views("contacts") + union([
    f"select {i} as ord, '{c}' as \"column\", case when regexp_matches('{c}', '_id$') then 'id' when regexp_matches('{c}', 'tel|fax') then 'phone' end as role, true as protected"
    for i, c in ((0, "client_id"), (3, "fax"))
] + [
    _DISTINCT.format(i=1, c="full_name"), _DISTINCT.format(i=4, c="state"),
    """select 2, 'write_to', case when avg(cast(contains(write_to, '@') as int)) > 0.5 then 'email' else 'text' end,
      avg(cast(contains(write_to, '@') as int)) > 0.5
      from (select write_to from contacts where write_to is not null order by client_id limit 50)""",
] + [
    f"""select {i}, '{c}', case when avg(cast(regexp_matches(cast({c} as varchar), '[$€£¥₹]|^\\d[\\d,]+\\.\\d{{2}}$') as int)) > 0.3
      then 'currency' else 'numeric' end, false from (select {c} from contacts where {c} is not null order by client_id limit 50)"""
    for i, c in ((5, "level"), (6, "paid"), (7, "owed"))
])


@query
def findings_contacts(spark, sf):
    done = cleaned_contacts(spark, sf)
    return worded(insights.insights(done.table, done.report, INSIGHTS, "none"))


ORACLES["findings_contacts"] = CLEANED + FINDINGS


@query
def compare_contacts(spark, sf):
    """Before and after of a table with duplicates."""
    return report.comparison(cleaned_contacts(spark, sf))


ORACLES["compare_contacts"] = CLEANED + union(
    f"select {i} as ord, '{m}' as metric, {a}::double as before, {b}::double as after, {r(gain, 1)} as improvement from s"
    for i, (m, a, b, gain) in enumerate((
        ("rows", "before_rows", "after_rows", "before_rows - after_rows"),
        ("missing", "nulls_before", "nulls_after", "nulls_before - nulls_after"),
        ("duplicates", "copies", "0", "copies"), ("score", "before_score", "after_score", "after_score - before_score"),
    ))
)

_STEPS = (
    ("step", text("Casing and spacing evened out in 2 text column(s)")),
    ("section", text("Missing values")),
    ("detail", "format('state: {} missing, mode', states)"),
    ("detail", "format('level: {} missing, median (skewed dist.)', levels)"),
    ("step", "format('{:,} missing value(s) filled in 2 column(s)', filled)"),
    ("section", text("Duplicates")),
    ("step", "format('{} exact duplicate row(s) removed', exact)"),
    ("step", "format('{} repeat(s) of the key client_id removed', repeats)"),
    ("section", text("Dates")),
    ("section", text("Outliers")),
    ("detail", "printf('level: %d value(s) capped to [%.2f, %.2f]', outside, lo, hi)"),
    ("step", "format('{:,} outlier(s) capped in 1 column(s)', outside)"),
    ("section", text("Quality")),
    ("detail", "'Quality score ' || before_score || ' -> ' || after_score"),
)
_LOG = (
    ("section", text("Column names and roles")),
    ("detail", text("Roles: client_id=id, full_name=text, write_to=email, fax=phone, state=categorical, level=numeric, paid=numeric, owed=numeric")),
    ("section", text("Values")),
    *_STEPS,
)


@query
def cleaning_log_lines(spark, sf):
    """The audit log, line by line."""
    return cleaned_contacts(spark, sf).log()


ORACLES["cleaning_log_lines"] = CLEANED + union(
    f"select {i} as seq, '{kind}' as type, {line} as text from s" for i, (kind, line) in enumerate(_LOG)
)


@query
def report_actions(spark, sf):
    return report.actions(cleaned_contacts(spark, sf))


ORACLES["report_actions"] = CLEANED + union(
    f"select {i} as ord, {line} as step from s" for i, line in enumerate(line for kind, line in _LOG if kind == "step")
)


@query
def report_methods(spark, sf):
    """The passes, and what each of them touched."""
    return report.methods_applied(cleaned_contacts(spark, sf))


ORACLES["report_methods"] = CLEANED + union(
    f"select {i} as ord, {text(name)} as pass, {text(says)} as description, cast({n} as double) as touched, '{unit}' as unit from s"
    for i, ((name, says), (n, unit)) in enumerate(zip(METHODS, (
        ("0", "columns"), ("filled", "cells"), ("exact + repeats", "rows"), ("2", "columns"), ("0", "columns"), ("outside", "cells"),
        ("round_even(after_score - before_score, 1)", "points"),
    )))
)


@query
def analysis_bundle(spark, sf):
    """The one call from raw table to history row, and what the row says."""
    done = analysis.analyse(table(spark, sf, "contacts"), ["client_id"])
    row = analysis.run_record(done, 1, 2, "contacts.csv", datetime(2024, 1, 1))
    rules = F.from_json("insights_json", "array<struct<rule:string>>")["rule"]
    return row.select(
        "id", "user_id", "filename", "original_rows", "cleaned_rows", "quality_before", "quality_after", "columns",
        F.array_join(F.array_distinct(rules), ",").alias("rules"),
        F.get_json_object("cleaning_json", "$.exact_removed").cast("bigint").alias("exact_removed"),
    )


ORACLES["analysis_bundle"] = CLEANED + f""", found as ({FINDINGS} union all
  select 'I11', null, null, null, null, null, null from (select count(distinct level) as d from c) where d > 1)
select 1::bigint as id, 2::bigint as user_id, 'contacts.csv' as filename, before_rows as original_rows, after_rows as cleaned_rows,
  before_score as quality_before, after_score as quality_after,
  '{json.dumps(["client_id", *TEXTS, *NUMBERS[1:]])}' as columns,
  (select string_agg(distinct rule, ',' order by case when rule = 'I1' then 0 else cast(rule[2:] as int) end) from found) as rules, exact as exact_removed from s"""


# ── the older variant ──

_OLD = with_views("contacts") + f""",
t as (select * exclude (paid) from contacts),
f as (select distinct * replace (coalesce(write_to, {first_mode('t', 'write_to')}) as write_to, coalesce(fax, {first_mode('t', 'fax')}) as fax,
  coalesce(state, {first_mode('t', 'state')}) as state, coalesce(level, (select {r('median(level)')} from t)) as level) from t),
b as ({fences('f', 'level')}),
c as (select f.* replace (upper(state[1]) || state[2:] as state, greatest(lo, least(level, hi)) as level) from f, b),
s as (select (select count(*) from f) as rows, (select count_if(level < lo or level > hi) from f, b) as outside,
  count(*) - (select count(*) from f) as exact,
  4 * count(*) - count(write_to) - count(fax) - count(state) - count(level) as filled,
  (select stddev_samp(client_id) / avg(client_id) * 100 from c) as cv, (select min(client_id)::double from c) as low, (select max(client_id)::double from c) as high from t)
"""
_OLD_PAIRS = pairs("c", ("client_id", "level", "owed"))


def _legacy_contacts(spark, sf):
    return cleaning.clean(table(spark, sf, "contacts").drop("paid"), ["client_id"], LEGACY)


@query
def findings_contacts_legacy(spark, sf):
    done = _legacy_contacts(spark, sf)
    return worded(insights.legacy_insights(done.table, done.report))


ORACLES["findings_contacts_legacy"] = _OLD + union([
    worded_sql("L1", "Dataset Overview", "info", "=", "rows", "format('{:,} rows in 7 columns', rows)",
               text("3 numeric, 4 text and 0 date column(s); 100.0% complete.")),
    worded_sql("L2", "Data Quality", "warning", "=", "filled", "format('{:,} missing value(s) filled', filled)",
               text("Columns: write_to, fax, state, level."), where="filled > 0"),
    worded_sql("L4", "Data Quality", "warning", "=", "exact", "format('{:,} duplicate row(s) removed', exact)", text("Exact copies only."),
               where="exact > 0"),
    worded_sql("L5", "Data Quality", "warning", "=", "outside", "format('{:,} outlier(s) capped', outside)", text("Columns: level."),
               where="outside > 0"),
    worded_sql("I10", "Statistics", "info", "client_id", r("cv", 2), text("Client Id varies widely"),
               f"printf('Variation %.0f%%, from %s to %s.', cv, {compact('low')}, {compact('high')})", where="cv > 50"),
    worded_sql("L6", "Statistics", "info", "=", "n", "format('{} strongly correlated pair(s)', n)", pair_list(STRONG, _OLD_PAIRS),
               f"(select count(*) as n from ({_OLD_PAIRS}) where {STRONG})", "n > 0"),
    worded_sql("L7", "Patterns", "info", "full_name", "d", text("full_name identifies every row"), text("All values differ."),
               "(select count(distinct full_name) as d, count(*) as rows from c)", "d = rows"),
    worded_sql("L8", "Patterns", "success", "state", "d", "format('state has {} values', d)",
               f"'Most frequent: ' || {most_frequent('c', 'state')} || '.'", "(select count(distinct state) as d from c)", "d <= 5"),
    worded_sql("L10", "Recommendation", "success", "=", "3", text("Ready for regression"), text("3 numeric columns.")),
    worded_sql("L11", "Recommendation", "success", "=", "4", text("Suited to classification and segmentation"), text("Text and numeric columns.")),
    worded_sql("L12", "Recommendation", "info", "=", "rows", text("Large table: sample it first"), "format('{:,} rows.', rows)", where="rows > 10000"),
])


@query
def legacy_steps(spark, sf):
    """The older variant's list of steps, uncut."""
    return report.actions(_legacy_contacts(spark, sf), None)


ORACLES["legacy_steps"] = _OLD + union(
    f"select {i} as ord, {line} as step from s" for i, line in enumerate((
        "format('{:,} missing value(s) filled in 4 column(s)', filled)", "format('{} exact duplicate row(s) removed', exact)",
        text("Text evened out in 1 column(s): state"), "format('{:,} outlier(s) capped in 1 column(s)', outside)",
    ))
)


# ── other rules ──


@query
def findings_texts_only(spark, sf):
    """A table of names alone: nothing to advise but to look at it."""
    return worded(insights.insights(table(spark, sf, "part").select("p_name", "p_brand", "p_type")))



def _text_field(c: str) -> list[str]:
    source = f"(select count(*) as d, sum(n) as total, max(n) as top, min_by(value, (-n, value)) as value from (select {c} as value, count(*) as n from part where {c} is not null group by 1))"
    label = "P " + c[2:].capitalize()
    share = "top * 100.0::double / total"
    return [
        worded_sql("I15", "Field Analysis", "info", c, "d", text(f"{label} identifies every record"),
                   text("All values differ: leave it out of groupings."), source, "d = total"),
        worded_sql("I16", "Field Analysis", f"=case when {share} > 80 then 'warning' else 'info' end", c, r(share, 2),
                   f"'{label} is mostly ' || value", f"printf('%.0f%% of records share one value.', {share})", source, "d <> total and d <= 2"),
        worded_sql("I17", "Field Analysis", "info", c, r(share, 2), f"'{label} has a dominant value: ' || value",
                   f"'Most frequent: ' || {most_frequent('part', c)} || '.'", source, f"d <> total and d > 2 and {share} > 50"),
    ]


_ROWS = "(select count(*) as rows from part)"
ORACLES["findings_texts_only"] = union([
    worded_sql("I1", "Executive Overview", "info", "=", "rows", "format('{:,} records in 3 fields', rows)",
               text("0 numeric, 3 text and 0 date field(s); 100.0% complete; quality score 0.0 before, 0.0 after cleaning."), _ROWS),
    worded_sql("I8", "Data Quality", "success", "=", "0", text("The table came in excellent condition"),
               text("Nothing was missing, copied or out of range."), _ROWS),
    *_text_field("p_name"), *_text_field("p_brand"), *_text_field("p_type"),
    worded_sql("I21", "Recommendation", "info", "=", "rows", text("Large table: explore a stratified sample first"),
               "format('{:,} rows.', rows)", _ROWS, "rows > 50000"),
    worded_sql("I22", "Recommendation", "info", "=", "0", text("Explore the cleaned table in a dashboard"),
               text("No modelling advice applies."), _ROWS, "rows <= 50000"),
])


@query
def findings_normality(spark, sf):
    """The default normality test: values drawn per column."""
    found = worded(insights.insights(table(spark, sf, "lineitem")))
    return found.where(F.col("rule") == "I11").drop("detail")


ORACLES["findings_normality"] = union(
    f"""select 'I11' as rule, 'Distribution Analysis' as category, 'info' as severity, '{c}' as subject, {r('p')} as metric,
    '{"L " + c[2:].capitalize()} looks ' || case when p > 0.05 then 'normally distributed' else 'not normal' end as title from ({shapiro(c)})"""
    for c in LINEITEM[:3]
)


@query
def rename_log(spark, sf):
    """Values turned into column names, and how each was renamed."""
    wide = table(spark, sf, "orders").groupBy("o_orderstatus").pivot("o_orderpriority").agg(F.count(F.lit(1)))
    return report.rename_log(cleaning.clean(wide, ["o_orderstatus"]))


ORACLES["rename_log"] = """
select cast(row_number() over (order by p) - 1 as int) as ord, p as original, lower(regexp_replace(p, '[^A-Za-z0-9]+', '_', 'g')) as standardised
from (select distinct o_orderpriority as p from orders)"""


@query
def source_guards(spark, sf):
    """Orders written and read in each format; a format not on the list and an empty table are refused."""
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    rows = []
    for kind in tables.FORMATS:
        path = new_path(spark, kind)
        df.write.format(kind).options(**({"header": "true"} if kind == "csv" else {})).save(path)
        back = tables.require_rows(tables.read_table(spark, path, kind))
        rows.append((kind, "read", *back.agg(F.count(F.lit(1)), F.sum("o_orderkey").cast("bigint")).first()))
    for kind, attempt in (
        ("xlsx", lambda: tables.read_table(spark, sf, "xlsx")),
        ("empty", lambda: tables.require_rows(df.where("o_orderkey is null"))),
    ):
        try:
            attempt()
            rows.append((kind, "read", None, None))
        except ValueError:
            rows.append((kind, "refused", None, None))
    return spark.createDataFrame(rows, "source string, outcome string, rows bigint, keys bigint")


ORACLES["source_guards"] = union(
    [f"select '{kind}' as source, 'read' as outcome, count(*) as rows, sum(o_orderkey)::bigint as keys from orders" for kind in tables.FORMATS]
    + ["select 'xlsx', 'refused', null, null", "select 'empty', case when count(o_orderkey) = count(*) then 'refused' else 'read' end, null, null from orders"]
)
