"""DuckDB SQL that gives the same rows as each query in ``catalog.queries``."""

from __future__ import annotations

from itertools import combinations

from scrubline.operators.normality import LARGE_LOG_STD, LARGE_MEAN, weights
from catalog.views import with_views
from scrubline.functions.text import FAKE_NULLS, LEGACY_NULLS

ORACLES: dict[str, str] = {}

LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_ALL = LINEITEM + ["l_returnflag", "l_linestatus", "l_shipdate"]
CASED = r"\p{Lu}\p{Ll}\p{Lt}"


def r(x: str, digits: int = 4) -> str:
    """Half-even rounding without a negative zero."""
    return f"(round_even(cast({x} as double), {digits}) + 0::double)"


def union(parts) -> str:
    return " union all ".join(parts)


def text_list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def real(x: str) -> str:
    """NULL for a placeholder text."""
    return f"(case when lower(trim({x})) not in {text_list(FAKE_NULLS)} then {x} end)"


def normal(x: str) -> str:
    controls = f"regexp_replace({x}, '[^\\P{{C}}\\t\\n]', '', 'g')"
    return f"nullif(trim(regexp_replace({controls}, '[\\s\\p{{Z}}]+', ' ', 'g')), '')"


def title(x: str) -> str:
    runs = f"regexp_extract_all({x}, '[{CASED}]+|[^{CASED}]+')"
    return f"array_to_string(list_transform({runs}, lambda w: upper(w[1]) || lower(w[2:])), '')"


def fences(table: str, col: str, digits: str = "") -> str:
    q1, q3 = f"quantile_cont({col}, 0.25)", f"quantile_cont({col}, 0.75)"
    return f"select {q1} - 1.5 * ({q3} - {q1}) as lo, {q3} + 1.5 * ({q3} - {q1}) as hi from {table}"


def null_rows(table: str, cols) -> str:
    return union(
        f"""select {i} as ord, '{c}' as "column", count(*) - count({c}) as nulls, count(*) as rows,
        {r(f'(count(*) - count({c})) * 100.0 / count(*)')} as null_pct from {table}"""
        for i, c in enumerate(cols)
    )


def pairs(table: str, cols) -> str:
    """ord, a, b, r of all pairs, constant columns NULL."""
    return union(
        f"select {i} as ord, '{a}' as a, '{b}' as b, case when isnan(corr({a}, {b})) then null else corr({a}, {b}) end as r from {table}"
        for i, (a, b) in enumerate(combinations(cols, 2))
    )


# ── flagship, sources, sinks ──

ORACLES["capped_value_stats"] = f"""
with f as ({fences('events', 'value')}),
c as (select event_type, greatest(lo, least(value, hi)) as v from events, f)
select event_type, count(v) as n, {r('sum(v)')} as total, {r('avg(v)')} as mean, {r('stddev_samp(v)')} as std,
  {r('min(v)')} as low, {r('max(v)')} as high from c group by event_type"""

ORACLES["load_summary"] = with_views("dirty_events") + "\n" + null_rows(
    "dirty_events", ["event_id", "ts", "user_id", "event_type", "value", "day_txt"]
)

ORACLES["preview"] = "select " + ", ".join(
    f"coalesce(cast({c} as varchar), '') as {c}"
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
) + " from (select * from orders order by o_orderkey limit 6)"

_ORDERS = ["o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", "sparse_status", "o_orderdate_txt"]
_ORDER_NULLS = " + ".join(f"count(*) - count({c})" for c in _ORDERS)

ORACLES["table_shape"] = with_views("dirty_orders") + f"""
select count(*) as rows, 6::bigint as columns, count(*) * 6 as cells, {_ORDER_NULLS} as nulls,
  {r(f'(1 - ({_ORDER_NULLS}) / (count(*) * 6.0)) * 100')} as completeness_pct from dirty_orders"""

ORACLES["clean_export"] = f"""
select o_orderkey, o_custkey, o_orderstatus, {r('o_totalprice')} as o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, o_orderpriority from orders"""

ORACLES["json_rows"] = """
select c_custkey, cast(to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_mktsegment': c_mktsegment}) as varchar) as json,
  c_mktsegment as segment from customer"""

ORACLES["run_history"] = with_views("event_runs") + """
select id, user_id, filename, original_rows, cleaned_rows, original_rows - cleaned_rows as removed_rows,
  quality_before, quality_after,
  case when quality_after >= 80 then 'green' when quality_after >= 60 then 'amber' else 'red' end as band,
  strftime(created_at, '%d %b %Y, %H:%M') as created_at
from event_runs qualify row_number() over (partition by user_id order by created_at desc, id desc) <= 15"""

ORACLES["run_counts"] = "select user_id, count(*) as runs from events group by user_id"

# ── names and roles ──

ORACLES["rename_columns"] = "select o_orderstatus, " + ", ".join(
    f"""{r(f"sum(case when o_orderpriority = '{p}' then o_totalprice end)", 2)} as "{name}" """
    for p, name in (
        ("1-URGENT", "1_urgent"), ("2-HIGH", "2_high"), ("3-MEDIUM", "3_medium"),
        ("4-NOT SPECIFIED", "4_not_specified"), ("5-LOW", "5_low"),
    )
) + " from orders group by o_orderstatus"

_ROLES = {
    "orders": "o_orderkey id, o_custkey id, o_orderstatus categorical, o_totalprice currency, o_orderdate date, "
              "o_orderpriority categorical",
    "customer": "c_custkey id, c_name text, c_nationkey id, c_acctbal currency, c_mktsegment categorical",
    "part": "p_partkey id, p_name text, p_brand categorical, p_type categorical, p_size numeric, p_retailprice numeric",
    "events": "event_id id, ts date, user_id id, event_type categorical, value currency, props text",
    "dirty_orders": "o_orderkey id, o_custkey id, o_orderpriority categorical, o_totalprice currency, "
                    "sparse_status categorical, o_orderdate_txt date",
    "dirty_lineitem": "l_orderkey id, l_linenumber numeric, price_txt currency, disc_txt pct, qty_txt text, l_quantity numeric",
    "lineitem": "l_orderkey id, l_partkey id, l_suppkey id, l_linenumber numeric, l_quantity numeric, "
                "l_extendedprice currency, l_discount numeric, l_tax numeric, l_returnflag categorical, "
                "l_linestatus categorical, l_shipdate date",
}

ORACLES["role_profile"] = 'select * from (values ' + ", ".join(
    f"({i}, '{c.split()[0]}', '{c.split()[1]}', {str(c.split()[1] == 'id').lower()}, '{t}')"
    for t, cols in _ROLES.items() for i, c in enumerate(cols.split(", "))
) + ') v(ord, "column", role, protected, table_name)'

ORACLES["role_counts"] = (
    "select * from (values ('id', 3::bigint), ('numeric', 5::bigint), ('categorical', 2::bigint), ('date', 1::bigint)) v(role, n)"
)

ORACLES["first_values"] = with_views("dirty_orders") + " select * from (" + union(
    f"""select '{c}' as "column", row_number() over (order by o_orderkey) as k, {c} as value
    from dirty_orders where {c} is not null"""
    for c in ("o_orderpriority", "sparse_status", "o_orderdate_txt")
) + ") where k <= 50"

_TRY_DATES = "try_strptime(value, ['%Y-%m-%d', '%d-%m-%Y', '%m-%d-%Y', '%d/%m/%Y', '%m/%d/%Y', '%Y/%m/%d'])"
ORACLES["role_evidence"] = with_views("dirty_lineitem") + ", v as (" + union(
    f"""select '{c}' as "column", {c} as value, row_number() over (
    order by l_orderkey, l_linenumber, price_txt, disc_txt, qty_txt, l_quantity nulls first) as k from dirty_lineitem"""
    for c in ("price_txt", "disc_txt", "qty_txt")
) + f""") select "column", {r("avg(cast(contains(value, '@') as int))")} as email,
  {r(r"avg(cast(regexp_matches(value, '[$€£¥₹]|^\d[\d,]+\.\d{2}$') as int))")} as currency,
  {r("avg(cast(suffix(value, '%') as int))")} as percent,
  {r(f"avg(case when k <= 20 then cast({_TRY_DATES} is not null as int) end)")} as date
from v where k <= 50 group by "column" """

# ── values ──

ORACLES["fake_nulls"] = with_views("dirty_events") + f" select event_id, {real('event_type')} as event_type from dirty_events"

ORACLES["currency_parse"] = with_views("dirty_lineitem") + r"""
select l_orderkey, l_linenumber, try_cast(regexp_replace(price_txt, '[$€£¥₹₩₪₺,\s]', '', 'g') as double) as price
from dirty_lineitem"""

ORACLES["percent_parse"] = with_views("dirty_lineitem") + f"""
select l_orderkey, l_linenumber, {r(f"try_cast(rtrim(trim({real('disc_txt')}), '%') as double) / 100")} as discount
from dirty_lineitem"""

ORACLES["text_normalise"] = f"select doc_id, {normal('text')} as text from documents"

ORACLES["title_case"] = f"""
select p_partkey, {title('p_name')} as name, {title('p_brand')} as brand,
  {title("concat_ws('''', p_type, p_brand)")} as type_brand from part"""

ORACLES["numeric_coerce_gate"] = with_views("dirty_lineitem") + """,
g as (select count(try_cast(qty_txt as double)) / count(*) as share from dirty_lineitem)
select l_orderkey, l_linenumber, price_txt, case when share > 0.5 then try_cast(qty_txt as double) end as qty_txt
from dirty_lineitem, g"""

ORACLES["parse_dates"] = with_views("dirty_orders") + """
select o_orderkey, try_strptime(o_orderdate_txt, '%Y-%m-%d') as day from dirty_orders"""

ORACLES["parse_mixed_dates"] = with_views("mixed_dates") + """
select o_orderkey, coalesce(try_strptime(day_txt, '%Y-%m-%d'), try_strptime(day_txt, '%d/%m/%Y'),
  try_strptime(day_txt, '%m/%d/%Y'), try_strptime(day_txt, '%Y%m%d')) as day from mixed_dates"""

ORACLES["date_parts"] = """
select o_orderkey, year(o_orderdate)::int as o_order_year, month(o_orderdate)::int as o_order_month,
  quarter(o_orderdate)::int as o_order_quarter from orders"""

ORACLES["z_scores"] = f"""
with s as (select avg(value) as m, stddev_pop(value) as p, stddev_samp(value) as q from events)
select event_id, {r('(value - m) / p')} as z, {r('(value - m) / q')} as z_sample from events, s"""


def compact(x: str, digits: int = 2) -> str:
    return (
        f"case when abs({x}) >= 1e6 then format('{{:.1f}}M', {x} / 1e6) "
        f"when abs({x}) >= 1e3 then format('{{:.1f}}K', {x} / 1e3) else format('{{:,.{digits}f}}', {x}) end"
    )


def axis(x: str) -> str:
    return f"case when abs({x}) < 1 and {x} <> 0 then format('{{:.3f}}', {x}) else {compact(x, 1)} end"


_LABEL = "replace(lower(concat_ws('_', o_orderpriority, o_orderstatus)), '_', ' ')"
ORACLES["display_texts"] = f"""
select o_orderkey, {title(_LABEL)} as label,
  case when length(o_orderpriority) > 8 then o_orderpriority[1:7] || '…' else o_orderpriority end as short,
  {compact('o_totalprice')} as compact, {compact('(o_totalprice / 1000)')} as compact_small,
  {axis('(o_totalprice / 1e6)')} as axis,
  case when abs(o_totalprice / 1000) >= 1000 then {compact('(o_totalprice / 1000)')}
       else regexp_replace(format('{{:,.2f}}', o_totalprice / 1000), '\\.?0+$', '') end as dashboard,
  case when o_totalprice / 5000 >= 80 then 'green' when o_totalprice / 5000 >= 60 then 'amber' else 'red' end as band,
  greatest(0.0::double, least(o_totalprice / 5000, 100.0::double)) as clamped
from orders"""

ORACLES["date_labels"] = """
select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as iso, strftime(o_orderdate, '%d %b %Y') as day_label,
  strftime(o_orderdate, '%b %Y') as month_label, last_day(o_orderdate) as month_end from orders"""

# ── missing values ──

ORACLES["null_profile"] = with_views("dirty_lineitem") + "\n" + null_rows(
    "dirty_lineitem", ["l_orderkey", "l_linenumber", "price_txt", "disc_txt", "qty_txt", "l_quantity"]
)

ORACLES["drop_sparse"] = with_views("dirty_orders") + """
select o_orderkey, o_custkey, o_orderpriority, o_totalprice, o_orderdate_txt from dirty_orders"""


def number_fill(table: str, col: str) -> str:
    return f"""select case when count({col}) < 3 then 0 when abs(skewness({col})) < 0.5 then {r(f'avg({col})')}
    else {r(f'median({col})')} end as fill from {table}"""


def label_fill(table: str, col: str) -> str:
    mode = f"select {col} from {table} where {col} is not null group by {col} order by count(*) desc, {col} limit 1"
    return f"""select case when 1 - count({col}) / count(*) > 0.3 then 'Unknown' else coalesce(({mode}), 'Unknown') end as fill
    from {table}"""


ORACLES["impute_numeric"] = with_views("dirty_lineitem") + f"""
select l_orderkey, l_linenumber, coalesce(l_quantity, fill) as l_quantity
from dirty_lineitem, ({number_fill('dirty_lineitem', 'l_quantity')})"""

ORACLES["impute_skewed"] = with_views("dirty_events") + f"""
select event_id, coalesce(value, fill) as value from dirty_events, ({number_fill('dirty_events', 'value')})"""

ORACLES["impute_mode"] = with_views("dirty_orders") + f"""
select o_orderkey, coalesce(o_orderpriority, fill) as o_orderpriority
from dirty_orders, ({label_fill('dirty_orders', 'o_orderpriority')})"""

ORACLES["impute_unknown"] = with_views("dirty_orders") + f"""
select o_orderkey, coalesce(sparse_status, fill) as sparse_status
from dirty_orders, ({label_fill('dirty_orders', 'sparse_status')})"""


def in_order(col: str, order: str) -> str:
    return (
        f"coalesce(last_value({col} ignore nulls) over (order by {order} rows between unbounded preceding and current row), "
        f"first_value({col} ignore nulls) over (order by {order} rows between current row and unbounded following))"
    )


ORACLES["fill_in_order"] = with_views("dirty_events") + f"""
select event_id, {in_order('day_txt', 'event_id')} as day_txt from dirty_events"""

# ── duplicates and outliers ──

ORACLES["duplicate_count"] = with_views("dup_orders") + """
select count(*) as rows, count(*) - (select count(*) from (select distinct * from dup_orders)) as duplicates from dup_orders"""

ORACLES["exact_dedup"] = with_views("dup_orders") + " select distinct * from dup_orders"

ORACLES["business_key_dedup"] = f"""
select * from lineitem qualify row_number() over (partition by l_orderkey, l_shipdate order by {', '.join(LINEITEM_ALL)}) = 1"""

ORACLES["clip_outliers"] = f"""
with f as ({fences('events', 'value')})
select event_id, {r('greatest(lo, least(value, hi))')} as value from events, f"""

ORACLES["outlier_counts"] = f"""
with f as ({fences('events', 'value')}), s as (select avg(value) as m, stddev_pop(value) as sd from events)
select 0 as ord, 'value' as "column", count(*) filter (where value < lo or value > hi) as outside,
  count(*) filter (where abs((value - m) / sd) > 3) as far, {r('any_value(lo)')} as lower, {r('any_value(hi)')} as upper,
  {r('count(*) filter (where value < lo or value > hi) * 100.0 / count(*)', 2)} as pct
from events, f, s"""

# ── statistics ──

ORACLES["numeric_stats"] = union(
    f"""select {i} as ord, '{c}' as "column", count({c}) as n, count(*) - count({c}) as missing, {r(f'avg({c})', 2)} as mean,
    {r(f'median({c})', 2)} as median, {r(f'stddev_samp({c})', 2)} as std, {r(f'min({c})', 2)} as min,
    {r(f'max({c})', 2)} as max, {r(f'skewness({c})', 2)} as skew from lineitem"""
    for i, c in enumerate(LINEITEM)
)

ORACLES["describe"] = union(
    f"""select {i} as ord, '{c}' as "column", count({c}) as n, {r(f'avg({c})', 2)} as mean, {r(f'stddev_samp({c})', 2)} as std,
    {r(f'min({c})', 2)} as min, {r(f'quantile_cont({c}, 0.25)', 2)} as p25, {r(f'quantile_cont({c}, 0.5)', 2)} as p50,
    {r(f'quantile_cont({c}, 0.75)', 2)} as p75, {r(f'max({c})', 2)} as max from lineitem"""
    for i, c in enumerate(LINEITEM)
)

ORACLES["variation"] = union(
    f"""select '{c}' as "column", case when avg({c}) = 0 then 0 else {r(f'stddev_samp({c}) / avg({c}) * 100')} end as variation_pct
    from lineitem""" for c in LINEITEM
)

ORACLES["quantiles"] = union(
    f"""select '{c}' as "column", {p}::double as p, {r(f'quantile_cont({c}, {p})')} as value from lineitem"""
    for c in ("l_extendedprice", "l_quantity") for p in (0.01, 0.25, 0.5, 0.75, 0.99)
)

ORACLES["value_counts"] = "select p_name as value, count(*) as n from part group by p_name"

ORACLES["topn_other"] = f"""
with c as (select p_name as value, count(*) as n, row_number() over (order by count(*) desc, p_name) as k from part group by p_name)
select case when k <= 12 then value else 'Other' end as value, k > 12 as is_other, cast(sum(n) as bigint) as n,
  {r('sum(n) * 100.0 / (select sum(n) from c)')} as share_pct from c group by 1, 2"""

ORACLES["distinct_counts"] = union(
    f"""select '{c}' as "column", count(distinct {c}) as n_distinct from documents""" for c in ("text", "lang", "source", "n_chars")
)

ORACLES["top_values"] = " union all ".join(
    f"""select * from (select '{c}' as "column", {c} as value, count(*) as n,
    cast(row_number() over (order by count(*) desc, {c}) as int) as rank from events group by {c}) where rank <= 3"""
    for c in ("event_type", "props")
)

ORACLES["distinct_counts_wide"] = (
    "select name as \"column\", n as n_distinct from (select count(distinct columns(*)) from lineitem) unpivot (n for name in (columns(*)))"
)

ORACLES["top_values_long_text"] = " union all ".join(
    f"""select "column", md5(value) as value, n, rank from (select '{c}' as "column", {c} as value, count(*) as n,
    cast(row_number() over (order by count(*) desc, {c}) as int) as rank from documents where {c} is not null group by {c}) where rank <= 5"""
    for c in ("text", "source", "lang")
)

ORACLES["correlation_pairs"] = f"select ord, a, b, {r('r')} as r from ({pairs('lineitem', LINEITEM)})"

ORACLES["correlation_with_gaps"] = with_views("dirty_events") + (
    ", g as (select event_id, user_id, value, 1 as constant from dirty_events) "
    f"select ord, a, b, {r('r')} as r from ({pairs('g', ['event_id', 'user_id', 'value', 'constant'])})"
)


def jarque_bera(table: str, col: str) -> str:
    """n, statistic and p."""
    return f"""select n, n / 6 * (power(g * (n - 2) / sqrt(n * (n - 1)), 2) + power(k, 2) / 4) as s
    from (select count({col})::double as n, skewness({col}) as g, kurtosis_pop({col}) as k from {table})"""


ORACLES["normality_jb"] = f"""
select 'value' as "column", cast(n as bigint) as n, {r('s', 3)} as statistic, {r('exp(-s / 2)', 3)} as p
from ({jarque_bera('events', 'value')})"""


def bins(table: str, col: str) -> str:
    iqr = f"(quantile_cont({col}, 0.75) - quantile_cont({col}, 0.25))"
    sturges = f"((max({col}) - min({col})) / (log2(count({col})) + 1))"
    fd = f"(2 * {iqr} / power(count({col}), 1.0 / 3))"
    width = f"case when {iqr} > 0 then least({fd}, {sturges}) else {sturges} end"
    return f"""select *, (hi - lo) / nb as w from (select min({col}) as lo, max({col}) as hi, count({col}) as n,
    stddev_samp({col}) as sd, cast(ceil((max({col}) - min({col})) / ({width})) as int) as nb from {table})"""


ORACLES["histogram_auto"] = f"""
with b as ({bins('events', 'value')}),
g as (select value, lo, w, nb, least(cast(floor((value - lo) / (hi - lo) * nb) as int), nb - 1) as k from events, b),
p as (select lo, w, case when value < k * w + lo then k - 1 when k < nb - 1 and value >= (k + 1) * w + lo then k + 1 else k end as bin
  from g)
select bin, {r('bin * any_value(w) + any_value(lo)')} as low, {r('(bin + 1) * any_value(w) + any_value(lo)')} as high,
  count(*) as n from p group by bin"""

ORACLES["kde_grid"] = f"""
with b as ({bins('customer', 'c_acctbal')}),
g as (select cast(i as int) as point, lo + i * ((hi - lo) / 299) as x, sd * power(n, -0.2) as h, w from b, range(300) t(i))
select point, {r('x')} as x,
  {r('sum(exp(-0.5 * power((c_acctbal - x) / h, 2))) * any_value(w) / (any_value(h) * sqrt(2 * pi()))')} as density
from g, customer group by point, x"""


def box(table: str, col: str, ord_: int) -> str:
    return f"""select {ord_} as ord, '{col}' as "column", n, {r('(least(wl, q1) - m) / sd')} as whisker_low, {r('(q1 - m) / sd')} as q1,
    {r('(q2 - m) / sd')} as median, {r('(q3 - m) / sd')} as q3, {r('(greatest(wh, q3) - m) / sd')} as whisker_high, fliers
    from (select count({col}) as n, min(case when {col} >= q1 - 1.5 * (q3 - q1) then {col} end) as wl,
      max(case when {col} <= q3 + 1.5 * (q3 - q1) then {col} end) as wh,
      count(*) filter (where {col} < q1 - 1.5 * (q3 - q1) or {col} > q3 + 1.5 * (q3 - q1)) as fliers,
      any_value(q1) as q1, any_value(q2) as q2, any_value(q3) as q3, any_value(m) as m, any_value(sd) as sd
    from {table}, (select quantile_cont({col}, 0.25) as q1, quantile_cont({col}, 0.5) as q2, quantile_cont({col}, 0.75) as q3,
      avg({col}) as m, stddev_samp({col}) as sd from {table}))"""


ORACLES["box_stats"] = union(box("lineitem", c, i) for i, c in enumerate(LINEITEM[4:]))
ORACLES["box_stats_skewed"] = box("events", "value", 0)

ORACLES["monthly_trend"] = f"""
with m as (select last_day(o_orderdate) as month, avg(o_totalprice) as mean from orders group by 1),
i as (select *, cast(row_number() over (order by month) - 1 as int) as idx,
  avg(mean) over (order by month rows between 2 preceding and current row) as rolling from m),
t as (select regr_slope(mean, idx) as slope, regr_intercept(mean, idx) as intercept, corr(mean, idx) as r from i)
select month, {r('mean')} as mean, idx, {r('rolling')} as rolling, {r('slope')} as slope, {r('intercept')} as intercept,
  {r('r')} as r, {r('slope * idx + intercept')} as trend, case when slope > 0 then 'up' else 'down' end as direction from i, t"""

ORACLES["category_summary"] = f"""
with g as (select p_name as category, count(*) as rows, avg(p_retailprice) as mean, sum(p_retailprice) as sum,
  count(p_retailprice) as count from part group by p_name order by count(*) desc, p_name limit 8)
select category, rows, {r('mean')} as mean, {r('sum')} as sum, count, {r('sum * 100 / (select sum(sum) from g)')} as share_pct from g"""

ORACLES["members_of_top"] = """
select p_partkey, p_name from part where p_name in
  (select p_name from part group by p_name order by count(*) desc, p_name limit 8)"""

_KPI = LINEITEM[4:]
ORACLES["kpi_strip"] = "select ord, \"column\", label, " + r("v", 2) + f" as value, {axis('v')} as text from (" + union(
    f"""select {i} as ord, '{c}' as "column", case when sum({c}) > 9999 then 'Total' else 'Mean' end as label,
    case when sum({c}) > 9999 then sum({c}) else avg({c}) end as v from lineitem""" for i, c in enumerate(_KPI)
) + ")"

_CALM = " + ".join(f"cast(abs(skewness({c})) < 2 as int)" for c in ("o_orderkey", "o_custkey", "o_totalprice"))
ORACLES["quality_score"] = with_views("dirty_orders") + f""",
d as (select count(*) as u from (select distinct * from dirty_orders)),
s as (select count(*) as rows, 6 as columns, cast({_ORDER_NULLS} as bigint) as nulls, count(*) - any_value(u) as duplicates,
  ({_CALM}) / 3.0::double as consistency from dirty_orders, d)
select *, {r('least((1 - nulls / (rows * 6)) * 40 + (1 - duplicates / rows) * 20 + consistency * 30 + 10, 100)', 1)} as score from s"""

# ── whole runs ──

def _clean_orders(order: str) -> str:
    return with_views("dirty_orders") + f""",
v as (select sparse_status, o_orderkey, o_custkey, {title(normal(real('o_orderpriority')))} as o_orderpriority, o_totalprice,
  {real('o_orderdate_txt')} as o_orderdate_txt from dirty_orders),
f as (select o_orderkey, o_custkey, coalesce(o_orderpriority, p.fill) as o_orderpriority,
  coalesce(o_totalprice, t.fill) as o_totalprice, {in_order('o_orderdate_txt', order)} as day
  from v, ({label_fill('v', 'o_orderpriority')}) p, ({number_fill('v', 'o_totalprice')}) t),
u as (select distinct * from f),
k as (select * from u qualify row_number() over (
  partition by o_orderkey, day order by o_orderkey, o_custkey, o_orderpriority, o_totalprice, day) = 1),
b as ({fences('k', 'o_totalprice')}),
c as (select o_orderkey, o_custkey, o_orderpriority, greatest(lo, least(o_totalprice, hi)) as o_totalprice,
  try_strptime(day, '%Y-%m-%d') as o_orderdate_txt from k, b)"""


_CLEAN_ORDERS = _clean_orders("o_orderkey")
ORACLES["clean_orders"] = _CLEAN_ORDERS + f"""
select o_orderkey, o_custkey, o_orderpriority, {r('o_totalprice')} as o_totalprice, o_orderdate_txt,
  year(o_orderdate_txt)::int as o_ordertxt_year, month(o_orderdate_txt)::int as o_ordertxt_month,
  quarter(o_orderdate_txt)::int as o_ordertxt_quarter from c"""

ORACLES["clean_by_dropped_order"] = ORACLES["clean_orders"].replace(_CLEAN_ORDERS, _clean_orders("sparse_status nulls first, o_orderkey"))

ORACLES["frozen_rules"] = _CLEAN_ORDERS + f""",
w as (select o_orderkey, o_custkey, coalesce(o_orderpriority, p.fill) as o_orderpriority,
  greatest(lo, least(coalesce(o_totalprice, t.fill), hi)) as o_totalprice, try_strptime(o_orderdate_txt, '%Y-%m-%d') as day
  from v, ({label_fill('v', 'o_orderpriority')}) p, ({number_fill('v', 'o_totalprice')}) t, b)
select o_orderkey, o_custkey, o_orderpriority, {r('o_totalprice')} as o_totalprice, day as o_orderdate_txt,
  year(day)::int as o_ordertxt_year, month(day)::int as o_ordertxt_month, quarter(day)::int as o_ordertxt_quarter from w"""

ORACLES["legacy_stats"] = union(
    f"""select {i} as ord, '{c}' as "column", count(*) - count({c}) as missing, {r(f'avg({c})', 2)} as mean,
    {r(f'median({c})', 2)} as median, {r(f'stddev_samp({c})', 2)} as std, {r(f'min({c})', 2)} as min,
    {r(f'max({c})', 2)} as max from lineitem"""
    for i, c in enumerate(LINEITEM)
)


def first_mode(table: str, col: str) -> str:
    return f"(select {col} from {table} where {col} is not null group by {col} order by count(*) desc, {col} limit 1)"


_LEGACY_LABEL = title(r"trim(regexp_replace(o_orderpriority, '\s+', ' ', 'g'))")
ORACLES["clean_orders_legacy"] = with_views("dirty_orders") + f""",
f as (select distinct o_orderkey, o_custkey, coalesce(o_orderpriority, {first_mode('dirty_orders', 'o_orderpriority')}) as o_orderpriority,
  coalesce(o_totalprice, (select {r('median(o_totalprice)')} from dirty_orders)) as o_totalprice,
  coalesce(o_orderdate_txt, {first_mode('dirty_orders', 'o_orderdate_txt')}) as day from dirty_orders),
b as ({fences('f', 'o_totalprice')})
select o_orderkey, o_custkey, case when {_LEGACY_LABEL} not in {text_list(LEGACY_NULLS)} then {_LEGACY_LABEL} end as o_orderpriority,
  {r('greatest(lo, least(o_totalprice, hi))')} as o_totalprice, try_strptime(day, '%Y-%m-%d') as o_orderdate_txt from f, b"""

_PRICE = "try_cast(regexp_replace(price_txt, '[$,]', '', 'g') as double)"
_DISC = f"try_cast(rtrim(trim({real('disc_txt')}), '%') as double) / 100"


def capped(col: str) -> str:
    return f"greatest((select lo from b_{col}), least({col}, (select hi from b_{col})))"


_CAPPED = ("l_linenumber", "price_txt", "disc_txt", "l_quantity")
ORACLES["clean_lineitem"] = with_views("dirty_lineitem") + f""",
v as (select l_orderkey, l_linenumber, {_PRICE} as price_txt, {_DISC} as disc_txt, {normal(real('qty_txt'))} as qty_txt, l_quantity,
  row_number() over (partition by l_orderkey order by l_linenumber, t.price_txt nulls first, t.disc_txt nulls first,
    t.qty_txt nulls first, t.l_quantity nulls first) as nth
  from dirty_lineitem t),
f as (select nth, l_orderkey, l_linenumber, price_txt, coalesce(disc_txt, d.fill) as disc_txt, qty_txt,
  coalesce(l_quantity, q.fill) as l_quantity
  from v, ({number_fill('v', 'disc_txt')}) d, ({number_fill('v', 'l_quantity')}) q),
k as (select * from f where nth = 1),
{', '.join(f"b_{c} as ({fences('k', c)})" for c in _CAPPED)}
select l_orderkey, {capped('l_linenumber')} as l_linenumber, {r(capped('price_txt'))} as price_txt,
  {r(capped('disc_txt'))} as disc_txt, qty_txt, {r(capped('l_quantity'))} as l_quantity from k"""

_NULLED = with_views("dirty_orders") + f""",
v as (select {title(normal(real('o_orderpriority')))} as o_orderpriority, o_totalprice, {real('o_orderdate_txt')} as o_orderdate_txt
  from dirty_orders)"""
ORACLES["fill_detail"] = _NULLED + f"""
select 0 as ord, 'o_orderpriority' as "column", 'mode' as strategy, count(*) - count(o_orderpriority) as count,
  {r('(count(*) - count(o_orderpriority)) * 100.0 / count(*)', 1)} as pct from v
union all select 1, 'o_totalprice',
  case when abs(skewness(o_totalprice)) < 0.5 then 'mean (near-normal dist.)' else 'median (skewed dist.)' end,
  count(*) - count(o_totalprice), {r('(count(*) - count(o_totalprice)) * 100.0 / count(*)', 1)} from v
union all select 2, 'o_orderdate_txt', 'forward-fill / backward-fill', count(*) - count(o_orderdate_txt),
  {r('(count(*) - count(o_orderdate_txt)) * 100.0 / count(*)', 1)} from v"""

_SCORES = _CLEAN_ORDERS + f""",
x as (select count(*) as rows, cast({_ORDER_NULLS} as double) as nulls from dirty_orders),
y as (select count(*) as rows, ({_CALM} + cast(abs(skewness(year(o_orderdate_txt))) < 2 as int)
  + cast(abs(skewness(month(o_orderdate_txt))) < 2 as int) + cast(abs(skewness(quarter(o_orderdate_txt))) < 2 as int)) / 6 as calm from c),
z as (select x.rows as before_rows, y.rows as after_rows, nulls,
  round_even((1 - nulls / (x.rows * 6)) * 40 + 20 + calm * 30 + 10, 1) as before_score,
  round_even(40 + 20 + calm * 30 + 10, 1) as after_score from x, y)"""
ORACLES["compare_before_after"] = _SCORES + f"""
select 0 as ord, 'rows' as metric, before_rows::double as before, after_rows::double as after,
  (before_rows - after_rows)::double as improvement from z
union all select 1, 'missing', nulls, 0, nulls from z
union all select 2, 'duplicates', 0, 0, 0
union all select 3, 'score', before_score, after_score, {r('after_score - before_score', 1)} from z"""

_FIELDS = (
    ("o_orderkey", "id"), ("o_custkey", "id"), ("o_orderstatus", "categorical"), ("o_totalprice", "currency"),
    ("o_orderdate", "date"), ("o_orderpriority", "categorical"),
)
_TYPE_NAMES = "map {'INTEGER': 'int', 'VARCHAR': 'string', 'TIMESTAMP': 'timestamp_ntz', 'TIMESTAMP WITH TIME ZONE': 'timestamp'}"
ORACLES["schema_table"] = union(
    f"""select '{c}' as field, {i} as ord,
    (select coalesce({_TYPE_NAMES}[typeof({c})], lower(typeof({c}))) from orders limit 1) as type, '{role}' as role, count({c}) as non_null, count(distinct {c}) as unique,
    (select substr(cast({c} as varchar), 1, 20) from orders order by o_orderkey limit 1) as sample from orders"""
    for i, (c, role) in enumerate(_FIELDS)
)

_EVENT_NULLS = "(count(*) - count(event_type)) + (count(*) - count(value)) + (count(*) - count(day_txt))"
ORACLES["key_facts"] = with_views("dirty_events") + f"""
select count(*) as rows, 6::bigint as columns, 3 as numeric_fields,
  {r(f'(1 - ({_EVENT_NULLS}) / (count(*) * 6.0)) * 100', 1)} as completeness_pct from dirty_events"""

# ── findings ──


def finding(rule: str, category: str, severity: str, subject: str, metric: str, source: str, where: str = "true") -> str:
    subject = f"'{subject}'" if subject and not subject.startswith("=") else (subject[1:] or "null")
    severity = severity[1:] if severity.startswith("=") else f"'{severity}'"
    return f"""select '{rule}' as rule, '{category}' as category, {severity} as severity, cast({subject} as varchar) as subject,
    cast({metric} as double) as metric from {source} where {where}"""


def skew_findings(table: str, cols, skew: float, cv: float, rules=("I9", "I10"), category="Statistical Highlights"):
    out = []
    for c in cols:
        out.append(finding(rules[0], category, "info", c, r("s", 2), f"(select skewness({c}) as s from {table})", f"abs(s) > {skew}"))
        out.append(
            finding(rules[1], category, "info", c, r("v", 2), f"(select stddev_samp({c}) / avg({c}) * 100 as v from {table})", f"v > {cv}")
        )
    return out


def normality_findings(table: str, cols):
    return [finding("I11", "Distribution Analysis", "info", c, r("exp(-s / 2)"), f"({jarque_bera(table, c)})") for c in cols]


def correlation_findings(table: str, cols):
    p, cat = f"({pairs(table, cols)})", "Correlation Analysis"
    strong, moderate = "abs(r) >= 0.7", "abs(r) >= 0.4 and abs(r) < 0.7"
    first = f"(select * from {p} where {strong} order by ord limit 1)"
    return [
        finding("I12", cat, "=case when abs(r) > 0.9 then 'warning' else 'info' end", "=a || ',' || b", r("r", 2), first),
        finding("I13", cat, "info", "=", "n", f"(select count(*) as n from {p} where {moderate})", "n > 0"),
        finding("I14", cat, "success", "=", "0", f"(select count(*) as n from {p} where abs(r) >= 0.4)", "n = 0"),
    ]


def field_findings(table: str, cols):
    out = []
    for c in cols:
        src = f"""(select count(*) as d, max(n) as top, (select count(*) from {table}) as rows
        from (select count(*) as n from {table} where {c} is not null group by {c}))"""
        share = "top * 100.0::double / rows"
        out += [
            finding("I15", "Field Analysis", "info", c, "d", src, "d = rows"),
            finding(
                "I16", "Field Analysis", f"=case when {share} > 80 then 'warning' else 'info' end", c, r(share, 2), src,
                "d <> rows and d <= 2",
            ),
            finding("I17", "Field Analysis", "info", c, r(share, 2), src, f"d <> rows and d > 2 and {share} > 50"),
        ]
    return out


def span_finding(table: str, col: str, rule: str = "I18", category: str = "Time Analysis") -> str:
    span = f"(select date_sub('day', min({col}), max({col})) as days from {table})"
    return finding(rule, category, "info", col, "days", span)


ORACLES["insight_rules"] = union(
    [
        finding("I1", "Executive Overview", "info", "=", "n", "(select count(*) as n from lineitem)"),
        finding("I8", "Data Quality", "success", "=", "0", "(select 1)"),
        *skew_findings("lineitem", LINEITEM[:5], 1.5, 60),
        *normality_findings("lineitem", LINEITEM[:3]),
        *correlation_findings("lineitem", LINEITEM),
        *field_findings("lineitem", ["l_returnflag", "l_linestatus"]),
        span_finding("lineitem", "l_shipdate"),
        finding("I19", "Recommendation", "success", "=", "8", "(select 1)"),
        finding("I20", "Recommendation", "success", "=", "1", "(select 1)"),
        finding("I21", "Recommendation", "info", "=", "n", "(select count(*) as n from lineitem)", "n > 50000"),
    ]
)

ORACLES["insight_rules_skewed"] = union(
    [
        finding("I1", "Executive Overview", "info", "=", "n", "(select count(*) as n from events)"),
        finding("I8", "Data Quality", "success", "=", "0", "(select 1)"),
        *skew_findings("events", ["event_id", "value"], 1.5, 60),
        *normality_findings("events", ["event_id", "value"]),
        *correlation_findings("events", ["event_id", "value"]),
        *field_findings("events", ["event_type"]),
        span_finding("events", "ts"),
        finding("I19", "Recommendation", "success", "=", "2", "(select 1)"),
        finding("I20", "Recommendation", "success", "=", "1", "(select 1)"),
        finding("I21", "Recommendation", "info", "=", "n", "(select count(*) as n from events)", "n > 50000"),
    ]
)

_NUMS = ["o_orderkey", "o_custkey", "o_totalprice", "o_ordertxt_year", "o_ordertxt_month", "o_ordertxt_quarter"]
ORACLES["insight_rules_cleaned"] = _SCORES + """,
w as (select *, year(o_orderdate_txt) as o_ordertxt_year, month(o_orderdate_txt) as o_ordertxt_month,
  quarter(o_orderdate_txt) as o_ordertxt_quarter from c),
m as (select (count(*) - count(o_orderpriority)) + (count(*) - count(o_totalprice)) + (count(*) - count(o_orderdate_txt)) as n from v)
""" + union(
    [
        finding("I2", "Data Quality", "success", "=", r("after_score - before_score", 1), "z", "after_score > before_score"),
        finding("I3", "Data Quality", "warning", "=", "n", "m"),
        finding("I6", "Data Quality", "info", "=", "1", "(select 1)"),
        finding("I7", "Data Quality", "success", "=", "3", "(select 1)"),
        *skew_findings("w", _NUMS[:5], 1.5, 60),
        *correlation_findings("w", _NUMS),
        *field_findings("w", ["o_orderpriority"]),
        span_finding("w", "o_orderdate_txt"),
        finding("I19", "Recommendation", "success", "=", "6", "(select 1)"),
        finding("I20", "Recommendation", "success", "=", "1", "(select 1)"),
        finding("I21", "Recommendation", "info", "=", "n", "(select count(*) as n from w)", "n > 50000"),
    ]
)

ORACLES["insight_rules_legacy"] = union(
    [
        finding("L1", "Dataset Overview", "info", "=", "n", "(select count(*) as n from lineitem)"),
        finding("L3", "Data Quality", "success", "=", "0", "(select 1)"),
        *skew_findings("lineitem", LINEITEM[:5], 1, 50, category="Statistics"),
        finding("L6", "Statistics", "info", "=", "n", f"(select count(*) as n from ({pairs('lineitem', LINEITEM)}) where abs(r) >= 0.7)", "n > 0"),
        *[
            finding("L8", "Patterns", "success", c, "d", f"(select count(distinct {c}) as d from lineitem)", "d <= 5")
            for c in ("l_returnflag", "l_linestatus")
        ],
        span_finding("lineitem", "l_shipdate", "I18", "Patterns"),
        finding("L10", "Recommendation", "success", "=", "8", "(select 1)"),
        finding("L11", "Recommendation", "success", "=", "2", "(select 1)"),
        finding("L12", "Recommendation", "info", "=", "n", "(select count(*) as n from lineitem)", "n > 10000"),
    ]
)

ORACLES["report_charts"] = """
select * from (values (1, 'histogram', 'o_totalprice'), (2, 'bar', 'o_orderstatus'), (3, 'bar', 'o_orderpriority'),
  (4, 'line', 'o_orderdate_o_totalprice'), (5, 'grouped', 'o_orderstatus_o_totalprice'), (0, 'kpi', 'kpi_summary')) v(ord, type, "column")"""

ORACLES["chart_columns"] = f"select ord, a, b, {r('r')} as r from ({pairs('lineitem', LINEITEM[3:])})"


# ── later additions ──

ORACLES["run_append_twice"] = with_views("event_runs") + """
select user_id, count(*) as runs, false as compacted from event_runs group by user_id
union all select user_id, count(*), true from event_runs where user_id = (select max(user_id) from event_runs) group by user_id"""

ORACLES["first_values_sparse"] = union(
    f"""select * from (select 'c{k}' as "column", cast(row_number() over (order by o_orderkey) as int) as k, 'c{k}-' || o_orderkey as value
    from orders where o_orderkey % {k + 40} = {k}) where k <= 50""" for k in range(12)
)

ORACLES["correlation_wide"] = f"""
with wide as (select {", ".join(
    f"case when o_orderkey % {k + 3} <> 0 or {str(k % 2 == 0).lower()} then (o_orderkey * {2 * k + 1} + o_custkey * {k % 7}) % 101 + (o_totalprice % 97) * {k % 5} end as c{k}"
    for k in range(300))} from orders),
found as (select unnest([{", ".join(f"{{'i': {i}, 'j': {j}, 'r': corr(c{i}, c{j})}}" for i in range(300) for j in range(i + 1, 300))}], recursive := true) from wide)
select (i * 300 - i * (i + 1) // 2 + j - i - 1)::int as ord, 'c' || i as a, 'c' || j as b, {r('r')} as r from found where abs(r) > 0.2"""


def _exact_quantile(source: str, col: str, share: str) -> str:
    """One row ``q``: a quantile of a decimal column in decimal arithmetic."""
    return f"""select max(case when i = k then v end) + (max(case when i = least(k + 1, n - 1) then v end) - max(case when i = k then v end)) * cast(any_value(f) as decimal(3,2)) as q
    from (select cast({col} as decimal(30,6)) as v, row_number() over (order by {col}) - 1 as i, count(*) over () as n,
      cast(floor({share} * (count(*) over () - 1)) as bigint) as k, {share} * (count(*) over () - 1) - floor({share} * (count(*) over () - 1)) as f
      from {source} where {col} is not null)"""


ORACLES["clean_exact_money"] = with_views("exact_money") + f""",
h as ({_exact_quantile('exact_money', 'amount', '0.5')}),
f as (select o_orderkey, coalesce(cast(amount as decimal(24,4)), cast(h.q as decimal(24,4))) as amount from exact_money, h),
a as ({_exact_quantile('f', 'amount', '0.25')}), b as ({_exact_quantile('f', 'amount', '0.75')}),
e as (select cast(a.q - 1.5 * (b.q - a.q) as decimal(24,4)) as lo, cast(b.q + 1.5 * (b.q - a.q) as decimal(24,4)) as hi from a, b)
select o_orderkey, cast(greatest(lo, least(amount, hi)) as varchar) as amount, 'decimal(24,4)' as kind from f, e"""

ORACLES["csv_round_trip"] = with_views("long_ids") + "select cast(id_19 as bigint) as id_19, id_22, label from long_ids"
ORACLES["csv_round_trip_cleaned"] = with_views("long_ids") + "select cast(id_19 as bigint) as id_19, id_22 from long_ids"
ORACLES["run_append"] = with_views("event_runs") + """
select id, user_id, original_rows::bigint + 3000000000 as original_rows, cleaned_rows::bigint as cleaned_rows from event_runs"""
ORACLES["owner_history"] = with_views("event_runs") + """
select id, user_id, original_rows - cleaned_rows as removed_rows from event_runs
where user_id = (select min(user_id) from event_runs) order by created_at desc, id desc limit 15"""
ORACLES["fetch_run"] = with_views("event_runs") + """
select id, user_id, filename from event_runs where id = (select min(id) from event_runs)"""
ORACLES["histogram_far_tail"] = """
select least(floor(v / 100), 9999999999999)::bigint as bin, count(*) as n
from (select case when event_id = 0 then 1e15 else value end as v from events) where v is not null group by 1"""

_DRAWN = """
select '{c}' as "column", count(*) as n, {w} as w from (
  select v, row_number() over (order by v) as i, avg(v) over () as mean from (
    select v from (select v, unnest(range(1, n + 1)) as copy from (
      select {c}::double as v, count(*) as n from lineitem where {c} is not null group by 1))
    order by md5(concat_ws(':', '42', v, copy)), v limit 50))"""
_W = f"pow(sum(([{', '.join(map(repr, weights(50).tolist()))}])[i] * v), 2) / sum((v - mean) * (v - mean))"
_POWERS = lambda terms: " + ".join(f"({x}) * ln(50) ** {i}" for i, x in enumerate(terms))
_Z = f"(ln(1 - w) - ({_POWERS(LARGE_MEAN)})) / exp({_POWERS(LARGE_LOG_STD)})"


_KEYED = """
select '{c}' as "column", count(*) as n, {w} as w from (
  select v, row_number() over (order by v) as i, avg(v) over () as mean from (
    select {c}::double as v from lineitem where {c} is not null
    order by substr(md5(concat_ws(':', '42', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 15) limit 50))"""


def shapiro(c: str, drawn: str = _DRAWN) -> str:
    """``column, n, w, p`` of 50 drawn values; the normal tail by an approximation right to seven digits."""
    return f"""select "column", n, w, case when z < 0 then 1 - q else q end as p from (
      select *, exp(-z * z / 2) / sqrt(2 * pi()) * (0.319381530 * t - 0.356563782 * t ** 2 + 1.781477937 * t ** 3
        - 1.821255978 * t ** 4 + 1.330274429 * t ** 5) as q
      from (select *, 1 / (1 + 0.2316419 * abs(z)) as t from (select *, {_Z} as z from ({drawn.format(c=c, w=_W)}))))"""


ORACLES["shapiro_sample"] = union(
    f"""select "column", n, {r('w', 6)} as w, {r('p')} as p from ({shapiro(c)})""" for c in ("l_quantity", "l_extendedprice")
)

ORACLES["shapiro_keyed"] = union(
    f"""select "column", n, {r('w', 6)} as w, {r('p')} as p from ({shapiro(c, _KEYED)})""" for c in ("l_quantity", "l_extendedprice")
)
