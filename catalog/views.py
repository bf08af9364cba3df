"""Test tables and views with planted defects; one SQL text serves both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DIRTY = {
    # nulls, placeholder texts, case and spacing noise, a sparse column, dates as text
    "dirty_orders": """
select o_orderkey, o_custkey,
  case when o_orderkey % 7 = 0 then null
       when o_orderkey % 11 = 0 then 'N/A'
       when o_orderkey % 13 = 0 then concat('  ', lower(o_orderpriority), '   x ')
       else o_orderpriority end as o_orderpriority,
  case when o_orderkey % 9 = 0 then null else o_totalprice end as o_totalprice,
  case when o_orderkey % 10 < 3 then o_orderstatus end as sparse_status,
  case when o_orderkey % 5 = 0 then null else cast(cast(o_orderdate as date) as varchar(10)) end as o_orderdate_txt
from {orders}""",
    # money and percent texts, numbers mixed with words, missing numbers
    "dirty_lineitem": """
select l_orderkey, l_linenumber,
  concat('$', cast(cast(l_extendedprice as decimal(18,2)) as varchar(30))) as price_txt,
  case when l_orderkey % 17 = 0 then '-'
       else concat(cast(cast(round(l_discount*100) as int) as varchar(5)), '%') end as disc_txt,
  case when l_orderkey % 4 = 0 then 'bad' else cast(cast(l_quantity as int) as varchar(9)) end as qty_txt,
  case when l_orderkey % 6 = 0 then null else l_quantity end as l_quantity
from {lineitem}""",
    # case noise, placeholder texts, missing values, gaps in the dates
    "dirty_events": """
select event_id, ts, user_id,
  case when event_id % 3 = 0 then upper(event_type) when event_id % 5 = 0 then 'unknown' else event_type end as event_type,
  case when event_id % 8 = 0 then null else value end as value,
  case when event_id % 4 = 0 then null else cast(cast(ts as date) as varchar(10)) end as day_txt
from {events}""",
    # five percent exact copies
    "dup_orders": "select * from {orders} union all select * from {orders} where o_orderkey % 20 = 0",
    # dates in four layouts
    "mixed_dates": """
select o_orderkey,
  case o_orderkey % 4
    when 0 then concat(yyyy, '-', mm, '-', dd)
    when 1 then concat(dd, '/', mm, '/', yyyy)
    when 2 then concat(yyyy, mm, dd)
    else 'soon' end as day_txt
from (select o_orderkey, substring(iso, 1, 4) as yyyy, substring(iso, 6, 2) as mm, substring(iso, 9, 2) as dd
      from (select o_orderkey, cast(cast(o_orderdate as date) as varchar(10)) as iso from {orders}) a) b""",
    # whole numbers too long for a double, and for 64 bits
    "long_ids": """
select concat('1234567890123', substring(cast(1000000 + o_orderkey as varchar(9)), 2, 6)) as id_19,
  concat('1234567890123456', substring(cast(1000000 + o_orderkey as varchar(9)), 2, 6)) as id_22,
  case when o_orderkey % 9 = 0 then null else o_orderpriority end as label
from {orders}""",
    # money of 19 digits, more than a double holds, with gaps and values far off
    "exact_money": """
select o_orderkey, cast(case when o_orderkey % 97 = 1 then null when o_orderkey % 500 = 33 then '99071992547400000.07'
    else concat(cast(90071992547400000 + (o_orderkey * 7919) % 5000 as varchar(20)), '.', substring(cast(100 + o_orderkey % 89 as varchar(3)), 2, 2))
  end as decimal(22,2)) as amount
from {orders}""",
    # contacts with mail and fax, exact copies, repeats of the id, values far off and a dominant state
    "contacts": """
select c_custkey as client_id, c_name as full_name,
  case when c_custkey % 7 = 0 then null else concat('c', cast(c_custkey as varchar(20)), '@mail.org') end as write_to,
  case when c_custkey % 11 = 0 then null else concat('+49 30 ', cast(1000000 + c_custkey as varchar(20))) end as fax,
  case when c_custkey % 10 < 6 then 'open' when c_custkey % 10 < 8 then 'held' when c_custkey % 10 < 9 then 'shut' end as state,
  cast(case when c_custkey % 9 = 0 then null when c_custkey % 50 = 1 then 900 else 20 + c_custkey % 40 end as double) as level,
  cast(20 + c_custkey % 40 + (c_custkey * 7919) % 61 + extra as double) as paid,
  cast(2 * (20 + c_custkey % 40) + (c_custkey * 31) % 23 as double) as owed
from (select c_custkey, c_name, 0 as extra from {customer}
      union all select c_custkey, c_name, 0 from {customer} where c_custkey % 20 = 0
      union all select c_custkey, c_name, 1 from {customer} where c_custkey % 30 = 0) a""",
    # one analysis run per event
    "event_runs": """
select event_id as id, user_id, concat(event_type, '.csv') as filename,
  cast(event_id % 1000 + 100 as int) as original_rows, cast(event_id % 1000 + 100 - event_id % 7 as int) as cleaned_rows,
  cast(event_id % 50 + 40 as double) as quality_before, cast(event_id % 50 + 50 as double) as quality_after,
  ts as created_at
from {events}""",
}

SOURCE = {
    "dirty_orders": "orders", "dirty_lineitem": "lineitem", "dirty_events": "events",
    "dup_orders": "orders", "mixed_dates": "orders", "event_runs": "events", "long_ids": "orders",
    "exact_money": "orders", "contacts": "customer",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, or a view over one."""
    if name in DIRTY:
        source = SOURCE[name]
        return spark.sql(DIRTY[name], **{source: table(spark, sf_dir, source)})
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(*names: str) -> str:
    """``with`` clause that defines views for the SQL side."""
    parts = [f"{n} as ({DIRTY[n].format(**{SOURCE[n]: SOURCE[n]})})" for n in names]
    return "with " + ", ".join(parts)
