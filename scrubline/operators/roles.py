"""Semantic roles: what a column means, from its name, type and first values."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubline.config import CURRENT, CleanConfig
from scrubline.functions.dates import looks_like_date
from scrubline.functions.numbers import as_written
from scrubline.functions.text import strip
from scrubline.jobs import together
from scrubline.operators.columns import ROW_ID, data_columns, family, quoted, row_order, small_frame
from scrubline.operators.frequencies import distinct_counts
from scrubline.operators.ordering import first_rows
from scrubline.operators.profile import null_counts

# Name patterns, matched anywhere in the lower-case name.
ID_NAME = r"(^id$|_id$|^id_|uuid|guid|key|code|sku|ref|serial|phone|mobile|email|url|link)"
EMAIL_NAME = r"email"
PHONE_NAME = r"phone|mobile|tel|fax"

# A money symbol anywhere, or a whole number of cents.
CURRENCY_VALUE = r"[$€£¥₹]|^\d[\d,]+\.\d{2}$"

PROTECTED = ("id", "email", "phone")
NUMERIC_ROLES = ("numeric", "currency", "pct")

SEARCH = 4  # times k: rows searched for the first k values before going column by column


@dataclass(frozen=True)
class Role:
    column: str
    role: str
    family: str

    @property
    def protected(self) -> bool:
        return self.role in PROTECTED


def first_values(
    df: DataFrame, cols: Sequence[str], order_by: Sequence[str], k: int, rows: int | None = None,
    filled: dict[str, int] | None = None,
) -> DataFrame:
    """``column, k, value``: the first ``k`` non-null values of each column, as text.

    One bounded prefix serves every column that has ``k`` values in it. In a
    numbered table one scan serves all of the sparse rest; else they are looked up
    one at a time. ``filled`` tells how many non-null values each column has at all.
    """
    kinds = dict(df.dtypes)
    depth = SEARCH * k
    prefix = first_rows(df, order_by, depth)
    order = F.struct(*[quoted(c) for c in order_by])
    text = {c: as_written(quoted(c), kinds[c]) for c in cols}

    def ranked(source: DataFrame, names: Sequence[str]) -> DataFrame:
        cells = [F.struct(F.lit(c).alias("column"), text[c].alias("value")) for c in names]
        w = Window.partitionBy("column").orderBy("_order")
        return (
            source.select(order.alias("_order"), F.inline(F.array(*cells)))
            .where(F.col("value").isNotNull())
            .withColumn("k", F.row_number().over(w))
            .where(F.col("k") <= k)
            .select("column", "k", "value")
        )

    if rows is None:
        rows = df.count()
    sparse: list[str] = []
    gappy = [c for c in cols if filled is None or filled.get(c) != rows]
    if rows > depth and gappy:
        found = prefix.agg(*[F.count(quoted(c)) for c in gappy]).first()
        sparse = [c for c, n in zip(gappy, found) if n < min(k, (filled or {}).get(c, k))]
    out = [ranked(prefix, [c for c in cols if c not in sparse])] if len(sparse) < len(cols) else []
    if sparse and list(order_by) == [ROW_ID]:
        out.append(ranked_by_number(df, {c: text[c] for c in sparse}, k))
        sparse = []
    for c in sparse:
        keep = list(dict.fromkeys([*order_by, c]))
        some = df.where(quoted(c).isNotNull()).select(*[quoted(x) for x in keep])
        out.append(ranked(first_rows(some, order_by, k), [c]))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def ranked_by_number(df: DataFrame, texts: dict[str, Column], k: int) -> DataFrame:
    """``column, k, value``: the non-null values with the ``k`` smallest row numbers, of all columns in one scan.

    Each task keeps ``k`` values per column, so that many rows per task are ranked.
    """
    names = list(texts)

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {i: (np.zeros(0, np.int64), pa.array([], pa.string())) for i in range(len(names))}
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for i in range(len(names)):
                values = batch.column(i + 1)
                at = np.flatnonzero(values.is_valid().to_numpy(zero_copy_only=False))
                if len(kept[i][0]) == k:
                    at = at[numbers[at] < kept[i][0].max()]
                if not len(at):
                    continue
                at = at[np.argsort(numbers[at])[:k]]
                both = np.concatenate([kept[i][0], numbers[at]])
                best = np.argsort(both, kind="stable")[:k]
                kept[i] = both[best], pa.concat_arrays([kept[i][1], values.take(pa.array(at))]).take(pa.array(best))
        for i, (numbers, values) in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([names[i]] * len(numbers), pa.string()), pa.array(numbers), values], ["column", "number", "value"])

    some = df.select(F.col(ROW_ID), *[e.cast("string").alias(f"c{i}") for i, e in enumerate(texts.values())])
    best = some.mapInArrow(smallest, "column string, number long, value string")
    w = Window.partitionBy("column").orderBy("number")
    return best.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k).select("column", "k", "value")


def sample_shares(values: DataFrame, config: CleanConfig = CURRENT) -> DataFrame:
    """Share of sampled values that look like e-mail, money, percent and date, per column."""
    v = F.col("value")

    def share(hit: Column) -> Column:
        return F.avg(hit.cast("int"))

    return values.groupBy("column").agg(
        share(v.contains("@")).alias("email"),
        share(v.rlike(CURRENCY_VALUE)).alias("currency"),
        share(F.endswith(strip(v), F.lit("%"))).alias("percent"),
        share(F.when(F.col("k") <= config.date_sample_values, looks_like_date(v))).alias("date"),
    )


def infer_roles(
    df: DataFrame,
    order_by: Sequence[str] | None = None,
    config: CleanConfig = CURRENT,
    counted: tuple[int, dict[str, int]] | None = None,
) -> list[Role]:
    """Role per column. ``counted`` (rows, nulls per column) saves a scan when known."""
    kinds = {f.name: family(f.dataType) for f in df.schema.fields}
    cols = data_columns(df)
    if not config.use_roles:
        plain = {"text": "text", "numeric": "numeric", "date": "date", "boolean": "categorical"}
        return [Role(c, plain.get(kinds[c], "other"), kinds[c]) for c in cols]

    rules = (("id", ID_NAME), ("email", EMAIL_NAME), ("phone", PHONE_NAME))
    by_name = {
        c: next(role for role, rule in rules if re.search(rule, c.lower()))
        for c in cols
        if any(re.search(rule, c.lower()) for _, rule in rules)
    }
    open_cols = [c for c in cols if c not in by_name and kinds[c] != "other"]
    rows, nulls = counted or null_counts(df, open_cols)
    filled = {c: rows - nulls[c] for c in open_cols}
    sampled = [c for c in open_cols if kinds[c] in ("text", "numeric") and filled[c]]

    def sample() -> dict:
        if not sampled:
            return {}
        values = first_values(df, sampled, row_order(df, order_by), config.sample_values, rows, filled)
        return {r["column"]: r for r in sample_shares(values, config).collect()}  # one row per column

    texts = [c for c in open_cols if kinds[c] == "text"]
    shares, distinct = together(sample, lambda: distinct_counts(df, texts, config.max_categories))

    def by_value(c: str) -> str | None:
        s = shares.get(c)
        if s is not None:
            if s["email"] > config.email_share:
                return "email"
            if s["currency"] > config.currency_share:
                return "currency"
            if s["percent"] > config.percent_share:
                return "pct"
        if kinds[c] in ("numeric", "date"):
            return kinds[c]
        if kinds[c] == "boolean":
            return "categorical"
        if s is not None and s["date"] > config.date_share:
            return "date"
        return None

    found = by_name | {c: r for c in open_cols if (r := by_value(c))}
    for c in [c for c in open_cols if c not in found]:
        few = distinct[c] <= config.max_categories and distinct[c] < config.max_category_ratio * rows
        found[c] = "categorical" if few else "text"
    return [Role(c, found.get(c, "other"), kinds[c]) for c in cols]


def role_frame(df: DataFrame, roles: Sequence[Role]) -> DataFrame:
    """``ord, column, role, protected``."""
    rows = [(i, r.column, r.role, r.protected) for i, r in enumerate(roles)]
    return small_frame(df, rows, "ord int, column string, role string, protected boolean")


def role_counts(roles: DataFrame) -> DataFrame:
    """Columns per role, money and percent counted with the numeric ones."""
    merged = F.when(F.col("role").isin(*NUMERIC_ROLES), "numeric").otherwise(F.col("role"))
    return roles.groupBy(merged.alias("role")).agg(F.count(F.lit(1)).alias("n"))
