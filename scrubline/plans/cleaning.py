"""The cleaning pipeline: decide from small profiles, apply as column expressions.

Each pass collects a handful of numbers per column and turns them into
expressions on the lazy table. The table itself is written once, after the
duplicates are gone, so that everything later reads only the columns it needs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from scrubline.config import CURRENT, LEGACY, CleanConfig
from scrubline.functions import dates as D
from scrubline.functions import numbers as N
from scrubline.functions import text as X
from scrubline.functions.names import normalise_names
from scrubline.jobs import together
from scrubline.operators.columns import (
    ROW_ID, batches, data_columns, family, fold_nan, numeric_columns, quoted, row_order, small_frame, text_columns,
)
from scrubline.operators.duplicates import business_key, duplicate_count, first_of_each
from scrubline.operators.frequencies import distinct_counts
from scrubline.operators.missing import (
    Fill, apply_fills, decide_fills, fill_in_order, fill_log, sparse_columns,
)
from scrubline.operators.ordering import first_rows, numbered
from scrubline.operators.outliers import Fence, cap, count_outside, outlier_report, tukey_fences
from scrubline.operators.profile import Moments, moments, null_counts
from scrubline.operators.quality import consistency, score
from scrubline.operators.roles import NUMERIC_ROLES, Role, first_values, infer_roles
from scrubline.staging import stage


@dataclass
class Report:
    """Everything decided and counted along the way; its size grows with the columns only."""

    variant: str = "current"
    rows_before: int = 0
    rows_after: int = 0
    roles: list[Role] = field(default_factory=list)
    renames: dict[str, str] = field(default_factory=dict)
    coercions: dict[str, str] = field(default_factory=dict)
    currency: list[str] = field(default_factory=list)
    percent: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    protected: list[str] = field(default_factory=list)
    fills: list[Fill] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)
    exact_removed: int = 0
    key_removed: int = 0
    key: list[str] = field(default_factory=list)
    date_formats: dict[str, str] = field(default_factory=dict)
    dates_parsed: list[str] = field(default_factory=list)
    date_features: list[str] = field(default_factory=list)
    fences: list[Fence] = field(default_factory=list)
    nulls_before: dict[str, int] = field(default_factory=dict)
    nulls_after: dict[str, int] = field(default_factory=dict)
    duplicates_before: int = 0
    duplicates_after: int = 0
    quality_before: float = 0.0
    quality_after: float = 0.0
    log: list[tuple[str, str]] = field(default_factory=list)

    @property
    def steps(self) -> list[str]:
        return [text for kind, text in self.log if kind == "step"]

    def section(self, text: str) -> None:
        self.log.append(("section", text))

    def detail(self, text: str) -> None:
        self.log.append(("detail", text))

    def step(self, text: str) -> None:
        self.log.append(("step", text))

    def as_dict(self) -> dict:
        """Plain values, ready for JSON; decimals as texts, which keep their digits."""
        out = asdict(self, dict_factory=lambda items: {k: str(v) if isinstance(v, Decimal) else v for k, v in items})
        out["log"] = [{"type": kind, "text": text} for kind, text in self.log]
        out["steps"] = self.steps
        return out


@dataclass
class Cleaned:
    table: DataFrame
    report: Report

    def log(self) -> DataFrame:
        rows = [(i, kind, text) for i, (kind, text) in enumerate(self.report.log)]
        return small_frame(self.table, rows, "seq int, type string, text string")

    def renames(self) -> DataFrame:
        rows = [(i, a, b) for i, (a, b) in enumerate(self.report.renames.items())]
        return small_frame(self.table, rows, "ord int, original string, standardised string")

    def fills(self) -> DataFrame:
        return fill_log(self.table, self.report.fills)

    def outliers(self) -> DataFrame:
        return outlier_report(self.table, self.report.fences)


def clean(df: DataFrame, order_by: Sequence[str] | None = None, config: CleanConfig = CURRENT) -> Cleaned:
    """Seven passes over a raw table; returns the cleaned table and the report.

    ``order_by`` names raw columns that put the rows in order; without it the
    row id of ``read_table`` does, else the columns themselves.
    """
    if not config.use_roles:
        return clean_legacy(df, order_by, config)
    report = Report()
    named, order = name_pass(df, order_by, report)
    df, order = numbered(fold_nan(named), order), None  # from here on the rows' numbers are their order
    rows, nulls = counted = null_counts(df)
    report.rows_before = rows
    report.nulls_before = nulls
    raw = df
    roles, report.duplicates_before = together(
        lambda: infer_roles(raw, order, config, counted), lambda: duplicate_count(raw).first()["duplicates"]
    )
    report.roles = roles
    report.detail("Roles: " + ", ".join(f"{r.column}={r.role}" for r in roles))

    df = stage(value_pass(df, roles, report, config), "values")
    df = missing_pass(df, roles, order, report, config)
    df = duplicate_pass(df, roles, order, report, config)
    df = late_passes(df, roles, order, report, config)
    return Cleaned(df.select(*[quoted(c) for c in data_columns(df)]), report)


def name_pass(df: DataFrame, order_by, report: Report) -> tuple[DataFrame, list[str] | None]:
    report.section("Column names and roles")
    named, renames = normalise_names(df, [ROW_ID])
    report.renames = renames
    if renames:
        report.detail("Renamed: " + ", ".join(f"{a} -> {b}" for a, b in list(renames.items())[:5]))
        report.step(f"{len(renames)} column name(s) brought to snake case")
    order = [renames.get(c, c) for c in order_by] if order_by else None
    return named, order


def value_expression(name: str, role: str, kind: str, exact: bool = False):
    """How one unprotected column is cleaned, row by row; ``exact`` numbers keep their type."""
    c = quoted(name)
    if kind != "text":
        # typed values hold no placeholder texts, and money is already a number
        return c.cast("double") if role in ("currency", "pct") and not exact else c
    c = X.null_fakes(c)
    if role == "currency":
        return N.parse_currency(c)
    if role == "pct":
        return N.parse_percent(c)
    if role == "categorical":
        return X.title_case(X.normalise_text(c))
    if role == "text":
        return X.normalise_text(c)
    return c


def apply_values(df: DataFrame, roles: Sequence[Role]) -> DataFrame:
    """Row-by-row cleaning of every unprotected column."""
    new = {
        r.column: value_expression(r.column, r.role, r.family, isinstance(df.schema[r.column].dataType, DecimalType))
        for r in roles
        if not r.protected and r.role != "other" and r.family != "boolean"
    }
    return df.withColumns(new) if new else df


def value_pass(df: DataFrame, roles: Sequence[Role], report: Report, config: CleanConfig) -> DataFrame:
    report.section("Values")
    by_role = lambda *names: [r.column for r in roles if r.role in names]
    report.currency, report.percent = by_role("currency"), by_role("pct")
    report.texts = by_role("categorical", "text")
    report.protected = [r.column for r in roles if r.protected]
    df = apply_values(df, roles)
    if config.coerce_numeric:
        df, coerced = coerce_numbers(df, by_role("text", "categorical"), config.coerce_share)
        report.coercions = dict.fromkeys(coerced, "text to number")
        for r in [r for r in roles if r.column in coerced]:
            roles[roles.index(r)] = Role(r.column, "numeric", "text")
        report.texts = [c for c in report.texts if c not in coerced]
    if report.currency:
        report.step(f"Money symbols removed from {len(report.currency)} column(s): {', '.join(report.currency[:3])}")
    if report.percent:
        report.step(f"Percent texts read as fractions in {len(report.percent)} column(s)")
    if report.texts:
        report.step(f"Casing and spacing evened out in {len(report.texts)} text column(s)")
    return df


def coerce_numbers(df: DataFrame, cols: Sequence[str], share: float = 0.5) -> tuple[DataFrame, list[str]]:
    """Turn text columns into numbers where more than ``share`` of all rows convert."""
    if not cols:
        return df, []
    rates = df.agg(
        *[(F.count(N.to_number(quoted(c))) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias(f"c{i}")
          for i, c in enumerate(cols)]
    ).first()
    good = [c for i, c in enumerate(cols) if rates[f"c{i}"] > share]
    return (df.withColumns({c: N.to_number(quoted(c)) for c in good}) if good else df), good


def missing_pass(df: DataFrame, roles, order, report: Report, config: CleanConfig) -> DataFrame:
    report.section("Missing values")
    rows, nulls, stats = value_nulls(df, roles, report)
    report.dropped = sparse_columns(roles, rows, nulls, config)
    df = df.drop(*report.dropped) if report.dropped else df
    kept = [r for r in roles if r.column not in report.dropped]
    gaps = [r.column for r in kept if r.role == "date" and nulls[r.column]]
    report.fills, df = together(
        lambda: decide_fills(df, kept, rows, nulls, config, stats), lambda: fill_in_order(df, gaps, order)
    )
    df = apply_fills(df, report.fills)
    for c in report.dropped:
        report.detail(f"{c}: dropped, {nulls[c] / rows:.0%} missing")
    for f in report.fills:
        report.detail(f"{f.column}: {f.count} missing, {f.strategy}")
    if report.fills:
        cells = sum(f.count for f in report.fills)
        report.step(f"{cells:,} missing value(s) filled in {len(report.fills)} column(s)")
    if report.dropped:
        report.step(
            f"{len(report.dropped)} column(s) above {config.drop_null_share:.0%} missing dropped: "
            + ", ".join(report.dropped[:4])
        )
    return df


def value_nulls(df: DataFrame, roles, report: Report) -> tuple[int, dict[str, int], dict[str, Moments]]:
    """Rows and missing values after the value pass, and the moments found on the way.

    Only cleaned texts can have lost values; those read as numbers are counted
    by their moments, so no column is cleaned twice. The rest keeps its raw count.
    """
    rows = report.rows_before
    nulls = dict(zip((r.column for r in roles), report.nulls_before.values()))
    cleaned = [r for r in roles if r.family == "text" and not r.protected]
    numbers = [r.column for r in cleaned if r.role in NUMERIC_ROLES]
    gaps = [r.column for r in roles if r.family == "numeric" and r.role in NUMERIC_ROLES and nulls[r.column]]
    texts = [r.column for r in cleaned if r.column not in numbers]
    stats, (_, fresh) = together(
        lambda: moments(df, numbers + [c for c in gaps if c not in numbers]), lambda: null_counts(df, texts)
    )
    nulls.update(fresh)
    nulls.update({c: rows - stats[c].n for c in numbers})
    return rows, nulls, stats


def duplicate_pass(df: DataFrame, roles, order, report: Report, config: CleanConfig) -> DataFrame:
    """Both kinds of duplicates go in one staged write, which also carries their counts."""
    report.section("Duplicates")
    report.key = [c for c in business_key(roles, config) if c in df.columns]
    staged = stage(first_of_each(df, report.key), "unique")
    rows, exact = staged.agg(F.count(F.lit(1)), F.coalesce(F.sum("_repeats"), F.lit(0))).first()
    df = staged.drop("_repeats")
    report.exact_removed = report.rows_before - exact
    report.key_removed = exact - rows
    report.rows_after = rows
    if report.exact_removed:
        report.step(f"{report.exact_removed} exact duplicate row(s) removed")
    if report.key_removed:
        report.step(f"{report.key_removed} repeat(s) of the key {', '.join(report.key)} removed")
    return df


def guess_format(df: DataFrame, col: str, order: Sequence[str] | None) -> str | None:
    """Date layout of the first value of a text column, month first when both fit."""
    keep = row_order(df, order)
    some = df.where(quoted(col).isNotNull()).select(*[quoted(c) for c in dict.fromkeys([*keep, col])])
    first = first_rows(some, keep, 1).select(quoted(col)).first()
    if first is None:
        return None
    value = F.lit(first[0])
    fits = small_frame(df, [(0,)], "one int").select(
        *[D.parse_date(value, f).isNotNull().alias(f"f{i}") for i, f in enumerate(D.GUESS_FORMATS)]
    ).first()
    return next((f for i, f in enumerate(D.GUESS_FORMATS) if fits[f"f{i}"]), None)


def parsed_date(col: str, fmt: str):
    """Expression of a date text in a decided layout; ``mixed`` tries them all."""
    return D.parse_mixed_date(quoted(col)) if fmt == "mixed" else D.parse_date(quoted(col), fmt)


def date_pass(df: DataFrame, roles, order, report: Report, config: CleanConfig) -> DataFrame:
    report.section("Dates")
    cols = [r.column for r in roles if r.role == "date" and r.column in df.columns]
    texts = [c for c in cols if family(df.schema[c].dataType) == "text"]
    formats = {c: "mixed" if config.date_mode == "mixed" else guess_format(df, c, order) for c in texts}
    known = {c: f for c, f in formats.items() if f}
    if known:
        rates = df.agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.count(parsed_date(c, f)).alias(f"c{i}") for i, (c, f) in enumerate(known.items())],
        ).first()
        good = {
            c: f for i, (c, f) in enumerate(known.items())
            if rates[f"c{i}"] / max(rates["rows"], 1) >= config.date_parse_share
        }
        df = df.withColumns({c: parsed_date(c, f) for c, f in good.items()}) if good else df
        report.date_formats = good
    report.dates_parsed = list(report.date_formats)
    for c in texts:
        report.detail(f"{c}: " + (f"read as dates, {formats[c]}" if c in report.date_formats else "left as text"))

    typed = [c for c in cols if family(df.schema[c].dataType) == "date"]
    if config.derive_dates and typed:
        distinct = distinct_counts(df, typed, config.min_distinct_dates)
        for c in typed:
            if distinct[c] >= config.min_distinct_dates:
                base = D.feature_base(c)
                parts = dict(zip(("year", "month", "quarter"), D.date_parts(quoted(c), base)))
                df = df.withColumns({f"{base}_{p}": e for p, e in parts.items()})
                report.date_features += [f"{base}_{p}" for p in parts]
    if report.dates_parsed:
        report.step(
            f"{len(report.dates_parsed)} date column(s) parsed, {len(report.date_features)} time feature(s) added"
        )
    return df


def late_passes(df: DataFrame, roles, order, report: Report, config: CleanConfig) -> DataFrame:
    """Dates, outliers and score. The numbers at hand do not wait for the dates to be parsed."""
    guarded = {r.column for r in roles if r.protected}
    numbers = numeric_columns(df)
    stats: dict[str, Moments] = {}

    def fences(table: DataFrame, cols: Sequence[str]) -> list[Fence]:
        found = tukey_fences(table, [c for c in cols if c not in guarded], config, stats)
        return count_outside(table, found, config)

    staged = df
    df, early, ids = together(
        lambda: date_pass(staged, roles, order, report, config),
        lambda: fences(staged, numbers),
        lambda: moments(staged, [c for c in numbers if c in guarded]),
    )
    stats.update(ids)
    late = fences(df, [c for c in numeric_columns(df) if c not in numbers])
    df = outlier_pass(df, early + late, report)
    quality_pass(df, report, config, stats)
    return df


def outlier_pass(df: DataFrame, fences: Sequence[Fence], report: Report) -> DataFrame:
    report.section("Outliers")
    report.fences = list(fences)
    for f in report.fences:
        report.detail(f"{f.column}: {f.outside} value(s) capped to [{f.lower:.2f}, {f.upper:.2f}]")
    if report.fences:
        total = sum(f.outside for f in report.fences)
        report.step(f"{total:,} outlier(s) capped in {len(report.fences)} column(s)")
    return cap(df, report.fences) if report.fences else df


def quality_pass(df: DataFrame, report: Report, config: CleanConfig, stats: dict[str, Moments]) -> None:
    """Score before and after; both use the consistency of the cleaned table.

    ``stats`` holds the moments before capping, which stand for every column not capped.
    """
    report.section("Quality")
    changed = [f.column for f in report.fences]
    repeats = 0 if key_settles_rows(report) else None
    (rows, report.nulls_after), after, report.duplicates_after = together(
        lambda: null_counts(df),
        lambda: moments(df, changed),
        lambda: duplicate_count(df).first()["duplicates"] if repeats is None else repeats,
    )
    final = {**stats, **after}
    consistent = consistency((final[c].skew for c in numeric_columns(df)), config)
    report.quality_before = score(
        report.rows_before, len(report.nulls_before), sum(report.nulls_before.values()),
        report.duplicates_before, consistent,
    )
    report.quality_after = score(
        rows, len(report.nulls_after), sum(report.nulls_after.values()), report.duplicates_after, consistent
    )
    report.detail(f"Quality score {report.quality_before} -> {report.quality_after}")


def key_settles_rows(report: Report) -> bool:
    """Whether the key alone keeps all rows apart: it was deduplicated and not changed since."""
    touched = set(report.dates_parsed) | {f.column for f in report.fences}
    return bool(report.key) and not touched & set(report.key)


def clean_legacy(df: DataFrame, order_by: Sequence[str] | None = None, config: CleanConfig = LEGACY) -> Cleaned:
    """The older variant: missing values, duplicates, text, dates, outliers, by type alone."""
    report = Report(variant="legacy")
    df, order_by = numbered(fold_nan(df), order_by), None
    rows, nulls = null_counts(df)
    report.rows_before, report.nulls_before = rows, nulls
    roles = infer_roles(df, order_by, config)
    report.roles = roles

    df = missing_pass(df, roles, order_by, report, config)
    df = duplicate_pass(df, [], order_by, report, config)
    df = legacy_text_pass(df, order_by, report, config)
    df = legacy_date_pass(df, order_by, report, config)
    df = outlier_pass(df, count_outside(df, tukey_fences(df, None, config), config), report)
    report.rows_after, report.nulls_after = null_counts(df)
    return Cleaned(df.select(*[quoted(c) for c in data_columns(df)]), report)


def legacy_text_pass(df: DataFrame, order_by, report: Report, config: CleanConfig) -> DataFrame:
    """Trim and squeeze every text; title case unless an early value looks like prose, mail or link."""
    cols = text_columns(df)
    if not cols:
        return df
    trimmed = {c: X.strip(F.regexp_replace(quoted(c), r"(?U)\s+", " ")) for c in cols}
    squeezed = df.withColumns(trimmed)
    v = F.col("value")
    labels = (F.length(v) < 50) & ~v.contains("@") & ~v.contains("http")
    sample = first_values(squeezed, cols, row_order(squeezed, order_by), config.sample_values)
    titled = {r["column"]: r["ok"] for r in sample.groupBy("column").agg(F.min(labels).alias("ok")).collect()}
    new = {}
    for c in cols:
        e = X.title_case(trimmed[c]) if titled.get(c, True) else trimmed[c]
        new[c] = F.when(~e.isin(*X.LEGACY_NULLS), e)
    changed = {}
    for some in batches(cols, 16):
        row = df.agg(*[F.max(~new[c].eqNullSafe(quoted(c))).alias(f"c{i}") for i, c in enumerate(some)]).first()
        changed.update({c: bool(row[f"c{i}"]) for i, c in enumerate(some)})
    report.texts = [c for c in cols if changed[c]]
    if report.texts:
        report.step(f"Text evened out in {len(report.texts)} column(s): {', '.join(report.texts[:5])}")
    return df.withColumns(new)


def legacy_date_pass(df: DataFrame, order_by, report: Report, config: CleanConfig) -> DataFrame:
    """Parse text columns whose early values are mostly date-shaped."""
    cols = text_columns(df)
    if not cols:
        return df
    sample = first_values(df, cols, row_order(df, order_by), config.sample_values)
    shaped = F.avg(F.col("value").rlike(D.LEGACY_DATE_SHAPE).cast("int"))
    shares = {r["column"]: r["share"] for r in sample.groupBy("column").agg(shaped.alias("share")).collect()}
    likely = [c for c in cols if shares.get(c, 0) >= config.date_share]
    formats = {c: f for c in likely if (f := guess_format(df, c, order_by))}
    if not formats:
        return df
    rates = df.agg(
        *[F.avg(parsed_date(c, f).isNotNull().cast("int")).alias(f"c{i}") for i, (c, f) in enumerate(formats.items())]
    ).first()
    report.date_formats = {
        c: f for i, (c, f) in enumerate(formats.items()) if (rates[f"c{i}"] or 0) >= config.date_parse_share
    }
    report.dates_parsed = list(report.date_formats)
    if report.dates_parsed:
        report.step(f"{len(report.dates_parsed)} date column(s) parsed: {', '.join(report.dates_parsed)}")
        df = df.withColumns({c: parsed_date(c, f) for c, f in report.date_formats.items()})
    return df
