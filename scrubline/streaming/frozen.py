"""Row-by-row cleaning with the decisions of an earlier report.

Nothing here looks at other rows, so it runs alike on a batch and on a
streaming DataFrame, and needs no state. Fills along the row order do need
other rows: those columns keep their gaps, and a warning names them.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame

from scrubline.functions import dates as D
from scrubline.functions import numbers as N
from scrubline.functions.names import normalise_names
from scrubline.operators.columns import ROW_ID, fold_nan, quoted
from scrubline.operators.missing import IN_ORDER, apply_fills
from scrubline.operators.outliers import cap
from scrubline.plans.cleaning import Report, apply_values, parsed_date


def apply_report(df: DataFrame, report: Report) -> DataFrame:
    """Names, values, constant fills, dates, time features and caps as decided in ``report``."""
    if report.variant != "current":
        raise ValueError("a report of the older variant holds no rules that work row by row")
    ordered = [f.column for f in report.fills if f.strategy == IN_ORDER]
    if ordered:
        warnings.warn(f"filled along the row order when cleaning, left with gaps here: {', '.join(ordered)}", stacklevel=2)
    df, _ = normalise_names(df, [ROW_ID])
    df = fold_nan(df)
    df = apply_values(df, report.roles)
    df = df.withColumns({c: N.to_number(quoted(c)) for c in report.coercions}).drop(*report.dropped)
    df = apply_fills(df, report.fills)
    if report.date_formats:
        df = df.withColumns({c: parsed_date(c, f) for c, f in report.date_formats.items()})
    for r in report.roles:
        base = D.feature_base(r.column)
        if r.role == "date" and f"{base}_year" in report.date_features:
            df = df.select("*", *D.date_parts(quoted(r.column), base))
    return cap(df, report.fences) if report.fences else df
