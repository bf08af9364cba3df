"""One call from raw table to cleaned table, charts, findings, statistics and a history row."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame

from scrubline.config import CURRENT, INSIGHTS, CleanConfig, InsightConfig
from scrubline.operators.profile import numeric_stats
from scrubline.plans.charts import Chart, chart_datasets
from scrubline.plans.cleaning import Cleaned, clean
from scrubline.plans.insights import insights
from scrubline.sources.runs import RUN_SCHEMA
from scrubline.sources.tables import require_rows


@dataclass
class Analysis:
    cleaned: Cleaned
    charts: list[Chart]
    insights: DataFrame
    stats: DataFrame


def analyse(
    df: DataFrame, order_by: Sequence[str] | None = None, config: CleanConfig = CURRENT,
    rules: InsightConfig = INSIGHTS,
) -> Analysis:
    """Clean the table and derive everything shown about it. The caller writes what it needs."""
    cleaned = clean(require_rows(df), order_by, config)
    return Analysis(
        cleaned,
        chart_datasets(cleaned.table, cleaned.report.roles),
        insights(cleaned.table, cleaned.report, rules),
        numeric_stats(cleaned.table),
    )


def run_record(analysis: Analysis, run_id: int, owner: int, filename: str, created_at: datetime) -> DataFrame:
    """The history row of one analysis; findings and charts are a few dozen small rows."""
    found = [r.asDict() for r in analysis.insights.orderBy("chapter", "ord", "place").collect()]
    charts = [{"type": c.type, "column": c.column, "title": c.title} for c in analysis.charts]
    report, table = analysis.cleaned.report, analysis.cleaned.table
    row = (
        run_id, owner, filename, report.rows_before, report.rows_after, json.dumps(table.columns),
        json.dumps(found), json.dumps(charts), json.dumps(report.as_dict()),
        report.quality_before, report.quality_after, created_at,
    )
    return table.sparkSession.createDataFrame([row], RUN_SCHEMA)
