"""The dashboard: period table, four charts, cost by family, latest sessions.

Four jobs over the fact table instead of eighteen scans: periods (one fused
aggregate), charts (one fused aggregate), families, sessions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tokentally.constants import CHARTS, PERIODS, TOP_SESSIONS
from tokentally.operators.periods import period_summary
from tokentally.operators.series import series_scaled, usage_series
from tokentally.operators.sessions import cost_by_family, top_sessions


@dataclass
class Dashboard:
    periods: DataFrame
    series: DataFrame
    families: DataFrame
    sessions: DataFrame


def dashboard(usage: DataFrame, as_of: int, periods=PERIODS, charts=CHARTS, k: int = TOP_SESSIONS) -> Dashboard:
    """All dashboard blocks as DataFrames (nothing is collected here)."""
    return Dashboard(
        periods=period_summary(usage, as_of, periods),
        series=series_scaled(usage_series(usage, as_of, charts)),
        families=cost_by_family(usage),
        sessions=top_sessions(usage, k),
    )
