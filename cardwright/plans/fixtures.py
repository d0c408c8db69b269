"""What queries and their oracles share: the applications view with two fixed
scores, and a fixed card. Scores are rounded before any quantile or threshold."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from ..operators.binning import Bin, Binning
from ..operators.scorecard import Scorecard
from ..sources.applications import APP_VIEW_SQL, app_view

#: The same text is valid in Spark SQL and in DuckDB.
PD_A = "round(1 / (1 + exp(-(-16e-1 + 4e-2 * dti + 55e-2 * delinq_2y + 4e-1 * region_risk - 12e-5 * income))), 9)"
PD_B = "round(1 / (1 + exp(-(-13e-1 + 35e-3 * dti + 6e-1 * delinq_2y + 5e-2 * inquiries_6m - 1e-4 * income))), 9)"

APP_CTE = f"app AS ({APP_VIEW_SQL})"
SCORED_CTE = f"{APP_CTE}, scored AS (SELECT a.*, {PD_A} AS pd_a, {PD_B} AS pd_b FROM app a)"

#: Inner edges and weights of evidence of the fixed card, its coefficients and intercept.
CARD_BINS = {
    "dti": ([15.0, 25.0, 35.0], [0.62, 0.21, -0.14, -0.55]),
    "delinq_2y": ([0.0, 1.0], [0.33, -0.12, -0.6]),
    "income": ([0.0, 4000.0], [-0.7, 0.05, 0.48]),
}
CARD_BETAS = {"dti": -0.9, "delinq_2y": -0.75, "income": -1.1}
CARD_INTERCEPT = -0.93

def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return app_view(spark, sf_dir).selectExpr("*", f"{PD_A} AS pd_a", f"{PD_B} AS pd_b")


def fixed_card(intercept_mode: str = "reference") -> Scorecard:
    binnings = {}
    for f, (inner, woes) in CARD_BINS.items():
        ends = [-math.inf, *inner, math.inf]
        bins = tuple(Bin(f"({a:.4g}, {b:.4g}]", a, b, 0, 0, 0.0, w, 0.0) for a, b, w in zip(ends, ends[1:], woes))
        binnings[f] = Binning(f, bins, 0.0, True)
    return Scorecard(binnings, CARD_INTERCEPT, CARD_BETAS, intercept_mode=intercept_mode)
