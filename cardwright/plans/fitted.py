"""The whole scorecard run on fitted models: card and booster are fitted once,
the test rows are scored once and written, and every section reads those."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import binning, boosting, evaluation, fairness, scorecard
from ..sources.applications import FEATURES, GROUP, TARGET, app_view
from ..sources.work import release, written
from . import credit

MODELS = {"card": "pd_card", "gbm": "pd_gbm"}
SHARE = 0.80


@dataclass
class Run:
    """Fitted models, and the test rows with pd_card, pd_gbm, score and the decision of each model."""

    card: scorecard.Scorecard
    booster: boosting.Booster
    test: DataFrame


def fit_run(train: DataFrame, test: DataFrame, features: list[str] = FEATURES, params: boosting.BoosterParams | None = None) -> Run:
    """Bins, card and monotone booster of ``train``, and both scores of ``test``."""
    card = scorecard.fit_scorecard(train, binning.fit_binnings(train, features, TARGET), TARGET)
    booster = boosting.fit_monotone_booster(train, features, TARGET, params or credit.monotone_params())
    scored = written(test.withColumns({
        "pd_card": F.round(card.pd(), 9), "pd_gbm": F.round(booster.batch_pd(features), 9), "score": card.score(),
    }), "fitted")
    cuts = {m: evaluation.approval_threshold(scored, c, SHARE) for m, c in MODELS.items()}
    out = scored.withColumns({f"ok_{m}": (F.col(MODELS[m]) <= F.lit(cut)).cast("int") for m, cut in cuts.items()})
    out._work_path = scored._work_path
    return Run(card, booster, out)


def fitted_run(spark: SparkSession, sf_dir: str) -> Run:
    return fit_run(*credit._split(spark, sf_dir))


def impact_of_models(run: Run) -> DataFrame:
    """(model, rate_1, rate_0, air, flagged, disadvantaged, low, high): adverse impact of each model's own decisions, with its bootstrap interval."""
    spark, out = run.test.sparkSession, None
    for m in MODELS:
        low, high = fairness.adverse_impact_interval(run.test, f"ok_{m}", GROUP) or (None, None)
        one = fairness.adverse_impact(run.test, f"ok_{m}", GROUP).select(F.lit(m).alias("model"), "*", F.lit(low).cast("double").alias("low"), F.lit(high).cast("double").alias("high"))
        out = one if out is None else out.unionByName(one)
    return out


def sections(run: Run) -> dict[str, DataFrame]:
    """Every section of the report, of the fitted models alone; each is a small frame, worked out when it is read."""
    test, spark = run.test, run.test.sparkSession
    swap = evaluation.swap_set(test, "pd_card", "pd_gbm", TARGET, SHARE)
    declined = evaluation.riskiest(test, "pd_card", "app_id")
    reasons = scorecard.reason_codes(declined, run.card, "app_id")
    delta = evaluation.swap_delta_interval(swap)
    return {
        "Information value": binning.iv_table(spark, run.card.binnings),
        "Points": scorecard.points_table(spark, run.card),
        "Score range": test.agg(F.min("score").alias("least"), F.max("score").alias("greatest"), F.avg("score").alias("mean")),
        "Models": evaluation.model_summary(test, MODELS, TARGET).orderBy("model"),
        "Intervals": evaluation.auc_intervals(test, MODELS, TARGET).orderBy("model"),
        "Difference of the areas": evaluation.auc_difference(test, "pd_gbm", "pd_card", TARGET),
        "Calibration": evaluation.calibrations(test, MODELS, TARGET).orderBy("model", "bin"),
        "Swap set": evaluation.swap_intervals(swap).orderBy("cell"),
        "Verdict": evaluation.swap_verdict(swap).select("*", F.lit(delta[0] if delta else None).cast("double").alias("low"), F.lit(delta[1] if delta else None).cast("double").alias("high")),
        "Adverse impact": impact_of_models(run),
        "Declined first": declined.select("app_id", "pd_card", F.round("score", 0).alias("score")),
        "Their reasons": reasons.orderBy("app_id", "rank"),
    }


def champion_challenger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(section, item, measure, value) of one run: metrics, intervals, calibration, swap set and adverse impact of the fitted card and booster."""
    run = fitted_run(spark, sf_dir)
    keys = {"Models": ["model"], "Intervals": ["model"], "Difference of the areas": [], "Calibration": ["model", "bin"], "Swap set": ["cell"], "Verdict": [], "Adverse impact": ["model"], "Score range": []}
    rows, found = [], sections(run)
    for name, key in keys.items():
        measures = [c for c, kind in found[name].dtypes if kind != "string" and c not in key]
        for r in found[name].collect():
            item = " ".join(str(r[k]) for k in key)
            rows += [(name, item, c, None if r[c] is None else round(float(r[c]), 4)) for c in measures]
    release(run.test)
    return spark.createDataFrame(rows, "section string, item string, measure string, value double")


def fitted_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two reasons that cost most points, by a card fitted on the funded applications, for every application."""
    apps = app_view(spark, sf_dir)
    train = credit.funded(apps)
    card = scorecard.fit_scorecard(train, binning.fit_binnings(train, FEATURES, TARGET), TARGET)
    return scorecard.reason_codes(apps, card, "app_id", top_k=2)


QUERIES = (champion_challenger, fitted_reasons)
