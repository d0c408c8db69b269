"""Markdown reports over the result frames. Every table in them is small: bins,
models, cells, groups; rows of applications are never collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import binning, evaluation, fairness, rejects
from ..sources.applications import APPROVED, GROUP, TARGET
from ..sources.work import release, written
from . import credit, fitted


def table(df: DataFrame, digits: int = 4) -> str:
    """A small frame as a Markdown table, in its own order."""
    def cell(v) -> str:
        return "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)

    rows = [df.columns, ["-"] * len(df.columns), *[[cell(v) for v in r] for r in df.collect()]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def _report(title: str, parts: list[tuple[str, DataFrame]]) -> str:
    return "\n\n".join([f"# {title}", *[f"## {name}\n\n{table(df)}" for name, df in parts]]) + "\n"


def scorecard_report(spark: SparkSession, sf_dir: str) -> str:
    """Of a card and a booster that are fitted on the table, once for all sections."""
    run = fitted.fitted_run(spark, sf_dir)
    text = _report("Scorecard", [
        ("Population", credit.population_summary(spark, sf_dir)),
        ("Bins", binning.bin_table(spark, run.card.binnings).orderBy("feature", "bin")),
        *fitted.sections(run).items(),
    ])
    release(run.test)
    return text


def fairness_report(spark: SparkSession, sf_dir: str) -> str:
    """Of the champion among the fitted candidates, the card with the proxies."""
    judged, ablation, champion = credit.alternatives(spark, sf_dir)
    cut = evaluation.approval_threshold(champion, "pd")
    decided = champion.withColumn("approved", (F.col("pd") <= F.lit(cut)).cast("int"))
    interval = fairness.adverse_impact_interval(decided, "approved", GROUP) or (None, None)
    text = _report("Fair lending", [
        ("Adverse impact", fairness.adverse_impact(decided, "approved", GROUP)),
        ("Interval (closed form)", fairness.adverse_impact_log_interval(decided, "approved", GROUP)),
        ("Interval (bootstrap)", spark.createDataFrame([interval], "low double, high double")),
        ("Score distribution", fairness.score_distribution(champion, "pd", GROUP)),
        ("Reconstruction of the group, and ablation of the proxies", ablation),
        ("Less discriminatory alternatives", judged),
        ("Conclusion", fairness.lda_conclusion(judged)),
    ])
    release(champion)
    return text


def rejects_report(spark: SparkSession, sf_dir: str) -> str:
    """Of a card that is fitted on the funded applications and scores all."""
    apps = written(credit.funded_card_scores(spark, sf_dir), "all-scored")
    known, others = credit.funded(apps), credit.rejected(apps)
    by_outcome = apps.groupBy(APPROVED).agg(F.count(F.lit(1)).alias("n"), F.avg("pd").alias("predicted"), F.avg(TARGET).alias("actual"))
    text = _report("Reject inference", [
        ("Funded model on all", by_outcome.orderBy(APPROVED)),
        ("Parcelling by multiplier", rejects.multiplier_sweep(known, others, "pd", TARGET).orderBy("multiplier")),
        ("Against the truth", rejects.counterfactual(rejects.parcelling(known, others, "pd", TARGET), "inferred", TARGET)),
        ("Augmentation weights", rejects.augmentation_weights(apps, "pd", APPROVED).orderBy("band")),
        ("Refit with inferred rejects", credit.refit_with_rejects(apps)),
    ])
    release(apps)
    return text


def write_report(text: str, spark: SparkSession, path: str) -> None:
    """One Markdown file in a folder of any store that Spark writes to."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path, lineSep="\n")
