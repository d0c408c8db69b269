import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cardwright.operators import boosting
from cardwright.operators.binning import fit_binnings
from cardwright.operators.evaluation import calibration, model_summary, ranking_metrics, riskiest, swap_set, swap_verdict
from cardwright.operators.scorecard import ScorecardConfig, fit_scorecard, points_table, reason_codes
from cardwright.plans.fixtures import fixed_card


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(91)
    x = 90 * rng.beta(1.5, 2, 5000)
    y = (rng.random(5000) < 0.08 + 0.55 * (x / 90) ** 1.2).astype(int)
    x2 = x + rng.laplace(0, 15, 5000)
    return spark.createDataFrame(pd.DataFrame({"id": range(5000), "x": x, "x2": x2, "y": y})).cache()


@pytest.fixture(scope="module")
def card(data):
    return fit_scorecard(data, fit_binnings(data, ["x", "x2"], "y"), "y")


def test_scaling():
    c = ScorecardConfig()
    assert c.factor == pytest.approx(20 / math.log(2)) and c.offset == pytest.approx(600 - c.factor * math.log(20))
    assert (round(c.factor, 3), round(c.offset, 3)) == (28.854, 513.561)


def test_fit_is_the_penalised_optimum(data, card):
    pdf = data.select("y", *[card.binnings[f].woe(F.col(f)).alias(f) for f in ("x", "x2")]).toPandas()
    x, y = np.column_stack([np.ones(len(pdf)), pdf[["x", "x2"]]]), pdf["y"].to_numpy()
    beta, ridge = np.zeros(3), np.diag([0.0, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        beta -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - y) + ridge @ beta)
    assert np.allclose([card.intercept, *card.coefficients.values()], beta, atol=1e-4)
    assert all(b < 0 for b in card.coefficients.values())


def test_high_scores_mean_low_risk(data, card):
    pdf = data.select("y", card.score().alias("s"), card.pd().alias("p")).toPandas()
    low, high = pdf["s"].quantile([0.2, 0.8])
    assert pdf[pdf["s"] <= low]["y"].mean() > pdf[pdf["s"] >= high]["y"].mean()
    assert np.corrcoef(pdf["s"], pdf["p"])[0, 1] < -0.9


def test_points_sum_up_to_the_score(spark, data, card):
    table = {(r["feature"], r["bin"]): r["points"] for r in points_table(spark, card).collect()}
    rows = data.limit(50).select(card.score("last").alias("s"), card.binnings["x"].index(F.col("x")).alias("a"), card.binnings["x2"].index(F.col("x2")).alias("b")).collect()
    assert all(abs(table["x", r["a"]] + table["x2", r["b"]] - r["s"]) <= 0.1 for r in rows)


def test_reason_codes(data, card):
    pdf = reason_codes(data, card, "id").toPandas()
    assert (pdf["points_lost"] >= 0).all() and pdf.groupby("id").size().eq(2).all()
    ranked = pdf.sort_values(["id", "rank"])
    assert (ranked.groupby("id")["points_lost"].diff().dropna() <= 0).all()
    assert (abs(pdf["points_available"] - pdf["points_earned"] - pdf["points_lost"]) <= 0.1001).all()


def test_equal_losses_stand_in_the_card_s_order(spark):
    card = fixed_card()
    best = spark.createDataFrame([(1, 10.0, 0, 9000.0)], "id int, dti double, delinq_2y int, income double")
    assert [r["feature"] for r in reason_codes(best, card, "id").collect()] == list(card.coefficients)


def test_intercept_modes_differ_by_a_constant(spark):
    a, b = fixed_card("reference"), fixed_card("calibrated")
    rows = spark.createDataFrame([(10.0, 0, 9000.0), (40.0, 2, -5.0)], "dti double, delinq_2y int, income double")
    gaps = [r[0] for r in rows.select(a.score() - b.score()).collect()]
    assert gaps == pytest.approx([2 * a.config.factor * a.intercept] * 2)


def test_ranking_metrics_equal_pairs(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"s": rng.integers(0, 30, 800) / 7, "y": rng.integers(0, 2, 800)})
    got = ranking_metrics(spark.createDataFrame(pdf), "s", "y").first()
    pos, neg = pdf[pdf.y == 1].s.to_numpy(), pdf[pdf.y == 0].s.to_numpy()
    auc = ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg))
    ks = max(0, max((pos >= t).mean() - (neg >= t).mean() for t in pdf.s.unique()))
    assert (got["auc"], got["gini"], got["ks"]) == (pytest.approx(auc), pytest.approx(2 * auc - 1), pytest.approx(ks))
    one_class = ranking_metrics(spark.createDataFrame([(1.0, 1)], "s double, y int"), "s", "y").first()
    assert one_class["auc"] is None


def test_ties_at_the_cut_are_all_approved_and_equal_models_swap_nobody(spark):
    df = spark.createDataFrame([(i, 0.5 if i >= 3 else 0.1, i % 2) for i in range(10)], "id int, p double, y int").withColumn("q", F.col("p"))
    cells = {r["cell"]: (r["n"], r["bad_rate"]) for r in swap_set(df, "p", "q", "y").collect()}
    assert cells["both"][0] == 10 and cells["swap_in"] == (0, None) and cells["swap_out"] == (0, None)
    assert swap_verdict(swap_set(df, "p", "q", "y")).first()["verdict"] is None


def test_calibration_leaves_empty_bands_out(spark):
    df = spark.createDataFrame([(0.2, 0)] * 8 + [(0.4, 1)] * 2, "p double, y int")
    rows = calibration(df, "p", "y").orderBy("bin").collect()
    assert sum(r["n"] for r in rows) == 10 and len(rows) < 8


def test_summary_and_riskiest(spark):
    df = spark.createDataFrame([(1, 0.9, 1), (2, 0.9, 0), (3, 0.1, 0)], "id int, p double, y int")
    assert [r["id"] for r in riskiest(df, "p", "id").collect()] == [1, 2]
    assert model_summary(df, {"m": "p"}, "y").first()["brier"] == pytest.approx((0.01 + 0.81 + 0.01) / 3)


def test_booster_is_monotone_and_learns(data):
    model = boosting.fit_monotone_booster(data, ["x", "x2"], "y", boosting.BoosterParams(rounds=5, learning_rate=0.3, bins=8, monotone={"x": 1}))
    pdf = data.select("x", "y", model.pd().alias("p"), F.lit(50.0).alias("x2")).select("x", model.pd().alias("fixed"), "p", "y").toPandas().sort_values("x")
    assert (pdf["fixed"].diff().dropna() >= -1e-12).all()
    assert pdf[pdf.y == 1]["p"].mean() > pdf[pdf.y == 0]["p"].mean() + 0.05
