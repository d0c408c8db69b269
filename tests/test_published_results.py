"""The 60,000-application population of seed 21 gives the published results."""

import pytest
from pyspark.sql import functions as F

from cardwright.operators import evaluation, fairness, rejects
from cardwright.operators.binning import fit_binnings
from cardwright.operators.scorecard import fit_scorecard, points_table
from cardwright.sources.applications import APPROVED, GROUP, TARGET, add_proxy_features, funded, positional_split, synthetic_applications

FEATURES = ["income", "dti", "utilization", "delinq_2y", "inquiries_6m", "credit_age_months", "employment_years"]


@pytest.fixture(scope="module")
def population(spark):
    return synthetic_applications(spark, 60_000, seed=21, block=60_000).cache()


@pytest.fixture(scope="module")
def scored(spark, population):
    split = positional_split(funded(population), "app_id").cache()
    train = split.filter("is_train")
    card = fit_scorecard(train, fit_binnings(train, FEATURES, TARGET), TARGET)
    return card, split.filter("NOT is_train").withColumn("pd", F.round(card.pd(), 9)).cache()


def test_population(population):
    rates = population.agg(F.avg(F.when(F.col(APPROVED) == 1, F.col(TARGET))).alias("funded"), F.avg(TARGET).alias("all")).first()
    assert (round(rates["funded"], 3), round(rates["all"], 3)) == (0.283, 0.410)


def test_scorecard(spark, scored):
    card, test = scored
    m = evaluation.model_summary(test, {"card": "pd"}, TARGET).first()
    assert (m["auc"], m["gini"], m["ks"], m["brier"]) == pytest.approx((0.6544, 0.3088, 0.2345, 0.19158), abs=2e-4)
    points = {(r["feature"], r["label"]): r["points"] for r in points_table(spark, card).collect()}
    assert points["utilization", "(62.11, inf]"] == pytest.approx(53.1, abs=0.11)


def test_groups(scored):
    _, test = scored
    sizes = {r[GROUP]: r["count"] for r in test.groupBy(GROUP).count().collect()}
    assert sizes == {1: 2805, 0: 4855}
    cut = evaluation.approval_threshold(test, "pd")
    air = fairness.adverse_impact(test.withColumn("ok", (F.col("pd") <= cut).cast("int")), "ok", GROUP).first()["air"]
    assert air == pytest.approx(0.9923, abs=2e-3)


def test_nine_features(spark, population):
    """Section by section of the published fairness results: the card with the two proxies, and without."""
    names = [*FEATURES, "region_risk_proxy_a", "region_risk_proxy_b"]
    split = positional_split(funded(add_proxy_features(population, stream_rows=60_000)), "app_id").cache()
    train, test = split.filter("is_train"), split.filter("NOT is_train")
    seen = {}

    def fit_predict(train, test, names):
        card = fit_scorecard(train, fit_binnings(train, names, TARGET), TARGET)
        return seen.setdefault(len(names), test.withColumn("pd", F.round(card.pd(), 9)).select(TARGET, GROUP, "pd").cache())

    out = fairness.proxy_ablation(train, test, names, names[-2:], fit_predict, GROUP)
    assert (out["air_full"], out["air_ablated"]) == pytest.approx((0.9646, 0.9923), abs=2e-3)
    assert (out["reconstruction_full"], out["reconstruction_ablated"]) == pytest.approx((0.5888, 0.5167), abs=1e-3)
    assert out["signal_retained"] == pytest.approx(0.19, abs=0.01)
    full = seen[9]
    d = {r["group_value"]: r for r in fairness.score_distribution(full, "pd", GROUP).collect()}
    assert (d[1]["mean"], d[0]["mean"]) == pytest.approx((0.2891, 0.2767), abs=3e-4)
    assert (d[1]["median"], d[0]["median"], d[1]["p10"], d[0]["p10"]) == pytest.approx((0.2715, 0.2592, 0.1365, 0.1297), abs=1e-3)
    assert d[1]["separation_auc"] == pytest.approx(0.4761, abs=1e-3)
    auc = {k: evaluation.ranking_metrics(s, "pd", TARGET).first()["auc"] for k, s in seen.items()}
    assert (auc[9], auc[7]) == pytest.approx((0.6649, 0.6544), abs=3e-4)
    ok = full.withColumn("ok", (F.col("pd") <= evaluation.approval_threshold(full, "pd")).cast("int"))
    rates = fairness.adverse_impact(ok, "ok", GROUP).first()
    assert (rates["rate_1"], rates["rate_0"]) == pytest.approx((0.7818, 0.8105), abs=2e-3)
    assert fairness.adverse_impact_interval(ok, "ok", GROUP) == pytest.approx((0.9393, 0.9899), abs=5e-3)
    judged = {r["name"]: r["verdict"] for r in fairness.lda_search(fairness.candidates_frame(spark, {
        "champion": (out["air_full"], auc[9]), "without proxies": (out["air_ablated"], auc[7]),
    })).collect()}
    assert judged == {"without proxies": "blocked_on_cost"}


def test_rejects_are_riskier_than_the_funded_model_says(population, scored):
    card, _ = scored
    both = population.withColumn("pd", F.round(card.pd(), 9))
    r = rejects.counterfactual(rejects.parcelling(funded(both), both.filter(F.col(APPROVED) == 0), "pd", TARGET, 1.0), "inferred", TARGET).first()
    assert r["direction"] == "under-estimates"
