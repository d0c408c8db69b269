import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cardwright.operators import fairness, rejects
from cardwright.sources.applications import add_proxy_features, positional_split, read_applications, synthetic_applications, write_applications


def decided(spark, one, zero):
    rows = [(1, int(i < one[0])) for i in range(one[1])] + [(0, int(i < zero[0])) for i in range(zero[1])]
    return spark.createDataFrame(rows, "g int, ok int")


def test_disparity_is_flagged(spark):
    r = fairness.adverse_impact(decided(spark, (50, 100), (90, 100)), "ok", "g").first()
    assert (r["air"], r["flagged"], r["disadvantaged"]) == (pytest.approx(50 / 90), True, 1)
    r = fairness.adverse_impact(decided(spark, (80, 100), (80, 100)), "ok", "g").first()
    assert (r["air"], r["flagged"], r["disadvantaged"]) == (1.0, False, 0)


@pytest.mark.parametrize("one, zero", [((5, 10), (0, 0)), ((0, 0), (5, 10))])
def test_an_empty_group_has_no_ratio(spark, one, zero):
    r = fairness.adverse_impact(decided(spark, one, zero), "ok", "g").first()
    assert r["air"] is None and r["flagged"] is None


def test_nobody_approved(spark):
    r = fairness.adverse_impact(decided(spark, (0, 10), (0, 10)), "ok", "g").first()
    assert r["air"] is None and r["flagged"] is False


def test_intervals_bracket_the_ratio(spark):
    rng = np.random.default_rng(77)
    g = (rng.random(5000) < 0.35).astype(int)
    ok = (rng.random(5000) < np.where(g == 1, 0.66, 0.79)).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"g": g, "ok": ok}))
    point = fairness.adverse_impact(df, "ok", "g").first()["air"]
    low, high = fairness.adverse_impact_interval(df, "ok", "g")
    closed = fairness.adverse_impact_log_interval(df, "ok", "g").first()
    assert low < point < high and closed["low"] < point < closed["high"]
    assert abs(low - closed["low"]) < 0.02
    assert fairness.adverse_impact_interval(decided(spark, (3, 5), (3, 5)), "ok", "g") is None


def test_a_proxy_gives_the_group_away(spark):
    rng = np.random.default_rng(78)
    g = (rng.random(2500) < 0.4).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"proxy": 2 * g + rng.logistic(0, 0.4, 2500), "noise": rng.uniform(-1, 1, 2500), "g": g}))
    assert fairness.proxy_reconstruction(df, ["proxy", "noise"], "g") > 0.85
    assert fairness.proxy_reconstruction(df, ["noise"], "g") < 0.60


@pytest.mark.parametrize("other, verdict, conclusion", [
    ((0.90, 0.65), "blocked_on_cost", "tolerance"), ((0.801, 0.699), "not_material", "no candidate"), ((0.85, 0.698), "qualifies", "qualifies"),
])
def test_search_for_alternatives(spark, other, verdict, conclusion):
    judged = fairness.lda_search(fairness.candidates_frame(spark, {"champion": (0.80, 0.70), "alt": other}))
    assert judged.first()["verdict"] == verdict
    assert conclusion in fairness.lda_conclusion(judged).first()["conclusion"]


def test_search_needs_a_champion(spark):
    with pytest.raises(ValueError):
        fairness.lda_search(fairness.candidates_frame(spark, {"alt": (0.9, 0.7)}))


def test_parcelling(spark):
    rng = np.random.default_rng(79)
    s = rng.beta(2, 3, 2400)
    funded = spark.createDataFrame(pd.DataFrame({"s": s, "y": (rng.random(2400) < 0.5 * s).astype(int)}))
    turned = spark.createDataFrame(pd.DataFrame({"s": 0.4 + 0.5 * rng.random(600), "y": rng.integers(0, 2, 600)}))
    mean = {k: rejects.parcelling(funded, turned, "s", "y", k).toPandas()["inferred"] for k in (1.0, 3.0)}
    assert mean[3.0].mean() > mean[1.0].mean() and mean[3.0].max() <= 1
    sweep = rejects.multiplier_sweep(funded, turned, "s", "y").toPandas()
    tied = rejects.multiplier_sweep(funded, turned.withColumn("y", F.lit(5)), "s", "y", (3.0, 3.0, 2.0)).toPandas()
    assert list(tied["best"]) == [True, False, False]  # of equal errors the first of the list
    assert sweep["best"].sum() == 1 and sweep.loc[sweep["best"], "signed_error"].abs().iloc[0] == sweep["signed_error"].abs().min()


def test_a_band_without_funded_rows_takes_the_overall_rate_and_rates_are_capped(spark):
    funded = spark.createDataFrame([(0.5, 1)] * 6 + [(0.5, 0)] * 4, "s double, y int")
    turned = spark.createDataFrame([(0.1,), (0.5,)], "s double")
    got = {r["s"]: r["inferred"] for r in rejects.parcelling(funded, turned, "s", "y", 2.0).collect()}
    assert got == {0.1: 0.999, 0.5: 0.999}
    got = {r["s"]: r["inferred"] for r in rejects.parcelling(funded, turned, "s", "y", 1.0).collect()}
    assert got == {0.1: pytest.approx(0.6), 0.5: pytest.approx(0.6)}


def test_fuzzy_copies(spark):
    df = spark.createDataFrame([(1, 0.2), (2, 0.5), (3, 0.9)], "a int, p double")
    pdf = rejects.fuzzy_augmentation(df, "p").toPandas()
    assert len(pdf) == 6 and pdf["w"].sum() == pytest.approx(3) and pdf["y"].sum() == 3


def test_counterfactual(spark):
    df = spark.createDataFrame([(0.6, int(i < 30)) for i in range(100)], "p double, y int")
    r = rejects.counterfactual(df, "p", "y").first()
    assert r["absolute_error"] == pytest.approx(0.3) and r["direction"] == "over-estimates"
    assert rejects.counterfactual(df.withColumn("y", df["y"] * 0), "p", "y").first()["relative_error"] is None


def test_weights_and_labels(spark):
    df = spark.createDataFrame([(i, i / 100, int(i < 50)) for i in range(100)], "id int, s double, f int")
    pdf = rejects.augmentation_weights(df, "s", "f").toPandas()
    assert pdf["n_all"].sum() == 100 and (pdf.loc[pdf["n_funded"] == 0, "weight"] == 1).all()
    labels = rejects.hard_labels(df, "s", "id").toPandas()
    again = rejects.hard_labels(df.repartition(7), "s", "id").toPandas().sort_values("id")
    assert (labels.sort_values("id")["label"].to_numpy() == again["label"].to_numpy()).all() and 30 < labels["label"].sum() < 70


def test_rows_get_their_band_s_weight(spark):
    df = spark.createDataFrame([(i, i / 40, int(i < 20)) for i in range(40)], "id int, s double, f int")
    weights = spark.createDataFrame([(0, 2.5), (1, 0.5)], "band int, weight double")
    got = {r["id"]: r["weight"] for r in rejects.with_weights(df, weights, "s", [0.25, 0.75]).collect()}
    assert got == {i: 2.5 if i < 10 else 0.5 if i < 30 else 1.0 for i in range(40)}


def test_noise_hangs_on_the_key(spark):
    apps = synthetic_applications(spark, 3_000, block=1_000)
    one, two = (add_proxy_features(a).selectExpr("sum(region_risk_proxy_a)", "stddev(region_risk_proxy_a - 100 * region_risk)").first() for a in (apps, apps.repartition(7)))
    assert one == pytest.approx(two) and one[1] == pytest.approx(6, rel=0.06)


def test_a_far_off_key_does_not_crowd_the_ranges(spark):
    keys = [*range(500), 10**15]
    pdf = positional_split(spark.createDataFrame([(k,) for k in keys], "id long"), "id").toPandas().sort_values("id")
    assert list(pdf["pos"]) == list(range(1, 502)) and pdf["is_train"].sum() == 350
    assert positional_split(spark.createDataFrame([], "id long"), "id").count() == 0


def test_split_is_positional(spark):
    df = spark.createDataFrame([(i * i,) for i in range(101)], "id long").repartition(5)
    pdf = positional_split(df, "id").toPandas().sort_values("id")
    assert list(pdf["pos"]) == list(range(1, 102)) and pdf["is_train"].sum() == 70


def test_synthetic_population(spark, tmp_path):
    apps = synthetic_applications(spark, 25_000)
    again = apps.repartition(3)
    stats = apps.selectExpr("count(*) n", "avg(defaulted) d", "avg(approved_by_incumbent) a", "min(income) lo", "max(dti) hi").first()
    assert stats["n"] == 25_000 and 0.3 < stats["d"] < 0.5 and 0.3 < stats["a"] < 0.6 and stats["lo"] >= 12_000 and stats["hi"] <= 75
    assert again.selectExpr("sum(hash(*))").first() == apps.selectExpr("sum(hash(*))").first()
    write_applications(apps, str(tmp_path / "a"))
    back = read_applications(spark, str(tmp_path / "a"))
    assert back.count() == 25_000 and add_proxy_features(back).stat.corr("region_risk", "region_risk_proxy_a") > 0.8
