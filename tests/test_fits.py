"""Newton's steps, best-first trees, the run on fitted models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardwright.operators import boosting, evaluation, fairness
from cardwright.operators.boosting import BoosterParams, _Growth, _walk
from cardwright.operators.scorecard import fit_logistic, newton_sums
from cardwright.plans import credit, fitted
from cardwright.plans.reports import scorecard_report
from cardwright.sources.applications import APPROVED, GROUP, TARGET, add_proxy_features, funded, positional_split, synthetic_applications
from tests.test_queries import SF, optimum

SEVEN = ["income", "dti", "utilization", "delinq_2y", "inquiries_6m", "credit_age_months", "employment_years"]


# --- Newton ---------------------------------------------------------------

def data(spark, seed=1, n=4000):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 3, 0.2]
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.4 + x @ [1.0, -0.5, 2.0])))).astype(int)
    rows = [(*map(float, r), int(t)) for r, t in zip(x, y)]
    return x, y, spark.createDataFrame(rows, "a double, b double, c double, y int")


@pytest.mark.parametrize("grouped", [True, False])
def test_newton_reaches_the_optimum(spark, grouped):
    x, y, df = data(spark)
    b0, betas = fit_logistic(df, ["a", "b", "c"], "y", grouped=grouped)
    want0, want = optimum(x, y)
    assert b0 == pytest.approx(want0, abs=1e-8) and betas == pytest.approx(want.tolist(), abs=1e-8)


def test_a_step_is_one_aggregate_to_one_row(spark):
    _, _, df = data(spark, n=50)
    rows = df.selectExpr("a AS x0", "b AS x1", "CAST(y AS DOUBLE) AS y", "1D AS w")
    plan = newton_sums(rows, ["x0", "x1"], np.zeros(3))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SinglePartition" in plan and "Python" not in plan


def test_weights_and_odd_tables(spark):
    x, y, df = data(spark, n=300)
    twice = fit_logistic(df.withColumn("w", F.lit(2.0)), ["a"], "y", "w")
    again = fit_logistic(df.unionByName(df), ["a"], "y")
    assert twice[0] == pytest.approx(again[0]) and twice[1] == pytest.approx(again[1])
    assert fit_logistic(df.limit(0), ["a", "b"], "y") == (0.0, [0.0, 0.0])
    # Separable rows: the ridge keeps the fit finite.
    clean = spark.createDataFrame([(float(i), int(i > 5)) for i in range(12)], "a double, y int")
    b0, [b] = fit_logistic(clean, ["a"], "y", grouped=False)
    want0, want = optimum(np.arange(12.0)[:, None], np.array([int(i > 5) for i in range(12)]))
    assert (b0, b) == pytest.approx((want0, want[0]), rel=1e-6)


# --- trees ----------------------------------------------------------------

def grown_one_leaf_at_a_time(bins, g, h, size, params, way):
    """Best-first growth that sums up every leaf from its rows, one split a step: [(rows, value)]."""
    def leaf_value(rows, low, high):
        return min(max(-g[rows].sum() / (h[rows].sum() + params.l2 + 1e-12), low), high)

    def best(rows, low, high):
        found = (1e-9, None)
        whole = g[rows].sum() * leaf_value(rows, low, high)
        for f in range(len(bins)):
            for b in range(size - 1):
                a, c = rows[bins[f][rows] <= b], rows[bins[f][rows] > b]
                if min(len(a), len(c)) < params.min_rows:
                    continue
                va, vc = leaf_value(a, low, high), leaf_value(c, low, high)
                if (vc - va) * way[f] < 0:
                    continue
                gain = whole - g[a].sum() * va - g[c].sum() * vc
                if gain > found[0] + 1e-12:
                    found = (gain, (f, b, a, c, (va + vc) / 2))
        return found

    leaves = [(*best(rows := np.arange(bins.shape[1]), -np.inf, np.inf), rows, -np.inf, np.inf)]
    while len(leaves) < params.leaves and any(x[1] for x in leaves):
        at = max((x for x in range(len(leaves)) if leaves[x][1]), key=lambda x: leaves[x][0])
        _, (f, _, a, c, middle), _, low, high = leaves.pop(at)
        for rows, is_left in ((a, True), (c, False)):
            lo, hi = low, high
            if way[f]:
                if (way[f] > 0) == is_left:
                    hi = min(high, middle)
                else:
                    lo = max(low, middle)
            leaves.append((*best(rows, lo, hi), rows, lo, hi))
    return {tuple(x[2].tolist()): params.learning_rate * leaf_value(x[2], x[3], x[4]) for x in leaves}


@pytest.mark.parametrize("leaves, monotone", [(2, {}), (6, {}), (15, {"a": 1}), (9, {"a": -1, "b": 1})])
def test_trees_grow_best_leaf_first(leaves, monotone):
    rng = np.random.default_rng(leaves)
    bins = rng.integers(0, 8, (3, 900))
    g, h = rng.normal(size=900) - 0.2 * bins[0] + 0.1 * bins[1] * (bins[2] > 3), rng.uniform(0.1, 0.25, 900)
    params, jobs = BoosterParams(leaves=leaves, min_rows=20, monotone=monotone), []

    def sums(rows):
        return np.stack([[np.bincount(b[rows], w, 8) for b in bins] for w in (g[rows], h[rows], np.ones(len(rows)))])

    def gather(tree, active):
        jobs.append(len(active))
        at = _walk(tree, bins)
        return np.stack([sums(np.flatnonzero(at == k)) for k in active])

    growth = _Growth(["a", "b", "c"], [np.arange(7.0)] * 3, params, gather)
    tree = growth.tree(growth.root(sums(np.arange(900))))
    at = _walk(tree, bins)
    got = {tuple(np.flatnonzero(at == k).tolist()): tree[3][k] for k in np.unique(at)}
    want = grown_one_leaf_at_a_time(bins, g, h, 8, params, [monotone.get(f, 0) for f in "abc"])
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    assert len(got) <= leaves and len(jobs) <= max(0, len(got) - 2)


def test_a_constrained_feature_never_lowers_the_score(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b), int(rng.random() < 0.2 + 0.3 * (a > 0.5) + 0.2 * np.sin(6 * a) * (b > 0.5))) for a, b in rng.random((4000, 2))]
    model = boosting.fit_monotone_booster(spark.createDataFrame(rows, "a double, b double, y int"), ["a", "b"], "y", BoosterParams(rounds=12, monotone={"a": 1}, min_rows=30))
    grid = spark.range(101).crossJoin(spark.createDataFrame([(0.2,), (0.8,)], "b double")).select((F.col("id") / 100).alias("a"), "b")
    for b in (0.2, 0.8):
        scores = [r[0] for r in grid.filter(F.col("b") == b).orderBy("a").select(model.batch_pd(["a", "b"])).collect()]
        assert all(x <= y + 1e-12 for x, y in zip(scores, scores[1:])) and scores[-1] > scores[0]


# --- published figures ----------------------------------------------------

@pytest.fixture(scope="module")
def split(spark):
    apps = add_proxy_features(synthetic_applications(spark, 60_000, seed=21, block=60_000), stream_rows=60_000)
    return positional_split(funded(apps), "app_id")


def test_the_run_gives_the_published_comparison(spark, split):
    """Booster, swap set and the booster's adverse impact on the population of seed 21."""
    ways = {"dti": 1, "utilization": 1, "delinq_2y": 1, "inquiries_6m": 1, "credit_age_months": -1, "employment_years": -1, "income": -1}
    params = BoosterParams(rounds=300, bins=255, monotone=ways, patience=10)
    run = fitted.fit_run(split.filter("is_train"), split.filter("NOT is_train"), SEVEN, params)
    found = fitted.sections(run)
    m = {r["model"]: r for r in found["Models"].collect()}
    assert m["gbm"]["auc"] == pytest.approx(0.6588, abs=3e-3) and m["gbm"]["brier"] == pytest.approx(0.19062, abs=3e-3)
    assert (m["card"]["auc"], m["card"]["ks"]) == pytest.approx((0.6544, 0.2345), abs=3e-4)
    cells = {r["cell"]: r for r in found["Swap set"].collect()}
    assert cells["swap_in"]["n"] == cells["swap_out"]["n"] and cells["both"]["n"] + cells["swap_in"]["n"] == pytest.approx(0.8 * 7660, abs=2)
    assert cells["swap_in"]["n"] == pytest.approx(331, abs=80) and cells["both"]["bad_rate"] == pytest.approx(0.2349, abs=4e-3)
    assert cells["swap_in"]["bad_rate"] == pytest.approx(0.3535, abs=0.05) and cells["swap_out"]["bad_rate"] == pytest.approx(0.3384, abs=0.05)
    impact = {r["model"]: r for r in found["Adverse impact"].collect()}
    assert impact["card"]["air"] == pytest.approx(0.9923, abs=2e-3) and 0.94 < impact["gbm"]["air"] <= 1
    d = found["Difference of the areas"].first()
    assert d["low"] < 0.0044 < d["high"]


def test_the_unconstrained_candidate(spark, split):
    names = [*SEVEN, "region_risk_proxy_a", "region_risk_proxy_b"]
    scores = boosting.fit_gbt_candidate(split.filter("is_train"), split.filter("NOT is_train"), names, TARGET).select(TARGET, GROUP, F.round("pd", 9).alias("pd"))
    air, auc = credit._air_and_auc(scores.cache())
    assert auc == pytest.approx(0.6636, abs=5e-3) and air == pytest.approx(0.9673, abs=0.02)


# --- the run and the reports ----------------------------------------------

def test_every_section_follows_the_outcomes(spark, monkeypatch):
    """With other outcomes every section of the report changes."""
    monkeypatch.setattr(credit, "MONOTONE_ROUNDS", 6)
    before = scorecard_report(spark, SF)
    view = credit.app_view
    turned = lambda s, d: view(s, d).withColumn(TARGET, F.when(F.col("dti") * 7 % 3 < 1, 1 - F.col(TARGET)).otherwise(F.col(TARGET)))
    monkeypatch.setattr(credit, "app_view", turned)
    after = scorecard_report(spark, SF)
    parts = lambda text: {p.split("\n")[0]: p for p in text.split("## ")[1:]}
    one, two = parts(before), parts(after)
    assert one.keys() == two.keys() and len(one) == 14
    assert [name for name in one if one[name] == two[name]] == []


def test_rejects_are_parcelled_by_the_funded_card(spark, monkeypatch):
    seen = []
    real = credit.rejects.parcelling
    monkeypatch.setattr(credit.rejects, "parcelling", lambda a, b, score, target, *x: seen.append(score) or real(a, b, score, target, *x))
    r = credit.parcelled_refit(spark, SF).first()
    assert seen == ["pd"] and r["delta"] == pytest.approx(r["auc_with_rejects"] - r["auc_funded_only"], abs=1e-4)
    apps = credit.funded_card_scores(spark, SF)
    assert r["auc_funded_only"] == pytest.approx(evaluation.ranking_metrics(apps, "pd", TARGET).first()["auc"], abs=1e-4)


def test_champion_and_challenger_of_the_table(spark, monkeypatch):
    monkeypatch.setattr(credit, "MONOTONE_ROUNDS", 6)
    rows = {(r["section"], r["item"], r["measure"]): r["value"] for r in fitted.champion_challenger(spark, SF).collect()}
    assert {s for s, _, _ in rows} == {"Models", "Intervals", "Difference of the areas", "Calibration", "Swap set", "Verdict", "Adverse impact", "Score range"}
    assert rows["Intervals", "card", "low"] < rows["Models", "card", "auc"] < rows["Intervals", "card", "high"]
    assert rows["Swap set", "both", "n"] > 0 and APPROVED and fairness.FOUR_FIFTHS == 0.8
