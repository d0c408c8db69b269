"""The credit-risk queries: each applies an operator to the whole stand-in table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import binning, boosting, evaluation, fairness, rejects, scorecard
from ..operators.quantiles import kept
from ..sources.applications import (
    APPROVED, FEATURES, GROUP, TARGET, add_proxy_features, app_view, as_features, funded, positional_split, rejected, synthetic_applications,
)
from ..sources.work import release, written
from .fixtures import fixed_card, scored

CARD_FEATURES = FEATURES
#: Of the search for less discriminatory models: as in the original, region_risk shows through its proxies only.
PROXIES = ["proxy_a", "proxy_b"]
LDA_FEATURES = [*[f for f in FEATURES if f != "region_risk"], *PROXIES]
#: Rounds of the boosters, without and with monotone constraints.
GBM_ROUNDS, MONOTONE_ROUNDS = 250, 300


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def population_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    apps = app_view(spark, sf_dir)
    name = F.when(F.grouping(APPROVED) == 1, "all").when(F.col(APPROVED) == 1, "funded").otherwise("rejected")
    return _rounded(apps.groupingSets([[APPROVED], []], APPROVED).agg(
        name.alias("population"), F.count(F.lit(1)).alias("n"), F.avg(TARGET).alias("default_rate"), F.avg(APPROVED).alias("funded_share"),
    ).drop(APPROVED))


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_features(funded(app_view(spark, sf_dir)), FEATURES, "app_id", TARGET)


def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional_split(funded(app_view(spark, sf_dir)), "app_id").select("app_id", "pos", "is_train")


def woe_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = binning.quantile_edges(funded(app_view(spark, sf_dir)), FEATURES)
    rows = [(f, i, float(e)) for f, es in edges.items() for i, e in enumerate(es or [])]
    return _rounded(spark.createDataFrame(rows, "feature string, position int, edge double"))


def _bins(spark: SparkSession, sf_dir: str, **options) -> dict:
    return binning.fit_binnings(funded(app_view(spark, sf_dir)), FEATURES, TARGET, **options)


def _table(spark: SparkSession, bins: dict) -> DataFrame:
    return _rounded(binning.bin_table(spark, bins).drop("label"))


def woe_unmerged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, _bins(spark, sf_dir, merge=False))


def woe_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, _bins(spark, sf_dir))


def woe_merged_thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, _bins(spark, sf_dir, min_share=0.10))


def woe_bin_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(binning.bin_table(spark, _bins(spark, sf_dir, merge_policy="adjacent"), digits=4))


def iv_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.iv_table(spark, _bins(spark, sf_dir)).select("feature", "iv", "n_bins", "monotonic", "band")


def woe_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = fixed_card()
    return binning.transform(app_view(spark, sf_dir), card.binnings).select("app_id", *[f"{f}_woe" for f in card.binnings])


def bin_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = fixed_card()
    return app_view(spark, sf_dir).select("app_id", *[b.index(F.col(f).cast("double")).alias(f"{f}_bin") for f, b in card.binnings.items()])


def card_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scaling, and the points that stand for the odds of the funded applications."""
    c = scorecard.ScorecardConfig()
    odds = F.sum(1 - F.col(TARGET)) / F.sum(TARGET)
    return _rounded(funded(app_view(spark, sf_dir)).agg(
        F.lit(c.factor).alias("factor"), F.lit(c.offset).alias("offset"), odds.alias("odds"), (F.lit(c.offset) + F.lit(c.factor) * F.ln(odds)).alias("score_at_odds"),
    ))


def card_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = fixed_card()
    return _rounded(app_view(spark, sf_dir).select(
        "app_id", card.pd().alias("pd"), card.score().alias("score"), fixed_card("calibrated").score("last").alias("score_calibrated"),
    ))


def points_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the fixed card's bins, with the funded applications in each."""
    card = fixed_card()
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), b.index(F.col(f).cast("double")).alias("bin")) for f, b in card.binnings.items()])
    counts = funded(app_view(spark, sf_dir)).select(TARGET, F.explode(cells).alias("c")).groupBy("c.feature", "c.bin").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(TARGET), 4).alias("bad_rate")
    )
    points = scorecard.points_table(spark, card).select("feature", "bin", "woe", "points")
    return F.broadcast(points).join(counts, ["feature", "bin"], "left").select("feature", "bin", "woe", "points", F.coalesce("n", F.lit(0)).alias("n"), "bad_rate")


def reason_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorecard.reason_codes(app_view(spark, sf_dir), fixed_card(), "app_id", top_k=2)


def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.model_summary(funded(scored(spark, sf_dir)), {"card": "pd_a", "challenger": "pd_b"}, TARGET))


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.calibrations(funded(scored(spark, sf_dir)), {"card": "pd_a", "challenger": "pd_b"}, TARGET))


def approval_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    apps = funded(scored(spark, sf_dir)).select("pd_a")
    cut = evaluation.approval_threshold(apps, "pd_a")
    return _rounded(apps.agg(F.lit(cut).alias("threshold"), F.count(F.when(F.col("pd_a") <= cut, 1)).alias("n_approved"), F.count(F.lit(1)).alias("n")), 9)


def swap_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.swap_set(funded(scored(spark, sf_dir)), "pd_a", "pd_b", TARGET))


def swap_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.swap_verdict(evaluation.swap_set(funded(scored(spark, sf_dir)), "pd_a", "pd_b", TARGET)))


def decline_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.riskiest(funded(scored(spark, sf_dir)), "pd_a", "app_id").select("app_id", "pd_a")


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    apps = funded(scored(spark, sf_dir))
    return apps.withColumn("approved", (F.col("pd_a") <= evaluation.approval_threshold(apps, "pd_a")).cast("int"))


def adverse_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fairness.adverse_impact(_decided(spark, sf_dir), "approved", GROUP))


def adverse_impact_log_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fairness.adverse_impact_log_interval(_decided(spark, sf_dir), "approved", GROUP))


def adverse_impact_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = fairness.adverse_impact_interval(_decided(spark, sf_dir), "approved", GROUP)
    return spark.createDataFrame([(low, high)], "low double, high double")


def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fairness.score_distribution(funded(scored(spark, sf_dir)), "pd_a", GROUP))


def _fixed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio and AUC of the fixed scores and of their mean, on the table."""
    apps = funded(scored(spark, sf_dir)).withColumn("pd_c", F.round((F.col("pd_a") + F.col("pd_b")) / 2, 9))
    with kept(apps.select(TARGET, GROUP, "pd_a", "pd_b", "pd_c")) as rows:
        found = {n: _air_and_auc(rows.select(TARGET, GROUP, F.col(c).alias("pd"))) for n, c in (("champion", "pd_a"), ("challenger", "pd_b"), ("mean", "pd_c"))}
    return fairness.candidates_frame(spark, found)


def lda_search_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fairness.lda_search(_fixed_candidates(spark, sf_dir)))


def lda_conclusion_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fairness.lda_conclusion(fairness.lda_search(_fixed_candidates(spark, sf_dir)))


def ablation_narrative_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What it would mean for the first fixed score to give way to the second, with the AUC for the group as its reconstruction."""
    with kept(funded(scored(spark, sf_dir)).select(TARGET, GROUP, "pd_a", "pd_b")) as rows:
        seen = []
        for c in ("pd_a", "pd_b"):
            one = rows.select(TARGET, GROUP, F.col(c).alias("pd"))
            seen.append((_air_and_auc(one)[0], evaluation.ranking_metrics(one, "pd", GROUP).first()["auc"]))
    (air_a, group_a), (air_b, group_b) = seen
    names = "name string, air_full double, air_ablated double, reconstruction_full double, reconstruction_ablated double"
    swaps = [("a to b", air_a, air_b, group_a, group_b), ("b to a", air_b, air_a, group_b, group_a)]
    return _rounded(fairness.ablation_narrative(spark.createDataFrame(swaps, names)))


def parcelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    apps = scored(spark, sf_dir)
    return _rounded(rejects.parcelling(funded(apps), rejected(apps), "pd_a", TARGET).select("app_id", "inferred"))


def parcelled_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    apps = scored(spark, sf_dir)
    inferred = rejects.parcelling(funded(apps), rejected(apps), "pd_a", TARGET)
    return rejects.hard_labels(inferred, "inferred", "app_id").select("app_id", "label")


def parcelling_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    apps = scored(spark, sf_dir)
    return _rounded(rejects.multiplier_sweep(funded(apps), rejected(apps), "pd_a", TARGET))


def augmentation_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rejects.augmentation_weights(scored(spark, sf_dir), "pd_a", APPROVED))


def fuzzy_augmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    apps = scored(spark, sf_dir)
    inferred = rejects.parcelling(funded(apps), rejected(apps), "pd_a", TARGET).select("app_id", "inferred")
    return _rounded(rejects.fuzzy_augmentation(inferred, "inferred").select("app_id", "y", "w"))


def counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    apps = scored(spark, sf_dir)
    return _rounded(rejects.counterfactual(rejects.parcelling(funded(apps), rejected(apps), "pd_a", TARGET), "inferred", TARGET))


def stacked_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    apps = scored(spark, sf_dir).select("app_id", "dti", "pd_a", TARGET, APPROVED)
    labelled = rejects.parcelling(funded(apps), rejected(apps), "pd_a", TARGET).withColumn("label", (F.col("inferred") >= 0.5).cast("int"))
    return rejects.stack_inferred(funded(apps), labelled, TARGET).select("app_id", "dti", TARGET)


def funded_model_on_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scored(spark, sf_dir).groupBy(APPROVED).agg(F.count(F.lit(1)).alias("n"), F.avg("pd_a").alias("predicted"), F.avg(TARGET).alias("actual")))


# --- fitted models: results depend on solvers or random draws -------------

def fit_predict(train: DataFrame, test: DataFrame, names: list[str]) -> DataFrame:
    """Bins, card and scored test rows (``pd``): the callback of proxy_ablation."""
    card = scorecard.fit_scorecard(train, binning.fit_binnings(train, names, TARGET), TARGET)
    return test.withColumn("pd", F.round(card.pd(), 9))


def _split(spark: SparkSession, sf_dir: str, proxies: bool = False) -> tuple[DataFrame, DataFrame]:
    apps = funded(app_view(spark, sf_dir))
    if proxies:
        h = lambda seed: F.pmod(F.xxhash64("app_id", F.lit(seed)), F.lit(1000)) / 1000 - 0.5
        apps = apps.withColumn("proxy_a", F.round(F.col("region_risk") * 100 + h(1) * 20, 2)).withColumn("proxy_b", F.round(F.col("region_risk") * 40 + h(2) * 14, 2))
    split = positional_split(apps, "app_id")
    return split.filter("is_train"), split.filter("NOT is_train")


def card_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _split(spark, sf_dir)
    return scorecard.points_table(spark, scorecard.fit_scorecard(train, binning.fit_binnings(train, CARD_FEATURES, TARGET), TARGET))


def card_fitted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _split(spark, sf_dir)
    return _rounded(evaluation.model_summary(fit_predict(train, test, CARD_FEATURES), {"card": "pd"}, TARGET), 4)


def proxy_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = fairness.proxy_reconstruction(as_features(funded(app_view(spark, sf_dir)), FEATURES, GROUP), FEATURES, GROUP)
    return spark.createDataFrame([(round(value, 4),)], "auc double")


def proxy_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _split(spark, sf_dir, proxies=True)
    names = LDA_FEATURES
    out = fairness.proxy_ablation(train, test, names, PROXIES, fit_predict, GROUP)
    return _rounded(spark.createDataFrame([out]), 4)


def _ablation(train: DataFrame, test: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(the row of :func:`fairness.ablation_narrative`, {card: its scored test rows, written}), of the cards with and without proxies."""
    scores: dict[str, DataFrame] = {}

    def fit(train: DataFrame, test: DataFrame, names: list[str]) -> DataFrame:
        name = "champion" if PROXIES[0] in names else "scorecard_without_proxies"
        scores[name] = written(fit_predict(train, test, names).select(TARGET, GROUP, "pd"), name)
        return scores[name]

    out = fairness.proxy_ablation(train, test, LDA_FEATURES, PROXIES, fit, GROUP)
    return train.sparkSession.createDataFrame([("proxies", *out.values())], f"name string, {', '.join(f'{k} double' for k in out)}"), scores


def _air_and_auc(scores: DataFrame) -> tuple[float, float]:
    """The ratio at the 80 % cut of ``pd``, and its AUC."""
    ok = (F.col("pd") <= F.lit(evaluation.approval_threshold(scores, "pd"))).cast("int")
    air = fairness.adverse_impact(scores.withColumn("_ok", ok), "_ok", GROUP).first()["air"]
    return air, evaluation.ranking_metrics(scores, "pd", TARGET).first()["auc"]


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the champion card, the card without proxies and the booster, fitted on the table; the row of the ablation; the champion's scores)."""
    train, test = _split(spark, sf_dir, proxies=True)
    row, scores = _ablation(train, test)
    pick = lambda d: as_features(d, LDA_FEATURES, TARGET, GROUP)
    gbm = boosting.fit_gbt_candidate(pick(train), pick(test), LDA_FEATURES, TARGET, rounds=GBM_ROUNDS)
    scores["gbm_challenger"] = written(gbm.select(TARGET, GROUP, F.round("pd", 9).alias("pd")), "gbm-challenger")
    found = {name: _air_and_auc(s) for name, s in scores.items()}
    champion = scores.pop("champion")
    release(*scores.values())
    return fairness.candidates_frame(spark, found), row, champion


def alternatives(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the judged candidates, the numbers of the ablation with their narrative, the champion's scored test rows), from one set of fits."""
    candidates, row, champion = _candidates(spark, sf_dir)
    return _rounded(fairness.lda_search(candidates)), _rounded(fairness.ablation_narrative(row)), champion


def lda_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alternatives(spark, sf_dir)[0]


def lda_conclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fairness.lda_conclusion(fairness.lda_search(_candidates(spark, sf_dir)[0]))


def ablation_narrative(spark: SparkSession, sf_dir: str) -> DataFrame:
    row, scores = _ablation(*_split(spark, sf_dir, proxies=True))
    release(*scores.values())
    return fairness.ablation_narrative(row).select("name", "narrative_code")


#: Directions of the features that have one.
WAYS = {"income": -1, "dti": 1, "utilization": 1, "delinq_2y": 1, "inquiries_6m": 1}


def monotone_params() -> boosting.BoosterParams:
    return boosting.BoosterParams(rounds=MONOTONE_ROUNDS, bins=255, monotone=WAYS, patience=10)


def gbm_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _split(spark, sf_dir)
    model = boosting.fit_monotone_booster(train, FEATURES, TARGET, monotone_params())
    scores = test.select(TARGET, F.round(model.batch_pd(FEATURES), 9).alias("pd"))
    return _rounded(evaluation.model_summary(scores, {"gbm_monotone": "pd"}, TARGET), 4)


def gbm_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _split(spark, sf_dir)
    pick = lambda d: as_features(d, FEATURES, TARGET, GROUP)
    fitted = boosting.fit_gbt_candidate(pick(train), pick(test), FEATURES, TARGET, rounds=GBM_ROUNDS)
    with kept(fitted.select(TARGET, GROUP, F.round("pd", 9).alias("pd"))) as scores:
        air, _ = _air_and_auc(scores)
        return _rounded(evaluation.model_summary(scores, {"gbm": "pd"}, TARGET).withColumn("air", F.lit(air)), 4)


def funded_card_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All applications with ``pd`` of a card that is fitted on all funded ones."""
    apps = app_view(spark, sf_dir)
    return fit_predict(funded(apps), apps, CARD_FEATURES)


def refit_with_rejects(apps: DataFrame) -> DataFrame:
    """(auc_funded_only, auc_with_rejects, delta) on all of ``apps``, which hold the
    funded card's ``pd``: rejects are parcelled by it, labelled, and stacked under the funded for a second card."""
    labelled = rejects.hard_labels(rejects.parcelling(funded(apps), rejected(apps), "pd", TARGET), "inferred", "app_id")
    both = rejects.stack_inferred(funded(apps), labelled, TARGET)
    after = fit_predict(both.drop("pd"), apps.drop("pd"), CARD_FEATURES)
    auc = [evaluation.ranking_metrics(s, "pd", TARGET).first()["auc"] for s in (apps, after)]
    return apps.sparkSession.createDataFrame([(auc[0], auc[1], auc[1] - auc[0])], "auc_funded_only double, auc_with_rejects double, delta double")


def parcelled_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    with kept(funded_card_scores(spark, sf_dir)) as apps:
        return _rounded(refit_with_rejects(apps), 4)


def synthetic_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many synthetic applications as the table has line items."""
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    apps = add_proxy_features(synthetic_applications(spark, n))
    return _rounded(apps.groupBy(APPROVED).agg(F.count(F.lit(1)).alias("n"), F.avg(TARGET).alias("default_rate"), F.corr("region_risk", "region_risk_proxy_a").alias("proxy_corr")), 4)


WITH_ORACLE = (
    population_summary, feature_matrix, train_test_split, woe_edges, woe_unmerged, woe_merged, woe_merged_thin, iv_summary, woe_transform,
    bin_lookup, card_scaling, card_scores, points_table, reason_codes, model_summary, calibration, approval_cut, swap_set, swap_verdict,
    decline_sample, adverse_impact, adverse_impact_log_interval, score_distribution, lda_search_fixture, lda_conclusion_fixture,
    ablation_narrative_fixture,
    woe_bin_labels, parcelling, parcelled_labels, parcelling_sweep, augmentation_weights, fuzzy_augmentation, counterfactual, stacked_population, funded_model_on_rejects,
)
ROWS_ONLY = (
    adverse_impact_bootstrap, card_fitted, card_fitted_metrics, proxy_reconstruction, proxy_ablation, lda_search,
    lda_conclusion, ablation_narrative, gbm_monotone,
    gbm_candidate, parcelled_refit, synthetic_population,
)
