"""The search for less discriminatory models judges models that are fitted on the table."""

import pytest
from pyspark.sql import functions as F

from cardwright.plans import credit

SF = "/root/testdata/sf0.001"


def test_candidates_are_fitted(spark, monkeypatch):
    monkeypatch.setattr(credit, "GBM_ROUNDS", 3)
    found = {r["name"]: r for r in credit.lda_search(spark, SF).collect()}
    assert set(found) == {"scorecard_without_proxies", "gbm_challenger"}
    train, test = credit._split(spark, SF, proxies=True)
    air, auc = credit._air_and_auc(credit.fit_predict(train, test, [f for f in credit.LDA_FEATURES if f not in credit.PROXIES]))
    assert (found["scorecard_without_proxies"]["air"], found["scorecard_without_proxies"]["auc"]) == pytest.approx((air, auc), abs=1e-6)


def test_the_narrative_depends_on_the_table(spark, monkeypatch):
    whole = credit.app_view(spark, SF)
    moved = whole.withColumn("defaulted", (F.col("region_risk") > 0.5).cast("int")).withColumn(credit.GROUP, (F.col("region_risk") > 0.5).cast("int"))
    monkeypatch.setattr(credit, "app_view", lambda *_: moved)
    assert [tuple(r) for r in credit.ablation_narrative(spark, SF).collect()] == [("proxies", "driver")]
