"""Every query runs, and equals its DuckDB oracle where it has one."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from cardwright.operators.binning import fit_binnings
from cardwright.plans import catalog, credit

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(pdf):
    plain = lambda x: None if x is None or x != x else x.item() if hasattr(x, "item") else x
    return sorted(tuple(map(repr, map(plain, r))) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


def compare(spark, duck, name, query, sql):
    got = query(spark, SF).toPandas()
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_the_oracle(spark, duck, name):
    compare(spark, duck, name, catalog.queries()[name], catalog.oracle_sql()[name])


def optimum(x, y):
    """Newton steps to the ridge-penalised logistic optimum: (intercept, coefficients)."""
    x = np.column_stack([np.ones(len(y)), x])
    ridge = np.diag([0.0, *np.ones(x.shape[1] - 1)])
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        beta -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - y) + ridge @ beta)
    return beta[0], beta[1:]


def auc(score, y):
    pos, neg = score[y == 1], score[y == 0]
    return ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg))


def test_fitted_cards_against_newton(spark):
    """Points, metrics and refit of the fitted cards, from the same bins by another solver."""
    train, test = (d.toPandas() for d in credit._split(spark, SF))
    bins = fit_binnings(credit._split(spark, SF)[0], credit.CARD_FEATURES, "defaulted")

    def woe(pdf, feature):
        return np.select([(pdf[feature] > b.lo) & (pdf[feature] <= b.hi) for b in bins[feature].bins], [b.woe for b in bins[feature].bins], 0.0)

    matrix = lambda pdf: np.column_stack([woe(pdf, f) for f in credit.CARD_FEATURES])
    b0, betas = optimum(matrix(train), train["defaulted"].to_numpy())
    factor = 20 / np.log(2)
    share = (600 - factor * np.log(20) + factor * b0) / len(betas)
    got = {(r["feature"], r["bin"]): r["points"] for r in credit.card_fitted(spark, SF).collect()}
    for f, beta in zip(credit.CARD_FEATURES, betas):
        for i, b in enumerate(bins[f].bins):
            assert got[f, i] == pytest.approx(share - factor * beta * b.woe, abs=0.06)
    p = 1 / (1 + np.exp(-(b0 + matrix(test) @ betas)))
    m = credit.card_fitted_metrics(spark, SF).first()
    y = test["defaulted"].to_numpy()
    assert m["auc"] == pytest.approx(auc(p.round(6), y), abs=2e-3) and m["brier"] == pytest.approx(((p - y) ** 2).mean(), abs=2e-4)


def test_reconstruction_against_newton(spark):
    pdf = credit.funded(credit.app_view(spark, SF)).toPandas()
    x = pdf[credit.FEATURES].to_numpy(float)
    x = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-9)
    g = pdf[credit.GROUP].to_numpy()
    b0, betas = optimum(x, g)
    assert catalog.queries()["proxy_reconstruction"](spark, SF).first()["auc"] == pytest.approx(auc(b0 + x @ betas, g), abs=2e-3)


def test_bootstrap_lies_about_the_closed_interval(spark):
    low, high = credit.adverse_impact_bootstrap(spark, SF).first()
    closed = credit.adverse_impact_log_interval(spark, SF).first()
    assert low == pytest.approx(closed["low"], abs=0.03) and high == pytest.approx(min(1.0, closed["high"]), abs=0.05)


def test_refit_and_population(spark):
    """The population is as large as the table of line items; its rates at 60,000 are held in test_published_results."""
    r = credit.parcelled_refit(spark, SF).first()
    assert r["delta"] == pytest.approx(r["auc_with_rejects"] - r["auc_funded_only"], abs=1e-4) and 0.5 < r["auc_funded_only"] < 0.8
    rows = {r["approved_by_incumbent"]: r for r in credit.synthetic_population(spark, SF).collect()}
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert rows[0]["n"] + rows[1]["n"] == n and rows[1]["default_rate"] == pytest.approx(0.287, abs=0.03)
    whole = (rows[0]["n"] * rows[0]["default_rate"] + rows[1]["n"] * rows[1]["default_rate"]) / n
    assert whole == pytest.approx(0.41, abs=0.03) and min(r["proxy_corr"] for r in rows.values()) > 0.8


def test_ablation_of_the_registered_query(spark):
    r = credit.proxy_ablation(spark, SF).first()
    assert all(0 < r[k] <= 1 for k in ("air_full", "air_ablated", "reconstruction_full", "reconstruction_ablated"))
    want = max(r["reconstruction_ablated"] - 0.5, 0) / max(r["reconstruction_full"] - 0.5, 1e-9)
    assert r["signal_retained"] == pytest.approx(want, abs=0.02)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
