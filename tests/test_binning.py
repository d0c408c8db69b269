import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cardwright.functions.bands import band_closed_open, band_open_closed, iv_band
from cardwright.operators.binning import Bin, Binning, Intervals, fit_binnings, merge_monotonic, merge_thin, transform
from cardwright.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 100, 6000)
    y = (rng.random(6000) < 0.05 + 0.006 * x).astype(int)
    noise = np.random.default_rng(1).uniform(0, 100, 6000)
    return spark.createDataFrame(pd.DataFrame({"x": x, "noise": noise, "y": y})).cache()


def test_signal_and_noise(toy):
    bins = fit_binnings(toy, ["x", "noise"], "y")
    rates = [b.bad_rate for b in bins["x"].bins]
    assert rates == sorted(rates) and bins["x"].monotonic
    assert bins["x"].iv > 0.10 and bins["noise"].iv < 0.02
    assert bins["x"].bins[0].woe > bins["x"].bins[-1].woe
    assert sum(b.n for b in bins["x"].bins) == 6000


def test_iv_bands(spark):
    got = spark.createDataFrame([(0.01,), (0.05,), (0.2,), (0.4,), (0.8,), (None,), (float("nan"),)], "iv double").select(iv_band(F.col("iv"))).collect()
    assert [r[0] for r in got] == ["useless", "weak", "medium", "strong"] + ["SUSPICIOUS - check leakage"] * 3


def test_thin_last_bin_by_policy():
    def cells():
        return Intervals([1.0, 2.0, 3.0, 4.0, 5.0], [200, 200, 200, 200, 190, 10], [10, 20, 30, 40, 50, 5])

    reference, adjacent = cells(), cells()
    merge_thin(reference, 50, "reference")
    merge_thin(adjacent, 50, "adjacent")
    assert (reference.n, reference.bad, reference.inner) == ([990, 10], [150, 5], [5.0])
    assert (adjacent.n, adjacent.bad) == ([200, 200, 200, 200, 200], [10, 20, 30, 40, 55])


@pytest.mark.parametrize("thin", [0, 1])
def test_thin_first_bins_pop_the_first_edge(thin):
    n = [100, 100, 100, 100]
    n[thin] = 1
    cells = Intervals([1.0, 2.0, 3.0], n, [0, 0, 0, 0])
    merge_thin(cells, 5, "reference")
    assert cells.inner == [2.0, 3.0]


def test_two_bins_stay_however_thin():
    cells = Intervals([1.0], [97, 3], [1, 1])
    merge_thin(cells, 50)
    assert cells.n == [97, 3]


def test_first_of_equal_violations_merges():
    cells = Intervals([1.0, 2.0, 3.0, 4.0], [10] * 5, [1, 5, 3, 8, 6])
    merge_monotonic(cells)
    assert cells.inner[0] == 1.0 and cells.n[0] == 10 and cells.n[1] >= 20


def test_degenerate_features(spark):
    df = spark.createDataFrame([(float(i % 2), 7.0, i % 3 == 0) for i in range(31)], "flag double, constant double, b boolean").withColumn("y", F.col("b").cast("int"))
    bins = fit_binnings(df, ["flag", "constant"], "y")
    assert len(bins["flag"].bins) == 1 and bins["flag"].bins[0].woe == 0 and bins["flag"].iv == 0
    assert bins["constant"].bins == () and bins["constant"].iv == 0 and bins["constant"].monotonic
    assert {r[0] for r in df.select(bins["constant"].woe(F.col("constant"))).collect()} == {0.0}
    with pytest.raises(ValueError):
        bins["constant"].index(F.col("constant"))


def test_unmatched_values_and_gaps(spark):
    gap = Binning("x", (Bin("a", -math.inf, 1.0, 5, 1, 0.2, 0.7, 0.0), Bin("b", 2.0, math.inf, 5, 3, 0.6, -0.4, 0.0)), 0.0, True)
    rows = [(1.0,), (1.5,), (3.0,), (None,), (float("nan"),), (float("-inf"),)]
    got = spark.createDataFrame(rows, "x double").select(gap.woe(F.col("x")), gap.woe(F.col("x"), "last"), gap.index(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [(0.7, 0.7, 0), (0.0, -0.4, 1), (-0.4, -0.4, 1), (0.0, -0.4, 1), (0.0, -0.4, 1), (0.0, -0.4, 1)]


def test_closures_differ_on_an_edge(spark):
    row = spark.range(1).select(band_open_closed(F.lit(2.0), [1.0, 2.0, 3.0]), band_closed_open(F.lit(2.0), [1.0, 2.0, 3.0])).first()
    assert tuple(row) == (1, 2)


def test_unmerged_counts_equal_numpy(toy):
    pdf = toy.toPandas()
    bins = fit_binnings(toy, ["x"], "y", merge=False)["x"].bins
    edges = np.unique(np.quantile(pdf["x"], np.linspace(0, 1, 7)))
    edges[0], edges[-1] = -np.inf, np.inf
    expected = [int(((pdf["x"] > a) & (pdf["x"] <= b)).sum()) for a, b in zip(edges, edges[1:])]
    assert [b.n for b in bins] == expected


def test_transform_adds_columns(toy):
    bins = fit_binnings(toy, ["x"], "y")
    assert transform(toy, bins).filter("x_woe IS NULL").count() == 0


def test_exact_quantiles_by_narrowing(spark, monkeypatch):
    import cardwright.operators.quantiles as q

    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.normal(size=60_000), "b": np.where(rng.random(60_000) < 0.6, 3.0, rng.integers(0, 50, 60_000)), "c": rng.exponential(size=60_000) ** 4})
    probs = [0, 0.01, 1 / 6, 0.5, 0.8, 0.999, 1]
    got = exact_quantiles(spark.createDataFrame(pdf).repartition(8), ["a", "b", "c"], probs)
    for c in pdf:
        assert np.allclose(got[c], np.quantile(pdf[c], probs), rtol=1e-12, atol=0)
    assert q.SMALL < 60_000
    monkeypatch.setattr(q, "SMALL", 50)  # several finer rounds
    assert exact_quantiles(spark.createDataFrame(pdf).repartition(8), ["a", "b", "c"], probs) == got
    monkeypatch.setattr(q, "GRID", 20)
    assert exact_quantiles(spark.createDataFrame(pdf[:5000]), ["a", "c"], probs) == {c: pytest.approx(np.quantile(pdf[c][:5000], probs).tolist(), rel=1e-12) for c in "ac"}
    assert exact_quantiles(spark.createDataFrame([(None,), (float("nan"),)], "a double"), ["a"], [0.5]) == {"a": []}


def test_quantile_search_does_not_multiply_rows(spark):
    import cardwright.operators.quantiles as q

    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({c: np.round(rng.normal(size=4000), 2) for c in "ab"})
    pdf.loc[:9, "a"] = np.nan
    searches = {"a": q.Search.between({7}, [(-0.5, 0.25)]), "b": q.Search.between({7}, [(0.0, 0.0)])}
    df = spark.createDataFrame(pdf).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "ab"]).repartition(4)
    for apart in (True, False):
        counted = q._counted(df, searches, apart)
        plan = counted._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan and "MapInArrow" in plan
        rows = counted.collect()
        for i, c in enumerate("ab"):
            x, edges = pdf[c].dropna(), searches[c].edges
            for cell in range(2 * len(edges) + 1):
                low, high = searches[c].gap(cell) if cell % 2 == 0 else (edges[cell // 2],) * 2
                want = x[x == low] if cell % 2 else x[(x > low) & (x < high)]
                own = [r for r in rows if r["column"] == i and r["cell"] == cell]
                assert sum(r["n"] for r in own) == len(want)
                if cell in searches[c].wanted:
                    assert sorted(v for r in own for v in [r["value"]] * r["n"]) == sorted(want)
                else:
                    assert len(own) <= 4 and all(r["value"] is None for r in own)
