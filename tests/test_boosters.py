"""The boosters' queries take all features and rounds, and give the ratio."""

import timeit

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardwright.operators import boosting
from cardwright.plans import credit

SF = "/root/testdata/sf0.001"


def test_queries_ask_for_the_whole_job(spark, monkeypatch):
    asked = []

    def fit(df, features, target, params):
        asked.append((features, params.rounds))
        return boosting.Booster(-1.0, [boosting.Split("dti", 20.0, -0.1, 0.1)])

    monkeypatch.setattr(boosting, "fit_monotone_booster", fit)
    monotone, candidate = credit.gbm_monotone(spark, SF).first(), credit.gbm_candidate(spark, SF).first()
    assert asked == [(credit.FEATURES, 300), (credit.FEATURES, 250)]
    assert monotone["auc"] is not None and 0 < candidate["air"] <= 1


def test_batches_score_like_the_expression(spark):
    tree = boosting.Split("a", 1.0, -0.5, boosting.Split("b", 2.0, 0.25, 0.75))
    model = boosting.Booster(0.1, [tree, -0.2, tree])
    df = spark.createDataFrame([(0.0, 1), (1.0, 9), (2.0, 2), (2.0, 3), (None, 1), (5.0, None), (float("nan"), 2)], "a double, b long")
    for r in df.select(model.pd().alias("p"), model.batch_pd(["a", "b"]).alias("q")).collect():
        assert r["p"] == pytest.approx(r["q"], abs=1e-12)


def test_growth_ends_when_held_rows_gain_nothing(spark):
    noise = spark.range(12_000).select(F.rand(1).alias("x"), (F.rand(2) < 0.3).cast("int").alias("y")).cache()
    model = boosting.fit_monotone_booster(noise, ["x"], "y", boosting.BoosterParams(rounds=60, patience=3))
    assert len(model.trees) < 60


def test_histograms_of_joint_features_are_those_of_each():
    rng = np.random.default_rng(3)
    sizes, n = [3, 255, 7, 5, 40], 5000
    bins = np.stack([rng.integers(0, s, n) for s in sizes]).astype(np.uint8)
    assert boosting._joint(sizes) == [[0, 3, 2], [4], [1]]
    w, own = rng.normal(size=n), rng.integers(0, 4, n)
    for slots, slot in ((1, None), (4, own)):
        got = boosting._histograms(bins, slot, slots, (w, None), sizes)
        for f, size in enumerate(sizes):
            for s in range(slots):
                rows = np.ones(n, bool) if slot is None else own == s
                assert got[0, f, s, :size] == pytest.approx(np.bincount(bins[f][rows], w[rows], size))
                assert (got[1, f, s, :size] == np.bincount(bins[f][rows], minlength=size)).all() and not got[:, f, s, size:].any()


def test_a_walk_takes_no_lookup_of_each_rows_own_cut():
    rng = np.random.default_rng(4)
    rows, leaves = [[0, 0.0, -1, 0.0]], [0]
    for _ in range(14):
        at = leaves.pop(0)
        rows[at][:3] = [int(rng.integers(7)), float(rng.integers(20, 230)), len(rows)]
        leaves += [len(rows), len(rows) + 1]
        rows += [[0, 0.0, -1, 0.0], [0, 0.0, -1, 0.0]]
    tree, bins = boosting._arrays(rows), rng.integers(0, 255, (7, 200_000)).astype(np.uint8)
    feature, cut, left, _ = tree

    def by_lookups():
        node, every = np.zeros(bins.shape[1], np.intp), np.arange(bins.shape[1])
        while (inner := left[node] >= 0).any():
            node = np.where(inner, left[node] + ~(bins[feature[node], every] <= cut[node]), node)
        return node

    seconds = lambda f: min(timeit.repeat(f, number=1, repeat=5))
    assert (boosting._walk(tree, bins) == by_lookups()).all()
    assert seconds(lambda: boosting._walk(tree, bins)) < seconds(by_lookups) / 2


def test_tasks_of_a_job_follow_the_cores_not_the_files(spark):
    few = 2 * spark.sparkContext.defaultParallelism
    df = spark.range(0, 1000, numPartitions=3 * few).select(F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("y"))
    blocks = boosting._blocks(df, ["x"], [np.array([10.0, 500.0])], "y", 2_000_000, True)
    assert blocks.getNumPartitions() == few
    rows, back = zip(*blocks.collect())
    assert sum(len(x[1]) for x in (*rows, *back)) == 1000 and 0 < sum(len(x[1]) for x in back) < 250
