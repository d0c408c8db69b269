"""Fair-lending measures, proxy tests and the search for less discriminatory models."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bands import ratio
from .evaluation import approval_threshold, ranking_metrics
from .quantiles import exact_quantiles, kept, small
from .scorecard import fit_logistic

FOUR_FIFTHS = 0.80
MIN_GROUP = 10

FitPredict = Callable[[DataFrame, DataFrame, list[str]], DataFrame]


def adverse_impact(df: DataFrame, approved: str, group: str) -> DataFrame:
    """(rate_1, rate_0, air, flagged, disadvantaged).

    The ratio is the smaller approval rate over the larger; below 0.80 it is
    flagged. With an empty group all but the rates are null; with nobody
    approved the ratio is null and not flagged.
    """
    rate = lambda g: F.avg(F.when(F.col(group) == g, F.col(approved).cast("double")))
    rates = df.agg(rate(1).alias("rate_1"), rate(0).alias("rate_0"))
    both = F.col("rate_1").isNotNull() & F.col("rate_0").isNotNull()
    air = F.when(both, ratio(F.least("rate_1", "rate_0"), F.greatest("rate_1", "rate_0")))
    return rates.select(
        "rate_1", "rate_0", air.alias("air"),
        F.when(both, F.coalesce(air < FOUR_FIFTHS, F.lit(False))).alias("flagged"),
        F.when(both, F.when(F.col("rate_1") < F.col("rate_0"), 1).otherwise(0)).alias("disadvantaged"),
    )


def intersectional_impact(df: DataFrame, approved: str, groups: list[str], least: int = 30) -> DataFrame:
    """Approval over the lattice of ``groups``: a row for each cell of each set of
    attributes, from one cube over the table.

    (attributes, values, n, rate, ratio, small, flagged): the attributes' names
    and values in their order, joined by " x "; the rate over the best one among
    the same attributes' cells of at least ``least`` rows. Smaller cells are
    marked, have a ratio too, and are never flagged; others are below 0.80.
    Rows where an attribute is null form cells of their own.
    """
    names = {g: F.coalesce(F.col(g).cast("string"), F.lit("(null)")) for g in groups}
    plain = df.select(F.col(approved).cast("double").alias("_ok"), *[e.alias(f"_{i}") for i, e in enumerate(names.values())])
    keys = [f"_{i}" for i in range(len(groups))]
    cube = plain.cube(*keys).agg(F.grouping_id().alias("_set"), F.count("_ok").alias("n"), F.avg("_ok").alias("rate"))
    joined = lambda parts: F.array_join(F.array_compact(F.array(*parts)), " x ")
    within = lambda i: (F.shiftright("_set", len(groups) - 1 - i).bitwiseAND(1)) == 0
    cells = cube.filter(F.col("_set") < 2 ** len(groups) - 1).select(
        joined([F.when(within(i), F.lit(g)) for i, g in enumerate(groups)]).alias("attributes"),
        joined([F.when(within(i), F.col(k)) for i, k in enumerate(keys)]).alias("values"), "n", "rate",
    )
    cells = small(cells)
    best = cells.filter(F.col("n") >= least).groupBy("attributes").agg(F.max("rate").alias("best"))
    judged = cells.join(F.broadcast(best), "attributes", "left").withColumn("ratio", ratio(F.col("rate"), F.col("best"))).withColumn("small", F.col("n") < least)
    return judged.select("attributes", "values", "n", "rate", "ratio", "small", (~F.col("small") & F.coalesce(F.col("ratio") < FOUR_FIFTHS, F.lit(False))).alias("flagged"))


def worst_cells(cells: DataFrame) -> DataFrame:
    """(attributes, worst_ratio, worst_values, least_n, n_flagged) of :func:`intersectional_impact`: the worst of the cells that are large enough, and the size of the least cell."""
    large = F.when(~F.col("small"), F.struct("ratio", "values"))
    out = cells.groupBy("attributes").agg(F.min(large).alias("w"), F.min("n").alias("least_n"), F.count(F.when(F.col("flagged"), 1)).alias("n_flagged"))
    return out.select("attributes", F.col("w.ratio").alias("worst_ratio"), F.col("w.values").alias("worst_values"), "least_n", "n_flagged")


def _cells(df: DataFrame, approved: str, group: str) -> dict[tuple[int, int], int]:
    rows = df.groupBy(F.col(group).cast("int").alias("g"), F.col(approved).cast("int").alias("a")).agg(F.count(F.lit(1)).alias("n")).collect()
    return {(r["g"], r["a"]): r["n"] for r in rows}


def adverse_impact_interval(df: DataFrame, approved: str, group: str, draws: int = 400, seed: int = 3) -> tuple[float, float] | None:
    """Percentile bootstrap interval (95 %) of the ratio.

    The ratio depends on the four cells group x approved alone, so resampling
    rows is drawing those four counts; the table is read once. Draws with fewer
    than ten rows in a group are left out; without any, there is no interval.
    """
    cells = _cells(df, approved, group)
    keys = [(1, 1), (1, 0), (0, 1), (0, 0)]
    n = np.array([cells.get(k, 0) for k in keys], dtype=np.int64)
    if not n.sum():
        return None
    drawn = np.random.default_rng(seed).multinomial(n.sum(), n / n.sum(), size=draws)
    one, zero = drawn[:, :2].sum(axis=1), drawn[:, 2:].sum(axis=1)
    fit = (one >= MIN_GROUP) & (zero >= MIN_GROUP)
    r1, r0 = drawn[fit, 0] / one[fit], drawn[fit, 2] / zero[fit]
    high = np.maximum(r1, r0)
    values = (np.minimum(r1, r0)[high > 0]) / high[high > 0]
    return tuple(float(x) for x in np.quantile(values, [0.025, 0.975])) if len(values) else None


def adverse_impact_log_interval(df: DataFrame, approved: str, group: str) -> DataFrame:
    """(air, low, high): the interval of the ratio of rates 0 over 1 on the log scale, in closed form."""
    n = lambda g, a: F.count(F.when((F.col(group) == g) & (F.col(approved) == a), 1)).cast("double")
    c = df.agg(n(1, 1).alias("a1"), n(1, 0).alias("d1"), n(0, 1).alias("a0"), n(0, 0).alias("d0"))
    r1, r0 = ratio(F.col("a1"), F.col("a1") + F.col("d1")), ratio(F.col("a0"), F.col("a0") + F.col("d0"))
    log = F.ln(ratio(F.least(r1, r0), F.greatest(r1, r0)))
    err = F.sqrt(ratio(1 - r1, F.col("a1")) + ratio(1 - r0, F.col("a0")))
    return c.select(F.exp(log).alias("air"), F.exp(log - 1.959964 * err).alias("low"), F.exp(log + 1.959964 * err).alias("high"))


def score_distribution(df: DataFrame, score: str, group: str) -> DataFrame:
    """(group_value, n, mean, median, p10) per group, with mean_gap (group 1 less
    group 0) and separation_auc (of the negated score for group 1) on each row."""
    with kept(df.select(F.col(score).alias("s"), F.col(group).alias("g"))) as held:
        sides = held.select(*[F.when(F.col("g") == g, F.col("s")).alias(f"s{g}") for g in (1, 0)])
        found = exact_quantiles(sides, ["s1", "s0"], [0.5, 0.1], keep=False)
        quantiles = df.sparkSession.createDataFrame(
            [(g, *(found[f"s{g}"] or [None, None])) for g in (1, 0)], "group_value int, median double, p10 double"
        )
        means = held.groupBy(F.col("g").alias("group_value")).agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("mean"))
        gap = held.agg((F.avg(F.when(F.col("g") == 1, F.col("s"))) - F.avg(F.when(F.col("g") == 0, F.col("s")))).alias("mean_gap"))
        apart = ranking_metrics(held.select((-F.col("s")).alias("s"), "g"), "s", "g").select(F.col("auc").alias("separation_auc"))
        return small(F.broadcast(quantiles).join(means, "group_value").crossJoin(F.broadcast(gap)).crossJoin(F.broadcast(apart)).select(
            "group_value", "n", "mean", "median", "p10", "mean_gap", "separation_auc"
        ))


def standardised(df: DataFrame, features: list[str], *others: str) -> DataFrame:
    """Features less their mean, over their population deviation + 1e-9."""
    stats = df.agg(*[e for f in features for e in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))]).first()
    scaled = [((F.col(f) - F.lit(stats[f"m_{f}"])) / F.lit((stats[f"s_{f}"] or 0.0) + 1e-9)).alias(f) for f in features]
    return df.select(*others, *scaled)


def proxy_reconstruction(df: DataFrame, features: list[str], group: str) -> float:
    """How well the features give the group away: AUC of a logistic probe on the
    rows that it was fitted on. These are kept while Newton's steps read them."""
    with kept(df.select(group, *[F.col(f).cast("double").alias(f) for f in features])) as rows:
        x = standardised(rows, features, F.col(group).alias("g"))
        intercept, betas = fit_logistic(x, features, "g", grouped=False)
        z = F.lit(intercept)
        for f, b in zip(features, betas):
            z = z + F.lit(b) * F.col(f)
        return ranking_metrics(x.select(z.alias("z"), "g"), "z", "g").first()["auc"]


def proxy_ablation(
    train: DataFrame, test: DataFrame, features: list[str], drop: list[str], fit_predict: FitPredict, group: str,
    share: float = 0.80, full_scores: DataFrame | None = None,
) -> dict[str, float]:
    """Refit without the features ``drop`` and compare the ratio and what the
    remaining features still tell about the group. Names in ``drop`` that are no
    features are ignored. ``fit_predict(train, test, names)`` returns the test
    rows with a column ``pd``; ``full_scores`` saves the refit of the full model."""
    left = [f for f in features if f not in drop]

    def air(scored: DataFrame) -> float:
        cut = approval_threshold(scored, "pd", share)
        return adverse_impact(scored.withColumn("_ok", (F.col("pd") <= F.lit(cut)).cast("int")), "_ok", group).first()["air"]

    full = air(full_scores if full_scores is not None else fit_predict(train, test, features))
    less = air(fit_predict(train, test, left))
    before, after = proxy_reconstruction(test, features, group), proxy_reconstruction(test, left, group)
    return {
        "air_full": full, "air_ablated": less, "reconstruction_full": before, "reconstruction_ablated": after,
        "signal_retained": max(after - 0.5, 0.0) / max(before - 0.5, 1e-9),
    }


def ablation_narrative(df: DataFrame, with_worsened: bool = False) -> DataFrame:
    """Adds narrative_code to rows of proxy_ablation's numbers: ``cosmetic`` (ratio still, reconstruction
    fell), ``driver`` (ratio rose), else ``neutral`` (or ``worsened``, if asked for)."""
    change = F.col("air_ablated") - F.col("air_full")
    fell = F.col("reconstruction_full") - F.col("reconstruction_ablated")
    code = F.when((F.abs(change) < 0.01) & (fell > 0.02), "cosmetic").when(change > 0.01, "driver")
    if with_worsened:
        code = code.when(change < -0.01, "worsened")
    return df.withColumn("narrative_code", code.otherwise("neutral"))


# Materiality and affordability of a less discriminatory alternative.
MIN_AIR_GAIN, MAX_AUC_COST = 0.02, 0.005


def lda_search(candidates: DataFrame, champion: str = "champion") -> DataFrame:
    """Candidates (name, air, auc) against the champion: name, air_gain, auc_cost,
    verdict (qualifies, blocked_on_cost, not_material) and rank (of the qualifying, by gain; 0 for others)."""
    from pyspark.sql import Window

    best = candidates.filter(F.col("name") == champion)
    if best.isEmpty():
        raise ValueError(f"no candidate is named {champion}")
    against = candidates.filter(F.col("name") != champion).crossJoin(
        F.broadcast(best.select(F.col("air").alias("air_0"), F.col("auc").alias("auc_0")))
    )
    gain, cost = F.col("air") - F.col("air_0"), F.col("auc_0") - F.col("auc")
    verdict = F.when(gain < MIN_AIR_GAIN, "not_material").when(cost > MAX_AUC_COST, "blocked_on_cost").otherwise("qualifies")
    judged = against.select("name", "air", "auc", gain.alias("air_gain"), cost.alias("auc_cost"), verdict.alias("verdict"))
    place = F.row_number().over(Window.partitionBy("verdict").orderBy(F.desc("air_gain"), "name"))
    return judged.withColumn("rank", F.when(F.col("verdict") == "qualifies", place).otherwise(0))


def lda_conclusion(judged: DataFrame) -> DataFrame:
    """(n_qualifying, n_blocked, conclusion): a qualifying candidate comes before a blocked one, that before none."""
    n = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    out = judged.agg(n("qualifies").alias("n_qualifying"), n("blocked_on_cost").alias("n_blocked"))
    return out.withColumn(
        "conclusion",
        F.when(F.col("n_qualifying") > 0, "a less discriminatory alternative qualifies")
        .when(F.col("n_blocked") > 0, "fairer candidates exist but exceed the accuracy tolerance")
        .otherwise("no candidate is materially fairer"),
    )


def candidates_frame(spark: SparkSession, candidates: dict[str, tuple[float, float]]) -> DataFrame:
    """{name: (air, auc)} as the candidates of :func:`lda_search`."""
    return spark.createDataFrame([(n, float(a), float(u)) for n, (a, u) in candidates.items()], "name string, air double, auc double")
