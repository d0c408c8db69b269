"""Queries beyond the published card: reserved and categorical bins, stability,
intervals, intersections and SQL functions, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.card_sql import register_card
from ..operators import binning, categorical, evaluation, fairness, scorecard, stability
from ..sources.applications import APP_VIEW_SQL, GROUP, TARGET, app_view, funded
from .credit import _decided, _rounded
from .fixtures import APP_CTE, fixed_card, scored
from .oracles import CUT, FUNDED, _BIN_ROWS, _merged_state, _scores_sql

#: Utilization cannot be told from a single line (missing); seven lines are all that are listed (a value of its own).
SPECIAL_COLUMNS = "CASE WHEN inquiries_6m = 1 THEN NULL ELSE utilization END AS util_part, inquiries_6m AS inq_part"
SPECIAL_FEATURES, SPECIAL_VALUES = ["dti", "util_part", "inq_part"], {"inq_part": [7.0]}
SPECIAL_BETAS, SPECIAL_INTERCEPT = {"dti": -0.9, "util_part": -0.75, "inq_part": -1.1}, -0.93


def _special(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    apps = app_view(spark, sf_dir).selectExpr("*", *SPECIAL_COLUMNS.split(", "))
    return apps, binning.fit_binnings(funded(apps), SPECIAL_FEATURES, TARGET, special=SPECIAL_VALUES, missing=True)


def woe_special(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins with reserved cells for missing values and for one special value."""
    return _rounded(binning.bin_table(spark, _special(spark, sf_dir)[1]).drop("label"))


def special_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities and points of a card whose features have reserved cells."""
    apps, bins = _special(spark, sf_dir)
    card = scorecard.Scorecard(bins, SPECIAL_INTERCEPT, SPECIAL_BETAS)
    return _rounded(apps.select("app_id", card.pd().alias("pd"), card.score().alias("score")))


CATEGORIES = ["priority", "segment", "nation", "day"]
KEPT_LEVELS = 100


def _categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    orders = read("orders").select(F.col("o_orderkey").alias("app_id"), "o_custkey", F.col("o_orderpriority").alias("priority"), F.date_format("o_orderdate", "MM-dd").alias("day"))
    people = read("customer").join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation")
    )
    return funded(app_view(spark, sf_dir)).select("app_id", TARGET).join(orders, "app_id").join(people, "o_custkey")


def categorical_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of four features by smoothed bad rate, the many days of the year cut to the most frequent hundred and the rest."""
    rows = categorical.level_counts(_categories(spark, sf_dir), CATEGORIES, TARGET, KEPT_LEVELS).collect()
    return _rounded(categorical.level_table(spark, rows))


def categorical_woe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of the levels of two features with the largest information value."""
    found = categorical.fit_categorical(_categories(spark, sf_dir), ["priority", "segment"], TARGET, max_bins=3)
    table = categorical.group_table(spark, found).withColumn("levels", F.array_join("levels", ","))
    return _rounded(table.drop("rest"))


def _event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value, and length of the properties, by week; errors have no value."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd").alias("week"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"), F.length("props").cast("double").alias("size"),
    )


def psi_by_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population stability of two features of the events, week by week against the first one."""
    return _rounded(stability.stability(_event_features(spark, sf_dir), ["value", "size"], "week"))


def vintage_bad_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad rates of score bands by the year of the order."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("app_id"), F.year("o_orderdate").alias("year"))
    apps = funded(scored(spark, sf_dir)).select("app_id", "pd_a", TARGET).join(orders, "app_id")
    return _rounded(stability.vintage_rates(apps, "pd_a", TARGET, "year").withColumnRenamed("period", "year"))


def auc_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.auc_intervals(funded(scored(spark, sf_dir)), {"card": "pd_a", "challenger": "pd_b"}, TARGET))


def auc_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.auc_difference(funded(scored(spark, sf_dir)), "pd_a", "pd_b", TARGET))


def swap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.swap_intervals(evaluation.swap_set(funded(scored(spark, sf_dir)), "pd_a", "pd_b", TARGET)))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fairness.intersectional_impact(_decided(spark, sf_dir), "approved", [GROUP, "region_risk"])


def intersectional_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_cells(spark, sf_dir))


def intersectional_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(fairness.worst_cells(_cells(spark, sf_dir)))


def card_scores_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from SQL text alone, by a card's temporary functions."""
    register_card(spark, fixed_card(), "fixed_card")
    return spark.sql(
        "SELECT app_id, round(fixed_card_pd(dti, delinq_2y, income), 6) AS pd, round(fixed_card_score(dti, delinq_2y, income), 6) AS score FROM {apps}",
        apps=app_view(spark, sf_dir),
    )


QUERIES = (
    woe_special, special_scores, categorical_levels, categorical_woe, psi_by_week, vintage_bad_rates, auc_intervals, auc_difference,
    swap_intervals, intersectional_impact, intersectional_worst, card_scores_sql,
)

# --- DuckDB SQL -----------------------------------------------------------

def _special_bins() -> str:
    """CTEs ending in ``cells``: the bins of each feature and after them the reserved cells."""
    states = ",".join(_merged_state(f, 0.05, 1, kept=f"{f} IS NOT NULL" + (" AND inq_part <> 7" if f == "inq_part" else "")) for f in SPECIAL_FEATURES)
    rows = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, p, c[p].n AS n, c[p].bad AS bad, CASE WHEN p > 1 THEN ed[p - 1] END AS lo, ed[p] AS hi FROM (SELECT c, ed, unnest(range(1, len(c) + 1)) AS p FROM last_{f})"
        for f in SPECIAL_FEATURES
    )
    one = lambda f, p, test, at: f"SELECT '{f}', {p}, count(*) FILTER ({test}), coalesce(sum(defaulted) FILTER ({test}), 0)::BIGINT, {at}, {at} FROM app WHERE approved_by_incumbent = 1"
    reserved = " UNION ALL ".join([one("inq_part", 98, "inq_part = 7", "7e0"), *[one(f, 99, f"{f} IS NULL", "NULL") for f in SPECIAL_FEATURES]])
    return f"""WITH RECURSIVE app AS (SELECT *, {SPECIAL_COLUMNS} FROM ({APP_VIEW_SQL})), {states},
        parts AS (SELECT * FROM ({rows}) WHERE n > 0 UNION ALL {reserved}),
        sums AS (SELECT *, sum(bad) OVER w AS tb, sum(n - bad) OVER w AS tg FROM parts WINDOW w AS (PARTITION BY feature)),
        shares AS (SELECT *, (bad + 0.5e0) / (tb + 0.5e0) AS pb, (n - bad + 0.5e0) / (tg + 0.5e0) AS pg FROM sums),
        cells AS (SELECT feature, p, CAST(row_number() OVER (PARTITION BY feature ORDER BY p) - 1 AS INTEGER) AS bin, lo, hi, n, bad, bad / nullif(n, 0) AS rate,
                  CASE WHEN n > 0 THEN ln(pg / pb) ELSE 0e0 END AS woe, CASE WHEN n > 0 THEN (pg - pb) * ln(pg / pb) ELSE 0e0 END AS iv FROM shares)"""


def _special_scores_sql() -> str:
    joins, terms = "", []
    for i, (f, beta) in enumerate(SPECIAL_BETAS.items()):
        at_seven = f" OR c{i}.p = 98 AND {f} = 7" if f == "inq_part" else ""
        not_seven = f" AND {f} <> 7" if f == "inq_part" else ""
        joins += f""" LEFT JOIN cells c{i} ON c{i}.feature = '{f}' AND (c{i}.p = 99 AND {f} IS NULL{at_seven}
            OR c{i}.p < 98 AND {f} > coalesce(c{i}.lo, '-inf'::DOUBLE) AND {f} <= coalesce(c{i}.hi, 'inf'::DOUBLE){not_seven})"""
        terms.append(f"{beta}::DOUBLE * coalesce(c{i}.woe, 0e0)")
    factor, b0 = "(20e0 / ln(2e0))", f"({SPECIAL_INTERCEPT}::DOUBLE)"
    return f"""{_special_bins()}, z AS (SELECT app_id, {' + '.join(terms)} AS z FROM app{joins})
        SELECT app_id, round(1 / (1 + exp(-({b0} + z))), 6) AS pd, round(600e0 - {factor} * ln(20e0) + {factor} * {b0} - {factor} * z, 6) AS score FROM z"""


_LEVELS = f"""WITH {APP_CTE}, x AS (
        SELECT defaulted, o_orderpriority AS priority, strftime(o_orderdate, '%m-%d') AS day, c_mktsegment AS segment, n_name AS nation
        FROM app JOIN orders ON app_id = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE approved_by_incumbent = 1
    ), c AS (SELECT feature, level, count(*) AS n, sum(defaulted)::BIGINT AS bad FROM (UNPIVOT x ON priority, segment, nation, day INTO NAME feature VALUE level) GROUP BY ALL),
    t AS (SELECT feature, sum(n)::BIGINT AS tn, sum(bad)::BIGINT AS tb FROM c GROUP BY feature),
    k AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, level) AS place FROM c JOIN t USING (feature)),
    r AS (SELECT *, (bad + 20e0 * (tb::DOUBLE / tn)) / (n + 20) AS rate FROM k WHERE place <= {KEPT_LEVELS}),
    o AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY rate, level) - 1 AS position FROM r)"""


def _groups_sql() -> str:
    """Every contiguous partition of a feature's five levels is a number of four bits: whether a cut follows each level."""
    return f"""{_LEVELS}, m AS (
            SELECT feature, tn, tb, mask, position, level, n, bad, (
                (mask & 1 & (position > 0)::INT) + ((mask >> 1) & 1 & (position > 1)::INT) + ((mask >> 2) & 1 & (position > 2)::INT) + ((mask >> 3) & 1 & (position > 3)::INT)
            ) AS bin FROM o, (SELECT unnest(range(16))::INT AS mask) WHERE feature IN ('priority', 'segment')
        ), g AS (
            SELECT feature, mask, bin, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad, array_to_string(list(level ORDER BY level), ',') AS levels,
                   (sum(n - bad) + 0.5e0) / (any_value(tn - tb) + 0.5e0) AS pg, (sum(bad) + 0.5e0) / (any_value(tb) + 0.5e0) AS pb, any_value(tn) AS tn
            FROM m GROUP BY feature, mask, bin
        ), v AS (
            SELECT feature, mask, sum((pg - pb) * ln(pg / pb)) AS iv, count(*) AS k FROM g GROUP BY feature, mask HAVING count(*) <= 3 AND min(n) >= 0.05e0 * any_value(tn)
        ), b AS (SELECT feature, arg_min(mask, (-round(iv, 12), k)) AS mask FROM v GROUP BY feature)
        SELECT feature, bin, levels, n, bad AS n_bad, round(ln(pg / pb), 6) AS woe, round((pg - pb) * ln(pg / pb), 6) AS iv FROM g JOIN b USING (feature, mask)"""


def _psi_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT '{f}' AS feature, week, {f} AS x FROM e" for f in ("value", "size"))
    return f"""WITH e AS (
            SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, CASE WHEN event_type <> 'error' THEN value END AS value, length(props)::DOUBLE AS size FROM events
        ), x AS ({parts}), q AS (
            SELECT feature, list_sort(list_distinct(quantile_cont(x, [{', '.join(str(i / 10) for i in range(1, 10))}]))) AS ed
            FROM x WHERE week = (SELECT min(week) FROM e) GROUP BY feature
        ), b AS (SELECT feature, week, CASE WHEN x IS NULL THEN len(ed) + 1 ELSE len(list_filter(ed, lambda v: x >= v)) END AS band, len(ed) + 2 AS k FROM x JOIN q USING (feature)),
        c AS (SELECT feature, week, band, any_value(k) AS k, count(*) AS n FROM b GROUP BY ALL),
        grid AS (SELECT w.feature, w.week, w.total, w.k, unnest(range(w.k)) AS band FROM (SELECT feature, week, sum(n) AS total, any_value(k) AS k FROM c GROUP BY ALL) w),
        s AS (SELECT grid.*, (coalesce(c.n, 0) + 0.5e0) / (total + 0.5e0 * grid.k) AS share FROM grid LEFT JOIN c ON c.feature = grid.feature AND c.week = grid.week AND c.band = grid.band),
        p AS (SELECT s.feature, s.week, any_value(s.total)::BIGINT AS n, sum((s.share - z.share) * ln(s.share / z.share)) AS psi
              FROM s JOIN s z ON z.feature = s.feature AND z.band = s.band AND z.week = (SELECT min(week) FROM e) GROUP BY s.feature, s.week)
        SELECT feature, week AS period, n, round(psi, 6) AS psi, CASE WHEN psi < 0.10 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'shifted' END AS reading FROM p"""


def _placed(score: str, tag: str) -> str:
    """CTEs ending in v_{tag}: of each funded row the placement value of its score."""
    return f"""w_{tag} AS (SELECT {score} AS s, count(*) FILTER (defaulted = 1) AS pos, count(*) FILTER (defaulted = 0) AS neg FROM f GROUP BY 1),
        r_{tag} AS (SELECT s, coalesce(sum(neg) OVER w, 0) + neg / 2e0 AS a, coalesce(sum(pos) OVER w, 0) + pos / 2e0 AS c, sum(pos) OVER () AS tp, sum(neg) OVER () AS tn
                    FROM w_{tag} WINDOW w AS (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        v_{tag} AS (SELECT app_id, defaulted AS y, CASE defaulted WHEN 1 THEN a / tn ELSE 1 - c / tp END AS v FROM f JOIN r_{tag} ON {score} = s)"""


_Z = "1.959963984540054e0"


def _interval_rows(model: str, tag: str) -> str:
    return f"""SELECT '{model}' AS model, avg(v) FILTER (y = 1) AS auc,
        sqrt(var_samp(v) FILTER (y = 1) / count(*) FILTER (y = 1) + var_samp(v) FILTER (y = 0) / count(*) FILTER (y = 0)) AS se FROM v_{tag}"""


def _intersections() -> str:
    g, r = "protected_group_synthetic", "region_risk"
    part = lambda names, values, keys: f"SELECT '{names}' AS attributes, {values} AS \"values\", count(*) AS n, avg(ok) AS rate FROM d GROUP BY {keys}"
    text = lambda c: f"CAST({c} AS VARCHAR)"
    return f"""{FUNDED}, {CUT}, d AS (SELECT {g}, {r}, (pd_a <= a)::INT AS ok FROM f, cut),
        c AS ({part(g, text(g), g)} UNION ALL {part(r, text(r), r)} UNION ALL {part(f'{g} x {r}', f"{text(g)} || ' x ' || {text(r)}", f'{g}, {r}')}),
        b AS (SELECT attributes, max(rate) AS best FROM c WHERE n >= 30 GROUP BY attributes),
        judged AS (SELECT c.*, rate / nullif(best, 0) AS ratio, n < 30 AS small FROM c LEFT JOIN b USING (attributes)),
        i AS (SELECT *, NOT small AND coalesce(ratio < 0.8, false) AS flagged FROM judged)"""


def oracle_sql() -> dict[str, str]:
    z_row = "round(low, 6) AS low, round(high, 6) AS high"
    return {
        "woe_special": f"{_special_bins()} {_BIN_ROWS.replace('FROM bins', 'FROM cells')}",
        "special_scores": _special_scores_sql(),
        "categorical_levels": f"""{_LEVELS} SELECT feature, position::INTEGER AS position, level, false AS rest, n, bad AS n_bad, round(rate, 6) AS rate FROM o
            UNION ALL SELECT feature, count(*) FILTER (place <= {KEPT_LEVELS})::INTEGER, NULL, true, sum(n) FILTER (place > {KEPT_LEVELS})::BIGINT, sum(bad) FILTER (place > {KEPT_LEVELS})::BIGINT, NULL
            FROM k GROUP BY feature HAVING max(place) > {KEPT_LEVELS}""",
        "categorical_woe": _groups_sql(),
        "psi_by_week": _psi_sql(),
        "vintage_bad_rates": f"""{FUNDED}, q AS (SELECT quantile_cont(pd_a, [0.25, 0.5, 0.75]) AS ed FROM f),
            b AS (SELECT year(o_orderdate)::INTEGER AS year, len(list_filter(ed, lambda v: pd_a >= v))::INTEGER AS band, defaulted FROM f JOIN orders ON app_id = o_orderkey, q),
            g AS (SELECT year, band, count(*) AS n, avg(defaulted) AS bad_rate FROM b GROUP BY ALL)
            SELECT year, band, n, round(bad_rate, 6) AS bad_rate, round(bad_rate - lag(bad_rate) OVER (PARTITION BY band ORDER BY year), 6) AS shift FROM g""",
        "auc_intervals": f"""{FUNDED}, {_placed('pd_a', 'a')}, {_placed('pd_b', 'b')},
            m AS ({_interval_rows('card', 'a')} UNION ALL {_interval_rows('challenger', 'b')}),
            l AS (SELECT *, auc - {_Z} * se AS low, auc + {_Z} * se AS high FROM m)
            SELECT model, round(auc, 6) AS auc, round(se, 6) AS se, {z_row}, round(2 * auc - 1, 6) AS gini, round(2 * low - 1, 6) AS gini_low, round(2 * high - 1, 6) AS gini_high FROM l""",
        "auc_difference": f"""{FUNDED}, {_placed('pd_a', 'a')}, {_placed('pd_b', 'b')},
            p AS (SELECT v_a.y, v_a.v AS a, v_b.v AS b FROM v_a JOIN v_b USING (app_id)),
            m AS (SELECT avg(a) FILTER (y = 1) AS a, avg(b) FILTER (y = 1) AS b, sqrt(var_samp(a - b) FILTER (y = 1) / count(*) FILTER (y = 1) + var_samp(a - b) FILTER (y = 0) / count(*) FILTER (y = 0)) AS se FROM p)
            SELECT round(a, 6) AS auc_first, round(b, 6) AS auc_second, round(a - b, 6) AS difference, round(se, 6) AS se, round(a - b - {_Z} * se, 6) AS low, round(a - b + {_Z} * se, 6) AS high FROM m""",
        "swap_intervals": f"""{FUNDED}, {CUT}, d AS (SELECT *, CASE WHEN pd_a <= a AND pd_b <= b THEN 'both' WHEN pd_b <= b THEN 'swap_in' WHEN pd_a <= a THEN 'swap_out' END AS cell FROM f, cut),
            k AS (SELECT k.cell, count(d.cell) AS n, avg(defaulted) AS p, {_Z} * {_Z} AS zz FROM (VALUES ('both'), ('swap_in'), ('swap_out')) AS k(cell) LEFT JOIN d ON k.cell = d.cell GROUP BY k.cell)
            SELECT cell, n, round(p, 6) AS bad_rate,
                   CASE WHEN n > 0 THEN round((p + zz / (2 * n) - sqrt(zz) * sqrt(p * (1 - p) / n + zz / (4e0 * n * n))) / (1 + zz / n), 6) END AS low,
                   CASE WHEN n > 0 THEN round((p + zz / (2 * n) + sqrt(zz) * sqrt(p * (1 - p) / n + zz / (4e0 * n * n))) / (1 + zz / n), 6) END AS high FROM k""",
        "intersectional_impact": f'{_intersections()} SELECT attributes, "values", n, round(rate, 6) AS rate, round(ratio, 6) AS ratio, small, flagged FROM i',
        "intersectional_worst": f"""{_intersections()} SELECT attributes, round(min(ratio) FILTER (NOT small), 6) AS worst_ratio,
            arg_min("values", (ratio, "values")) FILTER (NOT small) AS worst_values, min(n) AS least_n, count(*) FILTER (flagged) AS n_flagged FROM i GROUP BY attributes""",
        "card_scores_sql": f"SELECT app_id, pd, score FROM ({_scores_sql()})",
    }
