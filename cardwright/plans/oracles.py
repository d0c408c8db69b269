"""DuckDB SQL of the credit-risk queries, written independently of the operators."""

from __future__ import annotations


from ..sources.applications import FEATURES
from .fixtures import APP_CTE, CARD_BETAS, CARD_BINS, CARD_INTERCEPT, SCORED_CTE

FACTOR = "(20e0 / ln(2e0))"
OFFSET = f"(600e0 - {FACTOR} * ln(20e0))"
SIXTHS = "[" + ", ".join(f"{i}e0 / 6" for i in range(7)) + "]"


#: Which edge goes for a thin bin, by policy: thin is its place among the filled bins, thin_at among all intervals.
_THIN_POP = {
    "reference": "CASE WHEN thin IS NULL THEN NULL WHEN thin = 1 THEN 1 ELSE greatest(thin - 2, 1) END",
    "adjacent": "CASE WHEN thin IS NULL THEN NULL ELSE greatest(thin_at - 1, 1) END",
}


def _merged_state(feature: str, share: float, start_phase: int, policy: str = "reference", kept: str = "true") -> str:
    """CTEs ending in ``last_{feature}``: the interval counts c and inner edges ed after merging."""
    f = feature
    return f"""
        x_{f} AS (SELECT CAST({f} AS DOUBLE) AS x, defaulted AS y FROM app WHERE approved_by_incumbent = 1 AND {kept}),
        e_{f} AS (SELECT list_sort(list_distinct(quantile_cont(x, {SIXTHS})))[2:-2] AS ed FROM x_{f}),
        g_{f} AS (SELECT len(list_filter(ed, lambda v: x > v)) AS b, count(*) AS n, sum(y)::BIGINT AS bad FROM x_{f}, e_{f} GROUP BY 1),
        c_{f} AS (SELECT list({{'n': coalesce(n, 0), 'bad': coalesce(bad, 0)}} ORDER BY p) AS c
                  FROM (SELECT unnest(range(0, len(ed) + 1)) AS p FROM e_{f}) LEFT JOIN g_{f} ON p = b),
        m_{f} AS (
            SELECT 0 AS step, {start_phase} AS phase, c, ed, (SELECT count(*) FROM x_{f}) AS nn FROM c_{f}, e_{f}
            UNION ALL
            SELECT step + 1, CASE WHEN pop IS NULL THEN phase + 1 ELSE phase END,
                   CASE WHEN pop IS NULL THEN c ELSE list_concat(list_concat(c[1:pop - 1],
                        [{{'n': c[pop].n + c[pop + 1].n, 'bad': c[pop].bad + c[pop + 1].bad}}]), c[pop + 2:]) END,
                   CASE WHEN pop IS NULL THEN ed ELSE list_concat(ed[1:pop - 1], ed[pop + 1:]) END, nn
            FROM (
                SELECT *, CASE
                    WHEN len(v) <= 2 THEN NULL
                    WHEN phase = 1 THEN {_THIN_POP[policy]}
                    WHEN list_bool_and(list_transform(drops, lambda d: d <= 0)) OR list_bool_and(list_transform(drops, lambda d: d >= 0)) THEN NULL
                    ELSE list_position(list_transform(drops, lambda d: d * way), list_max(list_transform(drops, lambda d: d * way))) END AS pop
                FROM (
                    SELECT *, nullif(list_position(list_transform(v, lambda s: s.n < {share} * nn), true), 0) AS thin,
                           list_position(list_transform(c, lambda s: s.n > 0 AND s.n < {share} * nn), true) AS thin_at,
                           list_transform(range(1, len(r)), lambda j: r[j] - r[j + 1]) AS drops, CASE WHEN r[1] <= r[-1] THEN 1 ELSE -1 END AS way
                    FROM (SELECT *, list_transform(v, lambda s: s.bad / s.n) AS r
                          FROM (SELECT *, list_filter(c, lambda s: s.n > 0) AS v FROM m_{f} WHERE phase <= 2))
                )
            )
        ),
        last_{f} AS (SELECT c, ed FROM m_{f} WHERE phase = 3)"""


def _bins(share: float, start_phase: int, policy: str = "reference") -> str:
    states = ",".join(_merged_state(f, share, start_phase, policy) for f in FEATURES)
    rows = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {i} AS place, p, c[p].n AS n, c[p].bad AS bad, ed[p - 1] AS lo, ed[p] AS hi FROM (SELECT c, ed, unnest(range(1, len(c) + 1)) AS p FROM last_{f})"
        for i, f in enumerate(FEATURES)
    )
    return f"""WITH RECURSIVE {APP_CTE}, {states},
        parts AS ({rows.replace('ed[p - 1]', 'CASE WHEN p > 1 THEN ed[p - 1] END')}),
        filled AS (SELECT *, sum(bad) OVER w AS tb, sum(n - bad) OVER w AS tg FROM parts WHERE n > 0 WINDOW w AS (PARTITION BY feature)),
        shares AS (SELECT *, (bad + 0.5e0) / (tb + 0.5e0) AS pb, (n - bad + 0.5e0) / (tg + 0.5e0) AS pg FROM filled),
        bins AS (
            SELECT feature, place, CAST(row_number() OVER (PARTITION BY feature ORDER BY p) - 1 AS INTEGER) AS bin, lo, hi, n, bad, bad / n AS rate,
                   ln(pg / pb) AS woe, (pg - pb) * ln(pg / pb) AS iv FROM shares
        )"""


_BIN_ROWS = "SELECT feature, bin, round(lo, 6) AS lo, round(hi, 6) AS hi, n, bad AS n_bad, round(rate, 6) AS bad_rate, round(woe, 6) AS woe, round(iv, 6) AS iv FROM bins"


def _case(feature: str, values: list, none) -> str:
    """CASE over the fixed card's ``(lo, hi]`` bins."""
    inner = CARD_BINS[feature][0]
    ends = [None, *inner, None]
    parts = []
    for k, v in enumerate(values):
        tests = [f"{feature} > {ends[k]}" if ends[k] is not None else "", f"{feature} <= {ends[k + 1]}" if ends[k + 1] is not None else ""]
        parts.append(f"WHEN {' AND '.join(t for t in tests if t)} THEN {v}")
    return f"CASE {' '.join(parts)} ELSE {none} END"


def _woe(feature: str, none="0e0") -> str:
    return _case(feature, [f"{w}::DOUBLE" for w in CARD_BINS[feature][1]], none)


def _points(feature: str) -> list[str]:
    share = f"(({OFFSET} + {FACTOR} * {CARD_INTERCEPT}::DOUBLE) / {len(CARD_BETAS)})"
    return [f"({share} - {FACTOR} * {CARD_BETAS[feature]}::DOUBLE * {w}::DOUBLE)" for w in CARD_BINS[feature][1]]


def _reason_sql() -> str:
    rows = []
    for at, f in enumerate(CARD_BETAS):
        points = _points(f)
        best = f"greatest({', '.join(points)})"
        earned = _case(f, points, points[-1])
        rows.append(
            f"SELECT app_id, {at} AS place, '{f}' AS feature, {_case(f, list(range(len(points))), len(points) - 1)} AS bin, {earned} AS earned, {best} AS best FROM app"
        )
    return f"""WITH {APP_CTE}, r AS ({' UNION ALL '.join(rows)}),
        s AS (SELECT *, round(best - earned, 1) AS lost FROM r),
        t AS (SELECT *, row_number() OVER (PARTITION BY app_id ORDER BY lost DESC, place) AS rank FROM s)
        SELECT app_id, CAST(rank AS INTEGER) AS rank, feature, CAST(bin AS INTEGER) AS bin, round(earned, 1) AS points_earned,
               round(best, 1) AS points_available, lost AS points_lost FROM t WHERE rank <= 2"""


def _points_sql() -> str:
    rows, seen = [], []
    for f in CARD_BETAS:
        for k, (p, w) in enumerate(zip(_points(f), CARD_BINS[f][1])):
            rows.append(f"SELECT '{f}' AS feature, {k}::INTEGER AS bin, round({w}::DOUBLE, 4) AS woe, round({p}, 1) AS points")
        seen.append(f"SELECT '{f}' AS feature, {_case(f, list(range(len(CARD_BINS[f][1]))), len(CARD_BINS[f][1]) - 1)} AS bin, defaulted FROM app WHERE approved_by_incumbent = 1")
    return f"""WITH {APP_CTE}, p AS ({' UNION ALL '.join(rows)}), s AS ({' UNION ALL '.join(seen)}),
        c AS (SELECT feature, bin, count(*) AS n, round(avg(defaulted), 4) AS bad_rate FROM s GROUP BY feature, bin)
        SELECT p.feature, p.bin, woe, points, coalesce(n, 0) AS n, bad_rate FROM p LEFT JOIN c ON p.feature = c.feature AND p.bin = c.bin"""


def _scores_sql() -> str:
    z = " + ".join(f"{b}::DOUBLE * {_woe(f)}" for f, b in CARD_BETAS.items())
    z_last = " + ".join(f"{b}::DOUBLE * {_woe(f, str(CARD_BINS[f][1][-1]) + '::DOUBLE')}" for f, b in CARD_BETAS.items())
    b0 = f"{CARD_INTERCEPT}::DOUBLE"
    return f"""WITH {APP_CTE} SELECT app_id, round(1 / (1 + exp(-({b0} + {z}))), 6) AS pd,
        round({OFFSET} + {FACTOR} * {b0} - {FACTOR} * ({z}), 6) AS score,
        round({OFFSET} - {FACTOR} * {b0} - {FACTOR} * ({z_last}), 6) AS score_calibrated FROM app"""


FUNDED = f"WITH {SCORED_CTE}, f AS (SELECT * FROM scored WHERE approved_by_incumbent = 1), j AS (SELECT * FROM scored WHERE approved_by_incumbent = 0)"
CUT = "cut AS (SELECT quantile_cont(pd_a, 0.8) AS a, quantile_cont(pd_b, 0.8) AS b FROM f)"
_TENTHS = "[" + ", ".join(f"{i / 10}" for i in range(1, 10)) + "]"
PARCEL = f"""{FUNDED}, q AS (SELECT quantile_cont(pd_a, {_TENTHS}) AS e FROM f),
    fb AS (SELECT *, len(list_filter(e, lambda v: pd_a >= v)) AS band FROM f, q), jb AS (SELECT *, len(list_filter(e, lambda v: pd_a >= v)) AS band FROM j, q),
    rates AS (SELECT band, avg(defaulted) AS rate FROM fb GROUP BY band),
    r AS (SELECT jb.*, coalesce(rate, (SELECT avg(defaulted) FROM f)) AS rate FROM jb LEFT JOIN rates ON jb.band = rates.band),
    i AS (SELECT *, least(rate * 2e0, 0.999e0) AS inferred FROM r)"""


def _auc(score: str, label: str, source: str, tag: str) -> str:
    """CTEs ending in m_{tag}(auc, ks): ties count half."""
    return f"""g_{tag} AS (SELECT {score} AS s, count(*) FILTER ({label} = 1) AS pos, count(*) FILTER ({label} = 0) AS neg FROM {source} GROUP BY 1),
        b_{tag} AS (SELECT *, coalesce(sum(pos) OVER w, 0) AS pb, coalesce(sum(neg) OVER w, 0) AS nb, sum(pos) OVER () AS tp, sum(neg) OVER () AS tn
                    FROM g_{tag} WINDOW w AS (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        m_{tag} AS (SELECT sum(pos * (nb + neg / 2e0)) / (any_value(tp)::DOUBLE * any_value(tn)) AS auc, greatest(max((tp - pb) / tp - (tn - nb) / tn), 0) AS ks FROM b_{tag})"""


def all_sql() -> dict[str, str]:
    """Name of the query -> DuckDB SQL."""
    air = lambda c: f"""(SELECT least(r1, r0) / greatest(r1, r0) FROM (
        SELECT avg(({c} <= cut)::INT) FILTER (protected_group_synthetic = 1) AS r1, avg(({c} <= cut)::INT) FILTER (protected_group_synthetic = 0) AS r0
        FROM f3, (SELECT quantile_cont({c}, 0.8) AS cut FROM f3)))"""  # noqa: E731
    f3 = f"{FUNDED}, f3 AS (SELECT *, round((pd_a + pd_b) / 2, 9) AS pd_c FROM f)"
    candidates = " UNION ALL ".join(f"SELECT '{n}' AS name, {air(f'pd_{c}')} AS air, (SELECT auc FROM m_{c}) AS auc" for n, c in (("champion", "a"), ("challenger", "b"), ("mean", "c")))
    lda = f"""{f3}, {", ".join(_auc(f"pd_{c}", "defaulted", "f3", c) for c in "abc")}, c AS ({candidates}),
        d AS (SELECT c.*, c.air - b.air AS gain, b.auc - c.auc AS cost FROM c, c b WHERE b.name = 'champion' AND c.name <> 'champion'),
        v AS (SELECT *, CASE WHEN gain < 0.02e0 THEN 'not_material' WHEN cost > 0.005e0 THEN 'blocked_on_cost' ELSE 'qualifies' END AS verdict FROM d)"""
    swaps = f"""{f3}, {", ".join(_auc(f"pd_{c}", "protected_group_synthetic", "f3", c) for c in "ab")},
        x AS (SELECT {air("pd_a")} AS a, {air("pd_b")} AS b, (SELECT auc FROM m_a) AS ra, (SELECT auc FROM m_b) AS rb),
        t AS (SELECT 'a to b' AS name, a AS a0, b AS a1, ra AS r0, rb AS r1 FROM x UNION ALL SELECT 'b to a', b, a, rb, ra FROM x)"""
    return {
        "population_summary": f"""WITH {APP_CTE}, p AS (
                SELECT 'all' AS population, * FROM app UNION ALL SELECT CASE approved_by_incumbent WHEN 1 THEN 'funded' ELSE 'rejected' END, * FROM app)
            SELECT population, count(*) AS n, round(avg(defaulted), 6) AS default_rate, round(avg(approved_by_incumbent), 6) AS funded_share FROM p GROUP BY population""",
        "feature_matrix": f"""WITH {APP_CTE} SELECT app_id, defaulted, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in FEATURES)}
            FROM app WHERE approved_by_incumbent = 1""",
        "train_test_split": f"""WITH {APP_CTE}, f AS (SELECT app_id, row_number() OVER (ORDER BY app_id) AS pos, count(*) OVER () AS n FROM app WHERE approved_by_incumbent = 1)
            SELECT app_id, pos, pos <= floor(0.7e0 * n) AS is_train FROM f""",
        "woe_edges": f"WITH RECURSIVE {APP_CTE}, " + ",".join(
            f"x_{f} AS (SELECT list_sort(list_distinct(quantile_cont(CAST({f} AS DOUBLE), {SIXTHS})))[2:-2] AS ed FROM app WHERE approved_by_incumbent = 1)" for f in FEATURES
        ) + " " + " UNION ALL ".join(
            f"SELECT '{f}' AS feature, CAST(p - 1 AS INTEGER) AS position, round(ed[p], 6) AS edge FROM (SELECT ed, unnest(range(1, len(ed) + 1)) AS p FROM x_{f})" for f in FEATURES
        ),
        "woe_unmerged": f"{_bins(0.05, 3)} {_BIN_ROWS}",
        "woe_merged": f"{_bins(0.05, 1)} {_BIN_ROWS}",
        "woe_merged_thin": f"{_bins(0.10, 1)} {_BIN_ROWS}",
        "woe_bin_labels": f"""{_bins(0.05, 1, "adjacent")}
            SELECT feature, bin, format('({{:.4g}}, {{:.4g}}]', coalesce(lo, '-inf'::DOUBLE), coalesce(hi, 'inf'::DOUBLE)) AS label,
                   round(lo, 6) AS lo, round(hi, 6) AS hi, n, bad AS n_bad, round(rate, 4) AS bad_rate, round(woe, 4) AS woe, round(iv, 4) AS iv FROM bins""",
        "iv_summary": f"""{_bins(0.05, 1)}, k AS (SELECT *, lag(rate) OVER (PARTITION BY feature ORDER BY bin) AS before FROM bins),
            s AS (SELECT feature, sum(iv) AS v, count(*) AS k,
                  coalesce(bool_and(rate >= before), true) OR coalesce(bool_and(rate <= before), true) AS monotonic FROM k GROUP BY feature)
            SELECT feature, round(v, 6) AS iv, CAST(k AS INTEGER) AS n_bins, monotonic,
                   CASE WHEN v < 0.02 THEN 'useless' WHEN v < 0.1 THEN 'weak' WHEN v < 0.3 THEN 'medium' WHEN v < 0.5 THEN 'strong'
                        ELSE 'SUSPICIOUS - check leakage' END AS band FROM s""",
        "woe_transform": f"WITH {APP_CTE} SELECT app_id, {', '.join(f'{_woe(f)} AS {f}_woe' for f in CARD_BINS)} FROM app",
        "bin_lookup": f"WITH {APP_CTE} SELECT app_id, " + ", ".join(
            f"CAST({_case(f, list(range(len(w))), len(w) - 1)} AS INTEGER) AS {f}_bin" for f, (_, w) in CARD_BINS.items()
        ) + " FROM app",
        "card_scaling": f"""{FUNDED}, o AS (SELECT sum(1 - defaulted) / sum(defaulted) AS odds FROM f)
            SELECT round({FACTOR}, 6) AS factor, round({OFFSET}, 6) AS "offset", round(odds, 6) AS odds, round({OFFSET} + {FACTOR} * ln(odds), 6) AS score_at_odds FROM o""",
        "card_scores": _scores_sql(),
        "points_table": _points_sql(),
        "reason_codes": _reason_sql(),
        "model_summary": f"""{FUNDED}, {_auc('pd_a', 'defaulted', 'f', 'a')}, {_auc('pd_b', 'defaulted', 'f', 'b')},
            u AS (SELECT 'card' AS model, m_a.*, (SELECT avg(power(pd_a - defaulted, 2)) FROM f) AS brier FROM m_a
                  UNION ALL SELECT 'challenger', m_b.*, (SELECT avg(power(pd_b - defaulted, 2)) FROM f) FROM m_b)
            SELECT model, round(auc, 6) AS auc, round(2 * auc - 1, 6) AS gini, round(ks, 6) AS ks, round(brier, 6) AS brier FROM u""",
        "calibration": FUNDED + ", " + " UNION ALL ".join(
            f"""{'r AS (' if m == 'card' else ''}SELECT '{m}' AS model, CAST(len(list_filter(e, lambda v: {c} >= v)) AS INTEGER) AS bin, {c} AS p, defaulted
            FROM f, (SELECT quantile_cont({c}, [{', '.join(str(i / 8) for i in range(1, 8))}]) AS e FROM f)""" for m, c in (("card", "pd_a"), ("challenger", "pd_b"))
        ) + ") SELECT model, bin, count(*) AS n, round(avg(p), 6) AS mean_score, round(avg(defaulted), 6) AS observed FROM r GROUP BY model, bin",
        "approval_cut": f"{FUNDED}, {CUT} SELECT round(any_value(a), 9) AS threshold, count(*) FILTER (pd_a <= a) AS n_approved, count(*) AS n FROM f, cut",
        "swap_set": f"""{FUNDED}, {CUT}, d AS (SELECT *, CASE WHEN pd_a <= a AND pd_b <= b THEN 'both' WHEN pd_b <= b THEN 'swap_in' WHEN pd_a <= a THEN 'swap_out' END AS cell FROM f, cut)
            SELECT k.cell, count(d.cell) AS n, round(avg(defaulted), 6) AS bad_rate
            FROM (VALUES ('both'), ('swap_in'), ('swap_out')) AS k(cell) LEFT JOIN d ON k.cell = d.cell GROUP BY k.cell""",
        "swap_verdict": f"""{FUNDED}, {CUT}, d AS (SELECT avg(defaulted) FILTER (pd_a > a AND pd_b <= b) - avg(defaulted) FILTER (pd_a <= a AND pd_b > b) AS delta FROM f, cut)
            SELECT round(delta, 6) AS delta, CASE WHEN delta < 0 THEN 'BETTER' WHEN delta IS NOT NULL THEN 'WORSE' END AS verdict FROM d""",
        "decline_sample": f"{FUNDED} SELECT app_id, pd_a FROM f ORDER BY pd_a DESC, app_id LIMIT 2",
        "adverse_impact": f"""{FUNDED}, {CUT}, d AS (
                SELECT avg((pd_a <= a)::INT) FILTER (protected_group_synthetic = 1) AS r1, avg((pd_a <= a)::INT) FILTER (protected_group_synthetic = 0) AS r0 FROM f, cut)
            SELECT round(r1, 6) AS rate_1, round(r0, 6) AS rate_0, round(least(r1, r0) / greatest(r1, r0), 6) AS air,
                   least(r1, r0) / greatest(r1, r0) < 0.8 AS flagged, CAST(r1 < r0 AS INTEGER) AS disadvantaged FROM d""",
        "adverse_impact_log_interval": f"""{FUNDED}, {CUT}, d AS (
                SELECT avg((pd_a <= a)::INT) FILTER (protected_group_synthetic = 1) AS r1, avg((pd_a <= a)::INT) FILTER (protected_group_synthetic = 0) AS r0,
                       count(*) FILTER (protected_group_synthetic = 1 AND pd_a <= a) AS n1, count(*) FILTER (protected_group_synthetic = 0 AND pd_a <= a) AS n0 FROM f, cut),
            l AS (SELECT ln(least(r1, r0) / greatest(r1, r0)) AS l, sqrt((1 - r1) / n1 + (1 - r0) / n0) AS s FROM d)
            SELECT round(exp(l), 6) AS air, round(exp(l - 1.959964e0 * s), 6) AS low, round(exp(l + 1.959964e0 * s), 6) AS high FROM l""",
        "score_distribution": f"""{FUNDED}, n AS (SELECT -pd_a AS s, protected_group_synthetic AS y FROM f), {_auc('s', 'y', 'n', 's')},
            g AS (SELECT protected_group_synthetic AS group_value, count(*) AS n, avg(pd_a) AS mean, quantile_cont(pd_a, 0.5) AS median, quantile_cont(pd_a, 0.1) AS p10 FROM f GROUP BY 1)
            SELECT group_value, n, round(mean, 6) AS mean, round(median, 6) AS median, round(p10, 6) AS p10,
                   round((SELECT mean FROM g WHERE group_value = 1) - (SELECT mean FROM g WHERE group_value = 0), 6) AS mean_gap,
                   round((SELECT auc FROM m_s), 6) AS separation_auc FROM g""",
        "lda_search_fixture": f"""{lda} SELECT name, round(air, 6) AS air, round(auc, 6) AS auc, round(gain, 6) AS air_gain, round(cost, 6) AS auc_cost, verdict,
            CASE verdict WHEN 'qualifies' THEN CAST(row_number() OVER (PARTITION BY verdict ORDER BY gain DESC, name) AS INTEGER) ELSE 0 END AS rank FROM v""",
        "lda_conclusion_fixture": f"""{lda}, k AS (SELECT count(*) FILTER (verdict = 'qualifies') AS n_qualifying, count(*) FILTER (verdict = 'blocked_on_cost') AS n_blocked FROM v)
            SELECT *, CASE WHEN n_qualifying > 0 THEN 'a less discriminatory alternative qualifies'
                WHEN n_blocked > 0 THEN 'fairer candidates exist but exceed the accuracy tolerance' ELSE 'no candidate is materially fairer' END AS conclusion FROM k""",
        "ablation_narrative_fixture": f"""{swaps} SELECT name, round(a0, 6) AS air_full, round(a1, 6) AS air_ablated, round(r0, 6) AS reconstruction_full, round(r1, 6) AS reconstruction_ablated,
            CASE WHEN abs(a1 - a0) < 0.01e0 AND r0 - r1 > 0.02e0 THEN 'cosmetic' WHEN a1 - a0 > 0.01e0 THEN 'driver' ELSE 'neutral' END AS narrative_code FROM t""",
        "parcelling": f"{PARCEL} SELECT app_id, round(inferred, 6) AS inferred FROM i",
        "parcelled_labels": f"""{PARCEL} SELECT app_id,
            CAST(('0x' || substr(md5(CAST(app_id AS VARCHAR) || ':7'), 1, 12))::BIGINT / 281474976710656e0 < inferred AS INTEGER) AS label FROM i""",
        "parcelling_sweep": f"""{PARCEL}, k AS (SELECT unnest([1e0, 1.5e0, 2e0, 3e0, 4e0]) AS k),
            s AS (SELECT k, avg(least(rate * k, 0.999e0)) AS inf, avg(defaulted) AS act FROM r, k GROUP BY k)
            SELECT k AS multiplier, round(inf, 6) AS inferred_rate, round(act, 6) AS actual_rate, round(inf - act, 6) AS signed_error,
                   row_number() OVER (ORDER BY abs(inf - act), k) = 1 AS best FROM s""",
        "augmentation_weights": f"""WITH {SCORED_CTE}, q AS (SELECT quantile_cont(pd_a, {_TENTHS}) AS e FROM scored),
            b AS (SELECT CAST(len(list_filter(e, lambda v: pd_a >= v)) AS INTEGER) AS band, count(*) AS n_all, count(*) FILTER (approved_by_incumbent = 1) AS n_funded FROM scored, q GROUP BY 1)
            SELECT band, n_all, n_funded, round(coalesce((n_all / (sum(n_all) OVER ())) / nullif(n_funded / (sum(n_funded) OVER ()), 0), 1), 6) AS weight FROM b""",
        "fuzzy_augmentation": f"{PARCEL} SELECT app_id, 1 AS y, round(inferred, 6) AS w FROM i UNION ALL SELECT app_id, 0, round(1 - inferred, 6) FROM i",
        "counterfactual": f"""{PARCEL}, m AS (SELECT avg(inferred) AS p, avg(defaulted) AS a FROM i)
            SELECT round(p, 6) AS inferred_rate, round(a, 6) AS actual_rate, round(p - a, 6) AS absolute_error, round((p - a) / nullif(a, 0), 6) AS relative_error,
                   CASE WHEN p > a THEN 'over-estimates' ELSE 'under-estimates' END AS direction FROM m""",
        "stacked_population": f"{PARCEL} SELECT app_id, dti, defaulted FROM f UNION ALL SELECT app_id, dti, CAST(inferred >= 0.5 AS INTEGER) FROM i",
        "funded_model_on_rejects": f"""WITH {SCORED_CTE} SELECT approved_by_incumbent, count(*) AS n, round(avg(pd_a), 6) AS predicted, round(avg(defaulted), 6) AS actual
            FROM scored GROUP BY approved_by_incumbent""",
    }
