"""A fitted card as temporary SQL functions, so that SQL text alone scores.

Each function is one SQL expression over its arguments; Spark inlines it, so it
takes part in code generation like any other expression.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from ..operators.binning import Binning
from ..operators.scorecard import Scorecard


def _number(x: float) -> str:
    """A double literal with all its digits."""
    return f"{x!r}D" if x == x and abs(x) != float("inf") else f"double('{x}')"


def _cases(binning: Binning, x: str, values: list[str], otherwise: str) -> str:
    """CASE over the reserved cells and the ``(lo, hi]`` bins of ``x``."""
    tests = [f"{x} IS NULL OR isnan({x})" if r.value is None else f"{x} = {_number(r.value)}" for r in binning.reserved]
    parts = [f"WHEN {t} THEN {v}" for t, v in zip(tests, values[len(binning.bins):])]
    parts += [f"WHEN {x} > {_number(b.lo)} AND {x} <= {_number(b.hi)} THEN {v}" for b, v in zip(binning.bins, values)]
    return f"CASE {' '.join(parts)} ELSE {otherwise} END" if parts else otherwise


def card_functions(card: Scorecard, name: str) -> dict[str, str]:
    """{function: its CREATE statement}: ``<name>_woe_<feature>``, ``<name>_points_<feature>`` (both of
    one value), and of the features in the card's order ``<name>_pd`` and ``<name>_score``.

    Values outside all bins have a weight of 0, as in batch scoring; their points
    are the last bin's, as reason codes have them.
    """
    names = [name, *card.coefficients]
    if bad := [n for n in names if not re.fullmatch(r"[A-Za-z_]\w*", n)]:
        raise ValueError(f"not a name in SQL: {bad[0]}")
    out, terms = {}, []
    for f, beta in card.coefficients.items():
        b = card.binnings[f]
        create = lambda kind, body, f=f: f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_{kind}_{f}(x DOUBLE) RETURNS DOUBLE RETURN {body}"
        out[f"{name}_woe_{f}"] = create("woe", _cases(b, "x", [_number(c.woe) for c in b.cells], "0D"))
        if b.bins:
            points = [_number(p) for p in card.points(f)]
            out[f"{name}_points_{f}"] = create("points", _cases(b, "x", points, points[len(b.bins) - 1]))
        terms.append(f"{_number(beta)} * " + _cases(b, f, [_number(c.woe) for c in b.cells], "0D"))
    inputs = ", ".join(f"{f} DOUBLE" for f in card.coefficients)
    total = " + ".join(terms)
    out[f"{name}_pd"] = (
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_pd({inputs}) RETURNS DOUBLE RETURN 1 / (1 + exp(-({_number(card.intercept)} + {total})))"
    )
    out[f"{name}_score"] = (
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_score({inputs}) RETURNS DOUBLE RETURN {_number(card.base)} - {_number(card.config.factor)} * ({total})"
    )
    return out


def register_card(spark: SparkSession, card: Scorecard, name: str = "card") -> list[str]:
    """Make the functions of :func:`card_functions` known to the session; gives their names."""
    made = card_functions(card, name)
    for statement in made.values():
        spark.sql(statement)
    return list(made)
