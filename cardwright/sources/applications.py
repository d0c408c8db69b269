"""Credit applications: schema, the view over the test tables, synthetic data.

A source is a DataFrame with these columns; every operator takes column names,
so a table of one's own works as well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .work import FILE, ROW, sorted_table

APPLICATION_SCHEMA = T.StructType([
    T.StructField("app_id", T.LongType()),
    T.StructField("income", T.DoubleType()),
    T.StructField("dti", T.DoubleType()),
    T.StructField("utilization", T.DoubleType()),
    T.StructField("delinq_2y", T.LongType()),
    T.StructField("inquiries_6m", T.LongType()),
    T.StructField("credit_age_months", T.DoubleType()),
    T.StructField("employment_years", T.DoubleType()),
    T.StructField("loan_amount", T.DoubleType()),
    T.StructField("region_risk", T.DoubleType()),
    T.StructField("protected_group_synthetic", T.IntegerType()),
    T.StructField("approved_by_incumbent", T.IntegerType()),
    T.StructField("defaulted", T.IntegerType()),
])

#: The view over orders, customer, nation and lineitem that stands in for applications.
APP_VIEW_SQL = """
SELECT o.o_orderkey AS app_id,
 c.c_acctbal AS income, o.o_totalprice AS loan_amount,
 l.avg_qty AS dti, l.util AS utilization, l.n_ret AS delinq_2y, l.n_lines AS inquiries_6m,
 CAST(n.n_regionkey AS DOUBLE) / 4 AS region_risk,
 CASE WHEN (o.o_orderkey * 7919 + 13) % 1000 < 250 + 112 * n.n_regionkey THEN 1 ELSE 0 END AS protected_group_synthetic,
 CASE WHEN l.n_ret <= 2 AND l.avg_qty < 35 AND c.c_acctbal > 0 THEN 1 ELSE 0 END AS approved_by_incumbent,
 CASE WHEN (o.o_orderkey * 104729 + 71) % 1000
   < 60 + 7 * l.avg_qty + 60 * l.n_ret + 25 * n.n_regionkey - c.c_acctbal / 100 THEN 1 ELSE 0 END AS defaulted
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN (SELECT l_orderkey, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount) * 1000, 6) AS util,
   count(*) AS n_lines, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS n_ret
   FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
"""

FEATURES = ["income", "dti", "utilization", "delinq_2y", "inquiries_6m", "region_risk", "loan_amount"]
GROUP, APPROVED, TARGET = "protected_group_synthetic", "approved_by_incumbent", "defaulted"


def app_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in applications of a test directory."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "nation", "lineitem")}
    sql = APP_VIEW_SQL
    for name in tables:
        sql = sql.replace(f"FROM {name} ", f"FROM {{{name}}} ").replace(f"JOIN {name} ", f"JOIN {{{name}}} ")
    return spark.sql(sql, **tables)


def funded(apps: DataFrame) -> DataFrame:
    return apps.filter(F.col(APPROVED) == 1)


def rejected(apps: DataFrame) -> DataFrame:
    return apps.filter(F.col(APPROVED) == 0)


def as_features(apps: DataFrame, features: list[str], *others: str) -> DataFrame:
    """Projection of ``features`` as doubles, beside ``others`` as they are."""
    return apps.select(*others, *[F.col(f).cast("double").alias(f) for f in features])


def positional_split(apps: DataFrame, key: str, share: float = 0.7) -> DataFrame:
    """Adds ``pos`` (from 1, in order of ``key``) and ``is_train`` (pos <= floor(share * n)).

    ``apps`` is written once in the order of the key; a row's number is its place
    in its file, after the rows of all files before, whose counts come to the
    driver. No window runs, and how many files there are follows the table's size.
    """
    table = sorted_table(apps, key)
    counts = {r[FILE]: r["count"] for r in table.groupBy(FILE).count().collect()}
    before, upto = [], 0
    for file in range(max(counts, default=-1) + 1):
        before.append(upto)
        upto += counts.get(file, 0)
    offset = F.get(F.lit(before) if before else F.array(F.lit(0)), F.col(FILE))
    pos = (offset + F.col(ROW) + 1).cast("long")
    return table.withColumn("pos", pos).withColumn("is_train", F.col("pos") <= int(upto * share)).drop(FILE, ROW)


# --- synthetic population -------------------------------------------------

# The law of default.
INTERCEPT, NOISE, LOG_INCOME_CENTRE = -2.9, 0.35, 10.9
DEFAULT_COEFFICIENTS = {
    "dti": 0.034, "utilization": 0.021, "delinq_2y": 0.38, "inquiries_6m": 0.12,
    "credit_age_months": -0.0028, "employment_years": -0.055, "log_income": -0.55, "region_risk": 1.5,
}


# The draws in the order in which they use up the stream (name, law, parameters).
DRAWS = (
    ("log_income", "normal", (10.9, 0.55)),
    ("employment_years", "gamma", (2.2, 2.6)),
    ("loan_share", "uniform", (0.08, 0.65)),
    ("other_debt", "normal", (12, 6)),
    ("used", "beta", (2.2, 3.0)),
    ("delinq_2y", "poisson", (0.28,)),
    ("inquiries_6m", "poisson", (0.9,)),
    ("credit_age_months", "gamma", (5.0, 26.0)),
    ("region_risk", "beta", (2, 5)),
    ("noise", "normal", (0, NOISE)),
    ("default_draw", "uniform", (0, 1)),
    ("group_draw", "uniform", (0, 1)),
)
# Bounds of the columns that have some, and digits of those that are rounded.
BOUNDS = {
    "income": (12_000, 400_000), "employment_years": (0, 40), "loan_amount": (1_000, 60_000), "dti": (1, 75),
    "delinq_2y": (0, 8), "inquiries_6m": (0, 12), "credit_age_months": (6, 500),
}
DIGITS = {"income": 0, "dti": 2, "utilization": 2, "credit_age_months": 0, "employment_years": 1, "loan_amount": 0, "region_risk": 4}


def _draw(rng: np.random.Generator, n: int) -> pd.DataFrame:
    """n applications from the documented laws, the columns of APPLICATION_SCHEMA after the key."""
    d = {name: getattr(rng, law)(*parameters, n) for name, law, parameters in DRAWS}
    bounded = lambda name, x: np.clip(x, *BOUNDS[name]) if name in BOUNDS else x
    d |= {name: bounded(name, x) for name, x in d.items()}
    d["income"] = bounded("income", np.exp(d["log_income"]))
    d["loan_amount"] = bounded("loan_amount", d["income"] * d["loan_share"])
    d["dti"] = bounded("dti", d["loan_amount"] / d["income"] * 100 + d["other_debt"])
    d["utilization"] = d["used"] * 100
    d["log_income"] = np.log(d["income"]) - LOG_INCOME_CENTRE
    logit = INTERCEPT + sum(c * d[name] for name, c in DEFAULT_COEFFICIENTS.items()) + d["noise"]
    d[TARGET] = d["default_draw"] < 1 / (1 + np.exp(-logit))
    d[GROUP] = d["group_draw"] < 0.25 + 0.45 * d["region_risk"]
    d[APPROVED] = (d["dti"] < 45) & (d["delinq_2y"] <= 2) & (d["utilization"] < 85) & (d["income"] > 20_000)
    columns = {f.name: d[f.name] for f in APPLICATION_SCHEMA.fields[1:]}
    return pd.DataFrame({
        c: x.astype("int32") if x.dtype == bool else np.round(x, DIGITS[c]) if c in DIGITS else x for c, x in columns.items()
    })


def synthetic_applications(spark: SparkSession, n: int = 60_000, seed: int = 21, block: int = 10_000) -> DataFrame:
    """n synthetic applications, drawn in blocks of their own random streams.

    A block's rows depend on the seed and its number alone, so the table is the
    same however Spark partitions it or retries a task. With ``block`` >= n all
    rows come from one stream seeded by ``seed`` alone.
    """
    blocks = -(-n // block)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b in pdf["id"]:
                size = min(block, n - int(b) * block)
                rows = _draw(np.random.default_rng([seed, int(b)] if blocks > 1 else seed), size)
                rows.insert(0, "app_id", np.arange(size) + int(b) * block)
                yield rows

    return spark.range(blocks).mapInPandas(draw, APPLICATION_SCHEMA)


def _normal(key: str, seed: int) -> Column:
    """A standard normal draw for each key, the same however rows are partitioned."""
    uniform = lambda k: (F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(k)), F.lit(2**53)) + 0.5) / float(2**53)
    return F.sqrt(-2 * F.ln(uniform(0))) * F.cos(2 * math.pi * uniform(1))


def _noise_stream(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """(app_id, a, b): two runs of n standard normal draws out of one stream, for ids from 0."""
    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            rng = np.random.default_rng(seed)
            yield pd.DataFrame({"app_id": np.arange(n), "a": rng.standard_normal(n), "b": rng.standard_normal(n)})

    return spark.range(1, numPartitions=1).mapInPandas(draw, "app_id long, a double, b double")


def add_proxy_features(apps: DataFrame, seed: int = 4, stream_rows: int | None = None) -> DataFrame:
    """Two features that carry region_risk: closely, and thinly with utilization.

    The noise hangs on app_id and the seed. With ``stream_rows`` it comes from
    one random stream of that many rows in the order of app_id (from 0), as the
    published figures need it; that stream is drawn by one task.
    """
    if stream_rows:
        apps, a, b = apps.join(_noise_stream(apps.sparkSession, stream_rows, seed), "app_id"), F.col("a"), F.col("b")
    else:
        a, b = _normal("app_id", seed), _normal("app_id", seed + 1)
    return apps.withColumns({
        "region_risk_proxy_a": F.round(F.col("region_risk") * 100 + a * 6, 2),
        "region_risk_proxy_b": F.round(F.col("region_risk") * 40 + F.col("utilization") * 0.15 + b * 4, 2),
    }).drop("a", "b")


def write_applications(apps: DataFrame, path: str) -> None:
    apps.write.mode("overwrite").parquet(path)


def read_applications(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(APPLICATION_SCHEMA).parquet(path)
