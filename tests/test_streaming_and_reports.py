from pyspark.sql import functions as F

from cardwright.plans import credit
from cardwright.plans.fixtures import fixed_card
from cardwright.plans.reports import fairness_report, scorecard_report, rejects_report
from cardwright.streaming.scoring import score_applications, windowed_impact

SF = "/root/testdata/sf0.001"
SCHEMA = "app_id long, ts timestamp, dti double, delinq_2y long, income double, grp int"


def test_a_stream_is_scored_like_a_table(spark, tmp_path):
    rows = spark.range(200).select(
        "id", F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 50).cast("double").alias("dti"), (F.col("id") % 3).alias("delinq_2y"),
        (F.col("id") * 40.0 - 500).alias("income"), (F.col("id") % 2).cast("int").alias("grp"),
    ).withColumnRenamed("id", "app_id")
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    scored = score_applications(stream, fixed_card(), cut=0.3)
    for name, df in (("scored", scored), ("impact", windowed_impact(scored, "ts", "grp"))):
        query = df.writeStream.format("memory").queryName(name).outputMode("append" if name == "scored" else "complete").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        query.awaitTermination(120)
    want = {r["app_id"]: (r["score"], r["approved"]) for r in score_applications(rows, fixed_card(), cut=0.3).collect()}
    assert {r["app_id"]: (r["score"], r["approved"]) for r in spark.table("scored").collect()} == want
    impact = spark.table("impact").collect()
    assert sum(r["n_1"] + r["n_0"] for r in impact) == 200 and all(r["air"] is None or 0 <= r["air"] <= 1 for r in impact)


def test_reports(spark, monkeypatch):
    monkeypatch.setattr(credit, "MONOTONE_ROUNDS", 12)
    monkeypatch.setattr(credit, "GBM_ROUNDS", 12)
    text = scorecard_report(spark, SF)
    assert "| feature |" in text and "dti" in text and "swap_in" in text
    assert "Adverse impact" in fairness_report(spark, SF) and "multiplier" in rejects_report(spark, SF)
