"""Queries on anomalies of signals and on training runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import anomalies, runs, strategies
from ..sources.proxies import table
from .registry import query

_SCORES = """l AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), a AS (SELECT vec_id, avg(v) AS mu, count(*) AS n, sqrt(avg(v * v)) AS rms, max(abs(v)) AS peak FROM l GROUP BY vec_id),
m AS (SELECT vec_id, any_value(n) AS n, any_value(rms) AS rms, any_value(peak) AS peak, avg((v - mu) ** 2) AS m2, avg((v - mu) ** 4) AS m4 FROM l JOIN a USING (vec_id) GROUP BY vec_id),
s AS (SELECT vec_id, round(rms, 5) AS rms, round(((n * n - 1) * m4 / (m2 * m2) - 3 * (n - 1) ** 2) / ((n - 2) * (n - 3)), 3) AS kurtosis, round(peak / rms, 3) AS crest FROM m)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", anomalies.signal_scores(x).alias("s")).select("vec_id", "s.*")


@query(f"WITH {_SCORES} SELECT vec_id, rms, kurtosis, crest FROM s")
def signal_anomaly_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir)


@query(f"WITH {_SCORES} SELECT vec_id, kurtosis, 'tick_tock' AS reason_key, round(least(0.95, 0.5 + (kurtosis - 0.4) * 0.05), 2) AS confidence FROM s WHERE kurtosis >= 0.4")
def signal_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scores(spark, sf_dir).withColumn("t", anomalies.suggestion(F.col("kurtosis"), 0.4, "tick_tock")).where("t IS NOT NULL")
    return rows.select("vec_id", "kurtosis", "t.reason_key", "t.confidence")


def _samples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Customers as samples whose features hang on their label, the quarter of their balance."""
    rows = table(spark, sf_dir, "customer")
    label = F.when(F.col("c_acctbal") < 0, "noise").when(F.col("c_acctbal") > 8000, "tick").otherwise("OK")
    blur = lambda k: strategies.dice(F.col("c_custkey"), F.lit(k))
    values = {"a": F.col("c_acctbal") / 1000 + 3 * blur(1), "b": F.abs(F.col("c_acctbal") - 4000) / 1000 + 2 * blur(2), "c": blur(3), "d": F.col("c_nationkey").cast("double")}
    return rows.select(F.col("c_custkey").alias("id"), label.alias("label"), F.col("c_nationkey").alias("reference"), *(v.alias(k) for k, v in values.items())), list(values)


@query()
def isolation_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, features = _samples(spark, sf_dir)
    split = F.when(strategies.dice(F.col("id"), F.lit(4)) < 0.6, "train").when(strategies.dice(F.col("id"), F.lit(4)) < 0.8, "validation").otherwise("test")
    out = anomalies.anomaly_run(rows.withColumn("split", split), features, "label", "OK", "id", contamination=0.05, trees=50)
    return out.groupBy("split").agg(F.count("*").alias("rows"), F.count_if("truth").alias("anomalies"), F.count_if("anomaly").alias("found"), F.count_if(F.col("truth") & F.col("anomaly")).alias("right"))


@query()
def boosted_seed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, features = _samples(spark, sf_dir)
    split = strategies.split_rows(rows.withColumn("line", F.lit("one")).withColumn("sn", F.col("id")), "stratified", "label", F.col("id"), seed=5)
    metrics, _, _ = runs.seed_runs(split, features, ["OK", "noise", "tick"], "OK", [1, 2], runs.BOOSTED, {"maxIter": 5, "maxDepth": 3, "subsamplingRate": 0.7}, steps=[0.0, 0.2, 0.4, 0.6])
    return metrics.select("seed", "split", "samples", "accuracy", "f1_macro", "nok_recall", "false_ok_rate", "false_reject_rate")
