"""The driver's tables read as samples, label events, manifests, recordings and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.labels import status

#: The same views for DuckDB.
SAMPLES_SQL = "samples AS (SELECT c_custkey AS sample_pk, c_mktsegment AS line, CAST(c_nationkey AS VARCHAR) AS reference, CAST(c_custkey // 2 AS VARCHAR) AS sn, CASE WHEN c_custkey % 2 = 0 THEN 'up' ELSE 'down' END AS direction FROM customer)"
EVENTS_SQL = r"""events0 AS (
  SELECT event_id AS id, user_id AS sample_pk, CAST(ts AS DATE) AS timestamp,
         CASE event_type WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'expert' ELSE 'expert_b' END WHEN 'signup' THEN 'model_v1' WHEN 'error' THEN 'visitor' ELSE 'operator_' || (event_id % 3) END AS source,
         CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'rejected' WHEN event_id % 11 = 0 THEN ' Pending ' END AS requested,
         'r' || (CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) % 4) AS reason_key,
         CASE WHEN value < 20 THEN 'nok' ELSE 'ok' END AS result_key
  FROM events
), ev AS (
  SELECT *, CASE WHEN source LIKE 'expert%' THEN 'expert' WHEN source LIKE 'operator%' THEN 'operator' WHEN source LIKE 'model%' THEN 'model' ELSE source END AS category,
         CASE WHEN lower(trim(requested)) IN ('rejected', 'pending') THEN lower(trim(requested)) WHEN source LIKE 'expert%' THEN 'confirmed' ELSE 'unconfirmed' END AS status
  FROM events0
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("sample_pk"), F.col("c_mktsegment").alias("line"), F.col("c_nationkey").cast("string").alias("reference"), F.floor(key / 2).cast("string").alias("sn"), F.when(key % 2 == 0, "up").otherwise("down").alias("direction")
    )


def label_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_from(table(spark, sf_dir, "events"))


def events_from(events: DataFrame) -> DataFrame:
    """Label events of a batch or a stream."""
    kind, key = F.col("event_type"), F.col("event_id")
    source = F.when(kind == "purchase", F.when(key % 2 == 0, "expert").otherwise("expert_b")).when(kind == "signup", "model_v1").when(kind == "error", "visitor").otherwise(F.concat(F.lit("operator_"), (key % 3).cast("string")))
    requested = F.when((kind == "error") & (key % 2 == 0), "rejected").when(key % 11 == 0, " Pending ")
    out = events.select(
        key.alias("id"), F.col("user_id").alias("sample_pk"), F.to_date("ts").alias("timestamp"), source.alias("source"), requested.alias("requested"),
        F.concat(F.lit("r"), (F.regexp_extract("props", r"(\d+)", 1).cast("int") % 4).cast("string")).alias("reason_key"), F.when(F.col("value") < 20, "nok").otherwise("ok").alias("result_key"),
    )
    return out.withColumn("status", status(F.col("requested"), F.col("source")))
