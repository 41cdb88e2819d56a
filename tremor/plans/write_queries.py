"""Queries on changes of the label store and on choices of one row among several."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import label_writes as W
from ..operators import labels as L
from ..sources.proxies import EVENTS_SQL, SAMPLES_SQL, label_events, samples, table
from .registry import query

_E, _S = f"WITH {EVENTS_SQL}", f"WITH {SAMPLES_SQL}, {EVENTS_SQL}"
#: Orders as new labels of their customers' samples.
_NEW_SQL = """new AS (SELECT o_custkey AS sample_pk, CAST(o_orderdate AS DATE) AS timestamp, CASE o_orderstatus WHEN 'F' THEN 'expert:a' WHEN 'O' THEN 'operator_9' ELSE '专家' END AS source, o_orderpriority AS reason_key,
 CASE WHEN o_totalprice > 100000 THEN 'ok' ELSE 'nok' END AS result_key, CASE WHEN o_orderkey % 7 = 0 THEN 'rejected' WHEN o_orderstatus = 'O' THEN 'unconfirmed' ELSE 'confirmed' END AS status FROM orders WHERE o_custkey IN (SELECT sample_pk FROM samples))"""


def _new(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("sample_pk"), F.to_date("o_orderdate").alias("timestamp"), F.when(F.col("o_orderstatus") == "F", "expert:a").when(F.col("o_orderstatus") == "O", "operator_9").otherwise(" 专家 ").alias("source"),
        F.col("o_orderpriority").alias("reason_key"), F.when(F.col("o_totalprice") > 100000, "ok").otherwise("nok").alias("result_key"), F.when(F.col("o_orderkey") % 7 == 0, " Rejected").alias("status"),
    )
    return orders.join(samples(spark, sf_dir).select("sample_pk", "line", "sn", "direction"), "sample_pk").drop("sample_pk")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_events(spark, sf_dir).select("id", "sample_pk", "timestamp", "source", "reason_key", "result_key", "status")


def _appended_sql(kept: str) -> str:
    return f"""{_S}, {_NEW_SQL}, kept AS (SELECT id, sample_pk, timestamp, source, reason_key, result_key, status FROM ev {kept})
SELECT * FROM kept UNION ALL SELECT CAST((SELECT coalesce(max(id), 0) FROM kept) + row_number() OVER (ORDER BY sample_pk NULLS FIRST, timestamp NULLS FIRST, source NULLS FIRST, reason_key NULLS FIRST, result_key NULLS FIRST, status NULLS FIRST) AS BIGINT), sample_pk, timestamp, source, reason_key, result_key, status FROM new"""


@query(_appended_sql(""))
def append_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.appended(_events(spark, sf_dir), _new(spark, sf_dir), samples(spark, sf_dir))


@query(_appended_sql("WHERE status <> 'unconfirmed'"))
def replace_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.replaced(_events(spark, sf_dir), _new(spark, sf_dir), samples(spark, sf_dir))


@query(f"""{_E}, c AS (SELECT id, 'operator_new' AS source, 'r9' AS reason_key FROM ev WHERE source = 'expert_b')
SELECT ev.id, coalesce(c.source, ev.source) AS source, coalesce(c.reason_key, ev.reason_key) AS reason_key, CASE WHEN c.id IS NULL THEN ev.status ELSE 'unconfirmed' END AS status FROM ev LEFT JOIN c ON c.id = ev.id""")
def update_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    changes = events.where("source = 'expert_b'").select("id", F.lit("operator_new").alias("source"), F.lit("r9").alias("reason_key"))
    return W.updated(events, changes).select("id", "source", "reason_key", "status")


@query(f"{_E} SELECT id, source, CASE WHEN status <> 'pending' THEN status WHEN source = 'expert' OR source LIKE 'expert#_%' ESCAPE '#' THEN 'confirmed' ELSE 'unconfirmed' END AS status FROM ev")
def confirm_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return W.with_status(events, events.where("status = 'pending'"), "confirmed").select("id", "source", "status")


@query(f"{_E} SELECT id, CASE WHEN category = 'model' THEN 'rejected' ELSE status END AS status FROM ev")
def reject_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return W.with_status(events, events.where("source LIKE 'model%'"), "rejected").select("id", "status")


@query(f"{_E} SELECT id, sample_pk FROM ev WHERE status <> 'rejected'")
def delete_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return W.deleted(events, events.where("status = 'rejected'").select("id")).select("id", "sample_pk")


@query(f"{_S} SELECT s.line, s.sn, s.direction, ev.id, ev.source, ev.status FROM ev JOIN samples s ON s.sample_pk = ev.sample_pk")
def export_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.exported(_events(spark, sf_dir), samples(spark, sf_dir)).select("line", "sn", "direction", "id", "source", "status")


@query(f"{_E} SELECT sample_pk, row_number() OVER (PARTITION BY sample_pk ORDER BY timestamp, id) - 1 AS place, id, source, status FROM ev")
def label_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    past = W.history(_events(spark, sf_dir)).select("sample_pk", F.posexplode("history").alias("place", "h"))
    return past.select("sample_pk", F.col("place").cast("long").alias("place"), "h.id", "h.source", "h.status")


@query(f"{_E} SELECT source, status, count(*) AS events, count(DISTINCT sample_pk) AS samples, CAST(min(timestamp) AS VARCHAR) AS first, CAST(max(timestamp) AS VARCHAR) AS last FROM ev GROUP BY ALL")
def label_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.preview(_events(spark, sf_dir)).withColumns({c: F.col(c).cast("string") for c in ("first", "last")})


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def earliest_row_per_serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.latest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT l_suppkey, arg_max(l_returnflag, (l_shipdate, l_orderkey, l_linenumber, l_returnflag)) AS last_line, CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR) AS seen FROM lineitem GROUP BY l_suppkey")
def last_seen_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_returnflag")
    found = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.max_by("l_returnflag", at).alias("last_line"), F.max("l_shipdate").alias("seen"))
    return found.withColumn("seen", F.to_date("seen").cast("string"))
