"""Queries on imported label sheets: orders read as rows of sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import imports as I
from ..sources.proxies import table
from .registry import query

RESULTS = ("ok", "nok", "boundary")
REASONS = (I.Reason("clean_normal", "clean normal", "ok", ("正常",)), I.Reason("friction", "friction", "nok", ("rub",)), I.Reason("tremble", "tremble", "nok"), I.Reason("boundary", "edge case", "boundary"))

_WORD = """CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '异常' WHEN '2' THEN ' NOK ' WHEN '3' THEN 'ok' WHEN '4' THEN '不确定' ELSE 'unclear' END"""
_REASON = "CASE o_orderkey % 5 WHEN 0 THEN 'friction' WHEN 1 THEN ' Tre-mble ' WHEN 2 THEN 'loud 强烈 friction' WHEN 3 THEN 'qq' END"
#: The same for both engines: words, their keys, how reasons match.
_KEY = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'nok' WHEN '2' THEN 'nok' WHEN '3' THEN 'ok' WHEN '4' THEN 'boundary' END"
_MATCH = f"CASE o_orderkey % 5 WHEN 0 THEN 'friction' WHEN 1 THEN 'tremble' WHEN 2 THEN 'friction' WHEN 4 THEN CASE {_KEY} WHEN 'ok' THEN 'clean_normal' WHEN 'boundary' THEN 'boundary' END END"
_SCORE = f"CASE WHEN {_MATCH} IS NULL THEN NULL WHEN o_orderkey % 5 = 1 THEN 0.999 WHEN o_orderkey % 5 = 2 THEN 0.9 ELSE 1 END"

_LINES = """known AS (SELECT CAST(c_custkey AS VARCHAR) AS sn, c_mktsegment AS line FROM customer WHERE c_nationkey < 9),
 by_sn AS (SELECT CAST(p_partkey AS VARCHAR) AS sn, p_brand AS line FROM part), by_reference AS (SELECT CAST(p_size AS VARCHAR) AS reference, arg_max(p_brand, (p_retailprice, p_partkey)) AS line FROM part GROUP BY p_size),
 lined AS (SELECT o.*, CASE WHEN o_orderstatus = 'F' THEN 'A' ELSE coalesce(k.line, s.line, r.line) END AS line FROM orders o LEFT JOIN known k ON k.sn = CAST(o_custkey * 3 AS VARCHAR) LEFT JOIN by_sn s ON s.sn = CAST(o_custkey * 3 AS VARCHAR)
  LEFT JOIN by_reference r ON r.reference = CAST(o_orderkey % 60 AS VARCHAR))"""


def _sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row"), F.when(F.col("o_orderstatus") == "F", " A ").alias("line"), (F.col("o_custkey") * 3).cast("string").alias("sn"), (F.col("o_orderkey") % 60).cast("string").alias("reference"),
        F.date_format("o_orderdate", "yyyy/M/d").alias("label_time"), F.expr(_WORD).alias("up"), F.expr(_REASON).alias("up_type"), F.lit("正常").alias("down"), F.lit("None").alias("down_type"), F.when(F.col("o_orderkey") % 2 == 0, "seen").alias("note"),
    )


def _known(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    history = table(spark, sf_dir, "customer").where("c_nationkey < 9").select(F.col("c_custkey").cast("string").alias("sn"), F.col("c_mktsegment").alias("line"), F.lit(None).cast("timestamp").alias("timestamp"), F.col("c_custkey").alias("id"))
    manifest = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("sn"), F.col("p_size").cast("string").alias("reference"), F.col("p_brand").alias("line"), F.col("p_retailprice").alias("timestamp"), F.col("p_partkey").alias("id"))
    return history, manifest


@query(f"""WITH {_LINES}, l AS (
 SELECT o_orderkey, line, 'up' AS direction, {_KEY} AS result_key, {_MATCH} AS reason_key, {_SCORE} AS score, CASE WHEN o_orderkey % 5 = 2 THEN 0.95 ELSE 1 END AS confidence, {_WORD} AS word, {_REASON} AS text, o_orderdate FROM lined
 UNION ALL SELECT o_orderkey, line, 'down', 'ok', 'clean_normal', 1, 1, 'ok', NULL, o_orderdate FROM lined)
SELECT o_orderkey AS row, direction, line, result_key, reason_key, CAST(score AS DOUBLE) AS score, CAST(confidence AS DOUBLE) AS confidence, strftime(o_orderdate, '%Y-%m-%dT00:00:00') AS at,
 concat_ws(' | ', CASE WHEN o_orderkey % 2 = 0 THEN 'seen' END, CASE WHEN text IS NULL AND reason_key IS NOT NULL THEN 'reason_auto=' || result_key || '->' || CASE reason_key WHEN 'clean_normal' THEN 'clean normal' ELSE 'edge case' END END,
  CASE WHEN score < 0.999 THEN 'fuzzy=' || text || '->friction(0.90)' END) AS note,
 CASE WHEN line IS NULL THEN 'no line' WHEN result_key IS NULL THEN 'no such result: unclear' WHEN reason_key IS NULL THEN CASE WHEN text IS NULL THEN 'no reason' ELSE 'no such reason: qq' END END AS error FROM l""")
def import_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = I.with_lines(I.sheet_labels(_sheet(spark, sf_dir)), *_known(spark, sf_dir))
    return I.import_records(labels, RESULTS, REASONS).select("row", "direction", "line", "result_key", "reason_key", "score", "confidence", "at", "note", "error")


@query(f"""WITH g AS (SELECT *, {_WORD} AS word, {_KEY} AS up_key, {_MATCH} AS up_match, {_REASON} AS up_text FROM orders), l AS (
 SELECT o_orderkey, o_orderdate, o_custkey, 1 AS k, 'up' AS direction, up_key AS result_key, up_match AS reason_key, up_text AS text FROM g
 UNION ALL SELECT o_orderkey, o_orderdate, o_custkey, 1, 'down', 'nok', NULL, NULL FROM g WHERE o_orderkey % 3 = 0
 UNION ALL SELECT o_orderkey, o_orderdate, o_custkey, 2, 'down', 'nok', 'friction', 'rub' FROM g WHERE o_orderstatus = 'O')
SELECT o_orderkey AS row, 'label_' || k || '_' || direction AS place, CASE k WHEN 1 THEN 'operator_N_' || (o_custkey % 4) ELSE 'operator' END AS source, result_key, reason_key,
 strftime(o_orderdate, '%Y-%m-%dT') || lpad(CAST(o_custkey % 24 AS VARCHAR), 2, '0') || ':00:00' AS at,
 CASE WHEN result_key IS NULL THEN 'no such result: unclear' WHEN reason_key IS NULL THEN CASE WHEN text IS NULL THEN 'no reason' ELSE 'no such reason: qq' END END AS error FROM l""")
def import_annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row"), F.lit("A").alias("line"), F.col("o_custkey").cast("string").alias("sn"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_day"), (F.col("o_custkey") % 24).cast("double").cast("string").alias("hour_block"),
        F.concat(F.lit("N-"), (F.col("o_custkey") % 4).cast("string")).alias("label_1_operator"), F.expr(_WORD).alias("label_1_up"), F.expr(_REASON).alias("label_1_up_type"), F.when(F.col("o_orderkey") % 3 == 0, "故障").alias("label_1_down"),
        F.when(F.col("o_orderstatus") == "O", "nok").alias("label_2_down"), F.when(F.col("o_orderstatus") == "O", "rub").alias("label_2_down_type"),
    )
    return I.import_records(I.sheet_labels(sheet), RESULTS, REASONS).select("row", "place", "source", "result_key", "reason_key", "at", "error")
