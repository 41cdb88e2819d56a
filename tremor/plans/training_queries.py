"""Queries on the making of training sets, on decisions and on metrics over splits and seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assembly as A
from ..operators import prediction as P
from ..sources.proxies import table
from .learning_queries import audit_candidates
from .registry import ORACLE_SQL, query


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as recordings, in a folder per line and reference."""
    path = F.concat_ws("/", "o_orderstatus", "o_orderpriority", F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("line"), F.col("o_custkey").cast("string").alias("sn"), F.col("o_orderpriority").alias("reference"), F.col("o_orderdate").cast("string").alias("time"), path.alias("relative_path")
    )


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') OR (o_orderstatus = 'P' AND o_orderpriority = '5-LOW') OR o_orderpriority = '3-MEDIUM' OR (o_orderstatus = 'P' AND o_orderpriority = '2-HIGH')""")
def selected_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = A.selected(_manifest(spark, sf_dir), lines=["F"], folders=["O\\1-URGENT"], references=["P/5-LOW", "3-MEDIUM"], key_folders=["P/2-HIGH/", ("O/2-HIGH", "P")])
    return found.select("o_orderkey")


@query("""SELECT DISTINCT a.o_orderkey AS sample_pk, b.o_orderstatus AS line, CAST(b.o_custkey AS VARCHAR) AS sn, b.o_orderpriority AS reference, b.o_orderstatus || '/' || b.o_orderpriority || '/' || b.o_orderkey AS relative_path
FROM orders a JOIN orders b ON a.o_orderstatus = b.o_orderstatus AND a.o_custkey = b.o_custkey WHERE a.o_orderpriority < '3'""")
def training_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = _manifest(spark, sf_dir)
    registered = manifest.withColumnRenamed("o_orderkey", "sample_pk").withColumn("is_active", (F.col("reference") < "3").cast("int"))
    return A.training_samples(registered, manifest).select("sample_pk", "line", "sn", "reference", "relative_path")


@query("""WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'nok' ELSE '' END AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'NOK part' ELSE '' END AS n, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS r FROM orders)
SELECT o_orderkey, CASE WHEN k = '' THEN n ELSE k END AS result_key, CASE WHEN n = '' THEN k ELSE n END AS result_name, r AS reason_id, k <> '' OR n <> '' OR r <> '' AS labelled FROM x""")
def label_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(key % 3 == 0, " nok").when(key % 3 == 1, "NaN").alias("result_key"), F.when(key % 2 == 0, "NOK part").alias("result_name"), F.when(key % 5 == 0, F.col("o_custkey")).alias("reason_id")
    )
    return A.payload(rows.withColumn("labelled", A.has_label(rows))).select("o_orderkey", "result_key", "result_name", "reason_id", "labelled")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN coalesce(c_mktsegment, ' none') ELSE 'X' END AS line, c_nationkey AS reference FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 2""")
def enriched_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("sn"), F.when(F.col("o_orderkey") % 2 == 0, " none").otherwise("X").alias("line"))
    view = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sn"), F.col("c_mktsegment").alias("line"), F.col("c_nationkey").alias("reference"), F.col("c_custkey").alias("at"))
    return A.enriched(rows, view, ["sn"], ["line", "reference"], "at").select("o_orderkey", "line", "reference")


@query("SELECT o_orderkey, o_orderkey % 4 = 0 OR o_orderkey % 3 = 0 OR o_custkey % 5 = 1 AS abnormal FROM orders")
def abnormal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    name = F.when(key % 3 == 0, "part NOK").when(key % 3 == 1, "good")
    found = A.abnormal(F.when(key % 4 == 0, " NG").when(key % 4 == 1, "ok"), name, (F.col("o_custkey") % 5).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", found.alias("abnormal"))


@query("SELECT o_custkey, o_orderpriority AS reason_name FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1 AND o_orderpriority NOT IN ('1-URGENT', '5-LOW')")
def nonstandard_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("reason_name"))
    return A.nonstandard(newest, ["1-urgent", " 5-LOW"])


@query("""WITH x AS (SELECT vec_id, label - 1 AS reason_id, CASE WHEN label % 3 = 0 THEN CAST(label - 1 AS VARCHAR) ELSE 'r' || label END AS name FROM embeddings),
 r AS (SELECT reason_id, any_value(name) AS reason_name, count(*) AS n, min(vec_id) AS first, CASE WHEN reason_id <= 0 THEN 'good' ELSE CAST(reason_id AS VARCHAR) END AS class FROM x GROUP BY reason_id),
 c AS (SELECT class, row_number() OVER (ORDER BY min(first)) - 1 AS mlabel, string_agg(reason_name, '_' ORDER BY first) AS mtype FROM r GROUP BY class)
SELECT reason_id, reason_name, n, CAST(mlabel AS INTEGER) AS mlabel, mtype FROM r JOIN c USING (class)""")
def model_label_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (label - 1).alias("reason_id"), F.when(label % 3 != 0, F.concat(F.lit("r"), label.cast("string"))).alias("reason_name"))
    return A.model_labels(rows, "vec_id")


@query("""WITH s AS (SELECT o_custkey, o_orderstatus AS v, min(o_orderkey) AS pos FROM orders GROUP BY ALL), p AS (SELECT o_custkey, o_orderpriority AS v, min(o_orderkey) AS pos FROM orders GROUP BY ALL)
SELECT o_custkey, row_count, o_orderstatus, o_orderpriority FROM (SELECT o_custkey, string_agg(v, '|' ORDER BY pos) AS o_orderstatus FROM s GROUP BY 1 HAVING count(*) > 1) JOIN (SELECT o_custkey, string_agg(v, '|' ORDER BY pos) AS o_orderpriority FROM p GROUP BY 1) USING (o_custkey)
JOIN (SELECT o_custkey, count(*) AS row_count FROM orders GROUP BY 1) USING (o_custkey)""")
def key_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.conflicts(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderstatus", "o_orderpriority"], "o_orderkey")


@query("""WITH x AS (SELECT vec_id, list_avg(list_transform(embedding, lambda v: v::DOUBLE)) > 0.01 AS fault, 0.5 + embedding[1]::DOUBLE AS a, 0.5 + embedding[2]::DOUBLE AS b, 0.5 + embedding[3]::DOUBLE AS c FROM embeddings), y AS (SELECT *, b > a AND b > 0.6 AS hit FROM x)
SELECT vec_id, CASE WHEN fault OR hit THEN 'NOK' ELSE 'OK' END AS result, CASE WHEN fault THEN '传感器错误' WHEN hit THEN 'friction' ELSE 'ok' END AS mtype, CASE WHEN fault THEN 1 WHEN hit THEN b ELSE a END AS score,
 CASE WHEN fault THEN '传感器错误' WHEN a >= b AND a >= c THEN 'ok' WHEN b >= c THEN 'friction' ELSE 'tremble' END AS raw_mtype, CASE WHEN fault THEN 1 ELSE greatest(a, b, c) END AS raw_score, CASE WHEN NOT fault THEN c END AS tremble FROM y""")
def predict_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal = F.col("embedding").cast("array<double>")
    scores = F.transform(F.slice(signal, 1, 3), lambda v: v + 0.5)
    rows = table(spark, sf_dir, "embeddings").withColumn("d", P.detail(scores, ["ok", "friction", "tremble"], [0.5, 0.6, 1.0], "ok", P.sensor_fault(signal, F.lit(8), 60.0, 0.01)))
    return rows.select("vec_id", *(F.col(f"d.{c}") for c in ("result", "mtype", "score", "raw_mtype", "raw_score")), F.try_element_at(F.col("d.scores"), F.lit("tremble")).alias("tremble"))


_PAIR = "CASE WHEN {0} % 4 = 0 THEN 'NOK' WHEN {0} % 4 < 3 THEN 'OK' END"


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_linenumber % 3 AS d, {_PAIR.format('l_partkey')} AS u, {_PAIR.format('l_suppkey')} AS w, CASE WHEN l_quantity > 10 THEN 'fu' ELSE '' END AS ut, CASE WHEN l_quantity > 30 THEN 'fw' ELSE '' END AS wt FROM lineitem),
 y AS (SELECT *, CASE WHEN u IS NULL AND w IS NULL THEN NULL WHEN u = 'NOK' OR w = 'NOK' THEN 'NOK' ELSE 'OK' END AS joint FROM x)
SELECT l_orderkey, l_linenumber, joint AS serial, CASE d WHEN 0 THEN u WHEN 1 THEN w ELSE joint END AS result,
 CASE d WHEN 0 THEN ut WHEN 1 THEN wt ELSE CASE joint WHEN 'NOK' THEN CASE WHEN w = 'NOK' AND wt <> '' THEN wt ELSE ut END WHEN 'OK' THEN CASE WHEN ut <> '' THEN ut ELSE wt END END END AS type FROM y""")
def row_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    up, down = (F.expr(_PAIR.format(c)) for c in ("l_partkey", "l_suppkey"))
    direction = F.element_at(F.array(F.lit("up"), F.lit("down"), F.lit("")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    kind = lambda least, name: F.when(F.col("l_quantity") > least, name).otherwise("")
    out = P.row_label(direction, up, kind(10, "fu"), down, kind(30, "fw"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", P.serial_result(up, down).alias("serial"), out["result"].alias("result"), out["type"].alias("type"))


_NAMES = ["ok", "friction", "tremble"]
_METRICS = f"""f AS (SELECT CASE WHEN l_linenumber < 3 THEN 'validation' ELSE 'train' END AS split, l_suppkey % 3 AS seed, l_partkey % 3 AS t, l_orderkey % 3 AS p, [l_discount * 4 + 0.2::DOUBLE, l_tax * 4 + 0.1::DOUBLE, 0.3::DOUBLE] AS s FROM lineitem),
 c AS (SELECT split, seed, k, count(*) FILTER (WHERE t = k) AS support, count(*) FILTER (WHERE p = k) AS claimed, count(*) FILTER (WHERE t = k AND p = k) AS hit FROM f, (VALUES (0), (1), (2)) v(k) GROUP BY ALL),
 m AS (SELECT split, seed, avg(CASE WHEN claimed > 0 THEN hit / claimed ELSE 0 END) AS precision_macro, avg(CASE WHEN support > 0 THEN hit / support ELSE 0 END) AS recall_macro, avg(2 * hit / (support + claimed)) AS f1_macro, sum(support * 2 * hit / (support + claimed)) / sum(support) AS f1_weighted
  FROM c WHERE support + claimed > 0 GROUP BY ALL),
 a AS (SELECT split, seed, count(*) AS samples, avg((t = p)::INT) AS accuracy, avg((p = 0)::INT) FILTER (WHERE t = 0) AS ok_recall, avg((p <> 0)::INT) FILTER (WHERE t <> 0) AS nok_recall, count(*) FILTER (WHERE t <> 0 AND p = 0) AS false_ok_count,
  avg((p = 0)::INT) FILTER (WHERE t <> 0) AS false_ok_rate, avg((p <> 0)::INT) FILTER (WHERE t = 0) AS false_reject_rate, avg(-ln(least(s[t + 1], 1 - 2.220446049250313e-16::DOUBLE))) AS logloss, avg(list_max(s)) AS max_prob_mean, avg(list_sort(s, 'DESC')[1] - list_sort(s, 'DESC')[2]) AS margin_mean FROM f GROUP BY ALL),
 r AS (SELECT * FROM a JOIN m USING (split, seed))"""
_FIGURES = ("accuracy", "ok_recall", "nok_recall", "false_ok_rate", "false_reject_rate", "logloss", "max_prob_mean", "margin_mean", "precision_macro", "recall_macro", "f1_macro", "f1_weighted")
_ROUNDED = ", ".join(f"round({c}, 9) AS {c}" for c in _FIGURES)


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.element_at(F.array(*(F.lit(n) for n in _NAMES)), (F.col(c) % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") < 3, "validation").otherwise("train").alias("split"), (F.col("l_suppkey") % 3).alias("seed"), name("l_partkey").alias("truth"), name("l_orderkey").alias("predicted"),
        F.array(F.col("l_discount") * 4 + 0.2, F.col("l_tax") * 4 + 0.1, F.lit(0.3)).alias("scores"),
    )
    return P.split_metrics(rows, ["split", "seed"], "truth", "predicted", "scores", _NAMES, "ok")


@query(f"WITH {_METRICS} SELECT split, seed, samples, false_ok_count, {_ROUNDED} FROM r")
def split_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("split", "seed", "samples", "false_ok_count", *(F.round(c, 9).alias(c) for c in _FIGURES))


@query(f"WITH {_METRICS}, u AS (UNPIVOT (SELECT split, seed, {', '.join(f'{c}::DOUBLE AS {c}' for c in _FIGURES)} FROM r) ON {', '.join(_FIGURES)} INTO NAME metric VALUE x) SELECT split, metric, round(avg(x), 9) AS mean, round(stddev_samp(x), 9) AS std FROM u GROUP BY ALL")
def seed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.seed_summary(_metrics(spark, sf_dir), _FIGURES).select("split", "metric", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@query(f"WITH {_METRICS} SELECT seed, row_number() OVER (ORDER BY false_ok_rate NULLS LAST, nok_recall DESC NULLS LAST, f1_macro DESC NULLS LAST, seed) - 1 AS place FROM r WHERE split = 'validation'")
def seeds_by_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There are as many rows as seeds, so their places are counted on one list."""
    best = P.best_seeds(_metrics(spark, sf_dir)).select("seed", "false_ok_rate", "nok_recall", "f1_macro")
    order = [F.coalesce("false_ok_rate", F.lit(2.0)), -F.coalesce("nok_recall", F.lit(-1.0)), -F.col("f1_macro"), F.col("seed")]
    listed = best.agg(F.sort_array(F.collect_list(F.struct(*(c.alias(f"_{i}") for i, c in enumerate(order))))).alias("runs"))
    return listed.select(F.posexplode("runs").alias("place", "run")).select(F.col("run._3").alias("seed"), F.col("place").cast("long").alias("place"))


@query(f"""WITH a AS ({ORACLE_SQL['audit_candidates']}), i AS (SELECT sample, issue AS v, min(truth * 10 + predicted) AS pos FROM a GROUP BY ALL), p AS (SELECT sample, priority AS v, min(truth * 10 + predicted) AS pos FROM a GROUP BY ALL)
SELECT a.sample, min(priority) AS audit_priority_top, count(*) FILTER (WHERE issue = 'false_ok_NOK_as_OK') AS false_ok_sample_count, count(*) AS sample_count, max(score) AS max_suspect_score, round(avg(score), 9) AS mean_suspect_score, max(seeds) AS max_error_seed_count,
 count(*) FILTER (WHERE issue = 'false_ok_NOK_as_OK') > 0 AS has_false_ok, any_value(x.v) AS issue, any_value(y.v) AS priority
FROM a JOIN (SELECT sample, string_agg(v, '|' ORDER BY pos) AS v FROM i GROUP BY 1) x ON x.sample = a.sample JOIN (SELECT sample, string_agg(v, '|' ORDER BY pos) AS v FROM p GROUP BY 1) y ON y.sample = a.sample GROUP BY a.sample""")
def suspicious_serials(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = audit_candidates(spark, sf_dir).withColumn("at", F.col("truth") * 10 + F.col("predicted"))
    return P.suspicious_serials(candidates, ["sample"], "at").withColumn("mean_suspect_score", F.round("mean_suspect_score", 9))
