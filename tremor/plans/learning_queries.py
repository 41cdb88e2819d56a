"""Queries on sampling, splits, decisions, metrics and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import group_key
from ..operators import learning as M
from ..sources.proxies import table
from .registry import query

_DICE = "CAST(('0x' || substr(md5({} || ':0'), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"
_V = [f"v{k}" for k in range(64)]


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("truth"), F.when(F.col("l_linestatus") == "O", "N").when(F.col("l_quantity") % 3 == 0, "R").otherwise("A").alias("predicted"))


_FLAGS = "f AS (SELECT l_returnflag AS truth, CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_quantity % 3 = 0 THEN 'R' ELSE 'A' END AS predicted FROM lineitem)"


@query(f"WITH {_FLAGS} SELECT truth, predicted, count(*) AS n FROM f GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion(_flags(spark, sf_dir), "truth", "predicted")


@query(f"""WITH {_FLAGS}, l AS (SELECT truth AS label FROM f UNION SELECT predicted FROM f), s AS (SELECT label, (SELECT count(*) FROM f WHERE truth = label) AS support, (SELECT count(*) FROM f WHERE truth = label AND predicted = label) AS hit, (SELECT count(*) FROM f WHERE predicted = label) AS claimed FROM l)
SELECT label, support, CASE WHEN claimed > 0 THEN hit / claimed ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall, CASE WHEN support + claimed > 0 THEN 2 * hit / (support + claimed) ELSE 0 END AS f1 FROM s""")
def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.class_metrics(M.confusion(_flags(spark, sf_dir), "truth", "predicted"), "truth", "predicted")


@query(f"""WITH {_FLAGS}, x AS (SELECT truth = 'N' AS t, predicted = 'N' AS p FROM f) SELECT count(*) FILTER (WHERE t AND p) / count(*) FILTER (WHERE t) AS ok_recall, count(*) FILTER (WHERE NOT t AND NOT p) / count(*) FILTER (WHERE NOT t) AS nok_recall,
 count(*) FILTER (WHERE NOT t AND NOT p) / count(*) FILTER (WHERE NOT p) AS nok_precision, count(*) FILTER (WHERE NOT t AND p) AS false_ok, count(*) FILTER (WHERE t AND NOT p) AS false_reject FROM x""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.quality_gate(_flags(spark, sf_dir), F.col("truth") == "N", F.col("predicted") == "N")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount * 5 AS a, l_tax * 6 AS b, 0.3::DOUBLE AS c FROM lineitem), y AS (SELECT *, greatest(a, b) AS m FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN a = m THEN 'ok' WHEN b <= 0.25 THEN 'ok' ELSE 'friction' END AS verdict FROM y""")
def threshold_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.array(F.col("l_discount") * 5, F.col("l_tax") * 6, F.lit(0.3))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", M.decided(scores, ["ok", "friction", "tremble"], [1.0, 0.25, 1.0], "ok").alias("verdict"))


@query("""WITH x AS (SELECT l_linestatus AS g, l_returnflag = 'R' AS p, l_discount AS s FROM lineitem), r AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY s) + (count(*) OVER (PARTITION BY g, s) - 1) / 2.0 AS k FROM x)
SELECT g AS l_linestatus, round((sum(k) FILTER (WHERE p) - count(*) FILTER (WHERE p) * (count(*) FILTER (WHERE p) + 1) / 2.0) / (count(*) FILTER (WHERE p) * count(*) FILTER (WHERE NOT p)), 9) AS auc FROM r GROUP BY g""")
def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("p", F.col("l_returnflag") == "R")
    return M.auc(rows, "l_linestatus", "p", "l_discount").select("l_linestatus", F.round("auc", 9).alias("auc"))


@query(f"""SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_DICE.format('vec_id')}, vec_id) AS n FROM embeddings) WHERE n <= 20""")
def downsample_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.downsampled(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", 20, "vec_id")


@query(f"""SELECT vec_id, label, CAST(copies AS INTEGER) AS copies FROM (SELECT vec_id, label, 120 // c + CASE WHEN n <= 120 % c THEN 1 ELSE 0 END AS copies FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_DICE.format('vec_id')}, vec_id) AS n, count(*) OVER (PARTITION BY label) AS c FROM embeddings)) WHERE copies > 0""")
def rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.rebalanced(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", 120, "vec_id")


_SPLIT = f"""g AS (SELECT o_orderkey, o_custkey, o_orderstatus || '::' || o_orderpriority || '::' || o_custkey AS grp FROM orders), s AS (SELECT *, {_DICE.format('grp')} AS d FROM g),
 p AS (SELECT *, CASE WHEN d < 0.1::DOUBLE THEN 'test' WHEN d < 0.1::DOUBLE + 0.9::DOUBLE * 0.125::DOUBLE THEN 'validation' ELSE 'train' END AS split FROM s)"""


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = group_key(F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_custkey").cast("string"), F.lit(None).cast("string"), F.col("o_orderkey"))
    return M.group_split(table(spark, sf_dir, "orders").withColumn("grp", key), "grp")


@query(f"WITH {_SPLIT} SELECT o_orderkey, grp, split FROM p")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("o_orderkey", "grp", "split")


@query(f"WITH {_SPLIT} SELECT o_custkey, count(DISTINCT split) AS splits FROM p GROUP BY o_custkey HAVING count(DISTINCT split) > 1")
def overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.split_overlap(_split(spark, sf_dir), "o_custkey")


@query(f"WITH {_SPLIT} SELECT o_orderkey, CAST(floor({_DICE.format('grp')} * 5) AS INTEGER) AS fold FROM p")
def cross_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.folds(_split(spark, sf_dir), "grp").select("o_orderkey", "fold")


@query("SELECT label, (SELECT count(*) FROM embeddings) / ((SELECT count(DISTINCT label) FROM embeddings) * count(*)) AS weight FROM embeddings GROUP BY label")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.class_weights(table(spark, sf_dir, "embeddings"), "label")


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("label", *(F.col("embedding")[k].cast("double").alias(v) for k, v in enumerate(_V)))


_COLUMNS = ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS {v}" for k, v in enumerate(_V))
_LONG = f"l AS (SELECT label, feature, x FROM (SELECT label, {_COLUMNS} FROM embeddings) UNPIVOT (x FOR feature IN ({', '.join(_V)})))"


@query(f"""WITH {_LONG}, p AS (SELECT feature, label, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM l GROUP BY ALL), t AS (SELECT feature, avg(x) AS g, count(*) AS n, count(DISTINCT label) AS k FROM l GROUP BY feature)
SELECT feature, round((sum(p.n * (m - g) * (m - g)) / (any_value(k) - 1)) / (sum(p.n * v) / (any_value(t.n) - any_value(k))), 6) AS f FROM p JOIN t USING (feature) GROUP BY feature""")
def anova_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.anova(_values(spark, sf_dir), "label", _V).select("feature", F.round("f", 6).alias("f"))


@query(f"WITH {_LONG} SELECT feature, 0.0::DOUBLE AS nan_rate, count(DISTINCT x) AS nunique, round(var_pop(x), 9) AS variance FROM l GROUP BY feature")
def feature_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.feature_quality(_values(spark, sf_dir), _V).withColumn("variance", F.round("variance", 9))


@query("""WITH w AS (SELECT vec_id, k, CAST(embedding[k + 1] AS DOUBLE) AS x FROM embeddings, range(64) AS r(k)), p AS (SELECT 'v' || l.k AS a, 'v' || h.k AS b, corr(l.x, h.x) AS r FROM w AS l JOIN w AS h ON l.vec_id = h.vec_id AND l.k < h.k GROUP BY l.k, h.k)
SELECT a, b, round(r, 9) AS r FROM p WHERE abs(r) >= 0.05""")
def corr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.correlated_pairs(_values(spark, sf_dir), _V, 0.05).withColumn("r", F.round("r", 9))


@query("""WITH e AS (SELECT l_partkey AS sample, l_linenumber AS seed, l_suppkey % 3 AS truth, l_orderkey % 3 AS predicted, 0.4 + l_discount * 6 AS c, l_tax AS t, CASE WHEN l_returnflag = 'N' THEN 'Expert' ELSE 'operator' END AS source, CASE WHEN l_linestatus = 'O' THEN 'fuzzy=0.8' ELSE 'seen' END AS note FROM lineitem), g AS (
 SELECT sample, truth, predicted, count(DISTINCT seed) AS seeds, avg(c) AS mean_confidence, max(c) AS max_confidence, min(t) AS min_true, min(source) AS source, min(note) AS note FROM e WHERE truth <> predicted GROUP BY ALL),
k AS (SELECT *, CASE WHEN predicted = 0 THEN 'false_ok_NOK_as_OK' WHEN truth = 0 THEN 'false_reject_OK_as_NOK' ELSE 'nok_type_confusion' END AS issue, seeds >= 2 OR mean_confidence >= 0.9 AS sure FROM g)
SELECT sample, truth, predicted, seeds, round(mean_confidence, 9) AS mean_confidence, max_confidence, min_true, issue,
 CASE WHEN predicted = 0 THEN CASE WHEN sure THEN 'P0_critical_false_ok' ELSE 'P1_false_ok' END WHEN truth = 0 THEN CASE WHEN sure THEN 'P2_false_reject' ELSE 'P3_false_reject_low_conf' END ELSE 'P3_nok_type_confusion' END AS priority,
 CAST(CASE WHEN predicted = 0 THEN 100 WHEN truth = 0 THEN 65 ELSE 40 END + least((seeds - 1) * 10, 40) + CASE WHEN mean_confidence >= 0.9 THEN 10 ELSE 0 END + CASE WHEN min_true <= 0.05 THEN 10 ELSE 0 END
  + CASE WHEN lower(source) <> 'expert' THEN 10 ELSE 0 END + CASE WHEN note LIKE '%fuzzy=%' THEN 10 ELSE 0 END AS BIGINT) AS score FROM k""")
def audit_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as decisions of several seeds on parts."""
    errors = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("sample"), F.col("l_linenumber").alias("seed"), (F.col("l_suppkey") % 3).alias("truth"), (F.col("l_orderkey") % 3).alias("predicted"), (F.lit(0.4) + F.col("l_discount") * 6).alias("confidence"),
        F.col("l_tax").alias("true_probability"), F.when(F.col("l_returnflag") == "N", "Expert").otherwise("operator").alias("source"), F.when(F.col("l_linestatus") == "O", "fuzzy=0.8").otherwise("seen").alias("note"),
    )
    return M.audit(errors, ["sample"]).drop("source", "note").withColumn("mean_confidence", F.round("mean_confidence", 9))
