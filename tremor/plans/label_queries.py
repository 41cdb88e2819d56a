"""Queries on the label store and its changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import source_category, source_rank
from ..operators import labels as L
from ..operators import registry as R
from ..sources.proxies import EVENTS_SQL, SAMPLES_SQL, label_events, samples, table
from .registry import query

_E, _S = f"WITH {EVENTS_SQL}", f"WITH {SAMPLES_SQL}, {EVENTS_SQL}"
_STATE = """st AS (
  SELECT sample_pk, CASE WHEN ne > 0 THEN 'expert' WHEN no = 0 THEN 'unlabeled' WHEN no = 1 THEN 'operator_single' WHEN ns > 1 THEN 'operator_conflict' ELSE 'operator_consistent' END AS label_state FROM (
    SELECT sample_pk, count(*) FILTER (WHERE category = 'expert') AS ne, count(*) FILTER (WHERE category = 'operator') AS no,
           count(DISTINCT CASE WHEN category = 'operator' THEN result_key || '/' || reason_key END) AS ns FROM ev GROUP BY sample_pk))"""


@query(f"""{_S}, x AS (SELECT *, row_number() OVER (PARTITION BY sample_pk ORDER BY timestamp DESC, id DESC) AS n FROM ev WHERE status = 'confirmed')
SELECT s.line, coalesce(x.reason_key, '') AS reason_key, count(*) AS n FROM samples s LEFT JOIN x ON s.sample_pk = x.sample_pk AND x.n = 1 GROUP BY ALL""")
def latest_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = L.latest_confirmed(label_events(spark, sf_dir)).select("sample_pk", "reason_key")
    joined = samples(spark, sf_dir).join(newest, "sample_pk", "left")
    return joined.groupBy("line", F.coalesce("reason_key", F.lit("")).alias("reason_key")).agg(F.count("*").alias("n"))


@query(f"""{_S} SELECT line, count(*) AS n FROM samples s WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.sample_pk = s.sample_pk AND status = 'confirmed') GROUP BY line""")
def unlabeled_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    confirmed = label_events(spark, sf_dir).where("status = 'confirmed'")
    return samples(spark, sf_dir).join(confirmed, "sample_pk", "left_anti").groupBy("line").agg(F.count("*").alias("n"))


@query(f"""{_S} SELECT ev.id, s.line, s.sn, ev.source, ev.status FROM ev JOIN samples s ON s.sample_pk = ev.sample_pk WHERE s.line IN ('BUILDING', 'MACHINERY') AND ev.status IN ('confirmed', 'pending')""")
def filtered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = label_events(spark, sf_dir).where(F.col("status").isin("confirmed", "pending"))
    return events.join(samples(spark, sf_dir).where(F.col("line").isin("BUILDING", "MACHINERY")), "sample_pk").select("id", "line", "sn", "source", "status")


@query(f"""{_E} SELECT source, category, CASE category WHEN 'expert' THEN 0 WHEN 'operator' THEN 1 WHEN 'model' THEN 2 ELSE 99 END AS rank, status, count(*) AS n FROM ev GROUP BY ALL""")
def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = source_category(F.col("source"))
    return label_events(spark, sf_dir).groupBy("source", kind.alias("category"), source_rank(kind).alias("rank"), "status").agg(F.count("*").alias("n"))


@query(f"""{_E}, {_STATE} SELECT label_state, count(*) AS n FROM st GROUP BY label_state""")
def label_status_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.resolve(label_events(spark, sf_dir)).groupBy("label_state").agg(F.count("*").alias("n"))


@query(f"""{_E}, g AS (SELECT sample_pk, timestamp, count(*) FILTER (WHERE category = 'expert') AS ne, count(*) FILTER (WHERE category = 'operator') AS no,
      count(DISTINCT CASE WHEN category = 'operator' THEN result_key || '/' || reason_key END) AS ns FROM ev GROUP BY ALL),
s AS (SELECT sample_pk, timestamp, CASE WHEN ne > 0 THEN 'expert' WHEN no = 0 THEN 'unlabeled' WHEN no = 1 THEN 'operator_single' WHEN ns > 1 THEN 'operator_conflict' ELSE 'operator_consistent' END AS label_state FROM g),
n AS (SELECT *, row_number() OVER (PARTITION BY sample_pk, timestamp, category ORDER BY id DESC) AS k FROM ev)
SELECT s.sample_pk, s.timestamp, s.label_state, n.result_key, n.reason_key FROM s LEFT JOIN n ON n.sample_pk = s.sample_pk AND n.timestamp = s.timestamp AND n.k = 1
 AND n.category = CASE s.label_state WHEN 'expert' THEN 'expert' WHEN 'operator_consistent' THEN 'operator' END""")
def training_label_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample's labels of each day, so that all states occur."""
    return L.resolve(label_events(spark, sf_dir), ["sample_pk", "timestamp"])


@query(f"""{_E}, g AS (SELECT sample_pk, timestamp, arg_max(reason_key, id) FILTER (WHERE category = 'expert') AS expert, arg_min(reason_key, id) FILTER (WHERE category = 'operator') AS op,
  count(DISTINCT CASE WHEN category = 'operator' THEN reason_key END) AS n, arg_max(reason_key, id) AS newest FROM ev GROUP BY ALL)
SELECT sample_pk, timestamp, coalesce(expert, CASE WHEN n > 1 THEN op END, newest) AS reason_key FROM g""")
def effective_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.effective_reason(label_events(spark, sf_dir), ["sample_pk", "timestamp"])


@query(f"""{_E} SELECT sample_pk, id, source FROM (SELECT *, row_number() OVER (PARTITION BY sample_pk ORDER BY timestamp DESC NULLS LAST, CASE category WHEN 'expert' THEN 0 WHEN 'operator' THEN 1 WHEN 'model' THEN 2 ELSE 99 END, id) AS n FROM ev) WHERE n = 1""")
def source_rank_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.ranked_latest(label_events(spark, sf_dir)).select("sample_pk", "id", "source")


@query(f"""{_E} SELECT sample_pk, id FROM (SELECT *, row_number() OVER (PARTITION BY sample_pk ORDER BY CAST(timestamp AS VARCHAR) DESC, id DESC) AS n FROM ev) WHERE n = 1""")
def text_latest_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.latest(label_events(spark, sf_dir), ["sample_pk"], [F.col("timestamp").cast("string").desc(), F.desc("id")]).select("sample_pk", "id")


@query(f"""{_E} SELECT sample_pk, id FROM (SELECT *, row_number() OVER (PARTITION BY sample_pk ORDER BY CASE WHEN id % 4 > 0 THEN timestamp END DESC NULLS LAST, id DESC) AS n FROM ev) WHERE n = 1""")
def dedup_keep_latest_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = label_events(spark, sf_dir).withColumn("parsed", F.when(F.col("id") % 4 > 0, F.col("timestamp")))
    return L.latest(events, ["sample_pk"], [F.desc_nulls_last("parsed"), F.desc("id")]).select("sample_pk", "id")


@query(f"""{_E} SELECT id, sample_pk, source FROM (SELECT *, row_number() OVER (PARTITION BY sample_pk, timestamp, source ORDER BY id DESC) AS n FROM ev) WHERE n = 1 OR source NOT IN ('expert', 'operator', 'model')""")
def same_day_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.same_day_replaced(label_events(spark, sf_dir)).select("id", "sample_pk", "source")


@query(f"""{_S}, new AS (SELECT s_suppkey * 31 AS sample_pk, 'new' AS line, CAST(s_nationkey AS VARCHAR) AS reference, CAST(s_suppkey AS VARCHAR) AS sn, 'up' AS direction FROM supplier)
SELECT coalesce(n.sample_pk, o.sample_pk) AS sample_pk, coalesce(n.line, o.line) AS line, coalesce(o.reference, n.reference) AS reference, coalesce(n.sn, o.sn) AS sn, coalesce(n.direction, o.direction) AS direction FROM samples o FULL JOIN new n ON o.sample_pk = n.sample_pk""")
def upsert_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as newly registered samples: some replace known ones, some are new."""
    key = F.col("s_suppkey")
    new = table(spark, sf_dir, "supplier").select(
        (key * 31).alias("sample_pk"), F.lit("new").alias("line"), F.col("s_nationkey").cast("string").alias("reference"), key.cast("string").alias("sn"), F.lit("up").alias("direction")
    )
    return L.upserted(samples(spark, sf_dir), new, ["sample_pk"], kept=["reference"])


@query(f"""{_S}, new AS (SELECT * FROM samples WHERE line = 'BUILDING' AND direction = 'up')
SELECT s.sample_pk, s.line, CASE WHEN s.line <> 'BUILDING' OR n.sample_pk IS NOT NULL THEN 1 ELSE 0 END AS is_active FROM samples s LEFT JOIN new n ON s.sample_pk = n.sample_pk""")
def replace_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = samples(spark, sf_dir).withColumn("is_active", F.lit(1))
    new = samples(spark, sf_dir).where("line = 'BUILDING' AND direction = 'up'")
    return L.replaced_in_scope(old, new, ["sample_pk"]).select("sample_pk", "line", "is_active")


@query(f"""{_E}, a AS (SELECT sample_pk, requested, reason_key FROM ev WHERE category = 'operator'), b AS (SELECT sample_pk, requested, reason_key FROM ev WHERE category <> 'operator')
SELECT sample_pk, requested, reason_key, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.sample_pk = b.sample_pk AND a.requested IS NOT DISTINCT FROM b.requested AND a.reason_key = b.reason_key)) GROUP BY ALL""")
def import_dedup_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events: those of operators as stored ones, all others as the batch."""
    columns = ["sample_pk", "requested", "reason_key"]
    events = label_events(spark, sf_dir)
    of_operators = source_category(F.col("source")) == "operator"
    return L.imported(events.where(of_operators).select(columns), events.where(~of_operators).select(columns), columns).groupBy(columns).agg(F.count("*").alias("n"))


@query(f"""{_S}, l AS (SELECT sample_pk, CASE WHEN reference > '15' THEN line END AS line, sn, reference AS label FROM samples WHERE reference <> '7' AND direction = 'up')
SELECT s.sample_pk, coalesce(a.label, b.label) AS label FROM (SELECT * FROM samples WHERE direction = 'up') s LEFT JOIN l a ON a.line = s.line AND a.sn = s.sn LEFT JOIN l b ON b.line IS NULL AND b.sn = s.sn""")
def label_fallback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = samples(spark, sf_dir).where("direction = 'up'")
    found = up.where("reference <> '7'").select(F.when(F.col("reference") > "15", F.col("line")).alias("line"), "sn", F.col("reference").alias("label"))
    return L.with_fallback(up, found, ["line", "sn"], ["sn"], ["label"]).select("sample_pk", "label")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 50 > 0 THEN o_orderdate END DESC NULLS FIRST, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def newest_manifest_nulls_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = table(spark, sf_dir, "orders").withColumn("created", F.when(F.col("o_orderkey") % 50 > 0, F.col("o_orderdate")))
    return R.newest(manifest, ["o_custkey"], "created", "o_orderkey").select("o_custkey", "o_orderkey")


@query("""WITH s AS (SELECT *, strlen(text) AS size FROM documents) SELECT sha1, size, count(*) AS files, min(doc_id) AS kept FROM (SELECT sha1(text) AS sha1, size, doc_id FROM s) GROUP BY ALL HAVING count(*) > 1""".replace("sha1(text)", "md5(text)").replace("sha1", "digest"))
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    groups = R.content_duplicates(docs, "doc_id", "text")
    return groups.join(docs.select(F.col("doc_id").alias("kept"), F.md5(F.col("text").cast("binary")).alias("digest")), "kept").select("digest", F.col("size").cast("long").alias("size"), "files", "kept")


@query("""WITH o AS (SELECT o_custkey, o_orderdate, count(*) AS n, min(o_orderpriority) AS p FROM orders GROUP BY ALL HAVING count(*) = 1),
w AS (SELECT o_custkey, o_orderdate, CASE WHEN o_totalprice > 200000 THEN 'moved/' || o_orderpriority ELSE o_orderpriority END AS p FROM orders WHERE o_orderstatus <> 'P'), n AS (SELECT o_custkey, o_orderdate, min(p) AS p FROM w GROUP BY ALL HAVING count(*) = 1)
SELECT o.o_custkey, CAST(CAST(o.o_orderdate AS DATE) AS VARCHAR) AS day, o.p AS old_path, n.p AS new_path FROM o JOIN n ON o.o_custkey = n.o_custkey AND o.o_orderdate = n.o_orderdate WHERE o.p <> n.p""")
def rename_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as the old manifest; those no longer pending, the dear ones moved, as the new one."""
    orders, path = table(spark, sf_dir, "orders"), F.col("o_orderpriority")
    new = orders.where("o_orderstatus <> 'P'").withColumn("o_orderpriority", F.when(F.col("o_totalprice") > 200000, F.concat(F.lit("moved/"), path)).otherwise(path))
    return R.renamed(orders, new, ["o_custkey", "o_orderdate"], "o_orderpriority").select("o_custkey", F.to_date("o_orderdate").cast("string").alias("day"), "old_path", "new_path")


@query("""WITH d AS (SELECT o_custkey, o_orderpriority, 1 AS d FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_custkey, o_orderpriority, -1 FROM orders WHERE o_orderstatus <> 'F')
SELECT o_custkey, o_orderpriority, CASE WHEN sum(d) > 0 THEN 'removed' ELSE 'added' END AS change, CAST(abs(sum(d)) AS BIGINT) AS times FROM d GROUP BY o_custkey, o_orderpriority HAVING sum(d) <> 0""")
def bag_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return R.bag_difference(*(orders.where(F.col("o_orderstatus") != gone).select("o_custkey", "o_orderpriority") for gone in ("P", "F")))


@query("""SELECT DISTINCT c_custkey AS sn, 'left' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_acctbal > 0 UNION ALL SELECT DISTINCT o_custkey, 'right' FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def consistency_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unmatched(table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("sn")), table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("sn")), "sn")


@query(f"""{_S}, k AS (SELECT DISTINCT sn FROM samples WHERE line <> 'BUILDING') SELECT k.sn, d.direction, EXISTS (SELECT 1 FROM samples s WHERE s.line <> 'BUILDING' AND s.sn = k.sn AND s.direction = d.direction) AS is_input FROM k, (VALUES ('up'), ('down')) d(direction)""")
def complete_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.completed(samples(spark, sf_dir).where("line <> 'BUILDING'"), "sn", "direction")
