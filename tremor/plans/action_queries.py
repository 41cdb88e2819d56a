"""Queries on reasons, reviewers' actions, the register's paths and the store on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import label_writes as W
from ..operators import learning as M
from ..operators import locations as P
from ..operators import overviews as O
from ..operators import reasons as R
from ..operators import views as V
from ..sources import store as S
from ..sources.proxies import EVENTS_SQL, SAMPLES_SQL, label_events, samples, table
from ..sources.shared import shared_path
from .registry import query

RULES = {
    "results": {"ok": {"id": 0, "name": "good"}, "nok": {"id": 1, "name": "bad"}},
    "reasons": {"r0": {"id": 0, "name": "clean", "alias": ["fine"], "parent": "ok"}, "r1": {"id": 102, "name": "tick", "alias": ["clock"], "parent": "nok"}, "r2": {"id": 103, "name": "friction", "alias": [], "parent": "nok"}},
    "meta": {"legacy_label_to_reason": {7: "r2"}},
}
_E = f"WITH {SAMPLES_SQL}, {EVENTS_SQL}, e AS (SELECT ev.*, s.line, s.sn, s.sn || '_' || s.direction AS sample_id FROM ev JOIN samples AS s USING (sample_pk))"
_RULES_SQL = "rules AS (SELECT * FROM (VALUES ('r0', 0, 'clean', 'ok', 0, 'good'), ('r1', 102, 'tick', 'nok', 1, 'bad'), ('r2', 103, 'friction', 'nok', 1, 'bad')) AS t(key, rid, name, result_key, result_id, result_name))"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).withColumn("sample_id", F.concat_ws("_", "sn", "direction"))
    return rows.select("line", "sn", "sample_id", F.lit(1).alias("is_active"), "sample_pk", "reference", "direction")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = label_events(spark, sf_dir).join(_samples(spark, sf_dir).select("sample_pk", "line", "sn", "sample_id"), "sample_pk")
    return keyed.select("id", "line", "sn", "sample_id", "sample_pk", F.col("timestamp").cast("string").alias("timestamp"), "source", "reason_key", "result_key", F.lit("").alias("note"), "status")


@query(f"""{_E}, {_RULES_SQL}, c AS (SELECT id, CASE id % 6 WHEN 0 THEN reason_key END AS k, CASE id % 6 WHEN 1 THEN 'fine' WHEN 2 THEN 'tick' END AS n, CASE id % 6 WHEN 3 THEN '103.0' WHEN 4 THEN '7' WHEN 5 THEN '9' END AS i FROM e),
f AS (SELECT *, CASE WHEN k IN ('r0', 'r1', 'r2') THEN k WHEN n = 'fine' THEN 'r0' WHEN n = 'tick' THEN 'r1' WHEN i IN ('103.0', '7') THEN 'r2' END AS found FROM c)
SELECT id, coalesce(found, k) AS reason_key, coalesce(CAST(rid AS VARCHAR), i) AS reason_id, coalesce(name, n) AS reason_name, result_key, result_id, result_name, found IS NOT NULL AS known FROM f LEFT JOIN rules ON key = found""")
def resolved_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.col("id") % 6
    rows = _events(spark, sf_dir).select("id", F.when(case == 0, F.col("reason_key")).alias("reason_key"), F.when(case == 1, "fine").when(case == 2, "tick").alias("reason_name"), F.when(case == 3, "103.0").when(case == 4, "7").when(case == 5, "9").alias("reason_id"))
    return R.resolved(rows, R.rules_table(spark, RULES)).select("id", "reason_key", "reason_id", "reason_name", "result_key", "result_id", "result_name", "known")


_NEW = """n AS (SELECT o_orderkey AS place, s.line, s.sn, s.sn || '_' || s.direction AS sample_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS timestamp, CASE o_orderstatus WHEN 'F' THEN 'expert' WHEN 'O' THEN 'operator_9' ELSE 'Model' END AS source, CASE WHEN o_orderkey % 2 = 0 THEN 'r1' ELSE 'r0' END AS reason_key FROM orders JOIN samples AS s ON sample_pk = o_custkey),
nk AS (SELECT *, CASE WHEN source <> 'operator_9' THEN lower(source) END AS bare, CASE WHEN source = 'expert' THEN 'confirmed' ELSE 'unconfirmed' END AS status FROM n),
u AS (SELECT * FROM nk WHERE bare IS NULL UNION ALL SELECT * FROM (SELECT * FROM nk WHERE bare IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample_id, line, sn, timestamp, bare ORDER BY place DESC) = 1)),
t AS (SELECT line, sn, sample_id, CAST(timestamp AS VARCHAR) AS day, lower(source) AS bare, arg_max(id, (timestamp, id)) AS target FROM e WHERE lower(source) = category GROUP BY ALL),
p AS (SELECT u.*, t.target FROM u LEFT JOIN t ON t.line = u.line AND t.sn = u.sn AND t.sample_id = u.sample_id AND t.day = u.timestamp AND t.bare = u.bare)"""


@query(f"""{_E}, {_NEW} SELECT id, sample_id, CAST(timestamp AS VARCHAR) AS timestamp, source, reason_key, status FROM e WHERE id NOT IN (SELECT target FROM p WHERE target IS NOT NULL)
UNION ALL SELECT target, sample_id, timestamp, source, reason_key, status FROM p WHERE target IS NOT NULL
UNION ALL SELECT (SELECT max(id) FROM e) + row_number() OVER (ORDER BY place), sample_id, timestamp, source, reason_key, status FROM p WHERE target IS NULL""")
def added_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("o_orderstatus") == "F", "expert").when(F.col("o_orderstatus") == "O", "operator_9").otherwise("Model")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("place"), F.col("o_custkey").alias("sample_pk"), F.to_date("o_orderdate").cast("string").alias("timestamp"), source.alias("source"), F.when(F.col("o_orderkey") % 2 == 0, "r1").otherwise("r0").alias("reason_key"))
    known = _samples(spark, sf_dir)
    new = orders.join(known.select("sample_pk", "line", "sn", "sample_id"), "sample_pk").drop("sample_pk")
    out, _ = R.added(_events(spark, sf_dir), known.select("line", "sn", "sample_id", "is_active"), new)
    return out.select("id", "sample_id", "timestamp", "source", "reason_key", "status")


@query(f"""{_E}, l AS (SELECT line, sn, sample_id, arg_max(id, (timestamp, id)) AS id FROM e GROUP BY ALL)
SELECT e.id, CASE WHEN l.id IS NOT NULL AND (right(e.sample_id, 2) = 'up') THEN '[[prototype]]' ELSE '' END AS note FROM e LEFT JOIN l ON l.id = e.id""")
def typical_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = _samples(spark, sf_dir).select("line", "sn", "sample_id", (F.col("direction") == "up").alias("typical"))
    return R.typical(_events(spark, sf_dir), flags).select("id", "note")


_MANIFEST = "m AS (SELECT o_orderkey AS n, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END AS line, 'S' || (o_custkey % 400) AS sn, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'R' || (o_orderkey % 7) END AS reference, CASE WHEN o_orderkey % 11 = 0 THEN '/abs' ELSE 'p' || o_orderkey END AS relative_path, 'factory_raw' AS tdms_storage_root FROM orders)"


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("n"), F.when(key % 9 != 0, F.col("o_orderpriority")).alias("line"), F.concat(F.lit("S"), (F.col("o_custkey") % 400).cast("string")).alias("sn"), F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("R"), (key % 7).cast("string"))).alias("reference"),
        F.when(key % 11 == 0, "/abs").otherwise(F.concat(F.lit("p"), key.cast("string"))).alias("relative_path"), F.lit("factory_raw").alias("tdms_storage_root"),
    )


@query(f"""WITH {_MANIFEST}, g AS (SELECT *, lower(line) AS l, lower(sn) AS s, relative_path IN (SELECT 'p' || o_orderkey FROM orders WHERE o_orderstatus = 'F') AS there FROM m WHERE relative_path <> '/abs'),
k AS (SELECT l, s, arg_max(relative_path, (there, n)) AS path FROM g WHERE l IS NOT NULL GROUP BY l, s), b AS (SELECT s, arg_max(relative_path, (there, n)) AS path FROM g GROUP BY s),
v AS (SELECT DISTINCT o_orderpriority AS line, 's' || (o_custkey % 500) AS sn FROM orders)
SELECT v.line, v.sn, '/data/factory_raw/' || coalesce(k.path, b.path) AS path, CASE WHEN coalesce(k.path, b.path) IS NULL THEN 'missing' ELSE 'registered' END AS tdms_status FROM v LEFT JOIN k ON k.l = lower(v.line) AND k.s = v.sn LEFT JOIN b ON b.s = v.sn""")
def resolved_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    present = orders.where("o_orderstatus = 'F'").select(F.concat(F.lit("/data/factory_raw/p"), F.col("o_orderkey").cast("string")).alias("path"))
    view = orders.select(F.col("o_orderpriority").alias("line"), F.concat(F.lit("s"), (F.col("o_custkey") % 500).cast("string")).alias("sn")).distinct()
    return P.resolved_paths(view, _manifest(spark, sf_dir), "n", present, "/data")


@query(f"""WITH {_MANIFEST}, u AS (SELECT o_orderpriority AS line, 's' || (o_custkey % 500) AS sn, max('new/' || o_orderkey) AS path FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL)
SELECT n, m.line, m.sn, reference, coalesce(u.path, relative_path) AS relative_path FROM m LEFT JOIN u ON lower(u.line) = lower(coalesce(m.line, '')) AND u.sn = lower(m.sn)
UNION ALL SELECT NULL, line, sn, NULL, path FROM u WHERE NOT EXISTS (SELECT 1 FROM m WHERE lower(coalesce(m.line, '')) = lower(u.line) AND lower(m.sn) = u.sn)""")
def register_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    updates = orders.select(F.col("o_orderpriority").alias("line"), F.concat(F.lit("s"), (F.col("o_custkey") % 500).cast("string")).alias("sn"), F.concat(F.lit("new/"), F.col("o_orderkey").cast("string")).alias("relative_path"))
    return P.with_paths(_manifest(spark, sf_dir), updates).drop("tdms_storage_root")


@query(f"WITH {SAMPLES_SQL} SELECT line, sn, sn || '_' || direction AS sample_id, CASE line WHEN 'BUILDING' THEN 'new' ELSE reference END AS reference, CAST(2 AS BIGINT) AS version FROM samples")
def store_scope_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples written, those of one line replaced, and the second version read by a store that is opened anew."""
    root, rows = shared_path(spark, "store"), _samples(spark, sf_dir).select("line", "sn", "sample_id", "reference")
    first = S.LabelStore(spark, root).samples
    first.append(rows)
    first.replace(rows.where("line = 'BUILDING'").withColumn("reference", F.lit("new")), ["BUILDING"])
    again = S.LabelStore(spark, root).samples
    return again.read().select("line", "sn", "sample_id", "reference", F.lit(again.versions()[-1]).cast("long").alias("version"))


@query(f"""{_E}, l AS (SELECT sample_pk, arg_max(id, (timestamp, id)) AS id FROM e WHERE status = 'confirmed' GROUP BY sample_pk)
SELECT s.line, s.sn, s.sn || '_' || s.direction AS sample_id, coalesce(CAST(e.timestamp AS VARCHAR), '') AS timestamp, coalesce(e.source, '') AS source, coalesce(e.reason_key, '') AS reason_key, coalesce(e.status, '') AS status, '' AS group_name
FROM samples AS s LEFT JOIN l ON l.sample_pk = s.sample_pk LEFT JOIN e ON e.id = l.id""")
def export_sample_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).select("id", "sample_pk", "timestamp", "source", "reason_key", "status")
    sheet = S.exported_records(_samples(spark, sf_dir), events, "sample_pk")["sample_labels"]
    return sheet.select("line", "sn", "sample_id", "timestamp", "source", "reason_key", "status", "group_name")


_LABELS = f"{_E}, r AS (SELECT *, row_number() OVER (PARTITION BY sample_pk ORDER BY timestamp DESC, id DESC) AS k FROM e WHERE status = 'confirmed'), l AS (SELECT line, sn, coalesce(reason_key, '') AS label FROM r WHERE k = 1)"


@query(f"""{_LABELS}, {_MANIFEST.replace("'S' || (o_custkey % 400)", "CAST(o_custkey // 2 AS VARCHAR)").replace("o_orderpriority", "c_mktsegment").replace("FROM orders", "FROM orders JOIN customer ON c_custkey = o_custkey")},
refs AS (SELECT line, sn, arg_max(reference, n) AS reference FROM m WHERE line IS NOT NULL AND reference <> '' GROUP BY ALL),
f AS (SELECT coalesce(line, '') AS line, CASE WHEN reference = '' THEN '<EMPTY_reference>' ELSE reference END AS reference, count(*) AS files FROM m GROUP BY ALL),
c AS (SELECT l.line, coalesce(refs.reference, '<UNKNOWN_reference>') AS reference, count(*) AS labels, count(DISTINCT l.sn) AS labeled_serials FROM l LEFT JOIN refs ON refs.line = l.line AND refs.sn = l.sn GROUP BY ALL)
SELECT line, reference, coalesce(files, 0) AS files, coalesce(labels, 0) AS labels, coalesce(labeled_serials, 0) AS labeled_serials FROM f FULL JOIN c USING (line, reference)""")
def database_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    manifest = rows.select(key.alias("n"), F.when(key % 9 != 0, F.col("c_mktsegment")).alias("line"), F.floor(F.col("o_custkey") / 2).cast("string").alias("sn"), F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("R"), (key % 7).cast("string"))).alias("reference"))
    labels = O.latest_labels(_events(spark, sf_dir))
    return O.distribution(manifest, labels, "n").select("line", "reference", "files", "labels", "labeled_serials")


@query(f"""{_E} SELECT sn, count(*) AS rows, count(DISTINCT result_key) AS results, string_agg(DISTINCT result_key, '|' ORDER BY result_key) AS result_keys FROM e GROUP BY line, sn HAVING count(DISTINCT result_key) > 1""")
def mixed_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.mixed_channels(_events(spark, sf_dir), ["line", "sn"]).select("sn", "rows", "results", "result_keys")


@query(f"{_E} SELECT CAST(substr(reason_key, 2) AS INTEGER) AS reason_id, CASE substr(reason_key, 2) WHEN '0' THEN 'clean' ELSE substr(reason_key, 2) END AS reason_name, count(*) AS reason_count FROM e GROUP BY ALL")
def available_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select(F.substring("reason_key", 2, 9).alias("reason_id"), F.lit("").alias("reason_name"), "id")
    return O.available_reasons(rows, {0: "clean", 102: "tick"}, "id")


@query(f"WITH {_MANIFEST} SELECT DISTINCT 'line' AS kind, line AS value FROM m WHERE line IS NOT NULL UNION ALL SELECT DISTINCT 'reference', line || '/' || reference FROM m WHERE line IS NOT NULL AND reference <> '' UNION ALL SELECT DISTINCT 'folder', '/' FROM m WHERE relative_path = '/abs'")
def training_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.options(_manifest(spark, sf_dir))


@query(f"{_E} SELECT reason_key AS label, count(*) AS count FROM e WHERE status = 'confirmed' GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 3")
def reason_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.reason_preview(_events(spark, sf_dir), 3)


_RUNS = "r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders), s AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_orderstatus = 'F')"


@query(f"WITH {_RUNS} SELECT c_custkey, s.o_orderkey AS latest_o_orderkey FROM customer LEFT JOIN s ON s.o_custkey = c_custkey AND s.k = 1")
def latest_successful_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return V.with_latest_run(table(spark, sf_dir, "customer").select("c_custkey"), runs, "c_custkey", "o_orderdate", "o_orderkey", ["o_orderkey"], F.col("o_orderstatus") == "F")


@query(f"WITH {_RUNS} SELECT c_custkey, coalesce(s.o_orderkey = r.o_orderkey, false) AS current FROM customer LEFT JOIN r ON r.o_custkey = c_custkey AND r.k = 1 LEFT JOIN s ON s.o_custkey = c_custkey AND s.k = 1")
def result_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the results of a customer's last finished order are those of the newest one."""
    runs = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    done = F.col("o_orderstatus") == "F"
    results = V.with_latest_run(table(spark, sf_dir, "customer").select("c_custkey"), runs, "c_custkey", "o_orderdate", "o_orderkey", ["o_orderkey"], done)
    return V.current_results(table(spark, sf_dir, "customer").select("c_custkey"), runs, results.withColumnRenamed("latest_o_orderkey", "o_orderkey"), "c_custkey", "o_orderdate", "o_orderkey", done)


def _dice_sql(*parts: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


@query(f"""WITH g AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {_dice_sql("vec_id", "3")}, vec_id) - 1 AS at, count(*) OVER (PARTITION BY label) AS n FROM embeddings WHERE label IN (0, 1, 2)),
t AS (SELECT label, any_value(n) AS n, CASE label WHEN 0 THEN -1 WHEN 1 THEN 20 ELSE 90 END AS target FROM g GROUP BY label),
d AS (SELECT label, CAST(floor({_dice_sql("label", "draw", "3")} * n) AS BIGINT) AS at, count(*) AS more FROM (SELECT *, unnest(range(1, greatest(target - n, 0) + 1)) AS draw FROM t) GROUP BY ALL)
SELECT vec_id, label, CAST(CASE WHEN t.target < 0 OR g.at < t.target THEN 1 ELSE 0 END + coalesce(more, 0) AS INTEGER) AS copies FROM g JOIN t USING (label) LEFT JOIN d ON d.label = g.label AND d.at = g.at""")
def rebalance_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One label whole, one cut down, one filled up by draws with replacement."""
    return M.rebalanced_to(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "label", {0: -1, 1: 20, 2: 90}, "vec_id", 3)
