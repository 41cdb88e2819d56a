"""Queries on files of recordings and their register, on samples of bounded size and on what reviewers see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels as L
from ..operators import recordings as R
from ..operators import sampling as P
from ..operators import views as V
from ..sources.proxies import EVENTS_SQL, SAMPLES_SQL, label_events, samples, table
from .registry import query

_E, _S = f"WITH {EVENTS_SQL}", f"WITH {SAMPLES_SQL}, {EVENTS_SQL}"
_DIE = "CAST(('0x' || substr(md5(vec_id || ':{}'), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"

#: Parts as files: lines by size, some hidden, in four kinds of file.
_FILES_SQL = """files AS (SELECT p_partkey, 'L' || (p_size % 5) AS line, 'C' || (p_partkey // 2) AS sn, p_size AS bytes, 'L' || (p_size % 5) || '/' || CASE WHEN p_size % 7 = 0 THEN '.old/' ELSE '' END || 'C' || (p_partkey // 2) || '_' || p_partkey AS base,
 CASE p_partkey % 4 WHEN 0 THEN '.tdms' WHEN 1 THEN '.tdms.zst' WHEN 2 THEN '.TDMS' ELSE '.csv' END AS ext FROM part)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    line, sn = F.concat(F.lit("L"), size % 5), F.concat(F.lit("C"), F.floor(key / 2))
    ext = F.when(key % 4 == 0, ".tdms").when(key % 4 == 1, ".tdms.zst").when(key % 4 == 2, ".TDMS").otherwise(".csv")
    path = F.concat(line, F.lit("/"), F.when(size % 7 == 0, ".old/").otherwise(""), sn, F.lit("_"), key, ext)
    return table(spark, sf_dir, "part").select("p_partkey", line.alias("line"), sn.alias("sn"), size.cast("long").alias("bytes"), path.alias("path"))


@query(f"""WITH {_FILES_SQL} SELECT p_partkey, ext = '.tdms.zst' AS packed, lower(ext) = '.tdms' AS plain, CASE WHEN ext = '.TDMS' THEN '.tdms' ELSE ext END AS suffix, split_part(base, '/', -1) AS stem,
 base || CASE ext WHEN '.csv' THEN '.csv.tdms.zst' WHEN '.tdms.zst' THEN ext ELSE ext || '.zst' END AS packed_path, ext <> '.csv' AND base NOT LIKE '%/.old/%' AS recording FROM files""")
def recording_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    parts = {"packed": R.is_packed(p), "plain": R.is_plain(p), "suffix": R.suffix(p), "stem": R.logical_stem(p), "packed_path": R.packed_path(p), "recording": R.is_recording(p)}
    return _files(spark, sf_dir).select("p_partkey", *(c.alias(n) for n, c in parts.items()))


@query(f"""WITH {_FILES_SQL} SELECT line, count(*) AS files, count(*) FILTER (WHERE ext = '.tdms.zst') AS packed, count(*) FILTER (WHERE ext <> '.tdms.zst') AS plain, CAST(sum(bytes) AS BIGINT) AS bytes FROM files
 WHERE ext <> '.csv' AND base NOT LIKE '%/.old/%' GROUP BY GROUPING SETS ((line), ())""")
def folder_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.folder_counts(_files(spark, sf_dir).withColumnRenamed("path", "relative_path").where(R.is_recording(F.col("relative_path"))))


@query("""WITH f AS (SELECT DISTINCT p_partkey // 4 AS sn, 'L/' || (p_partkey // 2) || CASE WHEN p_size % 2 = 0 THEN '.tdms' ELSE '.tdms.zst' END AS p FROM part), r AS (SELECT s_suppkey AS sn, 'L/' || (s_suppkey * 2 + 1) || '.tdms' AS p FROM supplier),
 n AS (SELECT sn, count(*) AS n FROM (SELECT * FROM f UNION SELECT * FROM r) GROUP BY sn), m AS (SELECT sn, min(p) AS p FROM f GROUP BY sn), b AS (SELECT sn, coalesce(r.p, m.p) AS p, n FROM n LEFT JOIN r USING (sn) LEFT JOIN m USING (sn)),
 u AS (SELECT b.*, b.p LIKE '%.tdms' AND z.p IS NOT NULL AS upgraded FROM b LEFT JOIN f AS z ON z.sn = b.sn AND z.p = b.p || '.zst')
SELECT sn, CASE WHEN upgraded THEN p || '.zst' ELSE p END AS relative_path, upgraded, n - 1 - CAST(upgraded AS INTEGER) AS skipped FROM u""")
def one_file_per_serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    ext = F.when(F.col("p_size") % 2 == 0, ".tdms").otherwise(".tdms.zst")
    files = table(spark, sf_dir, "part").select(F.floor(key / 4).alias("sn"), F.concat(F.lit("L/"), F.floor(key / 2), ext).alias("relative_path"))
    registered = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sn"), F.concat(F.lit("L/"), F.col("s_suppkey") * 2 + 1, F.lit(".tdms")).alias("relative_path"))
    return R.one_per_serial(files, registered)


@query("""WITH f AS (SELECT p_brand || '/' || p_name || '_' || p_partkey || '.tdms' AS path, p_name || '_' || p_partkey AS stem FROM part), w AS (SELECT DISTINCT CAST(s_suppkey AS VARCHAR) AS sn FROM supplier)
SELECT sn, path FROM (SELECT sn, path, row_number() OVER (PARTITION BY sn ORDER BY length(stem), path) AS n FROM w JOIN f ON contains(stem, sn)) WHERE n = 1""")
def file_by_name_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit("/"), "p_name", F.lit("_"), F.col("p_partkey"), F.lit(".tdms")).alias("path"))
    return R.by_name_part(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("sn")), files)


@query(f"""{_S}, k AS (SELECT sample_pk, line FROM samples WHERE sample_pk IN (SELECT o_custkey FROM orders)) SELECT k.sample_pk, k.line, count(e.id) AS n FROM k LEFT JOIN ev AS e USING (sample_pk) GROUP BY ALL""")
def prune_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are the files that are present."""
    present = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample_pk"))
    kept, events = R.pruned(samples(spark, sf_dir), label_events(spark, sf_dir), present, ["sample_pk"])
    return kept.join(events.groupBy("sample_pk").agg(F.count("*").alias("n")), "sample_pk", "left").select("sample_pk", "line", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT o_orderkey AS id, o_orderstatus AS line, o_orderpriority AS storage_root FROM orders WHERE NOT (o_orderpriority = '1-URGENT' AND o_orderstatus IN ('F', 'P')) UNION ALL SELECT c_custkey, 'F', '1-URGENT' FROM customer""")
def rewrite_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("line"), F.col("o_orderpriority").alias("storage_root"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("F").alias("line"), F.lit("1-URGENT").alias("storage_root"))
    return R.rewritten(manifest, rows, "1-URGENT", ["F", "P"])


@query("SELECT p_name AS name, count(*) AS files, string_agg(p_partkey || '/' || p_name, '|' ORDER BY p_partkey || '/' || p_name) AS paths FROM part GROUP BY p_name HAVING count(*) > 1")
def same_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.same_names(table(spark, sf_dir, "part").select(F.concat(F.col("p_partkey"), F.lit("/"), "p_name").alias("path")))


@query(f"""WITH {_FILES_SQL}, t AS (SELECT *, sn || 'aug' || lpad(CAST(bytes AS VARCHAR), 3, '0') || substr(sha1(base || ext), 1, 6) AS new FROM files) SELECT p_partkey, new AS sn, new || '_' || p_partkey || '.tdms' AS name FROM t""")
def augmented_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("p_partkey", R.augmented(F.col("sn"), F.col("path"), F.col("bytes")).alias("a")).select("p_partkey", "a.*")


@query("SELECT l_partkey AS path, CAST(unnest(generate_series(1, max(l_linenumber))) AS INTEGER) AS index FROM lineitem GROUP BY l_partkey")
def augment_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.augment_plan(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path"), F.col("l_linenumber").alias("copies")))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label")


_PLACED = f"t AS (SELECT vec_id, label, {_DIE.format(1)} AS d1, row_number() OVER (PARTITION BY label ORDER BY {_DIE.format(0)}, vec_id) AS n, count(*) OVER (PARTITION BY label) AS c, count(*) OVER () AS t FROM embeddings)"


@query(f"WITH {_PLACED}, s AS (SELECT * FROM t WHERE n <= greatest(1, ceil(100 * c / t))) SELECT vec_id, label FROM (SELECT *, row_number() OVER (ORDER BY d1, vec_id) AS m FROM s) WHERE m <= 100")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.stratified(_vectors(spark, sf_dir), "label", 100, "vec_id")


@query(f"""WITH {_PLACED}, q AS (SELECT greatest(1, 104 // (SELECT count(DISTINCT label) FROM t)) AS q), f AS (SELECT t.*, n <= q AS first FROM t, q), r AS (SELECT *, row_number() OVER (PARTITION BY first ORDER BY d1, vec_id) AS m, count(*) FILTER (WHERE first) OVER () AS p FROM f)
SELECT vec_id, label FROM r WHERE first OR m <= 104 - p""")
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.balanced(_vectors(spark, sf_dir), "label", 104, "vec_id")


@query(f"""WITH s AS (SELECT vec_id, label, CASE WHEN embedding[1] > 0 THEN 'train' ELSE 'validation' END AS split FROM embeddings), t AS (SELECT *, row_number() OVER (PARTITION BY split, label ORDER BY {_DIE.format(0)}, vec_id) AS n FROM s)
SELECT vec_id, CAST(label AS VARCHAR) AS label, CASE WHEN split = 'train' AND ((label = 0 AND n > 3) OR label = 2) THEN 'test' ELSE split END AS split FROM t""")
def remainder_to_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), F.when(F.col("embedding")[0] > 0, "train").otherwise("validation").alias("split"))
    return P.remainder_to_test(rows, "label", {"0": 3, "1": -1, "2": 0}, "vec_id")


def _keys() -> list[str]:
    return ["l_orderkey", "l_linenumber", "l_partkey"]


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity = 22 THEN 2 ELSE 1 END AS label FROM lineitem WHERE l_quantity IN (20, 21, 22)")
def mapped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("reason_id", F.when(F.col("l_quantity") == 5, "none").otherwise(F.col("l_quantity").cast("string")))
    return P.mapped_labels(rows, "reason_id", {20: 1, 21: 1, 22: 2}).select(*_keys(), "label")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_tax AS s0, 0.0::DOUBLE AS s1, l_discount AS s2 FROM lineitem")
def aligned_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = P.aligned_scores(F.array("l_discount", "l_tax"), [2, 0], [0, 1, 2])
    return table(spark, sf_dir, "lineitem").select(*_keys(), *(scores[k].alias(f"s{k}") for k in range(3)))


@query("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F", count(*) FILTER (WHERE o_orderstatus = 'O') AS "O", count(*) FILTER (WHERE o_orderstatus = 'P') AS "P" FROM orders GROUP BY ALL""")
def label_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.crosstab(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("SELECT CAST(greatest(1, floor(quantile_cont(len(string_split(text, chr(10))), 0.95))) AS INTEGER) AS length FROM documents")
def length_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as values of a signal."""
    return P.length_target(table(spark, sf_dir, "documents").select(F.split("text", "\n").alias("signal")), "signal")


_NAMES = ("mel_band_", "mel_shock_", "dwt_", "time_", "peak_", "level")


def _feature() -> Column:
    return F.concat(F.element_at(F.array(*(F.lit(n) for n in _NAMES)), F.col("p_size") % 6 + 1), F.col("p_partkey"))


@query("""WITH r AS (SELECT CASE p_size % 6 WHEN 0 THEN 'mel_band' WHEN 1 THEN 'mel_shock' WHEN 2 THEN 'dwt' WHEN 3 THEN 'time' WHEN 4 THEN 'peak' ELSE 'other' END AS family, p_partkey + 1 AS place, p_retailprice AS i FROM part)
SELECT family, count(*) AS features, count(*) FILTER (WHERE place <= 20) AS among_top, round(avg(i), 6) AS mean_importance, round(sum(i), 4) AS sum_importance, min(-i) AS best_score FROM r GROUP BY family""")
def feature_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranking = table(spark, sf_dir, "part").select(_feature().alias("feature"), (F.col("p_partkey") + 1).alias("place"), F.col("p_retailprice").alias("importance"), (-F.col("p_retailprice")).alias("score"))
    return P.group_summary(ranking).withColumns({"mean_importance": F.round("mean_importance", 6), "sum_importance": F.round("sum_importance", 4)})


@query("""WITH c AS (SELECT p_partkey, unnest(CASE p_size % 4 WHEN 0 THEN ['A_up', 'A_down'] WHEN 1 THEN ['B', 'C'] WHEN 2 THEN ['[]'] ELSE [p_name] END) AS sample_id FROM part) SELECT * FROM c""")
def exploded_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_size") % 4
    cell = F.when(kind == 0, '["A_up", "A_down"]').when(kind == 1, "['B','C']").when(kind == 2, "[]").otherwise(F.col("p_name"))
    return V.exploded_samples(table(spark, sf_dir, "part").select("p_partkey", cell.alias("sample_id")))


@query(f"{_E} SELECT id, true AS any_source, category = 'expert' AS by_expert, source = 'visitor' AS by_visitor FROM ev")
def source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("source")
    return label_events(spark, sf_dir).select("id", V.source_matches(s, " All ").alias("any_source"), V.source_matches(s, "Expert").alias("by_expert"), V.source_matches(s, "visitor").alias("by_visitor"))


@query(f"""{_E}, v AS (SELECT ev.*, event_type || CASE WHEN value > 50 THEN ' [[prototype]]' ELSE '' END AS note FROM ev JOIN events ON id = event_id)
SELECT sample_pk, id, source, note FROM (SELECT *, row_number() OVER (PARTITION BY sample_pk ORDER BY CAST(timestamp AS VARCHAR) DESC, id DESC) AS n FROM v WHERE contains(note, '[[prototype]]')) WHERE n = 1""")
def typical_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat("event_type", F.when(F.col("value") > 50, " [[prototype]]").otherwise("")).alias("note"))
    return V.tagged(label_events(spark, sf_dir).join(notes, "id"), "[[prototype]]").select("sample_pk", "id", "source", "note")


@query(f"""{_S}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_pk ORDER BY CAST(timestamp AS VARCHAR) DESC, id DESC) AS n FROM ev WHERE status = 'confirmed') WHERE n = 1 AND sample_pk IN (SELECT o_custkey FROM orders))
SELECT s.sample_pk, CASE WHEN l.id IS NULL THEN 'old' ELSE l.reason_key END AS reason_key, CASE WHEN l.id IS NULL THEN '' ELSE l.result_key END AS result_key FROM samples AS s LEFT JOIN l USING (sample_pk)""")
def write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders name the samples that changed."""
    view = samples(spark, sf_dir).select("sample_pk", F.lit("old").alias("reason_key"))
    changed = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample_pk"))
    return V.written_back(view, L.latest_confirmed(label_events(spark, sf_dir)), ["reason_key", "result_key"], "sample_pk", changed)


@query(f"""{_E}, p AS (SELECT sample_pk, count(DISTINCT result_key || '/' || reason_key) AS variants, string_agg(DISTINCT result_key || '/' || reason_key, '; ' ORDER BY result_key || '/' || reason_key) AS labels FROM ev GROUP BY sample_pk HAVING count(DISTINCT result_key || '/' || reason_key) > 1),
 l AS (SELECT *, row_number() OVER (PARTITION BY sample_pk ORDER BY timestamp DESC, CASE category WHEN 'expert' THEN 0 WHEN 'operator' THEN 1 WHEN 'model' THEN 2 ELSE 99 END, id) AS n FROM ev)
SELECT sample_pk, CAST(variants AS INTEGER) AS variants, labels, result_key AS latest_result_key, reason_key AS latest_reason_key, timestamp AS latest_timestamp, source AS latest_source FROM p JOIN l USING (sample_pk) WHERE n = 1""")
def inconsistent_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.inconsistent_samples(label_events(spark, sf_dir), "sample_pk", "id")


@query("""SELECT c_custkey, o_orderkey AS latest_o_orderkey, o_orderstatus AS latest_o_orderstatus FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) ON c_custkey = o_custkey AND n = 1""")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as projects, orders as their runs."""
    runs = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return V.with_latest_run(table(spark, sf_dir, "customer").select("c_custkey"), runs, "c_custkey", "o_orderdate", "o_orderkey", ["o_orderkey", "o_orderstatus"])


@query("""WITH s AS (SELECT c_custkey AS k, count(*) AS s FROM customer GROUP BY 1), f AS (SELECT o_custkey AS k, count(*) AS f FROM orders GROUP BY 1), b AS (SELECT k, coalesce(s, 0) AS n_samples, coalesce(f, 0) AS n_features FROM s FULL JOIN f USING (k))
SELECT k AS sample_pk, n_samples, n_features, CASE WHEN n_samples > 1 THEN 'repeated_sample' WHEN n_features > 1 THEN 'repeated_feature' WHEN n_samples > n_features THEN 'missing_feature' ELSE 'extra_feature' END AS problem FROM b WHERE n_samples <> n_features OR n_samples > 1""")
def alignment_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.misaligned(samples(spark, sf_dir), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample_pk")), ["sample_pk"])


@query("""SELECT line, reference, CAST(GROUPING(line, reference) AS BIGINT) AS grain, count(*) AS n, count(DISTINCT sn) AS serials FROM (SELECT p_type AS line, p_brand AS reference, CASE WHEN p_size > 5 THEN p_name END AS sn FROM part) GROUP BY GROUPING SETS ((line), (line, reference))""")
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.manifest_counts(table(spark, sf_dir, "part").select(F.col("p_type").alias("line"), F.col("p_brand").alias("reference"), F.when(F.col("p_size") > 5, F.col("p_name")).otherwise(" NaN ").alias("sn")))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE o_totalprice <= 50000) AS missing, count(*) > 0 AND count(*) FILTER (WHERE o_totalprice <= 50000) = 0 AS complete FROM orders WHERE o_orderstatus = 'F'")
def rate_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.when(F.col("o_totalprice") > 50000, "51200").when(F.col("o_totalprice") > 20000, "")
    return V.rate_probe(table(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("is_active"), rate.alias("sampling_rate")))


@query("""WITH f AS (SELECT CAST(l_partkey AS VARCHAR) AS sn, min(l_orderkey * 10 + l_linenumber) AS f FROM lineitem GROUP BY 1), p AS (SELECT sn, CAST(row_number() OVER (ORDER BY f, sn) AS INTEGER) AS place FROM f)
SELECT CAST(l_partkey AS VARCHAR) AS sn, l_orderkey AS sample_id, l_discount AS score_gap, l_tax AS confidence, place FROM lineitem JOIN p ON sn = CAST(l_partkey AS VARCHAR) WHERE place <= 20""")
def review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("sn"), F.col("l_orderkey").alias("sample_id"), F.col("l_discount").alias("score_gap"), F.col("l_tax").alias("confidence"), F.col("l_quantity").alias("true_probability"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at")
    )
    return V.review_rows(rows, "at", 20).select("sn", "sample_id", "score_gap", "confidence", "place")
