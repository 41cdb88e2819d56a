"""Queries on counts, distributions, consistency, text rules and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import labels as L
from ..operators import stats as S
from ..sources.proxies import EVENTS_SQL, SAMPLES_SQL, label_events, samples, table
from .registry import query

_E, _S = f"WITH {EVENTS_SQL}", f"WITH {SAMPLES_SQL}, {EVENTS_SQL}"


@query(f"""{_S} SELECT count(*) AS events, count(*) FILTER (WHERE status = 'confirmed') AS confirmed, count(*) FILTER (WHERE status = 'unconfirmed') AS unconfirmed, count(*) FILTER (WHERE status = 'pending') AS pending,
 count(*) FILTER (WHERE status = 'rejected') AS rejected, count(DISTINCT sample_pk) AS labelled, count(DISTINCT reason_key) AS reasons, count(DISTINCT source) AS sources FROM ev""")
def catalog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = [F.count_if(F.col("status") == s).alias(s) for s in ("confirmed", "unconfirmed", "pending", "rejected")]
    distinct = [F.count_distinct(c).alias(a) for c, a in (("sample_pk", "labelled"), ("reason_key", "reasons"), ("source", "sources"))]
    return label_events(spark, sf_dir).agg(F.count("*").alias("events"), *by, *distinct)


@query(f"""{_S} SELECT line, reference, CAST(GROUPING(line, reference) AS BIGINT) AS grain, count(*) AS n FROM samples GROUP BY GROUPING SETS ((line), (reference), (line, reference), ())""")
def line_reference_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.distribution(samples(spark, sf_dir), [["line"], ["reference"], ["line", "reference"], []])


@query(f"""{_E} SELECT result_key, reason_key, status, CAST(GROUPING(result_key, reason_key, status) AS BIGINT) AS grain, count(*) AS n FROM ev GROUP BY GROUPING SETS ((result_key), (reason_key), (result_key, status))""")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.distribution(label_events(spark, sf_dir), [["result_key"], ["reason_key"], ["result_key", "status"]])


@query("""WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY ALL)
SELECT o_custkey, o_orderpriority, n, n_values FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, f) AS k, count(*) OVER (PARTITION BY o_custkey) AS n_values FROM c) WHERE k = 1""")
def majority_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.majority(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", F.col("o_orderkey"))


@query(f"""{_S} SELECT s.line, s.sn, count(DISTINCT reason_key) AS n_values, count(*) AS n_rows, string_agg(DISTINCT reason_key, '|' ORDER BY reason_key) AS values FROM ev JOIN samples s ON s.sample_pk = ev.sample_pk WHERE category = 'expert' GROUP BY s.line, s.sn HAVING count(DISTINCT reason_key) > 1""")
def inconsistent_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = label_events(spark, sf_dir).where(T.source_category(F.col("source")) == "expert").join(samples(spark, sf_dir), "sample_pk")
    return S.inconsistent(events, ["line", "sn"], "reason_key")


@query(f"""{_S}, g AS (SELECT sample_pk, timestamp, count(*) FILTER (WHERE category = 'expert') AS ne, count(*) FILTER (WHERE category = 'operator') AS no,
 count(DISTINCT CASE WHEN category = 'operator' THEN result_key || '/' || reason_key END) AS ns FROM ev GROUP BY ALL)
SELECT reference, count(*) AS samples, count(*) FILTER (WHERE ne > 0) AS expert, count(*) FILTER (WHERE ne = 0 AND no > 1 AND ns = 1) AS operator_consistent, count(*) FILTER (WHERE ne = 0 AND no > 1 AND ns > 1) AS operator_conflict,
 count(*) FILTER (WHERE ne = 0 AND no = 1) AS operator_single, count(*) FILTER (WHERE coalesce(ne, 0) = 0 AND coalesce(no, 0) = 0) AS unlabeled FROM samples s LEFT JOIN g ON g.sample_pk = s.sample_pk GROUP BY reference""")
def reference_label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of all samples, each on every day that it has events."""
    found = L.resolve(label_events(spark, sf_dir), ["sample_pk", "timestamp"])
    states = samples(spark, sf_dir).join(found, "sample_pk", "left").withColumn("label_state", F.coalesce("label_state", F.lit("unlabeled")))
    return S.state_counts(states, ["reference"])


@query(f"""{_E}, c AS (SELECT source, reason_key AS name, count(*) AS n FROM ev GROUP BY ALL) SELECT source, name, n, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, name) - 1 AS INTEGER) AS place FROM c""")
def nested_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = S.cell_distribution(label_events(spark, sf_dir), "source", "reason_key")
    return cells.select("source", F.posexplode("cells").alias("place", "c")).select("source", "place", "c.*")


@query(r"""SELECT page_id, split_part(regexp_extract(url, '^https?://[^/]+/([^?]*)', 1), '/', 1) AS lang, CASE WHEN len(string_split(regexp_extract(url, '^https?://[^/]+/([^?]*)', 1), '/')) > 1 THEN string_split(regexp_extract(url, '^https?://[^/]+/([^?]*)', 1), '/')[2] ELSE 'UNKNOWN' END AS sn,
 CASE WHEN len(string_split(regexp_extract(url, '^https?://[^/]+/([^?]*)', 1), '/')) > 2 THEN string_split(regexp_extract(url, '^https?://[^/]+/([^?]*)', 1), '/')[3] ELSE 'UNKNOWN' END AS time FROM pages""")
def filename_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.regexp_extract("url", r"^https?://[^/]+/([^?]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", *(T.name_token(stem, "/", k).alias(n) for k, n in enumerate(("lang", "sn", "time"))))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN '99999999999999' WHEN 0 THEN CASE WHEN o_orderkey % 8 = 0 THEN 'unknown' || strftime(o_orderdate, '%Y%m%d%H%M%S') ELSE strftime(o_orderdate, '%Y%m%d_%H%M%S') END ELSE strftime(o_orderdate, '%Y%m%d_%H%M%S') END AS time FROM orders""")
def time_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, year = (F.date_format("o_orderdate", f) for f in ("ddMMyyyyHHmmss", "yyyyMMddHHmmss"))
    key = F.col("o_orderkey") % 4
    text = F.when(key == 0, F.when(F.col("o_orderkey") % 8 == 0, F.concat(F.lit("unknown"), year)).otherwise(year)).when(key == 1, day).when(key == 2, F.lit(" 99999999999999")).otherwise(F.concat(F.lit("x"), day))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.line_time(text, key != 0).alias("time"))


@query(r"""WITH x AS (SELECT event_id, event_type || ' | fuzzy=' || event_id || ' |torque = ' || (event_id % 3) || '||' || CASE WHEN event_id % 5 = 0 THEN '[[prototype]]' ELSE '' END || 'Reference = x' AS note FROM events)
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '[[prototype]] ' ELSE '' END || trim(string_split(note, '|')[1]) || ' | ' || trim(string_split(note, '|')[3]) AS note FROM x""")
def note_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.when(F.col("event_id") % 5 == 0, T.TYPICAL).otherwise("")
    note = F.concat(F.col("event_type"), F.lit(" | fuzzy="), F.col("event_id"), F.lit(" |torque = "), F.col("event_id") % 3, F.lit("||"), tag, F.lit("Reference = x"))
    return table(spark, sf_dir, "events").select("event_id", T.clean_note(note).alias("note"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, name, value FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS quantity, l_extendedprice AS price, l_tax AS tax FROM lineitem) UNPIVOT (value FOR name IN (quantity, price, tax))""")
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("tax"))
    return rows.unpivot(["l_orderkey", "l_linenumber", "l_partkey"], ["quantity", "price", "tax"], "name", "value")


@query("""SELECT doc_id, CASE WHEN n >= 1024 THEN printf('%.1f KB', n / 1024.0) ELSE printf('%.1f B', n * 1.0) END AS size FROM (SELECT doc_id, strlen(text) AS n FROM documents)""")
def byte_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.byte_size(F.octet_length("text")).alias("size"))


@query("""SELECT p_partkey, (rank() OVER (ORDER BY p_retailprice DESC) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0) / count(*) OVER () AS percent_rank FROM (SELECT p_partkey, round(p_retailprice / 10) AS p_retailprice FROM part)""")
def percent_rank_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.round(F.col("p_retailprice") / 10).alias("p_retailprice"))
    return S.percent_rank_average(rows, "p_retailprice").select("p_partkey", "percent_rank")
