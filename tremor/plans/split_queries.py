"""Queries on splits and folds by strategy, over customers as samples of lines (segments) and references (nations)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import strategies as S
from ..sources.proxies import table
from .registry import query

_ROWS = "r AS (SELECT c_custkey AS id, c_mktsegment AS line, CAST(c_nationkey AS VARCHAR) AS reference, c_custkey // 2 AS sn, CASE WHEN c_acctbal < 0 THEN 'noise' WHEN c_acctbal > 8000 THEN 'tick' ELSE 'ok' END AS label FROM customer)"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("c_acctbal") < 0, "noise").when(F.col("c_acctbal") > 8000, "tick").otherwise("ok")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("line"), F.col("c_nationkey").cast("string").alias("reference"), F.floor(F.col("c_custkey") / 2).alias("sn"), label.alias("label"))


def _die(*parts: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def _side(name: str, counts: str, share: float, trials: int, seed: int, lines: bool) -> str:
    """CTEs up to one called name: scope, grp, test; counts has scope, grp, label, line, n."""
    part = lambda seen, rows, target: f"2 * abs({rows} - {target}) / greatest({target}, 1) + sum(3 * abs({seen} / greatest({rows}, 1) - full_n / total) + 1.5 * abs({seen} - full_n * {target} / total) / greatest(full_n * {target} / total, 1) + CASE WHEN full_n * {target} / total >= 0.75 AND {seen} = 0 THEN 8 ELSE 0 END)"
    missing = f"""{name}_m AS (SELECT scope, trial, sum(2.0 * (CASE WHEN one THEN 0 ELSE 1 END + CASE WHEN whole THEN 1 ELSE 0 END)) AS missing FROM (
    SELECT s.scope, trial, line, count(DISTINCT s.grp) AS k, bool_or(test) AS one, bool_and(test) AS whole FROM {name}_s AS s JOIN {counts} USING (scope, grp) WHERE line <> '' GROUP BY ALL) WHERE k >= 2 GROUP BY ALL),"""
    return f"""{name}_g AS (SELECT *, count(*) OVER (PARTITION BY scope) AS k FROM (SELECT DISTINCT scope, grp FROM {counts})),
{name}_s AS (SELECT scope, grp, trial, row_number() OVER (PARTITION BY scope, trial ORDER BY {_die("grp", str(seed), "trial")}, grp) <= least(greatest(ceil(k * {share}::DOUBLE - 1e-9), 1), k - 1) AS test
  FROM {name}_g, (SELECT unnest(range({trials})) AS trial) WHERE k > 1),
{name}_l AS (SELECT scope, trial, label, CAST(coalesce(sum(n) FILTER (test), 0) AS DOUBLE) AS t, CAST(coalesce(sum(n) FILTER (NOT test), 0) AS DOUBLE) AS r FROM {name}_s JOIN {counts} USING (scope, grp) GROUP BY ALL),
{name}_t AS (SELECT *, t + r AS full_n, sum(t) OVER w AS test_rows, sum(r) OVER w AS train_rows, sum(t + r) OVER w AS total, sum(t + r) OVER w * {share}::DOUBLE AS target FROM {name}_l WINDOW w AS (PARTITION BY scope, trial)),
{name}_p AS (SELECT scope, trial, {part("r", "train_rows", "(total - target)")} + {part("t", "test_rows", "target")} AS score FROM {name}_t GROUP BY scope, trial, test_rows, train_rows, total, target),
{missing if lines else ""}
{name}_b AS (SELECT scope, arg_min(trial, (round({"score + coalesce(missing, 0)" if lines else "score"}, 9), trial)) AS trial FROM {name}_p {f"LEFT JOIN {name}_m USING (scope, trial)" if lines else ""} GROUP BY scope),
{name} AS (SELECT scope, grp, test FROM {name}_s JOIN {name}_b USING (scope, trial))"""


def _steps(lines: bool, seed: int = 7, trials: int = 32) -> str:
    return f"""c AS (SELECT scope, grp, label, line, count(*) AS n FROM k GROUP BY ALL),
{_side("a", "c", 0.1, trials, seed, lines)},
c2 AS (SELECT c.* FROM c WHERE (scope, grp) NOT IN (SELECT (scope, grp) FROM a WHERE test)),
{_side("b", "c2", 0.125, trials, seed, False)}
SELECT id, CASE WHEN a.test THEN 'test' WHEN b.test THEN 'validation' ELSE 'train' END AS split FROM k LEFT JOIN a USING (scope, grp) LEFT JOIN b USING (scope, grp)"""


@query(f"WITH {_ROWS}, k AS (SELECT *, '' AS scope, line || '::' || reference AS grp FROM r), {_steps(True)}")
def split_reference_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_rows(_rows(spark, sf_dir), "Reference-Out", "label", F.col("id"), seed=7).select("id", "split")


@query(f"WITH {_ROWS}, k AS (SELECT *, '' AS scope, line AS grp FROM r), {_steps(False)}")
def split_line_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_rows(_rows(spark, sf_dir), "line_out", "label", F.col("id"), seed=7).select("id", "split")


@query(f"WITH {_ROWS}, k AS (SELECT *, line || '::' || reference AS scope, line || '::' || reference || '::' || sn AS grp FROM r), {_steps(False, trials=8)}")
def split_reference_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_rows(_rows(spark, sf_dir), "reference_in", "label", F.col("id"), trials=8, seed=7).select("id", "split")


def _proportional(name: str, rows: str, share: float, seed: int) -> str:
    return f"""{name}_n AS (SELECT label, count(*) AS n FROM {rows} GROUP BY label),
{name}_q AS (SELECT *, ceil(sum(n) OVER () * {share}::DOUBLE - 1e-9) AS wanted, ceil(sum(n) OVER () * {share}::DOUBLE - 1e-9) * n / sum(n) OVER () AS exact FROM {name}_n),
{name}_k AS (SELECT label, floor(exact) + CASE WHEN row_number() OVER (ORDER BY floor(exact) - exact, label) <= wanted - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS quota FROM {name}_q),
{name} AS (SELECT {rows}.*, row_number() OVER (PARTITION BY label ORDER BY {_die("id", str(seed))}, CAST(id AS VARCHAR)) <= quota AS test FROM {rows} JOIN {name}_k USING (label))"""


@query(f"WITH {_ROWS}, {_proportional('a', 'r', 0.1, 7)}, p AS (SELECT id, label FROM a WHERE NOT test), {_proportional('b', 'p', 0.125, 8)} SELECT a.id, CASE WHEN a.test THEN 'test' WHEN b.test THEN 'validation' ELSE 'train' END AS split FROM a LEFT JOIN b USING (id)")
def split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split_rows(_rows(spark, sf_dir), "sample-level", "label", F.col("id"), seed=7).select("id", "split")


@query(f"""WITH {_ROWS}, k AS (SELECT id, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY {_die("id", "7")}, CAST(id AS VARCHAR)) AS k FROM r)
SELECT id, CAST(len(list_filter([1, 2, 3, 4], lambda i: n * i // 5 < k)) AS INTEGER) AS fold FROM k""")
def folds_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.folds(_rows(spark, sf_dir), "stratified", "label", F.col("id"), 5, seed=7).select("id", "fold")


@query()
def folds_reference_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.folds(_rows(spark, sf_dir), "reference_in", "label", F.col("id"), 5, seed=7).select("id", "fold")


@query()
def folds_reference_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.folds(_rows(spark, sf_dir), "reference_out", "label", F.col("id"), 5, seed=7).select("id", "fold")


@query()
def split_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    group = S.serial_key(F.col("id"), S.reference_key(F.col("id")))
    return S.pooled_split(rows, group, "label", {"noise": -1, "ok": 200, "tick": 60}, trials=8, seed=7).select("id", "split", "evaluation")
