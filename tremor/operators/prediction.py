"""Decisions on recordings and serials, and metrics over splits and seeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .assembly import joined_values
from .learning import decided

#: The class of signals that no model is asked about, and priorities of audits from the first on.
SENSOR_ERROR = "传感器错误"
PRIORITIES = ("P0_critical_false_ok", "P1_false_ok", "P2_false_reject", "P3_false_reject_low_conf", "P3_nok_type_confusion", "P4_other")


def sensor_fault(signal: Column, rate: Column, longest: float, highest_mean: float) -> Column:
    """Whether a signal is empty, longer than so many seconds or too high in the mean."""
    n = F.coalesce(F.size(signal), F.lit(0))
    mean = F.aggregate(signal, F.lit(0.0), lambda a, x: a + x) / n
    return (n <= 0) | (n > rate * longest) | F.coalesce(mean > highest_mean, F.lit(False))


def detail(scores: Column, names: Sequence[str], thresholds: Sequence[float], ok: str, fault: Column) -> Column:
    """The decision by thresholds, the plain one by the highest score, and all scores by name; faulty signals are NOK."""
    labels = F.array(*(F.lit(n) for n in names))
    mtype = decided(scores, names, thresholds, ok)
    at = lambda name: F.element_at(scores, F.array_position(labels, name).cast("int"))
    raw = F.element_at(labels, F.array_position(scores, F.array_max(scores)).cast("int"))
    error = F.lit(SENSOR_ERROR)

    def build(result: Column, name: Column, score: Column, raw_name: Column, raw_score: Column, all_scores: Column) -> Column:
        return F.struct(result.alias("result"), name.alias("mtype"), score.alias("score"), raw_name.alias("raw_mtype"), raw_score.alias("raw_score"), all_scores.alias("scores"))

    sound = build(F.when(mtype == ok, "OK").otherwise("NOK"), mtype, at(mtype), raw, F.array_max(scores), F.map_from_arrays(labels, scores))
    return F.when(fault, build(F.lit("NOK"), error, F.lit(1.0), error, F.lit(1.0), F.create_map(error, F.lit(1.0)))).otherwise(sound)


def serial_result(up: Column, down: Column) -> Column:
    """NOK if either direction is, OK for others, null if neither is known."""
    known = up.isNotNull() | down.isNotNull()
    return F.when(known & (F.coalesce(up == "NOK", F.lit(False)) | F.coalesce(down == "NOK", F.lit(False))), "NOK").when(known, "OK")


def row_label(direction: Column, up: Column, up_type: Column, down: Column, down_type: Column) -> Column:
    """Result and type of a row: its direction's, and where that is none of both the stricter one."""
    filled = lambda x: F.when(x != "", x)
    worst = serial_result(up, down)
    of_fault = F.coalesce(F.when(down == "NOK", filled(down_type)), up_type)
    kind = F.when(worst == "NOK", of_fault).when(worst == "OK", F.coalesce(filled(up_type), down_type))
    pair = lambda result, name: F.struct(result.alias("result"), name.alias("type"))
    return F.when(direction == "up", pair(up, up_type)).when(direction == "down", pair(down, down_type)).otherwise(pair(worst, kind))


def split_metrics(rows: DataFrame, keys: Sequence[str], truth: str, predicted: str, scores: str, names: Sequence[str], ok: str) -> DataFrame:
    """One row of metrics per key, all from one aggregate over true and predicted classes; classes that only occur in scores count for nothing."""
    labels = F.array(*(F.lit(n) for n in names))
    own = F.element_at(F.col(scores), F.array_position(labels, F.col(truth)).cast("int"))
    ranked = F.sort_array(F.col(scores), asc=False)
    tiny = 2.220446049250313e-16
    cells = rows.select(*keys, truth, predicted, (-F.ln(F.least(F.greatest(own, F.lit(tiny)), F.lit(1 - tiny)))).alias("_loss"), ranked[0].alias("_top"), (ranked[0] - ranked[1]).alias("_margin"))
    cells = cells.groupBy(*keys, truth, predicted).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("_loss", "_top", "_margin")))
    sides = cells.select(*keys, F.explode(F.array(F.struct(F.col(truth).alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("claimed")), F.struct(F.col(predicted).alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("claimed")))).alias("s"), F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0).alias("hit"))
    per = sides.groupBy(*keys, "s.label").agg(F.sum("s.support").alias("support"), F.sum("s.claimed").alias("claimed"), (F.sum("hit") / 2).alias("hit"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    f1 = share(2 * F.col("hit"), F.col("support") + F.col("claimed"))
    macro = per.groupBy(*keys).agg(F.avg(share(F.col("hit"), F.col("claimed"))).alias("precision_macro"), F.avg(share(F.col("hit"), F.col("support"))).alias("recall_macro"), F.avg(f1).alias("f1_macro"), (F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1_weighted"))
    n = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    good, called = F.col(truth) == ok, F.col(predicted) == ok
    ratio = lambda a, b: F.when(b > 0, a / b)
    total = cells.groupBy(*keys).agg(
        F.sum("n").alias("samples"), (n(F.col(truth) == F.col(predicted)) / F.sum("n")).alias("accuracy"), ratio(n(good & called), n(good)).alias("ok_recall"), ratio(n(~good & ~called), n(~good)).alias("nok_recall"),
        n(~good & called).alias("false_ok_count"), ratio(n(~good & called), n(~good)).alias("false_ok_rate"), ratio(n(good & ~called), n(good)).alias("false_reject_rate"),
        *((F.sum(c) / F.sum("n")).alias(name) for c, name in (("_loss", "logloss"), ("_top", "max_prob_mean"), ("_margin", "margin_mean"))),
    )
    return total.join(macro, list(keys))


def best_seeds(metrics: DataFrame, split: str = "validation") -> DataFrame:
    """Runs from the best on: least false OK, then most bad parts found, then F1, then seed."""
    return metrics.where(F.col("split") == split).orderBy(F.asc_nulls_last("false_ok_rate"), F.desc_nulls_last("nok_recall"), F.desc_nulls_last("f1_macro"), F.asc("seed"))


def seed_summary(metrics: DataFrame, values: Sequence[str]) -> DataFrame:
    """Mean and standard deviation of every metric over the seeds, per split."""
    long = metrics.unpivot(["split", "seed"], [F.col(v).cast("double").alias(v) for v in values], "metric", "x")
    return long.groupBy("split", "metric").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))


def suspicious_serials(candidates: DataFrame, keys: Sequence[str], order: str, lists: Sequence[str] = ("issue", "priority")) -> DataFrame:
    """Per serial its audit candidates: the first priority, how many call a bad part good, scores, seeds, and what kinds there are."""
    place = F.array_position(F.array(*(F.lit(p) for p in PRIORITIES)), F.col("priority"))
    false_ok = F.col("issue") == "false_ok_NOK_as_OK"
    found = candidates.groupBy(*keys).agg(
        F.element_at(F.array(*(F.lit(p) for p in PRIORITIES)), F.min(F.when(place > 0, place)).cast("int")).alias("audit_priority_top"), F.count_if(false_ok).alias("false_ok_sample_count"), F.count("*").alias("sample_count"),
        F.max("score").alias("max_suspect_score"), F.avg("score").alias("mean_suspect_score"), F.max("seeds").alias("max_error_seed_count"),
    )
    return found.join(joined_values(candidates, keys, lists, order).drop("row_count"), list(keys)).withColumn("has_false_ok", F.col("false_ok_sample_count") > 0)
