"""What a reviewer works on: exploded lists of samples, filters, tags, labels written back, runs, rows to review."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_text, source_category, source_rank


def exploded_samples(rows: DataFrame, column: str = "sample_id") -> DataFrame:
    """One row per sample where a cell holds a list of them, in brackets and with either quotes; all other cells stay."""
    text = F.trim(F.col(column))
    items = F.when(F.rlike(text, F.lit(r"^\[[\s\S]*\]$")), F.from_json(text, "array<string>"))
    cells = F.when(F.size(items) > 0, items).otherwise(F.array(F.col(column)))
    return rows.withColumn(column, F.explode(cells))


def source_matches(source: Column, wanted: str) -> Column:
    """Whether a source is the wanted one: all, a category of people, or one source by name."""
    want, have = wanted.strip().lower(), F.lower(F.trim(F.coalesce(source, F.lit(""))))
    if want in ("", "all", "全部"):
        return F.lit(True)
    return F.coalesce(source_category(have), F.lit("")) == want if want in ("expert", "operator") else have == want


def tagged(events: DataFrame, tag: str, keys: Sequence[str] = ("sample_pk",)) -> DataFrame:
    """Per sample the newest event whose note has the tag, by time as text, then id."""
    columns = [c for c in events.columns if c not in keys]
    found = events.where(F.contains("note", F.lit(tag))).groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(F.coalesce(F.col("timestamp").cast("string"), F.lit("")), "id")).alias("_e"))
    return found.select(*keys, "_e.*")


def standardized(rows: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("line", "sn", "sample_id")) -> DataFrame:
    """The columns in their order, empty text for those that are missing; rows without a key column raise."""
    missing = [k for k in keys if k not in rows.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in columns))


def written_back(view: DataFrame, latest: DataFrame, columns: Sequence[str], key: str, changed: DataFrame | None = None) -> DataFrame:
    """view with the label columns of the latest labels (one row per key), empty for none in them; samples without a label stay, and with changed all but its keys."""
    for c in columns:
        if c not in view.columns:
            view = view.withColumn(c, F.lit(""))
    found = latest.select(F.col(key).alias("_key"), F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns)).alias("_label"))
    if changed is not None:
        found = found.join(changed.select(F.col(key).alias("_key")).distinct(), "_key", "left_semi")
    joined = view.join(found, F.col(key) == F.col("_key"), "left")
    return joined.withColumns({c: F.when(F.col("_label").isNotNull(), F.col(f"_label.{c}")).otherwise(F.col(c)) for c in columns}).select(*view.columns)


def inconsistent_samples(events: DataFrame, key: str, order: str) -> DataFrame:
    """Samples with more than one pair of result and reason, the pairs in order, and the newest label: by time, then trust, then the first row.

    Events with neither result nor reason do not count; a missing time is the oldest."""
    result, reason = (F.coalesce(norm_text(F.col(c)), F.lit("")) for c in ("result_key", "reason_key"))
    rows = events.where(norm_text(F.col(key).cast("string")).isNotNull() & (F.concat(result, reason) != ""))
    newest = F.struct(F.col("timestamp").isNotNull(), "timestamp", -source_rank(source_category(F.col("source"))), -F.col(order))
    pairs = F.array_sort(F.collect_set(F.concat_ws("/", result, reason)))
    latest = F.struct(result.alias("result_key"), reason.alias("reason_key"), "timestamp", "source")
    found = rows.groupBy(key).agg(pairs.alias("p"), F.max_by(latest, newest).alias("l"))
    return found.where(F.size("p") > 1).select(key, F.size("p").alias("variants"), F.array_join("p", "; ").alias("labels"), *(F.col(f"l.{c}").alias(f"latest_{c}") for c in ("result_key", "reason_key", "timestamp", "source")))


def with_latest_run(projects: DataFrame, runs: DataFrame, project: str, created: str, run: str, values: Sequence[str], succeeded: Column | None = None) -> DataFrame:
    """Projects with values of their newest run, of those that succeeded where that is asked for, the greater run id on ties; null for none."""
    newest = (runs if succeeded is None else runs.where(succeeded)).groupBy(project).agg(F.max(F.struct(created, run, *(v for v in values if v not in (created, run)))).alias("_r"))
    return projects.join(newest.select(project, *(F.col(f"_r.{v}").alias(f"latest_{v}") for v in values)), project, "left")


def current_results(projects: DataFrame, runs: DataFrame, results: DataFrame, project: str, created: str, run: str, succeeded: Column) -> DataFrame:
    """Projects and whether their results are those of the newest run, and that run succeeded; results: project and run."""
    newest = runs.groupBy(project).agg(F.max(F.struct(created, run, succeeded.alias("ok"))).alias("_r"))
    found = projects.join(newest, project, "left").join(results.select(project, F.col(run).alias("_have")), project, "left")
    return found.select(*projects.columns, F.coalesce((F.col("_have") == F.col(f"_r.{run}")) & F.col("_r.ok"), F.lit(False)).alias("current"))


def misaligned(samples: DataFrame, features: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that keep samples and features from being trained on: repeated on a side, or not as often on both."""
    both = samples.select(*keys, F.lit(1).alias("_s"), F.lit(0).alias("_f")).unionByName(features.select(*keys, F.lit(0).alias("_s"), F.lit(1).alias("_f")))
    counts = both.groupBy(*keys).agg(F.sum("_s").alias("n_samples"), F.sum("_f").alias("n_features"))
    s, f = F.col("n_samples"), F.col("n_features")
    problem = F.when(s > 1, "repeated_sample").when(f > 1, "repeated_feature").when(s > f, "missing_feature").when(f > s, "extra_feature")
    return counts.withColumn("problem", problem).where("problem IS NOT NULL")


def manifest_counts(manifest: DataFrame) -> DataFrame:
    """Rows per line, and per line and reference the distinct serials that are not empty."""
    serial = norm_text(F.col("sn").cast("string"))
    return manifest.groupingSets([["line"], ["line", "reference"]], "line", "reference").agg(F.grouping_id("line", "reference").alias("grain"), F.count("*").alias("n"), F.count_distinct(serial).alias("serials"))


def rate_probe(samples: DataFrame) -> DataFrame:
    """Active samples and those of them without a sampling rate; complete if there are some and none lacks it."""
    missing = F.count_if(F.coalesce(F.col("sampling_rate").cast("string"), F.lit("")) == "")
    found = samples.where("is_active = 1").agg(F.count("*").alias("total"), missing.alias("missing"))
    return found.withColumn("complete", (F.col("total") > 0) & (F.col("missing") == 0))


def review_rows(errors: DataFrame, order: str, top: int, by_line: bool = False) -> DataFrame:
    """All wrong rows of the `top` serials that occur first, with the serial's place; rows without a serial are left out.

    Serials of different lines are different ones where by_line says so. errors: sn, score_gap, confidence, true_probability, sample_id and a column of order. Sort by place, then the widest gap."""
    sn = norm_text(F.col("sn").cast("string"))
    own = F.struct(F.coalesce(norm_text(F.col("line").cast("string")), F.lit("")).alias("line"), sn.alias("sn")) if by_line else sn
    named = errors.withColumn("_sn", own).where(sn.isNotNull())
    first = named.groupBy("_sn").agg(F.min(order).alias("_first")).orderBy("_first", "_sn").limit(top)
    place = first.select("_sn", F.row_number().over(Window.orderBy("_first", "_sn")).alias("place"))
    out = named.join(F.broadcast(place), "_sn").drop("_sn")
    return out.orderBy("place", F.desc_nulls_last("score_gap"), F.desc_nulls_last("confidence"), F.asc_nulls_last("true_probability"), F.asc_nulls_last("sample_id"))
