"""What there is to train on and to review: distributions, options, mixed labels, lists with a row per event."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TYPICAL, norm_text, to_int

#: What counts for a reference that a row lacks, one that no register has, and a model that none names.
EMPTY_REFERENCE, UNKNOWN_REFERENCE, NO_MODEL = "<EMPTY_reference>", "<UNKNOWN_reference>", "未配置模型"
#: Fixed value: a label without reason and result.
NO_LABEL = "未标"


def latest_labels(events: DataFrame, confirmed: bool = True, key: str = "sample_pk") -> DataFrame:
    """The newest event of each sample, of the confirmed ones or of all."""
    rows = events.where("status = 'confirmed'") if confirmed else events
    by = Window.partitionBy(key).orderBy(F.desc("timestamp"), F.desc("id"))
    return rows.withColumn("_k", F.row_number().over(by)).where("_k = 1").drop("_k")


def distribution(manifest: DataFrame, labels: DataFrame, order: str, models: DataFrame | None = None) -> DataFrame:
    """Per line and reference its files, labels, labelled serials and how often each label occurs; with models (line, reference, model_name) also the model.

    A label's reference is that of the register's last row for its line and serial."""
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows = manifest.select(text("line").alias("line"), text("sn").alias("sn"), text("reference").alias("reference"), F.col(order).alias("_order"))
    files = rows.withColumn("reference", F.when(F.col("reference") == "", EMPTY_REFERENCE).otherwise(F.col("reference"))).groupBy("line", "reference").agg(F.count("*").alias("files"))
    known = rows.where("line <> '' AND sn <> '' AND reference <> ''").groupBy("line", "sn").agg(F.max_by("reference", "_order").alias("reference"))
    name = F.coalesce(*(norm_text(F.col(c)) for c in ("reason_name", "reason_key", "result_name", "result_key") if c in labels.columns), F.lit(NO_LABEL))
    own = labels.select(text("line").alias("line"), text("sn").alias("sn"), name.alias("label")).join(known, ["line", "sn"], "left").withColumn("reference", F.coalesce("reference", F.lit(UNKNOWN_REFERENCE)))
    sums = own.groupBy("line", "reference").agg(F.count("*").alias("labels"), F.count_distinct(F.when(F.col("sn") != "", F.col("sn"))).alias("labeled_serials"))
    kinds = own.groupBy("line", "reference", "label").agg(F.count("*").alias("n")).groupBy("line", "reference").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "label"))), lambda x: F.struct(x.label.alias("label"), (-x.k).alias("count"))).alias("label_counts"))
    out = files.join(sums, ["line", "reference"], "full").join(kinds, ["line", "reference"], "left")
    out = out.select("line", "reference", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("files", "labels", "labeled_serials")), "label_counts")
    if models is None:
        return out
    return out.join(models.select("line", "reference", "model_name"), ["line", "reference"], "left").withColumn("model_name", F.coalesce(norm_text(F.col("model_name")), F.lit(NO_MODEL)))


def by_model(found: DataFrame) -> DataFrame:
    """A distribution per line and model."""
    return found.groupBy("line", "model_name").agg(F.count("*").alias("references"), *(F.sum(c).alias(c) for c in ("files", "labels", "labeled_serials")))


def mixed_channels(labels: DataFrame, keys: Sequence[str], result: str = "result_key", joined: Sequence[str] = ()) -> DataFrame:
    """Recordings whose channels have several results, with these in order and those columns that are named, each value once."""
    once = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c)))), "|").alias(f"{c}s")
    found = labels.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_distinct(F.when(F.col(result) != "", F.col(result))).alias("results"), once(result), *(once(c) for c in joined))
    return found.where("results > 1")


def available_reasons(features: DataFrame, names: Mapping[int, str], order: str) -> DataFrame:
    """Numbers of reasons among feature rows, how often, and their name: the first that a row gives, else the rules', else the number."""
    number = to_int(F.col("reason_id").cast("string"))
    given = norm_text(F.col("reason_name")) if "reason_name" in features.columns else F.lit(None).cast("string")
    rows = features.select(number.alias("reason_id"), given.alias("given"), F.col(order).alias("_order")).where("reason_id IS NOT NULL")
    rules = F.create_map(*(F.lit(x) for kv in names.items() for x in kv)) if names else F.lit(None).cast("map<int,string>")
    sums = rows.groupBy("reason_id").agg(F.min_by(F.col("given"), F.when(F.col("given").isNotNull(), F.col("_order"))).alias("given"), F.count("*").alias("reason_count"))
    return sums.select("reason_id", F.coalesce("given", rules[F.col("reason_id")], F.col("reason_id").cast("string")).alias("reason_name"), "reason_count")


def options(manifest: DataFrame) -> DataFrame:
    """What training data can be chosen by: lines, line/reference and folders, each once."""
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    path = F.replace(text("relative_path"), F.lit("\\"), F.lit("/"))
    parent = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    folder = F.when(F.rlike(path, F.lit("^/[^/]*$")), "/").otherwise(parent)
    line, reference = text("line"), text("reference")
    kinds = [("line", line), ("reference", F.when((line != "") & (reference != ""), F.concat_ws("/", line, reference)).otherwise("")), ("folder", folder)]
    every = manifest.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds))).alias("x")).select("x.*")
    return every.where("value <> ''").distinct()


def distinct_values(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The values that lists can be filtered by: column and value, blanks left out."""
    every = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), norm_text(F.col(c).cast("string")).alias("value")) for c in columns))).alias("x")).select("x.*")
    return every.where("value IS NOT NULL").distinct().orderBy("column", "value")


def event_rows(samples: DataFrame, events: DataFrame, values: Sequence[str], key: str = "sample_id") -> DataFrame:
    """A row for each event of a sample, in order of time, and one with empty values for a sample without."""
    joined = samples.join(events.select(key, "id", *values), key, "left")
    shown = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in values}
    out = joined.withColumns(shown)
    if "note" in values:
        out = out.withColumn("typical", F.contains("note", F.lit(TYPICAL)))
    return out.withColumn("labeled", norm_text(F.col("reason_name")).isNotNull() if "reason_name" in values else F.col("id").isNotNull())


def overview(view: DataFrame, latest: DataFrame, statuses: DataFrame, key: str = "sample_id") -> DataFrame:
    """Samples, labelled, unlabelled and typical ones, and how many are registered, not registered or missing; statuses: sample and tdms_status."""
    joined = view.select(key).join(latest.select(key, F.coalesce("note", F.lit("")).alias("note"), F.lit(True).alias("_has")), key, "left").join(statuses.select(key, "tdms_status"), key, "left")
    status = F.coalesce("tdms_status", F.lit("missing"))
    has = F.coalesce("_has", F.lit(False))
    return joined.agg(F.count("*").alias("total"), F.count_if(has).alias("labeled"), F.count_if(~has).alias("unlabeled"), F.count_if(F.contains("note", F.lit(TYPICAL))).alias("typical"), *(F.count_if(status == s).alias(s) for s in ("registered", "unregistered", "missing")))
