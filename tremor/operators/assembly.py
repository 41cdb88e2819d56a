"""What a training set is made of: registered samples of chosen lines, folders and references, their labels and metadata, model labels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_text

#: Columns of which one makes a label.
LABEL_COLUMNS = ("result_key", "result_id", "result_name", "reason_key", "reason_id", "reason_name")
#: Keys and signs of abnormal results.
ABNORMAL_KEYS = ("nok", "ng", "abnormal", "fail", "error")
ABNORMAL_NAMES = "异常|故障|NG|NOK"
#: Reasons that a model learns as one class.
GOOD_IDS, GOOD_NAMES = (-1, 0), ("干扰", "正常", "noisy_normal", "clean_normal")


def _prefix(folder: str) -> str:
    return folder.replace("\\", "/").strip("/") + "/"


def _any(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def selected(manifest: DataFrame, lines: Sequence[str] = (), folders: Sequence[str] = (), references: Sequence[str] = (), key_folders: Sequence[str | tuple[str, str]] = (), line_name: Sequence[str] = ()) -> DataFrame:
    """Rows of a line, below a folder, of a reference (or line/reference) or of a key folder; any of these suffices.

    Without lines, folders and references line_name counts as lines, and without that every row does. A key folder belongs to a line:
    the one given with it or its first part, the second one below prototype."""
    line, reference, path = (F.coalesce(F.trim(c), F.lit("")) for c in ("line", "reference", "relative_path"))
    lines = lines or (() if folders or references else line_name)
    tests = [line.isin(*lines)] if lines else []
    tests += [path.startswith(_prefix(f)) for f in folders]
    for name in references:
        own, _, rest = name.rpartition("/")
        tests.append((reference == rest.strip()) & (line == own.strip()) if own else reference == rest.strip())
    tests = tests or [F.lit(True)]
    for item in key_folders:
        folder, of = (item, "") if isinstance(item, str) else item
        parts = _prefix(folder).strip("/").split("/")
        tests.append(path.startswith(_prefix(folder)) & (line == (of or (parts[1] if parts[0] == "prototype" and len(parts) > 1 else parts[0]))))
    return manifest.where(_any(tests))


def training_samples(samples: DataFrame, manifest: DataFrame) -> DataFrame:
    """Active samples with each distinct place of their recordings; samples or recordings alone are left out."""
    places = ["reference", "time", "relative_path"]
    own = samples.where("is_active = 1").drop(*places)
    return own.join(manifest.select("line", "sn", *places).distinct(), ["line", "sn"]).distinct()


def has_label(rows: DataFrame) -> Column:
    return _any([norm_text(F.col(c).cast("string")).isNotNull() for c in LABEL_COLUMNS if c in rows.columns])


def payload(rows: DataFrame) -> DataFrame:
    """Label columns as text, empty for none; of key and name the one that is missing is the other."""
    text = lambda c: norm_text(F.col(c).cast("string")) if c in rows.columns else F.lit(None).cast("string")
    other = {f"{kind}_{a}": f"{kind}_{b}" for kind in ("result", "reason") for a, b in (("key", "name"), ("name", "key"))}
    return rows.withColumns({c: F.coalesce(text(c), text(other[c]) if c in other else F.lit(""), F.lit("")) for c in LABEL_COLUMNS})


def enriched(rows: DataFrame, view: DataFrame, keys: Sequence[str], values: Sequence[str], order: str) -> DataFrame:
    """rows with values that are empty or missing taken from the last row of view that has the keys."""
    last = view.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_last"))
    joined = rows.join(last, list(keys), "left")
    fill = {v: F.when(norm_text(F.col(v).cast("string")).isNull(), F.coalesce(norm_text(F.col(f"_last.{v}").cast("string")), F.col(v))).otherwise(F.col(v)) if v in rows.columns else F.col(f"_last.{v}") for v in values}
    return joined.withColumns(fill).drop("_last").select(*rows.columns, *(v for v in values if v not in rows.columns))


def abnormal(key: Column, name: Column, id_: Column) -> Column:
    return F.coalesce(F.lower(norm_text(key)).isin(*ABNORMAL_KEYS), F.lit(False)) | F.coalesce(F.rlike(name, F.lit(ABNORMAL_NAMES)), F.lit(False)) | F.coalesce(id_.try_cast("double") == 1, F.lit(False))


def nonstandard(latest: DataFrame, known: Sequence[str]) -> DataFrame:
    """Rows whose reason is none of the known keys, names and aliases in any case; rows without a reason are left out."""
    return latest.where(norm_text(F.col("reason_name")).isNotNull() & ~F.lower(F.trim("reason_name")).isin(*(k.strip().lower() for k in known)))


def model_labels(rows: DataFrame, order: str) -> DataFrame:
    """Per reason the class that a model learns: undisturbed and disturbed good parts are one class, any other reason its own;
    classes are numbered as they first occur and named by their reasons. Rows are counted first; the window sees reasons only."""
    reasons = rows.where("reason_id IS NOT NULL").groupBy("reason_id").agg(F.count("*").alias("n"), F.min(order).alias("first"), F.min_by("reason_name", order).alias("reason_name"))
    name = F.coalesce(norm_text(F.col("reason_name")), F.col("reason_id").cast("string"))
    good = F.col("reason_id").isin(*GOOD_IDS) | name.isin(*GOOD_NAMES)
    reasons = reasons.withColumns({"reason_name": name, "_class": F.when(good, F.lit("good")).otherwise(F.col("reason_id").cast("string"))})
    classes = reasons.groupBy("_class").agg(F.min("first").alias("at"), F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("first", "reason_name"))), lambda r: r["reason_name"])), "_").alias("mtype"))
    numbered = classes.withColumn("mlabel", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("at")) - 1).drop("at")
    return reasons.join(F.broadcast(numbered), "_class").select("reason_id", "reason_name", "n", "mlabel", "mtype")


def joined_values(rows: DataFrame, keys: Sequence[str], values: Sequence[str], order: str) -> DataFrame:
    """Per key and column the distinct non-empty values in the order they occur, joined by bars, and the number of rows.

    Values are reduced to distinct ones before a key's are brought together."""
    long = rows.select(*keys, order, F.explode(F.array(*(F.struct(F.lit(v).alias("c"), norm_text(F.col(v).cast("string")).alias("v")) for v in values))).alias("f")).select(*keys, order, "f.*")
    once = long.groupBy(*keys, "c", "v").agg(F.min(order).alias("at"), F.count("*").alias("n"))
    listed = lambda v: F.array_join(F.transform(F.sort_array(F.collect_list(F.when((F.col("c") == v) & F.col("v").isNotNull(), F.struct("at", "v")))), lambda x: x["v"]), "|")
    return once.groupBy(*keys).agg(F.sum(F.when(F.col("c") == values[0], F.col("n"))).alias("row_count"), *(listed(v).alias(v) for v in values))


def conflicts(rows: DataFrame, keys: Sequence[str], values: Sequence[str], order: str) -> DataFrame:
    """Keys whose rows disagree on the first of the values."""
    return joined_values(rows, keys, values, order).where(F.contains(F.col(values[0]), F.lit("|")))
