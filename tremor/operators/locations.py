"""Where recordings are: what the register says, what is there, what is missing, and what the register should say."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import line_rules
from .recordings import is_packed

#: The storage of raw recordings, the folder of samples that are shown to reviewers, and beginnings that no relative path has.
RAW, PROTOTYPES, NOT_RELATIVE = "factory_raw", "prototype", ("/", "data_root/")


def _lower(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))


def unregistered(files: DataFrame, channels: DataFrame, manifest: DataFrame, samples: DataFrame, rules: Mapping[str, Mapping[str, Any]], storage: str = RAW, line: str | None = None) -> DataFrame:
    """One row per file with what is missing: in_manifest, in_samples, duplicate (its serial has another registered file), problem.

    files: relative_path; channels: the description of recordings, a row per channel; manifest: tdms_storage_root,
    relative_path, sn; samples: the columns of `line_rules.sample_rows`. A file is in the samples if one of its channels
    is, or, where it has none, if its serial is; a duplicate's serial alone is enough."""
    kept = files.where(~F.startswith("relative_path", F.lit(PROTOTYPES + "/"))) if storage == RAW else files
    told = line_rules.described(kept.select("relative_path").distinct(), rules, "relative_path", line)
    register = manifest.where(F.trim("tdms_storage_root") == storage)
    paths = register.select(F.replace("relative_path", F.lit("\\"), F.lit("/")).alias("relative_path")).distinct().withColumn("_path", F.lit(True))
    serial = lambda rows, name: rows.select(F.trim("sn").alias("sn")).where("sn <> ''").distinct().withColumn(name, F.lit(True))
    sides = F.explode(F.array("up_group", "down_group")).alias("group")
    expected = told.where("problem IS NULL").select("relative_path", "line", "sn", "acc_channel", "up_group", "down_group", sides)
    expected = expected.withColumn("direction", F.when(F.col("group") == F.col("up_group"), "up").otherwise("down"))
    have = channels.select("relative_path", "group", F.col("channel").alias("acc_channel")).distinct()
    expected = expected.join(have, ["relative_path", "group", "acc_channel"])
    sample = samples.select("line", "sn", "sample_id", F.col("group_name").alias("group"), F.col("channel_name").alias("acc_channel")).distinct().withColumn("_sample", F.lit(True))
    expected = expected.withColumn("sample_id", F.concat_ws("_", "sn", "direction")).join(sample, ["line", "sn", "sample_id", "group", "acc_channel"], "left")
    found = expected.groupBy("relative_path").agg(F.max(F.coalesce("_sample", F.lit(False))).alias("_any"))
    rows = told.join(paths, "relative_path", "left").join(serial(register, "_registered"), "sn", "left").join(serial(samples, "_sampled"), "sn", "left").join(found, "relative_path", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = rows.withColumn("duplicate", ~yes("_path") & yes("_registered"))
    in_samples = F.when(F.col("_any").isNull(), yes("_sampled") | F.col("duplicate")).otherwise(yes("_any") | (F.col("duplicate") & yes("_sampled")))
    sound = F.col("problem").isNull()
    return rows.select("relative_path", "line", "sn", F.when(sound, yes("_path")).alias("in_manifest"), F.when(sound, in_samples).alias("in_samples"), (sound & F.col("duplicate")).alias("duplicate"), "problem")


def unregistered_counts(found: DataFrame) -> DataFrame:
    missing = ~F.col("in_manifest") & ~F.col("duplicate")
    return found.agg(F.count("*").alias("files"), F.count_if(missing).alias("missing_manifest"), F.count_if(~F.col("in_samples")).alias("missing_samples"), F.count_if(missing & ~F.col("in_samples")).alias("missing_both"), F.count_if("duplicate").alias("duplicates"), F.count_if(F.col("problem").isNotNull()).alias("failed"))


def usable(path: Column, storage: Column) -> Column:
    """Whether a register's path leads below the data root."""
    low = F.lower(path)
    return (path != "") & (storage != "") & ~F.startswith(low, F.lit(NOT_RELATIVE[0])) & ~F.startswith(low, F.lit(NOT_RELATIVE[1])) & ~F.rlike(path, F.lit(r"^[A-Za-z]:[\\/]"))


def adapter(manifest: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """The register by (line, sn) and by sn, both in lower case: path, storage and reference of the last row that has them, and by sn the first line.

    Rows without a serial are left out; those without a line count by sn only."""
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    storage = F.regexp_replace(F.replace(text("tdms_storage_root"), F.lit("\\"), F.lit("/")), "^/+|/+$", "")
    rows = manifest.select(_lower("line").alias("line"), _lower("sn").alias("sn"), text("relative_path").alias("path"), storage.alias("storage"), text("reference").alias("reference"), F.col(order).alias("_order")).where("sn <> ''")
    good = usable(F.col("path"), F.col("storage"))
    last = lambda c, where: F.max_by(F.when(where, F.col(c)), F.when(where, F.col("_order"))).alias(c)
    values = [last("path", good), last("storage", good), last("reference", F.col("reference") != "")]
    first = F.min_by(F.when(F.col("line") != "", F.col("line")), F.when(F.col("line") != "", F.col("_order"))).alias("line")
    return rows.where("line <> ''").groupBy("line", "sn").agg(*values), rows.groupBy("sn").agg(*values, first)


def resolved_paths(rows: DataFrame, manifest: DataFrame, order: str, present: DataFrame, data_root: str) -> DataFrame:
    """rows with `path` and `tdms_status`: the register's newest path that is there, else its last one, by line and serial, else by serial; missing if it has none.

    present: path of every file that is there. Paths are the data root, the storage of the register's last row for the
    key, and the relative path."""
    root = data_root.rstrip("/")
    by_key, by_sn = adapter(manifest, order)
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    storage = F.regexp_replace(F.replace(text("tdms_storage_root"), F.lit("\\"), F.lit("/")), "^/+|/+$", "")
    candidates = manifest.select(_lower("line").alias("line"), _lower("sn").alias("sn"), text("relative_path").alias("candidate"), storage.alias("own"), F.col(order).alias("_order")).where("sn <> ''")
    candidates = candidates.where(usable(F.col("candidate"), F.col("own"))).drop("own")
    there = present.select("path").distinct().withColumn("_there", F.lit(True))

    def newest(keys: list[str], adapted: DataFrame, name: str) -> DataFrame:
        full = candidates.join(adapted.where("path IS NOT NULL").select(*keys, "storage"), keys)
        full = full.withColumn("path", F.concat_ws("/", F.lit(root), "storage", F.replace("candidate", F.lit("\\"), F.lit("/"))))
        full = full.join(there, "path", "left").withColumn("_there", F.coalesce("_there", F.lit(False)))
        return full.groupBy(*keys).agg(F.max_by("path", F.struct("_there", "_order")).alias(name))

    keyed = rows.withColumns({"_line": _lower("line"), "_sn": _lower("sn")})
    exact = newest(["line", "sn"], by_key, "_exact").withColumnsRenamed({"line": "_line", "sn": "_sn"})
    loose = newest(["sn"], by_sn.drop("line"), "_loose").withColumnRenamed("sn", "_sn")
    out = keyed.join(exact, ["_line", "_sn"], "left").join(loose, "_sn", "left").withColumn("path", F.coalesce("_exact", "_loose"))
    return out.withColumn("tdms_status", F.when(F.col("path").isNull(), "missing").otherwise("registered")).select(*(c for c in rows.columns if c != "path"), "path", "tdms_status")


def with_paths(manifest: DataFrame, updates: DataFrame, storage: str = RAW) -> DataFrame:
    """The register with new paths by (line, sn), whatever their case; keys that it lacks get a row of their own, of several updates of a key the last path counts."""
    key = {"_line": _lower("line"), "_sn": _lower("sn")}
    new = updates.withColumns(key).groupBy("_line", "_sn").agg(F.max(F.struct("relative_path", F.trim("line").alias("line"), F.trim("sn").alias("sn"))).alias("u"))
    old = manifest.withColumns(key)
    changed = old.join(new, ["_line", "_sn"], "left")
    hit = F.col("u").isNotNull()
    replaced = changed.select(*(F.when(hit, F.col("u.relative_path")).otherwise(F.col(c)).alias(c) if c == "relative_path" else F.when(hit, F.lit(storage)).otherwise(F.col(c)).alias(c) if c == "tdms_storage_root" else F.col(c) for c in manifest.columns))
    fresh = new.join(old.select("_line", "_sn").distinct(), ["_line", "_sn"], "left_anti").select(*(F.col(f"u.{c}").alias(c) if c in ("line", "sn", "relative_path") else F.lit(storage if c == "tdms_storage_root" else None).cast(manifest.schema[c].dataType).alias(c) for c in manifest.columns))
    return replaced.union(fresh)


def registered(manifest: DataFrame, files: DataFrame, rules: Mapping[str, Mapping[str, Any]], created: Column, storage: str = RAW, packed_only: bool = True, line: str | None = None) -> DataFrame:
    """The register with a row for each new file, named by its line's rule; known (storage, path) stay as they are.

    Files that are not packed raise where only packed ones may be registered, and so do files whose line cannot be told."""
    path = F.replace("relative_path", F.lit("\\"), F.lit("/"))
    new = files.select(path.alias("relative_path")).distinct()
    known = manifest.where(F.col("tdms_storage_root") == storage).select("relative_path")
    told = line_rules.described(new.join(known, "relative_path", "left_anti"), rules, "relative_path", line)
    bad = F.when(F.lit(packed_only) & ~is_packed(F.col("relative_path")), F.concat(F.lit("not packed: "), "relative_path")).when(F.col("line").isNull(), F.concat(F.lit("the line cannot be told: "), "relative_path"))
    checked = told.withColumn("line", F.when(bad.isNotNull(), F.raise_error(bad).cast("string")).otherwise(F.col("line")))
    own = {"tdms_storage_root": F.lit(storage), "created_time": created}
    return manifest.unionByName(checked.withColumns({k: v for k, v in own.items() if k in manifest.columns}).select(*(F.col(c).cast(manifest.schema[c].dataType).alias(c) if c in (*checked.columns, *own) else F.lit(None).cast(manifest.schema[c].dataType).alias(c) for c in manifest.columns)))


def in_order(manifest: DataFrame, lines: tuple[str, ...]) -> DataFrame:
    """The register in the order in which it is shown: lines as given, then others by name; newest first, then serial and path."""
    place = F.array_position(F.array(*(F.lit(x) for x in lines)), F.col("line")) if lines else F.lit(0)
    return manifest.orderBy(F.when(place > 0, place).otherwise(len(lines) + 1), "line", F.desc_nulls_last("created_time"), "sn", "relative_path")
