"""Recordings as files and their register: names, listings, one file per serial, pruning, augmented names."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: How names of recordings end, plain and packed.
PLAIN, PACKED = ".tdms", ".tdms.zst"


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_packed(path: Column) -> Column:
    return F.endswith(F.lower(path), F.lit(PACKED))


def is_plain(path: Column) -> Column:
    return F.endswith(F.lower(path), F.lit(PLAIN))


def suffix(path: Column) -> Column:
    """The ending of a recording, of other files what follows the last dot, with the dot."""
    other = F.regexp_extract(file_name(path), r"(?<=.)(\.[^.]+)$", 1)
    return F.when(is_packed(path), PACKED).when(is_plain(path), PLAIN).otherwise(other)


def logical_stem(path: Column) -> Column:
    """The file's name without its ending, the same for the plain and the packed form."""
    name = file_name(path)
    return F.left(name, F.length(name) - F.length(suffix(path)))


def packed_path(path: Column) -> Column:
    """Where the packed form of a file is."""
    return F.when(is_packed(path), path).when(is_plain(path), F.concat(path, F.lit(".zst"))).otherwise(F.concat(path, F.lit(PACKED)))


def _logical_path(path: Column) -> Column:
    return F.left(path, F.length(path) - F.length(suffix(path)))


def is_recording(path: Column, packed: bool = True) -> Column:
    """Whether a path is a recording's, with no hidden part; without packed only plain ones count."""
    kind = is_plain(path) | is_packed(path) if packed else is_plain(path)
    return kind & ~F.rlike(path, F.lit(r"(^|/)\.[^/]"))


def listing(spark: SparkSession, root: str, packed: bool = True) -> DataFrame:
    """path, relative_path, line (the first folder), modified and bytes of the recordings below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/") + "/"
    relative = F.substring_index(F.col("path"), base, -1)
    found = files.where(is_recording(F.col("path"), packed)).select("path", relative.alias("relative_path"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
    return found.withColumn("line", F.substring_index("relative_path", "/", 1))


def folder_counts(files: DataFrame) -> DataFrame:
    """Files, packed and plain ones and bytes per line, and over all lines (line null)."""
    path = F.col("relative_path")
    counts = [F.count("*").alias("files"), F.count_if(is_packed(path)).alias("packed"), F.count_if(is_plain(path)).alias("plain"), F.sum("bytes").alias("bytes")]
    return files.groupingSets([["line"], []], "line").agg(*counts)


def one_per_serial(files: DataFrame, registered: DataFrame) -> DataFrame:
    """The file that each serial keeps: the registered one, else the first by path; in place of a plain file its packed form, if there is one.

    Returns sn, relative_path, upgraded, skipped (files left out)."""
    both = registered.select("sn", "relative_path", F.lit(0).alias("_new")).unionByName(files.select("sn", "relative_path", F.lit(1).alias("_new")))
    path = F.col("relative_path")
    forms = both.groupBy("sn", _logical_path(path).alias("_logical")).agg(
        F.min(F.struct("_new", "relative_path")).alias("first"), F.min(F.when((F.col("_new") == 1) & is_packed(path), path)).alias("packed"), F.count_distinct("relative_path").alias("n")
    )
    kept = forms.groupBy("sn").agg(F.min_by(F.struct(F.col("first.relative_path").alias("path"), "packed"), "first").alias("k"), F.sum("n").alias("n"))
    upgraded = is_plain(F.col("k.path")) & F.col("k.packed").isNotNull()
    return kept.select("sn", F.when(upgraded, F.col("k.packed")).otherwise(F.col("k.path")).alias("relative_path"), upgraded.alias("upgraded"), (F.col("n") - 1 - upgraded.cast("int")).alias("skipped"))


#: Files whose names' parts one task sorts.
FILES = 10_000


def by_name_part(serials: DataFrame, files: DataFrame) -> DataFrame:
    """For each sn the file whose stem contains it; of several the shortest name, then the first path.

    Parts of stems that are as long as some serial are joined by equality, so no pair that does not match is looked at.
    Each task keeps the best file of every part of its FILES files or so, so a short serial that most stems hold is no task's alone."""
    wanted = serials.select("sn").where("sn <> ''").distinct()
    lengths = wanted.agg(F.collect_set(F.length("sn")).alias("_lengths"))
    stem = F.regexp_replace(file_name(F.col("path")), r"(?<=.)\.[^.]+$", "")
    places = lambda n: F.sequence(F.lit(1), F.length("_stem") - n + 1)
    of_length = lambda n: F.when(F.length("_stem") >= n, F.transform(places(n), lambda p: F.substring(F.col("_stem"), p, n))).otherwise(F.array().cast("array<string>"))
    dealt = files.select("path").repartition(1 + files.count() // FILES, "path")
    parts = dealt.select("path", stem.alias("_stem")).join(F.broadcast(lengths)).select("path", F.explode(F.array_distinct(F.flatten(F.transform("_lengths", of_length)))).alias("sn"))
    best = parts.groupBy("sn").agg(F.min(F.struct(F.length(file_name(F.col("path"))).alias("n"), "path"))["path"].alias("path"))
    return best.join(wanted, "sn", "left_semi")


def pruned(samples: DataFrame, events: DataFrame, present: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The samples that have a file, and the events of these."""
    kept = samples.join(present.select(*keys).distinct(), list(keys), "left_semi")
    return kept, events.join(kept.select("sample_pk"), "sample_pk", "left_semi")


def rewritten(manifest: DataFrame, rows: DataFrame, root: str = "", lines: Sequence[str] = ()) -> DataFrame:
    """The register with rows in place of all that lie in the scope: below the root and of the lines, where these are given."""
    inside = F.lit(True)
    if root:
        inside &= F.trim(F.coalesce("storage_root", F.lit(""))) == root
    if lines:
        inside &= F.trim(F.coalesce("line", F.lit(""))).isin(*lines)
    return manifest.where(~inside).unionByName(rows)


@F.pandas_udf(StringType())
def composed(names: pd.Series) -> pd.Series:
    """Names in Unicode's composed form, in which an accent and its letter are one character."""
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def same_names(files: DataFrame) -> DataFrame:
    """Names that several files have, in composed form, with their paths in order, the largest groups first."""
    found = files.groupBy(composed(file_name(F.col("path"))).alias("name")).agg(F.count("*").alias("files"), F.array_join(F.array_sort(F.collect_list("path")), "|").alias("paths"))
    return found.where("files > 1").orderBy(F.desc("files"), "name")


def augmented(sn: Column, path: Column, index: Column) -> Column:
    """struct(sn, name) of an augmented recording: the serial gets aug, three digits and six of the path's SHA-1."""
    new = F.concat(F.coalesce(sn, F.lit("")), F.lit("aug"), F.lpad(index.cast("string"), 3, "0"), F.left(F.sha1(path.cast("binary")), F.lit(6)))
    stem = logical_stem(path)
    at = F.instr(stem, sn)
    inside = F.concat(F.substring(stem, F.lit(1), at - 1), new, F.substring(stem, at + F.length(sn), F.length(stem)))
    name = F.when((F.length(sn) > 0) & (at > 0), inside).otherwise(F.concat(stem, F.lit("_"), new))
    return F.struct(new.alias("sn"), F.concat(name, F.lit(PLAIN)).alias("name"))


def augment_plan(folders: DataFrame) -> DataFrame:
    """One row per copy to make, path and index from 1: of folders that overlap the largest count of a file holds."""
    counts = folders.groupBy("path").agg(F.max("copies").alias("copies")).where("copies >= 1")
    return counts.select("path", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("index"))
