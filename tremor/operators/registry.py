"""The register of recordings: newest rows, duplicates, renames, consistency of lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest(rows: DataFrame, keys: Sequence[str], created: str, tie: str) -> DataFrame:
    """The newest row per key, where a missing time is the newest of all."""
    by = Window.partitionBy(*keys).orderBy(F.desc_nulls_first(created), F.desc(tie))
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def content_duplicates(files: DataFrame, key: str, content: str, modified: str | None = None) -> DataFrame:
    """Files of equal content: hashed only where another file has the same size; the oldest by `modified` is kept, of equally old ones the one of least key."""
    kept = F.min(key) if modified is None else F.min(F.struct(F.col(modified).isNull(), modified, key))[key]
    sized = files.withColumn("size", F.octet_length(content))
    several = sized.groupBy("size").agg(F.count("*").alias("_k")).where("_k > 1")
    hashed = sized.join(several, "size").withColumn("sha1", F.sha1(F.col(content).cast("binary")))
    groups = hashed.groupBy("sha1", "size").agg(F.count("*").alias("files"), kept.alias("kept"))
    return groups.where("files > 1")


def renamed(old: DataFrame, new: DataFrame, keys: Sequence[str], path: str) -> DataFrame:
    """Rows whose path changed while all keys stayed, where either side has the keys once."""
    once = lambda rows, name: rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(path).alias(name)).where("_n = 1").drop("_n")
    return once(old, "old_path").join(once(new, "new_path"), list(keys)).where("old_path <> new_path")


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one list has more often than the other, with how often and where."""
    columns = left.columns
    both = left.withColumn("d", F.lit(1)).unionByName(right.withColumn("d", F.lit(-1)))
    found = both.groupBy(*columns).agg(F.sum("d").alias("d")).where("d <> 0")
    return found.select(*columns, F.when(F.col("d") > 0, "removed").otherwise("added").alias("change"), F.abs("d").alias("times"))


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has."""
    here = left.select(key).distinct().join(right, key, "left_anti").withColumn("side", F.lit("left"))
    return here.union(right.select(key).distinct().join(left, key, "left_anti").withColumn("side", F.lit("right")))


def completed(samples: DataFrame, key: str, direction: str, directions: Sequence[str] = ("up", "down")) -> DataFrame:
    """All directions of each serial, those that were missing with is_input false."""
    wanted = samples.select(key).distinct().withColumn(direction, F.explode(F.array(*(F.lit(d) for d in directions))))
    return wanted.join(samples.select(key, direction).distinct().withColumn("_have", F.lit(True)), [key, direction], "left").select(key, direction, F.coalesce("_have", F.lit(False)).alias("is_input"))
