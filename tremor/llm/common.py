"""Helpers that the operators share: reading, cutting lineage, bounded batches, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch between the JVM and Python; both sides hold a few at a time, outside the heap, for every running task.
BATCH_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, however long single texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or where that is unset (tests) one of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tremor-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage, by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of one partition of a settled table.
ROWS = 1 << 15


def filling(rows: int) -> int:
    """Partitions for so many rows of a few numbers."""
    return 2 + rows // ROWS


def filled(df: DataFrame) -> DataFrame:
    """df settled, in as many partitions as its rows fill, as a later shuffle costs files for each."""
    df = settle(df)
    return df.coalesce(filling(df.count()))


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same by a compressed table in the shared folder, for wide rows."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df marked for broadcast if it has at most `most` rows of a few numbers; else as it is, to be joined by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def fold_of(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds)).cast("int")


#: Edges of one partition while components are looked for.
EDGES = 1 << 14


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v); root is the component's least node.

    Alternates large-star and small-star steps, each a group-wise minimum and a join, so a node of
    any degree is handled by ordinary aggregation; stops when the star forest no longer changes.
    A round's tables have as many partitions as their edges fill, as each shuffle costs files for each.
    """
    pairs = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    n, seen = pairs.count(), None
    for _ in range(rounds):
        parts = 2 + n // EDGES
        pairs = pairs.coalesce(parts)
        both = pairs.union(pairs.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts).distinct().coalesce(parts)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        pairs = settle(small.coalesce(parts).distinct().coalesce(parts))
        state = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.countDistinct("u")).first())
        if state == seen:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        n, seen = state[0], state
    raise RuntimeError(f"components are not complete after {rounds} rounds")
