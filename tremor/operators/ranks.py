"""Ranks and draws within groups of any size: a group is dealt by value, so no task holds the whole of it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settle

#: Parts of the range of dice; a group's parts have a 4,096th of its rows each.
DICE_PARTS = 4096


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """left with the columns of right's row of equal keys, null keys alike."""
    named = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys))
    return left.join(named, same, "left").drop(*(f"_key_{k}" for k in keys))


def _before(total: Column, by) -> Column:
    return F.coalesce(F.sum(total).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def below(levels: DataFrame, groups: Sequence[str], value: str, count: str) -> DataFrame:
    """levels with `below`, the sum of count over smaller values of the group, and `total`, over all of it.

    levels has each value of a group once. Rows are dealt by range of group and value, in parts that Spark cuts by a sample
    of what there is, so that no distribution of values fills one part; a part's own sums are taken inside it, and those
    of the parts before from a row for each group and part. Null is the least value, NaN the greatest."""
    order = [*groups, value]
    dealt = settle(levels.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    keys = [*groups, "_part"]
    parts = dealt.groupBy(*keys).agg(F.sum(count).alias("_s"))
    whole = Window.partitionBy(*groups)
    parts = parts.select(*keys, _before(F.col("_s"), whole.orderBy("_part")).alias("_outer"), F.sum("_s").over(whole).alias("total"))
    own = dealt.withColumn("_own", _before(F.col(count), Window.partitionBy(*keys).orderBy(value)))
    return joined(own, parts, keys).withColumn("below", F.col("_outer") + F.col("_own")).drop("_part", "_outer", "_own")


def drawn(rows: DataFrame, group: str, die: Column, tie: str, quota: Callable[[Column], Column]) -> DataFrame:
    """rows with `_all`, the rows of their group, and `_in`, whether they are among its `quota(_all)` rows of least die.

    die is in [0, 1). Counts of its parts tell which parts are wholly in or out; ranks are taken within a part."""
    placed = rows.withColumn("_die", die).withColumn("_part", F.floor(F.col("_die") * DICE_PARTS).cast("int"))
    by = Window.partitionBy(group)
    counts = placed.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    counts = counts.withColumns({"_all": F.sum("_n").over(by), "_left": quota(F.sum("_n").over(by)) - _before(F.col("_n"), by.orderBy("_part"))})
    rank = F.row_number().over(Window.partitionBy(group, "_part").orderBy("_die", tie))
    return joined(placed, counts.drop("_n"), [group, "_part"]).withColumn("_in", (F.col("_left") > 0) & (rank <= F.col("_left"))).drop("_die", "_part", "_left")


def numbered(rows: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """rows with their place in the order, from 0 without gaps: dealt by range, and counted by the sizes of the ranges before.

    Rows that the order does not tell apart get places in any order."""
    dealt = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33).cast("int")
    sizes, upto, begins = sorted((r[0], r[1]) for r in dealt.groupBy(part.alias("_part")).count().collect()), 0, []
    for number, n in sizes:
        begins.append((number, upto))
        upto += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(begins, "_part int, _begin long"))
    placed = dealt.withColumn("_part", part).join(offsets, "_part")
    return placed.select(*(F.col(c) for c in rows.columns), (F.col("_begin") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))
