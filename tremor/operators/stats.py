"""Counts, distributions and consistency of labels and registered files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import below, joined


def distribution(rows: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Rows per grouping set, in one pass; columns that a set leaves out are null and `grain` names the set."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    found = rows.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in columns)).agg(F.count("*").alias("n"), F.grouping_id(*columns).alias("grain"))
    return found.select(*columns, "grain", "n")


def majority(rows: DataFrame, keys: Sequence[str], value: str, order: Column) -> DataFrame:
    """The most frequent value of each key, the one seen first on ties, and how many values there are."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    by = Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc("first"))
    ranked = counted.withColumns({"place": F.row_number().over(by), "n_values": F.count("*").over(Window.partitionBy(*keys))})
    return ranked.where("place = 1").select(*keys, value, "n", "n_values")


def inconsistent(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys with more than one value, their rows and their values in order."""
    found = rows.groupBy(*keys).agg(F.count_distinct(value).alias("n_values"), F.count("*").alias("n_rows"), F.array_join(F.array_sort(F.collect_set(value)), "|").alias("values"))
    return found.where("n_values > 1")


def cell_distribution(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One row per key with the histogram of a column as an array of structs, most frequent first."""
    counted = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    cells = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("rank"), F.col(value).alias("name")))), lambda c: F.struct(c["name"].alias("name"), (-c["rank"]).alias("n")))
    return counted.groupBy(key).agg(cells.alias("cells"))


def state_counts(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Exclusive label states per key, with zeros."""
    names = ("expert", "operator_consistent", "operator_conflict", "operator_single", "unlabeled")
    return states.groupBy(*keys).agg(F.count("*").alias("samples"), *(F.count_if(F.col("label_state") == s).alias(s) for s in names))


def percent_rank_average(rows: DataFrame, value: str) -> DataFrame:
    """Rank from the top over the number of rows, ties at their mean rank; counts per value come first, and ranks are dealt by value."""
    counted = rows.groupBy(value).agg(F.count("*").alias("_n")).withColumn("_one", F.lit(0))
    placed = below(counted, ["_one"], value, "_n")
    rank = F.col("total") - F.col("below") - F.col("_n") + 1 + (F.col("_n") - 1) / 2
    return joined(rows, placed.select(value, (rank / F.col("total")).alias("percent_rank")), [value])
