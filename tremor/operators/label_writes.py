"""Changes of the label store: each takes the events there are and gives those there are afterwards.

Events have id, sample_pk, timestamp, source, status and values; rows that break a rule raise an error when they are computed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_text
from .labels import status
from .ranks import numbered

#: What an event's status can be.
STATUSES = ("confirmed", "unconfirmed", "pending", "rejected")
#: Fixed value: a label that has no name.
NO_NAME = "未填写"


def checked(new: DataFrame, samples: DataFrame, keys: Sequence[str] = ("line", "sn", "direction")) -> DataFrame:
    """New events with the sample_pk of their sample and the status that their source gives; unknown samples and missing sources raise."""
    found = new.join(samples.select(*keys, "sample_pk"), list(keys), "left")
    known = F.coalesce("sample_pk", F.raise_error(F.concat(F.lit("no such sample: "), F.to_json(F.struct(*keys)))).cast("long"))
    source = F.coalesce(norm_text(F.col("source")), F.raise_error(F.lit("a label event needs a source")).cast("string"))
    requested = F.col("status") if "status" in new.columns else F.lit(None).cast("string")
    return found.withColumns({"sample_pk": known, "source": source}).withColumn("status", status(requested, F.col("source"))).drop(*keys)


def appended(events: DataFrame, new: DataFrame, samples: DataFrame) -> DataFrame:
    """The events and the new ones, which get the ids that follow the highest there is, in order of sample, time, source and their other values."""
    repeated = samples.groupBy("line", "sn", "direction").count().where("count > 1")
    if not repeated.isEmpty():
        raise ValueError(f"samples repeat: {repeated.first().asDict()}")
    above = events.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    own = checked(new, samples)
    own = numbered(own, ["sample_pk", "timestamp", "source", *sorted(c for c in own.columns if c not in ("sample_pk", "timestamp", "source"))], "_n")
    return events.unionByName(own.withColumn("id", F.lit(above + 1) + F.col("_n")).select(events.columns))


def replaced(events: DataFrame, new: DataFrame, samples: DataFrame, of_status: str = "unconfirmed") -> DataFrame:
    """The new events in place of all that have the status; events of other statuses stay."""
    return appended(events.where(F.col("status") != of_status), new, samples)


def updated(events: DataFrame, changes: DataFrame) -> DataFrame:
    """Events with new values by id, their status by the new source; ids that no event has raise."""
    values = [c for c in changes.columns if c not in ("id", "status")]
    marked = changes.select("id", F.struct(*values, status(F.col("status") if "status" in changes.columns else F.lit(None).cast("string"), F.col("source")).alias("status")).alias("_new"))
    joined = events.withColumn("_old", F.lit(True)).join(marked, "id", "full")
    there = F.when(F.col("_old").isNull(), F.raise_error(F.concat(F.lit("no such label event: "), F.col("id").cast("string"))).cast("long")).otherwise(F.col("id")).alias("id")
    pick = lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(*(there if c == "id" else pick(c) if c in (*values, "status") else F.col(c) for c in events.columns))


def confirmed_by(source: Column) -> Column:
    """What confirming makes of an event: confirmed for expert or expert with a sign and a name, by the text alone."""
    return F.when(F.rlike(F.lower(source), F.lit("^expert($|[-_:.])")), "confirmed").otherwise("unconfirmed")


def with_status(events: DataFrame, ids: DataFrame, to: str) -> DataFrame:
    """The status of the events whose id is in ids; confirming depends on the source."""
    if to not in STATUSES:
        raise ValueError(f"no such status: {to}")
    marked = events.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    new = confirmed_by(F.col("source")) if to == "confirmed" else F.lit(to)
    return marked.withColumn("status", F.when(F.col("_hit"), new).otherwise(F.col("status"))).select(events.columns)


def deleted(events: DataFrame, ids: DataFrame) -> DataFrame:
    return events.join(ids, "id", "left_anti").select(events.columns)


def exported(events: DataFrame, samples: DataFrame) -> DataFrame:
    """Every event with what its sample is known by; events without a sample are left out."""
    return events.join(samples, "sample_pk").select(*(c for c in samples.columns if c != "sample_pk"), *events.columns)


def history(events: DataFrame, keys: Sequence[str] = ("sample_pk",)) -> DataFrame:
    """Per sample its events from the oldest on, as a list of (timestamp, id, source, reason_key, status)."""
    return events.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("timestamp", "id", "source", "reason_key", "status"))).alias("history"))


def reason_preview(events: DataFrame, top: int = 20) -> DataFrame:
    """The most frequent labels of confirmed events, by reason's name, else its key, else the result's name."""
    name = F.coalesce(*(F.when(F.col(c) != "", F.col(c)) for c in ("reason_name", "reason_key", "result_name") if c in events.columns), F.lit(NO_NAME))
    counts = events.where("status = 'confirmed'").groupBy(name.alias("label")).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "label").limit(top)


def preview(events: DataFrame) -> DataFrame:
    """Events, samples, first and last day by source and status."""
    return events.groupBy("source", "status").agg(F.count("*").alias("events"), F.count_distinct("sample_pk").alias("samples"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
