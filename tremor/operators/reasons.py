"""Reasons by key, name, alias or number, and what reviewers do with labels: add, confirm, tag, take over a suggestion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import TYPICAL, norm_text, source_category, to_int
from .labels import status
from .ranks import numbered

#: Fixed value: what reviewers see for a reason that no rule has.
UNREGISTERED = "系统未登记类型"
FIELDS = ("reason_key", "reason_id", "reason_name", "result_key", "result_id", "result_name")
_RULE = "key string, id int, name string, aliases array<string>, legacy array<int>, result_key string, result_id int, result_name string"


def rules_table(spark: SparkSession, rules: Mapping[str, Any]) -> DataFrame:
    """One row per reason of rules as their file has them: results, reasons with a parent, and old numbers in meta."""
    results, old = rules.get("results") or {}, (rules.get("meta") or {}).get("legacy_label_to_reason") or {}
    rows = []
    for key, r in (rules.get("reasons") or {}).items():
        parent = results.get(r.get("parent")) or {}
        rows.append((key, r.get("id"), r.get("name"), list(r.get("alias") or []), [int(n) for n, k in old.items() if k == key], r.get("parent"), parent.get("id"), parent.get("name")))
    return spark.createDataFrame(rows, _RULE)


def _ways(rules: DataFrame) -> DataFrame:
    """What a reason can be called: way (0 key, 1 name or alias, 2 number, 3 old number), call, key; the least key where several are called alike."""
    calls = F.concat(
        F.array(F.struct(F.lit(0).alias("way"), F.col("key").alias("call"))), F.transform(F.concat(F.array("name"), "aliases"), lambda a: F.struct(F.lit(1).alias("way"), a.alias("call"))),
        F.array(F.struct(F.lit(2).alias("way"), F.col("id").cast("string").alias("call"))), F.transform("legacy", lambda n: F.struct(F.lit(3).alias("way"), n.cast("string").alias("call"))),
    )
    return rules.select("key", F.explode(calls).alias("c")).where("c.call IS NOT NULL").groupBy("c.way", "c.call").agg(F.min("key").alias("key"))


def resolved(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows with reason and result as the rules have them: by key, then by name or alias, by number, by old number; others stay as they are, and `known` is false."""
    number = to_int(F.col("reason_id").cast("string")).cast("string")
    ways, keyed = F.broadcast(_ways(rules)), rows
    for way, call in enumerate((F.trim("reason_key"), F.trim("reason_name"), number, number)):
        one = ways.where(F.col("way") == way).select(F.col("call").alias(f"_call{way}"), F.col("key").alias(f"_key{way}"))
        keyed = keyed.withColumn("_call", call).join(one, F.col("_call") == F.col(f"_call{way}"), "left").drop("_call", f"_call{way}")
    found = F.coalesce(*(F.col(f"_key{w}") for w in range(4)))
    own = F.broadcast(rules.select(F.col("key").alias("_found"), F.struct(F.col("key").alias("reason_key"), F.col("id").alias("reason_id"), F.col("name").alias("reason_name"), "result_key", "result_id", "result_name").alias("_rule")))
    joined = keyed.withColumn("_own", found).join(own, F.col("_own") == F.col("_found"), "left")
    value = lambda c: F.when(F.col("_rule").isNotNull(), F.col(f"_rule.{c}").cast(rows.schema[c].dataType)).otherwise(F.col(c)) if c in rows.columns else F.col(f"_rule.{c}")
    return joined.select(*(c for c in rows.columns if c not in FIELDS), *(value(c).alias(c) for c in FIELDS), F.col("_rule").isNotNull().alias("known"))


def displayed(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows as reviewers see them: a reason that is given and that no rule has is shown under one name."""
    asked = norm_text(F.col("reason_key")).isNotNull() | norm_text(F.col("reason_name")).isNotNull() | norm_text(F.col("reason_id").cast("string")).isNotNull()
    known = resolved(rows.select("*", F.struct(*rows.columns).alias("_row")), rules).select("_row.*", "known")
    return known.withColumn("reason_name", F.when(asked & ~F.col("known"), UNREGISTERED).otherwise(F.col("reason_name"))).drop("known")


def reason_number(number: Column, name: Column, by_name: Mapping[str, int], names: Mapping[int, str]) -> Column:
    """struct(id, name) for settings: a number as it is, else by its name; a missing name by the number."""
    ids = F.create_map(*(F.lit(x) for kv in by_name.items() for x in kv)) if by_name else F.lit(None).cast("map<string,int>")
    texts = F.create_map(*(F.lit(x) for kv in names.items() for x in kv)) if names else F.lit(None).cast("map<int,string>")
    own = F.coalesce(to_int(number.cast("string")), ids[F.trim(name)])
    return F.struct(own.alias("id"), F.coalesce(norm_text(name), F.when(own.isNotNull(), F.coalesce(texts[own], own.cast("string"))), F.lit("")).alias("name"))


def _day_key() -> Column:
    """Sample, day and source of an event that replaces the one of that day; null for a source that names more than its category."""
    source = F.lower(norm_text(F.col("source")))
    whole = source.isNotNull() & F.col("timestamp").isNotNull() & (source == source_category(F.col("source")))
    return F.when(whole, F.struct("line", "sn", "sample_id", F.to_date("timestamp").alias("day"), source.alias("source")))


KEY = ("line", "sn", "sample_id")


def added(events: DataFrame, samples: DataFrame, new: DataFrame, rules: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Events and samples after new labels: one of a sample, day and bare source takes the place of the last such event, others are added.

    events: id, line, sn, sample_id, timestamp, source, values and status. New labels come in order of their `place`, of
    those with one key the last counts. Samples that are not there yet are registered, as active. Labels without line,
    sn, sample_id or source raise; those of rules get its reason and result."""
    new = resolved(new, rules).drop("known") if rules is not None else new
    needed = F.coalesce(*(norm_text(F.col(c)) if c != "source" else norm_text(F.col("source")) for c in KEY[:1]))
    for c in (*KEY, "source"):
        needed = F.when(norm_text(F.col(c)).isNull(), F.raise_error(F.lit(f"a label needs {c}"))).otherwise(needed)
    new = new.withColumn("line", needed).withColumn("status", status(F.lit(None).cast("string"), F.col("source"))).withColumn("_key", _day_key())
    single = new.where("_key IS NULL")
    last = Window.partitionBy("_key").orderBy(F.desc("place"))
    new = new.where("_key IS NOT NULL").withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k").unionByName(single)
    old = events.withColumn("_key", _day_key())
    target = old.where("_key IS NOT NULL").groupBy("_key").agg(F.max(F.struct("timestamp", "id"))["id"].alias("_target"))
    placed = new.join(target, "_key", "left")
    values = [c for c in events.columns if c != "id"]
    missing = [c for c in values if c not in placed.columns]
    placed = placed.withColumns({c: F.lit(None).cast(events.schema[c].dataType) for c in missing})
    changed = placed.where("_target IS NOT NULL").select(F.col("_target").alias("id"), *values)
    above = events.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = numbered(placed.where("_target IS NULL").select("place", *values), ["place", *KEY], "_n")
    fresh = fresh.select((F.lit(above + 1) + F.col("_n")).alias("id"), *values)
    out = events.join(changed.select("id"), "id", "left_anti").select(events.columns).unionByName(changed.select(events.columns)).unionByName(fresh.select(events.columns))
    known = samples.select(*KEY)
    extra = new.select(*KEY).distinct().join(known, list(KEY), "left_anti")
    blank = {c: F.lit(1 if c == "is_active" else None).cast(samples.schema[c].dataType) for c in samples.columns if c not in KEY}
    return out, samples.unionByName(extra.withColumns(blank))


def confirmed_copies(events: DataFrame, ids: DataFrame, now: Column, source: str = "expert") -> DataFrame:
    """events and, for each id, a copy of its event as an expert's of now; ids that no event has raise."""
    wanted = ids.select("id").distinct().join(events, "id", "left")
    there = F.when(F.col("sample_id").isNull(), F.raise_error(F.concat(F.lit("no such label event: "), F.col("id").cast("string"))).cast("string")).otherwise(F.col("sample_id"))
    above = events.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    copies = numbered(wanted.withColumns({"sample_id": there, "source": F.lit(source), "status": F.lit("confirmed"), "timestamp": now.cast(events.schema["timestamp"].dataType)}), ["id"], "_n")
    return events.unionByName(copies.withColumn("id", F.lit(above + 1) + F.col("_n")).select(events.columns))


def _newest(events: DataFrame) -> DataFrame:
    return events.groupBy(*KEY).agg(F.max(F.struct("timestamp", "id"))["id"].alias("id"))


def tagged(events: DataFrame, samples: DataFrame, tag: str) -> DataFrame:
    """events with a tag behind the note of each sample's newest event, where it is not there yet."""
    hit = _newest(events).join(samples.select(*KEY).distinct(), list(KEY), "left_semi").select("id", F.lit(True).alias("_hit"))
    note = F.coalesce("note", F.lit(""))
    return events.join(hit, "id", "left").withColumn("note", F.when(F.col("_hit") & ~F.contains(note, F.lit(tag)), F.trim(F.concat_ws(" ", note, F.lit(tag)))).otherwise(F.col("note"))).select(events.columns)


def typical(events: DataFrame, flags: DataFrame) -> DataFrame:
    """events with the typical tag set before, or taken from, the note of each sample's newest event; flags: sample's key and typical."""
    hit = _newest(events).join(flags.select(*KEY, "typical"), list(KEY)).select("id", "typical")
    note = F.coalesce("note", F.lit(""))
    has = F.contains(note, F.lit(TYPICAL))
    changed = F.when(F.col("typical") & ~has, F.trim(F.concat_ws(" ", F.lit(TYPICAL), note))).when(~F.col("typical") & has, F.trim(F.replace(note, F.lit(TYPICAL), F.lit(""))))
    return events.join(hit, "id", "left").withColumn("note", F.coalesce(changed, F.col("note"))).select(events.columns)


def accepted(events: DataFrame, samples: DataFrame, suggestions: DataFrame, ids: DataFrame, rules: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Events and samples after suggestions for the samples in ids have been taken over, as labels of the source model."""
    taken = ids.select("sample_id").distinct().join(suggestions, "sample_id").join(samples.select(*KEY), "sample_id")
    blank = {c: F.lit(None).cast("string") for c in FIELDS if c not in taken.columns}
    new = taken.withColumns(blank).withColumns({"source": F.lit("model"), "timestamp": now, "place": F.lit(0), "reason_confidence": F.col("confidence")})
    return added(events, samples, new.drop("confidence"), rules)


def label_records(samples: DataFrame, events: DataFrame, labeled_only: bool = True, changed: DataFrame | None = None, values: Sequence[str] = ("timestamp", "source", "reason_key", "reason_name", "note", "status")) -> DataFrame:
    """The table of labels: all events with their sample's columns, or the newest of each changed sample, or all samples with their newest event.

    Missing line and sn are filled from the sample, missing values are ''."""
    of = samples if changed is None else samples.join(changed.select("sample_id").distinct(), "sample_id", "left_semi")
    newest = Window.partitionBy("sample_id").orderBy(F.desc("timestamp"), F.desc("id"))
    last = events.withColumn("_k", F.row_number().over(newest)).where("_k = 1").drop("_k")
    rows, how = (events if labeled_only and changed is None else last), ("inner" if labeled_only else "left")
    own = of.select("sample_id", *(F.col(c).alias(f"_{c}") for c in ("line", "sn", "group_name", "channel_name") if c in of.columns))
    have = [c for c in ("line", "sn") if c in rows.columns]
    joined = own.join(rows.select("sample_id", *have, *values), "sample_id", "right" if labeled_only and changed is None else how)
    filled = {c: F.coalesce(norm_text(F.col(c)), F.col(f"_{c}"), F.lit("")) if c in have else F.coalesce(F.col(f"_{c}"), F.lit("")) for c in ("line", "sn")}
    texts = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in values}
    other = {c: F.coalesce(F.col(f"_{c}"), F.lit("")) for c in ("group_name", "channel_name") if c in of.columns}
    return joined.select(*(v.alias(k) for k, v in filled.items()), "sample_id", *(v.alias(k) for k, v in other.items()), *(v.alias(k) for k, v in texts.items()))
