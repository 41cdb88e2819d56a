"""The event-sourced label store: statuses, latest labels, resolution of annotators, changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_text, source_category, source_rank


def status(requested: Column, source: Column) -> Column:
    """rejected and pending as requested; else confirmed for experts and unconfirmed for all others."""
    asked = F.lower(norm_text(requested))
    return F.when(asked.isin("rejected", "pending"), asked).when(source_category(source) == "expert", "confirmed").otherwise("unconfirmed")


def latest(events: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return events.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def latest_confirmed(events: DataFrame, keys: Sequence[str] = ("sample_pk",)) -> DataFrame:
    return latest(events.where("status = 'confirmed'"), keys, [F.desc("timestamp"), F.desc("id")])


def ranked_latest(events: DataFrame, keys: Sequence[str] = ("sample_pk",)) -> DataFrame:
    """Newest first, unparsed times last, then by trust in the source."""
    return latest(events, keys, [F.desc_nulls_last("timestamp"), source_rank(source_category(F.col("source"))).asc(), F.asc("id")])


def resolve(events: DataFrame, keys: Sequence[str] = ("sample_pk",), signature: Sequence[str] = ("result_key", "reason_key")) -> DataFrame:
    """One training label per sample, by plain aggregates:

    the newest expert event if there is one; else, of two or more operator events that agree, the newest;
    else none, with the reason why. Model events never count."""
    category = source_category(F.col("source"))
    signed = F.struct(*(F.coalesce(norm_text(F.col(c)), F.lit("")).alias(c) for c in signature))
    newest = F.struct("timestamp", "id", *signature)
    pick = lambda kind: F.max(F.when(category == kind, newest))
    found = events.groupBy(*keys).agg(
        pick("expert").alias("expert"),
        pick("operator").alias("operator"),
        F.count_if(category == "expert").alias("n_expert"),
        F.count_if(category == "operator").alias("n_operator"),
        F.count_distinct(F.when(category == "operator", signed)).alias("n_signed"),
    )
    state = (
        F.when(F.col("n_expert") > 0, "expert")
        .when(F.col("n_operator") == 0, "unlabeled")
        .when(F.col("n_operator") == 1, "operator_single")
        .when(F.col("n_signed") > 1, "operator_conflict")
        .otherwise("operator_consistent")
    )
    chosen = F.when(F.col("label_state") == "expert", F.col("expert")).when(F.col("label_state") == "operator_consistent", F.col("operator"))
    return found.withColumn("label_state", state).select(*keys, "label_state", *(chosen[c].alias(c) for c in signature))


def effective_reason(events: DataFrame, keys: Sequence[str] = ("sample_pk",)) -> DataFrame:
    """The newest expert's reason; where operators differ the first operator's; else the newest of all."""
    category = source_category(F.col("source"))
    at = F.struct("timestamp", "id")
    found = events.groupBy(*keys).agg(
        F.max_by("reason_key", F.when(category == "expert", at)).alias("expert"),
        F.min_by("reason_key", F.when(category == "operator", at)).alias("first_operator"),
        F.count_distinct(F.when(category == "operator", F.col("reason_key"))).alias("n"),
        F.max_by("reason_key", at).alias("newest"),
    )
    return found.select(*keys, F.coalesce("expert", F.when(F.col("n") > 1, F.col("first_operator")), "newest").alias("reason_key"))


def same_day_replaced(events: DataFrame) -> DataFrame:
    """Of events of one sample, day and bare source category the newest, the later row at equal times; all other events stay."""
    bare = F.col("source").isin("expert", "operator", "model")
    by = Window.partitionBy("sample_pk", F.to_date("timestamp"), "source").orderBy(F.desc("timestamp"), F.desc("id"))
    return events.withColumn("_n", F.row_number().over(by)).where(~bare | (F.col("_n") == 1)).drop("_n")


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], kept: Sequence[str] = ()) -> DataFrame:
    """old with the rows of new in place of those of equal key; columns in kept hold on to old values."""
    values = [c for c in old.columns if c not in keys]
    marked = new.select(*keys, F.struct(*(F.col(c) for c in values)).alias("new"))
    joined = old.select(*keys, F.struct(*values).alias("old")).join(marked, list(keys), "full")
    pick = lambda c: F.when(F.col("new").isNull() | (F.lit(c in kept) & F.col("old").isNotNull()), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}"))
    return joined.select(*keys, *(pick(c).alias(c) for c in values)).select(old.columns)


def replaced_in_scope(old: DataFrame, new: DataFrame, keys: Sequence[str], scope: str = "line") -> DataFrame:
    """Samples of the scopes that new speaks of become inactive unless new has them; new ones are active."""
    scopes = new.select(scope).distinct().withColumn("_in", F.lit(True))
    off = old.join(scopes, scope, "left")
    off = off.withColumn("is_active", F.when(F.col("_in"), F.lit(0)).otherwise(F.col("is_active"))).drop("_in").select(old.columns)
    return upserted(off, new.withColumn("is_active", F.lit(1)).select(old.columns), keys)


def imported(stored: DataFrame, batch: DataFrame, columns: Sequence[str]) -> DataFrame:
    """stored and those rows of batch that equal no stored row in the columns, nulls alike; repeats within batch stay."""
    on = [stored[c].eqNullSafe(batch[c]) for c in columns]
    condition = on[0]
    for more in on[1:]:
        condition = condition & more
    return stored.unionByName(batch.join(stored, condition, "left_anti"))


def with_fallback(samples: DataFrame, labels: DataFrame, keys: Sequence[str], loose: Sequence[str], values: Sequence[str], order: str | None = None) -> DataFrame:
    """Labels by all keys, and where these miss, by the loose keys among labels without a line.

    Of several labels of a key the last in the order counts, without one the greatest, so no sample is repeated."""
    last = lambda name: (F.max(F.struct(*values)) if order is None else F.max_by(F.struct(*values), F.struct(order, F.struct(*values)))).alias(name)
    exact = labels.where("line IS NOT NULL").groupBy(*keys).agg(last("exact"))
    rest = labels.where("line IS NULL").groupBy(*loose).agg(last("rest"))
    joined = samples.join(exact, list(keys), "left").join(rest, list(loose), "left")
    return joined.select(*samples.columns, *(F.coalesce(F.col(f"exact.{v}"), F.col(f"rest.{v}")).alias(v) for v in values))
