"""Mixing sources to target weights by Pareto order sampling.

A source's target is its weighted share of `total` times all words; no target exceeds `most` times the
source's words, and what is over is shared anew among the others by weight until nothing is over.
Within a source a document of size class k (about log2 of its words) is wanted (k + 1) ** tilt times
as often as one of class 0, at most `most` times: the expected number of copies of each class fills
its source's target. Whole copies are certain. For the fraction left, the inclusion probability p,
documents are ranked by Pareto's variable u / (1 - u) * (1 - p) / p, u a hash of the id, and those of
least rank are taken until their words come nearest to what is left of the target. The cut is found
by two rounds of per-source histograms of the rank and one window over the single bucket that it
falls in, so no task ever sorts a whole source.

Defined results. A null text has size 0; a null source is one source, the last. Documents without
words are never drawn (a document without words takes nothing). Rows that repeat an id are ranked by
the same u and tie by their size; rows with equal id and size are drawn together or, at the cut,
in one of them. Without rows the result is empty. Reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Weights of the sources in order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Buckets of one histogram round.
BUCKETS = 4096


def words_in(text: str) -> Column:
    """The number of words `[^\\x20\\x09-\\x0D]+`, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def filled(rows: DataFrame, group: Sequence[str], weight: str, limit: str, goal: str) -> DataFrame:
    """Adds `share`: least(limit, level * weight), with the level at which a group's shares sum to its goal.

    Rows are a small aggregate, one per source or per source and size class."""
    by = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col(limit) / F.col(weight), *rows.columns[:2])
    up = order.rowsBetween(Window.unboundedPreceding, -1)
    # With all rows before this one at their limits, would this one be at its limit too?
    spent, weights = F.coalesce(F.sum(limit).over(up), F.lit(0.0)), F.coalesce(F.sum(weight).over(up), F.lit(0.0))
    level = (F.col(goal) - spent) / (F.sum(weight).over(by) - weights)
    tried = rows.withColumn("level", level).withColumn("over", F.col("level") * F.col(weight) > F.col(limit)).withColumn("rank", F.row_number().over(order))
    found = F.min(F.when(~F.col("over"), F.struct("rank", "level"))).over(by)["level"]
    return tried.withColumn("share", F.least(F.col(limit), F.coalesce(found * F.col(weight), F.col(limit)))).drop("level", "over", "rank")


#: Columns that `mix` adds.
RESULTS = ("size", "source_size", "target", "copies", "taken")


def targets(docs: DataFrame, weights: Sequence[float] = WEIGHTS, total: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) of documents with source and size."""
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(order - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("most", F.lit(float(most)) * F.col("source_size"))
    goal = F.lit(float(total)) * F.sum("source_size").over(Window.partitionBy(F.lit(0)))
    return filled(ranked.withColumn("goal", goal), [], "weight", "most", "goal").select("source", "source_size", F.col("share").alias("target"))


def uniform(key: str, seed: int) -> Column:
    """A number in (0, 1) from the id: 48 bits of its MD5."""
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(str(seed))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, total: float = 1.5, most: float = 2.0, tilt: float = 0.5, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All rows of docs with size, source_size, target, copies and taken (their words times their copies).

    Columns of docs that have one of these names give way to the results."""
    spark = docs.sparkSession
    names = {c: f"_{k}" for k, c in enumerate(docs.columns)}
    own = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    rows = own.withColumns({"id": F.col(names[id_col]), "source": F.col(names[source_col]), "size": words_in(names[text_col])})
    rows = rows.withColumn("class", (F.length(F.bin(F.col("size") + 1)) - 1)).withColumn("u", uniform("id", seed))
    slim = settle(rows.select("id", "source", "size", "class", "u"))
    goals = targets(slim, weights, total, most)
    strata = slim.groupBy("source", "class").agg(F.sum("size").cast("double").alias("words"))
    # The expected copies e of a class: e * words sum to the target, e is at most `most`.
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    strata = strata.alias("a").join(goals.alias("b"), same).select("a.source", "class", "words", "source_size", "target")
    strata = strata.withColumns({"weight": F.pow(F.col("class") + 1.0, F.lit(float(tilt))) * F.col("words"), "most": F.lit(float(most)) * F.col("words")}).where("words > 0")
    strata = filled(strata, ["source"], "weight", "most", "target").withColumn("expected", F.col("share") / F.col("words"))
    strata = strata.withColumn("whole", F.floor(F.col("expected") + 1e-12)).withColumn("p", F.greatest(F.lit(0.0), F.col("expected") - F.col("whole")))
    certain = F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("source"))
    strata = settle(strata.withColumn("left", F.col("target") - certain).select("source", "class", "source_size", "target", "whole", "p", "left"))
    plan = F.broadcast(strata) if strata.count() <= 100_000 else strata
    match = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.class") == F.col("b.class"))
    drawn = slim.alias("a").join(plan.alias("b"), match).where("p > 0").select("id", "a.source", "size", "left", (F.col("u") / (1 - F.col("u")) * (1 - F.col("p")) / F.col("p")).alias("rank"))
    cuts = cut(settle(drawn), BUCKETS)
    rows = rows.alias("a").join(plan.alias("b"), match, "left").select("a.*", "source_size", "target", "whole", "p")
    rank = F.col("u") / (1 - F.col("u")) * (1 - F.col("p")) / F.col("p")
    few = F.broadcast(cuts) if cuts.count() <= 100_000 else cuts
    rows = rows.withColumn("rank", F.when(F.col("p") > 0, rank)).alias("a").join(few.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left")
    taken = F.struct("rank", "id", "size") <= F.struct("last_rank", "last_id", "last_size")
    copies = F.coalesce(F.col("whole"), F.lit(0)) + F.when(F.col("rank").isNotNull() & F.col("last_rank").isNotNull() & taken, 1).otherwise(0)
    goals = settle(goals)
    goal = F.broadcast(goals) if goals.count() <= 100_000 else goals
    out = rows.select("a.*", copies.cast("long").alias("copies")).drop("source_size", "target").alias("a").join(goal.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")))
    return out.select(*(F.col(n).alias(c) for c, n in names.items() if c.lower() not in RESULTS), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def cut(drawn: DataFrame, buckets: int) -> DataFrame:
    """(source, last_rank, last_id, last_size): where each source's order reaches its words, the nearer of two ends."""
    # Ranks are spread over (0, infinity); rank / (1 + rank) orders them within (0, 1).
    placed = drawn.withColumn("x", F.col("rank") / (1 + F.col("rank")))
    low, width, base = F.lit(0.0), 1.0, F.lit(0.0)
    placed = placed.withColumns({"from_x": low, "before": base})
    for _ in range(2):
        width /= buckets
        step = F.least(F.lit(buckets - 1), F.floor((F.col("x") - F.col("from_x")) / width)).cast("int")
        inside = placed.withColumn("bucket", F.greatest(F.lit(0), step))
        sums = inside.groupBy("source", "bucket", "from_x", "before", "left").agg(F.sum("size").alias("words"))
        run = F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) + F.col("before")
        reach = sums.withColumn("upto", run).where("upto - words < left").groupBy("source").agg(F.max("bucket").alias("bucket"), F.max_by(F.col("upto") - F.col("words"), "bucket").alias("before"), F.max_by("from_x", "bucket").alias("from_x"))
        reach = settle(reach.select("source", "bucket", "before", (F.col("from_x") + F.col("bucket") * width).alias("from_x")))
        small = F.broadcast(reach) if reach.count() <= 100_000 else reach
        match = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.bucket") == F.col("b.bucket"))
        placed = settle(inside.drop("from_x", "before").alias("a").join(small.alias("b"), match).select("id", "a.source", "size", "left", "rank", "x", "b.from_x", "b.before"))
    order = Window.partitionBy("source").orderBy("rank", "id", "size")
    upto = F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    last = placed.withColumn("upto", upto).withColumn("miss", F.abs(F.col("upto") - F.col("left")))
    nearest = F.struct("miss", "rank", "id", "size")
    best = last.groupBy("source").agg(F.min(nearest).alias("m"), F.min(F.col("left") - F.col("before")).alias("gap"))
    # Nothing of the bucket may be nearer still: then the order ends before its first rank.
    none = F.col("gap") < F.col("m.miss")
    first = F.when(none, F.lit(None)).otherwise(F.col("m.id"))
    lows = placed.groupBy("source").agg(F.min("rank").alias("low"))
    best = best.alias("a").join(lows.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "low")
    return best.select("source", F.when(none, F.col("low")).otherwise(F.col("m.rank")).alias("last_rank"), F.coalesce(first, F.lit(-(1 << 62))).alias("last_id"), F.when(none, F.lit(-1)).otherwise(F.col("m.size")).alias("last_size"))
