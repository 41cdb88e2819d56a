"""Splits and folds by strategy: whole groups on one side, the best of many draws by a score of label counts.

Everything that is searched or scored is a table of counts per group and label. A draw of groups is by dice, so every
engine makes the same one; ranks of dice are dealt by value (`ranks.drawn`), so no task holds all groups of a scope.
Only numbers of groups and of labels come to the driver. Greedy steps that depend on what came before (folds within a
reference, the core pool) stream the groups of one reference, or of one draw, in order of their dice through a task
that keeps sums, not rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_text
from ..sources.shared import settle
from .learning import dice
from .ranks import drawn

#: Strategies in the order in which they are offered, the one taken for unknown names, and other names.
STRATEGIES = ("reference_out", "line_out", "reference_in", "stratified")
DEFAULT = "reference_out"
ALIASES = {"sample": "stratified", "sample_level": "stratified", "stratified_sample": "stratified", "referencein": "reference_in", "reference_out_main": "reference_out", "referenceout": "reference_out", "lineout": "line_out"}
#: Weights of the score of a split.
ROWS, RATIO, COUNT, MISSING, EXPECTED, LINE = 2.0, 3.0, 1.5, 8.0, 0.75, 2.0
#: Of the other score, a label that the training side lacks.
LACKING = 5.0


def strategy(name: object) -> str:
    """The strategy that a name means."""
    text = str(name if name is not None else "").strip().lower().replace("-", "_").replace(" ", "_")
    text = ALIASES.get(text, text)
    return text if text in STRATEGIES else DEFAULT


def _part(value: Column, name: str, row: Column) -> Column:
    return F.coalesce(norm_text(value.cast("string")), F.concat(F.lit(f"__missing_{name}__"), row.cast("string")))


def line_key(row: Column, line: str = "line") -> Column:
    """A line; a row without one stands alone."""
    return _part(F.col(line), "line", row)


def reference_key(row: Column, line: str = "line", reference: str = "reference") -> Column:
    return F.concat_ws("::", line_key(row, line), _part(F.col(reference), "reference", row))


def serial_key(row: Column, outer: Column, sn: str = "sn", source_sn: str | None = None) -> Column:
    """outer and the serial, of an augmented row the serial that it was made from."""
    own = _part(F.col(sn), "sn", row)
    return F.concat_ws("::", outer, F.coalesce(norm_text(F.col(source_sn)), own) if source_sn else own)


def _penalty(labels: Column, rows: Column, target: Column, total: Column, count: str) -> Column:
    """The part of the score that one side has; labels: structs of label, full and the counts of the sides."""
    expected = lambda x: x.full * target / F.greatest(total, F.lit(1.0))

    def one(x: Column) -> Column:
        seen, wanted = x[count], expected(x)
        ratio = F.abs(seen / F.greatest(rows, F.lit(1.0)) - x.full / F.greatest(total, F.lit(1.0)))
        return RATIO * ratio + COUNT * F.abs(seen - wanted) / F.greatest(wanted, F.lit(1.0)) + F.when((wanted >= EXPECTED) & (seen == 0), MISSING).otherwise(0.0)

    return ROWS * F.abs(rows - target) / F.greatest(target, F.lit(1.0)) + F.aggregate(labels, F.lit(0.0), lambda a, x: a + one(x))


def scored(sides: DataFrame, share: float, lines: bool = False) -> DataFrame:
    """(scope, trial, score, rows of either side) of draws; sides: scope, trial, group, label, n, test and, with lines, line."""
    t, r = F.sum(F.when(F.col("test"), F.col("n")).otherwise(0)).cast("double"), F.sum(F.when(F.col("test"), 0).otherwise(F.col("n"))).cast("double")
    by_label = sides.groupBy("scope", "trial", "label").agg(t.alias("t"), r.alias("r"))
    both = by_label.groupBy("scope", "trial").agg(F.sort_array(F.collect_list(F.struct("label", (F.col("t") + F.col("r")).alias("full"), "t", "r"))).alias("labels"), F.sum("t").alias("test_rows"), F.sum("r").alias("train_rows"))
    total = F.col("test_rows") + F.col("train_rows")
    target = total * share
    score = _penalty(F.col("labels"), F.col("train_rows"), total - target, total, "r") + _penalty(F.col("labels"), F.col("test_rows"), target, total, "t")
    out = both.withColumn("score", score)
    if lines:
        seen = sides.where("line <> ''").groupBy("scope", "trial", "line").agg(F.count_distinct("group").alias("groups"), F.max("test").alias("some"), F.min("test").alias("every"))
        missing = seen.where("groups >= 2").groupBy("scope", "trial").agg(F.sum((~F.col("some")).cast("int") + F.col("every").cast("int")).alias("missing"))
        out = out.join(missing, ["scope", "trial"], "left").withColumn("score", F.col("score") + LINE * F.coalesce("missing", F.lit(0)))
    return out.select("scope", "trial", "score", "test_rows", "train_rows")


def _best(sides: DataFrame, scores: DataFrame) -> DataFrame:
    """(scope, group, test) of the draw of least score; the first of equal ones, scores being equal if nine decimals are."""
    usable = scores.where("test_rows > 0 AND train_rows > 0")
    chosen = usable.groupBy("scope").agg(F.min(F.struct(F.round("score", 9), "trial"))["trial"].alias("trial"))
    return sides.join(chosen, ["scope", "trial"]).select("scope", "group", "test").distinct()


def shuffled_sides(counts: DataFrame, share: float, trials: int, seed: int) -> DataFrame:
    """counts (scope, group, label, n, ...) for each trial, with the share of groups that its dice put on the test side, rounded up, never all."""
    groups = counts.select("scope", "group").distinct().withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    groups = groups.withColumn("_key", F.struct("scope", "trial"))
    quota = lambda n: F.least(F.greatest(F.ceil(n * share - 1e-9), F.lit(1)), n - 1)
    dealt = drawn(groups, "_key", dice(F.col("group"), F.lit(seed), F.col("trial")), "group", quota)
    return dealt.select("scope", "group", "trial", F.col("_in").alias("test")).join(counts, ["scope", "group"])


def group_sides(counts: DataFrame, share: float, trials: int = 32, seed: int = 0, lines: bool = False) -> DataFrame:
    """(scope, group, test): in each scope of two groups or more the best of the trials, of which there are 8 to 256."""
    several = counts.groupBy("scope").agg(F.count_distinct("group").alias("_n")).where("_n > 1").select("scope")
    sides = settle(shuffled_sides(counts.join(several, "scope"), share, max(8, min(trials, 256)), seed))
    return _best(sides, scored(sides, share, lines))


def _counted(rows: DataFrame, scope: Column, group: Column, label: str, line: Column) -> DataFrame:
    return rows.groupBy(scope.alias("scope"), group.alias("group"), F.col(label).alias("label"), line.alias("line")).agg(F.count("*").alias("n"))


def _two_steps(rows: DataFrame, scope: Column, group: Column, label: str, line: Column, test: float, validation: float, trials: int, seed: int, lines: bool) -> DataFrame:
    """(scope, group, split) by a test side and then a validation side of what is left."""
    counts = settle(_counted(rows, scope, group, label, line))
    tests = settle(group_sides(counts, test, trials, seed, lines).where("test").select("scope", "group"))
    pool = counts.join(tests, ["scope", "group"], "left_anti")
    checks = group_sides(pool, validation, trials, seed).where("test").select("scope", "group")
    return tests.withColumn("split", F.lit("test")).union(checks.withColumn("split", F.lit("validation")))


def _shares(counts: Mapping[object, int], share: float) -> dict[object, int] | None:
    """How many rows of each label the smaller side takes: in proportion, by largest remainder; None where labels are too rare."""
    total = sum(counts.values())
    n = math.ceil(total * share - 1e-9)
    if len(counts) < 2 or min(counts.values()) < 2 or n < len(counts) or total - n < len(counts):
        return None
    exact = {k: n * c / total for k, c in counts.items()}
    whole = {k: math.floor(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (whole[k] - exact[k], str(k)))[: n - sum(whole.values())]:
        whole[k] += 1
    return whole


def row_side(rows: DataFrame, label: str, row: Column, share: float, seed: int) -> DataFrame:
    """rows with `test`: a share of the rows by dice, in proportion to labels where these are frequent enough."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    total, wanted = sum(counts.values()), _shares(counts, share)
    keyed = rows.withColumn("_row", row.cast("string"))
    die = dice(F.col("_row"), F.lit(seed))
    if total < 2:
        return rows.withColumn("test", F.lit(False))
    if wanted is None:
        keyed = keyed.withColumn("_one", F.lit(0))
        placed = drawn(keyed, "_one", die, "_row", lambda n: F.lit(min(math.ceil(total * share - 1e-9), total - 1)))
    else:
        quotas = F.create_map(*(F.lit(x) for k, n in wanted.items() for x in (str(k), n)))
        name = F.coalesce(F.col(label).cast("string"), F.lit("None"))
        keyed = keyed.withColumn("_label", F.struct(name.alias("name"), quotas[name].alias("quota")))
        placed = drawn(keyed, "_label", die, "_row", lambda n: F.col("_label.quota"))
    return placed.withColumn("test", F.col("_in")).select(*rows.columns, "test")


def split_rows(rows: DataFrame, by: str, label: str, row: Column, test: float = 0.1, validation: float = 0.125, trials: int = 32, seed: int = 0, source_sn: str | None = None) -> DataFrame:
    """rows with `split` (train, validation, test) by a strategy; validation is a share of what test leaves.

    row is a key of each row. reference_out and line_out keep references or lines together; where one is left for
    training and validation, serials are parted instead. reference_in parts serials inside every reference, and one of a
    single serial is for training. stratified parts rows. Too few groups raise an error."""
    by = strategy(by)
    if by == "stratified":
        first = settle(row_side(rows, label, row, test, seed))
        second = row_side(first.where("NOT test").drop("test"), label, row, validation, seed + 1)
        train = second.select(*rows.columns, F.when(F.col("test"), "validation").otherwise("train").alias("split"))
        return train.union(first.where("test").select(*rows.columns, F.lit("test").alias("split")))
    line, outer = line_key(row), line_key(row) if by == "line_out" else reference_key(row)
    serial = serial_key(row, outer, source_sn=source_sn)
    keyed = rows.withColumns({"_outer": outer, "_serial": serial, "_line": line})
    nothing, groups = F.lit(""), keyed.select("_outer").distinct().count()
    if by == "reference_in":
        found = settle(_two_steps(keyed, F.col("_outer"), F.col("_serial"), label, F.col("_line"), test, validation, trials, seed, False).select(F.col("group").alias("_serial"), "split"))
        if {r[0] for r in found.select("split").distinct().collect()} != {"test", "validation"}:
            raise ValueError("serials are too few for a test and a validation side")
        return keyed.join(found, "_serial", "left").select(*rows.columns, F.coalesce("split", F.lit("train")).alias("split"))
    if groups < 2:
        raise ValueError(f"{by} needs two groups or more")
    found = settle(_two_steps(keyed, nothing, F.col("_outer"), label, F.col("_line"), test, validation, trials, seed, by == "reference_out").select(F.col("group").alias("_outer"), "split"))
    out = keyed.join(found, "_outer", "left").withColumn("split", F.coalesce("split", F.lit("train")))
    if found.where("split = 'validation'").isEmpty():
        pool = out.where("split = 'train'")
        counts = _counted(pool, nothing, F.col("_serial"), label, F.col("_line"))
        checks = settle(group_sides(counts, validation, trials, seed).where("test").select(F.col("group").alias("_serial"), F.lit(True).alias("_check")))
        if checks.isEmpty():
            raise ValueError("serials are too few for a validation side")
        out = out.join(checks, "_serial", "left").withColumn("split", F.when((F.col("split") == "train") & F.col("_check"), "validation").otherwise(F.col("split")))
    return out.select(*rows.columns, "split")


def folds_within(rows: DataFrame, outer: Column, serial: Column, label: str, k: int, seed: int = 0) -> DataFrame:
    """(serial, fold): whole serials in k folds, even inside every reference; no fold stays empty while another has two serials.

    A serial counts with its most frequent label (the least of several) and its rows. A reference with k serials or
    more of each of its labels, of which there are two or more, deals them in turn in order of label and dice; in others
    each serial, in order of dice, goes to the fold with fewest rows of its label, then with fewest rows, then the first."""
    if k < 2:
        raise ValueError("two folds at least")
    seen = rows.groupBy(outer.alias("outer"), serial.alias("serial"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
    serials = seen.groupBy("outer", "serial").agg(F.min(F.struct(-F.col("n"), "label"))["label"].alias("label"), F.sum("n").alias("n")).withColumn("die", dice(F.col("serial"), F.lit(seed)))
    labels = serials.groupBy("outer", "label").agg(F.count("*").alias("s"))
    even = labels.groupBy("outer").agg(((F.min("s") >= k) & (F.count("*") > 1)).alias("even"))
    serials = serials.join(even, "outer")

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, turn, of_label, sizes = None, 0, {}, [0] * k
        for frame in frames:
            folds = []
            for reference, even, name, n in zip(frame.outer, frame.even, frame.label, frame.n, strict=True):
                if reference != now:
                    now, turn, of_label, sizes = reference, 0, {}, [0] * k
                counts = of_label.setdefault(name, [0] * k)
                fold = turn % k if even else min(range(k), key=lambda f: (counts[f], sizes[f], f))
                folds.append(fold)
                turn += 1
                counts[fold] += n
                sizes[fold] += n
            yield frame.assign(fold=np.array(folds, np.int32))[["outer", "serial", "die", "n", "fold"]]

    ordered = serials.repartition("outer").sortWithinPartitions("outer", F.when(F.col("even"), F.col("label")), "die", "serial")
    dealt = settle(ordered.select("outer", "serial", "label", "die", "n", "even").mapInPandas(deal, "outer string, serial string, die double, n long, fold int"))
    sizes = {r.fold: [r.rows, r.serials] for r in dealt.groupBy("fold").agg(F.sum("n").alias("rows"), F.count("*").alias("serials")).collect()}
    moved: dict[str, int] = {}
    for empty in (f for f in range(k) if f not in sizes):
        donor = max(sizes, key=lambda f: (sizes[f][0], -f), default=None)
        if donor is None or sizes[donor][1] < 2:
            continue
        last = dealt.where((F.col("fold") == donor) & ~F.col("serial").isin(list(moved))).orderBy(F.desc("outer"), F.desc("die"), F.desc("serial")).first()
        moved[last.serial] = empty
        sizes[donor] = [sizes[donor][0] - last.n, sizes[donor][1] - 1]
        sizes[empty] = [last.n, 1]
    if not moved:
        return dealt.select("serial", "fold")
    to = F.create_map(*(F.lit(x) for kv in moved.items() for x in kv))
    return dealt.select("serial", F.coalesce(to[F.col("serial")], "fold").alias("fold"))


def group_folds(rows: DataFrame, group: Column, label: str, k: int, seed: int = 0) -> DataFrame:
    """(group, fold): whole groups in folds that have alike shares of each label, as many as the rarest label has groups, k at most.

    Groups come by the spread of their label counts, widest first, and go to the fold that leaves the shares least
    uneven, of equal ones to the one with fewest rows. Where a label has one group only, groups go by size to the
    smallest fold. The groups' counts stream through one task, which keeps a sum per fold and label."""
    counts = settle(rows.groupBy(group.alias("group"), F.col(label).alias("label")).agg(F.count("*").alias("n")))
    totals = {r[0]: (r[1], r[2]) for r in counts.groupBy("label").agg(F.sum("n"), F.count("*")).collect()}
    names = sorted(totals, key=lambda x: (x is None, x))
    groups = counts.select("group").distinct().count()
    if groups < 2:
        raise ValueError("groups are too few for folds")
    rarest = min(n for _, n in totals.values())
    k = min(k, groups, rarest) if rarest >= 2 else max(2, min(k, groups))
    every = np.array([totals[x][0] for x in names], float)
    vector = F.array(*(F.coalesce(F.sum(F.when(F.col("label").eqNullSafe(F.lit(x)), F.col("n"))), F.lit(0)) for x in names))
    table = counts.groupBy("group").agg(vector.alias("counts"), F.sum("n").alias("n"))
    mean = F.col("n") / len(names)
    spread = F.sqrt(F.aggregate("counts", F.lit(0.0), lambda a, c: a + (c - mean) * (c - mean)) / len(names))
    order = [F.desc("spread"), "die", "group"] if rarest >= 2 else [F.desc("n"), "group"]
    ordered = table.select("group", "counts", "n", F.round(spread, 9).alias("spread"), dice(F.col("group"), F.lit(seed)).alias("die")).coalesce(1).sortWithinPartitions(*order)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have, sizes = np.zeros((k, len(every))), np.zeros(k)
        for frame in frames:
            folds = []
            for own, n in zip(frame.counts, frame.n, strict=True):
                if rarest < 2:
                    best = int(sizes.argmin())
                else:
                    best, least = -1, np.inf
                    for f in range(k):
                        have[f] += own
                        uneven = float(np.mean(np.std(have / every, axis=0)))
                        have[f] -= own
                        if uneven < least - 1e-12 or abs(uneven - least) <= 1e-12 and sizes[f] < sizes[best]:
                            best, least = f, min(least, uneven)
                have[best] += own
                sizes[best] += n
                folds.append(best)
            yield pd.DataFrame({"group": frame.group, "fold": np.array(folds, np.int32)})

    return ordered.mapInPandas(deal, "group string, fold int")


def row_folds(rows: DataFrame, label: str, row: Column, k: int, seed: int = 0) -> DataFrame:
    """rows with `fold`: the rows of each label dealt in turn by dice, so that folds differ by one row of a label at most."""
    least = rows.groupBy(label).count().agg(F.min("count")).first()[0]
    k = min(k, least or 0)
    if k < 2:
        raise ValueError("rows of a label are too few for folds")
    keyed = rows.withColumn("_row", row.cast("string"))
    die = dice(F.col("_row"), F.lit(seed))
    # The first i shares of k, less the first i - 1: fold i - 1.
    placed = keyed.withColumn("fold", F.lit(0))
    for i in range(1, k):
        placed = drawn(placed, label, die, "_row", lambda n, i=i: F.floor(n * i / k)).withColumn("fold", F.col("fold") + (~F.col("_in")).cast("int")).drop("_in", "_all")
    return placed.select(*rows.columns, "fold")


def folds(rows: DataFrame, by: str, label: str, row: Column, k: int = 5, seed: int = 0, source_sn: str | None = None) -> DataFrame:
    """rows with `fold` from 0 by a strategy, k folds or as many as the rarest label allows."""
    by = strategy(by)
    if by == "stratified":
        return row_folds(rows, label, row, k, seed)
    outer = line_key(row) if by == "line_out" else reference_key(row)
    keyed = rows.withColumn("_outer", outer)
    if by != "reference_in":
        found = group_folds(keyed, F.col("_outer"), label, k, seed).withColumnRenamed("group", "_outer")
        return keyed.join(found, "_outer").select(*rows.columns, "fold")
    keyed = keyed.withColumn("_serial", serial_key(row, outer, source_sn=source_sn))
    least = rows.groupBy(label).count().agg(F.min("count")).first()[0]
    found = folds_within(keyed, F.col("_outer"), F.col("_serial"), label, min(k, least or 0, keyed.select("_serial").distinct().count()), seed)
    return keyed.join(found.withColumnRenamed("serial", "_serial"), "_serial").select(*rows.columns, "fold")


def core_pool(counts: DataFrame, targets: Mapping[object, int], test: float, validation: float, trials: int = 32, seed: int = 0) -> DataFrame:
    """The groups that a training set with so many rows of each label is drawn from; counts: group, label, n; a target below 0 means all.

    Groups with rows of a label that is wanted whole are in. Of 8 to 96 orders of the others, each one takes groups
    that have what is still missing and then gives back, last first, those that are not needed; the order that misses
    least, then the one that takes least too much, is the first best."""
    have = {r[0]: r[1] for r in counts.groupBy("label").agg(F.sum("n")).collect()}
    part = max(0.0, 1 - test) * max(0.0, 1 - validation) or 1.0
    wanted = {x: have[x] if t < 0 else min(have[x], max(t, math.ceil(t / part))) for x, t in targets.items() if have.get(x, 0) > 0}
    if not wanted:
        return counts.select("group").distinct()
    names = list(wanted)
    target = np.array([wanted[x] for x in names])
    whole = [x for x in names if wanted[x] >= have[x]]
    vector = F.array(*(F.coalesce(F.sum(F.when(F.col("label") == x, F.col("n"))), F.lit(0)) for x in names))
    table = settle(counts.groupBy("group").agg(vector.alias("counts"), F.max(F.col("label").isin(whole) if whole else F.lit(False)).alias("must")))
    base = np.array(table.where("must").agg(*(F.coalesce(F.sum(F.col("counts")[i]), F.lit(0)) for i in range(len(names)))).first(), int)
    trials = max(8, min(trials, 96))
    dealt = table.where("NOT must").withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))).withColumn("die", dice(F.col("group"), F.lit(seed), F.col("trial")))

    def grow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, taken, sums = None, [], base.copy()

        def result() -> pd.DataFrame:
            nonlocal sums
            kept = []
            for group, own in reversed(taken):
                if (sums - own >= target).all():
                    sums = sums - own
                else:
                    kept.append(group)
            short, over = int(np.maximum(target - sums, 0).sum()), int(np.maximum(sums - target, 0).sum())
            return pd.DataFrame({"trial": now, "group": [None, *kept], "short": short, "over": over})

        for frame in frames:
            for trial, group, own in zip(frame.trial, frame.group, frame.counts, strict=True):
                if trial != now:
                    if now is not None:
                        yield result()
                    now, taken, sums = trial, [], base.copy()
                missing = sums < target
                if missing.any() and own[missing].sum() > 0:
                    taken.append((group, own))
                    sums = sums + own
        if now is not None:
            yield result()

    grown = settle(dealt.select("trial", "die", "group", "counts").repartition("trial").sortWithinPartitions("trial", "die", "group").mapInPandas(grow, "trial int, group string, short long, over long"))
    best = grown.agg(F.min(F.struct("short", "over", "trial")).alias("b")).select(F.col("b.trial").alias("trial"))
    return table.where("must").select("group").union(grown.where("group IS NOT NULL").join(F.broadcast(best), "trial").select("group"))


def drawn_sides(counts: DataFrame, share: float, trials: int = 32, seed: int = 0) -> DataFrame:
    """(group, test): each trial draws every group with the share's chance, one at least and never all; the best by the other score."""
    trials = max(8, trials)
    groups = counts.select("group").distinct().withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
    groups = groups.withColumn("test", dice(F.col("group"), F.lit(seed), F.col("trial")) < share)
    second = F.struct(dice(F.col("group"), F.lit(seed), F.col("trial"), F.lit("pick")), "group")
    state = groups.groupBy("trial").agg(F.max("test").alias("some"), F.min("test").alias("every"), F.min(second)["group"].alias("pick"))
    sides = groups.join(F.broadcast(state), "trial")
    sides = sides.withColumn("test", F.when((F.col("group") == F.col("pick")) & (~F.col("some") | F.col("every")), ~F.col("test")).otherwise(F.col("test"))).select("trial", "group", "test").join(counts, "group")
    t, r = F.sum(F.when(F.col("test"), F.col("n")).otherwise(0)).cast("double"), F.sum(F.when(F.col("test"), 0).otherwise(F.col("n"))).cast("double")
    by_label = sides.groupBy("trial", "label").agg(t.alias("t"), r.alias("r"))
    both = by_label.groupBy("trial").agg(F.sort_array(F.collect_list(F.struct("label", "t", "r"))).alias("labels"), F.sum("t").alias("test_rows"), F.sum("r").alias("train_rows"))
    a, b = F.col("test_rows"), F.col("train_rows")
    total = a + b

    def one(x: Column) -> Column:
        full = (x.t + x.r) / total
        return F.abs(x.r / F.greatest(b, F.lit(1.0)) - full) + F.abs(x.t / F.greatest(a, F.lit(1.0)) - full) + F.abs(x.t - (x.t + x.r) * share) / total + F.when(x.r == 0, LACKING).otherwise(0.0)

    score = F.abs(a - total * share) / total + F.aggregate("labels", F.lit(0.0), lambda s, x: s + one(x))
    best = both.where("test_rows > 0 AND train_rows > 0").agg(F.min(F.struct(F.round(score, 9), "trial"))["trial"].alias("trial"))
    return sides.join(F.broadcast(best), "trial").select("group", "test").distinct()


def pooled_split(rows: DataFrame, group: Column, label: str, targets: Mapping[object, int], test: float = 0.1, validation: float = 0.125, trials: int = 32, seed: int = 0) -> DataFrame:
    """rows of the wanted labels with `split`: a core pool parted by serials, all other rows on the test side.

    `evaluation` marks the rows that are neither for training nor for test."""
    kept = rows.where(F.col(label).isin(list(targets))).withColumn("_group", group)
    counts = settle(kept.groupBy(F.col("_group").alias("group"), F.col(label).alias("label")).agg(F.count("*").alias("n")))
    core = settle(core_pool(counts, targets, test, validation, trials, seed))
    inside = counts.join(core, "group", "left_semi")
    first = settle(drawn_sides(inside, test, trials, seed))
    second = drawn_sides(inside.join(first.where("NOT test"), "group", "left_semi"), validation, trials, seed)
    sides = first.where("test").select("group", F.lit("test").alias("split")).union(second.select("group", F.when(F.col("test"), "validation").otherwise("train").alias("split")))
    out = kept.join(sides.withColumnRenamed("group", "_group"), "_group", "left").withColumn("split", F.coalesce("split", F.lit("test")))
    return out.select(*rows.columns, "split", (F.col("split") == "validation").alias("evaluation"))


def rest_for_evaluation(full: DataFrame, split: DataFrame, keys: Sequence[str] = ("line", "sn", "sample_id")) -> DataFrame:
    """All rows that are neither for training nor for test, by their keys."""
    used = split.where(F.col("split").isin("train", "test")).select(*(F.coalesce(F.col(k).cast("string"), F.lit("None")).alias(f"_{k}") for k in keys)).distinct()
    same = [F.coalesce(full[k].cast("string"), F.lit("None")) == used[f"_{k}"] for k in keys]
    return full.join(used, same, "left_anti")
