"""Imported label sheets: results and reasons from words, lines from what is known, one row per label.

A sheet has a column `row` that numbers its rows; rules are a short list of reasons, the rest are DataFrames.
"""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_text, source_name

#: Words for results.
RESULT_WORDS = {"正常": "ok", "ok": "ok", "异常": "nok", "故障": "nok", "nok": "nok", "边界": "boundary", "不确定": "boundary", "boundary": "boundary"}
#: How sure a label is, by the first of these words in its reason.
STRENGTHS = {"轻微": 0.6, "中等": 0.8, "强烈": 0.95}
#: Reasons that results have by themselves.
OWN_REASONS = {"ok": "clean_normal", "boundary": "boundary"}
#: What does not count when reasons are compared.
IGNORED = r"[\s_\-—,，。.:：;；、/\\()（）\[\]{}]+"
#: Forms of times in sheets.
TIME_FORMS = ("yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s", "yyyy/M/d H:m:s", "yyyy-M-d H:m", "yyyy/M/d H:m", "yyyy-M-d", "yyyy/M/d")
ISO = "yyyy-MM-dd'T'HH:mm:ss"
#: Columns of annotators in sheets.
FIELDS = ("operator", "up", "up_type", "down", "down_type", "result")


@dataclass(frozen=True)
class Reason:
    key: str
    name: str
    result: str
    aliases: tuple[str, ...] = ()


def result_key(raw: Column, results: Sequence[str]) -> Column:
    """The result of a word: its key in any case, or one of the known words as it stands; null for others."""
    word = norm_text(raw)
    known = F.create_map(*(F.lit(x) for k, v in RESULT_WORDS.items() if v in results for x in (k, v)))
    return F.when(F.lower(word).isin(*results), F.lower(word)).otherwise(F.element_at(known, word))


def bare_reason(text: str) -> str:
    """A reason in compatible characters and lower case, without signs and blanks."""
    return re.sub(IGNORED, "", unicodedata.normalize("NFKC", text).lower())


def reason_matcher(reasons: Sequence[Reason], cutoff: float) -> Callable[[Column], Column]:
    """Column function from reason texts to (key, token, score, shown): a name as it stands scores 1, one that differs only by
    what does not count 0.999, others by common blocks, at least 0.9 where one text holds the other. Of equal scores the reason
    listed first wins; key is null below the cutoff."""
    exact = {name: r.key for r in reasons for name in (r.name, *r.aliases)}
    tokens = [(bare_reason(name), r.key, name) for r in reasons for name in (r.name, *r.aliases) if bare_reason(name)]

    def score(text: str, token: str) -> float:
        if text == token:
            return 0.999
        held = 0.9 if text in token or token in text else 0.0
        return max(difflib.SequenceMatcher(a=text, b=token).ratio(), held)

    def best(raw: str) -> tuple[str | None, str | None, float | None, str | None]:
        if raw in exact:
            return exact[raw], raw, 1.0, "1.00"
        text = bare_reason(raw)
        scored = [(score(text, token), -i) for i, (token, _, _) in enumerate(tokens)] if text else []
        top, place = max(scored, default=(0.0, 0))
        if not scored or top < cutoff:
            return None, None, None, None
        return tokens[-place][1], tokens[-place][2], top, f"{top:.2f}"

    @F.pandas_udf("key string, token string, score double, shown string")
    def match(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([best(t) for t in texts], columns=["key", "token", "score", "shown"])

    return match


def own_reason(result: Column, reasons: Sequence[Reason]) -> Column:
    """The reason of a label that names none: the result's own, or the only one that it has; else null."""
    found = {}
    for kind in dict.fromkeys(r.result for r in reasons):
        keys = [r.key for r in reasons if r.result == kind]
        if OWN_REASONS.get(kind) in keys:
            found[kind] = OWN_REASONS[kind]
        elif len(keys) == 1:
            found[kind] = keys[0]
    return F.element_at(F.create_map(*(F.lit(x) for kv in found.items() for x in kv)), result) if found else F.lit(None).cast("string")


def confidence(reason: Column, default: float) -> Column:
    out = F.lit(float(default))
    for word, value in reversed(STRENGTHS.items()):
        out = F.when(F.contains(reason, F.lit(word)), value).otherwise(out)
    return out


def sheet_time(x: Column, now: Column | None = None) -> Column:
    """A time of any known form in ISO form; other text stays, empty text becomes the present."""
    read = F.coalesce(*(F.try_to_timestamp(norm_text(x), F.lit(f)) for f in TIME_FORMS))
    return F.coalesce(F.date_format(read, ISO), norm_text(x), F.date_format(F.current_timestamp() if now is None else now, ISO))


def block_time(date: Column, hour: Column) -> Column:
    """The start of an hour of a day; the date alone where the hour is none of 0 to 23, null where the date cannot be read."""
    day = F.coalesce(*(F.try_to_timestamp(norm_text(date), F.lit(f)) for f in ("yyyy-MM-dd", "yyyyMMdd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss")))
    number = norm_text(hour).try_cast("double").cast("int")
    at = F.when(number.between(0, 23), F.timestamp_add("HOUR", number, F.date_trunc("day", day))).otherwise(day)
    return F.date_format(at, ISO)


def annotator_groups(columns: Sequence[str]) -> list[int]:
    """The numbers of the annotators that a sheet's columns name; plain columns are the first one's."""
    found = {int(m[1]) for c in columns if (m := re.fullmatch(rf"label_(\d+)_({'|'.join(FIELDS)})", c.strip()))}
    return sorted(found | ({1} if set(FIELDS[1:]) & {c.strip() for c in columns} else set()))


def has_annotators(columns: Sequence[str]) -> bool:
    """Whether a sheet is by several annotators: it names an operator and a direction of a numbered group."""
    return any(re.fullmatch(r"label_\d+_operator", c.strip()) for c in columns) and any(re.fullmatch(r"label_\d+_(up|down)", c.strip()) for c in columns)


def sheet_labels(sheet: DataFrame, source: str = "operator", by_annotators: bool | None = None, now: Column | None = None) -> DataFrame:
    """One row per label of a sheet: row, line, sn, reference, at, place, direction, source, result, reason and the parts of a note.

    A plain sheet gives both directions of each row; a sheet by annotators what each of them filled in."""
    several = has_annotators(sheet.columns) if by_annotators is None else by_annotators
    get = lambda *names: F.coalesce(*(norm_text(F.col(f"`{n}`").cast("string")) for n in names if n in sheet.columns), F.lit(None).cast("string"))
    stated = get("timestamp", "label_time")

    def label(place: str, direction: str, of: Column, result: Column, reason: Column, *notes: Column) -> Column:
        return F.struct(F.lit(place).alias("place"), F.lit(direction).alias("direction"), of.alias("source"), result.alias("result"), reason.alias("reason"), F.array(*notes).alias("notes"))

    labels = []
    if several:
        for k in annotator_groups(sheet.columns):
            field = lambda name, k=k: get(f"label_{k}_{name}", *([name] if k == 1 and name != "operator" else []))
            group = F.concat(F.lit("group_result="), field("result"))
            of = F.coalesce(source_name("operator", field("operator")), F.lit("operator"))
            reference = F.concat(F.lit("reference="), get("reference"))
            labels += [
                F.when(F.coalesce(field(way), field("result"), field(f"{way}_type")).isNotNull(), label(f"label_{k}_{way}", way, of, F.coalesce(field(way), field("result")), field(f"{way}_type"), get("note"), F.lit(f"employee_group=label_{k}"), reference, group))
                for way in ("up", "down")
            ]
        at = F.when(stated.isNull(), F.coalesce(block_time(get("date_day", "date"), get("hour_block", "hour")), sheet_time(get("date_day", "date"), now))).otherwise(sheet_time(stated, now))
    else:
        hint = F.concat(F.lit("result="), get("result"))
        labels = [label(way, way, F.lit(source), get(way), get(f"{way}_type"), get(f"{way}_note"), get("note"), hint) for way in ("up", "down")]
        at = sheet_time(stated, now)
    rows = sheet.select("row", get("line").alias("line"), get("sn").alias("sn"), get("reference").alias("reference"), at.alias("at"), F.explode(F.array(*labels)).alias("l"))
    return rows.where("l IS NOT NULL").select("row", "line", "sn", "reference", "at", "l.*")


def with_lines(rows: DataFrame, history: DataFrame, manifest: DataFrame, line: str = "") -> DataFrame:
    """Rows with the line they lack: the given one, else the newest that history or the manifest has for the serial, else the
    newest of the reference, else the only line of history or of the manifest.

    history: sn, line, timestamp, id; manifest: sn, reference, line, timestamp, id."""

    def newest(known: DataFrame, key: str, name: str) -> DataFrame:
        clean = known.select(norm_text(F.col(key)).alias(key), norm_text(F.col("line")).alias("line"), F.struct("timestamp", "id").alias("at")).where(f"{key} IS NOT NULL AND line IS NOT NULL")
        return clean.groupBy(key).agg(F.max_by("line", "at").alias(name))

    def only(known: DataFrame) -> Column:
        lines = known.agg(F.count_distinct(norm_text(F.col("line"))).alias("n"), F.max(norm_text(F.col("line"))).alias("line"))
        return lines.select(F.when(F.col("n") == 1, F.col("line"))).scalar()

    found = rows.join(newest(history, "sn", "_history"), "sn", "left").join(newest(manifest, "sn", "_serial"), "sn", "left").join(newest(manifest, "reference", "_reference"), "reference", "left")
    own = F.coalesce(norm_text(F.col("line")), norm_text(F.lit(line)), "_history", "_serial", "_reference", only(history), only(manifest))
    return found.withColumn("line", own).select(rows.columns)


def import_records(labels: DataFrame, results: Sequence[str], reasons: Sequence[Reason], cutoff: float = 0.72, sure: float = 1.0) -> DataFrame:
    """Labels with keys of results and reasons, confidence, score of the match, note and, where a rule is broken, the error.

    Reasons are matched once per distinct text. Rows without an error can be appended to the store."""
    match = reason_matcher(reasons, cutoff)
    texts = labels.select("reason").where("reason IS NOT NULL").distinct().withColumn("_m", match("reason"))
    rows = labels.join(texts, "reason", "left").withColumn("result_key", result_key(F.col("result"), results))
    own = own_reason(F.col("result_key"), reasons)
    names = F.create_map(*(F.lit(x) for r in reasons for x in (r.key, r.name)))
    auto = F.col("reason").isNull()
    rows = rows.withColumn("reason_key", F.when(auto, own).otherwise(F.col("_m.key")))
    rows = rows.withColumns({"score": F.when(auto & F.col("reason_key").isNotNull(), 1.0).otherwise(F.col("_m.score")), "matched": F.when(auto, F.element_at(names, F.col("reason_key"))).otherwise(F.col("_m.token"))})
    error = (
        F.when(F.col("sn").isNull(), "no serial").when(F.col("line").isNull(), "no line").when(F.col("result_key").isNull(), F.concat_ws(": ", F.lit("no such result"), "result"))
        .when(F.col("reason_key").isNull(), F.when(auto, "no reason").otherwise(F.concat_ws(": ", F.lit("no such reason"), "reason")))
    )
    notes = F.concat(
        "notes",
        F.array(F.when(auto, F.concat(F.lit("reason_auto="), "result_key", F.lit("->"), "matched"))),
        F.array(F.when(F.col("score") < 0.999, F.concat(F.lit("fuzzy="), "reason", F.lit("->"), "matched", F.lit("("), "_m.shown", F.lit(")")))),
    )
    return rows.select(
        "row", "place", "line", "sn", F.concat_ws("_", "sn", "direction").alias("sample_id"), "direction", "result_key", "reason_key", "at", "source",
        F.array_join(F.filter(notes, lambda n: n.isNotNull()), " | ").alias("note"), confidence(F.coalesce("reason", F.lit("")), sure).alias("confidence"), "score", "matched", error.alias("error"),
    )
