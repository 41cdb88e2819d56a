"""Text rules: empty values, sources, times, file names, notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as empty text.
EMPTY = ("", "nan", "none", "null")
#: Names of source categories.
SOURCE_ALIASES = {"expert": "expert", "专家": "expert", "operator": "operator", "员工": "operator", "人工": "operator", "model": "model", "ai": "model"}
#: Order of trust of the categories; others have OTHER_RANK.
SOURCE_RANKS = {"expert": 0, "operator": 1, "model": 2}
OTHER_RANK = 99


def norm_text(x: Column) -> Column:
    """Trimmed text; null for what counts as empty."""
    return F.when(~F.lower(F.trim(x)).isin(*EMPTY), F.trim(x))


def to_int(x: Column) -> Column:
    """The whole part of a number written as text, null for other text."""
    number = norm_text(x).try_cast("double")
    return F.when(~F.isnan(number), F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))).cast("int")


def source_category(source: Column) -> Column:
    """expert, operator or model by prefix or alias; other sources in lower case, empty ones null."""
    low = F.lower(norm_text(source))
    prefix = F.regexp_extract(low, r"^(expert|operator|model)([_\-:.]|$)", 1)
    alias = F.element_at(F.create_map(*(F.lit(x) for kv in SOURCE_ALIASES.items() for x in kv)), low)
    return F.coalesce(F.when(prefix != "", prefix), alias, low)


def source_rank(category: Column) -> Column:
    ranks = F.create_map(*(F.lit(x) for kv in SOURCE_RANKS.items() for x in kv))
    return F.coalesce(F.element_at(ranks, category), F.lit(OTHER_RANK))


def source_name(category: str, part: Column) -> Column:
    """A source of a category, its second part reduced to letters, digits and single underscores."""
    safe = F.regexp_replace(F.regexp_replace(F.trim(part), r"[^0-9A-Za-z]+", "_"), r"^_+|_+$", "")
    return F.when(safe == "", F.lit(category)).otherwise(F.concat_ws("_", F.lit(category), safe))


def parsed_time(x: Column, formats: tuple[str, ...] = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy-MM-dd")) -> Column:
    """The first format that the text has, null for none."""
    return F.coalesce(*(F.try_to_timestamp(norm_text(x), F.lit(f)) for f in formats))


def compact_time(x: Column, day_first: Column) -> Column:
    """Fourteen digits as a time, year or day first, the other order where that is no time."""
    digits = F.regexp_replace(x, r"\D", "")
    year, day = (F.try_to_timestamp(digits, F.lit(f)) for f in ("yyyyMMddHHmmss", "ddMMyyyyHHmmss"))
    return F.when(F.length(digits) == 14, F.when(day_first, F.coalesce(day, year)).otherwise(F.coalesce(year, day)))


def line_time(x: Column, day_first: Column) -> Column:
    """The time of a file name in one form, as text; what cannot be read, is empty or begins with UNKNOWN stays as it is."""
    raw = F.trim(F.coalesce(x, F.lit("")))
    read = F.when(~F.startswith(F.upper(raw), F.lit("UNKNOWN")), F.date_format(compact_time(raw, day_first), "yyyyMMdd_HHmmss"))
    return F.coalesce(read, raw)


def name_token(stem: Column, sign: str, index: int) -> Column:
    """A part of a file name between signs, UNKNOWN beyond its end."""
    return F.coalesce(F.try_element_at(F.split(stem, sign), F.lit(index + 1)), F.lit("UNKNOWN"))


#: Keys that imports leave in notes, and the tag of typical samples.
NOTE_KEYS = ("result", "reason_auto", "fuzzy", "raw_result", "raw_reason", "raw_label", "factory_source_kind", "factory_source_path", "factory_source_row", "dedup_same_sample_source_label_count", "group", "reference")
TYPICAL = "[[prototype]]"


def clean_note(note: Column) -> Column:
    """A note without the segments between bars that imports leave, key=value of known keys; the typical tag leads."""
    text = F.coalesce(note, F.lit(""))
    parts = F.transform(F.split(F.replace(text, F.lit(TYPICAL), F.lit("")), r"\|"), lambda p: F.trim(p))
    left = lambda p: F.contains(p, F.lit("=")) & F.lower(F.trim(F.substring_index(p, "=", 1))).isin(*NOTE_KEYS)
    joined = F.array_join(F.filter(parts, lambda p: (p != "") & ~left(p)), " | ")
    return F.when(F.contains(text, F.lit(TYPICAL)), F.trim(F.concat(F.lit(TYPICAL + " "), joined))).otherwise(joined)


def byte_size(n: Column) -> Column:
    """A number of bytes in the largest unit that leaves one or more, with one decimal, halves to the even digit."""
    size = F.greatest(n.cast("long"), F.lit(0))
    steps = F.array(*(F.lit(1024**k) for k in range(1, 6)))
    unit = F.size(F.filter(steps, lambda s: size >= s))
    names = F.array(*(F.lit(u) for u in ("B", "KB", "MB", "GB", "TB", "PB")))
    return F.format_string("%.1f %s", F.bround(size / F.pow(F.lit(1024.0), unit), 1), F.element_at(names, unit + 1))


def group_key(line: Column, reference: Column, sn: Column, source_sn: Column, row: Column) -> Column:
    """What must stay together in a split: line, reference and the serial that a row comes from; blank serials stand alone."""
    serial = F.coalesce(norm_text(source_sn), norm_text(sn), F.concat(F.lit("row-"), row.cast("string")))
    return F.concat_ws("::", F.coalesce(norm_text(line), F.lit("")), F.coalesce(norm_text(reference), F.lit("")), serial)
