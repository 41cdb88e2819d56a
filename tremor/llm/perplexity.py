"""Quality rules with n-gram perplexity bands.

A modified, interpolated Kneser-Ney model over the characters (code points) of the texts, all of them
told apart, of order 4; each text stands behind three line feeds. Spark counts the n-grams of all texts
in a table dealt by n-gram that grows with the corpus; lower orders count how many different
characters stand before them; discounts come from the counts of counts of each order, and the
probabilities of an order from joins with its contexts and with the order below. Below single
characters all that were seen, and one unknown, are equally likely. No text has an n-gram that the
table lacks, as all texts are counted, so a scored n-gram never backs off. A text's perplexity is per
character.

The `common` most frequent n-grams (a bounded table) are broadcast as an array sorted by hash and
scored where texts are read; all others are joined to the dealt table by the same 64-bit hash. The
counts are exact but for n-grams of equal hash within one task. Logarithms are whole numbers of 2^-32
before they are summed, so no sum depends on its order.

For each language the log-perplexities of all documents that pass the base rules give a median and a
median absolute deviation; documents beyond `width` deviations below or above are rejected. Medians
come from histograms with bins of 1/1024, so they cover all documents and any language may be large.

Defined results. A null or empty text has no words, fails the base rules, and has no perplexity. A
null language is a language. Where the deviation is 0, only documents with exactly the median's bin
or within one bin of it are kept. Bytes that are no UTF-8 are the character U+FFFD to the model.
Repeated rows count each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, filled, settle, small
from .context_tree import frequent
from .kernels import U64, Rolling, Words, byte_rolling, mix, pieces
from .ngrams import counted, look_up

ORDER = 4
BINS = 1024
#: Units of a logarithm.
UNITS = 1 << 32
#: N-grams that a task holds before it gives out their counts.
HELD = 1_000_000
_ODD = U64(0x9E3779B97F4A7C15 & ((1 << 48) - 1) | 1)


def hashed(code: np.ndarray) -> np.ndarray:
    """A bijection of codes of up to 48 bits, by which the model's arrays are sorted."""
    return (code * _ODD) & U64((1 << 48) - 1)


@dataclass
class Grams:
    """The ORDER-grams that end at each character of some texts: hashes, and where they begin in chars; the number of each text's."""

    chars: np.ndarray
    begins: np.ndarray
    hashes: np.ndarray
    sizes: np.ndarray

    def shown(self, which: np.ndarray) -> np.ndarray:
        """The characters of some n-grams, one row each."""
        return self.chars[self.begins[which][:, None] + np.arange(ORDER)]


def grams(data: np.ndarray, offsets: np.ndarray) -> Grams:
    n, lead = len(offsets) - 1, ORDER - 1
    starts = offsets + lead * np.arange(n + 1)
    out = np.full(starts[-1], 0x0A, np.uint8)
    own = np.ones(len(out), bool)
    own[(starts[:-1, None] + np.arange(lead)).reshape(-1)] = False
    out[own] = data
    try:
        text = out.tobytes().decode()
    except UnicodeDecodeError:
        valid = [data[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return grams(np.frombuffer(b"".join(valid), np.uint8), np.cumsum([0, *map(len, valid)]))
    chars = np.frombuffer(text.encode("utf-32-le"), "<u4")
    begins = np.flatnonzero(own[(out & 0xC0) != 0x80][lead:])
    before = np.zeros(len(out) + 1, np.int64)
    np.cumsum((out & 0xC0) != 0x80, out=before[1:])
    return Grams(chars, begins, hashes_at(chars, begins), np.diff(before[starts]) - lead)


def hashes_at(chars: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ORDER-grams that begin at some places."""
    return mix(Rolling(mix(chars.astype(U64))).spans(begins, begins + ORDER))


@dataclass
class Model:
    """For each order from 1: sorted hashes of seen n-grams and their log probabilities; for the contexts
    of orders from 2 sorted hashes and the log weights of backing off."""

    seen: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    bits: int = 6

    def log(self, code: np.ndarray) -> np.ndarray:
        """log probability of the last symbol of each n-gram of the highest order after those before it."""
        out, open_, weight = np.full(len(code), np.nan), np.arange(len(code)), np.zeros(len(code))
        for order in range(len(self.seen), 0, -1):
            short = code[open_] & U64((1 << self.bits * order) - 1)
            at, hit = look_up(self.seen[order - 1], hashed(short))
            out[open_[hit]] = weight[open_[hit]] + self.logs[order - 1][at[hit]]
            open_, short = open_[~hit], short[~hit]
            if order > 1 and len(open_):
                at, hit = look_up(self.contexts[order - 2], hashed(short >> U64(self.bits)))
                weight[open_[hit]] += self.backoff[order - 2][at[hit]]
        # A symbol that no text has: as likely as one of all symbols under what unigrams leave.
        out[open_] = weight[open_] - np.log(1 << self.bits) - np.log(1e6)
        return out


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """What modified Kneser-Ney takes off counts of 0, 1, 2, and 3 or more, by the numbers of n-grams with counts 1 to 4."""
    n1, n2, n3, n4 = (max(n, 1) for n in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    off = np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.05, [0.05, 0.95, 1.95, 2.95])
    off[0] = 0
    return off


def kneser_ney(code: np.ndarray, count: np.ndarray, most: int = 4, bits: int = 6) -> Model:
    """The model of counted n-grams of symbols of few bits, in arrays of one process."""
    tables = [(code, count)]
    for order in range(most - 1, 0, -1):
        above = tables[-1][0]
        tables.append(counted(above & U64((1 << bits * order) - 1)))
    tables.reverse()
    seen, logs, contexts, backoff = [], [], [], []
    below_code, below_p = None, None
    for order, (gram, n) in enumerate(tables, 1):
        off = discounts(*(int((n == k).sum()) for k in (1, 2, 3, 4)))
        context, where = np.unique(gram >> U64(bits), return_inverse=True)
        total = np.bincount(where, n)
        less = off[np.minimum(n, 3)]
        left = np.bincount(where, less) / total
        if below_p is None:
            lower = np.full(len(gram), 1 / (1 << bits))
        else:
            at, _ = look_up(below_code, gram & U64((1 << bits * (order - 1)) - 1))
            lower = below_p[at]
        p = (n - less) / total[where] + left[where] * lower
        below_code, below_p = gram, p
        for keys, values, to, out in ((gram, np.log(p), seen, logs), (context, np.log(left), contexts, backoff)):
            if out is backoff and order == 1:
                continue
            key = hashed(keys)
            sort = np.argsort(key)
            to.append(key[sort])
            out.append(values[sort].astype(np.float32))
    return Model(seen, logs, contexts, backoff, bits)


def merged(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Several tables of hashes, characters and counts as one."""
    code, shown, n = (np.concatenate(x) for x in zip(*held, strict=True))
    code, first, where = np.unique(code, return_index=True, return_inverse=True)
    return code, shown[first], np.bincount(where, n, len(code)).astype(np.int64)


def count(docs: DataFrame) -> DataFrame:
    """(gram, n): the ORDER-grams of all texts with their counts, summed in tasks before they are exchanged."""

    def out(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        _, shown, n = merged(held)
        data = shown.astype("<u4").tobytes().decode("utf-32-le").encode()
        ends = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)[::ORDER], len(data)).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.StringArray.from_buffers(len(n), pa.py_buffer(ends), pa.py_buffer(data)), pa.array(n)], ["gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, data, offsets in pieces(batches):
            found = grams(data, offsets)
            code, first, n = np.unique(found.hashes, return_index=True, return_counts=True)
            held.append((code, found.shown(first), n))
            size += len(code)
            if size > HELD:
                held = [merged(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    return docs.select("text").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def probabilities(grams: DataFrame) -> DataFrame:
    """(gram, n, p): for counted ORDER-grams the probability of the last character after those before it."""
    tables = [filled(grams)]
    for order in range(ORDER - 1, 0, -1):
        tables.append(filled(tables[-1].groupBy(F.substring("gram", 2, order).alias("gram")).agg(F.count("*").alias("n"))))
    tables.reverse()
    below = None
    for order, table in enumerate(tables, 1):
        off = [float(x) for x in discounts(*table.agg(*(F.count_if(F.col("n") == k) for k in (1, 2, 3, 4))).first())]
        context = F.substring("gram", 1, order - 1)
        by = table.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), *(F.count_if(F.least("n", F.lit(3)) == k).alias(f"n{k}") for k in (1, 2, 3)))
        left = sum((F.col(f"n{k}") * off[k] for k in (2, 3)), F.col("n1") * off[1]) / F.col("total")
        contexts = filled(by.select("context", "total", left.alias("left")))
        rows = table.withColumn("context", context).join(small(contexts), "context")
        if below is None:
            rows = rows.withColumn("lower", F.lit(1.0) / (table.count() + 1))
        else:
            rows = rows.withColumn("shorter", F.substring("gram", 2, order - 1)).join(small(below.select(F.col("gram").alias("shorter"), F.col("p").alias("lower"))), "shorter")
        less = F.element_at(F.array(*(F.lit(x) for x in off[1:])), F.least("n", F.lit(3)).cast("int"))
        below = filled(rows.select("gram", "n", ((F.col("n") - less) / F.col("total") + F.col("left") * F.col("lower")).alias("p")))
    return below


def train(docs: DataFrame) -> DataFrame:
    """(code, n, units): the hash of each ORDER-gram of the texts, its count and its log probability in UNITS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, _ in pieces(batches, "gram"):
            chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
            code = hashes_at(chars, ORDER * np.arange(rows.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), rows.column("n"), rows.column("units")], ["code", "n", "units"])

    table = probabilities(count(docs)).select("gram", "n", F.round(F.log("p") * UNITS).cast("long").alias("units"))
    return settle(table.mapInArrow(run, "code long, n long, units long"))


_SIGNS = np.zeros(256, bool)
_SIGNS[list(b"#*$%&|<>")] = True


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(offsets) - 1
    words = Words(data, offsets)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    chars = np.zeros(len(words.starts) + 1, np.int64)
    np.cumsum(lead[words.ends] - lead[words.starts], out=chars[1:])
    signs = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SIGNS[data], out=signs[1:])
    codes_ = Rolling(words.hashes())
    doc = words.doc_of()
    # Windows of three words that occur twice or more in their text.
    window = codes_.every(3)
    inside = np.arange(len(window)) + 3 <= words.first[doc[: len(window)] + 1]
    key = mix(window + mix(doc[: len(window)].astype(U64)))[inside]
    _, where, times = np.unique(key, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(inside)[times[where] > 1]
    again = np.zeros(len(words.starts) + 2, bool)
    for k in range(3):
        again[twice + k] = True
    # Lines with a word, as bytes, that equal an earlier line of their text.
    breaks = np.flatnonzero(data == 0x0A)
    line_start = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    line_doc = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1])
    line_doc = np.sort(line_doc)
    line_end = np.empty(len(line_start), np.int64)
    line_end[:-1] = line_start[1:] - 1
    line_end[-1:] = len(data)
    is_last = np.append(line_doc[1:] != line_doc[:-1], True) if len(line_doc) else np.zeros(0, bool)
    line_end[is_last] = offsets[line_doc[is_last] + 1]
    has_word = np.searchsorted(words.starts, line_start) < np.searchsorted(words.starts, line_end)
    name = mix(byte_rolling(data).spans(line_start, line_end) + mix(line_doc.astype(U64) * U64(31) + (line_end - line_start).astype(U64)))[has_word]
    _, first = np.unique(name, return_index=True)
    lines = np.bincount(line_doc[has_word], minlength=n) - np.bincount(line_doc[has_word][first], minlength=n)
    return {
        "n_words": words.counts,
        "word_chars": chars[words.first[1:]] - chars[words.first[:-1]],
        "n_symbols": signs[offsets[1:]] - signs[offsets[:-1]],
        "n_dup_lines": lines,
        "n_repeat_words": np.bincount(doc[again[: len(doc)]], minlength=n),
    }


_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, model: DataFrame, common: int) -> DataFrame:
    """(doc_id, lang, statistics, log_perplexity) of every text."""
    top = model.where(F.col("n") >= frequent(model.withColumnRenamed("n", "c"), common)).select("code", "units").toPandas()
    code = top["code"].to_numpy(np.int64).view(U64)
    order = np.argsort(code)
    shared = docs.sparkSession.sparkContext.broadcast((code[order], top["units"].to_numpy(np.int64)[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, units = shared.value
        for rows, data, offsets in pieces(batches):
            found = grams(data, offsets)
            code, where = np.unique(found.hashes, return_inverse=True)
            at, hit = look_up(codes, code)
            value = np.zeros(len(code), np.int64)
            value[hit] = units[at[hit]]
            ends = np.cumsum(np.append(0, found.sizes))
            sums = np.append(0, np.cumsum(value[where]))[ends]
            # Of all other n-grams each text's distinct ones with their numbers.
            rest = np.flatnonzero(~hit[where])
            owner, rest = np.searchsorted(ends, rest, "right") - 1, where[rest]
            order = np.lexsort((rest, owner))
            owner, rest = owner[order], rest[order]
            new = np.flatnonzero(np.append(True, (rest[1:] != rest[:-1]) | (owner[1:] != owner[:-1]))) if len(rest) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(rest)))
            rare = pa.StructArray.from_arrays([pa.array(code[rest[new]].view(np.int64)), pa.array(times)], ["code", "k"])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.append(0, np.bincount(owner[new], minlength=rows.num_rows))), pa.int32()), rare)
            stats = statistics(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [rows.column("row"), rows.column("doc_id"), rows.column("lang"), *(pa.array(stats[f].astype(np.int64)) for f in _FIELDS), pa.array(found.sizes), pa.array(np.diff(sums)), lists],
                ["row", "doc_id", "lang", *_FIELDS, "size", "units", "rare"],
            )

    schema = "row long, doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, size long, units long, rare array<struct<code:bigint,k:bigint>>"
    rows = settle(docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, schema))
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.*")
    rest = rare.join(model.select("code", F.col("units").alias("each")), "code").groupBy("row").agg(F.sum(F.col("k") * F.col("each")).alias("more"))
    # Without a character there is no perplexity.
    value = -(F.col("units") + F.coalesce("more", F.lit(0))) / UNITS / F.nullif("size", F.lit(0))
    return rows.drop("rare").join(rest, "row", "left").select("doc_id", "lang", *_FIELDS, value.alias("log_perplexity"))


def median_bin(rows: DataFrame, value: str) -> DataFrame:
    """(lang, median): the bin of the lower median of a column of whole numbers, by histogram."""
    bins = rows.groupBy("lang", value).agg(F.count("*").alias("n"))
    by = Window.partitionBy("lang")
    run = F.sum("n").over(by.orderBy(value))
    return bins.withColumns({"run": run, "all": F.sum("n").over(by)}).where("2 * run >= all").groupBy("lang").agg(F.min(value).alias("median"))


def filter_quality(docs: DataFrame, width: float = 5.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", common: int = 1 << 20) -> DataFrame:
    """(doc_id, lang, statistics, log_perplexity, low, high, base_failed, kept), one row per input row."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = measured(docs, train(docs), common)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = settle(rows.withColumn("base_failed", failed).withColumn("bin", F.floor(F.col("log_perplexity") * BINS).cast("int")))
    fair = rows.where("NOT base_failed AND bin IS NOT NULL").select("lang", "bin")
    middle = settle(median_bin(fair, "bin").withColumnRenamed("lang", "of"))
    away = fair.join(small(middle), F.col("lang").eqNullSafe(F.col("of"))).select("lang", F.abs(F.col("bin") - F.col("median")).alias("away"))
    spread = median_bin(away, "away").select(F.col("lang").alias("lang2"), F.col("median").alias("deviation"))
    bands = settle(middle.join(spread, F.col("of").eqNullSafe(F.col("lang2"))).select("of", *((F.col("median") + sign * F.greatest(F.lit(1.0), width * 1.4826 * F.col("deviation"))).alias(name) for sign, name in ((-1, "low_bin"), (1, "high_bin")))))
    out = rows.join(small(bands), F.col("lang").eqNullSafe(F.col("of")), "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("bin").between(F.col("low_bin"), F.col("high_bin")), F.lit(False))
    return out.select("doc_id", "lang", *_FIELDS, "log_perplexity", (F.col("low_bin") / BINS).alias("low"), (F.col("high_bin") / BINS).alias("high"), "base_failed", kept.alias("kept"))
