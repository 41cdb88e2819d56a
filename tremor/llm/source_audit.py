"""Divergence of sources: which sources of a language use which terms unlike the others.

Each partition counts the terms of its texts in byte radix tries, one for each language, whose leaves have counters of
occurrences and documents per source. A trie is written out in byte order whenever it holds LEAVES terms. Tries are
merged by range of (language, term): rows with equal terms follow each other and are folded as they stream by, so one
row is kept at a time however often a term was written. The kept terms are then read in UTF-8 order once more: blocks
of terms become a matrix of shares, whose absolute differences are summed per pair of sources, and each source's
candidates stay with the first of equal values, as UTF-8 order brings the lesser term first.

A share is p = 1 + floor(10^9 (count + 5) / (N + 5 V)), by long division in 64-bit integers, exact for up to 9 * 10^15
terms. A result has a row for each ordered pair of sources of a language, so the sources of a language, of which lists
are held in tasks, are the square root of the result; languages are worked on in slices of at most GROUPS groups, and
a language with more than STRIP sources in strips of sources, so neither tables of groups nor matrices grow beyond it.

Defined results. Null text, lang and source are ''. Rows count as documents each, repeated ones too. A language without
kept terms has pairs of value 0 and no terms; a lone source has no pairs; an empty table gives an empty result. Extra
columns are ignored. A term of any length is kept whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, settle, stored
from .kernels import Words, lower, pieces

#: Terms that the tries of a task hold before they are written out.
LEAVES = 250_000
#: Groups of language and source that are broadcast at once, if no single language has more.
GROUPS = 50_000
#: Sources whose pairs with all others one task sums.
STRIP = 256
#: Bytes of text whose distinct terms are looked up together.
STEP = 4 << 20
#: Cells of a matrix of terms and sources.
CELLS = 1 << 20

_TERM = np.zeros(256, bool)
_TERM[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Trie:
    """A byte radix trie: edges carry byte strings, and nodes at which a term ends have a number."""

    def __init__(self):
        self.root, self.size = [-1, None], 0

    def add(self, term: bytes) -> int:
        """The number of a term, a new one if it is not there yet."""
        node, at = self.root, 0
        while at < len(term):
            edges = node[1]
            if edges is None:
                edges = node[1] = {}
            edge = edges.get(term[at])
            if edge is None:
                fresh = [-1, None]
                edges[term[at]] = (term[at:], fresh)
                node = fresh
                break
            label, below = edge
            if not term.startswith(label, at):
                shared = 1
                while shared < len(term) - at and term[at + shared] == label[shared]:
                    shared += 1
                middle = [-1, {label[shared]: (label[shared:], below)}]
                edges[term[at]] = (label[:shared], middle)
                label, below = label[:shared], middle
            node, at = below, at + len(label)
        if node[0] < 0:
            node[0] = self.size
            self.size += 1
        return node[0]

    def walk(self) -> Iterator[tuple[bytes, int]]:
        """Terms in byte order with their numbers."""
        left = [(b"", self.root)]
        while left:
            term, (number, edges) = left.pop()
            if number >= 0:
                yield term, number
            if edges:
                left += [(term + edges[b][0], edges[b][1]) for b in sorted(edges, reverse=True)]


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, with the sums of their values."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return (keys[starts], *(np.add.reduceat(v[order], starts) for v in values))


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values)


class _Counter:
    """The tries of one partition, with counters for each leaf and source."""

    def __init__(self):
        self.tries: dict[str, Trie] = {}
        self.sources: dict[str, dict[str, int]] = {}
        self.parts: dict[str, list[tuple[np.ndarray, ...]]] = {}

    def count(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> None:
        langs, sources = rows.column("lang").to_pylist(), rows.column("source").to_pylist()
        solid = _TERM[data]
        words = Words(data, offsets, solid)
        ends = np.append(0, np.cumsum(words.ends - words.starts)).astype(np.int32)
        terms = pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(lower(data[solid]))]).dictionary_encode()
        code, names = terms.indices.to_numpy().astype(np.int64), terms.dictionary.to_pylist()
        for lang, source in zip(langs, sources, strict=True):
            of = self.sources.setdefault(lang, {})
            of.setdefault(source, len(of))
        key, n = _summed(words.doc_of() * len(names) + code, np.ones(len(code), np.int64))
        doc, code = np.divmod(key, max(len(names), 1))
        order = {lang: k for k, lang in enumerate(self.sources)}
        lang_of = np.array([order[x] for x in langs])[doc] if len(doc) else doc
        source_of = np.array([self.sources[a][b] for a, b in zip(langs, sources, strict=True)])[doc] if len(doc) else doc
        for lang, k in order.items():
            some = lang_of == k
            if not some.any():
                continue
            width = len(self.sources[lang])
            key, total, docs = _summed(code[some] * width + source_of[some], n[some], np.ones(int(some.sum()), np.int64))
            code_of, source = np.divmod(key, width)
            distinct, at = np.unique(code_of, return_inverse=True)
            trie = self.tries.setdefault(lang, Trie())
            leaf = np.array([trie.add(names[c]) for c in distinct.tolist()], np.int64)
            self.parts.setdefault(lang, []).append((leaf[at], source, total, docs))

    def size(self) -> int:
        return sum(t.size for t in self.tries.values())

    def written(self) -> Iterator[pa.RecordBatch]:
        """All counts in order of terms, and '' for each language with all of its sources; then everything is forgotten."""
        for lang, sources in self.sources.items():
            names = pa.array(list(sources), pa.string())
            yield _batch([lang], [""], np.zeros(1, np.int64), names, np.zeros(len(names), np.int64), np.array([len(names)]))
            if lang not in self.tries:
                continue
            leaf, source, total, docs = (np.concatenate(x) for x in zip(*self.parts[lang], strict=True))
            key, total, docs = _summed(leaf * len(sources) + source, total, docs)
            leaf, source = np.divmod(key, len(sources))
            starts = np.searchsorted(leaf, np.arange(self.tries[lang].size + 1))
            walked = list(self.tries[lang].walk())
            for at in range(0, len(walked), 8192):
                some = np.array([number for _, number in walked[at : at + 8192]])
                sizes = starts[some + 1] - starts[some]
                places = np.repeat(starts[some] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(int(sizes.sum()))
                sums = np.add.reduceat(docs[places], np.append(0, np.cumsum(sizes)[:-1]))
                yield _batch([lang] * len(some), [t.decode() for t, _ in walked[at : at + 8192]], sums, names.take(pa.array(source[places])), total[places], sizes)
        self.__init__()


ROW = "lang string, term string, docs long, sources array<string>, counts array<long>"


def _batch(lang, term, docs: np.ndarray, sources: pa.Array, counts: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(term, pa.string()), pa.array(docs), _lists(sources, sizes), _lists(pa.array(counts), sizes)], ["lang", "term", "docs", "sources", "counts"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = _Counter()
    for piece in pieces(batches, step=STEP):
        counter.count(*piece)
        if counter.size() >= LEAVES:
            yield from counter.written()
    yield from counter.written()


def _folded(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One row for each run of rows with equal language and term."""
    lang, term = batch.column("lang"), batch.column("term")
    n = len(lang)
    if n < 2:
        return batch
    new = np.append(True, pc.or_(pc.not_equal(lang.slice(1), lang.slice(0, n - 1)), pc.not_equal(term.slice(1), term.slice(0, n - 1))).to_numpy(zero_copy_only=False))
    starts, run = np.flatnonzero(new), np.cumsum(new) - 1
    sizes = pc.list_value_length(batch.column("counts")).to_numpy()
    names = pc.list_flatten(batch.column("sources")).dictionary_encode()
    width = max(len(names.dictionary), 1)
    key, counts = _summed(np.repeat(run, sizes) * width + names.indices.to_numpy(), pc.list_flatten(batch.column("counts")).to_numpy())
    row, source = np.divmod(key, width)
    first = pa.array(starts)
    return _batch(lang.take(first), term.take(first), np.add.reduceat(batch.column("docs").to_numpy(), starts), names.dictionary.take(pa.array(source)), counts, np.bincount(row, minlength=len(starts)))


def merged(tries: DataFrame, least_docs: int) -> DataFrame:
    """Tries as one: the terms in at least so many documents of their language, and each language's ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pc.or_(pc.greater_equal(batch.column("docs"), least_docs), pc.equal(batch.column("term"), "")))

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is not None:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            batch = _folded(batch)
            yield whole(batch.slice(0, batch.num_rows - 1))
            last = batch.slice(batch.num_rows - 1)
        if last is not None:
            yield whole(last)

    return tries.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(run, ROW)


def share(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / total), three digits at a time."""
    quotient, rest = np.divmod(count + 5, total)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total)
        quotient = quotient * 1000 + more
    return quotient + 1


class _Audit:
    """Sums over a range of a language's terms, for a strip of its sources."""

    def __init__(self, lang: str, strip: int, sources: list[str], totals: list[int], kept: int, top: int):
        self.lang, self.top, self.sources, self.at = lang, top, sources, {s: k for k, s in enumerate(sources)}
        self.own = range(strip * STRIP, min((strip + 1) * STRIP, len(sources)))
        self.totals, self.total = np.array(totals, np.int64) + 5 * kept, sum(totals) + 5 * kept
        self.pairs = np.zeros((len(self.own), len(sources)), np.int64)
        self.best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object))

    def add(self, rows: pa.RecordBatch) -> None:
        step = max(1, CELLS // len(self.sources))
        for at in range(0, rows.num_rows, step):
            self._block(rows.slice(at, step))

    def _block(self, rows: pa.RecordBatch) -> None:
        sizes = pc.list_value_length(rows.column("counts")).to_numpy()
        term, source = np.repeat(np.arange(len(sizes)), sizes), np.array([self.at[s] for s in pc.list_flatten(rows.column("sources")).to_pylist()], np.int64)
        counts = np.zeros((len(sizes), len(self.sources)), np.int64)
        counts[term, source] = pc.list_flatten(rows.column("counts")).to_numpy()
        p, q = share(counts, self.totals), share(counts.sum(1), self.total)
        for k, s in enumerate(self.own):
            self.pairs[k] += np.abs(p - p[:, s : s + 1]).sum(0)
        mine = slice(self.own.start, self.own.stop)
        more = np.where(counts[:, mine] > 0, p[:, mine] - q[:, None], 0)
        source, term = np.nonzero(more.T > 0)
        names = np.array(rows.column("term").to_pylist(), object)
        old = self.best
        source, value, name = np.append(old[0], source), np.append(old[1], more[term, source]), np.append(old[2], names[term])
        order = np.lexsort((np.arange(len(source)), -value, source))
        source, value, name = source[order], value[order], name[order]
        begins = np.searchsorted(source, source)
        keep = np.arange(len(source)) - begins < self.top
        self.best = (source[keep], value[keep], name[keep])

    def result(self) -> pa.RecordBatch:
        i, j = (x.reshape(-1) for x in np.indices(self.pairs.shape))
        own = i + self.own.start
        other = own != j
        first = [self.sources[k] for k in np.append(own[other], self.best[0] + self.own.start)]
        item = [*(self.sources[k] for k in j[other]), *self.best[2]]
        part = ["pair"] * int(other.sum()) + ["term"] * len(self.best[0])
        value = np.append(self.pairs.reshape(-1)[other], self.best[1])
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * len(part), pa.string()), pa.array(first, pa.string()), pa.array(part, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], ["lang", "source", "part", "item", "value"])


def _slices(groups: DataFrame) -> Iterator[dict[str, tuple[list[str], list[int], int]]]:
    """Languages with their sources, their totals and the number of kept terms, as many at once as GROUPS allows."""
    now, held = {}, 0
    rows = groups.where("kept > 0").groupBy("lang", "kept").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("of"))
    for row in rows.toLocalIterator():
        if now and held + len(row.of) > GROUPS:
            yield now
            now, held = {}, 0
        now[row.lang] = ([x.source for x in row.of], [x.total for x in row.of], row.kept)
        held += len(row.of)
    if now:
        yield now


def audited(kept: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """(lang, source, part, item, value): partial sums of pairs, and candidates, from each range of terms."""
    spark, out = kept.sparkSession, None
    for langs in _slices(groups):
        known = spark.sparkContext.broadcast(langs)
        strips = spark.createDataFrame([(lang, -(-len(of[0]) // STRIP)) for lang, of in langs.items()], "lang string, strips int")
        rows = kept.where("term <> ''").join(F.broadcast(strips), "lang").withColumn("strip", F.explode(F.sequence(F.lit(0), F.col("strips") - 1)))

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            now = None
            for batch in batches:
                lang, strip = batch.column("lang").to_pylist(), batch.column("strip").to_numpy()
                at = 0
                while at < len(lang):
                    to = at + 1
                    while to < len(lang) and lang[to] == lang[at] and strip[to] == strip[at]:
                        to += 1
                    if now is None or now[0] != (lang[at], strip[at]):
                        if now is not None:
                            yield now[1].result()
                        now = ((lang[at], strip[at]), _Audit(lang[at], int(strip[at]), *known.value[lang[at]], top))
                    now[1].add(batch.slice(at, to - at))
                    at = to
            if now is not None:
                yield now[1].result()

        dealt = rows.select("lang", "strip", "term", "sources", "counts").repartitionByRange("lang", "strip", "term").sortWithinPartitions("lang", "strip", "term")
        found = settle(dealt.mapInArrow(run, "lang string, source string, part string, item string, value long"))
        out = found if out is None else out.union(found)
    return out if out is not None else kept.sparkSession.createDataFrame([], "lang string, source string, part string, item string, value long")


def divergence(docs: DataFrame, least_docs: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): distances of sources to each other, and the terms each one has more of than its language.

    Part 'pair': item is another source of the language, value the sum of |p - its p| over the kept terms. Part 'term':
    item is a kept term of the source with p above the language's, value the difference, to rank `top`."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    kept = settle(merged(stored(rows.mapInArrow(_count, ROW), "tries"), least_docs))
    sizes = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("total"))
    terms = kept.groupBy("lang").agg(F.count_if(F.col("term") != "").alias("kept"))
    groups = settle(sizes.join(terms, "lang"))
    found = audited(kept, groups, top)
    names = groups.select("lang", "source")
    pairs = names.join(names.withColumnRenamed("source", "item"), "lang").where("source <> item")
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)
