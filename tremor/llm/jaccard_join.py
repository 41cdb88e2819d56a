"""Exact Jaccard similarity join of documents' word n-grams, in regions around pivots.

Jaccard distance is a metric, so what is known of two documents' distances to a pivot bounds their own. It is used
three times, from coarse to fine; nothing is dropped that the bounds do not exclude.

1. Pivots of one n-gram. A document is at distance 1 - 1/n from each n-gram that it holds and at 1 from all others, so
   its nearest pivots are its own n-grams; ties go to the rarer one, then to the lesser hash. Two documents that link
   share SHARED n-grams among the first n - ceil(similarity * n) + SHARED of each, or all that they must have in common if
   those are fewer: these are its own region and the windows to which it is replicated. Pairs that meet in fewer small
   regions, by chance, are left there. N-grams with equal members are one region, which counts as often as it has n-grams.
   What is rare is read from a table of fixed size, which only orders the pivots: the result is the same for any table.
2. Pivots of hash classes. The counts of a set's members in CLASSES classes bound the symmetric difference of two sets
   from below, as do their sizes; pairs beyond the bound are not looked at further.
3. Pivots of documents. Every region's least document is compared with all others, exactly, and what links becomes
   one class. Regions of several classes that are large choose PIVOTS documents from their members; each member goes to
   the cell of its nearest pivot and, by the triangle inequality, to each cell whose pivot is at most twice the linking
   distance farther. Cells are regions again, until they are small, of one class, or as large as before; then the
   members outside the largest class are compared with all others in blocks.

Equal sets are one document from the start, and within a class no further pairs are compared, so thousands of near
copies cost a comparison with the pivots each. A group in a task has about 2 * BLOCK sets or 2 * BLOCK_GRAMS n-grams, or two sets that are larger.
Sets travel as packed texts, a quarter of their hashes' size, and only to cells or pairs that have them.

Defined results. A null or empty text has no n-grams, size 0, and its own component. Rows without an id get a component
but never name one (null if no member has an id). Repeated rows stay. Extra columns are ignored; an empty table gives
an empty result. N-grams are told apart by 64-bit hashes, sets by 128 bits and their size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .carry import pack, some_of, unpack, wanted_ids
from .common import bounded_batches, components, filled, filling, settle, small, stored
from .kernels import STEP_BYTES, U64, mix, pieces, repeated, shingle_sets

#: Members of a region whose pairs are all compared.
SMALL = 64
#: N-grams that two linked sets have in common among their pivots, unless they must have fewer in common at all.
SHARED = 3
#: Members, and n-grams in all of them, of a block where a region's members are compared in blocks.
BLOCK, BLOCK_GRAMS = 256, 1 << 20
#: Documents that split a region.
PIVOTS = 8
#: Hash classes whose counts bound distances.
CLASSES = 256
#: Cells, as a power of two, of the table of how frequent n-grams are.
CELL_BITS = 20
#: N-grams among which those that recur are counted at a time.
HELD = 1 << 20


def frequencies(docs: DataFrame, words: int) -> np.ndarray:
    """For each cell of n-grams' hashes the binary logarithm of how often its n-grams recur; any table is right, a good one keeps regions small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = np.zeros(1 << CELL_BITS, np.int64), []

        def add() -> None:
            hashes = np.sort(np.concatenate(held))
            new = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
            n = np.diff(np.append(new, len(hashes)))
            many = n > 2
            np.add.at(counts, (hashes[new[many]] >> U64(64 - CELL_BITS)).astype(np.int64), n[many])
            held.clear()

        for _, data, offsets in pieces(batches):
            held.append(shingle_sets(data, offsets, words)[0])
            if sum(map(len, held)) >= HELD:
                add()
        if held:
            add()
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["cell", "n"])

    found = docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.ceil(F.log2(F.sum("n") + 1)).cast("byte").alias("level")).toArrow()
    levels = np.zeros(1 << CELL_BITS, np.int8)
    levels[found.column("cell").to_numpy()] = found.column("level").to_numpy()
    return levels


def _keys(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each set; those of empty sets are 0."""
    out = np.zeros((2, len(ends) - 1), U64)
    some = np.flatnonzero(np.diff(ends))
    if len(some):
        out[0, some] = np.bitwise_xor.reduceat(mix(hashes), ends[some])
        out[1, some] = np.add.reduceat(mix(hashes ^ U64(0x5851F42D4C957F2D)), ends[some])
    return out[0].view(np.int64), out[1].view(np.int64)


def _names(k1: np.ndarray, k2: np.ndarray, salt: int) -> np.ndarray:
    return mix(k1.view(U64) + mix(k2.view(U64) + U64(salt))).view(np.int64)


def sketches(docs: DataFrame, words: int, salt: int = 0) -> DataFrame:
    """(doc_id, n, k1, k2, name, counts): the size and names of each document's set, its counts by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches):
            hashes, ends = shingle_sets(data, offsets, words)
            n = np.diff(ends)
            doc = np.repeat(np.arange(len(n)), n)
            k1, k2 = _keys(hashes, ends)
            counts = np.bincount(doc * CLASSES + (hashes >> U64(56)).astype(np.int64), minlength=CLASSES * len(n))
            counts = np.minimum(counts, 255).astype(np.uint8).tobytes()
            classes = pa.array([counts[k : k + CLASSES] for k in range(0, len(counts), CLASSES)], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n), *map(pa.array, (k1, k2, _names(k1, k2, salt))), classes], ["doc_id", "n", "k1", "k2", "name", "counts"])

    return docs.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, name long, counts binary")


def _pivots(docs: DataFrame, levels: np.ndarray, words: int, percent: int, salt: int) -> DataFrame:
    """(region, name, n): the sets' pivots of one n-gram; equal sets that are read together count once."""
    shared, common = docs.sparkSession.sparkContext.broadcast(levels), SHARED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in pieces(batches):
            hashes, ends = shingle_sets(data, offsets, words)
            n = np.diff(ends)
            name = _names(*_keys(hashes, ends), salt)
            once = np.zeros(len(n), bool)
            once[np.unique(name, return_index=True)[1]] = True
            order = np.lexsort((hashes, shared.value[(hashes >> U64(64 - CELL_BITS)).astype(np.int64)], np.repeat(np.arange(len(n)), n)))
            first = np.where(once, np.minimum(n, n - -(-percent * n // 100) + common), 0)
            prefix = hashes[order][np.repeat(ends[:-1], first) + repeated(first)]
            yield pa.RecordBatch.from_arrays([pa.array(prefix.view(np.int64)), pa.array(np.repeat(name, first)), pa.array(np.repeat(n, first))], ["region", "name", "n"])

    return docs.select("text").mapInArrow(run, "region long, name long, n long")


def _sizes_fit(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _by_counts(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose counts by class do not differ more than linked sets may."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                rows = batch.slice(at, 4096)
                a, b = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint8).reshape(-1, CLASSES).astype(np.int16) for c in ("a", "b"))
                differing = np.abs(a - b).sum(1, dtype=np.int64)
                near = differing * (100 + percent) <= (rows.column("n").to_numpy() + rows.column("m").to_numpy()) * (100 - percent)
                yield rows.select(["u", "v"]).filter(pa.array(near))

    one = classes.select(F.col("name").alias("u"), "n", F.col("counts").alias("a"))
    other = classes.select(F.col("name").alias("v"), F.col("n").alias("m"), F.col("counts").alias("b"))
    return pairs.join(one, "u").join(other, "v").mapInArrow(run, "u long, v long")


def _of(rows: DataFrame, names: DataFrame) -> DataFrame:
    """The rows with one of the names, and perhaps some others, before anything is shuffled."""
    shared = wanted_ids(rows, names.select(F.col("name").alias("doc_id")))
    rows = rows.withColumnRenamed("name", "doc_id")
    return rows.mapInArrow(lambda batches: some_of(batches, shared), rows.schema).withColumnRenamed("doc_id", "name")


def _sets(docs: DataFrame, wanted: DataFrame, words: int, salt: int) -> DataFrame:
    """(name, grams): the wanted sets, as the packed text of one of their documents; wanted: name, rep."""

    shared = wanted_ids(docs, wanted.select(F.col("rep").alias("doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in pieces(some_of(batches, shared)):
            packed = [pack(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(_names(*_keys(*shingle_sets(data, offsets, words)), salt)), pa.array(packed, pa.binary())], ["name", "grams"])

    return docs.mapInArrow(run, "name long, grams binary").join(wanted.select("name"), "name", "left_semi").groupBy("name").agg(F.first("grams").alias("grams"))


def _opened(packed: Iterable[bytes], words: int) -> Iterator[np.ndarray]:
    """The n-grams of each packed text, of about a step's bytes of texts at a time."""
    held, ends = [], [0]

    def sets() -> list[np.ndarray]:
        hashes, at = shingle_sets(np.frombuffer(b"".join(held), np.uint8), np.array(ends), words)
        return np.split(hashes, at[1:-1])

    for text in map(unpack, packed):
        held.append(text)
        ends.append(ends[-1] + len(text))
        if ends[-1] >= STEP_BYTES:
            yield from sets()
            held, ends = [], [0]
    if held:
        yield from sets()


def _linked(pairs: DataFrame, sets: DataFrame, percent: int, words: int) -> DataFrame:
    """The pairs (u, v) that link, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Of rows that follow each other, those with the same v stand together; a set is opened once for them.
            near, last, b = [], None, np.zeros(0, U64)
            for v, one, other in zip(batch.column("v").to_pylist(), _opened(batch.column("a").to_pylist(), words), batch.column("b"), strict=True):
                if v != last:
                    last, b = v, next(_opened([other.as_py()], words))
                shared = len(np.intersect1d(one, b, assume_unique=True))
                near.append(shared * 100 >= (len(one) + len(b) - shared) * percent)
            yield batch.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    both = pairs.join(sets.select(F.col("name").alias("u"), F.col("grams").alias("a")), "u").join(sets.select(F.col("name").alias("v"), F.col("grams").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _shared(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """How many n-grams each set of one has in common with each set of other."""
    every = np.concatenate([*one, *other])
    row = np.repeat(np.arange(len(one) + len(other)), [len(x) for x in (*one, *other)])
    code = np.unique(every, return_inverse=True)[1]
    left = row < len(one)
    common = (np.bincount(code[left], minlength=code.max(initial=0) + 1) > 0) & (np.bincount(code[~left], minlength=code.max(initial=0) + 1) > 0)
    column = np.cumsum(common) - 1
    keep = common[code]
    row, column = row[keep], column[code[keep]]
    out, width = np.zeros((len(one), len(other)), np.int64), 8192
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(common.sum()), width):
        some = slice(*np.searchsorted(column, [at, at + width]))
        holds = np.zeros((len(one) + len(other), width), np.float32)
        holds[row[some], column[some] - at] = 1
        out += (holds[: len(one)] @ holds[len(one) :].T).astype(np.int64)
    return out


def _arrays(column: pa.ChunkedArray, words: int) -> list[np.ndarray]:
    """Sets that travel as lists of n-grams or as packed texts."""
    if pa.types.is_binary(column.type):
        return list(_opened(column.to_pylist(), words))
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy().view(np.uint64)
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _in_blocks(cells: DataFrame, sets: DataFrame, percent: int, words: int) -> DataFrame:
    """Links (u, v) between classes within each cell, from pairs that hold a member of its own; cells: cell, name, n, own, class."""
    sizes = cells.groupBy("cell", "class").agg(F.count("*").alias("k"), F.sum("n").alias("grams"))
    sizes = sizes.groupBy("cell").agg(F.max_by("class", "k").alias("main"), F.sum("k").alias("k"), F.sum("grams").alias("grams"), F.max("k").alias("main_k"), F.max_by("grams", "k").alias("main_grams"))

    def blocks(k: Column, grams: Column) -> Column:
        return F.ceil(F.greatest(F.lit(1), k / BLOCK, grams / BLOCK_GRAMS)).cast("int")

    k, grams = F.col("k") - F.col("main_k"), F.col("grams") - F.col("main_grams")
    sizes = sizes.where(k > 0).select("cell", "main", blocks(k, grams).alias("across"), blocks(F.col("k"), F.col("grams")).alias("down"))
    rows = cells.join(sizes, "cell")
    spread = F.xxhash64("name")
    few = rows.where(F.col("class") != F.col("main")).withColumns({"b": F.pmod(spread, F.col("across")).cast("int"), "r": F.explode(F.sequence(F.lit(0), F.col("down") - 1)), "few": F.lit(True)})
    every = rows.withColumns({"b": F.explode(F.sequence(F.lit(0), F.col("across") - 1)), "r": F.pmod(spread, F.col("down")).cast("int"), "few": F.lit(False)})
    columns = ["cell", "b", "r", "few", "name", "class", "own"]
    dealt = few.select(*columns).union(every.select(*columns)).join(_of(sets, rows), "name")

    def run(group: pa.Table) -> pa.Table:
        side = group.column("few").to_numpy(zero_copy_only=False).astype(bool)
        name, class_of, own = (group.column(c).to_numpy(zero_copy_only=False) for c in ("name", "class", "own"))
        grams = _arrays(group.column("grams"), words)
        size = np.array([len(x) for x in grams])
        i, j = np.flatnonzero(side), np.flatnonzero(~side)
        if not len(i) or not len(j):
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        shared = _shared([grams[x] for x in i], [grams[x] for x in j])
        near = shared * 100 >= (size[i][:, None] + size[j][None, :] - shared) * percent
        near &= (class_of[i][:, None] != class_of[j][None, :]) & (own[i][:, None] | own[j][None, :])
        u, v = np.nonzero(near)
        pair = np.stack([class_of[i[u]], class_of[j[v]]])
        first = np.unique(pair, axis=1, return_index=True)[1]
        return pa.table({"u": pa.array(name[i[u[first]]]), "v": pa.array(name[j[v[first]]])})

    return dealt.groupBy("cell", "b", "r").applyInArrow(run, "u long, v long")


def _to_pivots(cells: DataFrame, sets: DataFrame, percent: int, words: int, round: int) -> DataFrame:
    """(cell, k, name, n, own, links, targets, nearest) of all members but the pivots: the pivots each one links to, the cells it goes to, 0 for the one outside all."""
    order = Window.partitionBy("cell").orderBy(F.xxhash64("name", F.lit(round)), "name")
    pivots = settle(cells.select("cell", "name", "k").withColumn("place", F.row_number().over(order)).where(F.col("place") <= PIVOTS))
    salts = F.ceil(F.col("k") / (8 * BLOCK)).cast("int")
    others = cells.join(pivots.select("cell", "name"), ["cell", "name"], "left_anti").select("cell", F.pmod(F.xxhash64("name"), salts).cast("int").alias("salt"), F.lit(False).alias("pivot"), "name", "k", "n", "own")
    heads = pivots.select("cell", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(True).alias("pivot"), "name", "k", F.lit(0).cast("long").alias("n"), F.lit(False).alias("own"))
    dealt = others.union(heads).join(_of(sets, cells), "name").repartition("cell", "salt").sortWithinPartitions("cell", "salt", F.desc("pivot"))
    reach = 1 - percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, held = None, [], []
        for batch in batches:
            out = []
            for cell, salt, pivot, name, k, n, own, grams in zip(*(batch.column(c).to_pylist() for c in ("cell", "salt", "pivot", "name", "k", "n", "own")), _arrays(batch.column("grams"), words), strict=True):
                if now != (cell, salt):
                    now, names, held = (cell, salt), [], []
                if pivot:
                    names.append(name)
                    held.append(grams)
                    continue
                shared = _shared([grams], held)[0]
                size = len(grams) + np.array([len(x) for x in held]) - shared
                d = 1 - shared / size
                links = [p for p, s, z in zip(names, shared.tolist(), size.tolist(), strict=True) if s * 100 >= z * percent]
                nearest = int(d.argmin())
                if d[nearest] <= 1 - 2 * reach:
                    targets, home = np.flatnonzero(d <= d[nearest] + 2 * reach + 1e-9), names[nearest]
                else:
                    targets, home = np.flatnonzero(d <= 1 - reach + 1e-9), None
                out.append((cell, k, name, n, own, links, [names[t] for t in targets] + ([None] if home is None else []), home))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["cell", "k", "name", "n", "own", "links", "targets", "nearest"])

    return dealt.mapInArrow(run, "cell long, k long, name long, n long, own boolean, links array<long>, targets array<long>, nearest long")


def _classes_of(edges: DataFrame) -> DataFrame:
    return components(edges).select(F.col("node").alias("name"), F.col("root").alias("class"))


def _classed(rows: DataFrame, classes: DataFrame) -> DataFrame:
    return rows.join(classes, "name", "left").withColumn("class", F.coalesce("class", "name"))


def _sized(cells: DataFrame, classes: DataFrame) -> DataFrame:
    """The cells of several classes that hold members of their own, with their sizes; cells: cell, name, n, own, before."""
    parts = filling(cells.count())
    cells = _classed(cells, classes).coalesce(parts)
    sizes = cells.groupBy("cell").agg(F.count("*").alias("k"), F.min("class").alias("a"), F.max("class").alias("b"), F.max("own").alias("some"))
    return filled(cells.join(sizes.where("a <> b AND some").select("cell", "k"), "cell").select("cell", "k", "name", "n", "own", "before", "class"))


def _joint(regions: DataFrame) -> DataFrame:
    """(cell, head, name, n): the members of large regions, those with one least member in one cell where that has fewer pairs than they have.

    Near copies share many n-grams, so they meet again and again in regions that differ by some members."""
    regions = regions.select("region", F.col("least.name").alias("head"), "name", "n", "k")
    sizes = regions.groupBy("head").agg(F.count_distinct("name").alias("all"), F.sum("k").alias("pairs"), F.count_distinct("region").alias("regions"))
    joint = filled(sizes.where((F.col("regions") > 1) & (F.col("all") * F.col("all") <= F.col("pairs"))).select("head", F.lit(True).alias("joint")))
    cell = F.when(F.col("joint"), F.xxhash64("head", F.lit("joint"))).otherwise(F.col("region"))
    return regions.join(small(joint), "head", "left").select(cell.alias("cell"), "head", "name", "n").distinct()


def _split(cells: DataFrame, sets: DataFrame, classes: DataFrame, percent: int, words: int = 1) -> DataFrame:
    """The classes after all members of the cells have been compared; each round's cells are smaller, or compared in blocks."""
    edges, round = classes.select(F.col("name").alias("u"), F.col("class").alias("v")), 0
    cells = _sized(cells.withColumn("before", F.lit(None).cast("long")), classes)
    while not cells.isEmpty():
        whole = (F.col("k") > 2 * BLOCK) & (F.col("before").isNull() | (F.col("k") <= 0.7 * F.col("before")))
        found = _in_blocks(cells.where(~whole), sets, percent, words)
        large, round = cells.where(whole), round + 1
        following = None
        if not large.isEmpty():
            near = filled(_to_pivots(large, sets, percent, words, round))
            found = found.union(near.select(F.col("name").alias("u"), F.explode("links").alias("v")))
            # Where members go to most of the cells, the pivots do not part them.
            parted = near.groupBy("cell").agg((F.sum(F.size("targets")) <= F.count("*") * (PIVOTS / 2)).alias("parted"))
            near = near.join(parted, "cell")
            child = near.where("parted").select("cell", "k", "name", "n", "own", F.explode("targets").alias("to"), "nearest")
            child = child.select(F.xxhash64("cell", "to", F.lit(round)).alias("cell"), "name", "n", (F.col("own") & F.col("to").eqNullSafe(F.col("nearest"))).alias("own"), F.col("k").alias("before"))
            same = near.where("NOT parted").select("cell", "name", "n", "own", F.lit(0).cast("long").alias("before"))
            following = child.union(same)
        edges = filled(edges.union(found).distinct())
        classes = _classes_of(edges)
        if following is None:
            break
        cells = _sized(following, classes)
    return classes


def classes_of(docs: DataFrame, percent: int, words: int, known: DataFrame | None = None, few: int = SMALL) -> DataFrame:
    """(doc_id, n, component_id, alone), one row per input row: its set's size, the least doc_id that links reach, and whether that is no other one.

    docs: doc_id, text. known: links (u, v) by doc_id that were found before; sets of one class are not compared again. few: members of a region whose pairs are all joined."""
    for salt in range(8):
        sketch = stored(sketches(docs, words, salt), "sketches")
        sets_of = settle(sketch.where("n > 0").groupBy("k1", "k2", "n", "name").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")))
        distinct_sets = sets_of.count()
        sets_of = sets_of.coalesce(filling(distinct_sets))
        if distinct_sets == sets_of.select("name").distinct().count():
            break
    else:
        raise RuntimeError("sets cannot be told apart by 64 bits")
    edges = None
    if known is not None:
        by_doc = sketch.where("n > 0").select(F.col("doc_id"), "name")
        ends = (by_doc.select(F.col("doc_id").alias(c), F.col("name").alias(to)) for c, to in (("u", "a"), ("v", "b")))
        edges = known.join(next(ends), "u").join(next(ends), "v").select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct()
        edges = filled(edges)
    # Regions of single n-grams; of those with equal members, one. What stands in one set only goes no further than its first shuffle.
    by = Window.partitionBy("region")
    tokens = _pivots(docs, frequencies(docs, words), words, percent, salt).withColumns({"lo": F.min("name").over(by), "hi": F.max("name").over(by)})
    tokens = tokens.where("lo <> hi").select("region", "name", "n", "lo").distinct()
    tokens = tokens.withColumns({"k": F.count("*").over(by), "x": F.bit_xor(F.xxhash64("name")).over(by), "y": F.bit_xor(F.xxhash64(F.lit(1), "name")).over(by)})
    alike = tokens.select(F.xxhash64("k", "x", "y", "lo").alias("region"), "name", "n", "k").repartition("region")
    members = stored(alike.groupBy("region", "name", "n", "k").agg(F.count("*").alias("w")), "regions")
    parts = filling(members.count())
    members = members.coalesce(parts)
    if edges is None:
        members = members.withColumn("class", F.col("name"))
    else:
        members = filled(_classed(members, _classes_of(edges)).coalesce(parts))
        several = members.groupBy("region").agg(F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b")
        members = filled(members.join(several.select("region"), "region", "left_semi"))
    some, many = members.where(F.col("k") <= few), members.where(F.col("k") > few)
    other = some.select("region", F.col("name").alias("v"), F.col("n").alias("m"), F.col("class").alias("there"), F.col("w").alias("z"))
    pairs = some.join(other, "region").where((F.col("name") < F.col("v")) & (F.col("class") != F.col("there")) & _sizes_fit(F.col("n"), F.col("m"), percent))
    least_shared = F.least(F.lit(SHARED), F.ceil((F.col("n") + F.col("m")) * percent / (100 + percent)))
    pairs = pairs.groupBy(F.col("name").alias("u"), "v", "n", "m").agg(F.sum(F.least("w", "z")).alias("shared")).where(F.col("shared") >= least_shared).select("u", "v")
    many = many.join(many.groupBy("region").agg(F.min(F.struct("name", "n", "class")).alias("least")), "region")
    stars = many.where(F.col("class") != F.col("least.class")).where(_sizes_fit(F.col("n"), F.col("least.n"), percent)).select(F.col("least.name").alias("u"), F.col("name").alias("v"))
    pairs = filled(pairs.union(stars).distinct())
    compared_sets = filled(pairs.select(F.col("u").alias("name")).union(pairs.select("v")).distinct())
    counts = _of(sketch.select("name", "n", "counts").where("n > 0"), compared_sets).join(compared_sets, "name", "left_semi").groupBy("name", "n").agg(F.first("counts").alias("counts"))
    pairs = filled(_by_counts(pairs, stored(counts, "counts"), percent))
    wanted = pairs.select(F.col("u").alias("name")).union(pairs.select("v")).union(many.select("name")).distinct()
    sets = stored(_sets(docs, filled(sets_of.select("name", "rep").join(wanted, "name", "left_semi")), words, salt), "sets")
    links = _linked(pairs, sets, percent, words)
    classes = filled(_classes_of(links if edges is None else links.union(edges)))
    cells = _joint(many).where(F.col("name") != F.col("head")).select("cell", "name", "n", F.lit(True).alias("own"))
    classes = _split(cells, sets, classes, percent, words)
    named = filled(_classed(sets_of.select("name", "rep", "last"), classes))
    least = named.groupBy("class").agg(F.min("rep").alias("component_id"), (F.coalesce(F.min("rep") == F.max("last"), F.lit(False)) & (F.count("*") == 1)).alias("alone"))
    named = named.join(least, "class").select("name", "component_id", "alone")
    out = sketch.select("doc_id", "n", F.when(F.col("n") > 0, F.col("name")).alias("name")).join(named, "name", "left")
    return out.select("doc_id", "n", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.coalesce("alone", F.lit(True)).alias("alone"))


def join_classes(docs: DataFrame, percent: int = 85, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per input row: its set's size, and the least doc_id that links reach.

    Two documents link when 100 * intersection >= percent * union of their sets of distinct n-grams of words, A-Z in
    lower case; a text of fewer words is one n-gram."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return classes_of(docs, percent, words).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
