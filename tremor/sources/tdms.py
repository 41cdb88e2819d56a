"""Recordings in the TDMS format as a Spark data source, `tdms`: channels of measured values, plain or packed with zstd.

    spark.dataSource.register(TdmsSource)
    spark.read.format("tdms").option("groups", "Vib Up_0").option("channels", "ACC").load(folder)
    frame.write.format("tdms").mode("append").save(folder)

Reading: a partition holds one file or several small ones, up to PARTITION_BYTES. Files are opened where they are and only the bytes of wanted channels are read; packed
files are unpacked in memory up to MEMORY_BYTES, larger ones into a file of the task. A channel gives a row for every
ROW_VALUES values, so no row grows with a recording; without values (option values=false) only the description is read,
one row per channel. Options groups and channels are comma-separated names.

Writing: rows of one path that follow each other become one file, a segment per row; a file appears under its name
when the job commits. Deal and sort rows by path and place first (`by_file`).
"""

from __future__ import annotations

import io
import struct
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "path string, relative_path string, group string, channel string, n long, rate int, start long, samples array<float>, properties map<string,string>"
#: Values in one row.
ROW_VALUES = 1 << 20
#: Packed files up to this size are unpacked in memory.
MEMORY_BYTES = 64 << 20
#: Bytes and files of one partition, unless a single file is larger.
PARTITION_BYTES, PARTITION_FILES = 128 << 20, 64

#: Fixed values of the format: the tag of a segment, bits of its table of contents, numbers of types.
TAG = b"TDSm"
METADATA, NEW_LIST, RAW, INTERLEAVED, BIG_ENDIAN, DAQMX = 1 << 1, 1 << 2, 1 << 3, 1 << 5, 1 << 6, 1 << 7
NUMBERS = {1: "i1", 2: "i2", 3: "i4", 4: "i8", 5: "u1", 6: "u2", 7: "u4", 8: "u8", 9: "f4", 10: "f8", 25: "f4", 26: "f8", 33: "u1"}
TEXT, TIME = 32, 68
NO_DATA, SAME_DATA, OPEN_END = 0xFFFFFFFF, 0, 0xFFFFFFFFFFFFFFFF
VERSION = 4713
#: Seconds between the format's epoch, 1904, and 1970.
EPOCH = 2082844800


@dataclass
class Run:
    """Values of a channel in one chunk of a segment: where they begin, how many, and the bytes from one to the next."""

    at: int
    n: int
    kind: str
    step: int


@dataclass
class Channel:
    properties: dict[str, Any] = field(default_factory=dict)
    runs: list[Run] = field(default_factory=list)

    @property
    def n(self) -> int:
        return sum(r.n for r in self.runs)

    @property
    def rate(self) -> int | None:
        """Values a second, from the time between two, rounded."""
        step = self.properties.get("wf_increment")
        return int(round(1.0 / step)) if step else None


class _Fields:
    """Numbers and texts of a segment's description, one behind the other."""

    def __init__(self, data: bytes, order: str):
        self.data, self.order, self.at = data, order, 0

    def number(self, code: str) -> Any:
        (value,) = struct.unpack_from(self.order + code, self.data, self.at)
        self.at += struct.calcsize(code)
        return value

    def text(self) -> str:
        n = self.number("I")
        self.at += n
        return self.data[self.at - n : self.at].decode("utf-8", "replace")

    def value(self) -> Any:
        kind = self.number("I")
        if kind == TEXT:
            return self.text()
        if kind == TIME:
            low, high = (self.number("Q"), self.number("q")) if self.order == "<" else (self.number("q"), self.number("Q"))[::-1]
            return high - EPOCH + low / 2**64
        if kind not in NUMBERS:
            raise ValueError(f"a property of the unknown type {kind}")
        kind = np.dtype(self.order + NUMBERS[kind])
        self.at += kind.itemsize
        return np.frombuffer(self.data, kind, 1, self.at - kind.itemsize)[0].item()


def names_of(path: str) -> tuple[str, str] | None:
    """Group and channel of an object's path, /'group'/'channel' with quotes doubled; None for groups and the root."""
    parts, at = [], 0
    while at < len(path):
        at, part = at + 2, []
        while at < len(path):
            if path[at] == "'":
                if path[at + 1 : at + 2] != "'":
                    break
                at += 1
            part.append(path[at])
            at += 1
        parts.append("".join(part))
        at += 1
    return (parts[0], parts[1]) if len(parts) == 2 else None


def describe(file: Any) -> dict[tuple[str, str], Channel]:
    """The channels of a file by group and name, with where their values are; values themselves are not read."""
    size = file.seek(0, io.SEEK_END)
    found: dict[tuple[str, str], Channel] = {}
    layout: dict[str, tuple[int, int, int]] = {}  # type, values, bytes of a chunk; of the objects with data, in order
    known: dict[str, tuple[int, int, int]] = {}
    begin = 0
    while begin + 28 <= size:
        file.seek(begin)
        lead = file.read(28)
        if lead[:4] != TAG:
            raise ValueError(f"no segment at byte {begin}")
        contents = struct.unpack_from("<I", lead, 4)[0]
        order = ">" if contents & BIG_ENDIAN else "<"
        following, described = struct.unpack_from(order + "QQ", lead, 12)
        end = size if following == OPEN_END else min(begin + 28 + following, size)
        if contents & METADATA:
            fields = _Fields(file.read(described), order)
            if contents & NEW_LIST:
                layout = {}
            for _ in range(fields.number("I")):
                path = fields.text()
                index = fields.number("I")
                if index == NO_DATA:
                    layout.pop(path, None)
                elif index == SAME_DATA:
                    layout[path] = known[path]
                elif index in (0x1269, 0x126A) or contents & DAQMX:
                    raise ValueError("raw values of a device are not read")
                else:
                    kind, _, n = fields.number("I"), fields.number("I"), fields.number("Q")
                    n_bytes = fields.number("Q") if kind == TEXT else n * (16 if kind == TIME else np.dtype(NUMBERS[kind]).itemsize)
                    layout[path] = known[path] = (kind, n, n_bytes)
                properties = {fields.text(): fields.value() for _ in range(fields.number("I"))}
                if names := names_of(path):
                    found.setdefault(names, Channel()).properties.update(properties)
        if contents & RAW:
            _place(found, layout, begin + 28 + described, end, order, bool(contents & INTERLEAVED))
        begin = end if end > begin else size
    return found


def _place(found: dict[tuple[str, str], Channel], layout: dict[str, tuple[int, int, int]], at: int, end: int, order: str, interleaved: bool) -> None:
    """Adds the runs of a segment's chunks, of the last chunk what is there of it."""
    chunk = sum(n_bytes for _, _, n_bytes in layout.values())
    width = sum(n_bytes // n for _, n, n_bytes in layout.values() if n) if interleaved else 0
    while chunk and at < end:
        inside = 0
        for path, (kind, n, n_bytes) in layout.items():
            one = n_bytes // n if n else 0
            if interleaved:
                there = min(n, max(0, (end - at - inside - one) // width + 1)) if width else 0
                first, step = at + inside, width
                inside += one
            else:
                first, step = at + inside, one
                there = n if first + n_bytes <= end else max(0, (end - first) // one) if one else 0
                inside += n_bytes
            if kind in NUMBERS and there and (names := names_of(path)):
                found[names].runs.append(Run(first, there, order + NUMBERS[kind], step))
        at += chunk


def values(file: Any, channel: Channel, most: int = ROW_VALUES) -> Iterator[np.ndarray]:
    """A channel's values as 32-bit numbers, `most` at a time."""
    held: list[np.ndarray] = []
    have = 0
    for run in channel.runs:
        kind, done = np.dtype(run.kind), 0
        while done < run.n:
            n = min(run.n - done, most - have)
            file.seek(run.at + done * run.step)
            data = file.read((n - 1) * run.step + kind.itemsize)
            held.append(np.ndarray((n,), kind, data, strides=(run.step,)).astype(np.float32))
            done, have = done + n, have + n
            if have == most:
                yield np.concatenate(held)
                held, have = [], 0
    if held:
        yield np.concatenate(held)


def segment(channel: tuple[str, str], samples: np.ndarray, properties: dict[str, Any]) -> bytes:
    """One segment with the values of one channel; number-like properties are written as numbers."""
    path = "".join("/'" + part.replace("'", "''") + "'" for part in channel).encode()
    described = struct.pack("<II", 1, len(path)) + path + struct.pack("<IIIQI", 20, 9, 1, len(samples), len(properties))
    for name, value in properties.items():
        described += struct.pack("<I", len(name.encode())) + name.encode()
        try:
            described += struct.pack("<Id", 10, float(value))
        except (TypeError, ValueError):
            described += struct.pack("<II", TEXT, len(str(value).encode())) + str(value).encode()
    raw = samples.astype("<f4").tobytes()
    return TAG + struct.pack("<IIQQ", METADATA | NEW_LIST | RAW, VERSION, len(described) + len(raw), len(described)) + described + raw


def is_recording(relative: str) -> bool:
    parts = relative.split("/")
    return not any(p.startswith(".") for p in parts) and parts[-1].lower().endswith((".tdms", ".tdms.zst"))


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


class seekable:
    """A recording open for reading at any place, a packed one unpacked first."""

    def __init__(self, files: pafs.FileSystem, path: str, memory: int = MEMORY_BYTES):
        self.file = files.open_input_file(path)
        if path.lower().endswith(".zst"):
            target = io.BytesIO() if self.file.size() <= memory else tempfile.TemporaryFile()
            zstandard.ZstdDecompressor().copy_stream(self.file, target)
            self.file.close()
            self.file = target

    def __enter__(self) -> Any:
        return self.file

    def __exit__(self, *_: object) -> None:
        self.file.close()


class _Files(InputPartition):
    """Files of one task, as (path, relative path)."""


_ARROW = pa.schema([("path", pa.string()), ("relative_path", pa.string()), ("group", pa.string()), ("channel", pa.string()), ("n", pa.int64()), ("rate", pa.int32()), ("start", pa.int64()), ("samples", pa.list_(pa.float32())), ("properties", pa.map_(pa.string(), pa.string()))])


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.groups, self.channels = ({x.strip() for x in options[k].split(",") if x.strip()} if options.get(k) else None for k in ("groups", "channels"))
        self.with_values = options.get("values", "true").lower() == "true"
        self.most = int(options.get("row_values", ROW_VALUES))

    def partitions(self) -> list[InputPartition]:
        files, base = _opened(self.root)
        info = files.get_file_info(base)
        if info.is_file:
            return [_Files([(self.root, info.base_name)])]
        found = files.get_file_info(pafs.FileSelector(base, recursive=True))
        sizes = sorted((f.path[len(base) :].lstrip("/"), f.size or 0) for f in found if f.is_file)
        out, room = [], 0
        for relative, size in sizes:
            if not is_recording(relative):
                continue
            if not out or size > room or len(out[-1]) == PARTITION_FILES:
                out.append([])
                room = PARTITION_BYTES
            out[-1].append((f"{self.root}/{relative}", relative))
            room -= size
        return [_Files(some) for some in out]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        for path, relative in partition.value:
            yield from self._read(path, relative)

    def _read(self, full: str, relative: str) -> Iterator[pa.RecordBatch]:
        files, path = _opened(full)
        with seekable(files, path) as file:
            for (group, name), channel in describe(file).items():
                if self.groups is not None and group not in self.groups or self.channels is not None and name not in self.channels:
                    continue
                start, properties = 0, {k: str(v) for k, v in channel.properties.items()}
                parts = values(file, channel, self.most) if self.with_values else iter(())
                for samples in [next(parts, np.zeros(0, np.float32))] if channel.n <= self.most or not self.with_values else parts:
                    row = [full, relative, group, name, channel.n, channel.rate, start]
                    arrays = [pa.array([v], f.type) for v, f in zip(row, _ARROW, strict=False)]
                    samples_list = pa.ListArray.from_arrays(pa.array([0, len(samples)], pa.int32()), pa.array(samples))
                    yield pa.RecordBatch.from_arrays([*arrays, samples_list, pa.array([list(properties.items())], _ARROW.field("properties").type)], schema=_ARROW)
                    start += len(samples)


@dataclass
class _Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        moves, file, now = [], None, None
        files, base = _opened(self.root)
        for batch in iterator:
            column = {c: batch.column(batch.schema.get_field_index(c)) for c in ("relative_path", "group", "channel", "properties", "samples")}
            for k in range(batch.num_rows):
                path = column["relative_path"][k].as_py()
                if path != now:
                    if file is not None:
                        file.close()
                    now, target = path, f"{base}/{path}"
                    files.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    moves.append((f"{target.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}", target))
                    file = files.open_output_stream(moves[-1][0], compression="zstd" if path.lower().endswith(".zst") else None)
                samples = column["samples"][k].values
                samples = np.zeros(0, np.float32) if samples is None else samples.to_numpy(zero_copy_only=False)
                file.write(segment((column["group"][k].as_py(), column["channel"][k].as_py()), samples, dict(column["properties"][k].as_py() or [])))
        if file is not None:
            file.close()
        return _Written(moves)

    def _finish(self, messages: list[WriterCommitMessage | None], keep: bool) -> None:
        files, _ = _opened(self.root)
        for message in messages:
            for source, target in message.moves if message else []:
                if keep:
                    files.move(source, target)
                else:
                    files.delete_file(source)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self._finish(messages, True)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._finish(messages, False)


class TdmsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tdms"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: Any, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("recordings are added; write in mode append")
        return _Writer(self.options)


def by_file(channels: DataFrame) -> DataFrame:
    """Rows dealt and ordered as writing needs them."""
    return channels.repartition("relative_path").sortWithinPartitions("relative_path", "group", "channel", "start")


def read(spark: Any, root: str, **options: Any) -> DataFrame:
    spark.dataSource.register(TdmsSource)
    return spark.read.format("tdms").options(**options).load(root)


def write(channels: DataFrame, root: str) -> None:
    channels.sparkSession.dataSource.register(TdmsSource)
    by_file(channels).select("relative_path", "group", "channel", "start", "samples", "properties").write.format("tdms").mode("append").save(root)


def write_replaced(channels: DataFrame, replacements: DataFrame, root: str) -> None:
    """Copies of recordings in which some channels have other values; replacements: relative_path, group, channel, samples."""
    key = ["relative_path", "group", "channel"]
    first = channels.where("start = 0").join(replacements.withColumnRenamed("samples", "_new"), key)
    changed = first.drop("samples").withColumnRenamed("_new", "samples").select(channels.columns)
    write(channels.join(replacements.select(*key), key, "left_anti").select(channels.columns).union(changed), root)
