"""Tables of the label store on disk, in versions: what was committed is there in whole, what was not is not seen.

A change writes its rows as Parquet into a folder of its own and then commits: a record that lists the folders of the
new version is created under the version's number, which fails if another writer took that number. So a killed writer
leaves only a folder that no record names, a reader never sees half of a change, and of two writers who began with
one version the second raises. A table may be parted by a column of few values; a replacement of some of them writes
only these, and all other parts keep their folders. Records carry the schema's number; older parts are brought up to
date as they are read, and rewritten by `migrate`. Records are read and created through Spark's own file systems.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Migration = Callable[[DataFrame], DataFrame]


def with_defaults(defaults: Mapping[str, Any], without: Sequence[str] = ()) -> Migration:
    """Adds columns that are missing, fills their nulls, and drops others."""

    def change(rows: DataFrame) -> DataFrame:
        have = {c: F.coalesce(F.col(c), F.lit(v)) if c in rows.columns else F.lit(v) for c, v in defaults.items()}
        return rows.withColumns(have).drop(*without)

    return change


def status_again(rows: DataFrame) -> DataFrame:
    """Rejected and pending events stay so; others are confirmed by what their source's text begins with."""
    expert = F.rlike(F.lower("source"), F.lit(r"^expert($|[_\-:.])"))
    old = F.col("status") if "status" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("status", F.when(old.isin("rejected", "pending"), old).when(expert, "confirmed").otherwise("unconfirmed"))


#: How each table came to its present schema, oldest change first.
SAMPLES: tuple[Migration, ...] = (with_defaults({"reference": "", "time": ""}, ("tdms_storage_root", "relative_path", "tdms_path")),)
EVENTS: tuple[Migration, ...] = (status_again,)


class Conflict(RuntimeError):
    """Another writer has committed first."""


class Table:
    """One table of a store: its versions, reading, and changes."""

    def __init__(self, spark: SparkSession, root: str, name: str, by: str | None = None, keys: Sequence[str] = (), migrations: Sequence[Migration] = ()):
        self.spark, self.path, self.by, self.keys, self.migrations = spark, f"{root.rstrip('/')}/{name}", by, list(keys), list(migrations)

    def _files(self, path: str) -> tuple[Any, Any]:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        files, folder = self._files(f"{self.path}/_commits")
        if not files.exists(folder):
            return []
        return sorted(int(f.getPath().getName().split(".")[0]) for f in files.listStatus(folder) if f.getPath().getName().endswith(".json"))

    def record(self, version: int | None = None) -> dict[str, Any]:
        """What a version consists of; the newest, if none is named."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "parts": []}
        if version is not None and version not in known:
            raise ValueError(f"no version {version} of {self.path}")
        text = self.spark.read.text(f"{self.path}/_commits/{known[-1] if version is None else version:08d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version in the present schema."""
        parts = self.record(version)["parts"]
        if not parts:
            raise ValueError(f"nothing has been written to {self.path}")
        found = []
        for number in sorted({p["schema"] for p in parts}):
            folders = [p["path"] for p in parts if p["schema"] == number]
            rows = self.spark.read.option("mergeSchema", "true").parquet(*folders)
            found.append(reduce(lambda df, change: change(df), self.migrations[number:], rows))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)

    def _written(self, rows: DataFrame, schema: int) -> list[dict[str, Any]]:
        """The rows as folders, one for each value of the parting column."""
        folder = f"{self.path}/data-{uuid.uuid4().hex}"
        if self.by is None:
            rows.write.parquet(folder)
            return [{"of": None, "path": folder, "schema": schema}]
        rows.withColumn("_part", F.col(self.by)).write.partitionBy("_part").parquet(folder)
        files, at = self._files(folder)
        names = [f.getPath().getName() for f in files.listStatus(at) if f.isDirectory()]
        values = {r[0] for r in rows.select(self.by).distinct().collect()}
        kept = {self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(v)): v for v in values if v is not None and str(v) != ""}
        return [{"of": kept.get(n.split("=", 1)[1]), "path": f"{folder}/{n}", "schema": schema} for n in sorted(names)]

    def _commit(self, begun: int, parts: list[dict[str, Any]]) -> int:
        record = json.dumps({"version": begun + 1, "parts": parts}, ensure_ascii=False)
        files, at = self._files(f"{self.path}/_commits/{begun + 1:08d}.json")
        if files.exists(at):
            raise Conflict(f"version {begun + 1} of {self.path} is another writer's")
        files.mkdirs(at.getParent())
        # Written beside and renamed: the record is there in whole or not at all, and a name that is taken is not renamed to.
        temporary, place = self._files(f"{self.path}/_commits/.{uuid.uuid4().hex}")
        out = temporary.create(place, False)
        out.write(bytearray(record.encode()))
        out.close()
        if not files.rename(place, at):
            raise Conflict(f"version {begun + 1} of {self.path} is another writer's")
        return begun + 1

    def _checked(self, rows: DataFrame) -> None:
        if self.keys and not rows.groupBy(*self.keys).count().where("count > 1").isEmpty():
            raise ValueError(f"rows of {self.path} repeat {', '.join(self.keys)}")

    def append(self, rows: DataFrame, begun: int | None = None) -> int:
        """The version with rows added; begun is the version that the writer has seen, the newest if not given."""
        before = self.record()
        begun = before["version"] if begun is None else begun
        if before["version"] != begun:
            raise Conflict(f"{self.path} is at version {before['version']}, not {begun}")
        if self.keys:
            old = [self.read().select(*self.keys)] if before["parts"] else []
            self._checked(reduce(lambda a, b: a.union(b), [*old, rows.select(*self.keys)]))
        return self._commit(begun, before["parts"] + self._written(rows, len(self.migrations)))

    def replace(self, rows: DataFrame, scope: Iterable[Any] | None = None, begun: int | None = None) -> int:
        """The version with rows in place of all, or of the named values of the parting column; rows beyond the scope raise."""
        before = self.record()
        begun = before["version"] if begun is None else begun
        if before["version"] != begun:
            raise Conflict(f"{self.path} is at version {before['version']}, not {begun}")
        self._checked(rows)
        kept = []
        if scope is not None:
            inside = set(scope)
            if self.by is None:
                raise ValueError(f"{self.path} is not parted")
            if not rows.where(~F.coalesce(F.col(self.by).isin(*inside), F.lit(False))).isEmpty():
                raise ValueError(f"rows beyond the scope of {self.by}")
            kept = [p for p in before["parts"] if p["of"] not in inside]
        return self._commit(begun, kept + self._written(rows, len(self.migrations)))

    def migrate(self) -> int:
        """All parts rewritten in the present schema, as a version of its own; the same version if there is nothing to do."""
        before = self.record()
        if all(p["schema"] == len(self.migrations) for p in before["parts"]):
            return before["version"]
        return self.replace(self.read(), begun=before["version"])


class LabelStore:
    """Samples, parted by line and unique in (line, sn, sample_id), and label events, unique in id."""

    def __init__(self, spark: SparkSession, root: str):
        self.samples = Table(spark, root, "samples", by="line", keys=("line", "sn", "sample_id"), migrations=SAMPLES)
        self.events = Table(spark, root, "label_events", keys=("id",), migrations=EVENTS)

    def confirmed(self) -> DataFrame:
        return self.events.read().where("status = 'confirmed'")

    def unlabeled(self) -> DataFrame:
        """Active samples without a confirmed event."""
        return self.samples.read().where("is_active = 1").join(self.confirmed().select("sample_pk"), F.col("id") == F.col("sample_pk"), "left_anti")


#: Columns of exported sheets.
SAMPLE_COLUMNS = ("line", "sn", "sample_id", "group_name", "channel_name", "sampling_rate", "sample_type", "sample_config", "origin", "is_active", "created_at", "updated_at")
EVENT_COLUMNS = ("line", "sn", "sample_id", "event_uuid", "timestamp", "source", "result_key", "result_id", "result_name", "reason_key", "reason_id", "reason_name", "reason_confidence", "label_version", "note", "status", "imported_at")


def exported_records(samples: DataFrame, events: DataFrame, id_col: str = "id") -> dict[str, DataFrame]:
    """The sheets samples, label_events and sample_labels (samples with their latest confirmed event), as text with '' for what is missing."""
    key = ["line", "sn", "sample_id"]
    named = events.drop(*key).join(samples.select(F.col(id_col).alias("sample_pk"), *key), "sample_pk")
    last = named.where("status = 'confirmed'").groupBy("sample_pk").agg(F.max(F.struct("timestamp", "id", F.struct(*(c for c in EVENT_COLUMNS[3:] if c in named.columns)).alias("e")))["e"].alias("e"))
    both = samples.join(last.withColumnRenamed("sample_pk", "_pk"), F.col(id_col) == F.col("_pk"), "left").select(*samples.columns, "e.*")

    def sheet(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
        return rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in columns))

    return {"samples": sheet(samples, SAMPLE_COLUMNS), "label_events": sheet(named, EVENT_COLUMNS), "sample_labels": sheet(both, (*SAMPLE_COLUMNS, *EVENT_COLUMNS[3:]))}


def labels_of(sheet: DataFrame, lines: Sequence[str] = (), tag: str | None = None) -> DataFrame:
    """Rows of exported labels of the lines, and with a tag in their note, where these are asked for."""
    out = sheet
    if lines:
        out = out.where(F.trim("line").isin(*lines))
    return out.where(F.contains(F.coalesce("note", F.lit("")), F.lit(tag))) if tag else out


def write_sheets(sheets: Mapping[str, DataFrame], folder: str) -> None:
    for name, rows in sheets.items():
        rows.write.option("header", "true").option("escape", '"').option("emptyValue", "").csv(f"{folder.rstrip('/')}/{name}")


def write_features(parts: Sequence[DataFrame], folder: str, fixed: Sequence[str], rows_per_file: int = 100_000) -> list[str]:
    """Feature rows of several extractors as one typed table: fixed columns first, then features as they come up; returns the columns."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    columns = [*(c for c in fixed if c in every.columns), *(c for c in every.columns if c not in fixed)]
    missing = [F.lit(None).cast("string").alias(c) for c in fixed if c not in every.columns]
    every.select(*columns, *missing).write.option("maxRecordsPerFile", rows_per_file).parquet(folder)
    return columns


#: The column of whole tensors, and how columns of single values are called.
TENSOR, VALUE = "__feature_tensor__", "feat__{channel}__{step:04d}"


def to_wide(rows: DataFrame, channels: Sequence[str], steps: int, column: str = TENSOR) -> DataFrame:
    """One column for each value of a tensor of channels and steps; values that a tensor lacks are null."""
    values = (F.try_element_at(F.try_element_at(column, F.lit(c + 1)), F.lit(s + 1)).alias(VALUE.format(channel=name, step=s)) for c, name in enumerate(channels) for s in range(steps))
    return rows.select(*(x for x in rows.columns if x != column), *values)


def layout(columns: Sequence[str]) -> dict[str, dict[int, str]]:
    """The columns of single values by channel, as they come, and step; none raise."""
    found: dict[str, dict[int, str]] = {}
    for name in columns:
        if match := re.fullmatch(r"feat__(.+)__(\d+)", name):
            found.setdefault(match[1], {})[int(match[2])] = name
    if not found:
        raise ValueError("no columns of single values")
    return found


def from_wide(rows: DataFrame, column: str = TENSOR) -> DataFrame:
    """Columns of single values as one tensor: gaps, nulls and what is no number count as 0."""
    found = layout(rows.columns)
    steps = max(max(of) for of in found.values()) + 1
    number = lambda c: F.coalesce(F.nanvl(F.col(f"`{c}`").cast("string").try_cast("double"), F.lit(0.0)), F.lit(0.0)).cast("float")
    zero = F.lit(0.0).cast("float")
    tensor = F.array(*(F.array(*(number(of[s]) if s in of else zero for s in range(steps))) for of in found.values()))
    used = {c for of in found.values() for c in of.values()}
    return rows.select(*(c for c in rows.columns if c not in used), tensor.alias(column))


def checked_tensors(rows: DataFrame, channels: int, length: int | None = None, column: str = TENSOR) -> DataFrame:
    """rows with tensors of so many channels, another number raises; with a length, cut at its end or filled with 0."""
    tensor = F.when(F.size(column) == channels, F.col(column)).otherwise(F.raise_error(F.concat(F.lit("channels of a tensor: "), F.size(column).cast("string"))))
    if length is not None:
        tensor = F.transform(tensor, lambda x: F.slice(F.concat(x, F.array_repeat(F.lit(0.0).cast("float"), length)), 1, length))
    return rows.withColumn(column, tensor)
