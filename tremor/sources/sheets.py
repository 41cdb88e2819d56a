"""Sheets of labels as text files: encodings told by content, header names without marks and blanks, union of files."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a file that is no UTF-8 is read as; it contains GBK.
OTHER_ENCODING = "GB18030"


def clean_header(rows: DataFrame) -> DataFrame:
    """Columns named without byte-order marks and outer blanks; of several that become one the exactly named, then the marked one, then the first."""
    best: dict[str, tuple[int, int]] = {}
    for place, raw in enumerate(rows.columns):
        name = raw.lstrip("﻿").strip()
        rank = 0 if raw == name else 1 if raw == "﻿" + name else 2
        best[name] = min(best.get(name, (3, 0)), (rank, place))
    unique = rows.toDF(*(f"_c{k}" for k in range(len(rows.columns))))
    return unique.select(*(F.col(f"_c{place}").alias(name) for name, (_, place) in best.items()))


def encodings(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path and encoding of each file: UTF-8 if every line is, else the other. Files are read by lines, on all executors."""
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.is_valid_utf8("value").alias("valid"))
    return lines.groupBy("path").agg(F.when(F.bool_and("valid"), "UTF-8").otherwise(OTHER_ENCODING).alias("encoding"))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.map_(pa.string(), pa.string())
    for batch in batches:
        for content in batch.column("content").to_pylist():
            rows = csv.DictReader(io.StringIO(content.decode(OTHER_ENCODING, "replace"), newline=""))
            maps = [[(k, v) for k, v in row.items() if k is not None and isinstance(v, str)] for row in rows]
            yield pa.RecordBatch.from_arrays([pa.array(maps, kind)], ["cells"])


def _other(spark: SparkSession, path: str) -> DataFrame:
    """A sheet in the encoding that Spark's reader does not know, decoded whole in one task."""
    cells = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_cells, "cells map<string, string>")
    names = sorted(r[0] for r in cells.select(F.explode(F.map_keys("cells"))).distinct().collect())
    return cells.select(*(F.col("cells")[n].alias(n) for n in names))


def read_sheets(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All rows of the sheets as text, columns that a sheet lacks null; quoted cells may hold line ends. Empty files have no rows.

    Only names, headers and encodings of files are gathered; every sheet has its own header."""
    found = sorted((r["path"], r["encoding"]) for r in encodings(spark, paths).collect())
    utf8 = lambda path: spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    sheets = [clean_header(utf8(path) if code == "UTF-8" else _other(spark, path)) for path, code in found]
    if not sheets:
        return spark.range(0).drop("id")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sheets)


def read_features(spark: SparkSession, root: str, left_out: str = "*augmented*") -> DataFrame:
    """Feature rows of all files below a folder named *features*, without those of augmented recordings; one header for all."""
    rows = spark.read.option("pathGlobFilter", "*features*").option("recursiveFileLookup", "true").parquet(root)
    name = F.element_at(F.split("_metadata.file_name", "/"), -1)
    return rows.where(~F.like(name, F.lit(left_out.replace("*", "%"))))
