"""Flat binary rasters (row-major, no header) as rows, and back.

``spark.read.format("flatraster")`` splits every file into row blocks, so a large raster is many tasks, each seeking to its
rows. Options: ``path`` (a file or a folder searched for ``glob``), ``width``, ``length``, ``dtype`` (float32, uint8 or auto: by
file size), ``endian`` (little or big), ``rows_per_task``. Values are doubles; uint8 is scaled to 0..1; 0 and NaN are NULL.

Paths here are of file systems that every executor mounts. ``read_binary`` takes any path that Spark reads.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "name string, y int, x int, v double"
_WIDTHS = {"float32": 4, "uint8": 1}


def kind_of(size: int, cells: int, dtype: str = "auto") -> str:
    """float32 or uint8, from the file's size unless given; another size is an error."""
    for kind, width in _WIDTHS.items():
        if dtype in ("auto", kind) and size == cells * width:
            return kind
    raise ValueError(f"{size} bytes are no {dtype} raster of {cells} cells")


def decode(data: bytes, kind: str, endian: str = "little") -> np.ndarray:
    """Doubles with NaN for no data."""
    v = np.frombuffer(data, np.uint8 if kind == "uint8" else ">f4" if endian == "big" else "<f4").astype(np.float64)
    v[v == 0] = np.nan
    return v / 255 if kind == "uint8" else v


def _rows(name: str, first: int, width: int, v: np.ndarray) -> pa.RecordBatch:
    cells = np.arange(len(v))
    return pa.RecordBatch.from_arrays([pa.array([name] * len(v)), pa.array((first + cells // width).astype(np.int32)), pa.array((cells % width).astype(np.int32)), pa.array(v, from_pandas=True)], names=["name", "y", "x", "v"])


class Block(InputPartition):
    def __init__(self, path: str, kind: str, first: int, rows: int):
        self.path, self.kind, self.first, self.rows = path, kind, first, rows


class FlatReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.pattern = options["path"].removeprefix("file://"), options.get("glob", "*")
        self.width, self.length = int(options["width"]), int(options["length"])
        self.dtype, self.endian, self.rows = options.get("dtype", "auto"), options.get("endian", "little"), int(options.get("rows_per_task", "256"))

    def partitions(self) -> list[Block]:
        files = [self.path] if os.path.isfile(self.path) else sorted(p for p in glob.glob(f"{self.path}/**/{self.pattern}", recursive=True) if os.path.isfile(p))
        return [Block(p, kind_of(os.path.getsize(p), self.width * self.length, self.dtype), y, min(self.rows, self.length - y)) for p in files for y in range(0, self.length, self.rows)]

    def read(self, part: Block) -> Iterator[pa.RecordBatch]:
        cell = _WIDTHS[part.kind] * self.width
        with open(part.path, "rb") as f:
            f.seek(part.first * cell)
            v = decode(f.read(part.rows * cell), part.kind, self.endian)
        yield _rows(os.path.splitext(os.path.basename(part.path))[0], part.first, self.width, v)


class FlatRaster(DataSource):
    @classmethod
    def name(cls) -> str:
        return "flatraster"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FlatReader:
        return FlatReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FlatRaster)


def read_binary(spark: SparkSession, path: str, width: int, length: int, dtype: str = "auto", endian: str = "little", pattern: str = "*") -> tuple[DataFrame, DataFrame]:
    """(rows, skipped): rasters through Spark's own file access, a file a row; files of another size are listed in ``skipped``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    fits = F.col("length").isin([width * length * w for k, w in _WIDTHS.items() if dtype in ("auto", k)])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield _rows(os.path.splitext(os.path.basename(p))[0], 0, width, decode(data, kind_of(len(data), width * length, dtype), endian))

    return files.where(fits).select("path", "content").mapInArrow(decoded, SCHEMA), files.where(~fits).select("path", "length")


def write_flat(df: DataFrame, folder: str, width: int, length: int, value: str = "v", no_data: float = 0.0) -> None:
    """One float32 file for each ``name``: rows of a raster meet in one task (a raster is one file's worth), and go to ``folder``/name.flat."""

    def put(key, batch):
        image = np.full(width * length, no_data, "<f4")
        at = batch["y"].to_numpy() * width + batch["x"].to_numpy()
        v = batch[value].to_numpy(zero_copy_only=False).astype(np.float64)
        image[at] = np.where(np.isnan(v), no_data, v)
        os.makedirs(folder, exist_ok=True)
        part = f"{folder}/.{key[0].as_py()}.part"
        image.tofile(part)
        os.replace(part, f"{folder}/{key[0].as_py()}.flat")  # a retried task writes the same file again
        return pa.table({"name": [key[0].as_py()], "cells": [len(at)]})

    df.select("name", "y", "x", F.col(value).cast("double").alias(value)).groupBy("name").applyInArrow(put, "name string, cells long").collect()
