"""A Spark data source for folders of .npy files: one partition a group of files, shapes checked by each file's header.

    spark.dataSource.register(ArraySource)
    spark.read.format("npy").option("path", folder).option("least_columns", 60).load()

A file of shape (n, columns) gives n rows.  With ``layout`` keypoints, (3, T, 17), (T, 17, 3) and (T, 51) give T rows of 51 values, x of
all points, then y, then confidence.  Files of other shapes or types, and files that cannot be read, are told in the executor's log
and passed over.  Files are read by Arrow's file systems, so paths may be local or URIs that they know.
"""

from __future__ import annotations

import ast
import logging
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

POINTS = 17
#: Rows handed on at once.
_AT_ONCE = 4096
_log = logging.getLogger(__name__)


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


def header(stream) -> tuple[tuple[int, ...], np.dtype, bool]:
    """Shape, type and whether columns come first of the array that begins here; the values follow."""
    magic = stream.read(8)
    if len(magic) < 8 or magic[:6] != b"\x93NUMPY" or magic[6] not in (1, 2, 3):
        raise ValueError("not an .npy file")
    size = struct.unpack("<H", stream.read(2))[0] if magic[6] == 1 else struct.unpack("<I", stream.read(4))[0]
    said = ast.literal_eval(bytes(stream.read(size)).decode("utf-8" if magic[6] == 3 else "latin-1"))
    kind = np.dtype(said["descr"])
    if kind.kind not in "fiub":
        raise ValueError(f"values of type {kind}")
    return tuple(int(n) for n in said["shape"]), kind, bool(said["fortran_order"])


def accepted(shape: tuple[int, ...], layout: str, least_columns: int) -> bool:
    if layout == "keypoints":
        return shape[:1] + shape[2:] == (3, POINTS) or shape[1:] in ((POINTS, 3), (3 * POINTS,))
    return len(shape) == 2 and shape[1] >= least_columns


def table(values: np.ndarray, layout: str) -> np.ndarray:
    """A row a frame."""
    if layout != "keypoints" or values.ndim == 2:
        return values
    channels_first = values if values.shape[0] == 3 and values.shape[2] == POINTS else values.transpose(2, 0, 1)
    return channels_first.transpose(1, 0, 2).reshape(channels_first.shape[1], 3 * POINTS)


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]
        self.layout, self.least, self.group = options.get("layout", "rows"), int(options.get("least_columns", 1)), int(options.get("files", 64))
        if self.layout not in ("rows", "keypoints"):
            raise ValueError(f"layout {self.layout}")

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)

    def partitions(self) -> list[InputPartition]:
        store, base = self._store()
        found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        paths = sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".npy"))
        return [Files(paths[k : k + self.group]) for k in range(0, len(paths), self.group)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = self._store()
        for path in partition.paths:
            try:
                with store.open_input_file(path) as stream:
                    shape, kind, columns_first = header(stream)
                    if not accepted(shape, self.layout, self.least):
                        raise ValueError(f"shape {shape}")
                    raw = stream.read(int(np.prod(shape)) * kind.itemsize)
                    values = np.frombuffer(raw, dtype=kind).reshape(shape, order="F" if columns_first else "C").astype(np.float32)
            except (ValueError, KeyError, SyntaxError, OSError, TypeError) as fault:
                _log.warning("passed over %s: %s", path, fault)
                continue
            rows = np.ascontiguousarray(table(values, self.layout))
            folder, _, name = path.rpartition("/")
            for at in range(0, len(rows), _AT_ONCE):
                part = rows[at : at + _AT_ONCE]
                n, width = part.shape
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([folder.rpartition("/")[2]] * n), pa.array([name.removesuffix(".npy")] * n), pa.array(np.arange(at, at + n)), pa.ListArray.from_arrays(ends, pa.array(part.ravel()))],
                    ["folder", "file", "row", "values"],
                )


class ArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "folder string, file string, row bigint, values array<float>"

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(dict(self.options))


def keypoint_columns(values: Column) -> list[Column]:
    """x0, y0, c0 and on of the 51 values of a frame in the keypoints layout."""
    return [F.element_at(values, k * POINTS + i + 1).cast("double").alias(f"{a}{i}") for i in range(POINTS) for k, a in enumerate("xyc")]


def fitted(frames, length: int, width: int = 3 * POINTS):
    """folder, file, row, values with exactly ``length`` rows a file: the middle ones of longer files, zeros after shorter ones."""
    sizes = frames.groupBy("folder", "file").agg((F.max("row") + 1).alias("n"))
    first = F.greatest(F.floor((F.col("n") - length) / 2), F.lit(0))
    wanted = sizes.select("folder", "file", first.alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long"))).alias("to"))
    found = wanted.withColumn("row", F.col("to") + F.col("first")).join(frames, ["folder", "file", "row"], "left")
    return found.select("folder", "file", F.col("to").alias("row"), F.coalesce("values", F.array_repeat(F.lit(0.0).cast("float"), width)).alias("values"))
