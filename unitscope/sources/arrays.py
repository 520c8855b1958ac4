"""Dense arrays in files: a Spark data source with byte-range partitions, and a distributed writer.

Three layouts are read: a ``.npy`` file; a raw file of numbers (as a memory-mapped array leaves
it) whose shape is given; and a folder of raw parts next to ``shape.npy``, as ``save_array`` writes it.

    spark.dataSource.register(ArrayFiles)
    spark.read.format("dense_array").load("hdfs://…/features.npy")                       # cells
    spark.read.format("dense_array").option("shape", "63305,512,7,7").option("form", "blocks").load("…/layer4.mmap")

A task seeks to its byte range and reads it piece by piece; nothing is read whole. The folder
must be one that all executors see.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from unitscope.schema import ABSENT, IDS
from unitscope.sources.images import whole_path

CELLS = "id_1 long, id_2 long, id_3 long, id_4 long, value double"
BLOCKS = "img long, unit int, h int, w int, values array<double>"
#: Bytes of a partition, of one piece in a task, and of a written part.
PARTITION, PIECE, PART = 64 << 20, 4 << 20, 64 << 20


def _files(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return fs.FileSystem.from_uri(path)


@dataclass
class Span(InputPartition):
    """Some numbers of a file: ``count`` from byte ``at``, the first of them number ``first`` of the array."""

    file: str
    at: int
    first: int
    count: int


def npy_header(data: bytes) -> tuple[tuple[int, ...], bool, np.dtype, int]:
    """Shape, column order, kind of number and start of the numbers of a ``.npy`` file."""
    source = io.BytesIO(data)
    version = np.lib.format.read_magic(source)
    read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
    if read is None:
        raise ValueError(f"unknown version {version} of an array file")
    shape, by_column, kind = read(source)
    return shape, by_column, kind, source.tell()


class ArrayFiles(DataSource):
    """Format ``dense_array``. Options: ``shape`` (``"4,3,2"``) and ``dtype`` (default ``<f8``) of a raw file;
    ``form`` (``cells``, or ``blocks`` with one row per map of a rank-4 array); ``start`` and ``end`` of the
    first axis; ``partitionBytes``."""

    @classmethod
    def name(cls) -> str:
        return "dense_array"

    def schema(self) -> str:
        return BLOCKS if self.options.get("form", "cells") == "blocks" else CELLS

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(dict(self.options))


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        path = options["path"]
        system, place = _files(path)
        self.blocks = options.get("form", "cells") == "blocks"
        self.by_column, self.kind = False, np.dtype(options.get("dtype", "<f8"))
        info = system.get_file_info(place)
        if info.type.name == "Directory":
            with system.open_input_file(f"{place}/shape.npy") as f:
                self.shape = tuple(int(n) for n in np.load(io.BytesIO(f.read())))
            from pyarrow import fs

            found = system.get_file_info(fs.FileSelector(place))
            parts = sorted((int(i.base_name[len("part-") :]), i) for i in found if i.base_name.startswith("part-"))
            held = [(f"{path.rstrip('/')}/{i.base_name}", 0, first, i.size // self.kind.itemsize) for first, i in parts]
        elif place.endswith(".npy"):
            with system.open_input_file(place) as f:
                self.shape, self.by_column, self.kind, start = npy_header(f.read(1 << 16))
            held = [(path, start, 0, (info.size - start) // self.kind.itemsize)]
        else:
            if "shape" not in options:
                raise ValueError("a raw file needs the option shape")
            self.shape = tuple(int(n) for n in options["shape"].split(","))
            held = [(path, 0, 0, info.size // self.kind.itemsize)]
        if not 1 <= len(self.shape) <= 4 or self.blocks and (len(self.shape) != 4 or self.by_column):
            raise ValueError(f"a tensor of shape {self.shape} is not read as {'blocks' if self.blocks else 'cells'}")
        wanted = math.prod(self.shape)
        at = 0
        for _, _, first, count in held:
            if first != at:
                raise ValueError(f"numbers from {at} on are missing")
            at += count
        if at < wanted or at > wanted and len(held) > 1:
            raise ValueError(f"{at} numbers where a shape of {self.shape} has {wanted}")
        # what stands together: a map, or a number
        self.unit = self.shape[2] * self.shape[3] if self.blocks else 1
        row = math.prod(self.shape[1:])
        low, high = int(options.get("start", 0)), min(int(options.get("end", self.shape[0])), self.shape[0])
        step = max(1, int(options.get("partitionbytes", options.get("partitionBytes", PARTITION))) // (self.kind.itemsize * max(self.unit, 1))) * max(self.unit, 1)
        bounds = (0, wanted) if self.by_column else (low * row, max(low, high) * row)
        self.kept = (low, high)
        self.spans = []
        for file, byte, first, count in held:
            if self.unit and first % self.unit:
                raise ValueError("a map is cut between two parts")
            lo, hi = max(first, bounds[0]), min(first + count, bounds[1])
            for at in range(lo, hi, step):
                self.spans.append(Span(file, byte + (at - first) * self.kind.itemsize, at, min(step, hi - at)))

    def partitions(self) -> list[Span]:
        # a format needs one partition at least
        return self.spans or [Span("", 0, 0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if not span.count:
            return
        system, place = _files(span.file)
        step = max(1, PIECE // (self.kind.itemsize * self.unit)) * self.unit
        with system.open_input_file(place) as f:
            f.seek(span.at)
            for lo in range(0, span.count, step):
                n = min(step, span.count - lo)
                raw = f.read(n * self.kind.itemsize)
                if len(raw) != n * self.kind.itemsize:
                    raise ValueError(f"{span.file} ended early")
                yield self.rows(span.first + lo, np.frombuffer(raw, dtype=self.kind).astype(np.float64))

    def rows(self, first: int, values: np.ndarray) -> pa.RecordBatch:
        if self.blocks:
            _, units, h, w = self.shape
            number = first // self.unit + np.arange(len(values) // self.unit)
            ends = np.arange(len(number) + 1, dtype=np.int32) * self.unit
            size = np.ones(len(number), dtype=np.int32)
            columns = [number // units, (number % units).astype(np.int32), size * h, size * w]
            return pa.RecordBatch.from_arrays(
                [*map(pa.array, columns), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["img", "unit", "h", "w", "values"]
            )
        ids = np.unravel_index(first + np.arange(len(values)), self.shape, order="F" if self.by_column else "C")
        if self.by_column:
            inside = (ids[0] >= self.kept[0]) & (ids[0] < self.kept[1])
            ids, values = [i[inside] for i in ids], values[inside]
        absent = [np.full(len(values), ABSENT)] * (4 - len(self.shape))
        columns = [pa.array(i.astype(np.int64)) for i in [*absent, *ids]]
        return pa.RecordBatch.from_arrays([*columns, pa.array(values)], names=[*IDS, "value"])


def read_array(spark: SparkSession, path: str, form: str = "cells", **options) -> DataFrame:
    """Cells ``(id_1 … id_4, value)`` or maps ``(img, unit, h, w, values)`` of an array file or folder."""
    spark.dataSource.register(ArrayFiles)
    reader = spark.read.format("dense_array").option("form", form)
    for key, value in options.items():
        reader = reader.option(key, ",".join(map(str, value)) if isinstance(value, (tuple, list)) else str(value))
    return reader.load(whole_path(spark, path))


def save_array(cells: DataFrame, path: str, shape: tuple[int, ...], fill: float = 0.0, part_bytes: int = PART) -> None:
    """Write cells of rank 1 to 4 as a folder of raw parts that ``read_array`` takes.

    Absent cells hold ``fill``; a cell beyond the shape, or a null id, is refused. Parts end between maps.
    ``shape.npy`` is written last: a folder without it is not complete.
    """
    spark = cells.sparkSession
    shape = tuple(int(n) for n in shape)
    if not 1 <= len(shape) <= 4:
        raise ValueError(f"rank must be 1..4, not {len(shape)}")
    axes = IDS[4 - len(shape) :]
    bad = F.lit(False)
    flat = F.lit(0).cast("long")
    for axis, n in zip(axes, shape):
        bad = bad | F.col(axis).isNull() | (F.col(axis) < 0) | (F.col(axis) >= n)
        flat = flat * n + F.col(axis)
    total = math.prod(shape)
    unit = math.prod(shape[2:]) if len(shape) == 4 and 0 < math.prod(shape[2:]) * 8 <= part_bytes else 1
    size = max(1, part_bytes // (8 * unit)) * unit
    root = whole_path(spark, path)
    system, place = _files(root)
    if system.get_file_info(f"{place}/shape.npy").type.name != "NotFound":
        raise FileExistsError(path)
    placed = cells.select(F.when(bad, F.raise_error(F.lit(f"a cell lies outside the shape {shape}"))).otherwise(flat).cast("long").alias("_at"), F.col("value").cast("double").alias("_value"))
    numbers = placed.withColumn("_part", F.floor(F.col("_at") / size).cast("long"))
    parts = spark.range(-(-total // size)).select(F.col("id").alias("_part"))

    def write(key: tuple, part: pa.Table, held: pa.Table) -> pa.Table:
        first = key[0].as_py() * size
        values = np.full(min(size, total - first), fill)
        values[held["_at"].to_numpy() - first] = held["_value"].to_numpy()
        target, base = _files(root)
        target.create_dir(base, recursive=True)
        with target.open_output_stream(f"{base}/part-{first:016d}") as out:
            out.write(values.astype("<f8").tobytes())
        return pa.table({"n": pa.array([len(values)])})

    made = parts.groupBy("_part").cogroup(numbers.groupBy("_part")).applyInArrow(write, "n long")
    if (made.agg(F.sum("n")).first()[0] or 0) != total:
        raise RuntimeError(f"{path} was not written whole")
    system.create_dir(place, recursive=True)
    header = io.BytesIO()
    np.save(header, np.array(shape, dtype=np.int64))
    with system.open_output_stream(f"{place}/shape.npy") as out:
        out.write(header.getvalue())
