"""Image files: reading, decoding to pixels, and writing label maps as PNG."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PIXELS = "file string, y int, x int, r int, g int, b int"


def read_images(spark: SparkSession, path: str, names: str | None = None) -> DataFrame:
    """Images below a directory with their size and raw bytes, keyed by the path below it.

    A file that cannot be read has a height of -1; ``unreadable`` lists those. ``names`` is a
    pattern of the file names wanted, in all folders below.
    """
    reader = spark.read.format("image").option("dropInvalid", False)
    if names:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", names)
    image = reader.load(path)
    below = F.length(F.lit(whole_path(spark, path).split("://")[-1].split(":")[-1].rstrip("/")))
    place = F.regexp_replace("image.origin", "^[A-Za-z][A-Za-z0-9+.-]*:(//)?(?=/|[^/])", "")
    return image.select(
        F.substring(place, below + 2, F.length(place)).alias("file"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("n_channels"),
        F.col("image.data").alias("data"),
    )


def whole_path(spark: SparkSession, path: str) -> str:
    """The path with its file system, as Hadoop on the driver resolves it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(place).toString()


def unreadable(images: DataFrame) -> DataFrame:
    """``(file)`` of the images that could not be read."""
    return images.where(F.col("height") < 0).select("file")


def image_pixels(images: DataFrame) -> DataFrame:
    """Pixels ``(file, y, x, r, g, b)`` of the readable images; grey fills all three channels."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                bytes_ = np.frombuffer(row.data, dtype=np.uint8)
                raw = bytes_.reshape(row.height, row.width, row.n_channels).astype("int32")
                y, x = np.indices((row.height, row.width))
                blue, green, red = [raw[..., min(c, row.n_channels - 1)].ravel() for c in range(3)]
                yield pd.DataFrame(
                    {"file": row.file, "y": y.ravel(), "x": x.ravel(), "r": red, "g": green, "b": blue}
                )

    return images.where(F.col("height") >= 0).mapInPandas(decode, _PIXELS)


def label_pixels(images: DataFrame) -> DataFrame:
    """Label maps stored as images: a pixel's label is red plus 256 times green."""
    label = F.col("r") + F.col("g") * 256
    return image_pixels(images).select("file", "y", "x", label.alias("label"))


#: Numbers of decoded images that leave a task together (8 MB of doubles), or one image.
_NUMBERS = 1 << 20


def _runs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to ``_NUMBERS`` at most, or single rows."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > _NUMBERS:
            yield lo, i
            lo, total = i, 0
        total += n
    if sizes:
        yield lo, len(sizes)


def label_maps(images: DataFrame, every: bool = False) -> DataFrame:
    """Whole label maps ``(file, height, width, labels array<int>)``, row-major, packed where they are decoded.

    With ``every``, unreadable images have a row too, of nulls.
    """

    def decode(raw: bytes, h: int, w: int, n: int) -> np.ndarray:
        bgr = np.frombuffer(raw, dtype=np.uint8).reshape(h * w, n).astype(np.int32)
        return bgr[:, min(2, n - 1)] + 256 * bgr[:, min(1, n - 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, w, n = (batch.column(c).to_numpy() for c in ("height", "width", "n_channels"))
            good = h >= 0
            sizes = np.where(good, h.astype(np.int64) * w, 0)
            # decoded label maps take four times the bytes of an image channel
            for lo, hi in _runs(sizes.tolist()):
                flat = [decode(batch.column("data")[i].as_py(), h[i], w[i], n[i]) for i in range(lo, hi) if good[i]]
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes[lo:hi])]).astype(np.int32), mask=np.append(~good[lo:hi], False))
                labels = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int32), *flat])))
                shape = [pa.array(x[lo:hi], mask=~good[lo:hi]) for x in (h, w)]
                yield pa.RecordBatch.from_arrays([batch.column("file").slice(lo, hi - lo), *shape, labels], names=["file", "height", "width", "labels"])

    kept = images if every else images.where(F.col("height") >= 0)
    return kept.mapInArrow(run, "file string, height int, width int, labels array<int>")


def input_arrays(images: DataFrame, height: int, width: int, key: str = "file", bgr_mean: list[float] | None = None) -> DataFrame:
    """Images as network input ``(key, values array<double>)``: 3 × height × width, row-major.

    Decoded, resized bilinearly (to bytes, as image files hold them), and normalised in one
    pass, a bounded number at a time; grey images fill all three channels. Unreadable images have no row.
    """
    from unitscope.operators.images import BGR_MEAN, INPUT_SCALE
    from unitscope.operators.maps import resize

    mean = np.array(list(reversed(bgr_mean or BGR_MEAN)))[:, None, None]

    def array(raw: bytes, h: int, w: int, n: int) -> np.ndarray:
        bgr = np.frombuffer(raw, dtype=np.uint8).reshape(h, w, n)
        rgb = np.stack([bgr[..., min(c, n - 1)] for c in (2, 1, 0)]).astype(np.float64)
        if (h, w) != (height, width):
            rgb = np.clip(np.floor(np.round(resize(rgb, height, width), 9) + 0.5), 0, 255)
        return ((rgb - mean) / INPUT_SCALE).ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _runs([3 * height * width] * batch.num_rows):
                flat = [array(*(batch.column(c)[i].as_py() for c in ("data", "height", "width", "n_channels"))) for i in range(lo, hi)]
                ends = pa.array(np.arange(hi - lo + 1, dtype=np.int32) * (3 * height * width))
                values = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(flat)))
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(lo, hi - lo), values], names=[key, "values"])

    kind = T.StructType([images.schema[key], T.StructField("values", T.ArrayType(T.DoubleType()))])
    return images.where(F.col("height") >= 0).select(key, "height", "width", "n_channels", "data").mapInArrow(run, kind)


def save_pixels(pixels: DataFrame, path: str) -> int:
    """Write pixel rows ``(file, ch, y, x, v)``, ch 0..2 = R, G, B, as one PNG per file; returns their number."""
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", "ch", F.col("v").cast("int").alias("v"))))
    # a group holds the pixels of one image
    whole = pixels.groupBy("file").agg(
        (F.max("y") + 1).cast("int").alias("height"), (F.max("x") + 1).cast("int").alias("width"), F.transform(ordered, lambda p: p["v"]).alias("rgb")
    )
    return write_png(whole, path)


def write_png(images: DataFrame, path: str) -> int:
    """Write images ``(file, height, width, rgb array<int>)`` below a shared folder.

    Every task writes its own files, through the file system the folder's address names;
    a repeated task overwrites them with the same bytes. Returns the number of files.
    """

    uri = whole_path(images.sparkSession, path)
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]

    def png(rgb: np.ndarray) -> bytes:
        """A minimal 8-bit RGB PNG."""
        height, width, _ = rgb.shape
        lines = np.concatenate([np.zeros((height, 1), np.uint8), rgb.reshape(height, -1)], axis=1)

        def chunk(kind: bytes, data: bytes) -> bytes:
            crc = zlib.crc32(kind + data)
            return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", crc)

        head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
        return (
            b"\x89PNG\r\n\x1a\n"
            + chunk(b"IHDR", head)
            + chunk(b"IDAT", zlib.compress(lines.tobytes()))
            + chunk(b"IEND", b"")
        )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        target, base = fs.FileSystem.from_uri(uri)
        target.create_dir(base, recursive=True)
        done = 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                rgb = np.asarray(row.rgb, dtype=np.uint8).reshape(row.height, row.width, 3)
                if "/" in row.file:
                    target.create_dir(f"{base}/{row.file}".rpartition("/")[0], recursive=True)
                with target.open_output_stream(f"{base}/{row.file}") as out:
                    out.write(png(rgb))
                done += 1
        yield pd.DataFrame({"n": [done]})

    return images.mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
