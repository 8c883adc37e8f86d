"""Image files: listing, decoding and encoding in tasks."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import scanlines
from ..operators.blocks import lines_of_strips, number
from .dds import DdsSource, opened

__all__ = ["DdsSource"]

RASTER = "path string, width int, height int, rgba binary, status string"


def scan_images(spark: SparkSession, folder: str) -> DataFrame:
    """path and length of the images of one folder; a missing folder is empty. Content is not read."""
    try:
        files = spark.read.format("binaryFile").load(folder)
    except Exception as error:  # only the missing folder is an empty one
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "path string, length bigint")
    return files.where(names.is_image(F.col("path"))).select("path", "length")


def scan_list(spark: SparkSession, manifest: DataFrame, folder: str, partition_bytes: int = 64 << 20) -> DataFrame:
    """Files of a manifest (ord, path, and length if known), with their content, in its order; a path may occur more than once.

    The manifest's rows are dealt into ranges of ord, and each task opens the files of its rows only, each once; files that
    aren't there have no row. With lengths, ranges hold about partition_bytes, else as many files. Paths that don't begin
    at a root are below the folder.
    """
    known = "length" in manifest.columns
    size = F.sum("length") if known else F.count(F.lit(1)) * (1 << 20)
    many = max(1, int((manifest.agg(size).first()[0] or 0) // partition_bytes) + 1)
    kinds = {f.name: f.dataType.simpleString() for f in manifest.schema}
    at = manifest.columns.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, bytes | None] = {}
        for batch in batches:
            for k, path in enumerate(batch.column(at).to_pylist()):
                whole = path if "://" in path or path.startswith(("/", "file:")) else f"{folder.rstrip('/')}/{path}"
                if whole not in held:
                    if sum(len(x or b"") for x in held.values()) > partition_bytes:
                        held.clear()
                    held[whole] = _content(whole)
                if held[whole] is not None:
                    yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, pa.array([held[whole]], pa.binary())], names=[*kinds, "content"])

    rows = manifest.repartitionByRange(many, "ord").sortWithinPartitions("ord")
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kind}" for c, kind in [*kinds.items(), ("content", "binary")]))


def _content(path: str) -> bytes | None:
    filesystem, place = opened(path)
    try:
        with filesystem.open_input_stream(place, compression=None) as source:
            return source.read()
    except FileNotFoundError:
        return None


def _averaged(line: list[int], up: list[int], step: int) -> list[int]:
    """A line of filter 3, behind one pixel of zeros: each byte goes up by half the sum of its left and upper one."""
    row = [0] * step
    for i, here in enumerate(line):
        row.append((here + (row[i] + up[i + step] >> 1)) & 255)
    return row


def _paeth(line: list[int], up: list[int], step: int) -> list[int]:
    """A line of filter 4, behind one pixel of zeros: each byte goes up by the one of left, upper and corner that is nearest to left + upper - corner."""
    row = [0] * step
    for i, here in enumerate(line):
        left, above, corner = row[i], up[i + step], up[i]
        a, b, c = abs(above - corner), abs(left - corner), abs(left + above - 2 * corner)
        row.append((here + (left if a <= b and a <= c else above if b <= c else corner)) & 255)
    return row


def _png(data: bytes) -> np.ndarray:
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, body, head = 8, [], None
    palette, clear = None, b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        head = struct.unpack(">IIBBBBB", part) if kind == b"IHDR" else head
        body += [part] * (kind == b"IDAT")
        palette = np.frombuffer(part, np.uint8).reshape(-1, 3) if kind == b"PLTE" else palette
        clear = part if kind == b"tRNS" else clear
        at += size + 12
    width, height, depth, color, _, _, laced = head
    if laced or depth not in (8, 16) or color == 3 and depth != 8:
        raise ValueError("unsupported PNG")
    count = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    step = count * depth // 8
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * step)
    rows = np.zeros((height + 1, (width + 1) * step), np.int32)  # one row and one pixel of zeros before
    for y in range(height):
        kind, line, up, row = raw[y, 0], raw[y, 1:].astype(np.int32), rows[y], rows[y + 1]
        if kind in (0, 2):
            row[step:] = (line + (up[step:] if kind else 0)) & 255
            continue
        if kind == 1:
            row[step:] = np.cumsum(line.reshape(-1, step), axis=0).ravel() & 255
            continue
        row[:] = (_averaged if kind == 3 else _paeth)(line.tolist(), up.tolist(), step)
    pixels = rows[1:, step:].astype(np.uint8).reshape(height, width, count, depth // 8)[..., 0]  # the high byte of 16
    full = np.full((height, width, 1), 255, np.uint8)
    if color == 3:
        alpha = np.full(256, 255, np.uint8)
        alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
        return np.concatenate([palette[pixels[..., 0]], alpha[pixels]], axis=2)
    rgb = pixels[..., :3] if color in (2, 6) else np.repeat(pixels[..., :1], 3, axis=2)
    if clear and color in (0, 2):  # texels of exactly this colour are clear, by all bits of their samples
        wide = rows[1:, step:].reshape(height, width, count, depth // 8)
        samples = (wide * (256 ** np.arange(depth // 8)[::-1])).sum(axis=-1)
        full = np.where((samples == np.frombuffer(clear, ">u2", count)).all(axis=-1, keepdims=True), 0, full).astype(np.uint8)
    return np.concatenate([rgb, pixels[..., -1:] if color in (4, 6) else full], axis=2)


def _tga(data: bytes) -> np.ndarray:
    note, _, kind = data[0], data[1], data[2]
    width, height, depth, flags = struct.unpack("<HHBB", data[12:18])
    if kind not in (2, 3) or depth not in (8, 24, 32):
        raise ValueError("unsupported TGA")
    pixels = np.frombuffer(data, np.uint8, width * height * depth // 8, 18 + note).reshape(height, width, depth // 8)
    pixels = pixels if flags & 32 else pixels[::-1]
    rgb = pixels[..., 2::-1] if depth > 8 else np.repeat(pixels, 3, axis=2)
    alpha = pixels[..., 3:4] if depth == 32 else np.full((height, width, 1), 255, np.uint8)
    return np.concatenate([rgb, alpha], axis=2)


def decode(files: DataFrame) -> DataFrame:
    """path, width, height, rgba and status (ok or the error) of PNG and TGA files. files: path, content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    image = (_tga if path.as_py().lower().endswith(".tga") else _png)(data.as_py())
                    row = image.shape[1], image.shape[0], image.tobytes(), "ok"
                except (ValueError, IndexError, KeyError, TypeError, struct.error, zlib.error) as error:
                    row = None, None, None, f"{type(error).__name__}: {error}"
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([row[0]], pa.int32()), pa.array([row[1]], pa.int32()), pa.array([row[2]], pa.binary()), pa.array([row[3]])], names=["path", "width", "height", "rgba", "status"])

    return files.select("path", "content").mapInArrow(run, RASTER)


def to_lines(rasters: DataFrame) -> DataFrame:
    """Lines of decoded rasters: texture_id (the path), y, r, g, b, a."""
    rows = rasters.where("status = 'ok'").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    line = F.substring("rgba", (F.col("at") * F.col("width") * 4 + 1).cast("int"), F.col("width") * 4)
    return lines_of_strips(rows.select(F.col("path").alias("texture_id"), "width", "height", F.lit("RGBA8").alias("format"), "at", line.alias("strip")))


def to_texels(rasters: DataFrame) -> DataFrame:
    """A row for each texel of decoded rasters."""
    return scanlines.texels(to_lines(rasters), tuple("rgba"))


def picture_texels(pictures: DataFrame) -> DataFrame:
    """Texels of Spark's own image source, for JPEG files: grey or BGR bytes, row by row. Files that it can't read have none.

    For PNG files use decode(): that source takes the low byte of 16-bit samples and drops the alpha of grey images.
    """
    image = pictures.select(F.col("image.origin").alias("texture_id"), *[F.col(f"image.{c}").alias(c) for c in ("width", "height", "nChannels", "mode", "data")])
    rows = image.where("mode >= 0").withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    line = F.substring("data", (F.col("y") * F.col("width") * F.col("nChannels") + 1).cast("int"), F.col("width") * F.col("nChannels"))
    lines = rows.select("texture_id", "y", "width", "nChannels", line.alias("line"))
    cells = lines.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    digits = F.hex(F.substring("line", F.col("x") * F.col("nChannels") + 1, F.col("nChannels")))
    grey = F.col("nChannels") == 1
    of = lambda place: number(digits, place, 1).cast("int")
    samples = [F.when(grey, of(0)).otherwise(of(2 - k)).alias(c) for k, c in enumerate("rgb")]
    return cells.select("texture_id", "y", "x", *samples, F.when(F.col("nChannels") == 4, of(3)).otherwise(255).alias("a"))


def picture_status(pictures: DataFrame) -> DataFrame:
    """path, width, height, status of the image source's files, as decode() gives them."""
    ok = F.col("image.mode") >= 0
    return pictures.select(F.col("image.origin").alias("path"), F.when(ok, F.col("image.width")).alias("width"), F.when(ok, F.col("image.height")).alias("height"), F.when(ok, "ok").otherwise("not a picture").alias("status"))


def encode(rasters: DataFrame, export_format: str = "png") -> DataFrame:
    """name and bytes of TGA files, if the format is tga in any case, else of PNG files whatever their names end with.

    rasters: name, width, height, channels (1: grey, 3: RGB, 4: RGBA), pixels.
    """
    to_tga = export_format.lower() == "tga"

    @F.pandas_udf("binary")
    def encoded(width: pd.Series, height: pd.Series, channels: pd.Series, pixels: pd.Series) -> pd.Series:
        write = _as_tga if to_tga else _as_png
        return pd.Series([write(np.frombuffer(p, np.uint8).reshape(h, w, c)) for w, h, c, p in zip(width, height, channels, pixels, strict=True)])

    return rasters.select("name", encoded("width", "height", "channels", "pixels").alias("bytes"))


def _as_png(image: np.ndarray) -> bytes:
    height, width, channels = image.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate([np.zeros((height, 1), np.uint8), image.reshape(height, -1)], axis=1)  # no row filter
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def _as_tga(image: np.ndarray) -> bytes:
    height, width, channels = image.shape
    head = struct.pack("<BBB9xHHBB", 0, 0, 3 if channels == 1 else 2, width, height, 8 * channels, 32 | (8 if channels == 4 else 0))
    order = {1: [0], 3: [2, 1, 0], 4: [2, 1, 0, 3]}[channels]
    return head + image[..., order].tobytes()
