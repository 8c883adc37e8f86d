"""Blocks of 4 x 4 texels: encoding to BC3, 16-byte blocks, payloads, and decoding of BC1, BC2 and BC3."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..functions.channels import div, shifted_right
from . import scanlines
from .scanlines import joined

KEY = ["texture_id", "by", "bx"]


def alpha_ends(v: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of blocks of 16 values: the largest, the smallest, and 3-bit codes between them, texel 0 lowest."""
    a0, a1 = v.max(axis=-1), v.min(axis=-1)
    span = a0 - a1
    step = ((a0[..., None] - v) * 14 + span[..., None]) // (2 * np.maximum(span, 1))[..., None]
    codes = np.array([0, 2, 3, 4, 5, 6, 7, 1])[step] * there
    return a0, a1, (codes << (3 * np.arange(16))).sum(axis=-1)


def color_ends(r: np.ndarray, g: np.ndarray, b: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of blocks of 16 colours: two corners of their box as RGB565 words, and 2-bit codes of the nearest colours between them, the first of equals.

    The corners are the box's; channels that fall as green rises change sides.
    """
    n = there.sum(axis=-1)
    ends = []
    for c, levels in ((r, 31), (g, 63), (b, 31)):
        falls = n * (c * g * there).sum(axis=-1) < (c * there).sum(axis=-1) * (g * there).sum(axis=-1)
        high, low = c.max(axis=-1), c.min(axis=-1)
        ends.append([(np.where(falls, x, y) * levels + 127) // 255 for x, y in ((low, high), (high, low))])
    c0, c1 = (ends[0][k] * 2048 + ends[1][k] * 32 + ends[2][k] for k in (0, 1))
    wide = [[((x >> at & levels) * 255 + levels // 2) // levels for at, levels in ((11, 31), (5, 63), (0, 31))] for x in (c0, c1)]
    colors = [*wide, [(2 * p + q) // 3 for p, q in zip(*wide, strict=True)], [(p + 2 * q) // 3 for p, q in zip(*wide, strict=True)]]
    far = [sum((c - p[..., None]) ** 2 for c, p in zip((r, g, b), color, strict=True)) for color in colors]
    codes = np.argmin(np.stack(far), axis=0) * there
    return c0, c1, (codes << (2 * np.arange(16))).sum(axis=-1)


def _by_block(lines: DataFrame, samples: tuple[str, ...], ends: Callable, names: tuple[str, ...]) -> DataFrame:
    """A row for each block with what ends() says of it."""

    def encode(cells: dict[str, np.ndarray], there: np.ndarray) -> list[pa.Array]:
        found = ends(*(cells[c] for c in samples), there)
        offsets = pa.array(np.arange(len(found[0]) + 1) * found[0].shape[1], pa.int32())
        return [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64).ravel())) for x in found]

    strips = scanlines.in_blocks(lines, samples, encode, " ".join(f"{n} array<bigint>" for n in names))
    each = strips.select("texture_id", "by", F.inline(F.arrays_zip(F.transform(names[0], lambda _, k: k), *names)).alias("bx", *names))
    return each.select(*KEY, *[F.col(n).cast("int").alias(n) for n in names[:2]], names[2])


def bc3_alpha(planes: DataFrame) -> DataFrame:
    """Alpha blocks of planes (texels or lines with v): end points and 3-bit codes, texel 0 lowest."""
    return _by_block(scanlines.as_lines(planes, ("v",)), ("v",), alpha_ends, ("a0", "a1", "a_bits"))


def expanded(c: Column) -> list[Column]:
    """The 8-bit channels of an RGB565 word."""
    r, g, b = F.shiftright(c, 11), F.shiftright(c, 5).bitwiseAND(63), c.bitwiseAND(31)
    return [div(r * 255 + 15, 31), div(g * 255 + 31, 63), div(b * 255 + 15, 31)]


def palette(c0: Column, c1: Column) -> list[list[Column]]:
    """The four colours between two RGB565 words."""
    a, b = expanded(c0), expanded(c1)
    return [a, b, [div(p * 2 + q, 3) for p, q in zip(a, b, strict=True)], [div(p + q * 2, 3) for p, q in zip(a, b, strict=True)]]


def bc3_color(texels: DataFrame) -> DataFrame:
    """Colour blocks of texels or lines by range fit: two RGB565 corners of the block's box and 2-bit codes, texel 0 lowest."""
    return _by_block(scanlines.as_lines(texels, ("r", "g", "b")), ("r", "g", "b"), color_ends, ("c0", "c1", "c_bits"))


def little_endian(value: Column, n: int = 4) -> Column:
    """Hex digits of the n bytes of a number, lowest byte first."""
    digits = F.lpad(F.hex(value.cast("bigint")), 2 * n, "0")
    return F.concat(*[F.substring(digits, k, 2) for k in range(2 * n - 1, 0, -2)])


def _strip_bytes(cells: dict[str, np.ndarray], there: np.ndarray) -> list[pa.Array]:
    """The 16-byte blocks of each strip, one after the other."""
    found: dict[str, np.ndarray] = {}
    found["a0"], found["a1"], a_bits = alpha_ends(cells["a"], there)
    found["c0"], found["c1"], found["c_bits"] = color_ends(cells["r"], cells["g"], cells["b"], there)
    rows = np.zeros(a_bits.shape, [("a0", "u1"), ("a1", "u1"), ("a_bits", "u1", 6), ("c0", "<u2"), ("c1", "<u2"), ("c_bits", "<u4")])
    for name in ("a0", "a1", "c0", "c1", "c_bits"):
        rows[name] = found[name]
    rows["a_bits"] = a_bits[..., None] >> (8 * np.arange(6)) & 255
    return [pa.array([strip.tobytes() for strip in rows], pa.binary())]


def bc3_strips(texels: DataFrame) -> DataFrame:
    """texture_id, by, strip: the bytes of each line of blocks of texels or lines with r, g, b, a. One shuffle, of lines."""
    return scanlines.in_blocks(scanlines.as_lines(texels, tuple("rgba")), tuple("rgba"), _strip_bytes, "strip binary")


def bc3_payload(texels: DataFrame) -> DataFrame:
    """texture_id, payload of texels or lines. Strips are joined to whole textures as bytes only."""
    return bc3_strips(texels).groupBy("texture_id").agg(joined("strip", "`by`").alias("payload"))


def bc3_of_rasters(rasters: DataFrame) -> DataFrame:
    """rasters (with width, height and rgba, the bytes of a whole image) with payload; an image is one row's work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for width, height, data in zip(*(batch.column(c).to_pylist() for c in ("width", "height", "rgba")), strict=True):
                image = np.frombuffer(data, np.uint8).reshape(height, width, 4).astype(np.int64)
                high, wide = -(-height // 4), -(-width // 4)
                y, x = np.minimum(np.arange(4 * high), height - 1), np.minimum(np.arange(4 * wide), width - 1)
                there = (np.arange(4 * high) < height)[:, None] & (np.arange(4 * wide) < width)
                cut = lambda v, a=high, b=wide: v.reshape(a, 4, b, 4).swapaxes(1, 2).reshape(a, b, 16)
                cells = {c: cut(image[y][:, x, k]) for k, c in enumerate("rgba")}
                made.append(b"".join(s.as_py() for s in _strip_bytes(cells, cut(there))[0]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, "payload"])

    return rasters.mapInArrow(run, StructType([*rasters.schema.fields, StructField("payload", BinaryType())]))


def bc3_decode(alpha: DataFrame, color: DataFrame) -> DataFrame:
    """Texels of blocks of bc3_alpha and bc3_color."""
    each = alpha.join(color, KEY).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return _texels(each, _alpha_of_code(), palette(F.col("c0"), F.col("c1")))


def _alpha_of_code() -> Column:
    """Alpha of texel i: eight levels if a0 > a1, else six, 0 and 255."""
    code = shifted_right(F.col("a_bits"), F.col("i") * 3).bitwiseAND(7)
    between = lambda n: div((F.lit(n + 1) - code) * F.col("a0") + (code - 1) * F.col("a1"), n)
    six = F.when(code == 6, 0).when(code == 7, 255).otherwise(between(5))
    return F.when(code == 0, F.col("a0")).when(code == 1, F.col("a1")).when(F.col("a0") > F.col("a1"), between(7)).otherwise(six)


def _texels(each: DataFrame, alpha: Column, colors: list[list[Column]]) -> DataFrame:
    code = shifted_right(F.col("c_bits"), F.col("i") * 2).bitwiseAND(3)
    pick = lambda n: F.when(code == 0, colors[0][n]).when(code == 1, colors[1][n]).when(code == 2, colors[2][n]).otherwise(colors[3][n])
    y, x = F.col("by") * 4 + F.shiftright("i", 2), F.col("bx") * 4 + F.col("i").bitwiseAND(3)
    return each.select(
        "texture_id", y.cast("int").alias("y"), x.cast("int").alias("x"), *[pick(n).cast("int").alias(c) for n, c in enumerate("rgb")], alpha.cast("int").alias("a")
    )


def number(digits: Column, at: int, n: int) -> Column:
    """The number in n bytes, lowest first, from byte at of a value in hex digits."""
    return F.conv(F.concat(*[F.substring(digits, 2 * (at + k) + 1, 2) for k in range(n - 1, -1, -1)]), 16, 10).cast("bigint")


def decode_blocks(blocks: DataFrame) -> DataFrame:
    """texture_id, y, x, r, g, b, a of blocks: texture_id, by, bx, format (BC1, BC2 or BC3), block (8 or 16 bytes)."""
    plain = F.col("format") == "BC1"
    digits = blocks.withColumn("digits", F.hex("block")).withColumn("color", F.when(plain, F.col("digits")).otherwise(F.substring("digits", 17, 16)))
    read = digits.select(
        *KEY,
        "format",
        "digits",
        number(F.col("color"), 0, 2).cast("int").alias("c0"),
        number(F.col("color"), 2, 2).cast("int").alias("c1"),
        number(F.col("color"), 4, 4).alias("c_bits"),
        number(F.col("digits"), 0, 1).alias("a0"),
        number(F.col("digits"), 1, 1).alias("a1"),
        number(F.col("digits"), 2, 6).alias("a_bits"),
    )
    each = read.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(15))))
    # Only BC1 has blocks of three colours and transparent black; they are those whose first corner isn't the greater.
    three = plain & (F.col("c0") <= F.col("c1"))
    four = palette(F.col("c0"), F.col("c1"))
    middle = [F.when(three, div(p + q, 2)).otherwise(v) for p, q, v in zip(four[0], four[1], four[2], strict=True)]
    last = [F.when(three, F.lit(0)).otherwise(v) for v in four[3]]
    code = shifted_right(F.col("c_bits"), F.col("i") * 2).bitwiseAND(3)
    nibble = F.substring(F.col("digits"), F.col("i") + F.when(F.col("i") % 2 == 0, 2).otherwise(0), F.lit(1))
    alpha = F.when(plain, F.when(three & (code == 3), 0).otherwise(255)).when(F.col("format") == "BC2", F.conv(nibble, 16, 10).cast("bigint") * 17)
    return _texels(each, alpha.otherwise(_alpha_of_code()), [four[0], four[1], middle, last])


def _wide_colors(c: np.ndarray) -> np.ndarray:
    """The 8-bit channels of RGB565 words, in a last axis."""
    return np.stack([((c >> at & most) * 255 + most // 2) // most for at, most in ((11, 31), (5, 63), (0, 31))], axis=-1)


def decoded(data: np.ndarray, kind: str) -> np.ndarray:
    """r, g, b, a of the 16 texels of blocks: (blocks, 16, 4) of rows of 8 or 16 bytes."""
    color = data[:, -8:].astype(np.int64)
    c0, c1 = color[:, 0] + color[:, 1] * 256, color[:, 2] + color[:, 3] * 256
    codes = (color[:, 4:, None] >> (2 * np.arange(4)) & 3).reshape(-1, 16)
    p, q = _wide_colors(c0), _wide_colors(c1)
    # Only BC1 has blocks of three colours and transparent black; they are those whose first corner isn't the greater.
    three = ((c0 <= c1) & (kind == "BC1"))[:, None]
    colors = np.stack([p, q, np.where(three, (p + q) // 2, (2 * p + q) // 3), np.where(three, 0, (p + 2 * q) // 3)], axis=1)
    out = np.empty((len(data), 16, 4), np.int64)
    out[..., :3] = np.take_along_axis(colors, codes[..., None], axis=1)
    ahead = data[:, :8].astype(np.int64)
    if kind == "BC1":
        out[..., 3] = np.where(three & (codes == 3), 0, 255)
    elif kind == "BC2":
        out[..., 3] = (ahead[..., None] >> np.array([0, 4]) & 15).reshape(-1, 16) * 17
    else:
        a0, a1 = ahead[:, :1], ahead[:, 1:2]
        bits = (ahead[:, 2:] << (8 * np.arange(6))).sum(axis=1)
        code = bits[:, None] >> (3 * np.arange(16)) & 7
        eight, six = ((8 - code) * a0 + (code - 1) * a1) // 7, ((6 - code) * a0 + (code - 1) * a1) // 5
        six = np.where(code == 6, 0, np.where(code == 7, 255, six))
        out[..., 3] = np.where(code == 0, a0, np.where(code == 1, a1, np.where(a0 > a1, eight, six)))
    return out


def lines_of_strips(strips: DataFrame) -> DataFrame:
    """Lines r, g, b, a of strips: texture_id, width, height, format, at, strip (a line of texels, or of blocks at line 4 * at), without padding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = {c: batch.column(c).to_pylist() for c in ("width", "format")}
            height, at, ids = batch.column("height").to_numpy(), batch.column("at").to_numpy(), batch.column("texture_id")
            alike: dict[tuple, list[int]] = {}
            for k, shape in enumerate(zip(of["width"], of["format"], strict=True)):
                alike.setdefault(shape, []).append(k)
            for (width, kind), rows in alike.items():
                data = np.frombuffer(b"".join(batch.column("strip").take(pa.array(rows)).to_pylist()), np.uint8)
                rows = np.array(rows)
                if kind == "RGBA8":
                    image, y = data.reshape(len(rows), width, 4), at[rows]
                else:
                    many = -(-width // 4)
                    cells = decoded(data.reshape(len(rows) * many, -1), kind).reshape(len(rows), many, 4, 4, 4)
                    image = cells.swapaxes(1, 2).reshape(len(rows) * 4, many * 4, 4)[:, :width]
                    y, rows = (at[rows][:, None] * 4 + np.arange(4)).ravel(), np.repeat(rows, 4)
                inside = y < height[rows]
                samples = [scanlines.lists(image[inside][..., k]) for k in range(4)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[inside])), pa.array(y[inside], pa.int32()), *samples], names=["texture_id", "y", *"rgba"])

    kind = strips.schema["texture_id"].dataType.simpleString()
    return strips.mapInArrow(run, f"texture_id {kind}, y int, " + ", ".join(f"{c} array<int>" for c in "rgba"))
