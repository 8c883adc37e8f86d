"""Channel packing, splitting and resampling of texels; payloads and container bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import channels
from ..functions.channels import div
from ..functions.names import BAD_LEVEL
from . import scanlines
from .blocks import bc3_alpha, bc3_color, bc3_decode, bc3_payload, joined, lines_of_strips, little_endian, number

__all__ = ["bc3_alpha", "bc3_color", "bc3_decode", "bc3_payload"]

PLACE = ["texture_id", "y", "x"]
MAPS = ("normal", "roughness", "metallic")
#: Sizes beyond this are taken for damage.
MOST_SIDE = 65536


def merge_base_color(texels: DataFrame, alpha: str = "black") -> DataFrame:
    return texels.select(*PLACE, "r", "g", "b", channels.fill_alpha(alpha).alias("a"))


def split_color(texels: DataFrame) -> DataFrame:
    return texels.select(*PLACE, "r", "g", "b", F.col("a").alias("alpha"))


def split_packed(texels: DataFrame) -> DataFrame:
    normal = F.col("a").alias("normal_r"), F.col("g").alias("normal_g"), F.lit(255).alias("normal_b"), F.lit(255).alias("normal_a")
    return texels.select(*PLACE, channels.inverted(F.col("r")).alias("roughness"), F.col("b").alias("metallic"), *normal)


def resample(planes: DataFrame, source: int, target: int) -> DataFrame:
    """scanlines.resample() of texels."""
    if source == target:
        return planes
    return scanlines.texels(scanlines.resample(scanlines.as_lines(planes, ("v",)), source, target), ("v",))


def resample_to(texels: DataFrame, sizes: DataFrame, samples: tuple[str, ...] = ("v",)) -> DataFrame:
    """scanlines.resample_to() of texels."""
    return scanlines.texels(scanlines.resample_to(scanlines.as_lines(texels, samples), sizes, samples), samples)


def _with_expected(levels: DataFrame) -> DataFrame:
    first = Window.partitionBy("texture_id").orderBy("level")
    base = levels.withColumns({"bw": F.first("width").over(first), "bh": F.first("height").over(first)})
    sizes = {f"expected_{name}": channels.mip_size(F.col(short), F.col("level")) for name, short in (("width", "bw"), ("height", "bh"))}
    sized = base.withColumns(sizes).drop("bw", "bh")
    return sized.withColumn("wrong", (F.col("width") != F.col("expected_width")) | (F.col("height") != F.col("expected_height")))


def mip_errors(levels: DataFrame) -> DataFrame:
    """Every level with its expected size and a message if it is another. levels: texture_id, level, width, height."""
    message = F.format_string("level %d: expected %dx%d, got %dx%d", "level", "expected_width", "expected_height", "width", "height")
    columns = ["texture_id", "level", "width", "height", "expected_width", "expected_height"]
    return _with_expected(levels).select(*columns, F.when(F.col("wrong"), message).alias("error"))


def first_mip_error(levels: DataFrame) -> DataFrame:
    """texture_id and the error of its first level of a wrong size, as a job reports it (null if all are right)."""
    message = F.format_string(BAD_LEVEL, "level", "expected_width", "expected_height", "width", "height")
    return _with_expected(levels).groupBy("texture_id").agg(F.min_by(F.when(F.col("wrong"), message), F.when(F.col("wrong"), F.col("level"))).alias("error"))


def dds_header(width: Column, height: Column, levels: Column, bc3: Column) -> Column:
    """The 128 header bytes as hex."""
    # Fixed values of the container format.
    word = lambda v: little_endian(v if isinstance(v, Column) else F.lit(v))
    flags = F.when(bc3, 0x21007 + 0x80000).otherwise(0x21007 + 0x8)
    size = F.when(bc3, channels.bc3_size(width, height)).otherwise(width * 4)
    masks = [F.when(bc3, 0).otherwise(m) for m in (0xFF, 0xFF00, 0xFF0000, 0xFF000000)]
    caps = F.when(levels > 1, 0x1000 + 0x400008).otherwise(0x1000)
    words = [word(0x20534444), word(124), word(flags), word(height), word(width), word(size), word(0), word(levels), *[word(0)] * 11, word(32)]
    kind = [F.when(bc3, 0x4).otherwise(0x41), F.when(bc3, 0x35545844).otherwise(0), F.when(bc3, 0).otherwise(32)]
    return F.concat(*words, *map(word, kind), *map(word, masks), word(caps), *[word(0)] * 4)


def dds_info(files: DataFrame) -> DataFrame:
    """The rows of files (with bytes) and width, height, levels, format (BC1, BC2, BC3, RGBA8) and status of their level 0.

    status: ok, not_dds, unsupported_format, bad_size (a side of 0 or over MOST_SIDE; sizes and levels are null), or truncated.
    """
    return described(files, F.hex(F.substring("bytes", 1, 128)), F.octet_length("bytes").cast("bigint"))


def described(files: DataFrame, head: Column, length: Column) -> DataFrame:
    """dds_info() from the hex digits of the first 128 bytes and the length of the file."""
    fourcc = F.substring(head, 169, 8)
    blocks = F.when(number(head, 80, 4).bitwiseAND(4) == 4, F.element_at(F.create_map(*[F.lit(x) for x in ("44585431", "BC1", "44585433", "BC2", "44585435", "BC3")]), fourcc))
    plain = (number(head, 80, 4) == 0x41) & (number(head, 88, 4) == 32) & (F.substring(head, 185, 32) == "FF00000000FF00000000FF00000000FF")
    width, height, levels = number(head, 16, 4), number(head, 12, 4), F.greatest(F.lit(1), number(head, 28, 4))
    is_dds = (length >= 128) & (F.substring(head, 1, 8) == "44445320")
    kind = F.when(is_dds, F.when(plain, "RGBA8").otherwise(blocks))
    fits = width.between(1, MOST_SIDE) & height.between(1, MOST_SIDE) & (levels <= MOST_SIDE)
    sized = lambda n: F.when(is_dds & fits, n).cast("int")
    read = files.withColumns({"width": sized(width), "height": sized(height), "levels": sized(levels), "format": kind})
    status = F.when(~F.coalesce(is_dds, F.lit(False)), "not_dds").when(kind.isNull(), "unsupported_format").when(~fits, "bad_size")
    return read.withColumn("status", status.when(length < payload_size() + 128, "truncated").otherwise("ok"))


def payload_size() -> Column:
    """Bytes of level 0 of rows with format, width and height."""
    half = F.when(F.col("format") == "BC1", 2).otherwise(1)
    return F.when(F.col("format") == "RGBA8", F.col("width").cast("bigint") * F.col("height") * 4).otherwise(div(channels.bc3_size(F.col("width"), F.col("height")), half))


def dds_strips(files: DataFrame) -> DataFrame:
    """Level 0 of DDS files, cut: texture_id, width, height, format, at, strip: the bytes of a line of texels, or of a line of blocks.

    files: texture_id, bytes; those that dds_info() gives another status than ok have no rows. Each file is read once.
    """
    good = dds_info(files).where("status = 'ok'")
    plain = F.col("format") == "RGBA8"
    size = F.when(plain, F.col("width") * 4).otherwise(div(F.col("width") + 3, 4) * F.when(F.col("format") == "BC1", 8).otherwise(16)).cast("int")
    many = F.when(plain, F.col("height")).otherwise(div(F.col("height") + 3, 4)).cast("int")
    cut = good.withColumn("strip_bytes", size).withColumn("at", F.explode(F.sequence(F.lit(0), many - 1)))
    return cut.select("texture_id", "width", "height", "format", "at", F.substring("bytes", F.col("at") * F.col("strip_bytes") + 129, F.col("strip_bytes")).alias("strip"))


def dds_lines(files: DataFrame) -> DataFrame:
    """Level 0 of DDS files as lines of r, g, b, a. files: texture_id, bytes; those that can't be read have no rows."""
    return lines_of_strips(dds_strips(files))


def dds_texels(files: DataFrame) -> DataFrame:
    """dds_lines() as texels."""
    return scanlines.texels(dds_lines(files), tuple("rgba"))


def rgba8_payload(texels: DataFrame) -> DataFrame:
    """texture_id and the raw texel bytes, line by line, of texels or lines."""
    return scanlines.rgba8_payload(scanlines.as_lines(texels, tuple("rgba")))


def payload(texels: DataFrame, uncompressed: bool) -> DataFrame:
    return rgba8_payload(texels) if uncompressed else bc3_payload(texels)


def assemble_levels(levels: DataFrame) -> DataFrame:
    """texture_id and the payloads of its levels joined, level 0 first. levels: texture_id, level, payload."""
    return levels.groupBy("texture_id").agg(F.count(F.lit(1)).cast("int").alias("levels"), joined("payload", "level").alias("payload"))
