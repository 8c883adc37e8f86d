"""The jobs that a user calls, composed of the operators.

A job gives its files (rows with name and bytes or pixels) and its log (ord or name, ok, message), from which
activity.task_outcome() makes the task's result. Where an input can't be used, on_error="fail" ends the query with the
error, and on_error="collect" leaves the input's files out and logs the error with ok = false.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import channels, names
from ..operators import activity, catalog, raster, scanlines, sets
from ..sources import dds

dds_texels = raster.dds_texels


class Job(NamedTuple):
    files: DataFrame
    log: DataFrame


def _checked(rows: DataFrame, error: Column, on_error: str) -> DataFrame:
    """The rows without an error; with on_error="fail", the first error met ends the query."""
    if on_error not in ("fail", "collect"):
        raise ValueError(f"on_error is fail or collect, not {on_error}")
    if on_error == "collect":
        return rows.where(error.isNull())
    return rows.where(F.when(error.isNotNull(), F.raise_error(error).cast("boolean")).otherwise(True))


def save_files(job: Job, folder: str) -> int:
    """Write a job's files of name and bytes below a folder; none has its name before all are written. The number of files."""
    return dds.save(job.files, folder)


def find_sets(listing: DataFrame) -> DataFrame:
    """The complete sets, by prefix in byte order."""
    return sets.find_sets(listing).orderBy("prefix")


def _of_kinds(texels: DataFrame, found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """The rows of the sets' maps under their prefix and kind. texels: texture_id is a path."""
    maps = found.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("path")) for k in kinds])).alias("map"), "prefix")
    keyed = maps.select(F.col("map.path").alias("texture_id"), F.col("map.kind").alias("kind"), "prefix")
    return texels.join(keyed, "texture_id").drop("texture_id").withColumnRenamed("prefix", "texture_id")


def merge_sets(texels: DataFrame, found: DataFrame, alpha: str = "black", sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The _c and _n lines of complete sets, keyed by prefix. texels: texels or lines.

    With sizes (texture_id, width, height of each map), roughness and metallic are resampled to the normal map's size;
    without, the maps of a set have one size.
    """
    lines = scanlines.as_lines(texels, tuple("rgba"))
    maps = _of_kinds(lines.drop("a"), found, raster.MAPS)
    if sizes is not None:
        of_maps = _of_kinds(sizes, found, raster.MAPS)
        wanted = of_maps.where("kind = 'normal'").select("texture_id", F.col("width").alias("target_width"), F.col("height").alias("target_height"))
        pairs = of_maps.join(wanted, "texture_id").withColumn("texture_id", F.struct("texture_id", "kind")).drop("kind")
        resized = scanlines.resample_to(maps.withColumn("texture_id", F.struct("texture_id", "kind")), pairs, ("r", "g", "b"))
        maps = resized.withColumn("kind", F.col("texture_id.kind")).withColumn("texture_id", F.col("texture_id.texture_id"))
    color = _of_kinds(lines, found, ("basecolor",))
    return scanlines.merge_base_color(color, alpha), scanlines.pack_maps(maps)


def _dds(payloads: DataFrame, uncompressed: bool) -> Column:
    """The bytes of a file of rows with width, height, levels and payload."""
    header = raster.dds_header(F.col("width"), F.col("height"), F.col("levels"), F.lit(not uncompressed))
    return F.concat(F.unhex(header), F.col("payload")).alias("bytes")


def merge_files(texels: DataFrame, sizes: DataFrame, listing: DataFrame, alpha: str = "black", fmt: str = "DXT5", lenient: bool = False) -> Job:
    """The _c.dds and _n.dds files of all complete sets of a listing (K2). texels (or lines), sizes: texture_id is a path."""
    uncompressed = names.is_uncompressed(fmt, lenient)
    found = sets.find_sets(listing)
    color, packed = merge_sets(texels, found, alpha, sizes)
    packed = packed.select(*scanlines.LINE, F.col("pr").alias("r"), F.col("pg").alias("g"), F.col("pb").alias("b"), F.col("pa").alias("a"))
    of_kind = _of_kinds(sizes, found, ("basecolor", "normal"))
    files = []
    for at, (made, kind) in enumerate(((color, "basecolor"), (packed, "normal"))):
        whole = raster.payload(made, uncompressed).join(of_kind.where(F.col("kind") == kind), "texture_id").withColumn("levels", F.lit(1))
        files.append(whole.select(names.merge_names(F.col("texture_id"))[at].alias("name"), _dds(whole, uncompressed)))
    line = F.format_string(names.DONE, "prefix")
    return Job(files[0].unionByName(files[1]), found.select(F.col("prefix").alias("name"), F.lit(True).alias("ok"), line.alias("message")))


def split_files(files: DataFrame, export_format: str = "png", export_alpha: bool = True, on_error: str = "fail") -> Job:
    """The channel images of packed DDS files (K3). files: path, bytes, ord.

    Gives name, width, height, channels (1, 3 or 4) and pixels; of inputs that write one name, the last in order counts.
    """
    info = raster.dds_info(files)
    error = F.when(F.col("status") != "ok", F.concat_ws(": ", "path", "status"))
    good = _checked(info, error, on_error)
    kind = names.split_kind(names.stem(F.col("path")))
    outputs = sets.split_outputs(good.where(kind.isNotNull()).select("path", "ord"), export_format, export_alpha)
    chosen = sets.collisions(outputs.select("path", "ord", "channel", "name")).select("path", "name")
    wanted = outputs.select("path", "channel", "name").distinct().join(chosen, ["path", "name"])
    lines = raster.dds_lines(good.select(F.col("path").alias("texture_id"), "bytes"))
    r, g, b, a = (F.col(c) for c in "rgba")
    full = scanlines.with_alpha("r", F.lit(255))
    of_channel = {"BaseColor": [r, g, b], "Alpha": [a], "Roughness": [F.transform(r, channels.inverted)], "Metallic": [b], "Normal": [a, g, full, full]}
    each = lines.join(wanted.withColumnRenamed("path", "texture_id"), "texture_id")
    pick = lambda of: F.coalesce(*[F.when(F.col("channel") == c, of(v)) for c, v in of_channel.items()])
    rows = each.select("texture_id", "name", "y", pick(lambda v: F.lit(len(v))).alias("channels"), pick(scanlines.interleaved).alias("strip"))
    whole = rows.groupBy("texture_id", "name", "channels").agg(raster.joined("strip", "y").alias("pixels"))
    sizes = good.select(F.col("path").alias("texture_id"), "width", "height").distinct()
    made = whole.join(sizes, "texture_id").select("name", "width", "height", "channels", "pixels")
    message = F.coalesce(error, names.split_line(names.stem(F.col("path")), kind, export_alpha))
    return Job(made, info.select("ord", error.isNull().alias("ok"), message.alias("message")))


def mip_files(texels: DataFrame, levels: DataFrame, alpha: str = "keep", fmt: str = "DXT5", lenient: bool = False, on_error: str = "fail") -> Job:
    """A file of each sequence of levels (K4). levels: texture_id, level, width, height; texels: texture_id, level, y, x, r, g, b, a, or lines with a level."""
    uncompressed = names.is_uncompressed(fmt, lenient)
    errors = raster.first_mip_error(levels)
    good = _checked(errors, F.col("error"), on_error).select("texture_id")
    shown = texels.join(good, "texture_id", "left_semi").withColumn("texture_id", F.struct("texture_id", "level"))
    one = raster.payload(scanlines.override_alpha(scanlines.as_lines(shown, tuple("rgba")), alpha), uncompressed)
    whole = raster.assemble_levels(one.select("texture_id.texture_id", "texture_id.level", "payload"))
    base = levels.groupBy("texture_id").agg(F.min_by("width", "level").alias("width"), F.min_by("height", "level").alias("height"))
    made = whole.join(base, "texture_id")
    name = F.concat(F.col("texture_id").cast("string"), F.lit("/Mipmap.dds"))
    line = F.coalesce("error", F.format_string(names.MADE, name))
    return Job(made.select(name.alias("name"), _dds(made, uncompressed)), errors.select(name.alias("name"), F.col("error").isNull().alias("ok"), line.alias("message")))


def dds_files(texels: DataFrame, sizes: DataFrame, fmt: str = "8.8.8.8", lenient: bool = False) -> DataFrame:
    """name and bytes of DDS files of one level. sizes: texture_id (a path), width, height."""
    uncompressed = names.is_uncompressed(fmt, lenient)
    made = raster.payload(texels, uncompressed).join(sizes, "texture_id").withColumn("levels", F.lit(1))
    return made.select(names.convert_name(F.col("texture_id")).alias("name"), _dds(made, uncompressed))


def convert_images(texels: DataFrame, sizes: DataFrame, alpha: str = "keep", fmt: str = "8.8.8.8", lenient: bool = False) -> DataFrame:
    return dds_files(scanlines.override_alpha(scanlines.as_lines(texels, tuple("rgba")), alpha), sizes, fmt, lenient)


def convert_files(texels: DataFrame, manifest: DataFrame, alpha: str = "keep", fmt: str = "DXT5", lenient: bool = False, on_error: str = "fail") -> Job:
    """A DDS file of each image of a manifest (K5): path, ord, width, height, status. Of images with one output name the last counts."""
    error = F.when(F.col("status") != "ok", F.concat_ws(": ", "path", "status"))
    good = _checked(manifest, error, on_error).withColumn("name", names.convert_name(F.col("path")))
    chosen = sets.collisions(good).select(F.col("path").alias("texture_id")).distinct()
    sizes = good.select(F.col("path").alias("texture_id"), "width", "height").distinct().join(chosen, "texture_id", "left_semi")
    files = convert_images(texels.join(sizes, "texture_id", "left_semi"), sizes, alpha, fmt, lenient)
    line = F.coalesce(error, names.convert_line(F.col("path")))
    return Job(files, manifest.select("ord", error.isNull().alias("ok"), line.alias("message")))


def import_packages(existing: DataFrame, incoming: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files after an import (rel_path, length) and its outcome (K7). incoming: source, rel_path, length; sources: ord, source, kind, error."""
    report = catalog.import_report(sources)
    done = catalog.imported_sources(sources)
    return catalog.import_files(existing, incoming.join(done, "source", "left_semi").select("rel_path", "length")), report


def package_view(packages: DataFrame, sort: str = "name-asc") -> tuple[DataFrame, DataFrame]:
    """The display of packages in a sort order, and their number (K10)."""
    shown = packages.select("name", "bytes", "modified_at", *catalog.shown())
    return shown.orderBy(*catalog.sort_keys(sort)).select("name", "title", "size_text", "date_text"), catalog.package_count(packages)


def task_view(progress: DataFrame, tasks: DataFrame) -> DataFrame:
    """Progress within each task's time, with its running count, total and percent (K12). tasks: task_id, start_ts, end_ts."""
    return activity.progress_view(activity.in_task(progress, tasks))
