"""Texture sets from a file listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names


def image_files(listing: DataFrame) -> DataFrame:
    return listing.where(names.is_image(F.col("path")))


def find_sets(listing: DataFrame) -> DataFrame:
    """prefix and the four paths of each complete set. Of several files of a kind, the greatest path counts."""
    files = image_files(listing).withColumn("stem", names.stem(F.col("path"))).withColumn("kind", names.map_kind(F.col("stem")))
    files = files.where("kind <> ''").withColumn("prefix", names.set_prefix(F.col("stem"), F.col("kind")))
    found = files.groupBy("prefix").agg(*[F.max(F.when(F.col("kind") == k, F.col("path"))).alias(k) for k in names.KINDS])
    return found.where(" and ".join(f"{k} is not null" for k in names.KINDS))


def sequence_errors(folders: DataFrame, sequence: DataFrame) -> DataFrame:
    """dir and the error of those folders that have no numbered files."""
    return folders.select("dir").distinct().join(sequence.select("dir"), "dir", "left_anti").select("dir", F.lit(names.NO_LEVELS).alias("error"))


def numbered_sequence(listing: DataFrame) -> DataFrame:
    """dir, i, path, level: of files p0 to p999 the best extension of each number; the level is the place, not the number."""
    name = names.basename(F.col("path"))
    files = listing.where(name.rlike(r"^p(0|[1-9][0-9]{0,2})[.](png|tga|jpg|jpeg)$")).select(
        F.regexp_replace("path", r"/[^/]*$", "").alias("dir"),
        F.regexp_extract(name, "^p([0-9]+)", 1).cast("int").alias("i"),
        F.array_position(F.array(*map(F.lit, names.EXTENSIONS)), names.extension(F.col("path"))).alias("rank"),
        "path",
    )
    best = files.groupBy("dir", "i").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))
    return best.withColumn("level", F.row_number().over(Window.partitionBy("dir").orderBy("i")) - 1)


def split_outputs(files: DataFrame, export_format: str = "png", export_alpha: bool = True) -> DataFrame:
    """path, channel, name (and ord, if there): what splitting each file writes; files of neither kind write nothing."""
    own = [c for c in ("path", "ord") if c in files.columns]
    s = names.stem(F.col("path"))
    listed = lambda *parts: F.array(*map(F.lit, parts))
    color = listed("BaseColor", "Alpha") if export_alpha else listed("BaseColor")
    channels = F.when(names.split_kind(s) == "c", color).when(names.split_kind(s) == "n", listed("Roughness", "Metallic", "Normal"))
    out = files.select(*own, names.split_prefix(s).alias("prefix"), F.explode(channels).alias("channel"))
    return out.select(*own, "channel", F.concat("prefix", F.lit("_"), "channel", F.lit(f".{export_format}")).alias("name"))


def collisions(outputs: DataFrame) -> DataFrame:
    """For each output name the last input in list order, and how many inputs name it. outputs: ord, path, name."""
    return outputs.groupBy("name").agg(F.max_by("path", "ord").alias("path"), F.count(F.lit(1)).alias("inputs"))


def selection_union(*selections: DataFrame) -> DataFrame:
    """ord and path, each path at its first place; selection_in_order() sorts them."""
    whole = selections[0]
    for more in selections[1:]:
        whole = whole.unionByName(more)
    return whole.groupBy("path").agg(F.min("ord").alias("ord"))


def selection_in_order(*selections: DataFrame) -> DataFrame:
    """The union by first place."""
    return selection_union(*selections).orderBy("ord")


def split_inputs(manifest: DataFrame) -> DataFrame:
    return manifest.where(names.is_dds(F.col("path")))


def selection_remove(selection: DataFrame, removed: DataFrame) -> DataFrame:
    return selection.join(removed.select("path"), "path", "left_anti")
