"""The catalogue of asset packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names


def list_packages(listing: DataFrame) -> DataFrame:
    """name, disabled, bytes, modified_at. listing: name (package), is_dir, length, modified. Without a directory row the newest file dates it."""
    dated = F.coalesce(F.max(F.when(F.col("is_dir"), F.col("modified"))), F.max("modified"))
    length = F.when(F.col("is_dir"), F.lit(0)).otherwise(F.coalesce("length", F.lit(0)))
    found = listing.groupBy("name").agg(F.sum(length).cast("bigint").alias("bytes"), dated.alias("modified_at"))
    return found.select("name", names.is_disabled(F.col("name")).alias("disabled"), "bytes", "modified_at")


def packages_of_paths(files: DataFrame, root: str) -> DataFrame:
    """The listing of list_packages() from paths under a root: a package is the first segment below it; plain files in the root are none."""
    below = F.expr(f"substr(path, {len(root.rstrip('/')) + 2})")
    inside = files.where(F.col("path").startswith(root.rstrip("/") + "/")).withColumn("below", below)
    inside = inside.where(F.col("below").contains("/") | F.col("is_dir"))
    top = F.regexp_extract("below", "^([^/]+)", 1)
    # Only the package's own directory dates it; those within count as files of length 0.
    own = F.col("is_dir") & ~F.rtrim(F.regexp_replace("below", "/$", "")).contains("/")
    length = F.when(F.col("is_dir"), 0).otherwise(F.col("length"))
    return inside.select(top.alias("name"), own.alias("is_dir"), length.cast("bigint").alias("length"), "modified")


def package_count(packages: DataFrame) -> DataFrame:
    return packages.agg(F.count(F.lit(1)).alias("packages"))


def sort_keys(how: str) -> list[Column]:
    """Display orders; nulls count as 0, the name breaks ties. Names sort by Unicode collation."""
    name = F.collate("name", "UNICODE")
    if how == "name-asc":
        return [name.asc(), F.col("name")]
    if how == "name-desc":
        return [name.desc(), F.col("name")]
    if how == "size-desc":
        return [F.coalesce("bytes", F.lit(0)).desc(), F.col("name")]
    if how == "date-desc":
        return [F.coalesce("modified_at", F.timestamp_seconds(F.lit(0)).cast("timestamp_ntz")).desc(), F.col("name")]
    raise ValueError(f"no order is called {how}")


def import_files(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Files after an import: same relative paths are overwritten, others stay. Both: rel_path, length."""
    return existing.join(incoming.select("rel_path"), "rel_path", "left_anti").unionByName(incoming)


def _before_abort(sources: DataFrame) -> DataFrame:
    """The sources up to the first file that fails, with that one's place as stop; sources that are neither directory nor file go."""
    known = sources.where("kind in ('dir', 'file')")
    stop = known.where("kind = 'file' and error is not null").agg(F.min("ord").alias("stop"))
    return known.join(F.broadcast(stop), F.col("stop").isNull() | (F.col("ord") <= F.col("stop")))  # stop is one row


def imported_sources(sources: DataFrame) -> DataFrame:
    """ord and source of what an import took in: a file that fails ends it, a directory that fails does not."""
    return _before_abort(sources).where("error is null").select("ord", "source")


def import_report(sources: DataFrame) -> DataFrame:
    """imported, failed (directories) and aborted, the error of the file that ended the import or null. sources: ord, kind, error."""
    failed = F.col("error").isNotNull()
    ended = F.when(failed & (F.col("kind") == "file"), F.col("error"))
    return _before_abort(sources).agg(F.count_if(~failed).alias("imported"), F.count_if(failed & (F.col("kind") == "dir")).alias("failed"), F.max(ended).alias("aborted"))


def import_errors(sources: DataFrame) -> DataFrame:
    """ord and error of the directories that failed, a row each."""
    return _before_abort(sources).where("kind = 'dir' and error is not null").select("ord", "error")


def import_outcome(sources: DataFrame) -> DataFrame:
    """imported and errors in one row; a file that fails is an error of the query. sources: kind (dir, file, other), error.

    The errors are few; import_errors() gives any number of them as rows.
    """
    failed = F.col("error").isNotNull()
    known = sources.where("kind in ('dir', 'file')")
    stopped = F.when(failed & (F.col("kind") == "file"), F.raise_error(F.col("error")).cast("string"))
    message = F.coalesce(stopped, F.when(failed, F.col("error")))
    return known.agg(F.count_if(~failed).alias("imported"), F.array_sort(F.collect_list(message)).alias("errors"))


def toggle(packages: DataFrame) -> DataFrame:
    """name, new_name, collides: renaming onto a name that exists is reported."""
    renamed = packages.select("name", names.toggled(F.col("name")).alias("new_name"))
    taken = packages.select(F.col("name").alias("new_name"), F.lit(True).alias("taken"))
    return renamed.join(taken.distinct(), "new_name", "left").select("name", "new_name", F.coalesce("taken", F.lit(False)).alias("collides"))


def delete(packages: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The packages that stay, and for each wanted name whether it was deleted."""
    stay = packages.join(wanted.select("name"), "name", "left_anti")
    done = wanted.join(packages.select("name", F.lit(True).alias("there")).distinct(), "name", "left")
    return stay, done.select("name", F.coalesce("there", F.lit(False)).alias("deleted"))


def shown() -> list[Column]:
    """The texts that a package is shown with."""
    date = F.coalesce(F.date_format("modified_at", "MM/dd"), F.lit("unknown"))
    return [names.display_name(F.col("name")).alias("title"), names.size_text(F.col("bytes")).alias("size_text"), date.alias("date_text")]


def display(packages: DataFrame) -> DataFrame:
    return packages.select("name", *shown())
