"""Task progress, activity entries and job profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from . import ranges

FEED, TOASTS = 40, 4


def collapse_runs(
    events: DataFrame, gap_seconds: float, per: tuple[str, ...] = (), what: tuple[str, ...] = ("tone",), order: tuple[str, ...] = ("ts",), count: int | None = None
) -> DataFrame:
    """Runs of entries that repeat the one before within the gap: first_ts, last_ts, repeats.

    per names the lines (tasks) that runs are in; without it, all entries are one line. Entries are worked on in ranges of
    time (count of them, or as many as there are partitions to shuffle to), however long a line is.
    """
    rows = ranges.with_range(events, "ts", count)
    line = Window.partitionBy("_span", *per).orderBy(*order)
    entry = F.struct(F.lit(True).alias("known"), F.col("ts").alias("ts"), *[F.col(c).alias(f"what{k}") for k, c in enumerate(what)])
    ends = rows.groupBy(*per, "_span").agg(F.max_by(entry, F.struct(*order)).alias("_end"))
    carry = ranges.carried(ends, per, _last_before=F.last("_end"))
    before = F.coalesce(F.lag(entry).over(line), F.col("_last_before"))
    marked = ranges.joined(rows, carry, per).withColumn("_before", before)
    late = ranges.micros("ts") - ranges.micros("_before.ts") > int(gap_seconds * 1_000_000)
    other = F.lit(False)
    for k, c in enumerate(what):
        other = other | ~F.col(c).eqNullSafe(F.col(f"_before.what{k}"))
    breaks = F.when(F.col("_before.ts").isNull() | late | other, 1).otherwise(0)
    # Parts of runs within a range, then the numbers that the ranges before have reached.
    numbered = marked.withColumn("_new", breaks).withColumn("_part", F.sum("_new").over(line))
    parts = numbered.groupBy("_span", *per, "_part", *what).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("repeats"))
    reached = ranges.carried(parts.groupBy(*per, "_span").agg(F.max("_part").alias("_most")), per, _runs_before=F.sum("_most"))
    whole = ranges.joined(parts, reached, per).withColumn("run", F.coalesce("_runs_before", F.lit(0)) + F.col("_part"))
    return whole.groupBy(*per, "run", *what).agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("repeats").alias("repeats"))


def activity_feed(events: DataFrame, keep: int = FEED) -> DataFrame:
    """The newest entries; how many to keep is the feature."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(keep)


def activity_count(events: DataFrame) -> DataFrame:
    """The number of all entries, which goes on counting when the feed is full."""
    return events.agg(F.count(F.lit(1)).alias("entries"))


def toasts(events: DataFrame, gap_seconds: float, per: tuple[str, ...] = (), what: tuple[str, ...] = ("tone",), order: tuple[str, ...] = ("ts",), keep: int = TOASTS) -> DataFrame:
    """The newest runs of repeated entries; how many to keep is the feature."""
    runs = collapse_runs(events, gap_seconds, per, what, order)
    return runs.orderBy(F.desc("first_ts"), *[F.desc(c) for c in per], F.desc("run")).limit(keep)


def progress_view(progress: DataFrame, count: int | None = None) -> DataFrame:
    """Running count, total and percent of each task's events, in ranges of time, however many a task has. progress: task_id, event_id, ts."""
    per = ("task_id",)
    rows = ranges.with_range(progress, "ts", count)
    numbers = rows.groupBy(*per, "_span").agg(F.count(F.lit(1)).alias("n"))
    carry = ranges.carried(numbers, per, done_before=F.sum("n"), whole_total=F.sum("n"))
    so_far = F.row_number().over(Window.partitionBy("_span", *per).orderBy("ts", "event_id"))
    counted = ranges.joined(rows, carry, per).withColumn("completed", (so_far + F.coalesce("done_before", F.lit(0))).cast("bigint"))
    return counted.select("task_id", "event_id", "completed", F.col("whole_total").alias("total"), names.percent(F.col("completed"), F.col("whole_total")).alias("percent"))


def in_task(progress: DataFrame, tasks: DataFrame) -> DataFrame:
    """Events within their task's time; the others are dropped."""
    joined = progress.join(tasks, "task_id")
    return joined.where((F.col("ts") >= F.col("start_ts")) & (F.col("ts") <= F.col("end_ts"))).select("task_id", "event_id", "ts")


def task_counts(items: DataFrame) -> DataFrame:
    """task_id, completed, total; the log lines stay rows of items."""
    return items.groupBy("task_id").agg(F.count_if("ok").alias("completed"), F.count(F.lit(1)).alias("total"))


def task_outcome(items: DataFrame) -> DataFrame:
    """task_id, completed, total, logs in order, as one row takes them. items: task_id, ord, ok, message.

    For tasks of any length, task_counts() leaves the lines as rows.
    """
    logs = F.transform(F.array_sort(F.collect_list(F.struct("ord", "message"))), lambda x: x["message"])
    return items.groupBy("task_id").agg(F.count_if("ok").alias("completed"), F.count(F.lit(1)).alias("total"), logs.alias("logs"))


def readiness(rules: list[tuple[Column, str]]) -> Column:
    """The message of the first rule that fails, or null."""
    return F.coalesce(*[F.when(failed, F.lit(message)) for failed, message in rules])


def _last_of_key(values: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """A row for each profile with the last value of each key: profile_id, seq, key, value."""
    last = values.groupBy("profile_id", "key").agg(F.max_by("value", "seq").alias("value"))
    return last.groupBy("profile_id").pivot("key", list(keys)).agg(F.first("value"))


def fold_profiles(patches: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """A row for each profile with the last value of each known key. patches: profile_id, seq, key, value (a number as text).

    The rows of a profile that share seq are one patch; it is rejected whole if one of its values isn't a number.
    """
    read = patches.withColumn("number", F.expr("try_cast(value as double)"))
    sound = read.groupBy("profile_id", "seq").agg(F.min(F.col("number").isNotNull()).alias("sound")).where("sound").drop("sound")
    return _last_of_key(read.join(sound, ["profile_id", "seq"]).select("profile_id", "seq", "key", F.col("number").alias("value")), keys)


#: Types that a setting may have, as schema_of_variant() names those of a value.
SETTING_TYPES = {"string": ("STRING",), "boolean": ("BOOLEAN",), "bigint": ("BIGINT",), "double": ("BIGINT", "DOUBLE", "DECIMAL")}


def fold_settings(patches: DataFrame, settings: dict[str, tuple[str, object]]) -> DataFrame:
    """The settings of each profile after its patches: profile_id, applied and rejected (numbers of patches), and a column a setting.

    patches: profile_id, seq, patch (JSON text). settings: type (string, boolean, bigint or double) and default by key. A
    patch counts whole or not at all: one that isn't an object, or has a known key of another type, changes nothing; null
    is another type. Keys that aren't known are dropped. A profile without a sound patch has the defaults.
    """
    read = patches.withColumn("v", F.expr("try_parse_json(patch)"))
    kind = F.expr("schema_of_variant(v)")
    of = lambda key: F.expr(f"variant_get(v, '$[\"{key}\"]')")
    wrong = F.coalesce(~kind.startswith("OBJECT"), F.lit(True))
    for key, (wanted, _) in settings.items():
        name = F.regexp_extract(F.expr(f"schema_of_variant(variant_get(v, '$[\"{key}\"]'))"), "^[A-Z]+", 0)
        wrong = wrong | (of(key).isNotNull() & ~name.isin(*SETTING_TYPES[wanted]))
    checked = read.withColumn("sound", ~F.when(F.coalesce(~kind.startswith("OBJECT"), F.lit(True)), True).otherwise(wrong))
    values = {key: F.when(F.col("sound"), F.expr(f"try_variant_get(v, '$[\"{key}\"]', '{wanted}')")) for key, (wanted, _) in settings.items()}
    taken = checked.select("profile_id", "seq", "sound", *[v.alias(key) for key, v in values.items()])
    last = [F.coalesce(F.max_by(key, F.when(F.col(key).isNotNull(), F.col("seq"))), F.lit(default).cast(wanted)).alias(key) for key, (wanted, default) in settings.items()]
    return taken.groupBy("profile_id").agg(F.count_if("sound").alias("applied"), F.count_if(~F.col("sound")).alias("rejected"), *last)
