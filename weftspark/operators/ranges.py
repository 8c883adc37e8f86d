"""Running values over any number of rows: ranges of time are worked on apart, and what one range hands to the next is joined in.

Rows are dealt by range and key, so that neither a hot key nor the whole table is one task's. A range of a key is summed up
in one row; only these rows, at most as many as ranges for a key, are brought together to carry on from range to range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_RANGES = 256


def cut_points(rows: DataFrame, time: str, many: int) -> list[int]:
    """Up to many - 1 times, in microseconds, that cut the rows into ranges of about equal numbers."""
    shares = [k / many for k in range(1, many)]
    found = rows.agg(F.percentile_approx(micros(time), shares, 10 * many).alias("cuts")).first()["cuts"]
    return sorted(set(found or []))


def micros(time: str) -> Column:
    return F.unix_micros(F.col(time).cast("timestamp"))


def range_of(value: Column, cuts: list[int]) -> Column:
    """The number of cuts that are not after the value, by halving; 0 for null."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value >= cuts[middle], among(middle + 1, high)).otherwise(among(low, middle))

    return among(0, len(cuts))


def with_range(rows: DataFrame, time: str, ranges: int | None = None) -> DataFrame:
    """rows with _span, the number of their range of time. Rows of one microsecond share a range."""
    many = ranges or min(MOST_RANGES, max(2, 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return rows.withColumn("_span", range_of(micros(time), cut_points(rows, time, many)))


def carried(summaries: DataFrame, per: tuple[str, ...], **values: Column) -> DataFrame:
    """A row for each key and range: what the ranges before say. values are over `before`, or, if their name begins with whole_, over all ranges of the key."""
    before = Window.partitionBy(*per).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*per)
    return summaries.select(*per, "_span", *[v.over(whole if name.startswith("whole_") else before).alias(name) for name, v in values.items()])


def joined(rows: DataFrame, carry: DataFrame, per: tuple[str, ...]) -> DataFrame:
    """rows with what was carried to their key and range; keys may be null."""
    names = ["_span", *per]
    other = carry.select(*[F.col(c).alias(f"own_{c}") for c in names], *[c for c in carry.columns if c not in names])
    same = F.col("_span") == F.col("own__span")
    for c in per:
        same = same & F.col(c).eqNullSafe(F.col(f"own_{c}"))
    return rows.join(other, same).drop(*[f"own_{c}" for c in names])
