"""Mixing sources to target weights.

Tokens are summed per source, each source gets a target, and target over size is its repetition rate. A document is
emitted floor(rate) times, plus one copy if a hash of its id, seeded, falls below the fraction; so the expected tokens
of a source are its target, whatever the order and partitioning of the rows, and reruns agree.

Targets share a stated multiple of all tokens by weight. None exceeds max_repeat times its source's tokens; what is
over is shared again by weight among the others. That is the same as min(max_repeat * size, level * weight) with one
common level, found from the sorted ratios of the sources.

Null text has size 0; a document of size 0 takes nothing. Null is a source like any other, last in order. A source
without tokens has target 0, and its documents are emitted no time. Equal ids draw alike. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, kept

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEAT = 2
SEED = "mix-1"
#: Up to so many sources, the targets are broadcast; above, both sides are shuffled.
BROADCAST_SOURCES = 20_000


def size_of(text: Column) -> Column:
    """Number of words (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, share: float = SHARE, max_repeat: int = MAX_REPEAT, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target of each source; sizes has source and size."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.asc_nulls_last("source"))  # one row for each source, already summed
    by_ratio = Window.orderBy("ratio", F.asc_nulls_last("source"))
    place = F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights)))
    totals = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("double"))
    totals = totals.withColumn("most", (F.col("source_size") * max_repeat).cast("double")).withColumn("ratio", F.col("most") / F.col("weight"))
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    totals = totals.withColumn("whole", F.sum("source_size").over(everything) * F.lit(share))
    # With all smaller ratios at their cap, the others' common level; the first that its own cap allows is the answer.
    totals = totals.withColumn("level", (F.col("whole") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    allowed = F.when(F.col("level") <= F.col("ratio"), F.struct(F.col("at"), F.col("level")))
    totals = totals.withColumn("at", F.row_number().over(by_ratio)).withColumn("level", F.min(allowed).over(everything)["level"])
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("weight")))
    return totals.select("source", "source_size", target.alias("target"))


def draw(id_col: Column, seed: str = SEED) -> Column:
    """A number from 0 to under 1 for each id (52 bits of its MD5)."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(1 << 52))


def copies(docs: DataFrame, seed: str = SEED, **shares) -> DataFrame:
    """doc (the row as a struct), doc_id, size, source_size, target and copies, the number of times to emit the document."""
    whole_row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    sized = docs.select(whole_row, "doc_id", "source", size_of(F.col("text")).alias("size"))
    wanted = kept(targets(sized.select("source", "size"), **shares), "targets")
    few = wanted.count() <= BROADCAST_SOURCES
    wanted = wanted.withColumnRenamed("source", "wanted_source")
    joined = sized.join(F.broadcast(wanted) if few else wanted, F.col("source").eqNullSafe(F.col("wanted_source")), "left").drop("wanted_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return joined.withColumn("copies", (whole + F.when(draw(F.col("doc_id"), seed) < rate - whole, 1).otherwise(0)).cast("bigint"))


def mix(docs: DataFrame, seed: str = SEED, **shares) -> DataFrame:
    """The mixed documents, with the columns of docs: each as many times as copies() says."""
    found = copies(docs, seed, **shares).where("copies > 0")
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
