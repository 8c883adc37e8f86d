"""Rasters as one row a line: texture_id, y, and an array of each sample, in order of x.

Shuffles move lines, strips of four lines, or bytes of them, so their rows are fewer than texels by a line's width, and
texels of a line need no grouping. Lines are whole: the arrays of a texture have one length. Resampling and encoding are
array arithmetic on the lines that Spark brings together in a task: bands of lines, or strips of four.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import channels
from ..functions.channels import div, shifted_left

LINE = ["texture_id", "y"]
#: Output lines that a task makes of a texture at once.
BAND = 64


def of_texels(texels: DataFrame, samples: tuple[str, ...]) -> DataFrame:
    """Lines of texels (texture_id, y, x and the samples)."""
    cells = F.array_sort(F.collect_list(F.struct("x", *samples)))
    return texels.groupBy(*LINE).agg(cells.alias("cells")).select(*LINE, *[F.col(f"cells.{c}").alias(c) for c in samples])


def as_lines(rows: DataFrame, samples: tuple[str, ...]) -> DataFrame:
    """Lines as they are, or those of texels, which have a column x."""
    return of_texels(rows, samples) if "x" in rows.columns else rows.select(*LINE, *samples)


def texels(lines: DataFrame, samples: tuple[str, ...]) -> DataFrame:
    """A row for each texel."""
    places = F.transform(F.col(samples[0]), lambda _, x: x)
    return lines.select(*LINE, F.inline(F.arrays_zip(places, *samples)).alias("x", *samples))


def grouped(rows: DataFrame, group: str, kernel: Callable, schema: str) -> DataFrame:
    """Rows that share texture_id and a number are brought into one task, ordered by y, and given to kernel in tables of whole groups.

    kernel gets a table and its groups: for each different content of SHAPE columns and places y, the rows of all such
    groups, as a matrix of one row a group.
    """
    keyed = rows.withColumn("key", F.to_json(F.struct("texture_id")))
    dealt = keyed.repartition("texture_id", group).sortWithinPartitions("key", group, "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = _starts(batch, group)
            if held and (len(starts) > 1 or not _same(held[-1], batch, group)):
                first = 0 if not _same(held[-1], batch, group) else starts[1]
                yield from kernel(pa.Table.from_batches([*held, batch.slice(0, first)]).combine_chunks())
                held, batch, starts = [], batch.slice(first), starts[starts >= first] - first
            if len(starts) > 1:
                yield from kernel(pa.Table.from_batches([batch.slice(0, starts[-1])]))
                batch = batch.slice(starts[-1])
            held.append(batch)
        if held:
            yield from kernel(pa.Table.from_batches(held).combine_chunks())

    return dealt.mapInArrow(run, schema)


def _starts(rows: pa.RecordBatch | pa.Table, group: str) -> np.ndarray:
    """The first row of each group."""
    key, number = rows.column("key"), rows.column(group).to_numpy()
    key = (key.combine_chunks() if isinstance(key, pa.ChunkedArray) else key).dictionary_encode()
    ids = key.indices.to_numpy()
    return np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (number[1:] != number[:-1])]))


def _same(before: pa.RecordBatch, after: pa.RecordBatch, group: str) -> bool:
    """Whether a batch goes on with the last group of the one before."""
    return all(before.column(c)[-1] == after.column(c)[0] for c in ("key", group))


def _alike(table: pa.Table, group: str, shape: tuple[str, ...]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """shape's values, the places y, and the rows of all groups that share both: a matrix of one row a group."""
    starts = _starts(table, group)
    stops = np.append(starts[1:], table.num_rows)
    y, columns = table.column("y").to_numpy(), [table.column(c).to_numpy() for c in shape]
    found: dict[tuple, list[int]] = {}
    for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
        found.setdefault((*(int(c[a]) for c in columns), y[a:b].tobytes()), []).append(a)
    for key, at in found.items():
        places = np.frombuffer(key[-1], y.dtype).astype(np.int64)
        yield key[:-1], places, np.array(at)[:, None] + np.arange(len(places))


def _values(table: pa.Table, name: str, rows: np.ndarray, width: int) -> np.ndarray:
    """The samples of lines of one width: groups, lines, samples."""
    column = table.column(name).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[rows][..., None] + np.arange(width)].astype(np.int64)


def lists(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(rows, np.int32).ravel()))


def triangle(n: int, m: int) -> np.ndarray:
    """Exact whole-number weights of n samples (rows) for m (columns): a triangle about each output's middle."""
    i, o = np.arange(n, dtype=np.int64)[:, None], np.arange(m, dtype=np.int64)
    return np.maximum(0, 2 * max(n, m) - np.abs((2 * i + 1) * m - (2 * o + 1) * n))


def _reached(n: Column, m: Column, i: Column) -> tuple[Column, Column]:
    """The first and last of m outputs that sample i of n may count for."""
    center, reach = (i * 2 + 1) * m, F.greatest(n, m) * 2
    return F.greatest(F.lit(0), div(center - reach, n * 2) - 1), F.least(m - 1, div(center + reach, n * 2) + 1)


def _resampled(rows: DataFrame, samples: tuple[str, ...]) -> DataFrame:
    """Lines from lines with width, height, target_width and target_height beside them. Each goes to the bands of output lines that it counts for."""
    first, last = _reached(F.col("height"), F.col("target_height"), F.col("y"))
    bands = F.explode(F.sequence(F.floor(first / BAND), F.floor(last / BAND))).alias("band")
    sizes = ("width", "height", "target_width", "target_height")

    def kernel(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for (width, height, target_width, target_height, band), places, at in _alike(table, "band", (*sizes, "band")):
            lines = np.arange(band * BAND, min((band + 1) * BAND, target_height))
            across, down = triangle(width, target_width), triangle(height, target_height)[np.ix_(places, lines)]
            total = down.sum(axis=0)[:, None] * across.sum(axis=0)
            # Whole numbers below 2**52 are exact in floats, whose products are faster.
            kind = np.float64 if int(total.max(initial=0)) * 255 < 1 << 52 else np.int64
            known = np.flatnonzero(total.any(axis=1))
            made = []
            for c in samples:
                sums = down.T.astype(kind) @ (_values(table, c, at, width).astype(kind) @ across.astype(kind))
                whole = sums.astype(np.int64)[:, known]
                made.append(lists(((2 * whole + total[known]) // (2 * total[known])).reshape(-1, target_width)))
            ids = table.column("texture_id").take(pa.array(np.repeat(at[:, 0], len(known)))).combine_chunks()
            yield pa.RecordBatch.from_arrays([ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids, pa.array(np.tile(lines[known], len(at)), pa.int32()), *made], names=["texture_id", "y", *samples])

    cut = rows.select("texture_id", "y", *[F.col(c).cast("int").alias(c) for c in sizes], *samples, bands)
    kind = rows.schema["texture_id"].dataType.simpleString()
    return grouped(cut, "band", kernel, f"texture_id {kind}, y int, " + ", ".join(f"{c} array<int>" for c in samples))


def resample(lines: DataFrame, source: int, target: int, samples: tuple[str, ...] = ("v",)) -> DataFrame:
    """Textures of source x source samples at target x target, rounded half up."""
    if source == target:
        return lines
    sizes = {"width": source, "height": source, "target_width": target, "target_height": target}
    return _resampled(lines.withColumns({c: F.lit(n) for c, n in sizes.items()}), samples)


def resample_to(lines: DataFrame, sizes: DataFrame, samples: tuple[str, ...] = ("v",)) -> DataFrame:
    """Textures at sizes of their own: texture_id, width, height, target_width, target_height."""
    return _resampled(lines.join(sizes, "texture_id"), samples)


def pack_maps(lines: DataFrame) -> DataFrame:
    """R = 255 - roughness, G = normal G, B = metallic, A = normal R, line by line: pr, pg, pb, pa.

    lines: texture_id, kind (normal, roughness or metallic), y, r, g, b. Lines that lack a map have no row.
    """
    of = lambda kind, value: F.max(F.when(F.col("kind") == kind, value))
    grey = F.transform(F.arrays_zip("r", "g", "b"), lambda t: channels.luma(t["r"], t["g"], t["b"]))
    packed = lines.where(F.col("kind").isin("normal", "roughness", "metallic")).groupBy(*LINE).agg(
        of("roughness", F.transform(grey, channels.inverted)).alias("pr"), of("normal", F.col("g")).alias("pg"), of("metallic", grey).alias("pb"), of("normal", F.col("r")).alias("pa")
    )
    return packed.where("pr is not null and pg is not null and pb is not null")


def merge_base_color(lines: DataFrame, alpha: str = "black") -> DataFrame:
    return lines.select(*LINE, "r", "g", "b", with_alpha("r", channels.fill_alpha(alpha)).alias("a"))


def with_alpha(like: str, value: Column) -> Column:
    """As many times the value as a line has texels."""
    return F.array_repeat(value.cast("int"), F.size(like))


def override_alpha(lines: DataFrame, mode: str) -> DataFrame:
    return lines if mode not in ("black", "white") else lines.withColumn("a", with_alpha("r", channels.override_alpha(F.col("a"), mode)))


def interleaved(samples: list[Column]) -> Column:
    """The bytes of a line whose texels have these samples."""
    many = len(samples)
    word = F.transform(samples[0], lambda v: v.cast("bigint"))
    for sample in samples[1:]:
        word = F.zip_with(word, sample, lambda a, b: a * 256 + b)
    return F.unhex(F.array_join(F.transform(word, lambda w: F.lpad(F.hex(w), 2 * many, "0")), ""))


def joined(value: str, order: str) -> Column:
    """The bytes of all rows of a group one after the other."""
    return F.expr(f"listagg({value}) within group (order by {order})")


def rgba8_payload(lines: DataFrame) -> DataFrame:
    """texture_id and the raw texel bytes, line by line."""
    rows = lines.select("texture_id", "y", interleaved([F.col(c) for c in "rgba"]).alias("strip"))
    return rows.groupBy("texture_id").agg(joined("strip", "y").alias("payload"))


def in_blocks(lines: DataFrame, samples: tuple[str, ...], encode: Callable, columns: str) -> DataFrame:
    """texture_id, by, and columns that encode makes of strips of four lines cut into blocks of 4 x 4.

    encode gets a dict of samples (strips, blocks, 16), and which of the 16 texels are there (blocks, 16) - at the right
    and lower edges some aren't, they repeat others of their block - and gives an Arrow array of one value a strip for each
    column.
    """

    def kernel(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for (width, by), places, at in _alike(table, "by", ("width", "by")):
            many = -(-width // 4)
            x = np.minimum(np.arange(4 * many), width - 1)
            line = np.minimum(np.searchsorted(places & 3, np.arange(4)), len(places) - 1)
            there = np.isin(np.arange(4), places & 3)[:, None] & (np.arange(4 * many) < width)
            cut = lambda v: np.moveaxis(v.reshape(*v.shape[:-2], 4, many, 4), -3, -2).reshape(*v.shape[:-2], many, 16)
            cells = {c: cut(_values(table, c, at, width)[:, line][:, :, x]) for c in samples}
            ids = table.column("texture_id").take(pa.array(at[:, 0])).combine_chunks()
            made = encode(cells, cut(there))
            yield pa.RecordBatch.from_arrays([ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids, pa.array(np.full(len(at), by), pa.int32()), *made], names=["texture_id", "by", *(f"c{k}" for k in range(len(made)))])

    rows = lines.select("texture_id", F.col("y").cast("int").alias("y"), F.shiftright("y", 2).cast("int").alias("by"), F.size(samples[0]).alias("width"), *samples)
    kinds = ", ".join(f"c{k} {kind}" for k, kind in enumerate(columns.split()[1::2]))
    found = grouped(rows, "by", kernel, f"texture_id {lines.schema['texture_id'].dataType.simpleString()}, by int, {kinds}")
    return found.toDF("texture_id", "by", *columns.split()[::2])
