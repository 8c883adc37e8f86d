"""Product codes of vectors, their nearest entries found with fixed pivots.

The codebook of each part position starts as that part of the first vectors. Some of these entries, far from each other,
are the position's pivots for good. The distance of each part to its pivots is computed once and written beside the part.
In a round, only the distances of pivots to entries are new: the difference of the two distances bounds the distance of
part and entry from below. Entries are evaluated in the order of that bound, exactly in whole numbers, until the bound
passes the best distance; float distances are lowered by more than their error, so no nearest entry and no tie is lost.

Components are floor(scale * x); one beyond 2**26 is an error. Vectors that are null or hold null or non-finite components
take no part; shorter vectors count as filled with zeros, as does a length that can't be divided by the number of parts.
Ties of distance go to the lower index; of rows that repeat an id, the smaller vector is first; a null id comes last. With
fewer vectors than entries, codebooks have as many entries as there are vectors. An empty table gives no rows. Other
columns are not read.

Tasks give sums for each part position and entry only; what reaches the driver has the size of the codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, forget, kept

PARTS, ENTRIES, ROUNDS, SCALE, PIVOTS = 16, 64, 2, 256, 3
#: Sums of labels are broadcast up to so many labels, and joined by salted keys beyond.
LABELS, SALTS = 1 << 16, 16
#: Relative and absolute error of a stored distance, at most.
RELATIVE, ABSOLUTE = 3e-7, 1e-6


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; null if the vector takes no part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    value = lambda x: F.floor(x.cast("double") * scale)
    inside = lambda x: F.when(F.abs(x.cast("double") * scale) <= 2.0**26, value(x).cast("int")).otherwise(F.raise_error(F.lit("a component is beyond 2**26")).cast("int"))
    return F.when(vector.isNotNull() & finite, F.transform(vector, inside))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows, filled with zeros."""
    values, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    lengths = np.diff(offsets)
    if len(lengths) and (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width), values.dtype)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def distances(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to a few others."""
    return np.stack([((rows - o) ** 2).sum(axis=1) for o in others], axis=1)


def far_apart(book: np.ndarray, pivots: int) -> np.ndarray:
    """Entries as pivots: the first, then always the one with the largest distance to those before."""
    chosen = [0]
    while len(chosen) < min(pivots, len(book)):
        chosen.append(int(distances(book, book[chosen]).min(axis=1).argmax()))
    return book[chosen]


def nearest(rows: np.ndarray, to_pivots: np.ndarray, book: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each row, its squared distance, and the number of entries evaluated."""
    of_entries = np.sqrt(distances(pivots, book))
    bound = np.zeros((len(rows), len(book)))
    for own, entries in zip(to_pivots.T.astype(np.float64), of_entries, strict=True):
        np.maximum(bound, np.abs(own[:, None] - entries) - (own[:, None] * RELATIVE + ABSOLUTE), out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, axis=1) ** 2
    index, best, evaluated = np.zeros(len(rows), np.int64), np.full(len(rows), np.iinfo(np.int64).max), np.zeros(len(rows), np.int64)
    left = np.arange(len(rows))
    for k in range(len(book)):
        left = left[bound[left, k] <= best[left]]
        if not len(left):
            break
        entry = order[left, k]
        found = ((rows[left] - book[entry]) ** 2).sum(axis=1)
        better = (found < best[left]) | (found == best[left]) & (entry < index[left])
        index[left[better]], best[left[better]] = entry[better], found[better]
        evaluated[left] += 1
    return index, best, evaluated


def _cut(batch: pa.RecordBatch, parts: int, width: int, pivots: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts and their distances to pivots: rows, part positions, components or pivots."""
    v = matrix(batch.column("v"), width).astype(np.int64).reshape(batch.num_rows, parts, -1)
    return v, matrix(batch.column("to_pivots"), parts * pivots).reshape(batch.num_rows, parts, pivots)


def _table(rows: DataFrame, width: int, pivots: np.ndarray) -> DataFrame:
    """vec_id, label, v, to_pivots: a distance for each part position and pivot."""
    parts, each, d = pivots.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"), width).astype(np.int64).reshape(-1, parts, d)
            found = np.stack([np.sqrt(distances(v[:, k], pivots[k])) for k in range(parts)], axis=1).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * parts * each, pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["vec_id", "label", "v", "to_pivots"])

    return rows.mapInArrow(run, f"vec_id bigint, label {rows.schema['label'].dataType.simpleString()}, v array<int>, to_pivots array<float>")


def _moved(table: DataFrame, books: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The codebooks after a round: each entry the floored mean of its parts; entries without parts stay."""
    parts, entries, d = books.shape
    width, each = parts * d, pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, d), np.int64)
        for batch in batches:
            v, to_pivots = _cut(batch, parts, width, each)
            for k in range(parts):
                index, _, _ = nearest(v[:, k], to_pivots[:, k], books[k], pivots[k])
                n[k] += np.bincount(index, minlength=entries)
                np.add.at(sums[k], index, v[:, k])
        part, entry = np.nonzero(n)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * d, pa.int32()), pa.array(sums[part, entry].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), lists], names=["part", "entry", "n", "sums"])

    found = table.select("v", "to_pivots").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>").select("part", "entry", "n", F.posexplode_outer("sums").alias("place", "s"))
    moved = books.copy()
    for r in found.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():  # as many rows as the codebooks have components
        if r["place"] is not None:
            moved[r["part"], r["entry"], r["place"]] = r["s"] // r["n"]
    return moved


def _coded(table: DataFrame, books: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """vec_id, label, code, error, evaluated of every vector."""
    parts, _, d = books.shape
    width, each = parts * d, pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, to_pivots = _cut(batch, parts, width, each)
            found = [nearest(v[:, k], to_pivots[:, k], books[k], pivots[k]) for k in range(parts)]
            digits = np.stack([f[0] for f in found], axis=1).tolist()
            columns = [pa.array(["".join(f"{i:02x}" for i in row) for row in digits], pa.string()), *(pa.array(sum(f[k] for f in found)) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), *columns], names=["vec_id", "label", "code", "error", "evaluated"])

    return table.mapInArrow(run, f"vec_id bigint, label {table.schema['label'].dataType.simpleString()}, code string, error bigint, evaluated bigint")


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded with label_error: the sum of errors of its label, nulls together. A label may hold any share of the rows."""
    sums = kept(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "own")
    same = F.col("label").eqNullSafe(F.col("own"))
    if sums.count() <= LABELS:
        return coded.join(F.broadcast(sums), same).drop("own")
    salted = sums.withColumn("own_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, same & (F.col("salt") == F.col("own_salt"))).drop("own", "salt", "own_salt")


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, pivots: int = PIVOTS, label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error, evaluated (entries whose distance was computed), label_error of every vector; the codebooks by part, entry and place."""
    bounded_batches(vectors.sparkSession)
    if entries > 256:
        raise ValueError("an index has two hex digits")
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(label_col).alias("label"), quantised(F.col("embedding"), scale).alias("v")).where("v is not null")
    width = -(-(rows.agg(F.max(F.size("v"))).first()[0] or 0) // parts) * parts
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()
    books = np.array([[*r["v"], *[0] * (width - len(r["v"]))] for r in first], np.int64).reshape(len(first), parts, width // parts).swapaxes(0, 1).copy()
    if not first:
        empty = rows.select("vec_id", "label", F.lit("").alias("code"), *(F.lit(0).cast("bigint").alias(c) for c in ("error", "evaluated", "label_error")))
        return empty, books
    fixed = np.stack([far_apart(book, pivots) for book in books])
    table = kept(_table(rows, width, fixed), "vector-parts")
    for _ in range(rounds):
        books = _moved(table, books, fixed)
    coded = kept(_coded(table, books, fixed), "vector-codes")
    forget(table)
    return with_label_error(coded), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
