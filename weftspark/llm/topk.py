"""Exact top-k search by inner product, with an impact-ordered index read a score at a time.

Rows are dealt into blocks of bounded size, and each block's index is written once to the shared folder. In a block, a
value counts by how far it is from the middle of its dimension; times the query's weight, that distance is its impact. The
distances of a dimension are quantised into LEVELS segments of postings of equal size. A query processes segments by
descending quantised impact, adding to its accumulators.

What a row's score can still gain or lose is bounded by what is left of the dimensions whose segment with the row is not
processed yet. Processing stops when the rows that this bound proves to be the only possible members of the best k are
few; all of these are scored exactly. Until then, and at worst to the end, segments are processed.

Values are floor(1024 * x) and scores are exact integer sums; a score beyond 64 bits is an error. Vectors that are null or
hold null or non-finite components take no part; shorter vectors, also those of no components, count as filled with zeros. Ties go to the smaller id.
Rows that repeat an id are candidates of their own, but never for a query with their id; equal queries have equal rows
once. A query with fewer than k candidates returns all of them. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, kept, mapped_file, new_folder, put_file
from .elias_fano import dump, load

K = 10
LEVELS = 8
BLOCK_ROWS = 8192
BLOCK_QUERIES = 1024
#: Possible members are few if they are FEW times k or a FEW_SHARE-th of the rows. After each LOOKS-th of the postings the
#: bound is looked at: for PROBED rows first, then for all if so few of those are possible members that the end is near.
FEW, FEW_SHARE, LOOKS, PROBED = 8, 16, 32, 256
FOUND = "query_id bigint, vec_id bigint, score bigint, postings bigint, of bigint"


def quantised(vector: Column) -> Column:
    """floor(1024 * x) of each component; null if the vector takes no part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    value = lambda x: F.floor(x.cast("double") * 1024)
    inside = lambda x: F.when(F.abs(x.cast("double")) < 2.0**52, value(x).cast("bigint")).otherwise(F.raise_error(F.lit("a component is 2**52 or more")).cast("bigint"))
    return F.when(vector.isNotNull() & finite, F.transform(vector, inside))


def exact_scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products; in whole numbers of any size where 64 bits might not hold them."""
    most = int(np.abs(rows).max(initial=0)) * int(np.abs(query).max(initial=0)) * max(rows.shape[1], 1)
    if most < 1 << 63:
        return rows @ query
    found = rows.astype(object) @ query.astype(object)
    if len(found) and max(abs(x) for x in found) >= 1 << 63:
        raise OverflowError("a score does not fit in 64 bits")
    return found.astype(np.int64)


class Block:
    """The index of one block: for each dimension, the rows by descending distance from its middle, cut into segments."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.middle = np.median(rows, axis=0) if len(rows) else np.zeros(rows.shape[1])
        offsets = (rows - self.middle).T
        order = np.argsort(-np.abs(offsets), axis=1, kind="stable")
        n = len(ids)
        self.cuts = np.unique(np.linspace(0, n, LEVELS + 1).astype(np.int64))
        #: By dimension: rows, and their values from the middle.
        self.order, self.offsets = order.astype(np.int32), np.take_along_axis(offsets, order, axis=1)
        #: The largest distance of each segment, and 0 after the last.
        self.reach = np.concatenate([np.abs(self.offsets[:, self.cuts[:-1]]).T, np.zeros((1, rows.shape[1]))])
        segment = np.empty(offsets.shape, np.uint8)
        of_place = np.searchsorted(self.cuts, np.arange(n), "right") - 1
        np.put_along_axis(segment, order, np.broadcast_to(of_place, offsets.shape).astype(np.uint8), axis=1)
        self.segment = np.ascontiguousarray(segment.T)

    ARRAYS = ("ids", "rows", "middle", "order", "offsets", "cuts", "reach", "segment")

    def arrays(self) -> dict[str, np.ndarray]:
        return {name: getattr(self, name).ravel() for name in self.ARRAYS}

    @classmethod
    def read(cls, arrays: dict[str, np.ndarray]) -> Block:
        block = cls.__new__(cls)
        for name in cls.ARRAYS:
            setattr(block, name, arrays[name])
        width = len(block.middle)
        for name in ("rows", "reach", "segment"):
            setattr(block, name, getattr(block, name).reshape(-1, width))
        for name in ("order", "offsets"):
            setattr(block, name, getattr(block, name).reshape(width, -1))
        return block

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """ids and scores of the k best rows, and the number of postings processed."""
        width = min(len(query), self.rows.shape[1])
        query = query[:width]
        own = self.ids == query_id
        want = min(k, len(self.ids) - int(own.sum()))
        if want <= 0:
            return self.ids[:0], np.zeros(0, np.int64), 0
        weights = np.abs(query).astype(np.float64)
        used = np.flatnonzero(weights)
        impacts = self.reach[:-1, used] * weights[used]
        levels, places = np.unravel_index(np.argsort(-impacts, axis=None, kind="stable"), impacts.shape)
        taken = np.zeros(width, np.int64)
        got = np.full(len(self.ids), float(self.middle[:width] @ query))
        candidates = np.flatnonzero(~own)
        total = len(self.ids) * len(used)
        processed, look, few = 0, total // LOOKS, max(FEW * k, len(self.ids) // FEW_SHARE)
        slack = 1e-9 * (float(np.abs(self.middle[:width]) @ weights) + float(self.reach[0, :width] @ weights)) + 1e-6
        for level, d in zip(levels, used[places], strict=True):
            part = slice(self.cuts[level], self.cuts[level + 1])
            got[self.order[d, part]] += self.offsets[d, part] * float(query[d])
            processed += part.stop - part.start
            taken[d] = level + 1
            if processed < look:
                continue
            look = processed + total // LOOKS
            left = self.reach[taken, np.arange(width)] * weights
            # The rows that lead now have at least this, whatever is left: no row that stays below it is among the best.
            lead = candidates[np.argpartition(got[candidates], len(candidates) - want)[len(candidates) - want :]]
            proven = float((got[lead] - self._left(lead, taken, left, width)).min()) - slack
            some = candidates[:: -(-len(candidates) // PROBED)]
            if np.mean(got[some] + self._left(some, taken, left, width) + slack >= proven) * len(candidates) > 2 * few:
                continue
            candidates = candidates[got[candidates] + self._left(candidates, taken, left, width) + slack >= proven]
            if len(candidates) <= few:
                break
        scores = exact_scores(self.rows[candidates, :width], query)
        best = np.lexsort((self.ids[candidates], -scores))[:want]
        return self.ids[candidates[best]], scores[best], processed

    def _left(self, candidates: np.ndarray, taken: np.ndarray, left: np.ndarray, width: int) -> np.ndarray:
        """How much each candidate's score may differ from what it has got: the sum over the dimensions not processed for it."""
        out = np.empty(len(candidates))
        for at in range(0, len(candidates), 4096):
            part = candidates[at : at + 4096]
            out[at : at + 4096] = (self.segment[part, :width] >= taken) @ left
        return out


def _written(rows: DataFrame, blocks: int, folder: str, name: str, index: bool) -> DataFrame:
    """number, path of a file for each of so many blocks of rows (vec_id, v); with index, its segments."""

    def write(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id", kind="stable")
        ids, number = part["vec_id"].to_numpy(np.int64), int(part["block"].iloc[0])
        matrix = np.zeros((len(part), max(1, *map(len, part["v"]))), np.int64)
        for i, v in enumerate(part["v"]):
            matrix[i, : len(v)] = v
        arrays = Block(ids, matrix).arrays() if index else {"ids": ids, "rows": matrix.ravel(), "middle": np.zeros(matrix.shape[1])}
        path = f"{folder}/{name}-{number}"
        put_file(path, lambda out: out.write(dump(arrays)))
        return pd.DataFrame({"number": [number], "path": [path]})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)))
    return kept(dealt.groupBy("block").applyInPandas(write, "number bigint, path string"), f"{name}-files")


def search(vectors: DataFrame, queries: DataFrame, k: int = K, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score, and the postings processed of how many. Both inputs have vec_id and embedding.

    Tasks get names of files only: each reads the index of one block and the queries of one group.
    """
    spark = vectors.sparkSession
    take = lambda df: df.select(F.col("vec_id").cast("bigint").alias("vec_id"), quantised(F.col("embedding")).alias("v")).where("v is not null and vec_id is not null")
    rows, asked = take(vectors), take(queries).dropDuplicates(["vec_id", "v"])
    folder = new_folder(spark, "topk")
    blocks = _written(rows, -(-rows.count() // block_rows) or 1, folder, "block", True)
    groups = _written(asked, -(-asked.count() // block_queries) or 1, folder, "queries", False)
    n_blocks, n_groups = blocks.count(), groups.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, query_path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block, arrays = Block.read(load(mapped_file(path))), load(mapped_file(query_path))
                found = [block.search(int(i), q, k) for i, q in zip(arrays["ids"], arrays["rows"].reshape(len(arrays["ids"]), -1), strict=True)]
                times = [len(ids) for ids, _, _ in found]
                spread = lambda x: np.repeat(np.array(x, np.int64), times)
                columns = [spread(arrays["ids"]), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])]
                columns += [spread([f[2] for f in found]), spread([block.rows.size] * len(found))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in FOUND.split(", ")])

    # Every block with every group of queries, as all rows are to be searched; the names are few.
    numbered = lambda df, name: df.select(F.row_number().over(Window.orderBy("number")).alias(name), F.col("path").alias(f"{name}_path"))
    cells = spark.range(n_blocks * n_groups).select((F.col("id") % max(n_blocks, 1) + 1).alias("b"), (F.floor(F.col("id") / max(n_blocks, 1)) + 1).alias("g"))
    cells = cells.join(numbered(blocks, "b"), "b").join(numbered(groups, "g"), "g").select("b_path", "g_path")
    found = kept(cells.repartition(max(n_blocks * n_groups, 1)).mapInArrow(run, FOUND), "found")
    forget(blocks, groups)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "postings", "of")
