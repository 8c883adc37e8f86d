"""Language identification by prediction by partial matching.

Each language has a context tree over bytes, of variable order up to ORDER. A byte seen after its context costs
log2((total + distinct) / count) bits there; one not seen costs the escape, log2((total + distinct) / distinct) bits,
and what it costs after the context that is one byte shorter. A context never seen in the language costs nothing and is
shortened; below order 0, each of the 256 bytes costs 8 bits. The statistics are frozen: scoring a text does not change
them. A text belongs to the language that codes it in the fewest bits; equal lengths go to the smaller name.

The trees are learned from at most rows_per_lang documents and bytes_per_lang bytes of each language, in expectation (those
whose hashed id falls under a share that their number and size give); all bytes of those count. Everything else covers all
documents and whole texts. A sample of more than MOST_GRAMS different strings, or tables of more than MOST_COSTS costs, are
refused: they go to every task.

A text that is null, empty, or without a letter is `und` with score 0. With no learned language, all texts are. The
score of another text is the share of its language among all, by 2 to the power of minus bits. Repeated rows are judged
alike; other columns are not read. lang, source and id take no part in a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, forget, kept, small_batches, text_bytes

ORDER = 3
ROWS_PER_LANG, BYTES_PER_LANG = 2000, 32 << 20
MOST_GRAMS, MOST_COSTS = 20_000_000, 1 << 26
BROADCAST_LANGS = 10_000
#: Bytes of text that a task looks at together.
AT_ONCE = 1 << 20


@dataclass
class Tables:
    """Costs in bits, a column for each language.

    seen[n]: sorted numbers of the (n+1)-byte strings that some language knows; cost[n]: of the last byte after the n
    before it; contexts[n]: sorted numbers of the n-byte contexts; leave[n]: of the escape from each of these.
    """

    langs: list[str]
    seen: list[np.ndarray]
    cost: list[np.ndarray]
    contexts: list[np.ndarray]
    leave: list[np.ndarray]


def gram_counts(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG, bytes_per_lang: int = BYTES_PER_LANG) -> DataFrame:
    """lang, n, gram, count: strings of 1 to ORDER + 1 bytes of the training documents. docs: doc_id, text, lang."""
    labelled = docs.where("lang is not null and text is not null")
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))
    share = F.least(F.lit(rows_per_lang) / F.col("rows"), F.lit(bytes_per_lang) / F.greatest("bytes", F.lit(1)))
    place = F.shiftrightunsigned(F.xxhash64(F.lit("ppm"), F.col("doc_id").cast("string")), 11) / F.lit(float(1 << 53))
    few = sizes.count() <= BROADCAST_LANGS  # else the texts would be dealt out by language
    chosen = labelled.join(F.broadcast(sizes) if few else sizes, "lang").where(place < share).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in small_batches([whole], "text", 8 << 20)):
            names = np.array(batch.column("lang").to_pylist(), object)
            data, offsets = text_bytes(batch.column("text"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            for lang in dict.fromkeys(names):
                keep, value = (names == lang)[row], data.astype(np.uint32)
                for n in range(ORDER + 1):
                    if n:
                        value = value[:-1] << np.uint32(8) | data[n:]
                    if not len(value):
                        break
                    inside = keep[n:] & (row[: len(row) - n] == row[n:])
                    gram, count = np.unique(value[inside], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(np.full(len(gram), n, np.int32)), pa.array(gram.astype(np.int64)), pa.array(count.astype(np.int64))], names=["lang", "n", "gram", "count"])

    return chosen.mapInArrow(run, "lang string, n int, gram bigint, count bigint").groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))


def fit(counts: DataFrame) -> Tables:
    """The tables of the collected counts: the sample bounds their number, which is checked first."""
    counts = kept(counts, "gram-counts")
    if (n := counts.count()) > MOST_GRAMS:
        raise ValueError(f"the sample has {n} strings of up to {ORDER + 1} bytes; take fewer rows or bytes of each language")
    found = counts.toPandas()
    forget(counts)
    langs = sorted(found["lang"].unique())
    levels: list[dict[str, tuple[np.ndarray, np.ndarray]]] = []
    for n in range(ORDER + 1):
        of_n = found[found["n"] == n].sort_values("gram")
        levels.append({lang: (part["gram"].to_numpy(np.int64), part["count"].to_numpy(np.float64)) for lang, part in of_n.groupby("lang")})
    tables = Tables(langs, [], [], [], [])
    for n in range(ORDER + 1):
        known = np.unique(np.concatenate([g for g, _ in levels[n].values()] or [np.zeros(0, np.int64)]))
        if len(known) * len(langs) > MOST_COSTS:
            raise ValueError(f"{len(known)} strings in {len(langs)} languages; take fewer rows or bytes of each language")
        contexts = np.unique(known >> 8) if n else np.zeros(1, np.int64)
        costs, leaves = np.zeros((len(known), len(langs))), np.zeros((len(contexts), len(langs)))
        lower = _at(tables, n - 1, known & ((1 << 8 * n) - 1)) if n else np.full((len(known), len(langs)), 8.0)
        for k, lang in enumerate(langs):
            gram, count = levels[n].get(lang, (np.zeros(0, np.int64), np.zeros(0)))
            of_context = np.searchsorted(contexts, gram >> 8 if n else gram * 0)
            total = np.bincount(of_context, count, len(contexts))
            distinct = np.bincount(of_context, minlength=len(contexts)).astype(float)
            with np.errstate(divide="ignore", invalid="ignore"):
                leaves[:, k] = np.where(distinct > 0, np.log2((total + distinct) / distinct), 0.0)
            costs[:, k] = leaves[np.searchsorted(contexts, known >> 8 if n else known * 0), k] + lower[:, k]
            costs[np.searchsorted(known, gram), k] = np.log2((total + distinct)[of_context] / count)
        tables.seen.append(known)
        tables.cost.append(costs)
        tables.contexts.append(contexts)
        tables.leave.append(leaves)
    return tables


def _at(tables: Tables, n: int, gram: np.ndarray) -> np.ndarray:
    """Bits of the last byte of each (n+1)-byte string, by orders n and below."""
    seen, cost = tables.seen, tables.cost
    out = np.zeros((len(gram), len(tables.langs)))
    rest = np.arange(len(gram))
    for m in range(n, -1, -1):
        part = gram[rest] & ((1 << 8 * (m + 1)) - 1)
        at = np.minimum(np.searchsorted(seen[m], part), max(len(seen[m]) - 1, 0))
        hit = seen[m][at] == part if len(seen[m]) else np.zeros(len(part), bool)
        out[rest[hit]] += cost[m][at[hit]]
        rest, part = rest[~hit], part[~hit]
        if len(rest):
            contexts = tables.contexts[m]
            if len(contexts):
                context = part >> 8
                at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
                out[rest] += np.where((contexts[at] == context)[:, None], tables.leave[m][at], 0.0)
    out[rest] += 8.0
    return out


def code_lengths(data: np.ndarray, offsets: np.ndarray, tables: Tables) -> np.ndarray:
    """Bits of each text, a column for each language. The first bytes of a text have shorter contexts."""
    lengths, starts = np.diff(offsets), offsets[:-1]
    bits = np.zeros((len(lengths), len(tables.langs)))
    if not len(data):
        return bits
    value = np.zeros(len(data), np.int64)
    for n in range(ORDER + 1):
        value[n:] |= data[: len(data) - n].astype(np.int64) << 8 * n
    row = np.repeat(np.arange(len(lengths)), lengths)
    # Each different string of the batch is looked up once.
    inside = np.arange(len(data)) - starts[row]
    for n in range(ORDER):
        first = inside == n
        if first.any():
            np.add.at(bits, row[first], _at(tables, n, value[first] & ((1 << 8 * (n + 1)) - 1)))
    full = inside >= ORDER
    gram, back = np.unique(value[full], return_inverse=True)
    costs = _at(tables, ORDER, gram)
    which = row[full]
    for k in range(len(tables.langs)):
        bits[:, k] += np.bincount(which, costs[back, k], len(lengths))
    return bits


def _judged(texts: pa.Array, tables: Tables) -> tuple[list[str], list[float], list[float | None]]:
    """Language, score and bits per byte of each text."""
    data, offsets = text_bytes(texts)
    bits = code_lengths(data, offsets, tables)
    names, scores, rates = [], [], []
    for k, text in enumerate(texts):
        text = text.as_py()
        if not tables.langs or not text or not any(map(str.isalpha, text)):
            names.append("und"), scores.append(0.0), rates.append(None)
            continue
        best = int(bits[k].argmin())
        names.append(tables.langs[best])
        scores.append(float(1 / np.exp2(np.maximum(bits[k, best] - bits[k], -1000)).sum()))
        rates.append(float(bits[k, best] / (offsets[k + 1] - offsets[k])))
    return names, scores, rates


def classify(docs: DataFrame, tables: Tables, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, bits_per_byte of every row."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(tables)  # a bounded sample's statistics

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", AT_ONCE):
            names, scores, rates = _judged(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())], names=[id_col, "lang_pred", "score", "bits_per_byte"])

    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, bits_per_byte double")


def with_language(docs: DataFrame, tables: Tables, text_col: str = "text") -> DataFrame:
    """The rows of docs, unchanged, whose text is of a learned language (not `und`)."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(tables)  # a bounded sample's statistics

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, at, AT_ONCE):
            names, _, _ = _judged(batch.column(at), shared.value)
            yield batch.filter(pa.array([name != "und" for name in names]))

    # Columns go by number, as mapInArrow takes a dot in a name for a field.
    names = [f"c{k}" for k in range(len(docs.columns))]
    found = docs.toDF(*names)
    return found.mapInArrow(run, found.schema).toDF(*docs.columns)
