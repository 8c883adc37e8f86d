"""Removal of repeated byte strings by a distributed suffix array of difference-cover type.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a document of smaller id, or earlier in
the same document. Texts are UTF-8 (null: empty), matches never cross documents, and strings are judged on the input.

Suffixes are sorted only as far as LENGTH bytes, and only where a repeat is possible:

1. Every window of LENGTH bytes has an anchor, the place of its least hashed KGRAM bytes. Equal windows have equal
   anchors at equal offsets, so an anchor that occurs once rules out its windows. Consecutive windows with one anchor are
   a context: the bytes they span.
2. Equal contexts are merged, in each task before anything is shuffled and then over all: only the earliest stays, the
   others are removed whole.
3. The different contexts that share an anchor are dealt out by it, and each task sorts their suffixes: the triples at
   places 1 and 2 modulo 3 are sorted and named, the names sorted by recursion, the other suffixes merged in; neighbours
   that agree in LENGTH bytes are the same window, and all but its earliest are removed. An anchor with more than
   HOT contexts is dealt out by window instead, each window by its MD5.

A document is its id and text: rows that repeat both are one document, and removed alike; rows that share an id only are
ordered by a hash of their text. A null id comes first. Texts under LENGTH bytes are kept. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, give_back, kept, mix64, small_batches, text_bytes

LENGTH = 100
KGRAM = 32
#: Different contexts of one anchor that one task sorts; more are dealt out by window.
HOT = 20_000
#: Bytes of contexts that one task sorts, about.
SORTED_BYTES = 1 << 20
#: Windows of a long text that are looked at together, and bytes of text whose contexts a task merges at once.
CHUNK, MERGED_BYTES = 1 << 20, 24 << 20
_BASE = 0xD6E8FEB86659FD93
_PLACE = 34
_powers: list[np.ndarray] = []
CONTEXT = "anchor bigint, context bigint, doc_id bigint, text_hash bigint, start bigint, windows int, alone boolean, repeated boolean"
_SPAN = "doc_id bigint, text_hash bigint, start bigint, stop bigint"


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        _powers.clear()
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers


def contexts_of(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Contexts of the texts that data holds end to end: row, start (in its text), windows, anchor, context (a hash)."""
    n = len(data)
    if n < LENGTH:
        return {k: np.zeros(0, np.int64) for k in ("row", "start", "windows", "anchor", "context")}
    powers, inverse = _power_tables(max(n, CHUNK + LENGTH))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
    grams = mix64((sums[KGRAM:] - sums[: n + 1 - KGRAM]) * inverse[: n + 1 - KGRAM])
    least = (grams >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(grams), dtype=np.uint64)
    span, wide = 1, LENGTH - KGRAM + 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    anchor = (least & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    begins = np.flatnonzero(np.arange(len(anchor)) + LENGTH <= offsets[row[: len(anchor)] + 1])
    if not len(begins):
        return contexts_of(data[:0], offsets)
    at = anchor[begins]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (begins[1:] != begins[:-1] + 1)])
    first = np.flatnonzero(new)
    start, windows, at = begins[first], np.diff(np.append(first, len(begins))), at[first]
    stop = start + windows + LENGTH - 1
    content = mix64((sums[stop] - sums[start]) * inverse[start]) ^ mix64(((at - start) << 32 | windows).astype(np.uint64))
    return {"row": row[start], "start": start - offsets[row[start]], "windows": windows, "anchor": grams[at].astype(np.int64), "context": content.astype(np.int64)}


def _contexts(rows: DataFrame) -> DataFrame:
    """Contexts after merging in each task. alone: the task has no other context with the anchor; of the others, the first
    is marked repeated = false once for each anchor. A context that equals an earlier one is a span: windows = -bytes."""

    def merged(found: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        f = {k: np.concatenate([x[k] for x in found]) for k in found[0]}
        order = np.lexsort((f["start"], f["text_hash"], f["doc_id"], f["context"], f["anchor"]))
        f = {k: v[order] for k, v in f.items()}
        same = lambda *keys: np.concatenate([[False], np.all([f[k][1:] == f[k][:-1] for k in keys], axis=0)])
        copy = same("anchor", "context")
        head = np.maximum.accumulate(np.where(copy, 0, np.arange(len(copy))))
        itself = np.all([f[k] == f[k][head] for k in ("doc_id", "text_hash", "start")], axis=0)
        gone = copy & ~itself
        f = {k: v[~copy | gone] for k, v in f.items()} | {"gone": gone[~copy | gone]}
        later = f["gone"]
        # Among the contexts that stay, those of an anchor stand together.
        staying = np.flatnonzero(~later)
        anchors = f["anchor"][staying]
        new = np.concatenate([[True], anchors[1:] != anchors[:-1]])
        group = np.cumsum(new) - 1
        f["alone"], f["repeated"] = np.zeros(len(later), bool), np.ones(len(later), bool)
        # A copy within the task makes its anchor repeated as well.
        copies = np.isin(anchors, np.unique(f["anchor"][later])) if later.any() else np.zeros(len(anchors), bool)
        f["alone"][staying] = (np.bincount(group)[group] == 1) & ~copies
        f["repeated"][staying] = ~new
        f["windows"] = np.where(later, -(f["windows"] + LENGTH - 1), f["windows"]).astype(np.int32)
        names = [x.split()[0] for x in CONTEXT.split(", ")]
        for k in range(0, len(later), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(f[n][k : k + 200_000]) for n in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in small_batches(batches, "text", CHUNK):
            data, offsets = text_bytes(batch.column("text"))
            ids, hashes = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in (0, 1))
            for base in range(0, max(len(data), 1), CHUNK) if batch.num_rows == 1 else (0,):
                stop = min(len(data), base + CHUNK + LENGTH - 1) if batch.num_rows == 1 else len(data)
                part = contexts_of(data[base:stop], offsets if batch.num_rows > 1 else np.array([0, stop - base]))
                if len(part["row"]):
                    row = part.pop("row")
                    found.append(part | {"start": part["start"] + base, "doc_id": ids[row], "text_hash": hashes[row]})
            size += len(data)
            if size >= MERGED_BYTES and found:
                yield from merged(found)
                found, size = [], 0
        if found:
            yield from merged(found)

    return rows.mapInArrow(run, CONTEXT)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of a sequence of numbers over 0 in order, by the difference cover {1, 2} modulo 3."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    s = np.concatenate([text.astype(np.int64), np.zeros(3, np.int64)])
    base = int(s.max()) + 1
    ones, twos = np.arange(1, n + 1, 3), np.arange(2, n + 1, 3)  # with n itself, where it keeps the two halves apart
    sampled = np.concatenate([ones, twos])
    if base < 1 << 20:
        triple = (s[sampled] * base + s[sampled + 1]) * base + s[np.minimum(sampled + 2, n + 2)]
        _, names = np.unique(triple, return_inverse=True)
    else:
        columns = [s[np.minimum(sampled + k, n + 2)] for k in (2, 1, 0)]
        order = np.lexsort(columns)
        differ = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
        names = np.empty(len(sampled), np.int64)
        names[order] = np.concatenate([[0], np.cumsum(differ)])
    if names.max() + 1 < len(sampled):
        # The end of the first half must be below all: a text end there is n or beyond, whose triple is the least.
        order = suffix_array(np.concatenate([names[: len(ones)] + 2, [1], names[len(ones) :] + 2]))
        order = order[order != len(ones)]
        order = order - (order > len(ones))
    else:
        order = np.argsort(names)
    rank = np.zeros(n + 4, np.int64)
    in_order = sampled[order]
    rank[in_order] = np.arange(1, len(order) + 1)
    in_order = in_order[in_order < n]
    zeros = np.arange(0, n, 3)
    wide = len(sampled) + 2
    zero_key = s[zeros] * wide + rank[zeros + 1]
    by_key = np.argsort(zero_key, kind="stable")
    zeros, zero_key = zeros[by_key], zero_key[by_key]
    one, two = in_order[in_order % 3 == 1], in_order[in_order % 3 == 2]
    below = np.searchsorted(s[one] * wide + rank[one + 1], zero_key)
    two_rank = _pair_rank(s, rank, two, zeros, wide)
    place = np.arange(len(zeros)) + below + two_rank
    out = np.empty(n, np.int64)
    rest = np.ones(n, bool)
    rest[place] = False
    out[place] = zeros
    out[np.flatnonzero(rest)] = in_order
    return out


def _pair_rank(s: np.ndarray, rank: np.ndarray, two: np.ndarray, zeros: np.ndarray, wide: int) -> np.ndarray:
    """How many suffixes at 2 modulo 3 are below each at 0, by two numbers and the rank of what follows."""
    both = np.concatenate([two, zeros])
    if int(s.max() + 1) ** 2 * wide < 1 << 62:
        key = (s[both] * (int(s.max()) + 1) + s[both + 1]) * wide + rank[both + 2]
    else:
        _, pair = np.unique(s[both] * (int(s.max()) + 1) + s[both + 1], return_inverse=True)
        key = pair * wide + rank[both + 2]
    return np.searchsorted(key[: len(two)], key[len(two) :])


def later_windows(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of pieces in order of precedence: (piece, offset) of every LENGTH bytes that also stand in an earlier piece or place."""
    sizes = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    row = np.repeat(np.arange(len(pieces)), sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    order = suffix_array(data.astype(np.int64) + 1)
    order = order[order + LENGTH <= (starts + sizes)[row[order]]]  # those that LENGTH bytes of their piece follow
    if not len(order):
        return order, order
    windows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    equal = np.zeros(len(order), bool)
    for k in range(1, len(order), 100_000):
        part = order[k - 1 : k + 100_000]
        equal[k : k + 100_000] = (windows[part[1:]] == windows[part[:-1]]).all(axis=1)
    group = np.cumsum(~equal)
    first = np.full(group[-1] + 1, len(data), np.int64)
    np.minimum.at(first, group, order)
    later = order[order > first[group]]
    return row[later], later - starts[row[later]]


def _runs(row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of covered bytes of windows: row, start, stop."""
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] > at[:-1] + LENGTH)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return row[first], at[first], at[last] + LENGTH


def _sorted_spans(pieces: DataFrame, buckets: int) -> DataFrame:
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "text_hash", "start"], kind="stable", na_position="first").reset_index(drop=True)
        row, at = later_windows(part["piece"].tolist())
        give_back()
        if not len(row):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("doc_id", "text_hash", "start", "stop")})
        row, start, stop = _runs(row, at)
        begin = part["start"].to_numpy()[row]
        return pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[row], "text_hash": part["text_hash"].to_numpy()[row], "start": begin + start, "stop": begin + stop})

    return pieces.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(buckets)).alias("bucket")).applyInPandas(run, _SPAN)


def _window_spans(pieces: DataFrame) -> DataFrame:
    """The same for anchors with very many contexts: each window goes by its digest, and equal ones meet pre-aggregated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                piece = row["piece"]
                digests = [hashlib.md5(piece[k : k + LENGTH]).digest() for k in range(len(piece) - LENGTH + 1)]
                n = len(digests)
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([row["doc_id"]] * n, pa.int64()), pa.array([row["text_hash"]] * n, pa.int64()), pa.array(range(row["start"], row["start"] + n), pa.int64())], names=["digest", "doc_id", "text_hash", "start"])

    windows = kept(pieces.select("doc_id", "text_hash", "start", "piece").mapInArrow(run, "digest binary, doc_id bigint, text_hash bigint, start bigint"), "hot-windows")
    where = F.struct("doc_id", "text_hash", "start")
    first = kept(windows.groupBy("digest").agg(F.min(where).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"), "hot-first")
    return windows.join(first, "digest").where(where > F.col("first")).select("doc_id", "text_hash", "start", (F.col("start") + LENGTH).alias("stop"))


def _identified(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def removed_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, spans (array of start, stop; may overlap) of the documents that lose bytes. Null ids are -2**63."""
    rows = _identified(docs)
    found = _contexts(rows)
    # One row for each anchor and task decides whether the anchor occurs elsewhere.
    seen = found.where("windows > 0 and (alone or not repeated)").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("anchor")))
    columns = ["anchor", "context", "doc_id", "text_hash", "start", "windows"]
    elsewhere = seen.where("n > 1 or not alone").select(*columns)
    in_task = found.where("windows < 0 or (not alone and repeated)").select(*columns)
    repeated = all_contexts = kept(elsewhere.unionByName(in_task), "contexts")
    spans = repeated.where("windows < 0").select("doc_id", "text_hash", "start", (F.col("start") - F.col("windows")).alias("stop"))
    repeated = repeated.where("windows > 0")
    where = F.struct("doc_id", "text_hash", "start", "windows")
    first = kept(repeated.groupBy("anchor", "context").agg(F.min(where).alias("first"), F.count(F.lit(1)).alias("n")), "first-contexts")
    again = repeated.join(first.where("n > 1").select("anchor", "context", F.col("first").alias("f")), ["anchor", "context"])
    again = again.where(where > F.col("f")).select("doc_id", "text_hash", "start", (F.col("start") + F.col("windows") + LENGTH - 1).alias("stop"))
    several = kept(first.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1"), "several")
    different = first.select("anchor", "first.*").join(several, "anchor")
    of_doc = different.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("anchor", "contexts", "start", "windows")).alias("pieces"))
    wanted = kept(of_doc, "wanted")
    pieces = rows.join(wanted, ["doc_id", "text_hash"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            out = []
            for row in batch.to_pylist():
                data = row["text"].encode("utf-8", "surrogatepass")
                out += [(p["anchor"], p["contexts"], row["doc_id"], row["text_hash"], p["start"], data[p["start"] : p["start"] + p["windows"] + LENGTH - 1]) for p in row["pieces"]]
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["anchor", "contexts", "doc_id", "text_hash", "start", "piece"])

    pieces = kept(pieces.mapInArrow(cut, "anchor bigint, contexts bigint, doc_id bigint, text_hash bigint, start bigint, piece binary"), "pieces")
    size = pieces.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    few = _sorted_spans(pieces.where(F.col("contexts") <= HOT), -(-size // SORTED_BYTES) or 1)
    spans = spans.unionByName(again).unionByName(few).unionByName(_window_spans(pieces.where(F.col("contexts") > HOT)))
    found = kept(spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "spans")
    forget(all_contexts, first, several, wanted, pieces)
    return found


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(stop, out[-1][1])
        else:
            out.append((start, stop))
    return out


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, stop in bytes) and kept, the bytes that stay."""
    rows = _identified(docs).join(removed_spans(docs), ["doc_id", "text_hash"], "left")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start: bigint, stop: bigint>>, kept binary, text_hash bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            out = []
            for doc_id, text_hash, text, spans in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text", "spans")], strict=True):
                data, runs = text.encode("utf-8", "surrogatepass"), _merged(spans)
                edges = [0, *[x for run in runs for x in run], len(data)]
                left = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((None if doc_id == -(1 << 63) else doc_id, len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest(), [{"start": a, "stop": b} for a, b in runs], left, text_hash))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept", "text_hash"])

    return rows.mapInArrow(run, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs with what stays of their text, and n_chars set to it.

    A character that lost some of its bytes goes whole. Rows whose text loses everything go; rows that lose nothing are
    unchanged.
    """
    spans = removed_spans(docs)
    names = {c.lower() for c in docs.columns}
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, _identified_id().alias("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"), "text").join(spans, ["doc_id", "text_hash"], "left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, spans, strict=True):
            if found is None or text is None:
                out.append(text)
                continue
            data, runs = text.encode("utf-8", "surrogatepass"), _merged(list(found))
            edges = [0, *[x for run in runs for x in run], len(data)]
            out.append("".join(data[a:b].decode("utf-8", "ignore") for a, b in zip(edges[::2], edges[1::2], strict=True)))
        return pd.Series(out, dtype=object)

    # Else Spark cuts in the filter and again in the projection, with two Python workers for each task.
    once = cut.asNondeterministic()
    cut_rows = keyed.withColumn("left", once("text", "spans")).where("spans is null or length(left) > 0")
    columns = [F.col(f"row.`{c}`") for c in docs.columns]
    for k, c in enumerate(docs.columns):
        if c.lower() == "text":
            columns[k] = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(F.col("left")).alias(c)
        elif c.lower() == "n_chars" and "text" in names:
            columns[k] = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.length("left").cast("bigint")).alias(c)
    return cut_rows.select(*columns)


def _identified_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
