"""Phrases whose words keep company, mined from windows of the longest kind only.

Each word leads one window of three words, padded with null where its piece of text ends. The windows are counted, and
Spark's ROLLUP sums them to their shorter prefixes: (lang, a, b, c), (lang, a, b), (lang, a), (lang). So one count of one
kind of window gives the phrases of every length, and the number of words.

Few windows can belong to a phrase that occurs often enough. A pass before counts pairs of neighbours by 64-bit hash, and
a window is padded from its first pair on whose hash occurs too seldom. Hashes that meet and bits that are set twice only
let more windows pass: the filter of at most FILTER_BITS bits loses no phrase at any size, it only saves less when full.

Null text counts as empty, null language as `und`; a null id doesn't matter, no other column is read, so further columns
may have any name. Repeated rows count each time. Texts over CHUNK bytes are cut between pieces; one piece of text is held
whole. Ties of scores go by frequency, then by phrase in order of UTF-8 bytes. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, forget, give_back, kept, mapped_file, mix64, new_folder, put_file

LEAST, WITHIN_PCT, BEST = 10, 50, 2000
CHUNK = 3 << 20
#: Bits a frequent pair, and the most bits a filter has (64 MB); a file of a filter holds FILE_BITS.
PAIR_BITS, FILTER_BITS, FILE_BITS = 8, 1 << 29, 1 << 23
#: The best of a language are found among those of each of so many parts.
PARTS = 256

SEPARATOR = re.compile(rb"[.,;:!?\n-\r]")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: 0: part of a word, 1: blank, 2: end of a piece.
KIND = np.zeros(256, np.uint8)
KIND[[9, 32]] = 1
KIND[list(b".,;:!?\n\v\f\r")] = 2


def chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[bytes, list[int], list[str]]]:
    """Texts in lower case joined by line ends, about limit bytes at once; where each begins; their languages."""
    parts, starts, langs, size = [], [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data, at = (text or "").encode().translate(LOWER), 0
            while at < len(data):
                end = at + limit
                if end < len(data):
                    found = SEPARATOR.search(data, end)
                    end = found.end() if found else len(data)
                parts.append(data[at:end])
                starts.append(size)
                langs.append(lang)
                size += len(parts[-1]) + 1
                at = end
                if size >= limit:
                    yield b"\n".join(parts), starts, langs
                    parts, starts, langs, size = [], [], [], 0
    if parts:
        yield b"\n".join(parts), starts, langs
    give_back()


def words_of(joined: bytes, starts: list[int], langs: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray, list[str], np.ndarray]:
    """The distinct words, the word at each place, its language's number, the languages, and the places whose next word is in the same piece."""
    data = np.frombuffer(joined, np.uint8)
    kind = KIND[data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = kind == 0
    edges = np.flatnonzero(np.diff(inside))
    begin, end = edges[::2], edges[1::2]
    offsets = np.zeros(len(begin) + 1, np.int32)
    np.cumsum(end - begin, out=offsets[1:])
    words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(data[kind == 0].tobytes())).dictionary_encode()
    piece = np.cumsum(kind == 2, dtype=np.int32)[begin]
    names = sorted(set(langs))
    number = {name: k for k, name in enumerate(names)}
    lang = np.array([number[x] for x in langs], np.int64)[np.searchsorted(starts, begin, "right") - 1]
    return words.dictionary, words.indices.to_numpy().astype(np.int64), lang, names, piece[:-1] == piece[1:]


def pair_hashes(words: pa.Array, ids: np.ndarray, lang: np.ndarray, names: list[str]) -> np.ndarray:
    """A hash of language, word and next word for each place but the last."""
    of_word = np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words))
    of_lang = np.array([xxhash.xxh3_64_intdigest(x) for x in names], np.uint64)
    return mix64(mix64(of_lang[lang[:-1]] ^ of_word[ids[:-1]]) + of_word[ids[1:]])


def pair_counts(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(batches, limit):
        words, ids, lang, names, goes_on = words_of(*chunk)
        if goes_on.any():
            found, n = np.unique(pair_hashes(words, ids, lang, names)[goes_on], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["pair", "n"])


def write_filter(pairs: DataFrame, bits: int, folder: str) -> tuple[int, ...]:
    """Files of FILE_BITS bits, one bit set for each pair; the numbers of the files."""
    size = min(bits, FILE_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[int, np.ndarray] = {}
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            for k in np.unique(slot // size):
                files.setdefault(int(k), np.zeros(size, bool))[slot[slot // size == k] % size] = True
        for k, set_bits in files.items():
            put_file(f"{folder}/{k}", lambda out, x=set_bits: out.write(np.packbits(x, bitorder="little").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(list(files), pa.int64())], names=["file"])

    slots = pairs.select(F.col("pair").bitwiseAND(bits - 1).alias("slot")).distinct()
    return tuple(sorted(r["file"] for r in slots.repartition(min(bits // size, 64), F.floor(F.col("slot") / size)).mapInArrow(run, "file bigint").collect()))


@functools.lru_cache(1)
def load_filter(folder: str, bits: int, files: tuple[int, ...]) -> np.ndarray:
    found, size = np.zeros(bits // 8, np.uint8), min(bits, FILE_BITS) // 8
    for k in files:
        found[k * size : (k + 1) * size] = mapped_file(f"{folder}/{k}")
    return found


def frequent(pairs: np.ndarray, found: np.ndarray) -> np.ndarray:
    slot = pairs & np.uint64(len(found) * 8 - 1)
    return (found[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def counted_windows(chunk: tuple, found: np.ndarray) -> pa.RecordBatch:
    """The different windows of a chunk and their numbers: lang, a, b, c, n."""
    words, ids, lang, names, goes_on = words_of(*chunk)
    pair = np.zeros(len(ids) + 1, bool)
    if len(ids) > 1:
        pair[: len(ids) - 1] = goes_on & frequent(pair_hashes(words, ids, lang, names), found)
    after = np.concatenate([ids + 1, [0, 0]])
    two, three = pair[:-1], pair[:-1] & pair[1:]
    second, third = np.where(two, after[1:-1], 0), np.where(three, after[2:], 0)
    v = len(words) + 1
    of_two, place = np.unique((lang * v + ids) * v + second, return_inverse=True)
    keys, n = np.unique(place * v + third, return_counts=True)
    head, c = of_two[keys // v], keys % v
    first, b = head // v, head % v
    taken = lambda x: words.take(pa.array(x - 1, mask=x == 0))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(first // v)), words.take(pa.array(first % v)), taken(b), taken(c), pa.array(n)], names=["lang", "a", "b", "c", "n"])


def windows(docs: DataFrame, least: int, text_col: str = "text", lang_col: str = "lang", chunk_bytes: int = CHUNK) -> DataFrame:
    """Padded windows of three words with their numbers, those of a batch summed: lang, a, b, c, n."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    pairs = kept(texts.mapInArrow(lambda batches: pair_counts(batches, chunk_bytes), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("pair"), "frequent-pairs")
    bits = min(max(pairs.count() * PAIR_BITS, 1 << 16), FILTER_BITS)
    bits = 1 << (bits - 1).bit_length()
    folder = new_folder(docs.sparkSession, "pair-filter")
    files = write_filter(pairs, bits, folder)
    forget(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, chunk_bytes):
            yield counted_windows(chunk, load_filter(folder, bits, files))

    return texts.mapInArrow(run, "lang string, a string, b string, c string, n bigint")


def frequencies(counted: DataFrame, least: int) -> DataFrame:
    """What occurs at least so often: lang, a, b, c, f, with null for words that a shorter phrase lacks, and (lang) with the number of all words."""
    rolled = counted.rollup("lang", "a", "b", "c").agg(F.sum("n").alias("f"), F.grouping_id().alias("rolled"))
    whole = F.expr("rolled = 0 and c is not null or rolled = 1 and b is not null or rolled = 3")
    return rolled.where(F.col("rolled").eqNullSafe(7) | (F.col("f") >= least) & whole).drop("rolled")


def ratio(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)) in decimals of 38 digits."""
    return F.expr(f"(1000000BD * cast({a} as decimal(15)) * cast({a} as decimal(15))) div (cast({left} as decimal(15)) * cast({right} as decimal(15)))")


def phrases(docs: DataFrame, least: int = LEAST, within_pct: int = WITHIN_PCT, text_col: str = "text", lang_col: str = "lang", chunk_bytes: int = CHUNK) -> DataFrame:
    """Phrases of two and three words that occur at least so often and aren't mostly part of a longer one: lang, phrase, a, l, r, n, score."""
    found = kept(frequencies(windows(docs, least, text_col, lang_col, chunk_bytes), least), "phrase-counts")
    total = found.where("a is null").select("lang", F.col("f").alias("n"))
    one = found.where("a is not null and b is null").select("lang", "a", "f")
    two = found.where("b is not null and c is null").select("lang", "a", "b", "f")
    three = found.where("c is not null").select("lang", "a", "b", "c", "f")
    longer = three.select("lang", "f", F.inline(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("c").alias("b"))))).groupBy("lang", "a", "b").agg(F.max("f").alias("longest"))
    left = one.select("lang", "a", F.col("f").alias("l"))
    right = one.select("lang", F.col("a").alias("b"), F.col("f").alias("r"))
    pairs = two.join(longer, ["lang", "a", "b"], "left").where(F.expr(f"longest is null or cast(longest as decimal(19)) * 100 < cast(f as decimal(19)) * {within_pct}"))
    pairs = pairs.join(left, ["lang", "a"]).join(right, ["lang", "b"]).select("lang", F.concat_ws(" ", "a", "b").alias("phrase"), F.col("f").alias("a"), "l", "r")
    triples = three.join(left.withColumnRenamed("l", "l1"), ["lang", "a"]).join(two.toDF("lang", "b", "c", "r1"), ["lang", "b", "c"])
    triples = triples.join(two.toDF("lang", "a", "b", "l2"), ["lang", "a", "b"]).join(right.toDF("lang", "c", "r2"), ["lang", "c"])
    second = ratio("f", "l2", "r2") < ratio("f", "l1", "r1")
    triples = triples.select("lang", F.concat_ws(" ", "a", "b", "c").alias("phrase"), F.col("f").alias("a"), F.when(second, F.col("l2")).otherwise(F.col("l1")).alias("l"), F.when(second, F.col("r2")).otherwise(F.col("r1")).alias("r"))
    scored = pairs.unionByName(triples).withColumn("score", ratio("a", "l", "r"))
    return scored.join(total, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def best(scored: DataFrame, most: int = BEST) -> DataFrame:
    """The first of each language, by score, frequency and phrase: with rank, from 1. They are chosen in PARTS first, so no task sorts all phrases of a language."""
    ahead = "order by score desc, a desc, phrase"
    some = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", F.expr(f"row_number() over (partition by lang, part {ahead})")).where(F.col("rank") <= most)
    return some.withColumn("rank", F.expr(f"row_number() over (partition by lang {ahead})").cast("long")).where(F.col("rank") <= most).drop("part")
