"""Near duplicates by order MinHash, verified by banded alignment.

A document is its sequence of words (A-Z lower-cased). Its k-mers of K words are labelled with their occurrence number,
so that repeats differ. Each of SKETCHES hash functions picks the PICKED labelled k-mers with the smallest hashes and keeps
them in text order; documents that agree in one such tuple are candidates. Order makes the tuple sensitive to edit
similarity, which a banded bit-parallel alignment of the words then decides: 1 - distance / longer length >= SIMILARITY.
K-mers are short and tuples small and many, so that a pair at SIMILARITY is a candidate with a chance of over 0.95; in
documents of fewer than SHORT words the tuples are of PICKED_SHORT single words, as few k-mers outlast an edit there.

Documents with the same words are one node from the start. The nodes that share a tuple are a group; each is compared to
one of them, the group's leader, unless the group is in one class already. Similar nodes are joined into classes by alternating
star contraction. In groups that did not become one class, such as those that a common passage makes, members of different
classes are then compared until they are in one class: lengths and counts of words by bucket rule out what can't be
similar, the rest is aligned. So each two nodes that share a tuple end in one class or were found not to be similar.

Texts that are null or without words are in a class of their own each. Rows that share an id but not their words are in the
classes of their words; where the id is the smallest of both, these are one class. A document with a null id is in the
class of those with the same words, if there are any, else in class null. Ties go to smaller ids. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, forget, kept, mix64, small_batches, tidied

K = 3
SKETCHES = 48
PICKED = 2
#: Documents of fewer words have tuples of single words; from SHORT * SIMILARITY words on there are tuples of k-mers.
SHORT = 40
PICKED_SHORT = 4
SIMILARITY = 0.8
#: Documents of candidate pairs whose ids are broadcast to find their texts; more are joined by shuffle.
BROADCAST_IDS = 500_000
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SEEDS = mix64(np.arange(101, 101 + SKETCHES, dtype=np.uint64)) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_TAKEN = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Hash values of a document that are held at the same time.
HELD_VALUES = 1 << 17
#: Buckets of words whose counts bound the distance of two documents from below.
BUCKETS = 256
#: Members of a group that one task compares with each other, and their words; larger groups are dealt out.
UNIT, UNIT_WORDS = 4096, 1 << 22


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def word_hashes(text: str | None, hashes: _Hashes) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def sketches(words: np.ndarray) -> list[int]:
    """The tuples of a document: those of single words if it is short, of k-mers if it isn't, of both about the bound."""
    found = []
    if len(words) < SHORT:
        found += _tuples(words, 1, PICKED_SHORT)
    if len(words) >= SHORT * SIMILARITY:
        found += _tuples(words, K, PICKED)
    return found


def _tuples(words: np.ndarray, k: int, picked: int) -> list[int]:
    """A key for each hash function: its smallest labelled k-mers, in text order."""
    n = len(words) - k + 1
    kmers = np.zeros(n, np.uint64)
    for j in range(k):
        kmers = kmers * _STEP + words[j : n + j]
    order = np.argsort(kmers, kind="stable")
    ordered = kmers[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    place = np.arange(n)
    label = np.empty(n, np.uint64)
    label[order] = (place - np.maximum.accumulate(np.where(first, place, 0))).astype(np.uint64)
    labelled = mix64(mix64(kmers) + label * _STEP)
    picked = min(picked, n)
    least = np.empty((picked, SKETCHES), np.int64)
    at_once = max(1, HELD_VALUES // n)
    for start in range(0, SKETCHES, at_once):
        values = labelled[None, :] * _SEEDS[start : start + at_once, None]
        each = np.arange(len(values))
        for i in range(picked):
            found = values.argmin(axis=1)
            least[i, start : start + at_once] = found
            values[each, found] = _TAKEN
    least.sort(axis=0)
    keys = mix64(np.arange(1, SKETCHES + 1, dtype=np.uint64) + np.uint64(1000 * k))
    for i in range(picked):
        keys = mix64(keys * _STEP + labelled[least[i]])
    return keys.view(np.int64).tolist()


def within(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether the edit distance of two word sequences is at most most, by a band of bits around the diagonal.

    Each step takes in a word of b; the band is the 2 * most + 1 words of a about its diagonal, one bit each.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return False
    same = min(len(a), len(b))
    start = int(np.argmin(np.append(a[:same] == b[:same], False)))
    a, b = a[start:], b[start:]
    same = min(len(a), len(b))
    stop = int(np.argmin(np.append(a[len(a) - same :][::-1] == b[len(b) - same :][::-1], False)))
    a, b = a[: len(a) - stop], b[: len(b) - stop]
    if not len(a):
        return len(b) <= most
    # Words in common, in any order, bound the distance from below.
    of_a, times_a = np.unique(a, return_counts=True)
    of_b, times_b = np.unique(b, return_counts=True)
    _, at_a, at_b = np.intersect1d(of_a, of_b, assume_unique=True, return_indices=True)
    if len(b) - int(np.minimum(times_a[at_a], times_b[at_b]).sum()) > most:
        return False
    if most >= len(a):
        return _distance(a.tolist(), b.tolist()) <= most
    band = most if most <= 64 else 16
    while _distance_in_band(a.tolist(), b.tolist(), band) > band:  # most pairs need a narrow band only
        if band == most:
            return False
        band = min(4 * band, most)
    return True


def _distance(a: list[int], b: list[int]) -> int:
    """The edit distance by bit vectors as long as a, for an a that is shorter than the band."""
    places: dict[int, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    full, last, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    for word in b:
        match = places.get(word, 0)
        flat = (((match & up) + up) ^ up) | match | down
        right, left = (down | ~(flat | up)) & full, flat & up & full
        score += bool(right & last) - bool(left & last)
        right, left = right << 1 | 1, left << 1
        up, down = (left | ~(flat | right)) & full, flat & right & full
    return score


class _Window:
    """Where each word of a stands within a window that moves on one word at a time, as bits."""

    def __init__(self, a: list[int], width: int):
        self.width, self.places = width, {}
        for i, word in enumerate(a):
            self.places.setdefault(word, []).append(i)
        self.held: dict[int, tuple[int, int, int]] = {}

    def bits(self, word: int, start: int) -> int:
        places = self.places.get(word)
        if places is None:
            return 0
        if len(places) == 1:
            at = places[0] - start
            return 1 << at if 0 <= at < self.width else 0
        mask, was, ahead = self.held.get(word, (0, start, 0))
        mask >>= start - was
        while ahead < len(places) and places[ahead] < start + self.width:
            if places[ahead] >= start:
                mask |= 1 << (places[ahead] - start)
            ahead += 1
        self.held[word] = mask, start, ahead
        return mask


def _distance_in_band(a: list[int], b: list[int], band: int) -> int:
    """The edit distance if it is at most band, else a number above band. a is the shorter and longer than band.

    The vertical differences of the rows about the diagonal are bits of a window that moves down a row with each column.
    The score is followed down the window's lowest diagonal to the last row, then along that row.
    """
    width = 2 * band + 2
    full, corner = (1 << width) - 1, 1 << (width - 1)
    window = _Window(a, width)
    up, down, score = full & ~((1 << (band + 1)) - 1), 0, band
    row = corner >> 1
    for j, word in enumerate(b):
        match = window.bits(word, j - band - 1)
        flat = ((((match & up) + up) ^ up) | match | down) & full
        right, left = (down | ~(flat | up)) & full, flat & up
        if j < len(a) - band:
            score += not flat & corner
        else:
            score += bool(right & row) - bool(left & row)
            row >>= 1
        if score - (len(b) - j) > 2 * band:
            return band + 1
        flat >>= 1
        up, down = (left | ~(flat | right)) & full, flat & right
    return score


def _sketch_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, digest, n_words, keys of every row; digest is null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in small_batches(batches, "text"):
            ids, digests, sizes, keys = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = word_hashes(text.as_py(), hashes)
                ids.append(doc_id), sizes.append(len(words))
                digests.append(_digest(words))
                keys.append(sketches(words) if len(words) else [])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column(2), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "text_key", "digest", "n_words", "keys"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", _text_key(F.col("text")).alias("text_key"))
    return rows.mapInArrow(run, "doc_id bigint, text_key string, digest binary, n_words bigint, keys array<bigint>")


def _text_key(text: Column) -> Column:
    return F.coalesce(F.md5(text.cast("binary")), F.lit(""))


def _digest(words: np.ndarray) -> bytes | None:
    return hashlib.md5(words.tobytes()).digest() if len(words) else None


def _word_rows(docs: DataFrame) -> DataFrame:
    """node, digest, words of each document, as 8-byte hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in small_batches(batches, "text"):
            words = [word_hashes(t.as_py(), hashes) for t in batch.column(1)]
            columns = [batch.column(0), pa.array(map(_digest, words), pa.binary()), pa.array([w.tobytes() for w in words], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "digest", "words"])

    return docs.select(F.col("doc_id").cast("bigint").alias("node"), "text").mapInArrow(run, "node bigint, digest binary, words binary")


def _words_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, words of the nodes (node, digest)."""
    needed = kept(nodes, "needed")
    few = _if_few(needed)
    rows = _word_rows(docs.join(few(needed.select(F.col("node").alias("doc_id"))), "doc_id", "left_semi")).join(few(needed), ["node", "digest"])
    found = kept(rows.groupBy("node").agg(F.min("words").alias("words")), "words")  # all of a node are equal
    forget(needed)
    return found


def _if_few(rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """How to join numbers of nodes: broadcast if there are BROADCAST_IDS at most, else by shuffle. rows were kept."""
    return F.broadcast if rows.count() <= BROADCAST_IDS else lambda ids: ids


def _verified(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """node, leader, similar of each pair."""
    pairs = kept(pairs, "to-verify")
    few = _if_few(pairs)
    # Only words that are asked for are shuffled. By node last: the alignments of a leader's many followers then lie in many tasks.
    of_nodes = words.join(few(pairs.select("node").distinct()), "node", "left_semi")
    of_leaders = words.select(F.col("node").alias("leader"), F.col("words").alias("leader_words")).join(few(pairs), "leader")
    both = of_leaders.join(of_nodes, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                found.append(within(a, b, int((1 - similarity) * max(len(a), len(b)) + 1e-9)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.bool_())], names=["node", "leader", "similar"])

    found = kept(both.select("node", "leader", "words", "leader_words").mapInArrow(run, "node bigint, leader bigint, similar boolean"), "verified")
    forget(pairs)
    return found


def _rooted(rows: DataFrame, roots: DataFrame | None, of: str) -> DataFrame:
    """The rows with the class so far of the nodes in column `of`, as {of}_root."""
    if roots is None:
        return rows.withColumn(f"{of}_root", F.col(of))
    return rows.join(roots.select(F.col("node").alias(of), F.col("root").alias(f"{of}_root")), of, "left").withColumn(f"{of}_root", F.coalesce(f"{of}_root", of))


def _with_root(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The rows with the class so far of their node, as root."""
    if roots is None:
        return rows.withColumn("root", F.col("node"))
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _apart(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
    return _rooted(_rooted(pairs, roots, "node"), roots, "leader").where("node_root <> leader_root")


def _merged(roots: DataFrame | None, similar: DataFrame) -> DataFrame | None:
    """node, root of all nodes that are not the root of their class, after similar pairs joined classes."""
    edges = kept(_apart(similar, roots).select(F.greatest("node_root", "leader_root").alias("a"), F.least("node_root", "leader_root").alias("b")).distinct(), "joined")
    if edges.isEmpty():
        return roots
    step = components(edges)
    if roots is None:
        return step
    moved = roots.join(step.toDF("root", "new_root"), "root", "left").select("node", F.coalesce("new_root", "root").alias("root"))
    return kept(moved.unionByName(step), "roots")


class _Unit:
    """Members of one group that a task compares: shortest first, each with those before it that are in other classes."""

    def __init__(self, rows: pa.Table, similarity: float):
        order = np.lexsort((rows.column("node").to_numpy(), rows.column("n_words").to_numpy()))
        rows = rows.take(order)
        self.similarity, self.key = similarity, rows.column("key")[0].as_py()
        self.side, self.nodes, self.sizes = (rows.column(c).to_numpy() for c in ("side", "node", "n_words"))
        self.classes = np.array(rows.column("root").to_numpy())
        self.words = [np.frombuffer(w.as_buffer(), np.uint64) for w in rows.column("words")]
        self.keys = [frozenset(k) for k in rows.column("keys").to_pylist()]
        self.bags = np.zeros((len(order), BUCKETS), np.uint8)
        for bag, words in zip(self.bags, self.words, strict=True):
            bag[:] = np.minimum(np.bincount((words % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS), 255)
        self.totals = self.bags.sum(axis=1, dtype=np.int64)
        self.two = bool(self.side.any())

    def links(self) -> Iterator[tuple[int, int]]:
        """The pairs that were found similar and joined two classes, larger node first."""
        starts = np.searchsorted(self.sizes, self.sizes * self.similarity - 1e-9)  # shorter ones can't be similar
        for i in range(1, len(self.sizes)):
            for j in self._likely(int(starts[i]), i):
                if self.classes[i] == self.classes[j] or min(self.keys[i] & self.keys[j]) != self.key:
                    continue  # joined by now, or compared in another group that both are in
                if within(self.words[j], self.words[i], int((1 - self.similarity) * self.sizes[i] + 1e-9)):
                    a, b = sorted((self.classes[i], self.classes[j]))
                    self.classes[self.classes == b] = a
                    yield max(self.nodes[i], self.nodes[j]), min(self.nodes[i], self.nodes[j])

    def _likely(self, start: int, i: int) -> np.ndarray:
        """Members from start to before i that are in another class and share enough words, those that share most first."""
        apart = self.classes[start:i] != self.classes[i]
        if self.two:
            apart &= self.side[start:i] != self.side[i]
        j = np.flatnonzero(apart) + start
        shared = np.minimum(self.bags[j], self.bags[i]).sum(axis=1, dtype=np.int64)
        distance = np.maximum(self.totals[j], self.totals[i]) - shared
        close = distance <= (1 - self.similarity) * self.sizes[i] + 1e-9
        return j[close][np.argsort(-shared[close], kind="stable")]


def _linked_in_units(rows: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """node, leader of links that join classes within each unit. rows: unit, side, key, node, root, n_words, keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
            units = table.column("unit").to_numpy()
            cuts = [0, *(np.flatnonzero(units[1:] != units[:-1]) + 1).tolist(), len(units)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if links := list(_Unit(table.slice(a, b - a), similarity).links()):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["node", "leader"])

        for batch in batches:
            if not batch.num_rows:
                continue
            units = batch.column(0).to_numpy()
            last = int(np.searchsorted(units, units[-1]))  # sorted by unit; the last one may go on
            if last or (held and held[-1].column(0)[0].as_py() != units[0]):
                yield from found(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield from found(pa.Table.from_batches(held))

    rows = kept(rows, "unit-rows")
    asked = words.join(_if_few(rows)(rows.select("node").distinct()), "node", "left_semi")
    dealt = rows.join(asked, "node").select("unit", "side", "key", "node", "root", "n_words", "keys", "words")
    return dealt.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "node bigint, leader bigint").distinct()


def _units(members: DataFrame, similarity: float) -> DataFrame:
    """unit, side, key, node, root, n_words, keys: each two members of a group whose lengths allow similarity are in one unit at least.

    Groups of up to UNIT members and UNIT_WORDS words are one unit. Larger ones are dealt into cells by length and hash,
    and each two cells whose lengths are near enough are a unit, so that no task takes a whole large group. keys are the
    groups that a node is in, so that a pair that shares several is compared in one of them only.
    """
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum("n_words").alias("total"))
    of_node = Window.partitionBy("node")  # as many rows as a node has tuples, at most
    rows = members.select("key", "node", "root", "n_words", F.collect_list("key").over(of_node).alias("keys")).join(sizes, "key")
    fits = (F.col("members") <= UNIT) & (F.col("total") <= UNIT_WORDS)
    columns = ["unit", "side", "key", "node", "root", "n_words", "keys"]
    small = rows.where(fits).withColumns({"unit": F.col("key"), "side": F.lit(0)}).select(*columns)
    banded = rows.where(~fits).withColumn("band", F.floor(F.log("n_words") / math.log(1 / similarity) + 1e-9))
    many = F.greatest(F.count(F.lit(1)) * 2 / UNIT, F.sum("n_words") * 2 / UNIT_WORDS)
    counted = banded.groupBy("key", "band").agg(F.ceil(many).alias("cells"))
    cells = counted.select("key", "band", "cells", F.explode(F.sequence(F.lit(0), F.col("cells").cast("int") - 1)).alias("cell"))
    # A band reaches the next but one by rounding only; such pairs are then ruled out by their exact lengths.
    other = cells.select("key", F.col("band").alias("band_b"), F.col("cell").alias("cell_b"))
    near = cells.join(other, "key").where("band_b = band and cell_b >= cell or band_b > band and band_b <= band + 2")
    unit = F.xxhash64("key", "band", "cell", "band_b", "cell_b").alias("unit")
    same = (F.col("band") == F.col("band_b")) & (F.col("cell") == F.col("cell_b"))
    first = near.select("key", "band", "cell", unit, F.lit(0).alias("side"))
    second = near.where(~same).select("key", F.col("band_b").alias("band"), F.col("cell_b").alias("cell"), unit, F.lit(1).alias("side"))
    dealt = banded.join(counted, ["key", "band"]).withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int"))
    return small.unionByName(dealt.join(first.unionByName(second), ["key", "band", "cell"]).select(*columns))


def _open_groups(rooted: DataFrame) -> DataFrame:
    """The rows (key, root, ...) of those groups whose members are in more than one class."""
    spread = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("key")
    return rooted.join(spread, "key")


def _groups(nodes: DataFrame) -> DataFrame:
    """key, n, times, node, n_words, leader, leader_words: the members of each group of nodes that share a tuple.

    Tuples that the same nodes share are one group, times their number. A group's leader is the member with the most
    company over all its groups (ties: the smallest node): most groups of a cluster then have the same leader, which
    keeps the different pairs of a member and a leader few.
    """
    members = nodes.select("node", "n_words", F.explode(F.array_distinct("keys")).alias("key"))
    of_set = F.bit_xor(F.xxhash64("node")).alias("set_a"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("set_b")
    groups = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *of_set).where("n > 1")
    groups = groups.groupBy("set_a", "set_b", "n").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("times")).select("key", "n", "times")
    shared = kept(members.join(groups, "key"), "shared")
    # A node has SKETCHES tuples at most, or twice as many, so these windows are small.
    weighed = kept(shared.withColumn("company", F.sum(F.col("n") * F.col("times")).over(Window.partitionBy("node"))), "weighed")
    leaders = weighed.groupBy("key").agg(F.max(F.struct("company", (-F.col("node")).alias("minus"), "n_words")).alias("lead"))
    leaders = leaders.select("key", (-F.col("lead.minus")).alias("leader"), F.col("lead.n_words").alias("leader_words"))
    found = kept(weighed.drop("company").join(leaders, "key"), "groups")
    forget(shared, weighed)
    return found


def similar_nodes(docs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Verified links between nodes (node, digest, n_words, keys): node, leader; and node, root of the nodes that are not roots."""
    spark = docs.sparkSession
    none = spark.createDataFrame([], "node bigint, leader bigint"), spark.createDataFrame([], "node bigint, root bigint")
    followers = _groups(nodes)
    if followers.isEmpty():
        return none
    words = _words_of(nodes.join(followers.select("node").distinct(), "node", "left_semi").select("node", "digest"), docs)
    links = roots = None

    def compare(pairs: DataFrame) -> None:
        """Align pairs (node, leader) and join the classes of those that are similar."""
        nonlocal links, roots
        done = _verified(pairs, words, similarity)
        similar = done.where("similar").select("node", "leader")
        links = similar if links is None else links.unionByName(similar)
        roots = _merged(roots, similar)

    comparable = F.least("n_words", "leader_words") >= F.greatest("n_words", "leader_words") * similarity - 1e-9
    pairs = followers.where("node <> leader").where(comparable).groupBy("node", "leader").agg(F.sum("times").alias("shared"))
    # Each node's likeliest leader first.
    best = kept(pairs.groupBy("node").agg(F.max(F.struct("shared", "leader")).alias("most")).select("node", F.col("most.leader").alias("leader")), "best")
    compare(best)
    # Then the other leaders of groups that are not one class by that.
    group_rows = followers.select("key", "n", "node", "n_words", "leader", "leader_words")
    still = kept(_open_groups(_with_root(group_rows, roots)).drop("root"), "open")
    others = still.where("node <> leader").where(comparable).select("node", "leader").distinct().join(best, ["node", "leader"], "left_anti")
    compare(_apart(others, roots).select("node", "leader"))
    # In groups of more than two that are not one class yet, members of different classes are compared until they are
    # in one or found not to be similar.
    crowds = kept(_open_groups(_with_root(still.where("n > 2"), roots)), "crowds")
    if not crowds.isEmpty():
        found = kept(_linked_in_units(_units(crowds, similarity), words, similarity), "crowd-links")
        links = links.unionByName(found)
        roots = _merged(roots, found)
    return links, roots if roots is not None else none[1]


def components(links: DataFrame) -> DataFrame:
    """node, root of each linked node: the smallest node that links (a, b, each once, a > b) lead to. Alternating star contraction."""
    edges = links
    while True:
        # Done when every node has one edge, to a node that has none.
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out")).union(edges.select("b", F.lit(0)))
        if ends.groupBy("node").agg(F.sum("out").alias("outs"), F.min("out").alias("least")).where("outs > 1 or outs = 1 and least = 0").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = edges.union(edges.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = kept(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, edges = edges, kept(small.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "small-star")
        forget(before, large)


def _placed(docs: DataFrame, similarity: float) -> DataFrame:
    """doc_id, text_key, digest, n_words, node (its words' smallest doc_id), class_id, n_links of every row."""
    with tidied() as stays:
        rows = kept(_sketch_rows(docs), "sketches")
        nodes = rows.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("node"))
        of_digest = kept(nodes, "nodes")
        # Of several texts that one id leads, the one with the smallest digest stands for all.
        heads = rows.withColumnRenamed("doc_id", "node").join(of_digest, ["digest", "node"])
        heads = heads.groupBy("node").agg(F.min_by(F.struct("digest", "n_words", "keys"), "digest").alias("head")).select("node", "head.*")
        links, roots = similar_nodes(docs, kept(heads, "heads"), similarity)
        degree = links.union(links.select("leader", "node")).toDF("node", "other").distinct().groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
        placed = rows.select("doc_id", "text_key", "digest", "n_words").join(of_digest, "digest", "left").join(roots, "node", "left").join(degree, "node", "left")
        class_id, n_links = F.coalesce("root", "node", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links")
        stays.append(kept(placed.select("doc_id", "text_key", "digest", "n_words", "node", class_id, n_links), "placed"))
    return stays[0]


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (its class's smallest doc_id), n_words, n_links (links of its words' node to others that were verified)."""
    return _placed(docs, similarity).select("doc_id", "class_id", "n_words", "n_links")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Of each class of docs one row: the smallest document's, of its rows with equal words the one with the smallest text digest.

    Rows are chosen, not ids: where one id has several texts, only the text that leads the class stays. A text that only
    rows with null ids have stays once. Texts without words stay once an id, and in each row whose id is null.
    """
    placed = _placed(docs, similarity)
    first = placed.where("digest is null and doc_id is not null or digest is not null and (node is null or node = doc_id and class_id = doc_id)")
    first = first.groupBy("doc_id", "digest", "text_key").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id", "digest")
    first = kept(first.agg(F.min(F.struct("text_key", "n")).alias("least")).select("doc_id", "least.*"), "first-rows")
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.toDF(*names)
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))

    def of(chosen: DataFrame) -> DataFrame:
        return rows.join(chosen, doc_id.cast("bigint").eqNullSafe(F.col("doc_id")) & (_text_key(text) == F.col("text_key")), "left_semi")

    found = of(first.where("n = 1")).unionByName(rows.where(doc_id.isNull() & ~F.coalesce(text, F.lit("")).rlike(WORD)))
    repeated = first.where("n > 1")
    if not repeated.isEmpty():
        plain = [n for n in names if "map<" not in rows.schema[n].dataType.simpleString() and rows.schema[n].dataType.simpleString() != "variant"]
        turn = F.row_number().over(Window.partitionBy(doc_id, _text_key(text)).orderBy(F.xxhash64(*plain)))
        found = found.unionByName(of(repeated).withColumn("turn", turn).where("turn = 1").drop("turn"))
    return found.toDF(*docs.columns)
