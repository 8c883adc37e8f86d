"""Language-model scoring with an n-gram trie in Elias-Fano code.

A token is a word (A-Z lower-cased) or the end of its text. The trie's first level holds the hashes of the words seen in
training in order, the rank of a word being its id; each further level holds, for each node of the level before, the
ids of the tokens that follow it, as one monotone sequence: the ids of a node count from the last value of the node
before it. Pointers from nodes to their followers are monotone too. Both are Elias-Fano coded; beside them lie 8-bit codes
of log10 probabilities and back-off weights, each with the codebook of its file. A lookup takes the node's base and
searches the successor of base + id within the node's followers.

Probabilities are interpolated with absolute discounting, p(w|h) = max(n(hw) - D, 0)/n(h) + D * distinct(h)/n(h) * p(w|h'),
down to (c + 1)/(N + V + 1) for one token, in which 1 of the V + 1 shares is for all unseen tokens.

N-grams of all orders are counted by Spark in one pass: each task counts its own first, then the counts meet in ranges of
n-grams that a sample of texts cuts evenly; the sample only sets the cuts. A frequent context spans several ranges. Ranges
become files of the shared folder, which tasks map into memory. The driver sees a few numbers for each file; tasks find
them in an index beside the files, and what is broadcast has the same size for any corpus.

Null text is empty, and scores its end token only. Words are known by 64-bit hashes; there may be 2**31 - 2 different ones,
more are refused. Other columns are not read, rows
are scored each for itself. With no training text every token has probability 1 (one share, of unseen tokens).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, give_back, kept, mapped_file, mix64, new_folder, opened, put_file, small_batches, text_bytes
from .elias_fano import Sequence, dump, encode, load

ORDER = 3
DISCOUNT = 0.75
#: Expected number of texts that set the cuts, of n-grams drawn from them for each range, and tokens for each range, about.
CUT_TEXTS, CUTS_DRAWN, RANGE_TOKENS = 4000, 32, 4 << 20
#: Words or n-grams that a task counts before it hands them on; bytes of text that it takes at once.
COUNTED, AT_ONCE = 4 << 20, 8 << 20
MOST_WORDS = (1 << 31) - 2
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
END = b"\n"  # no word holds a line end
_LOW = np.int64(0xFFFFFFFF)
_OPEN: dict[str, object] = {}
_READ, READ_BYTES = [0], 256 << 20


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, lower-cased, and at which token each text begins: each has its words and an end."""
    data, offsets = text_bytes(texts)
    space = (data == 32) | (data - np.uint8(9) < 5)
    begins_word, ends_word = ~space, ~space
    begins_word[1:] &= space[:-1]
    ends_word[:-1] &= space[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]  # a word ends with its text
    begins_word[edges], ends_word[edges - 1] = ~space[edges], ~space[edges - 1]
    starts = np.flatnonzero(begins_word)
    places = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(np.flatnonzero(ends_word) + 1 - starts, out=places[1:])
    del space, begins_word, ends_word
    letters = data.tobytes().translate(LOWER, SPACES)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(letters)])
    return words, np.searchsorted(starts, offsets) + np.arange(len(offsets))


def read(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the different tokens of all texts, the number in them of each token, and where each text begins."""
    words, begins = split(texts)
    coded = words.dictionary_encode()
    each = [*coded.dictionary.to_numpy(zero_copy_only=False), END]
    numbers, of_word = np.full(begins[-1], len(each) - 1, np.int32), np.ones(begins[-1], bool)
    of_word[begins[1:] - 1] = False
    numbers[of_word] = coded.indices.to_numpy()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, each), np.uint64, len(each)), numbers, begins


def read_known(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and training counts of the tokens of all texts, and where each text begins."""
    hashes, numbers, begins = read(texts)
    ids, counts = word_ids(hashes, model)
    return ids[numbers], counts[numbers], begins


def pack(keys: np.ndarray, *others: np.ndarray) -> bytes:
    """Rising keys and further columns, small: bytes of the keys' differences and of the columns by place, compressed."""
    columns = [c.astype(np.uint64) for c in (np.diff(keys.astype(np.uint64), prepend=np.uint64(0)), *others)]
    used = [max((int(c.max(initial=0)).bit_length() + 7) // 8, 1) for c in columns]  # bytes above are zero in all rows
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8)[:, :n].T).ravel() for c, n in zip(columns, used, strict=True)]
    return bytes(used) + zstandard.ZstdCompressor(level=1).compress(np.concatenate(planes).tobytes())


def unpack(data: bytes, columns: int = 2) -> list[np.ndarray]:
    used = list(data[:columns])
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[columns:]), np.uint8).reshape(sum(used), -1)
    found, at = [], 0
    for n in used:
        column = np.zeros((planes.shape[1], 8), np.uint8)
        column[:, :n] = planes[at : at + n].T
        found.append(column.view(np.uint64).ravel())
        at += n
    return [np.cumsum(found[0], dtype=np.uint64), *(x.astype(np.int64) for x in found[1:])]


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def summed_grams(contexts: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for n-grams, in order of context and token."""
    contexts, ids = contexts.astype(np.int64, copy=False), ids.astype(np.int64, copy=False)
    if len(ids) and contexts.max() > MOST_WORDS:  # contexts of two tokens go by their ranks
        order = np.argsort(contexts)
        contexts, ids, counts = contexts[order], ids[order], counts[order]
        del order
        keys = np.cumsum(np.concatenate([[False], contexts[1:] != contexts[:-1]]))
    else:
        keys = contexts.copy()
    keys <<= 32
    keys |= ids
    order = np.argsort(keys)
    del keys
    contexts, ids, counts = contexts[order], ids[order], counts[order]
    del order
    new = np.concatenate([[True], (contexts[1:] != contexts[:-1]) | (ids[1:] != ids[:-1])])[: len(ids)]
    first = np.flatnonzero(new)
    return contexts[first], ids[first], np.add.reduceat(counts, first) if len(first) else counts


def _quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and the codebook: 256 bins of equally many values, each standing for its mean."""
    order = np.argsort(values)
    bins = np.arange(len(values)) * 256 // max(len(values), 1)
    codes = np.empty(len(values), np.uint8)
    codes[order] = bins
    sums = np.bincount(bins, values[order], 256) if len(values) else np.zeros(256)
    return codes, (sums / np.maximum(np.bincount(bins, minlength=256), 1)).astype(np.float32)


class _Found:
    """Arrays by which tasks find the files of a level, in a file of the shared folder. Broadcasts hold its name only."""

    def __init__(self, folder: str, name: str, **arrays: np.ndarray):
        self.folder, self.name = folder, name
        put_file(f"{folder}/{name}-index", lambda out: out.write(dump(arrays)))
        self.__dict__ |= arrays

    def __getstate__(self) -> tuple[str, str]:
        return self.folder, self.name

    def __setstate__(self, state: tuple[str, str]) -> None:
        self.folder, self.name = state
        self.__dict__ |= load(mapped_file(f"{self.folder}/{self.name}-index"))

    def path(self, k: int) -> str:
        return f"{self.folder}/{self.name}-{self.numbers[k]}"


class Words(_Found):
    """Files of words: numbers, the ids and the hashes that they start with."""

    @classmethod
    def of(cls, folder: str, numbers: np.ndarray, starts: np.ndarray, first: np.ndarray) -> Words:
        return cls(folder, "words", numbers=numbers, starts=starts, first=first)


class Level(_Found):
    """Files of n-grams: numbers, the number of the first node, and the first (context, token), by contexts in order."""

    @classmethod
    def of(cls, folder: str, order: int, contexts: np.ndarray, tokens: np.ndarray, starts: np.ndarray) -> Level:
        each, rank = np.unique(contexts, return_inverse=True)
        return cls(folder, f"level-{order}", numbers=np.arange(len(contexts)), starts=starts, each=each, keys=rank.astype(np.int64) << 32 | tokens)

    def file_of(self, contexts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The file where each n-gram is, if it is anywhere."""
        at = np.searchsorted(self.each, contexts, "right") - 1
        exact = (at >= 0) & (self.each[np.maximum(at, 0)] == contexts)
        return np.maximum(np.searchsorted(self.keys, at << 32 | np.where(exact, ids, _LOW), "right") - 1, 0)


@dataclass
class Model:
    """What tasks need to find the files; of the same size for any corpus where it is broadcast."""

    words: Words
    n_words: int
    total: int
    levels: list[Level]


def _file(path: str, kind: type):
    """A file of the model; files that had to be read take no more than READ_BYTES of a task's memory, about."""
    if path not in _OPEN:
        data = mapped_file(path)
        _READ[0] += 0 if isinstance(data, np.memmap) else len(data)
        if len(_OPEN) > 20_000 or _READ[0] > READ_BYTES:
            _OPEN.clear()
            _READ[0] = 0
        _OPEN[path] = kind(load(data))
    return _OPEN[path]


class _Words:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.base, self.hashes, self.counts = arrays["base"][0], Sequence(arrays, "hash"), arrays["count"]
        self.most = self.hashes.at(np.array([self.hashes.n - 1]))[0]


class _LevelFile:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.first, self.contexts = (int(x) for x in arrays["range"])
        self.pointers, self.followers = Sequence(arrays, "pointer"), Sequence(arrays, "follower")
        self.most = self.followers.at(np.array([self.followers.n - 1]))[0]
        self.prob, self.prob_book, self.back, self.back_book = (arrays[k] for k in ("prob", "prob_book", "back", "back_book"))

    def spans(self, local: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of the followers of local contexts, and the base of their values."""
        begin, end = (x.astype(np.int64) for x in self.pointers.at_both(local))
        base = np.zeros(len(local), np.uint64)
        base[begin > 0] = self.followers.at(begin[begin > 0] - 1) + np.uint64(1)
        return begin, end, base

    def find(self, contexts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Local index of each follower (-1: none), its log10 probability, and the context's back-off (0: not a context). contexts do not fall."""
        local = contexts - self.first
        inside = (local >= 0) & (local < self.contexts)
        index, prob, back = np.full(len(ids), -1), np.zeros(len(ids)), np.zeros(len(ids))
        at = np.flatnonzero(inside)
        if not len(at):
            return index, prob, back
        local = local[at]
        new = np.concatenate([[True], local[1:] != local[:-1]])
        inverse = np.cumsum(new) - 1
        begin, end, base = (x[inverse] for x in self.spans(local[new]))
        back[at] = self.back_book[self.back[local]]
        target = base + ids[at].astype(np.uint64)
        within = (begin < end) & (target <= self.most)
        at, begin, end, target = at[within], begin[within], end[within], target[within]
        found, equal = self.followers.next_at_least(target)
        equal &= (found >= begin) & (found < end)
        index[at[equal]] = found[equal]
        prob[at[equal]] = self.prob_book[self.prob[found[equal]]]
        return index, prob, back


def _by_file(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The files of a list of numbers, and where in the list each is; in one pass, however many files there are."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for at in np.split(order, cuts) if len(order) else []:
        yield int(part[at[0]]), at


def word_ids(hashes: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Ids (-1: unknown) and training counts of token hashes."""
    each, inverse = np.unique(hashes, return_inverse=True)
    ids, counts = np.full(len(each), -1), np.zeros(len(each), np.int64)
    part = np.searchsorted(model.words.first, each, "right") - 1
    for k, at in _by_file(part):
        if k < 0:
            continue
        words = _file(model.words.path(k), _Words)
        at = at[each[at] - words.base <= words.most]
        found, equal = words.hashes.next_at_least(each[at] - words.base)
        ids[at[equal]] = model.words.starts[k] + found[equal]
        counts[at[equal]] = words.counts[found[equal]]
    return ids[inverse], counts[inverse]


def counts_of_ids(ids: np.ndarray, model: Model) -> np.ndarray:
    counts = np.zeros(len(ids), np.int64)
    part = np.searchsorted(model.words.starts, ids, "right") - 1
    for k, at in _by_file(part):
        counts[at] = _file(model.words.path(k), _Words).counts[ids[at] - model.words.starts[k]]
    return counts


def single_log(counts: np.ndarray, model: Model) -> np.ndarray:
    return np.log10((counts + 1.0) / (model.total + model.n_words + 1))


def look_up(contexts: np.ndarray, ids: np.ndarray, level: Level) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (-1: none), log10 probabilities and back-offs of n-grams at a level; context or id -1: none. contexts do not fall."""
    node, prob, back = np.full(len(ids), -1), np.zeros(len(ids)), np.zeros(len(ids))
    known = np.flatnonzero(contexts >= 0)
    if not len(level.numbers) or not len(known):
        return node, prob, back
    contexts, asked = contexts[known], np.maximum(ids[known], 0)  # an unknown token is in no list, but its context has a back-off
    part = level.file_of(contexts, asked)
    for k, at in _by_file(part):
        index, p, b = _file(level.path(k), _LevelFile).find(contexts[at], asked[at])
        at = known[at]
        node[at], prob[at], back[at] = np.where(index >= 0, index + level.starts[k], -1), p, b
    unknown = ids < 0
    node[unknown], prob[unknown] = -1, 0.0
    return node, prob, back


def _pairs(ids: np.ndarray, begins: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The token before each token (start: none), and the keys of both; -1 where one is not known."""
    before = np.concatenate([[-1], ids[:-1]])
    before[begins[:-1]] = start
    return before, np.where((before >= 0) & (ids >= 0), before << 32 | ids, -1)


def _grams(ids: np.ndarray, begins: np.ndarray, start: int, order: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By order: contexts, tokens and counts of the n-grams of training texts. The context of three is the key of the first two."""
    _, keys = _pairs(ids, begins, start)
    each, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    found = {2: (each >> 32, each & _LOW, counts)}
    if order == 3:
        rank = np.concatenate([[-1], inverse[:-1]])
        rank[begins[:-1]] = -1
        some = rank >= 0
        three, counts = np.unique(rank[some] << 32 | ids[some], return_counts=True)
        found[3] = each[three >> 32], three & _LOW, counts
    return found


def _train_words(texts: DataFrame, folder: str, ranges: int) -> tuple[Words, int, int]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hand_on() -> pa.RecordBatch:
            keys, sums = summed(*map(np.concatenate, zip(*held, strict=True)))
            part = (keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
            cuts = np.searchsorted(part, np.arange(ranges + 1, dtype=np.uint64))
            rows = [(k, pack(keys[a:b], sums[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "data"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in small_batches(batches, "text", AT_ONCE):
            hashes, numbers, _ = read(batch.column(0))
            held.append((hashes, np.bincount(numbers, minlength=len(hashes))))
            if sum(len(h) for h, _ in held) > COUNTED:
                yield hand_on()
        if held:
            yield hand_on()
        give_back()

    def build(part: pd.DataFrame) -> pd.DataFrame:
        pieces = [unpack(d) for d in part["data"]]
        keys, counts = summed(np.concatenate([k for k, _ in pieces]), np.concatenate([c for _, c in pieces]))
        number = int(part["part"].iloc[0])
        spread = keys - keys[0]
        arrays = {"base": keys[:1], "count": counts, **{f"hash.{k}": v for k, v in encode(spread, int(spread[-1]) + 1).items()}}
        put_file(f"{folder}/words-{number}", lambda out: out.write(dump(arrays)))
        return pd.DataFrame({"part": [number], "first": [int(keys[0]) - (1 << 63)], "size": [len(keys)], "total": [int(counts.sum())]})

    done = texts.mapInArrow(count, "part int, data binary").groupBy("part").applyInPandas(build, "part int, first bigint, size bigint, total bigint")
    listed = kept(done, "word-files")
    files = listed.orderBy("part").toPandas()  # four numbers for each file
    forget(listed)
    starts = np.concatenate([[0], np.cumsum(files["size"].to_numpy(np.int64))]).astype(np.int64)
    if starts[-1] > MOST_WORDS:
        raise ValueError(f"{starts[-1]} different words; ids are of 31 bits")
    first = files["first"].to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return Words.of(folder, files["part"].to_numpy(np.int64), starts[:-1], first), int(starts[-1]), int(files["total"].sum())


def _drawn_cuts(texts: DataFrame, folder: str, model: Model, order: int, ranges: int, size: int, rows: int) -> dict[int, _Found]:
    """For each order, n-grams that cut the texts' into ranges of about equal size. The rows that are read are bounded, as are the n-grams drawn."""
    shared = texts.sparkSession.sparkContext.broadcast(model)  # names of folders
    share = min(1.0, CUT_TEXTS / max(rows, 1))
    rate = min(1.0, CUTS_DRAWN * ranges / max(share * size / 6, 1))
    sample = texts.where(F.pmod(F.col("row_hash"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, list] = {n: [] for n in range(2, order + 1)}
        for batch in small_batches(batches, "text", AT_ONCE):
            ids, _, begins = read_known(batch.column(0), shared.value)
            for n, (contexts, tokens, counts) in _grams(ids, begins, shared.value.n_words, order).items():
                # By a hash of the n-gram, so that one that occurs often is drawn as one.
                some = mix64(mix64(contexts) + tokens.astype(np.uint64)).astype(np.float64) < rate * 2.0**64
                met[n].append((contexts[some], tokens[some], counts[some]))
        for n, parts in met.items():
            if parts:
                contexts, tokens, counts = summed_grams(*map(np.concatenate, zip(*parts, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tokens), n, np.int32)), *map(pa.array, (contexts, tokens, counts))], names=["n", "context", "token", "times"])

    drawn = sample.select("text").mapInArrow(draw, "n int, context bigint, token bigint, times bigint").groupBy("n", "context", "token").agg(F.sum("times").alias("times"))
    found = drawn.toPandas()
    cuts = {}
    for n in range(2, order + 1):
        of_n = found[found["n"] == n].sort_values(["context", "token"])
        at = np.unique(np.arange(1, ranges) * len(of_n) // ranges) if len(of_n) else []
        first = of_n.iloc[at] if len(of_n) else of_n
        cuts[n] = _Found(folder, f"cuts-{n}", contexts=first["context"].to_numpy(np.int64), tokens=first["token"].to_numpy(np.int64))
    return cuts


def _count_grams(texts: DataFrame, folder: str, model: Model, order: int, cuts: dict[int, _Found]) -> list:
    """Files of the counts of each range of each order; a row for each."""
    shared = texts.sparkSession.sparkContext.broadcast(model)  # names of folders

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {n: [] for n in range(2, order + 1)}
        sizes = dict.fromkeys(held, 0)

        def hand_on(n: int) -> pa.RecordBatch:
            parts = [np.concatenate(c) for c in zip(*held[n], strict=True)]
            held[n], sizes[n] = [], 0
            contexts, tokens, counts = summed_grams(*parts)
            del parts
            ends = [0]
            for context, token in zip(cuts[n].contexts.tolist(), cuts[n].tokens.tolist(), strict=True):
                a, b = np.searchsorted(contexts, context), np.searchsorted(contexts, context, "right")
                ends.append(int(a + np.searchsorted(tokens[a:b], token)))
            ends.append(len(tokens))
            rows = [(k, pack(contexts[a:b], tokens[a:b], counts[a:b])) for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a]
            columns = [pa.array([n] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["n", "part", "data"])

        for batch in small_batches(batches, "text", AT_ONCE):
            ids, _, begins = read_known(batch.column(0), shared.value)
            for n, grams in _grams(ids, begins, shared.value.n_words, order).items():
                held[n].append(grams)
                sizes[n] += len(grams[0])
                if sizes[n] > COUNTED:
                    yield hand_on(n)
        for n in held:
            if held[n]:
                yield hand_on(n)
        give_back()

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        pieces = [unpack(d, 3) for d in rows["data"]]
        parts = [np.concatenate(c) for c in zip(*pieces, strict=True)]
        pieces.clear()
        contexts, tokens, counts = summed_grams(*parts)
        del parts
        n, part = int(rows["n"].iloc[0]), int(rows["part"].iloc[0])
        path = f"{folder}/counts-{n}-{part}"
        put_file(path, lambda out: out.write(pack(contexts, tokens, counts)))
        found = {"n": n, "part": part, "path": path, "size": len(tokens), "token": int(tokens[0])}
        for side, context in (("first", contexts[0]), ("last", contexts[-1])):
            of_context = contexts == context
            found |= {side: int(context), f"{side}_n": int(of_context.sum()), f"{side}_sum": int(counts[of_context].sum())}
        del contexts, tokens, counts, of_context
        give_back()
        return pd.DataFrame([found])

    schema = "n int, part int, path string, size bigint, token bigint, first bigint, first_n bigint, first_sum bigint, last bigint, last_n bigint, last_sum bigint"
    done = texts.select("text").mapInArrow(count, "n int, part int, data binary").groupBy("n", "part").applyInPandas(meet, schema)
    listed = kept(done, "count-files")
    files = listed.orderBy("n", "part").collect()
    forget(listed)
    return files


def _build_level(spark: SparkSession, files: list, folder: str, model: Model, order: int, discount: float) -> Level:
    shared = spark.sparkContext.broadcast(model)  # names of folders
    edges: dict[int, list[int]] = {}  # of contexts at the ends of files: how many tokens follow, and how often
    for f in files:
        for side in ("first", "last")[: 1 if f["first"] == f["last"] else 2]:
            both = edges.setdefault(f[side], [0, 0])
            both[0] += f[f"{side}_n"]
            both[1] += f[f"{side}_sum"]

    def nodes_of(contexts: np.ndarray, model: Model) -> np.ndarray:
        return contexts if order == 2 else look_up(contexts >> 32, contexts & _LOW, model.levels[0])[0]

    def lower(contexts: np.ndarray, ids: np.ndarray, model: Model) -> np.ndarray:
        """Probability of each token after its context without the first token."""
        single = single_log(counts_of_ids(ids, model), model)
        if order == 2:
            return 10**single
        each, inverse = np.unique((contexts & _LOW) << 32 | ids, return_inverse=True)
        node, prob, back = (x[inverse] for x in look_up(each >> 32, each & _LOW, model.levels[0]))
        return 10 ** np.where(node >= 0, prob, back + single)

    def build(number: int, source: str, after: int | None, known: dict[int, tuple[int, int]]) -> tuple[int, int]:
        """Write the file of a range. after: the first context of the next file; known: of contexts at the ends, what edges has."""
        model = shared.value
        filesystem, name = opened(source)
        with filesystem.open_input_stream(name, compression=None) as stream:
            contexts, ids, counts = unpack(stream.read(), 3)
        contexts = contexts.astype(np.int64)
        new = np.concatenate([[True], contexts[1:] != contexts[:-1]])
        each = contexts[new]
        nodes = nodes_of(each, model)
        first, local_of = int(nodes[0]), nodes - nodes[0]
        # The next file's first context has its back-off here too: its tokens below that file's first are looked for here.
        more = np.array([after] if after is not None and after > each[-1] else [], np.int64)
        last = int(nodes_of(more, model)[0]) if len(more) else int(nodes[-1])
        local = local_of[np.cumsum(new) - 1]
        distinct = np.bincount(local, minlength=last - first + 1).astype(np.int64)
        sums = np.bincount(local, counts, last - first + 1)
        pointers = np.concatenate([[0], np.cumsum(distinct)])
        at_edges = dict(zip(each[[0, -1]].tolist(), local_of[[0, -1]].tolist(), strict=True)) | {int(c): last - first for c in more}
        for context, at in at_edges.items():
            distinct[at], sums[at] = known[context]
        with np.errstate(divide="ignore", invalid="ignore"):
            spare = np.where(sums > 0, discount * distinct / sums, 1.0)
        prob = np.maximum(counts - discount, 0) / sums[local] + spare[local] * lower(contexts, ids, model)
        some = np.diff(pointers) > 0
        base = np.zeros(last - first + 1, np.int64)
        base[some] = np.concatenate([[0], np.cumsum(ids[pointers[1:][some] - 1] + 1)[:-1]])
        values = base[local] + ids
        prob_codes, prob_book = _quantised(np.log10(prob))
        back_codes, back_book = _quantised(np.log10(spare))
        arrays = {"range": np.array([first, last - first + 1]), "prob": prob_codes, "prob_book": prob_book, "back": back_codes, "back_book": back_book}
        arrays |= {f"pointer.{k}": v for k, v in encode(pointers, len(ids) + 1).items()}
        arrays |= {f"follower.{k}": v for k, v in encode(values, int(values[-1]) + 1).items()}
        put_file(f"{folder}/level-{order}-{number}", lambda out: out.write(dump(arrays)))
        return number, first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [build(r["number"], r["path"], r["after"], {e: (n, s) for e, n, s in zip(r["ends"], r["distinct"], r["sums"], strict=True)}) for r in batch.to_pylist()]
            give_back()
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names=["number", "first_node"])

    after = [f["first"] for f in files[1:]] + [None]
    rows = []
    for k, f in enumerate(files):
        ends = [e for e in dict.fromkeys([f["first"], f["last"], after[k]]) if e is not None]
        rows.append((k, f["path"], after[k], ends, *map(list, zip(*[edges[e] for e in ends], strict=True))))
    listed = spark.createDataFrame(rows, "number bigint, path string, after bigint, ends array<bigint>, distinct array<bigint>, sums array<bigint>").repartition(max(len(files), 1))
    written = kept(listed.mapInArrow(run, "number bigint, first_node bigint"), "level-files")
    built = written.orderBy("number").collect()
    forget(written)
    for f in files:
        filesystem, name = opened(f["path"])
        filesystem.delete_file(name)
    starts = np.concatenate([[0], np.cumsum([f["size"] for f in files])[:-1]]).astype(np.int64) if files else np.zeros(0, np.int64)
    numbers = lambda rows, name: np.array([r[name] for r in rows], np.int64)
    return Level.of(folder, order, numbers(built, "first_node"), numbers(files, "token"), starts)


def train(texts: DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> Model:
    """The model of a table's texts; order is 2 or 3."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark: SparkSession = texts.sparkSession
    # The hash of the whole row draws the sample: copies of one text are drawn each for itself.
    keys = [F.col(f"`{c}`").cast("string") for c, kind in texts.dtypes if not kind.startswith(("array", "map", "struct"))]
    texts = texts.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.xxhash64(*keys).alias("row_hash"))
    folder = new_folder(spark, "ngrams")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size, rows = texts.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    ranges = max(least, -(-(size or 0) // (6 * RANGE_TOKENS)))
    model = Model(*_train_words(texts.select("text"), folder, ranges), [])
    files = _count_grams(texts, folder, model, order, _drawn_cuts(texts, folder, model, order, ranges, size or 0, rows))
    for n in range(2, order + 1):
        model.levels.append(_build_level(spark, [f for f in files if f["n"] == n], folder, model, n, discount))
    return model


def token_logs(ids: np.ndarray, counts: np.ndarray, begins: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each token alone, and after the tokens before it."""
    base = single_log(counts, model)
    before, _ = _pairs(ids, begins, model.n_words)
    # Each different n-gram is looked up once, in order; -1 is an unknown token, and stands first.
    pairs, inverse = np.unique((before + 1) << 32 | ids + 1, return_inverse=True)
    node, prob, back = look_up((pairs >> 32) - 1, (pairs & _LOW) - 1, model.levels[0])
    total = np.where(node[inverse] >= 0, prob[inverse], back[inverse] + base)
    if len(model.levels) > 1:
        rank = np.concatenate([[-1], inverse[:-1]])
        rank[begins[:-1]] = -1
        context = np.where(rank >= 0, node[rank], -1)
        known = np.flatnonzero(context >= 0)
        three, of_three = np.unique(rank[known] << 32 | ids[known] + 1, return_inverse=True)
        found, prob, back = (x[of_three] for x in look_up(node[three >> 32], (three & _LOW) - 1, model.levels[1]))
        total[known] = np.where(found >= 0, prob, back + total[known])
    return base, total


def score(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score, score of each text."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # names of folders
    names = [id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in small_batches(batches, "text", AT_ONCE):
            ids, counts, begins = read_known(batch.column("text"), model)
            base, total = token_logs(ids, counts, begins, model)
            n_known, base, total = (np.add.reduceat(x, begins[:-1]) for x in ((counts > 0).astype(np.int64), base, total))
            columns = [np.diff(begins), n_known, np.full(batch.num_rows, model.total, np.int64), base, total]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names=names)

    schema = f"`{id_col}` {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return docs.select(F.col(f"`{id_col}`"), "text").mapInArrow(run, schema)
