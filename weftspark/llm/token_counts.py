"""Exact token counts at every prefix of a text, for byte-level BPE vocabularies (a tokenizer's .json file).

A dynamic program over the prefixes of a piece of text keeps the one token that ends each prefix's encoding, and its count:
that of the prefix before this token, and one. A table row holds the changes from prefix to prefix for each character of a
text. What a text cut at any place costs, and how much of it fits a budget, is read from the row; nothing is encoded again.

Pieces of a cut text differ from those of the whole text only at its end: a run of white space that ends a text is one
piece, but gives its last character away if something follows; a contraction is one piece only when complete; a special
string counts as one token only when complete. The counts are those of the cut text in each case.

Null text and empty text have no tokens. Very long texts and very long pieces take time and memory in proportion to their
length. Rows, ties and repeated rows are independent of each other; an id may be null or repeat, and is given back as it
is. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from operator import sub

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, small_batches
from .piece_tokens import Codec

CONTRACTION = "'(?:s|t|re|ve|m|ll|d)"
#: Units that a task remembers, about; they are forgotten when the task ends.
UNITS = 300_000
SPACES = regex.compile(r"\s*")
#: The change from one prefix to the next, in this machine's order of bytes.
STEP = np.dtype(np.int16)
_LOADED: dict[str, Counter] = {}


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, and the others, in order, as the characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def ranges(characters: str) -> str:
    """A set of characters as ranges for a pattern."""
    codes = np.array(sorted(map(ord, characters)))
    parts = np.split(codes, np.flatnonzero(np.diff(codes) > 1) + 1)
    return "".join(f"\\U{p[0]:08x}-\\U{p[-1]:08x}" for p in parts)


def pattern(letter: str = r"\p{L}", number: str = r"\p{N}") -> regex.Pattern:
    """Units: white space and the piece after it, or white space that ends a text."""
    other = rf"[^\s{letter}{number}]"
    version = "(?V1)" if "--" in letter + number else ""
    return regex.compile(rf"{version}(?:\s*[^\S\x20])?{CONTRACTION}|\s*{letter}+|\s*{number}+|\s*{other}+|\s+")


def odd_characters(pieces) -> tuple[str, str]:
    """What `regex` takes for letters and for numbers, and the tokenizer's own, often older, tables don't."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    found = []
    for kind, member in (("L", "a"), ("N", "1")):
        asked = regex.sub(rf"[^\p{{{kind}}}]", "", every)
        begins = {start for _, (start, _) in pieces.pre_tokenize_str("".join(member + c for c in asked))}
        found.append("".join(c for k, c in enumerate(asked) if 2 * k + 1 in begins))
    return found[0], found[1]


class Units(dict):
    """Of the units met lately, the changes of the count at their characters, as bytes. Those not asked for in a while go first."""

    def __init__(self, counter: Counter):
        self.counter, self.before, self.same = counter, {}, {}

    def __missing__(self, unit: str) -> bytes:
        found = self.before.get(unit)
        if found is None:
            counts = self.counter.unit_counts(unit)
            found = array("h", map(sub, counts, [0, *counts])).tobytes()
            found = self.same.setdefault(found, found)
        if len(unit) < 64:
            if len(self) > UNITS:
                self.before, self.same = dict(self), {}
                self.clear()
            self[unit] = found
        return found


class Counter(Codec):
    """Tables for one tokenizer file, made once in each Python worker. Tokens are strings of bytes, as characters below 256."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        with open(file, encoding="utf-8") as source:
            told = json.load(source)
        model, before = told["model"], told["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or told["normalizer"] or before.get("type") != "ByteLevel" or before["add_prefix_space"] or not before.get("use_regex", True):
            raise ValueError("only plain byte-level BPE vocabularies can be counted")
        if any(t[k] for t in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("special strings that take white space or whole words can't be counted")
        byte = byte_of_character()
        as_bytes = lambda token: "".join(chr(byte[c]) for c in token)
        special = [t["content"] for t in told["added_tokens"]]
        vocabulary = {t: i for t, i in model["vocab"].items() if t not in special}
        self.piece = [""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.piece[i] = as_bytes(token)
        self.id = {p: i for i, p in enumerate(self.piece) if p}
        self.halves, self.rank, self.made_at = {}, {}, [-1] * len(self.piece)
        for rank, pair in enumerate(model["merges"]):
            left, right = map(as_bytes, pair if isinstance(pair, list) else pair.split(" "))
            made = self.id[left + right]
            if made in self.halves:
                raise ValueError("two merges make the same token")
            self.halves[made], self.made_at[made] = (self.id[left], self.id[right]), rank
            self.rank[self.id[left] << 32 | self.id[right]] = rank
        self.compatible: dict[int, bool] = {}
        self.matches = ahocorasick.Automaton()
        for token, i in self.id.items():
            if self._apart(*self.halves[i]) if i in self.halves else len(token) == 1:
                self.matches.add_word(token, (len(token), i))
        self.matches.make_automaton()
        letters, numbers = odd_characters(Tokenizer.from_file(file).pre_tokenizer)
        without = lambda kind, odd: rf"[\p{{{kind}}}--[{ranges(odd)}]]" if odd else rf"\p{{{kind}}}"
        self.odd, self.pattern, self.odd_pattern = frozenset(letters + numbers), pattern(), pattern(without("L", letters), without("N", numbers))
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.units = Units(self)

    def _undo(self, left: int, right: int) -> bool:
        """Whether merging leaves the two side by side: undo their merges, latest first, and look for an earlier merge over the border. Only listed pairs merge."""
        return (left << 32 | right) not in self.rank and self._apart(left, right)

    def _apart(self, left: int, right: int) -> bool:
        made_at, halves = self.made_at, self.halves
        while True:
            a, b = halves.get(left), halves.get(right)
            if a is None and b is None:
                return True
            if b is not None and (a is None or made_at[right] >= made_at[left]):
                undone, right, first = made_at[right], b[0], True  # of equal merges the left one came first
            else:
                undone, left, first = made_at[left], a[1], False
            over = self.rank.get(left << 32 | right)
            if over is not None and (over < undone or first and over == undone):
                return False

    def piece_counts(self, piece: str) -> list[int]:
        """The number of tokens of each prefix of a piece, by bytes; 0 for none."""
        last, counts = [-1] * (len(piece) + 1), [0] * (len(piece) + 1)
        fits, tested, at = self.fits, self.compatible.get, -1
        for end, (n, i) in self.matches.iter(piece):
            if end == at:
                continue  # the one last token of this prefix is known
            start = end + 1 - n
            if start:
                before = last[start]
                if before < 0 or (found := tested(before << 32 | i)) is False or found is None and not fits(before, i):
                    continue
            last[end + 1], counts[end + 1], at = i, counts[start] + 1, end
        if -1 in last[1:]:
            raise ValueError(f"no last token for a prefix of {piece!r}")
        return counts

    def character_counts(self, piece: str) -> list[int]:
        """The number of tokens of each prefix of a piece, by characters, from one on."""
        data = piece.encode()
        counts = self.piece_counts(data.decode("latin-1"))
        if len(data) == len(piece):
            return counts[1:]
        return [counts[k] for k in range(1, len(data) + 1) if k == len(data) or data[k] & 0xC0 != 0x80]

    def unit_counts(self, unit: str) -> list[int]:
        """The number of tokens of each prefix of a unit."""
        if unit[0] == " " and unit[1:].isalpha():
            return self.character_counts(unit)
        cut = SPACES.match(unit).end()
        spaces, rest = unit[:cut], unit[cut:]
        counts = self.character_counts(spaces) if spaces else []
        if not rest:
            return counts
        given = spaces[-1:] == " "
        ahead = spaces[:-1] if spaces else ""
        before = self.character_counts(ahead)[-1] if ahead else 0
        if spaces and not given:
            before += self.character_counts(spaces[-1])[-1]
        if given:
            return counts + [before + n for n in self.character_counts(" " + rest)[1:]]
        of_rest = self.character_counts(rest)
        if len(rest) == 3 and regex.fullmatch(CONTRACTION, rest):
            of_rest[1] = of_rest[0] + self.character_counts(rest[1])[0]
        return counts + [before + n for n in of_rest]

    def _ordinary(self, text: str) -> bytes:
        units = self.pattern if text.isascii() or self.odd.isdisjoint(text) else self.odd_pattern
        return b"".join(map(self.units.__getitem__, units.findall(text)))

    def steps(self, text: str) -> bytes:
        """The change of the number of tokens at each character."""
        if not self.special or not self.special.search(text):
            return self._ordinary(text)
        parts, at = [], 0
        for found in self.special.finditer(text):
            own = np.frombuffer(self._ordinary(text[at : found.end() - 1]), STEP)  # an incomplete special string is plain text
            after = own[: found.start() - at].sum() + 1
            parts += [own.tobytes(), np.array([after - own.sum()], STEP).tobytes()]
            at = found.end()
        return b"".join([*parts, self._ordinary(text[at:])])

    def forget(self) -> None:
        self.units = Units(self)
        self.compatible.clear()


def counter(file: str) -> Counter:
    if file not in _LOADED:
        _LOADED[file] = Counter(file)
    return _LOADED[file]


def table(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_chars, n_tokens, and steps: the change of the count at each character, two bytes each."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(file)
        for batch in small_batches(batches, "text", 2 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            steps = [known.steps(t) for t in texts]
            tokens = [int(np.frombuffer(s, STEP).sum(dtype=np.int64)) for s in steps]
            columns = [[len(t.encode()) for t in texts], [len(t) for t in texts], tokens]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array(steps, pa.binary())], names=[id_col, "n_bytes", "n_chars", "n_tokens", "steps"])
        known.forget()

    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_chars bigint, n_tokens bigint, steps binary")


def _answered(counts: DataFrame, question: str, name: str, answer) -> DataFrame:
    """counts with a column more, from each row's steps and a number."""
    columns = [c for c in counts.columns if c != "steps"]
    numbered = counts.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)], F.expr(question).cast("bigint").alias("question"), F.col("steps").alias("steps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = zip(batch.column("question").to_pylist(), batch.column("steps").to_pylist(), strict=True)
            found = [None if q is None else answer(q, np.frombuffer(s or b"", STEP)) for q, s in asked]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(found, pa.int64())], names=[*(f"c{k}" for k in range(len(columns))), "answer"])
        give_back()

    kinds = ", ".join(f"c{k} {counts.schema[c].dataType.simpleString()}" for k, c in enumerate(columns))
    return numbered.mapInArrow(run, f"{kinds}, answer bigint").toDF(*columns, name)


def tokens_of_first(counts: DataFrame, characters: str, name: str = "tokens") -> DataFrame:
    """How many tokens the first characters of each text have, as encoded alone. characters: an SQL expression over the table's columns."""
    return _answered(counts, characters, name, lambda k, steps: int(steps[: max(k, 0)].sum(dtype=np.int64)))


def longest_within(counts: DataFrame, budget: str, name: str = "fits_chars") -> DataFrame:
    """How many characters the longest prefix of each text has that takes at most so many tokens. budget: an SQL expression over the table's columns."""

    def answer(most: int, steps: np.ndarray) -> int:
        within = np.flatnonzero(np.cumsum(steps, dtype=np.int64) <= most)
        return int(within[-1]) + 1 if len(within) else 0

    return _answered(counts, budget, name, answer)
