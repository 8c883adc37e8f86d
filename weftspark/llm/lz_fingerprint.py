"""Lempel-Ziv phrase fingerprints of documents.

A text is parsed character by character into dictionary phrases: each phrase is the longest one met before plus one
character, and joins the dictionary. The set of phrases is hashed, and its minimum under each of SIGNATURE hash functions
kept; the share of equal minima of two fingerprints estimates how much of their dictionaries they share, and so how well
one compresses by the other.

Each document is compared to an edited copy, whose last quarter of characters is replaced by the first as many of the
next document, and to the next document; next goes by ascending id (then a hash of the text), and the first follows the last. Null
text is empty; an empty text has no phrases, its fingerprint is all zeros and equal to that of other empty texts only.
Null ids come first. Rows that repeat an id are documents of their own. A table of one row is its own next document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, mix64

SIGNATURE = 64
_FACTORS = mix64(np.arange(1, SIGNATURE + 1, dtype=np.uint64)) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
EDGES = ", part int, first_text string, last_text string"


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) <= n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(2 * n + 2, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


def parse(text: str, known: set[str], phrase: str = "", at: int = 0) -> tuple[list[int], str]:
    """Parse on from the offset at: where the new phrases end, and the phrase that is not complete. known grows."""
    ends, add = [], known.add
    for at, character in enumerate(text, at + 1):
        phrase += character
        if phrase not in known:
            add(phrase)
            ends.append(at)
            phrase = ""
    return ends, phrase


def minima(codes: np.ndarray, start: int, ends: list[int]) -> np.ndarray:
    """The least hash of the phrases that end at ends, the first of them begun at start, under each function."""
    least = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
    if ends:
        powers, inverse = _powers(len(codes))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[: len(codes)], out=sums[1:])
        stop = np.array(ends)
        begin = np.concatenate([[start], stop[:-1]])
        phrases = mix64((sums[stop] - sums[begin]) * inverse[begin])
        for k in range(0, len(phrases), 2048):
            least = np.minimum(least, (phrases[k : k + 2048, None] * _FACTORS).min(axis=0))
    return least


def signature(least: np.ndarray, any_phrase: bool) -> np.ndarray:
    return (mix64(least) & np.uint64(0xFFFF)).astype(np.uint16) if any_phrase else np.zeros(SIGNATURE, np.uint16)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hex(found: np.ndarray) -> str:
    return found.astype(">u2").tobytes().hex()


class Parsed:
    """A text parsed up to the last character that an edit of its last quarter can't change, and on from there."""

    def __init__(self, text: str):
        self.text, self.kept = text, len(text) - len(text) // 4
        self.codes, self.known = _codes(text), set()
        self.ends, self.phrase = parse(text[: self.kept], self.known)
        self.least = minima(self.codes[: self.kept], 0, self.ends)
        self.signature = self._onward(text, self.codes)

    def _onward(self, text: str, codes: np.ndarray) -> np.ndarray:
        """The signature of a text that begins with what is kept."""
        ends, _ = parse(text[self.kept :], self.known, self.phrase, self.kept)
        start = self.ends[-1] if self.ends else 0
        least = np.minimum(self.least, minima(codes[start:], 0, [e - start for e in ends]))
        for a, b in zip([start, *ends], ends, strict=False):
            self.known.discard(text[a:b])  # as it was
        return signature(least, bool(self.ends or ends))

    def row(self, doc_id: int | None, after: Parsed) -> tuple:
        tail = after.text[: len(self.text) - self.kept]
        edited = self.text[: self.kept] + tail
        other = self.signature if edited == self.text else self._onward(edited, np.concatenate([self.codes[: self.kept], after.codes[: len(tail)]]))
        return doc_id, len(self.text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), _hex(self.signature), _hex(other), float((self.signature == other).mean()), float((self.signature == after.signature).mean())


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprint of each document, of its edited text, and their likeness."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))  # not the text: its sample would go to the driver
    rows = rows.repartitionByRange("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash").drop("text_hash")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, first = TaskContext.get().partitionId(), None, None
        for batch in batches:
            done = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parsed = Parsed(text.as_py())
                if held:
                    done.append(held[1].row(held[0], parsed) + (part, first, None))
                    first = None
                else:
                    first = parsed.text
                held = doc_id, parsed
            yield _batch(done, SCHEMA + EDGES)
        if held:  # its next document is the first of another part
            yield _batch([(held[0], *[None] * 6, part, first, held[1].text)], SCHEMA + EDGES)

    found = kept(rows.mapInArrow(within, SCHEMA + EDGES), "fingerprints")
    parts = sorted(r[0] for r in found.where("last_text is not null").select("part").collect())  # a number for each part
    follow = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)) or [], "part int, next_part int")
    last = found.where("last_text is not null").select("doc_id", "part", "last_text").join(F.broadcast(follow), "part")
    firsts = found.where("first_text is not null").select(F.col("part").alias("next_part"), "first_text")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _batch([Parsed(row["last_text"]).row(row["doc_id"], Parsed(row["first_text"]))], SCHEMA)

    edges = last.join(firsts, "next_part").select("doc_id", "last_text", "first_text").mapInArrow(across, SCHEMA)
    return found.where("last_text is null").drop("part", "first_text", "last_text").unionByName(edges)
