"""SentencePiece (merge type) encoding by a prefix table, and decoding.

A text is encoded by keeping, for each prefix, the one token that ends its encoding. Candidates for that token are the
vocabulary entries that an automaton finds ending there; the right one is compatible with the last token of the prefix
before it, that is, merging would leave the two side by side. The ids are recovered backwards from the last prefix.

No entry of a usable vocabulary has the space mark after another character, so merging never crosses the start of a
run of marks; texts are cut there, and the result of each distinct cut is reused within a task.

Null text and empty text have no ids. Very long texts and very long words take time and memory in proportion to their
length. Rows, ties and repeated rows are independent of each other; an id may be null or repeat, and is given back as it
is. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, small_batches

MARK = "▁"
CUT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Entries held by the caches of a task, about; they are emptied when the task ends.
CACHE = 180_000
_LOADED: dict[str, Codec] = {}


class Known(dict):
    """Of the cuts met lately, the ids as text. Those not asked for in a while go first.

    Each cut's ids are decoded once, when it is met; a cut whose ids decode to anything but itself has the bytes beside them.
    """

    def __init__(self, coder: Codec):
        self.coder, self.before = coder, {}

    def __missing__(self, cut: str) -> str | tuple[str, bytes]:
        found = self.before.get(cut)
        if found is None:
            ids = self.coder._cut_ids(cut)
            found, data = ",".join([self.coder.decimal[i] for i in ids]), self.coder.decode_bytes(ids)
            if data != cut.replace(MARK, " ").encode("utf-8", "surrogatepass"):
                found = found, data
        if len(cut) < 64:
            if len(self) > CACHE:
                self.before = dict(self)
                self.clear()
            self[cut] = found
        return found

    def forget(self) -> None:
        self.before = {}
        self.clear()


class Codec:
    """Tables for one model file, made once in each Python worker."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.piece = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        plain = [i for i in range(len(self.piece)) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
        self.byte_id = {int(self.piece[i][3:5], 16): i for i in range(len(self.piece)) if model.is_byte(i)}
        self.score = [model.get_score(i) for i in range(len(self.piece))]
        self.decimal = list(map(str, range(len(self.piece))))
        self.id = {self.piece[i]: i for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("the vocabulary has entries that span words")
        self.decoded = {i: self.piece[i].replace(MARK, " ").encode() for i in plain} | {i: bytes([b]) for b, i in self.byte_id.items()}
        self.characters = {p for p in self.id if len(p) == 1}
        self.halves: dict[int, tuple[int, int]] = {}
        self.usable: set[int] = set()
        self.matches = ahocorasick.Automaton()
        for p, i in self.id.items():
            if self._split(p, i):
                self.matches.add_word(p, (len(p), i))
                self.usable.add(i)
        self.matches.make_automaton()
        self.compatible: dict[int, bool] = {}
        self.known = Known(self)

    def _split(self, piece: str, own: int) -> bool:
        """Find the two halves whose merging made the entry; false if merging its characters does not end in it."""
        parts = list(piece)
        if any(c not in self.id for c in parts):
            return False
        while len(parts) > 1:
            best = max(((self.score[i], -k) for k in range(len(parts) - 1) if (i := self.id.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                return False
            k = -best[1]
            if len(parts) == 2:
                self.halves[own] = (self.id[parts[0]], self.id[parts[1]])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return True

    def fits(self, left: int, right: int) -> bool:
        """Whether merging leaves the two tokens side by side: undo their merges, latest first, and look for an earlier merge over the border."""
        key = left << 32 | right
        if (found := self.compatible.get(key)) is None:
            if len(self.compatible) > 2 * CACHE:
                self.compatible.clear()
            found = self.compatible[key] = self._undo(left, right)
        return found

    def _undo(self, left: int, right: int) -> bool:
        score, piece, halves = self.score, self.piece, self.halves
        if piece[left] + piece[right] in self.id:
            return False
        while True:
            a, b = halves.get(left), halves.get(right)
            if a is None and b is None:
                return True
            if b is not None and (a is None or score[right] <= score[left]):
                undone, right, first = score[right], b[0], True  # at equal scores the left merge came first
            else:
                undone, left, first = score[left], a[1], False
            over = self.id.get(piece[left] + piece[right])
            if over is not None and (score[over] > undone or first and score[over] == undone):
                return False

    def _known_characters(self, text: str) -> list[int]:
        whole = self.id.get(text)
        if whole in self.usable:
            return [whole]
        last: list[int] = [-1] * (len(text) + 1)
        length, fits, tested = [0] * (len(text) + 1), self.fits, self.compatible.get
        at = -1
        for end, (n, i) in self.matches.iter(text):
            if end == at:
                continue  # the one last token of this prefix is known
            start = end + 1 - n
            if start:
                before = last[start]
                if before < 0 or (found := tested(before << 32 | i)) is False or found is None and not fits(before, i):
                    continue
            last[end + 1], length[end + 1], at = i, n, end
        ids, end = [], len(text)
        while end:
            if last[end] < 0:
                raise ValueError(f"no last token for a prefix of {text!r}")
            ids.append(last[end])
            end -= length[end]
        return ids[::-1]

    def _cut_ids(self, cut: str) -> list[int]:
        if self.characters.issuperset(cut):
            return self._known_characters(cut)
        ids: list[int] = []
        for known, run in self._runs(cut):
            if known:
                ids += self._known_characters(run)
            else:
                ids += [self.byte_id[b] for b in run.encode()]
        return ids

    def _runs(self, cut: str) -> Iterator[tuple[bool, str]]:
        start, kind = 0, None
        for k, c in enumerate(cut):
            if (now := c in self.characters) is not kind:
                if k:
                    yield kind, cut[start:k]
                start, kind = k, now
        yield kind, cut[start:]

    def forget(self) -> None:
        self.known.forget()
        self.compatible.clear()

    def coded(self, text: str) -> tuple[str, str]:
        """The ids of a text in decimal, joined by commas, and the text that they decode to.

        Ids decode each for itself, so the bytes of a text are those of its cuts, one after the other.
        """
        if not text:
            return "", ""
        marked = MARK + text.replace(" ", MARK)
        cuts = CUT.findall(marked)
        found = list(map(self.known.__getitem__, cuts))
        try:
            ids, data = ",".join(found), None  # every cut decodes to itself
        except TypeError:
            ids = ",".join([f if isinstance(f, str) else f[0] for f in found])
            data = b"".join([c.replace(MARK, " ").encode() if isinstance(f, str) else f[1] for c, f in zip(cuts, found, strict=True)])
        first = int(ids.split(",", 1)[0])
        if data is not None:
            return ids, self._text(data, first)
        return ids, marked[self.piece[first].startswith(MARK) :].replace(MARK, " ")

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.coded(text)[0].split(",")] if text else []

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.decoded[i] for i in ids])

    def _text(self, data: bytes, first: int) -> str:
        """Without the space that encoding puts before a text."""
        return (data[1:] if self.piece[first].startswith(MARK) else data).decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        """The text of the ids, without the space that encoding puts before it."""
        return self._text(self.decode_bytes(ids), ids[0]) if ids else ""


def codec(model_file: str) -> Codec:
    if model_file not in _LOADED:
        _LOADED[model_file] = Codec(model_file)
    return _LOADED[model_file]


def encode_texts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and decoded text of every row: id, ids array<int>, decoded string."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model_file)
        for batch in small_batches(batches, "text"):
            ids = [coder.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([coder.decode(i) for i in ids])], names=[id_col, "ids", "decoded"])
        coder.forget()

    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def token_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, and SHA-256 of the ids (decimal, joined by commas) and of the decoded text."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model_file)
        for batch in small_batches(batches, "text"):
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column("text").to_pylist():
                ids, decoded = coder.coded(text or "")
                counts.append(ids.count(",") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])
        coder.forget()

    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
