"""Elias-Fano coded monotone sequences in flat arrays, read in bulk, and files of named arrays."""

from __future__ import annotations

import json

import numpy as np

WORDS = 8  # 64-bit words of a block
_U = np.uint64
_TWOS, _FOURS, _EIGHTS, _EACH, _TOPS = (_U(int(x * 8, 16)) for x in ("55", "33", "0f", "01", "80"))
#: The place of the k-th one of a byte, at 256 * k + byte.
_IN_BYTE = np.array([([i for i in range(8) if byte >> i & 1] + [0] * 8)[k] for k in range(8) for byte in range(256)], np.int64)


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """Arrays of a sequence that does not fall, of numbers below universe."""
    values, n = values.astype(_U), len(values)
    low = max((universe // max(n, 1)).bit_length() - 1, 0)
    upper = (values >> _U(low)).astype(np.int64) + np.arange(n)
    size = -(-(n + (universe >> low) + 2) // (64 * WORDS)) * WORDS
    flags = np.zeros(size * 64, bool)
    flags[upper] = True
    bits = np.packbits(flags, bitorder="little").view(_U)
    upto = np.cumsum(np.bitwise_count(bits).reshape(-1, WORDS), axis=1, dtype=np.uint16)
    ones = np.concatenate([[0], np.cumsum(upto[:, -1], dtype=np.int64)])
    zeros = np.arange(len(ones)) * 64 * WORDS - ones
    within = np.zeros_like(upto)  # ones of a block before each of its words
    within[:, 1:] = upto[:, :-1]
    packed = np.zeros(n * low // 64 + 2, _U)
    if low:
        place = np.arange(n, dtype=np.int64) * low
        word, shift = place >> 6, (place & 63).astype(_U)
        rest = values & _U((1 << low) - 1)
        _put(packed, word, rest << shift)
        over = (place & 63) + low > 64
        _put(packed, word[over] + 1, rest[over] >> (_U(64) - shift[over]))
    return {"meta": np.array([n, low], np.int64), "bits": bits, "ones": ones, "zeros": zeros, "within": within.ravel(), "low": packed}


def _put(packed: np.ndarray, word: np.ndarray, bits: np.ndarray) -> None:
    """Set bits of words; word does not fall."""
    if len(word):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        packed[word[first]] |= np.bitwise_or.reduceat(bits, first)


class Sequence:
    """A coded sequence; all methods take and give arrays."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.n, self.width = (int(x) for x in arrays[f"{name}.meta"])
        self.bits, self.ones, self.zeros, self.packed = (arrays[f"{name}.{k}"] for k in ("bits", "ones", "zeros", "low"))
        self.within = arrays[f"{name}.within"].reshape(-1, WORDS)

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Places of the k-th ones, or zeros."""
        counts = self.ones if one else self.zeros
        block = np.searchsorted(counts, k, "right") - 1
        rest = k - counts[block]
        before = self.within[block]
        if not one:
            before = np.arange(0, 64 * WORDS, 64, dtype=np.uint16) - before
        word = np.bitwise_count((before <= rest.astype(np.uint16)[:, None]).view(_U).ravel()).astype(np.int64) - 1
        rest = (rest - before.ravel()[np.arange(len(k)) * WORDS + word]).astype(_U)
        word += block * WORDS
        value = self.bits[word] if one else ~self.bits[word]
        upto = value - (value >> _U(1) & _TWOS)  # ones of each two bits, four bits, and of all bytes up to each
        upto = (upto & _FOURS) + (upto >> _U(2) & _FOURS)
        upto = (upto + (upto >> _U(4)) & _EIGHTS) * _EACH
        place = np.bitwise_count((rest * _EACH | _TOPS) - upto & _TOPS).astype(_U) << _U(3)
        rest -= (upto << _U(8)) >> place & _U(255)
        return (word << 6) + place.astype(np.int64) + _IN_BYTE[rest << _U(8) | value >> place & _U(255)]

    def _next_one(self, place: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Places of the ones after those at place, which are numbered index."""
        place = place + 1
        value = self.bits[np.minimum(place >> 6, len(self.bits) - 1)] >> (place & 63).astype(_U)
        found = place + np.bitwise_count((value & -value) - _U(1))
        far = np.flatnonzero((value == 0) | (place >> 6 >= len(self.bits)))
        if len(far):
            found[far] = self._select(index[far] + 1, True)
        return found

    def _ones_from(self, place: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many ones follow one another from each place; before the zero numbered high."""
        word, shift = place >> 6, (place & 63).astype(_U)
        after = np.minimum(word + 1, len(self.bits) - 1)
        zeros = ~(self.bits[word] >> shift | self.bits[after] << (_U(63) ^ shift) << _U(1))
        count = np.bitwise_count((zeros & -zeros) - _U(1)).astype(np.int64)  # zeros below the lowest one
        long = np.flatnonzero(zeros == 0)
        if len(long):
            count[long] = self._select(high[long], False) - place[long]
        return count

    def lows(self, index: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(index), _U)
        place = index * self.width
        word, shift = place >> 6, (place & 63).astype(_U)
        return (self.packed[word] >> shift | self.packed[word + 1] << (_U(63) ^ shift) << _U(1)) & _U((1 << self.width) - 1)

    def at(self, index: np.ndarray) -> np.ndarray:
        index = index.astype(np.int64)
        if not len(index):
            return np.zeros(0, _U)
        return (self._select(index, True) - index).astype(_U) << _U(self.width) | self.lows(index)

    def at_both(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at index and at index + 1."""
        index = index.astype(np.int64)
        if not len(index):
            return np.zeros(0, _U), np.zeros(0, _U)
        place = self._select(index, True)
        after = self._next_one(place, index)
        return tuple((p - i).astype(_U) << _U(self.width) | self.lows(i) for p, i in ((place, index), (after, index + 1)))

    def next_at_least(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first value that is at least target (n if none), and whether it is equal."""
        high, low = (target >> _U(self.width)).astype(np.int64), target & _U((1 << self.width) - 1)
        index = np.zeros(len(target), np.int64)
        later = np.flatnonzero(high)
        index[later] = self._select(high[later] - 1, False) + 1 - high[later]
        end = index + self._ones_from(index + high, high)
        below, left = index.copy(), np.flatnonzero(index < end)
        asked, first, last = low[left], index[left], end[left]
        while len(left):  # by halving, among the values with the same high part
            middle = (first + last) >> 1
            up = self.lows(middle) < asked
            first, last = np.where(up, middle + 1, first), np.where(up, last, middle)
            more = first < last
            below[left[~more]] = first[~more]
            left, asked, first, last = (x[more] for x in (left, asked, first, last))
        equal = below < end
        equal[equal] = self.lows(below[equal]) == low[equal]
        return below, equal


def dump(arrays: dict[str, np.ndarray]) -> bytes:
    """One file of named arrays, each at a multiple of 8 bytes."""
    head, parts, offset = {}, [], 0
    for name, array in arrays.items():
        data = np.ascontiguousarray(array).tobytes()
        head[name] = [array.dtype.str, offset, len(data)]
        data += b"\0" * (-len(data) % 8)
        parts.append(data)
        offset += len(data)
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 8)
    return len(text).to_bytes(8, "little") + text + b"".join(parts)


def load(mapped: np.ndarray) -> dict[str, np.ndarray]:
    mapped = np.asarray(mapped)  # a plain array: slices of memory maps are slow to make
    size = int.from_bytes(mapped[:8].tobytes(), "little")
    head = json.loads(mapped[8 : 8 + size].tobytes())
    return {name: mapped[8 + size + at : 8 + size + at + n].view(kind) for name, (kind, at, n) in head.items()}
