"""Token hashes of many texts at once, by numpy."""

from __future__ import annotations

import numpy as np

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
#: Byte classes: white space, word bytes (letters, digits, all of non-ASCII), and the rest.
SPACE, WORD, MARK = 0, 1, 2
_CLASS = np.full(256, MARK, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE
_CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = WORD
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), base, np.uint64)
        held[0] = 1
        _powers[base] = held = np.cumprod(held, dtype=np.uint64)
    return held[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def stretch_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch [first, last) of the bytes."""
    summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * _powers_of(_MULTIPLIER, len(data)), dtype=np.uint64)])
    return mixed((summed[last] - summed[first]) * _powers_of(_INVERSE, len(summed))[first] + (last - first).astype(np.uint64))


class Tokens:
    """Runs of word bytes and runs of marks (word bytes only: marks=False; all between white space: whole=True), a 64-bit hash each, and where they start and end in their text.

    first has the index of each text's first token, and the number of all tokens at the end.
    """

    def __init__(self, sources: list[bytes], *, fold: bool = False, marks: bool = True, whole: bool = False):
        flat = np.frombuffer(b" " + b"".join((s.lower() if fold else s) + b" " for s in sources), np.uint8)
        kind = _CLASS[flat]
        if whole:
            kind = np.where(kind == SPACE, SPACE, WORD)
        if not marks:
            kind = np.where(kind == WORD, WORD, SPACE)
        edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        runs = np.concatenate([edge, [len(flat)]])
        starts, ends = runs[:-1], runs[1:]
        real = kind[starts] != SPACE
        starts, ends = starts[real], ends[real]
        n = len(flat)
        summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[flat] * _powers_of(_MULTIPLIER, n), dtype=np.uint64)])
        self._summed, self._at, self._until = summed, starts, ends
        self.hash = self.stems(n)
        bounds = np.concatenate([[1], 1 + np.cumsum([len(s) + 1 for s in sources])]).astype(np.int64)
        self.first = np.searchsorted(starts, bounds)
        text = np.repeat(np.arange(len(sources)), np.diff(self.first))
        self.text = text
        self.starts, self.ends = starts - bounds[text], ends - bounds[text]

    def stems(self, width: int) -> np.ndarray:
        """A hash of each token's first so many bytes, or of all where it has fewer."""
        ends = np.minimum(self._until, self._at + width)
        return mixed((self._summed[ends] - self._summed[self._at]) * _powers_of(_INVERSE, len(self._summed))[self._at] + (ends - self._at).astype(np.uint64))


#: Equal tokens in a row that count as a repetition.
REPEATED = 5


def pair_hashes(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token with the next one of its text (one hash for all that begin a repetition), and the text it is in."""
    same = t.text[1:] == t.text[:-1]
    again = np.concatenate([(t.hash[1:] == t.hash[:-1]) & same, np.zeros(REPEATED, bool)])
    begins = np.logical_and.reduce([again[k : k + len(same)] for k in range(REPEATED - 1)])
    pairs = np.where(begins, np.uint64(_MULTIPLIER), mixed(t.hash[:-1] * np.uint64(0xD6E8FEB86659FD93) + t.hash[1:]))
    return pairs[same], t.text[:-1][same]


def run_hashes(t: Tokens, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of so many tokens of one text, of the whole of a shorter text, and the text it is in."""
    summed = np.zeros(len(t.hash), np.uint64)
    ahead = np.concatenate([t.hash, np.zeros(width, np.uint64)])
    left = np.repeat(t.first[1:], np.diff(t.first)) - np.arange(len(t.hash))
    for k in range(width):
        summed = summed * np.uint64(_MULTIPLIER) + np.where(left > k, ahead[k : k + len(summed)], np.uint64(0))
    first = np.repeat(t.first[:-1], np.diff(t.first)) == np.arange(len(t.hash))
    use = (left >= width) | first
    return mixed(summed)[use], t.text[use]
