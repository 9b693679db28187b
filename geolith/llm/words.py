"""Word hashes over Arrow text buffers, vectorised and in bounded pieces."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

#: Bytes hashed at a time; a piece ends where a word does.
PIECE = 1 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))

#: Bytes between words: space, and tab to carriage return.
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
#: Bytes between words where only digits, letters and non-ASCII characters are words.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _letters() -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    table[65:91] = table[97:123]  # A-Z count as a-z
    return table


_LETTERS = _letters()
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_FACTOR, _INVERSE)):
            _powers[k] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, PIECE + 4096) - 1, base)], dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


class Words(NamedTuple):
    hashes: np.ndarray  # uint64, in order
    starts: np.ndarray  # byte places in the buffer
    ends: np.ndarray
    document: np.ndarray  # index of each word's document


def _pieces(raw: np.ndarray, white: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about PIECE bytes that cut no word."""
    at = 0
    while at < len(raw):
        end = at + PIECE
        while end < len(raw):
            stop = np.flatnonzero(white[raw[end : end + 4096]])
            k = np.searchsorted(bounds, end)
            nearest = bounds[k] if k < len(bounds) else len(raw)
            if len(stop) and end + stop[0] < nearest:
                end += int(stop[0])
                break
            if nearest <= end + 4096:
                end = int(nearest)
                break
            end += 4096
        end = min(end, len(raw))
        yield at, end
        at = end


def words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, white: np.ndarray = WHITE) -> Words:
    """Words of all documents in a buffer; A-Z are lower-cased within the hash."""
    found = []
    for a, b in _pieces(raw, white, starts):
        piece = raw[a:b]
        inside = ~white[piece]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = starts[np.searchsorted(starts, a) : np.searchsorted(starts, b)] - a
        first[cuts] = inside[cuts]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        before = cuts[cuts > 0] - 1
        last[before] = inside[before]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        power, inverse = _power(len(piece) + 1)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_LETTERS[piece] * power[:-1], out=total[1:])
        found.append((mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64)), s + a, e + a))
    if not found:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, none)
    h, s, e = (np.concatenate(x) for x in zip(*found, strict=True))
    full = np.flatnonzero(ends > starts)
    return Words(h, s, e, full[np.searchsorted(starts[full], s, side="right") - 1])


def word_hash(word: str) -> int:
    """The hash words() gives to one word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(words(raw, np.array([0]), np.array([len(raw)]), np.zeros(256, bool)).hashes[0])


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each place on, and the places (indexes of first words) whose n words are of one document."""
    count = max(0, len(w.hashes) - n + 1)
    h = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = mix(h + w.hashes[k : k + count]) * _FACTOR
    places = np.flatnonzero(w.document[:count] == w.document[n - 1 : n - 1 + count])
    return h[places], places
