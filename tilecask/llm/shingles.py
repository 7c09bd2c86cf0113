"""Word and shingle hashes of many texts at once.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  A word's hash is a polynomial
over its bytes, read off one running sum over a whole segment, so no word becomes a
Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .frames import WORKER_CACHES

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
#: A-Z to a-z and the five other white-space bytes to the blank.
LOWER = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
SEGMENT = 1 << 20
_HEAD = _U(0x5851F42D4C957F2D)
#: Powers of the base by how many, 16 or 32 MB each, which a worker keeps while it hashes words.
POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
WORKER_CACHES.append(POWERS)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, (n - 1).bit_length())
    if size not in POWERS:
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        pair = np.cumprod(up), np.cumprod(down)
        if size > 1 << 21:
            return pair
        POWERS[size] = pair
    return POWERS[size]


def _segments(data: bytes) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(data):
        end = min(len(data), at + SEGMENT)
        if end < len(data):
            cut = data.rfind(b" ", at, end)
            end = cut + 1 if cut > at else data.find(b" ", end) + 1 or len(data)
        yield at, end
        at = end


def words_of(texts: list[bytes], table: bytes = LOWER, heads: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word as ``table`` cuts them at blanks, and for each text the index of its first word (one more entry at the end).

    With ``heads``, each word has a row of hashes: its own and those of its first so many bytes; a
    shorter word repeats its own.
    """
    data = b" ".join(texts).translate(table)
    found, places = [], []
    for at, end in _segments(data):
        part = np.frombuffer(data, np.uint8, end - at, at)
        word = part != 32
        edge = np.diff(word.view(np.int8), prepend=0, append=0)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(first):
            continue
        up, down = _power(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_CODES[part] * up[: len(part)], out=total[1:])
        ends = [last, *(np.minimum(first + n, last) for n in heads)]
        own = [mix((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64) + np.where(end < last, _HEAD, _U(0))) for end in ends]
        found.append(np.stack(own, axis=1) if heads else own[0])
        places.append(first + at)
    words = np.concatenate(found) if found else np.zeros((0, len(heads) + 1) if heads else 0, np.uint64)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return words, np.searchsorted(np.concatenate(places) if places else np.zeros(0, np.int64), begins)


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted; all words as one where there are fewer than ``width``."""
    words, first = words_of(texts)
    n = max(0, len(words) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(width):
        rolled = rolled * _U(0xD6E8FEB86659FD93) + words[j : j + n]
    rolled = mix(rolled)
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= width:
            own = np.sort(rolled[a : b - width + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            value = _U(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    value = value * _U(0xA0761D6478BD642F) + w
            yield mix(np.array([value]))
        else:
            yield rolled[:0]
