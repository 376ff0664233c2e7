"""64-bit hashes of words and of word shingles, whole batches of texts at a time."""

from __future__ import annotations

import numpy as np

#: Bytes hashed at once, and the words of a shingle.
CHUNK, SHINGLE = 1 << 20, 5
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64: every bit of the input reaches every bit of the result."""
    x = x + _ODD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
_FOLDED = _VALUE.copy()
_FOLDED[65:91] = _VALUE[97:123]
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64)] * 2


def _grown(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of some bytes: runs of other than ASCII white space."""
    word = np.concatenate([[False], ~_BLANK[data], [False]])
    turn = np.flatnonzero(word[1:] != word[:-1])
    return turn[::2], turn[1::2]


#: What marks a word's shape: bytes of capitals (A-Z), digits, and other signs of ASCII.
_SIGNS = np.zeros((3, 256), dtype=np.uint8)
_SIGNS[0, 65:91] = _SIGNS[1, 48:58] = 1
_SIGNS[2, [x for x in range(33, 127) if not chr(x).isalnum()]] = 1
SHAPES = 54


def _shapes(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to SHAPES - 1: no, one or more capitals; no, one or more signs or digits; and three lengths, with or without digits."""
    capital, digit, sign = (np.concatenate([[0], np.cumsum(t[data], dtype=np.uint32)]) for t in _SIGNS)
    count = lambda x: x[b] - x[a]
    length = np.digitize(b - a, (4, 10))
    return np.minimum(count(capital), 2) + 3 * np.minimum(count(sign), 2) + 9 * length + 27 * np.minimum(count(digit), 1)


def _hash(data: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    up, down = _grown(len(data) + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((_FOLDED if fold else _VALUE)[data] * up[: len(data)], dtype=np.uint64)])
    a, b = spans(data)
    return mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * _ODD), a, b


def word_hashes(texts: list[bytes], fold: bool = True, shapes: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text); A-Z count as a-z if fold.

    shapes, if given, gets arrays that hold the words' shapes.
    """
    hashes, counts, i = [], np.zeros(len(texts), dtype=np.int64), 0

    def add(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, a, b = _hash(data, fold)
        hashes.append(found)
        if shapes is not None:
            shapes.append(_shapes(data, a, b))
        return found, a

    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < CHUNK):
            size += len(texts[j]) + 1
            j += 1
        if j == i + 1 and size > 2 * CHUNK:  # a very long text, cut at white space
            text, at = texts[i], 0
            while at < len(text):
                end = min(len(text), at + CHUNK)
                while end < len(text) and not _BLANK[text[end]]:
                    end += 1
                counts[i] += len(add(np.frombuffer(text, dtype=np.uint8, count=end - at, offset=at))[0])
                at = end
        elif size > j - i:
            _, starts = add(np.frombuffer(b"\n".join(texts[i:j]), dtype=np.uint8))
            edges = np.cumsum([len(x) + 1 for x in texts[i:j]])
            counts[i:j] = np.diff(np.searchsorted(starts, np.concatenate([[0], edges])))
        i = j
    return np.concatenate([np.zeros(0, dtype=np.uint64), *hashes]), counts


def shingle_sets(texts: list[bytes], width: int = SHINGLE) -> list[np.ndarray]:
    """Each text's set of shingles of `width` words, as sorted hashes; fewer words are one shingle, none are no set."""
    words, counts = word_hashes(texts)
    weights = [mix(np.array([k], dtype=np.uint64))[0] | np.uint64(1) for k in range(1, width + 1)]
    n = max(0, len(words) - width + 1)
    rolled = np.zeros(n, dtype=np.uint64)
    for k, w in enumerate(weights):
        rolled += words[k : k + n] * w
    rolled = mix(rolled)
    sets, at = [], 0
    for c in counts.tolist():
        if c >= width:
            sets.append(np.unique(rolled[at : at + c - width + 1]))
        elif c:
            total = np.zeros(1, dtype=np.uint64)
            for k in range(c):
                total += words[at + k : at + k + 1] * weights[k]
            sets.append(mix(total ^ np.uint64(c)))
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
        at += c
    return sets
