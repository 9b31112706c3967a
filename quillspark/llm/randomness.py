"""Tests of randomness by encoding, and what ordinary strings of the same encoding and length do in them.

A string's encoding is the smallest alphabet that holds it.  Over the values of that alphabet it
is tested by chi-squared against equal shares of all symbols, by the number of its runs of
character classes (lower case, capitals, digits, marks), and by the serial correlation of its
neighbours, of their values and of their being vowels.

Neither random nor ordinary strings follow textbook laws at 20 characters, and the statistics of
one string depend on each other.  So both are simulated, for each encoding and each length of a
grid: random ones draw symbols alike; of ordinary ones the letters follow the trigrams of all
words of the corpus, and words are joined as identifiers, constants, paths and numbers are.  The
linear discriminant of the two combines the statistics into one score, and the p-value of a
candidate is the share of other ordinary strings that score as high or higher; above all but TAIL
of them it falls off exponentially, by the mean distance of that tail, which errs on the side of
ordinary strings.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Ordinary strings for each encoding and length: one half for the discriminant, one for the p-values.
SIMULATED = 20_000
#: Lengths that are simulated; a string counts as the longest of them that it reaches.
GRID = (16, 20, 24, 32, 40, 64, 128)
#: Share of the ordinary strings from which the tail is drawn on, and scores that are kept of the others.
TAIL, KEPT = 0.005, 200
LEAST_P = 1e-60
#: Chance that a number of up to 4 digits follows a word, that one of 4 to 14 follows a word of hexadecimal
#: letters, and that marks stand between words where the encoding has them.
NUMBERS, HEX_NUMBERS, MARKS = 0.1, 0.8, 0.7
#: Weight of the letters' own shares in the trigrams, in counts.
PRIOR = 2.0
#: Bytes of ordinary strings from which windows are cut.
STREAM = 1 << 18

_LOW, _UP, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


@dataclass(frozen=True)
class Encoding:
    """name, its symbols in order of their values, and a pattern of the strings it holds."""

    name: str
    symbols: str
    pattern: re.Pattern

    @property
    def size(self) -> int:
        return len(self.symbols)


def _encoding(name: str, symbols: str, pattern: str) -> Encoding:
    return Encoding(name, symbols, re.compile(pattern))


#: From the smallest alphabet to the largest; digits alone are numbers and no encoding.
ENCODINGS = (
    _encoding("hex", _DIGIT + "abcdef", r"(?=.*[a-f])[0-9a-f]+\Z"),
    _encoding("HEX", _DIGIT + "ABCDEF", r"(?=.*[A-F])[0-9A-F]+\Z"),
    _encoding("base32", _UP + "234567", r"[A-Z2-7]*[A-Z][A-Z2-7]*=*\Z"),
    _encoding("base36", _DIGIT + _LOW, r"(?=.*[a-z])[0-9a-z]+\Z"),
    _encoding("BASE36", _DIGIT + _UP, r"(?=.*[A-Z])[0-9A-Z]+\Z"),
    _encoding("alnum", _UP + _LOW + _DIGIT, r"(?=.*[A-Za-z])[A-Za-z0-9]+\Z"),
    _encoding("base64", _UP + _LOW + _DIGIT + "+/", r"(?=.*[A-Za-z])[A-Za-z0-9+/]+={0,2}\Z"),
    _encoding("base64url", _UP + _LOW + _DIGIT + "-_", r"(?=.*[A-Za-z])[A-Za-z0-9_-]+={0,2}\Z"),
)
NAMES = tuple(e.name for e in ENCODINGS)


def encoding(s: str) -> int | None:
    """Number of the encoding in ENCODINGS; none for what no encoding makes, such as numbers and rules of dashes."""
    return next((i for i, e in enumerate(ENCODINGS) if e.pattern.match(s)), None)


_KIND = np.full(256, 3, dtype=np.int8)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 0, 1, 2


def _values(e: Encoding) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[np.frombuffer(e.symbols.encode(), dtype=np.uint8)] = np.arange(e.size)
    return out


VALUES = tuple(_values(e) for e in ENCODINGS)
_VOWEL = np.zeros(256)
_VOWEL[[ord(c) for c in "aeiouyAEIOUY"]] = 1


def chi_squared(v: np.ndarray, k: int) -> np.ndarray:
    """Of each row of values against equal shares of k symbols."""
    m, n = v.shape
    counts = np.bincount((np.arange(m)[:, None] * k + v).reshape(-1), minlength=m * k).reshape(m, k).astype(float)
    return (counts * counts).sum(axis=1) * k / n - n


def changes(x: np.ndarray) -> np.ndarray:
    """Places of each row at which the class of characters changes: its runs less one."""
    kind = _KIND[x]
    return (kind[:, 1:] != kind[:, :-1]).sum(axis=1)


def serial(v: np.ndarray) -> np.ndarray:
    """Correlation of neighbouring values of each row; 1 where all are equal."""
    d = v - v.mean(axis=1, keepdims=True)
    var = (d * d).sum(axis=1)
    return np.where(var > 0, (d[:, 1:] * d[:, :-1]).sum(axis=1) / np.where(var > 0, var, 1), 1.0)


def statistics(x: np.ndarray, which: int) -> np.ndarray:
    """(rows, 4) for rows of bytes of one encoding: uniformity, changes, serial correlation of values and of vowels."""
    e, v, n = ENCODINGS[which], VALUES[which][x], x.shape[1]
    # The cube root of chi-squared over its degrees of freedom is nearly normal.
    uniform = np.cbrt(np.maximum(chi_squared(v, e.size), 0) / (e.size - 1))
    vowel = _VOWEL[x]
    mixed = (vowel.max(axis=1) > 0) & (vowel.min(axis=1) < 1)
    return np.stack([uniform, changes(x) / (n - 1), serial(v), np.where(mixed, serial(vowel), 0.0)], axis=1)


class Letters:
    """Words by the trigrams of a corpus: counts[a, b, c] with 0 for a word's edge and 1 to 26 for letters."""

    def __init__(self, counts: np.ndarray) -> None:
        share = counts.sum(axis=(0, 1)) + 1.0
        smooth = counts + PRIOR * (share / share.sum())
        self.steps = np.cumsum(smooth / smooth.sum(axis=2, keepdims=True), axis=2)

    def words(self, r: np.random.Generator, n: int, letters: np.ndarray | None = None, longest: int = 19) -> list[bytes]:
        """n words, of the given letters (numbers 1 to 26) only if any are given."""
        steps = self.steps
        if letters is not None:
            p = np.diff(steps, axis=2, prepend=0)
            keep = np.zeros(27)
            keep[[0, *letters]] = 1
            p = p * keep + 1e-9 * keep
            steps = np.cumsum(p / p.sum(axis=2, keepdims=True), axis=2)
        a, b = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        out, live = np.zeros((n, longest), dtype=np.uint8), np.ones(n, dtype=bool)
        for j in range(longest):
            c = (r.random(n)[:, None] > steps[a, b]).sum(axis=1)
            c = np.minimum(c, 26)
            live &= c > 0
            out[:, j] = np.where(live, c + 96, 0)
            a, b = b, np.where(live, c, 0)
        return [w for w in (x.tobytes().rstrip(b"\0") for x in out) if w]


def ordinary(which: int, letters: Letters, r: np.random.Generator, size: int) -> np.ndarray:
    """A stream of at least size bytes of ordinary strings of an encoding: joined words and numbers."""
    name = NAMES[which]
    digits = "234567" if name == "base32" else _DIGIT
    few = name in ("hex", "HEX")
    words = letters.words(r, size // 4, np.arange(1, 7) if few else None)
    marks = {"base64": [b"/", b"+"], "base64url": [b"-", b"_"]}.get(name)
    u = r.random((len(words), 4))
    numbers = r.integers(0, len(digits), (len(words), 14))
    out, total = [], 0
    for i, w in enumerate(words):
        style = u[i // 4, 3]
        if name in ("HEX", "base32", "BASE36"):
            w = w.upper()
        elif name not in ("hex", "base36"):
            # Camel case, capitals, or lower case, for some words on end; without marks mostly camel case.
            w = w.capitalize() if style < (0.5 if marks else 0.7) else w.upper() if style < (0.6 if marks else 0.8) else w
        piece = w
        if u[i, 0] < (HEX_NUMBERS if few else NUMBERS):
            k = 4 + int(u[i, 1] * 11) if few else 1 + int(u[i, 1] * 4)
            piece += "".join(digits[d] for d in numbers[i, :k]).encode()
        if marks and u[i, 2] < MARKS:
            piece += marks[int(style * 2)] if style < 1 else marks[0]
        out.append(piece)
        total += len(piece)
        if total >= size:
            break
    return np.frombuffer(b"".join(out), dtype=np.uint8)


def simulate(which: int, letters: Letters, simulated: int = SIMULATED, seed: int = 7) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, weights of the statistics, ascending scores of ordinary strings) of one encoding for each length."""
    r = np.random.default_rng([seed, which])
    stream = ordinary(which, letters, r, STREAM)
    symbols = np.frombuffer(ENCODINGS[which].symbols.encode(), dtype=np.uint8)
    half = simulated // 2
    for n in GRID:
        # Windows that begin anywhere.
        words = statistics(stream[r.integers(0, len(stream) - n, simulated)[:, None] + np.arange(n)], which)
        drawn = statistics(symbols[r.integers(0, len(symbols), (simulated // 4, n))], which)
        spread = np.cov(words[:half].T) + np.cov(drawn.T) + 1e-9 * np.eye(words.shape[1])
        weights = np.linalg.solve(spread, drawn.mean(axis=0) - words[:half].mean(axis=0))
        yield n, weights, np.sort(words[half:] @ weights)


@dataclass
class Null:
    """P-values of one encoding and length: some scores with the shares of ordinary strings above them, and the tail."""

    weights: np.ndarray
    scores: np.ndarray
    shares: np.ndarray
    scale: float

    @classmethod
    def of(cls, weights: np.ndarray, scores: np.ndarray) -> Null:
        n = len(scores)
        tail = max(2, int(TAIL * n))
        keep = np.unique(np.concatenate([np.linspace(0, n - 1 - tail, KEPT).astype(np.int64), np.arange(max(0, n - 5 * tail), n - tail)]))
        edge = scores[keep[-1]]
        return cls(weights, scores[keep], (n - keep + 1) / (n + 1), max(float((scores[n - tail :] - edge).mean()), 1e-9))

    def p(self, score: float) -> float:
        if score <= self.scores[-1]:
            i = int(np.searchsorted(self.scores, score, side="right")) - 1
            return float(self.shares[i]) if i >= 0 else 1.0
        return max(float(self.shares[-1]) * math.exp(-(score - self.scores[-1]) / self.scale), LEAST_P)


#: The nulls by number of the encoding and length.
Nulls = dict[tuple[int, int], Null]


def nulls_of(counts: np.ndarray, simulated: int = SIMULATED) -> Nulls:
    letters = Letters(counts)
    return {(which, n): Null.of(weights, scores) for which in range(len(ENCODINGS)) for n, weights, scores in simulate(which, letters, simulated)}


def battery(s: str, nulls: Nulls) -> tuple[int, float] | None:
    """(encoding, p): the chance that an ordinary string of this encoding and length looks so random; none if no encoding fits."""
    which = encoding(s)
    x = np.frombuffer(s.rstrip("=").encode(), dtype=np.uint8)
    if which is None or len(x) < GRID[0]:
        return None
    null = nulls[which, max(g for g in GRID if g <= len(x))]
    return which, null.p(float(statistics(x[None, :], which)[0] @ null.weights))


def trigrams(words: list[bytes]) -> np.ndarray:
    """Counts for Letters of lower-case words; plain, for small lists."""
    out = np.zeros((27, 27, 27))
    for w in words:
        v = [0, 0, *(c - 96 for c in w), 0]
        for a, b, c in zip(v, v[1:], v[2:], strict=False):
            out[a, b, c] += 1
    return out


def count_trigrams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Counts for Letters of the words, ASCII letters of either case, at these places."""
    size = ends - starts
    # Words one after another, each followed by its edge and the first one led by two.
    first = np.cumsum(size + 1) - (size + 1) + 2
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    code = np.zeros(int((size + 1).sum()) + 2, dtype=np.int64)
    code[np.repeat(first, size) + at] = (data[np.repeat(starts, size) + at] | 32) - 96
    b = code[1:-1]
    a = np.where(b > 0, code[:-2], 0)
    return np.bincount(a * 729 + b * 27 + code[2:], minlength=27**3)
