"""The arithmetic of a hashed maximum-entropy model whose softmax is factored by classes, on batches of token codes.

A code says what a token is: of the ``frequent`` words (the end of a text among them) each has its
own, and with them a class of ``width`` words; any other word is of one of ``rare`` classes by its
last two bytes, and its code has a hash of the word beside. A history's features are hashes of the
last word, the last two, and the words two and three back: each is a row of a table of weights, and
the rows of a history add up to the scores of the classes, or of the words in a frequent class.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Codes before a text's first token; tokens whose arrays fit a core's cache; tokens that Sums adds up at once; and how large scores may get before their exponentials leave float32.
BACK = 3
PIECE, TOGETHER, LARGEST = 8192, 32_768, 80.0
#: Features of a history: which codes before the token, by how far back.
CLASS_FEATURES = ((1,), (1, 2), (2,), (3,))
WORD_FEATURES = ((1,), (2,))
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


@dataclass(frozen=True)
class Shape:
    """How many frequent words, words of a frequent class and rare classes there are, and bits of the tables' rows."""

    frequent: int = 1024
    width: int = 64
    rare: int = 16
    class_bits: int = 14
    word_bits: int = 13

    @property
    def frequent_classes(self) -> int:
        return -(-self.frequent // self.width)

    @property
    def classes(self) -> int:
        return self.frequent_classes + self.rare


class Codes(dict):
    """Codes by word (bytes): of the frequent words, of common ones (their place above that of all frequent, see place_of), and of others, made as they come and kept, at most a million."""

    def __init__(self, shape: Shape, frequent: list[bytes], common: list[bytes]):
        super().__init__(zip(frequent, range(len(frequent)), strict=True))
        self.update((w, shape.frequent + rare_class(w, shape.rare) + shape.rare * i) for i, w in enumerate(common))
        self.shape, self.own, self.first = shape, dict(self), len(common)

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
            self.update(self.own)
        code = self[word] = self.shape.frequent + rare_class(word, self.shape.rare) + self.shape.rare * (self.first + zlib.crc32(word))
        return code


def place_of(codes: np.ndarray, shape: Shape) -> np.ndarray:
    """Of codes of words that are not frequent: the place among the common words; beyond their number for others."""
    return (codes - shape.frequent) // shape.rare


def rare_class(word: bytes, rare: int) -> int:
    return zlib.crc32(word[-2:]) % rare


@dataclass
class Weights:
    """Scores by hashed row: class_rows (rows x classes), word_rows (rows x width); and without any feature: class_bias, word_bias (frequent classes x width, -inf where there is no word)."""

    class_rows: np.ndarray
    word_rows: np.ndarray
    class_bias: np.ndarray
    word_bias: np.ndarray

    def small(self) -> tuple[bool, bool]:
        """Whether no history's scores of classes, and of words, go so far from 0 that their exponentials leave float32."""
        far = lambda rows, features, bias: len(features) * np.abs(rows).max() + np.abs(bias[np.isfinite(bias)]).max(initial=0) < LARGEST
        return far(self.class_rows, CLASS_FEATURES, self.class_bias), far(self.word_rows, WORD_FEATURES, self.word_bias)


def start(shape: Shape, counts: np.ndarray, rare_mass: np.ndarray) -> Weights:
    """No feature says anything yet: words are as likely as their counts. counts: of the frequent words, in their order; rare_mass: what the words of each rare class weigh together."""
    word = np.full(shape.frequent_classes * shape.width, -np.inf)
    word[: len(counts)] = np.log(counts)
    word = word.reshape(shape.frequent_classes, shape.width)
    mass = np.concatenate([np.exp(word).sum(1), rare_mass])
    with np.errstate(divide="ignore"):
        class_bias = np.log(mass) - np.log(mass.sum())
        word -= np.where(np.isneginf(word).all(1), 0, np.log(np.exp(word).sum(1)))[:, None]
    return Weights(np.zeros((1 << shape.class_bits, shape.classes), np.float32), np.zeros((1 << shape.word_bits, shape.width), np.float32), class_bias.astype(np.float32), word.astype(np.float32))


def classes_of(codes: np.ndarray, shape: Shape) -> np.ndarray:
    return np.where(codes < shape.frequent, codes // shape.width, shape.frequent_classes + (codes - shape.frequent) % shape.rare)


def rows_of(codes: np.ndarray, at: np.ndarray, back: tuple[int, ...], tag: int, bits: int, also: np.ndarray | None = None) -> np.ndarray:
    """The row that the codes ``back`` before each place hash to."""
    x = np.full(len(at), tag + 1, np.uint64) if also is None else also.astype(np.uint64) + np.uint64(tag << 20)
    for far in back:
        x = (x ^ (x >> np.uint64(29))) * _SPREAD[0] + codes[at - far].astype(np.uint64) * _SPREAD[far]
    x ^= x >> np.uint64(31)
    return ((x * _SPREAD[1]) >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.int64)


def _softmax(scores: np.ndarray, hit: np.ndarray, parts: bool, small: bool) -> np.ndarray:
    """Natural log of the hits' probability; scores become the probabilities if ``parts``. Scores that are not ``small`` are taken from the largest."""
    if not small:
        scores -= scores.max(1, keepdims=True)
    of = scores[np.arange(len(hit)), hit]
    np.exp(scores, out=scores)
    total = scores @ np.ones(scores.shape[1], scores.dtype)
    if parts:
        scores /= total[:, None]
    return of - np.log(total)


def _scores(table: np.ndarray, bias: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    out = np.take(table, rows[0], axis=0)
    for r in rows[1:]:
        out += np.take(table, r, axis=0)
    out += bias
    return out


def pieces(codes: np.ndarray, at: np.ndarray, w: Weights, shape: Shape, parts: bool = False) -> Iterator[tuple[np.ndarray, list]]:
    """batch() of PIECE places at a time."""
    small = w.small()
    for i in range(0, len(at), PIECE):
        yield batch(codes, at[i : i + PIECE], w, shape, parts, small)


def batch(codes: np.ndarray, at: np.ndarray, w: Weights, shape: Shape, parts: bool = False, small: tuple[bool, bool] = (False, False)) -> tuple[np.ndarray, list]:
    """Natural log of each token's probability, given its history, but for which of the words of a rare class it is; and, if asked for, the parts that Sums.add() needs.

    codes: int64, with BACK codes before a text; at: places of the tokens; small: as the weights say it.
    """
    of = codes[at]
    cls = classes_of(of, shape)
    rows = [rows_of(codes, at, back, i, shape.class_bits) for i, back in enumerate(CLASS_FEATURES)]
    p = _scores(w.class_rows, w.class_bias, rows)
    log = _softmax(p, cls, parts, small[0]).astype(float)
    own = np.flatnonzero(of < shape.frequent)
    in_class = of[own] % shape.width
    word_rows = [rows_of(codes, at[own], back, i, shape.word_bits, cls[own]) for i, back in enumerate(WORD_FEATURES)]
    q = _scores(w.word_rows, w.word_bias[cls[own]], word_rows)
    log[own] += _softmax(q, in_class, parts, small[1])
    return log, [(rows, p, cls), (word_rows, q, in_class)]


class Sums:
    """How often each row's outcomes were there, and how often they were expected: the two halves of the gradient. Batches of PIECE tokens at most wait until there are about TOGETHER tokens."""

    def __init__(self, w: Weights):
        tables = (w.class_rows, w.word_rows)
        self._seen = [np.zeros(t.shape) for t in tables]
        self._expected = [np.zeros(t.shape[::-1]) for t in tables]
        self._outcomes = [np.empty((t.shape[1], TOGETHER + PIECE)) for t in tables]
        self._waiting: list[list] = [[], []]
        self._n = [0, 0]
        self.tokens = 0

    @property
    def seen(self) -> list[np.ndarray]:
        self._flush()
        return self._seen

    @property
    def expected(self) -> list[np.ndarray]:
        self._flush()
        return [np.ascontiguousarray(t.T) for t in self._expected]

    def add(self, parts: list) -> None:
        self.tokens += len(parts[0][2])
        for i, (rows, p, hit) in enumerate(parts):
            self._outcomes[i][:, self._n[i] : self._n[i] + len(hit)] = p.T
            self._waiting[i].append((rows, hit))
            self._n[i] += len(hit)
        if max(self._n) >= TOGETHER:
            self._flush()

    def _flush(self) -> None:
        for i, waiting in enumerate(self._waiting):
            n, seen, expected = self._n[i], self._seen[i], self._expected[i]
            if n:
                hit = np.concatenate([h for _, h in waiting])
                for of_feature in zip(*[rows for rows, _ in waiting], strict=True):
                    at = np.concatenate(of_feature).astype(np.intp)
                    np.add.at(seen.reshape(-1), at * seen.shape[1] + hit, 1.0)
                    for one, total in zip(self._outcomes[i], expected, strict=True):
                        total += np.bincount(at, one[:n], len(total))
            self._waiting[i], self._n[i] = [], 0


def moved(table: np.ndarray, seen: np.ndarray, expected: np.ndarray, rate: float, prior: float) -> np.ndarray:
    """table a step up the gradient seen - expected, each weight's scaled by the logarithmic mean of the two, which is log(seen / expected)."""
    return (table + rate * np.log((seen + prior) / (expected + prior))).astype(np.float32)
