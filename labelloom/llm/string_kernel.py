"""Gap-weighted subsequence kernel over words, Nyström features of it, and a linear support vector machine on these.

The numpy half of toxicity scoring. Two words are alike as far as they share subsequences of letters; a subsequence
spread over a longer span weighs less, so an insult with inserted characters stays near the insult. Subsequences are
hashed into ``2 ** BITS`` places, and the kernel is the inner product over the places, so a machine over landmarks
folds into one weight for every place: a word is scored without going through the landmarks again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np

# (letters of a subsequence, longest span): spans above the number of letters allow gaps.
ORDERS = ((3, 6), (4, 7))
# Weight of one character of span.
DECAY = 0.85
BITS = 20
# Longer words are seen through overlapping windows of this many characters.
WINDOW = 32
START, END = "\x02", "\x03"
# Rows of the training matrix that are worked on together.
BLOCK = 2_048


def _paths(letters: int, span: int) -> list[tuple[int, ...]]:
    """Offsets of all subsequences that begin at 0 and end within the span."""
    return [(0, *rest) for rest in combinations(range(1, span), letters - 1)]


PATHS = [path for letters, span in ORDERS for path in _paths(letters, span)]


def marked(word: str) -> list[str]:
    """The word between marks of its start and end; a long one as windows that overlap by half."""
    word = START + word + END
    if len(word) <= WINDOW:
        return [word]
    return [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def readings(word: str) -> list[str]:
    """What of a word is scored: the word, and its letters and digits alone if other characters stand between them."""
    return marked(word) if word.isalnum() else marked(word) + marked("".join(filter(str.isalnum, word)))


def _each_path(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """``(places, weight)`` of the subsequences along each path, ``(starts, words)``, for words of one length.

    Paths that begin alike share the hashes of their beginning. A row per start, so that a shorter path's part of a
    table is one stretch of memory.
    """
    length = len(codes)
    known = {(0,): (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)}

    def hashed(path: tuple[int, ...]) -> np.ndarray:
        if path not in known:
            starts = length - path[-1]
            h = hashed(path[:-1])[:starts] ^ codes[path[-1] : path[-1] + starts]
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            known[path] = h
        return known[path]

    for path in PATHS:
        if length > path[-1]:
            yield (hashed(path) >> np.uint64(64 - BITS)).view(np.int64), DECAY ** (path[-1] + 1)


def _coded(words: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(indices, code points)`` of the words of each length, a row per character, in blocks that bound the memory of one step."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        for i in range(0, len(at), 4_096):
            part = at[i : i + 4_096]
            raw = "".join([words[j] for j in part.tolist()]).encode("utf-32-le", "surrogatepass")
            yield part, np.ascontiguousarray(np.frombuffer(raw, np.uint32).reshape(len(part), n).T, np.uint64)


def _by_length(words: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(indices, places, weights)`` for the words of each length; weights have unit norm."""
    for part, codes in _coded(words):
        found = list(_each_path(codes))
        places = np.ascontiguousarray(np.concatenate([p for p, _ in found]).T, np.int32) if found else np.zeros((len(part), 0), np.int32)
        weights = np.concatenate([np.full(len(p), w) for p, w in found]) if found else np.zeros(0)
        norm = np.sqrt((weights**2).sum())
        yield part, places, weights / norm if norm else weights


def features(words: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse feature vector of each marked word, as places and values."""
    out: list = [None] * len(words)
    for part, places, weights in _by_length(words):
        for j, p in zip(part, places):
            unique, inverse = np.unique(p, return_inverse=True)
            out[j] = (unique, np.bincount(inverse, weights, len(unique)))
    return out


def scores(words: Sequence[str], weight: np.ndarray, bias: float) -> np.ndarray:
    """Margin of each word under one weight for every place: the largest of its readings and windows."""
    flat, more = [START + w + END for w in words], []
    for i, w in enumerate(words):
        if len(w) > WINDOW - 2 or not w.isalnum():
            flat[i], *others = readings(w)
            more += [(i, p) for p in others]
    flat += [p for _, p in more]
    out = np.empty(len(flat))
    for part, codes in _coded(flat):
        total, square = np.zeros(len(part)), 0.0
        for places, w in _each_path(codes):
            # a word's terms in one stretch: the order of the sum decides its last bits, and these may decide a label
            total += w * np.ascontiguousarray(weight.take(places).T).sum(axis=1)
            square += w * w * len(places)
        out[part] = total / np.sqrt(square) + bias if square else bias
    np.maximum.at(out, np.array([i for i, _ in more], np.int64), out[len(words) :])
    return out[: len(words)]


def gram(words: Sequence[str], landmarks: Sequence[str], root: np.ndarray | None = None) -> np.ndarray:
    """Kernel of each word with each landmark; with ``root`` its product with that, in single precision and block by block."""
    marks = features(landmarks)
    used = np.unique(np.concatenate([p for p, _ in marks])) if marks else np.zeros(0, np.int32)
    # a row per place that a landmark has, and one of zeros for all others
    table = np.zeros((len(used) + 1, len(landmarks)), np.float32)
    for i, (places, values) in enumerate(marks):
        table[np.searchsorted(used, places), i] = values
    row = np.full(1 << BITS, len(used), np.int32)
    row[used] = np.arange(len(used))
    width = len(landmarks) if root is None else root.shape[1]
    out = np.zeros((len(words), width), float if root is None else np.float32)
    for part, places, weights in _by_length(words):
        here = np.empty((len(part), len(landmarks)))
        for j, p in enumerate(places):
            here[j] = weights @ table[row[p]]
        out[part] = here if root is None else here @ root
    return out


class Nystrom:
    """Features whose inner product is the kernel as the landmarks see it: ``K(x, L) K(L, L)^-1/2``."""

    def __init__(self, landmarks: Sequence[str], ridge: float = 1e-6):
        self.landmarks = list(landmarks)
        values, vectors = np.linalg.eigh(gram(self.landmarks, self.landmarks))
        kept = values > ridge * max(1.0, values.max(initial=0.0))
        self.root = vectors[:, kept] / np.sqrt(values[kept])

    def map(self, words: Sequence[str]) -> np.ndarray:
        return gram(words, self.landmarks, self.root)

    def fold(self, coefficients: np.ndarray) -> np.ndarray:
        """One weight for every place from coefficients of the features."""
        weight = np.zeros(1 << BITS, np.float32)
        for a, (places, values) in zip(self.root @ coefficients, features(self.landmarks)):
            weight[places] += (a * values).astype(np.float32)
        return weight


def train_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, steps: int = 50) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Newton steps; ``y`` is +1 or -1. Returns coefficients and bias.

    Rows are taken block by block: besides ``x`` only a block and matrices of the size of the coefficients are held.
    """
    n = x.shape[1] + 1
    w = np.zeros(n)
    penalty = np.eye(n)
    penalty[-1, -1] = 1e-6

    def slack(w: np.ndarray) -> np.ndarray:
        return 1 - y * np.concatenate([x[i : i + BLOCK].astype(float) @ w[:-1] + w[-1] for i in range(0, len(x), BLOCK)])

    def loss(w: np.ndarray, slack: np.ndarray) -> float:
        return 0.5 * w @ penalty @ w + c * (weight * np.maximum(0, slack) ** 2).sum()

    here = slack(w)
    for _ in range(steps):
        grad, hess = penalty @ w, penalty.copy()
        for i in range(0, len(x), BLOCK):
            at = i + np.flatnonzero(here[i : i + BLOCK] > 0)
            a = np.column_stack([x[at].astype(float), np.ones(len(at))])
            wa = 2 * c * weight[at]
            grad -= a.T @ (wa * y[at] * here[at])
            hess += (a.T * wa) @ a
        step = np.linalg.solve(hess, grad)
        rate, now = 1.0, loss(w, here)
        while rate > 1e-6 and loss(w - rate * step, slack(w - rate * step)) > now:
            rate /= 2
        w = w - rate * step
        here = slack(w)
        if np.abs(rate * step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 100) -> np.ndarray:
    """Coefficients (bias last) of a logistic regression with weighted rows, by Newton steps; targets are smoothed so that they stay finite."""
    ones = np.column_stack([x, np.ones(len(x))])
    pos, neg = (y == 1).sum(), (y == 0).sum()
    weight = weight / weight.mean()
    goal = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.zeros(ones.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(ones @ w, -30, 30)))
        grad = ones.T @ (weight * (p - goal)) + ridge * w
        hess = (ones.T * (weight * p * (1 - p) + 1e-9)) @ ones + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w
