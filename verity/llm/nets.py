"""What the two numpy networks share: words as ids, Adam, temperature and thresholds."""

from __future__ import annotations

import re
import zlib

import numpy as np

WORD = re.compile(r"\w+|[^\w\s]+")
#: Words that a task remembers before its memory starts anew.
REMEMBERED = 150_000


class HashedIds(dict):
    """Word to bucket; remembers what it hashed."""

    def __init__(self, buckets: int, salt: bytes = b"", chars: int | None = None):
        super().__init__()
        self.buckets, self.salt, self.chars = buckets, salt, chars

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        key = word if self.chars is None else word[: self.chars]
        self[word] = found = zlib.crc32(self.salt + key.encode("utf-8", "surrogatepass")) % self.buckets
        return found

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


class Adam:
    def __init__(self, params: list[np.ndarray], rate: float = 0.01):
        self.params, self.rate, self.t = params, rate, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= scale * m / (np.sqrt(v) + 1e-8)


def temperature(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The T that gives sigmoid(logit / T) the least weighted log loss."""
    if not len(logits) or len(set(labels.tolist())) < 2:
        return 1.0
    grid = np.exp(np.linspace(-2, 2, 81))

    def loss(t: float) -> float:
        p = np.clip(sigmoid(logits / t), 1e-9, 1 - 1e-9)
        return float(-(weights * (labels * np.log(p) + (1 - labels) * np.log(1 - p))).sum())

    return float(min(grid, key=loss))


def best_threshold(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray, default: float = 0.5) -> float:
    """The cut of best weighted F1, in the middle between two scores."""
    if not len(scores) or not labels.any():
        return default
    order = np.argsort(-scores, kind="stable")
    s, y, w = scores[order], labels[order], weights[order]
    hits, taken = np.cumsum(w * y), np.cumsum(w)
    f1 = 2 * hits / (taken + (w * y).sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(f1.argmax())
    return float((s[k] + s[k + 1]) / 2 if k + 1 < len(s) else s[k] / 2)


def recentre(scores: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Stretch each score so that its cut comes to lie at one half; order on a side stays."""
    cuts = np.clip(cuts, 1e-6, 1 - 1e-6)
    return np.where(scores < cuts, 0.5 * scores / cuts, 0.5 + 0.5 * (scores - cuts) / (1 - cuts))
