"""Toxicity from subword bags.

A word is the mean of the vectors of its character n-grams (and of the word itself), all hashed to one table; a
window of words is the mean of its words, and a linear softmax over that mean gives the two class scores. Vectors
and softmax are learned together in numpy. Misspellings that were never seen share most n-grams with words
that were. A window is one word as long as ``WINDOW`` is 1, so nothing is averaged over words: the most toxic word
decides, phrases of ordinary words are not seen, and false alarms grow with the length. A logistic line fitted on the
training documents turns its margin into a probability.

Null, empty and white-space texts have no window and get the score of the lowest margin, close to 0.
"""

from __future__ import annotations

import string
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.labelled import training_sample
from tablewright.llm.shared import CHARS_A_WORD, held_out, id_and_text, keep_texts, map_texts

BUCKETS, DIM, GRAMS = 1 << 17, 8, (3, 4, 5)
# one word a window: on the test tables windows of 2 and 3 words gave 5 to 10 times as many false alarms
WINDOW, EPOCHS, RATE, BATCH = 1, 6, 0.1, 2048
#: rarely seen word types that take part in learning, and words whose margin a task remembers
RARE_TYPES, CACHE = 60_000, 400_000
#: characters whose n-grams are hashed at a time, unless a single word has more
PART_CHARS = 400_000
LOWEST = -12.0
_edges = string.punctuation + "\u2018\u2019\u201c\u201d\u00ab\u00bb"


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of the word) of every n-gram of every word, and of each whole word, by word."""
    plain = [b"<" + w.lower().strip(_edges).encode("utf-8", "surrogatepass") + b">" for w in words]
    sizes = np.fromiter(map(len, plain), np.int64, len(plain))
    data = np.frombuffer(b"".join(plain), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(plain)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))  # bytes up to the end of the word
    ids = [np.fromiter(map(zlib.crc32, plain), np.uint64, len(plain)) % np.uint64(BUCKETS)]
    owners = [np.arange(len(plain))]
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = (h + data[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        ids.append(h % np.uint64(BUCKETS))
        owners.append(owner[at])
    ids, owners = np.concatenate(ids).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return ids[order], owners[order]


@dataclass
class Model:
    table: np.ndarray  # by bucket: what a gram adds to the margin of class 1, its vector times the softmax weights
    bias: float
    slope: float
    offset: float

    def word_margins(self, words: list[str]) -> np.ndarray:
        ids, owners = word_grams(words)
        counts = np.bincount(owners, minlength=len(words))
        return np.bincount(owners, weights=self.table[ids], minlength=len(words)) / np.maximum(counts, 1) + self.bias

    def scorer(self):
        """A function of a list of texts; it remembers the margins of a bounded number of words."""
        known: dict[str, float] = {}
        held = [0]  # characters of the known words

        def margins(texts: list) -> np.ndarray:
            split = [(t or "").split() for t in texts]
            fresh = list({w for words in split for w in words if w not in known})
            held[0] += sum(map(len, fresh))
            if len(known) + len(fresh) > CACHE or held[0] > CACHE * CHARS_A_WORD:
                known.clear()
                fresh = list({w for words in split for w in words})
                held[0] = sum(map(len, fresh))
            at = 0
            while at < len(fresh):
                end, chars = at, 0
                while end < len(fresh) and end < at + 20_000 and (end == at or chars + len(fresh[end]) <= PART_CHARS):
                    chars += len(fresh[end])
                    end += 1
                part, at = fresh[at:end], end
                known.update(zip(part, self.word_margins(part).tolist()))
            out = np.full(len(texts), LOWEST)
            for k, words in enumerate(split):
                if words:
                    v = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
                    total = np.concatenate([[0.0], np.cumsum(v)])
                    size = min(WINDOW, len(words))
                    # a window that is shorter than WINDOW is averaged over the words it has
                    out[k] = max(LOWEST, ((total[size:] - total[:-size]) / size).max())
            return out

        def scores(texts: list) -> list[float]:
            z = np.clip(self.slope * margins(texts) + self.offset, -30, 30)
            return (1.0 / (1.0 + np.exp(-z))).tolist()

        scores.margins = margins
        return scores


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Line a·x + b of a one-dimensional logistic fit with balanced classes and a small ridge, by Newton steps."""
    mean, spread = x.mean(), x.std() or 1.0
    u = np.stack([(x - mean) / spread, np.ones_like(x)], 1)
    share = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    w = np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(u @ w, -30, 30)))
        grad = u.T @ (share * (p - y)) + 0.1 * w
        hess = (u * (share * p * (1 - p))[:, None]).T @ u + 0.1 * np.eye(2)
        w -= np.linalg.solve(hess, grad)
    return float(w[0] / spread), float(w[1] - w[0] * mean / spread)


def fit(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Vectors and softmax from the words of toxic and of clean texts.

    Every word type is an example of both classes, weighted by the number of texts of each class it is in: words
    that all texts share end at an even margin, words of toxic texts alone far above it.
    """
    y = np.asarray(labels, np.int64)
    if len(set(labels)) < 2:
        rate = 0.5 if not labels else 0.01 + 0.98 * labels[0]
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, float(np.log(rate / (1 - rate))))
    rng = np.random.default_rng(seed)
    aside = rng.random(len(texts)) < 0.4  # words of these are not learned, so their margins are those of new texts
    if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
        aside = np.zeros(len(texts), bool)
    seen: dict[str, list[int]] = {}
    for text, label in ((t, k) for t, k, a in zip(texts, labels, aside) if not a):
        for w in set(text.split()):
            seen.setdefault(w, [0, 0])[label] += 1
    often = [w for w, c in seen.items() if c[0] + c[1] > 1]
    once = [w for w, c in seen.items() if c[0] + c[1] == 1]
    words = often + [once[i] for i in rng.permutation(len(once))[:RARE_TYPES]]
    counts = np.array([seen[w] for w in words], np.float64)
    share = counts / np.maximum(1, np.bincount(y[~aside], minlength=2))  # the share of the texts of each class with the word
    # two texts of either class are added, so that words of a few texts, which may be there by chance, stay near even
    n = share * (~aside).sum() / 2
    weight = np.sqrt(n.sum(1, keepdims=True)) * (n + 2) / (n.sum(1, keepdims=True) + 4)
    ids, owners = word_grams(words)
    begin = np.searchsorted(owners, np.arange(len(words) + 1))
    table = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    soft = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen_t, seen_s = np.full((BUCKETS, 1), 1e-6, np.float32), np.full_like(soft, 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(words))
        for at in range(0, len(order), BATCH):
            batch = order[at:at + BATCH]
            sizes = begin[batch + 1] - begin[batch]
            start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            flat = ids[np.repeat(begin[batch] - start, sizes) + np.arange(sizes.sum())]
            mean = np.add.reduceat(table[flat], start, axis=0) / sizes[:, None]
            logits = mean @ soft + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = (p * weight[batch].sum(1, keepdims=True) - weight[batch]).astype(np.float32)
            g_soft, g_mean = mean.T @ d, d @ soft.T
            rows, back = np.unique(flat, return_inverse=True)
            g_rows = np.repeat(g_mean / sizes[:, None], sizes, axis=0)
            g_table = np.stack([np.bincount(back, weights=g_rows[:, k], minlength=len(rows)) for k in range(DIM)], 1)
            seen_t[rows] += (g_table ** 2).mean(1, keepdims=True)
            table[rows] -= (RATE * g_table / np.sqrt(seen_t[rows])).astype(np.float32)
            seen_s += g_soft ** 2
            soft -= RATE * g_soft / np.sqrt(seen_s)
            bias -= RATE * d.mean(0)
    line = soft[:, 1] - soft[:, 0]
    model = Model((table @ line).astype(np.float32), float(bias[1] - bias[0]), 1.0, 0.0)
    fresh = aside if aside.any() else ~aside
    model.slope, model.offset = _logistic(
        model.scorer().margins([t for t, a in zip(texts, fresh) if a]), y[fresh].astype(float))
    return model


def toxicity_model(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0) -> Model:
    """Fitted on a bounded sample of the labelled rows that are not held out."""
    return fit(*training_sample(docs, labels, "toxic", modulus, remainder))


def toxicity_scores(docs: DataFrame, model: Model, modulus: int = 5, remainder: int = 0, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def make():
        scores = model.scorer()
        return lambda texts: {"score": scores(texts)}

    scored = map_texts(id_and_text(docs, id_col, text_col), make, "score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The documents that score below the limit, with all their columns."""

    def make():
        scores = model.scorer()
        return lambda texts: [p < limit for p in scores(texts)]

    return keep_texts(docs, make, text_col)
