"""Text quality by a byte-level convolutional network in numpy.

Learned filters slide over the bytes of overlapping chunks that together cover the whole text. Each filter is
rectified and max-pooled over a chunk; a linear layer turns the pooled values into a chunk's log-odds; their
mean over the chunks, each counted by its length, gives the probability of the text. Bytes enter one-hot, so a filter
is one weight for each offset and byte value.

Null and empty texts are one chunk of padding and get a score like any other text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.labelled import training_sample
from tablewright.llm.shared import held_out, id_and_text, keep_texts, map_texts

FILTERS, WIDTH = 16, 6
CHUNK, OVERLAP = 1024, 128
EPOCHS, RATE, BATCH, DRAWS = 14, 0.01, 64, 2
#: bytes that one step of the scorer works on
BLOCK = 1 << 17


def chunk_bounds(n: int) -> list[tuple[int, int]]:
    """Overlapping chunks of one size, the last one ending with the text."""
    if n <= CHUNK:
        return [(0, n)]
    starts = list(range(0, n - CHUNK, CHUNK - OVERLAP)) + [n - CHUNK]
    return [(a, a + CHUNK) for a in starts]


def padded(data: bytes) -> bytes:
    """At least one place for a filter; texts begin and end with a zero byte."""
    return b"\0" + data + b"\0" * max(1, WIDTH - 1 - len(data))


@dataclass
class Model:
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    shift: np.ndarray
    weights: np.ndarray
    bias: float

    def pair_tables(self) -> list[np.ndarray]:
        """Two neighbouring offsets in one table of 65536 rows: half as many look-ups."""
        f = self.filters
        return [(f[k][:, None, :] + f[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, WIDTH, 2)]

    def scorer(self):
        tables = self.pair_tables()

        def pooled(chunks: list[bytes]) -> np.ndarray:
            sizes = np.array([len(c) - WIDTH + 1 for c in chunks])
            data = np.frombuffer(b"".join(chunks), np.uint8).astype(np.int32)
            pairs = data[:-1] * 256 + data[1:]
            n = len(data) - WIDTH + 1
            sums = tables[0][pairs[:n]]
            for k in range(1, len(tables)):
                sums += tables[k][pairs[2 * k:2 * k + n]]
            # places that run over a chunk's end are left out by the bounds of the segments
            start = np.concatenate([[0], np.cumsum([len(c) for c in chunks])[:-1]])
            edges = np.stack([start, start + sizes], 1).ravel()
            if edges[-1] == n:
                edges = edges[:-1]
            return np.maximum(np.maximum.reduceat(sums, edges, axis=0)[::2] + self.shift, 0)

        def log_odds(texts: list) -> np.ndarray:
            total, length = np.zeros(len(texts)), np.zeros(len(texts))
            chunks, owner, size = [], [], 0

            def flush():
                nonlocal chunks, owner, size
                if chunks:
                    odds = pooled(chunks) @ self.weights + self.bias
                    n = np.array([len(c) for c in chunks])
                    np.add.at(total, owner, odds * n)
                    np.add.at(length, owner, n)
                chunks, owner, size = [], [], 0

            for i, text in enumerate(texts):
                data = padded((text or "").encode("utf-8", "surrogatepass"))
                for a, b in chunk_bounds(len(data)):
                    chunks.append(data[a:b])
                    owner.append(i)
                    size += b - a
                    if size >= BLOCK:
                        flush()
            flush()
            return total / length

        def scores(texts: list) -> list[float]:
            return (1 / (1 + np.exp(-np.clip(log_odds(texts), -30, 30)))).tolist() if texts else []

        scores.log_odds = log_odds
        return scores


def fit(texts: list[str], labels: list[int], seed: int = 11) -> Model:
    """Adam on the log loss of single chunks with both classes weighted alike; a new draw of chunks in every epoch."""
    rng = np.random.default_rng(seed)
    y_all = np.asarray(labels, np.float64)
    if len(set(labels)) < 2:
        rate = 0.5 if not labels else 0.01 + 0.98 * labels[0]
        return Model(np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros(FILTERS, np.float32),
                     np.zeros(FILTERS, np.float32), float(np.log(rate / (1 - rate))))
    data = [padded(t.encode("utf-8", "surrogatepass")) for t in texts]
    bounds = [chunk_bounds(len(d)) for d in data]
    balance = np.where(y_all == 1, 0.5 / y_all.mean(), 0.5 / (1 - y_all.mean()))
    weights = {"filters": rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32),
               "shift": np.zeros(FILTERS, np.float32), "weights": rng.normal(0, 0.3, FILTERS).astype(np.float32),
               "bias": np.zeros(1, np.float32)}
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    step = 0
    for epoch in range(EPOCHS):
        picks = np.concatenate([rng.permutation(len(data)) for _ in range(DRAWS)])
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        for at in range(0, len(picks), BATCH):
            docs = picks[at:at + BATCH]
            chunks = []
            for i in docs:
                a, b = bounds[i][rng.integers(len(bounds[i]))]
                chunks.append(np.frombuffer(data[i][a:b], np.uint8))
            size = max(map(len, chunks))
            block = np.zeros((len(chunks), size), np.int64)
            last = np.array([len(c) - WIDTH + 1 for c in chunks])
            for r, c in enumerate(chunks):
                block[r, :len(c)] = c
            tables = Model(weights["filters"], None, None, 0.0).pair_tables()
            pairs = block[:, :-1] * 256 + block[:, 1:]
            n = size - WIDTH + 1
            sums = sum(t[pairs[:, 2 * k:2 * k + n]] for k, t in enumerate(tables))
            sums[np.arange(n)[None, :] >= last[:, None]] = -1e9
            top = sums.argmax(1)
            high = np.take_along_axis(sums, top[:, None, :], 1)[:, 0] + weights["shift"]
            pool = np.maximum(high, 0)
            p = 1 / (1 + np.exp(-np.clip(pool @ weights["weights"] + weights["bias"][0], -30, 30)))
            d = (balance[docs] * (p - y_all[docs]) / len(docs)).astype(np.float32)
            g_high = d[:, None] * weights["weights"] * (high > 0)
            grad = {"weights": pool.T @ d + 1e-4 * weights["weights"], "bias": np.array([d.sum()]), "shift": g_high.sum(0),
                    "filters": np.zeros_like(weights["filters"])}
            rows, filters = np.arange(len(docs))[:, None], np.arange(FILTERS)[None, :]
            for k in range(WIDTH):
                np.add.at(grad["filters"][k], (block[rows, top + k], np.broadcast_to(filters, top.shape)), g_high)
            step += 1
            for name, g in grad.items():
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.001 * (g * g - second[name])
                weights[name] -= (rate * (first[name] / (1 - 0.9 ** step))
                                  / (np.sqrt(second[name] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return Model(weights["filters"], weights["shift"], weights["weights"], float(weights["bias"][0]))


def quality_model(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1) -> Model:
    """Fitted on a bounded sample of the labelled rows that are not held out."""
    return fit(*training_sample(docs, labels, "quality", modulus, remainder))


def quality_scores(docs: DataFrame, model: Model, modulus: int = 3, remainder: int = 1, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def make():
        scores = model.scorer()
        return lambda texts: {"score": scores(texts)}

    scored = map_texts(id_and_text(docs, id_col, text_col), make, "score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_likely_good(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The documents that score at least the limit, with all their columns."""

    def make():
        scores = model.scorer()
        return lambda texts: [p >= limit for p in scores(texts)]

    return keep_texts(docs, make, text_col)
