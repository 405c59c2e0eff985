"""Quality rules with compression bands.

A text is compressed whole and in fixed chunks. Repetitive text compresses to far fewer bytes than prose of
its length, noise to far more; what counts as far depends on the length, because short texts hold little to
refer back to. The ratio of whole texts keeps falling slowly, so the floor of the last band falls by ``FALL`` with each doubling
down to ``LOWEST_FLOOR``. Beside the whole text and the chunks, equal blocks of at least ``BLOCK`` bytes are compressed on their own
(a shorter text is one block); all blocks together must lie in the band of a block's length, which sees repetition inside
blocks of texts of any length, while the whole ratio sees what repeats across them. All three hold at every length. Base rules on
words and repeated eight-word windows come first.

Null and empty texts have no words and fail the base rule. Rows with equal ids are judged one by one.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from tablewright.llm.shared import id_and_text, keep_texts, map_texts

LEVEL = 3
CHUNK = 2048
BLOCK = 65536
# lower end of a length class in bytes, lowest and highest ratio of compressed to raw bytes for whole texts
WHOLE_BANDS = [
    (0, 0.30, 1.80),
    (256, 0.57, 1.05),
    (362, 0.53, 0.85),
    (512, 0.51, 0.80),
    (724, 0.49, 0.76),
    (1024, 0.475, 0.72),
    (1448, 0.458, 0.69),
    (2048, 0.450, 0.67),
    (2896, 0.444, 0.65),
    (4096, 0.434, 0.63),
    (5793, 0.424, 0.61),
    (8192, 0.414, 0.60),
    (11585, 0.408, 0.60),
    (16384, 0.402, 0.60),
    (23170, 0.397, 0.60),
    (32768, 0.391, 0.60),
    (65536, 0.375, 0.60),
]
#: what the floor of the last band loses with each doubling of the length, and where that ends
FALL, LOWEST_FLOOR = 0.012, 0.345
CHUNK_BAND = (0.40, 0.70)
MAX_BAD_CHUNKS = 0.25
WINDOW, MIN_WORDS, MAX_REPEAT_PCT = 8, 20, 30

SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "whole_ratio double, block_ratio double, n_chunks long, n_bad_chunks long, kept boolean")
_symbols = re.compile(r"[#*$%&|<>]")


def repeated_words(words: list) -> int:
    """Words inside eight-word windows that occur at least twice; exact, by doubling ranks."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict = {}
    ranks = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    step = 1
    while step < WINDOW:
        pairs = ranks[:-step] * len(words) + ranks[step:]
        step *= 2
        ranks = np.unique(pairs, return_inverse=True)[1] if step < WINDOW else pairs
    _, inverse, counts = np.unique(ranks, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[WINDOW:WINDOW + n] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def band_of(n_bytes: int, bands: list) -> tuple:
    """Lowest and highest ratio of a text of this length."""
    start, low, high = bands[max(0, bisect_right([b[0] for b in bands], n_bytes) - 1)]
    if start == bands[-1][0] and n_bytes > start > 0:
        low = max(min(low, LOWEST_FLOOR), low - FALL * math.log2(n_bytes / start))
    return low, high


def judge(text: str | None, compress: Callable, bands: list, chunk_band: tuple, max_bad: float) -> tuple:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "surrogatepass"))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeats = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PCT * len(words)
    ratio = len(compress(data)) / len(data) if data else 0.0
    n_blocks = max(1, len(data) // BLOCK)
    ends = [len(data) * i // n_blocks for i in range(n_blocks + 1)]
    by_block = sum(len(compress(data[a:b])) for a, b in zip(ends, ends[1:])) / len(data) if n_blocks > 1 else ratio
    # equal chunks over the whole text, none shorter than half of the fixed size
    n_chunks = max(1, round(len(data) / CHUNK)) if data else 0
    cuts = [len(data) * i // n_chunks for i in range(n_chunks + 1)] if n_chunks > 1 else []
    bad = sum(not chunk_band[0] <= len(compress(data[a:b])) / (b - a) <= chunk_band[1] for a, b in zip(cuts, cuts[1:]))
    low, high = band_of(len(data), bands)
    block_low, block_high = band_of(BLOCK if n_blocks > 1 else len(data), bands)
    kept = not failed and low <= ratio <= high and block_low <= by_block <= block_high and bad <= max_bad * n_chunks
    return (len(words), chars, len(_symbols.findall(text or "")), len(lines) - len(set(lines)), repeats, failed, ratio,
            by_block, n_chunks, bad, kept)


def _judge_of(bands, chunk_band, max_bad):
    compress = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False).compress
    return lambda text: judge(text, compress, bands, chunk_band, max_bad)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: list = WHOLE_BANDS,
                  chunk_band: tuple = CHUNK_BAND, max_bad_chunks: float = MAX_BAD_CHUNKS) -> DataFrame:
    """One row per document with its counts, ratios and verdict."""
    names = [part.split()[0] for part in SCHEMA.split(", ")]

    def make():
        one = _judge_of(bands, chunk_band, max_bad_chunks)

        def score(texts):
            rows = [one(t) for t in texts]
            return {n: [r[i] for r in rows] for i, n in enumerate(names)}
        return score

    return map_texts(id_and_text(docs, id_col, text_col), make, SCHEMA)


def keep_good(docs: DataFrame, text_col: str = "text", bands: list = WHOLE_BANDS, chunk_band: tuple = CHUNK_BAND,
              max_bad_chunks: float = MAX_BAD_CHUNKS) -> DataFrame:
    """The documents that pass, with all their columns."""

    def make():
        one = _judge_of(bands, chunk_band, max_bad_chunks)
        return lambda texts: [one(t)[-1] for t in texts]

    return keep_texts(docs, make, text_col)
