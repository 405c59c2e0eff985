"""Stupid-backoff scores of documents under the n-gram counts of the whole corpus.

Counts are a table partitioned by n-gram hash. Documents are dealt into chunks; a chunk sends every n-gram it
holds once, with its count, to the partition of that n-gram. A partition adds up what all chunks sent and answers each
chunk with the totals in the order it asked, so the join of totals to the n-grams of the documents moves one
small number for each distinct n-gram of a chunk. The chunk then looks up every position and sums by document.
A frequent n-gram is one entry in each chunk, however often it occurs, so no partition runs hot. There are as many chunks as
the bytes of all texts ask for, however many partitions the input has, so a task's memory does not grow with the corpus.

The score of a word after its context is count(n-gram) / count(context) for the longest n-gram seen at least
``min_count`` times, times ``backoff`` for every order left out; at the end of the line count(word) / all words.
With ``min_count`` 2, the default, an n-gram that occurs once in the corpus is no evidence for the text it is in.

Words are runs of characters other than ASCII white space, case kept. N-grams do not cross documents. Null,
empty and white-space texts have no words: counts 0, sum 0, mean null. Rows with equal ids are scored one by one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tablewright.llm.shared import id_and_text

#: bigrams, as ``SQL`` has them; ``op10_lm_scoring_trigrams`` scores with ``TRIGRAMS``, as ``SQL_TRIGRAMS`` does
TRIGRAMS = 3
ORDER, BACKOFF, MIN_COUNT = 2, 0.4, 2
#: bytes of text in a chunk, about; what a task holds is some twenty times as much
CHUNK_BYTES = 12 << 20
#: characters of a text that are cut into words at once
PIECE = 1 << 20
SCHEMA = "n_words long, n_seen long, log_score double, mean_log_score double"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, piece by piece; a word that goes on in the next piece is kept for it."""
    rest = b""
    for at in range(0, len(text or ""), PIECE):
        piece = rest + text[at:at + PIECE].encode("utf-8", "surrogatepass")
        words, rest = piece.split(), b""
        if words and at + PIECE < len(text) and piece.endswith(words[-1]):
            rest = words.pop()
        yield words


def word_hashes(texts: Iterable) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of all texts in order, and the number of words of each text."""
    seen: dict[bytes, int] = {}
    parts, sizes = [], []
    for t in texts:
        n = 0
        for words in words_of(t):
            parts.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words)))
            n += len(words)
        sizes.append(n)
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, seen), np.uint64, len(seen))
    return table[np.concatenate(parts)] if parts and seen else np.zeros(0, np.uint64), np.array(sizes, np.int64)


def gram_hashes(words: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order k the hash of the k words that end at a place; 0 where the document has too few before it."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    grams = [_mix(words | np.uint64(1))]
    for k in range(2, order + 1):
        last = np.zeros(len(words), np.uint64)
        last[1:] = grams[-1][:-1]
        h = _mix(last * np.uint64(0x9E3779B97F4A7C15) + words + np.uint64(k)) | np.uint64(1)
        grams.append(np.where(place >= k - 1, h, np.uint64(0)))
    return grams


def distinct(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all orders, sorted, each once, and how often each occurs."""
    every = np.concatenate(grams)
    every.sort()
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    return every[first], np.diff(first, append=len(every)).astype("<u4")


def looked_up(grams: np.ndarray, keys: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The total of every n-gram in its place, 0 for none; keys are looked up in their order, which needs little memory."""
    order = np.argsort(grams)
    out = np.empty(len(grams))
    out[order] = totals[np.searchsorted(keys, grams[order])]
    out[grams == 0] = 0
    return out


def _bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range of hashes begins in sorted keys, and the end."""
    edges = [(i << 64) // buckets for i in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)]]).astype(np.int64)


def stupid_backoff(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, min_count: int = MIN_COUNT,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: words, words scored by a full-order n-gram, sum and mean of the log scores (4 and 6 decimals)."""
    source = id_and_text(docs, id_col, text_col)
    size = source.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first().n
    chunks = max(1, -(-(size or 0) // CHUNK_BYTES))
    # one exchange: the plan below reads it twice
    dealt = source.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    asked = to_arrow_schema(T.StructType.fromDDL("bucket int, chunk int, words long, keys binary, counts binary"))
    answer = to_arrow_schema(T.StructType.fromDDL("chunk int, bucket int, words long, totals binary"))
    out = T.StructType([source.schema["doc_id"]] + T.StructType.fromDDL(SCHEMA).fields)
    arrow = to_arrow_schema(out)

    def grams_of(table: pa.Table):
        words, sizes = word_hashes(t.as_py() for t in table.column("text"))
        return sizes, gram_hashes(words, sizes, order)

    def ask(table: pa.Table) -> pa.Table:
        sizes, grams = grams_of(table)
        keys, counts = distinct(grams)
        del grams
        at, chunk = _bounds(keys, chunks), table.column("chunk")[0].as_py()
        pack = zstandard.ZstdCompressor(level=1).compress
        return pa.Table.from_arrays([
            pa.array(np.arange(chunks), asked.field("bucket").type), pa.array(np.full(chunks, chunk), asked.field("chunk").type),
            pa.array(np.full(chunks, sizes.sum()), pa.int64()),
            pa.Array.from_buffers(pa.binary(), chunks, [None, pa.py_buffer((8 * at).astype("<i4")), pa.py_buffer(keys)]),
            pa.array([pack(counts[at[b]:at[b + 1]].tobytes()) for b in range(chunks)], pa.binary())], schema=asked)

    def add_up(table: pa.Table) -> pa.Table:
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        keys = [np.frombuffer(k.as_buffer(), "<u8") for k in table.column("keys")]
        ends = np.cumsum([len(k) for k in keys])
        keys = np.concatenate(keys)
        counts = np.concatenate([np.frombuffer(unpack(c.as_py()), "<u4") for c in table.column("counts")])
        place = np.argsort(keys)
        keys = keys[place]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        del keys
        sums = np.add.reduceat(counts[place], first, dtype="<u8") if len(first) else np.zeros(0, "<u8")
        totals = np.empty(len(place), "<u8")
        totals[place] = np.repeat(sums, np.diff(first, append=len(place)))
        words, starts = pc.sum(table.column("words")).as_py(), [0, *ends[:-1].tolist()]
        rows = [(c.as_py(), b.as_py(), words, pack(totals[s:e].tobytes()))
                for c, b, s, e in zip(table.column("chunk"), table.column("bucket"), starts, ends.tolist())]
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), answer)], schema=answer)

    def score(table: pa.Table, totals: pa.Table) -> pa.Table:
        if not table.num_rows:
            return arrow.empty_table()
        sizes, grams = grams_of(table)
        unpack = zstandard.ZstdDecompressor().decompress
        buckets = np.argsort(totals.column("bucket").to_numpy())
        every = np.concatenate([np.frombuffer(unpack(totals.column("totals")[b].as_py()), "<u8") for b in buckets.tolist()]).astype(np.float64)
        keys = distinct(grams)[0]
        n_all = totals.column("words")[0].as_py()
        counts = [looked_up(grams.pop(0), keys, every) for _ in range(order)]
        del keys, every
        value = np.log(np.maximum(counts[0], 1)) - np.log(max(n_all, 1))
        for k in range(1, order):
            context = np.ones_like(counts[k])
            context[1:] = counts[k - 1][:-1]
            seen = counts[k] >= min_count
            value = np.where(seen, np.log(np.maximum(counts[k], 1)) - np.log(np.maximum(context, 1)), value + np.log(backoff))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        total = np.bincount(doc, weights=value, minlength=len(sizes))
        full = np.bincount(doc, weights=(counts[-1] >= min_count), minlength=len(sizes)).astype(np.int64)
        mean = [None if not n else round(s / n * 1e6) / 1e6 for s, n in zip(total.tolist(), sizes.tolist())]
        columns = [table.column("doc_id").combine_chunks(), sizes, full, np.round(total, 4), mean]
        return pa.Table.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c.cast(f.type)
                                     for c, f in zip(columns, arrow)], schema=arrow)

    sent = dealt.groupBy("chunk").applyInArrow(ask, T.StructType.fromDDL("bucket int, chunk int, words long, keys binary, counts binary"))
    added = sent.groupBy("bucket").applyInArrow(add_up, T.StructType.fromDDL("chunk int, bucket int, words long, totals binary"))
    return dealt.groupBy("chunk").cogroup(added.groupBy("chunk")).applyInArrow(score, out)


SQL = """
WITH words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (
    SELECT doc_id, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents)),
grams AS (SELECT doc_id, i, word, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM words),
one AS (SELECT word, count(*) AS n FROM words GROUP BY word),
two AS (SELECT prev, word, count(*) AS n FROM grams WHERE prev IS NOT NULL GROUP BY prev, word HAVING count(*) >= 2),
scored AS (
  SELECT g.doc_id, t.n IS NOT NULL AS seen,
    CASE WHEN t.n IS NOT NULL THEN ln(t.n) - ln(c.n) ELSE ln(w.n) - ln((SELECT sum(n) FROM one)) + ln(0.4) END AS v
  FROM grams g JOIN one w ON w.word = g.word LEFT JOIN one c ON c.word = g.prev
  LEFT JOIN two t ON t.prev = g.prev AND t.word = g.word),
sums AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (seen) AS n_seen, sum(v) AS s FROM scored GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_seen, 0) AS n_seen,
  round(coalesce(s, 0), 4) AS log_score, round(s / n_words, 6) AS mean_log_score
FROM documents d LEFT JOIN sums USING (doc_id)"""

SQL_TRIGRAMS = """
WITH words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (
    SELECT doc_id, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents)),
grams AS (SELECT doc_id, i, word, lag(word) OVER d AS prev, lag(word, 2) OVER d AS first FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
one AS (SELECT word, count(*) AS n FROM words GROUP BY word),
two AS (SELECT prev, word, count(*) AS n FROM grams WHERE prev IS NOT NULL GROUP BY prev, word),
three AS (SELECT first, prev, word, count(*) AS n FROM grams WHERE first IS NOT NULL GROUP BY first, prev, word HAVING count(*) >= 2),
scored AS (
  SELECT g.doc_id, h.n IS NOT NULL AS seen,
    CASE WHEN h.n IS NOT NULL THEN ln(h.n) - ln(b.n) WHEN t.n >= 2 THEN ln(t.n) - ln(c.n) + ln(0.4)
      ELSE ln(w.n) - ln((SELECT sum(n) FROM one)) + 2 * ln(0.4) END AS v
  FROM grams g JOIN one w ON w.word = g.word LEFT JOIN one c ON c.word = g.prev
  LEFT JOIN two t ON t.prev = g.prev AND t.word = g.word LEFT JOIN two b ON b.prev = g.first AND b.word = g.prev
  LEFT JOIN three h ON h.first = g.first AND h.prev = g.prev AND h.word = g.word),
sums AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (seen) AS n_seen, sum(v) AS s FROM scored GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_seen, 0) AS n_seen,
  round(coalesce(s, 0), 4) AS log_score, round(s / n_words, 6) AS mean_log_score
FROM documents d LEFT JOIN sums USING (doc_id)"""
