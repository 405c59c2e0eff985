"""Ranked lexical search over hashed max-sketches.

Impacts are integers. With N documents that hold a term, L terms in all of them, and n terms in a document, a term that
occurs tf times there has the impact (10^9 tf) div (1000 tf + 20 m), where m = 50 + (50 n N) div L; its score is the impact
times the term's weight floor(1000 ln((2N + 2) / (2 df + 1))).

Every document folds its impacts into a sketch: its terms are hashed to ``WIDTH`` coordinates, each holds the largest impact
that fell there. A query looks its terms up in the sketches of a whole batch of documents at once; the weighted sum is never
below the score. Documents are then scored exactly from the largest bound down, until the bound falls below the score of
the query's k-th best document so far. The result is exact, whatever the width.

Two scans: the first counts N, L and df of the query terms, the second sketches, bounds and scores. A task keeps k documents
a query and returns them; they are ranked by item in two rounds, so that no group grows with the number of tasks alone.
Queries are taken in blocks of at most ``BLOCK_TERMS`` terms; every block is searched over all documents.

A document is a row. Null texts hold no term and are no document; a null doc_id is ranked after the others of its score.
Rows of one item_id (a null one too) are one item: their terms, once each. Items without terms have no result. Texts are
read in pieces, so that a long one does not become one list of words. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import quoted
from tablewright.llm.shared import id_and_text, slices

TOP = 50
#: coordinates of a sketch
WIDTH = 1 << 16
#: numbers of the sketches in memory at once; fixes how many documents a batch has
BATCH_CELLS = 1 << 21
#: distinct terms of the items that are searched in one pass
BLOCK_TERMS = 500_000
#: characters of a text that are cut into words at once
PIECE = 1 << 20
#: groups of the first round of ranking
SALTS = 512
#: fixed values: everything but letters, digits and characters beyond ASCII parts the terms; A-Z are lower-cased
LETTERS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def term_counts(text: str | None) -> Counter:
    """How often each term occurs in the whole text; terms as UTF-8 bytes."""
    counts: Counter = Counter()
    if text:
        rest = b""
        for at in range(0, len(text), PIECE):
            piece = rest + text[at:at + PIECE].encode("utf-8", "surrogatepass").translate(LETTERS)
            rest = b""
            if at + PIECE < len(text):
                cut = piece.rfind(b" ") + 1
                piece, rest = piece[:cut], piece[cut:]
            counts.update(piece.split())
        if rest:
            counts[rest] += 1
    return counts


def _counted(docs: DataFrame, terms: list[bytes]) -> tuple[int, int, list[int]]:
    """N, L and df of the terms, over all documents; at most one row a term and task is shuffled."""
    place = {t: i for i, t in enumerate(terms)}

    def run(batches):
        held, n_docs, n_terms = Counter(), 0, 0
        for batch in batches:
            for part in slices(batch, 0):
                for text in part.column(0).to_pylist():
                    counts = term_counts(text)
                    if counts:
                        n_docs += 1
                        n_terms += counts.total()
                        held.update(place.keys() & counts.keys())
        keys = [-1, -2] + [place[t] for t in held]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([n_docs, n_terms, *held.values()], pa.int64())], ["key", "n"])

    found = {r.key: r.n for r in docs.select("text").mapInArrow(run, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()}
    return found.get(-1, 0), found.get(-2, 0), [found.get(i, 0) for i in range(len(terms))]


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Search:
    """The queries of a block, and their best documents so far."""

    def __init__(self, queries: list[dict[bytes, int]], n_docs: int, n_terms: int, top: int, width: int):
        self.queries, self.n_docs, self.n_terms, self.top, self.width = queries, n_docs, n_terms, top, width
        asked = [self._hashed(q) for q in queries]
        # of a sketch only the coordinates that some query asks for are kept
        kept = np.unique(np.concatenate(asked)) if asked else np.zeros(0, np.int64)
        self.row = np.full(width, -1)
        self.row[kept] = np.arange(len(kept))
        self.rows, self.batch = len(kept), max(16, BATCH_CELLS // max(1, len(kept)))
        self.places = [self.row[a] for a in asked]
        self.weights = [np.fromiter(q.values(), np.float64, len(q)) for q in queries]
        self.best: list[list] = [[] for _ in queries]
        self.scored = 0

    def _hashed(self, terms) -> np.ndarray:
        # the hash is used inside this process only
        return np.fromiter(map(hash, terms), np.int64, len(terms)) % self.width

    def sketches(self, counts: list[Counter], damping: list[int]) -> np.ndarray:
        """(coordinate, document): the largest impact of the terms there; impacts rise with tf, so the largest tf is folded."""
        most = np.zeros((self.rows, len(counts)), np.int64)
        for j, c in enumerate(counts):
            rows = self.row[self._hashed(c)]
            kept = rows >= 0
            np.maximum.at(most[:, j], rows[kept], np.fromiter(c.values(), np.int64, len(c))[kept])
        # sums of products stay below 2^53, so doubles hold them exactly
        return (1_000_000_000 * most // (1000 * most + 20 * np.array(damping, np.int64)[None, :])).astype(np.float64)

    def add(self, ids: list, texts: list) -> None:
        rows = [(i, c) for i, t in zip(ids, texts) if (c := term_counts(t))]
        for at in range(0, len(rows), self.batch):
            self._batch(rows[at:at + self.batch])

    def _batch(self, rows: list[tuple]) -> None:
        counts = [c for _, c in rows]
        damping = [50 + 50 * c.total() * self.n_docs // self.n_terms for c in counts]
        sketch = self.sketches(counts, damping)
        for terms, places, weights, best in zip(self.queries, self.places, self.weights, self.best):
            bounds = weights @ sketch[places]
            floor = best[0][0] if len(best) == self.top else 1
            near = np.flatnonzero(bounds >= floor)
            for j in near[np.argsort(-bounds[near], kind="stable")]:
                if len(best) == self.top and bounds[j] < best[0][0]:
                    break
                held, m = counts[j], 20 * damping[j]
                self.scored += 1
                score = sum(w * (1_000_000_000 * held[t] // (1000 * held[t] + m)) for t, w in terms.items() if t in held)
                if score > 0:
                    doc_id = rows[j][0]
                    entry = (score, -math.inf if doc_id is None else -doc_id)
                    if len(best) < self.top:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)


def _searched(docs: DataFrame, items: list, vocabulary: list[bytes], members: list[list[int]], top: int, width: int) -> DataFrame:
    n_docs, n_terms, held = _counted(docs, vocabulary)
    weights = [weight(n_docs, df) for df in held]
    queries = [{vocabulary[t]: weights[t] for t in terms} for terms in members]
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        search = Search(queries, n_docs, n_terms, top, width)
        for batch in batches:
            for part in slices(batch, 1):
                search.add(part.column(0).to_pylist(), part.column(1).to_pylist())
        rows = [(i, None if e[1] == -math.inf else -e[1], e[0]) for i, best in zip(items, search.best) for e in best]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "item_id long, doc_id long, score long")


def _blocks(items: DataFrame, id_col: str, text_col: str, block_terms: int) -> Iterator[tuple[list, list[bytes], list[list[int]]]]:
    """(ids, distinct terms, terms of each id) of some items; one block at a time is on the driver."""
    rows = items.select(quoted(id_col).cast("long").alias("item_id"), quoted(text_col).cast("string").alias("text"))
    ids, place, members = [], {}, []
    for r in rows.orderBy("item_id").toLocalIterator():
        terms = list(term_counts(r.text))
        same = bool(ids) and ids[-1] == r.item_id
        if not same and len(place) + len(terms) > block_terms and ids:
            yield ids, list(place), [sorted(m) for m in members]
            ids, place, members = [], {}, []
        if not same:
            ids.append(r.item_id)
            members.append(set())
        members[-1].update(place.setdefault(t, len(place)) for t in terms)
    if ids:
        yield ids, list(place), [sorted(m) for m in members]


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", width: int = WIDTH, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` documents of every item with a score above 0."""
    texts = id_and_text(docs, id_col, text_col)
    found = None
    for ids, vocabulary, members in _blocks(items, item_col, item_text_col, block_terms):
        part = _searched(texts, ids, vocabulary, members, top, width)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    some = found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))).withColumn(
        "place", F.row_number().over(Window.partitionBy("item_id", "salt").orderBy(*order))).where(F.col("place") <= top)
    return (some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= top)
            .select("item_id", "rank", "doc_id", "score"))


#: terms are code points here and bytes above; no character beyond ASCII parts them, so both agree
SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
terms AS (SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
size AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
total AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM size),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term),
scores AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))))::BIGINT AS score
           FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN size USING (r), total GROUP BY item_id, r, doc_id),
placed AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
           FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 50
"""
