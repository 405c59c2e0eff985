"""Ranked lexical search against its SQL and a plain version."""

import math
import re
from collections import Counter

import duckdb
import pytest

from tablewright.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top=50):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    big_n, big_l = len(counts), sum(c.total() for _, c in counts)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    rows = set()
    for item, words in asked.items():
        scored = []
        for i, c in counts:
            m = 50 + (50 * c.total() * big_n) // big_l
            score = 0
            for w in words & c.keys():
                df = sum(w in o for _, o in counts)
                score += math.floor(1000 * math.log((2 * big_n + 2) / (2 * df + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        for rank, (s, _, _, i) in enumerate(sorted(scored)[:top], 1):
            rows.add((item, rank, i, -s))
    return rows


DOCS = [(1, "The cat sat; the CAT ran"), (2, "Ünïcode Ün cat 42"), (3, None), (4, ""), (5, " ;; \n"), (6, "cat"), (7, "cat"), (7, "cat"),
        (None, "cat dog"), (8, "dog " * 3000 + "cat"), (9, "É é e x2x x2 2x"), (10, "sat " + "word" * 5000)]
ITEMS = [(1, "Cat DOG"), (1, "sat"), (2, None), (3, "ün É x2x"), (None, "dog"), (4, "absent words"), (5, "cat cat cat")]


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, 0, "x", "y") for i, t in docs], "doc_id long, text string, rank int, score string, item_id string")
    return d.repartition(3), spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")


@pytest.mark.parametrize("width,block", [(1 << 16, 500_000), (1, 500_000), (7, 2)])
def test_ranked_equals_a_plain_version_whatever_the_width(spark, width, block):
    docs, items = frames(spark, DOCS, ITEMS)
    got = lexical_search.ranked(docs, items, top=4, width=width, block_terms=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert {tuple(r) for r in got.collect()} == plain(DOCS, ITEMS, 4)


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = " ".join(f"Word{i % 50}É" for i in range(3000))
    whole = lexical_search.term_counts(text)
    monkeypatch.setattr(lexical_search, "PIECE", 17)
    assert lexical_search.term_counts(text) == whole == Counter(w.encode() for w in terms(text))
    monkeypatch.setattr(lexical_search, "PIECE", 3)
    assert lexical_search.term_counts("abcdefghij") == Counter([b"abcdefghij"])


def test_bounds_are_never_below_the_scores(spark):
    texts = [t for _, t in DOCS if t]
    counts = [c for t in texts if (c := lexical_search.term_counts(t))]
    query = {t: 100 + i for i, t in enumerate(lexical_search.term_counts("cat dog sat ün"))}
    wide, narrow = (lexical_search.Search([query], len(counts), sum(c.total() for c in counts), 5, w) for w in (1 << 16, 3))
    for search in (wide, narrow):
        sketch = search.sketches(counts, [60] * len(counts))
        bounds = search.weights[0] @ sketch[search.places[0]]
        exact = [sum(w * (10**9 * c[t] // (1000 * c[t] + 1200)) for t, w in query.items() if t in c) for c in counts]
        assert all(b >= e for b, e in zip(bounds, exact))


@pytest.mark.parametrize("docs,items", [([], ITEMS), (DOCS, []), ([(1, None)], ITEMS), (DOCS, [(1, None)])])
def test_empty_tables_give_no_rows(spark, docs, items):
    got = lexical_search.ranked(*frames(spark, docs, items))
    assert got.collect() == [] and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_the_query_equals_its_sql(spark, sf):
    from tablewright.llm import queries
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    got = queries.op11_lexical_search(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(lexical_search.SQL).fetchall())
