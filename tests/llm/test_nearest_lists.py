"""Nearest neighbours in posting lists against brute force."""

import numpy as np
import pytest

from tablewright.llm import nearest_lists, queries

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], SCHEMA).repartition(3)


def usable(rows):
    return {(i, tuple(map(float, np.float32(v)))) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}


def plain(rows, neighbours=20):
    """{(query id, vector): [(vec_id, score)]}, all of them."""
    found = {}
    rows = usable(rows)
    for i, v in rows:
        if i % 20 == 0:
            near = sorted((-float((np.array(v) * np.array(w)).sum()), j) for j, w in rows if j != i and len(w) == len(v))
            found[i, v] = [(j, -s) for s, j in near[:neighbours]]
    return found


def recall(got, rows):
    want = plain(rows)
    seen = {}
    for r in got.collect():
        seen.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    vectors = dict(usable(rows))
    for (i, v), near in want.items():
        mine = sorted(seen.pop(i, []))
        assert [m[0] for m in mine] == list(range(1, len(near) + 1))
        assert [(-s, j) for _, j, s in mine] == sorted((-s, j) for _, j, s in mine)
        for _, j, s in mine:
            assert j != i and s == pytest.approx(float((np.array(v) * np.array(vectors[j])).sum()), abs=1e-12)
        hit += len({j for _, j, _ in mine} & {j for j, _ in near})
        total += len(near)
    assert not seen
    return hit / max(1, total)


def groups(n, width, seed, spread=0.3, lengths=False):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((max(2, n // 60), width))
    x = centres[r.integers(len(centres), size=n)] + spread * r.standard_normal((n, width))
    return x * r.uniform(0.2, 3, (n, 1)) if lengths else x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("make", [lambda: groups(3000, 24, 1), lambda: groups(2000, 16, 2, 1.0, True),
                                  lambda: groups(2000, 24, 3) * np.arange(1, 25) ** -1.5])
def test_recall_is_at_least_nine_tenths(spark, make):
    rows = [(i, v.tolist()) for i, v in enumerate(make())]
    assert recall(nearest_lists.nearest(frame(spark, rows)), rows) >= 0.9


def test_the_query_on_the_test_vectors(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.op12_nearest_lists(spark, sf)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and recall(got, rows) >= 0.9


def test_copies_ties_and_odd_vectors(spark):
    r = np.random.default_rng(4)
    same = np.float32(r.standard_normal(8)).tolist()
    rows = [(i, same) for i in range(300)] + [(i, np.float32(r.standard_normal(8)).tolist()) for i in range(300, 700)]
    rows += [(None, same), (1000, None), (1020, []), (1040, [0.0] * 8), (1060, [1.0, None] * 4), (1080, [float("nan")] * 8),
             (1100, [float("inf")] * 8), (1120, [1.0, 2.0, 3.0]), (1121, [3.0, 2.0, 1.0]), (1140, [5.0]), (300, rows[300][1]), (0, same)]
    got = nearest_lists.nearest(frame(spark, rows))
    assert recall(got, rows) >= 0.9
    near = {q: [x.vec_id for x in sorted((y for y in got.collect() if y.query_id == q), key=lambda y: y["rank"])] for q in (0, 280, 1120, 1140)}
    assert near[1120] == [1121] and near[1140] == []
    top = [j for j, v in rows if v and len(v) == 8 and None not in v and np.isfinite(v).all() and np.dot(v, same) > np.dot(same, same) * (1 + 1e-9)]
    if not top:  # copies first, smallest ids first, the query itself left out
        assert near[0] == list(range(1, 21)) and near[280] == list(range(20))


def test_one_id_with_several_vectors(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 2.0])]
    got = sorted(tuple(r) for r in nearest_lists.nearest(frame(spark, rows)).collect())
    assert got == sorted([(20, 1, 1, 2.0), (20, 2, 2, 0.0), (20, 1, 2, 2.0), (20, 2, 1, 0.0)])


def test_hot_lists_and_many_queries_are_cut(spark, monkeypatch):
    rows = [(i, v.tolist()) for i, v in enumerate(groups(1200, 8, 5))]
    monkeypatch.setattr(nearest_lists, "SHELF", 8 * 100)
    monkeypatch.setattr(nearest_lists, "QUERIES", 10)
    monkeypatch.setattr(nearest_lists, "SAMPLE", 40)
    monkeypatch.setattr(nearest_lists, "PENDING", 500)
    assert recall(nearest_lists.nearest(frame(spark, rows)), rows) >= 0.9


def test_an_empty_table(spark):
    got = nearest_lists.nearest(frame(spark, []))
    assert got.collect() == [] and got.columns == ["query_id", "rank", "vec_id", "score"]


def test_the_graph_finds_the_nearest_centroids():
    r = np.random.default_rng(6)
    points, x = r.standard_normal((600, 12)), r.standard_normal((200, 12))
    graph = nearest_lists.Graph(points)
    ids, far = graph.search(x, 32)
    true = np.argsort(nearest_lists.distances(x, points), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, true)]) > 0.95
    assert np.allclose(far, nearest_lists.distances(x, points)[np.arange(200)[:, None], ids] ** 2)


def test_parts_are_balanced():
    sizes = [len(p) for p in nearest_lists.halves(groups(1000, 8, 7), 30)]
    assert sum(sizes) == 1000 and max(sizes) <= 30 and min(sizes) >= 15
