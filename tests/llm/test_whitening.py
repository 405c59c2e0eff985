"""Whitening against a library eigensolver and plain integer arithmetic."""

import numpy as np
import pytest

from tablewright.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, n string, component string, whitened string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], SCHEMA).repartition(3)


def plain(rows, most=16):
    """{(vec_id, vector): (n, deviation, |whitened|, explained)} for vectors of one length."""
    x = {(i, tuple(v)): np.floor(64 * np.float32(v).astype(float)).astype(int) + 1_000_000 for i, v in rows}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, total = len(fit), fit.sum(0)
    c = fit - total / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = [k for k in range(min(most, len(values))) if values[k] > 1e-13 * values[0]]
    return {key: (n, sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, total)), np.abs((v - total / n) @ vectors[:, keep] / np.sqrt(values[keep])),
                  values[keep] / values.sum()) for key, v in x.items()}


def held_against(got, rows, most=16):
    want = plain(rows, most)
    seen = {}
    for r in got.collect():
        seen.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    assert set(seen) == {i for i, _ in rows}
    for (i, _), (n, deviation, white, explained) in want.items():
        assert sorted(seen[i]) == list(range(1, len(explained) + 1))
        for k, some in seen[i].items():
            for r in some:
                assert (r.n, r.deviation) == (n, deviation) and r.identity_error < 1e-9
                assert abs(r.whitened) == pytest.approx(white[k - 1], abs=1e-7) and r.explained == pytest.approx(explained[k - 1], rel=1e-9)


def matrices():
    r = np.random.default_rng(1)
    for d in (1, 2, 7, 40):
        q = np.linalg.qr(r.standard_normal((d, d)))[0]
        yield from (a + a.T for a in (r.standard_normal((d, d)), np.eye(d), np.zeros((d, d)), np.diag(np.arange(d) % 3 + 0.5)))
        b = r.standard_normal((d, 2))
        yield b @ b.T
        yield (q * 10.0 ** -np.linspace(0, 18, d)) @ q.T
        yield (q * np.repeat([3.0, 1.0], d)[:d]) @ q.T
        yield (q * (1 + 1e-13 * np.arange(d))) @ q.T


def test_the_spectrum_is_right_for_repeated_tiny_and_zero_eigenvalues():
    for a in matrices():
        a = (a + a.T) / 2
        values, vectors = whitening.spectrum(a)
        size = max(np.abs(a).max(), 1e-300)
        assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13
        assert np.abs(a @ vectors - vectors * values).max() < 1e-12 * size * len(a)
        assert np.abs(np.sort(values)[::-1] - np.linalg.eigvalsh(a)[::-1]).max() < 1e-12 * size * len(a)


def test_the_polar_factor_is_orthogonal_and_leaves_a_positive_matrix():
    a = np.random.default_rng(2).standard_normal((20, 20))
    a = a + a.T
    u = whitening.polar_factor(a)
    assert np.abs(u @ u.T - np.eye(20)).max() < 1e-13 and np.linalg.eigvalsh(u @ a).min() > -1e-12


@pytest.mark.parametrize("width", [1, 5, 24])
def test_whitened_equals_a_plain_version(spark, width):
    r = np.random.default_rng(width)
    rows = [(i, (np.float32(r.standard_normal(width) * np.arange(1, width + 1))).tolist()) for i in range(200)]
    rows += [(500, rows[0][1]), (501, rows[0][1]), (0, rows[0][1])]
    held_against(whitening.whitened(frame(spark, rows)), rows)


def test_the_query_on_the_test_vectors(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.op13_whitening(spark, sf)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    held_against(got, rows)


def test_odd_rows_are_left_out_and_lengths_are_fitted_apart(spark):
    r = np.random.default_rng(9)
    short, long = ([(i, np.float32(r.standard_normal(w)).tolist()) for i in range(s, s + 50)] for s, w in ((0, 3), (100, 6)))
    odd = [(900, None), (901, []), (902, [1.0, None, 2.0]), (903, [float("nan")] * 3), (904, [float("-inf")] * 6)]
    got = whitening.whitened(frame(spark, short + long + odd)).cache()
    held_against(got.where("vec_id < 100"), short)
    held_against(got.where("vec_id >= 100"), long)
    assert got.where("vec_id >= 900").count() == 0
    unnamed = whitening.whitened(frame(spark, [*short, (None, [0.5, 0.5, 0.5])]))
    assert unnamed.where("vec_id IS NULL").count() == 3


def test_level_dimensions_single_vectors_and_empty_tables(spark):
    flat = [(i, [float(i % 7), 2.0, float(i % 5)]) for i in range(60)]
    held_against(whitening.whitened(frame(spark, flat)), flat)  # two components, no third
    assert whitening.whitened(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert whitening.whitened(frame(spark, [])).collect() == []


def test_far_values_stay_exact_or_fail(spark):
    rows = [(i, [float(np.float32(2.1e5 * (i % 9))), float(i)]) for i in range(40)]
    held_against(whitening.whitened(frame(spark, rows)), rows)
    with pytest.raises(Exception, match="2\\^40"):
        whitening.whitened(frame(spark, [(1, [1e30, 0.0]), (2, [0.0, 1.0])])).collect()
