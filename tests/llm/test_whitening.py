"""Embedding whitening against numpy, its eigen-solver, and its defined results for odd rows."""

import numpy as np
import pytest
from tidemark.llm import queries, symmetric_qr, whitening


def expected(rows, most=4):
    """(key, component) -> [(n, deviation, whitened, explained)], by numpy over all vectors at once."""
    good = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fitted = np.array(sorted({tuple(x) for _, x in good}), float)
    n, sums = len(fitted), [int(s) for s in fitted.sum(axis=0)]
    centred = fitted - fitted.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors, out = values[::-1], vectors[:, ::-1], {}
    for i, x in good:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        for j in range(min(most, len(values))):
            out.setdefault((i, j + 1), []).append((n, deviation, (np.array(x) - np.array(sums) / n) @ vectors[:, j] / np.sqrt(values[j]), values[j] / values.sum()))
    return out


def check(found, rows):
    got = {}
    for r in found.collect():
        got.setdefault((r["vec_id"], r["component"]), []).append(r)
    want, sign = expected(rows), {}
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    for key, each in want.items():
        for (n, deviation, value, explained), r in zip(each, got[key]):
            assert (r["n"], r["deviation"]) == (n, deviation) and r["identity_error"] < 1e-9
            turned = sign.setdefault(key[1], np.sign(value * r["whitened"]) or 1)
            assert abs(value - turned * r["whitened"]) < 1e-8 and abs(explained - r["explained"]) < 1e-9


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, whitened string, n string").repartition(3)


ROWS = [(1, [0.1, 0.2, 0.3]), (2, [0.5, -0.2, 0.3]), (2, [0.5, -0.2, 0.3]), (None, [0.1, 9.0, -4.0]), (8, [0.0, -0.001, 0.7]), (10, [5.0, 5.0, 5.0])]
ODD = [(4, None), (5, [None, 0.1, 0.1]), (6, [float("nan"), 1.0, 1.0]), (7, [float("inf"), 1.0, 1.0]), (9, [1.0, 2.0]), (11, []), (12, [1e300, 0.0, 0.0])]


def whitened(rows):
    model = whitening.fit(rows)
    return model, whitening.by_component(whitening.whiten(rows, model), model)


def test_whole_table(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()
    check(queries.op11_embedding_whitening(spark, small), [tuple(r) for r in rows])


def test_odd_rows_have_no_result(spark):
    check(whitened(frame(spark, ROWS + ODD))[1], ROWS)


def test_copies_count_once(spark):
    model, found = whitened(frame(spark, ROWS + [(k, [5.0, 5.0, 5.0]) for k in range(100, 400)]))
    assert model.n == 5 and found.count() == 3 * (len(ROWS) + 300)


def test_without_variance(spark):
    model, found = whitened(frame(spark, ROWS[:1]))
    assert model.n == 1 and model.identity_error is None
    assert [(r["deviation"], r["whitened"], r["explained"]) for r in found.collect()] == [(0, None, None)] * 3


def test_flat_space_has_null_components(spark):
    model, found = whitened(frame(spark, [(k, [k / 256, 2 * k / 256, 0.0]) for k in range(9)]))
    assert model.identity_error < 1e-9 and {r["component"] for r in found.where("whitened is not null").collect()} == {1}


def test_empty(spark):
    for rows in ([], [(1, None)]):
        model, found = whitened(frame(spark, ROWS + rows).where("vec_id = -1") if not rows else frame(spark, rows))
        assert model is None and found.count() == 0


def test_large_entries_are_exact(spark):
    rows = frame(spark, [(1, [2.0**53 - 1, 1.0]), (2, [-(2.0**53), 5.0])])
    found = whitening.whiten(rows, whitening.fit(rows)).collect()
    top, low = int((2.0**53 - 1) * 256), -(2**61)
    assert {int(r["deviation"]) for r in found} == {(top - low) ** 2 + (4 * 256) ** 2}


def test_merged_moments_equal_one_pass():
    rows = np.random.default_rng(5).integers(-300, 300, (60, 6))
    whole, parts = whitening._Moments(6), [whitening._Moments(6) for _ in range(3)]
    whole.add(rows)
    for k, part in enumerate(parts):
        part.add(rows[20 * k : 20 * k + 20])
        if k:
            parts[0].merge(part)
    assert parts[0].sums == whole.sums == rows.sum(axis=0).tolist()
    assert np.allclose(parts[0].covariance(), np.cov(rows.T, bias=True), rtol=1e-12) and np.allclose(whole.covariance(), parts[0].covariance(), rtol=1e-12)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 40])
def test_symmetric_qr(n):
    a = np.random.default_rng(n).normal(size=(n, n))
    for m in (a + a.T, a @ a.T, np.ones((n, n)), np.zeros((n, n)), np.eye(n)):
        values, vectors = symmetric_qr.eigen(m)
        assert np.allclose(values, np.linalg.eigvalsh(m)[::-1], atol=1e-12 * max(1, abs(m).max() * n))
        assert np.allclose(vectors @ m @ vectors.T, np.diag(values), atol=1e-12 * max(1, abs(m).max() * n)) and np.allclose(vectors @ vectors.T, np.eye(n), atol=1e-12)
