"""Whitening against eigenvectors of the whole covariance matrix."""

import math

import numpy as np
import pytest
from conftest import DATA

from ragmill.llm import registry, whitening

SCHEMA = "vec_id long, embedding array<double>, label int, x string, n long, d int, block string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "x", 1, 2, "b") for i, v in vectors], SCHEMA)


def exact(vectors, most=16):
    """n, eigenvalues, shares and components of the distinct x."""
    x = np.unique(np.floor(64 * np.array(vectors, float)), axis=0)
    gap = x - x.mean(0)
    values, parts = np.linalg.eigh(gap.T @ gap / len(x))
    return len(x), x.sum(0), values[::-1][:most], values[::-1][:most] / values.sum(), parts[:, ::-1][:, :most], x.mean(0)


def check(spark, vectors, rows, model):
    n, sums, values, shares, parts, mean = exact([v for _, v in vectors])
    k = len(model.eigenvalues)
    assert model.n == n and model.sums == [int(s) for s in sums] and model.identity_error < 1e-9
    assert np.allclose(model.eigenvalues, values[:k], rtol=1e-11) and np.allclose(model.explained, shares[:k], rtol=1e-11)
    assert np.abs(model.components.T @ model.components - np.eye(k)).max() < 1e-12
    got = {}
    for r in whitening.whiten(rows, model).collect():
        got.setdefault(r.id, []).append(r)
    for i, v in vectors:
        x = np.floor(64 * np.array(v))
        for r in got[i]:
            assert r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums, strict=True))
            assert np.allclose(r.whitened, (x - mean) @ model.components / np.sqrt(model.eigenvalues), rtol=1e-12, atol=1e-12)
    return k


def test_components_are_eigenvectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 20)) @ np.diag(np.linspace(3, 0.5, 20)) + 5
    vectors = list(enumerate(base.tolist())) + [(1000 + i, base[7].tolist()) for i in range(300)]
    rows = whitening.whole_entries(frame(spark, vectors))
    model = whitening.fit(rows)
    assert check(spark, vectors, rows, model) == 16
    parts = exact([v for _, v in vectors])[4]
    assert np.abs(np.abs((model.components * parts).sum(0)) - 1).max() < 1e-12
    early = whitening.fit(rows, most=3, tolerance=1e-9)
    assert np.allclose(early.eigenvalues, model.eigenvalues[:3], rtol=1e-10)


@pytest.mark.parametrize("case", ["repeated", "rank", "constant", "one", "two"])
def test_degenerate_variance(spark, case):
    eye = np.eye(5)
    vectors = {
        "repeated": [s * 2 * e for e in eye for s in (1, -1)] + [4 * eye[0], -4 * eye[0], 4 * eye[1], -4 * eye[1]],
        "rank": [i * eye[0] + 2 * i * eye[1] + (i % 3) * eye[2] for i in range(30)],
        "constant": [np.array([i, 7, 7, -i % 4, 7]) for i in range(20)],
        "one": [eye[0]] * 4,
        "two": [eye[0], 3 * eye[1]],
    }[case]
    vectors = [(i, v.astype(float).tolist()) for i, v in enumerate(vectors)]
    rows = whitening.whole_entries(frame(spark, vectors))
    model = whitening.fit(rows)
    if case == "one":
        assert model.n == 1 and len(model.eigenvalues) == 0
    else:
        k = check(spark, vectors, rows, model)
        assert k == {"repeated": 5, "rank": 2, "constant": 2, "two": 1}[case]


def test_awkward_vectors(spark):
    good = [(i, [float(i % 7), float(i * i % 5), float(i)]) for i in range(50)]
    odd = [(None, [1.0, 2.0, 3.0]), (60, None), (61, []), (62, [1.0, None, 2.0]), (63, [1.0, math.nan, 2.0]), (64, [1.0, math.inf, 2.0]), (65, [1.0, 2.0]), (66, [1e200, 1.0, 1.0]), (5, good[5][1])]
    rows = whitening.whole_entries(frame(spark, good + odd))
    kept = sorted((r.id if r.id is not None else -1) for r in rows.collect())
    assert kept == sorted([-1, 5, *range(50)])
    model = whitening.fit(rows)
    assert check(spark, [*good, (None, [1.0, 2.0, 3.0])], rows, model) == 3
    large = whitening.whole_entries(frame(spark, [(i, [i * 1e13, 1.0]) for i in range(4)]))
    model = whitening.fit(large)
    assert model.sums == [384 * 10**13, 256] and whitening.whiten(large, model).where("deviation is null").count() == 4
    none = frame(spark, good).limit(0)
    model = whitening.fit(whitening.whole_entries(none))
    assert model.n == 0 and whitening.whiten(whitening.whole_entries(none), model).count() == 0


def test_query_over_the_given_vectors(spark):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    n, sums, values, shares, parts, mean = exact([v for _, v in vectors])
    got = registry.op11_whitening(spark, DATA).collect()
    assert len(got) == 16 * len(vectors) and {r.n for r in got} == {n}
    of = {i: np.floor(64 * np.array(v)) for i, v in vectors}
    signs = {}
    for r in got:
        k = r.component - 1
        right = (of[r.vec_id] - mean) @ parts[:, k] / math.sqrt(values[k])
        signs.setdefault(k, 1 if right * r.whitened > 0 else -1)
        assert abs(right * signs[k] - r.whitened) < 1e-9
        assert abs(r.explained - shares[k]) < 1e-10 and r.identity_error < 1e-10
        assert r.deviation == int(((n * of[r.vec_id] - sums) ** 2).sum())
