"""Whitening against numpy's eigenvectors of the covariance."""

import math

import numpy as np
import pytest
from oracle import SF

from ruleloom.llm import queries, whitening
from ruleloom.llm.whitening import Summary


def reference(x, components=8):
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    return n, ((n * x - s) ** 2).sum(axis=1), (c @ u[:, :components]) / np.sqrt(e[:components]), e[:components] / e.sum()


def checked(out, x, ids):
    n, deviation, whitened, explained = reference(x)
    table = {(r["vec_id"], r["component"]): r for r in out}
    k = whitened.shape[1]
    assert len(out) == len(table) == len(ids) * k and {r["n"] for r in out} == {n}
    got = np.array([[table[i, c + 1]["whitened"] for c in range(k)] for i in ids])
    assert np.abs(got - whitened * np.sign((got * whitened).sum(axis=0))).max() < 1e-6
    assert [table[i, 1]["deviation"] for i in ids] == deviation.tolist()
    assert [table[ids[0], c + 1]["explained"] for c in range(k)] == pytest.approx(explained, rel=1e-9)
    assert {r["identity_error"] for r in out} == {out[0]["identity_error"]} and out[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("parts", [1, 11])
def test_whitening_equals_eigenvectors(spark, parts):
    rng = np.random.default_rng(1)
    v = (rng.normal(size=(300, 12)) * np.linspace(0.1, 1, 12)).astype(np.float32)
    odd = [(900, None), (901, []), (902, [1.0] * 11 + [None]), (903, [float("nan")] * 12), (904, [float("inf")] + [0.0] * 11), (905, [1.0] * 5)]
    rows = [(i, x.tolist(), "extra") for i, x in enumerate(v)] + [(i, x, None) for i, x in odd]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string").repartition(parts)
    checked(whitening.whiten(df).collect(), np.floor(v.astype(float) * 1024).astype(int) + 100_000, list(range(300)))


def test_merges_lose_no_dimension():
    rng = np.random.default_rng(2)
    x = rng.integers(90_000, 110_000, (57, 9))
    whole, parts = Summary.of(x), [Summary.of(p) for p in np.array_split(x, 20)]
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.merge(p)
    assert merged.n == 57 and (merged.sums == x.sum(axis=0)).all()
    assert merged.values == pytest.approx(whole.values) and np.abs(np.abs((merged.vectors * whole.vectors).sum(axis=1)) - 1).max() < 1e-9


def test_flat_single_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(None, [0.5, 0.25])], schema)).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [(None, 1, 1, 0, None, None), (None, 2, 1, 0, None, None)]
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(5)], schema)).collect()
    assert len(line) == 15 and all((r["whitened"] is None) == (r["component"] > 1) for r in line)
    assert sum(r["explained"] for r in line if r["vec_id"] == 0) == pytest.approx(1)


def test_a_deviation_beyond_a_long_is_null(spark):
    out = whitening.whiten(spark.createDataFrame([(0, [1e9, 0.0]), (1, [0.0, 1.0]), (2, [0.5, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert all(r["deviation"] is None for r in out if r["vec_id"] == 0) and all(math.isfinite(r["whitened"]) for r in out)


def test_registered_query(spark):
    out = queries.op12_embedding_whitening(spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    checked(out, np.floor(np.array([r["embedding"] for r in rows], float) * 1024).astype(int) + 100_000, [r["vec_id"] for r in rows])
