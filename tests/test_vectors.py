"""Top-k joins and pair scores against brute force, with balls that can be skipped."""

import math

import numpy as np
import pytest

from ruleloom.operators import vectors


def clustered(n=240, clusters=8, dims=16, spread=0.08, seed=1):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, dims))
    x = centers[rng.integers(clusters, size=n)] + spread * rng.normal(size=(n, dims))
    x[min(5, n - 1)] = x[min(4, n - 1)]  # ties
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, name="id"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(10_000, None)], f"{name} long, unit array<double>")


def nearest(x, q, k, skip=None):
    s = np.round(x @ q, 6)
    return [(i, s[i]) for i in sorted((i for i in range(len(x)) if i != skip), key=lambda i: (-s[i], i))[:k]]


@pytest.mark.parametrize("block", [16, 4096])
def test_top_k_equals_all_scores_and_skips_far_balls(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    x = clustered()
    out = vectors.top_k(frame(spark, x, "qid"), frame(spark, x), 5, exclude_self=True)
    got = {}
    for r in out.orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["id"], r["score"]))
    assert set(got) == set(range(len(x)))
    for q, found in got.items():
        want = nearest(x, x[q], 5, q)
        assert [i for i, _ in found] == [i for i, _ in want] and np.allclose([s for _, s in found], [s for _, s in want], atol=2e-6)
    left_out, every = out.skipped
    print(f"{left_out} of {every} pairs of balls skipped")
    assert (left_out > every // 4) == (block == 16)


def test_top_groups_with_balls_equal_those_without(spark, monkeypatch):
    x = clustered(180)
    reps = spark.createDataFrame([(i, f"F{i // 6:02d}", i % 6 == 0, v.tolist()) for i, v in enumerate(x)], "id long, family string, is_base boolean, unit array<double>")
    asks = frame(spark, clustered(30, seed=2), "qid")
    want = [tuple(r) for r in vectors.top_groups(asks, reps, 4).orderBy("qid", "rank").collect()]
    monkeypatch.setattr(vectors, "BLOCK", 12)
    assert [tuple(r) for r in vectors.top_groups(asks, reps, 4).orderBy("qid", "rank").collect()] == want


def test_top_k_of_nothing(spark):
    none = spark.createDataFrame([], "id long, unit array<double>")
    some = frame(spark, clustered(5))
    assert vectors.top_k(none.withColumnRenamed("id", "qid"), some, 3).count() == 0
    assert vectors.top_k(some.withColumnRenamed("id", "qid"), none, 3).count() == 0


@pytest.mark.parametrize("block", [7, 4096])
def test_pair_distribution_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    x = clustered(60)
    s = np.round(np.clip((x @ x.T)[np.triu_indices(60, 1)], -1, 1), 6)
    r = vectors.pair_distribution(frame(spark, x)).first().asDict()
    assert r["n"] == 60 * 59 // 2
    for name, p in {"p10": 10, "p25": 25, "median": 50, "p75": 75, "p90": 90, "p95": 95, "p99": 99}.items():
        assert math.isclose(r[name], np.percentile(s, p), abs_tol=2e-6)
    assert math.isclose(r["mean"], s.mean(), abs_tol=1e-6) and math.isclose(r["min"], s.min(), abs_tol=2e-6)
    one = vectors.pair_distribution(frame(spark, x[:1])).first().asDict()
    assert one["n"] == 0 and one["median"] is None


@pytest.mark.parametrize(("block", "tile"), [(4096, 1 << 22), (24, 64)])
def test_distribution_has_every_partner_of_a_label(spark, monkeypatch, block, tile):
    """Not the thirty nearest alone: n counts all pairs, the least score is the farthest partner's; equal ids are no pair, a null label is a group."""
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "TILE", tile)
    x = (clustered(90, spread=0.3) * np.random.default_rng(3).uniform(0.1, 9, size=(90, 1))).astype(np.float32)
    labels = [None if i == 7 else "ab"[i > 60] for i in range(90)]
    rows = [(i, v.tolist(), labels[i]) for i, v in enumerate(x)]
    given = spark.createDataFrame([*rows, (200, None, "a"), (201, [0.0] * 16, "b"), (None, x[0].tolist(), "a")], "id long, unit array<float>, label string")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 6)
    got = {r["label"]: r.asDict() for r in vectors.distribution(given, "label").collect()}
    assert set(got) == {"a", "b", None}
    for label, r in got.items():
        want = np.concatenate([np.delete(s[i], i) for i in range(90) if labels[i] == label])
        assert r["n"] == len(want) and r["n"] == 89 * labels.count(label)
        figures = {"min": want.min(), "mean": want.mean(), "max": want.max()} | {name: np.quantile(want, p) for name, p in vectors.SHARES.items()}
        assert all(math.isclose(r[name], v, abs_tol=2e-6) for name, v in figures.items())
    assert vectors.distribution(given.where("id = 7"), "label").count() == 0


def test_rows_are_sent_to_parts_and_not_to_balls(spark, monkeypatch):
    """Vectors without clusters, 150 balls: no ball can be skipped, but a row is sent to PARTS tasks, not to 150."""
    x = np.random.default_rng(5).normal(size=(600, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sent, paired = [], vectors._paired
    monkeypatch.setattr(vectors, "_paired", lambda *a: sent.append(paired(*a)) or sent[-1])
    for name, value in {"BLOCK": 4, "QUERIES": 100, "INDEX": 220, "ROWS": 7, "TILE": 64}.items():
        monkeypatch.setattr(vectors, name, value, raising=False)
    got = {}
    for r in vectors.top_k(frame(spark, x, "qid"), frame(spark, x), 5, exclude_self=True).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    assert got == {q: [i for i, _ in nearest(x, x[q], 5, q)] for q in range(600)}
    assert sum(s.count() for s in sent) <= 600 * (24 + 3) * 2
    reps = spark.createDataFrame([(i, f"F{i // 6:02d}", i % 6 == 0, v.tolist()) for i, v in enumerate(x)], "id long, family string, is_base boolean, unit array<double>")
    got = [tuple(r) for r in vectors.top_groups(frame(spark, x[:40], "qid"), reps, 4).orderBy("qid", "rank").collect()]
    monkeypatch.undo()
    assert got == [tuple(r) for r in vectors.top_groups(frame(spark, x[:40], "qid"), reps, 4).orderBy("qid", "rank").collect()]


def test_both_sides_are_cut_so_that_few_rows_are_sent(spark, monkeypatch):
    """Where no ball can be skipped a vector goes to 8 + 3 tasks of 24, not to 24 + 1."""
    x = np.random.default_rng(6).normal(size=(600, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sent, paired = [], vectors._paired
    monkeypatch.setattr(vectors, "_paired", lambda *a: sent.append(paired(*a)) or sent[-1])
    monkeypatch.setattr(vectors, "BLOCK", 4)
    got = {}
    for r in vectors.top_k(frame(spark, x, "qid"), frame(spark, x), 5, exclude_self=True).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    assert got == {q: [i for i, _ in nearest(x, x[q], 5, q)] for q in range(600)}
    assert max(s.count() for s in sent) <= 600 * (8 + 3)
    assert sent[-1].select("qpart", "ipart").distinct().count() == 24


def test_single_precision_vectors_ask_each_other_and_travel_as_they_are(spark, monkeypatch):
    """Floats that are not normalised give the rows of their unit vectors in doubles, without a second copy of the queries; the bounds leave as a row a ball, not as k rows a query."""
    rng = np.random.default_rng(7)
    x = (clustered(300, spread=0.2) * rng.uniform(0.1, 9, size=(300, 1))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [float("inf")] + [1.0] * 15), (904, [None] + [1.0] * 15)]
    given = spark.createDataFrame(rows, "id long, unit array<float>")
    units = given.select("id", vectors.unit("unit").alias("unit"))
    assert units.where("unit is not null").count() == 300
    for block in (4096, 12):
        monkeypatch.setattr(vectors, "BLOCK", block)
        want = [tuple(r) for r in vectors.top_k(units.withColumnRenamed("id", "qid"), units, 6, exclude_self=True).orderBy("qid", "rank").collect()]
        sent, paired = [], vectors._paired
        with monkeypatch.context() as m:
            m.setattr(vectors, "_paired", lambda *a: sent.append(paired(*a)) or sent[-1])
            out = vectors.top_k(None, given, 6, exclude_self=True)
        assert [tuple(r) for r in out.orderBy("qid", "rank").collect()] == want and len(want) == 1800
        assert {s.schema["unit"].dataType.simpleString() for s in sent} == {"array<float>"}
    for i, r in enumerate(units.where("id < 300").orderBy("id").collect()):
        assert r["unit"] == vectors._normalised(x[i : i + 1].astype(float))[0][0].tolist()
    assert vectors.top_k(None, given.where("id > 900"), 3).count() == 0


@pytest.mark.parametrize("n", [160, 640])
def test_own_rows_are_sent_seven_times_at_any_size(spark, monkeypatch, n):
    """Rows that ask each other go to 4 + 3 tasks of 12 in a small table as in one of four times its rows; balls that all overlap are compared at once, without a pass for bounds that rule out nothing."""
    x = np.random.default_rng(8).normal(size=(n, 12)).astype(np.float32)
    unit = np.array([v / np.linalg.norm(v) for v in x.astype(float)])
    given = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, unit array<float>")
    monkeypatch.setattr(vectors, "BLOCK", 100)
    sent, paired = [], vectors._paired
    monkeypatch.setattr(vectors, "_paired", lambda *a: sent.append(paired(*a)) or sent[-1])
    got = {}
    for r in vectors.top_k(None, given, 5, exclude_self=True).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["id"], r["score"]))
    assert got == {q: nearest(unit, unit[q], 5, q) for q in range(n)}
    assert [s.count() for s in sent] == [n * (4 + 3)]
    assert sent[0].select("qpart", "ipart").distinct().count() == 12
