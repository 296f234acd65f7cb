"""Family plans: folds over dependent chunks, in slices, with faults."""

import random

import pytest

from ruleloom.streaming import families
from ruleloom.streaming.families import Family

SCHEMA = "family_id string, chunk int, position int, member_id string, member_type string, delta string"


def plan(seed=1, n=9):
    rng = random.Random(seed)
    rows = []
    for f in [*(f"F{i}" for i in range(n)), None]:
        for p in range(rng.randrange(1, 30)):
            rows.append((f, p // 4 + 1, p, f"m{rng.randrange(10**6)}-{p}", rng.choice(["EQUIVALENT", "VARIANT"]), rng.choice(["d1", "d2", None])))
    rng.shuffle(rows)
    return rows


def loops(rows, payload=families.by_delta):
    out = {}
    for key in sorted({(r[0] or "", r[0], r[1]) for r in rows}, key=lambda x: (x[0], x[2])):
        members = [(r[3], r[4], r[5]) for r in sorted((r for r in rows if (r[0], r[1]) == key[1:]), key=lambda r: r[2])]
        out[key[1]] = families.apply(out.get(key[1], Family()), key[2], members, payload)
    return {f: (x.version, x.base_origin, sorted(x.equivalent, key=families.natural), x.normal(), x.next_chunk, x.fault) for f, x in out.items()}


def rows_of(df):
    return {r["family_id"]: (r["version"], r["base_origin"], r["equivalent_member_ids"], [{"delta": g["delta"], "member_ids": g["member_ids"]} for g in r["variant_groups"]], r["next_chunk"], r["fault"]) for r in df.collect()}


@pytest.mark.parametrize("slice_", [1, 2, 1000])
def test_fold_equals_loops(spark, tmp_path, slice_):
    rows = plan()
    assert rows_of(families.fold(spark.createDataFrame(rows, SCHEMA), str(tmp_path), slice_=slice_)) == loops(rows)


def test_a_broken_run_goes_on(spark, tmp_path):
    rows, seen = plan(2), []
    df = spark.createDataFrame(rows, SCHEMA)
    half = rows_of(families.fold(df, str(tmp_path), slice_=2, most=1))
    assert half == loops([r for r in rows if r[1] <= 2])
    (tmp_path / "upto=4").mkdir()  # a slice that was broken off: files, but no mark of success
    (tmp_path / "upto=4" / "part-0.parquet").write_bytes(b"cut")
    marks = {p: p.stat().st_mtime_ns for p in tmp_path.glob("upto=2/*")}
    assert rows_of(families.fold(df, str(tmp_path), slice_=2)) == loops(rows)
    assert marks == {p: p.stat().st_mtime_ns for p in tmp_path.glob("upto=2/*")} and not seen


def test_faults_end_a_family_alone(spark, tmp_path):
    rows = [("a", 1, 1, "x", "EQUIVALENT", None), ("a", 3, 2, "y", "VARIANT", "d"), ("b", 1, 1, "x", "EQUIVALENT", None), ("b", 2, 2, "x", "VARIANT", "d"), ("b", 3, 3, "z", "VARIANT", "d"), ("c", 1, 1, "x", "VARIANT", "d")]
    got = rows_of(families.fold(spark.createDataFrame(rows, SCHEMA), str(tmp_path)))
    assert got == loops(rows)
    assert got["a"][0] == 1 and "chunk 3" in got["a"][5] and got["b"][0] == 1 and "chunk 2" in got["b"][5] and got["c"][5] is None


def test_a_payload_must_hold_every_member(spark, tmp_path):
    lossy = lambda family, members: ([m for m, *_ in members], {})  # noqa: E731  forgets the members before
    rows = [("a", 1, 1, "x", "EQUIVALENT", None), ("a", 2, 2, "y", "EQUIVALENT", None)]
    (r,) = families.fold(spark.createDataFrame(rows, SCHEMA), str(tmp_path), lossy).collect()
    assert (r["version"], r["equivalent_member_ids"]) == (1, ["x"]) and "chunk 2" in r["fault"]


def test_an_empty_plan(spark, tmp_path):
    assert families.fold(spark.createDataFrame([], SCHEMA), str(tmp_path)).count() == 0
