"""The filter audit against loops over all orders, and its SQL."""

import random
from collections import Counter
from itertools import permutations

import cases
from oracle import SF, expected, got

from ruleloom.llm import filter_audit, queries

LABELS = "doc_id long, quality int, toxic int"


def failures(rows):
    """[(id, part, failed letters)] by the rules."""
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    out = []
    for i, text, lang, *_ in rows:
        t = text or ""
        w = cases.WORD.findall(t)
        tests = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and t in first and i > first[t]}
        out.append((i, lang or "", {k for k, v in tests.items() if v}))
    return out


def loops(rows, labels):
    found = failures(rows)
    good, bad = ({i for i, q, t in labels if (q, t)[n] == 1 and i is not None} for n in (0, 1))
    out = {}
    for part in {p for _, p, _ in found}:
        mine = [(i, f) for i, p, f in found if p == part]
        steps = {}
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for k, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                earlier = set(order[: k - 1])
                steps[order, k] = [len(left), len(gone), sum(f in x and bool(x & earlier) for _, x in mine), sum(x == {f} for _, x in mine), sum(i in good for i, _ in gone), sum(i in bad for i, _ in gone)]
        for (order, k), v in steps.items():
            shapley = sum(steps[o, o.index(order[k - 1]) + 1][1] for o in map("".join, permutations("ABCDE")))
            out[part, order, k] = (*v, shapley)
    return out


def audited(spark, rows, labels):
    out = filter_audit.audit(cases.frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    made = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in out}
    assert len(made) == len(out)
    return made


def test_audit_equals_loops(spark):
    rng = random.Random(1)
    rows = [(*r[:2], rng.choice(["en", "de", None, ""]), *r[3:]) for r in cases.documents(2)]
    rows += [(200 + i, " ".join(f"w{k}" for k in range(120)), "en", *[None] * 8) for i in range(3)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(80)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (999, 1, 1)]
    assert audited(spark, rows, labels) == loops(rows, labels)


def test_a_large_group_of_copies_lies_in_many_ranges(spark):
    rows = [(i, "the same text", "en", *[None] * 8) for i in range(500)] + [(i, f"text {i}", "en", *[None] * 8) for i in range(500, 700)] + [(0, "the same text", "en", *[None] * 8)] * 3
    rows += [(None, "the same text", "en", *[None] * 8)] * 2 + [(-5, None, "en", *[None] * 8), (-4, "", "en", *[None] * 8)]
    random.Random(3).shuffle(rows)
    masks = filter_audit.masks(cases.frame(spark, rows).repartition(7))
    bit = 1 << filter_audit.FILTERS.index("E")
    assert Counter((r["id"], bool(r["mask"] & bit)) for r in masks.collect()) == Counter((i, "E" in f) for i, _, f in failures(rows))


def test_texts_of_one_fingerprint_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(filter_audit.F, "xxhash64", lambda *c: F.lit(7).cast("long") + F.lit(0) * F.length(c[0]).cast("long"))
    rows = [(i, f"text {i % 5}", "en", *[None] * 8) for i in range(60)]
    masks = filter_audit.masks(cases.frame(spark, rows)).collect()
    assert {r["id"] for r in masks if not r["mask"] & 16} == set(range(5))


def test_empty_tables(spark):
    assert filter_audit.audit(cases.empty(spark), spark.createDataFrame([], LABELS)).count() == 0
    rows = cases.documents(2)[:5]
    assert audited(spark, rows, []) == loops(rows, [])


def test_registered_query_equals_its_sql(spark):
    assert got(queries.op13_filter_audit(spark, SF)) == expected(queries.SQL["op13_filter_audit"])
