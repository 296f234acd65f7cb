"""Line deduplication at every length."""

from collections import Counter

import cases
import pytest
from oracle import SF

import corpus_pipeline as pipeline
from ruleloom.llm import queries
from ruleloom.llm.line_dedup import line_dedup


def test_equal_lines_of_every_length_go(spark):
    rows = [(1, "Les.\n\na\nLes.\nLet.\n \na", *[None] * 9), (2, "a\nLes.\n\n", *[None] * 9), (3, "b\nLes.", *[None] * 9)]
    out = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup(cases.frame(spark, rows), every_length=True).collect()}
    assert out == {1: ("Les.\n\na\nLet.\n ", 7, 2), 2: ("\n", 4, 2), 3: ("b", 2, 1)}


def test_lines_two_edits_apart_go_by_default(spark):
    line = "the weather on erin are ntreou and so on"
    rows = [(1, line, *[None] * 9), (2, line.replace("are", "at"), *[None] * 9), (3, line.replace("are", "xyz"), *[None] * 9), (4, line.replace("the", "tha", 1) + "!", *[None] * 9)]
    assert {r["doc_id"]: r["n_dropped"] for r in line_dedup(cases.frame(spark, rows)).collect()} == {1: 0, 2: 1, 3: 0, 4: 1}


@pytest.mark.parametrize("run", [
    lambda spark: queries.QUERIES["op6_line_dedup"](spark, SF),
    lambda spark: pipeline.repeated_lines(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF),
])
def test_registered_uses_leave_no_equal_lines(spark, run):
    lines = Counter(x for r in run(spark).collect() for x in r["text"].split("\n") if cases.WORD.search(x))
    assert lines and set(lines.values()) == {1}
