"""How five filters of a corpus interact, in every order of them.

A row's failures are a bit mask. Four of the bits come from the row's own text.
The fifth, a repeated text, comes from one range sort of the table by the
text's fingerprint, the text and the id: a row repeats the first row of its run
of equal texts if its id is larger. A run may begin in an earlier range of the
sort; the runs at both ends of every range are kept aside, with their texts,
and joined, so that a large group of copies is spread over many tasks. The
masks are then counted by part; every count of every order is a sum over those
few counters.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.plans.durable import materialize

FILTERS = "ABCDE"
#: Runs at the ends of ranges that are sent to every executor at most.
SEND_RUNS = 100_000
SPACES = r"[\x20\x09-\x0D]+"


def own_failures(text: Column) -> Column:
    """Bits of the filters A to D, from the text alone.

    A: under 100 words. B: 100 * distinct words < 80 * words. C: 100 * capital
    letters A-Z > 10 * code points. D: one of # $ % & * |.
    """
    words = F.array_remove(F.split(text, SPACES), "")
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    bit = lambda test, k: F.when(test, F.lit(1 << k)).otherwise(F.lit(0))
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[0]
    by_words = F.transform(F.array(counts), lambda c: bit(c["n"] < 100, 0) + bit(F.lit(100) * c["d"].cast("long") < F.lit(80) * c["n"].cast("long"), 1))[0]
    return by_words + bit(F.lit(100) * capitals.cast("long") > F.lit(10) * F.length(text).cast("long"), 2) + bit(text.rlike("[#$%&*|]"), 3)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, part, mask, fp, text) of one sorted range, with what the range alone tells.

    kind 0, a row: ``again`` if its id is larger than its run's first one,
    ``run`` if an earlier range must decide. kind 1 and 2: the runs of the
    range's first and last fingerprint, with text and first id.
    """
    where = TaskContext.get().partitionId()
    last_fp = last_text = first_id = None
    number, began = -1, None  # of the run, and the fingerprint with which the range begins
    heads: list[tuple] = []
    tails: list[tuple] = []
    names = ["kind", "at", "run", "id", "part", "mask", "again", "fp", "text"]
    kind_of_id = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        kind_of_id = b.schema.field(0).type
        ids, fps, texts = b.column(0).to_pylist(), b.column(3).to_numpy(), b.column(4)
        again, runs = np.zeros(n, bool), np.full(n, -1, np.int64)
        for i, fp in enumerate(fps.tolist()):
            if fp == last_fp and (text := texts[i].as_py()) == last_text:
                pass
            else:
                text = texts[i].as_py()
                number, first_id = number + 1, ids[i]
                if fp != last_fp:
                    tails = []
                    began = fp if began is None else began
                run = (number, first_id, fp, text)
                tails.append(run)
                if fp == began:
                    heads.append(run)
                last_fp, last_text = fp, text
            if ids[i] is not None and first_id is not None:
                again[i] = ids[i] > first_id
                if fp == began and not again[i]:
                    runs[i] = number
        none = pa.nulls(n, pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, where, np.int64)), pa.array(runs), b.column(0), b.column(1), b.column(2), pa.array(again), pa.nulls(n, pa.int64()), none], names)
    for kind, found in ((1, heads), (2, tails)):
        for run, first, fp, text in found:
            cols = [pa.array([kind], pa.int32()), pa.array([where], pa.int64()), pa.array([run], pa.int64()), pa.array([first], kind_of_id), pa.nulls(1, pa.string()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.bool_()), pa.array([fp], pa.int64()), pa.array([text], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names)


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, mask) of every row; see :func:`audit`."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.xxhash64(text).alias("fp"), text.alias("text"))
    # the ids split a large group of copies; texts would reach the driver in the sample that finds the ranges, and equal fingerprints stand for them there
    ranges = rows.repartitionByRange(F.col("fp"), F.col("id").asc_nulls_last()).sortWithinPartitions("fp", "text", F.col("id").asc_nulls_last())
    kind = rows.schema["id"].dataType.simpleString()
    # the masks come after the sort, as finding the ranges computes whatever comes before it a second time
    ranges = ranges.select("id", "part", own_failures(F.col("text")).alias("mask"), "fp", "text")
    found = ranges.mapInArrow(_runs, f"kind int, at long, run long, id {kind}, part string, mask int, again boolean, fp long, text string")
    found = materialize(found, "op13-runs")
    first = found.where("kind = 2").groupBy("fp", "text").agg(F.min("id").alias("first"))
    late = found.where("kind = 1").select("fp", "text", "id", F.col("at").alias("a"), F.col("run").alias("r")).join(first, ["fp", "text"]).where("first < id").select("a", "r")
    late = materialize(late, "op13-late")
    late = F.broadcast(late) if late.count() <= SEND_RUNS else late
    rows = found.where("kind = 0").join(late, (F.col("at") == F.col("a")) & (F.col("run") == F.col("r")), "left")
    repeated = F.col("again") | F.col("a").isNotNull()
    return rows.select("id", "part", (F.col("mask") + F.when(repeated, 1 << FILTERS.index("E")).otherwise(0)).cast("int").alias("mask"))


def orders() -> list[tuple[str, int, int, int]]:
    """(order, step, bits before it, bit) of all orders of the filters."""
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    return [("".join(o), k + 1, sum(bit[f] for f in o[:k]), bit[o[k]]) for o in permutations(FILTERS) for k in range(len(o))]


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each part, order and step.

    E, a repeated text: a smaller id has the same text anywhere in the table. A
    null text is empty; a null part is the part of the empty string; a row with
    a null id repeats nothing and makes nothing a repetition; rows with the same
    id and text do not repeat each other. A label counts for every row of its
    id; of several labels of one id, one with the value 1 is enough. Other
    columns are ignored; an empty table gives an empty result.
    """
    told = labels.select(F.col(f"`{id_col}`").alias("l"), (F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("t")).where("l is not null")
    told = told.groupBy("l").agg(F.max("q").alias("q"), F.max("t").alias("t"))
    one = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0))
    counters = masks(docs, id_col, text_col, part_col).join(told, F.col("id") == F.col("l"), "left").groupBy("part", "mask").agg(F.count("*").alias("n"), one("q").alias("good"), one("t").alias("bad"))
    counters = materialize(counters, "op13-counters")  # at most 32 rows a part
    m, before, bit = F.col("mask"), F.col("o.before"), F.col("o.bit")
    listed = json.dumps([{"filter_order": a, "step": k, "before": b, "bit": x} for a, k, b, x in orders()])  # one literal instead of thousands
    steps = F.from_json(F.lit(listed), "array<struct<filter_order:string,step:int,before:int,bit:int>>")
    rows = counters.select("*", F.explode(steps).alias("o"))
    fails, earlier = m.bitwiseAND(bit) != 0, m.bitwiseAND(before) != 0
    total = lambda test, n="n": F.sum(F.when(test, F.col(n)).otherwise(0)).cast("long")
    gone = fails & ~earlier
    # in the orders, a filter comes before all others that fail a row in 120 / (number of failures) of them
    shapley = F.sum(F.when(fails, F.col("n") * F.expr("120 div bit_count(mask)")).otherwise(0)).cast("long")
    return rows.groupBy("part", F.col("o.filter_order").alias("filter_order"), F.col("o.step").cast("int").alias("step")).agg(
        total(~fails & ~earlier).alias("kept"), total(gone).alias("removed"), total(fails & earlier).alias("redundant"), total(m == bit).alias("unique_fails"),
        total(gone, "good").alias("good_lost"), total(gone, "bad").alias("toxic_lost"), shapley.alias("shapley"),
    )
