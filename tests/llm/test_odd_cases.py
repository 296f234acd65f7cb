"""Clashing names, repeated ids, hot keys and every threshold."""

import math
import random
import zlib
from collections import Counter, defaultdict

import cases
import pytest
import xxhash
from pyspark.sql import functions as F

from ruleloom.llm import mixing, ngram_join, quality, sharding
from ruleloom.llm.line_dedup import line_dedup

CLASHES = ["_at", "_doc", "_version", "_lines", "_words", "_text", "_windows", "_sorted", "_twice", "_plan", "_h", "_s", "_source", "_k", "_said", "_order", "_part", "passes", "cut", "extra", "by_block", "source_size", "target", "shards", "shard", "copy", "part", "rest"]


def clashing(spark):
    return cases.frame(spark, cases.documents(8, 40)).select("*", *(F.lit(f"given {c}").alias(c) for c in CLASHES))


@pytest.mark.parametrize(
    ("run", "new"),
    [
        (lambda d: line_dedup(d, every_length=True).drop("text"), {"n_lines", "n_dropped", "text"}),
        (quality.ledger, {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "failures"}),
        (mixing.plan, {"size", "source_size", "target", "copies", "shards"}),
        (lambda d: mixing.mix(d).dropDuplicates(["id"]), {"shard", "copy"}),
    ],
)
def test_given_columns_stay(spark, run, new):
    docs = clashing(spark)
    stay = [c for c in docs.columns if c not in new]
    out = run(docs)
    assert len(out.columns) == len(set(out.columns))
    given = {tuple(r) for r in docs.select(stay).collect()}
    found = {tuple(r) for r in out.select(stay).collect()}
    assert found <= given and found


def test_rows_of_one_id_with_different_texts_are_documents_of_their_own(spark):
    rows = [(1, "A"), (5, "A"), (5, "B"), (5, "B"), (7, "B\nC\nC"), (7, "D"), (None, "A"), (9, None)]
    out = line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), every_length=True).collect()
    found = Counter((r["doc_id"], r["text"]) for r in out)
    assert found == Counter([(1, "A"), (5, ""), (5, "B"), (5, "B"), (7, "C"), (7, "D"), (None, "A"), (9, None)])


def test_a_long_text_of_repeats_is_no_trouble(spark):
    words = " ".join(f"w{i * 7919 % 100_000}" for i in range(100_000))
    lines = "\n".join(f"{i % 50_000:x} and so on, a line that is long enough" for i in range(100_000))
    (r,) = quality.ledger(spark.createDataFrame([(1, words + " " + words)], "doc_id long, text string")).select("n_words", "n_repeat_words").collect()
    assert r["n_words"] == r["n_repeat_words"] == 200_000
    (r,) = line_dedup(spark.createDataFrame([(1, lines)], "doc_id long, text string"), threshold=0).collect()
    assert r["n_dropped"] == 50_000 and r["text"] == lines[: len(r["text"])]


@pytest.mark.parametrize("percent", [50, 55, 60, 65, 75, 90])
def test_every_threshold_and_size_links_all(spark, percent):
    rng, rows, n = random.Random(percent), [], 0
    for size in [*range(1, 34), 60, 150]:
        base = [f"w{size}x{i}" for i in range(size)]
        rows.append((n, " ".join(base)))
        for other in {math.ceil(size * 100 / percent), math.floor(size * 100 / percent), size}:  # supersets at and over the edge, and exchanges of words
            extra = [f"y{n}x{i}" for i in range(max(0, other - size))]
            keep = base[:]
            if other == size:
                out = size * (100 - percent) // (100 + percent)
                keep = rng.sample(base, size - out)
                extra = [f"z{n}x{i}" for i in range(out)]
            n += 1
            rows.append((n, " ".join(rng.sample(keep + extra, len(keep + extra)))))
        n += 1
    out = ngram_join.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width=1, percent=percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == cases.jaccard_groups(rows, 1, percent)


def winner(key, shards, seed=0):
    """The shard of the smallest -1 / ln u, u from the chained 64-bit hashes of key, seed and shard."""
    best = None
    for s in range(shards):
        h = 42 if key is None else xxhash.xxh64(key.to_bytes(8, "little", signed=True), 42).intdigest()
        for x in (seed, s):
            h = xxhash.xxh64(x.to_bytes(4, "little"), h).intdigest()
        u = ((h >> 11) + 0.5) / float(1 << 53)
        if best is None or -1 / math.log(u) > best[0]:
            best = (-1 / math.log(u), s)
    return best[1]


def test_shards_are_the_rendezvous_winners_and_slots_have_no_gaps_under_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HELD", 50)
    rows = cases.documents(4, 100) + [(7, f"text {i}", *[None] * 9) for i in range(300)] + [(8, "same", *[None] * 9)] * 333
    out = sharding.shard(cases.frame(spark, rows), [1.0] * 16, [1.0] * 17).collect()
    assert Counter((r["doc_id"], r["text_crc32"]) for r in out) == Counter((r[0], zlib.crc32((r[1] or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in out:
        assert r["shard"] == winner(r["doc_id"], 16) and r["grown_shard"] == winner(r["doc_id"], 17)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_mixed_rows_lie_in_their_shards_in_shuffled_order(spark):
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("w"), 5)).alias("text"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"))
    want = Counter()
    for r in mixing.plan(docs).collect():
        want.update((s, r["doc_id"]) for s in r["shards"])
    where = mixing.mix(docs).withColumn("p", F.spark_partition_id()).collect()
    assert Counter((r["shard"], r["doc_id"]) for r in where) == want
    at = defaultdict(set)
    for r in where:
        at[r["p"]].add(r["shard"])
    assert all(len(x) == 1 for x in at.values()) and {s for x in at.values() for s in x} == set(range(16))
    ids = [r["doc_id"] for r in where if r["p"] == where[0]["p"]]
    assert ids != sorted(ids) and ids != sorted(ids, reverse=True)
    assert [tuple(r) for r in where] == [tuple(r) for r in mixing.mix(docs).withColumn("p", F.spark_partition_id()).collect()]


def test_the_tree_splits_quotas_as_the_hypergeometric_law_does(spark):
    units = spark.createDataFrame([(f"s{int(i >= 48)}", 0, i) for i in range(96)], "source string, pass int, block int")
    left = [mixing.dealt(units, 1, seed).where("shard = 0 and source = 's0'").count() for seed in range(40)]
    mean, var = 24, 48 * 0.5 * 0.5 * (96 - 48) / (96 - 1)
    assert abs(sum(left) / 40 - mean) < 4 * (var / 40) ** 0.5
    assert 0.4 * var < sum((x - mean) ** 2 for x in left) / 40 < 2.2 * var


def test_repeated_and_null_ids_come_near_their_target(spark):
    text = " ".join(f"w{i}" for i in range(10))
    for ids in ([1] * 60 + [2] * 40, [None] * 100, list(range(100))):
        df = spark.createDataFrame([(i, text, "a") for i in ids] + [(1000 + i, text, "b") for i in range(210)], "doc_id long, text string, source string")
        rows = mixing.plan(df).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target"), F.sum(F.size("shards")).alias("n"), F.sum("copies").alias("copies"), F.count("*").alias("rows")).collect()
        assert {r["source"]: r["rows"] for r in rows} == {"a": 100, "b": 210}
        assert all(abs(r["taken"] - r["target"]) <= 10 and r["n"] == r["copies"] for r in rows)
