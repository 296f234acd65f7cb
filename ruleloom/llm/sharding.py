"""Weighted rendezvous hashing of record keys onto shards, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.plans.durable import materialize

#: Slots are numbered within this many key ranges of each shard, side by side.
RANGES = 1_024
#: Rows that one window of a range numbers, and slots of repeated rows that are written as one run.
HELD = 1_000_000


def rendezvous(key: str | Column, weights: Sequence[float], seed: int = 0) -> Column:
    """The shard with the highest score -weight / ln(u) of the key.

    u in (0, 1) comes from a hash of the key and the shard number alone, so a
    new shard takes rows only into itself, in proportion to its weight, and a
    weight that falls gives rows only away. A null key has one fixed shard.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must not be negative, and one must be positive")
    key = F.col(key) if isinstance(key, str) else key
    scores = []
    for shard, weight in enumerate(weights):
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
        scores.append(F.struct((F.lit(-float(weight)) / F.ln(u)).alias("score"), F.lit(-shard).alias("shard")))
    best = scores[0] if len(scores) == 1 else F.greatest(*scores)
    return (-best["shard"]).cast("int")


def shard(docs: DataFrame, weights: Sequence[float], grown: Sequence[float], id_col: str = "doc_id", text_col: str = "text", seed: int = 0, ranges: int = RANGES) -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``.

    size is the text's UTF-8 length plus 1; slot numbers each shard's rows from
    0 without gaps, in the order of the key's range of hashes, a part of it,
    the key's hash, the key, the text's checksum and size; grown_shard is the
    shard under the weights ``grown``. Null texts have size 1 and the checksum
    of nothing; null keys share one shard; an empty table gives an empty result.

    Rows that are alike in all of these are counted first and get neighbouring
    slots, so repeated rows cost no more than one. A slot is the row's rank in
    its range plus the rows of the ranges before; ranges with many rows, those
    of a hot key, are split by checksum, so no task holds a shard or a key.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    kinds = kinds.groupBy("id", "size", "crc").agg(F.count("*").alias("m"))
    kinds = kinds.withColumns({"shard": rendezvous("id", weights, seed), "grown_shard": rendezvous("id", grown, seed), "at": F.xxhash64("id", F.lit(seed), F.lit("slot"))})
    kinds = kinds.withColumn("part", F.pmod(F.shiftright("at", 40), F.lit(ranges)).cast("int"))
    kinds = materialize(kinds, "op9-kinds")
    pieces = kinds.groupBy("shard", "part").agg(F.ceil(F.count("*") / HELD).cast("int").alias("pieces"))
    kinds = kinds.join(F.broadcast(pieces), ["shard", "part"])  # shards x ranges rows
    kinds = kinds.withColumn("piece", F.pmod(F.xxhash64("crc", "size"), F.col("pieces")).cast("int"))
    counts = kinds.groupBy("shard", "part", "piece").agg(F.sum("m").alias("n"))
    before = Window.partitionBy("shard").orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "part", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "part", "piece").orderBy("at", "id", "crc", "size").rowsBetween(Window.unboundedPreceding, -1)
    kinds = kinds.withColumn("ahead", F.coalesce(F.sum("m").over(inside), F.lit(0))).join(counts, ["shard", "part", "piece"])
    first = F.col("base") + F.col("ahead")
    # the slots of one kind, in runs; where some kind has several, different tasks write them out
    runs = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / HELD)), lambda r: F.struct((first + r * HELD).alias("a"), (first + F.least((r + 1) * HELD, F.col("m")) - 1).alias("b"))))
    many = kinds.agg(F.max("m")).first()[0] or 0
    kinds = kinds.withColumn("run", runs)
    kinds = kinds.repartition("run.a", "shard") if many > HELD else kinds
    slot = F.explode(F.sequence("run.a", "run.b"))
    return kinds.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", slot.alias("slot"), "grown_shard")
