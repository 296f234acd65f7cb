"""Integrity constraints as queries: each returns its violations (constraint, key, detail)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _said(rows: DataFrame, name: str, key: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(name).alias("constraint"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def unique(rows: DataFrame, *key: str) -> DataFrame:
    twice = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return _said(twice, "unique", F.concat_ws("|", *(F.col(k).cast("string") for k in key)), F.col("n"))


def filled(rows: DataFrame, key: str, *fields: str) -> DataFrame:
    """Strings that are null or blank."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.trim(F.col(f)), F.lit("")).alias("value")) for f in fields)))
    return _said(rows.select(F.col(key).alias("k"), each.alias("x")).where("x.value = ''"), "filled", F.col("k"), F.col("x.field"))


def distinct_items(rows: DataFrame, key: str, items: str) -> DataFrame:
    """Arrays with null, blank or repeated items."""
    clean = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    bad = rows.withColumn("_d", F.size(items) - F.size(F.array_distinct(clean))).where("_d <> 0")
    return _said(bad, "distinct_items", F.col(key), F.col("_d"))


def disjoint(groups: DataFrame, known: DataFrame, group: str, member: str) -> DataFrame:
    """Members in several groups, and members that are not known. ``groups`` has a row a membership."""
    several = groups.groupBy(member).agg(F.count_distinct(group).alias("n")).where("n > 1")
    unknown = groups.join(known.select(F.col(member)), member, "left_anti").select(member).distinct()
    return _said(several, "disjoint", F.col(member), F.col("n")).unionAll(_said(unknown, "known", F.col(member), F.lit("unknown")))


def leftovers(groups: DataFrame, known: DataFrame, member: str) -> DataFrame:
    """Known members without a group: singletons."""
    return known.select(member).join(groups.select(member), member, "left_anti")


def partition(whole: DataFrame, parts: DataFrame, member: str, group: str, least: int = 2, most: int = 25) -> DataFrame:
    """``parts`` must cover ``whole`` exactly once, in groups of least to most members, or single ones."""
    missing = whole.select(member).join(parts.select(member), member, "left_anti")
    extra = parts.select(member).join(whole.select(member), member, "left_anti")
    sizes = parts.groupBy(group).agg(F.count("*").alias("n")).where((F.col("n") > most) | ((F.col("n") < least) & (F.col("n") > 1)))
    return reduce(DataFrame.unionAll, [unique(parts, member), _said(missing, "covered", F.col(member), F.lit("missing")), _said(extra, "covered", F.col(member), F.lit("extra")), _said(sizes, "group_size", F.col(group), F.col("n"))])


def contiguous(rows: DataFrame, by: str, rank: str, item: str, k: int | None = None, no_self: bool = True) -> DataFrame:
    """Ranked lists: ranks 1..n, no item twice, none the list's own, and all of one length ``k``."""
    per = rows.groupBy(by).agg(F.count("*").alias("n"), F.min(rank).alias("lo"), F.max(rank).alias("hi"), F.count_distinct(rank).alias("ranks"), F.count_distinct(item).alias("items"), F.count_if(F.col(item) == F.col(by)).alias("own"))
    checks = [("ranks", (F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("ranks") != F.col("n"))), ("repeated_item", F.col("items") != F.col("n"))]
    if no_self:
        checks.append(("own_item", F.col("own") > 0))
    if k is not None:
        checks.append(("length", F.col("n") != k))
    return reduce(DataFrame.unionAll, [_said(per.where(bad), name, F.col(by), F.col("n")) for name, bad in checks])


def vectors(rows: DataFrame, key: str, vector: str, dimensions: int) -> DataFrame:
    """Vectors of another length, or zero, or with null or non-finite components."""
    v = F.col(vector)
    bad = F.when(v.isNull(), "null").when(F.size(v) != dimensions, "dimensions")
    bad = bad.when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not finite").when(F.forall(v, lambda x: x == 0), "zero")
    return _said(rows.withColumn("_w", bad).where("_w is not null"), "vector", F.col(key), F.col("_w"))


def situations(rows: DataFrame, key: str, start: str, end: str, text: str) -> DataFrame:
    """Step ranges must be whole numbers with 1 <= start <= end, and the text filled."""
    a, b = F.col(start).cast("string").try_cast("long"), F.col(end).cast("string").try_cast("long")
    bad = F.when(a.isNull() | b.isNull(), "not whole").when(a < 1, "starts before 1").when(b < a, "ends before start").when(F.coalesce(F.trim(text), F.lit("")) == "", "no text")
    return _said(rows.withColumn("_w", bad).where("_w is not null"), "situation", F.col(key), F.col("_w"))


def queue(state: DataFrame, pending: DataFrame, order: str, key: str) -> DataFrame:
    """Serial orders are dense from 0, and no pending unit is already in the state."""
    span = pending.agg(F.count("*").alias("n"), F.min(order).alias("lo"), F.max(order).alias("hi"), F.count_distinct(order).alias("d"))
    holes = span.where("n > 0 and (lo <> 0 or hi <> n - 1 or d <> n)")
    return _said(holes, "dense_order", F.lit("queue"), F.col("n")).unionAll(_said(pending.join(state.select(key), key, "left_semi"), "pending", F.col(key), F.lit("already in the state")))


def serial_state(processed: DataFrame, queue: DataFrame, order: str, key: str, version: int) -> DataFrame:
    """The processed units are the queue's first ones, the version is their number, and the queue is not empty.

    processed: key; queue: order from 0, key. A unit that is in one of the two
    prefixes only is named, with where it is missing.
    """
    n = processed.select(key).where(F.col(key).isNotNull()).distinct().count()
    prefix = queue.where(F.col(order) < n).select(key)
    done = processed.select(key)
    spark = queue.sparkSession
    figures = [(c, "queue", d) for c, d, bad in (("version", f"{version} of {n}", version != n), ("empty_queue", "0", queue.isEmpty())) if bad]
    out = spark.createDataFrame(figures, "constraint string, key string, detail string")
    out = out.unionAll(_said(prefix.join(done, key, "left_anti"), "prefix", F.col(key), F.lit("not processed")))
    return out.unionAll(_said(done.join(prefix, key, "left_anti"), "prefix", F.col(key), F.lit("not next in the queue")))


def one_of(whole: DataFrame, key: str, **parts: DataFrame) -> DataFrame:
    """Every key of ``whole`` lies in exactly one of the named parts, and the parts hold no other key."""
    each = reduce(DataFrame.unionAll, [p.select(F.col(key).alias("k"), F.lit(name).alias("part")).distinct() for name, p in parts.items()])
    where = each.groupBy("k").agg(F.array_join(F.array_sort(F.collect_list("part")), ",").alias("parts"), F.count("*").alias("n"))  # at most one entry a part
    found = whole.select(F.col(key).alias("w")).distinct().join(where, F.col("w") == F.col("k"), "full")
    bad = found.where("w is null or k is null or n > 1")
    detail = F.when(F.col("w").isNull(), "unknown").when(F.col("k").isNull(), "in no part").otherwise(F.concat(F.lit("in "), "parts"))
    return _said(bad, "one_part", F.coalesce("w", "k"), detail)


def enforce(violations: DataFrame) -> None:
    """Raise with the first violations; a decision of the caller, after which rows may be quarantined instead."""
    if found := violations.limit(5).collect():
        raise ValueError("; ".join(f"{r['constraint']}: {r['key']} ({r['detail']})" for r in found))


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str], fingerprint: str) -> DataFrame:
    """Work without a result under the same fingerprint."""
    return work.join(done.select(*keys, fingerprint), [*keys, fingerprint], "left_anti")


def conflicts(work: DataFrame, done: DataFrame, keys: Sequence[str], fingerprint: str) -> DataFrame:
    """Results of the same keys under another fingerprint: a run over other inputs."""
    other = done.select(*keys, F.col(fingerprint).alias("_f"))
    bad = work.join(other, list(keys)).where(F.col(fingerprint) != F.col("_f"))
    return _said(bad, "fingerprint", F.concat_ws("|", *(F.col(k).cast("string") for k in keys)), F.col("_f"))


def complete_results(rows: DataFrame, by: Sequence[str], item: str, score: str, k: int) -> DataFrame:
    """(by..., complete): k results with different items and scores."""
    return rows.groupBy(*by).agg(((F.count("*") == k) & (F.count_distinct(item) == k) & (F.count(score) == k)).alias("complete"))


def audit(**checks: tuple[DataFrame, Column]) -> DataFrame:
    """(name, passed, detail): one aggregate a check, over its table."""
    return reduce(DataFrame.unionAll, [t.agg(c.alias("v")).select(F.lit(n).alias("name"), F.col("v.passed").alias("passed"), F.col("v.detail").cast("string").alias("detail")) for n, (t, c) in checks.items()])
