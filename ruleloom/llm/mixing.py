"""Mixing sources to target weights, in DataFrame functions only.

Targets follow the weights up to a multiple of each source's size. A source is
taken in whole passes and one partial pass over its permutation (the order of a
hash of its keys), whose end is found on block sums first and then inside one
block only, so no task holds a source. The permutation is cut into blocks; each
pass over a block is one unit, and the units that a source's passes reach are
its quota. A binary splitting tree deals the quotas to the output shards: every
node permutes its units and sends an exact half to each side, which makes the
sources' counts of a half multivariate hypergeometric. Each shard then holds
disjoint blocks; the rows move to their shard and are shuffled inside it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.llm.names import fresh
from ruleloom.plans.durable import materialize

WEIGHTS = (5, 2, 1)
LIMIT = 3
#: Blocks of a source for the search of a pass's end; units of a pass for the shards: one for each row of a source, within these powers of two.
FINE_BITS, UNIT_BITS = 12, (4, 12)
#: Units whose shards are sent to every executor at most; more are joined by source and block.
SEND_UNITS = 1 << 20
#: Ranges of the hash in which units are ranked side by side.
RANK_BITS = 10
#: 2 ** LEVELS output shards.
LEVELS = 4


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sources in code point order, null last, weigh ``weights``, repeating. The
    targets share the sum of all sizes by weight; none is above ``limit`` times
    its source's size, and what that cuts off is shared again by weight.
    Sorted by the level at which a source is full, the sources that stop are a
    prefix, so one pass of running sums finds the common level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("full", F.col("source_size") * limit / F.col("w"))
    by_level = Window.orderBy("full", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * limit).over(before), F.lit(0))) / F.sum("w").over(rest))
    rows = rows.withColumn("stops", F.col("level") > F.col("full"))
    level = F.coalesce(F.max(F.when(~F.col("stops"), F.col("level"))).over(everything), F.lit(0.0))
    target = F.when(F.col("stops"), (F.col("source_size") * limit).cast("double")).otherwise(level * F.col("w"))
    return rows.select("source", "source_size", target.alias("target"))


def dealt(units: DataFrame, levels: int = LEVELS, seed: int = 0) -> DataFrame:
    """``units`` (source, pass, block) with ``shard``: exact halves at every node of the tree.

    The units are ranked once in the order of a hash, a random permutation; a
    node is a range of ranks, and its children are the range's halves, so each
    side's counts of the sources are multivariate hypergeometric draws from the
    node's. Ranks are counted within ranges of the hash, so no task holds all units.
    """
    h = F.xxhash64("source", "pass", "block", F.lit(seed))
    out = units.withColumn("h", h).withColumn("range", F.shiftrightunsigned("h", 64 - RANK_BITS).cast("int"))
    counts = out.groupBy("range").agg(F.count("*").alias("n"))  # at most 2 ** RANK_BITS rows
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("range", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"), F.sum("n").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"))
    inside = Window.partitionBy("range").orderBy("h", F.col("source").asc_nulls_last(), "pass", "block")
    out = out.withColumn("rank", F.row_number().over(inside)).join(F.broadcast(counts), "range")
    low, high, shard = F.lit(0).cast("long"), F.col("all"), F.lit(0)
    rank = F.col("base") + F.col("rank") - 1
    for _ in range(levels):  # from the root down: the node's range, and which half of it the unit is in
        middle = F.floor((low + high + 1) / 2).cast("long")
        right = rank >= middle
        low, high, shard = F.when(right, middle).otherwise(low), F.when(right, high).otherwise(middle), shard * 2 + right.cast("int")
        out = out.withColumns({"low": low, "high": high, "shard": shard})
        low, high, shard = F.col("low"), F.col("high"), F.col("shard")
    return out.drop("h", "range", "base", "all", "rank", "low", "high")


def _decided(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], limit: int, levels: int, seed: int, name: str) -> DataFrame:
    """``docs`` with one more column ``name``: struct(size, source_size, target, copies, shards)."""
    h, key, k, said, block, dealt_to, place = fresh([*docs.columns, name], "_h", "_source", "_k", "_said", "_block", "_dealt", "_place")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    out = docs.withColumns({name: size, key: F.col(source_col)})
    out = out.withColumn(h, F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(name), F.col(text_col), F.lit(seed)), 1))
    rows = materialize(out.select(F.col(key).alias("source"), F.col(name).alias("size"), F.col(h).alias("h")), "op8-sizes")
    sizes = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.ceil(F.log2(F.count("*"))).cast("int").alias("bits")), "op8-sources")
    aim = targets(sizes.select("source", "source_size"), weights, limit)
    aim = aim.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    aim = materialize(aim.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "op8-targets")

    # the block in which each source's partial pass ends, then the last key that fits and the first that does not
    goal = aim.select(F.col("source").alias("s"), "rest").where("rest > 0")
    fine = F.shiftright("h", 63 - FINE_BITS)
    upto = Window.partitionBy("source").orderBy("fine").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("source", fine.alias("fine")).agg(F.sum("size").alias("words")).withColumn("base", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    edge = materialize(blocks.join(_few(goal), F.col("source").eqNullSafe(F.col("s"))).where("base <= rest and base + words > rest").select("s", "rest", "base", F.col("fine").alias("edge")), "op8-edges")
    near = rows.withColumn("fine", fine).join(_few(edge), F.col("source").eqNullSafe(F.col("s")) & (F.col("fine") == F.col("edge"))).groupBy("s", "rest", "base", "h").agg(F.sum("size").alias("words"), F.max("size").alias("size"), F.count("*").alias("m"))
    inside = Window.partitionBy("s").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = near.withColumn("upto", F.col("base") + F.sum("words").over(inside))
    fits = F.col("upto") <= F.col("rest")
    near = near.groupBy("s").agg(F.max(F.when(fits, F.col("h"))).alias("last"), F.max(F.when(fits, F.col("upto"))).alias("upto"), F.min(F.when(~fits, F.struct("h", "size", "m"))).alias("next"))
    cut = edge.join(near.withColumnRenamed("s", "n"), F.col("s").eqNullSafe(F.col("n")), "left")
    start = F.shiftleft("edge", 63 - FINE_BITS) - 1
    cut = cut.select("s", F.coalesce("last", start).alias("cut"), (F.col("rest") - F.coalesce("upto", "base")).alias("gap"), "next")
    # equal rows share a key: of those at the edge as many are taken as fit
    some = F.when(F.col("next.m") > 1, F.least(F.col("next.m"), F.floor(F.col("gap") / F.col("next.size")))).otherwise(0).cast("long")
    cut = materialize(cut.withColumn("some", F.coalesce(some, F.lit(0))).select("s", "cut", (F.col("gap") - F.col("some") * F.coalesce("next.size", F.lit(0))).alias("gap"), "some", F.col("next.h").alias("next"), F.col("next.m").alias("m")), "op8-cuts")
    # and one row more that brings the sum nearer
    spare = rows.join(_few(cut), F.col("source").eqNullSafe(F.col("s"))).where("h > cut and (h <> next or some < m) and abs(size - gap) < gap")
    spare = materialize(spare.groupBy("s").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), F.col("h"))).alias("x")).select(F.col("s").alias("z"), F.col("x.h").alias("extra")), "op8-spares")
    cut = cut.join(spare, F.col("s").eqNullSafe(F.col("z")), "left").select(F.col("s").alias("c"), "cut", "extra", "next", "some")
    same = (F.col("extra") == F.col("next")).eqNullSafe(True)
    parts = cut.select("c", F.explode(F.array(F.struct(F.col("next").alias("h"), (F.col("some") + same.cast("int")).alias("wanted")), F.struct(F.when(~same, F.col("extra")).alias("h"), F.lit(1).cast("long").alias("wanted")))).alias("p"))
    parts = parts.select("c", F.col("p.h").alias("partial"), "p.wanted").where("partial is not null and wanted > 0")
    there = rows.join(_few(parts), F.col("source").eqNullSafe(F.col("c")) & (F.col("h") == F.col("partial"))).groupBy("c", "partial", "wanted").agg(F.count("*").alias("m"))
    parts = materialize(there, "op8-partial")  # two keys a source at most
    extras = parts.groupBy(F.col("c").alias("z")).agg(F.collect_set("partial").alias("extras"))
    aim = materialize(aim.join(cut.select("c", "cut"), F.col("source").eqNullSafe(F.col("c")), "left").join(extras, F.col("source").eqNullSafe(F.col("z")), "left").join(sizes.select(F.col("source").alias("y"), F.least(F.greatest("bits", F.lit(UNIT_BITS[0])), F.lit(UNIT_BITS[1])).alias("bits")), F.col("source").eqNullSafe(F.col("y")), "left").select("source", "source_size", "target", "passes", F.coalesce("cut", F.lit(-1)).alias("cut"), F.coalesce("extras", F.array().cast("array<bigint>")).alias("extras"), "bits"), "op8-plan")

    # the sources' quotas: all blocks in whole passes, in the partial pass those that it reaches
    unit = lambda c, bits: F.call_function("shiftright", c, F.lit(63) - bits).cast("int")
    passes = aim.select("source", "passes", "bits", unit(F.col("cut"), F.col("bits")).alias("edge"), F.transform("extras", lambda x: unit(x, F.col("bits"))).alias("spare"), F.explode(F.sequence(F.lit(0), F.col("passes"))).alias("pass"))
    units = passes.select("*", F.explode(F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.col("bits")) - 1)).alias("block"))
    units = units.where("pass < passes or block <= edge or array_contains(spare, block)").select("source", "pass", "block")
    shards = dealt(units, levels, seed).groupBy("source", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"]).alias("shard"))  # a pass each
    shards = materialize(shards.select(F.col("source").alias(k), F.col("block").alias(block), F.col("shard").alias(dealt_to)), "op8-decisions")
    aim = aim.select(F.col("source").alias(k), F.struct("source_size", "target", "passes", "cut", "extras", "bits").alias(said))
    out = out.join(_few(aim), F.col(key).eqNullSafe(F.col(k)), "left").drop(k)
    d = F.col(said)
    open_ = materialize(parts.where("wanted < m").select(F.col("c").alias(k), F.col("partial"), "wanted"), "op8-open")
    last = (F.col(h) <= d["cut"]) | F.array_contains(d["extras"], F.col(h))
    if open_.isEmpty():
        out = out.withColumn(place, last)
    else:  # equal rows of which only some are taken are numbered: inside the tasks that read them, then across
        wanted, mine = fresh([*out.columns, "partial"], "_wanted", "_in")
        keyed = (F.col(key).eqNullSafe(F.col(k))) & (F.col(h) == F.col("partial"))
        few = _few(open_.withColumnRenamed("wanted", wanted))
        some = materialize(out.join(few, keyed).drop(k, "partial").withColumn(mine, F.spark_partition_id()), "op8-numbered")
        counts = some.groupBy(key, h, mine).agg(F.count("*").alias("n")).select(F.col(key).alias(k), F.col(h).alias("partial"), F.col(mine).alias("part"), F.coalesce(F.sum("n").over(Window.partitionBy(key, h).orderBy(mine).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        rank = F.row_number().over(Window.partitionBy(key, h, mine).orderBy(F.lit(0)))
        some = some.withColumn(place, rank).join(counts, keyed & (F.col(mine) == F.col("part"))).withColumn(place, F.col("before") + F.col(place) <= F.col(wanted)).drop(k, "partial", "part", "before", wanted, mine)
        out = out.join(few, keyed, "left_anti").withColumn(place, last).unionByName(some)
    copies = d["passes"] + F.col(place).cast("int")
    out = out.withColumn(block, unit(F.col(h), d["bits"]))
    shards = F.broadcast(shards) if shards.count() <= SEND_UNITS else shards
    out = out.join(shards.withColumnRenamed(block, f"{block}of"), F.col(key).eqNullSafe(F.col(k)) & (F.col(block) == F.col(f"{block}of")), "left")
    taken = F.slice(F.coalesce(F.col(dealt_to), F.array().cast("array<int>")), F.lit(1), copies)
    made = F.struct(F.col(name).alias("size"), d["source_size"].alias("source_size"), d["target"].alias("target"), copies.alias("copies"), taken.alias("shards"))
    return out.withColumn(name, made).drop(h, key, k, said, block, f"{block}of", dealt_to, place)


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, limit: int = LIMIT, levels: int = LEVELS, seed: int = 0) -> DataFrame:
    """``docs`` with size, source_size, target, copies and shards (one for each copy).

    size is the number of words (runs outside 0x20 and 0x09-0x0D; a null text
    has none). Every document is taken ``floor(target / source_size)`` times;
    those up to a cut of the permutation once more, and one last document of
    the source if it brings the sum nearer to the target. Empty texts belong to
    the copies but add no words. Rows that share id and text lie at one place of
    the permutation; where the cut falls on them, as many of them are taken as
    fit, whichever. A null source is a source; an empty table gives an empty result.
    Columns of the new names are replaced, all others stay. The table of
    sources, a row each, passes through one task.
    """
    (name,) = fresh(docs.columns, "_plan")
    out = _decided(docs, id_col, text_col, source_col, weights, limit, levels, seed, name)
    new = ("size", "source_size", "target", "copies", "shards")
    given = [c for c in docs.columns if c.lower() not in new]
    return out.select(*(F.col(f"`{c}`") for c in given), *(F.col(f"{name}.{c}") for c in new))


def _few(df: DataFrame, most: int = 20_000) -> DataFrame:
    """A table with a row a source, broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, limit: int = LIMIT, levels: int = LEVELS, seed: int = 0) -> DataFrame:
    """The mixed rows: every copy of a document as a row, moved to its shard, in shuffled order within it.

    The columns are those of ``docs`` and ``shard``, ``copy``; given columns of
    those two names are replaced. A shard is a run of whole partitions, as many
    for each as the session's shuffle partitions allow, and its rows are
    shuffled: dealt to its partitions and ordered in each by a hash.
    """
    name, order, part = fresh(docs.columns, "_plan", "_order", "_part")
    planned = _decided(docs, id_col, text_col, source_col, weights, limit, levels, seed, name)
    given = [c for c in docs.columns if c.lower() not in ("shard", "copy")]
    rows = planned.select(*(F.col(f"`{c}`") for c in given), F.posexplode(F.col(name)["shards"]).alias("copy", "shard"), F.col(f"`{id_col}`").alias(part))
    rows = rows.withColumn(order, F.xxhash64(part, "copy", F.lit(seed + 1)))
    each = max(1, -(-int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) >> levels))
    rows = rows.withColumn(part, F.col("shard") * each + F.pmod(F.shiftright(order, 20), F.lit(each)).cast("int"))
    return rows.repartitionById(each << levels, F.col(part)).sortWithinPartitions("shard", order).drop(order, part)
