"""Connected components by hooking, pointer jumping and edge contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.plans.durable import materialize, release


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(vertex, component) for every endpoint of ``edges`` (two columns of one type).

    The component is the smallest reachable vertex. Each round hooks every
    vertex to its smallest smaller neighbour, jumps pointers until all point to
    roots, and contracts the edges to roots; a star or a clique of any size
    takes one round, and every round at least halves the vertices that are
    left. Minima are combined before the shuffle and joins carry one label row
    a vertex, so a hub costs no more than its edge rows. Null endpoints and
    loops link nothing; an empty table gives an empty result.
    """
    a, b = edges.columns[:2]
    given = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    given = materialize(given.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc-edges")
    live, steps = given.where("u <> v"), []
    while not live.isEmpty():
        if len(steps) == max_rounds:
            raise RuntimeError("components did not settle")
        step = _jumped(live.groupBy(F.col("v").alias("x")).agg(F.min("u").alias("p")))
        step = materialize(_jumped(step), "cc-parents")
        while not step.where("moved").isEmpty():  # chains shorten by half each time
            shorter = materialize(_jumped(step), "cc-parents")
            release(step)
            step = shorter
        steps.append(step.select("x", "p"))
        pu, pv = (steps[-1].select(F.col("x").alias(c), F.col("p").alias(f"p{c}")) for c in "uv")
        moved = live.join(pu, "u", "left").join(pv, "v", "left").select(F.coalesce("pu", "u").alias("u"), F.coalesce("pv", "v").alias("v"))
        left = materialize(moved.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc-edges")
        release(live)  # of the first round it is a view of ``given``, which has no files of its own
        live = left
    ends = given.select("u").union(given.select(F.col("v").alias("u"))).distinct()
    out = ends.select(F.col("u").alias("vertex"), F.col("u").alias("component"))
    for n, step in enumerate(steps, 1):  # each round's roots hook in a later one
        later = step.select(F.col("x").alias("component"), F.col("p").alias("root"))
        out = out.join(later, "component", "left").select("vertex", F.coalesce("root", "component").alias("component"))
        out = out if n % 6 else materialize(out, "cc-labels")
    return out


def _jumped(step: DataFrame) -> DataFrame:
    """Every pointer (x, p) moved to its target's target, with whether it moved."""
    above = step.select(F.col("x").alias("p"), F.col("p").alias("pp"))
    return step.select("x", "p").join(above, "p", "left").select("x", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved"))
