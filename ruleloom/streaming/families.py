"""Family plans: every family's chunks one after the other, families side by side.

A chunk's payload is applied to the family as the chunks before it left it. The
rows of a plan are dealt by family and ordered by chunk, and a task reads them
as a stream: it holds the family that it is at, never a family's rows. A plan
runs in slices of chunks; each slice's families are a table of their own, which
the next slice's rows follow on, and a run that is broken off goes on after the
last whole slice.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleloom.plans.durable import exists

GROUPS = "array<struct<delta:string,member_ids:array<string>>>"
#: A family's row; ``next_chunk`` is the chunk it waits for, ``fault`` what ended it before its last chunk.
FAMILY = f"family_id {{0}}, version int, base_origin string, equivalent_member_ids array<string>, variant_groups {GROUPS}, next_chunk int, fault string"


def natural(unit: str) -> list:
    """Sorts ids with their numbers as numbers."""
    return [(1, int(x), "") if x.isdigit() else (0, 0, x.lower()) for x in re.findall(r"[0-9]+|[^0-9]+", unit)]


@dataclass
class Family:
    """A family's state: its equivalent members and its variant groups by their delta."""

    equivalent: list[str] = field(default_factory=list)
    groups: dict[str, list[str]] = field(default_factory=dict)
    version: int = 0
    base_origin: str = "ANCHORED"
    next_chunk: int = 1
    fault: str | None = None

    def members(self) -> list[str]:
        return [*self.equivalent, *(m for g in self.groups.values() for m in g)]

    def normal(self) -> list[dict]:
        """The groups in normal form: ids in natural order, groups by their first id."""
        made = [{"delta": d, "member_ids": sorted(ids, key=natural)} for d, ids in self.groups.items()]
        return sorted(made, key=lambda g: natural(g["member_ids"][0]))


#: (family before, chunk's (member_id, member_type, delta)) -> (equivalent ids, {delta: ids}), of all members, old and new.
Payload = Callable[[Family, list[tuple[str, str, str | None]]], tuple[list[str], dict[str, list[str]]]]


def by_delta(family: Family, members: list[tuple[str, str, str | None]]) -> tuple[list[str], dict[str, list[str]]]:
    """The offline payload: equivalent members join the base, variants the group of their delta."""
    equivalent, groups = list(family.equivalent), {d: list(ids) for d, ids in family.groups.items()}
    for member, kind, delta in members:
        if kind == "EQUIVALENT":
            equivalent.append(member)
        else:
            groups.setdefault(delta or "", []).append(member)
    return equivalent, groups


def apply(family: Family, chunk: int, members: list[tuple[str, str, str | None]], payload: Payload) -> Family:
    """The family after one chunk.

    A chunk that is not the one the family waits for, and a payload that does
    not hold every old and new member once, end the family with a fault: it
    stays as it was, and its later chunks are not applied.
    """
    if family.fault:
        return family
    if chunk != family.next_chunk:
        family.fault = f"chunk {chunk} came where chunk {family.next_chunk} is due"
        return family
    equivalent, groups = payload(family, members)
    made = [*equivalent, *(m for g in groups.values() for m in g)]
    wanted = [*family.members(), *(m for m, *_ in members)]
    if len(set(made)) != len(made) or sorted(made) != sorted(wanted) or not all(groups.values()):
        family.fault = f"the payload of chunk {chunk} does not hold each member once"
        return family
    changed = any(kind != "EQUIVALENT" for _, kind, _ in members)
    return Family(equivalent, groups, family.version + 1, "SYNTHESIZED" if changed else family.base_origin, chunk + 1)


def _schema(plan: DataFrame) -> str:
    return FAMILY.format(plan.schema["family_id"].dataType.simpleString())


def _slice(plan: DataFrame, before: DataFrame | None, low: int, high: int, payload: Payload) -> DataFrame:
    """The families after the chunks low to high, those without any as they were."""
    rows = plan.where(F.col("chunk").between(low, high)).select("family_id", "chunk", "position", "member_id", "member_type", "delta")
    state = F.struct("version", "base_origin", "equivalent_member_ids", "variant_groups", "next_chunk", "fault")
    kind = f"struct<version:int,base_origin:string,equivalent_member_ids:array<string>,variant_groups:{GROUPS},next_chunk:int,fault:string>"
    rows = rows.withColumn("state", F.lit(None).cast(kind))
    if before is not None:  # a family's state comes before its chunks
        nothing = F.lit(None).cast("string")
        given = before.select("family_id", F.lit(0).alias("chunk"), F.lit(0).cast(plan.schema["position"].dataType).alias("position"), nothing.alias("member_id"), nothing.alias("member_type"), nothing.alias("delta"), state.cast(kind).alias("state"))
        rows = rows.unionByName(given)
    rows = rows.repartition("family_id").sortWithinPartitions("family_id", "chunk", "position")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chunk, members, family, type_ = None, None, [], Family(), None
        started = False

        def out() -> pa.RecordBatch:
            cols = [pa.array([at], type_), pa.array([family.version], pa.int32()), pa.array([family.base_origin]), pa.array([sorted(family.equivalent, key=natural)], pa.list_(pa.string()))]
            cols += [pa.array([family.normal()], pa.list_(pa.struct([("delta", pa.string()), ("member_ids", pa.list_(pa.string()))]))), pa.array([family.next_chunk], pa.int32()), pa.array([family.fault], pa.string())]
            return pa.RecordBatch.from_arrays(cols, ["family_id", "version", "base_origin", "equivalent_member_ids", "variant_groups", "next_chunk", "fault"])

        for whole in batches:
            type_ = whole.schema.field(0).type
            for lo in range(0, whole.num_rows, 4096):
                for r in whole.slice(lo, 4096).to_pylist():
                    if not started or r["family_id"] != at:
                        if started:
                            family = apply(family, chunk, members, payload) if members else family
                            yield out()
                        at, chunk, members, family, started = r["family_id"], None, [], Family(), True
                    if s := r["state"]:
                        family = Family(s["equivalent_member_ids"], {g["delta"]: g["member_ids"] for g in s["variant_groups"]}, s["version"], s["base_origin"], s["next_chunk"], s["fault"])
                        continue
                    if members and r["chunk"] != chunk:
                        family, members = apply(family, chunk, members, payload), []
                    chunk = r["chunk"]
                    members.append((r["member_id"], r["member_type"], r["delta"]))
        if started:
            family = apply(family, chunk, members, payload) if members else family
            yield out()

    return rows.mapInArrow(run, _schema(plan))


def fold(plan: DataFrame, path: str, payload: Payload = by_delta, slice_: int = 1_000, most: int | None = None) -> DataFrame:
    """The families (see FAMILY) after all chunks of ``plan`` (family_id, chunk from 1, position, member_id, member_type, delta).

    Each slice of ``slice_`` chunks is a table below ``path``; called again with
    the same plan and path, a fold goes on after the last whole slice, and one
    that was broken off in its writing is made anew. ``most`` ends a run after
    so many slices. A null family is a family; rows of a null chunk are not
    applied; an empty plan has no families.
    """
    spark = plan.sparkSession
    last = plan.agg(F.max("chunk")).first()[0] or 0
    before, done, made = None, 0, 0
    at = lambda n: f"{path.rstrip('/')}/upto={n}"
    while done < last:
        upto = min(done + slice_, last)
        if not exists(spark, f"{at(upto)}/_SUCCESS"):
            if most is not None and made == most:
                break
            _slice(plan, before, done + 1, upto, payload).write.mode("overwrite").parquet(at(upto))
            made += 1
        before, done = spark.read.schema(_schema(plan)).parquet(at(upto)), upto
    return before if before is not None else spark.createDataFrame([], _schema(plan))
