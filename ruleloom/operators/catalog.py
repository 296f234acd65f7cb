"""Catalog of rule families: reshaping, lookups, sync planning and assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ruleloom.functions.keys import natural_key
from ruleloom.plans.durable import materialize


def unnest(families: DataFrame) -> DataFrame:
    """(family_id, member_id, member_type, group_index) from equivalent_member_ids and variant_groups."""
    equal = families.select("family_id", F.explode("equivalent_member_ids").alias("member_id"), F.lit("EQUIVALENT").alias("member_type"), F.lit(None).cast("int").alias("group_index"))
    groups = families.select("family_id", F.posexplode("variant_groups").alias("group_index", "g"))
    variant = groups.select("family_id", F.explode("g.member_ids").alias("member_id"), F.lit("VARIANT").alias("member_type"), "group_index")
    return equal.unionByName(variant)


def nest(members: DataFrame) -> DataFrame:
    """Families (equivalent_member_ids, variant_groups, member_ids, member_count) from the flat rows; for a sink."""
    groups = members.where("group_index is not null").groupBy("family_id", "group_index").agg(F.array_sort(F.collect_list("member_id")).alias("member_ids"))
    groups = groups.groupBy("family_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("group_index", "member_ids"))), lambda g: F.struct(g["member_ids"].alias("member_ids"))).alias("variant_groups"))
    equal = members.groupBy("family_id").agg(F.array_sort(F.collect_list(F.when(F.col("group_index").isNull(), F.col("member_id")))).alias("equivalent_member_ids"), F.array_sort(F.collect_list("member_id")).alias("member_ids"), F.count("*").alias("member_count"))
    empty = F.array().cast(groups.schema["variant_groups"].dataType)
    return equal.join(groups, "family_id", "left").withColumn("variant_groups", F.coalesce("variant_groups", empty))


def normal_families(families: DataFrame) -> DataFrame:
    """Families (equivalent_member_ids, variant_groups, ...) in normal form, with member_ids, member_count, base_origin and ``faults``.

    Ids are distinct, trimmed and in natural order, groups in the order of
    their first ids. ``base_origin`` is SYNTHESIZED where base differs from
    base_before, else origin_before. Faults: repeated (an id twice), blank (an
    empty id), empty_group, few (less than two members); a family without any
    has an empty list. Works on each family by itself.
    """
    ids = lambda a: F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.trim(x))
    ordered = lambda a: F.transform(F.array_sort(F.transform(F.array_distinct(a), lambda x: F.struct(natural_key(x).alias("k"), x.alias("x")))), lambda s: s["x"])
    groups = F.coalesce(F.col("variant_groups"), F.array().cast(families.schema["variant_groups"].dataType))
    out = families.withColumns({"_e": ids(F.col("equivalent_member_ids")), "_g": F.transform(groups, lambda g: ids(g["member_ids"]))})
    out = out.withColumn("_all", F.concat("_e", F.flatten("_g")))
    sorted_groups = F.transform(F.array_sort(F.transform(F.filter("_g", lambda g: F.size(g) > 0), lambda g: F.struct(natural_key(ordered(g)[0]).alias("k"), ordered(g).alias("g")))), lambda s: F.struct(s["g"].alias("member_ids")))
    fault = lambda name, when: F.when(when, F.lit(name))
    faults = F.array_compact(F.array(fault("repeated", F.size("_all") != F.size(F.array_distinct("_all"))), fault("blank", F.exists("_all", lambda x: x == "")), fault("empty_group", F.exists("_g", lambda g: F.size(g) == 0)), fault("few", F.size(F.array_distinct("_all")) < 2)))
    member_ids = ordered(F.col("_all"))
    out = out.withColumns({"equivalent_member_ids": ordered(F.col("_e")), "variant_groups": sorted_groups, "member_ids": member_ids, "member_count": F.size(member_ids).cast("long"), "base_origin": F.when(F.col("base").eqNullSafe(F.col("base_before")), F.col("origin_before")).otherwise("SYNTHESIZED"), "faults": faults})
    return out.drop("_e", "_g", "_all")


def sync_actions(bases: DataFrame, active: DataFrame, sources: DataFrame) -> DataFrame:
    """(family_id, action, reused_from): KEEP, GENERATE_CHANGED, REUSE_SOURCE or GENERATE_NEW for each base.

    bases: family_id, sha, text; active: family_id, sha; sources: id, text. A
    new base takes the vector of the smallest source id with the same text.
    """
    by_text = sources.groupBy("text").agg(F.min("id").alias("source_id"))
    out = bases.join(active.select("family_id", F.col("sha").alias("active_sha")), "family_id", "left").join(by_text, "text", "left")
    action = F.when(F.col("active_sha") == F.col("sha"), "KEEP").when(F.col("active_sha").isNotNull(), "GENERATE_CHANGED").when(F.col("source_id").isNotNull(), "REUSE_SOURCE").otherwise("GENERATE_NEW")
    return out.select("family_id", action.alias("action"), F.when(action == "REUSE_SOURCE", F.col("source_id")).alias("reused_from"))


def active_vectors(bases: DataFrame, initial: DataFrame, updates: DataFrame) -> DataFrame:
    """(family_id, seq, vector): the newest update of the current hash, else the initial vector of that hash.

    bases: family_id, sha; initial and updates: family_id, sha, vector, and
    updates a seq; initial vectors have seq -1.
    """
    every = initial.select("family_id", "sha", "vector", F.lit(-1).cast("long").alias("seq")).unionByName(updates.select("family_id", "sha", "vector", F.col("seq").cast("long").alias("seq")))
    valid = every.join(bases.select("family_id", "sha"), ["family_id", "sha"], "left_semi")
    return valid.groupBy("family_id").agg(F.max("seq").alias("seq"), F.max_by("vector", "seq").alias("vector"))


def text_vectors(rows: DataFrame, text: str, key: str, vector: str) -> DataFrame:
    """One vector a text, that of the smallest id."""
    return rows.groupBy(text).agg(F.min(key).alias(key), F.min_by(vector, key).alias(vector))


def enriched(results: DataFrame, bases: DataFrame, variants: DataFrame, keep: int = 30) -> DataFrame:
    """Results (qid, family_id, member_id, rank) with the matched text: the base's, or the matched member's.

    bases: family_id, text; variants: member_id, text. A match without its
    text is reported by a null matched_text, not dropped.
    """
    base = bases.select("family_id", F.col("text").alias("base_text"))
    member = variants.select("member_id", F.col("text").alias("member_text"))
    out = results.where(F.col("rank") <= keep).join(base, "family_id", "left").join(member, "member_id", "left")
    return out.withColumn("matched_type", F.when(F.col("member_id").isNull(), "BASE").otherwise("VARIANT_MEMBER")).withColumn("matched_text", F.when(F.col("member_id").isNull(), F.col("base_text")).otherwise(F.col("member_text"))).drop("member_text")


def accepted_groups(judgments: DataFrame, candidates: DataFrame) -> DataFrame:
    """(family_id, n_units, n_equivalent, best_score, unit_ids) of accepted judgments with their one candidate row."""
    rows = judgments.where("decision in ('EQUIVALENT', 'VARIANT')").join(candidates, ["unit_id", "family_id"])
    return rows.groupBy("family_id").agg(F.count("*").alias("n_units"), F.count_if(F.col("decision") == "EQUIVALENT").alias("n_equivalent"), F.max("score").alias("best_score"), F.array_sort(F.collect_list("unit_id")).alias("unit_ids"))


def candidate_texts(candidates: DataFrame, bases: DataFrame, units: DataFrame, deltas: DataFrame) -> DataFrame:
    """Candidates (qid, family_id, member_id) with a document: base text, or the unit's text and its group's delta."""
    out = candidates.join(bases.select("family_id", F.col("text").alias("_b")), "family_id", "left")
    out = out.join(units.select(F.col("unit_id").alias("member_id"), F.col("text").alias("_u")), "member_id", "left").join(deltas.select("member_id", "delta"), "member_id", "left")
    return out.withColumn("document", F.when(F.col("member_id").isNull(), F.col("_b")).otherwise(F.concat_ws("\n", "_u", "delta"))).drop("_b", "_u", "delta")


def origins(candidates: DataFrame, states: DataFrame) -> DataFrame:
    """Candidates with the provenance of their family; families without a state are INITIAL."""
    return candidates.join(states.select("family_id", "origin"), "family_id", "left").withColumn("origin", F.coalesce("origin", F.lit("INITIAL")))


def dynamic_candidates(candidates: DataFrame) -> DataFrame:
    return candidates.where("origin = 'INGESTED_NO_MATCH'")


def assembled(families: DataFrame, unmatched: DataFrame, regrouped: DataFrame, regenerated: DataFrame) -> DataFrame:
    """(family_id, origin, member_id): the final catalog's memberships.

    families: family_id, member_id; unmatched: family_id kept as it is;
    regrouped: family_id, group_id (a family without a group is a singleton and
    kept); regenerated: group_id, new_family_id, member_id. A member of a
    regrouped family that no new family took keeps to its old family as an
    orphan.
    """
    kept = families.join(unmatched.select("family_id"), "family_id", "left_semi").select("family_id", F.lit("GRAPH_UNMATCHED").alias("origin"), "member_id")
    matched = families.join(unmatched.select("family_id"), "family_id", "left_anti").join(regrouped, "family_id", "left")
    single = matched.where("group_id is null").select("family_id", F.lit("SINGLETON").alias("origin"), "member_id")
    grouped = matched.where("group_id is not null")
    new = regenerated.select(F.col("new_family_id").alias("family_id"), F.lit("REGENERATED").alias("origin"), "member_id")
    orphan = grouped.join(regenerated.select("member_id"), "member_id", "left_anti").select("family_id", F.lit("ORPHAN").alias("origin"), "member_id")
    return kept.unionByName(single).unionByName(new).unionByName(orphan)


def usage_totals(log: DataFrame, by: Sequence[str], usage: str) -> DataFrame:
    """(by..., key, total): sums over the keys of a usage map."""
    return log.select(*by, F.explode(usage).alias("key", "value")).groupBy(*by, "key").agg(F.sum("value").alias("total"))


def nested_usage(log: DataFrame, document: str, pattern: str = "token", names: Sequence[str] = ("requests", "request_count")) -> DataFrame:
    """(key, total) over all whole numbers below a JSON document whose key holds ``pattern`` or is one of ``names``, whatever the case, at any depth.

    Documents are parsed, so text inside string values is never read as a key.
    Values are taken apart level by level until none is left; no document is
    gathered. A document that is no JSON has no numbers.
    """
    fits = F.lower("key").contains(pattern.lower()) | F.lower("key").isin([n.lower() for n in names])
    level = log.select(F.try_parse_json(F.col(document)).alias("v")).where("v is not null")
    found = None
    while True:
        level = materialize(level.select(F.to_json("v").alias("j")), "usage-level").select(F.parse_json("j").alias("v"))
        objects = level.where(F.schema_of_variant("v").startswith("OBJECT")).lateralJoin(log.sparkSession.tvf.variant_explode(F.col("v").outer())).select("key", F.col("value"))
        lists = level.where(F.schema_of_variant("v").startswith("ARRAY")).lateralJoin(log.sparkSession.tvf.variant_explode(F.col("v").outer())).select(F.lit(None).cast("string").alias("key"), F.col("value"))
        parts = objects.unionAll(lists).withColumn("kind", F.schema_of_variant("value"))
        here = parts.where(fits & (F.col("kind") == "BIGINT")).select("key", F.expr("try_variant_get(value, '$', 'bigint')").alias("n"))
        here = materialize(here, "usage-numbers")
        found = here if found is None else found.unionAll(here)
        level = parts.where(F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")).select(F.col("value").alias("v"))
        if level.isEmpty():
            return found.groupBy("key").agg(F.sum("n").alias("total"))


def coverage(rows: DataFrame, condition: Sequence[str], case: str) -> DataFrame:
    """(condition..., n_cases, signature, same): whether every condition has the same set of cases.

    A signature is an order-free sum of the cases' hashes, with their number,
    so no set is gathered; equal sets have equal ones, and different ones differ
    but for a collision of 128 bits.
    """
    once = rows.select(*condition, F.col(case).cast("string").alias("_case")).distinct()
    half = lambda seed: F.sum((F.xxhash64("_case", F.lit(seed))).cast("decimal(38,0)"))
    per = once.groupBy(*condition).agg(F.count("_case").alias("n_cases"), half(1).alias("_a"), half(2).alias("_b"))
    per = per.withColumn("signature", F.sha2(F.concat_ws(",", "n_cases", F.col("_a").cast("string"), F.col("_b").cast("string")), 256)).drop("_a", "_b")
    every = per.agg(F.min("signature").alias("_low"), F.max("signature").alias("_high"))
    return per.crossJoin(F.broadcast(every)).withColumn("same", F.col("_low") == F.col("_high")).drop("_low", "_high")  # one row


def joined_text(rows: DataFrame, by: Sequence[str], order: Column, line: Column, top: int | None = None, sep: str = "\n") -> DataFrame:
    """(by..., n, text): lines in order, the first ``top`` of each group."""
    r = rows.select(*by, order.alias("_o"), line.alias("_t"))
    if top is not None:
        r = r.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_o"))).where(F.col("_r") <= top)
    items = F.array_sort(F.collect_list(F.struct("_o", "_t")))
    return r.groupBy(*by).agg(F.count("*").alias("n"), F.array_join(F.transform(items, lambda x: x["_t"]), sep).alias("text"))


def steps_in_range(steps: DataFrame, ranges: DataFrame, case: str = "case_id") -> DataFrame:
    """Ranges (case, start_step, end_step, ...) with each step they hold: the range's steps are exploded and equi-joined."""
    each = ranges.withColumn("step_id", F.explode(F.sequence("start_step", "end_step")))
    return each.join(steps, [case, "step_id"])


def case_histories(steps: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, history): a case's steps as one array of (step_id, page, action, after_page), in order; the prefix that all its matches share."""
    pairs = steps.withColumn("after_page", F.lead("page").over(Window.partitionBy(case).orderBy("step_id")))
    return pairs.groupBy(case).agg(F.array_sort(F.collect_list(F.struct("step_id", "page", "action", "after_page"))).alias("history"))  # at most a case's steps


def steps_with_history(steps: DataFrame, ranges: DataFrame, case: str = "case_id") -> DataFrame:
    """Each range's steps, with the places (history_from, history_to, from 1) of the steps seen so far in its case's history.

    A match names its prefix by two numbers, so a case of n steps costs n rows
    and not n * n / 2; :func:`with_prefix` cuts the steps themselves out of
    ``case_histories`` where they are wanted. Steps before the range are not
    seen; steps that are missing in a case are in no prefix.
    """
    place = F.row_number().over(Window.partitionBy(case).orderBy("step_id"))
    placed = steps.withColumn("history_to", place)
    found = steps_in_range(placed, ranges, case)
    # the first step of the range that the case has: its place is the least one among the range's matches
    least = found.groupBy(case, "start_step", "end_step").agg(F.min("history_to").alias("history_from"))
    return found.join(least, [case, "start_step", "end_step"])


def with_prefix(matched: DataFrame, histories: DataFrame, case: str = "case_id") -> DataFrame:
    """``matched`` with ``prefix``: the steps from the range's first to its own."""
    return matched.join(histories, case).withColumn("prefix", F.slice("history", F.col("history_from"), F.col("history_to") - F.col("history_from") + 1)).drop("history")


def verdicts(steps: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, bug_found, bug_type, bug_step, confidence, n_failed, descriptions): the first failing step decides.

    steps: case, step_id, failed, confidence, bug_type, description. Without a
    failure the confidence is the smallest of the steps.
    """
    bad = F.col("failed")
    items = F.array_sort(F.collect_list(F.when(bad, F.struct("step_id", "description"))))
    first = F.min(F.when(bad, F.struct("step_id", "bug_type", "confidence")))
    out = steps.groupBy(case).agg(F.bool_or("failed").alias("bug_found"), first.alias("f"), F.min("confidence").alias("low"), F.count_if(bad).alias("n_failed"), F.array_join(F.transform(items, lambda x: x["description"]), "; ").alias("descriptions"))
    return out.select(case, "bug_found", F.col("f.bug_type").alias("bug_type"), F.col("f.step_id").alias("bug_step"), F.coalesce("f.confidence", "low").alias("confidence"), "n_failed", "descriptions")


def step_pairs(steps: DataFrame, case: str = "case_id", step: str = "step_id", page: str = "page") -> DataFrame:
    """Each step with the page after it; a case's last page has no step of its own."""
    after = F.lead(page).over(Window.partitionBy(case).orderBy(step))
    return steps.withColumn("after_page", after).where("after_page is not null")
