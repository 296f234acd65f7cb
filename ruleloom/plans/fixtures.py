"""Inputs of the catalog operators, made from the available tables; the same SQL runs on both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.operators.vectors import top_k, unit
from ruleloom.plans.durable import materialize

#: Neighbour lists of the fixture; the reference's sizes give no edges on such vectors.
K, MIN_SHARED, TOP, MIN_SCORE = 30, 5, 3, 0.40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit_id, doc_id, flag, situation, rule, domain, source from documents and labels."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(labels, "doc_id", "left").select(
        F.concat(F.lit("D"), F.col("doc_id")).alias("unit_id"), "doc_id", (F.col("quality") == 1).alias("flag"), F.trim(F.split_part("text", F.lit("\n"), F.lit(1))).alias("situation"), F.col("text").alias("rule"), F.col("lang").alias("domain"), "source"
    )


UNITS = """
units AS (SELECT concat('D', d.doc_id) AS unit_id, d.doc_id, quality = 1 AS flag, trim(split_part(text, chr(10), 1)) AS situation, text AS rule, lang AS domain, source
          FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), unit("embedding").alias("unit"), "label")


VECTORS = """
raw AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
vectors AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS unit, label FROM raw)"""


def representations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, family, is_base, grp, unit of the index (nine of ten vectors; each tenth is a query)."""
    v = vectors(spark, sf_dir).where("id % 10 <> 9")
    return v.select("id", F.format_string("F%05d", F.floor(F.col("id") / 10)).alias("family"), (F.col("id") % 10 == 0).alias("is_base"), F.when(F.col("id") % 10 > 0, F.floor((F.col("id") % 10 - 1) / 4).cast("int")).alias("grp"), "unit")


REPS = VECTORS + """,
reps AS (SELECT id, printf('F%05d', id // 10) AS family, id % 10 = 0 AS is_base, CASE WHEN id % 10 > 0 THEN CAST((id % 10 - 1) // 4 AS INTEGER) END AS grp, unit FROM vectors WHERE id % 10 <> 9),
queries AS (SELECT id AS qid, unit FROM vectors WHERE id % 10 = 9)"""


def held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where("id % 10 = 9").select(F.col("id").alias("qid"), "unit")


def neighbors(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    """q, n, score, rank: the k nearest other vectors."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("unit"))
    out = top_k(None, v, k, exclude_self=True)  # in single precision until they are compared
    return materialize(out.select(F.col("qid").alias("q"), F.col("id").alias("n"), "score", "rank"), "neighbors")


NEIGHBORS = VECTORS + f""",
scored AS (SELECT a.id AS q, b.id AS n, round(list_dot_product(a.unit, b.unit), 6) AS score FROM vectors a JOIN vectors b ON a.id <> b.id),
neighbors AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, n) AS rank FROM scored QUALIFY rank <= {K})"""
SNN = NEIGHBORS + f""",
edges AS (SELECT a.q AS source, b.q AS target, count(*) AS shared, round(count(*) / (2.0 * {K} - count(*)), 8) AS jaccard
          FROM neighbors a JOIN neighbors b ON a.n = b.n AND a.q < b.q GROUP BY ALL HAVING count(*) >= {MIN_SHARED})"""
MUTUAL = NEIGHBORS + f""",
directed AS (SELECT least(q, n) AS source, greatest(q, n) AS target, score FROM neighbors WHERE rank <= {TOP} AND score >= {MIN_SCORE}),
mutual AS (SELECT source, target, count(*) AS n_directions, round(avg(score), 8) AS mean_score, min(score) AS min_score, max(score) AS max_score FROM directed GROUP BY ALL HAVING count(*) = 2)"""


def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested families of the representations: equivalent ids, variant groups, counts."""
    r = representations(spark, sf_dir).withColumn("member_id", F.concat(F.lit("V"), F.col("id")))
    groups = r.where("grp is not null").groupBy("family", "grp").agg(F.array_sort(F.collect_list("member_id")).alias("member_ids"))
    groups = groups.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("grp", "member_ids"))).alias("g"))
    out = groups.join(r.where("is_base").select("family", F.array("member_id").alias("equivalent_member_ids")), "family", "left")
    return out.select(F.col("family").alias("family_id"), F.coalesce("equivalent_member_ids", F.array().cast("array<string>")).alias("equivalent_member_ids"), F.transform("g", lambda x: F.struct(x["member_ids"].alias("member_ids"))).alias("variant_groups"))


MEMBERS = REPS + """,
members AS (SELECT family AS family_id, concat('V', id) AS member_id, CASE WHEN is_base THEN 'EQUIVALENT' ELSE 'VARIANT' END AS member_type, grp AS group_index FROM reps)"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    return p.select(F.concat(F.lit("P"), F.col("page_id")).alias("id"), F.substring(host, 1, 2).alias("source"), host.alias("url"), "page_id")


MANIFEST = """
manifest AS (SELECT concat('P', page_id) AS id, substr(regexp_extract(url, '^https?://([^/]+)', 1), 1, 2) AS source, regexp_extract(url, '^https?://([^/]+)', 1) AS url, page_id FROM pages)"""


def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A runtime log of calls from events: key parts, sequence, status, usage."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("B"), F.col("user_id")).alias("batch_id"), F.col("event_type").alias("model"), F.lit("p").alias("prompt_sha256"), F.lit("i").alias("input_sha256"), F.col("event_id").alias("seq"), "value", F.get_json_object("props", "$.k").cast("long").alias("tokens"))


LOG = """
log AS (SELECT concat('B', user_id) AS batch_id, event_type AS model, 'p' AS prompt_sha256, 'i' AS input_sha256, event_id AS seq, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens FROM events)"""


def verdict_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    e = table(spark, sf_dir, "events")
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return e.select(F.col("user_id").alias("case_id"), step.alias("step_id"), ((F.col("event_type") == "error") & (F.col("value") < 1)).alias("failed"), F.col("value").alias("confidence"), F.col("event_type").alias("bug_type"), F.concat(F.lit("e"), F.col("event_id")).alias("description"))


STEPS = """
steps AS (SELECT user_id AS case_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step_id, event_type = 'error' AND value < 1 AS failed, value AS confidence, event_type AS bug_type, concat('e', event_id) AS description FROM events)"""


def plan_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("family_id"), F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber")).alias("member_id"), F.when(F.col("l_returnflag") == "A", "EQUIVALENT").otherwise("VARIANT").alias("member_type"), F.col("l_discount").alias("score"), "l_orderkey", "l_linenumber")


PLAN = """
plan AS (SELECT l_suppkey AS family_id, concat(l_orderkey, '-', l_linenumber) AS member_id, CASE WHEN l_returnflag = 'A' THEN 'EQUIVALENT' ELSE 'VARIANT' END AS member_type, l_discount AS score, l_orderkey, l_linenumber FROM lineitem),
positions AS (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY CASE WHEN member_type = 'EQUIVALENT' THEN 0 ELSE 1 END, score DESC, l_orderkey, l_linenumber) AS position FROM plan),
chunks AS (SELECT *, CAST(ceil(position / 18.0) AS INTEGER) AS chunk FROM positions)"""


def situations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(ranges, steps) of conversations: each even turn covers the three steps after it."""
    c = table(spark, sf_dir, "conversations")
    steps = c.select(F.col("conv_id").alias("case_id"), (F.col("turn") + 1).alias("step_id"), F.col("text").alias("page"), F.col("role").alias("action"))
    ranges = c.where("turn % 2 = 0").select(F.col("conv_id").alias("case_id"), (F.col("turn") + 1).alias("start_step"), (F.col("turn") + 3).alias("end_step"), F.col("text").alias("situation"))
    return ranges, steps


SITUATIONS = """
steps AS (SELECT conv_id AS case_id, turn + 1 AS step_id, text AS page, role AS action FROM conversations),
ranges AS (SELECT conv_id AS case_id, turn + 1 AS start_step, turn + 3 AS end_step, text AS situation FROM conversations WHERE turn % 2 = 0)"""


def sync_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bases, active, sources): the base of a document; the active table lacks a third and is stale for a seventh."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("F"), F.col("doc_id")).alias("family_id"), "doc_id", "text")
    bases = d.select("family_id", F.sha2("text", 256).alias("sha"), "text")
    active = d.where("doc_id % 3 <> 0").select("family_id", F.when(F.col("doc_id") % 7 == 0, F.lit("old")).otherwise(F.sha2("text", 256)).alias("sha"))
    return bases, active, d.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("id"), "text")


SYNC = """
bases AS (SELECT concat('F', doc_id) AS family_id, sha256(text) AS sha, text FROM documents),
active AS (SELECT concat('F', doc_id) AS family_id, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE sha256(text) END AS sha FROM documents WHERE doc_id % 3 <> 0),
sources AS (SELECT doc_id AS id, text FROM documents WHERE doc_id % 3 <> 0)"""
