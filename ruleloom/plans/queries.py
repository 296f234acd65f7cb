"""Registered queries over the catalog operators, each with its DuckDB SQL."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.functions import detectors, keys, providers, salvage, text
from ruleloom.operators import catalog, constraints, graph, ranking, vectors
from ruleloom.plans import fixtures as fx
from ruleloom.plans.durable import materialize, remove, shared_dir
from ruleloom.sources import files
from ruleloom.streaming import families, serial

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


NATURAL = "list_transform(regexp_extract_all(lower({0}), '[0-9]+|[^0-9]+'), lambda t: CASE WHEN regexp_matches(t, '^[0-9]') THEN '1' || lpad(length(ltrim(t, '0'))::VARCHAR, 6, '0') || ltrim(t, '0') ELSE '0' || t END)"


# --- sources, sinks, keys -------------------------------------------------


@query(f"""WITH {fx.MANIFEST}, u AS (SELECT url, min(page_id) AS p, count(*) AS n_ids FROM manifest GROUP BY url)
SELECT url, sha256(url) AS cache_key, n_ids, CASE WHEN length(url) % 5 = 0 THEN 'failed' WHEN p % 2 = 0 THEN 'cached' ELSE 'fetched' END AS status, CASE WHEN length(url) % 5 <> 0 THEN concat(CASE WHEN p % 2 = 0 THEN 'first ' ELSE 'second ' END, url) END AS body FROM u""")
def manifest_url_dedup(spark, sf_dir):
    """The manifest by a store of bodies: a first run over some of the urls, a second over all."""
    rows = files.manifest(fx.manifest(spark, sf_dir)).withColumn("page_id", F.substring("id", 2, 20).cast("long"))

    def fetch(run):
        def get(url):
            if len(url) % 5 == 0:
                raise ConnectionError("lost")
            return f"{run} {url}"

        return get

    store = _folder(spark, "bodies")
    even = rows.groupBy("url").agg(F.min("page_id").alias("p")).where("p % 2 = 0").select("url")
    files.fetched(rows.join(even, "url", "left_semi"), store, fetch("first")).count()
    got = files.fetched(rows, store, fetch("second"))
    return got.groupBy("url", "cache_key", "status", "body").agg(F.count("*").alias("n_ids"))


@query("SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS line FROM documents")
def json_lines_numbered(spark, sf_dir):
    """A1: lines with their numbers in their files, a file a language."""
    path = _folder(spark, "numbered")
    d = fx.table(spark, sf_dir, "documents")
    d.repartition("lang").sortWithinPartitions("lang", "doc_id").write.partitionBy("lang").json(path)
    lines = files.numbered_lines(spark, path)
    return lines.select(F.regexp_extract("file", "lang=([^/]*)/", 1).alias("lang"), F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), "line")


@query(f"WITH {fx.MANIFEST} SELECT url, min(page_id) AS first_page FROM manifest GROUP BY url")
def manifest_first_pages(spark, sf_dir):
    """A5: the first id of each url of the manifest."""
    rows = files.manifest(fx.manifest(spark, sf_dir)).withColumn("page_id", F.substring("id", 2, 20).cast("long"))
    rows = files.manifest(fx.manifest(spark, sf_dir)).withColumn("page_id", F.substring("id", 2, 20).cast("long"))
    return rows.groupBy("url").agg(F.min("page_id").alias("first_page"))


def _folder(spark, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


@query("SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha FROM documents")
def json_lines_round_trip(spark, sf_dir):
    """A1, B1: JSON Lines written whole and read back."""
    path = _folder(spark, "jsonl")
    files.write_json(fx.table(spark, sf_dir, "documents"), path)
    return files.json_lines(spark, path, "doc_id long, text string, lang string, source string, n_chars long").select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_arrays(spark, sf_dir):
    """A2: files that each hold one array."""
    path = _folder(spark, "arrays")
    n = fx.table(spark, sf_dir, "nation")
    n.groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey"))).alias("value")).withColumn("r", F.col("n_regionkey")).select("r", "value").write.partitionBy("r").text(path)
    return files.json_array(spark, f"{path}/*", "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT count(*) AS n_files, sum(n)::BIGINT AS n_lines, max(names) AS last FROM (SELECT n_regionkey, count(*) AS n, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey)")
def text_folder(spark, sf_dir):
    """A10: the files of a folder at any depth, whole."""
    path = _folder(spark, "texts")
    n = fx.table(spark, sf_dir, "nation")
    n.select(F.col("n_regionkey").alias("r"), "n_name").repartition("r").sortWithinPartitions("r", "n_name").write.partitionBy("r").text(path)
    lines = F.split(F.regexp_replace("text", r"\s+$", ""), "\n")
    return files.text_files(spark, path, "*.txt").agg(F.count("*").alias("n_files"), F.sum(F.size(lines)).alias("n_lines"), F.max(F.array_join(lines, ",")).alias("last"))


@query("SELECT concat('r', n_regionkey) AS dataset, n_nationkey AS ID, n_name AS name, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER) AS position FROM nation")
def dataset_cases(spark, sf_dir):
    """The CSV cases of every data set, ids as numbers and in their order."""
    path = _folder(spark, "datasets")
    for (region,) in fx.table(spark, sf_dir, "region").select("r_regionkey").collect():  # five data sets
        rows = fx.table(spark, sf_dir, "nation").where(F.col("n_regionkey") == region).select(F.concat("n_nationkey", F.lit(".0")).alias("ID"), F.col("n_name").alias("name"))
        rows.write.option("header", True).csv(f"{path}/r{region}")
    return files.datasets(spark, path, "*.csv").select("dataset", "ID", "name", "position")


@query("SELECT doc_id, concat('texts/', doc_id, '.txt') AS member, octet_length(encode(text)) AS size, sha256(text) AS data_sha FROM documents")
def zip_members(spark, sf_dir):
    """The members of checked ZIP archives."""
    import io
    import zipfile

    import pyarrow as pa

    def packed(name: str, text: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(f"texts/{name}.txt", text)
        return out.getvalue()

    def archives(batches):
        for b in batches:
            files_ = [packed(*x) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(files_, pa.binary())], ["path", "content"])

    d = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    d = materialize(d.mapInArrow(archives, "path string, content binary"), "archives")
    out = files.unzipped(d, expected=d.select("path", F.sha2("content", 256).alias("sha256")))
    return out.select(F.col("path").cast("long").alias("doc_id"), "member", "size", F.sha2("data", 256).alias("data_sha"))


@query("SELECT n_nationkey, n_name, CAST(2 AS BIGINT) AS times, 'refused' AS second_write FROM nation")
def append_and_copy(spark, sf_dir):
    """An append log, its copy as a whole, and a sink that is not written over."""
    path = _folder(spark, "sinks")
    n = fx.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    files.append(n, f"{path}/log")
    files.append(n, f"{path}/log")
    for _ in range(2):  # the second takes the first one's place
        files.copy(spark, f"{path}/log", f"{path}/copy")
    files.write_json(n, f"{path}/once")
    try:
        files.write_json(n, f"{path}/once")
        second = "written"
    except AnalysisException:
        second = "refused"
    return spark.read.parquet(f"{path}/copy").groupBy("n_nationkey", "n_name").agg(F.count("*").alias("times")).withColumn("second_write", F.lit(second))


@query(f"WITH {fx.MANIFEST} SELECT id, source, url FROM manifest QUALIFY row_number() OVER (PARTITION BY source ORDER BY page_id) <= 3")
def manifest_limit_per_source(spark, sf_dir):
    """The first rows of each source."""
    return ranking.first_per(fx.manifest(spark, sf_dir), ["source"], [F.col("page_id")], 3).select("id", "source", "url")


@query(r"""WITH u AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN url ELSE concat('https://github.com/', replace(regexp_extract(url, '^https?://([^/]+)', 1), '.', '-'), '/r', page_id % 7, '/issues/', page_id) END AS link FROM pages)
SELECT page_id, nullif(regexp_extract(link, '^https?://(?:www\.)?github\.com/([^/?#]+)/([^/?#]+)/issues/([0-9]+)', 1), '') AS owner, nullif(regexp_extract(link, '^https?://(?:www\.)?github\.com/([^/?#]+)/([^/?#]+)/issues/([0-9]+)', 2), '') AS repo,
CAST(nullif(regexp_extract(link, '^https?://(?:www\.)?github\.com/([^/?#]+)/([^/?#]+)/issues/([0-9]+)', 3), '') AS BIGINT) AS number FROM u""")
def issue_url_parts(spark, sf_dir):
    """Owner, repository and number of issue URLs; null for others."""
    p = fx.table(spark, sf_dir, "pages")
    link = F.when(F.col("page_id") % 5 == 0, F.col("url")).otherwise(F.concat(F.lit("https://github.com/"), F.replace(F.regexp_extract("url", r"^https?://([^/]+)", 1), F.lit("."), F.lit("-")), F.lit("/r"), F.col("page_id") % 7, F.lit("/issues/"), F.col("page_id")))
    return p.select("page_id", text.issue_parts(link).alias("p")).select("page_id", "p.owner", "p.repo", "p.number")


@query("""SELECT doc_id, sha256(concat('# ', trim(split_part(text, chr(10), 1)), chr(10), chr(10), 'Source URL: u', doc_id, chr(10), chr(10), coalesce(nullif(trim(CASE WHEN doc_id % 4 = 0 THEN '  ' ELSE text END), ''), '_No description provided._'), chr(10))) AS markdown_sha FROM documents""")
def issue_markdown(spark, sf_dir):
    """Issues as Markdown."""
    d = fx.table(spark, sf_dir, "documents")
    body = F.when(F.col("doc_id") % 4 == 0, F.lit("  ")).otherwise(F.col("text"))
    return d.select("doc_id", keys.sha_text(text.issue_markdown(F.split_part("text", F.lit("\n"), F.lit(1)), F.concat(F.lit("u"), F.col("doc_id")), body)).alias("markdown_sha"))


@query(f"WITH {fx.LOG} SELECT batch_id, model, seq, value, tokens FROM log QUALIFY row_number() OVER (PARTITION BY batch_id, model, prompt_sha256, input_sha256 ORDER BY seq DESC) = 1")
def latest_runtime_records(spark, sf_dir):
    """The last record of each key of an append log."""
    return ranking.latest(fx.call_log(spark, sf_dir), ["batch_id", "model", "prompt_sha256", "input_sha256"], "seq").select("batch_id", "model", "seq", "value", "tokens")


@query("SELECT event_id, printf('E%08d', row_number() OVER (ORDER BY ts, event_id) + 100) AS log_id FROM events")
def event_log_ids(spark, sf_dir):
    """Monotone event ids after an offset."""
    e = fx.table(spark, sf_dir, "events").select("event_id", "ts")
    return files.event_ids(e.withColumnRenamed("event_id", "id"), [F.col("ts"), F.col("id")], 100).select(F.col("id").alias("event_id"), F.col("event_id").alias("log_id"))


@query("""SELECT concat('| ', n_nationkey, ' | ', replace(regexp_replace(trim(n_name), '\\s+', ' ', 'g'), '|', '\\|'), ' | ', n_regionkey, ' |') AS value FROM nation""".replace("\\\\", "\\"))
def markdown_report(spark, sf_dir):
    """Rows of a Markdown table with escaped cells."""
    return files.markdown_table(fx.table(spark, sf_dir, "nation"), ["n_nationkey", "n_name", "n_regionkey"])


@query(f"""WITH k AS (SELECT page_id, {NATURAL.format("concat('p', page_id, 'x', page_id % 12)")} AS key FROM pages) SELECT page_id, array_to_string(key, '|') AS key, row_number() OVER (ORDER BY key, page_id) - 1 AS position FROM k""")
def natural_sort_units(spark, sf_dir):
    """Natural order of ids."""
    p = fx.table(spark, sf_dir, "pages").select("page_id", keys.natural_key(F.concat(F.lit("P"), F.col("page_id"), F.lit("x"), F.col("page_id") % 12)).alias("k"))
    return graph.numbered(p, [F.col("k"), F.col("page_id")], "position").select("page_id", F.array_join("k", "|").alias("key"), "position")


@query(f"""WITH k AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN concat(vec_id, 'a') ELSE concat('A', vec_id) END AS s FROM embeddings),
n AS (SELECT vec_id, CASE WHEN regexp_matches(s, '^[0-9]') THEN list_prepend('0', {NATURAL.format('s')}) ELSE {NATURAL.format('s')} END AS key FROM k) SELECT vec_id, array_to_string(key, '|') AS key FROM n""")
def natural_key_with_head(spark, sf_dir):
    """The natural key that keeps an empty first piece."""
    e = fx.table(spark, sf_dir, "embeddings")
    s = F.when(F.col("vec_id") % 2 == 0, F.concat(F.col("vec_id"), F.lit("a"))).otherwise(F.concat(F.lit("A"), F.col("vec_id")))
    return e.select("vec_id", s.alias("s")).select("vec_id", F.array_join(keys.natural_key_with_head("s"), "|").alias("key"))


@query(f"""WITH {fx.UNITS} SELECT unit_id, sha256(concat('Violated common-sense rule: ', trim(rule), chr(10), 'Situation: ', trim(situation))) AS embedding_sha, length(concat('Situation: ', trim(situation), chr(10), 'Violated commonsense rule: ', trim(rule))) AS rerank_length,
CASE WHEN starts_with(lower(trim(situation)), 'situation:') THEN trim(situation) ELSE concat('Situation: ', trim(situation)) END AS query_text FROM units""")
def unit_texts(spark, sf_dir):
    """Texts for embedding, rerank and queries."""
    u = fx.units(spark, sf_dir).withColumn("violated_commonsense_rule", F.col("rule"))
    return u.select("unit_id", keys.sha_text(text.embedding_text()).alias("embedding_sha"), F.length(text.rerank_text()).cast("long").alias("rerank_length"), text.query_text(F.col("situation")).alias("query_text"))


@query(r"""WITH m AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat('see ![a](', u, '.png) then <img width=2 src="', u, '.jpg"> and ![a](', u, '.png)') WHEN 1 THEN concat('plain ', u, '.gif), end. ![q](<', u, '.webp>)')
WHEN 2 THEN concat('[shot]: ', u, '.png', chr(10), 'https://user-images.githubusercontent.com/', page_id, '/f') ELSE concat('no image at ', u) END AS md FROM (SELECT page_id, split_part(split_part(url, '?', 1), '#', 1) AS u FROM pages)),
f AS (SELECT page_id, unnest(regexp_extract_all(md, 'https?://[^\\s()<>"]+\\.(?:png|jpg|gif|webp)|https://user-images[^\\s()<>"]+')) AS url, generate_subscripts(regexp_extract_all(md, 'https?://[^\\s()<>"]+\\.(?:png|jpg|gif|webp)|https://user-images[^\\s()<>"]+'), 1) AS i FROM m),
d AS (SELECT page_id, url, min(i) AS i FROM f GROUP BY ALL)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos, url FROM d""".replace("\\\\", "\\"))
def image_urls(spark, sf_dir):
    """Image URLs of Markdown in order of place, each once."""
    u = F.substring_index(F.substring_index("url", "?", 1), "#", 1)
    join = lambda *parts: F.concat(*(F.col("u") if x is None else F.lit(x) if isinstance(x, str) else x for x in parts))
    md = (
        F.when(F.col("page_id") % 4 == 0, join("see ![a](", None, '.png) then <img width=2 src="', None, '.jpg"> and ![a](', None, ".png)")).when(F.col("page_id") % 4 == 1, join("plain ", None, ".gif), end. ![q](<", None, ".webp>)"))
        .when(F.col("page_id") % 4 == 2, join("[shot]: ", None, ".png\nhttps://user-images.githubusercontent.com/", F.col("page_id"), "/f")).otherwise(join("no image at ", None))
    )
    rows = fx.table(spark, sf_dir, "pages").select("page_id", u.alias("u")).select("page_id", md.alias("md"))
    return rows.select("page_id", F.posexplode(text.image_urls(F.col("md"))).alias("pos", "url"))


@query("""SELECT doc_id, concat('Judge: ', lang, ' / end') AS prompt, CAST(2 AS BIGINT) AS n_parts, concat('i', doc_id % 3) AS first_url FROM documents""")
def prompt_messages(spark, sf_dir):
    """A template with one placeholder, and message parts, images first."""
    d = fx.table(spark, sf_dir, "documents")
    m = text.messages(text.fill_template("Judge: {{x}} / end", "{{x}}", F.col("lang")), F.array(F.concat(F.lit("i"), F.col("doc_id") % 3)))
    return d.select("doc_id", m.alias("m")).select("doc_id", F.element_at("m", -1)["text"].alias("prompt"), F.size("m").cast("long").alias("n_parts"), F.col("m")[0]["url"].alias("first_url"))


@query(r"""WITH a AS (SELECT conv_id, turn, concat('{"n":', length(text), ',"role":"', role, '"}') AS o, concat('{"turn":', turn, '}') AS p FROM conversations),
m AS (SELECT *, CASE (conv_id + turn) % 7 WHEN 0 THEN concat('Sure:', chr(10), '```json', chr(10), o, chr(10), '```', chr(10), 'and ```', p, '```') WHEN 1 THEN concat('  ', o, '  ') WHEN 2 THEN concat('first ', o, ' then ', p, ' done')
WHEN 3 THEN concat('cut off ', left(o, length(o) - 1)) WHEN 4 THEN concat('```', chr(10), 'not json', chr(10), '```', chr(10), o) WHEN 5 THEN concat('```JSON', chr(10), o, chr(10), '``` rather ', p) END AS t FROM a),
f AS (SELECT *, regexp_extract_all(t, '\{[^{}]*\}') AS objects, list_transform(regexp_extract_all(t, '(?is)```(?:json)?\s*(.*?)\s*```', 1), lambda x: x) AS fences FROM m),
g AS (SELECT *, list_filter(fences, lambda x: regexp_full_match(x, '\{[^{}]*\}')) AS fenced FROM f)
SELECT conv_id, turn, CASE WHEN len(fenced) > 0 THEN fenced[1] WHEN len(objects) = 1 THEN objects[1] END AS first_fenced, CASE WHEN len(objects) > 0 THEN objects[len(objects)] END AS last_object,
CASE WHEN len(fenced) > 0 THEN fenced[1] WHEN len(objects) = 1 THEN objects[1] END AS greedy FROM g""")
def json_salvage(spark, sf_dir):
    """The three JSON readers on answers in prose, in fences, with one object or two, cut off, or none."""
    c = fx.table(spark, sf_dir, "conversations")
    o = F.concat(F.lit('{"n":'), F.length("text"), F.lit(',"role":"'), "role", F.lit('"}'))
    p = F.concat(F.lit('{"turn":'), "turn", F.lit("}"))
    kind = (F.col("conv_id") + F.col("turn")) % 7
    join = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    answer = (
        F.when(kind == 0, join("Sure:\n```json\n", o, "\n```\nand ```", p, "```")).when(kind == 1, join("  ", o, "  ")).when(kind == 2, join("first ", o, " then ", p, " done")).when(kind == 3, join("cut off ", F.expr("left(o, length(o) - 1)")))
        .when(kind == 4, join("```\nnot json\n```\n", o)).when(kind == 5, join("```JSON\n", o, "\n``` rather ", p))
    )
    rows = c.withColumn("o", o).select("conv_id", "turn", answer.alias("answer"))
    return rows.select("conv_id", "turn", salvage.json_first_fenced("answer").alias("first_fenced"), salvage.json_last_object("answer").alias("last_object"), salvage.json_greedy("answer").alias("greedy"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE trim(concat('x ', lang)) END AS body FROM documents""")
def fence_stripped(spark, sf_dir):
    """C11: one outer fence removed."""
    d = fx.table(spark, sf_dir, "documents")
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n"), F.col("lang"), F.lit("\n```\n"))).otherwise(F.concat(F.lit(" x "), F.col("lang")))
    return d.select("doc_id", text.strip_fence(raw).alias("body"))


@query("""SELECT event_id, coalesce(CASE WHEN event_type IN ('error') THEN TRUE WHEN event_type IN ('view') THEN FALSE END, CAST(json_extract_string(props, '$.k') AS BIGINT) = 1) AS found,
CASE WHEN value BETWEEN 0 AND 1 THEN value WHEN value > 1 AND value <= 100 THEN value / 100 ELSE 0 END AS confidence FROM events""")
def coalesced_verdict(spark, sf_dir):
    """Booleans and shares from the first field that reads as one."""
    e = fx.table(spark, sf_dir, "events")
    a = F.when(F.col("event_type") == "error", "YES").when(F.col("event_type") == "view", "no").otherwise(F.lit("?"))
    return e.select("event_id", text.as_bool(a, F.get_json_object("props", "$.k")).alias("found"), text.as_share(F.lit("n/a"), F.col("value").cast("string")).alias("confidence"))


@query("""SELECT event_id, kind IN (1, 3, 5) AS bug_found, CASE kind WHEN 1 THEN NULL WHEN 5 THEN event_type ELSE 'unknown' END AS bug_type, CASE WHEN kind = 5 THEN '3' END AS bug_page_step,
CASE kind WHEN 1 THEN concat('s', event_id) WHEN 3 THEN NULL ELSE '' END AS bug_description, CASE kind WHEN 2 THEN '90%' WHEN 5 THEN '0.5' END AS confidence,
CASE WHEN kind = 2 THEN '["a"]' ELSE '[]' END AS evidence_steps, CASE WHEN kind = 3 THEN '["f"]' ELSE '[]' END AS exploration_feedback FROM (SELECT *, event_id % 8 AS kind FROM events) WHERE kind <> 7""")
def bug_records(spark, sf_dir):
    """Detector answers as records: a field that is there counts whatever it holds, a missing one has its default."""
    e = fx.table(spark, sf_dir, "events")
    kind, join = F.col("event_id") % 8, lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    answer = (
        F.when(kind == 0, "{}").when(kind == 1, join('{"bug_found": "no", "bug_type": null, "summary": "s', F.col("event_id"), '"}')).when(kind == 2, '{"bug_found": 0, "confidence": "90%", "step_analysis": ["a"]}')
        .when(kind == 3, '{"bug_found": [1], "bug_description": null, "summary": "x", "exploration_feedback": ["f"]}').when(kind == 4, '{"bug_found": "", "evidence_steps": [], "step_analysis": ["b"]}')
        .when(kind == 5, join('{"bug_found": true, "bug_type": "', F.col("event_type"), '", "bug_page_step": 3, "confidence": 0.5}')).when(kind == 6, '{"bug_found": {}, "has_bug": true, "type": "t"}').otherwise("none")
    )
    out = e.select("event_id", text.bug_record(answer).alias("r")).where("r is not null")
    given = ("bug_type", "bug_page_step", "bug_description", "confidence", "evidence_steps", "exploration_feedback")
    return out.select("event_id", "r.bug_found", *(F.col(f"r.{c}").cast("string").alias(c) for c in given))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'NO_MATCH' WHEN 2 THEN 'EQUIVALENT' WHEN 3 THEN 'VARIANT' WHEN 4 THEN 'VARIANT' ELSE 'MAYBE' END AS decision,
CASE event_id % 6 WHEN 0 THEN 'no JSON' WHEN 3 THEN 'no delta' WHEN 5 THEN 'unknown decision' WHEN 2 THEN CASE WHEN event_type = 'error' THEN 'unknown family' END END AS error FROM events""")
def judgment_outputs(spark, sf_dir):
    """Tagged answers of a judge, checked by their tag."""
    e = fx.table(spark, sf_dir, "events")
    m = F.col("event_id") % 6
    family = F.when(F.col("event_type") == "error", "F9").otherwise("F1")
    answer = (
        F.when(m == 0, "cut {").when(m == 1, '{"decision": "NO_MATCH"}').when(m == 2, F.concat(F.lit('{"decision": "EQUIVALENT", "family": "'), family, F.lit('"}')))
        .when(m == 3, '{"decision": "VARIANT", "family": "F1", "delta": " "}').when(m == 4, '{"decision": "VARIANT", "family": "F1", "delta": "later"}').otherwise('{"decision": "MAYBE"}')
    )
    return e.select("event_id", text.judgment(answer, F.array(F.lit("F1"), F.lit("F2"))).alias("j")).select("event_id", "j.decision", "j.error")


@query(f"WITH {fx.NEIGHBORS} SELECT q, q % 9 <> 0 AND q % 7 <> 0 AS complete FROM (SELECT DISTINCT q FROM neighbors)")
def complete_results(spark, sf_dir):
    """Lists with all their results and scores."""
    n = fx.neighbors(spark, sf_dir).where("not (q % 9 = 0 and rank = 4)").withColumn("score", F.when(~((F.col("q") % 7 == 0) & (F.col("rank") == 1)), F.col("score")))
    return constraints.complete_results(n, ["q"], "n", "score", fx.K)


@query(f"WITH {fx.UNITS} SELECT 'a' AS source_name, count(*) AS n_units, count(DISTINCT unit_id) AS n_ids FROM units WHERE doc_id % 2 = 0 UNION ALL SELECT 'b', count(*), count(DISTINCT unit_id) FROM units WHERE doc_id % 2 = 1")
def units_by_source(spark, sf_dir):
    """Units of several sources as one table, counted by source."""
    u = fx.units(spark, sf_dir).select("unit_id", "doc_id")
    whole = files.units([("a", u.where("doc_id % 2 = 0")), ("b", u.where("doc_id % 2 = 1").drop("doc_id"))])
    return whole.groupBy("source_name").agg(F.count("*").alias("n_units"), F.count_distinct("unit_id").alias("n_ids"))


@query("""SELECT l_suppkey, substr(sha256(array_to_string(list_sort(list(concat(l_orderkey, '-', l_linenumber))), chr(10))), 1, 16) AS signature, count(*) AS n FROM lineitem GROUP BY l_suppkey""")
def content_signature(spark, sf_dir):
    """Content addresses of id sets."""
    li = fx.table(spark, sf_dir, "lineitem")
    ids = F.collect_list(F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber")))
    return li.groupBy("l_suppkey").agg(keys.content_signature(ids).alias("signature"), F.count("*").alias("n"))


@query(f"WITH {fx.PLAN} SELECT family_id, member_id, concat('U', row_number() OVER (PARTITION BY family_id ORDER BY l_orderkey, l_linenumber) - 1) AS model_id FROM plan WHERE family_id NOT IN (SELECT family_id FROM plan GROUP BY family_id HAVING count(*) <> count(DISTINCT member_id))")
def surrogate_ids(spark, sf_dir):
    """Batch-local ids; batches whose mapping is no bijection are left out."""
    rows = keys.surrogate_ids(fx.plan_members(spark, sf_dir), ["family_id"], [F.col("l_orderkey"), F.col("l_linenumber")])
    bad = keys.mapping_violations(rows, ["family_id"], "model_id", "member_id").select("family_id")
    return rows.join(bad, "family_id", "left_anti").select("family_id", "member_id", "model_id")


@query(r"""SELECT page_id, CASE WHEN trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '._-') = '' THEN 'item' ELSE trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '._-') END AS token, round(page_id / 7.0, 8) AS rounded FROM pages""")
def path_tokens(spark, sf_dir):
    """Safe file names and rounded scores."""
    return fx.table(spark, sf_dir, "pages").select("page_id", keys.safe_path("url").alias("token"), F.round(F.col("page_id") / 7.0, 8).alias("rounded"))


@query(f"WITH {fx.VECTORS} SELECT id, CAST(len(unit) AS INTEGER) AS dimensions, round(list_dot_product(unit, unit), 6) AS norm2, round(unit[1], 6) AS first FROM vectors")
def normalized_vectors(spark, sf_dir):
    """A3, C20: unit vectors."""
    v = fx.vectors(spark, sf_dir)
    return v.select("id", F.size("unit").alias("dimensions"), F.round(F.aggregate("unit", F.lit(0.0), lambda s, x: s + x * x), 6).alias("norm2"), F.round(F.col("unit")[0], 6).alias("first"))


@query(f"WITH {fx.UNITS} SELECT unit_id, situation, domain FROM units WHERE flag AND situation <> ''")
def filter_positive_flatten(spark, sf_dir):
    """Nested positive extractions, flattened."""
    u = fx.units(spark, sf_dir)
    nested = u.select("unit_id", "flag", F.struct("situation", "domain").alias("violated"))
    return nested.where(F.col("flag") == F.lit(True)).select("unit_id", "violated.*").where("situation <> ''")


@query(f"""WITH {fx.UNITS} SELECT concat(unit_id, '::BASE') AS representation_id, sha256(concat('{{"domain":"', domain, '","source":"', source, '"}}')) AS base_sha FROM units""")
def base_records(spark, sf_dir):
    """Representation ids and hashes of canonical JSON."""
    u = fx.units(spark, sf_dir)
    return u.select(F.concat("unit_id", F.lit("::BASE")).alias("representation_id"), keys.sha_text(keys.canonical_json(source=F.col("source"), domain=F.col("domain"))).alias("base_sha"))


@query(r"""SELECT page_id, regexp_matches(link, '(?i)^https?://') AND (host IN ('user-images.githubusercontent.com', 'github.com') OR NOT regexp_matches(link, '(?i)^[^?#]*\.(png|jpe?g|gif|webp)([?#]|$)')) AS localise
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://github.com/a.png' WHEN 1 THEN concat(url, '.png') WHEN 2 THEN url ELSE 'data:image/png;base64,' END AS link FROM pages) t, (SELECT 1) x, LATERAL (SELECT lower(regexp_extract(link, '(?i)^https?://([^/?#:]+)', 1)) AS host) h""")
def image_url_rules(spark, sf_dir):
    """Which image URLs must be fetched first."""
    p = fx.table(spark, sf_dir, "pages")
    m = F.col("page_id") % 4
    link = F.when(m == 0, "https://github.com/a.png").when(m == 1, F.concat("url", F.lit(".png"))).when(m == 2, F.col("url")).otherwise("data:image/png;base64,")
    return p.select("page_id", text.needs_localising(link).alias("localise"))


@query("""SELECT conv_id, turn, concat('a', turn, CASE WHEN turn % 2 = 0 THEN 'b' ELSE '' END) AS content FROM conversations""")
def assistant_content(spark, sf_dir):
    """The text of chat responses, whole or in parts."""
    c = fx.table(spark, sf_dir, "conversations")
    one = F.concat(F.lit('{"choices":[{"message":{"content":"a'), F.col("turn"), F.lit('"}}]}'))
    parts = F.concat(F.lit('{"choices":[{"message":{"content":[{"type":"text","text":"a'), F.col("turn"), F.lit('"},{"type":"text","text":"b"}]}}]}'))
    return c.select("conv_id", "turn", text.assistant_content(F.when(F.col("turn") % 2 == 0, parts).otherwise(one)).alias("content"))


@query("""SELECT doc_id, concat('data:text/plain;base64,', to_base64(encode(lang))) AS data_url, sha256(lang) = sha256(CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END) AS same FROM documents""")
def data_urls(spark, sf_dir):
    """Data URLs, and equality of binary contents."""
    d = fx.table(spark, sf_dir, "documents").withColumns({"a": F.encode("lang", "UTF-8"), "b": F.encode(F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(F.col("source")), "UTF-8")})
    return d.select("doc_id", text.data_url(F.col("a"), "text/plain").alias("data_url"), files.images_equal("a", "b").alias("same"))


@query("""SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 2 = 0 THEN c_name END), ''), nullif(trim(c_mktsegment), ''), '') AS name, '' AS goal FROM customer""")
def function_records(spark, sf_dir):
    """Records with aliased field names."""
    c = fx.table(spark, sf_dir, "customer")
    rec = F.create_map(F.lit("Function Name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), F.lit("function"), F.col("c_mktsegment"))
    return c.select("c_custkey", rec.alias("r")).select("c_custkey", *text.renamed(F.col("r"), {"name": ["Function Name", "function"], "goal": ["Goal", "target"]}))


# --- constraints ----------------------------------------------------------


@query(f"WITH {fx.MANIFEST} SELECT 'unique' AS \"constraint\", url AS key, count(*)::VARCHAR AS detail FROM manifest GROUP BY url HAVING count(*) > 1")
def unique_id_violations(spark, sf_dir):
    """D2."""
    return constraints.unique(fx.manifest(spark, sf_dir), "url")


@query("""SELECT 'filled' AS "constraint", doc_id::VARCHAR AS key, 'situation' AS detail FROM documents WHERE doc_id % 9 = 0 UNION ALL SELECT 'distinct_items', doc_id::VARCHAR, '1' FROM documents WHERE lang = source OR doc_id % 2 = 0""")
def field_violations(spark, sf_dir):
    """D3: blank fields and repeated items."""
    d = fx.table(spark, sf_dir, "documents").withColumn("situation", F.when(F.col("doc_id") % 9 == 0, " ").otherwise(F.col("lang")))
    items = F.when(F.col("doc_id") % 2 == 0, F.array("lang", F.concat(F.lit(" "), "lang"))).otherwise(F.array("lang", "source"))
    return constraints.filled(d, "doc_id", "situation", "lang").unionAll(constraints.distinct_items(d.withColumn("items", items), "doc_id", "items"))


@query("""WITH g AS (SELECT vec_id AS m, vec_id % 7 AS g FROM embeddings WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id, 100 FROM embeddings WHERE vec_id % 6 = 0 UNION ALL SELECT vec_id + 1000000, 1 FROM embeddings WHERE vec_id % 50 = 0),
k AS (SELECT vec_id AS m FROM embeddings)
SELECT 'disjoint' AS "constraint", m::VARCHAR AS key, count(DISTINCT g)::VARCHAR AS detail FROM g GROUP BY m HAVING count(DISTINCT g) > 1
UNION ALL SELECT 'known', m::VARCHAR, 'unknown' FROM (SELECT DISTINCT m FROM g) WHERE m NOT IN (SELECT m FROM k) UNION ALL SELECT 'leftover', m::VARCHAR, 'singleton' FROM k WHERE m NOT IN (SELECT m FROM g)""")
def disjoint_groups(spark, sf_dir):
    """Groups must be disjoint subsets; what is left over becomes singletons."""
    e = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("m"))
    g = e.where("m % 3 = 0").select("m", (F.col("m") % 7).alias("g")).unionAll(e.where("m % 6 = 0").select("m", F.lit(100).cast("long"))).unionAll(e.where("m % 50 = 0").select(F.col("m") + 1000000, F.lit(1).cast("long")))
    left = constraints.leftovers(g, e, "m").select(F.lit("leftover"), F.col("m").cast("string"), F.lit("singleton"))
    return constraints.disjoint(g, e, "g", "m").unionAll(left)


@query(f"""WITH {fx.UNITS}, p AS (SELECT doc_id, doc_id // 30 AS g FROM units WHERE doc_id % 11 <> 0 UNION ALL SELECT -1, 0)
SELECT 'covered' AS "constraint", doc_id::VARCHAR AS key, 'missing' AS detail FROM units WHERE doc_id % 11 = 0 UNION ALL SELECT 'covered', '-1', 'extra' UNION ALL SELECT 'group_size', g::VARCHAR, count(*)::VARCHAR FROM p GROUP BY g HAVING count(*) > 25""")
def partition_violations(spark, sf_dir):
    """Groups must cover the input once, with 2 to 25 members."""
    whole = fx.units(spark, sf_dir).select("doc_id")
    parts = whole.where("doc_id % 11 <> 0").select("doc_id", F.floor(F.col("doc_id") / 30).alias("g")).unionAll(spark.sql("select -1L, 0L"))
    return constraints.partition(whole, parts, "doc_id", "g")


@query(f"""WITH {fx.MEMBERS}, f AS (SELECT family_id, count(*) AS n FROM members GROUP BY family_id)
SELECT 'bases' AS name, (SELECT bool_and(c = 1) FROM (SELECT count(*) FILTER (is_base) AS c FROM reps GROUP BY family)) AS passed, (SELECT count(DISTINCT family) FROM reps)::VARCHAR AS detail
UNION ALL SELECT 'member_count', (SELECT bool_and(n = 9) FROM f), (SELECT sum(n) FROM f)::VARCHAR UNION ALL SELECT 'members_once', (SELECT count(*) = count(DISTINCT member_id) FROM members), (SELECT count(*) FROM members)::VARCHAR""")
def package_audit(spark, sf_dir):
    """One aggregate for each check of the catalog."""
    r = fx.representations(spark, sf_dir)
    m = catalog.unnest(fx.families(spark, sf_dir))
    check = lambda ok, detail: F.struct(ok.alias("passed"), detail.cast("string").alias("detail"))
    bases = r.groupBy("family").agg(F.count_if("is_base").alias("c"))
    sizes = m.groupBy("family_id").agg(F.count("*").alias("n"))
    return constraints.audit(bases=(bases, check(F.bool_and(F.col("c") == 1), F.count("*"))), member_count=(sizes, check(F.bool_and(F.col("n") == 9), F.sum("n"))), members_once=(m, check(F.count("*") == F.count_distinct("member_id"), F.count("*"))))


@query(f"""WITH {fx.NEIGHBORS}, b AS (SELECT q, n, rank FROM neighbors WHERE NOT (q % 20 = 0 AND rank = 2)), p AS (SELECT q, count(*) AS c, max(rank) AS hi FROM b GROUP BY q)
SELECT 'ranks' AS "constraint", q::VARCHAR AS key, c::VARCHAR AS detail FROM p WHERE hi <> c UNION ALL SELECT 'length', q::VARCHAR, c::VARCHAR FROM p WHERE c <> {fx.K}""")
def neighbor_integrity(spark, sf_dir):
    """Ranked lists with holes and of other lengths."""
    n = fx.neighbors(spark, sf_dir).where("not (q % 20 = 0 and rank = 2)")
    return constraints.contiguous(n, "q", "rank", "n", fx.K)


@query(f"""WITH {fx.UNITS}, w AS (SELECT unit_id, sha256(rule) AS fp, doc_id FROM units) SELECT unit_id, 'pending' AS state FROM w WHERE doc_id % 3 = 0 OR doc_id % 7 = 0 UNION ALL SELECT unit_id, 'conflict' FROM w WHERE doc_id % 3 <> 0 AND doc_id % 7 = 0""")
def pending_work(spark, sf_dir):
    """Work without a result of the same inputs, and results of other inputs."""
    u = fx.units(spark, sf_dir)
    work = u.select("unit_id", F.sha2("rule", 256).alias("fp"))
    done = u.where("doc_id % 3 <> 0").select("unit_id", F.when(F.col("doc_id") % 7 == 0, "other").otherwise(F.sha2("rule", 256)).alias("fp"))
    bad = constraints.conflicts(work, done, ["unit_id"], "fp").select(F.col("key").alias("unit_id"), F.lit("conflict").alias("state"))
    return constraints.pending(work, done, ["unit_id"], "fp").select("unit_id", F.lit("pending").alias("state")).unionAll(bad)


@query("""SELECT 'situation' AS "constraint", conv_id::VARCHAR || '-' || turn AS key, CASE turn % 4 WHEN 0 THEN 'starts before 1' WHEN 1 THEN 'ends before start' ELSE 'not whole' END AS detail FROM conversations WHERE turn % 4 < 3""")
def situation_violations(spark, sf_dir):
    """Step ranges that are not valid."""
    c = fx.table(spark, sf_dir, "conversations")
    m = F.col("turn") % 4
    rows = c.select(F.concat_ws("-", "conv_id", "turn").alias("k"), F.when(m == 0, "0").when(m == 2, "1.5").otherwise("3").alias("a"), F.when(m == 1, "2").otherwise("5").alias("b"), F.lit("t").alias("t"))
    return constraints.situations(rows, "k", "a", "b", "t")


@query("""SELECT 'vector' AS "constraint", vec_id::VARCHAR AS key, CASE vec_id % 5 WHEN 0 THEN 'dimensions' WHEN 1 THEN 'zero' WHEN 2 THEN 'not finite' ELSE 'null' END AS detail FROM embeddings WHERE vec_id % 5 < 4""")
def vector_violations(spark, sf_dir):
    """Vectors of other lengths, zero, non-finite or missing."""
    e = fx.table(spark, sf_dir, "embeddings")
    m, v = F.col("vec_id") % 5, F.col("embedding")
    odd = F.when(m == 0, F.slice(v, 1, 3)).when(m == 1, F.transform(v, lambda x: F.lit(0).cast("float"))).when(m == 2, F.transform(v, lambda x: F.lit(float("nan")).cast("float"))).when(m == 3, F.lit(None)).otherwise(v)
    return constraints.vectors(e.select("vec_id", odd.alias("v")), "vec_id", "v", 64)


@query(f"""WITH {fx.UNITS}, p AS (SELECT unit_id, row_number() OVER (ORDER BY doc_id) - 1 + CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS o, doc_id FROM units WHERE doc_id % 3 = 0)
SELECT 'dense_order' AS "constraint", 'queue' AS key, count(*)::VARCHAR AS detail FROM p UNION ALL SELECT 'pending', unit_id, 'already in the state' FROM p WHERE doc_id % 10 = 0""")
def queue_violations(spark, sf_dir):
    """A queue with holes, and pending units that the state has already."""
    u = fx.units(spark, sf_dir).where("doc_id % 3 = 0").select("unit_id", "doc_id")
    p = graph.numbered(u, [F.col("doc_id")], "o").withColumn("o", F.col("o") + (F.col("doc_id") % 2))
    return constraints.queue(u.where("doc_id % 10 = 0"), p, "o", "unit_id")


@query(f"""WITH {fx.UNITS}, q AS (SELECT unit_id, row_number() OVER (ORDER BY doc_id) - 1 AS o FROM units), p AS (SELECT unit_id FROM q WHERE o % 10 < 4 AND o <> 11), n AS (SELECT count(*) AS n FROM p)
SELECT 'version' AS "constraint", 'queue' AS key, concat(n + 1, ' of ', n) AS detail FROM n UNION ALL SELECT 'prefix', unit_id, 'not processed' FROM q, n WHERE o < n AND unit_id NOT IN (SELECT unit_id FROM p)
UNION ALL SELECT 'prefix', unit_id, 'not next in the queue' FROM q, n WHERE o >= n AND unit_id IN (SELECT unit_id FROM p)""")
def serial_state_violations(spark, sf_dir):
    """A serial state whose units are not the queue's first, under a version that is not their number."""
    u = fx.units(spark, sf_dir).select("unit_id", "doc_id")
    q = materialize(ranking.dense_queue(u, u.where("false").select("unit_id"), "unit_id", [F.col("doc_id")]).select("unit_id", F.col("serial_order").alias("o")), "queue")
    done = q.where("o % 10 < 4 and o <> 11")
    return constraints.serial_state(done, q, "o", "unit_id", done.count() + 1)


@query("""WITH f AS (SELECT concat('F', doc_id) AS family_id, doc_id FROM documents), w AS (SELECT family_id, list_filter([CASE WHEN doc_id % 3 = 0 THEN 'kept' END, CASE WHEN doc_id % 3 = 1 OR doc_id % 30 = 0 THEN 'regrouped' END, CASE WHEN doc_id % 3 = 2 AND doc_id % 7 <> 0 THEN 'unmatched' END], lambda x: x IS NOT NULL) AS parts, doc_id FROM f)
SELECT 'one_part' AS "constraint", family_id AS key, CASE WHEN doc_id % 11 = 0 THEN 'unknown' WHEN len(parts) = 0 THEN 'in no part' ELSE concat('in ', array_to_string(parts, ',')) END AS detail FROM w WHERE (doc_id % 11 = 0 AND len(parts) > 0) OR (doc_id % 11 <> 0 AND len(parts) <> 1)""")
def family_partition_violations(spark, sf_dir):
    """Families in no part of the three-way partition, in several, or unknown to the catalog."""
    f = fx.table(spark, sf_dir, "documents").select(F.concat(F.lit("F"), "doc_id").alias("family_id"), "doc_id")
    m = F.col("doc_id") % 3
    return constraints.one_of(f.where("doc_id % 11 <> 0"), "family_id", kept=f.where(m == 0), regrouped=f.where((m == 1) | (F.col("doc_id") % 30 == 0)), unmatched=f.where((m == 2) & (F.col("doc_id") % 7 != 0)))


# --- vector joins ---------------------------------------------------------


@query(f"WITH {fx.NEIGHBORS} SELECT q, n, score, rank::INTEGER AS rank FROM neighbors")
def knn_cosine_topk(spark, sf_dir):
    """Exact nearest neighbours."""
    return fx.neighbors(spark, sf_dir)


@query(f"""WITH {fx.VECTORS}, n AS (SELECT count(*) AS c FROM vectors), d AS (SELECT a.id, a.unit AS s, b.unit AS r FROM vectors a JOIN vectors b ON b.id = (a.id + 1) % (SELECT c FROM n)),
s AS (SELECT a.id AS q, b.id AS n, round(0.35 * list_dot_product(a.s, b.s) + 0.65 * list_dot_product(a.r, b.r), 6) AS score FROM d a JOIN d b ON a.id <> b.id)
SELECT q, n, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, n)::INTEGER AS rank FROM s QUALIFY rank <= 20""")
def knn_weighted_dual_topk(spark, sf_dir):
    """Neighbours by the weighted sum of two cosines, as one product of scaled vectors."""
    v = fx.vectors(spark, sf_dir)
    n = v.count()
    other = v.select(((F.col("id") - 1 + n) % n).alias("id"), F.col("unit").alias("rule"))
    d = materialize(v.join(other, "id").select("id", vectors.dual(F.col("unit"), F.col("rule"), 0.35).alias("unit")), "dual")
    out = vectors.top_k(d.select(F.col("id").alias("qid"), "unit"), d, 20, exclude_self=True, clip=True)
    return out.select(F.col("qid").alias("q"), F.col("id").alias("n"), "score", "rank")


FAMILY = f"""WITH {fx.REPS}, s AS (SELECT qid, r.id, family, is_base, least(1, greatest(-1, round(list_dot_product(q.unit, r.unit), 6))) AS score FROM queries q, reps r),
f AS (SELECT qid, family, max(score) AS score, max(score) FILTER (is_base) AS base_score, max(score) FILTER (NOT is_base) AS best_variant_score, arg_min(id, (-score, NOT is_base, id)) AS matched_id FROM s GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, family)::INTEGER AS rank FROM f QUALIFY rank <= 20)"""


@query(FAMILY + " SELECT qid, family, score, matched_id, rank FROM top")
def family_recall_topk(spark, sf_dir):
    """The best families of each query with the representation that matched."""
    return vectors.top_groups(fx.held_out(spark, sf_dir), fx.representations(spark, sf_dir), 20).select("qid", "family", "score", "matched_id", "rank")


@query(FAMILY + " SELECT qid, family, score, base_score, best_variant_score, matched_id, rank FROM top")
def family_retrieval_topk(spark, sf_dir):
    """As E3, with base and best variant scores."""
    return vectors.top_groups(fx.held_out(spark, sf_dir), fx.representations(spark, sf_dir), 20)


@query(f"WITH {fx.REPS} SELECT qid, r.id, round(list_dot_product(q.unit, r.unit), 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(list_dot_product(q.unit, r.unit), 6) DESC, r.id)::INTEGER AS rank FROM queries q, reps r QUALIFY rank <= 10")
def flat_retrieval_topk(spark, sf_dir):
    """E5: queries against a flat index."""
    return vectors.top_k(fx.held_out(spark, sf_dir), fx.representations(spark, sf_dir).select("id", "unit"), 10)


@query(f"""WITH {fx.VECTORS}, s AS (SELECT a.label, round(least(1, greatest(-1, list_dot_product(a.unit, b.unit))), 6) AS score FROM vectors a JOIN vectors b ON a.id <> b.id)
SELECT label, count(*) AS n, round(min(score), 8) AS min, round(quantile_cont(score, 0.1), 8) AS p10, round(quantile_cont(score, 0.25), 8) AS p25, round(quantile_cont(score, 0.5), 8) AS median, round(avg(score), 8) AS mean,
round(quantile_cont(score, 0.75), 8) AS p75, round(quantile_cont(score, 0.9), 8) AS p90, round(quantile_cont(score, 0.95), 8) AS p95, round(quantile_cont(score, 0.99), 8) AS p99, round(max(score), 8) AS max FROM s GROUP BY label""")
def score_distribution(spark, sf_dir):
    """quantiles of the scores of each label's vectors with all others."""
    v = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("unit"), "label")
    return vectors.distribution(v, "label")


@query(f"""WITH {fx.VECTORS}, s AS (SELECT round(least(1, greatest(-1, list_dot_product(a.unit, b.unit))), 6) AS score FROM vectors a JOIN vectors b ON a.id < b.id)
SELECT count(*) AS n, round(min(score), 8) AS min, round(quantile_cont(score, 0.1), 8) AS p10, round(quantile_cont(score, 0.25), 8) AS p25, round(quantile_cont(score, 0.5), 8) AS median, round(avg(score), 8) AS mean,
round(quantile_cont(score, 0.75), 8) AS p75, round(quantile_cont(score, 0.9), 8) AS p90, round(quantile_cont(score, 0.95), 8) AS p95, round(quantile_cont(score, 0.99), 8) AS p99, round(max(score), 8) AS max FROM s""")
def pair_score_distribution(spark, sf_dir):
    """quantiles of all pairs' scores, the upper triangle."""
    return vectors.pair_distribution(fx.vectors(spark, sf_dir))


# --- graph ----------------------------------------------------------------


def _snn(spark, sf_dir) -> DataFrame:
    return materialize(graph.snn_edges(fx.neighbors(spark, sf_dir), fx.K, fx.MIN_SHARED), "snn")


def _mutual(spark, sf_dir) -> DataFrame:
    n = fx.neighbors(spark, sf_dir, fx.TOP)  # ranks above TOP make no edge, so those rows are neither shuffled nor stored
    return materialize(graph.undirected_edges(n, fx.TOP, fx.MIN_SCORE), "mutual")


@query(f"WITH {fx.SNN} SELECT source, target, shared, jaccard FROM edges")
def snn_edges(spark, sf_dir):
    """Shared-nearest-neighbour edges."""
    return _snn(spark, sf_dir)


@query(f"""WITH {fx.SNN}, ways AS (SELECT least(q, n) AS source, greatest(q, n) AS target FROM neighbors GROUP BY ALL HAVING count(*) = 2)
SELECT source, target, shared, jaccard FROM edges JOIN ways USING (source, target)""")
def snn_edges_mutual(spark, sf_dir):
    """E6 between mutual neighbours."""
    return graph.snn_edges(fx.neighbors(spark, sf_dir), fx.K, fx.MIN_SHARED, mutual=True)


@query(f"WITH {fx.MUTUAL} SELECT * FROM mutual")
def mutual_topk_edges(spark, sf_dir):
    """Undirected edges from qualifying directions both ways."""
    return _mutual(spark, sf_dir)


@query(f"WITH {fx.MUTUAL}, deg AS (SELECT source AS id, mean_score AS w FROM mutual UNION ALL SELECT target, mean_score FROM mutual) SELECT v.id, count(w) AS degree, round(coalesce(sum(w), 0), 8) AS weighted_degree FROM vectors v LEFT JOIN deg USING (id) GROUP BY v.id")
def weighted_degrees(spark, sf_dir):
    """Nodes with degrees, isolated ones included."""
    return graph.graph_nodes(fx.vectors(spark, sf_dir), _mutual(spark, sf_dir), "mean_score")


@query(f"""WITH {fx.MUTUAL}, ends AS (SELECT source AS id, mean_score AS w FROM mutual UNION ALL SELECT target, mean_score FROM mutual), d AS (SELECT v.id, count(w) AS degree, round(coalesce(sum(w), 0), 8) AS weighted_degree FROM vectors v LEFT JOIN ends USING (id) GROUP BY v.id)
SELECT id % 7 AS community, row_number() OVER (PARTITION BY id % 7 ORDER BY weighted_degree DESC, id)::INTEGER AS rank, id, degree, weighted_degree FROM d QUALIFY rank <= 10""")
def community_representatives(spark, sf_dir):
    """the members of each community with the highest weighted degree."""
    v = fx.vectors(spark, sf_dir)
    return graph.representatives(v, _mutual(spark, sf_dir), v.select("id", (F.col("id") % 7).alias("community")), "mean_score", [F.col("id")])


COMPONENTS = f"""WITH RECURSIVE {fx.MUTUAL}, both_ways AS (SELECT source AS a, target AS b FROM mutual UNION SELECT target, source FROM mutual),
reach(id, r) AS (SELECT id, id FROM vectors UNION SELECT reach.id, b FROM reach JOIN both_ways ON r = a), comps AS (SELECT id, min(r) AS component FROM reach GROUP BY id)"""


@query(COMPONENTS + " SELECT id, component FROM comps")
def connected_components(spark, sf_dir):
    """Components of the mutual graph."""
    return graph.component_table(fx.vectors(spark, sf_dir), _mutual(spark, sf_dir))


@query(COMPONENTS + """, s AS (SELECT component, count(*) AS size FROM comps GROUP BY component HAVING count(*) > 1), e AS (SELECT component, count(*) AS n_edges, round(sum(mean_score), 8) AS total_weight FROM mutual JOIN comps ON source = id GROUP BY component)
SELECT s.component, size, n_edges, total_weight, round(2.0 * n_edges / (size * (size - 1)), 6) AS density, size > 25 AS oversize, row_number() OVER (ORDER BY size DESC, s.component) AS rank FROM s JOIN e ON s.component = e.component""")
def component_density(spark, sf_dir):
    """Exported components with their density; oversize ones are reported."""
    edges = _mutual(spark, sf_dir)
    labels = materialize(graph.component_table(fx.vectors(spark, sf_dir), edges), "labels")
    return graph.component_export(labels, edges, "mean_score")


@query(f"""WITH {fx.SNN}, l AS (SELECT id, id % 7 AS c FROM vectors), e AS (SELECT a.c AS a, b.c AS b, jaccard AS w FROM edges JOIN l a ON a.id = source JOIN l b ON b.id = target),
p AS (SELECT c, sum(inside) AS inside, sum(w) AS total FROM (SELECT a AS c, CASE WHEN a = b THEN 2 * w ELSE 0 END AS inside, w FROM e UNION ALL SELECT b, 0, w FROM e) GROUP BY c) SELECT round(sum(inside) / sum(total) - 0.8 * sum(total * total) / (sum(total) * sum(total)), 6) AS modularity FROM p""")
def graph_modularity(spark, sf_dir):
    """F8: modularity of a given partition."""
    labels = fx.vectors(spark, sf_dir).select("id", (F.col("id") % 7).alias("community"))
    return graph.modularity(_snn(spark, sf_dir), labels, "jaccard", 0.8)


@query(COMPONENTS + """, l AS (SELECT id, id % 7 AS c FROM vectors), x AS (SELECT a.c AS a, b.c AS b, mean_score AS w FROM mutual JOIN l a ON a.id = source JOIN l b ON b.id = target),
p AS (SELECT c, sum(inside) AS inside, sum(w) AS total FROM (SELECT a AS c, CASE WHEN a = b THEN 2 * w ELSE 0 END AS inside, w FROM x UNION ALL SELECT b, 0, w FROM x) GROUP BY c),
cs AS (SELECT component, count(*) AS n FROM comps GROUP BY component), ls AS (SELECT c, count(*) AS n FROM l GROUP BY c)
SELECT (SELECT count(*) FROM vectors) AS nodes, (SELECT count(*) FROM mutual) AS edges, (SELECT min(mean_score) FROM mutual) AS min_weight, (SELECT max(mean_score) FROM mutual) AS max_weight, (SELECT count(*) FROM cs) AS components, (SELECT max(n) FROM cs) AS largest_components,
(SELECT count(*) FROM cs WHERE n = 1) AS single_components, (SELECT count(*) FROM ls) AS communities, (SELECT max(n) FROM ls) AS largest_communities, (SELECT count(*) FROM ls WHERE n = 1) AS single_communities, (SELECT round(sum(inside) / sum(total) - sum(total * total) / (sum(total) * sum(total)), 6) FROM p) AS modularity""")
def graph_summary(spark, sf_dir):
    """F8: the figures of a graph, its components and its communities."""
    v, edges = fx.vectors(spark, sf_dir), _mutual(spark, sf_dir)
    parts = materialize(graph.component_table(v, edges), "labels")
    return graph.graph_summary(v, edges, parts, v.select("id", (F.col("id") % 7).alias("community")), "mean_score")


@query()
def louvain_communities(spark, sf_dir):
    """Communities with dense ids by size."""
    labels = materialize(graph.louvain(fx.vectors(spark, sf_dir), _snn(spark, sf_dir)), "louvain")
    return labels.join(ranking.group_ids(labels, "community", F.col("id")), "community").select("id", "community", "group_id", "size")


@query()
def leiden_refine(spark, sf_dir):
    """I4: communities above 25 members refined."""
    edges = _snn(spark, sf_dir)
    labels = materialize(graph.louvain(fx.vectors(spark, sf_dir), edges), "louvain")
    return graph.leiden(labels, edges)


# --- ranking --------------------------------------------------------------


@query(f"WITH {fx.NEIGHBORS} SELECT q, n, rank::INTEGER AS recall_rank, (n % 100) / 100.0 AS rerank_score, row_number() OVER (PARTITION BY q ORDER BY n % 100 DESC, rank)::INTEGER AS rerank_rank FROM neighbors QUALIFY rerank_rank <= 10")
def rerank_reorder(spark, sf_dir):
    """The first ten after rerank, with both ranks."""
    n = fx.neighbors(spark, sf_dir).select("q", "n", F.col("rank").alias("recall_rank"), ((F.col("n") % 100) / 100.0).alias("rerank_score"))
    return ranking.reranked(n, ["q"], "rerank_score", "recall_rank", 10)


@query(f"""WITH {fx.NEIGHBORS}, c AS (SELECT *, count(*) FILTER (score >= 0.36) OVER (PARTITION BY q) AS ok FROM neighbors WHERE rank <= 20) SELECT q, n, score, rank::INTEGER AS rank FROM c WHERE (ok >= 3 AND score >= 0.36) OR (ok < 3 AND rank <= 3)""")
def soft_floor_candidates(spark, sf_dir):
    """A threshold with a least number of candidates."""
    return ranking.soft_floor(fx.neighbors(spark, sf_dir, 20), ["q"], "score", "rank", 0.36, 3)


@query(f"WITH {fx.PLAN} SELECT family_id, chunk, count(*) AS n, CASE WHEN chunk > 1 THEN chunk - 1 END AS depends_on, min(position) AS first_position FROM chunks GROUP BY ALL")
def membership_batch_plan(spark, sf_dir):
    """Chunks of 18 that depend on the one before."""
    m = fx.plan_members(spark, sf_dir)
    order = [F.when(F.col("member_type") == "EQUIVALENT", 0).otherwise(1), F.desc("score"), F.col("l_orderkey"), F.col("l_linenumber")]
    c = ranking.chunked(m, ["family_id"], order, 18)
    return c.groupBy("family_id", "chunk", "depends_on").agg(F.count("*").alias("n"), F.min("position").cast("long").alias("first_position"))


@query(f"""WITH {fx.PLAN}, g AS (SELECT family_id, count(*) AS n, count(*) FILTER (member_type = 'EQUIVALENT') AS eq, CAST(ceil(count(*) / 18.0) AS BIGINT) AS calls FROM plan GROUP BY family_id)
SELECT n // 50 AS bucket, count(*) AS families, sum(n)::BIGINT AS units, sum(eq)::BIGINT AS equivalents, sum(calls)::BIGINT AS calls, round(1 - sum(calls) / sum(n), 6) AS reduction FROM g GROUP BY bucket""")
def consolidation_summary(spark, sf_dir):
    """histogram of group sizes, call estimates, reduction."""
    m = fx.plan_members(spark, sf_dir)
    g = m.groupBy("family_id").agg(F.count("*").alias("n"), F.count_if(F.col("member_type") == "EQUIVALENT").alias("eq")).withColumn("calls", F.ceil(F.col("n") / 18))
    return g.groupBy(F.floor(F.col("n") / 50).alias("bucket")).agg(F.count("*").alias("families"), F.sum("n").alias("units"), F.sum("eq").alias("equivalents"), F.sum("calls").alias("calls"), F.round(1 - F.sum("calls") / F.sum("n"), 6).alias("reduction"))


@query(f"WITH {fx.UNITS}, q AS (SELECT unit_id, row_number() OVER (ORDER BY doc_id) - 1 AS serial_order FROM units WHERE doc_id % 3 = 0) SELECT unit_id, serial_order, printf('NM%04d', serial_order + 1) AS family_id FROM q")
def dense_serial_queue(spark, sf_dir):
    """Uncovered units in natural order with dense numbers and new family ids."""
    u = fx.units(spark, sf_dir).select("unit_id", "doc_id")
    out = ranking.dense_queue(u, u.where("doc_id % 3 <> 0").select("unit_id"), "unit_id", [keys.natural_key("unit_id")])
    return out.select("unit_id", "serial_order", ranking.family_id(F.col("serial_order")).alias("family_id"))


# --- catalog --------------------------------------------------------------


@query(f"WITH {fx.MEMBERS} SELECT family_id, member_id, member_type, group_index FROM members")
def family_member_unnest(spark, sf_dir):
    """nested families as flat memberships."""
    return catalog.unnest(fx.families(spark, sf_dir))


@query(f"WITH {fx.MEMBERS} SELECT family_id, count(*) AS member_count, array_to_string(list_sort(list(member_id)), ',') AS members, count(DISTINCT group_index) AS n_groups FROM members GROUP BY family_id")
def family_members(spark, sf_dir):
    """members of a family, nested again."""
    f = catalog.nest(catalog.unnest(fx.families(spark, sf_dir)))
    return f.select("family_id", "member_count", F.array_join("member_ids", ",").alias("members"), F.size("variant_groups").cast("long").alias("n_groups"))


@query("SELECT lang, count(*) AS families, count(DISTINCT source) AS sources, count(*) FILTER (n_chars > 1000) AS long_ones, min(doc_id) AS first FROM documents GROUP BY lang")
def catalog_rollup(spark, sf_dir):
    """counts of a catalog by origin."""
    d = fx.table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.count("*").alias("families"), F.count_distinct("source").alias("sources"), F.count_if(F.col("n_chars") > 1000).alias("long_ones"), F.min("doc_id").alias("first"))


@query(f"WITH {fx.UNITS} SELECT unit_id FROM units WHERE doc_id % 3 = 0")
def unassigned_units(spark, sf_dir):
    """Units that no family covers."""
    u = fx.units(spark, sf_dir)
    return constraints.leftovers(u.where("doc_id % 3 <> 0"), u, "unit_id")


@query(f"""WITH {fx.SYNC}, s AS (SELECT text, min(id) AS source_id FROM sources GROUP BY text),
j AS (SELECT b.family_id, CASE WHEN a.sha = b.sha THEN 'KEEP' WHEN a.sha IS NOT NULL THEN 'GENERATE_CHANGED' WHEN s.source_id IS NOT NULL THEN 'REUSE_SOURCE' ELSE 'GENERATE_NEW' END AS action, source_id FROM bases b LEFT JOIN active a ON a.family_id = b.family_id LEFT JOIN s ON s.text = b.text)
SELECT family_id, action, CASE WHEN action = 'REUSE_SOURCE' THEN source_id END AS reused_from FROM j""")
def sync_actions(spark, sf_dir):
    """What each base needs from the vector index."""
    return catalog.sync_actions(*fx.sync_inputs(spark, sf_dir))


@query("SELECT text_sha, min(doc_id) AS id FROM (SELECT doc_id, sha256(text) AS text_sha FROM documents) GROUP BY text_sha")
def text_vector_lookup(spark, sf_dir):
    """One vector a text, that of the smallest id."""
    d = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("text_sha"), F.col("n_chars").alias("vector"))
    return catalog.text_vectors(d, "text_sha", "id", "vector").select("text_sha", "id")


@query("""WITH b AS (SELECT user_id AS family_id, concat('h', user_id % 3) AS sha FROM events GROUP BY user_id),
e AS (SELECT user_id AS family_id, concat('h', event_id % 3) AS sha, event_id AS seq, value AS vector FROM events UNION ALL SELECT family_id, sha, -1, 0.5 FROM b WHERE family_id % 2 = 0)
SELECT e.family_id, max(seq) AS seq, arg_max(vector, seq) AS vector FROM e JOIN b ON b.family_id = e.family_id AND b.sha = e.sha GROUP BY e.family_id""")
def active_vectors(spark, sf_dir):
    """The newest vector whose hash is the current one."""
    e = fx.table(spark, sf_dir, "events")
    b = e.groupBy(F.col("user_id").alias("family_id")).agg(F.concat(F.lit("h"), F.first("user_id") % 3).alias("sha"))
    updates = e.select(F.col("user_id").alias("family_id"), F.concat(F.lit("h"), F.col("event_id") % 3).alias("sha"), F.col("value").alias("vector"), F.col("event_id").alias("seq"))
    initial = b.where("family_id % 2 = 0").withColumn("vector", F.lit(0.5))
    return catalog.active_vectors(b, initial, updates)


ENRICH = FAMILY + """, r AS (SELECT qid, family AS family_id, CASE WHEN matched_id % 10 <> 0 THEN matched_id END AS member_id, score, rank FROM top WHERE rank <= 5)"""


@query(ENRICH + """ SELECT r.qid, r.family_id, r.member_id, score, rank, concat('base ', r.family_id) AS base_text, CASE WHEN r.member_id IS NULL THEN 'BASE' ELSE 'VARIANT_MEMBER' END AS matched_type, CASE WHEN r.member_id IS NULL THEN concat('base ', r.family_id) ELSE concat('unit ', r.member_id) END AS matched_text FROM r""")
def enrich_results(spark, sf_dir):
    """Two-step retrieval with the matched texts; the flagship."""
    reps = fx.representations(spark, sf_dir)
    top = vectors.top_groups(fx.held_out(spark, sf_dir), reps, 20)
    top = top.select("qid", F.col("family").alias("family_id"), F.when(F.col("matched_id") % 10 != 0, F.col("matched_id")).alias("member_id"), "score", "rank")
    bases = reps.select(F.col("family").alias("family_id")).distinct().withColumn("text", F.concat(F.lit("base "), "family_id"))
    variants = reps.where("not is_base").select(F.col("id").alias("member_id"), F.concat(F.lit("unit "), "id").alias("text"))
    return catalog.enriched(top, bases, variants, keep=5)


@query(ENRICH + """ SELECT r.qid, r.family_id, r.member_id, score, rank, CASE WHEN r.member_id IS NULL THEN concat('base ', r.family_id) ELSE concat('unit ', r.member_id, chr(10), 'delta ', r.member_id % 2) END AS document FROM r""")
def candidate_documents(spark, sf_dir):
    """Rerank documents of candidates."""
    reps = fx.representations(spark, sf_dir)
    top = vectors.top_groups(fx.held_out(spark, sf_dir), reps, 5)
    top = top.select("qid", F.col("family").alias("family_id"), F.when(F.col("matched_id") % 10 != 0, F.col("matched_id")).alias("member_id"), "score", "rank")
    bases = reps.select(F.col("family").alias("family_id")).distinct().withColumn("text", F.concat(F.lit("base "), "family_id"))
    member = reps.where("not is_base").select(F.col("id").alias("member_id"))
    return catalog.candidate_texts(top, bases, member.select(F.col("member_id").alias("unit_id"), F.concat(F.lit("unit "), "member_id").alias("text")), member.select("member_id", F.concat(F.lit("delta "), F.col("member_id") % 2).alias("delta")))


@query(f"WITH {fx.REPS} SELECT family AS family_id, id % 2 = 0 AS even, CASE WHEN id // 10 % 3 = 0 THEN 'INGESTED_NO_MATCH' ELSE 'INITIAL' END AS origin, count(*) AS n FROM reps WHERE id // 10 % 3 = 0 GROUP BY ALL")
def candidate_origins(spark, sf_dir):
    """Provenance of candidates; only ingested ones are dynamic."""
    reps = fx.representations(spark, sf_dir).select(F.col("family").alias("family_id"), "id")
    states = reps.where(F.floor(F.col("id") / 10) % 3 == 0).select("family_id", F.lit("INGESTED_NO_MATCH").alias("origin")).distinct()
    return catalog.dynamic_candidates(catalog.origins(reps, states)).groupBy("family_id", (F.col("id") % 2 == 0).alias("even"), "origin").agg(F.count("*").alias("n"))


@query("""WITH j AS (SELECT l_orderkey * 10 + l_linenumber AS unit_id, l_suppkey AS family_id, min(l_returnflag) AS l_returnflag, max(l_discount) AS score FROM lineitem GROUP BY ALL)
SELECT family_id, count(*) AS n_units, count(*) FILTER (l_returnflag = 'A') AS n_equivalent, max(score) AS best_score, sha256(array_to_string(list_sort(list(unit_id)), ',')) AS units_sha FROM j WHERE l_returnflag IN ('A', 'R') GROUP BY family_id""")
def group_accepted(spark, sf_dir):
    """Accepted judgments with their candidates, by family."""
    li = fx.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("unit_id"), F.col("l_suppkey").alias("family_id"), "l_returnflag", "l_discount")
    li = li.groupBy("unit_id", "family_id").agg(F.min("l_returnflag").alias("l_returnflag"), F.max("l_discount").alias("score"))
    judged = li.select("unit_id", "family_id", F.when(F.col("l_returnflag") == "A", "EQUIVALENT").when(F.col("l_returnflag") == "R", "VARIANT").otherwise("NO_MATCH").alias("decision"))
    return catalog.accepted_groups(judged, li.select("unit_id", "family_id", "score")).select("family_id", "n_units", "n_equivalent", "best_score", F.sha2(F.array_join("unit_ids", ","), 256).alias("units_sha"))


@query(f"""WITH {fx.MEMBERS}, f AS (SELECT family_id, member_id, CAST(substr(family_id, 2) AS INTEGER) AS n, CAST(substr(member_id, 2) AS INTEGER) % 10 AS d FROM members)
SELECT family_id, 'GRAPH_UNMATCHED' AS origin, member_id FROM f WHERE n % 4 = 0 UNION ALL SELECT family_id, 'SINGLETON', member_id FROM f WHERE n % 4 = 1
UNION ALL SELECT concat('N', n // 8), 'REGENERATED', member_id FROM f WHERE n % 4 >= 2 AND d <> 5 UNION ALL SELECT family_id, 'ORPHAN', member_id FROM f WHERE n % 4 >= 2 AND d = 5""")
def catalog_assembly(spark, sf_dir):
    """Retained, single, regenerated and orphaned memberships."""
    m = catalog.unnest(fx.families(spark, sf_dir)).select("family_id", "member_id").withColumns({"n": F.substring("family_id", 2, 9).cast("int"), "d": F.substring("member_id", 2, 9).cast("int") % 10})
    old = m.select("family_id", "member_id")
    regrouped = m.where("n % 4 >= 2").select("family_id", F.floor(F.col("n") / 8).alias("group_id")).distinct()
    new = m.where("n % 4 >= 2 and d <> 5").select(F.floor(F.col("n") / 8).alias("group_id"), F.concat(F.lit("N"), F.floor(F.col("n") / 8)).alias("new_family_id"), "member_id")
    return catalog.assembled(old, m.where("n % 4 = 0").select("family_id").distinct(), regrouped, new)


@query("""WITH p AS (SELECT l_returnflag, l_linestatus, list_sort(list(DISTINCT l_suppkey::VARCHAR)) AS c FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_linestatus, len(c)::BIGINT AS n_cases, (SELECT count(DISTINCT c) = 1 FROM p) AS same FROM p""")
def condition_coverage(spark, sf_dir):
    """H3: every condition has the same cases."""
    return catalog.coverage(fx.table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_suppkey").drop("signature")


@query(f"WITH {fx.LOG} SELECT model, 'tokens' AS key, sum(tokens)::BIGINT AS total FROM log GROUP BY model UNION ALL SELECT model, 'calls', count(*) FROM log GROUP BY model")
def usage_totals(spark, sf_dir):
    """usage maps summed by key."""
    log = fx.call_log(spark, sf_dir).withColumn("usage", F.create_map(F.lit("tokens"), "tokens", F.lit("calls"), F.lit(1).cast("long")))
    return catalog.usage_totals(log, ["model"], "usage")


@query(f"WITH {fx.LOG} SELECT 'total_tokens' AS key, sum(tokens)::BIGINT AS total FROM log UNION ALL SELECT 'requests', count(*) FROM log")
def nested_usage(spark, sf_dir):
    """whole numbers under matching keys at any depth of a document."""
    log = fx.call_log(spark, sf_dir)
    doc = F.concat(F.lit('{"note":"\\"tokens\\": 7","usage":{"total_tokens":'), "tokens", F.lit(',"cost":1.5,"detail":[{"requests":1,"token_share":0.5}]}}'))
    return catalog.nested_usage(log.select(doc.alias("doc")), "doc")


@query(f"""WITH {fx.LOG}, last AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY batch_id, model ORDER BY seq DESC) = 1) SELECT batch_id, count(*) AS n_models, sum(tokens)::BIGINT AS tokens, array_to_string(list_sort(list(model)), ',') AS models FROM last GROUP BY batch_id""")
def rebuilt_outputs(spark, sf_dir):
    """results rebuilt from the last records of a log."""
    last = ranking.latest(fx.call_log(spark, sf_dir), ["batch_id", "model", "prompt_sha256", "input_sha256"], "seq")
    return last.groupBy("batch_id").agg(F.count("*").alias("n_models"), F.sum("tokens").alias("tokens"), F.array_join(F.array_sort(F.collect_list("model")), ",").alias("models"))


# --- context, verdicts ----------------------------------------------------


@query(f"WITH {fx.SITUATIONS} SELECT r.case_id, start_step, end_step, s.step_id, situation, action FROM ranges r JOIN steps s ON s.case_id = r.case_id AND s.step_id BETWEEN start_step AND end_step")
def situation_step_range_join(spark, sf_dir):
    """Steps inside situation ranges."""
    ranges, steps = fx.situations(spark, sf_dir)
    return catalog.steps_in_range(steps, ranges).select("case_id", "start_step", "end_step", "step_id", "situation", "action")


@query(f"WITH {fx.SITUATIONS} SELECT r.case_id, start_step, end_step, s.step_id, count(*) AS n_seen, string_agg(concat(h.step_id, ' ', h.action, ' ', length(h.page)), '; ' ORDER BY h.step_id) AS seen FROM ranges r JOIN steps s ON s.case_id = r.case_id AND s.step_id BETWEEN start_step AND end_step JOIN steps h ON h.case_id = r.case_id AND h.step_id BETWEEN start_step AND s.step_id GROUP BY ALL")
def situation_step_history(spark, sf_dir):
    """Each matched step with the steps of its situation up to it."""
    ranges, steps = fx.situations(spark, sf_dir)
    found = catalog.with_prefix(catalog.steps_with_history(steps, ranges), catalog.case_histories(steps))
    seen = F.array_join(F.transform("prefix", lambda s: F.concat(s["step_id"], F.lit(" "), s["action"], F.lit(" "), F.length(s["page"]))), "; ")
    return found.select("case_id", "start_step", "end_step", "step_id", F.size("prefix").cast("long").alias("n_seen"), seen.alias("seen"))


@query(f"""WITH {fx.STEPS}, g AS (SELECT case_id, bool_or(failed) AS bug_found, min(step_id) FILTER (failed) AS bug_step, min(confidence) AS low, count(*) FILTER (failed) AS n_failed, coalesce(string_agg(description, '; ' ORDER BY step_id) FILTER (failed), '') AS descriptions FROM steps GROUP BY case_id)
SELECT g.case_id, bug_found, s.bug_type, bug_step, coalesce(s.confidence, low) AS confidence, n_failed, descriptions FROM g LEFT JOIN steps s ON s.case_id = g.case_id AND s.step_id = g.bug_step""")
def case_verdict(spark, sf_dir):
    """a case's verdict from its steps."""
    return catalog.verdicts(fx.verdict_steps(spark, sf_dir))


@query(f"""WITH {fx.SITUATIONS}, t AS (SELECT case_id, step_id, concat(step_id, '. [', action, '] ', length(page)) AS line, row_number() OVER (PARTITION BY case_id ORDER BY step_id) AS r FROM steps) SELECT case_id, count(*) AS n, string_agg(line, chr(10) ORDER BY step_id) AS text FROM t WHERE r <= 3 GROUP BY case_id""")
def context_render(spark, sf_dir):
    """The first lines of a case as one text."""
    _, steps = fx.situations(spark, sf_dir)
    line = F.concat(F.col("step_id"), F.lit(". ["), F.col("action"), F.lit("] "), F.length("page"))
    return catalog.joined_text(steps, ["case_id"], F.col("step_id"), line, top=3)


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('head ', 'ctx', chr(10), chr(10), '## Task ', lang, ' ## Task') ELSE concat(lang, chr(10), chr(10), 'ctx') END AS prompt FROM documents")
def context_insert(spark, sf_dir):
    """A context before the first marker of a prompt."""
    d = fx.table(spark, sf_dir, "documents")
    prompt = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("head ## Task "), "lang", F.lit(" ## Task"))).otherwise(F.col("lang"))
    return d.select("doc_id", text.insert_before(prompt, "## Task", F.lit("ctx")).alias("prompt"))


@query(f"WITH {fx.SITUATIONS} SELECT case_id, step_id, page, lead(page) OVER (PARTITION BY case_id ORDER BY step_id) AS after_page FROM steps QUALIFY after_page IS NOT NULL")
def step_pairs(spark, sf_dir):
    """Each step with the page after it."""
    _, steps = fx.situations(spark, sf_dir)
    return catalog.step_pairs(steps).select("case_id", "step_id", "page", "after_page")


@query("""WITH e AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS types FROM e GROUP BY user_id""")
def ordered_distinct(spark, sf_dir):
    """distinct values in order of first appearance."""
    e = fx.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    return catalog.joined_text(e, ["user_id"], F.col("first"), F.col("event_type"), sep=",").select("user_id", F.col("text").alias("types"))


# --- serial, services, plans ----------------------------------------------


@query("""WITH one AS (SELECT l_suppkey AS family_id, concat(l_orderkey, '-', l_linenumber) AS member_id, min(CASE WHEN l_returnflag = 'A' THEN 'EQUIVALENT' ELSE 'VARIANT' END) AS member_type, max(l_discount) AS score, l_orderkey, l_linenumber FROM lineitem GROUP BY ALL),
m AS (SELECT *, concat('d', l_linenumber) AS delta, CAST(ceil(row_number() OVER (PARTITION BY family_id ORDER BY CASE WHEN member_type = 'EQUIVALENT' THEN 0 ELSE 1 END, score DESC, l_orderkey, l_linenumber) / 18.0) AS INTEGER) AS chunk FROM one),
g AS (SELECT family_id, delta, array_to_string(list(member_id ORDER BY l_orderkey, l_linenumber), ' ') AS ids, min((l_orderkey, l_linenumber)) AS first FROM m WHERE member_type = 'VARIANT' GROUP BY ALL),
v AS (SELECT family_id, array_to_string(list(concat(delta, ': ', ids) ORDER BY first), '; ') AS variants FROM g GROUP BY family_id),
e AS (SELECT family_id, max(chunk)::INTEGER AS version, coalesce(array_to_string(list(member_id ORDER BY l_orderkey, l_linenumber) FILTER (member_type = 'EQUIVALENT'), ' '), '') AS equivalent FROM m GROUP BY family_id)
SELECT e.family_id, version, CASE WHEN variants IS NULL THEN 'ANCHORED' ELSE 'SYNTHESIZED' END AS base_origin, equivalent, coalesce(variants, '') AS variants, version + 1 AS next_chunk, CAST(NULL AS VARCHAR) AS fault FROM e LEFT JOIN v USING (family_id)""")
def family_fold(spark, sf_dir):
    """Families as their chunks leave them, parallel across families, serial within, in slices that a broken run goes on from."""
    m = fx.plan_members(spark, sf_dir).groupBy("family_id", "member_id", "l_orderkey", "l_linenumber").agg(F.min("member_type").alias("member_type"), F.max("score").alias("score"))
    m = m.withColumn("delta", F.concat(F.lit("d"), "l_linenumber"))
    order = [F.when(F.col("member_type") == "EQUIVALENT", 0).otherwise(1), F.desc("score"), F.col("l_orderkey"), F.col("l_linenumber")]
    plan = materialize(ranking.chunked(m, ["family_id"], order, 18).select("family_id", "chunk", "position", "member_id", "member_type", "delta"), "family-plan")
    f = families.fold(plan, _folder(spark, "families"))
    groups = F.array_join(F.transform("variant_groups", lambda g: F.concat(g["delta"], F.lit(": "), F.array_join(g["member_ids"], " "))), "; ")
    return f.select("family_id", "version", "base_origin", F.array_join("equivalent_member_ids", " ").alias("equivalent"), groups.alias("variants"), "next_chunk", "fault")


def _serial_events(spark, sf_dir) -> DataFrame:
    e = fx.table(spark, sf_dir, "embeddings").select(F.concat(F.lit("V"), "vec_id").alias("unit_id"), F.col("vec_id").alias("serial_order"), F.col("embedding").alias("vector"))
    judge = lambda unit, found: serial.by_threshold(unit, found, 0.45, 0.40)
    generalise = lambda unit, vector, family, members: serial.by_groups(unit, vector, family, members, 0.42, 4)
    return serial.event_log(e, judge, generalise)


@query()
def serial_consolidation(spark, sf_dir):
    """The ordered fold over a queue, as its event log."""
    return _serial_events(spark, sf_dir)


@query()
def state_replay(spark, sf_dir):
    """The catalog as the events leave it, with each family's version and origins."""
    return serial.replay(_serial_events(spark, sf_dir))


@query("""SELECT user_id AS family_id, max(event_id) AS seq, sha256(arg_max(event_type, event_id)) AS sha, arg_max(value, event_id) AS vector FROM events GROUP BY user_id""")
def index_sync(spark, sf_dir):
    """Vector events synced into a bucketed index by micro-batches, with compaction, the manifest last."""
    schema = "family_id long, seq long, sha string, vector double"
    path = f"{shared_dir(spark).rstrip('/')}/sync-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    e = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("family_id"), F.col("event_id").alias("seq"), F.sha2("event_type", 256).alias("sha"), F.col("value").alias("vector"))
    e.repartitionByRange(3, "seq").write.parquet(f"{path}/events")
    serial.sync_stream(spark, f"{path}/events", f"{path}/active", f"{path}/checkpoint", schema, per_trigger=1, deltas=1).awaitTermination()
    return serial.active_index(spark, f"{path}/active", schema)


@query(f"""WITH {fx.MEMBERS}, e AS (SELECT family_id, list(member_id ORDER BY CAST(substr(member_id, 2) AS BIGINT)) AS ids FROM members WHERE member_type = 'EQUIVALENT' GROUP BY family_id),
g AS (SELECT family_id, group_index, list(member_id ORDER BY CAST(substr(member_id, 2) AS BIGINT)) AS ids FROM members WHERE group_index IS NOT NULL GROUP BY ALL),
v AS (SELECT family_id, array_to_string(list(array_to_string(ids, ' ') ORDER BY CAST(substr(ids[1], 2) AS BIGINT)), '; ') AS groups FROM g GROUP BY family_id),
n AS (SELECT family_id, count(*) AS member_count FROM members GROUP BY family_id)
SELECT n.family_id, member_count, array_to_string(e.ids, ' ') AS equivalent, groups, CASE WHEN CAST(substr(n.family_id, 2) AS BIGINT) % 3 = 0 THEN 'SYNTHESIZED' ELSE 'ANCHORED' END AS base_origin,
CASE WHEN CAST(substr(n.family_id, 2) AS BIGINT) % 7 = 0 THEN 'repeated' ELSE '' END AS faults FROM n JOIN e USING (family_id) JOIN v USING (family_id)""")
def family_normal_form(spark, sf_dir):
    """Families in normal form, with their faults; a changed base is synthesised."""
    f = fx.families(spark, sf_dir).withColumn("n", F.substring("family_id", 2, 9).cast("int"))
    mixed = F.transform(F.reverse("variant_groups"), lambda g: F.struct(F.reverse(g["member_ids"]).alias("member_ids")))
    twice = F.when(F.col("n") % 7 == 0, F.concat("equivalent_member_ids", "equivalent_member_ids")).otherwise(F.col("equivalent_member_ids"))
    f = f.select("family_id", twice.alias("equivalent_member_ids"), mixed.alias("variant_groups"), F.lit("b").alias("base_before"), F.when(F.col("n") % 3 == 0, "c").otherwise("b").alias("base"), F.lit("ANCHORED").alias("origin_before"))
    out = catalog.normal_families(f)
    return out.select("family_id", "member_count", F.array_join("equivalent_member_ids", " ").alias("equivalent"), F.array_join(F.transform("variant_groups", lambda g: F.array_join(g["member_ids"], " ")), "; ").alias("groups"), "base_origin", F.array_join("faults", ",").alias("faults"))


@query()
def offline_embed(spark, sf_dir):
    """K1: each distinct text embedded once by the offline embedder."""
    u = fx.units(spark, sf_dir)
    return providers.embed(u, "unit_id", "situation", providers.HashEmbedder())


WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''))"


@query(f"""WITH {fx.NEIGHBORS}, t AS (SELECT doc_id, {WORDS} AS w FROM documents)
SELECT q AS qid, n AS id, CASE WHEN len(a.w) = 0 THEN 0 ELSE round_even(len(list_intersect(a.w, b.w)) / len(a.w), 6) END AS rerank_score FROM neighbors JOIN t a ON a.doc_id = q JOIN t b ON b.doc_id = n WHERE rank <= 10""")
def offline_rerank(spark, sf_dir):
    """K2: every query's recall list scored by the offline reranker."""
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = fx.neighbors(spark, sf_dir).where("rank <= 10").select(F.col("q").alias("qid"), F.col("n").alias("id"))
    pairs = pairs.join(d.withColumnsRenamed({"doc_id": "qid", "text": "query"}), "qid").join(d.withColumnsRenamed({"doc_id": "id", "text": "document"}), "id")
    return providers.rerank(pairs, providers.OverlapReranker())


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'error' WHEN doc_id % 5 = 1 THEN 'invalid_output' ELSE 'success' END AS status, CAST(CASE WHEN doc_id % 5 = 0 THEN 1 WHEN doc_id % 5 = 1 THEN 3 WHEN doc_id % 5 = 2 THEN 2 ELSE 1 END AS INTEGER) AS attempts,
CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN 'bad' WHEN doc_id % 5 = 3 THEN 'good in text' ELSE 'good' END AS output, CAST(CASE WHEN doc_id % 5 = 1 THEN 3 WHEN doc_id % 5 = 2 THEN 2 ELSE 1 END AS BIGINT) AS n_raw FROM documents""")
def validated_calls(spark, sf_dir):
    """K3, K4, K5, K7: calls whose raw answers are stored first, checked, asked again with the complaint, tried again when a connection breaks, and asked in text where images are refused."""
    import urllib.error

    broken: set[str] = set()

    def full(request: str, complaint: str | None) -> str:
        kind = int(request) % 5
        if kind == 0 or kind == 4 and request not in broken:
            broken.add(request)
            raise ConnectionError("lost")
        broken.discard(request)  # a task that runs again meets the same; one lost connection more or less within an attempt changes no result
        if kind == 3:
            raise urllib.error.HTTPError("u", 400, "no images", None, None)
        return "bad" if kind == 1 or kind == 2 and complaint is None else "good"

    path = _folder(spark, "raw")
    d = fx.table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("request"))
    chat = providers.with_fallback(full, lambda request, complaint: "good in text")
    out = providers.validated(d, "doc_id", "request", chat, lambda answer: None if answer.startswith("good") else "not good", pause=0.0, raw_path=path)
    raw = spark.read.parquet(path).groupBy(F.col("k").alias("doc_id")).agg(F.count("*").alias("n_raw"))
    return out.join(raw, "doc_id").select("doc_id", "status", "attempts", "output", "n_raw")


@query(f"""WITH {fx.SITUATIONS}, r AS (SELECT case_id, step_id, action, CASE WHEN step_id % 2 = 0 THEN page END AS page, concat('f', step_id) AS f FROM steps),
p AS (SELECT case_id, step_id, 'function_identification' AS entry, CASE WHEN page IS NOT NULL THEN concat('Name the function that this step uses.', chr(10), 'Page: ', page, chr(10), 'Action: ', action) ELSE concat('Name the function that this step uses.', chr(10), 'Action: ', action) END AS prompt, 1 AS n_images FROM r
UNION ALL SELECT case_id, step_id, 'response_verification', CASE WHEN page IS NOT NULL THEN concat('Does the page after the action fit the function?', chr(10), 'Function: ', f, chr(10), 'Before: ', page, chr(10), 'Action: ', action) ELSE concat('Does the page after the action fit the function?', chr(10), 'Function: ', f, chr(10), 'Action: ', action) END, 2 FROM r
UNION ALL SELECT case_id, step_id, 'response_verification_rules', concat('Does the page after the action fit the function and these rules?', chr(10), 'Function: ', f, chr(10), 'Action: ', action, chr(10), 'Rules:', chr(10), '$page'), 2 FROM r
UNION ALL SELECT case_id, step_id, 'function_summary', concat('Sum up what these steps test.', chr(10), coalesce(page, '')), 0 FROM r UNION ALL SELECT case_id, step_id, 'situation_extraction', concat('List the situations that these pages show.', chr(10), coalesce(page, '')), 1 FROM r
UNION ALL SELECT case_id, step_id, 'situation_extraction_in_sequence', concat('List the situations of this sequence of steps.', chr(10), 'Steps so far: $page', chr(10), coalesce(page, '')), 1 FROM r)
SELECT case_id, step_id, entry, n_images, length(prompt)::BIGINT AS prompt_length, sha256(concat('m', chr(10), chr(10), entry, chr(10), chr(10), prompt)) AS request_sha FROM p""")
def detector_requests(spark, sf_dir):
    """The requests of six prompt-bound entry points for every step of every case."""
    _, steps = fx.situations(spark, sf_dir)
    page = F.when(F.col("step_id") % 2 == 0, F.col("page"))
    fields = {"action": F.col("action"), "page": page, "function": F.concat(F.lit("f"), F.col("step_id")), "context": F.lit("$page")}
    out = detectors.requests(steps, "m", fields, ["case_id", "step_id"])
    return out.select("case_id", "step_id", "entry", "n_images", F.length("prompt").cast("long").alias("prompt_length"), "request_sha")


@query(f"""WITH {fx.SITUATIONS}, m AS (SELECT case_id, start_step, concat('{{"case":"', case_id, '","steps":"', start_step, '-', end_step, '"}}') AS plain, concat('{{"ablation":"no_generalisation","case":"', case_id, '","retrieval_schema":"instance_level","steps":"', start_step, '-', end_step, '"}}') AS tagged FROM ranges)
SELECT case_id, start_step, sha256(plain) AS fingerprint, sha256(tagged) AS ablated_fingerprint FROM m""")
def ablation_mappings(spark, sf_dir):
    """A case's mapping and its ablation, each under its own fingerprint."""
    ranges, _ = fx.situations(spark, sf_dir)
    fields = {"case": F.col("case_id").cast("string"), "steps": F.concat_ws("-", "start_step", "end_step")}
    plain = detectors.fingerprinted(ranges, **fields).select("case_id", "start_step", "end_step", "fingerprint")
    tagged = detectors.ablated(ranges, "no_generalisation", **fields).select("case_id", "start_step", F.col("fingerprint").alias("ablated_fingerprint"))
    return plain.drop("end_step").join(tagged, ["case_id", "start_step"])


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'made' ELSE 'cached' END AS answer FROM documents")
def memoised_calls(spark, sf_dir):
    """K8: only requests without a recorded answer reach a service."""
    d = fx.table(spark, sf_dir, "documents")
    work = d.select("doc_id", providers.request_key("m", F.lit("p"), F.col("text")).alias("request_sha"))
    cache = work.where("doc_id % 3 <> 0").withColumn("answer", F.lit("cached"))
    every, _ = providers.memoised(work, cache, ["doc_id", "request_sha"], lambda misses: misses.withColumn("answer", F.lit("made")))
    return every.select("doc_id", "answer")


def _staged(spark, sf_dir):
    from ruleloom.plans import stages

    root = f"{shared_dir(spark).rstrip('/')}/stages-{uuid.uuid4().hex}"
    atexit.register(remove, spark, root)
    return root, stages.fixture(spark, sf_dir)


@query()
def stage_summary(spark, sf_dir):
    """L1, L2: all seven library stages, with the rows of each step's table."""
    from ruleloom.plans import stages

    root, given = _staged(spark, sf_dir)
    tables = stages.run_all(spark, root, given, stages.FIXTURE)
    return stages.summary(tables, [step.output for steps in stages.stages().values() for step in steps])


@query("""WITH r AS (SELECT doc_id, length(trim(concat('# ', trim(split_part(text, chr(10), 1))))) AS n FROM documents)
SELECT step, status, CASE WHEN status = 'success' THEN (SELECT count(*) FROM documents) END AS n_rows, 64 AS hash_length, count(*) AS n FROM (VALUES ('reports'), ('prompts'), ('answers'), ('raw_units')) s(step), (VALUES ('success'), ('skipped')) t(status) GROUP BY ALL""")
def stage_manifests(spark, sf_dir):
    """A stage run twice: what its manifests say, with the hashes of its inputs."""
    from ruleloom.plans import stages

    root, given = _staged(spark, sf_dir)
    steps = stages.stages(stages.FIXTURE)[1][:4]
    for _ in range(2):
        stages.run_stage(spark, root, 1, steps, given, stages.FIXTURE)
    lines = stages.summaries(spark, root).select(F.explode(F.split("content", "\n")).alias("line")).where("line <> ''").select(F.from_json("line", stages.MANIFEST).alias("m"))
    return lines.groupBy("m.step", "m.status", "m.n_rows", F.length(F.map_values("m.inputs")[0]).alias("hash_length")).agg(F.count("*").alias("n"))


@query("""SELECT lang AS source, count(*) FILTER (length(trim(text)) >= 400) AS n_units, count(*) AS n FROM documents GROUP BY lang""")
def extracted_units(spark, sf_dir):
    """L2: the extraction stage, by language: reports whose answers hold a rule."""
    from ruleloom.plans import stages

    root, given = _staged(spark, sf_dir)
    given["issues"] = given["issues"].drop("source").join(fx.table(spark, sf_dir, "documents").select(F.concat(F.lit("D"), "doc_id").alias("id"), F.col("lang").alias("source")), "id")
    t = stages.run_stage(spark, root, 1, stages.stages(stages.FIXTURE)[1], given, stages.FIXTURE)
    found = t["raw_units"].select("id", "is_violation").join(t["reports"].select("id", "source"), "id")
    return found.groupBy("source").agg(F.count_if("is_violation").alias("n_units"), F.count("*").alias("n"))


@query("""SELECT detector, model, condition, l_suppkey AS case_id FROM (VALUES ('d1'), ('d2'), ('d3')) a(detector), (VALUES ('m1'), ('m2')) b(model), (VALUES ('base'), ('rules')) c(condition), (SELECT DISTINCT l_suppkey FROM lineitem)""")
def experiment_jobs(spark, sf_dir):
    """L3: detector, model and condition of every case's job."""
    from ruleloom.plans.stages import jobs

    cases = fx.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("case_id")).distinct()
    return jobs(cases, detector=["d1", "d2", "d3"], model=["m1", "m2"], condition=["base", "rules"])


@query(f"""WITH {fx.STEPS}, g AS (SELECT case_id, count(*) AS n, count(*) FILTER (failed) AS failed FROM steps GROUP BY case_id),
j AS (SELECT *, CASE detector WHEN 'any' THEN 1 ELSE CAST(ceil(n / 2.0) AS BIGINT) END + CASE condition WHEN 'rules' THEN 1 ELSE 0 END AS least FROM g, (VALUES ('any'), ('half')) a(detector), (VALUES ('base'), ('rules')) c(condition))
SELECT case_id, detector, condition, failed >= least AS bug_found, CASE WHEN failed >= least THEN 'steps' ELSE 'none' END AS bug_type, round(failed / n, 6) AS confidence FROM j""")
def experiment_results(spark, sf_dir):
    """K9, L3: each case's jobs run by the offline detectors, their raw answers stored and read as one result a job."""
    from ruleloom.plans.stages import jobs

    g = fx.verdict_steps(spark, sf_dir).groupBy("case_id").agg(F.count("*").alias("steps"), F.count_if("failed").alias("failed"))
    work = jobs(g, detector=["any", "half"], condition=["base", "rules"])
    work = work.withColumn("key", F.concat_ws("|", "case_id", "detector", "condition")).withColumn("request", F.to_json(F.struct("detector", "condition", "failed", "steps")))
    out = detectors.run_jobs(work, "key", "request", detectors.offline_detector, _folder(spark, "jobs"), waves=2)
    r, key = text.bug_record(F.col("raw")), F.split("key", r"\|")
    return out.select(key[0].cast("long").alias("case_id"), key[1].alias("detector"), key[2].alias("condition"), r.alias("r")).select("case_id", "detector", "condition", "r.bug_found", F.col("r.bug_type").cast("string").alias("bug_type"), F.round(F.col("r.confidence").cast("double"), 6).alias("confidence"))


@query("SELECT vec_id, '8x8' AS size, true AS equal_pixels, false AS equal_files FROM embeddings")
def image_pixels(spark, sf_dir):
    """PNG files of the same pixels, written with other filters and compression, compared by bytes and by pixels."""
    import numpy as np
    import pyarrow as pa

    from ruleloom.functions import images

    def made(batches):
        for b in batches:
            files_: list[tuple[bytes, bytes]] = []
            for v in b.column(1).to_pylist():
                p = np.repeat(np.rint(np.array(v, float) * 128 + 128).astype(np.uint8).reshape(8, 8, 1), 4, axis=2)
                files_.append((images.encode(p, 1, 1), images.encode(p, 2, 9)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[i] for f in files_], pa.binary()) for i in (0, 1))], ["vec_id", "a", "b"])

    pairs = materialize(fx.table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(made, "vec_id long, a binary, b binary"), "images")
    one, two = (images.pixel_hashes(pairs, "vec_id", c).withColumnsRenamed({"size": f"size_{c}", "pixels": f"pixels_{c}"}) for c in "ab")
    out = pairs.select("vec_id", files.images_equal("a", "b").alias("equal_files")).join(one, "vec_id").join(two, "vec_id")
    return out.select("vec_id", F.col("size_a").alias("size"), (F.col("pixels_a") == F.col("pixels_b")).alias("equal_pixels"), "equal_files")
