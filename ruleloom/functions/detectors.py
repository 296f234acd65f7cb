"""Prompt-bound entry points of detectors, their requests and fingerprints, as column expressions."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.functions.keys import canonical_json, sha_text
from ruleloom.plans.durable import exists


@dataclass(frozen=True)
class EntryPoint:
    """A prompt with ``$field`` places, the form with one more field if a row has it, and how many images go before it."""

    prompt: str
    images: int
    longer: str | None = None
    extra: str | None = None


ENTRY_POINTS: dict[str, EntryPoint] = {
    "function_identification": EntryPoint("Name the function that this step uses.\nAction: $action", 1, "Name the function that this step uses.\nPage: $page\nAction: $action", "page"),
    "response_verification": EntryPoint("Does the page after the action fit the function?\nFunction: $function\nAction: $action", 2, "Does the page after the action fit the function?\nFunction: $function\nBefore: $page\nAction: $action", "page"),
    "response_verification_rules": EntryPoint("Does the page after the action fit the function and these rules?\nFunction: $function\nAction: $action\nRules:\n$context", 2),
    "function_summary": EntryPoint("Sum up what these steps test.\n$page", 0),
    "situation_extraction": EntryPoint("List the situations that these pages show.\n$page", 1),
    "situation_extraction_in_sequence": EntryPoint("List the situations of this sequence of steps.\nSteps so far: $context\n$page", 1),
}


def prompt(entry: EntryPoint, fields: Mapping[str, Column]) -> Column:
    """The filled prompt; a value is never searched for places, and the longer form is used where its field is not null."""

    def fill(template: str) -> Column:
        parts: list[Column] = []
        while template:
            at = [(template.find("$" + name), name) for name in fields if "$" + name in template]
            if not at:
                break
            n, name = min(at)
            parts += [F.lit(template[:n]), F.coalesce(fields[name].cast("string"), F.lit(""))]
            template = template[n + 1 + len(name) :]
        return F.concat(*parts, F.lit(template))

    short = fill(entry.prompt)
    return short if entry.longer is None else F.when(fields[entry.extra].isNotNull(), fill(entry.longer)).otherwise(short)


def requests(rows: DataFrame, model: str, fields: Mapping[str, Column], keep: list[str]) -> DataFrame:
    """(keep..., entry, prompt, n_images, request_sha): a request of every entry point for every row."""
    each = [F.struct(F.lit(name).alias("entry"), prompt(e, fields).alias("prompt"), F.lit(e.images).alias("n_images")) for name, e in ENTRY_POINTS.items()]
    out = rows.select(*keep, F.explode(F.array(*each)).alias("r")).select(*keep, "r.*")
    return out.withColumn("request_sha", F.sha2(F.concat_ws("\n\n", F.lit(model), "entry", "prompt"), 256))


def fingerprinted(rows: DataFrame, **fields: Column) -> DataFrame:
    """``rows`` with ``mapping``, the canonical JSON of the fields, and its ``fingerprint``."""
    out = rows.withColumn("mapping", canonical_json(**fields))
    return out.withColumn("fingerprint", sha_text(F.col("mapping")))


def ablated(rows: DataFrame, tag: str, **fields: Column) -> DataFrame:
    """The mapping of an ablation: the same fields, tagged, and so with a fingerprint of its own."""
    return fingerprinted(rows, **fields, ablation=F.lit(tag), retrieval_schema=F.lit("instance_level"))


ANSWER = "key string, raw string, failure string"


def run_jobs(jobs: DataFrame, key: str, request: str, call: Callable[[str], str], path: str, tasks: int = 4, concurrency: int = 4, per_second: float | None = None, waves: int = 1) -> DataFrame:
    """(key, raw, failure) of every job: ``call`` of its request, or why that failed.

    Raw answers are a table below ``path``, a part for each of ``waves``; a job
    with an answer there is not called again, so a run that is broken off goes
    on after its last whole wave, and failed jobs are tried again by the next
    run. A wave runs in ``tasks`` tasks of ``concurrency`` calls at a time; each
    starts at most ``per_second`` / ``tasks`` calls a second, so that all of
    them together keep the limit on however many executors they run. A null key
    or request is a failure, and rows of one key are one job.
    """
    spark = jobs.sparkSession
    least = tasks / per_second if per_second else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started = [time.monotonic() - least]

        def ask(text: str | None) -> tuple[str | None, str | None]:
            try:
                return (call(text), None) if text is not None else (None, "no request")
            except Exception as e:  # noqa: BLE001  a failed call is a result of its job
                return None, str(e)

        def paced(texts: list[str | None], pool: ThreadPoolExecutor):
            for text in texts:
                wait = started[0] + least - time.monotonic()
                if wait > 0:
                    time.sleep(wait)
                started[0] = time.monotonic()
                yield pool.submit(ask, text)

        with ThreadPoolExecutor(concurrency) as pool:
            for b in batches:
                found = [f.result() for f in list(paced(b.column(1).to_pylist(), pool))]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[i] for x in found], pa.string()) for i in (0, 1))], ["key", "raw", "failure"])

    rows = jobs.groupBy(F.col(key).cast("string").alias("key")).agg(F.min(request).alias("request"))
    wave = F.pmod(F.xxhash64("key"), F.lit(waves))
    for n in range(waves):
        todo = rows.where(wave == n)
        at = f"{path.rstrip('/')}/wave={n}"
        done = spark.read.schema(ANSWER).parquet(at).where("raw is not null") if exists(spark, at) else None
        todo = todo.join(done.select("key"), "key", "left_anti") if done is not None else todo
        todo.repartition(tasks, "key").mapInArrow(run, ANSWER).write.mode("append").parquet(at)
    every = spark.read.schema(ANSWER).parquet(*(f"{path.rstrip('/')}/wave={n}" for n in range(waves)))
    # of a job that failed and was tried again, the answer stays
    return every.groupBy("key").agg(F.max("raw").alias("raw"), F.max("failure").alias("failure")).select("key", "raw", F.when(F.col("raw").isNull(), F.col("failure")).alias("failure"))


def offline_detector(request: str) -> str:
    """A detector without a service: its request is a JSON object of detector, condition, failed and steps; rules ask for one failure more."""
    r = json.loads(request)
    limit = {"any": 1, "half": -(-r["steps"] // 2)}[r["detector"]] + (r["condition"] == "rules")
    return json.dumps({"bug_found": r["failed"] >= limit, "bug_type": "steps" if r["failed"] >= limit else "none", "confidence": r["failed"] / r["steps"]})
