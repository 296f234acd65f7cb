"""Sources and sinks: JSON, JSON Lines, Markdown, CSV, manifests, issues, archives, append logs."""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ruleloom.functions.text import issue_markdown, issue_parts
from ruleloom.plans.durable import exists, materialize


#: Splits of text files whose first lines' numbers are sent to every executor at most.
SEND_SPLITS = 100_000


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, value): the lines of text files, numbered from 1 in each file, blank ones too.

    A large file is read in splits side by side; one scan before counts the
    lines of every split, and a line's number is what the splits before its own
    hold and its place in its own.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"), "value")
    splits = lines.groupBy("file", "at").agg(F.min("n").alias("first"), F.count("*").alias("lines"))  # a split's rows follow each other in one task
    before = F.coalesce(F.sum("lines").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = materialize(splits.select("file", "at", "first", before.alias("before")), "splits")
    splits = F.broadcast(splits) if splits.count() <= SEND_SPLITS else splits
    return lines.join(splits, ["file", "at"]).select("file", (F.col("before") + F.col("n") - F.col("first") + 1).alias("line"), "value")


def json_lines(spark: SparkSession, path: str | list[str], schema: str | StructType, strict: bool = True) -> DataFrame:
    """Objects, one a line; blank lines are skipped, a byte order mark is accepted, and any other line fails the read, naming file and line.

    With ``strict`` off, rows carry ``_file``, ``_line`` and ``_corrupt_record`` instead of failing.
    """
    whole = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    lines = numbered_lines(spark, path).withColumn("value", F.regexp_replace("value", "^\ufeff", "")).where(F.trim("value") != "")
    marked = StructType(list(whole.fields)).add("_corrupt_record", "string")
    read = lines.select(F.from_json("value", marked, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"), F.col("file").alias("_file"), F.col("line").alias("_line"))
    if not strict:
        return read.select("r.*", "_file", "_line")
    bad = F.raise_error(F.concat(F.col("_file"), F.lit(":"), F.col("_line"), F.lit(": not a JSON object of the schema")))
    sound = F.when(F.col("r._corrupt_record").isNull(), F.struct(*(F.col(f"r.`{f.name}`").alias(f.name) for f in whole.fields))).otherwise(bad.cast(whole))
    return read.select(sound.alias("r")).select("r.*")


def json_array(spark: SparkSession, path: str | list[str], schema: str | StructType) -> DataFrame:
    """Files that each hold one array of objects."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def text_files(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """(path, stem, text) of a folder's files at any depth."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).format("binaryFile").load(path)
    return rows.select("path", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stem"), F.decode("content", "UTF-8").alias("text"))


def csv_cases(spark: SparkSession, path: str | list[str], id_col: str = "ID") -> DataFrame:
    """CSV rows with a header; ids like 1.0 become 1."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.withColumn(id_col, F.col(id_col).try_cast("double").cast("long"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files, for comparison with a list of checksums."""
    return spark.read.option("recursiveFileLookup", True).format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def unzipped(archives: DataFrame, path: str = "path", content: str = "content", expected: DataFrame | None = None) -> DataFrame:
    """(path, member, size, data) of the files in ZIP archives, given as rows of bytes (as ``binaryFile`` reads them).

    A member with an absolute name, a drive, or a part ".." fails the read; so
    does an archive whose SHA-256 is not the one of ``expected`` (path, sha256),
    or is not in it.
    """
    rows = archives.select(F.col(path).alias("path"), F.col(content).alias("content"))
    if expected is not None:
        told = expected.select(F.col("path"), F.lower("sha256").alias("_sha"))
        right = F.sha2("content", 256) == F.col("_sha")
        fault = F.raise_error(F.concat(F.lit("wrong checksum: "), F.col("path")))
        rows = rows.join(told, "path", "left").withColumn("content", F.when(F.coalesce(right, F.lit(False)), F.col("content")).otherwise(fault.cast("binary"))).drop("_sha")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for m in z.infolist():
                        parts = m.filename.replace("\\", "/").split("/")
                        if parts[0] == "" or ":" in parts[0] or ".." in parts:
                            raise ValueError(f"unsafe member {m.filename} in {name}")
                        if not m.is_dir():
                            cols = [pa.array([name]), pa.array([m.filename]), pa.array([m.file_size], pa.int64()), pa.array([z.read(m)], pa.binary())]
                            yield pa.RecordBatch.from_arrays(cols, ["path", "member", "size", "data"])

    return rows.mapInArrow(read, "path string, member string, size long, data binary")


def datasets(spark: SparkSession, root: str, name: str = "test_case.csv", id_col: str = "ID") -> DataFrame:
    """The cases of every data set below ``root``, with ``dataset`` (its folder) and ``position`` in numeric order of ids."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).option("header", True).option("multiLine", True).option("escape", '"').csv(root)
    rows = rows.withColumn(id_col, F.col(id_col).try_cast("double").cast("long")).withColumn("dataset", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("dataset").orderBy(id_col)))


def units(sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """One table of all sources with source_name; ids must be unique across them (see constraints.unique)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("source_name", F.lit(name)) for name, df in sources])


def manifest(rows: DataFrame) -> DataFrame:
    """id, source, url as trimmed strings."""
    return rows.select(*(F.trim(F.col(c).cast("string")).alias(c) for c in ("id", "source", "url")))


FETCHED = "cache_key string, url string, body string, error string"


def fetched(rows: DataFrame, path: str, fetch: Callable[[str], str], overwrite: bool = False, dry_run: bool = False, tasks: int = 8) -> DataFrame:
    """The manifest with (cache_key, status, body, error), from a store of bodies by the SHA-256 of their urls.

    Each url is fetched once, whatever ids share it, and only if the store below
    ``path`` has no body of it; ``overwrite`` fetches all again, and the newest
    body counts. A ``dry_run`` calls nothing: it says cached or missing. A run's
    bodies are written aside and moved into the store as a whole, so that a run
    that breaks off leaves the store as it was. A url that fails is a row with
    its error and is not stored; a null url is failed, and is not called.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("cache_key", F.sha2("url", 256))
    batches = f"{path.rstrip('/')}/batches"
    there = spark.read.option("basePath", batches).schema(f"{FETCHED}, batch long").parquet(batches) if exists(spark, batches) else spark.createDataFrame([], f"{FETCHED}, batch long")
    known = there.groupBy("cache_key").agg(F.max_by("body", "batch").alias("body"))
    if dry_run:
        found = keyed.join(known.select("cache_key", F.lit(True).alias("there")), "cache_key", "left")
        return found.select(*keyed.columns, F.when(F.col("there"), "cached").otherwise("missing").alias("status"), F.lit(None).cast("string").alias("body"), F.lit(None).cast("string").alias("error"))
    todo = keyed.where("url is not null").select("cache_key", "url").distinct()
    todo = todo if overwrite else todo.join(known.select("cache_key"), "cache_key", "left_anti")

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in given:
            out: list[tuple] = []
            for url in b.column(1).to_pylist():
                try:
                    out.append((fetch(url), None))
                except Exception as e:  # noqa: BLE001  a url that fails is a row
                    out.append((None, str(e)))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([o[i] for o in out], pa.string()) for i in (0, 1))], ["cache_key", "url", "body", "error"])

    got = materialize(todo.repartition(tasks, "cache_key").mapInArrow(run, FETCHED), "fetched")
    good = got.where("error is null and body is not null")
    if not good.isEmpty():
        number = (there.agg(F.max("batch")).first()[0] or 0) + 1
        aside = f"{path.rstrip('/')}/aside-{uuid.uuid4().hex}"
        good.write.parquet(aside)
        jvm = spark.sparkContext._jvm
        new, at = jvm.org.apache.hadoop.fs.Path(aside), jvm.org.apache.hadoop.fs.Path(f"{batches}/batch={number}")
        store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(at.getParent())
        if store.exists(at) or not store.rename(new, at):
            raise OSError(f"cannot move {aside} to {at}")
    every = got.select("cache_key", F.when(F.col("error").isNull(), "fetched").otherwise("failed").alias("status"), "body", "error")
    old = known.join(got.select("cache_key"), "cache_key", "left_anti").select("cache_key", F.lit("cached").alias("status"), "body", F.lit(None).cast("string").alias("error"))
    out = keyed.join(every.unionByName(old), "cache_key", "left")
    return out.select(*keyed.columns, F.coalesce("status", F.lit("failed")).alias("status"), "body", F.when(F.col("url").isNull(), "no url").otherwise(F.col("error")).alias("error"))


def rendered_issues(issues: DataFrame) -> DataFrame:
    """(url, owner, repo, number, markdown) of issues (url, title, body)."""
    return issues.select("url", issue_parts(F.col("url")).alias("p"), issue_markdown(F.col("title"), F.col("url"), F.col("body")).alias("markdown")).select("url", "p.*", "markdown")


class _Issue(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _IssueReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = json.loads(options.get("urls", "[]"))
        self.per = int(options.get("per_partition", "50"))
        self.token, self.timeout = options.get("token"), float(options.get("timeout", "60"))
        self.tries, self.pause = int(options.get("tries", "3")), float(options.get("pause", "1"))

    def partitions(self) -> list[_Issue]:
        return [_Issue(self.urls[n : n + self.per]) for n in range(0, len(self.urls), self.per)]

    def read(self, partition: _Issue) -> Iterator[tuple]:
        import urllib.request

        from ruleloom.functions.providers import with_retries

        headers = {"Accept": "application/vnd.github+json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        for url in partition.urls:

            def get(url=url) -> dict:
                with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=self.timeout) as answer:
                    return json.load(answer)

            try:
                issue = with_retries(get, self.tries, self.pause)
                yield issue.get("html_url") or url, issue.get("title") or "", issue.get("body"), None
            except Exception as e:  # noqa: BLE001  a url that fails is a row, not the end of the scan
                yield url, None, None, str(e)


class IssueSource(DataSource):
    """``spark.dataSource.register(IssueSource)``, then ``format("rest_issues").option("urls", json)``: one row an issue.

    Options: token, timeout, per_partition, tries and pause of the retries. A
    url that cannot be read gives a row with its error.
    """

    @classmethod
    def name(cls) -> str:
        return "rest_issues"

    def schema(self) -> str:
        return "url string, title string, body string, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _IssueReader(self.options)


def case_steps(cases: DataFrame, case: str = "case_id", pages: str = "pages", actions: str = "actions") -> DataFrame:
    """(case, step_id, before_page, action, after_page) from n + 1 page lines and n action lines.

    A line's "Step 3:" prefix goes, double quotes become single ones.
    """
    clean = lambda x: F.translate(F.trim(F.regexp_replace(x, r"(?i)^\s*step\s*\d+\s*:\s*", "")), '"', "'")
    split = lambda c: F.filter(F.split(c, "\n"), lambda x: F.trim(x) != "")
    page = cases.select(case, F.posexplode(F.transform(split(pages), clean)).alias("pos", "before_page"))
    page = page.withColumn("after_page", F.lead("before_page").over(Window.partitionBy(case).orderBy("pos")))
    act = cases.select(case, F.posexplode(F.transform(split(actions), clean)).alias("pos", "action"))
    return page.join(act, [case, "pos"]).select(case, (F.col("pos") + 1).alias("step_id"), "before_page", "action", "after_page")


def write_json(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """JSON Lines; the commit is atomic, and an existing folder is an error unless ``overwrite``."""
    rows.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def copy(spark: SparkSession, source: str, target: str) -> None:
    """A table under a new path, visible as a whole: it is written aside, and takes the place of ``target`` when it is complete."""
    aside = f"{target.rstrip('/')}-{uuid.uuid4().hex}"
    spark.read.parquet(source).write.parquet(aside)
    jvm = spark.sparkContext._jvm
    new, old = jvm.org.apache.hadoop.fs.Path(aside), jvm.org.apache.hadoop.fs.Path(target)
    store = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = jvm.org.apache.hadoop.fs.Path(f"{aside}-old")
    there = store.exists(old)
    if there and not store.rename(old, gone):  # the old table stays until the new one has taken its place
        raise OSError(f"cannot move {target} aside")
    if not store.rename(new, old):
        if there:
            store.rename(gone, old)
        raise OSError(f"cannot move {aside} to {target}")
    store.delete(gone, True)


def event_ids(rows: DataFrame, order: Sequence[Column], offset: int = 0, prefix: str = "E") -> DataFrame:
    """``rows`` with event_id E00000001, E00000002, ... after ``offset`` earlier ones."""
    from ruleloom.operators.graph import numbered

    out = numbered(rows, list(order), "_seq", offset + 1)
    return out.withColumn("event_id", F.format_string(f"{prefix}%08d", "_seq")).drop("_seq")


def markdown_cell(c: Column) -> Column:
    return F.replace(F.regexp_replace(F.trim(c.cast("string")), r"\s+", " "), F.lit("|"), F.lit("\\|"))


def markdown_table(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(value): a table row for each row of ``rows``; write it as text below ``markdown_head``."""
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(markdown_cell(F.col(c)), F.lit("")) for c in columns)), F.lit(" |")).alias("value"))


def markdown_head(columns: Sequence[str]) -> str:
    return f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}"


def images_equal(before: str, after: str) -> Column:
    """Equal image files; for equal pixels in different files see ``functions.images.pixel_hashes``."""
    return F.sha2(before, 256) == F.sha2(after, 256)
