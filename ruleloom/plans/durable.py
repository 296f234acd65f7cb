"""Cut lineage through the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which the files of a query's shuffles go when the query is over, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The tables stored inside each open :func:`scratch`.
_open: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local (tests, a
    notebook) a temporary folder takes its place.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="ruleloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    folder = f"file://{own}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete ``path`` if it exists; quiet when the session is gone."""
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the driver is ending
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return it as read.

    A lost executor then costs a read, not the work before it. The files go
    when the driver ends, or by :func:`release` when nothing reads them any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    with own_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if _open:
        _open[-1].append(out)
    return out


@contextmanager
def own_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files behind; a write has a plan of its own, so no other query reads them."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


@contextmanager
def scratch() -> Iterator[None]:
    """The tables stored inside go at the end: for a step whose result is stored elsewhere by then."""
    _open.append([])
    try:
        yield
    finally:
        for df in _open.pop():
            release(df)


def settled(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``build`` makes, stored; the tables that it stored on the way go."""
    with scratch():
        out = materialize(build(), name)
        _open[-1].remove(out)
    if _open:
        _open[-1].append(out)
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a materialised table that later ones have replaced, so that a long loop's disk does not grow."""
    if path := getattr(df, "stored_at", None):
        remove(df.sparkSession, path)
