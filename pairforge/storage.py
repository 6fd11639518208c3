"""Intermediate tables that survive the loss of an executor.

``DataFrame.checkpoint`` computes its input twice (once to count, once to write), so a lineage is
cut here with a Parquet table in the shared folder that the session names in
``spark.checkpoint.dir``. Only where that setting is missing (tests, a notebook) a temporary
folder of this machine takes its place.
"""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The engine's setting by which shuffle files go with the query that made them.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; sets one of this machine only for a local session without any."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="pairforge-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Writes ``df`` once and returns a reader of what was written.

    The rows and the schema stay as they are; an empty input gives an empty table. What was shuffled for it is
    deleted as soon as it is written, not when the driver happens to collect its garbage.
    """
    return _write(df, label)[0]


def _write(df: DataFrame, label: str) -> tuple[DataFrame, tuple[SparkSession, str]]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with _cleaning(spark):
        df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path), (spark, path)


_turn, _writers = threading.Lock(), []


@contextmanager
def _cleaning(spark: SparkSession):
    """The setting :data:`SHUFFLE_CLEANUP` for as long as any thread writes; the last one gives back what the first one found."""
    with _turn:
        _writers.append(spark.conf.get(SHUFFLE_CLEANUP, None) if not _writers else _writers[0])
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        with _turn:
            before = _writers.pop()
            if not _writers:
                spark.conf.set(SHUFFLE_CLEANUP, before) if before is not None else spark.conf.unset(SHUFFLE_CLEANUP)


@contextmanager
def passing(df: DataFrame, label: str = "step"):
    """What :func:`materialize` gives, deleted at the end of the block."""
    table, entry = _write(df, label)
    try:
        yield table
    finally:
        _written.remove(entry)
        _delete(*entry)


def forget_at_exit(spark: SparkSession, path: str) -> str:
    """Has a path deleted with the written tables."""
    _written.append((spark, path))
    return path


@contextmanager
def intermediates():
    """Deletes at its end the tables that were written inside; what is computed from them must be done by then."""
    before = len(_written)
    try:
        yield
    finally:
        drop_materialized(before)


def drop_materialized(keep: int = 0) -> None:
    """Deletes every table that :func:`materialize` wrote in this process but the first ``keep``."""
    while len(_written) > keep:
        _delete(*_written.pop())


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        pass


atexit.register(drop_materialized)
