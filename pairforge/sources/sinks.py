"""Sinks: tables by suffix, results written once, keyed answers, best parameters."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    """Writes by suffix: .csv with a header, .json, otherwise Parquet."""
    writer = df.write.mode(mode)
    if path.endswith(".csv"):
        writer.option("header", True).csv(path)
    elif path.endswith(".json"):
        writer.json(path)
    else:
        writer.parquet(path)


def append_row(spark: SparkSession, path: str, row: dict) -> None:
    """Adds one result row to a table; the columns of the first row stay those of all."""
    write_table(spark.createDataFrame([row]), path, "append")


def prepared_corpus(df: DataFrame, field: str, expression, path: str | None = None) -> DataFrame:
    """Replaces a text column by ``preprocessed_<field>``, and writes the table if a path is given."""
    out = df.withColumn(f"preprocessed_{field}", expression).drop(field)
    if path:
        write_table(out, path, "overwrite")
    return out


def write_once(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at a path; ``make()`` gives its rows if it is not there yet."""
    from pairforge.operators.training import exists

    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def save_json(spark: SparkSession, path: str, values: dict) -> None:
    """A small JSON file, in any file system that the session knows."""
    fs, where = _place(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(json.dumps(values, ensure_ascii=False, indent=2).encode("utf-8")))
    finally:
        out.close()


def save_params(path: str, params: dict) -> None:
    """The same for a file of this machine."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(params, ensure_ascii=False, indent=2), encoding="utf-8")


def save_tfidf(model: DataFrame, params, path: str) -> None:
    """Writes a fitted TF-IDF model: its terms as a table and its parameters beside them."""
    model.write.mode("overwrite").parquet(f"{path}/terms")
    save_json(model.sparkSession, f"{path}/params.json", asdict(params))


def load_tfidf(spark: SparkSession, path: str):
    """``(model, parameters)`` of a written TF-IDF model."""
    from pairforge.operators.tfidf import TfIdfParams

    values = json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/params.json", wholetext=True).collect()))
    return spark.read.parquet(f"{path}/terms"), TfIdfParams(**values | {"stopwords": tuple(values["stopwords"])})


class KeyedStore:
    """A table of computed results by key (in place of a cache server): lookups are joins, additions are appends.

    Falsy results are results: a stored 0 is not computed again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def table(self) -> DataFrame:
        from pairforge.operators.training import exists

        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def misses(self, keys: DataFrame, key: str) -> DataFrame:
        return keys.join(self.table().select(key), key, "left_anti")

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def clear(self) -> None:
        fs, where = _place(self.spark, self.path)
        fs.delete(where, True)

    def get(self, key: str, value):
        """One stored row or None; for interactive use."""
        return self.table().where(F.col(key) == value).first()

    def contains(self, key: str, value) -> bool:
        return self.get(key, value) is not None

    def remove(self, key: str, values: DataFrame) -> None:
        """Takes out the rows whose key is among ``values``. The table is written anew beside the old one and then takes its place."""
        fs, where = _place(self.spark, self.path)
        new = f"{self.path}.new"
        self.table().join(values.select(key), key, "left_anti").write.mode("overwrite").parquet(new)
        fs.delete(where, True)
        fs.rename(_place(self.spark, new)[1], where)

    def __len__(self) -> int:
        return self.table().count()

    def keys(self, key: str) -> Iterator:
        """The stored keys one by one, a partition at a time."""
        return (r[key] for r in self.table().select(key).toLocalIterator())


class NoStore(KeyedStore):
    """A store that keeps nothing."""

    def __init__(self, spark: SparkSession, schema: str):
        super().__init__(spark, "", schema)

    def table(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def add(self, rows: DataFrame) -> None:
        return None

    def remove(self, key: str, values: DataFrame) -> None:
        return None

    def clear(self) -> None:
        return None


def open_store(spark: SparkSession, kind: str | None, schema: str, path: str | None = None) -> KeyedStore:
    """A store by kind: 'dummy' keeps nothing, 'shared' (also none named) keeps a table at ``path``, 'memory' one in
    the session's intermediate folder, which ends with the process. An unknown kind raises ValueError."""
    if kind == "dummy":
        return NoStore(spark, schema)
    if kind == "memory":
        import uuid

        from pairforge.storage import forget_at_exit, shared_dir

        return KeyedStore(spark, forget_at_exit(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"), schema)
    if kind in (None, "shared"):
        if not path:
            raise ValueError("a shared store needs a path")
        return KeyedStore(spark, path, schema)
    raise ValueError(f"unknown kind of store: {kind}")
