"""Readers of the pair tables and of the small files around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names of the known data sets that have tables of their own.
TABLES = ("rpd_dataset", "studentor_partner", "dataset_v6_r30")
SCHEMAS = {
    "rpd_dataset": "text_rp string, text_proj string, id_rp string, id_proj string, name_rp string, name_proj string, need_match boolean",
    "studentor_partner": "text_1 string, text_2 string, title_1 string, title_2 string, need_match string",
    "dataset_v6_r30": "vacancy string, resume string, result string",
}
SCHEMAS["all_examples"] = SCHEMAS["rpd_dataset"]


def to_pairs(df: DataFrame, name: str, key: str = "row_id") -> DataFrame:
    """Columns of a named source as pairs: ``pair_id``, texts, titles, ``need_match``.

    Labels are true for true, 'TRUE' or '1' by source and false for anything else, null too. A row
    number in ``key`` gives the titles of sources without any.
    """
    id_ = F.col(key).cast("long").alias("pair_id")
    if name in ("rpd_dataset", "all_examples"):
        return df.select(
            id_, F.col("text_rp").alias("text_1"), F.col("text_proj").alias("text_2"), F.concat_ws(": ", "id_rp", "name_rp").alias("title_1"), F.concat_ws(": ", "id_proj", "name_proj").alias("title_2"), F.coalesce("need_match", F.lit(False)).alias("need_match")
        )
    if name == "studentor_partner":
        return df.select(id_, "text_1", "text_2", "title_1", "title_2", F.coalesce(F.col("need_match") == "TRUE", F.lit(False)).alias("need_match"))
    if name == "dataset_v6_r30":
        titled = lambda side: F.concat(F.lit(side), F.col(key).cast("string"))
        return df.select(id_, F.col("vacancy").alias("text_1"), F.col("resume").alias("text_2"), titled("vacancy_").alias("title_1"), titled("resume_").alias("title_2"), F.coalesce(F.col("result") == "1", F.lit(False)).alias("need_match"))
    raise ValueError(f"Unknown dataset: {name}")


def load_dataset(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Pairs of a named data set from its JSON array or CSV file; rows are numbered from 0 in file order."""
    if name not in SCHEMAS:
        raise ValueError(f"Unknown dataset: {name}")
    if path.endswith(".json"):
        df = spark.read.schema(SCHEMAS[name]).json(path, multiLine=True)
    elif path.endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        df = spark.read.schema(SCHEMAS[name]).csv(path, header=True, multiLine=True, escape='"')
    return to_pairs(df if "row_id" in df.columns else number_rows(df, "row_id"), name)


def number_rows(df: DataFrame, name: str) -> DataFrame:
    """Numbers the rows of a table that is read from files from 0, in the order of the paths of the files, of the blocks in a
    file and of the rows in a block, whatever files the reader packs into one partition. Nothing is gathered: only the
    sizes of the blocks are summed up. The table must be read alike each time, as files are."""
    marked = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_mono"))
    # the rows of a block follow one another in their partition
    sizes = marked.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_mono").alias("_first"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block of the input
    starts = sizes.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return marked.join(starts, ["_file", "_block"]).withColumn(name, F.col("_start") + F.col("_mono") - F.col("_first")).drop("_file", "_block", "_mono", "_first", "_start")


def read_benchmark(spark: SparkSession, path: str, text_1: str, text_2: str, label: str = "need_match") -> DataFrame:
    """Pairs of any JSON, CSV or Parquet file by the names of two text columns."""
    df = read_any(spark, path)
    return df.select(F.monotonically_increasing_id().alias("pair_id"), F.col(text_1).alias("text_1"), F.col(text_2).alias("text_2"), F.coalesce(F.col(label).cast("boolean"), F.lit(False)).alias("need_match"))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A table by its suffix; an unknown suffix raises ValueError."""
    if ".json" in path:
        return spark.read.json(path, multiLine=True)
    if ".csv" in path:
        return spark.read.csv(path, header=True, multiLine=True, escape='"')
    if ".parquet" in path:
        return spark.read.parquet(path)
    raise ValueError(f"Unknown format: {path}")


def read_corpus(spark: SparkSession, path: str, field: str = "preprocessed_text") -> DataFrame:
    """The token arrays of a training corpus as ``tokens``."""
    return read_any(spark, path).select(F.col(field).alias("tokens"))


def read_scenario(spark: SparkSession, path: str) -> DataFrame:
    """A cascade scenario, all cells as text ('x' means the best value so far), rows numbered by ``step``."""
    return spark.read.csv(path, header=True).withColumn("step", F.monotonically_increasing_id())


def read_model_names(spark: SparkSession, path: str, skip: int = 1) -> DataFrame:
    """Lines of a model list: ``grp`` grows at each blank line, ``parts`` are the pieces between hyphens.
    The list is a hand-written file of one partition."""
    lines = spark.read.text(path).coalesce(1).withColumn("n", F.monotonically_increasing_id())
    return model_names(lines.where(F.col("n") >= skip))


def model_names(lines: DataFrame) -> DataFrame:
    """``n``, ``value`` lines to ``n``, ``grp``, ``name``, ``parts`` without the blank ones."""
    blank = F.trim(F.coalesce("value", F.lit(""))) == ""
    grouped = lines.withColumn("grp", F.sum(blank.cast("int")).over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.where(~blank).select("n", F.col("grp").cast("int").alias("grp"), F.trim("value").alias("name"), F.split(F.trim("value"), "-").alias("parts"))


def read_one(name: str) -> tuple:
    """The parameters of a model's name: its pieces after the first, all but the first of these as integers."""
    pieces = name.split("-")[1:]
    return tuple(pieces[:1] + [int(p) for p in pieces[1:]])


def typed_parts(parts: list[str]) -> list[int | str]:
    """Pieces of a model's name with those of digits as integers."""
    return [int(p) if p.isdigit() else p for p in parts]


def read_timings(spark: SparkSession, path: str) -> DataFrame:
    """Timing rows of one or many CSV files."""
    return spark.read.schema("time double, process_time double, text_1_len int, text_2_len int").csv(path, header=True)
