"""What the operators of this package share: one text per id, words, stable hashes, Arrow maps."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

WORD = regex.compile(r"[\p{L}\p{N}]+")
#: Entries of a per-task memo; when full it starts anew, so that memory stays bounded and results do not change.
MEMO_ENTRIES = 200_000


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits after NFC and lower-casing."""
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return WORD.findall(text.lower())


def hash64(value: str) -> int:
    """A stable signed 64-bit hash."""
    h = xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def text_sides(pairs: DataFrame, side_1=("id_1", "text_1"), side_2=("id_2", "text_2")) -> DataFrame:
    """One row per id of each side: ``side``, ``text_id``, ``text``.

    Rows without an id are left out (they have no unit to report on). An id always names the same
    text, so any copy will do; the largest is taken, which makes a null yield to a text. The
    map-side aggregation keeps a hot id from reaching one task with all its copies.
    """
    parts = []
    for side, (key, text) in enumerate((side_1, side_2), 1):
        part = pairs.select(F.col(key).cast("long").alias("text_id"), F.col(text).alias("text")).where(F.col("text_id").isNotNull())
        parts.append(part.groupBy("text_id").agg(F.max("text").alias("text")).select(F.lit(side).cast("int").alias("side"), "text_id", "text"))
    return parts[0].unionByName(parts[1])


def arrow_map(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], Iterator[dict[str, object]] | None]], schema: str) -> DataFrame:
    """``mapInArrow`` over batches as column lists.

    ``make`` runs once per task and gives a function from columns to an iterator of column dicts;
    if that function has an attribute ``close``, it is called at the end of the task for more.
    """
    fields: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(fields)

    def pack(columns: dict[str, object]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, type=f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                for out in step(dict(zip(batch.schema.names, (c.to_pylist() for c in batch.columns)))):
                    yield pack(out)
        for out in getattr(step, "close", lambda: ())():
            yield pack(out)

    return df.mapInArrow(run, fields)
