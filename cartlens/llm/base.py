"""Shared pieces of the corpus operators: columns, sizes, batches of text."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartlens.session import tune

# Words are runs of bytes other than space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

# Texts may be long, so few rows travel to Python at once.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings of the library, and small batches for rows that hold whole texts."""
    tune(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def whole(text: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def word_count(text: str = "text") -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def remainder(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the text ''."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(parts))


def scaled_partitions(spark: SparkSession, units: float, per_task: float) -> int:
    """Tasks for ``units`` of work; at least the session's number of shuffle partitions."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(units / per_task))


def texts(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows one after another, and the rows' offsets; null is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that hold rows."""
    return (batch for batch in found if batch.num_rows)


def slices(rows: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about so many characters, at least one row each."""
    first = held = 0
    for i, text in enumerate(rows):
        held += len(text)
        if held >= chars:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(rows):
        yield first, len(rows)
