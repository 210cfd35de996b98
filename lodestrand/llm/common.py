"""Helpers that several training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: What all contracts call a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one where that is unset and all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local[") and spark.conf.get("spark.master", "local") != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_dir()
    return f"{base.rstrip('/')}/lodestrand-{uuid.uuid4().hex}"


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-lodestrand-")


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it again, which cuts its lineage."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that Spark hands to Python at once; whole texts are long, so fewer than its default of 10,000 bound a task's memory.
TEXT_ROWS = "1000"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While this lasts, Spark hands fewer rows to Python at once; for what is written inside, since plans are made then."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), int(TEXT_ROWS)) if int(before) > 0 else TEXT_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_batches(df: DataFrame) -> SparkSession:
    """The session of ``df``, with Arrow batches small enough for whole texts unless it asks for another size itself."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, TEXT_ROWS)
    return spark


#: Bytes of text that a task works on at once.
SLICE_BYTES = 4 << 20


def text_slices(column: pa.Array, between: str, most: int = SLICE_BYTES) -> Iterator[tuple[list[int], pa.Array]]:
    """(row of each text, texts) of at most about ``most`` bytes together; longer texts are cut after signs that match ``between``.

    Null: empty.  A text without such a sign stays whole.
    """
    texts = column.fill_null("").cast(pa.large_string())
    size = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else np.empty(0, np.int64)
    run = np.cumsum(size)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(run, (run[i - 1] if i else 0) + most, "right")))
        if size[i] > most:
            text, at, sign = texts[i].as_py(), 0, re.compile(between)
            while at < len(text):
                found = sign.search(text, at + most)
                yield [i], pa.array([text[at : (end := found.end() if found else len(text))]], pa.large_string())
                at = end
        else:
            yield [*range(i, j)], texts.slice(i, j - i)
        i = j


def id_remainder(doc_id: str | Column, divisor: int) -> Column:
    """crc32 of the decimal text of an id, modulo ``divisor`` (a null id counts as empty text)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % divisor
