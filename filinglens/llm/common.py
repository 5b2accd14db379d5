"""What the operators of this package share: whole texts, row keys, stored steps, batches of bounded size.

Every operator takes ``docs`` with the columns ``doc_id`` and ``text`` and ignores all others.  A null text
counts as an empty one.  Rows are told apart by ``row_key`` (128 bits of doc_id and text): rows that repeat
both are one document with several rows, and each of its rows gets the same result.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filinglens.session import bounded_batches, scratch_path, shared_dir  # noqa: F401

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_key() -> list[Column]:
    """Two independent 64-bit hashes of (doc_id, text), as columns k1 and k2."""
    parts = (F.coalesce(F.col("doc_id").cast("string"), F.lit("\x00")), whole_text())
    return [F.xxhash64(F.lit(seed), *parts).alias(f"k{seed}") for seed in (1, 2)]


def fold(modulus: int, name: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % modulus


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage and gives Spark the true size."""
    spark = df.sparkSession
    shared_dir(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def kept_in_process(name: str, make: Callable):
    """What a Python worker makes once and keeps for its later tasks (task functions travel by value)."""
    store = sys.modules.setdefault("filinglens_kept_in_process", types.ModuleType("filinglens_kept_in_process"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each begins (one more entry than texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def blocks(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``size`` bytes: first and last+1 row, bytes, offsets."""
    data, offsets = buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
