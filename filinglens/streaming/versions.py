"""Versioned filings as a stream: the newest version of each filing is known from state, not from what is stored.

Each key keeps the row it was last taken in with, as a streaming aggregate; the work is all in Spark's own operators, no
Python is called for a key.  A batch's rows meet that state, so the cost of a batch depends on its own rows and not on
the history in the sink; with the RocksDB provider (``ROCKSDB``, set by the caller before the stream starts) state may
outgrow memory.  A row goes on if its version is above the one in state: late newer versions replace older ones, late
older ones and repeated rows go.  Which batch a row came in with is told by the batch's time, which Spark keeps in the
checkpoint, so a batch that is run again is the same; a clock that is set back between batches lets an equal version
through once more.  A batch overwrites its own folder, so a restart neither loses nor repeats rows.

Nulls: a null key is a key; a null version is below every other.  Of rows of one key in one batch the greatest version
stays, among equal ones the greatest by all columns as text, nulls lowest.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from filinglens.operators.ordering import latest_per_group

ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def newer_versions(stream: DataFrame, key: str, version: str) -> DataFrame:
    """Rows that are newer than what was seen of their key, with ``change``: new or newer; for output mode ``update``."""
    now = F.unix_micros(F.current_timestamp())
    known = F.col(version).isNotNull()
    if isinstance(stream.schema[version].dataType, T.FractionalType) and not isinstance(stream.schema[version].dataType, T.DecimalType):
        known = known & ~F.isnan(version)
    texts = [F.col(c).cast("string").alias(f"t{i}") for i, c in enumerate(stream.columns) if c not in (key, version)]
    order = F.struct(known.alias("known"), F.when(known, F.col(version)).alias("v"), (-now).alias("early"), *texts)
    rows = stream.select(F.col(key).alias("_key"), F.struct(*stream.columns).alias("_row"), order.alias("_order"))
    held = rows.groupBy("_key").agg(F.max_by("_row", "_order").alias("_row"), F.max("_order.early").alias("_first"), F.max(F.struct("_order.known", "_order.v", "_order.early")).alias("_top"))
    return held.filter(F.col("_top.early") == -now).select("_row.*", F.when(F.col("_first") == -now, "new").otherwise("newer").alias("change"))


def ingest_versions(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: T.StructType, key: str = "rcept_no", version: str = "version",
                    fmt: str = "parquet", files_per_trigger: int = 1000) -> StreamingQuery:
    """Take in new source files once and store every row that is newer than what its key had."""
    stream = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(source)
    run = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:12]

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/_batch={run}-{batch_id}")

    return (newer_versions(stream, key, version).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
            .outputMode("update").trigger(availableNow=True).start())


def current(spark: SparkSession, sink: str, key: str = "rcept_no", version: str = "version") -> DataFrame:
    """The newest stored version of every key."""
    stored = spark.read.parquet(sink).drop("_batch")
    ranked = stored.withColumn("_known", F.col(version).isNotNull())
    return latest_per_group(ranked, [key], ["_known", version], stored.columns).select(*stored.columns)
