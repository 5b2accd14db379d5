"""Incremental filing ingest as a file stream."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from filinglens.session import join_safe, materialise

BUCKETS = 64


def ingest(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: StructType, key: str = "rcept_no",
           fmt: str = "parquet", files_per_trigger: int = 1000, version: str | None = None) -> StreamingQuery:
    """Take in new source files once; each ``key`` is stored a single time.

    What was stored is read from the sink itself, so no state grows with the
    history.  A batch overwrites its own folder, named by the query (one per
    checkpoint) and the batch, which makes a retry harmless and keeps other
    sources and fresh checkpoints apart.  Keys are dealt over ``BUCKETS`` folders,
    so a batch looks only into those its keys fall in.  Of several rows with one
    key in a batch the largest by all columns stays, or by ``version`` first.
    """
    stream = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(source)

    order = [c for c in [version] if c] + [c for c in schema.names if c not in (key, version)]
    run = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:12]

    def store(batch: DataFrame, batch_id: int) -> None:
        own = f"{run}-{batch_id}"
        last = batch.groupBy(key).agg(F.max(F.struct(*order)).alias("_last"))
        fresh = last.select(key, *[F.col(f"_last.{c}").alias(c) for c in order]).select(*schema.names).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
        fresh = materialise(fresh)
        known = _stored(batch.sparkSession, sink, own, key, fresh)
        if known is not None:
            fresh = join_safe(fresh, known, [key], "left_anti")
        fresh.write.mode("overwrite").partitionBy("bucket").parquet(f"{sink}/batch={own}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _stored(spark: SparkSession, sink: str, own: str, key: str, fresh: DataFrame) -> DataFrame | None:
    """Stored keys of other batches, from the buckets that ``fresh`` touches; None before anything is stored."""
    root = spark._jvm.org.apache.hadoop.fs.Path(sink)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root) or not any(s.getPath().getName().startswith("batch=") for s in files.listStatus(root)):
        return None
    touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # BUCKETS of them at most
    schema = f"`{key}` {fresh.schema[key].dataType.simpleString()}, batch string, bucket int"
    return spark.read.schema(schema).option("basePath", sink).parquet(sink).filter((F.col("batch") != own) & F.col("bucket").isin(touched)).select(key)


def status_log(attempts: DataFrame, key: str = "rcept_no") -> DataFrame:
    """Latest status per key; one success outweighs any failure."""
    return attempts.groupBy(key).agg(
        F.max(F.struct((F.col("download_status") == "ok").cast("int").alias("ok"), "attempt", "download_status", "error")).alias("s")).select(
        key, F.col("s.download_status").alias("download_status"), F.col("s.error").alias("error"))
