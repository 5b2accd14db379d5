"""Session facts the operators rely on: shared storage and size checks."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMENSION_BLOCK = 10_000
BATCH_BYTES = 16 << 20
BATCH_ROWS = 2_000


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that long texts don't add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read, as named by ``spark.checkpoint.dir``.

    Where the setting is absent, a checkpoint folder already set on the context
    serves; only in local mode is one made up.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not configured and context.getCheckpointDir() is None and not context.master.partition("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return configured or context.getCheckpointDir()


_written: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Remove what this application wrote through :func:`scratch_path`; results that were not stored elsewhere go with it."""
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and cut the lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def attach(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a side table to large, possibly skewed rows.

    The side is written once, so Spark knows its size in bytes: it is broadcast if
    that is below ``spark.sql.autoBroadcastJoinThreshold``; otherwise it is an
    ordinary join, where adaptive execution splits hot partitions.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "side")
    side.write.parquet(path)
    return rows.join(spark.read.schema(side.schema).parquet(path), keys, how)


SHARE = 200_000


def bytes_of(spark: SparkSession, path: str) -> int:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def broadcast_bytes(spark: SparkSession) -> int:
    """``spark.sql.autoBroadcastJoinThreshold`` in bytes; below zero is off."""
    raw = spark.conf.get("spark.sql.autoBroadcastJoinThreshold").lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(raw[-1:], 0)
    return int(raw[:-1] if unit else raw) << unit if not raw.startswith("-") else -1


def join_to_few(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "inner", share: int = SHARE) -> DataFrame:
    """Join rows of which a few keys may hold most to a side that has few rows for each key.

    The side is written once.  Up to the broadcast threshold it goes to the rows, which so stay where they are.
    Beyond it, keys with more than ``share`` rows are salted: their rows are dealt over as many parts as they need and
    the side's rows copied to these parts, so no task holds more of one key.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "side")
    side.write.parquet(path)
    side = spark.read.schema(side.schema).parquet(path)
    if bytes_of(spark, path) <= broadcast_bytes(spark):
        return rows.join(F.broadcast(side), keys, how)
    rows = materialise(rows)
    hot = materialise(rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > share).select(*keys, F.ceil(F.col("_n") / share).cast("int").alias("_parts")))
    if hot.isEmpty():
        return rows.join(side, keys, how)
    parts = F.coalesce("_parts", F.lit(1))
    salted = rows.withColumn("_at", F.monotonically_increasing_id()).join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64("_at"), parts).cast("int")).drop("_parts", "_at")
    copies = side.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def join_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key meets a null key; the keys of ``left`` remain."""
    side = right.select(*[F.col(c).alias(f"_on_{c}" if c in keys else c) for c in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys])
    return left.join(side, on, how).drop(*[f"_on_{k}" for k in keys])


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns that later filters use.

    A filter on a plain column is pushed below it with the whole expression inside,
    so the work is done twice; values that come out of a generator stay put.
    """
    packed = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once")
    return df.select("*", packed).select(*[c for c in df.columns if c not in columns], *[F.col(f"_once.{n}").alias(n) for n in columns])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give heavy row work as many tasks as there are cores.

    Small inputs often sit in one row group and so in one task; they are spread by
    ``keys``.  An input that already splits into enough partitions is left alone,
    so large tables are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def expand_over(df: DataFrame, dimension: DataFrame, block: int = DIMENSION_BLOCK) -> DataFrame:
    """Every row of ``df`` with every row of a configuration table.

    A table of at most ``block`` rows becomes a constant array inside the plan; a
    larger one is cut into blocks by hash, and each row meets every block by its
    number.
    """
    rows = dimension.limit(block + 1).toJSON().collect()
    if len(rows) > block:
        blocks = -(-dimension.count() // block)
        dealt = dimension.withColumn("_block", F.pmod(F.xxhash64(*dimension.columns), F.lit(blocks)))
        asked = df.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        return asked.join(dealt, "_block").drop("_block")
    constant = F.from_json(F.lit("[" + ",".join(rows) + "]"), f"array<{dimension.schema.simpleString()}>")
    return df.select("*", F.explode(constant).alias("_d")).select(*df.columns, "_d.*")
