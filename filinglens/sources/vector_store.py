"""A stored table of vectors, kept equal to a table of texts.

Rows are keyed by (key, model) and lie in folders by a hash of the key.  ``sync`` compares fingerprints of the texts
with those stored: only new and edited texts are encoded, keys that are gone from the texts go from the store, and
only folders with a change are written again, from a copy made beforehand.  Vectors of other models stay untouched.
A run that breaks off before the last step leaves the store as it was; Spark's committer then replaces the changed
folders one by one, and the next ``sync`` settles whatever is missing.

A null text counts as an empty one.  A null key is a key; of repeated keys the greatest fingerprint counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filinglens.functions import text as X
from filinglens.operators import retrieval
from filinglens.session import join_safe, materialise

BUCKETS = 64


@dataclass
class Changes:
    """What a ``sync`` found: rows encoded for the first time, encoded again, removed, left alone; folders written."""

    new: int
    edited: int
    removed: int
    unchanged: int
    folders: int


def schema_of(key: T.StructField) -> T.StructType:
    return T.StructType([T.StructField("key", key.dataType), T.StructField("model", T.StringType()), T.StructField("fingerprint", T.StringType()),
                         T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("bucket", T.IntegerType())])


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read(spark: SparkSession, path: str, key: T.StructField, model: str | None = None) -> DataFrame:
    """Stored rows (key, model, fingerprint, embedding, bucket), of one model or all."""
    schema = schema_of(key)
    rows = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    return rows if model is None else rows.filter(F.col("model") == model)


def sync(texts: DataFrame, key: str, column: str, path: str, model: str, load, buckets: int = BUCKETS) -> Changes:
    """Make the vectors of ``model`` in the store those of ``texts`` (key, text)."""
    spark, kind = texts.sparkSession, texts.schema[key]
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    text = F.coalesce(F.col(column), F.lit(""))
    now = texts.select(F.col(key).alias("key"), text.alias("text"), X.fingerprint(text).alias("fingerprint"))
    now = now.groupBy("key").agg(F.max(F.struct("fingerprint", "text")).alias("t")).select("key", "t.fingerprint", "t.text", bucket.alias("bucket"))
    stored = read(spark, path, kind, model).select("key", F.col("fingerprint").alias("old"), F.lit(1).alias("there"))
    left = now.select("key", "fingerprint", "bucket", F.lit(1).alias("here"))
    met = left.join(stored.withColumnRenamed("key", "_key"), F.col("key").eqNullSafe(F.col("_key")), "full").select(
        F.when(F.col("here").isNotNull(), F.col("key")).otherwise(F.col("_key")).alias("key"), "fingerprint", "old",
        F.when(F.col("here").isNull(), "removed").when(F.col("there").isNull(), "new").when(F.col("old") != F.col("fingerprint"), "edited").otherwise("unchanged").alias("change"))
    met = materialise(met.withColumn("bucket", bucket))
    counts = {r.change: r["count"] for r in met.groupBy("change").count().collect()}
    touched = materialise(met.filter("change <> 'unchanged'").select("bucket").distinct())
    folders = touched.count()
    if folders:
        wanted = join_safe(now, met.filter("change IN ('new', 'edited')").select("key"), ["key"], "left_semi")
        fresh = retrieval.embed(wanted, "text", load).select("key", F.lit(model).alias("model"), "fingerprint", "embedding", "bucket")
        before = read(spark, path, kind).join(F.broadcast(touched), "bucket", "left_semi")
        gone = met.filter("change IN ('removed', 'edited')").select("key", F.lit(model).alias("model"))
        kept = join_safe(before, gone, ["key", "model"], "left_anti").select("key", "model", "fingerprint", "embedding", "bucket")
        after = materialise(kept.unionByName(fresh))
        # A folder that holds nothing any more is written as an empty one would be: it must go by itself.
        (after.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))
        empty = [r.bucket for r in touched.join(after.select("bucket").distinct(), "bucket", "left_anti").collect()]
        for b in empty:
            place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}")
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return Changes(*[counts.get(c, 0) for c in ("new", "edited", "removed", "unchanged")], folders)
