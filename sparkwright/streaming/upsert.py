"""Structured Streaming form of keep-the-deepest-row: each micro-batch is folded into the table of best rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.positions import deepest


def _versions(spark: SparkSession, folder: str, n: int) -> dict[int, int]:
    """The version that holds each bucket after batch ``n``: at most one entry a bucket."""
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{folder}/buckets/version={n}").collect()} if n >= 0 else {}


def _rows(spark: SparkSession, folder: str, held: dict[int, int], schema) -> DataFrame:
    paths = [f"{folder}/rows/version={v}/bucket={b}" for b, v in sorted(held.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _clean(spark: SparkSession, folder: str, held: dict[int, int], n: int) -> None:
    """Delete what neither the map of batch ``n`` - 1, which is committed, nor a later one names: at most a few folders a bucket are ever there."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = jvm.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in fs.globStatus(jvm.Path(f"{folder}/rows/version=*/bucket=*")) or ():
        path = found.getPath()
        version, bucket = (int(x.getName().rpartition("=")[2]) for x in (path.getParent(), path))
        if version < n and held.get(bucket) != version:
            fs.delete(path, True)
    for found in fs.globStatus(jvm.Path(f"{folder}/buckets/version=*")) or ():
        if int(found.getPath().getName().rpartition("=")[2]) < n - 1:
            fs.delete(found.getPath(), True)


def stream_best(spark: SparkSession, source: DataFrame, folder: str, checkpoint: str, buckets: int = 64, tie: str = "event_id") -> StreamingQuery:
    """Fold each micro-batch of ``source`` into ``folder``, read by ``best_rows``: the deepest row of each position seen, with all columns.

    Positions lie in buckets by a hash, and a batch rewrites only the buckets it touches, under its own number; a batch that is run again writes the
    same files again. Buckets and maps that no later batch can need are deleted, so ``best_rows`` reads the last two versions only. Positions without a FEN
    are one position.
    """
    schema = source.schema

    def fold(batch: DataFrame, n: int) -> None:
        batch = batch.withColumn("bucket", F.pmod(F.xxhash64("fen"), F.lit(buckets)).cast("int"))
        held = _versions(spark, folder, n - 1)
        _clean(spark, folder, held, n)
        touched = [r["bucket"] for r in batch.select("bucket").distinct().collect()]
        before = _rows(spark, folder, {b: held[b] for b in touched if b in held}, schema)
        best = deepest(batch.drop("bucket").unionByName(before), tie).withColumn("bucket", F.pmod(F.xxhash64("fen"), F.lit(buckets)).cast("int"))
        best.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/rows/version={n}")
        spark.createDataFrame(list((held | dict.fromkeys(touched, n)).items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/buckets/version={n}")

    return source.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def best_rows(spark: SparkSession, folder: str, n: int, schema) -> DataFrame:
    """The best rows after micro-batch ``n``."""
    return _rows(spark, folder, _versions(spark, folder, n), schema)
