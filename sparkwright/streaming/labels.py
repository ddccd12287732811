"""Incremental labelling as a stream whose own output says what is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def labelled(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The rows of all chunks, or of those before a micro-batch; None if there are none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch=*")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    names = [f.getPath().toString() for f in found or ()]
    names = [p for p in names if before is None or int(p.rpartition("=")[2]) < before]
    return spark.read.option("basePath", folder).parquet(*names) if names else None


def stream_labels(spark: SparkSession, source: DataFrame, folder: str, checkpoint: str, label: Callable[[DataFrame], DataFrame], chunk_rows: int = 500) -> StreamingQuery:
    """Label the positions of a stream once each: a micro-batch's distinct positions (``fen``) less those of earlier chunks go through ``label``.

    Chunks lie under the batch's number, so a batch that runs again after a crash replaces what it wrote and reads only chunks before its own: no
    position is labelled twice and none is lost. Files hold about ``chunk_rows`` rows. Rows without a position are left out.
    """

    def run(batch: DataFrame, n: int) -> None:
        todo = batch.select("fen").where(F.col("fen").isNotNull()).distinct()
        done = labelled(spark, folder, n)
        if done is not None:
            todo = todo.join(done.select("fen"), "fen", "left_anti")
        label(todo).write.mode("overwrite").option("maxRecordsPerFile", chunk_rows).parquet(f"{folder}/batch={n}")

    return source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
