"""Tables in the folder that driver and executors share: lineage is cut by writing a table and reading it again."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none and its executors are threads of the driver (tests on one machine) a temporary folder is used.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(spark, "_own_checkpoint_dir", None) or tempfile.mkdtemp(prefix="sparkwright-")
        spark._own_checkpoint_dir = folder
    return folder


def new_folder(spark: SparkSession, what: str) -> str:
    """A path in the shared folder, or in the folder of the ``scratch`` around, that nothing has used."""
    return f"{shared_dir(spark)}/sparkwright/{getattr(spark, '_own_scratch', '')}{what}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder in any store."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession):
    """All tables that are written inside go at the end, those that a callee has kept too; yields ``keep``, which writes a table outside, reads it again and returns it."""
    outer = getattr(spark, "_own_scratch", "")
    inner = f"{outer}scratch-{uuid.uuid4().hex}/"

    def keep(df: DataFrame, what: str) -> DataFrame:
        spark._own_scratch = outer
        try:
            return written(df, what)
        finally:
            spark._own_scratch = inner

    spark._own_scratch = inner
    try:
        yield keep
    finally:
        spark._own_scratch = outer
        delete(spark, f"{shared_dir(spark)}/sparkwright/{inner}")


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Shuffle files of a query that runs inside go when it ends, not when the driver collects garbage.

    Spark keeps their registration, so a stage that still misses them is run again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder as Parquet and read it again.

    The files survive the loss of any executor; a lost task is run again and commits once. They are packed more tightly than Spark's default does, since they are
    written and read a few times and several may be there at once.
    """
    spark = df.sparkSession
    path = new_folder(spark, what)
    with freed_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` returned and no later step reads."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/sparkwright/" in folder:
                delete(df.sparkSession, folder)
