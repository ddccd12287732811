"""Order and cut of training rows: shards dealt to workers, a shuffle through a bounded buffer, batches and chunks of an exact size.

All of it is numbering: a row's place among the rows of its worker says which slot of the buffer it takes, when the next row of that slot pushes it out, and to
which batch that belongs. So nothing runs row by row, nothing depends on partitions or on a random state, and a worker's rows are never one task.

Defined results: null groups are a group; ties in an order are broken by further columns of it, else by partitions; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import discard, written
from .numbering import numbered


def seeded(key: Column, seed: int, salt: str = "order") -> Column:
    """A text by which rows are in an order that the seed gives; every engine computes it alike."""
    return F.md5(F.concat_ws("|", F.lit(salt), F.lit(str(seed)), key.cast("string")).cast("binary"))


def shard_plan(shards: DataFrame, workers: int, seed: int = 0, epoch: int = 0, name: str = "shard") -> DataFrame:
    """(name, worker, turn): the shards of an epoch in an order that seed and epoch give, dealt to workers one by one."""
    ordered = shards.select(name).distinct().withColumn("__key", seeded(F.col(name), seed, f"epoch {epoch}"))
    rows = numbered(written(ordered, "shards"), [], ["__key", name], "__at", "__all")
    return rows.select(name, (F.col("__at") % workers).cast("int").alias("worker"), F.floor(F.col("__at") / workers).cast("long").alias("turn"))


def buffer_shuffled(rows: DataFrame, workers: list[str], order: Sequence[Column | str], key: str, buffer: int, seed: int = 0, at: str = "at") -> DataFrame:
    """``rows`` with their place ``at`` in their worker's order after a shuffle through a buffer of ``buffer`` rows.

    Rows come by ``order``. The first fill the buffer; each later one takes a slot that a hash of ``key`` and the seed gives, and pushes out the row there; at the end the
    buffer is drained in the order of another hash. A row that pushes out the one before it in its slot is the next row of that slot, one window away;
    slots hold about a ``buffer``-th of a worker's rows.
    """
    placed = numbered(rows, workers, order, "__n", "__all")
    pushed = F.conv(F.substring(seeded(F.col(key), seed, "slot"), 1, 15), 16, 10).cast("long") % buffer
    slot = F.when(F.col("__n") < buffer, F.col("__n")).otherwise(pushed)
    next_one = F.lead("__n").over(Window.partitionBy(*workers, "__slot").orderBy("__n"))
    moved = written(placed.withColumn("__slot", slot).withColumn("__next", next_one), "slots")
    early = moved.where("__next is not null").withColumn(at, F.col("__next") - buffer)
    # At most ``buffer`` rows of a worker are left.
    drained = F.row_number().over(Window.partitionBy(*workers).orderBy("__drain", key, "__n"))
    left = moved.where("__next is null").withColumn("__drain", seeded(F.col(key), seed, "drain"))
    late = left.withColumn(at, F.col("__all") - F.least(F.col("__all"), F.lit(buffer)) + drained - 1)
    return early.select(*rows.columns, at).unionByName(late.select(*rows.columns, at))


def batched(rows: DataFrame, size: int, groups: list[str], order: Sequence[Column | str], drop_last: bool = True) -> DataFrame:
    """``rows`` with ``batch`` and ``place`` in it, both from 0: batches of exactly ``size`` rows a group; the incomplete last one is dropped or kept."""
    placed = numbered(rows, groups, order, "__at", "__all")
    if drop_last:
        placed = placed.where(F.col("__at") < F.col("__all") - F.col("__all") % size)
    return placed.select(*rows.columns, F.floor(F.col("__at") / size).cast("long").alias("batch"), (F.col("__at") % size).cast("int").alias("place"))


def write_chunks(rows: DataFrame, path: str, size: int, order: Sequence[Column | str]) -> None:
    """One file chunk=N/... of exactly ``size`` rows for each chunk, in order; the last one may be smaller. What is there is replaced."""
    chunks = batched(rows, size, [], order, drop_last=False).withColumnRenamed("batch", "chunk")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks.repartition(n, "chunk").sortWithinPartitions("chunk", "place").drop("place").write.mode("overwrite").partitionBy("chunk").parquet(path)
    discard(chunks)
