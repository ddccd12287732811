"""Endless passes over shards: a streaming source of turns, whose offset is (epoch, turn), and a loop that reads the shards of each.

The source sends names of shards only, ``workers`` of them a micro-batch; their rows are read by Spark. The order of an epoch follows from seed and epoch, so a
restart from the checkpoint goes on with the turn after the last one that was committed, and a turn that runs again has the same shards.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

TURNS = "epoch int, turn int, worker int, shard string"


def epoch_order(shards: list[str], seed: int, epoch: int) -> list[str]:
    """The same order as ``batches.shard_plan``."""
    return sorted(shards, key=lambda s: (hashlib.md5(f"epoch {epoch}|{seed}|{s}".encode()).hexdigest(), s))


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.shards, self.workers = json.loads(options["shards"]), int(options.get("workers", "1"))
        self.seed, self.passes = int(options.get("seed", "0")), int(options.get("passes", "0"))
        self.turns = -(-len(self.shards) // self.workers)

    def initialOffset(self) -> dict:
        return {"epoch": 0, "turn": 0}

    def _rows(self, epoch: int, turn: int) -> list[tuple]:
        names = epoch_order(self.shards, self.seed, epoch)[turn * self.workers : (turn + 1) * self.workers]
        return [(epoch, turn, worker, name) for worker, name in enumerate(names)]

    def _next(self, at: dict) -> dict:
        epoch, turn = at["epoch"], at["turn"] + 1
        return {"epoch": epoch, "turn": turn} if turn < self.turns else {"epoch": epoch + 1, "turn": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if not self.shards or (self.passes and start["epoch"] >= self.passes):
            return iter(()), start
        return iter(self._rows(**start)), self._next(start)

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        while start != end:
            yield from self._rows(**start)
            start = self._next(start)


class ShardTurns(DataSource):
    """Options: shards (a JSON list of names), workers, seed, passes (0: endless)."""

    @classmethod
    def name(cls) -> str:
        return "shard_turns"

    def schema(self) -> str:
        return TURNS

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(self.options)


def stream_passes(spark: SparkSession, shards: list[str], read: Callable[[list[str]], DataFrame], use: Callable[[DataFrame, int], None], folder: str, workers: int = 1, seed: int = 0, passes: int = 0) -> StreamingQuery:
    """Hand the rows of each turn's shards to ``use`` with the micro-batch's number; they have the columns epoch, turn and worker, and ``read`` gives them a column ``shard``.

    ``use`` should write under that number, since a turn may run again after a crash. Stops after ``passes`` passes (0: never), or after one that had no rows.
    """
    spark.dataSource.register(ShardTurns)
    options = {"shards": json.dumps(shards), "workers": str(workers), "seed": str(seed), "passes": str(passes)}
    turns = spark.readStream.format("shard_turns").options(**options).load()
    counted = f"{folder}/counts"

    def run(batch: DataFrame, n: int) -> None:
        asked = batch.collect()  # at most ``workers`` names a turn
        rows = read([r["shard"] for r in asked]).join(F.broadcast(spark.createDataFrame(asked, TURNS)), "shard")
        use(rows, n)
        facts = rows.groupBy("epoch").agg(F.count("*").alias("n"))
        here = spark.createDataFrame([(r["epoch"],) for r in asked[:1]], "epoch int").join(facts, "epoch", "left")
        here.select("epoch", F.coalesce("n", F.lit(0)).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{counted}/batch={n}")

    return turns.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime="0 seconds").start()


def await_passes(spark: SparkSession, query: StreamingQuery, shards: int, folder: str, workers: int = 1, passes: int = 0, seconds: float = 600.0) -> int:
    """Wait until the passes are done, a pass has had no rows, or the time is over; stop the stream and return the micro-batches that are committed."""
    turns, began, done = -(-shards // workers), time.time(), 0
    try:
        while query.isActive and time.time() - began < seconds and turns:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/counts/batch=*/_SUCCESS")
            done = len(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or ())
            whole = done // turns
            if passes and whole >= passes:
                break
            if whole and not spark.read.parquet(f"{folder}/counts").where((F.col("epoch") == whole - 1) & (F.col("n") > 0)).head(1):
                break
            time.sleep(0.5)
        if query.exception():
            raise query.exception()
    finally:
        query.stop()
    return done
