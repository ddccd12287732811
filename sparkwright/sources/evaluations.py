"""Tables of position evaluations: (fen, line, cp, mate, depth, knodes), one row a variation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "fen string, line string, cp int, mate int, depth int, knodes bigint"

# Positions of the synthetic table with all their legal moves (one is no position, two have no move).
LEGAL = {
    "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq -": "a2a3 a2a4 b1a3 b1c3 b2b3 b2b4 c2c3 c2c4 d2d3 d2d4 e2e3 e2e4 f2f3 f2f4 g1f3 g1h3 g2g3 g2g4 h2h3 h2h4",
    "r1bqkbnr/pppp1ppp/2n5/4p3/4P3/5N2/PPPP1PPP/RNBQKB1R w KQkq -": "a2a3 a2a4 b1a3 b1c3 b2b3 b2b4 c2c3 c2c4 d1e2 d2d3 d2d4 e1e2 f1a6 f1b5 f1c4 f1d3 f1e2 f3d4 f3e5 f3g1 f3g5 f3h4 g2g3 g2g4 h1g1 h2h3 h2h4",
    "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq e3": "a7a5 a7a6 b7b5 b7b6 b8a6 b8c6 c7c5 c7c6 d7d5 d7d6 e7e5 e7e6 f7f5 f7f6 g7g5 g7g6 g8f6 g8h6 h7h5 h7h6",
    "8/P6k/8/8/8/8/8/K7 w - -": "a1a2 a1b1 a1b2 a7a8b a7a8n a7a8q a7a8r",
    "8/8/8/KPpk4/8/8/8/8 w - c6": "a5a4 a5a6 a5b6 b5b6 b5c6",
    "4k2r/8/8/8/8/8/8/4K3 b k -": "e8d7 e8d8 e8e7 e8f7 e8f8 e8g8 h8f8 h8g8 h8h1 h8h2 h8h3 h8h4 h8h5 h8h6 h8h7",
    "4k3/8/8/8/8/8/8/R3K3 w Q -": "a1a2 a1a3 a1a4 a1a5 a1a6 a1a7 a1a8 a1b1 a1c1 a1d1 e1c1 e1d1 e1d2 e1e2 e1f1 e1f2",
    "7k/5KQ1/8/8/8/8/8/8 b - -": "",
    "7k/5Q2/6K1/8/8/8/8/8 b - -": "",
    "8/k7/8/8/8/8/p6K/8 b - -": "a2a1b a2a1n a2a1q a2a1r a7a6 a7a8 a7b6 a7b7 a7b8",
    "rnbqkbnr/pppppppp/8/8 w KQkq -": None,
}
# First moves of the lines on them, illegal and malformed ones among them.
LINES = (
    "e2e4 d2d4 g1f3 e2e5 zz b1c3",
    "f1b5 f1c4 d2d4 e1g1 f3e5 g2g9",
    "e7e5 c7c5 g8f6 e2e4 e7e6 d7d5",
    "a7a8q a7a8r a7a8n a1b2 a7b8q a7a8k",
    "b5c6 b5b6 a5b6 a5b4 a5a4 0000",
    "e8g8 h8h1 e8e7 e8c8 h8h2 e8d8",
    "e1c1 a1a8 e1g1 e1d2 a1a9 a1b1",
    "h8g8 h8h7 h8g7 h8g8 h8h7 h8g7",
    "h8g8 h8h7 h8g7 h8g8 h8h7 h8g7",
    "a2a1q a2a1b a7b6 a2b1q a7a8 a2a1n",
    "e2e4 d2d4 g1f3 e2e5 zz b1c3",
)
POSITIONS, MOVES = tuple(LEGAL), tuple(" ".join(LINES).split(" "))


def _found(spark: SparkSession, pattern: str) -> bool:
    """Whether a glob pattern matches files, in any store."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path))


def read_shards(spark: SparkSession, folder: str, layout: str = "data", schema: str = SCHEMA) -> DataFrame:
    """Shards of evaluations: ``data`` reads data/data_*.parquet or else what ``flat`` reads, *.parquet; ``deep`` reads *.parquet or else
    all folders below. A damaged shard raises."""
    reader = spark.read.schema(schema)
    if layout == "data" and _found(spark, f"{folder}/data/data_*.parquet"):
        return reader.option("pathGlobFilter", "data_*.parquet").parquet(f"{folder}/data")
    if layout == "deep" and not _found(spark, f"{folder}/*.parquet"):
        reader = reader.option("recursiveFileLookup", "true")
    return reader.option("pathGlobFilter", "*.parquet").parquet(folder)


def write_buckets(df: DataFrame, path: str, buckets: int = 32, key: str = "fen") -> None:
    """One file a bucket of the key, replacing what is there."""
    df.repartition(buckets, key).write.mode("overwrite").parquet(path)


def write_partitions(df: DataFrame, path: str, buckets: int = 32, key: str = "fen") -> None:
    """A folder bucket=N for each bucket of the key; only buckets that ``df`` has are replaced."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    df.withColumn("bucket", bucket).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def write_named_shards(df: DataFrame, path: str, shards: int = 20, key: str = "fen") -> None:
    """Files data/data_*.parquet, the first layout that ``read_shards`` looks for, replacing what is there: written beside, then renamed one by one."""
    spark = df.sparkSession
    df.repartition(shards, key).write.mode("overwrite").parquet(f"{path}/_new")
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = jvm.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(jvm.Path(f"{path}/data"), True)
    fs.mkdirs(jvm.Path(f"{path}/data"))
    for k, found in enumerate(sorted(f.getPath().toString() for f in fs.globStatus(jvm.Path(f"{path}/_new/part-*.parquet")))):
        fs.rename(jvm.Path(found), jvm.Path(f"{path}/data/data_{k:05d}.parquet"))
    fs.delete(jvm.Path(f"{path}/_new"), True)


def append_rows(df: DataFrame, path: str) -> None:
    """More files beside those that are there; a task that runs again commits once."""
    df.write.mode("append").parquet(path)


def labelled_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct positions that earlier runs have written; unreadable files count as nothing."""
    return spark.read.option("ignoreCorruptFiles", "true").parquet(folder).select("fen").distinct()


def position_evals(events: DataFrame) -> DataFrame:
    """Raw evaluations on the arithmetic of ``events``, with null, empty and unscored rows, bad positions and bad and illegal moves among them."""
    e, u, n = F.col("event_id"), F.col("user_id"), len(POSITIONS)
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    position = pick(POSITIONS, e % n)
    return events.select(
        "event_id",
        F.when(u == 3, position).when(u != 7, F.concat_ws(" ", position, (e % 2).cast("string"), (1 + u).cast("string"))).alias("fen"),
        F.when(e % 17 == 0, F.lit("")).when(e % 19 != 0, F.concat(pick(MOVES, (e % n) * 6 + F.floor(e / n) % 6), F.lit(" a7a6"))).alias("line"),
        F.when((e % 7 != 0) & (e % 23 != 0), F.round((F.col("value") - 50) * 10).cast("int")).alias("cp"),
        F.when(e % 7 == 0, (e % 5 - 2).cast("int")).alias("mate"),
        F.when(u % 10 == 0, 8).when(e % 13 != 0, (10 + 3 * (e % 5)).cast("int")).alias("depth"),
        F.when(e % 29 != 0, 1000 * (e % 2 + 1)).alias("knodes"),
    )


_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
RAW_SQL = f"""raw AS (SELECT event_id,
  CASE WHEN user_id <> 7 THEN {_LIST(POSITIONS)}[event_id % {len(POSITIONS)} + 1] || CASE WHEN user_id = 3 THEN '' ELSE ' ' || (event_id % 2) || ' ' || (1 + user_id) END END AS fen,
  CASE WHEN event_id % 17 = 0 THEN '' WHEN event_id % 19 <> 0 THEN {_LIST(MOVES)}[(event_id % {len(POSITIONS)}) * 6 + (event_id // {len(POSITIONS)}) % 6 + 1] || ' a7a6' END AS line,
  CASE WHEN event_id % 7 <> 0 AND event_id % 23 <> 0 THEN CAST(round((value - 50) * 10) AS INT) END AS cp,
  CASE WHEN event_id % 7 = 0 THEN CAST(event_id % 5 - 2 AS INT) END AS mate,
  CASE WHEN user_id % 10 = 0 THEN 8 WHEN event_id % 13 <> 0 THEN CAST(10 + 3 * (event_id % 5) AS INT) END AS depth,
  CASE WHEN event_id % 29 <> 0 THEN 1000 * (event_id % 2 + 1) END AS knodes FROM events)"""
#: (fen, legal) of the positions without clocks; ``legal`` is null for what is no position.
LEGAL_SQL = "lawful(position, legal) AS (VALUES " + ", ".join(f"('{p}', " + ("NULL::VARCHAR[]" if m is None else f"string_split('{m}', ' ')" if m else "[]::VARCHAR[]") + ")" for p, m in LEGAL.items()) + ")"
