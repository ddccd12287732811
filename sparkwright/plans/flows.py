"""Registered queries of shards, sinks, batches and streams, each with DuckDB SQL. All of them read the raw evaluations, write to the shared folder and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import batches, legality, positions
from ..shared import delete, new_folder, written
from ..sources import evaluations
from ..sources.evaluations import LEGAL_SQL, RAW_SQL
from ..streaming import labels, passes
from .queries import HASH, _raw

WORKERS, BUFFER, BATCH, CHUNK, SHARDS = 4, 256, 64, 500, 10


def _kept(df: DataFrame, *folders: str) -> DataFrame:
    """``df`` as a written table, after which the folders it was read from are deleted."""
    out = written(df, "result")
    for folder in folders:
        delete(df.sparkSession, folder)
    return out


def _ordered(spark, d):
    rows = _raw(spark, d).select("event_id", (F.col("event_id") % WORKERS).cast("int").alias("worker"))
    return batches.buffer_shuffled(rows, ["worker"], ["event_id"], "event_id", BUFFER, 5)


def training_order(spark, d):
    """Each row's place in its worker's order after a shuffle through a buffer."""
    return _ordered(spark, d)


def training_batches(spark, d):
    """Whole batches of 64 rows of that order; each worker's last rows are dropped."""
    return batches.batched(_ordered(spark, d), BATCH, ["worker"], ["at"]).select("event_id", "worker", "batch", "place")


def _shard(fen):
    return F.concat(F.lit("shard"), (positions.split_hash(F.coalesce(fen, F.lit("")), "shard") % SHARDS).cast("string"))


def shard_turns(spark, d):
    """Rows of the shards in the order of two epochs, by worker and turn."""
    counted = _raw(spark, d).groupBy(_shard(F.col("fen")).alias("shard")).agg(F.count("*").alias("n"))
    counted = written(counted, "counted")
    plans = [batches.shard_plan(counted, 3, 11, epoch).withColumn("epoch", F.lit(epoch)) for epoch in (0, 1)]
    return reduce(DataFrame.unionByName, plans).join(counted, "shard").select("epoch", "shard", "worker", "turn", "n")


def chunk_files(spark, d):
    """Distinct positions in files of 500, read back: positions, files and the least and greatest position of each chunk."""
    folder = new_folder(spark, "chunks")
    fens = _raw(spark, d).select("fen").where("fen is not null").distinct().withColumn("key", batches.seeded(F.col("fen"), 2))
    batches.write_chunks(written(fens, "fens"), folder, CHUNK, ["key", "fen"])
    back = spark.read.parquet(folder).withColumn("file", F.col("_metadata.file_path"))
    facts = back.groupBy(F.col("chunk").cast("long").alias("chunk")).agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"), F.min("fen").alias("low"), F.max("fen").alias("high"))
    return _kept(facts, folder)


def shard_layouts(spark, d):
    """The raw rows after a way through each layout of sources and sinks."""
    raw, folder = _raw(spark, d).drop("event_id"), new_folder(spark, "layouts")
    found = []

    def seen(layout: str, rows: DataFrame) -> None:
        found.append(rows.agg(F.count("*").alias("n"), F.countDistinct("fen").alias("n_fens"), F.sum("knodes").alias("knodes"), F.sum("depth").alias("depth")).select(F.lit(layout).alias("layout"), "*"))

    evaluations.write_buckets(raw, f"{folder}/a", 5)
    seen("buckets, flat", evaluations.read_shards(spark, f"{folder}/a", "flat"))
    seen("buckets, no data folder", evaluations.read_shards(spark, f"{folder}/a", "data"))
    evaluations.write_partitions(raw, f"{folder}/b/deep", 6)
    seen("partitions, deep", evaluations.read_shards(spark, f"{folder}/b", "deep"))
    evaluations.append_rows(raw.where("depth >= 13"), f"{folder}/c")
    evaluations.append_rows(raw.where("depth < 13 or depth is null"), f"{folder}/c")
    seen("appended, flat", evaluations.read_shards(spark, f"{folder}/c", "deep"))
    evaluations.write_named_shards(raw, f"{folder}/d", 4)
    seen("named, data folder", evaluations.read_shards(spark, f"{folder}/d", "data"))
    done = evaluations.labelled_positions(spark, f"{folder}/c")
    found.append(done.agg(F.count("*").alias("n"), F.countDistinct("fen").alias("n_fens"), F.lit(None).cast("long").alias("knodes"), F.lit(None).cast("long").alias("depth")).select(F.lit("labelled").alias("layout"), "*"))
    return _kept(reduce(DataFrame.unionByName, found), folder)


def labelled_stream(spark, d):
    """Positions labelled with their number of legal moves by a stream over three files, some of which share positions, each position once."""
    folder = new_folder(spark, "labels")
    raw = _raw(spark, d).select("fen", (F.col("event_id") % 3).alias("third"))
    raw.repartition(3, "third").select("fen").write.option("maxRecordsPerFile", 5_000_000).parquet(f"{folder}/in")
    stream = spark.readStream.schema("fen string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    label = lambda rows: legality.with_legal(rows).where("legal is not null").select("fen", F.size("legal").alias("n_legal"))
    labels.stream_labels(spark, stream, f"{folder}/out", f"{folder}/checkpoint", label).awaitTermination()
    return _kept(labels.labelled(spark, f"{folder}/out").select("fen", "n_legal"), folder)


def pass_rows(spark, d):
    """Rows by epoch, turn and shard of a stream of two passes over the shards, three workers at a time."""
    folder = new_folder(spark, "passes")
    _raw(spark, d).withColumn("shard", _shard(F.col("fen"))).repartition("shard").write.partitionBy("shard").parquet(f"{folder}/in")
    names = [f"shard{k}" for k in range(SHARDS)]

    def use(rows: DataFrame, n: int) -> None:
        rows.groupBy("epoch", "turn", "worker", "shard").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/out/batch={n}")

    read = lambda shards: spark.read.parquet(f"{folder}/in").where(F.col("shard").isin(shards))
    stream = passes.stream_passes(spark, names, read, use, folder, workers=3, seed=11, passes=2)
    passes.await_passes(spark, stream, len(names), folder, 3, 2)
    return _kept(spark.read.parquet(f"{folder}/out").select("epoch", "turn", "worker", "shard", "n"), folder)


QUERIES = {f.__name__: f for f in (training_order, training_batches, shard_turns, chunk_files, shard_layouts, labelled_stream, pass_rows)}

_SEEDED = lambda key, seed, salt: f"md5('{salt}|{seed}|' || {key})"
_NO_NULL = "coalesce(fen, '')"
_SHARD_SQL = f"'shard' || ({HASH(_NO_NULL, 'shard')} % {SHARDS})"
_ORDER_SQL = f"""r AS (SELECT event_id, CAST(event_id % {WORKERS} AS INT) AS worker, row_number() OVER (PARTITION BY event_id % {WORKERS} ORDER BY event_id) - 1 AS n, count(*) OVER (PARTITION BY event_id % {WORKERS}) AS total FROM events),
s AS (SELECT *, CASE WHEN n < {BUFFER} THEN n ELSE CAST(('0x' || substr({_SEEDED("event_id", 5, "slot")}, 1, 15)) AS BIGINT) % {BUFFER} END AS slot FROM r),
t AS (SELECT *, lead(n) OVER (PARTITION BY worker, slot ORDER BY n) AS pushed FROM s),
o AS (SELECT event_id, worker, pushed - {BUFFER} AS place FROM t WHERE pushed IS NOT NULL UNION ALL
  SELECT event_id, worker, total - least(total, {BUFFER}) + row_number() OVER (PARTITION BY worker ORDER BY {_SEEDED("event_id", 5, "drain")}, event_id) - 1 FROM t WHERE pushed IS NULL)"""
_TURNS_SQL = lambda epoch: f"SELECT {epoch} AS epoch, shard, row_number() OVER (ORDER BY {_SEEDED('shard', 11, f'epoch {epoch}')}, shard) - 1 AS r, n FROM c"
_LAYOUT_SQL = "SELECT '{}' AS layout, count(*) AS n, count(DISTINCT fen) AS n_fens, CAST(sum(knodes) AS BIGINT) AS knodes, CAST(sum(depth) AS BIGINT) AS depth FROM raw"
SQL = {
    "training_order": f'WITH {_ORDER_SQL} SELECT event_id, worker, place AS "at" FROM o',
    "training_batches": f"WITH {_ORDER_SQL}, b AS (SELECT *, count(*) OVER (PARTITION BY worker) AS total FROM o) SELECT event_id, worker, place // {BATCH} AS batch, CAST(place % {BATCH} AS INT) AS place FROM b WHERE place < total - total % {BATCH}",
    "shard_turns": f"WITH {RAW_SQL}, c AS (SELECT {_SHARD_SQL} AS shard, count(*) AS n FROM raw GROUP BY 1), p AS ({_TURNS_SQL(0)} UNION ALL {_TURNS_SQL(1)}) SELECT CAST(epoch AS INT) AS epoch, shard, CAST(r % 3 AS INT) AS worker, r // 3 AS turn, n FROM p",
    "pass_rows": f"WITH {RAW_SQL}, c AS (SELECT {_SHARD_SQL} AS shard, count(*) AS n FROM raw GROUP BY 1), p AS ({_TURNS_SQL(0)} UNION ALL {_TURNS_SQL(1)}) SELECT CAST(epoch AS INT) AS epoch, shard, CAST(r % 3 AS INT) AS worker, CAST(r // 3 AS INT) AS turn, n FROM p",
    "chunk_files": f"WITH {RAW_SQL}, f AS (SELECT DISTINCT fen FROM raw WHERE fen IS NOT NULL), n AS (SELECT fen, (row_number() OVER (ORDER BY {_SEEDED('fen', 2, 'order')}, fen) - 1) // {CHUNK} AS chunk FROM f) SELECT chunk, count(*) AS n, CAST(1 AS BIGINT) AS files, min(fen) AS low, max(fen) AS high FROM n GROUP BY chunk",
    "shard_layouts": f"WITH {RAW_SQL} " + " UNION ALL ".join(_LAYOUT_SQL.format(x) for x in ("buckets, flat", "buckets, no data folder", "partitions, deep", "appended, flat", "named, data folder")) + " UNION ALL SELECT 'labelled', (SELECT count(*) FROM (SELECT DISTINCT fen FROM raw)), (SELECT count(DISTINCT fen) FROM raw), NULL, NULL",
    "labelled_stream": f"WITH {RAW_SQL}, {LEGAL_SQL} SELECT DISTINCT fen, CAST(len(legal) AS INT) AS n_legal FROM raw JOIN lawful ON starts_with(fen, position) WHERE legal IS NOT NULL",
}
