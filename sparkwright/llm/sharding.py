"""Sharding by weighted rendezvous hashing of stable record keys, by Spark expressions only.

A key draws a number u in (0, 1) for each shard, from a hash of key and shard, and goes to the shard with the greatest -weight / ln u. So a shard gets keys in
proportion to its weight, key and shards alone decide, and a shard that is added, taken away or given another weight moves only the keys it gains or
loses. Slots number the rows of a shard in order of the key's hash; they come from one range sort over all rows (``numbered``), so a shard is never one task.

Defined results: a null key counts as empty text and so has a shard like any other; a null text has no bytes and a checksum of 0; repeated rows are rows
like others, in one shard with slots of their own; rows of one key are in one shard, however many (a third of all rows may share one); equal texts under
different keys are independent; extra columns are ignored by ``assigned`` and kept by ``write_shards``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..shared import scratch
from .common import crc32_sql, discard, table, written

SHARDS, OVERHEAD = 24, 8  # shards of the query, bytes that a row takes besides its text
_DIGITS = 13  # hexadecimal digits of a hash: 52 bits, which a double holds exactly


def drawn(key: Column, shard: Column) -> Column:
    """A number in (0, 1) that key and shard alone decide."""
    digits = F.substring(F.md5(F.concat_ws("|", key, shard.cast("string")).cast("binary")), 1, _DIGITS)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(1 << 4 * _DIGITS)


def score(key: Column, shard: Column, weight: Column) -> Column:
    return -weight / F.ln(drawn(key, shard))


def rendezvous(rows: DataFrame, key: Column, weights: Sequence[float], shard: str = "shard", fewer: str | None = None) -> DataFrame:
    """``rows`` with the shard of ``key``, numbered from 0, and in a column named ``fewer`` the one it has without the last shard. Weights are positive."""
    if len(weights) < 1 + bool(fewer) or min(weights) <= 0:
        raise ValueError("there is no shard, or a weight is not positive")
    # A shard's score with minus its number: of equal scores the smaller shard wins.
    scores = F.transform(F.array(*[F.lit(float(w)) for w in weights]), lambda w, s: F.struct(score(key, s, w).alias("score"), (-s).alias("minus")))
    rows = rows.withColumn("__scores", scores)
    out = {shard: (-F.array_max("__scores")["minus"]).cast("int")}
    if fewer:
        out[fewer] = (-F.array_max(F.slice("__scores", 1, len(weights) - 1))["minus"]).cast("int")
    return rows.withColumns(out).drop("__scores")


def assigned(docs: DataFrame, weights: Sequence[float], next_weight: float | None = None, key_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard): the shard of each row among shards of these ``weights``, its slot there, and the shard
    it has once a shard of ``next_weight`` (the mean weight, if not given) is added. ``keep`` names columns to carry along."""
    extra = sum(weights) / len(weights) if next_weight is None else next_weight
    key, text = F.coalesce(F.col(key_col).cast("string"), F.lit("")), F.col(text_col).cast("string")
    rows = docs.select(F.col(key_col).alias("key"), key.alias("__key"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD).alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("text_crc32"), *keep)
    rows = rendezvous(rows, F.col("__key"), [*weights, extra], "grown_shard", "shard")
    rows = written(rows.withColumn("__order", F.md5(F.col("__key").cast("binary"))), "sharded")
    out = numbered(rows, ["shard"], ["__order", "__key"], "slot", "rows")
    discard(rows)
    return out.select("key", "size", "text_crc32", "shard", "slot", "grown_shard", *keep)


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], key_col: str = "doc_id", text_col: str = "text", files: int = 1) -> None:
    """All columns of ``docs`` and their slot in folders shard=N of ``path``, in files of rows in order of slot; rows of a shard are dealt to ``files`` files.
    Columns of ``docs`` that are named shard or slot are replaced."""
    whole = written(docs.drop("shard", "slot").withColumn("__row", F.monotonically_increasing_id()), "marked")
    places = assigned(whole, weights, None, key_col, text_col, ["__row"]).select("__row", "shard", "slot")
    rows = whole.join(places, "__row").drop("__row").withColumn("__file", F.pmod("slot", F.lit(files)))
    rows = rows.repartition(len(weights) * files, "shard", "__file").sortWithinPartitions("shard", "__file", "slot").drop("__file")
    rows.write.mode("overwrite").partitionBy("shard").parquet(path)
    discard(whole, places)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal weight, by the law that their key and the number of shards decide."""
    with scratch(spark) as keep:
        rows = assigned(table(spark, sf_dir, "documents"), [1.0] * SHARDS)
        return keep(rows.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"), "shards")


_DRAWN = "(CAST(('0x' || substr(md5(key || '|' || s), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE"
OP11_SQL = f"""WITH d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, coalesce(strlen(text), 0) + 8 AS size, text FROM documents),
c AS (SELECT doc_id, {crc32_sql("text")} AS text_crc32 FROM documents),
k AS (SELECT doc_id, key, s, -1 / ln({_DRAWN}) AS score FROM d, range({SHARDS + 1}) x(s)),
p AS (SELECT doc_id, key, arg_max(s, (score, -s)) FILTER (s < {SHARDS}) AS shard, arg_max(s, (score, -s)) AS grown_shard FROM k GROUP BY ALL)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(shard AS INT) AS shard, row_number() OVER (PARTITION BY shard ORDER BY md5(d.key), d.key) - 1 AS slot, CAST(grown_shard AS INT) AS grown_shard
FROM d JOIN c USING (doc_id) JOIN p USING (doc_id)"""
