"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import discard, freed_shuffles, shared_dir, written  # noqa: F401 (also for the operators)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read through Spark only (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


HOT_ROWS, HOT_KEYS = 256, 100_000


def hot_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """(key, parts) of the keys with more than ``HOT_ROWS`` rows and more than a ``HOT_KEYS``-th of all; None without any.

    So they are fewer than ``HOT_KEYS``, which bounds their broadcast, and their parts fewer than twice that. ``rows`` is a written table.
    """
    total = rows.count()
    least = max(HOT_ROWS, -(-total // HOT_KEYS))
    if total <= least:
        return None
    counted = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__rows")).where(F.col("__rows") > least)
    hot = written(counted.select(key, F.ceil(F.col("__rows") / least).cast("int").alias("__parts")), "hot")
    return None if hot.isEmpty() else hot


def dealt_join(rows: DataFrame, other: DataFrame, key: str, by: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``other`` on ``key``; rows of a hot key are dealt to its parts by a hash of ``by``, and ``other`` is repeated in each part."""
    if hot is None:
        return rows.join(other, key, how)
    parts = F.coalesce("__parts", F.lit(1))
    left = rows.join(F.broadcast(hot), key, "left").withColumn("__part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("__parts")
    right = other.join(F.broadcast(hot), key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return left.join(right, [key, "__part"], how).drop("__part")


def residue(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def salted_hash(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the values of ``cols`` only."""
    return (F.xxhash64(*cols).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))).cast("double")


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow string column as one byte array and the offsets of the rows (nulls: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20):
    """Parts of a batch whose texts hold about ``most_bytes`` bytes (one row at least), so that
    working arrays stay small however long the texts are."""
    at = text_bytes(batch.column(batch.schema.get_field_index(column)))[1]
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most_bytes, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def crc32_sql(text: str) -> str:
    """DuckDB SQL of the unsigned crc32 of a text's UTF-8 bytes, 0 for null; the table of 256 entries follows from the polynomial."""
    table_sql = "list_transform(range(256), lambda b: list_reduce(range(8), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b))"
    digits = f"string_split(hex(encode(coalesce({text}, ''))), '')"
    values = f"list_transform({digits}, lambda h: instr('0123456789ABCDEF', h) - 1)"
    # A byte is two digits; the lower one is shifted in first.
    return f"""(SELECT xor(4294967295, list_reduce(list_transform(range(len(v) // 2), lambda i: v[2 * i + 1] * 16 + v[2 * i + 2]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295))
  FROM (SELECT {values} AS v, {table_sql} AS t))"""
