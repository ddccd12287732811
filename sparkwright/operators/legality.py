"""Legality in Arrow batches: boards of a whole batch are columns of 64-bit numbers, so no Python loop runs over positions or moves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bitboards, board

SLICE = 2048  # positions whose moves are made together


def legal_lists(fens: pa.Array) -> pa.Array:
    """The moves of each FEN as a list of UCI strings: null if it cannot be parsed, empty if the game is over."""
    lists, where = [], np.full(len(fens), -1, np.int64)
    for s in range(0, len(fens), SLICE):
        p, at = bitboards.parse(fens[s : s + SLICE])
        moves = bitboards.legal_moves(p)
        where[s + at] = sum(map(len, lists)) + np.arange(len(at))
        ends = np.searchsorted(moves.at, np.arange(len(at) + 1)).astype(np.int32)
        lists.append(pa.ListArray.from_arrays(pa.array(ends), bitboards.uci(p, moves)))
    made = pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.string()))
    return made.take(pa.array(where, pa.int64(), mask=where < 0))


def with_legal(rows: DataFrame) -> DataFrame:
    """``rows`` with ``legal``, the moves of their ``fen``: null if it cannot be parsed, empty if the game is over.

    Nothing is shuffled, so a position that most rows share weighs no more than others: a batch works out each of its positions once, clocks apart.
    """
    place = rows.columns.index("fen")

    def run(batches):
        for b in batches:
            fens = b.column(place).dictionary_encode()
            bare = pc.replace_substring_regex(fens.dictionary, pattern=bitboards.CLOCKS, replacement="").dictionary_encode()
            legal = legal_lists(bare.dictionary).take(bare.indices).take(fens.indices)
            yield pa.RecordBatch.from_arrays([*b.columns, legal], names=[*b.schema.names, "legal"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("legal", T.ArrayType(T.StringType()))]))


def legal_moves(positions: DataFrame) -> DataFrame:
    """(fen, legal) of distinct positions. Sparse moves and not 4,096 flags leave Python."""
    return with_legal(positions.select("fen").where("fen is not null").distinct())


def legal_classes(legal: Column) -> Column:
    """The classes of a list of moves; a promotion's piece makes no difference."""
    return F.array_distinct(F.transform(legal, board.move_class))


def is_legal(move: Column, legal: Column) -> Column:
    """Whether a well-formed move is among the legal ones; a promotion's piece makes no difference, as in its class."""
    squares = F.substring(move, 1, 4)
    return F.coalesce(F.rlike(move, F.lit(board.UCI)) & F.exists(legal, lambda m: m.startswith(squares)), F.lit(False))


def keep_legal(rows: DataFrame, move: str = "move") -> DataFrame:
    """Rows whose move is legal in their position."""
    return with_legal(rows).where(is_legal(F.col(move), F.col("legal"))).drop("legal")


def terminal_positions(positions: DataFrame) -> DataFrame:
    """Distinct positions without a legal move."""
    return legal_moves(positions).where(F.size("legal") == 0).select("fen")


def keep_legal_moves(values: DataFrame, least_moves: int = 1) -> DataFrame:
    """Action values (fen, moves, cp, mate, ...) with bad and illegal moves dropped from the aligned lists, the class of each move for the side to move
    as ``classes`` and all legal classes as ``legal``; positions with fewer than ``least_moves`` moves left go."""
    rows = with_legal(values.where(F.size("moves") >= least_moves))
    kept = F.filter(F.arrays_zip("moves", "cp", "mate"), lambda z: is_legal(z["moves"], F.col("legal")))
    rows = rows.withColumn("kept", kept).where(F.size("kept") >= least_moves)
    for name in ("moves", "cp", "mate"):
        rows = rows.withColumn(name, F.col(f"kept.{name}"))
    seen = lambda c: F.when(board.field(F.col("fen"), 2) == "b", board.mirror_class(c)).otherwise(c)
    return rows.withColumn("classes", F.transform("moves", lambda m: seen(board.move_class(m)))).withColumn("legal", F.transform(legal_classes(F.col("legal")), seen)).drop("kept")


def drop_reasons(raw: DataFrame) -> DataFrame:
    """Rows by the first thing that would drop them: no line, bad FEN, no score, bad move, illegal move, or none."""
    rows = with_legal(raw.select("fen", "line", "cp", "mate")).withColumn("move", board.first_move(F.col("line")))
    reason = (
        F.when(F.coalesce(F.length("line"), F.lit(0)) == 0, "no line")
        .when(F.col("legal").isNull(), "bad position")
        .when(F.col("cp").isNull() & F.col("mate").isNull(), "no score")
        .when(~F.rlike("move", F.lit(board.UCI)), "bad move")
        .when(~is_legal(F.col("move"), F.col("legal")), "illegal move")
        .otherwise("kept")
    )
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))
