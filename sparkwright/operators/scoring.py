"""Batch scoring with a trained small model, and move selection by it.

A model is a folder of Parquet rows (layer, row, values) in the shared store. It is read once, its size is checked, and it goes to each executor as one broadcast.
Positions become sparse features inside Arrow batches: the first layer adds up the rows of the weights that are set (about 35 of 1,152), so no dense
64 x 18 block exists. A batch is cut so that its working arrays stay below ``NUMBERS``.

Defined results: a FEN that is null or no position scores null; extra columns are kept; an empty table gives no rows; equal positions score alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bitboards, board, scores

SQUARES, PLANES, CLASSES = 64, 18, 4096
MOST_PARAMETERS = 50_000_000  # 200 MB as 4-byte numbers; larger models are no small baseline
NUMBERS = 8_000_000  # of a batch's working arrays
EPSILON = 1e-5
#: Layers by name; block layers have the number of their block in place of N. A matrix has a row for each input.
LAYERS = ("in.weight", "in.bias", "N.norm", "N.up.weight", "N.up.bias", "N.down.weight", "N.down.bias", "norm", "policy.weight", "policy.bias", "head.weight", "head.bias", "wdl.weight", "wdl.bias", "value.weight", "value.bias")
SCORED = "value double, win double, draw double, loss double"

Model = dict[str, np.ndarray]


def write_model(spark: SparkSession, model: Model, path: str) -> None:
    """Weights as rows (layer, row, values); a vector is one row."""
    rows = [(name, k, [float(x) for x in row]) for name, w in model.items() for k, row in enumerate(np.atleast_2d(w))]
    spark.createDataFrame(rows, "layer string, row int, values array<double>").write.mode("overwrite").parquet(path)


def read_model(spark: SparkSession, path: str) -> Model:
    """The model in a folder. One of more than ``MOST_PARAMETERS`` numbers, or with a layer missing, is refused before it is collected."""
    rows = spark.read.parquet(path)
    facts = rows.agg(F.sum(F.size("values")).alias("n"), F.collect_set("layer").alias("names")).first()
    blocks = {n.split(".")[0] for n in facts["names"] if n.split(".")[0].isdigit()}
    wanted = {name.replace("N", b, 1) for name in LAYERS if name.startswith("N.") for b in blocks} | {n for n in LAYERS if not n.startswith("N.")}
    if wanted != set(facts["names"]):
        raise ValueError(f"layers missing or unknown: {sorted(wanted ^ set(facts['names']))}")
    if facts["n"] > MOST_PARAMETERS:
        raise ValueError(f"{facts['n']} numbers are more than {MOST_PARAMETERS}")
    held: dict[str, list] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["layer"], r["row"])):
        held.setdefault(r["layer"], []).append(r["values"])
    model = {name: np.array(v) if name.endswith(".weight") else np.array(v[0]) for name, v in held.items()}
    if model["in.weight"].shape[0] != SQUARES * PLANES or model["policy.weight"].shape[1] != CLASSES:
        raise ValueError("the model has other features or classes")
    return model


def mish(x: np.ndarray) -> np.ndarray:
    return x * np.tanh(np.logaddexp(0, x))


def root_mean_square(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).mean(1, keepdims=True) + EPSILON) * weight


def first_layer(model: Model, p: bitboards.Positions) -> np.ndarray:
    """The input layer's output from the features that are set; features of all squares at once (rights, clock) have the sum of their rows."""
    w = model["in.weight"]
    at, feature = [], []
    for plane, boards in enumerate([*p.own, *p.other, np.where(p.passing < 0, bitboards.NONE, bitboards.ONE << np.maximum(p.passing, 0).astype(bitboards.U))]):
        a, square = bitboards.spread(boards)
        at.append(a)
        feature.append(square * PLANES + (plane if plane < 12 else 16))
    at, feature = np.concatenate(at), np.concatenate(feature)
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], np.arange(len(p.black)))  # every position has two kings at least
    out = np.add.reduceat(w[feature[order]], starts, axis=0) + model["in.bias"]
    whole = w.reshape(SQUARES, PLANES, -1).sum(0)
    for k in range(4):
        out += ((p.rights >> np.uint8(k)) & 1)[:, None] * whole[12 + k]
    return out + (np.minimum(p.half, 100) / 100)[:, None] * whole[17]


def forward(model: Model, p: bitboards.Positions) -> np.ndarray:
    """The last hidden layer of each position."""
    x, block = first_layer(model, p), 0
    while f"{block}.norm" in model:
        h = mish(root_mean_square(x, model[f"{block}.norm"]) @ model[f"{block}.up.weight"] + model[f"{block}.up.bias"])
        x = x + h @ model[f"{block}.down.weight"] + model[f"{block}.down.bias"]
        block += 1
    return root_mean_square(x, model["norm"])


def heads(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values, and shares of win, draw and loss."""
    h = mish(x @ model["head.weight"] + model["head.bias"])
    logits = h @ model["wdl.weight"] + model["wdl.bias"]
    e = np.exp(logits - logits.max(1, keepdims=True))
    return np.tanh(h @ model["value.weight"] + model["value.bias"])[:, 0], e / e.sum(1, keepdims=True)


def _step(model: Model, classes: bool) -> int:
    width = max(w.shape[-1] for name, w in model.items() if not name.startswith("policy"))
    return max(1, NUMBERS // (40 * width + (CLASSES + 300 if classes else 0)))


def with_scores(rows: DataFrame, model: Model, policy: bool = False, fen_col: str = "fen") -> DataFrame:
    """``rows`` with ``value`` and shares ``win``, ``draw`` and ``loss`` for the side to move; with ``policy`` also ``legal``, the moves, ``classes``, the
    sorted classes of these as the side to move sees them, and ``logits`` of these. A batch scores each of its positions once; nothing is shuffled."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    place = rows.columns.index(fen_col)
    added = T.StructType.fromDDL(SCORED + (", legal array<string>, classes array<int>, logits array<double>" if policy else ""))

    def scored(fens: pa.Array) -> list[pa.Array]:
        held, parts, where = sent.value, [], np.full(len(fens), -1, np.int64)
        step, done = _step(held, policy), 0
        for s in range(0, len(fens), step):
            p, at = bitboards.parse(fens[s : s + step])
            if not len(at):
                continue
            where[s + at] = done + np.arange(len(at))
            done += len(at)
            x = forward(held, p)
            value, wdl = heads(held, x)
            columns = [pa.array(c) for c in (value, *wdl.T)]
            if policy:
                moves = bitboards.legal_moves(p)
                ends = np.searchsorted(moves.at, np.arange(len(at) + 1)).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), bitboards.uci(p, moves)))
                key = np.unique(moves.at * CLASSES + moves.start * 64 + moves.goal)
                of, number = key // CLASSES, key % CLASSES
                ends = pa.array(np.searchsorted(of, np.arange(len(at) + 1)).astype(np.int32))
                logits = (x @ held["policy.weight"] + held["policy.bias"])[of, number]
                columns += [pa.ListArray.from_arrays(ends, pa.array(number.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(logits))]
            parts.append(columns)
        kinds = [pa.float64()] * 4 + [pa.list_(k) for k in (pa.string(), pa.int32(), pa.float64())][: 3 if policy else 0]
        index = pa.array(where, pa.int64(), mask=where < 0)
        return [(pa.concat_arrays([c[k] for c in parts]) if parts else pa.array([], kind)).take(index) for k, kind in enumerate(kinds)]

    def run(batches):
        for b in batches:
            fens = b.column(place).dictionary_encode()
            columns = [c.take(fens.indices) for c in scored(fens.dictionary)]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, *added.names])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *added.fields]))


def policy_choices(positions: DataFrame, model: Model, temperature: float = 0.0, seed: int = 0) -> DataFrame:
    """(fen, move, cp): for each distinct position the legal move with the greatest logit, or one drawn at a temperature, repeatable by position and seed.

    Illegal classes take no part. Of a class with several promotions the queen goes first, then knight, rook, bishop. A class that names no legal move falls
    back to the first legal move; no legal move gives null.
    """
    rows = with_scores(positions.select("fen").where("fen is not null").distinct(), model, policy=True).where("value is not null")

    def uniform(c: Column) -> Column:
        """From a hash of position, class and seed."""
        return (F.pmod(F.xxhash64(F.concat_ws("|", "fen", c.cast("string"), F.lit(str(seed)))), F.lit((1 << 52) - 1)) + 1) / float(1 << 52)

    places = F.transform("classes", lambda c, i: i)
    place = scores.drawn_class(F.col("logits"), places, temperature, uniform)
    best = F.get("classes", place)
    turned = F.when(board.field(F.col("fen"), 2) == "b", board.mirror_class(best)).otherwise(best)
    rows = rows.withColumn("class", turned)
    move = F.coalesce(board.move_of_class(F.col("class"), F.col("legal")), F.get("legal", F.lit(0)))
    return rows.select("fen", move.alias("move"), F.when(F.size("legal") > 0, scores.q_cp(F.col("value"))).alias("cp"))


#: How a position stands after a move: the game goes on, or why it does not.
OPEN, MATE, STALEMATE, INSUFFICIENT, FIFTY = "open", "mate", "stalemate", "insufficient", "fifty"
_CHILD_SLICE = 256  # positions whose children are made together: about 9,000 children with 300,000 moves


def children(positions: DataFrame) -> DataFrame:
    """(fen, move, child, state): a row for each legal move of each distinct position, with the position after it and how that stands.

    Hot positions are worked out once: the distinct ones are spread over tasks first. A draw by fifty moves counts from a clock of 100, or of 99 if a move is
    left that neither takes nor moves a pawn.
    """

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, _CHILD_SLICE):
                part = b.slice(s, _CHILD_SLICE).column(0)
                p, at = bitboards.parse(part)
                moves = bitboards.legal_moves(p)
                after = bitboards.play(p, moves)
                replies = bitboards.legal_moves(after)
                n = np.bincount(replies.at, minlength=len(moves.at))
                is_pawn = ((after.own[bitboards.PAWN][replies.at] >> replies.start.astype(bitboards.U)) & bitboards.ONE).astype(bool)
                quiet = np.bincount(replies.at[~replies.takes & ~is_pawn], minlength=len(moves.at))
                state = np.full(len(moves.at), OPEN, object)
                state[(after.half >= 100) | ((after.half == 99) & (quiet > 0))] = FIFTY
                state[bitboards.insufficient(after)] = INSUFFICIENT
                state[n == 0] = np.where(bitboards.in_check(after), MATE, STALEMATE)[n == 0]
                fens = part.take(pa.array(at[moves.at], pa.int64()))
                yield pa.record_batch([fens, bitboards.uci(p, moves), bitboards.write_fen(after), pa.array(state, pa.string())], ["fen", "move", "child", "state"])

    distinct = positions.select(F.col("fen")).where("fen is not null").distinct()
    return distinct.mapInArrow(run, "fen string, move string, child string, state string")


def value_choices(positions: DataFrame, model: Model) -> DataFrame:
    """(fen, move, cp, n_moves): for each distinct position the move after which the other side's value is least.

    A mate is best and counts 100,000, a drawn position 0; of equal moves the first by name is taken. Positions without a legal move, or that are none, have no row.
    """
    rows = with_scores(children(positions), model, fen_col="child")
    q = F.when(F.col("state") == MATE, float("inf")).when(F.col("state") != OPEN, 0.0).otherwise(-F.col("value"))
    best = rows.withColumn("q", q).groupBy("fen").agg(F.min(F.struct((-F.col("q")).alias("minus"), "move")).alias("best"), F.count("*").cast("int").alias("n_moves"))
    minus = F.col("best.minus")
    return best.select("fen", F.col("best.move").alias("move"), F.when(minus == float("-inf"), 100_000).otherwise(scores.q_cp(-minus)).alias("cp"), "n_moves")
