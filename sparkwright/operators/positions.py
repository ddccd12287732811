"""DataFrame operators on evaluations: deepest row a position, packed variations, split, sample, resume, report, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import board, scores
from . import legality


def split_hash(key: Column, salt: str) -> Column:
    """60 bits of an md5 that every engine computes alike; the salt keeps it apart from any partitioning."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}|"), key).cast("binary")), 1, 15), 16, 10).cast("bigint")


def is_validation(fen: Column, modulus: int = 50) -> Column:
    return split_hash(fen, "split") % modulus == 0


def deepest(raw: DataFrame, tie: str = "event_id") -> DataFrame:
    """The deepest row of each position with all its columns (then most nodes, best score for the side to move, least line).

    The rank is cut to 1 before the shuffle as well as after it, so a hot position moves one row a task.
    """
    q = scores.eval_q(F.col("cp"), F.col("mate"), F.col("fen"))
    order = [F.col("depth").desc_nulls_last(), F.coalesce("knodes", F.lit(0)).desc(), q.desc_nulls_last(), F.col("line").asc_nulls_last(), F.col(tie)]
    return raw.withColumn("__rank", F.row_number().over(Window.partitionBy("fen").orderBy(*order))).where("__rank = 1").drop("__rank")


def best_per_position(raw: DataFrame, least_depth: int = 12, tie: str = "event_id") -> DataFrame:
    """``deepest`` rows of a least depth (0: any), with their split."""
    best = deepest(raw, tie)
    kept = best.where(F.col("depth") >= least_depth) if least_depth else best
    return kept.select("fen", "line", "cp", "mate", "depth", "knodes", is_validation(F.col("fen")).alias("is_val"))


def action_values(raw: DataFrame, least_moves: int = 1, tie: str = "event_id") -> DataFrame:
    """One row a position: moves and scores (side to move) of its richest search, best first.

    Searches are counted with partial aggregation and the richest of each position is chosen from the counts; only rows of chosen searches are packed.
    """
    fen = F.col("fen")
    rows = raw.where((F.length("line") > 0) & fen.isNotNull())
    order = [F.desc("n_moves"), F.col("depth").desc_nulls_last(), F.col("knodes").desc_nulls_last()]
    counts = rows.groupBy("fen", "depth", "knodes").agg(F.count("*").alias("n_moves"))
    chosen = counts.withColumn("r", F.row_number().over(Window.partitionBy("fen").orderBy(*order))).where((F.col("r") == 1) & (F.col("n_moves") >= least_moves))
    chosen = chosen.select(fen, F.col("depth").alias("__depth"), F.col("knodes").alias("__knodes"))
    of_chosen = rows.join(chosen, (rows.fen == chosen.fen) & F.col("depth").eqNullSafe(F.col("__depth")) & F.col("knodes").eqNullSafe(F.col("__knodes")), "left_semi")
    cp, mate = scores.side_view(F.col("cp"), fen), scores.side_view(F.col("mate"), fen)
    q = scores.eval_q(F.col("cp"), F.col("mate"), fen)
    one = F.struct(q.isNull().alias("none"), (-q + 0.0).alias("minus_q"), board.first_move(F.col("line")).alias("move"), F.col(tie).alias("tie"), cp.alias("cp"), mate.alias("mate"))
    packed = of_chosen.groupBy("fen").agg(F.sort_array(F.collect_list(one)).alias("all"), F.any_value("depth").alias("depth"))
    part = lambda name: F.transform("all", lambda x: x[name]).alias({"move": "moves"}.get(name, name))
    return packed.select("fen", part("move"), part("cp"), part("mate"), "depth", is_validation(fen).alias("is_val"))


def sample_positions(raw: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` distinct positions by the order of a seeded hash: the same ones whatever the partitions."""
    return raw.select("fen").where("fen is not null").distinct().orderBy(F.md5(F.concat(F.col("fen"), F.lit(f"|{seed}")).cast("binary")), "fen").limit(n)


def resume(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Positions of ``wanted`` that are not in ``done``."""
    return wanted.join(done.select("fen"), "fen", "left_anti")


def report(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """One row: rows before and after, and shares kept and held for validation."""
    a = raw.agg(F.count("*").alias("n_raw"), F.count_if(F.length("line") > 0).alias("n_lines"))
    b = clean.agg(F.count("*").alias("n_clean"), F.count_if("is_val").alias("n_val"))
    share = lambda x, y: F.round(F.coalesce(F.try_divide(100.0 * F.col(x), F.col(y)), F.lit(0.0)), 6)
    return a.join(b).select("n_raw", "n_lines", "n_clean", "n_val", share("n_clean", "n_raw").alias("kept_pct"), share("n_val", "n_clean").alias("val_pct"))


def in_split(rows: DataFrame, validation: bool) -> DataFrame:
    """Rows of one side of the split; a row without a mark is for training."""
    return rows.where(F.coalesce("is_val", F.lit(False)) == validation)


def deep_enough(raw: DataFrame, least_depth: int) -> DataFrame:
    """Rows of a least depth when they are read (a null depth counts as 0; 0 keeps all)."""
    return raw.where(F.coalesce("depth", F.lit(0)) >= least_depth) if least_depth else raw


def first_rows(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows by the order of a seeded hash of their position, before any check of validity."""
    return rows.orderBy(F.md5(F.concat(F.col("fen"), F.lit(f"|{seed}")).cast("binary")), "fen").limit(n) if n else rows


def shuffled(rows: DataFrame, seed: int) -> DataFrame:
    """All rows in an order that a seed gives: a whole shuffle, not one of a buffer."""
    return rows.orderBy(F.rand(seed))


def policy_targets(values: DataFrame, temperature: float = 0.1) -> DataFrame:
    """(fen, class, weight): soft targets of move classes; promotions to one square add up. Bad and illegal moves go before weights are made."""
    packed = legality.keep_legal_moves(values).withColumn("q", F.transform(F.arrays_zip("cp", "mate"), lambda z: scores.move_q(z["cp"], z["mate"])))
    weights = packed.withColumn("w", scores.soft_policy(F.col("q"), temperature))
    rows = weights.select("fen", F.explode(F.arrays_zip("classes", "w")).alias("z")).select("fen", F.col("z.classes").alias("class"), F.col("z.w").alias("w"))
    return rows.groupBy("fen", "class").agg(F.sum("w").alias("weight"))


def move_metrics(predictions: DataFrame, blunder: float = 10.0) -> DataFrame:
    """One row of rates over (q list, classes list, top5 list best first, value): top-1, top-5, points lost, off the list, blunders, value error."""
    best_at = F.array_position("q", F.array_max("q"))
    best = F.element_at("classes", best_at.cast("int"))
    at = F.array_position("classes", F.get("top5", F.lit(0)))
    on = at > 0
    lost = F.when(on, scores.points_lost(F.array_max("q"), F.get("q", (at - 1).cast("int"))))
    rate = lambda c: F.round(F.coalesce(F.avg(c.cast("double")), F.lit(0.0)), 6)
    rows = predictions.select(best.alias("best"), on.alias("on"), lost.alias("lost"), "top5", F.pow(F.col("value") - F.array_max("q"), 2).alias("error"))
    return rows.agg(
        F.count("*").alias("n"),
        rate(F.get("top5", F.lit(0)) == F.col("best")).alias("top1"),
        rate(F.array_contains("top5", F.col("best"))).alias("top5"),
        rate(F.col("lost")).alias("points_lost"),
        rate(~F.col("on")).alias("off_list"),
        rate(~F.col("on") | (F.col("lost") > blunder)).alias("blunders"),
        rate(F.col("error")).alias("value_mse"),
    )
