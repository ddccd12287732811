"""Scores as column expressions. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scale of centipawns, value of a forced mate.
CP_SCALE, MATE_Q = 0.00368208, 0.9999


def black_to_move(fen: Column) -> Column:
    return F.split_part(fen, F.lit(" "), F.lit(2)) == "b"


def win_q(cp: Column) -> Column:
    return 2 / (1 + F.exp(-CP_SCALE * cp)) - 1


def eval_q(cp: Column, mate: Column, fen: Column) -> Column:
    """Expected result in [-1, 1] for the side to move of a White-view score; a mate decides; null without a score."""
    q = F.when(mate.isNotNull(), F.when(mate > 0, MATE_Q).otherwise(-MATE_Q)).when(cp.isNotNull(), win_q(cp))
    return F.when(black_to_move(fen), -q).otherwise(q) + 0.0


def move_q(cp: Column, mate: Column) -> Column:
    """As ``eval_q`` for a score that is the mover's already; 0 without a score."""
    return F.coalesce(F.when(mate.isNotNull(), F.when(mate > 0, MATE_Q).otherwise(-MATE_Q)).otherwise(win_q(cp)), F.lit(0.0)) + 0.0


def side_view(value: Column, fen: Column) -> Column:
    """A White-view number from the side to move."""
    return F.when(black_to_move(fen), -value).otherwise(value)


def wdl(q: Column, draw_max: float = 0.5) -> Column:
    """Win, draw and loss shares with win - loss = q."""
    draw = draw_max * (1 - F.abs(q))
    return F.struct(((1 - draw + q) / 2).alias("win"), draw.alias("draw"), ((1 - draw - q) / 2).alias("loss"))


def q_cp(q: Column) -> Column:
    """Centipawns of an expected result, rounded half to even."""
    p = F.greatest(F.least((q + 1) / 2, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.bround(F.ln(p / (1 - p)) / CP_SCALE).cast("int")


def soft_policy(q: Column, temperature: float = 0.1) -> Column:
    """Softmax of an array of expected results."""
    t = max(temperature, 1e-6)
    e = F.transform(q, lambda x: F.exp((x - F.array_max(q)) / t))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def points_lost(best: Column, chosen: Column) -> Column:
    """Win-percentage points that a move gives away."""
    return (best - chosen) * 50


def log_sum_exp(logits: Column) -> Column:
    """ln of the summed exponentials of an array; impossible entries are -Infinity."""
    most = F.array_max(logits)
    return most + F.ln(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - most)))


def cross_entropy(logits: Column, target: Column) -> Column:
    """Loss against one class, counted from 0."""
    return log_sum_exp(logits) - F.get(logits, target.cast("int"))


def soft_cross_entropy(logits: Column, target: Column) -> Column:
    """Loss against shares of classes; a class without a share counts nothing, even if it is impossible."""
    terms = F.zip_with(logits, target, lambda x, t: F.when(t > 0, t * (log_sum_exp(logits) - x)).otherwise(0.0))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def size_loss(logits: Column, weight: float = 1e-3) -> Column:
    """The term that keeps logits from growing."""
    return weight * F.pow(log_sum_exp(logits), 2)


def wdl_cross_entropy(logits: Column, target: Column) -> Column:
    """Loss of three logits against (win, draw, loss) shares."""
    return F.aggregate(F.zip_with(logits, target, lambda x, t: t * (log_sum_exp(logits) - x)), F.lit(0.0), lambda a, x: a + x)


def total_loss(policy: Column, wdl_loss: Column, value: Column, size: Column, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> Column:
    """Weighted sum of the policy, result and value losses and the size term."""
    return weights[0] * policy + weights[1] * wdl_loss + weights[2] * value + size


def first_greatest(values: Column) -> Column:
    """Place of the first greatest entry, counted from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def ordered_classes(logits: Column, legal: Column, width: int = 0) -> Column:
    """Legal classes by falling logit (ties: in the order given), at most ``width`` of them (0: all)."""
    keyed = F.transform(legal, lambda c, i: F.struct((-F.get(logits, c)).alias("m"), i.alias("i"), c.alias("c")))
    ordered = F.transform(F.array_sort(keyed), lambda s: s["c"])
    return F.slice(ordered, 1, width) if width > 0 else ordered


def drawn_class(logits: Column, legal: Column, temperature: float, uniform: Callable[[Column], Column]) -> Column:
    """A legal class drawn with chances softmax(logit / temperature), by the greatest logit plus Gumbel noise; without a temperature the first greatest.

    ``uniform`` gives a number in (0, 1) for a class, for example from a hash of the row and a seed, so that a task that runs again draws the same.
    """
    noise = (lambda c: -F.ln(-F.ln(uniform(c)))) if temperature > 1e-6 else (lambda c: F.lit(0.0))
    scale = temperature if temperature > 1e-6 else 1.0
    keyed = F.transform(legal, lambda c, i: F.struct((-(F.get(logits, c) / scale + noise(c))).alias("m"), i.alias("i"), c.alias("c")))
    return F.get(F.array_sort(keyed), F.lit(0))["c"]


def learning_rate(step: Column, warmup: int, total: int, least: float) -> Column:
    """Share of the full rate: a linear rise, then half a cosine down to ``least``."""
    done = F.least(F.lit(1.0), (step - warmup) / max(1, total - warmup))
    return F.when(step < warmup, (step + 1) / max(1, warmup)).otherwise(least + (1.0 - least) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * done)))


def clock_budget(remaining_ms: Column, increment_ms: Column, moves_to_go: Column, overhead_ms: int = 100) -> Column:
    """Seconds for a move: an even share and four fifths of the increment, at most two fifths of the clock, less the overhead."""
    moves = F.greatest(F.lit(1), F.least(F.coalesce(moves_to_go, F.lit(30)), F.lit(40)))
    share = F.least(remaining_ms / moves + 0.8 * F.coalesce(increment_ms, F.lit(0)), 0.4 * remaining_ms)
    return F.greatest(F.lit(0.02), (share - overhead_ms) / 1000)
