"""Quality by a sparse ensemble of rules over document statistics.

Boosted shallow trees are grown on a bounded sample of labelled rows; every path from a root is a conjunctive rule
over statistics; an L1-penalised logistic regression weighs the rules (Friedman and Popescu, 2008), and the rules
that keep a weight are compiled into one Spark column expression.

Statistics come from whole texts and nothing but the text. The sample holds ``SAMPLE`` rows, chosen by hash.

Defined results: a null or empty text has all statistics 0 and is scored like any other; without labelled rows of
both kinds every score is the share of label 1 (0.5 if there is none). Repeated rows repeat; extra columns are ignored;
an empty table gives no rows. Memory is bounded by a slice of 4 MB of text (or one longer row).
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import residue, salted_hash, slices, table, text_bytes
from .linear import lasso_logistic

SAMPLE, TREES, DEPTH, BINS, RATE, STRENGTH, LEAST_ROWS = 6_000, 60, 3, 24, 0.3, 0.002, 5
CLASSES = ("upper", "lower", "digit", "space", "line", "bang", "bar", "symbol", "point", "high")
RATIOS = tuple(f"{c}_share" for c in CLASSES)
COUNTS = tuple(f"{c}_log" for c in ("bang", "bar", "symbol", "digit", "upper"))
NAMES = (*RATIOS, *COUNTS, "bytes_log", "words_log", "word_mean", "line_mean", "distinct_words", "repeated_share", "repeated_log", "distinct_lines", "upper_of_letters", "longest_word_log")
_CLASS = np.full(256, CLASSES.index("point"), np.uint8)
for _name, _chars in (("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)), ("space", b" \t\r\v\f"), ("line", b"\n"), ("bang", b"!"), ("bar", b"|"), ("symbol", b"#$%&*@^~_=+<>/\\{}[]`"), ("high", range(128, 256))):
    _CLASS[list(_chars)] = CLASSES.index(_name)


def statistics(texts: list[str | None], data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of statistics a text; ``data`` and ``at`` are the bytes of all texts and their offsets."""
    n, k = len(texts), len(CLASSES)
    rows = np.repeat(np.arange(n, dtype=np.int32), np.diff(at))
    counts = np.bincount(rows * np.int32(k) + _CLASS[data], minlength=n * k).reshape(n, k).astype(float)
    size = np.diff(at).astype(float)
    some = np.maximum(size, 1)
    words = np.zeros((n, 6))
    for i, t in enumerate(texts):
        if t:
            w, lines = t.split(), t.split("\n")
            m = max(1, len(w))
            again = sum(map(eq, w, w[1:]))
            words[i] = len(w), len(set(w)) / m, again / m, np.log1p(again), len(set(lines)) / len(lines), np.log1p(max(map(len, w), default=0))
    of = dict(zip(CLASSES, counts.T, strict=True))
    m = np.maximum(words[:, 0], 1)
    return np.column_stack([
        counts / some[:, None],
        *[np.log1p(of[c.removesuffix("_log")]) for c in COUNTS],
        np.log1p(size), np.log1p(words[:, 0]), (size - of["space"] - of["line"]) / m, size / (of["line"] + 1),
        words[:, 1], words[:, 2], words[:, 3], words[:, 4], of["upper"] / np.maximum(of["upper"] + of["lower"], 1), words[:, 5],
    ])


def statistic_rows(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` and one double column a statistic."""
    src = docs.select(*keep, F.col(text_col).cast("string").alias("text__"))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in src.schema.fields[:-1]] + [f"{c} double" for c in NAMES])

    def run(batches):
        for batch in batches:
            for b in slices(batch, "text__"):
                texts = b.column(len(keep))
                x = statistics(texts.to_pylist(), *text_bytes(texts))
                yield pa.record_batch([*b.columns[: len(keep)], *[pa.array(c) for c in x.T]], [*keep, *NAMES])

    return src.mapInArrow(run, schema)


Rule = tuple[tuple[int, bool, float], ...]
"""Conditions (statistic, greater, threshold) that all must hold."""


def _tree(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, path: Rule, features: np.ndarray, rules: list[Rule], out: np.ndarray) -> None:
    """Grow one node: record its path as a rule, split it, or set its leaf value in ``out``."""
    if path:
        rules.append(path)
    g, h = gradient[rows].sum(), hessian[rows].sum()
    best = (1e-6, 0, 0)
    for f in features if len(path) < DEPTH and len(rows) >= 2 * LEAST_ROWS else ():
        m = len(cuts[f])
        b = bins[rows, f]
        gs, hs, ns = (np.cumsum(np.bincount(b, v, m + 1))[:-1] for v in (gradient[rows], hessian[rows], np.ones(len(rows))))
        gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
        gain[(ns < LEAST_ROWS) | (len(rows) - ns < LEAST_ROWS)] = 0
        if m and gain.max() > best[0]:
            best = (float(gain.max()), int(f), int(gain.argmax()))
    if best[0] <= 1e-6:
        out[rows] = g / (h + 1)
        return
    _, f, k = best
    left = bins[rows, f] <= k
    for side, greater in ((rows[left], False), (rows[~left], True)):
        _tree(x, bins, cuts, gradient, hessian, side, (*path, (f, greater, float(cuts[f][k]))), features, rules, out)


def grow_rules(x: np.ndarray, y: np.ndarray, seed: int = 0) -> list[Rule]:
    """The distinct rules of boosted trees, in the order in which they were found."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    cuts = [np.union1d(c, np.quantile(x[y == 0, f], (0.02, 0.98))) for f, c in enumerate(cuts)]
    bins = np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)])
    total, rules = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        out = np.zeros(len(y))
        features = rng.permutation(x.shape[1])[: max(4, x.shape[1] // 2)]
        _tree(x, bins, cuts, y - p, p * (1 - p), np.sort(rng.permutation(len(y))[: max(1, len(y) * 3 // 4)]), (), features, rules, out)
        total += RATE * out
    return list(dict.fromkeys(rules))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, greater, cut in rule:
        out &= (x[:, f] > cut) == greater
    return out


@dataclass
class Model:
    """Weighted rules and a bias."""

    rules: list[tuple[Rule, float]]
    bias: float

    def column(self) -> Column:
        """The score as one Spark expression over the statistics."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            conditions = [F.col(NAMES[f]) > cut if greater else F.col(NAMES[f]) <= cut for f, greater, cut in rule]
            both = conditions[0]
            for c in conditions[1:]:
                both = both & c
            total = total + F.when(both, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def describe(self) -> list[str]:
        """The rules in words, heaviest first."""
        said = lambda r: " and ".join(f"{NAMES[f]} {'>' if g else '<='} {c:.4g}" for f, g, c in r)
        return [f"{w:+.3f} if {said(r)}" for r, w in sorted(self.rules, key=lambda z: -abs(z[1]))]


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on a bounded sample of labelled rows for which ``learnable`` holds."""
    known = labels.where(learnable & F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id__")).agg(F.max(label).cast("int").alias("y__"))
    chosen = known.where(salted_hash(F.lit("quality"), F.col("id__")) < min(1.0, SAMPLE / max(1, known.count())))
    texts = docs.select(F.col(id_col).cast("long").alias("id__"), F.col(text_col).cast("string").alias("text"))
    rows = statistic_rows(texts.join(F.broadcast(chosen), "id__"), ["y__"]).collect()
    data = np.array(sorted(map(tuple, rows)), float).reshape(-1, len(NAMES) + 1)
    x, y = data[:, 1:], (data[:, 0] > 0).astype(float)
    if len(set(y)) < 2:
        share = min(1 - 1e-3, max(1e-3, y.mean())) if len(y) else 0.5
        return Model([], float(np.log(share / (1 - share))))
    rules = [r for r in grow_rules(x, y) if 0 < holds(r, x).mean() < 1]
    weights, bias = lasso_logistic(np.column_stack([holds(r, x) for r in rules]).astype(float), y, STRENGTH)
    return Model([(r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-4], bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text."""
    found = statistic_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"])
    return found.select("doc_id", model.column().alias("score"))


def learnable(doc_id: Column) -> Column:
    return residue(doc_id, 3) != 1


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole document."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels"), learnable(F.col("doc_id"))))
    return found.select("doc_id", (residue(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
