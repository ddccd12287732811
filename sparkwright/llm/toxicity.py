"""Toxicity by maximum-scoring segments of token log-odds.

A token is a word (lower case) or, for a word without a score of its own, its longest scored prefix of 8 to 4 characters. Each
token's log-odds between toxic and other documents have a Dirichlet prior in proportion to the token's share of
all documents of the sample (Monroe et al., 2008); tokens with significant (z) and large log-odds keep them, all others
have the small negative score ``BACKGROUND``. A linear-time scan finds all maximal-scoring segments
(Ruzzo and Tompa, 1999). A segment of score s in a text of n tokens is expected E = K n exp(-lambda s) times by chance (Karlin and
Altschul, 1990): lambda solves sum p exp(lambda s) = 1, and K is the greatest-likelihood location of the Gumbel law of the best segments of
harmless texts of the sample, texts without a segment counting as censored. Every segment with E < 1 is significant; those of a text are taken together by
the sum statistic (Karlin and Altschul, 1993), and a logistic regression over its -ln P and the text's length calibrates the score.

The model is fitted on a bounded sample of labelled rows (``SAMPLE``, by hash); all significant tokens of it are kept, at least three of its toxic texts hold each.
Scores read whole texts and nothing but the text.

Defined results: a null or empty text has no segment; without labelled rows of both kinds every score is 0. Repeated
rows repeat; extra columns are kept by the filter and ignored otherwise; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, residue, salted_hash, slices, table, written
from .linear import logistic

SAMPLE, PREFIXES = 8_000, (8, 7, 6, 5, 4)
PRIOR_FLOOR, PRIOR_TOKENS, LEAST_Z, LEAST_ODDS, BACKGROUND = 0.5, 200.0, 3.3, 3.0, -0.3
CACHE = 200_000
_WORD = re.compile(r"[^\W\d_]+")


def tokens_of(word: str) -> list[str]:
    """The word and its prefixes, longest first; prefixes end in ``*``."""
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) > n]]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a sequence, in linear time.

    Only positive tokens are visited: the others count by the running total.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    held: list[tuple[int, int, float, float]] = []  # start, end, total before, total after
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, left, right = i, i + 1, float(total[i]), float(total[i + 1])
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= left:
                j -= 1
            if j < 0 or held[j][3] >= right:
                held.append((start, end, left, right))
                break
            start, left = held[j][0], held[j][2]
            del held[j:]
    return [(a, b, r - x) for a, b, x, r in held]


@dataclass
class Model:
    """Log-odds of significant tokens and the calibrated extreme-value law."""

    scores: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0
    place: float = 1.0  # K
    law: tuple[float, float, float] = (0.0, 0.0, -30.0)

    def __post_init__(self):
        self._known: dict[str, float] = {}

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens and maximal segments of a whole text."""
        words, known = _WORD.findall(text.lower()) if text else [], self._known
        if len(known) > CACHE:
            known.clear()
        for w in [w for w in set(words) if w not in known]:
            known[w] = next((self.scores[t] for t in tokens_of(w) if t in self.scores), BACKGROUND)
        scores = np.fromiter(map(known.__getitem__, words), float, len(words))
        return len(words), segments(scores) if len(words) and scores.max() > 0 else []

    def surplus(self, n: int, segment_score: float) -> float:
        """-ln E of a segment in a text of ``n`` tokens: significant if it is positive."""
        return self.rate * segment_score - math.log(self.place * max(1, n))

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> tuple[float, float]:
        """-ln P of the significant segments together, and the log of the number of tokens."""
        best, total = 0.0, 0.0
        for r, x in enumerate(sorted((x for _, _, s in found if (x := self.surplus(n, s)) > 0), reverse=True), 1):
            total += x
            # P of r segments with surpluses of this sum; ln 2 a segment for the choice of r.
            best = max(best, total - (r - 1) * math.log(max(total, 1.0)) + math.lgamma(r + 1) + math.lgamma(r) - (r - 1) * math.log(2))
        return best, math.log(n + 1)

    def score(self, n: int, found: list[tuple[int, int, float]]) -> float:
        """Probability that a text of ``n`` tokens with these segments is toxic."""
        x, n = self.evidence(n, found)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.law[0] * x + self.law[1] * n + self.law[2])))) if self.scores else 0.0


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on a bounded sample of labelled rows for which ``learnable`` holds."""
    known = labels.where(learnable & F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label).cast("int").alias("y"))
    n = known.count()
    chosen = known.where(salted_hash(F.lit("toxicity"), F.col("id")) < min(1.0, SAMPLE / max(1, n)))
    sample = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id").select("text", "y")

    def count(batches):
        seen: Counter[tuple[str, int]] = Counter()
        texts: Counter[int] = Counter()

        def flush():
            keys = sorted({t for t, _ in seen})
            yield pa.record_batch([pa.array([*keys, ""], pa.string()), *[pa.array([*[seen[t, y] for t in keys], texts[y]], pa.int64()) for y in (0, 1)]], ["token", "n0", "n1"])
            seen.clear()
            texts.clear()

        for batch in batches:
            for b in slices(batch, "text"):
                for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    y = int(y > 0)
                    seen.update((k, y) for k in {k for w in set(_WORD.findall(t.lower())) for k in tokens_of(w)})
                    texts[y] += 1
                if len(seen) > 400_000:
                    yield from flush()
        yield from flush()

    counted = written(sample.mapInArrow(count, "token string, n0 long, n1 long").groupBy("token").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "tokens")
    sums = counted.groupBy(F.when(F.col("token") == "", 0).when(F.col("token").endswith("*"), F.length("token")).otherwise(1).alias("kind"))
    totals = {r["kind"]: (r["n0"], r["n1"]) for r in sums.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).collect()}
    n0, n1 = totals.get(0, (0, 0))
    model = Model()
    if n0 and n1:
        kind = F.when(F.col("token").endswith("*"), F.length("token")).otherwise(1)
        of = lambda k: F.coalesce(*[F.when(kind == i, float(t[k])) for i, t in totals.items() if i])
        a = F.lit(PRIOR_FLOOR) + PRIOR_TOKENS * (F.col("n0") + F.col("n1")) / (of(0) + of(1))
        mass = F.lit(2 * PRIOR_TOKENS)
        odds = lambda c, k: F.ln((F.col(c) + a) / (of(k) + mass - F.col(c) - a))
        delta = odds("n1", 1) - odds("n0", 0)
        z = delta / F.sqrt(1 / (F.col("n1") + a) + 1 / (F.col("n0") + a))
        best = counted.where((F.col("token") != "") & (F.col("n1") >= 3)).withColumn("delta", delta).withColumn("z", z).where((F.col("z") > LEAST_Z) & (F.col("delta") > LEAST_ODDS)).select("token", "delta", "n0").collect()
        model.scores = {r["token"]: r["delta"] for r in best}
        shares = np.array([(r["n0"] + PRIOR_FLOOR) / (totals[1][0] + 1) for r in best])
        model.rate = karlin_rate(shares, np.array([r["delta"] for r in best]), BACKGROUND)
        tops = sorted((r["n"], r["s"], r["y"] > 0) for r in sample.mapInArrow(lambda batches: _tops(model, batches), "n long, s array<double>, y int").collect())
        clean = [(n, max(s, default=0.0)) for n, s, y in tops if not y and n]
        model.place = max(1, sum(s > 0 for _, s in clean)) / max(1e-9, sum(n * math.exp(-model.rate * s) for n, s in clean))
        e = np.array([(*model.evidence(n, [(0, 0, x) for x in s]), y) for n, s, y in tops], float).reshape(-1, 3)
        if len(best) and 0 < e[:, 2].sum() < len(e):
            model.law = tuple(map(float, logistic(e[:, :2], e[:, 2])))
    discard(counted)
    return model


def karlin_rate(shares: np.ndarray, scores: np.ndarray, background: float) -> float:
    """The positive lambda with sum p exp(lambda s) = 1; 1 if the expected score is not negative."""
    rest = max(0.0, 1 - shares.sum())
    if not len(scores) or (shares * scores).sum() + rest * background >= 0:
        return 1.0
    low, high = 0.0, 1.0
    excess = lambda r: (shares * np.exp(np.minimum(r * scores, 700))).sum() + rest * math.exp(r * background) - 1
    while excess(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return max(high, 1e-3)


def _tops(model: Model, batches):
    """Number of tokens, scores of all segments and label of each text of the sample."""
    for batch in batches:
        for b in slices(batch, "text"):
            found = [model.scan(t) for t in b.column(0).to_pylist()]
            yield pa.record_batch([pa.array([n for n, _ in found], pa.int64()), pa.array([[x for *_, x in f] for _, f in found], pa.list_(pa.float64())), b.column(1).cast(pa.int32())], ["n", "s", "y"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, segments) of every whole text; segments are word intervals with their scores and -ln E (significant if positive)."""
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("surplus", pa.float64())]))

    def run(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                found = [model.scan(t) for t in b.column(1).to_pylist()]
                rows = [[{"start": s, "end": e, "score": x, "surplus": model.surplus(n, x)} for s, e, x in f] for n, f in found]
                yield pa.record_batch([b.column(0), pa.array([model.score(*f) for f in found], pa.float64()), pa.array(rows, spans)], ["doc_id", "score", "segments"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, segments array<struct<start:int,end:int,score:double,surplus:double>>")


def keep_harmless(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows, with all their columns, that score under ``threshold``."""
    def run(batches):
        for batch in batches:
            for b in slices(batch, text_col):
                texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
                yield b.filter(pa.array([model.score(*model.scan(t)) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learnable(doc_id: Column) -> Column:
    return residue(doc_id, 5) != 0


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels"), learnable(F.col("doc_id"))))
    return found.select("doc_id", (residue(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size(F.filter("segments", lambda x: x["surplus"] > 0)).alias("n_segments"))
