"""Language identification in two levels: first the language family, then the language within it.

Texts become hashed byte bigrams and trigrams (square roots of counts, unit length). At both levels one linear
support vector machine per pair of classes votes; ties and the score use the margins. The machines are fitted on a
bounded sample of labelled rows: at most ``SAMPLE`` rows in all, shared equally by the ``CLASSES`` commonest languages, chosen by a
hash of the row. The driver gets one row a chosen language, the model one machine a pair of classes of a level. Predictions read whole texts and nothing but the text.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text when no
language has ``LEAST_ROWS`` labelled rows. Repeated rows repeat; extra columns are kept by the filter and ignored otherwise; an empty
table gives no rows. Memory is bounded by a slice of 4 MB (or one longer row) and 250 feature vectors; the fit's by the features of its sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import residue, salted_hash, slices, table, text_bytes
from .linear import sparse_svm

SIZE, ROWS, SAMPLE, WINDOW = 4096, 250, 4000, 90
CLASSES, LEAST_ROWS = 100, 2  # languages that are told apart, and the learnable rows that one needs
SENT = ["lang", "whole_places", "whole_values", "part_places", "part_values"]
UNDETERMINED, LEAST_SCORE = "und", 0.2
#: Families of languages by ISO 639-1 code; a code that is not here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu se",
    "turkic": "az kk ky tk tr tt ug uz",
    "indo-aryan": "as bn gu hi mr ne or pa sa sd si ur",
    "iranian": "fa ku ps tg",
    "semitic": "am ar he mt ti",
    "celtic": "br cy ga gd kw",
    "dravidian": "kn ml ta te",
    "sinitic": "zh",
    "austronesian": "id jv mg ms su tl",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123], _FOLD[65:91], _FOLD[128:] = np.arange(97, 123), np.arange(97, 123), np.arange(128, 256)
_LETTER = regex.compile(r"\p{L}")


def vectors(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Unit feature vectors of texts: ``data[at[i]:at[i + 1]]`` is text ``i``."""
    folded = _FOLD[data].astype(np.uint32)
    out = np.zeros((len(at) - 1, SIZE), np.float32)
    pairs = folded[:-1] << 8 | folded[1:]
    triples = pairs[:-1] << 8 | folded[2:]
    mix = lambda x: (x * np.uint32(2654435761)) >> np.uint32(20)  # noqa: E731  12 bits
    pairs, triples = mix(pairs + np.uint32(1)), mix(triples + np.uint32(77_777_777))
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        if b - a > 1:
            out[i] = np.bincount(pairs[a : b - 1], minlength=SIZE)
        if b - a > 2:
            out[i] += np.bincount(triples[a : b - 2], minlength=SIZE)
    np.sqrt(out, out=out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def packed(x: np.ndarray) -> tuple[bytes, bytes]:
    """Places and half-precision values of a vector's features: an eighth of its cells or so."""
    places = np.flatnonzero(x)
    return places.astype(np.uint16).tobytes(), x[places].astype(np.float16).tobytes()


@dataclass
class Model:
    """Families, their languages, and the machines of both levels as one matrix."""

    families: list[str]
    members: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray

    def _choose(self, classes: list[str], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner by votes, then margins; and how sure that is."""
        if len(classes) == 1:
            return np.zeros(len(margins), int), np.ones(len(margins))
        place = {p: k for k, p in enumerate(self.pairs)}
        votes, sums = np.zeros((len(margins), len(classes))), np.zeros((len(margins), len(classes)))
        least = np.full((len(margins), len(classes)), 30.0)
        for i, a in enumerate(classes):
            for j in range(i + 1, len(classes)):
                m = margins[:, place[a, classes[j]]]
                for k, s in ((i, m), (j, -m)):
                    votes[:, k] += s > 0
                    sums[:, k] += np.tanh(s)
                    least[:, k] = np.minimum(least[:, k], s)
        best = np.argmax(votes + sums / (2 * len(classes)), axis=1)
        return best, 1 / (1 + np.exp(-3 * np.clip(least[np.arange(len(best)), best], -10, 10)))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1]
        family, sure = self._choose(self.families, margins)
        langs, score = np.empty(len(x), object), sure.astype(float)
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(family == k)
            if len(rows):
                best, within = self._choose(self.members[f], margins[rows])
                langs[rows] = np.array(self.members[f], object)[best]
                score[rows] *= within
        return langs.tolist(), score


def fit(docs: DataFrame, learnable: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model | None:
    """Fit on a bounded sample of rows for which ``learnable`` holds and the language is not null: the ``CLASSES`` commonest languages of at least
    ``LEAST_ROWS`` such rows (ties by name), ``SAMPLE`` rows in all. Other languages are never predicted."""
    src = docs.where(learnable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"))
    counted = src.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_ROWS).orderBy(F.desc("n"), "lang").limit(CLASSES)
    counts = [(r["lang"], r["n"]) for r in counted.collect()]
    if not counts:
        return None
    each = SAMPLE // len(counts)
    chosen = docs.sparkSession.createDataFrame([(k, min(1.0, each / n)) for k, n in counts], "lang string, share double")
    drawn = src.withColumn("drawn", salted_hash(F.lit("language"), "text", "id")).join(F.broadcast(chosen), "lang").where("drawn < share")
    order = Window.partitionBy("lang").orderBy("drawn", "text", "id")  # of the few rows drawn, never more than a language's part
    sample = drawn.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= each).select("text", "lang")

    def run(batches):
        for batch in batches:
            for whole in slices(batch, "text"):
                for k in range(0, whole.num_rows, ROWS):
                    b = whole.slice(k, ROWS)
                    data, at = text_bytes(b.column(0))
                    middle = np.maximum(at[:-1], (at[:-1] + at[1:] - WINDOW) // 2)
                    cut = [data[a : min(a + WINDOW, e)] for a, e in zip(middle, at[1:], strict=True)]
                    short = vectors(np.concatenate(cut) if cut else data[:0], np.cumsum([0, *map(len, cut)]))
                    yield pa.record_batch([b.column(1), *[pa.array(c, pa.binary()) for x in (vectors(data, at), short) for c in zip(*map(packed, x), strict=True)]], SENT)

    sent = sample.mapInArrow(run, "lang string, " + ", ".join(f"{k} binary" for k in SENT[1:])).toArrow()
    if not sent.num_rows:
        return None
    sent = sent.sort_by([(k, "ascending") for k in SENT])  # the fit does not depend on partitions
    lang = np.array(sent.column(0).to_pylist() * 2, object)
    places, values = ([np.frombuffer(r.as_py(), t) for k in ks for r in sent.column(k)] for ks, t in (((1, 3), np.uint16), ((2, 4), np.float16)))
    del sent
    at = np.cumsum([0, *map(len, places)])
    places, values = np.concatenate(places), np.concatenate(values)
    langs = sorted(set(lang))
    family = np.array([FAMILY_OF.get(k, k) for k in lang], object)
    families = sorted(set(family))
    members = {f: [k for k in langs if FAMILY_OF.get(k, k) == f] for f in families}
    pairs, weights = [], []
    for classes, of in [(families, family), *[(members[f], lang) for f in families]]:
        for i, a in enumerate(classes):
            for b in classes[i + 1 :]:
                held = np.flatnonzero((of == a) | (of == b))
                pairs.append((a, b))
                weights.append(sparse_svm(at, places, values, SIZE, held, np.where(of[held] == a, 1, -1)))
    return Model(families, members, pairs, np.array(weights, np.float32).reshape(len(pairs), SIZE + 1))


def _predictions(model: Model | None, b: pa.RecordBatch, column: int) -> tuple[list[str], np.ndarray]:
    """Language and score of each row of a slice."""
    langs, scores = [UNDETERMINED] * b.num_rows, np.zeros(b.num_rows)
    known = np.array([bool(t) and _LETTER.search(t) is not None for t in b.column(column).to_pylist()], bool)
    for k in range(0, b.num_rows, ROWS) if model else ():
        rows = np.flatnonzero(known[k : k + ROWS]) + k
        if len(rows):
            data, at = text_bytes(b.column(column).take(pa.array(rows)))
            found, sure = model.predict(vectors(data, at))
            scores[rows] = sure
            for r, f in zip(rows, found, strict=True):
                langs[r] = f
    return langs, scores


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    def run(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                langs, scores = _predictions(model, b, 1)
                yield pa.record_batch([b.column(0), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows, with all their columns, whose language is determined with a score of at least ``least``."""
    def run(batches):
        for batch in batches:
            for b in slices(batch, text_col):
                langs, scores = _predictions(model, b, b.schema.get_field_index(text_col))
                yield b.filter(pa.array([k != UNDETERMINED and s >= least for k, s in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learnable(doc_id: Column) -> Column:
    return residue(doc_id, 3) != 1


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole document."""
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs, learnable(F.col("doc_id"))))
    return found.select("doc_id", (residue(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
