"""Ranked lexical search by a two-level quantised index.

Documents are cut into blocks, each a small inverted index. The exact level has a row for each block and term with the places of the documents in the block,
the term's occurrences and the documents' lengths. The upper level has the same places with one byte each: the document's share of the score, divided by
``STEP`` and rounded up. So a sum over bytes bounds a score from above, and the same sum less ``STEP`` - 1 for each matching term from below.

A search joins the upper level with the items' terms, adds up both bounds inside blocks and leaves the documents whose upper bound reaches the k-th greatest
lower bound of the item, first in the blocks that a task has seen, then among all. Only blocks where some are left read the exact level; every document that is left is
scored in 64-bit integers there, and the k best of each block are ranked. No step drops a document whose score could be among the k best, so results are exact;
how blocks are cut affects speed alone. Items are searched ``ITEMS`` at a time, so what is broadcast is bounded by their terms.

Defined results: a null text, empty text or one without terms is no document of the statistics and is never found; rows are documents, repeated ones too, and
equal scores go by ascending id, rows without an id last; repeated item rows are one item, an item id with several texts is ranked once for each text; an item
without terms, or whose terms no document holds, has no rows; very long texts are one block of their own; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, slices, table, written

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_FOLD = {k: k + 32 for k in range(65, 91)}
SHARE = 1_000_000  # more than the greatest share of a score that a term can have, before its weight
STEP = -(-SHARE // 255)
DOCS, BYTES, ITEMS = 4096, 8 << 20, 512  # documents and bytes of a block, items that are searched together
_LEVEL = "block long, term string, places array<int>, "


def terms(text: str) -> list[str]:
    return TERM.findall(text.translate(_FOLD))


def weight(n_docs: Column, df: Column) -> Column:
    return F.floor(1000 * F.ln((2 * n_docs + 2).cast("double") / (2 * df + 1).cast("double"))).cast("long")


def shares(tf: np.ndarray, length: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """What a term adds to a document's score, before its weight: exact in 64 bits."""
    m = 25 + (75 * length.astype(np.int64) * n_docs) // max(1, total)
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 8 * m)


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The exact level (block, term, places, tfs, lengths), and for the empty term, which no text has, one row a block with the ids of its documents as ``ids``."""

    def block_of(b: pa.RecordBatch, number: int) -> pa.RecordBatch:
        rows = sorted(((d is None, d or 0, t) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t), key=lambda r: r[:2])
        held, place, tf, ids, lengths = [], [], [], [], []
        for none, doc_id, text in rows:
            found = terms(text)
            if found:
                counts = Counter(found)
                held += counts.keys()
                tf += counts.values()
                place.append(len(counts))
                ids.append(None if none else doc_id)
                lengths.append(len(found))
        n = np.array(lengths, np.int64)
        at = np.repeat(np.arange(len(place), dtype=np.int32), place)
        coded = pa.array(held, pa.string()).dictionary_encode()
        code = coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))])
        many, none = len(coded.dictionary), np.zeros(0, np.int64)
        names = pa.concat_arrays([pa.array([""]), coded.dictionary.cast(pa.string())])
        ends = np.concatenate([[0], ends + len(n)])  # the row of the empty term: all documents
        columns = [np.concatenate([np.arange(len(n), dtype=np.int32), at[order]]), np.concatenate([np.zeros(len(n), np.int32), np.array(tf, np.int32)[order]]), np.concatenate([n, n[at[order]]])]
        id_lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.full(many + 1, len(ids))]).astype(np.int32)), pa.array(ids, pa.int64()))
        return pa.record_batch([pa.array(np.full(many + 1, number, np.int64)), names, *[_lists(c, ends) for c in columns], id_lists], ["block", "term", "places", "tfs", "lengths", "ids"])

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", BYTES):
                for s in range(0, part.num_rows, DOCS):
                    yield block_of(part.slice(s, DOCS), number)
                    number += 1

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, _LEVEL + "tfs array<int>, lengths array<long>, ids array<long>")


def bytes_of(exact: DataFrame, n_docs: int, total: int) -> DataFrame:
    """The upper level (block, term, places, impacts): shares divided by ``STEP`` and rounded up, a byte each."""

    def run(batches):
        for b in batches:
            places, tfs, lengths = b.column(2), b.column(3), b.column(4)
            ends = places.offsets.to_numpy()
            x = shares(tfs.flatten().to_numpy(), lengths.flatten().to_numpy(), n_docs, total)
            data = (-(-x // STEP)).astype(np.uint8)
            impacts = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((ends - ends[0]).astype(np.int32)), pa.py_buffer(data)])
            yield pa.record_batch([b.column(0), b.column(1), places, impacts], ["block", "term", "places", "impacts"])

    return exact.select("block", "term", "places", "tfs", "lengths").mapInArrow(run, _LEVEL + "impacts binary")


class Index:
    """Both levels as written tables, with the number of documents and of all their terms."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        held = postings(docs, id_col, text_col)
        self.exact = written(held, "exact")
        facts = self.exact.where("term = ''").agg(F.sum(F.size("places").cast("long")).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l")).first()
        self.n_docs, self.total = facts["n"] or 0, facts["l"] or 0
        self.upper = written(bytes_of(self.exact.where("term != ''"), self.n_docs, self.total), "upper")
        self.ids = self.exact.where("term = ''").select("block", "ids")

    def discard(self) -> None:
        discard(self.exact, self.upper)


def whole_blocks(batches):
    """Tables of whole blocks, from batches in order of blocks."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        block = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), b.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if e > s:
                if held and held[0].column(0)[0].as_py() != block[s]:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held = []
                held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list or binary column and the ends of its rows."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    if pa.types.is_binary(c.type):
        _, offsets, data = c.buffers()
        at = np.frombuffer(offsets, np.int32)[c.offset : c.offset + len(c) + 1]
        return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]
    at = c.offsets.to_numpy()
    return c.flatten().to_numpy(), at - at[0]


def bounds(block: pa.Table, n_items: int, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Greatest and least possible scores, items by documents of the block."""
    (places, ends), (impacts, _), (items, item_ends), (factors, _) = (_flat(block.column(c)) for c in ("places", "impacts", "items", "factors"))
    summed, matched = np.zeros((n_items, n_docs), np.int64), np.zeros((n_items, n_docs), np.int64)
    for r in range(len(block)):
        at, b = places[ends[r] : ends[r + 1]], impacts[ends[r] : ends[r + 1]].astype(np.int64)
        who, factor = items[item_ends[r] : item_ends[r + 1]], factors[item_ends[r] : item_ends[r + 1]]
        here = np.ix_(who, at)
        summed[here] += factor[:, None] * b
        matched[here] += factor[:, None] * (b > 0)
    most = summed * STEP
    return most, most - (STEP - 1) * matched


def reaching(hits: DataFrame, n_items: int, k: int) -> DataFrame:
    """(item, block, places, most, least): documents whose upper bound reaches the k-th lower bound among the blocks of their task so far, and the block's k greatest lower bounds."""

    def run(batches):
        best = np.zeros((n_items, k), np.int64)  # greatest lower bounds of each item
        for block in whole_blocks(batches):
            n_docs = int(_flat(block.column("places"))[0].max()) + 1
            most, least = bounds(block, n_items, n_docs)
            every = np.concatenate([best, least], axis=1)
            best = np.partition(every, every.shape[1] - k, axis=1)[:, -k:]
            floor = np.maximum(best.min(1), 1)
            out = []
            for item in np.flatnonzero((most >= floor[:, None]).any(1)):
                at = np.flatnonzero(most[item] >= floor[item])
                low = np.sort(least[item][at])[-k:]
                out.append((int(item), at.astype(np.int32), most[item][at], low[low > 0]))
            if out:
                number = block.column("block")[0].as_py()
                lists = [pa.array([o[j] for o in out], pa.list_(kind)) for j, kind in ((1, pa.int32()), (2, pa.int64()), (3, pa.int64()))]
                yield pa.record_batch([pa.array([o[0] for o in out], pa.int32()), pa.array([number] * len(out), pa.int64()), *lists], ["item", "block", "places", "most", "least"])

    return hits.mapInArrow(run, "item int, block long, places array<int>, most array<long>, least array<long>")


def rescored(asked: pd.DataFrame, exact: pd.DataFrame, n_docs: int, total: int, k: int) -> pd.DataFrame:
    """(item, block, place, score): the k best of one block for each item, by exact scores of the places that are asked for; ties go to the smaller place."""
    out = []
    if len(asked) and len(exact):
        score = {int(i): np.zeros(int(p.max()) + 1, np.int64) for i, p in zip(asked["item"], asked["places"], strict=True)}
        for at, tf, length, items, factors in zip(exact["places"], exact["tfs"], exact["lengths"], exact["items"], exact["factors"], strict=True):
            x = shares(np.asarray(tf), np.asarray(length), n_docs, total)
            for i, factor in zip(items, factors, strict=True):
                if (s := score.get(int(i))) is not None:
                    inside = np.asarray(at) < len(s)
                    s[np.asarray(at)[inside]] += int(factor) * x[inside]
        for i, p in zip(asked["item"], asked["places"], strict=True):
            s = score[int(i)][p]
            best = np.lexsort((p, -s))[:k]
            out += [(int(i), int(asked["block"].iloc[0]), int(p[j]), int(s[j])) for j in best if s[j] > 0]
    return pd.DataFrame(out, columns=["item", "block", "place", "score"]).astype({"item": "int32", "block": "int64", "place": "int32", "score": "int64"})


def _search(index: Index, asked: DataFrame, n_items: int, k: int) -> DataFrame:
    """(item, doc_id, score), the k best of each block that has any, for at most ``ITEMS`` items; ``asked`` is (item, term, times)."""
    names = F.broadcast(asked.select("term").distinct())
    df = index.upper.join(names, "term").groupBy("term").agg(F.sum(F.size("places").cast("long")).alias("df"))
    factor = (F.col("times") * weight(F.lit(index.n_docs), F.col("df"))).alias("factor")
    by_term = asked.join(df, "term").select("term", "item", factor).where("factor > 0").groupBy("term").agg(F.sort_array(F.collect_list(F.struct("item", "factor"))).alias("all"))
    by_term = written(by_term.select("term", F.col("all.item").alias("items"), F.col("all.factor").alias("factors")), "terms")
    n = int(index.upper.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hits = index.upper.join(F.broadcast(by_term), "term").select("block", "places", "impacts", "items", "factors").repartition(n, "block").sortWithinPartitions("block")
    found = written(reaching(hits, n_items, k), "reaching")
    lows = found.select("item", F.explode("least").alias("low"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low")))
    floors = lows.withColumn("r", rank).where(F.col("r") <= k).groupBy("item").agg(F.min("low").alias("low"), F.count("*").alias("n"))
    floors = floors.select("item", F.when(F.col("n") == k, F.col("low")).otherwise(1).alias("floor"))  # one row an item
    met = found.join(F.broadcast(floors), "item").withColumn("kept", F.filter("places", lambda p, i: F.get("most", i) >= F.col("floor")))
    kept = met.where(F.size("kept") > 0).join(index.ids, "block").select("item", "block", F.col("kept").alias("places"), F.transform("kept", lambda p: F.get("ids", p)).alias("ids"))
    kept = written(kept, "kept")
    exact = index.exact.where("term != ''").join(F.broadcast(by_term), "term").join(kept.select("block").distinct(), "block", "left_semi")
    exact = exact.select("block", "places", "tfs", "lengths", "items", "factors")
    n_docs, total = index.n_docs, index.total
    run = lambda a, b: rescored(a, b, n_docs, total, k)
    scored = kept.select("item", "block", "places").groupBy("block").cogroup(exact.groupBy("block")).applyInPandas(run, "item int, block long, place int, score long")
    doc_id = F.get("ids", (F.array_position("places", F.col("place")) - 1).cast("int"))
    out = written(scored.join(kept, ["item", "block"]).select("item", doc_id.alias("doc_id"), "score"), "scored")
    discard(by_term, found, kept)
    return out


def search(index: Index, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of the index for each item, as a written table."""

    @F.pandas_udf("array<string>")
    def said(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: terms(t) if t else [])

    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    rows = written(rows.withColumn("said", said("text")).where(F.size("said") > 0).withColumn("number", F.monotonically_increasing_id()).drop("text"), "items")
    groups = max(1, -(-rows.count() // (ITEMS // 2)))
    parts = []
    for g in range(groups):
        some = written(rows.where(F.pmod(F.xxhash64("number"), F.lit(groups)) == g) if groups > 1 else rows, "some-items")
        known = [r["number"] for r in some.select("number").orderBy("number").collect()]  # the numbers of one group of items
        for s in range(0, len(known), ITEMS):
            own = {number: at for at, number in enumerate(known[s : s + ITEMS])}
            at = F.element_at(F.create_map(*[F.lit(x) for pair in own.items() for x in pair]), F.col("number"))
            here = written(some.where(F.col("number").isin(list(own))).select(at.cast("int").alias("item"), "item_id", "said"), "here")
            asked = here.select("item", F.explode("said").alias("term")).groupBy("item", "term").agg(F.count("*").alias("times"))
            asked = written(asked, "asked")
            best = _search(index, asked, len(own), k)
            order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
            ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
            parts.append(written(ranked.join(F.broadcast(here.select("item", "item_id")), "item").select("item_id", "rank", "doc_id", "score"), "found"))
            discard(best, asked, here)
        discard(some)
    if not parts:
        return rows.select("item_id", F.lit(0).alias("rank"), F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    return reduce(DataFrame.unionByName, parts)


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    index = Index(table(spark, sf_dir, "documents"))
    found = search(index, table(spark, sf_dir, "benchmark"))
    index.discard()
    return found


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP12_SQL = f"""WITH d AS (SELECT doc_id, {_TERMS} AS terms FROM documents), f AS (SELECT count(*) AS n_docs, sum(len(terms)) AS total FROM d WHERE len(terms) > 0),
p AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, unnest(terms) AS term, len(terms) AS n FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, f GROUP BY term),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // total)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term), f GROUP BY ALL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""
