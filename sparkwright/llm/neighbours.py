"""Approximate nearest neighbours by a permutation index.

Pivots are at most ``PIVOTS`` vectors that lie apart, from a sample of ``SAMPLE`` vectors chosen by hash. A vector is represented by its ``PREFIX`` nearest
pivots in order; each data block posts its vectors in one inverted file a pivot, with the pivot's place. A query adds up, over
its own pivots' files, what shared pivots save of the footrule distance; the best ``SHARE`` of a block (``LEAST`` times the answer's length at least, so
that a small block can fill an answer) are reranked by the exact cosine in double precision. Every row is indexed; queries meet data in blocks of bounded size.

Vectors are scaled by a power of two before they are squared, which changes no digit of a cosine and keeps huge and tiny ones from over- and underflow.
Vectors of several lengths are searched apart, each among those of its length; a length that the sample lacks has no pivots and is searched exactly.

Equal vectors of a block are indexed once with their smallest ids (as many as an answer can need), so a vector with very many
copies does not crowd out others.

Work grows with queries times vectors, as for any index of a fixed share: a query reads its pivots' files in every block. Vectors are sent once for each
``QUERY_BLOCK`` queries, queries once for each ``DATA_BLOCK`` vectors. Rows are dealt to blocks by a mark and not by id, so neither an id nor a vector that most rows share fills a block.

Defined results: rows whose id or vector is null, whose vector is zero or holds a null or non-finite component take no part;
a repeated query id is answered once, and rows with the query's id are not its candidates; ties go to the smaller id; fewer
candidates than ``k`` are all returned; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

PIVOTS, PREFIX, SHARE, LEAST = 256, 64, 0.25, 8
SAMPLE, APART = 4096, 0.8  # pivots come from so many vectors; two pivots' cosine is less than this
DATA_BLOCK, QUERY_BLOCK, SLICE = 32768, 32768, 4096  # rows of a block; of those whose distances to all pivots are held at once


def usable(v: Column) -> Column:
    """Whether a vector has only finite components and is not zero."""
    x = lambda c: c.cast("double")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) < float("inf")))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda c: F.coalesce(x(c) != 0, F.lit(False)))


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors with a greatest component from 0.5 to 1, by powers of two."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def apart(sample: np.ndarray) -> np.ndarray:
    """The first vectors of a sample that are not close to one before, so that copies of one take no second place."""
    kept = sample[:1]
    for v in sample[1:]:
        if len(kept) == PIVOTS:
            break
        if (kept @ v).max() < APART:
            kept = np.vstack([kept, v])
    return kept


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first."""
    parts = [np.argsort(-(_unit(x[s : s + SLICE]) @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.int16) for s in range(0, len(x), SLICE)]
    return np.concatenate(parts)


def _distinct(ids: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """First rows of distinct vectors, in order of id, and the smallest ids of each."""
    order = np.argsort(ids, kind="stable")
    _, first, group = np.unique(x[order].view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
    rank = np.argsort(np.argsort(first))
    group = rank[group]
    by = np.argsort(group, kind="stable")
    held = [np.unique(c)[:most] for c in np.split(ids[order][by], np.cumsum(np.bincount(group))[:-1])]
    return order[np.sort(first)], held


def search_block(data: pd.DataFrame, queries: pd.DataFrame, pivots: np.ndarray | None, k: int) -> pd.DataFrame:
    """The ``k`` best found candidates of one data block for each query of one query block; all are reranked without pivots."""
    empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
    if data.empty or queries.empty:
        return empty
    ids, x = data["id"].to_numpy(np.int64), np.ascontiguousarray(np.stack(data["v"].to_numpy()).astype(np.float64))
    rows, held = _distinct(ids, x + 0.0, k + 1)
    x = scaled(x[rows])
    y = scaled(np.stack(queries["v"].to_numpy()).astype(np.float64))
    n = len(x) if pivots is None else min(len(x), max(LEAST * k, int(np.ceil(SHARE * len(x)))))
    if n < len(x):
        prefix = min(PREFIX, len(pivots))
        flat = permutations(x, pivots, prefix).ravel()
        by = np.argsort(flat, kind="stable")
        ends = np.cumsum(np.bincount(flat, minlength=len(pivots)))
        saved = (prefix - by % prefix).astype(np.uint16)
        files = [(by[a:b] // prefix, saved[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        asked = permutations(y, pivots, prefix)
    norms = np.sqrt((x * x).sum(1))
    out = []
    for j, (q, v) in enumerate(zip(queries["id"].to_numpy(np.int64), y, strict=True)):
        if n < len(x):
            total = np.zeros(len(x), np.uint16)
            for place, p in enumerate(asked[j]):
                at, s = files[p]
                total[at] += np.minimum(s, np.uint16(prefix - place))
            found = np.argpartition(np.uint16(65535) - total, n - 1)[:n]
        else:
            found = np.arange(n)
        score = (x[found] * v).sum(1) / (norms[found] * np.sqrt((v * v).sum()))
        keep = np.argpartition(-score, k + 1)[: k + 2] if len(score) > k + 2 else np.arange(len(score))
        keep = np.flatnonzero(score >= score[keep].min())
        near = sorted((-s, i) for s, r in zip(score[keep], found[keep], strict=True) for i in held[r] if i != q)[:k]
        out += [(q, i, -s) for s, i in near]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]) if out else empty


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of all other rows for rows with ``is_query``."""
    src = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked")
    ).withColumn("size", F.size("v"))
    picked = src.groupBy(F.xxhash64("v").alias("h")).agg(F.any_value("v").alias("v")).orderBy("h").limit(SAMPLE).collect()
    samples: dict[int, list] = {}
    for r in picked:
        samples.setdefault(len(r["v"]), []).append(r["v"])
    pivots = {size: apart(_unit(np.array(v, np.float64))) for size, v in samples.items()}
    asked = src.where("asked").groupBy("id").agg(F.min("v").alias("v")).withColumn("size", F.size("v"))
    blocks, query_blocks = -(-max(1, src.count()) // DATA_BLOCK), -(-max(1, asked.count()) // QUERY_BLOCK)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n, *of: F.pmod(F.xxhash64(*of), F.lit(n)).cast("int")
    marked = src.withColumn("mark", F.monotonically_increasing_id())
    data = marked.select("id", "v", "size", place(blocks, "id", "mark").alias("b"), spread(query_blocks).alias("q"))
    queries = asked.select("id", "v", "size", spread(blocks).alias("b"), place(query_blocks, "id").alias("q"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return search_block(left, right, pivots.get(len(right["v"].iloc[0])) if len(right) else None, k)

    key = ("size", "b", "q")
    found = data.groupBy(*key).cogroup(queries.groupBy(*key)).applyInPandas(run, "query_id long, vec_id long, score double")
    found = found.distinct()  # copies of a row may lie in several blocks
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest neighbours of every row whose id is divisible by 50."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
