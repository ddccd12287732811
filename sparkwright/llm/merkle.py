"""Merkle manifest of a dataset: leaves of rows, trees of 16 by source, a tree over the sources, and proofs, by window levels.

A level is one window: partitioned by group and parent index, ordered by index, its full frame lists the digests of a run. The list gives the parent's
preimage and, without the row itself, the row's siblings; of the equal parents of a run the first stays for the next level. A run has 16 rows at most, so no
task sees a group whole. Leaves get their places by a range sort over all rows (``numbered``). Proofs go down again from the root: each level joins its
parents' proofs, a sixteenth of its rows, so the whole costs little more than two shuffles of the leaves.

H is the lowercase hex sha256 of its inputs, concatenated; a value is ``-`` if null, else its UTF-8 byte count, ``:`` and itself.

Defined results: null sources are one group, before all others; rows without an id come first in their source; rows with one id lie in order of their
leaves, equal rows in any order (their proofs differ by place, and each of them verifies); a null text cannot be tampered with here and an empty one is no other;
extra columns are ignored; an empty table gives no rows; very long texts are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..shared import scratch
from .common import crc32_sql, discard, residue, table, written

FAN = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(columns: dict[str, Column]) -> Column:
    return digest(*[encoded(columns[c]) for c in COLUMNS])


def runs(nodes: DataFrame) -> DataFrame:
    """Nodes (g, at, size, digest, ...) with the digests of their run before and after them, as ``left`` and ``right``, and ``whole``, their parent's preimage."""
    run = Window.partitionBy("g", "parent").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    listed = nodes.withColumn("parent", F.floor(F.col("at") / FAN).cast("long")).withColumn("all", F.collect_list("digest").over(run))
    place = (F.col("at") % FAN).cast("int")
    joined = lambda a: F.array_join(a, "")
    return listed.withColumns({"left": joined(F.slice("all", F.lit(1), place)), "right": joined(F.slice("all", place + 2, F.lit(FAN))), "whole": joined("all")}).drop("all")


def parents(nodes: DataFrame) -> DataFrame:
    """The next level: one node for each run."""
    firsts = runs(nodes.select("g", "at", "size", "digest")).where(F.col("at") % FAN == 0)
    return firsts.select("g", F.col("parent").alias("at"), F.ceil(F.col("size") / FAN).cast("long").alias("size"), digest(F.col("whole")).alias("digest"))


def levels_of(leaves: DataFrame) -> list[DataFrame]:
    """Levels from the leaves (g, at, size, digest) up to where each group has one node; only the first is not written here."""
    levels, most = [leaves], leaves.agg(F.max("size")).first()[0] or 0
    while most > 1:
        below = levels[-1]
        levels.append(written(parents(below.where("size > 1")), "level"))
        most = -(-most // FAN)
    return levels


def with_paths(levels: list[DataFrame], roots: DataFrame) -> DataFrame:
    """The lowest level's nodes with all their columns, ``path``, the (left, right) of each level from theirs to the root, and all that ``roots`` has.

    ``roots`` (g, path, ...) has one row a group: the path of its root in a tree above, empty if there is none.
    """
    carried = [c for c in roots.columns if c != "g"]
    above = None
    for k in reversed(range(len(levels))):
        level = levels[k]
        here = level.where("size = 1").join(roots, "g")
        if above is not None:
            up = above.select("g", F.col("at").alias("parent"), *[F.col(c).alias(f"__{c}") for c in carried])
            met = runs(level.where("size > 1")).join(up, ["g", "parent"])
            met = met.withColumns({c: F.col(f"__{c}") for c in carried} | {"path": F.concat(F.array(F.struct("left", "right")), F.col("__path"))})
            here = here.unionByName(met.select(*here.columns))
        below = written(here, "paths") if k else here
        if above is not None and k:
            discard(above)
        above = below
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of a path."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def proof(path: Column) -> Column:
    """H of all siblings."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of ``docs`` (``COLUMNS``).

    Where ``tampered`` holds, the leaf that is checked against the manifest is that of the row with the text's A-Z lower-cased.
    """
    own = {c: F.col(c) for c in COLUMNS}
    changed = own | {"text": F.translate("text", _UPPER, _LOWER)}
    group = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))  # '-' sorts before '='
    bent = F.lit(None).cast("string") if tampered is None else F.when(tampered, leaf_of(changed))
    leaves = written(docs.select(group.alias("g"), "doc_id", leaf_of(own).alias("digest"), bent.alias("bent")), "leaves")
    placed = numbered(leaves, ["g"], ["doc_id", "digest"])
    levels = levels_of(placed)
    subroots = levels[0].where("size = 1").select("g", "digest")
    for level in levels[1:]:
        subroots = subroots.unionByName(level.where("size = 1").select("g", "digest"))
    subroots = written(subroots.withColumnRenamed("g", "source_key"), "subroots")
    top = levels_of(numbered(subroots, [], ["source_key"]).withColumn("g", F.lit(0)))
    root = top[-1].where("size = 1").select("g", F.array().cast("array<struct<left:string,right:string>>").alias("path"), F.col("digest").alias("root"))
    sources = written(with_paths(top, root).select(F.col("source_key").alias("g"), "path", F.col("digest").alias("subroot"), "root"), "sources")
    rows = with_paths(levels, sources).withColumn("folded_root", folded(F.coalesce("bent", "digest"), F.col("path")))
    discard(leaves, subroots, *top[1:])
    return rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents; those whose id's checksum 5 divides are tampered with."""
    with scratch(spark) as keep:
        return keep(manifest(table(spark, sf_dir, "documents"), residue(F.col("doc_id"), 5) == 0), "manifest")


_LEVELS = 4  # of each tree in the SQL: up to 65,536 nodes


def _tree_sql(name: str, first: str) -> str:
    """CTEs of a tree's levels name0, name1, ... and of each node's siblings before and after it, name0_run, ..."""
    out = [f"{name}0 AS ({first})"]
    for k in range(_LEVELS):
        out.append(f"{name}{k}_run AS (SELECT g, pos, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(d, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k} WHERE size > 1 WINDOW w AS (PARTITION BY g, pos // 16 ORDER BY pos))")
        out.append(f"{name}{k + 1} AS (SELECT g, pos // 16 AS pos, (size + 15) // 16 AS size, sha256(string_agg(d, '' ORDER BY pos)) AS d FROM {name}{k} WHERE size > 1 GROUP BY g, pos // 16, size)")
    return ", ".join(out)


_ALL = " UNION ALL ".join(f"SELECT g, d FROM s{k} WHERE size = 1" for k in range(_LEVELS + 1))
_JOINS = " ".join([f"LEFT JOIN s{k}_run s{k} ON s{k}.g = p.g AND s{k}.pos = p.pos // {16**k}" for k in range(_LEVELS)] + [f"LEFT JOIN t{k}_run t{k} ON t{k}.pos = t.pos // {16**k}" for k in range(_LEVELS)])
_STEPS = [f"{name}{k}" for name in "st" for k in range(_LEVELS)]
_H = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
_LEAF = "sha256(" + " || ".join(_H(c) for c in COLUMNS) + ")"
_FOLDS = "".join(f", f{k} AS (SELECT * REPLACE (CASE WHEN l{k} IS NULL THEN x ELSE sha256(l{k} || x || r{k}) END AS x) FROM f{k - 1})" for k in range(1, 2 * _LEVELS + 1))
OP13_SQL = f"""WITH raw AS (SELECT *, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS g, {crc32_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 AS bad FROM documents),
h AS (SELECT doc_id, g, {_LEAF} AS d, CASE WHEN bad THEN {_LEAF.replace(_H("text"), _H(f"translate(text, '{_UPPER}', '{_LOWER}')"))} END AS bent FROM raw),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS pos, count(*) OVER (PARTITION BY g) AS size FROM h),
{_tree_sql("s", "SELECT g, pos, size, d FROM placed")}, sub AS ({_ALL}), {_tree_sql("t", "SELECT 0 AS g, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS size, d FROM sub")},
place AS (SELECT g, d AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos FROM sub), root AS ({" UNION ALL ".join(f"SELECT d AS root FROM t{k} WHERE size = 1" for k in range(_LEVELS + 1))}),
f0 AS (SELECT p.doc_id, p.d AS leaf, t.subroot, root.root, coalesce(p.bent, p.d) AS x, {", ".join(f"{n}.l AS l{k}, {n}.r AS r{k}" for k, n in enumerate(_STEPS, 1))}
  FROM placed p JOIN place t ON t.g = p.g JOIN root ON true {_JOINS}){_FOLDS}
SELECT doc_id, leaf, subroot, root, sha256({" || ".join(f"coalesce(l{k} || r{k}, '')" for k in range(1, 2 * _LEVELS + 1))}) AS proof_sha256, x AS folded_root, x = root AS verified FROM f{2 * _LEVELS}"""
