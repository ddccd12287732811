"""Operators 11 to 13 against plain Python and SQL, and bounds and odd rows of earlier operators."""

import hashlib
import math
import os
import random
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

pytest.importorskip("sparkwright.llm")
from sparkwright.llm import bpe, common, jaccard, language, merkle, mpegts, neighbours, quality, queries, search, sharding, toxicity  # noqa: E402

TABLES = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["op11_sharding", "op12_search", "op13_merkle"])
def test_equals_sql(spark, same, name):
    same(queries.QUERIES[name](spark, TABLES), queries.SQL[name])


@pytest.mark.parametrize("name", ["op11_sharding", "op12_search", "op13_merkle"])
def test_only_the_result_stays(spark, name):
    """Of what a query writes its result alone is left in the shared folder."""
    folder = f"{common.shared_dir(spark)}/sparkwright"
    os.makedirs(folder, exist_ok=True)
    before = set(os.listdir(folder))
    got = queries.QUERIES[name](spark, TABLES.replace("sf0.01", "sf0.001"))
    assert got.count() > 0 and len(set(os.listdir(folder)) - before) <= 2


@pytest.fixture(scope="module")
def mixed(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing column names and a source with most rows."""
    r = random.Random(4)
    rows = [(k, f"Word{k % 7} same " * (k % 5), "en", "hot" if k % 3 else f"s{k % 40}", k) for k in range(400)]
    rows += [(None, "no id A", None, None, None), (None, None, None, None, None), (7, "", "en", "é", 0), (7, "", "en", "é", 0), (7, "Other", None, "Z", 1), (900, "LONG " * 60_000, "en", "hot", 5), (901, None, "en", "hot", 5), (-3, "Ünï 0 a1b2", "de", "", 1)]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, DOCS)
    return rows, docs.withColumns({c: F.lit(1) for c in ("key", "slot", "shard", "size", "g", "at", "digest", "block", "term", "item", "path", "root", "mark", "parent", "left")}).repartition(5)


def draws(key, shards):
    return [-1 / math.log((int(hashlib.md5(f"{key}|{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) for s in range(shards)]


def test_shards_of_odd_rows(spark, mixed):
    rows, docs = mixed
    got = sharding.assigned(docs, [1.0] * 5).collect()
    assert len(got) == len(rows)
    for x in got:
        now = draws("" if x.key is None else x.key, 6)
        assert x.shard == max(range(5), key=lambda s: now[s]) and x.grown_shard == max(range(6), key=lambda s: now[s])
    for s in range(5):
        slots = sorted(x.slot for x in got if x.shard == s)
        assert slots == list(range(len(slots)))
    want = sorted(((d is None, d or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows))
    assert sorted((x.key is None, x.key or 0, x["size"], x.text_crc32) for x in got) == want
    assert sharding.assigned(docs.where("false"), [1.0, 1.0]).count() == 0
    assert sharding.assigned(docs, [1.0]).agg(F.max("shard")).first()[0] == 0


def test_weights_and_growth_of_shards(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    n = {r.shard: r["count"] for r in sharding.assigned(docs, [1.0, 2.0, 5.0], 2.0).groupBy("shard").count().collect()}
    assert all(abs(n[s] / 40_000 - w / 8) < 0.01 for s, w in enumerate((1, 2, 5)))
    moved = sharding.assigned(docs, [1.0, 2.0, 5.0], 2.0).where("shard != grown_shard").groupBy("grown_shard").count().collect()
    assert [r.grown_shard for r in moved] == [3] and abs(moved[0]["count"] / 40_000 - 0.2) < 0.01
    more = {r.key: r.shard for r in sharding.assigned(docs, [1.0, 2.0, 6.0]).collect()}
    before = {r.key: r.shard for r in sharding.assigned(docs, [1.0, 2.0, 5.0]).collect()}
    assert {more[k] for k in before if more[k] != before[k]} == {2}


def test_one_key_with_most_rows_is_dealt(spark):
    docs = spark.range(30_000).select((F.col("id") % 3).cast("long").alias("doc_id"), F.lit("same").alias("text")).repartition(8)
    got = sharding.assigned(docs, [1.0] * 4)
    assert got.select("shard", "slot").distinct().count() == 30_000
    assert all(r["n"] == r["m"] + 1 for r in got.groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("m")).collect())


def test_written_shards(spark, tmp_path, mixed):
    rows, docs = mixed
    sharding.write_shards(docs.drop("shard"), str(tmp_path / "s"), [1.0, 1.0, 3.0], files=2)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(rows) and {c for c in docs.columns if c not in ("shard", "slot")} < set(back.columns)


def scored(rows, items, k):
    """Every document for every item by the stated formula."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    said = lambda t: term.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(d, said(t)) for d, t in rows if said(t)]
    n_docs, total = len(docs), sum(len(t) for _, t in docs)
    df = {}
    for _, t in docs:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for i, text in {(i, t) for i, t in items}:
        found = []
        for d, t in docs:
            m = 25 + 75 * len(t) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in said(text) if x in df)
            if s > 0:
                found.append((-s, d is None, d or 0))
        out += [(i, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k], 1)]
    return out


def test_search_of_odd_rows(spark, mixed):
    rows, docs = mixed
    items = [(1, "word1 same SAME other"), (2, ""), (3, None), (4, "nothing here"), (5, "a"), (6, "Ünï a1b2 0 long"), (1, "word1 same SAME other"), (6, "word2"), (None, "word3")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({"item": F.lit(0), "number": F.lit(0), "said": F.lit(0)})
    few = [(d, t) for d, t, *_ in rows]
    for k in (1, 3, 1000):
        got = [tuple(r) for r in search.search(search.Index(docs), asked, k).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, scored(few, items, k)))
    empty = search.Index(docs.where("false"))
    assert search.search(empty, asked).count() == 0 and search.search(search.Index(docs), asked.where("false")).count() == 0


def test_search_in_many_blocks_and_groups(spark, monkeypatch):
    """Small blocks and groups of items, copies that tie at the k-th place, and every document that reaches the bound is scored."""
    r = random.Random(8)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(4000)]
    rows = [(k, " ".join(r.choice(words) for _ in range(r.randrange(1, 60)))) for k in range(600)]
    rows += [(1000 + k, rows[5][1]) for k in range(40)]
    items = [(k, " ".join(r.choice(words) for _ in range(r.randrange(1, 12)))) for k in range(30)]
    monkeypatch.setattr(search, "DOCS", 37)
    monkeypatch.setattr(search, "ITEMS", 8)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(x) for x in search.search(search.Index(docs), spark.createDataFrame(items, "item_id long, text string"), 10).collect()]
    assert sorted(got) == sorted(scored(rows, items, 10))


def test_bounds_enclose_shares():
    import numpy as np

    tf, length = np.arange(1, 400).repeat(50), np.tile(np.geomspace(1, 10**7, 50).astype(np.int64), 399)
    x = search.shares(tf, length, 1000, 370_000)
    b = -(-x // search.STEP)
    assert b.max() <= 255 and x.max() < search.SHARE and (x <= b * search.STEP).all() and (x[b > 0] >= (b[b > 0] - 1) * search.STEP + 1).all()


def manifest_of(rows, bent):
    """The manifest by plain Python: (doc_id, leaf, subroot, root, proof, folded, verified) of each row."""
    h = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t, lang, source, n: h(*map(enc, (d, source, lang, n, t)))

    def tree(nodes):
        """The root, and (before, after) of each level for each node."""
        paths, own = [[] for _ in nodes], [[k] for k in range(len(nodes))]
        while len(nodes) > 1:
            up, held = [], []
            for s in range(0, len(nodes), 16):
                run = nodes[s : s + 16]
                for j in range(len(run)):
                    for k in own[s + j]:
                        paths[k].append(("".join(run[:j]), "".join(run[j + 1 :])))
                up.append(h(*run))
                held.append([k for o in own[s : s + 16] for k in o])
            nodes, own = up, held
        return nodes[0], paths

    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append((row[0] is not None, row[0] or 0, leaf(*row), row))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for top, s in zip(tops, order, strict=True):
        for (_, _, d, row), path in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            lower = re.sub("[A-Z]", lambda m: m[0].lower(), row[1]) if row[1] is not None else None
            node = leaf(row[0], lower, *row[2:]) if bent(row[0]) else d
            for left, right in path + top:
                node = h(left, node, right)
            out.append((row[0], d, trees[s][0], root, h(*(x for p in path + top for x in p)), node, node == root))
    return out


def test_manifest_of_odd_rows(spark, mixed):
    rows, docs = mixed
    bent = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 0
    got = sorted(repr(tuple(r)) for r in merkle.manifest(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0).collect())
    assert got == sorted(map(repr, manifest_of(rows, bent)))
    assert all(r.verified for r in merkle.manifest(docs).collect())
    assert merkle.manifest(docs.where("false")).count() == 0
    one = merkle.manifest(docs.where("doc_id = 900")).collect()
    assert one[0].leaf == one[0].subroot == one[0].root == one[0].folded_root and one[0].proof_sha256 == hashlib.sha256(b"").hexdigest()


def test_manifest_of_many_levels(spark):
    rows = [(k, f"T{k}", None, f"s{k % 300}" if k % 2 else "big", k) for k in range(3000)]
    got = merkle.manifest(spark.createDataFrame(rows, DOCS).repartition(6), F.col("doc_id") % 2 == 0).collect()
    assert sorted(map(tuple, got)) == sorted(manifest_of(rows, lambda d: d % 2 == 0))


def test_fit_of_dirty_languages_is_bounded(spark, monkeypatch):
    """5,000 language values: the sample and the classes stay within their bounds."""
    rows = [(k, f"text number {k} of some words", f"x{k % 5000}") for k in range(15_000)] + [(20_000 + k, f"bonjour les amis {k}", "fr") for k in range(50)] + [(30_000 + k, f"the good friends {k}", "en") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    kept = language.sparse_svm
    monkeypatch.setattr(language, "sparse_svm", lambda at, *a, **k: (seen.append(len(at) - 1), kept(at, *a, **{**k, "epochs": 1}))[1])
    model = language.fit(docs, F.lit(True))
    langs = {x for m in model.members.values() for x in m}
    assert len(langs) == language.CLASSES and {"fr", "en"} < langs and max(seen) <= 2 * language.SAMPLE
    got = {r.doc_id: r.lang_pred for r in language.predict(docs.where("doc_id >= 20000"), model).collect()}
    assert sum(got[k] == ("fr" if k < 30_000 else "en") for k in got) >= 90
    assert language.fit(docs.where("doc_id < 2000"), F.lit(True)) is None


@pytest.mark.parametrize("n", [1200, 2400])
def test_blocks_of_near_copies_travel_once(spark, monkeypatch, n):
    """Groups of many chunks, a few of whose members link all others: rows and links a member do not rise with the group.

    Two members link if at most three words of theirs are changed, and most have two, so the centres of a list leave most of it open.
    """
    r, made = random.Random(n), {}
    base = [f"w{k}" for k in range(160)]
    rows = []
    for k in range(n):
        w = list(base)
        for j, at in enumerate(r.sample(range(4, 156, 5), 1 if k % 12 == 0 else 2)):
            w[at] = f"new{k}x{j}"
        rows.append((k, " ".join(w)))
    rows += [(10_000 + k, " ".join(f"far{k}x{j}" for j in range(30))) for k in range(5)]
    kept = jaccard.written

    def counted(df, what):
        out = kept(df, what)
        made[what] = max(made.get(what, 0), out.count())
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    monkeypatch.setattr(jaccard, "LIST", 100)
    got = {x.doc_id: x.component_id for x in jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: 0 if d < 10_000 else d for d, _ in rows}
    assert made["home"] >= 0.7 * n and made.get("visits", 0) == 0, made
    assert all(made[t] <= 2.5 * len(rows) for t in ("home", "whole", "links", "alive", "candidates", "ends", "labels")), made


def test_empty_repeated_and_long_rows_of_scored_texts(spark):
    """Operators 4, 5, 8 and 9: no rows for an empty table, equal results for repeated rows, one row for a text of 20,000 words."""
    docs, labels = (spark.read.parquet(f"{TABLES}/{t}.parquet") for t in ("documents", "labels"))
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    known = language.fit(docs, language.learnable(F.col("doc_id")))
    rules = quality.fit(docs, labels, quality.learnable(F.col("doc_id")))
    toxic = toxicity.fit(docs, labels, toxicity.learnable(F.col("doc_id")))
    applied = [lambda d: language.predict(d, known), lambda d: bpe.decode_ids(bpe.encode_texts(d, path), path), lambda d: quality.score(d, rules), lambda d: toxicity.score(d, toxic)]
    few = docs.select("doc_id", "text").limit(20).union(spark.createDataFrame([(-1, "many words here " * 7000)], "doc_id long, text string"))
    for run in applied:
        assert run(docs.where("false")).count() == 0
        got = [repr(tuple(r)) for r in run(few.union(few)).collect()]
        assert len(got) == 42 and len(set(got)) == 21


def test_neighbours_where_one_id_has_a_third_of_the_rows(spark, monkeypatch):
    """Copies of a row lie in many small blocks; results are those of all pairs."""
    import numpy as np

    x = np.random.default_rng(3).normal(size=(200, 6))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(300, x[0].tolist())] * 100 + [(7, x[7].tolist())] * 40
    monkeypatch.setattr(neighbours, "DATA_BLOCK", 30)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 3)
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), F.col("vec_id") % 50 == 0).collect()
    unit = np.stack([*x, x[0]]) / np.sqrt((np.stack([*x, x[0]]) ** 2).sum(1))[:, None]
    ids = np.array([*range(200), 300])
    hits = 0
    for q in (0, 50, 100, 150, 300):
        s = unit @ unit[list(ids).index(q)]
        best = [int(ids[k]) for k in np.lexsort((ids, -s.round(12))) if ids[k] != q][:5]
        mine = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
        assert len(mine) == len(set(mine)) == 5
        hits += len(set(mine) & set(best))
    assert hits >= 23 and [r.vec_id for r in got if r.query_id == 0 and r["rank"] == 1] == [300]


def test_tables_announced_for_later_are_not_applied():
    data = mpegts.payload_of(b"some text")
    media = mpegts.pack(data)
    whole = mpegts.parse(media)
    at = 188 + 5 + 5  # the program map's byte with the indicator, in the second packet
    later = bytearray(media[188:376])
    assert later[at - 188] & 1
    later[at - 188] ^= 1
    size = 3 + ((later[6] & 15) << 8 | later[7])
    section = bytes(later[5 : 5 + size - 4])
    later[5 + size - 4 : 5 + size] = mpegts.crc32_mpeg(section).to_bytes(4, "big")
    later[3] = later[3] & 0xF0 | (later[3] + 1 & 15)
    both = mpegts.parse(media[:376] + bytes(later) + media[376:])
    assert both.streams == whole.streams and both.programs == whole.programs and not both.bad_tables
    alone = mpegts.parse(media[:188] + bytes(later) + media[376:])
    assert alone.programs and not alone.streams


OP6_CONTRACT = r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
p(label, phrase) AS (VALUES ('gpl', ['gnu', 'general', 'public', 'license']), ('apache', ['apache', 'license']), ('cc-by', ['cc', 'by']), ('mit', ['mit', 'license'])),
f AS (SELECT doc_id, label, len(phrase) AS n, unnest([i FOR i IN range(len(w)) IF w[i + 1:i + len(phrase)] = phrase]) AS at FROM w, p)
SELECT w.doc_id, CAST(any_value(len(w.w)) AS BIGINT) AS n_words, count(f.at) AS n_base, min(f.at) AS first_word, max(f.at) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels FROM w LEFT JOIN f USING (doc_id) GROUP BY w.doc_id"""


def test_contract_columns_of_licenses_equal_sql(spark, same):
    got = queries.QUERIES["op6_licenses"](spark, TABLES).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    same(got, OP6_CONTRACT)
