"""Operators of the llm subpackage against brute force, exact round trips and odd input."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("sparkwright.llm")

import public_tokenizers as P  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from sparkwright.llm import bpe, chat, common, jaccard, language, licenses, linear, mpegts, neighbours, packing, quality, queries, toxicity  # noqa: E402

TABLES = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n "), (4, "x"), (5, "Á b\x00c " * 3000), (6, "same words here now ok"), (7, "same words here now ok"), (7, "same words here now ok"), (None, "no id at all here")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("n", F.lit(3)).withColumn("keys", F.lit("clash"))


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, same, name):
    same(queries.QUERIES[name](spark, TABLES), queries.SQL[name])


def test_streams():
    for n in (0, 1, 575, 576, 577, 5759, 5760, 5761, 50_000):
        data = mpegts.payload_of(random.Random(n).randbytes(n))
        media = mpegts.pack(data)
        s = mpegts.parse(b"junk" + media)
        assert b"".join(u.data for u in s.units) == data and not s.continuity_errors and s.programs == {1: mpegts.PMT_PID}
        assert [u.pts for u in s.units] == [k * mpegts.TICK for k in range(len(s.units))] and all(u.random_access for u in s.units)
    assert mpegts.parse(media[: 188 * 9] + media[188 * 10 :]).continuity_errors == 1
    assert mpegts.parse(media[: 188 * 9] + media[188 * 8 : 188 * 9] + media[188 * 9 :]).repeated == 1
    whole = mpegts.parse(media)
    for k in (8, 20, 50):  # stray bytes, missing bytes, one damaged sync byte
        s = mpegts.parse(media[: 188 * k] + b"strayG." + media[188 * k :])
        assert s.sync_losses == 1 and not s.continuity_errors and [u.data for u in s.units] == [u.data for u in whole.units]
        s = mpegts.parse(media[: 188 * k + 60] + media[188 * k + 75 :])
        assert s.sync_losses == 1 and s.n_packets == whole.n_packets - 1 and s.continuity_errors == 1
        s = mpegts.parse(media[: 188 * k] + b"x" + media[188 * k + 1 :])
        assert s.sync_losses == 0 and s.n_packets == whole.n_packets - 1
    assert mpegts.parse(b"y" * 500 + media).n_packets == whole.n_packets
    assert mpegts.parse(None).n_packets == mpegts.parse(b"abc").n_packets == 0


def test_streams_of_odd_rows(odd, none):
    got = mpegts.stream_digests(mpegts.pack_streams(odd, "doc_id", "text")).collect()
    assert sorted((r.n_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted((len(b), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])) for _, t in ODD for b in ((t or "").encode(),) for p in (mpegts.payload_of(b),))
    assert mpegts.stream_digests(mpegts.pack_streams(none, "doc_id", "text")).count() == 0
    assert mpegts.read_units(mpegts.pack_streams(odd, "doc_id", "text"), "id", "media").where("random_access").count() >= len(ODD)


def test_chat_round_trip(spark):
    texts = ["<|im_end|>", "<\\|a", "<<|im_sep|>", "<", None, "|>", "a\nb"]
    rows = [(c, t, r, x) for c, r0 in enumerate(("user", "us%er<|im_start|>\nx", None)) for t, x in enumerate(texts) for r in (r0 if t % 3 else "assistant",)]
    done = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in done.select("conv_id", chat.parse_turns(F.col("formatted")).alias("t"), "formatted", "loss_runs").collect():
        want = [(x[2] or "", x[3] or "") for x in rows if x[0] == r.conv_id]
        assert [tuple(t) for t in r.t] == want
        at, under = 0, []
        for skip, take, trained in r.loss_runs:
            at += skip
            under.append(r.formatted[at : at + take])
            at += take
        esc = [x[3] or "" for x in rows if x[0] == r.conv_id]
        assert [u for u, (_, t, k) in zip(under, r.loss_runs) if k] == [_escaped(x) for x, (role, _) in zip(esc, want) if role == "assistant"]


def test_the_mask_decides(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "é<|im_end|>😀"), (1, 2, "assistant", ""), (1, 3, "user", None), (1, 4, "assistant", "<\\|x"), (2, None, "user", "no answer"), (None, 0, "assistant", "a"), (None, 0, "assistant", "a")]
    done = chat.format_conversations(spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, pieces string"))
    texts = lambda runs: F.transform(chat.masked_texts(F.col("formatted"), runs), chat.unescape_text)
    moved = F.transform("loss_runs", lambda r, i: F.when(i == 1, r.withField("skip", r["skip"] + 1)).otherwise(r))
    got = {r.conv_id: (r.a, r.b) for r in done.select("conv_id", texts(F.col("loss_runs")).alias("a"), texts(moved).alias("b")).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: ["é<|im_end|>😀", "", "<\\|x"], 2: [], None: ["a", "a"]}
    assert got[1][0] != got[1][1]
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def _escaped(text):
    import re

    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def test_bpe_equals_the_library():
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces, encode = bpe.piece_encoder(path, bpe.PATTERN)
    tokens = packing.tokenizer(P.path("byte_bpe_50k.json"), packing.MERGE_PATTERN)
    parts = [" ", "  ", "\n", "'s", "a", "Bc", "é", "1", "½", "!!", "\x1c", "\x85", " ", "▁", "中文", "😀", "е", "the", "<|endoftext|>", "<unk>", "\x00"]
    r = random.Random(3)
    for _ in range(500):
        t = "".join(r.choice(parts) for _ in range(r.randrange(1, 30)))
        ids = own.encode_ordinary(t)
        assert np.frombuffer(encode(t), "<u4").tolist() == ids and pieces.decode(ids) == t.encode()
        assert np.frombuffer(tokens(t), "<u4").tolist() == tokens.library.encode(t, add_special_tokens=False).ids


def test_bpe_of_odd_rows(odd, none):
    got = bpe.decode_ids(bpe.encode_texts(odd, P.path("byte_bpe_multi_50k.tiktoken")), P.path("byte_bpe_multi_50k.tiktoken")).collect()
    assert sorted(bytes(r.data) for r in got) == sorted((t or "").encode() for _, t in ODD)


def test_best_fit():
    r = random.Random(1)
    for _ in range(30):
        cap = r.choice((8, 50, 2048))
        sizes = [r.randint(1, cap) for _ in range(r.randrange(1, 400))]
        bins = []  # best-fit decreasing, one at a time
        for s in sorted(sizes, reverse=True):
            fit = [x for x in range(len(bins)) if bins[x] >= s]
            if fit:
                bins[min(fit, key=bins.__getitem__)] -= s
            else:
                bins.append(cap - s)
        assert packing.best_fit({s: sizes.count(s) for s in set(sizes)}, cap) == len(bins)


def test_carried():
    """Pairs over range boundaries against a plain stack."""
    r = random.Random(2)
    for _ in range(50):
        left = {p: (r.randrange(4), r.randrange(4)) for p in range(r.randrange(1, 12))}
        gaps, pieces, opening = packing.carried(left, 5)
        at = lambda p, k: np.array([p], np.int64) if k is None else (np.array([p], np.int64), np.array([k], np.int64))
        by_gap = {int(packing.pair_of(gaps, *at(p, k), False)[0]): (p, k) for p, (_, n) in left.items() for k in range(n)}
        by_piece = {int(packing.pair_of(pieces, *at(p, k), True)[0]): (p, k) for p, (n, _) in left.items() for k in range(n)}
        stack, want = [], set()
        for p in sorted(left):
            want |= {(stack.pop(), (p, k)) for k in range(left[p][1]) if stack}
            stack += [(p, k) for k in range(left[p][0])]
        assert {(by_piece[x], by_gap[x]) for x in by_piece if x >= 0} == want
        assert sorted(stack) == [(p, k) for p, (n, _) in sorted(opening.items()) for k in range(n)]


@pytest.mark.parametrize("sizes", ["mixed", "hot", "small"])
def test_packing_over_many_ranges(spark, sizes):
    """Ranges of about 100 rows: whole, gapless and within 1 % of serial best fit and one sequence a class, with a length that a third of all pieces have."""
    r = random.Random(3)
    length = {"mixed": lambda: min(2048, int(r.expovariate(1 / 500)) + 1), "hot": lambda: r.choice((700, r.randint(1, 2048), r.randint(1, 300))), "small": lambda: r.randint(1, 20)}[sizes]
    rows = [(k % 1000 if k % 7 else None, k, 0, length(), k) for k in range(2000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), task_rows=100).collect()
    assert sorted((r.piece, r.doc_id, r.start, r.length, r.ids_crc32) for r in got) == [(b, a, *c) for a, b, *c in rows]
    held = {}
    for x in got:
        held.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for v in held.values():
        ends = [0, *(o + n for o, n in sorted(v))]
        assert [o for o, _ in sorted(v)] == ends[:-1] and ends[-1] <= 2048
    n = packing.best_fit({s: sum(x[3] == s for x in rows) for s in {x[3] for x in rows}}, 2048)
    assert len(held) <= n + max(len(packing.length_classes(2048)), n // 100)


def test_packing_of_odd_rows(odd, none):
    got = packing.pack_documents(odd).collect()
    assert sum(r.length == 1 for r in got) == 2 and {r.doc_id for r in got} == {1, 2, 3, 4, 5, 6, 7, None}
    assert packing.pack_documents(none).count() == 0


def test_language(spark, odd, none):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    got = queries.QUERIES["op4_language"](spark, TABLES).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    model = language.fit(docs, language.learnable(F.col("doc_id")))
    und = {r.doc_id for r in language.predict(odd, model).where("lang_pred = 'und'").collect()}
    assert und == {1, 2, 3} and language.keep_identified(odd, model).columns == odd.columns
    assert language.fit(none, F.lit(True)) is None and {r.score for r in language.predict(odd, None).collect()} == {0.0}


def test_licenses(spark, odd, none):
    rows = [(1, "MIT  License, the Apache\nLicense and CC-BY; gnu general public license"), (2, "SMITH license cc byte"), (3, "Licensed under the Apache License, Version 2.0."), (4, None)]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(x) for x in sorted(got[1].base)] == [(0, "mit"), (3, "apache"), (6, "cc-by"), (8, "gpl")]
    assert not got[2].base and got[3].found == ["apache-2.0"] and got[4].n_words == 0
    assert len(licenses.rules()) > 200 and licenses.scan_licenses(odd).count() == len(ODD)


def _spelled(parsed):
    """A text for each way through a parsed regular expression; a repeat is made as seldom as it may be, and once."""
    texts = [""]
    for op, of in parsed:
        if str(op) == "LITERAL":
            more = [chr(of)]
        elif str(op) == "IN":
            more = [chr(c) for kind, x in of for c in ([x] if str(kind) == "LITERAL" else x)]
        elif str(op) == "NOT_LITERAL":
            more = ["x"]
        elif str(op) == "BRANCH":
            more = [t for x in of[1] for t in _spelled(x)]
        elif str(op) == "SUBPATTERN":
            more = _spelled(of[-1])
        else:
            assert str(op) in ("MAX_REPEAT", "MIN_REPEAT"), op
            more = ([""] if of[0] == 0 else []) + _spelled(of[2])
        texts = [a + b for a in texts for b in more]
    return list(dict.fromkeys(texts))


def test_licenses_of_parted_words(spark):
    import re

    rules = [(label, re.compile(pattern), priority) for label, _, pattern, priority, _ in licenses.rules()]
    assert len({p for _, p in licenses.NAMES}) + len(licenses.CLAUSES) >= 240
    parts, rows, want = (" ", "\n", "  ", "-", "\r\n * ", "** __"), [], []
    for label, pattern in (*licenses.NAMES, *licenses.CLAUSES):
        for k, said in enumerate(_spelled(re._parser.parse(pattern))):
            for part in parts if (label, pattern) in licenses.CLAUSES else (parts[k % len(parts)], "\n"):
                words, until, least, labels = f" zz {said} zz ", -1, 0, []
                found = [(words[: m.start()].count(" ") - 1, m[0].count(" ") + 1, priority, of) for of, rule, priority in rules for m in rule.finditer(words)]
                for start, n, priority, of in sorted(found, key=lambda x: (x[0], -x[0] - x[1], x[2])):
                    if start + n > until and (start >= until or priority < least):
                        until, least, labels = start + n, priority, labels + [of]
                assert labels
                want.append(list(dict.fromkeys(labels)))
                rows.append((len(rows), words.strip().replace(" ", part).upper() if k % 2 else words.strip().replace(" ", part)))
    got = {r.doc_id: r.found for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(t, got[k]) for k, t in rows if got[k] != want[k]] == []
    assert not [k for k in licenses.KEYWORDS if " " in k]


def _scanned(text):
    """n_words, base places and labels of a text in plain Python, without gates."""
    import re

    words = [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    base = sorted((i, label) for phrase, label in licenses.BASE for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p)
    line, until, least, labels = f" {' '.join(words)} ", -1, 0, []
    if not licenses.ANY.search(line):
        return len(words), base, []
    found = [(line[: m.start()].count(" ") - 1, m[0].count(" ") + 1, priority, of) for of, _, rule, priority, _ in licenses.RULES for m in rule.finditer(line)]
    for start, n, priority, of in sorted(found, key=lambda x: (x[0], -x[0] - x[1], x[2])):
        if start + n > until and (start >= until or priority < least):
            until, least, labels = start + n, priority, labels + [of]
    return len(words), base, list(dict.fromkeys(labels))


def test_licenses_of_all_documents(spark, monkeypatch):
    import re

    monkeypatch.setattr(licenses, "RULES", [(a, b, re.compile(c), d, e) for a, b, c, d, e in licenses.rules()], raising=False)
    monkeypatch.setattr(licenses, "ANY", re.compile("(?<= )(?:" + "|".join(p for _, p in (*licenses.NAMES, *licenses.CLAUSES)) + ")(?= )"), raising=False)
    long = "word " * 25_000 + "under the MIT\nLicense, GPLv3 " + "more\x00 " * 5_000
    more = [(-1, long), (-2, "Licensed under the GPLv3; LGPLv2 or AGPLv3, MPLv2"), (-3, "Licensed under the GPLv3; LGPLv2 or AGPLv3, MPLv2"), (-4, None), (None, "cc by cc by, É MIT license 4.0")]
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).withColumn("r", F.lit("clash")).withColumn("gated", F.lit(1))
    got = sorted(repr((x.doc_id, x.n_words, sorted(tuple(b) for b in x.base), x.found)) for x in licenses.scan_licenses(docs).collect())
    want = sorted(repr((r.doc_id, *_scanned(r.text))) for r in docs.collect())
    assert [x for x in zip(got, want, strict=True) if x[0] != x[1]] == []
    assert any("gpl-3.0" in x and "mpl-2.0" in x and "agpl-3.0" in x and "lgpl-2.0" in x for x in got)
    assert licenses.scan_licenses(docs.where("false")).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8)).round(3)
    x[5:200] = x[5]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [None] * 8), (903, [float("nan")] * 8), (904, [1.0]), (None, [1.0] * 8)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    norm = np.sqrt((x * x).sum(1))
    hits = 0
    for q in range(0, 600, 50):
        s = (x * x[q]).sum(1) / (norm * norm[q])
        best = [k for k in np.lexsort((np.arange(600), -s)) if k != q][:5]
        mine = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
        hits += len(set(best) & set(mine))
        assert len(mine) == 5 and all(abs(r.score - s[r.vec_id]) < 1e-12 for r in got if r.query_id == q)
    assert hits >= 0.9 * 60
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.lit(True)).count() == 0


def test_quality(spark, odd, none):
    got = queries.QUERIES["op8_quality"](spark, TABLES).join(spark.read.parquet(f"{TABLES}/labels.parquet"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.95
    model = quality.fit(none, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True))
    assert {r.score for r in quality.score(odd, model).collect()} == {0.5}


def test_toxicity(spark, odd, none):
    got = queries.QUERIES["op9_toxicity"](spark, TABLES).join(spark.read.parquet(f"{TABLES}/labels.parquet"), "doc_id").where("held_out and toxic = 0")
    assert got.agg(F.avg("predicted")).first()[0] < 0.03
    model = toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert {r.score for r in toxicity.score(odd, model).collect()} == {0.0} and toxicity.keep_harmless(odd, model).count() == len(ODD)


def test_segments_are_maximal():
    r = random.Random(2)
    for _ in range(200):
        s = np.array([r.choice((-2.0, -1.0, -0.5, 1.0, 3.0)) for _ in range(r.randrange(1, 25))])
        found, rest = toxicity.segments(s), []

        def split(a, b):  # the definition: take the best segment, then look left and right of it
            best = max(((s[i:j].sum(), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            if best[0] > 0:
                rest.append(best[0])
                split(a, best[3])
                split(best[4], b)

        split(0, len(s))
        assert sorted(x for _, _, x in found) == pytest.approx(sorted(rest))


def test_hot_keys_are_dealt(spark, monkeypatch):
    rows = spark.createDataFrame([(k % 7 if k % 3 else 1, k) for k in range(500)] + [(None, 1), (99, 2)], "k long, v long")
    other = spark.createDataFrame([(k, 10 * k) for k in range(7)] + [(None, 5)], "k long, w long")
    assert common.hot_keys(rows.where("k != 1"), "k") is None and common.hot_keys(rows.where("false"), "k") is None
    monkeypatch.setattr(common, "HOT_ROWS", 60)
    hot = common.hot_keys(rows, "k")
    assert {tuple(r) for r in hot.collect()} == {(1, 4)}
    for how in ("inner", "left"):
        got = common.dealt_join(rows, other, "k", "v", hot, how)
        assert got.columns == ["k", "v", "w"] and sorted(map(repr, got.collect())) == sorted(map(repr, rows.join(other, "k", how).collect()))


@pytest.mark.parametrize("hot_rows", [common.HOT_ROWS, 4])
def test_jaccard_against_all_pairs(spark, monkeypatch, hot_rows):
    for module in (common, jaccard):
        monkeypatch.setattr(module, "HOT_ROWS", hot_rows)
    r = random.Random(5)
    words, rows = [f"w{k}" for k in range(400)], []
    for size in (60, 20, 3, 2, *[1] * 20):
        base = [r.choice(words) for _ in range(r.randrange(20, 120))]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randrange(max(2, len(w) // 25))):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append((len(rows), " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "A b"), (1004, "a B"), (1004, "a b"), (None, "a b c d e")]
    chain = [f"c{k}" for k in range(60)]  # the row in the middle, which has no id, links the other two
    rows += [(1010, " ".join(chain[:56])), (None, " ".join(chain[2:58])), (1011, " ".join(chain[4:]))]
    rows += [(None, "a b c d e f"), (None, "a b c d e f")]
    sets, root = [set(jaccard.shingles(t).tolist()) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            c = len(sets[a] & sets[b])
            if c and 100 * c >= 85 * (len(sets[a]) + len(sets[b]) - c):
                root[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(d, len(sets[k]), least.get(find(k), d)) for k, (d, _) in enumerate(rows)}
    assert {(x.doc_id, x.n_shingles, x.component_id) for x in jaccard.join_components(docs).collect()} == want
    assert jaccard.keep_one_of_each(docs).columns == docs.columns
    assert jaccard.join_components(docs.where("false")).count() == 0


def test_near_copies_cost_a_few_rows_each(spark, monkeypatch):
    """2,000 near copies, few pairs of which link: no step writes pairs, and results equal those of all pairs."""
    r, made = random.Random(11), {}
    rows = [(k, " ".join(f"new{k}" if x == at else f"w{x}" for x in range(100))) for k in range(2000) for at in [r.randrange(3, 97)]]
    rows += [(5000 + k, " ".join(f"w{x}" for x in range(6 + k, 94 + k))) for k in range(3)]
    kept = jaccard.written

    def counted(df, what):
        out = kept(df, what)
        made[what] = max(made.get(what, 0), out.count())
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    monkeypatch.setattr(jaccard, "LIST", 1500)
    got = {x.doc_id: x.component_id for x in jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [np.unique(jaccard.shingles(t)) for _, t in rows]
    codes, root = np.unique(np.concatenate(sets), return_inverse=True)[1], np.arange(len(rows))
    held = np.zeros((len(rows), codes.max() + 1), np.float32)
    held[np.repeat(np.arange(len(rows)), list(map(len, sets))), codes] = 1
    common, n = held @ held.T, held.sum(1)
    for a, b in np.argwhere(np.triu(100 * common >= 85 * (n[:, None] + n - common), 1)):
        if root[a] != root[b]:
            root[root == max(root[a], root[b])] = min(root[a], root[b])
    assert got == {d: rows[root[k]][0] for k, (d, _) in enumerate(rows)}
    keys = sum(len(s) - -(-85 * len(s) // 100) + 1 for s in sets)
    assert made.pop("shared") <= keys and made.pop("mixed") <= keys and made.pop("every-64th") <= keys
    assert made.pop("lists") <= keys and max(made.values()) <= 4 * len(rows), made


def components_of(texts, words=4, per_cent=85):
    """The component of each text by comparing all pairs; texts without words are alone."""
    said = [(t or "").encode().lower().split() for t in texts]
    sets = [{tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set() for w in said]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            c = len(sets[a] & sets[b])
            if c and root[a] != root[b] and 100 * c >= per_cent * (len(sets[a]) + len(sets[b]) - c):
                root = [root[b] if x == root[a] else x for x in root]
    return root


def test_one_row_of_each_component_stays(spark):
    r = random.Random(9)
    rows = []
    for k in range(12):
        base = [f"w{r.randrange(300)}" for _ in range(r.randrange(60, 100))]
        near = [*base[:-1], "changed"]
        rows += [(100 * k + r.randrange(3) if r.random() < 0.6 else None, " ".join(r.choice((base, near)))) for _ in range(r.randrange(1, 9))]
    rows += [(1, rows[0][1])] * 30 + [(None, "only copies without an id")] * 20 + [(7, "only copies with an id")] * 20
    rows += [(7, None), (7, ""), (7, ""), (None, " \n")]
    r.shuffle(rows)
    root = components_of([t for _, t in rows])
    docs = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, mark int")
    first = None
    for n in (1, 7):
        kept = jaccard.keep_one_of_each(docs.repartition(n, "mark")).collect()
        assert sorted(root[x.mark] for x in kept) == sorted(set(root))
        for x in kept:
            group = [d for k, (d, _) in enumerate(rows) if root[k] == root[x.mark]]
            assert (x.doc_id, x.text) == rows[x.mark] and x.doc_id == min((d for d in group if d is not None), default=None)
        chosen = sorted(repr((x.doc_id, x.text)) for x in kept)
        assert chosen == (first or chosen)
        first = chosen


def test_texts_that_share_an_id(spark):
    x, y = "one two three four five six", "red green blue black white grey"
    kept = jaccard.keep_one_of_each(spark.createDataFrame([(3, x), (5, x), (5, y), (9, y)], "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect())) == [(3, x), (5, y)]


def test_words_of_a_shingle(spark):
    base = [f"w{k}" for k in range(40)]
    near = [*base[:20], "changed", *base[21:]]
    end = [*base[:-2], "p", "q"]
    texts = [" ".join(x) for x in (base, near, end)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = components_of(texts, 5, 80)
    assert root[0] == root[2] != root[1] and len(set(components_of(texts))) == 2
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.join_components(docs, per_cent=80, words=5).collect()}
    assert got == {0: (36, 0), 1: (36, 1), 2: (36, 0)}


def test_toxicity_finds(spark):
    folder = TABLES.replace("sf0.01", "sf0.1")  # TABLES has 6 such rows
    got = queries.QUERIES["op9_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out and toxic = 1")
    n, found = got.agg(F.count("*"), F.avg("predicted")).first()
    assert n >= 50 and found > 0.7


def test_neighbours_of_many_vectors(spark):
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(100, 16)), 40, axis=0) + 0.5 * rng.normal(size=(4000, 16))
    assert len(x) * neighbours.SHARE > 5 * neighbours.LEAST
    docs = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours.nearest(docs, F.col("vec_id") % 100 == 0).select("query_id", "vec_id").collect()
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    want = {(q, int(k)) for q in range(0, 4000, 100) for k in [j for j in np.argsort(-(unit @ unit[q]), kind="stable") if j != q][:5]}
    assert len(got) == len(want) and len(want & set(map(tuple, got))) >= 0.9 * len(want)


def test_neighbours_of_the_table(spark):
    rows = spark.read.parquet(f"{TABLES.replace('sf0.01', 'sf0.1')}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = {r.vec_id: np.array(r.embedding, float) for r in rows if r.embedding is not None and None not in r.embedding and np.isfinite(r.embedding).all() and np.any(r.embedding)}
    ids, m = np.array(sorted(x)), np.stack([x[k] for k in sorted(x)])
    unit = m / np.sqrt((m * m).sum(1))[:, None]
    got = queries.QUERIES["op7_neighbours"](spark, TABLES.replace("sf0.01", "sf0.1")).collect()
    assert len(m) * neighbours.SHARE > 5 * neighbours.LEAST
    best = {}
    for q in ids[ids % 50 == 0]:
        s = unit @ unit[np.searchsorted(ids, q)]
        s[ids == q] = -2
        best[int(q)] = sorted(s)[-5]
    assert {r.query_id for r in got} == set(best) and len(got) == 5 * len(best)
    assert np.mean([r.score >= best[r.query_id] - 1e-12 for r in got]) >= 0.9


def test_neighbours_of_huge_tiny_and_odd_vectors(spark):
    for scale in (1.0, 1e200, 1e-200, 1e-310):
        rows = [(k, [scale * (k + 1), scale, scale / 2], k) for k in range(6)] + [(k, [scale * (k + 1), -scale], k) for k in range(50, 52)] + [(0, [scale, scale, scale / 2], 9)]
        got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").withColumn("score", F.lit("clash")), F.col("vec_id") % 50 == 0).collect()
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == 0), key=lambda r: r["rank"])] == [1, 2, 3, 4, 5]
        assert [r.vec_id for r in got if r.query_id == 50] == [51] and all(0 <= r.score <= 1 + 1e-12 for r in got if r.query_id == 0)


def test_linear_models():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    y = x[:, 0] > 0.1
    w = linear.svm(x, np.where(y, 1, -1))
    assert ((x @ w[:-1] + w[-1] > 0) == y).mean() > 0.95
    sparse, _ = linear.lasso_logistic(x, y.astype(float), 0.05)
    assert abs(sparse[0]) > 0.5 and np.abs(sparse[1:]).max() < 0.1


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    step, kept = docs, []
    for _, f in corpus_pipeline.STAGES[:3]:
        step = spark.createDataFrame(f(spark, step, TABLES).collect(), docs.schema)
        kept.append({r.doc_id for r in step.collect()})
        assert step.columns == docs.columns
    assert kept[0] >= kept[1] >= kept[2] and len(kept[0]) > 990
    assert {r.doc_id for r in corpus_pipeline.run(spark, TABLES).collect()} == kept[2]
