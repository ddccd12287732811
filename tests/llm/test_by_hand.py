"""Queries on whole tables against plain Python that shares nothing with them but fitted models."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("sparkwright.llm")

import public_tokenizers as P  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from sparkwright.llm import language, queries, quality, toxicity  # noqa: E402

TABLES = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{TABLES}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def language_of(model, text):
    """Family first, then the language within it, by votes of pairwise machines over byte bigrams and trigrams."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    b = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in text.encode()]
    place = lambda x: (x * 2654435761 % 2**32) >> 20
    seen = Counter(place(((x << 8 | y) + 1) % 2**32) for x, y in zip(b, b[1:]))
    seen.update(place(((x << 16 | y << 8 | z) + 77_777_777) % 2**32) for x, y, z in zip(b, b[1:], b[2:]))
    norm = math.sqrt(sum(seen.values()))
    at = np.array(list(seen))
    margins = model.weights[:, at] @ (np.sqrt(np.array(list(seen.values()), float)) / max(norm, 1e-9)) + model.weights[:, -1] if seen else model.weights[:, -1]
    margin = {}
    for k, (x, y) in enumerate(model.pairs):
        margin[x, y], margin[y, x] = margins[k], -margins[k]

    def choose(classes):
        if len(classes) == 1:
            return classes[0], 1.0
        mine = lambda c: [margin[c, d] for d in classes if d != c]
        best = max(classes, key=lambda c: sum(m > 0 for m in mine(c)) + sum(map(math.tanh, mine(c))) / (2 * len(classes)))
        return best, 1 / (1 + math.exp(-3 * max(-10, min(10, *mine(best), 30))))

    family, sure = choose(model.families)
    lang, within = choose(model.members[family])
    return lang, sure * within


def test_language(spark, docs, texts):
    model = language.fit(docs, language.learnable(F.col("doc_id")))
    got = {r.doc_id: r for r in queries.QUERIES["op4_language"](spark, TABLES).collect()}
    assert len(got) == len(texts)
    for d, t in texts.items():
        lang, score = language_of(model, t)
        assert (got[d].lang_pred, got[d].held_out) == (lang, zlib.crc32(str(d).encode()) % 3 == 1) and got[d].score == pytest.approx(score, abs=1e-3)


def quality_statistics(text):
    data, words = (text or "").encode(), (text or "").split()
    kinds = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": b" \t\r\v\f", "line": b"\n", "bang": b"!", "bar": b"|", "symbol": b"#$%&*@^~_=+<>/\\{}[]`", "high": range(128, 256)}
    n = {k: sum(c in set(v) for c in data) for k, v in kinds.items()}
    n["point"] = len(data) - sum(n.values())
    some, many, again = max(1, len(data)), max(1, len(words)), sum(a == b for a, b in zip(words, words[1:]))
    lines = (text or "").split("\n")
    out = {f"{k}_share": v / some for k, v in n.items()} | {f"{k}_log": np.log1p(float(n[k])) for k in ("bang", "bar", "symbol", "digit", "upper")}
    out |= {"bytes_log": np.log1p(float(len(data))), "words_log": np.log1p(float(len(words))), "word_mean": (len(data) - n["space"] - n["line"]) / many, "line_mean": len(data) / (n["line"] + 1)}
    out |= {"distinct_words": len(set(words)) / many, "repeated_share": again / many, "repeated_log": np.log1p(float(again)), "distinct_lines": len(set(lines)) / len(lines) if text else 0.0}
    return out | {"upper_of_letters": n["upper"] / max(1, n["upper"] + n["lower"]), "longest_word_log": np.log1p(float(max(map(len, words), default=0)))}


def test_quality(spark, docs, texts):
    model = quality.fit(docs, spark.read.parquet(f"{TABLES}/labels.parquet"), quality.learnable(F.col("doc_id")))
    got = {r.doc_id: r for r in queries.QUERIES["op8_quality"](spark, TABLES).collect()}
    assert len(got) == len(texts) and model.rules
    for d, t in texts.items():
        x = quality_statistics(t)
        total = model.bias + sum(w for rule, w in model.rules if all((x[quality.NAMES[f]] > cut) == greater for f, greater, cut in rule))
        assert got[d].score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9) and got[d].predicted == int(got[d].score >= 0.5)


def toxicity_of(model, text):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    s = np.array([next((model.scores[t] for t in (w, *(w[:n] + "*" for n in (8, 7, 6, 5, 4) if len(w) > n)) if t in model.scores), toxicity.BACKGROUND) for w in words])
    found, todo = [], [(0, len(s))]
    while todo:  # the best segment, then what lies left and right of it
        a, b = todo.pop()
        if a < b and s[a:b].max() > 0:
            total = np.concatenate([[0.0], np.cumsum(s[a:b])])
            low = np.minimum.accumulate(total)
            end = int(np.argmax(total - low))
            start = int(np.flatnonzero(total[: end + 1] == low[end])[-1])
            found.append(total[end] - total[start])
            todo += [(a, a + start), (a + end, b)]
    surplus = sorted((x for x in (model.rate * f - math.log(model.place * max(1, len(s))) for f in found) if x > 0), reverse=True)
    best = 0.0
    for r in range(1, len(surplus) + 1):
        t = sum(surplus[:r])
        best = max(best, t - (r - 1) * math.log(max(t, 1)) + math.log(math.factorial(r)) + math.log(math.factorial(r - 1)) - (r - 1) * math.log(2))
    return len(surplus), 1 / (1 + math.exp(-max(-30, min(30, model.law[0] * best + model.law[1] * math.log(len(s) + 1) + model.law[2]))))


def test_toxicity(spark, docs, texts):
    model = toxicity.fit(docs, spark.read.parquet(f"{TABLES}/labels.parquet"), toxicity.learnable(F.col("doc_id")))
    got = {r.doc_id: r for r in queries.QUERIES["op9_toxicity"](spark, TABLES).collect()}
    assert len(got) == len(texts) and model.scores
    for d, t in texts.items():
        n, score = toxicity_of(model, t)
        assert got[d].n_segments == n and got[d].score == pytest.approx(score, abs=1e-6)


def test_streams(spark, texts):
    for r in queries.QUERIES["op1_mpegts"](spark, TABLES).collect():
        b = (texts[r.doc_id] or "").encode()
        whole = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))


def test_bpe(spark, texts):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in queries.QUERIES["op5_bpe"](spark, TABLES).collect():
        ids = np.array(own.encode_ordinary(texts[r.doc_id] or ""), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest())


def packed_by_hand(texts):
    """Pieces (doc_id, piece, start, length, crc) with the library's ids, and the number of sequences of best-fit decreasing."""
    from tokenizers import Tokenizer

    library, pieces = Tokenizer.from_file(P.path("byte_bpe_50k.json")), []
    for d, t in texts.items():
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        pieces += [(d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    gaps: list[int] = []
    for n in sorted((p[3] for p in pieces), reverse=True):
        fit = [k for k, g in enumerate(gaps) if g >= n]
        if fit:
            gaps[min(fit, key=gaps.__getitem__)] -= n
        else:
            gaps.append(2048 - n)
    return sorted(pieces), len(gaps)


def check_packed(rows, texts):
    pieces, n = packed_by_hand(texts)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == pieces
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for v in held.values():
        ends = [0, *(o + n for o, n in sorted(v))]
        assert [o for o, _ in sorted(v)] == ends[:-1] and ends[-1] <= 2048
    assert len(held) == n


def test_packing(spark, texts):
    check_packed(queries.QUERIES["op3_packing"](spark, TABLES).collect(), texts)


def kept_of_components(texts):
    """The least id of each component of texts by all shared shingles."""
    sets, holders = {}, defaultdict(list)
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
        for s in sets[d]:
            holders[s].append(d)
    common = Counter((a, b) for h in holders.values() if len(h) > 1 for i, a in enumerate(h) for b in h[i + 1 :])
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in common.items():
        if 100 * c >= 85 * (len(sets[a]) + len(sets[b]) - c):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {find(d) for d in texts}


def test_pipeline(spark, docs, texts):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = corpus_pipeline.run(spark, TABLES).collect()
    model = language.fit(docs, language.learnable(F.col("doc_id")))
    kept = {d: t for d, t in texts.items() for lang, score in [language_of(model, t)] if lang != "und" and score >= 0.2}
    step = docs.where(F.col("doc_id").isin(list(kept)))
    model = toxicity.fit(step, spark.read.parquet(f"{TABLES}/labels.parquet"), toxicity.learnable(F.col("doc_id")))
    kept = {d: t for d, t in kept.items() if toxicity_of(model, t)[1] < 0.5}
    kept = {d: kept[d] for d in kept_of_components(kept)}
    assert 0 < len(kept) < len(texts)
    check_packed(rows, kept)


def test_pipeline_of_odd_rows(spark, docs):
    """Null and empty texts go, repeated rows and ties leave one row, clashing columns stay, a table without rows gives none."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    clean = docs.where("doc_id % 10 = 0")
    odd = spark.createDataFrame([(9_000_001, None), (9_000_002, ""), (9_000_003, " \n "), (None, "x y z w no id"), (9_000_004, "é word " * 30_000)], "doc_id long, text string")
    rows = clean.unionByName(clean).unionByName(odd, allowMissingColumns=True).withColumn("class", F.lit("clash")).withColumn("at", F.lit(1))
    seen = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        rows = spark.createDataFrame(stage(spark, rows, TABLES).collect(), rows.schema)
        seen.append(Counter(r.doc_id for r in rows.select("doc_id").collect()))
    assert not {9_000_001, 9_000_002, 9_000_003} & set(seen[0]) and max(seen[0].values()) == 2 and max(seen[2].values()) == 1
    assert rows.columns == [*docs.columns, "class", "at"] and set(seen[2]) <= set(seen[1])
    step = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, TABLES)
        assert step.count() == 0
