import json

import plain_rules as plain
import pytest
from pyspark.sql import functions as F
from test_moves import games, spread

from sparkwright.operators import batches, numbering, scoring
from sparkwright.plans import flows, queries
from sparkwright.streaming import labels, passes

TABLES = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(flows.SQL))
def test_equals_sql(spark, same, name):
    same(flows.QUERIES[name](spark, TABLES), flows.SQL[name])


def test_scratch_tables_go_and_kept_ones_stay(spark):
    import os

    from sparkwright import shared

    top = f"{shared.shared_dir(spark)}/sparkwright"
    with shared.scratch(spark) as keep:
        with shared.scratch(spark) as inner:
            one = inner(shared.written(spark.range(3), "a"), "b")
            shared.written(spark.range(4), "c")
        two = keep(one, "kept")
        before = set(os.listdir(top))
        assert one.count() == 3
    gone = before - set(os.listdir(top))
    assert two.count() == 3 and all(x.startswith("scratch-") for x in gone) and not [x for x in os.listdir(top) if x.startswith("scratch-")]
    shared.discard(two)


def test_numbers_of_skewed_groups_with_ties(spark):
    rows = [(None if k % 3 == 0 else f"g{k % 11}", k % 7, k) for k in range(3000)]
    for n in (1, 9):
        got = numbering.numbered(spark.createDataFrame(rows, "g string, o int, k int").repartition(n), ["g"], ["o"]).collect()
        held = {}
        for r in got:
            held.setdefault(r.g, []).append((r.at, r.o, r.size))
        assert len(got) == 3000
        for g, found in held.items():
            found.sort()
            assert [x[0] for x in found] == list(range(len(found))) and [x[1] for x in found] == sorted(x[1] for x in found)
            assert {x[2] for x in found} == {len(found)} and len(found) == sum(r[0] == g for r in rows)
    assert numbering.numbered(spark.createDataFrame([], "g string, o int"), [], ["o"]).count() == 0


def emitted(keys, buffer, slot_of, drain_of):
    """The order of a shuffle through a buffer, row by row."""
    held, out = [], []
    for k in keys:
        if len(held) < buffer:
            held.append(k)
        else:
            s = slot_of(k)
            out.append(held[s])
            held[s] = k
    return out + sorted(held, key=drain_of)


@pytest.mark.parametrize("buffer", [1, 16, 500])
def test_buffered_shuffle_equals_row_by_row(spark, buffer):
    from hashlib import md5

    h = lambda salt, k: md5(f"{salt}|3|{k}".encode()).hexdigest()
    want = {w: emitted([k for k in range(300) if k % 2 == w], buffer, lambda k: int(h("slot", k)[:15], 16) % buffer, lambda k: h("drain", k)) for w in (0, 1)}
    for n in (1, 5):
        rows = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 2).cast("int").alias("w")).repartition(n)
        got = batches.buffer_shuffled(rows, ["w"], ["k"], "k", buffer, 3).collect()
        assert {w: [r.k for r in sorted(got, key=lambda r: r.at) if r.w == w] for w in (0, 1)} == want
    assert buffer == 1 or want[0] != sorted(want[0])


def test_batches_are_exact(spark):
    rows = spark.range(103).select(F.col("id").alias("k"), F.lit("a").alias("g"))
    assert {(r.batch, r["count"]) for r in batches.batched(rows, 10, ["g"], ["k"]).groupBy("batch").count().collect()} == {(b, 10) for b in range(10)}
    assert batches.batched(rows, 10, ["g"], ["k"], drop_last=False).where("batch = 10").count() == 3
    assert batches.batched(rows.where("false"), 10, ["g"], ["k"]).count() == 0


def test_epochs_differ_and_runs_do_not(spark):
    names = spark.createDataFrame([(f"s{k}",) for k in range(12)], "shard string")
    plan = lambda epoch: {(r.worker, r.turn): r.shard for r in batches.shard_plan(names, 5, 1, epoch).collect()}
    assert plan(0) == plan(0) != plan(1) and len(set(plan(1).values())) == 12
    order = passes.epoch_order([f"s{k}" for k in range(12)], 1, 1)
    assert plan(1) == {(k % 5, k // 5): s for k, s in enumerate(order)}


def test_a_batch_that_runs_again_labels_nothing_twice(spark, tmp_path):
    """The second batch fails after it has written; the restart replaces its chunk and goes on."""
    folder = str(tmp_path)
    for k, fens in enumerate((["a", "b", "b"], ["b", "c", None], ["c", "d", "a"])):
        spark.createDataFrame([(f,) for f in fens], "fen string").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = lambda: spark.readStream.schema("fen string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    seen = []

    def label(rows):
        seen.append(sorted(r.fen for r in rows.collect()))
        if len(seen) == 2:
            rows.withColumn("n", F.lit(-1)).write.mode("overwrite").parquet(f"{folder}/out/batch=1")
            raise RuntimeError("lost")
        return rows.withColumn("n", F.lit(len(seen)))

    with pytest.raises(Exception, match="lost"):
        labels.stream_labels(spark, source(), f"{folder}/out", f"{folder}/checkpoint", label).awaitTermination()
    labels.stream_labels(spark, source(), f"{folder}/out", f"{folder}/checkpoint", label).awaitTermination()
    got = [(r.fen, r.n) for r in labels.labelled(spark, f"{folder}/out").collect()]
    assert sorted(f for f, _ in got) == ["a", "b", "c", "d"] and all(n > 0 for _, n in got)
    assert seen[1] == seen[2]
    labels.stream_labels(spark, source(), f"{folder}/out", f"{folder}/checkpoint", label).awaitTermination()
    assert labels.labelled(spark, f"{folder}/out").count() == 4


def test_passes_go_on_after_a_restart(spark, tmp_path):
    folder, names = str(tmp_path), [f"s{k}" for k in range(5)]
    spark.range(50).withColumn("shard", F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).write.partitionBy("shard").parquet(f"{folder}/in")
    read = lambda shards: spark.read.parquet(f"{folder}/in").where(F.col("shard").isin(shards))
    use = lambda rows, n: rows.select("epoch", "turn", "worker", "shard", "id").write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
    for wanted in (1, 3):
        stream = passes.stream_passes(spark, names, read, use, folder, workers=2, seed=4, passes=wanted)
        passes.await_passes(spark, stream, 5, folder, 2, wanted, 120)
    rows = spark.read.parquet(f"{folder}/out").collect()
    for epoch in range(3):
        order = passes.epoch_order(names, 4, epoch)
        assert sorted(r.id for r in rows if r.epoch == epoch) == list(range(50))
        assert all(order[r.turn * 2 + r.worker] == r.shard for r in rows if r.epoch == epoch)


def test_a_pass_without_rows_ends_the_stream(spark, tmp_path):
    folder = str(tmp_path)
    read = lambda shards: spark.createDataFrame([], "shard string, x int")
    stream = passes.stream_passes(spark, ["a", "b"], read, lambda rows, n: None, folder)
    done = passes.await_passes(spark, stream, 2, folder, seconds=120)
    assert done >= 2 and not stream.isActive
    assert passes._Reader({"shards": json.dumps([])}).read({"epoch": 0, "turn": 0})[1] == {"epoch": 0, "turn": 0}


def dense(model, fen):
    """Value, shares and logits of one position by dense features and plain sums."""
    import math

    p = plain.parse_fen(fen)
    cells = p.cells if p.white else [c.swapcase() for r in range(7, -1, -1) for c in p.cells[r * 8 : r * 8 + 8]]
    x = [[0.0] * 18 for _ in range(64)]
    rights = p.rights if p.white else p.rights.swapcase()
    for s in range(64):
        if cells[s] != ".":
            x[s]["PNBRQKpnbrqk".index(cells[s])] = 1.0
        for k, c in enumerate("KQkq"):
            x[s][12 + k] = float(c in rights)
        x[s][17] = min(100, int(fen.split()[4])) / 100 if len(fen.split()) > 4 else 0.0
    if p.passing >= 0:
        x[p.passing if p.white else p.passing ^ 56][16] = 1.0
    flat = [v for row in x for v in row]
    layer = lambda v, name: [sum(a * model[f"{name}.weight"][i][j] for i, a in enumerate(v) if a) + b for j, b in enumerate(model[f"{name}.bias"])]
    norm = lambda v, name: [a / math.sqrt(sum(b * b for b in v) / len(v) + 1e-5) * w for a, w in zip(v, model[name], strict=True)]
    act = lambda v: [a * math.tanh(math.log1p(math.exp(a))) for a in v]
    h = layer(flat, "in")
    for n in ("0", "1"):
        h = [a + b for a, b in zip(h, layer(act(layer(norm(h, f"{n}.norm"), f"{n}.up")), f"{n}.down"), strict=True)]
    h = norm(h, "norm")
    head = act(layer(h, "head"))
    e = [math.exp(v) for v in layer(head, "wdl")]
    return math.tanh(layer(head, "value")[0]), [v / sum(e) for v in e], layer(h, "policy")


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    import numpy as np

    draw = np.random.default_rng(2)
    shapes = {"in": (1152, 6), "0.up": (6, 5), "0.down": (5, 6), "1.up": (6, 5), "1.down": (5, 6), "policy": (6, 4096), "head": (6, 4), "wdl": (4, 3), "value": (4, 1)}
    made = {f"{k}.weight": draw.normal(0, 0.4, s) for k, s in shapes.items()} | {f"{k}.bias": draw.normal(0, 0.2, s[1]) for k, s in shapes.items()}
    made |= {k: draw.normal(1, 0.1, 6) for k in ("0.norm", "1.norm", "norm")}
    path = str(tmp_path_factory.mktemp("model"))
    scoring.write_model(spark, made, path)
    back = scoring.read_model(spark, path)
    assert set(back) == set(made) and all((back[k] == made[k]).all() for k in made)
    return back


def test_scores_equal_dense_sums(spark, model):
    fens = [spread(p) + f" {k % 120} 9" for k, p in enumerate(games(4, 60, 8))][::7] + ["bad", None]
    docs = spark.createDataFrame([(f, 1) for f in fens + fens], "fen string, value_of int").repartition(3)
    got = {r.fen: r for r in scoring.with_scores(docs, model, policy=True).collect()}
    assert got["bad"].value is None and got[None].logits is None
    for f in fens[:-2]:
        value, wdl, logits = dense(model, f)
        assert abs(got[f].value - value) < 1e-9 and max(abs(a - b) for a, b in zip((got[f].win, got[f].draw, got[f].loss), wdl, strict=True)) < 1e-9
        turn = 0 if " w " in f else 56
        want = sorted({(s ^ turn) * 64 + (t ^ turn) for s, t, _ in plain.legal_moves(plain.parse_fen(f))})
        assert got[f].classes == want and all(abs(x - logits[c]) < 1e-9 for c, x in zip(want, got[f].logits, strict=True))
    assert scoring.with_scores(docs.where("false"), model).count() == 0


def test_policy_takes_the_greatest_legal_class(spark, model):
    fens = [spread(p) + " 0 1" for p in games(3, 50, 9)][::5] + ["8/P6k/8/8/8/8/8/K7 w - - 0 1", "7k/5Q2/6K1/8/8/8/8/8 b - - 0 1"]
    docs = spark.createDataFrame([(f,) for f in fens], "fen string")
    got = {r.fen: r for r in scoring.policy_choices(docs, model).collect()}
    illegal = 0
    for f in fens:
        p = plain.parse_fen(f)
        turn, logits, moves = 0 if p.white else 56, dense(model, f)[2], plain.legal_moves(p)
        if not moves:
            assert got[f].move is None and got[f].cp is None
            continue
        best = max(((s ^ turn) * 64 + (t ^ turn) for s, t, _ in moves), key=lambda c: logits[c])
        illegal += max(range(4096), key=lambda c: logits[c]) != best
        assert got[f].move == next(plain.uci(m) for q in ("", "q") for m in moves if (m[0] ^ turn) * 64 + (m[1] ^ turn) == best and m[2] == q)
    assert illegal > len(fens) // 2
    drawn = [{r.fen: r.move for r in scoring.policy_choices(docs, model, 1.0, seed).collect()} for seed in (1, 1, 2)]
    assert drawn[0] == drawn[1] != drawn[2]


def test_value_takes_mate_then_the_least_reply(spark, model):
    mate, stalemate, claim = "6k1/5ppp/8/8/8/8/8/R3K3 w Q - 0 1", "7k/8/5KQ1/8/8/8/8/8 w - - 0 1", "6k1/8/8/8/8/8/8/R3K3 w - - 99 80"
    states = {(r.fen, r.move): r.state for r in scoring.children(spark.createDataFrame([(f,) for f in (mate, stalemate, claim, claim, "8/P6k/8/8/8/8/8/K7 w - - 0 1", "bad")], "fen string")).collect()}
    assert states[mate, "a1a8"] == "mate" and states[stalemate, "g6f7"] == "stalemate" and states[stalemate, "g6g7"] == "mate" and states[claim, "a1a2"] == "fifty"
    assert states["8/P6k/8/8/8/8/8/K7 w - - 0 1", "a7a8n"] == "insufficient" and states["8/P6k/8/8/8/8/8/K7 w - - 0 1", "a7a8q"] == "open"
    fens = [spread(p) + " 0 1" for p in games(2, 30, 10)][::6] + [mate]
    got = {r.fen: r for r in scoring.value_choices(spark.createDataFrame([(f,) for f in fens], "fen string"), model).collect()}
    assert (got[mate].move, got[mate].cp) == ("a1a8", 100_000)
    for f in fens[:-1]:
        p = plain.parse_fen(f)
        scored = []
        for m in plain.legal_moves(p):
            half = 0 if p.cells[m[0]] in "Pp" or p.cells[m[1]] != "." else 1
            after = plain.play(p, m)
            over = not plain.legal_moves(after)
            scored.append((-1e9 if over and plain.in_check(after) else 0.0 if over else dense(model, f"{spread(after)} {half} 1")[0], plain.uci(m)))
        assert got[f].n_moves == len(scored) and got[f].move == min(scored)[1]


def test_models_that_are_too_large_or_incomplete_are_refused(spark, model, tmp_path, monkeypatch):
    scoring.write_model(spark, {k: v for k, v in model.items() if k != "1.norm"}, str(tmp_path / "a"))
    with pytest.raises(ValueError, match="1.norm"):
        scoring.read_model(spark, str(tmp_path / "a"))
    scoring.write_model(spark, model, str(tmp_path / "b"))
    monkeypatch.setattr(scoring, "MOST_PARAMETERS", 100)
    with pytest.raises(ValueError, match="more than 100"):
        scoring.read_model(spark, str(tmp_path / "b"))


def test_captures_go_by_their_victims(spark):
    from sparkwright.functions import board
    from sparkwright.operators import legality

    worth = dict(zip("pnbrqk.", (1, 3, 3, 5, 9, 0, 1), strict=True))
    fens = [spread(p) for p in games(5, 70, 12)][::3]
    rows = legality.with_legal(spark.createDataFrame([(f,) for f in fens], "fen string")).withColumn("cells", board.cells(F.col("fen")))
    for r in rows.withColumn("c", board.ordered_captures(F.col("legal"), F.col("cells"))).collect():
        p = plain.parse_fen(r.fen)
        takes = [m for m in plain.legal_moves(p) if p.cells[m[1]] != "." or (p.cells[m[0]] in "Pp" and (m[0] - m[1]) % 8)]
        assert r.c == [plain.uci(m) for m in sorted(takes, key=lambda m: -worth[p.cells[m[1]].lower()])]
