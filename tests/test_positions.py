import contextlib
import io

import pytest
from pyspark.sql import functions as F

from sparkwright.functions import board, scores
from sparkwright.operators import legality, positions
from sparkwright.plans import queries
from sparkwright.sources import evaluations

TABLES = "/root/testdata/sf0.01"
START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq -"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, same, name):
    same(queries.QUERIES[name](spark, TABLES), queries.SQL[name])


def test_scores(spark):
    rows = [(START, 0, None), (START, 500, None), (START.replace(" w ", " b "), 500, None), (START, None, 0), (START, 30, 2), (START, None, None)]
    df = spark.createDataFrame(rows, "fen string, cp int, mate int").withColumn("q", scores.eval_q(F.col("cp"), F.col("mate"), F.col("fen")))
    got = df.select("q", scores.wdl(F.col("q")).alias("w"), scores.move_q(F.col("cp"), F.col("mate")).alias("m"), scores.q_cp(F.col("q")).alias("cp")).collect()
    assert [None if r.q is None else round(r.q, 3) for r in got] == [0.0, 0.726, -0.726, -1.0, 1.0, None]
    assert got[5].m == 0.0 and got[1].cp == 500
    assert all(abs(sum(r.w) - 1) < 1e-12 and abs(r.w.win - r.w.loss - r.q) < 1e-12 for r in got[:5])


def test_features(spark):
    black = "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq e3 150 1"
    df = spark.createDataFrame([(START + " 0 1",), (black,)], "fen string")
    a, b = df.select(board.planes(F.col("fen")).alias("p"), board.clock(F.col("fen")).alias("c"), F.array_join(board.oriented_cells(F.col("fen")), "").alias("o")).collect()
    pieces = lambda r: [x for x in r.p if x % 18 < 12]
    assert len(pieces(a)) == len(pieces(b)) == 32
    assert all(s * 18 in a.p for s in range(8, 16))
    assert a.c == 0 and b.c == 1.0
    assert [x for x in b.p if x % 18 == 16] == [(20 ^ 56) * 18 + 16]
    assert b.o[:8] == "RNBQKBNR"


def test_move_classes(spark):
    df = spark.createDataFrame([("e2e4",), ("e7e8q",), ("e9e4",), ("",), (None,)], "m string")
    c = board.move_class(F.col("m"))
    got = [tuple(r) for r in df.select(c, board.mirror_class(board.mirror_class(c)), board.mirror_class(c)).collect()]
    assert got[0] == (12 * 64 + 28, 12 * 64 + 28, 52 * 64 + 36) and got[1][0] == 52 * 64 + 60 and got[2:] == [(None,) * 3] * 3


def test_classes_become_moves(spark):
    legal = ["e2e4", "a7a8n", "a7a8q", "b7b8r"]
    rows = [(12 * 64 + 28, legal), (48 * 64 + 56, legal), (49 * 64 + 57, legal), (0, legal), (-1, legal), (4096, legal), (None, legal), (12 * 64 + 28, None)]
    got = spark.createDataFrame(rows, "c int, legal array<string>").select(board.move_of_class(F.col("c"), F.col("legal"))).collect()
    assert [r[0] for r in got] == ["e2e4", "a7a8q", "b7b8r", None, None, None, None, None]


def test_losses(spark):
    df = spark.createDataFrame([([0.0, 0.0, float("-inf")], [0.5, 0.5, 0.0])], "x array<double>, t array<double>")
    x = F.col("x")
    got = df.select(scores.log_sum_exp(x), scores.cross_entropy(x, F.lit(1)), scores.soft_cross_entropy(x, F.col("t")), scores.size_loss(x)).first()
    ln2 = 0.6931471805599453
    assert list(got) == pytest.approx([ln2, ln2, ln2, 1e-3 * ln2**2])


def test_promotions_add_up(spark):
    fen = "8/P6k/8/8/8/8/8/K7 w - -"
    v = spark.createDataFrame([(fen, ["a7a8q", "a7a8r", "a1a2"], [100, 100, 100], [None] * 3)], "fen string, moves array<string>, cp array<int>, mate array<int>")
    got = {r["class"]: round(r.weight, 6) for r in positions.policy_targets(v).collect()}
    assert got == {48 * 64 + 56: 0.666667, 8: 0.333333}


def test_legality(spark):
    rows = [(START, "e2e4", 1), (START, "e2e5", 1), ("bad", "e2e4", 1), (START, "zz", 1), (START, None, 1), (START, "d2d4", None)]
    df = spark.createDataFrame(rows, "fen string, line string, cp int").withColumn("mate", F.lit(None).cast("int"))
    assert {r.reason: r.n for r in legality.drop_reasons(df).collect()} == {"kept": 1, "illegal move": 1, "bad position": 1, "bad move": 1, "no line": 1, "no score": 1}


def test_empty(spark):
    raw = spark.createDataFrame([], evaluations.SCHEMA + ", event_id bigint")
    assert positions.best_per_position(raw).count() == positions.action_values(raw).count() == 0
    assert positions.report(raw, positions.best_per_position(raw)).first().n_raw == 0


def test_shards(spark, tmp_path):
    raw = evaluations.position_evals(spark.read.parquet(f"{TABLES}/events.parquet")).drop("event_id").limit(50)
    evaluations.write_buckets(raw, str(tmp_path / "flat"), 3)
    assert evaluations.read_shards(spark, str(tmp_path / "flat"), "flat").count() == 50
    assert evaluations.read_shards(spark, str(tmp_path), "deep").count() == 50
    assert evaluations.labelled_positions(spark, str(tmp_path / "flat")).count() == raw.select("fen").distinct().count()


def _plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_plans(spark):
    assert "WindowGroupLimit" in _plan(queries.best_positions(spark, TABLES))
    plan = _plan(spark.read.parquet(f"{TABLES}/events.parquet").where("user_id = 3").select("event_id"))
    assert "EqualTo(user_id,3)" in plan and "ReadSchema: struct<event_id:bigint,user_id:bigint>" in plan


def test_damaged_shards_are_not_skipped(spark, tmp_path):
    spark.range(3).selectExpr("'f' fen", "'l' line", "1 cp", "1 mate", "1 depth", "id knodes").coalesce(1).write.parquet(str(tmp_path / "flat"))
    (tmp_path / "flat" / "damaged.parquet").write_bytes(b"PAR1 nothing PAR1")
    with pytest.raises(Exception, match="damaged"):
        evaluations.read_shards(spark, str(tmp_path / "flat"), "flat").count()


def test_illegal_moves_get_no_weight(spark):
    v = spark.createDataFrame([(START, ["e2e4", "zz", "e2e5", "d2d4"], [10, 900, 900, 10], [None] * 4), (START + " 1 1", ["e2e5"], [1], [None]), ("bad", ["e2e4"], [1], [None])], "fen string, moves array<string>, cp array<int>, mate array<int>")
    assert {(r.fen, r["class"]): round(r.weight, 6) for r in positions.policy_targets(v).collect()} == {(START, 12 * 64 + 28): 0.5, (START, 11 * 64 + 27): 0.5}
    assert [r.moves for r in legality.keep_legal_moves(v, 2).collect()] == [["e2e4", "d2d4"]]


def test_metrics_of_known_rows(spark):
    rows = [([0.5, 0.1, 0.5], [3, 4, 5], [3, 9, 8, 7, 6], 0.5), ([0.5, 0.1], [3, 4], [4, 3], 0.0), ([0.2, 0.19], [1, 2], [7, 8, 9, 6, 5], 0.2)]
    got = positions.move_metrics(spark.createDataFrame(rows, "q array<double>, classes array<int>, top5 array<int>, value double")).first()
    assert got.asDict() == pytest.approx({"n": 3, "top1": 1 / 3, "top5": 2 / 3, "points_lost": 10.0, "off_list": 1 / 3, "blunders": 2 / 3, "value_mse": 0.25 / 3}, abs=1e-6)
    none = positions.move_metrics(spark.createDataFrame([], "q array<double>, classes array<int>, top5 array<int>, value double")).first()
    assert set(none) == {0}


def test_stream_equals_batch(spark, tmp_path):
    from sparkwright.streaming import upsert

    raw = evaluations.position_evals(spark.read.parquet(f"{TABLES}/events.parquet")).limit(600)
    rows = raw.unionByName(spark.createDataFrame([(10_000 + k, START, "e2e4", k, None, 30, 100 + k) for k in range(200)], raw.schema))
    rows = spark.createDataFrame(rows.collect(), raw.schema)
    for k in range(3):
        rows.where(F.col("event_id") % 3 == k).coalesce(1).write.parquet(str(tmp_path / f"made{k}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        next((tmp_path / f"made{k}").glob("*.parquet")).rename(tmp_path / "in" / f"{k}.parquet")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    upsert.stream_best(spark, source, str(tmp_path / "out"), str(tmp_path / "check"), buckets=8).awaitTermination()
    held = {r["bucket"]: r["version"] for r in spark.read.parquet(str(tmp_path / "out/buckets/version=1")).collect()}
    kept = {(int(p.parent.name[8:]), int(p.name[7:])) for p in (tmp_path / "out" / "rows").glob("version=*/bucket=*")}
    assert all(v == 2 or held[b] == v for v, b in kept) and not (tmp_path / "out/buckets/version=0").exists()
    got = upsert.best_rows(spark, str(tmp_path / "out"), 2, rows.schema)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, positions.deepest(rows).collect()))
    assert got.where(F.col("fen") == START).first().knodes == 299 and got.where("fen is null").count() == 1


def test_shards_fall_back(spark, tmp_path):
    rows = spark.createDataFrame([("f", "l", 1, None, 3, 4)], evaluations.SCHEMA)
    evaluations.append_rows(rows, str(tmp_path))
    evaluations.append_rows(rows, str(tmp_path))
    assert evaluations.read_shards(spark, str(tmp_path)).count() == evaluations.read_shards(spark, str(tmp_path), "deep").count() == 2
    rows.coalesce(1).write.parquet(str(tmp_path / "made"))
    (tmp_path / "data").mkdir()
    next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / "data" / "data_0.parquet")
    assert evaluations.read_shards(spark, str(tmp_path)).count() == 1
    evaluations.write_partitions(rows.unionByName(rows), str(tmp_path / "parts"), 4)
    evaluations.write_partitions(rows, str(tmp_path / "parts"), 4)
    back = spark.read.parquet(str(tmp_path / "parts"))
    assert back.count() == 1 and "bucket" in back.columns


def test_only_chosen_searches_are_packed(spark):
    plan = _plan(queries.action_values(spark, TABLES))
    assert plan.index("LeftSemi") < plan.index("collect_list") or "LeftSemi" in plan
    raw = spark.createDataFrame([(k, START, f"e2e{3 + k % 2}", k, None, 10 + k % 3, None) for k in range(7)] + [(9, None, "e2e4", 1, None, 1, 1)], "event_id long, fen string, line string, cp int, mate int, depth int, knodes long")
    assert [(r.depth, len(r.moves)) for r in positions.action_values(raw).collect()] == [(10, 3)]


def test_rows_of_one_split_and_order(spark):
    rows = spark.createDataFrame([(f"f{k}", k % 3 == 0 if k % 4 else None, k) for k in range(40)], "fen string, is_val boolean, depth int")
    assert positions.in_split(rows, True).count() + positions.in_split(rows, False).count() == 40
    assert positions.first_rows(rows, 5, 1).count() == 5 and positions.first_rows(rows, 0).count() == positions.shuffled(rows, 3).count() == 40
    assert positions.deep_enough(rows, 10).count() == 30 and positions.deep_enough(rows, 0).count() == 40


def test_drawn_classes_follow_their_chances(spark):
    df = spark.range(4000).withColumn("x", F.expr("array(0.0D, ln(3.0D), 9.0D)")).withColumn("legal", F.expr("array(0, 1)"))
    uniform = lambda c: (positions.split_hash(F.concat_ws("|", F.col("id").cast("string"), c.cast("string")), "u") % 999_983 + 1) / 999_985
    got = df.select(scores.drawn_class(F.col("x"), F.col("legal"), 1.0, uniform).alias("c"), scores.ordered_classes(F.col("x"), F.col("legal"), 1).alias("o")).agg(F.avg("c"), F.min("o")[0]).first()
    assert abs(got[0] - 0.75) < 0.03 and got[1] == 1
