"""Registered queries of the evaluation operators, each with DuckDB SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import board, scores
from ..operators import legality, positions, scoring
from ..shared import discard, new_folder
from ..sources.evaluations import LEGAL_SQL, RAW_SQL, position_evals

HASH = lambda key, salt: f"CAST(('0x' || substr(md5('{salt}|' || {key}), 1, 15)) AS BIGINT)"
BLACK = "split_part(fen, ' ', 2) = 'b'"
Q_WHITE = "CASE WHEN mate IS NOT NULL THEN CASE WHEN mate > 0 THEN 0.9999 ELSE -0.9999 END WHEN cp IS NOT NULL THEN 2 / (1 + exp(-0.00368208 * cp)) - 1 END"
Q = f"(CASE WHEN {BLACK} THEN -({Q_WHITE}) ELSE {Q_WHITE} END + 0.0::DOUBLE)"
MOVE_Q = "coalesce(CASE WHEN z.mate IS NOT NULL THEN CASE WHEN z.mate > 0 THEN 0.9999 ELSE -0.9999 END ELSE 2 / (1 + exp(-0.00368208 * z.cp)) - 1 END, 0.0)::DOUBLE"
BEST = f"""best AS (SELECT fen, line, cp, mate, depth, knodes, {HASH("fen", "split")} % 50 = 0 AS is_val FROM (
  SELECT *, row_number() OVER (PARTITION BY fen ORDER BY depth DESC NULLS LAST, coalesce(knodes, 0) DESC, {Q} DESC NULLS LAST, line ASC NULLS LAST, event_id) AS r FROM raw) WHERE r = 1 AND depth >= 12)"""
PACKED = f"""searches AS (SELECT fen, depth, knodes, count(*) AS n_moves, list({{'move': split_part(line, ' ', 1), 'cp': CASE WHEN {BLACK} THEN -cp ELSE cp END, 'mate': CASE WHEN {BLACK} THEN -mate ELSE mate END}}
  ORDER BY {Q} IS NULL, -{Q} + 0.0, split_part(line, ' ', 1), event_id) AS items FROM raw WHERE length(line) > 0 AND fen IS NOT NULL GROUP BY fen, depth, knodes),
packed AS (SELECT fen, depth, items, {HASH("fen", "split")} % 50 = 0 AS is_val FROM (SELECT *, row_number() OVER (PARTITION BY fen ORDER BY n_moves DESC, depth DESC NULLS LAST, knodes DESC NULLS LAST) AS r FROM searches) WHERE r = 1)"""


# The model of the scoring queries: weight (i, j) of the layer numbered n follows from this rule, which the SQL has too; all are exact binary fractions.
WIDTH, HIDDEN = 4, 3
SMALL = {
    "in.weight": (1152, WIDTH), "in.bias": (1, WIDTH), "0.norm": (1, WIDTH), "0.up.weight": (WIDTH, HIDDEN), "0.up.bias": (1, HIDDEN), "0.down.weight": (HIDDEN, WIDTH), "0.down.bias": (1, WIDTH), "norm": (1, WIDTH),
    "policy.weight": (WIDTH, 4096), "policy.bias": (1, 4096), "head.weight": (WIDTH, HIDDEN), "head.bias": (1, HIDDEN), "wdl.weight": (HIDDEN, 3), "wdl.bias": (1, 3), "value.weight": (HIDDEN, 1), "value.bias": (1, 1),
}


def _weight(n: int, i, j):
    return ((i * 1031 + j * 613 + n * 97) % 4099 - 2049) / 2048


def small_model() -> scoring.Model:
    made = {name: _weight(n, np.arange(a)[:, None], np.arange(b)[None, :]) for n, (name, (a, b)) in enumerate(SMALL.items())}
    return {name: w if name.endswith(".weight") else w[0] for name, w in made.items()}


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return position_evals(_events(spark, d))


def raw_rows(spark, d):
    return _raw(spark, d)


def best_positions(spark, d):
    return positions.best_per_position(_raw(spark, d))


def action_values(spark, d):
    v = positions.action_values(_raw(spark, d))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",", "-")
    return v.select("fen", text("moves").alias("moves"), text("cp").alias("cps"), text("mate").alias("mates"), "depth", "is_val")


def position_scores(spark, d):
    q = scores.eval_q(F.col("cp"), F.col("mate"), F.col("fen"))
    rows = _raw(spark, d).select("event_id", q.alias("q")).where("q is not null")
    w = scores.wdl(F.col("q"))
    r = lambda c: F.round(c, 8) + 0.0
    return rows.select("event_id", r(F.col("q")).alias("q"), r(w["win"]).alias("win"), r(w["draw"]).alias("draw"), r(w["loss"]).alias("loss"), scores.q_cp(F.col("q")).alias("cp_back"))


def policy_targets(spark, d):
    return positions.policy_targets(positions.action_values(_raw(spark, d))).withColumn("weight", F.round("weight", 6))


def resume_positions(spark, d):
    done = positions.best_per_position(_raw(spark, d), 20).select("fen")
    return positions.resume(_raw(spark, d).select("fen").where("fen is not null").distinct(), done)


def sample_positions(spark, d):
    return positions.sample_positions(_raw(spark, d), 100, 7)


def clean_report(spark, d):
    raw = _raw(spark, d)
    return positions.report(raw, positions.best_per_position(raw))


def position_filters(spark, d):
    raw = _raw(spark, d)
    return positions.deep_enough(raw, 13).where((F.length("line") > 0) & F.rlike("fen", F.lit(board.FEN))).groupBy(board.field(F.col("fen"), 2).alias("side")).agg(
        F.count("*").alias("n"), F.count_if(positions.is_validation(F.col("fen"))).alias("n_val"), F.count_if(F.col("cp").isNull() & F.col("mate").isNull()).alias("n_unscored"))


def move_classes(spark, d):
    fen, move = board.normal_fen(F.col("fen")), board.first_move(F.col("line"))
    rows = _raw(spark, d).where(F.length("line") > 0)
    return rows.select("event_id", fen.alias("full_fen"), move.alias("move"), board.move_class(move).alias("class"), board.mirror_class(board.move_class(move)).alias("mirrored"), board.oriented_class(move, F.col("fen")).alias("oriented"), board.material(F.col("fen")).alias("material"))


def position_features(spark, d):
    rows = _raw(spark, d).select("fen").distinct().where(F.rlike("fen", F.lit(board.FEN)))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    rows = board.with_features(rows.withColumn("full", board.normal_fen(F.col("fen"))), "full").withColumn("cells", board.cells(F.col("full")))
    return rows.select("fen", F.size("planes").alias("n_set"), text("planes").alias("set_features"), F.array_join("oriented", "").alias("oriented"), "clock", text(board.legacy_indices(F.col("full"), F.col("cells"))).alias("legacy"))


def square_relations(spark, d):
    """Ids of the place of the goal relative to the start of the first moves."""
    rows = _raw(spark, d).select("event_id", board.move_class(board.first_move(F.col("line"))).alias("class")).where("class is not null")
    return rows.select("event_id", "class", board.relation((F.col("class") % 64).cast("int"), F.floor(F.col("class") / 64).cast("int")).alias("relation"))


def training_rows(spark, d):
    """Whole training examples of rows with a score and a legal first move: features, legal classes, the class wanted, result shares and value."""
    fen, move = F.col("fen"), board.first_move(F.col("line"))
    rows = _raw(spark, d).where(F.length("line") > 0).select("event_id", "fen", move.alias("move"), scores.eval_q(F.col("cp"), F.col("mate"), fen).alias("q")).where("q is not null")
    rows = legality.with_legal(rows).where(legality.is_legal(F.col("move"), F.col("legal"))).withColumn("full", board.normal_fen(fen))
    rows = board.with_features(rows, "full").withColumn("wdl", scores.wdl(F.col("q")))
    seen = lambda c: F.when(board.field(fen, 2) == "b", board.mirror_class(c)).otherwise(c)
    classes = F.array_sort(F.transform(legality.legal_classes(F.col("legal")), seen))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    r = lambda c: F.round(c, 8) + 0.0
    return rows.select("event_id", text("planes").alias("features"), "clock", text(classes).alias("legal"), board.oriented_class(F.col("move"), fen).alias("target"), r("wdl.win").alias("win"), r("wdl.draw").alias("draw"), r("wdl.loss").alias("loss"), r("q").alias("value"))


def capture_order(spark, d):
    """Legal captures of each position, the dearest victim first."""
    rows = legality.legal_moves(_raw(spark, d)).where("legal is not null").withColumn("cells", board.cells(F.col("fen")))
    rows = rows.withColumn("captures", board.ordered_captures(F.col("legal"), F.col("cells")))
    return rows.select("fen", F.size("captures").alias("n_captures"), F.array_join("captures", ",").alias("captures"))


def _model(spark) -> scoring.Model:
    """The small model of the rule ``SMALL``, written to and read from the shared store."""
    path = new_folder(spark, "model")
    scoring.write_model(spark, small_model(), path)
    model = scoring.read_model(spark, path)
    discard(spark.read.parquet(path))
    return model


def model_scores(spark, d):
    """Value and result shares of each distinct position."""
    rows = scoring.with_scores(_raw(spark, d).select("fen").where("fen is not null").distinct(), _model(spark)).where("value is not null")
    return rows.select("fen", *[(F.round(c, 6) + 0.0).alias(c) for c in ("value", "win", "draw", "loss")])


def policy_choices(spark, d):
    """The legal move of the greatest logit in each distinct position, with the position's value."""
    return scoring.policy_choices(_raw(spark, d), _model(spark))


def value_choices(spark, d):
    """The move after which the other side's value is least, in each distinct position."""
    return scoring.value_choices(_raw(spark, d), _model(spark))


def legal_counts(spark, d):
    rows = legality.legal_moves(_raw(spark, d).select("fen"))
    return rows.select("fen", F.size("legal").alias("n_legal"))


def drop_reasons(spark, d):
    return legality.drop_reasons(_raw(spark, d))


def legal_rows(spark, d):
    """Rows whose first move is legal, with the move of its class that the position has."""
    rows = _raw(spark, d).select("event_id", "fen", board.first_move(F.col("line")).alias("move"))
    kept = legality.with_legal(rows).where(legality.is_legal(F.col("move"), F.col("legal")))
    return kept.select("event_id", "move", board.move_of_class(board.move_class(F.col("move")), F.col("legal")).alias("of_class"))


def ended_positions(spark, d):
    return legality.terminal_positions(_raw(spark, d))


def validation_sample(spark, d):
    values = positions.in_split(positions.action_values(_raw(spark, d), least_moves=2), True)
    return positions.first_rows(values.select("fen", F.size("moves").alias("n_moves")), 20, 3)


def move_metrics(spark, d):
    """Metrics over a stand-in prediction: legal classes ordered by a hash of position and class."""
    v = legality.keep_legal_moves(positions.action_values(_raw(spark, d), least_moves=2), least_moves=2)
    q = F.transform(F.arrays_zip("cp", "mate"), lambda z: scores.move_q(z["cp"], z["mate"]))
    h = lambda c: positions.split_hash(F.concat(F.col("fen"), F.lit("|"), c.cast("string")), "guess")
    ranked = F.transform(F.array_sort(F.transform("legal", lambda c: F.struct(h(c).alias("h"), c.alias("c")))), lambda s: s["c"])
    value = (positions.split_hash(F.col("fen"), "value") % 1000) / 1000
    return positions.move_metrics(v.select(q.alias("q"), "classes", F.slice(ranked, 1, 5).alias("top5"), value.alias("value")))


def move_choices(spark, d):
    """Move ordering and drawing with each embedding as logits; classes whose number shares no factor 3 with the id are legal."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    legal = F.filter(F.transform("v", lambda x, i: i), lambda i: (i + F.col("vec_id")) % 3 != 0)
    uniform = lambda c: (positions.split_hash(F.concat_ws("|", F.col("vec_id").cast("string"), c.cast("string")), "draw") % 1_000_003 + 1) / 1_000_005
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return e.withColumn("legal", legal).select("vec_id", text(scores.ordered_classes(F.col("v"), F.col("legal"), 4)).alias("ordered"), scores.drawn_class(F.col("v"), F.col("legal"), 0.5, uniform).alias("drawn"), scores.drawn_class(F.col("v"), F.col("legal"), 0.0, uniform).alias("greatest"))


def schedules(spark, d):
    """The learning rate's share and the clock's budget as columns over event ids."""
    e = F.col("event_id")
    rate = scores.learning_rate(e % 1200, 100, 1000, 0.1)
    budget = scores.clock_budget(e * 37 % 600_000, e % 7 * 500, F.when(e % 3 != 0, (e % 60).cast("int")))
    return _events(spark, d).select("event_id", F.round(rate, 9).alias("rate"), F.round(budget, 6).alias("budget"))


def best_line_items(spark, d):
    """Keep-best on a second table: the dearest item of each order."""
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    order = [F.desc("l_extendedprice"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"]
    from pyspark.sql import Window

    best = items.withColumn("r", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))).where("r = 1")
    return best.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


def embedding_softmax(spark, d):
    """Softmax, greatest entry and five best places of each embedding."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    p = e.withColumn("p", scores.soft_policy(F.col("v")))
    top = F.slice(F.array_sort(F.transform("v", lambda x, i: F.struct((-x).alias("m"), i.alias("i")))), 1, 5)
    return p.select("vec_id", F.round(F.array_max("p"), 7).alias("p_max"), F.array_position("v", F.array_max("v")).alias("best"), F.array_join(F.transform(top, lambda s: s["i"].cast("string")), ",").alias("top5"))


def policy_losses(spark, d):
    """Mean loss terms with each embedding as logits; the class and the shares wanted follow from its id."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    wanted = F.col("vec_id") % F.size("v")
    shares = F.transform("v", lambda x, i: F.when(i == wanted, 0.75).when(i == 0, 0.25).otherwise(0.0))
    q = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.get("v", F.lit(0))))
    hard, soft, size = scores.cross_entropy(F.col("v"), wanted), scores.soft_cross_entropy(F.col("v"), shares), scores.size_loss(F.col("v"))
    w = scores.wdl(q)
    result = scores.wdl_cross_entropy(F.slice("v", 2, 3), F.array(w["win"], w["draw"], w["loss"]))
    value = F.pow(F.get("v", F.lit(4)) - q, 2)
    mean = lambda c: F.round(F.avg(c), 6)
    right, right_soft = scores.first_greatest(F.col("v")) == wanted, scores.first_greatest(F.col("v")) == scores.first_greatest(shares)
    return e.agg(
        F.count("*").alias("n"), mean(hard).alias("hard"), mean(soft).alias("soft"), mean(size).alias("size"), mean(result).alias("result"), mean(value).alias("value"),
        mean(scores.total_loss(hard, result, value, size, (1.0, 0.5, 2.0))).alias("total"), mean(scores.total_loss(soft, result, value, size)).alias("total_soft"),
        mean(right.cast("int")).alias("top1"), mean(right_soft.cast("int")).alias("top1_soft"),
    )


_NAMES = "policy_losses raw_rows best_positions action_values position_scores policy_targets resume_positions sample_positions clean_report position_filters move_classes position_features square_relations legal_counts legal_rows ended_positions validation_sample drop_reasons move_metrics move_choices schedules best_line_items embedding_softmax training_rows capture_order model_scores policy_choices value_choices"
QUERIES = {name: globals()[name] for name in _NAMES.split()}

_CLASS = lambda m: f"((ascii({m}[1]) - 97) + (ascii({m}[2]) - 49) * 8) * 64 + (ascii({m}[3]) - 97) + (ascii({m}[4]) - 49) * 8"
_STEP = "case when x.mate is not null then case when x.mate > 0 then 0.9999 else -0.9999 end when x.cp is not null then 2 / (1 + exp(-0.00368208 * x.cp)) - 1 else 0.0 end"
_SEEN = lambda c: f"xor({c}, CASE WHEN {BLACK} THEN 3640 ELSE 0 END)"
# (fen, class) of legal moves, and the moves of packed positions that are among them: place in the list, class, how many there are.
LISTED = f"""law AS (SELECT fen, n_moves, items, legal FROM (SELECT *, len(items) AS n_moves FROM packed) JOIN lawful ON starts_with(fen, position)),
allowed AS (SELECT DISTINCT fen, CAST({_SEEN(_CLASS("m"))} AS INT) AS class FROM (SELECT fen, unnest(legal) AS m FROM law)),
named AS (SELECT fen, n_moves, nth, x, CASE WHEN regexp_full_match(x.move, '[a-h][1-8][a-h][1-8][qrbn]?') THEN CAST({_SEEN(_CLASS("x.move"))} AS INT) END AS class FROM (SELECT fen, n_moves, generate_subscripts(items, 1) AS nth, unnest(items) AS x FROM law)),
listed AS (SELECT fen, n_moves, nth, x, class, count(*) OVER (PARTITION BY fen) AS count FROM named JOIN allowed USING (fen, class))"""
_SPREAD = "split_part(fen, ' ', 1)"
for _n in range(1, 9):
    _SPREAD = f"replace({_SPREAD}, '{_n}', '{'.' * _n}')"
_RIGHT = lambda right, king, rook, king_is, rook_is, plane: f"CASE WHEN contains(rights, '{right}') AND oriented[{king + 1}] = '{king_is}' AND oriented[{rook + 1}] = '{rook_is}' THEN [i * 18 + {plane} FOR i IN range(64)] ELSE [] END"
#: Features of the positions f(fen, full_fen, black) that ``source`` selects.
_WHOLE = "f AS (SELECT DISTINCT fen, CASE WHEN len(string_split(fen, ' ')) = 4 THEN fen || ' 0 1' ELSE fen END AS full_fen, split_part(fen, ' ', 2) = 'b' AS black FROM raw WHERE len(string_split(fen, '/')) = 8)"
FEATURES = f"""{{source}},
  x AS (SELECT *, string_split({_SPREAD}, '/') AS rows, CASE WHEN black THEN translate(split_part(fen, ' ', 3), 'KQkq', 'kqKQ') ELSE split_part(fen, ' ', 3) END AS rights, split_part(fen, ' ', 4) AS passing FROM f),
  o AS (SELECT *, array_to_string(list_reverse(rows), '') AS board, CASE WHEN black THEN translate(array_to_string(rows, ''), 'PNBRQKpnbrqk', 'pnbrqkPNBRQK') ELSE array_to_string(list_reverse(rows), '') END AS oriented FROM x),
  s AS (SELECT *, list_concat([i * 18 + instr('PNBRQKpnbrqk', oriented[i + 1]) - 1 FOR i IN range(64) IF oriented[i + 1] <> '.'], {_RIGHT("K", 4, 7, "K", "R", 12)}, {_RIGHT("Q", 4, 0, "K", "R", 13)}, {_RIGHT("k", 60, 63, "k", "r", 14)}, {_RIGHT("q", 60, 56, "k", "r", 15)},
    CASE WHEN passing = '-' THEN [] ELSE [xor(ascii(passing[1]) - 97 + (ascii(passing[2]) - 49) * 8, CASE WHEN black THEN 56 ELSE 0 END) * 18 + 16] END) AS planes FROM o)"""
_CLOCK = "(least(CAST(split_part(full_fen, ' ', 5) AS INT), 100) / 100::DOUBLE)"
_RULE = lambda name, i, j: f"(((({i}) * 1031 + ({j}) * 613 + {list(SMALL).index(name) * 97}) % 4099 - 2049) / 2048::DOUBLE)"


def _linear(x: str, name: str) -> str:
    """A layer's outputs as a list."""
    n, m = SMALL[f"{name}.weight"]
    terms = lambda j: " + ".join([*[f"{x}[{i + 1}] * {_RULE(f'{name}.weight', i, j)}" for i in range(n)], _RULE(f"{name}.bias", 0, j)])
    return "[" + ", ".join(terms(j) for j in range(m)) + "]"


_MISH = lambda x: f"[v * tanh(ln(1 + exp(v))) FOR v IN {x}]"
_NORM = lambda x, name: "[" + ", ".join(f"{x}[{j + 1}] / sqrt(list_avg([v * v FOR v IN {x}]) + 1e-5::DOUBLE) * {_RULE(name, 0, j)}" for j in range(WIDTH)) + "]"
_INPUT = lambda j: f"list_sum([{_RULE('in.weight', 'p', j)} FOR p IN planes]) + {_CLOCK} * list_sum([{_RULE('in.weight', 'p * 18 + 17', j)} FOR p IN range(64)]) + {_RULE('in.bias', 0, j)}"
_LAST = "u[1]", "u[2]", "u[3]"
#: The model on the features: x is the last hidden layer of each position, value and u (logits of win, draw, loss) its outputs.
FORWARD = f"""x0 AS (SELECT fen, black, [{", ".join(_INPUT(j) for j in range(WIDTH))}] AS x FROM s), x1 AS (SELECT fen, black, x, {_NORM("x", "0.norm")} AS h FROM x0),
x2 AS (SELECT fen, black, x, {_MISH(_linear("h", "0.up"))} AS h FROM x1), x3 AS (SELECT fen, black, x, {_linear("h", "0.down")} AS h FROM x2), x4 AS (SELECT fen, black, [x[k] + h[k] FOR k IN range(1, {WIDTH + 1})] AS x FROM x3),
x5 AS (SELECT fen, black, {_NORM("x", "norm")} AS x FROM x4), x6 AS (SELECT fen, black, x, {_MISH(_linear("x", "head"))} AS h FROM x5),
m AS (SELECT fen, black, x, tanh({_linear("h", "value")}[1]) AS value, {_linear("h", "wdl")} AS u FROM x6)"""
_CP = "CAST(round_even(ln(({0}) / (1 - ({0}))) / 0.00368208, 0) AS INT)"
_CHANCE = lambda q: f"greatest(least(({q} + 1) / 2, 1 - 1e-6::DOUBLE), 1e-6::DOUBLE)"
_NUMBER = lambda name: f"((ascii({name}[1]) - 97) + (ascii({name}[2]) - 49) * 8)"
_NAME = lambda n: f"chr(CAST(97 + {n} % 8 AS INT)) || chr(CAST(49 + {n} // 8 AS INT))"
#: Positions after each legal move, with dots for empty squares: (fen, move, child); kings that go two files castle, pawns that change the file for an empty square take in passing.
CHILDREN = f"""c0 AS (SELECT s.fen, s.black, s.board, split_part(s.full_fen, ' ', 5) AS half, split_part(s.full_fen, ' ', 6) AS nth, split_part(s.full_fen, ' ', 3) AS rights, legal, unnest(legal) AS move FROM s JOIN lawful ON starts_with(s.fen, position)),
c1 AS (SELECT *, {_NUMBER("move[1:2]")} AS a, {_NUMBER("move[3:4]")} AS z FROM c0),
c2 AS (SELECT *, board[a + 1] AS piece, upper(board[a + 1]) = 'K' AND abs(a - z) = 2 AS castles, upper(board[a + 1]) = 'P' AND a % 8 <> z % 8 AND board[z + 1] = '.' AS passes FROM c1),
c3 AS (SELECT *, [CASE WHEN i = z THEN CASE WHEN len(move) = 5 THEN CASE WHEN black THEN move[5] ELSE upper(move[5]) END ELSE piece END WHEN i = a THEN '.' WHEN castles AND i = (a + z) // 2 THEN CASE WHEN black THEN 'r' ELSE 'R' END
  WHEN castles AND i = CASE WHEN z > a THEN z + 1 ELSE z - 2 END THEN '.' WHEN passes AND i = z + CASE WHEN black THEN 8 ELSE -8 END THEN '.' ELSE board[i + 1] END FOR i IN range(64)] AS cells FROM c2),
kids AS (SELECT fen, move, array_to_string(cells, '') AS after, array_to_string([array_to_string(cells[r * 8 + 1:r * 8 + 8], '') FOR r IN [7, 6, 5, 4, 3, 2, 1, 0]], '/') || CASE WHEN black THEN ' w ' ELSE ' b ' END || rights || ' '
  || CASE WHEN upper(piece) = 'P' AND abs(a - z) = 16 THEN {_NAME("((a + z) // 2)")} ELSE '-' END || ' ' || CASE WHEN upper(piece) = 'P' OR board[z + 1] <> '.' THEN 0 ELSE CAST(half AS INT) + 1 END || ' ' || (CAST(nth AS INT) + CAST(black AS INT)) AS child FROM c3)"""
SQL = {
    "policy_losses": """WITH x AS (SELECT vec_id, len(embedding) AS k, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
  l AS (SELECT vec_id, ln(sum(exp(v))) AS l, max(v) FILTER (i = vec_id % k) AS v, max(v) FILTER (i = 0) AS v0, any_value(vec_id % k) AS w, ln(sum(exp(v)) FILTER (i BETWEEN 1 AND 3)) AS r,
    max(v) FILTER (i = 1) AS v1, max(v) FILTER (i = 2) AS v2, max(v) FILTER (i = 3) AS v3, max(v) FILTER (i = 4) AS v4, arg_max(i, (v, -i)) AS best FROM x GROUP BY vec_id),
  q AS (SELECT *, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, v0)) AS q FROM l),
  t AS (SELECT *, l - v AS hard, 0.75::DOUBLE * (l - v) + CASE WHEN w = 0 THEN 0 ELSE 0.25::DOUBLE * (l - v0) END AS soft, 0.001::DOUBLE * l * l AS size, (v4 - q) * (v4 - q) AS value,
    (1 - 0.5::DOUBLE * (1 - abs(q)) + q) / 2 * (r - v1) + 0.5::DOUBLE * (1 - abs(q)) * (r - v2) + (1 - 0.5::DOUBLE * (1 - abs(q)) - q) / 2 * (r - v3) AS result FROM q)
  SELECT count(*) AS n, round(avg(hard), 6) AS hard, round(avg(soft), 6) AS soft, round(avg(size), 6) AS size, round(avg(result), 6) AS result, round(avg(value), 6) AS value,
    round(avg(hard + 0.5::DOUBLE * result + 2 * value + size), 6) AS total, round(avg(soft + result + value + size), 6) AS total_soft,
    round(avg(CAST(best = w AS INT)), 6) AS top1, round(avg(CAST(best = w AS INT)), 6) AS top1_soft FROM t""",
    "raw_rows": f"WITH {RAW_SQL} SELECT * FROM raw",
    "best_positions": f"WITH {RAW_SQL}, {BEST} SELECT * FROM best",
    "action_values": f"""WITH {RAW_SQL}, {PACKED} SELECT fen, array_to_string(list_transform(items, lambda x: x.move), ',') AS moves,
  array_to_string(list_transform(items, lambda x: coalesce(CAST(x.cp AS VARCHAR), '-')), ',') AS cps, array_to_string(list_transform(items, lambda x: coalesce(CAST(x.mate AS VARCHAR), '-')), ',') AS mates, depth, is_val FROM packed""",
    "position_scores": f"""WITH {RAW_SQL}, s AS (SELECT event_id, {Q} AS q FROM raw), p AS (SELECT *, 0.5 * (1 - abs(q)) AS d, greatest(least((q + 1) / 2, 1 - 1e-6), 1e-6) AS c FROM s WHERE q IS NOT NULL)
  SELECT event_id, round(q, 8) + 0.0 AS q, round((1 - d + q) / 2, 8) + 0.0 AS win, round(d, 8) + 0.0 AS draw, round((1 - d - q) / 2, 8) + 0.0 AS loss, CAST(round_even(ln(c / (1 - c)) / 0.00368208, 0) AS INT) AS cp_back FROM p""",
    "policy_targets": f"""WITH {RAW_SQL}, {LEGAL_SQL}, {PACKED}, {LISTED}, v AS (SELECT fen, class, CAST({_STEP} AS DOUBLE) AS q FROM listed),
  e AS (SELECT fen, class, exp((q - max(q) OVER (PARTITION BY fen)) / 0.1) AS e FROM v), w AS (SELECT fen, class, e / sum(e) OVER (PARTITION BY fen) AS w FROM e)
  SELECT fen, class, round(sum(w), 6) AS weight FROM w GROUP BY 1, 2""",
    "move_metrics": f"""WITH {RAW_SQL}, {LEGAL_SQL}, {PACKED}, {LISTED}, v AS (SELECT fen, nth, class, CAST({_STEP} AS DOUBLE) AS q FROM listed WHERE n_moves >= 2 AND count >= 2),
  r AS (SELECT fen, class, row_number() OVER (PARTITION BY fen ORDER BY {HASH("fen || '|' || class", "guess")}, class) AS r FROM allowed),
  b AS (SELECT fen, arg_max(class, (q, -nth)) AS best, max(q) AS q FROM v GROUP BY fen), p AS (SELECT b.fen, b.best, b.q, r.class AS guess FROM b JOIN r ON r.fen = b.fen AND r.r = 1),
  f AS (SELECT p.*, (SELECT arg_min(v.q, v.nth) FROM v WHERE v.fen = p.fen AND v.class = p.guess) AS got, EXISTS (SELECT 1 FROM r WHERE r.fen = p.fen AND r.r <= 5 AND r.class = p.best) AS five, ({HASH("fen", "value")} % 1000) / 1000 AS value FROM p)
  SELECT count(*) AS n, round(coalesce(avg(CAST(guess = best AS INT)), 0), 6) AS top1, round(coalesce(avg(CAST(five AS INT)), 0), 6) AS top5, round(coalesce(avg((q - got) * 50), 0), 6) AS points_lost,
    round(coalesce(avg(CAST(got IS NULL AS INT)), 0), 6) AS off_list, round(coalesce(avg(CAST(got IS NULL OR (q - got) * 50 > 10 AS INT)), 0), 6) AS blunders, round(coalesce(avg((value - q) * (value - q)), 0), 6) AS value_mse FROM f""",
    "move_choices": f"""WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), k AS (SELECT vec_id, i, v, v / 0.5::DOUBLE - ln(-ln(({HASH("vec_id || '|' || i", "draw")} % 1000003 + 1) / 1000005::DOUBLE)) AS g FROM x WHERE (i + vec_id) % 3 <> 0),
  o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS r, row_number() OVER (PARTITION BY vec_id ORDER BY g DESC, i) AS s FROM k)
  SELECT vec_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY r) FILTER (r <= 4) AS ordered, CAST(max(i) FILTER (s = 1) AS INT) AS drawn, CAST(max(i) FILTER (r = 1) AS INT) AS greatest FROM o GROUP BY vec_id""",
    "schedules": """SELECT event_id, round(CASE WHEN event_id % 1200 < 100 THEN (event_id % 1200 + 1) / 100::DOUBLE ELSE 0.1::DOUBLE + 0.9::DOUBLE * 0.5::DOUBLE * (1 + cos(pi() * least(1.0::DOUBLE, (event_id % 1200 - 100) / 900::DOUBLE))) END, 9) AS rate,
  round(greatest(0.02::DOUBLE, (least(event_id * 37 % 600000 / greatest(1, least(CASE WHEN event_id % 3 <> 0 THEN event_id % 60 ELSE 30 END, 40))::DOUBLE + 0.8::DOUBLE * (event_id % 7 * 500), 0.4::DOUBLE * (event_id * 37 % 600000)) - 100) / 1000), 6) AS budget FROM events""",
    "validation_sample": f"""WITH {RAW_SQL}, {PACKED} SELECT fen, CAST(len(items) AS INT) AS n_moves FROM packed WHERE is_val AND len(items) >= 2 ORDER BY md5(fen || '|3'), fen LIMIT 20""",
    "position_features": f"""WITH {RAW_SQL}, {FEATURES.format(source=_WHOLE)}
  SELECT fen, CAST(len(planes) AS INT) AS n_set, array_to_string(list_sort(planes), ',') AS set_features, oriented, least(CAST(split_part(full_fen, ' ', 5) AS INT), 100) / 100::DOUBLE AS clock,
    array_to_string(list_concat([i * 12 + instr('PNBRQKpnbrqk', board[i + 1]) - 1 FOR i IN range(64) IF board[i + 1] <> '.'], CASE WHEN black THEN [] ELSE [768] END), ',') AS legacy FROM s""",
    "resume_positions": f"WITH {RAW_SQL}, {BEST.replace('>= 12', '>= 20')} SELECT DISTINCT fen FROM raw WHERE fen IS NOT NULL AND fen NOT IN (SELECT fen FROM best WHERE fen IS NOT NULL)",
    "sample_positions": f"WITH {RAW_SQL} SELECT fen FROM (SELECT DISTINCT fen FROM raw) ORDER BY md5(fen || '|7'), fen LIMIT 100",
    "clean_report": f"""WITH {RAW_SQL}, {BEST}, a AS (SELECT count(*) AS n_raw, count(*) FILTER (length(line) > 0) AS n_lines FROM raw), b AS (SELECT count(*) AS n_clean, count(*) FILTER (is_val) AS n_val FROM best)
  SELECT *, round(100.0::DOUBLE * n_clean / n_raw, 6) AS kept_pct, round(100.0::DOUBLE * n_val / n_clean, 6) AS val_pct FROM a, b""",
    "position_filters": f"""WITH {RAW_SQL} SELECT split_part(fen, ' ', 2) AS side, count(*) AS n, count(*) FILTER ({HASH("fen", "split")} % 50 = 0) AS n_val, count(*) FILTER (cp IS NULL AND mate IS NULL) AS n_unscored
  FROM raw WHERE coalesce(depth, 0) >= 13 AND length(line) > 0 AND regexp_full_match(fen, '{board.FEN.strip("^$")}') GROUP BY 1""",
    "move_classes": f"""WITH {RAW_SQL}, m AS (SELECT *, split_part(line, ' ', 1) AS move, split_part(fen, ' ', 1) AS placed FROM raw WHERE length(line) > 0), c AS (SELECT *, CASE WHEN regexp_full_match(move, '[a-h][1-8][a-h][1-8][qrbn]?') THEN CAST({_CLASS("move")} AS INT) END AS class FROM m)
  SELECT event_id, CASE WHEN length(fen) - length(replace(fen, ' ', '')) = 3 THEN fen || ' 0 1' ELSE fen END AS full_fen, move, class, xor(class, 3640) AS mirrored, CASE WHEN {BLACK} THEN xor(class, 3640) ELSE class END AS oriented,
    CAST({" + ".join(f"{v} * (length(replace(placed, '{p.lower()}', '')) - length(replace(placed, '{p}', '')))" for p, v in zip("PNBRQ", (1, 3, 3, 5, 9), strict=True))} AS INT) AS material FROM c""",
    "square_relations": f"""WITH {RAW_SQL}, m AS (SELECT event_id, split_part(line, ' ', 1) AS move FROM raw WHERE line IS NOT NULL)
  SELECT event_id, CAST({_CLASS("move")} AS INT) AS class, CAST((ascii(move[4]) - ascii(move[2]) + 7) * 15 + ascii(move[3]) - ascii(move[1]) + 7 AS INT) AS relation FROM m WHERE regexp_full_match(move, '[a-h][1-8][a-h][1-8][qrbn]?')""",
    "training_rows": f"""WITH {RAW_SQL}, {LEGAL_SQL}, {FEATURES.format(source=_WHOLE)}, q AS (SELECT event_id, fen, split_part(line, ' ', 1) AS move, {Q} AS q FROM raw WHERE length(line) > 0),
  t AS (SELECT * FROM q JOIN lawful ON starts_with(fen, position) JOIN s USING (fen) WHERE q IS NOT NULL AND regexp_full_match(move, '[a-h][1-8][a-h][1-8][qrbn]?') AND len(list_filter(legal, lambda l: l[1:4] = move[1:4])) > 0)
  SELECT event_id, array_to_string(list_sort(planes), ',') AS features, {_CLOCK} AS clock, array_to_string(list_sort(list_distinct([CAST({_SEEN(_CLASS("m"))} AS INT) FOR m IN legal])), ',') AS legal, CAST({_SEEN(_CLASS("move"))} AS INT) AS target,
    round((1 - 0.5 * (1 - abs(q)) + q) / 2, 8) + 0.0 AS win, round(0.5 * (1 - abs(q)), 8) + 0.0 AS draw, round((1 - 0.5 * (1 - abs(q)) - q) / 2, 8) + 0.0 AS loss, round(q, 8) + 0.0 AS value FROM t""",
    "capture_order": f"""WITH {RAW_SQL}, {LEGAL_SQL}, {FEATURES.format(source=_WHOLE)}, v AS (SELECT s.fen, board, unnest(legal) AS m, generate_subscripts(legal, 1) AS i FROM s JOIN lawful ON starts_with(s.fen, position)),
  w AS (SELECT *, CASE WHEN board[{_NUMBER("m[3:4]")} + 1] <> '.' THEN [1, 3, 3, 5, 9, 0][instr('pnbrqk', lower(board[{_NUMBER("m[3:4]")} + 1]))] WHEN lower(board[{_NUMBER("m[1:2]")} + 1]) = 'p' AND m[1] <> m[3] THEN 1 END AS victim FROM v)
  SELECT fen, CAST(count(victim) AS INT) AS n_captures, coalesce(string_agg(m, ',' ORDER BY -victim, {_NUMBER("m[1:2]")}, {_NUMBER("m[3:4]")}, m) FILTER (victim IS NOT NULL), '') AS captures FROM (SELECT * FROM w UNION ALL SELECT s.fen, board, NULL, NULL, NULL FROM s JOIN lawful ON starts_with(s.fen, position)) GROUP BY fen""",
    "model_scores": f"""WITH {RAW_SQL}, {FEATURES.format(source=_WHOLE)}, {FORWARD}, e AS (SELECT fen, value, [exp(v - list_max(u)) FOR v IN u] AS e FROM m)
  SELECT fen, round(value, 6) + 0.0 AS value, round(e[1] / list_sum(e), 6) + 0.0 AS win, round(e[2] / list_sum(e), 6) + 0.0 AS draw, round(e[3] / list_sum(e), 6) + 0.0 AS loss FROM e""",
    "policy_choices": f"""WITH {RAW_SQL}, {LEGAL_SQL}, {FEATURES.format(source=_WHOLE)}, {FORWARD}, l AS (SELECT m.*, legal FROM m JOIN lawful ON starts_with(fen, position)),
  k AS (SELECT fen, black, value, legal, unnest(list_distinct([CAST({_SEEN(_CLASS("v"))} AS INT) FOR v IN legal])) AS class, x FROM l),
  b AS (SELECT fen, any_value(black) AS black, any_value(value) AS value, any_value(legal) AS legal, arg_max(class, ({" + ".join(f"x[{j + 1}] * {_RULE('policy.weight', j, 'class')}" for j in range(WIDTH))} + {_RULE("policy.bias", 0, "class")}, -class)) AS class FROM k GROUP BY fen),
  n AS (SELECT fen, value, legal, xor(class, CASE WHEN black THEN 3640 ELSE 0 END) AS class FROM b), t AS (SELECT fen, value, legal, {_NAME("(class // 64)")} || {_NAME("(class % 64)")} AS move FROM n)
  SELECT fen, CASE WHEN list_contains(legal, move) THEN move ELSE move || 'q' END AS move, {_CP.format(_CHANCE("value"))} AS cp FROM t UNION ALL SELECT fen, NULL, NULL FROM l WHERE len(legal) = 0""",
    "value_choices": f"""WITH {RAW_SQL}, {LEGAL_SQL}, parents AS (WITH {FEATURES.format(source=_WHOLE)} SELECT * FROM s), {CHILDREN.replace("FROM s JOIN", "FROM parents s JOIN")},
  {FEATURES.format(source="f AS (SELECT DISTINCT child AS fen, child AS full_fen, split_part(child, ' ', 2) = 'b' AS black FROM kids)")}, {FORWARD},
  q AS (SELECT kids.fen, kids.move, CASE WHEN regexp_matches(replace(after, '.', ''), '[pqrPQR]') OR len(replace(after, '.', '')) > 3 THEN -m.value ELSE 0 END AS q FROM kids JOIN m ON m.fen = kids.child),
  b AS (SELECT fen, min((-q + 0.0, move)) AS best, CAST(count(*) AS INT) AS n_moves FROM q GROUP BY fen)
  SELECT fen, best[2] AS move, {_CP.format(_CHANCE("(-best[1])"))} AS cp, n_moves FROM b""",
    "best_line_items": "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) AS r FROM lineitem) WHERE r = 1",
    "embedding_softmax": """WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), e AS (SELECT *, exp((v - max(v) OVER w) / 0.1) AS e, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS r FROM x WINDOW w AS (PARTITION BY vec_id))
  SELECT vec_id, round(max(e) / sum(e), 7) AS p_max, CAST(min(i) FILTER (r = 1) + 1 AS BIGINT) AS best, string_agg(CAST(i AS VARCHAR), ',' ORDER BY r) FILTER (r <= 5) AS top5 FROM e GROUP BY vec_id""",
    "legal_counts": f"WITH {RAW_SQL}, {LEGAL_SQL} SELECT DISTINCT fen, CAST(len(legal) AS INT) AS n_legal FROM raw JOIN lawful ON starts_with(fen, position)",
    "ended_positions": f"WITH {RAW_SQL}, {LEGAL_SQL} SELECT DISTINCT fen FROM raw JOIN lawful ON starts_with(fen, position) WHERE len(legal) = 0",
    "legal_rows": f"""WITH {RAW_SQL}, {LEGAL_SQL}, m AS (SELECT event_id, split_part(line, ' ', 1) AS move, legal FROM raw JOIN lawful ON starts_with(fen, position) WHERE line IS NOT NULL)
  SELECT event_id, move, CASE WHEN list_contains(legal, move[1:4]) THEN move[1:4] ELSE move[1:4] || 'q' END AS of_class FROM m WHERE regexp_full_match(move, '[a-h][1-8][a-h][1-8][qrbn]?') AND len(list_filter(legal, lambda l: l[1:4] = move[1:4])) > 0""",
    "drop_reasons": f"""WITH {RAW_SQL}, {LEGAL_SQL}, m AS (SELECT raw.*, split_part(line, ' ', 1) AS move, legal FROM raw LEFT JOIN lawful ON starts_with(fen, position))
  SELECT CASE WHEN coalesce(length(line), 0) = 0 THEN 'no line' WHEN legal IS NULL THEN 'bad position' WHEN cp IS NULL AND mate IS NULL THEN 'no score' WHEN NOT regexp_full_match(move, '[a-h][1-8][a-h][1-8][qrbn]?') THEN 'bad move'
    WHEN len(list_filter(legal, lambda l: l[1:4] = move[1:4])) = 0 THEN 'illegal move' ELSE 'kept' END AS reason, count(*) AS n FROM m GROUP BY 1""",
}
