import random

import numpy as np
import plain_rules as plain
import pyarrow as pa
import pytest

from sparkwright.functions import bitboards
from sparkwright.operators import legality
from sparkwright.sources import evaluations

START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
MIXED = [
    (START, (20, 400, 8902, 197281)),
    ("r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1", (48, 2039, 97862)),
    ("8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1", (14, 191, 2812, 43238)),
    ("r3k2r/Pppp1ppp/1b3nbN/nP6/BBP1P3/q4N2/Pp1P2PP/R2Q1RK1 w kq - 0 1", (6, 264, 9467)),
    ("rnbq1k1r/pp1Pbppp/2p5/8/2B5/8/PPP1NnPP/RNBQK2R w KQ - 1 8", (44, 1486, 62379)),
]


def spread(p):
    """The FEN of a plain position, without clocks."""
    rows = ["".join(p.cells[r * 8 : r * 8 + 8]) for r in range(7, -1, -1)]
    for n in range(8, 0, -1):
        rows = [r.replace("." * n, str(n)) for r in rows]
    square = "-" if p.passing < 0 else "abcdefgh"[p.passing % 8] + "12345678"[p.passing // 8]
    return f"{'/'.join(rows)} {'w' if p.white else 'b'} {p.rights or '-'} {square}"


def games(n, length, seed):
    """Positions of random games, by plain rules."""
    draw, out = random.Random(seed), []
    for _ in range(n):
        p = plain.parse_fen(START)
        for _ in range(length):
            moves = plain.legal_moves(p)
            if not moves:
                break
            p = plain.play(p, draw.choice(moves))
            out.append(p)
    return out


@pytest.mark.parametrize(("fen", "counts"), MIXED)
def test_perft(fen, counts):
    p = bitboards.parse(pa.array([fen]))[0]
    for n in counts:
        moves = bitboards.legal_moves(p)
        assert len(moves.at) == n
        p = bitboards.play(p, moves)


def test_moves_and_children_of_random_games_equal_plain_rules():
    held = games(25, 80, 3)
    fens = [spread(p) for p in held]
    assert legality.legal_lists(pa.array(fens)).to_pylist() == [list(plain.legal_uci(f)) for f in fens]
    p, at = bitboards.parse(pa.array(fens))
    assert list(at) == list(range(len(fens)))
    assert bitboards.write_fen(p).to_pylist() == [f + " 0 1" for f in fens]
    assert list(bitboards.in_check(p)) == [plain.in_check(q) for q in held]
    moves = bitboards.legal_moves(p)
    after, names = bitboards.write_fen(bitboards.play(p, moves)).to_pylist(), bitboards.uci(p, moves).to_pylist()
    for k in range(0, len(after), 17):
        move = next(m for m in plain.legal_moves(held[moves.at[k]]) if plain.uci(m) == names[k])
        assert plain.parse_fen(after[k]) == plain.play(held[moves.at[k]], move)


def test_clocks_and_captures():
    fens = ["4k3/8/8/3pP3/8/8/8/4K2R w K d6 7 30", "4k3/8/8/8/8/8/8/4K2R b K - 7 30"]
    p = bitboards.parse(pa.array(fens))[0]
    moves = bitboards.legal_moves(p)
    after = dict(zip(zip(moves.at.tolist(), bitboards.uci(p, moves).to_pylist(), strict=True), bitboards.write_fen(bitboards.play(p, moves)).to_pylist(), strict=True))
    assert after[0, "e5d6"] == "4k3/8/3P4/8/8/8/8/4K2R b K - 0 30"
    assert after[0, "e1g1"] == "4k3/8/8/3pP3/8/8/8/5RK1 b - - 8 30"
    assert after[1, "e8d8"] == "3k4/8/8/8/8/8/8/4K2R w K - 8 31"
    assert [u for u, t in zip(bitboards.uci(p, moves).to_pylist(), moves.takes, strict=True) if t] == ["e5d6"]


def test_passing_that_uncovers_the_king_is_illegal():
    fens = ["8/8/8/K1Pp3r/8/8/8/7k w - d6", "8/8/8/2Pp4/8/8/8/K6k w - d6", "8/8/8/8/8/k1pP3R/8/K7 w - -"]
    got = legality.legal_lists(pa.array(fens)).to_pylist()
    assert "c5d6" not in got[0] and "c5d6" in got[1]
    assert got == [list(plain.legal_uci(f)) for f in fens]


@pytest.mark.parametrize(
    ("fen", "dead"),
    [("8/8/8/4k3/8/8/8/4K3 w - -", True), ("8/8/8/4k3/8/8/8/3NK3 w - -", True), ("8/8/8/3nk3/8/8/8/3NK3 w - -", False), ("8/8/8/3bk3/8/8/8/3BK3 b - -", True), ("8/8/8/2b1k3/8/8/8/3BK3 b - -", False),
     ("8/8/8/2b1k3/8/8/8/2B1K3 w - -", True), ("8/8/8/4k3/8/8/P7/4K3 w - -", False), ("8/8/8/4k3/8/8/8/Q3K3 w - -", False), ("8/8/8/4k3/8/8/8/2NNK3 w - -", False)],
)
def test_insufficient_material(fen, dead):
    assert list(bitboards.insufficient(bitboards.parse(pa.array([fen]))[0])) == [dead]


def test_bad_positions():
    bad = [None, "", "x", "8/8/8/8/8/8/8/8 w - -", START.replace("w", "x"), START.replace("8/8", "9/7"), START.replace("K", "k", 1), START + " 1", "é" + START]
    assert legality.legal_lists(pa.array(bad, pa.string())).to_pylist() == [None] * len(bad)
    assert legality.legal_lists(pa.array([], pa.string())).to_pylist() == []


def test_listed_moves():
    for fen, moves in evaluations.LEGAL.items():
        got = legality.legal_lists(pa.array([fen])).to_pylist()[0]
        assert got is None if moves is None else sorted(got) == moves.split()
    assert np.array_equal(legality.legal_lists(pa.array([START] * 3000)).to_pylist()[2999], sorted(plain.legal_uci(START), key=plain.legal_uci(START).index))
