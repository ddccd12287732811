"""Moves of many positions at once: a column of 64-bit boards for each kind of piece, so that no loop runs over positions, squares or moves.

All boards are seen by the side to move, which goes up: for Black ranks are turned over, so its pieces come first and its pawns go up too. Square 0 is a1,
bit 0. Steps to the eight neighbours are shifts; sliding pieces take at most seven of them, all positions together.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
PAWN, KNIGHT, BISHOP, ROOK, QUEEN, KING = range(6)
LETTERS = "PNBRQK"
ONE, NONE, ALL = U(1), U(0), U(0xFFFFFFFFFFFFFFFF)
_FILE = [U(0x0101010101010101 << f) for f in range(8)]
_RANK = [U(0xFF << 8 * r) for r in range(8)]
#: A FEN without clocks; they may follow.
FEN = r"^([pnbrqkPNBRQK1-8]+/){7}[pnbrqkPNBRQK1-8]+ [wb] (-|K?Q?k?q?) (-|[a-h][36])$"
CLOCKS = r" (\d+) (\d+)$"
STRAIGHT, DIAGONAL = ((1, 0), (-1, 0), (0, 1), (0, -1)), ((1, 1), (-1, 1), (1, -1), (-1, -1))
JUMPS = tuple((a, b) for a in (-2, -1, 1, 2) for b in (-2, -1, 1, 2) if abs(a) != abs(b))
PROMOTIONS = (BISHOP, KNIGHT, QUEEN, ROOK)  # in order of their letters
#: By right of the side to move, then of the other: king and rook at home, the king's and the rook's goal, squares that are empty and squares that are not attacked.
HOME = ((4, 7, 6, 5, (5, 6), (4, 5, 6)), (4, 0, 2, 3, (1, 2, 3), (2, 3, 4)), (60, 63), (60, 56))


def _bits(squares) -> np.uint64:
    return U(sum(1 << s for s in squares))


def _inside(df: int) -> np.uint64:
    """Squares from which a step of ``df`` files stays on the board."""
    return U(sum(int(_FILE[f]) for f in range(8) if 0 <= f + df < 8))


def step(x: np.ndarray, way: tuple[int, int]) -> np.ndarray:
    """Boards with each bit moved by (files, ranks)."""
    by = way[0] + 8 * way[1]
    x = x & _inside(way[0])
    return x << U(by) if by > 0 else x >> U(-by)


def ray(x: np.ndarray, way: tuple[int, int], free: np.ndarray) -> np.ndarray:
    """Squares that sliders on ``x`` reach over free squares, the first that is not free among them."""
    out, x = np.zeros_like(x), step(x, way)
    for _ in range(7):
        if not x.any():
            break
        out |= x
        x = step(x & free, way)
    return out


class Positions(NamedTuple):
    """Columns of positions: boards by kind of the side to move and of the other, rights (bits as in ``HOME``), the square behind a pawn that went two
    steps (-1: none), whether Black is to move, and the clocks."""

    own: np.ndarray
    other: np.ndarray
    rights: np.ndarray
    passing: np.ndarray
    black: np.ndarray
    half: np.ndarray
    full: np.ndarray

    def take(self, at: np.ndarray) -> Positions:
        return Positions(self.own[:, at], self.other[:, at], *(c[at] for c in self[2:]))

    @property
    def us(self) -> np.ndarray:
        return np.bitwise_or.reduce(self.own, axis=0)

    @property
    def them(self) -> np.ndarray:
        return np.bitwise_or.reduce(self.other, axis=0)


class Moves(NamedTuple):
    """Columns of moves, sorted: the place of the position, squares as the side to move sees them, the kind a pawn turns into (0: none), whether something is taken."""

    at: np.ndarray
    start: np.ndarray
    goal: np.ndarray
    promoted: np.ndarray
    takes: np.ndarray


_TURNED = np.array([s ^ 56 for s in range(64)])


def _at_home(rights: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Rights whose king and rook stand at home."""
    for k, home in enumerate(HOME):
        side = own if k < 2 else other
        fine = ((side[KING] >> U(home[0])) & (side[ROOK] >> U(home[1])) & ONE).astype(bool)
        rights = np.where(fine, rights, rights & ~np.uint8(1 << k))
    return rights


def parse(fens: pa.Array) -> tuple[Positions, np.ndarray]:
    """Positions of the FENs that are one (with or without clocks, 0 1 if left out; each side has one king), and where these stand among ``fens``."""
    fens = fens.cast(pa.string())
    bare = pc.replace_substring_regex(fens, pattern=CLOCKS, replacement="")
    fine = pc.fill_null(pc.match_substring_regex(bare, FEN), False)
    at = np.flatnonzero(fine.to_numpy(zero_copy_only=False))
    bare, fens = bare.take(pa.array(at)), fens.take(pa.array(at))
    parts = pc.split_pattern(bare, " ").flatten()
    placed, side, rights, passing = (parts.take(pa.array(np.arange(k, 4 * len(at), 4))) for k in range(4))
    for n in range(1, 9):
        placed = pc.replace_substring(placed, str(n), "." * n)
    even = (pc.binary_length(placed).to_numpy() == 71) & pc.match_substring_regex(placed, r"^([^/]{8}/){7}[^/]{8}$").to_numpy(zero_copy_only=False)
    keep = np.flatnonzero(even)
    at, fens, placed, side, rights, passing = at[keep], *(c.take(pa.array(keep)) for c in (fens, placed, side, rights, passing))
    chars = np.frombuffer("".join(placed.to_pylist()).encode(), np.uint8).reshape(len(at), 71)
    cells = np.concatenate([chars[:, 9 * r : 9 * r + 8] for r in range(7, -1, -1)], axis=1) if len(at) else np.zeros((0, 64), np.uint8)
    black = pc.equal(side, "b").to_numpy(zero_copy_only=False)
    cells = np.where(black[:, None], cells[:, _TURNED], cells)
    upper, lower = (np.stack([np.packbits(cells == ord(c), axis=1, bitorder="little").reshape(-1).view(U) for c in names]) for names in (LETTERS, LETTERS.lower()))
    own, other = np.where(black, lower, upper), np.where(black, upper, lower)
    flags = np.zeros(len(at), np.uint8)
    for k, (white, blacks) in enumerate(zip("KQkq", "kqKQ", strict=True)):
        has = np.where(black, pc.match_substring(rights, blacks).to_numpy(zero_copy_only=False), pc.match_substring(rights, white).to_numpy(zero_copy_only=False))
        flags |= has.astype(np.uint8) << np.uint8(k)
    target = np.array([-1 if s == "-" else ord(s[0]) - 97 + (ord(s[1]) - 49) * 8 for s in passing.to_pylist()], np.int64)
    target = np.where((target >= 0) & black, target ^ 56, target)
    clocks = pc.extract_regex(fens, r" (?P<half>\d{1,9}) (?P<full>\d{1,9})$")
    half, full = (pc.fill_null(pc.cast(pc.struct_field(clocks, name), pa.int64()), default).to_numpy(zero_copy_only=False) for name, default in (("half", 0), ("full", 1)))
    p = Positions(own, other, _at_home(flags, own, other), target, black, half, full)
    kings = (np.bitwise_count(own[KING]) == 1) & (np.bitwise_count(other[KING]) == 1)
    return p.take(np.flatnonzero(kings)), at[kings]


def _sliders(side: np.ndarray, way: tuple[int, int]) -> np.ndarray:
    return side[QUEEN] | side[ROOK if 0 in way else BISHOP]


def attacked_by(side: np.ndarray, free: np.ndarray, up: bool) -> np.ndarray:
    """Squares that pieces attack, over free squares; ``up`` is the way their pawns go."""
    forward = 1 if up else -1
    out = step(side[PAWN], (-1, forward)) | step(side[PAWN], (1, forward))
    for way in JUMPS:
        out |= step(side[KNIGHT], way)
    for way in STRAIGHT + DIAGONAL:
        out |= step(side[KING], way) | ray(_sliders(side, way), way, free)
    return out


def in_check(p: Positions) -> np.ndarray:
    """Which sides to move are in check."""
    return (attacked_by(p.other, ~(p.us | p.them), False) & p.own[KING]) != 0


def spread(boards: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, square) of all bits."""
    some = np.flatnonzero(boards)
    at, square = np.nonzero(np.unpackbits(boards[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return some[at], square


def legal_moves(p: Positions) -> Moves:
    """All legal moves, sorted by position, squares and promotion.

    A piece that is no king has to meet every check and to stay on the line if it is pinned; a king goes where nothing attacks; a pawn that takes in passing
    is tried on the board after the move.
    """
    us, them, king = p.us, p.them, p.own[KING]
    free = ~(us | them)
    danger = attacked_by(p.other, free | king, False)
    checkers = sum((step(king, way) & p.other[KNIGHT] for way in JUMPS), start=np.zeros_like(king))
    checkers |= (step(king, (-1, 1)) | step(king, (1, 1))) & p.other[PAWN]
    meets, pins = checkers.copy(), []
    for way in STRAIGHT + DIAGONAL:
        seen, sliders = ray(king, way, free), _sliders(p.other, way)
        giver = seen & sliders
        checkers |= giver
        meets |= np.where(giver != 0, seen, NONE)
        mine = seen & us
        beyond = ray(mine, way, free)
        pins.append((np.where((beyond & sliders) != 0, mine, NONE), seen | beyond))
    n_checks = np.bitwise_count(checkers)
    meets = np.where(n_checks == 0, ALL, np.where(n_checks == 1, meets, NONE))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(boards: np.ndarray, back: int) -> None:
        if boards.any():
            at, goal = spread(boards)
            found.append((at, goal - back, goal))

    pawns = p.own[PAWN]
    once = (pawns << U(8)) & free
    add(once & meets, 8)
    add(((once & _RANK[2]) << U(8)) & free & meets, 16)
    for df in (-1, 1):
        add(step(pawns, (df, 1)) & them & meets, 8 + df)
    for way in JUMPS:
        add(step(p.own[KNIGHT], way) & ~us & meets, way[0] + 8 * way[1])
    for way in STRAIGHT + DIAGONAL:
        x = _sliders(p.own, way)
        for n in range(1, 8):
            x = step(x, way) & ~us
            if not x.any():
                break
            add(x & meets, n * (way[0] + 8 * way[1]))
            x = x & free
    at, start, goal = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))
    keep = np.ones(len(at), bool)
    for pinned, line in pins:
        if pinned.any():
            keep &= ~(((pinned[at] >> start.astype(U)) & ONE).astype(bool) & ~((line[at] >> goal.astype(U)) & ONE).astype(bool))
    found = [(at[keep], start[keep], goal[keep])]
    for way in STRAIGHT + DIAGONAL:
        add(step(king, way) & ~us & ~danger, way[0] + 8 * way[1])
    for k, (_, _, goal_of_king, _, empty, safe) in enumerate(HOME[:2]):
        may = ((p.rights >> np.uint8(k)) & 1).astype(bool) & ((~free & _bits(empty)) == 0) & ((danger & _bits(safe)) == 0)
        add(np.where(may, _bits([goal_of_king]), NONE), goal_of_king - 4)
    found.append(_in_passing(p, free))
    at, start, goal = (np.concatenate([f[k] for f in found]).astype(np.int64) for k in range(3))
    is_pawn = ((pawns[at] >> start.astype(U)) & ONE).astype(bool)
    takes = ((them[at] >> goal.astype(U)) & ONE).astype(bool) | (is_pawn & ((goal - start) % 8 != 0))
    times = np.where(is_pawn & (goal >= 56), 4, 1)
    promoted = np.where(np.repeat(times, times) == 4, np.array(PROMOTIONS)[(np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)) % 4], 0)
    at, start, goal, takes = (np.repeat(c, times) for c in (at, start, goal, takes))
    turn = np.where(p.black[at], 56, 0)
    rank = np.zeros(6, np.int64)
    rank[list(PROMOTIONS)] = range(4)
    order = np.argsort((((at * 64 + (start ^ turn)) * 64) + (goal ^ turn)) * 4 + rank[promoted], kind="stable")
    return Moves(*(c[order] for c in (at, start, goal, promoted, takes)))


def _in_passing(p: Positions, free: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Legal captures in passing: the goal is empty and on the sixth rank, and the king is not attacked without both pawns."""
    out = []
    goal_bit = np.where((p.passing >= 40) & (p.passing < 48), ONE << np.maximum(p.passing, 0).astype(U), NONE) & free
    for df in (-1, 1):
        at = np.flatnonzero(step(p.own[PAWN], (df, 1)) & goal_bit)
        if len(at):
            q, goal = p.take(at), p.passing[at]
            start_bit, gone = ONE << (goal - 8 - df).astype(U), ONE << (goal - 8).astype(U)
            other = q.other.copy()
            other[PAWN] &= ~gone
            taken = ((q.us & ~start_bit) | goal_bit[at]) | (q.them & ~gone)
            safe = (attacked_by(other, ~taken, False) & q.own[KING]) == 0
            out.append((at[safe], goal[safe] - 8 - df, goal[safe]))
    return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3))


def play(p: Positions, m: Moves) -> Positions:
    """The positions after moves of ``p``, one for each move, seen by the other side."""
    q = p.take(m.at)
    start, goal = ONE << m.start.astype(U), ONE << m.goal.astype(U)
    own = np.where((q.own & start) != 0, (q.own & ~start) | goal, q.own)
    turns = m.promoted > 0
    own[PAWN] = np.where(turns, own[PAWN] & ~goal, own[PAWN])
    for kind in PROMOTIONS:
        own[kind] |= np.where(m.promoted == kind, goal, NONE)
    other = q.other & ~goal
    was_pawn, was_king = (q.own[PAWN] & start) != 0, (q.own[KING] & start) != 0
    passing = was_pawn & (m.goal == q.passing) & ((m.goal - m.start) % 8 != 0)
    other[PAWN] &= ~np.where(passing, goal >> U(8), NONE)
    for home in HOME[:2]:
        castles = was_king & (m.start == home[0]) & (m.goal == home[2])
        own[ROOK] ^= np.where(castles, _bits([home[1], home[3]]), NONE)
    touched = start | goal
    rights = q.rights
    for k, home in enumerate(HOME):
        rights = np.where((touched & _bits(home[:2])) != 0, rights & ~np.uint8(1 << k), rights)
    rights = ((rights & 3) << 2) | (rights >> 2)  # the other side's come first now
    two = was_pawn & (m.goal - m.start == 16)
    turned = [np.where(two, (m.start + 8) ^ 56, -1), ~q.black, np.where(was_pawn | m.takes, 0, q.half + 1), q.full + q.black]
    return Positions(other.byteswap(), own.byteswap(), rights.astype(np.uint8), *turned)


def insufficient(p: Positions) -> np.ndarray:
    """Which positions no side can win: each has a bare king, or one knight beside bare opponents (queens apart), or bishops that all stand on one colour with no pawn or knight about."""
    dark = U(0xAA55AA55AA55AA55)
    bishops = p.own[BISHOP] | p.other[BISHOP]
    one_colour = (((bishops & dark) == 0) | ((bishops & ~dark) == 0)) & ((p.own[PAWN] | p.other[PAWN] | p.own[KNIGHT] | p.other[KNIGHT]) == 0)

    def weak(side: np.ndarray, rest: np.ndarray) -> np.ndarray:
        whole, facing = np.bitwise_or.reduce(side, axis=0), np.bitwise_or.reduce(rest, axis=0) & ~rest[KING] & ~rest[QUEEN]
        lone_knight = (np.bitwise_count(whole) <= 2) & (facing == 0)
        out = np.where(side[KNIGHT] != 0, lone_knight, np.where(side[BISHOP] != 0, one_colour, True))
        return out & ((side[PAWN] | side[ROOK] | side[QUEEN]) == 0)

    return weak(p.own, p.other) & weak(p.other, p.own)


def _strings(rows: np.ndarray, keep: np.ndarray) -> pa.Array:
    """Strings of the bytes of each row that are kept."""
    ends = np.concatenate([[0], np.cumsum(keep.sum(1))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(rows), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows[keep])))


def uci(p: Positions, m: Moves) -> pa.Array:
    """Moves in UCI notation."""
    turn = np.where(p.black[m.at], 56, 0)
    start, goal = m.start ^ turn, m.goal ^ turn
    letters = np.frombuffer(LETTERS.lower().encode(), np.uint8)
    rows = np.stack([97 + start % 8, 49 + start // 8, 97 + goal % 8, 49 + goal // 8, letters[m.promoted]], 1).astype(np.uint8)
    keep = np.ones(rows.shape, bool)
    keep[:, 4] = m.promoted > 0
    return _strings(rows, keep)


def cells(p: Positions) -> np.ndarray:
    """Codes of 64 squares from a1 as White sees them: 0 is empty, 1 to 6 White's kinds, 7 to 12 Black's."""
    out = np.zeros((len(p.black), 64), np.uint8)
    for first, boards in ((1, p.own), (7, p.other)):
        for kind in range(6):
            out += np.unpackbits(np.ascontiguousarray(boards[kind]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") * np.uint8(first + kind)
    swapped = np.where(out > 6, out - 6, np.where(out > 0, out + 6, 0))
    return np.where(p.black[:, None], swapped[:, _TURNED], out).astype(np.uint8)


def write_fen(p: Positions) -> pa.Array:
    """FENs with clocks."""
    codes = cells(p).reshape(-1, 8, 8)[:, ::-1]
    n = len(codes)
    empty = codes == 0
    # A run of empty squares is written at its last square as its length.
    run = np.zeros((n, 8, 8), np.int64)
    for f in range(8):
        run[:, :, f] = np.where(empty[:, :, f], (run[:, :, f - 1] if f else 0) + 1, 0)
    ends = empty & np.concatenate([~empty[:, :, 1:], np.ones((n, 8, 1), bool)], axis=2)
    chars = np.where(empty, 48 + run, np.frombuffer(b"." + LETTERS.encode() + LETTERS.lower().encode(), np.uint8)[codes])
    rows = np.concatenate([chars, np.full((n, 8, 1), 47)], axis=2).reshape(n, 72)[:, :71].astype(np.uint8)
    keep = np.concatenate([~empty | ends, np.ones((n, 8, 1), bool)], axis=2).reshape(n, 72)[:, :71]
    white_first = np.where(p.black, ((p.rights & 3) << 2) | (p.rights >> 2), p.rights)
    names = np.array(["".join(c for k, c in enumerate("KQkq") if r >> k & 1) or "-" for r in range(16)])[white_first]
    squares = np.array(["abcdefgh"[s % 8] + "12345678"[s // 8] for s in range(64)] + ["-"])
    target = squares[np.where(p.passing < 0, 64, np.where(p.black, p.passing ^ 56, p.passing))]
    side = pa.array(np.where(p.black, "b", "w"))
    return pc.binary_join_element_wise(_strings(rows, keep), side, pa.array(names), pa.array(target), *(pa.array(c).cast(pa.string()) for c in (p.half, p.full)), " ")
