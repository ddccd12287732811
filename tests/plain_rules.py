"""Legal moves of a position, in plain Python, to compare with. Squares are 0 (a1) to 63 (h8); a board is a list of 64 characters."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

_FEN = re.compile(r"([pnbrqkPNBRQK1-8/]+) ([wb]) (-|K?Q?k?q?) (-|[a-h][36])(?: (\d+) \d+)?\Z")
_KING = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
_KNIGHT = [(a, b) for a in (-2, -1, 1, 2) for b in (-2, -1, 1, 2) if abs(a) != abs(b)]


def _ray(square: int, step: tuple[int, int], far: int) -> tuple[int, ...]:
    f, r, out = square % 8, square // 8, []
    for _ in range(far):
        f, r = f + step[0], r + step[1]
        if not (0 <= f < 8 and 0 <= r < 8):
            break
        out.append(r * 8 + f)
    return tuple(out)


STRAIGHT = [[x for d in ((1, 0), (-1, 0), (0, 1), (0, -1)) if (x := _ray(s, d, 7))] for s in range(64)]
DIAGONAL = [[x for d in ((1, 1), (-1, 1), (1, -1), (-1, -1)) if (x := _ray(s, d, 7))] for s in range(64)]
LEAPS = {"N": [sum((_ray(s, d, 1) for d in _KNIGHT), ()) for s in range(64)], "K": [sum((_ray(s, d, 1) for d in _KING), ()) for s in range(64)]}
#: Squares from which a pawn of White (Black) attacks a square.
PAWN_FROM = {True: [sum((_ray(s, (d, -1), 1) for d in (-1, 1)), ()) for s in range(64)], False: [sum((_ray(s, (d, 1), 1) for d in (-1, 1)), ()) for s in range(64)]}
#: king from, king to, rook from, rook to, squares that must be empty, by right
CASTLING = {"K": (4, 6, 7, 5, (5, 6)), "Q": (4, 2, 0, 3, (1, 2, 3)), "k": (60, 62, 63, 61, (61, 62)), "q": (60, 58, 56, 59, (57, 58, 59))}


class Position(NamedTuple):
    """A position without its clocks."""

    cells: tuple[str, ...]
    white: bool
    rights: str
    passing: int


def parse_fen(fen: str | None) -> Position | None:
    """The position of a FEN with or without clocks; None if it is not one (each side needs one king)."""
    m = _FEN.match(fen or "")
    rows = m[1].split("/") if m else []
    spread = [re.sub("[1-8]", lambda d: "." * int(d[0]), r) for r in rows]
    if len(spread) != 8 or any(len(r) != 8 for r in spread):
        return None
    cells = tuple("".join(reversed(spread)))
    if cells.count("K") != 1 or cells.count("k") != 1:
        return None
    rights = "".join(c for c in m[3] if c in CASTLING and cells[CASTLING[c][0]] == ("K" if c.isupper() else "k") and cells[CASTLING[c][2]] == ("R" if c.isupper() else "r"))
    passing = -1 if m[4] == "-" else (ord(m[4][0]) - 97) + (int(m[4][1]) - 1) * 8
    return Position(cells, m[2] == "w", rights, passing)


def attacked(cells, square: int, by_white: bool) -> bool:
    """Whether a side attacks a square."""
    own = str.upper if by_white else str.lower
    if any(cells[s] == own("P") for s in PAWN_FROM[by_white][square]):
        return True
    if any(cells[s] == own(k) for k, from_ in LEAPS.items() for s in from_[square]):
        return True
    for rays, kinds in ((STRAIGHT, own("RQ")), (DIAGONAL, own("BQ"))):
        for ray in rays[square]:
            for s in ray:
                if cells[s] != ".":
                    if cells[s] in kinds:
                        return True
                    break
    return False


def _candidates(p: Position):
    """Moves (from, to, promotion) by the pieces' steps, before checks are looked at."""
    cells, forward, last, first = p.cells, 8 if p.white else -8, 7 if p.white else 0, 1 if p.white else 6
    mine = str.isupper if p.white else str.islower
    for s in range(64):
        c = cells[s]
        if c == "." or not mine(c):
            continue
        kind = c.upper()
        if kind == "P":
            to = [t for t in PAWN_FROM[not p.white][s] if (cells[t] != "." and not mine(cells[t])) or t == p.passing]
            if 0 <= s + forward < 64 and cells[s + forward] == ".":
                to.append(s + forward)
                if s // 8 == first and cells[s + 2 * forward] == ".":
                    to.append(s + 2 * forward)
            for t in to:
                yield from ((s, t, q) for q in ("qrbn" if t // 8 == last else ("",)))
        elif kind in LEAPS:
            yield from ((s, t, "") for t in LEAPS[kind][s] if cells[t] == "." or not mine(cells[t]))
        else:
            for ray in (STRAIGHT[s] if kind != "B" else []) + (DIAGONAL[s] if kind != "R" else []):
                for t in ray:
                    if cells[t] == "." or not mine(cells[t]):
                        yield s, t, ""
                    if cells[t] != ".":
                        break
    for right in p.rights:
        if right.isupper() == p.white:
            a, b, _, _, free = CASTLING[right]
            if all(cells[s] == "." for s in free) and not any(attacked(cells, s, not p.white) for s in range(min(a, b), max(a, b) + 1)):
                yield a, b, ""


def play(p: Position, move: tuple[int, int, str]) -> Position:
    """The position after a move."""
    s, t, promoted = move
    cells, c = list(p.cells), p.cells[s]
    cells[s], cells[t] = ".", (promoted.upper() if p.white else promoted) or c
    passing = -1
    if c in "Pp":
        if t == p.passing:
            cells[t + (-8 if p.white else 8)] = "."
        if abs(s - t) == 16:
            passing = (s + t) // 2
    if c in "Kk" and abs(s - t) == 2:
        _, _, a, b, _ = next(x for x in CASTLING.values() if x[0] == s and x[1] == t)
        cells[a], cells[b] = ".", cells[a]
    rights = "".join(r for r in p.rights if not {s, t} & {CASTLING[r][0], CASTLING[r][2]})
    return Position(tuple(cells), not p.white, rights, passing)


def legal_moves(p: Position) -> list[tuple[int, int, str]]:
    """All legal moves, sorted."""
    out = []
    for m in _candidates(p):
        after = play(p, m).cells
        if not attacked(after, after.index("K" if p.white else "k"), not p.white):
            out.append(m)
    return sorted(out)


def in_check(p: Position) -> bool:
    return attacked(p.cells, p.cells.index("K" if p.white else "k"), not p.white)


def uci(move: tuple[int, int, str]) -> str:
    return "".join("abcdefgh"[s % 8] + "12345678"[s // 8] for s in move[:2]) + move[2]


@lru_cache(maxsize=50_000)
def legal_of(p: Position) -> tuple[str, ...]:
    """Legal moves of a position in UCI notation."""
    return tuple(map(uci, legal_moves(p)))


def legal_uci(fen: str | None) -> tuple[str, ...] | None:
    """Legal moves of a FEN in UCI notation; None if it cannot be parsed. Positions that differ in clocks alone are worked out once."""
    p = parse_fen(fen)
    return legal_of(p) if p else None


def perft(p: Position, depth: int) -> int:
    """Number of move sequences of a length."""
    moves = legal_moves(p)
    return len(moves) if depth == 1 else sum(perft(play(p, m), depth - 1) for m in moves)
