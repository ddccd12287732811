"""Positions and moves as column expressions: FEN fields, squares, move classes, features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECES = "PNBRQKpnbrqk"
WORTH = (0, 1, 3, 3, 5, 9, 0)  # of an empty square, pawn, knight, bishop, rook, queen, king
UCI = "^[a-h][1-8][a-h][1-8][qrbn]?$"
#: A legal syntax of the first four fields, and of all six.
FEN = r"^([pnbrqkPNBRQK1-8]{1,8}/){7}[pnbrqkPNBRQK1-8]{1,8} [wb] (-|K?Q?k?q?) (-|[a-h][36])( \d+ \d+)?$"


def field(fen: Column, n: int) -> Column:
    return F.split_part(fen, F.lit(" "), F.lit(n))


def normal_fen(fen: Column) -> Column:
    """Clocks 0 1 are added where they are left out."""
    return F.when(F.length(fen) - F.length(F.replace(fen, F.lit(" "), F.lit(""))) == 3, F.concat(fen, F.lit(" 0 1"))).otherwise(fen)


def first_move(line: Column) -> Column:
    return F.split_part(line, F.lit(" "), F.lit(1))


def square(name: Column) -> Column:
    """0 (a1) to 63 (h8)."""
    return F.ascii(F.substring(name, 1, 1)) - 97 + (F.ascii(F.substring(name, 2, 1)) - 49) * 8


def move_class(uci: Column) -> Column:
    """from * 64 + to; null if it is no move. A promotion's piece is left out."""
    return F.when(F.rlike(uci, F.lit(UCI)), square(F.substring(uci, 1, 2)) * 64 + square(F.substring(uci, 3, 2)))


def mirror_class(index: Column) -> Column:
    """The class of the move with ranks turned over."""
    return index.bitwiseXOR(F.lit(56 * 64 + 56))


def oriented_class(uci: Column, fen: Column) -> Column:
    """The class as the side to move sees it."""
    return F.when(field(fen, 2) == "b", mirror_class(move_class(uci))).otherwise(move_class(uci))


def cells(fen: Column) -> Column:
    """64 one-character cells from a1 to h8; '.' is empty."""
    spread = field(fen, 1)
    for n in range(1, 9):
        spread = F.replace(spread, F.lit(str(n)), F.lit("." * n))
    return F.split(F.array_join(F.reverse(F.split(spread, "/")), ""), "")


def oriented_cells(fen: Column) -> Column:
    """Cells as the side to move sees them: for Black ranks are turned over and colours swapped."""
    swapped = F.translate(field(fen, 1), PIECES, PIECES.swapcase())
    turned = F.array_join(F.reverse(F.split(swapped, "/")), "/")
    return F.when(field(fen, 2) == "b", cells(turned)).otherwise(cells(fen))


def planes(fen: Column, at: Column | None = None) -> Column:
    """Sparse features: sorted indices square * 18 + plane of the planes 0 to 16 that are set; plane 17 is ``clock``.

    0 to 5 are the mover's pieces, 6 to 11 the other's, 12 to 15 castling rights (mover's king side, queen side, then the other's; a right needs king and
    rook at home), 16 is the en-passant square. ``at`` is a column that holds ``oriented_cells``; without one they are worked out at each of nine places.
    """
    at = oriented_cells(fen) if at is None else at
    pieces = F.filter(F.transform(at, lambda c, i: F.when(c != ".", i * 18 + F.instr(F.lit(PIECES), c) - 1)), lambda x: x.isNotNull())
    black = field(fen, 2) == "b"
    rights = F.when(black, F.translate(field(fen, 3), "KQkq", "kqKQ")).otherwise(field(fen, 3))
    home = (("K", 4, "K", 7, "R"), ("Q", 4, "K", 0, "R"), ("k", 60, "k", 63, "r"), ("q", 60, "k", 56, "r"))

    def right(k: int) -> Column:
        letter, king, king_is, rook, rook_is = home[k]
        held = F.contains(rights, F.lit(letter)) & (F.get(at, F.lit(king)) == king_is) & (F.get(at, F.lit(rook)) == rook_is)
        return F.when(held, F.array(*[F.lit(s * 18 + 12 + k) for s in range(64)])).otherwise(F.array().cast("array<int>"))

    passing = field(fen, 4)
    target = F.when(black, square(passing).bitwiseXOR(F.lit(56))).otherwise(square(passing))
    ep = F.when(passing != "-", F.array(target * 18 + 16)).otherwise(F.array().cast("array<int>"))
    return F.sort_array(F.concat(pieces, *[right(k) for k in range(4)], ep))


def with_features(rows: DataFrame, fen_col: str = "fen") -> DataFrame:
    """``rows`` with ``oriented``, the cells as the side to move sees them, ``planes`` and ``clock``: each list is made once, in its own projection."""
    rows = rows.withColumn("oriented", oriented_cells(F.col(fen_col)))
    return rows.withColumn("planes", planes(F.col(fen_col), F.col("oriented"))).withColumn("clock", clock(F.col(fen_col)))


def clock(fen: Column) -> Column:
    """Half-moves since the last capture or pawn move, as a share of 100 and at most 1."""
    return F.least(F.coalesce(F.try_to_number(F.nullif(field(fen, 5), F.lit("")), F.lit("9999")).cast("int"), F.lit(0)), F.lit(100)) / 100


def relation(a: Column, b: Column) -> Column:
    """Id of the relative place of two squares, 0 to 224."""
    rank = lambda s: F.floor(s / 8).cast("int")
    return (rank(a) - rank(b) + 7) * 15 + (a % 8 - b % 8 + 7)


def material(fen: Column) -> Column:
    """White's material minus Black's (pawn 1, knight and bishop 3, rook 5, queen 9)."""
    placed = field(fen, 1)
    count = lambda c: F.length(placed) - F.length(F.replace(placed, F.lit(c), F.lit("")))
    total = F.lit(0)
    for c, v in zip("PNBRQ", (1, 3, 3, 5, 9), strict=True):
        total = total + v * (count(c) - count(c.lower()))
    return total


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once a row, however often ``body`` names it, also for each element of a list."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def move_of_class(number: Column, legal: Column) -> Column:
    """The legal move of a class: without promotion, else to a queen, knight, rook or bishop; null if there is none."""
    square = lambda n: F.concat(F.char(97 + n % 8), F.char(49 + F.floor(n / 8)))
    plain = lambda n: F.concat(square(F.floor(n / 64)), square(n % 64))
    ranked = lambda m: F.struct(F.instr(F.lit("qnrb"), F.substring(m, 5, 1)).alias("rank"), m.alias("move"))
    found = lambda p: F.array_min(F.transform(F.filter(legal, lambda m: F.startswith(m, p)), ranked))["move"]
    return once(number, lambda n: F.when(n.between(0, 4095), once(plain(n), found)))


def ordered_captures(legal: Column, at: Column) -> Column:
    """The legal moves that take something, the dearest victim first, equal ones in the order given; ``at`` is a column that holds ``cells``.

    A pawn that changes its file without a piece on its goal takes a pawn in passing.
    """
    goal = lambda m: F.get(at, square(F.substring(m, 3, 2)))
    start = lambda m: F.get(at, square(F.substring(m, 1, 2)))
    worth = lambda m: F.get(F.lit(list(WORTH)), F.instr(F.lit(".pnbrqk"), F.lower(goal(m))) - 1)
    passing = lambda m: (F.lower(start(m)) == "p") & (F.substring(m, 1, 1) != F.substring(m, 3, 1))
    victim = lambda m: F.when(goal(m) != ".", worth(m)).when(passing(m), 1)
    keyed = F.filter(F.transform(legal, lambda m, i: F.struct((-victim(m)).alias("minus"), i.alias("i"), m.alias("m"))), lambda s: s["minus"].isNotNull())
    return F.transform(F.array_sort(keyed), lambda s: s["m"])


def legacy_indices(fen: Column, at: Column | None = None) -> Column:
    """Sorted set bits of the older 769-wide vector: square * 12 + piece, and 768 if White is to move. ``at`` is a column that holds ``cells``."""
    pieces = F.filter(F.transform(cells(fen) if at is None else at, lambda c, i: F.when(c != ".", i * 12 + F.instr(F.lit(PIECES), c) - 1)), lambda x: x.isNotNull())
    return F.concat(pieces, F.when(field(fen, 2) == "w", F.array(F.lit(768))).otherwise(F.array().cast("array<int>")))
