"""Bulk-synchronous best-fit packing of documents into sequences.

1. Every document is tokenised once; only (doc_id, piece, start, length, crc) rows leave that stage.
2. Pieces are range-sorted by length and written. Supersteps go down the classes of lengths (``length_classes``); a class reads its ranges only.
3. In a superstep, the pieces of a class and all gaps that can hold one are range-sorted together (by size, then a hash, so that a hot
   length is split). Each range is swept by a task in ascending order: a gap takes the longest pieces before it that are left.
4. Ranges end with pieces and gaps left over. From their counts alone (two numbers a range) it follows which piece goes to which later gap:
   conflicts go by rank, the next free gap takes the longest piece below it. Pairs meet by one shuffle of the rows left over.
5. Pieces that no gap takes open sequences, in groups of ranges that fill at least 64; each group leaves one partly filled, for a later superstep. Gaps are updated; the next superstep begins.

There are 8 supersteps at 2,048 tokens, however many documents there are. All rows stay in tables; the driver sees counts by class and by range.
A task holds one range (about ``task_rows`` rows) or one group (at most a range more than the larger of ``task_rows`` and 131,072 rows). Each step's rows are written, so a lost executor repeats tasks of one step only.
Nothing is dropped or capped.

Defined results: a null or empty text is its closing id only; repeated rows are packed as rows of their own;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_characters
from .common import discard, slices, table, written

CAPACITY, CLOSING_ID = 2048, 0
#: public_tokenizers.PATTERN, written for the merger's regex engine: the same matches, faster.
MERGE_PATTERN = r""" ?\p{L}++|'(?:[sdmt]|ll|ve|re)| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
TASK_ROWS = 250_000  # rows of a range or of a group that opens sequences
HARMONIC = 4
FULL = 64  # sequences that a group fills at least, if there are pieces enough
STEP_BITS, GROUP_BITS = 56, 28  # of a sequence_id: superstep, group, place in the group
IDLE = 1 << 61  # keys of gaps that no piece takes


class Tokenizer:
    """Ids as the ``tokenizers`` file gives them. Texts are encoded by the same merges as a rank table (five to ten
    times as fast); those that spell an added token go to the library itself."""

    def __init__(self, path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        self.added = [x["content"] for x in spec["added_tokens"]]
        back = {c: b for b, c in enumerate(byte_characters())}
        ranks = {bytes(map(back.__getitem__, t)): k for t, k in spec["model"]["vocab"].items() if t not in self.added}
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.encode(text)).tobytes()


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str) -> Tokenizer:
    """One a worker process."""
    return Tokenizer(path, pattern)


def piece_rows(df: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents cut into pieces, of which only the first may be short."""
    def run(batches):
        encode = tokenizer(path, pattern)
        for batch in batches:
            for b in slices(batch, "text"):
                rows: list[tuple] = []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    ids = (encode(t) if t else b"") + CLOSING_ID.to_bytes(4, "little")
                    n, a, k = len(ids) // 4, 0, 0
                    while a < n:
                        e = min(n, (n - 1) % capacity + 1 if k == 0 else a + capacity)
                        rows.append((i, k, a, e - a, zlib.crc32(ids[4 * a : 4 * e])))
                        a, k = e, k + 1
                cols = list(zip(*rows, strict=True))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], capacity: int) -> int:
    """Sequences that serial best-fit decreasing needs for a count of pieces by length: what the supersteps are held against."""
    gaps: list[int] = []
    n = 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            at = bisect_left(gaps, length)
            n += at == len(gaps)
            gap = (gaps.pop(at) if at < len(gaps) else capacity) - length
            if gap:
                insort(gaps, gap)
    return n


def length_classes(capacity: int, harmonic: int = HARMONIC) -> list[tuple[int, int]]:
    """(over, up to) of the classes, longest first. Over ``capacity // harmonic`` all lengths of a class go equally often into a
    sequence; below, classes halve, and a 64th of ``capacity`` or less is one class. But for that last one, gaps are mostly too small for two pieces of
    the class that is swept."""
    edges = sorted({capacity // k for k in range(1, harmonic + 1) if capacity // k}, reverse=True)
    while edges[-1] > max(1, capacity // 64):
        edges.append(edges[-1] // 2)
    return list(zip(edges[1:] + [0], edges, strict=True))


class Shelf:
    """Pieces in ascending order of length, of which the longest that fits and is not taken is found in nearly constant time."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.tolist()
        self.at = list(range(len(lengths) + 1))  # the nearest place at or below that is not taken, plus one; 0: none

    def find(self, k: int) -> int:
        at, root = self.at, k
        while at[root] != root:
            root = at[root]
        while at[k] != root:
            at[k], k = root, at[k]
        return root

    def fill(self, gap: int, below: int) -> tuple[list[int], int]:
        """Places taken out of the first ``below`` for a gap, and what is left of it: the longest that fits, again and again."""
        taken = []
        while k := self.find(below):
            length = self.lengths[k - 1]
            if length > gap:
                below = bisect_right(self.lengths, gap, 0, k)
                continue
            self.at[k] = k - 1
            taken.append(k - 1)
            gap -= length
            below = k - 1
        return taken, gap


PLACED, PIECE_LEFT, GAP_LEFT, GAP = range(4)
ROWS = "kind int, size int, id long, piece int, start long, ids_crc32 long, sequence_id long, offset long, part int, place int, step int"
NAMES = [x.split()[0] for x in ROWS.split(", ")]
TYPES = [{"int": pa.int32(), "long": pa.int64()}[x.split()[1]] for x in ROWS.split(", ")]


def out_rows(rows: pa.Table, at: np.ndarray, step: int, **given) -> list[pa.RecordBatch]:
    """``rows`` at the places ``at`` with some columns given."""
    if not len(at):
        return []
    held = rows.take(pa.array(at))
    full = lambda x, t: pa.array(np.broadcast_to(np.asarray(x), len(at))).cast(t)
    given |= {"step": step}
    cols = [full(given[c], t) if c in given else held.column(c).combine_chunks() if c in held.column_names else pa.nulls(len(at), t) for c, t in zip(NAMES, TYPES, strict=True)]
    return pa.Table.from_arrays(cols, NAMES).to_batches()


def swept(rows: pa.Table, part: int, step: int, capacity: int):
    """One range partition, sorted by size with pieces before gaps of their size: each gap, in ascending order, takes the longest pieces
    before it that are left. What stays are gaps (which found no piece before them) and then pieces (after all of those gaps)."""
    size, gaps = rows.column("size").to_numpy(), np.flatnonzero(rows.column("kind").to_numpy() == GAP)
    pieces = np.flatnonzero(rows.column("kind").to_numpy() != GAP)
    shelf, before = Shelf(size[pieces]), np.searchsorted(pieces, gaps)
    sequences = rows.column("sequence_id").fill_null(0).to_numpy()
    taken, offsets, by, rest, used = [], [], [], [], []
    for k, (g, n) in enumerate(zip(gaps.tolist(), before.tolist(), strict=True)):
        gap = int(size[g])
        got, left = shelf.fill(gap, n)
        if got:
            used.append(k)
            rest.append(left)
        for x in got:
            taken.append(x)
            offsets.append(capacity - gap)
            by.append(g)
            gap -= shelf.lengths[x]
    free = np.ones(len(pieces), bool)
    free[taken] = False
    idle = np.ones(len(gaps), bool)
    idle[used] = False
    rest = np.array(rest, np.int64)
    yield from out_rows(rows, pieces[taken], step, kind=PLACED, sequence_id=sequences[by], offset=np.array(offsets, np.int64))
    yield from out_rows(rows, gaps[used][rest > 0], step, kind=GAP, size=rest[rest > 0])
    yield from out_rows(rows, pieces[free], step, kind=PIECE_LEFT, part=part, place=np.arange(free.sum()))
    yield from out_rows(rows, gaps[idle], step, kind=GAP_LEFT, part=part, place=np.arange(idle.sum()))


def carried(left: dict[int, tuple[int, int]], least: int) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[int, int]]]:
    """How pieces left in one range go to gaps left in later ones, from the counts (pieces, gaps) of each range alone.

    Conflicts go by rank: the next free gap takes the longest piece below it. Returns runs (part, first place, number, pair of the first)
    of gaps and of pieces (whose pairs descend), and for the pieces that no gap takes, by part, their number and the group that opens sequences for them.
    There are fewer than two runs a range. Ranges join a group until it has ``least`` pieces, since each group leaves one sequence partly filled.
    """
    stack: list[list[int]] = []
    gap_runs, piece_runs, pair = [], [], 0
    for part in sorted(left):
        pieces, gaps = left[part]
        at = 0
        while at < gaps and stack:
            m = min(stack[-1][1], gaps - at)
            stack[-1][1] -= m
            gap_runs.append((part, at, m, pair))
            piece_runs.append((stack[-1][0], stack[-1][1], m, pair))
            at, pair = at + m, pair + m
            if not stack[-1][1]:
                stack.pop()
        if pieces:
            stack.append([part, pieces])
    opening, group, held = {}, 0, 0
    for part, n in stack:
        opening[part] = n, group
        held += n
        if held >= least:
            group, held = group + 1, 0
    order = lambda runs: np.array(sorted(runs), np.int64).reshape(-1, 4)
    return order(gap_runs), order(piece_runs), opening


def pair_of(runs: np.ndarray, part: np.ndarray, place: np.ndarray, descending: bool) -> np.ndarray:
    """The pair of each row, -1 without one."""
    out = np.full(len(part), -1, np.int64)
    if len(runs):
        at = np.searchsorted(runs[:, 0] << 32 | runs[:, 1], part << 32 | place, "right") - 1
        r = runs[np.maximum(at, 0)]
        k = place - r[:, 1]
        hit = (at >= 0) & (r[:, 0] == part) & (k < r[:, 2])
        out[hit] = (r[:, 3] + (r[:, 2] - 1 - k if descending else k))[hit]
    return out


def settled(rows: pa.Table, step: int, capacity: int):
    """Rows sorted by key, pieces before gaps, sizes ascending: pairs (a piece and its gap) are placed, idle gaps stay, groups of pieces open sequences."""
    key, size, kind = rows.column("key").to_numpy(), rows.column("size").to_numpy().astype(np.int64), rows.column("kind").to_numpy()
    sequences = rows.column("sequence_id").fill_null(0).to_numpy()
    pieces = np.flatnonzero((key >= 0) & (kind == PIECE_LEFT))
    gaps = pieces + 1
    rest = size[gaps] - size[pieces]
    yield from out_rows(rows, pieces, step, kind=PLACED, sequence_id=sequences[gaps], offset=capacity - size[gaps])
    yield from out_rows(rows, gaps[rest > 0], step, kind=GAP, size=rest[rest > 0])
    idle = kind == GAP_LEFT
    idle[gaps] = False
    yield from out_rows(rows, np.flatnonzero(idle), step, kind=GAP)
    opened = np.flatnonzero(key < 0)
    for at in np.split(opened, np.flatnonzero(np.diff(key[opened])) + 1) if len(opened) else []:
        first = step << STEP_BITS | int(-1 - key[at[0]]) << GROUP_BITS
        shelf, n = Shelf(size[at]), 0
        taken, ids, offsets, rests = [], [], [], []
        while shelf.find(len(at)):
            got, left = shelf.fill(capacity, len(at))
            used = 0
            for x in got:
                taken.append(x)
                ids.append(first + n)
                offsets.append(used)
                used += shelf.lengths[x]
            if left:
                rests.append((first + n, left))
            n += 1
        yield from out_rows(rows, at[taken], step, kind=PLACED, sequence_id=ids, offset=offsets)
        if rests:
            ids, left = map(np.array, zip(*rests, strict=True))
            none = {c: pa.nulls(len(left), t) for c, t in zip(NAMES, TYPES, strict=True)}
            given = {"kind": np.full(len(left), GAP, np.int32), "size": left.astype(np.int32), "sequence_id": ids, "step": np.full(len(left), step, np.int32)}
            yield from pa.Table.from_pydict(none | given, pa.schema(list(zip(NAMES, TYPES, strict=True)))).to_batches()


def whole(batches) -> pa.Table | None:
    """The rows of a task, whose number the ranges bound."""
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


def pack(pieces: DataFrame, capacity: int = CAPACITY, task_rows: int = TASK_ROWS) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    spark = pieces.sparkSession
    pieces = written(pieces, "pieces")
    tasks = lambda n: max(1, -(-n // task_rows))
    classes = length_classes(capacity)
    class_of = sum((F.col("length") <= low).cast("int") for low, _ in classes)
    counts = dict(map(tuple, pieces.groupBy(class_of.alias("step")).count().collect()))  # one row a class
    total = sum(counts.values())
    by = ["length", F.xxhash64("doc_id", "piece", "ids_crc32")]
    ranged = written(pieces.repartitionByRange(tasks(total), *by).sortWithinPartitions("length"), "ranged")
    discard(pieces)
    done: list[DataFrame] = []
    placed, former = 0, capacity
    empty = spark.createDataFrame([], ROWS)
    for step, (low, high) in enumerate(classes):
        if not counts.get(step):
            continue
        docs = ranged.where((F.col("length") > low) & (F.col("length") <= high)).select(
            F.lit(PIECE_LEFT).alias("kind"), F.col("length").cast("int").alias("size"), F.col("doc_id").alias("id"), "piece", "start", "ids_crc32",
            F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"), F.lit(0).alias("part"), F.lit(0).alias("place"), F.lit(step).alias("step"),
        )
        # A gap over a former class's lower end was swept there and written anew; one up to it stays valid where it is.
        last = max((s for s in counts if s < step), default=-1)
        gaps = union(done, empty).where((F.col("kind") == GAP) & (F.col("size") > low) & ((F.col("step") == last) | (F.col("size") <= former)))
        n = tasks(counts[step] + min(placed, total))
        order = ["size", "kind", F.xxhash64("id", "piece", "ids_crc32", "sequence_id")]

        def sweep(batches, step=step):
            rows = whole(batches)
            if rows is not None:
                yield from swept(rows, TaskContext.get().partitionId(), step, capacity)

        first = written(docs.unionByName(gaps).repartitionByRange(n, *order).sortWithinPartitions("size", "kind").mapInArrow(sweep, ROWS), "sweep")
        over = first.where(F.col("kind").isin(PIECE_LEFT, GAP_LEFT))
        left: dict[int, tuple[int, int]] = {
            r.part: (r.pieces, r.gaps) for r in over.groupBy("part").agg(F.count_if(F.col("kind") == PIECE_LEFT).alias("pieces"), F.count_if(F.col("kind") == GAP_LEFT).alias("gaps")).collect()
        }  # one row a range
        gap_runs, piece_runs, opening = carried(left, max(task_rows, FULL * capacity // (low + 1)))

        def keyed(batches, gap_runs=gap_runs, piece_runs=piece_runs, opening=opening):
            number = {p: (m, -1 - g) for p, (m, g) in opening.items()}
            for b in batches:
                col = lambda c: b.column(b.schema.get_field_index(c)).to_numpy()  # noqa: B023, E731
                part, place, gap = col("part").astype(np.int64), col("place").astype(np.int64), col("kind") == GAP_LEFT
                key = np.where(gap, pair_of(gap_runs, part, place, False), pair_of(piece_runs, part, place, True))
                key = np.where(gap & (key < 0), IDLE | part << 32 | place, key)
                for p in np.unique(part).tolist():
                    m, group = number.get(p, (0, 0))
                    key[~gap & (part == p) & (place < m)] = group
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key)], [*b.schema.names, "key"])

        def settle(batches, step=step):
            rows = whole(batches)
            if rows is not None:
                yield from settled(rows, step, capacity)

        moved = over.mapInArrow(keyed, ROWS + ", key long").repartition(tasks(sum(map(sum, left.values()))), "key")
        done += [first, written(moved.sortWithinPartitions("key", "kind", "size").mapInArrow(settle, ROWS), "settled")]
        placed, former = placed + counts[step], low
    discard(ranged)
    out = union(done, empty).where(F.col("kind") == PLACED)
    return out.select(F.col("id").alias("doc_id"), "piece", "start", F.col("size").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def union(tables: list[DataFrame], empty: DataFrame) -> DataFrame:
    """All rows of written tables in one scan."""
    return empty.sparkSession.read.schema(empty.schema).parquet(*sorted({f.rpartition("/")[0] for t in tables for f in t.inputFiles()})) if tables else empty


def pack_documents(docs: DataFrame) -> DataFrame:
    """Tokenise and pack whole documents with production parameters."""
    import public_tokenizers
    return pack(piece_rows(docs, public_tokenizers.path("byte_bpe_50k.json"), MERGE_PATTERN))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed."""
    return pack_documents(table(spark, sf_dir, "documents"))
