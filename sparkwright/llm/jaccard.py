"""Exact Jaccard join of word shingles with signature trees, and its connected components.

1. Texts become sets of 64-bit shingle hashes; equal sets are one class from here on.
2. Shingles get one global order: rare ones first, then by hash. Two sets that link share a shingle
   among the first ``n - ceil(t n) + 1`` of both (prefix filter), so only classes with a common prefix shingle can link. Which
   shingles count as frequent affects speed alone, never the result.
3. The classes of each shared prefix shingle are first compared with one or two centres; links join components. Lists whose
   members are all in one component are done, so groups of near copies cost a few comparisons a member.
4. A shingle at place p of a set of n leaves an overlap of n - p at most if it is the first that two sets share. So the smaller set of a link has its first common
   shingle early: lists without a member that early are dropped (``leads``), which takes away groups whose members differ by rare shingles of their own.
5. The other lists are gathered into blocks, which go through signature trees: nodes hold the OR of their members' bitmaps, size ranges and
   whether all members are in one component; a dual traversal drops node pairs whose sizes do not fit, whose greatest possible overlap is too small or
   which are connected already. It says which members have a partner; these meet again with their whole sets, in the same traversal, and only links
   that join two components are written. A block of more than ``LIST`` members is cut into chunks. First each chunk is compared with itself, every member in
   one place, and components are contracted. Then the members outside the block's largest component, and no others, visit the other chunks. So a group of near copies
   travels once, whatever its size; members that come near the threshold without a link travel once a chunk.
6. Components come from alternating large-star and small-star steps over contracted links, the last few in one task.

Defined results: a null or empty text, or one without words, has an empty set and is a component of its own; a text
of fewer words than a shingle has one shingle of all its words; components are of rows: those of one id
with different texts are linked by their texts alone; a row without an id links others as any row does, and its component is the least id found, if any; repeated rows repeat; extra columns are ignored (kept by the filter); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HOT_ROWS, dealt_join, discard, freed_shuffles, hot_keys, slices, table, written

WORDS, PER_CENT = 4, 85
FREQUENT, FREQUENT_MOST = 20, 500_000  # documents with a frequent shingle at least; frequent shingles that are told apart
BITS, LEAF, FAN, LIST = 512, 16, 4, 8192
WIDE = 4  # bits a shingle of the second bitmap
BROADCAST_ROWS, CENTRES = 1_000_000, 2
ELEMENTS = 4_000_000  # shingles of a chunk
ONE_TASK = 200_000  # links whose components one task can find (a few MB)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted set of shingle hashes of a whole text (A-Z lower-cased, words parted by ASCII white space)."""
    import xxhash

    said = text.encode().lower().split() if text else []
    if not said:
        return np.zeros(0, np.uint64)
    if len(said) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(said), seed=len(said))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, said), np.uint64, len(said))
    n = len(h) - words + 1
    s = h[:n].copy()
    for k in range(1, words):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[k : n + k]
    s = (s ^ (s >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(s ^ (s >> np.uint64(29)))


def prefix(sets: np.ndarray, frequent: np.ndarray, per_cent: int = PER_CENT) -> tuple[np.ndarray, int]:
    """The first shingles of a set in the global order, so many that a link cannot miss them, and how many of them are rare."""
    n = rare = len(sets)
    most = n - -(-per_cent * n // 100) + 1 if n else 0
    if len(frequent) and n:
        common = frequent[np.minimum(np.searchsorted(frequent, sets), len(frequent) - 1)] == sets
        sets, rare = np.concatenate([sets[~common], sets[common]]), n - int(common.sum())
    return sets[:most], min(rare, most)


def bitmap(sets: np.ndarray) -> bytes:
    out = np.zeros(BITS, bool)
    out[(sets >> np.uint64(20)).astype(np.int64) % BITS] = True
    return np.packbits(out).tobytes()


def wide_bitmap(sets: np.ndarray) -> bytes:
    """A bitmap of ``WIDE`` bits a shingle at least; its size is a power of two, so halves can be folded onto each other."""
    size = max(64, 1 << int(WIDE * len(sets) - 1).bit_length())
    out = np.zeros(size, bool)
    out[((sets >> np.uint64(20)) & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").tobytes()


def wide_overlap(n: int, x: bytes, m: int, y: bytes) -> int:
    """An upper bound of the overlap of two sets from their second bitmaps."""
    u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(u) > len(v):
        n, u, m, v = m, v, n, u
    v = np.bitwise_or.reduce(v.reshape(-1, len(u)), axis=0)
    a, b, c = (int(np.bitwise_count(z).sum()) for z in (u, v, u & v))
    return min(n, m, c + min(n - a, m - b))


def class_id(sets: np.ndarray) -> bytes:
    return hashlib.blake2b(sets.tobytes(), digest_size=16).digest()


def _source(docs: DataFrame, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    """(doc_id, text, at, hash): ``at`` is where a text is found again, its row's mark, its id or, without one, ``hash``, the hash of the text."""
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    at = F.col(row_col) if row_col else F.coalesce(doc_id, F.xxhash64(text))
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), at.alias("at"), F.xxhash64(text).alias("hash"))


def frequent_shingles(src: DataFrame, least: int = FREQUENT, most: int = FREQUENT_MOST, words: int = WORDS) -> np.ndarray:
    """Hashes of shingles that stand in ``least`` documents or more, the ``most`` commonest of them, sorted."""
    def run(batches):
        for batch in batches:
            for b in slices(batch, "text", 8 << 20):
                sets = [shingles(t, words) for t in b.column(1).to_pylist() if t]
                value, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                yield pa.record_batch([pa.array(value[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], ["shingle", "n"])

    counted = src.mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    with freed_shuffles(src.sparkSession):
        found = counted.orderBy(F.desc("n"), "shingle").limit(most).select("shingle").toArrow()
    return np.sort(found.column(0).to_numpy().astype(np.int64).view(np.uint64))


def document_rows(src: DataFrame, frequent: np.ndarray, per_cent: int, words: int = WORDS) -> DataFrame:
    """(doc_id, at, hash, class, n, keys, rare, bits, wide) of every document."""
    def run(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                sets = [shingles(t, words) for t in b.column(1).to_pylist()]
                keys, rare = zip(*(prefix(s, frequent, per_cent) for s in sets), strict=True)
                flat = np.concatenate(keys).view(np.int64)
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                yield pa.record_batch([
                    b.column(0), b.column(2), b.column(3), pa.array([class_id(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(rare, pa.int64()), pa.array([bitmap(s) for s in sets], pa.binary()), pa.array([wide_bitmap(s) for s in sets], pa.binary()),
                ], ["doc_id", "at", "hash", "class", "n", "keys", "rare", "bits", "wide"])

    return src.mapInArrow(run, "doc_id long, at long, hash long, class binary, n long, keys array<long>, rare long, bits binary, wide binary")


def leads(n: Column, place: Column, per_cent: int) -> Column:
    """Whether the shingle at ``place`` can be the first that a set of ``n`` shares with a linked set that is no smaller."""
    return (100 + per_cent) * (n - place) >= 2 * per_cent * n


def shared_keys(classes: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """(key, id, n, place, size, low, high) of prefix shingles that ``size`` >= 2 classes have, one of which ``leads``; their least and greatest id.

    A frequent shingle may stand in any share of all classes, so its rows are counted with partial aggregation and stay where they are; there are
    at most ``FREQUENT_MOST`` such shingles, which bounds the broadcast. A shingle that no slice has twice escapes that count; so those which
    stand often in every 64th class are treated alike. Which shingles these are affects speed alone.
    """
    by_key = Window.partitionBy("key")
    rows = classes.select("id", "n", "rare", F.posexplode("keys").alias("place", "key")).withColumn("place", F.col("place").cast("int"))
    some = written(rows.where("id % 64 = 0 and place < rare").select("key"), "every-64th")
    hot = hot_keys(some, "key")
    discard(some)
    if hot is not None:
        rows = rows.join(F.broadcast(hot), "key", "left").withColumn("rare", F.when(F.col("__parts").isNull(), F.col("rare")).otherwise(0)).drop("__parts")
    few, many = rows.where("place < rare").drop("rare"), rows.where("place >= rare").drop("rare")
    facts = {"size": F.count("*"), "low": F.min("id"), "high": F.max("id"), "led": F.max(leads(F.col("n"), F.col("place"), per_cent))}
    few = few.select("key", "id", "n", "place", *[f.over(by_key).alias(name) for name, f in facts.items()]).where("size > 1 and led")
    sizes = many.groupBy("key").agg(*[f.alias(name) for name, f in facts.items()]).where("size > 1 and led")
    return few.unionByName(many.join(F.broadcast(sizes), "key")).select("key", "id", "n", "place", "size", "low", "high")


def fits(n: Column, m: Column, per_cent: int) -> Column:
    """Whether sets of these sizes can link."""
    return (100 * F.least(n, m)) >= (per_cent * F.greatest(n, m))


def sets_of_classes(wanted: DataFrame, classes: DataFrame, src: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, set), written, of the classes ``wanted``, a written table of distinct ids; sets are made again from the texts."""
    found = written(wanted.join(classes.select("id", "at", "class"), "id"), "found")
    small = found.count() <= BROADCAST_ROWS
    texts = src.select("at", "text").join(F.broadcast(found) if small else found.hint("shuffle_hash"), "at").select("id", "class", "text")

    def sets_of(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                sets = [shingles(t, words) for t in b.column(2).to_pylist()]
                same = [class_id(s) == c for s, c in zip(sets, b.column(1).to_pylist(), strict=True)]  # an id may stand for several texts
                yield pa.record_batch([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "set"]).filter(pa.array(same, pa.bool_()))

    made = written(texts.mapInArrow(sets_of, "id long, set binary"), "made")
    sets = written(made.groupBy("id").agg(F.any_value("set").alias("set")), "sets")
    discard(found, made)
    return sets


def verified(pairs: DataFrame, classes: DataFrame, src: DataFrame, per_cent: int, words: int = WORDS) -> DataFrame:
    """The pairs (a, b) of class ids that link, by comparing whole sets, which are made again from the texts. ``pairs`` is a written table."""
    pairs = written(with_wide_bits(pairs, classes, per_cent), "pairs")
    wanted = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "wanted")
    sets = sets_of_classes(wanted, classes, src, words)

    def compare(batches):
        for batch in batches:
            for b in slices(batch, "x"):
                keep = []
                for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    if len(u) > len(v):
                        u, v = v, u
                    at = np.searchsorted(v, u)
                    common = int((v[np.minimum(at, len(v) - 1)] == u).sum())
                    keep.append(100 * common >= per_cent * (len(u) + len(v) - common))
                yield pa.record_batch([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = dealt_join(pairs, sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a", "b", hot_keys(pairs, "a"))
    both = dealt_join(both, sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b", "a", hot_keys(pairs, "b"))
    links = written(both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "links")
    discard(pairs, wanted, sets)
    return links


def _sides(pairs: DataFrame, classes: DataFrame, bits: str, per_cent: int) -> DataFrame:
    """Pairs (a, b) with sizes and bitmaps (n, m, x, y) of both, where the sizes fit. ``pairs`` is a written table; one class may be in most of them."""
    side = lambda k, n, x: classes.select(F.col("id").alias(k), F.col("n").alias(n), F.col(bits).alias(x))
    both = dealt_join(pairs, side("a", "n", "x"), "a", "b", hot_keys(pairs, "a"))
    both = dealt_join(both, side("b", "m", "y"), "b", "a", hot_keys(pairs, "b")).where(fits(F.col("n"), F.col("m"), per_cent))
    return both.select("a", "b", "n", "m", "x", "y")


def with_bits(pairs: DataFrame, classes: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (a, b), a < b, whose first bitmaps allow enough overlap."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                n, m = b.column(2).to_numpy(), b.column(3).to_numpy()
                x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in (b.column(4), b.column(5)))
                yield pa.record_batch([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array((100 + per_cent) * most_overlap(n, x, m, y) >= per_cent * (n + m)))

    return _sides(pairs, classes, "bits", per_cent).mapInArrow(run, "a long, b long")


def with_wide_bits(pairs: DataFrame, classes: DataFrame, per_cent: int) -> DataFrame:
    """The pairs whose second bitmaps allow enough overlap too. They take a sixteenth of what whole sets would."""
    def run(batches):
        for b in batches:
            rows = zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True)
            keep = [(100 + per_cent) * wide_overlap(n, x, m, y) >= per_cent * (n + m) for n, m, x, y in rows]
            yield pa.record_batch([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _sides(pairs, classes, "wide", per_cent).mapInArrow(run, "a long, b long")


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(x).view(np.uint64)).sum(-1).astype(np.int64)


def most_overlap(n: np.ndarray, x: np.ndarray, m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """An upper bound of the overlap of sets of ``n`` and ``m`` shingles with bitmaps ``x`` and ``y``:
    shingles outside the other's bits are not common, and a set has ``n`` - ones more shingles than bits."""
    common, both = _ones(x & y), np.minimum(n, m)
    return np.minimum(both, common + np.minimum(n - _ones(x), m - _ones(y)))


class Members:
    """Classes that may be compared: sizes, first bitmaps, labels and, on request, the second bitmaps folded to a common width."""

    def __init__(self, n: np.ndarray, label: np.ndarray, bits: list[bytes], wide: list[bytes]):
        self.n, self.label = n, label
        self.bits = np.frombuffer(b"".join(bits), np.uint64).reshape(len(n), BITS // 64)
        self.spare = n - np.bitwise_count(self.bits).sum(1).astype(np.int64)
        self.width = np.array([len(w) for w in wide], np.int64)
        self.wide, self.folded = wide, {}

    def _folded(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Second bitmaps of members that are ``width`` bytes or twice that, where each of them is, and the shingles that share a bit."""
        if width not in self.folded:
            own, more = np.flatnonzero(self.width == width), np.flatnonzero(self.width == 2 * width)
            x = np.frombuffer(b"".join(self.wide[k] for k in own), np.uint64).reshape(len(own), width // 8)
            y = np.frombuffer(b"".join(self.wide[k] for k in more), np.uint64).reshape(len(more), 2, width // 8)
            both = np.concatenate([x, y[:, 0] | y[:, 1]])
            at = np.full(len(self.n), -1, np.int64)
            at[np.concatenate([own, more])] = np.arange(len(both))
            spare = self.n[np.concatenate([own, more])] - np.bitwise_count(both).sum(1).astype(np.int64)
            self.folded[width] = both, at, spare
        return self.folded[width]

    def alike(self, p: np.ndarray, q: np.ndarray, per_cent: int) -> np.ndarray:
        """Which pairs have other labels, sizes that fit and first bitmaps that allow enough overlap."""
        n, m = self.n[p], self.n[q]
        keep = (self.label[p] != self.label[q]) & (100 * np.minimum(n, m) >= per_cent * np.maximum(n, m))
        at = np.flatnonzero(keep)
        common = np.bitwise_count(self.bits[p[at]] & self.bits[q[at]]).sum(1).astype(np.int64)
        most = np.minimum(np.minimum(n[at], m[at]), common + np.minimum(self.spare[p[at]], self.spare[q[at]]))
        keep[at] = (100 + per_cent) * most >= per_cent * (n[at] + m[at])
        return keep

    def alike_wide(self, p: np.ndarray, q: np.ndarray, per_cent: int) -> np.ndarray:
        """Which pairs, of sizes that fit, have second bitmaps that allow enough overlap."""
        keep, widths = np.ones(len(p), bool), np.minimum(self.width[p], self.width[q])
        far = np.maximum(self.width[p], self.width[q]) > 2 * widths  # only a low likeness lets such sizes fit
        for width in np.unique(widths[~far]):
            both, at, spare = self._folded(int(width))
            here, step = np.flatnonzero((widths == width) & ~far), max(1, (8 << 20) // int(width))
            for s in range(0, len(here), step):
                k = here[s : s + step]
                x, y, n, m = at[p[k]], at[q[k]], self.n[p[k]], self.n[q[k]]
                common = np.bitwise_count(both[x] & both[y]).sum(1).astype(np.int64)
                most = np.minimum(np.minimum(n, m), common + np.minimum(spare[x], spare[y]))
                keep[k] = (100 + per_cent) * most >= per_cent * (n + m)
        return keep


class Tree:
    """A signature tree over members ``at`` in order of size; level 0 are members, level 1 leaves, the last level is the root."""

    def __init__(self, members: Members, at: np.ndarray):
        n, x, label = members.n[at], members.bits[at], members.label[at]
        self.at, self.levels = at, [(n, n, x, members.spare[at], label, np.ones(len(n), bool))]
        fan = LEAF
        while len(self.levels) == 1 or len(self.levels[-1][0]) > 1:
            low, high, x, spare, label, pure = self.levels[-1]
            cut = np.arange(0, len(low), fan)
            same = np.minimum.reduceat(label, cut) == np.maximum.reduceat(label, cut)
            self.levels.append((np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.bitwise_or.reduceat(x, cut), np.maximum.reduceat(spare, cut), label[cut], same & np.logical_and.reduceat(pure, cut)))
            fan = FAN

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Children of nodes of a level, and which of ``nodes`` each belongs to."""
        kids = nodes[:, None] * FAN + np.arange(FAN)
        inside = kids < len(self.levels[level - 1][0])
        return kids[inside], np.nonzero(inside)[0]


def dual_traversal(a: Tree, b: Tree, same: bool, per_cent: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaves (i of a, j of b) that may hold members which link and are not in one component; each pair once if ``same``."""
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        (alow, ahigh, ax, aspare, alabel, apure), (blow, bhigh, bx, bspare, blabel, bpure) = a.levels[la], b.levels[lb]
        if same and la == lb:
            i, j = i[i <= j], j[i <= j]
        keep = (100 * ahigh[i] >= per_cent * blow[j]) & (100 * bhigh[j] >= per_cent * alow[i])
        keep &= ~(apure[i] & bpure[j] & (alabel[i] == blabel[j]))
        i, j = i[keep], j[keep]
        common = np.concatenate([np.zeros(0, np.int64), *(np.bitwise_count(ax[i[s : s + 65536]] & bx[j[s : s + 65536]]).sum(1).astype(np.int64) for s in range(0, len(i), 65536))])
        most = np.minimum(np.minimum(ahigh[i], bhigh[j]), common + np.minimum(aspare[i], bspare[j]))
        keep = (100 + per_cent) * most >= per_cent * (alow[i] + blow[j])
        i, j = i[keep], j[keep]
        if (la == 1 and lb == 1) or not len(i):
            return i, j
        if la >= lb:
            kids, of = a.children(la, i)
            i, j, la = kids, j[of], la - 1
        else:
            kids, of = b.children(lb, j)
            j, i, lb = kids, i[of], lb - 1
        if same and la == lb:
            pairs = np.unique(np.stack([i, j], 1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
            i, j = pairs[:, 0], pairs[:, 1]


def member_pairs(a: Tree, b: Tree, members: Members, per_cent: int, leaves: int = 2048):
    """Pairs (p, q) of members that both bitmaps allow, some leaves at a time, so that no list of all pairs is ever held."""
    i, j = dual_traversal(a, b, a is b, per_cent)
    order = np.argsort(i, kind="stable")
    for s in range(0, len(i), leaves):
        x, y = i[order[s : s + leaves]], j[order[s : s + leaves]]
        p = np.repeat(x[:, None] * LEAF + np.arange(LEAF), LEAF, axis=1).ravel()
        q = np.tile(y[:, None] * LEAF + np.arange(LEAF), (1, LEAF)).ravel()
        keep = (p < len(a.at)) & (q < len(b.at)) & ((p < q) if a is b else True)
        p, q = a.at[p[keep]], b.at[q[keep]]
        keep = members.alike(p, q, per_cent)
        yield p[keep], q[keep]


def trees_of(members: Members, at: np.ndarray, chunk: np.ndarray, u: int, v: int) -> tuple[Tree, Tree] | None:
    """The two trees of a cell (one and the same where its chunks are); None if one chunk has no member."""
    if u == v:
        tree = Tree(members, at)
        return tree, tree
    left, right = at[chunk[at] == u], at[chunk[at] == v]
    return (Tree(members, left), Tree(members, right)) if len(left) and len(right) else None


def surviving(members: Members, cells: list[tuple[np.ndarray, int, int]], chunk: np.ndarray, per_cent: int) -> np.ndarray:
    """Which members have a partner in their cell that both bitmaps allow. Pairs of members known to survive are skipped."""
    alive = np.zeros(len(members.n), bool)
    small = [at for at, u, v in cells if u == v and len(at) <= LEAF]
    if small:  # such a tree is one leaf: all of them at once
        at, cell = np.concatenate(small), np.repeat(np.arange(len(small)), list(map(len, small)))
        for d in range(1, LEAF):
            same = np.flatnonzero(cell[d:] == cell[:-d]) if d < len(cell) else []
            if not len(same):
                break
            p, q = at[same], at[same + d]
            keep = members.alike(p, q, per_cent) & ~(alive[p] & alive[q])
            p, q = p[keep], q[keep]
            keep = members.alike_wide(p, q, per_cent)
            alive[p[keep]] = alive[q[keep]] = True
    for at, u, v in cells:
        if (u != v or len(at) > LEAF) and (trees := trees_of(members, at, chunk, u, v)):
            for p, q in member_pairs(*trees, members, per_cent):
                keep = ~(alive[p] & alive[q])
                p, q = p[keep], q[keep]
                keep = members.alike_wide(p, q, per_cent)
                alive[p[keep]] = alive[q[keep]] = True
    return np.flatnonzero(alive)


def forest(members: Members, cell: tuple[np.ndarray, int, int], chunk: np.ndarray, sets: list[np.ndarray], per_cent: int) -> list[tuple[int, int]]:
    """Links of one cell that join its members' components as all its links do: fewer than it has members."""
    at, u, v = cell
    trees = trees_of(members, at, chunk, u, v)
    if trees is None:
        return []
    ends = np.cumsum([0, *(len(sets[k]) for k in at)])
    values, codes = np.unique(np.concatenate([sets[k] for k in at]), return_inverse=True)
    code_of = {int(k): codes[ends[x] : ends[x + 1]] for x, k in enumerate(at)}
    mark, label, links = np.zeros(len(values), bool), members.label.copy(), []
    for p, q in member_pairs(*trees, members, per_cent):
        order = np.argsort(p, kind="stable")
        p, q = p[order], q[order]
        for s, e in zip(cuts := np.flatnonzero(np.diff(p, prepend=-1)), [*cuts[1:], len(p)], strict=True):
            one = p[s]
            other = q[s:e][label[q[s:e]] != label[one]]
            other = other[members.alike_wide(np.full(len(other), one), other, per_cent)]
            if not len(other):
                continue
            mark[code_of[int(one)]] = True
            for k in range(0, len(other), 256):
                near = other[k : k + 256]
                sizes = members.n[near]
                common = np.add.reduceat(mark[np.concatenate([code_of[int(x)] for x in near])].astype(np.int64), np.cumsum(sizes) - sizes)
                near = near[100 * common >= per_cent * (members.n[one] + sizes - common)]
                for x in near:
                    if label[x] != label[one]:
                        links.append((int(one), int(x)))
                        label[label == label[x]] = label[one]
            mark[code_of[int(one)]] = False
    return links


def blocks_of(lists: DataFrame) -> DataFrame:
    """(block, id) such that all members of a list (key, id, low) meet in a block.

    Near copies share most of their lists, so lists with the same least class are one block if that makes no more pairs than the lists apart.
    """
    hot = hot_keys(lists, "low")
    one = written(lists.select("low", "id").distinct(), "blocks")
    size = one.groupBy("low").agg(F.count("*").alias("size"))
    apart = lists.groupBy("low", "key").agg(F.count("*").alias("size")).groupBy("low").agg(F.sum(F.col("size") * F.col("size")).alias("apart"))
    merged = written(size.join(apart, "low").select("low", (F.col("size") * F.col("size") <= F.col("apart")).alias("merged")), "merged")
    whole = dealt_join(one, merged, "low", "id", hot).where("merged").select(F.col("low").alias("block"), "id")
    split = dealt_join(lists, merged, "low", "id", hot).where("not merged").select(F.xxhash64("key").alias("block"), "id")
    out = written(whole.union(split), "block-rows")
    discard(one, merged)
    return out


def chunked(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """``blocks`` (block, id) with ``chunk`` and ``chunks``: chunks hold about ``LIST`` members and ``ELEMENTS`` shingles, by a hash of id. ``blocks`` is a written table."""
    chunks = F.ceil(F.greatest(F.count("*") / LIST, F.sum("n") / ELEMENTS)).cast("int")
    large = dealt_join(blocks, sizes.select("id", "n"), "id", "block", hot_keys(blocks, "id")).groupBy("block").agg(chunks.alias("chunks")).where("chunks > 1")
    rows = dealt_join(blocks, large, "block", "id", hot_keys(blocks, "block"), "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    return rows.withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks").cast("int"))


def celled(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """``rows`` (block, id, chunk, u, v) with ``columns`` of id, the rows of a cell (block, u, v) together and in order of size. ``rows`` is a written table."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt_join(rows, columns, "id", "block", hot_keys(rows, "id"))
    return rows.repartition(n, "block", "u", "v").sortWithinPartitions("block", "u", "v", "n", "id")


def visits(chunks: DataFrame, known: DataFrame) -> DataFrame | None:
    """(block, id, chunk, u, v) of the cells in which members outside their block's largest component visit other chunks; None if no block has such.

    ``chunks`` is ``chunked``, written. Visitors of a block are cut into parties of ``LIST``; a chunk u meets a party in the cell (u, v), v = -1 - party. Members at
    home are repeated once a party, visitors once a chunk.
    """
    split = chunks.where("chunks > 1")
    if split.isEmpty():
        return None
    members = written(dealt_join(split, known.select("id", "label", "n"), "id", "block", hot_keys(split, "id")), "members")
    counted = members.groupBy("block", "label").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    most = counted.groupBy("block").agg(F.max(F.struct("size", (-F.col("label")).alias("minus"), "n")).alias("m"), F.sum("size").alias("all"), F.sum("n").alias("n"))
    most = most.where("m.size < all").select("block", (-F.col("m.minus")).alias("largest"), F.ceil(F.greatest((F.col("all") - F.col("m.size")) / LIST, (F.col("n") - F.col("m.n")) / ELEMENTS)).cast("int").alias("parties"))
    rows = written(dealt_join(members, most, "block", "id", hot_keys(members, "block")), "split")
    discard(members)
    at_home = rows.withColumn("v", F.explode(F.sequence(F.lit(-1), -F.col("parties"), F.lit(-1)))).select("block", "id", "chunk", F.col("chunk").alias("u"), "v")
    party = (-1 - F.pmod(F.xxhash64("id", F.lit(1)), "parties")).cast("int")
    away = rows.where("label != largest").withColumn("v", party).withColumn("u", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("u != chunk")
    out = written(at_home.union(away.select("block", "id", F.col("v").alias("chunk"), "u", "v")), "visits")
    discard(rows)
    return out


def whole_cells(batches, cell: tuple[str, str, str] = ("block", "u", "v")):
    """Tables of whole cells, with the cells' rows as (places, u, v), from batches in order of cells."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        first, last = ([held.column(c)[k].as_py() for c in cell] for k in (0, len(held) - 1))
        if first == last:
            continue
        held = held.combine_chunks()
        cuts = _cuts(held, cell)
        yield held.slice(0, int(cuts[-1])), _places(held, cuts)
        held = held.slice(int(cuts[-1]))
    if held is not None:
        held = held.combine_chunks()
        cuts = np.append(_cuts(held, cell), len(held))
        yield held, _places(held, cuts)


def _cuts(t: pa.Table, cell) -> np.ndarray:
    values = np.stack([t.column(c).to_numpy().astype(np.int64) for c in cell], 1)
    return np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1


def _places(t: pa.Table, cuts: np.ndarray) -> list[tuple[np.ndarray, int, int]]:
    u, v = t.column("u").to_numpy(), t.column("v").to_numpy()
    return [(np.arange(s, e), int(u[s]), int(v[s])) for s, e in zip([0, *cuts[:-1]], cuts, strict=True)]


def _members(t: pa.Table) -> Members:
    return Members(t.column("n").to_numpy(), t.column("label").to_numpy(), t.column("bits").to_pylist(), t.column("wide").to_pylist())


def with_partners(cells: DataFrame, per_cent: int) -> DataFrame:
    """(block, id) of the members that have a partner in their cell by signature trees and both bitmaps: at most a row a member."""
    def run(batches):
        for t, places in whole_cells(batches):
            at = surviving(_members(t), places, t.column("chunk").to_numpy(), per_cent)
            yield from t.select(["block", "id"]).take(pa.array(at)).to_batches()

    return cells.mapInArrow(run, "block long, id long")


def cell_links(cells: DataFrame, per_cent: int) -> DataFrame:
    """Links (a, b) that join components as all links inside cells do, by whole sets (``set``): of those between two components (x, y) one is enough."""
    def run(batches):
        for t, places in whole_cells(batches):
            members, ids, found = _members(t), t.column("id").to_numpy(), []
            sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
            for place in places:
                found += forest(members, place, t.column("chunk").to_numpy(), sets, per_cent)
            at = np.array(found, np.int64).reshape(-1, 2)
            pairs, of = np.sort(ids[at], axis=1), np.sort(members.label[at], axis=1)
            yield pa.record_batch([pa.array(c) for c in (*of.T, *pairs.T)], ["x", "y", "a", "b"])

    found = cells.mapInArrow(run, "x long, y long, a long, b long")
    return found.groupBy("x", "y").agg(F.min(F.struct("a", "b")).alias("one")).select("one.a", "one.b")


def links_of_cells(cells: DataFrame, known: DataFrame, classes: DataFrame, src: DataFrame, per_cent: int, words: int) -> DataFrame:
    """Links (a, b), written, that join components as all links inside the cells do. ``cells`` is a written table of (block, id, chunk, u, v)."""
    alive = written(with_partners(celled(cells, known), per_cent).distinct(), "alive")
    wanted = written(alive.select("id").distinct(), "wanted")
    sets = sets_of_classes(wanted, classes, src, words)
    whole = written(cells.join(alive, ["block", "id"], "left_semi"), "whole")
    links = written(cell_links(celled(whole, known.join(sets, "id")), per_cent), "links")
    discard(alive, wanted, sets, whole)
    return links


def with_blocks(lists: DataFrame, labels: DataFrame, classes: DataFrame, src: DataFrame, per_cent: int, words: int = WORDS) -> DataFrame:
    """``labels``, written, after all links between members of one list (key, id, low).

    Signature trees say which members have a partner; only they are compared by whole sets. Neither step writes pairs that may link. Blocks of one chunk are done when
    each chunk has been compared with itself; of the others the members outside the largest component visit the other chunks.
    """
    blocks = blocks_of(lists)
    facts = classes.select("id", "n", "bits", "wide")
    chunks = written(chunked(blocks, facts), "chunks")
    home = written(chunks.select("block", "id", "chunk", F.col("chunk").alias("u"), F.col("chunk").alias("v")), "home")
    links = links_of_cells(home, labelled(facts, labels), classes, src, per_cent, words)
    labels = components(links, labels)
    discard(blocks, home, links)
    known = labelled(facts, labels)
    if (cells := visits(chunks, known)) is not None:
        links = links_of_cells(cells, known, classes, src, per_cent, words)
        former, labels = labels, components(links, labels)
        discard(cells, links, former)
    discard(chunks)
    return labels


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(id, label) of the components of at most ``ONE_TASK`` edges (v, w)."""
    def run(batches):
        none = np.zeros(0, np.int64)
        ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        v, w = (np.concatenate([none, *(e[k] for e in ends)]) for k in (0, 1))
        ids, at = np.unique(np.concatenate([v, w]), return_inverse=True)
        a, b, least = at[: len(v)], at[len(v) :], np.arange(len(ids))
        while True:
            x, y = least[a], least[b]
            if (x == y).all():
                break
            np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
            while (least[least] != least).any():
                least = least[least]
        other = least != np.arange(len(ids))
        yield pa.record_batch([pa.array(ids[other]), pa.array(ids[least[other]])], ["id", "label"])

    return edges.select("v", "w").coalesce(1).mapInArrow(run, "id long, label long")


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(id, label), written: the least id of each linked class's component, ids that are their own label apart.

    ``labels`` (written) are the components that earlier links made: links are contracted to them first. Many edges go by alternating star steps, at most
    ``ONE_TASK`` by one task.
    """
    ends = links.select("a", "b")
    if labels is not None:
        ends = written(ends, "ends")
        of = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"of_{c}"))
        met = dealt_join(dealt_join(ends, of("a"), "a", "b", hot_keys(ends, "a"), "left"), of("b"), "b", "a", hot_keys(ends, "b"), "left")
        former_ends, ends = ends, met.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    edges = written(ends.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("w")).where("v != w").distinct(), "edges")
    if labels is not None:
        discard(former_ends)
    digest = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("v", "w").cast("decimal(38,0)"))).first())
    before = digest(edges)
    while before[0] > ONE_TASK:
        both = written(edges.select("v", "w").union(edges.select(F.col("w").alias("v"), F.col("v").alias("w"))), "both")
        least = both.groupBy("v").agg(F.least(F.min("w"), F.first("v")).alias("m"))
        large = dealt_join(both, least, "v", "w", hot_keys(both, "v")).where(F.col("w") > F.col("v")).select(F.col("w").alias("v"), F.col("m").alias("w"))
        large = written(large.where("v != w").distinct(), "large")
        low = large.groupBy("v").agg(F.min("w").alias("m"))
        small = dealt_join(large, low, "v", "w", hot_keys(large, "v"))
        small = small.select(F.col("w").alias("v"), F.col("m").alias("w")).union(low.select("v", "m")).where("v != w").distinct()
        former, edges = edges, written(small, "edges")
        after = digest(edges)
        discard(former, both, large)
        if after == before:
            break
        before = after
    found = edges.groupBy(F.col("v").alias("id")).agg(F.min("w").alias("label")) if before[0] > ONE_TASK else _in_one_task(edges)
    out = written(found, "labels")
    discard(edges)
    if labels is not None:
        joined = dealt_join(labels, out.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "id", hot_keys(labels, "label"), "left")
        former, out = out, written(joined.select("id", F.coalesce("to", "label").alias("label")).unionByName(out), "labels")
        discard(former)
    return out


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the label of ``id``: its component, or itself."""
    return rows.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))


def linked_classes(src: DataFrame, per_cent: int, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """The rows of the documents, and (id, class, rep, label) of the classes: ``label`` tells components apart, ``rep`` is the least id of a class."""
    rows = written(document_rows(src, frequent_shingles(src, words=words), per_cent, words), "documents")
    classes = rows.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("rep"), F.min("at").alias("at"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys"), F.any_value("rare").alias("rare"), F.any_value("bits").alias("bits"), F.any_value("wide").alias("wide"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    whole, rows = rows, written(rows.select("doc_id", "at", "hash", "class", "n"), "rows")
    discard(whole)
    shared = written(shared_keys(classes, per_cent), "shared")
    labels, open_lists, tested = None, shared, None
    for centre in ("low", "high")[:CENTRES]:
        met = open_lists.select(F.least("id", centre).alias("a"), F.greatest("id", centre).alias("b")).where("a != b").distinct()
        if tested is not None:
            met = met.join(tested, ["a", "b"], "left_anti")
        met = written(met, "met")
        pairs = written(with_bits(met, classes.select("id", "n", "bits"), per_cent), "candidates")
        discard(met)
        found = verified(pairs, classes, src, per_cent, words)
        tested = pairs if tested is None else tested.union(pairs)
        former, labels = labels, components(found, labels)
        discard(found, *([former] if former is not None else []))
        by_key = labelled(shared, labels)
        # A list of many members is dealt to parts here too; "size" counts them.
        parts = F.ceil(F.col("size") / HOT_ROWS)
        mixed = by_key.groupBy("key").agg(F.min("label").alias("p"), F.max("label").alias("q"), F.any_value("size").alias("size")).where("p != q")
        mixed = mixed.select("key", F.explode(F.sequence(F.lit(0), parts.cast("int") - 1)).alias("part"))
        dealt = by_key.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
        former, open_lists = open_lists, written(dealt.join(mixed, ["key", "part"], "left_semi").drop("part"), "mixed")
        if former is not shared:
            discard(former)
    # All pairs with a centre are tested, so lists of three are done, and centres leave the others.
    lists = written(open_lists.where("size > 3 and id != low and id != high").select("key", "id", "low"), "lists")
    found = with_blocks(lists, labels, classes, src, per_cent, words)
    done = written(labelled(classes.select("id", "class", "rep"), found), "done")
    discard(shared, open_lists, lists, tested, labels, found, classes)
    return rows, done


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_cent: int = PER_CENT, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, class, component_id): the component of each document among all links."""
    rows, done = linked_classes(_source(docs, id_col, text_col), per_cent, words)
    low = done.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_class = done.join(low, "label").select("class", "component_id")
    joined = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class")).alias("class"))
    joined = dealt_join(joined, of_class, "class", "doc_id", hot_keys(rows.where("n > 0"), "class"), "left")
    return joined.select("doc_id", "n_shingles", "class", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_cent: int = PER_CENT, words: int = WORDS) -> DataFrame:
    """Exactly one row, with all its columns, of each component: the first by id, rows without one last, then by a hash of the text.

    Repeated rows and rows without an id are rows like others. Rows with an empty set are all kept. Rows that tie in id and text
    are told apart by their marks, which depend on partitions.
    """
    marked = written(docs.withColumn("__row", F.monotonically_increasing_id()), "marked")
    rows, done = linked_classes(_source(marked, id_col, text_col, "__row"), per_cent, words)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "at")
    firsts = rows.where("n > 0").groupBy("class").agg(F.min(order).alias("first"))
    firsts = firsts.join(done.select("class", "label"), "class").groupBy("label").agg(F.min("first").alias("first"))
    dropped = written(rows.where("n > 0").select("at").join(firsts.select("first.at"), "at", "left_anti").select(F.col("at").alias("__row")), "dropped")
    small = dropped.count() <= BROADCAST_ROWS  # then whole texts need not be shuffled
    return marked.join(F.broadcast(dropped) if small else dropped.hint("shuffle_hash"), "__row", "left_anti").drop("__row")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every whole document."""
    return join_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS grams FROM w
), n AS (SELECT doc_id, len(grams) AS n FROM s), g AS (SELECT doc_id, unnest(grams) AS gram FROM s),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.doc_id AND r.root < l.y)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, (SELECT min(root) FROM r WHERE r.doc_id = n.doc_id) AS component_id FROM n
"""
