"""N-gram Jaccard join in metric space: who is linked to whom by sets of word shingles, exactly.

Documents with the same set form a class, and classes are joined in regions by document pivots. In a region,
some of its sets are pivots; each set's distance to each pivot is measured, and sets within the radius are
linked to it. Each set goes to the Voronoi cell of its nearest pivot and, as the triangle inequality demands,
to each cell whose pivot is farther by at most twice the radius; sets far from all pivots form a cell of their
own. Sets that are connected already need no comparison: of them only those go on whose distance to the pivot
differs by no more than the radius from that of a set that isn't. Cells are regions again, until nothing is
left to compare. Regions of at most LEAF sets are joined so in one task, larger ones by Spark, level by level,
with all pairs of blocks as the last resort for what pivots can't split. Only links that connect something new
are written, so a group of copies costs as many links as it has members.

Where regions begin: nearly all documents lie at distance 1 from nearly all others, so pivots drawn from the
whole corpus would split off next to nothing. Regions are therefore components of candidates. All shingles
stand in one order, rare ones first; two linked sets share one of their first shingles, and as linked sets are
of like size, a pair of rings of size fixes how many first ones count. These windows are a little wider than
they must be, as then linked sets share several: pairs that share fewer are no candidates.

The order rests on counts of all shingles of all documents in a table of fixed size. A second table tells which
first shingles may occur twice, and a third one which documents' sets are needed again; false hits cost work but
change nothing. Both grow with the input up to a fixed size; beyond it they let more pass. Sets are compared by
64-bit shingle hashes.

Null and empty texts and texts without words have empty sets, which are linked with nothing: their
component is their own doc_id. With fewer words than n the whole sequence is one shingle. Equal sets are
linked. Rows with a null doc_id take part and have a component if a row with an id is linked. Repeated rows
give repeated results. Further columns, whatever their names, are not read. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirlake.llm import words as W
from weirlake.llm.common import arrow_rows, batched, only, packed, row_key, rows_of, union_all, unpacked, utf8, written
from weirlake.llm.graph import components

COUNTERS = 22  # bits of the place in the table of counts; 4 million counters
LEAST_BITS, MOST_BITS = 20, 30  # of the place in the other tables; 128 MB at most
CHUNK = 16  # bits of a place within a chunk that travels as one row
LEAF, LEAF_SHINGLES = 2048, 4_000_000  # what one task joins at a time
RINGS = 4  # to the ratio of sizes that linked sets have at most
SPARE = 0.02  # of a set's shingles: by how many a window is wider, and so many more are shared
SMALL_REGION = 8  # lists up to this length are counted as pairs
HOT = 1000  # shingles in more documents than this, and four times the mean of counters, are dealt by aggregates
PIVOTS = 8
FEW = 12  # sets that are compared one by one
LEVELS = 4
FAR = 0.7


def bits_for(n: int) -> int:
    """Bits of the place in a table for n entries, of which then one in sixteen hits by chance."""
    return min(MOST_BITS, max(LEAST_BITS, int(16 * max(1, n) - 1).bit_length()))


def place(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def prefix_size(n: int, percent: int) -> int:
    """How many shingles of n can be missing from a linked set, and one more, and the spare ones."""
    return min(n, n - (percent * n + 99) // 100 + 1 + int(n * SPARE))


def linked(inter: int, a: int, b: int, percent: int) -> bool:
    return 100 * inter >= percent * (a + b - inter)


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set."""
    with np.errstate(over="ignore"):
        at = np.arange(1, len(s) + 1, dtype=np.uint64) * W.STEP
        one, two = W.mix(s ^ at).sum(dtype=np.uint64), W.mix(s + at).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))


# Tables of fixed size: each task counts for itself, chunks are summed by Spark.


def _chunks(counts: np.ndarray) -> Iterator[tuple]:
    for k in range(0, len(counts), 1 << CHUNK):
        own = counts[k : k + (1 << CHUNK)]
        if top := int(own.max()):
            yield k >> CHUNK, own.astype("<u1" if top < 256 else "<u2" if top < 65536 else "<u4").tobytes()


def _sparse(places: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
    """Chunks of a table that has few places: sorted distinct places and their counts, at most 255."""
    chunk = places >> CHUNK
    cuts = np.concatenate((np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1]))), [len(places)])) if len(places) else np.zeros(1, np.int64)
    low, few = (places & ((1 << CHUNK) - 1)).astype("<u2"), np.minimum(counts, 255).astype(np.uint8)
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(chunk[a]), low[a:b].tobytes() + few[a:b].tobytes()


def _spread(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 3
    return np.frombuffer(data, "<u2", n).astype(np.int64), np.frombuffer(data, np.uint8, n, 2 * n)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) >> CHUNK}")


def _summed(rows: DataFrame, bits: int, as_bits: bool) -> np.ndarray:
    """The table from chunks of all tasks: counts, or whether a count is at least two (one bit each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for chunk, data in rows_of(batches, "chunk", "data"):
            own = total.get(chunk)
            if own is None:
                own = total[chunk] = np.zeros(1 << CHUNK, np.uint16 if as_bits else np.int64)
            if as_bits:
                at, k = _spread(data)
                own[at] = np.minimum(own[at] + k.astype(np.uint16), 255)
            else:
                own += _unpacked(data)
        out = ((k, np.packbits(v >= 2).tobytes() if as_bits else np.minimum(v, (1 << 31) - 1).astype("<u4").tobytes()) for k, v in total.items())
        yield from batched(out, pa.schema([("chunk", pa.int64()), ("data", pa.binary())]), 16)

    n = 1 << (bits - CHUNK)
    parts = min(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    width = (1 << CHUNK) // 8 if as_bits else 4 << CHUNK
    out = np.zeros(n * width, np.uint8)
    for r in rows.repartition(parts, "chunk").mapInArrow(run, "chunk long, data binary").collect():  # 32 MB at most
        out[r[0] * width : (r[0] + 1) * width] = np.frombuffer(r[1], np.uint8)
    return out if as_bits else out.view("<u4")


def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def shingle_counts(docs: DataFrame, n: int) -> np.ndarray:
    """In how many documents shingles occur, by place in the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTERS, np.uint32)
        for (text,) in rows_of(batches, "text"):
            at = place(W.shingles(utf8(text), n), COUNTERS)
            np.add.at(counts, at, 1)
        yield from batched(_chunks(counts), pa.schema([("chunk", pa.int64()), ("data", pa.binary())]), 8)

    return _summed(only(docs, "text").mapInArrow(run, "chunk long, data binary"), COUNTERS, False)


ROW = ("t1", "t2")


def document_sets(docs: DataFrame, n: int, percent: int, counts) -> DataFrame:
    """doc_id, row key, n_shingles, signature, first shingles, and how many of these are not hot, of each document.
    counts: a broadcast variable."""
    hot = max(HOT, 4 * int(counts.value.sum(dtype=np.int64)) // len(counts.value))
    names = ["doc_id", *ROW, "n_shingles", "s1", "s2", "cold"]
    schema = pa.schema([*((c, pa.int64()) for c in names), ("first", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value

        def rows() -> Iterator[tuple]:
            for *key, text in rows_of(batches, "doc_id", *ROW, "text"):
                s = W.shingles(utf8(text), n)
                if not len(s):
                    yield (*key, 0, None, None, None, None)
                    continue
                known = table[place(s, COUNTERS)]
                order = np.lexsort((s, known))[: prefix_size(len(s), percent)]
                yield (*key, len(s), *signature(s), int((known[order] <= hot).sum()), s[order].view(np.int64))

        yield from batched(rows(), schema)

    arrow_rows(docs.sparkSession)
    return only(docs, "doc_id", "text").select("doc_id", *row_key(ROW), "text").mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", first array<long>")


def _may_meet(first: DataFrame, bits: int) -> np.ndarray:
    """Which first shingles may occur in two documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for b in batches]
        at, k = np.unique(place(np.concatenate(held), bits), return_counts=True) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        yield from batched(_sparse(at, k), pa.schema([("chunk", pa.int64()), ("data", pa.binary())]), 1000)

    return _summed(first.select("first").mapInArrow(run, "chunk long, data binary"), bits, True)


def _needed_bits(needed: DataFrame, bits: int) -> np.ndarray:
    """The table of the documents whose sets are wanted: (doc_id, s1, s2) each counts twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [place(_row_hash(*(b.column(i) for i in range(3))), bits) for b in batches]
        at = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
        yield from batched(_sparse(at, np.full(len(at), 2)), pa.schema([("chunk", pa.int64()), ("data", pa.binary())]), 1000)

    return _summed(needed.mapInArrow(run, "chunk long, data binary"), bits, True)


def _row_hash(doc_id: pa.Array, s1: pa.Array, s2: pa.Array) -> np.ndarray:
    parts = [x.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for x in (doc_id, s1, s2)]
    with np.errstate(over="ignore"):
        return W.mix(W.mix(parts[0] * W.STEP + parts[1]) + parts[2])


def _may_be(wanted, bits: int):
    """Whether the table of _needed_bits() has a row by its two keys, as a function of columns."""

    @F.pandas_udf("boolean")
    def run(t1: pd.Series, t2: pd.Series) -> pd.Series:
        zero = pa.array(np.zeros(len(t1), np.int64))
        return pd.Series(_has(wanted.value, place(_row_hash(pa.array(t1), pa.array(t2), zero), bits)))

    return run


def _sets_of(docs: DataFrame, n: int, needed, bits: int) -> DataFrame:
    """doc_id, signature and set of the documents that the table has."""
    schema = pa.schema([("doc_id", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("set", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = needed.value

        def rows() -> Iterator[tuple]:
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                s = W.shingles(utf8(text), n)
                if len(s):
                    sig = signature(s)
                    if _has(table, place(_row_hash(*(pa.array([x], pa.int64()) for x in (doc_id, *sig))), bits))[0]:
                        yield (doc_id, *sig, s.view(np.int64))

        yield from batched(rows(), schema, 100)

    arrow_rows(docs.sparkSession)
    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, s1 long, s2 long, set array<long>")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Elements of both sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _linked_pairs(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets are linked, as a square of truth values. Shingles of one set alone can't be common."""
    k, size = len(sets), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(k), size)
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    on = count[at] > 1
    at, owner = column[at[on]], owner[on]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    common, width = np.zeros((k, k), np.float32), max(256, (8 << 20) // k)
    for first in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        lo, hi = np.searchsorted(at, [first, first + width])
        some = np.zeros((k, width), np.float32)
        some[owner[lo:hi], at[lo:hi] - first] = 1
        common += some @ some.T
    return (100 + percent) * common.astype(np.float64) >= percent * (size[:, None] + size[None, :])


class Links:
    """Sets of a region that are found to be linked, and who is connected by that."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], balls: list[int | None], percent: int):
        self.ids, self.sets, self.percent = ids, sets, percent
        self.size = np.array([len(s) for s in sets])
        self.root = list(range(len(ids)))
        self.found: list[tuple[int, int]] = []
        at: dict[int, int] = {}
        for i, b in enumerate(balls):
            if b is not None:
                self.root[self.find(i)] = self.find(at.setdefault(b, i))

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.root[a] = b
            if self.ids[i] != self.ids[j]:
                self.found.append((self.ids[i], self.ids[j]))

    def pair(self, i: int, j: int) -> None:
        if self.find(i) != self.find(j) and linked(_common(self.sets[i], self.sets[j]), len(self.sets[i]), len(self.sets[j]), self.percent):
            self.link(i, j)

    def distances(self, flat: np.ndarray, starts: np.ndarray, rows: np.ndarray, pivot: int) -> tuple[np.ndarray, np.ndarray]:
        """Jaccard distances of rows, whose sets stand in flat, to a pivot, and which of them are linked to it."""
        own = self.sets[pivot]
        at = np.searchsorted(own, flat)
        at[at == len(own)] = 0
        inter = np.add.reduceat((own[at] == flat).astype(np.int64), starts)
        union = self.size[rows] + self.size[pivot] - inter
        return 1 - inter / union, 100 * inter >= self.percent * union

    def split(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """Compare rows with pivots among them, link what is within the radius, and give out the cells that are left."""
        r = 1 - self.percent / 100 + 1e-9
        flat, starts = np.concatenate([self.sets[i] for i in rows]), np.cumsum(self.size[rows]) - self.size[rows]
        pivots, columns = [int(rows[0])], []
        most = min(PIVOTS, 1 + len(rows) // 4)
        while True:
            d, near = self.distances(flat, starts, rows, pivots[-1])
            columns.append(d)
            for i in rows[near]:
                self.link(int(i), pivots[-1])
            if len(pivots) == most:
                break
            home = np.minimum.reduce(columns)
            farthest = int(np.argmax(home))  # the next pivot lies farthest from those so far
            if home[farthest] <= 2 * r:
                break
            pivots.append(int(rows[farthest]))
        d = np.stack(columns, 1)
        home = d.min(1)
        left = ~np.isin(rows, pivots)  # a pivot has been compared with all
        for k in range(len(pivots)):
            on = left & (home <= FAR) & (d[:, k] <= home + 2 * r)
            yield self.reachable(rows[on], d[on, k], r)
        yield rows[left & (home > FAR - r)]

    def reachable(self, rows: np.ndarray, d: np.ndarray, r: float) -> np.ndarray:
        """A cell without those of its largest connected part that no other set can be linked to."""
        if len(rows) < 2:
            return rows
        root = np.array([self.find(int(i)) for i in rows])
        value, n = np.unique(root, return_counts=True)
        core = root == value[np.argmax(n)]
        if core.all():
            return rows[:0]
        others = np.sort(d[~core])
        at = np.searchsorted(others, d[core] - r)
        keep = ~core
        keep[np.flatnonzero(core)] = (at < len(others)) & (others[np.minimum(at, len(others) - 1)] <= d[core] + r)
        return rows[keep]

    def run(self) -> list[tuple[int, int]]:
        if len(self.ids) == 2:
            self.pair(0, 1)
            return self.found
        # Large sets first, of equal ones by id: the order doesn't hang on how rows come.
        todo = [np.array(sorted(range(len(self.ids)), key=lambda i: (-self.size[i], self.ids[i])))]
        while todo:
            rows = todo.pop()
            if len(rows) < 2 or len({self.find(int(i)) for i in rows}) == 1:
                continue
            if len(rows) == 2:
                self.pair(int(rows[0]), int(rows[1]))
                continue
            cells = [c for c in self.split(rows) if len(c) > 1]
            if 2 * sum(len(c) ** 2 for c in cells) <= len(rows) ** 2:
                todo += cells
            else:  # windows that overlap so much split nothing
                self.compare(np.unique(np.concatenate(cells)))
        return self.found

    def compare(self, rows: np.ndarray) -> None:
        """All pairs of a few sets, of more by a matrix product."""
        if len(rows) <= FEW:
            for i, j in combinations(rows.tolist(), 2):
                self.pair(i, j)
            return
        on = _linked_pairs([self.sets[i] for i in rows], self.percent)
        for i, j in zip(*np.nonzero(np.triu(on, 1)), strict=True):
            self.link(int(rows[i]), int(rows[j]))


def connect(ids: list[int], sets: list[np.ndarray], balls: list[int | None], percent: int) -> list[tuple[int, int]]:
    """Links that connect the sets of a region as all links would. balls: sets with the same one are connected
    already."""
    return Links(ids, sets, balls, percent).run()


def _leaf_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of the groups (region, cid, ball), each in one task."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[tuple]:
            now, own = None, ([], [], [])
            for b in batches:
                region, cid, ball = (b.column(i).to_pylist() for i in range(3))
                values, offsets = b.column(3).values.to_numpy(zero_copy_only=False), b.column(3).offsets.to_numpy()
                for i, r in enumerate(region):
                    if r != now:
                        if len(own[0]) > 1:
                            yield own
                        now, own = r, ([], [], [])
                    if own[0] and own[0][-1] == cid[i]:
                        continue  # by a repeated row
                    own[0].append(cid[i])
                    own[1].append(np.array(values[offsets[i] : offsets[i + 1]]).view(np.uint64))
                    own[2].append(ball[i])
            if len(own[0]) > 1:
                yield own

        yield from batched((link for own in groups() for link in connect(*own, percent)), schema)

    dealt = members.join(sets, KEY).select("region", "cid", "ball", "set").repartition("region").sortWithinPartitions("region", "cid")
    return dealt.mapInArrow(run, "a long, b long")


#: A class by its set and the document that stands for it.
KEY = ["s1", "s2", "own"]
MEMBER = ["region", "cid", "n", "ball", *KEY]


def _with_size(members: DataFrame) -> DataFrame:
    """members with k, the number of their region's rows, and blocks, in how many pieces of half a leaf it is."""
    balls = [F.count_if(F.col("ball").isNull()).alias("free"), F.min("ball").alias("least"), F.max("ball").alias("most")]
    sizes = members.groupBy("region").agg(F.count("*").alias("k"), F.sum("n").alias("weight"), *balls)
    blocks = F.greatest(F.ceil(2 * F.col("k") / LEAF), F.ceil(2 * F.col("weight") / LEAF_SHINGLES)).cast("int")
    # Only the sets of one ball are connected already: two balls may have no link but one in this region.
    sizes = written(sizes.where("k > 1 and (free > 0 or least != most)").select("region", "k", blocks.alias("blocks")), "sizes")
    return written(members.select(MEMBER).join(sizes, "region"), "sized")


def _in_blocks(members: DataFrame) -> DataFrame:
    """What pivots can't split, as pairs of blocks of half a leaf. A large ball has blocks of its own, which are
    compared with all others, but not with one another, as they are connected already; the rest is dealt together."""
    sizes = members.groupBy("region", "ball").agg(F.count("*").alias("k"), F.sum("n").alias("weight"))
    pieces = lambda k, weight: F.greatest(F.lit(1), F.ceil(2 * k / LEAF), F.ceil(2 * weight / LEAF_SHINGLES)).cast("int")
    large = F.col("ball").isNotNull() & (2 * F.col("k") > LEAF)
    sizes = written(sizes.withColumn("part", F.when(large, F.col("ball"))), "balls")
    parts = written(sizes.groupBy("region", "part").agg(pieces(F.sum("k"), F.sum("weight")).alias("pieces")), "parts")
    own = members.join(sizes.where("part is not null").select("region", "ball", "part"), ["region", "ball"], "left")
    of = parts.select(F.col("region").alias("in_region"), F.col("part").alias("in_part"), "pieces")
    own = own.join(of, (F.col("region") == F.col("in_region")) & F.col("part").eqNullSafe(F.col("in_part")))
    own = own.withColumn("i", F.pmod(F.xxhash64("cid"), F.col("pieces")).cast("int"))
    block = F.xxhash64(F.col("part").isNull(), F.coalesce("part", F.lit(0)), "i")
    blocks = written(parts.select("region", "part", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("i")).select("region", "part", block.alias("block")), "blocks")
    other = blocks.select("region", F.col("part").alias("other_part"), F.col("block").alias("other"))
    apart = F.col("part").isNull() | F.col("other_part").isNull() | (F.col("part") != F.col("other_part"))
    pairs = blocks.join(other, "region").where(apart & (F.col("block") <= F.col("other")))
    pairs = pairs.select("region", F.xxhash64("region", "block", "other").alias("pair"), F.explode(F.array_distinct(F.array("block", "other"))).alias("block"))
    return own.withColumn("block", block).join(written(pairs, "pairs"), ["region", "block"]).withColumn("region", F.col("pair")).select(MEMBER)


def _joined_pivots(at: DataFrame) -> DataFrame:
    """region, pivot and rep: pivots of a region that are linked to one set are connected, and rep names them all."""
    own = F.transform(F.filter("near", lambda x: x["linked"]), lambda x: x["pivot"])
    sets = at.select("region", F.array_sort(own).alias("own")).where("size(own) > 0").groupBy("region").agg(F.collect_set("own").alias("sets"))  # 2 ** PIVOTS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for region, sets in rows_of(batches, "region", "sets"):
                rep: dict[int, int] = {}
                for own in sets:
                    held = {rep.get(p, p) for p in own}
                    least = min(held)
                    rep.update({p: least for p in own})
                    rep.update({p: least for p, v in rep.items() if v in held})
                yield from ((region, p, v) for p, v in rep.items())

        yield from batched(rows(), pa.schema([("region", pa.int64()), ("pivot", pa.int64()), ("rep", pa.int64())]))

    return written(sets.mapInArrow(run, "region long, pivot long, rep long"), "reps")


def _cells(big: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links to the pivots of each region, members of its cells, and members of the regions that cells don't split."""
    r = 1 - percent / 100 + 1e-9
    # Sets without a ball first; a region of several balls and nothing else has pivots as well.
    first = F.min(F.struct(F.col("ball").isNotNull().alias("held"), "cid"))["cid"]
    chosen = big.groupBy("region", F.pmod(F.xxhash64("cid"), F.lit(PIVOTS)).alias("slot")).agg(first.alias("cid"))
    chosen = written(chosen.select("region", "cid"), "chosen")
    pivots = big.join(chosen, ["region", "cid"]).join(sets, KEY).dropDuplicates(["region", "cid"])
    pivots = written(pivots.groupBy("region").agg(F.collect_list(F.struct("cid", "n", "set")).alias("pivots")), "pivots")  # at most PIVOTS each
    inter = lambda p: F.size(F.array_intersect(F.col("set"), p["set"]))
    near = F.transform("pivots", lambda p: F.struct(p["cid"].alias("pivot"), p["n"].alias("pn"), inter(p).alias("i")))
    near = F.transform(
        near,
        lambda x: F.struct((1 - x["i"] / (F.col("n") + x["pn"] - x["i"])).alias("d"), x["pivot"].alias("pivot"), (100 * x["i"] >= percent * (F.col("n") + x["pn"] - x["i"])).alias("linked")),
    )
    at = big.join(sets, KEY).join(pivots, "region").withColumn("near", near).select(*MEMBER, "k", "blocks", "near")
    at = written(at.withColumn("home", F.array_min(F.transform("near", lambda x: x["d"]))), "near")
    links = at.select("cid", F.explode(F.filter("near", lambda x: x["linked"])).alias("x")).select(F.col("cid").alias("a"), F.col("x.pivot").alias("b")).where("a != b")
    # From here a set that is linked to a pivot is in the ball of that pivot and all that are connected to it.
    reps = _joined_pivots(at)
    held = F.array_min(F.transform(F.filter("near", lambda x: x["linked"]), lambda x: x["pivot"]))
    at = at.withColumn("pivot", held).join(reps, ["region", "pivot"], "left")
    at = at.withColumn("ball", F.coalesce("rep", "ball")).drop("pivot", "rep").where("home > 0")  # a pivot has been compared with all
    # Cells of near sets. Those in the pivot's ball stay only where a set beyond it can reach them.
    cell = at.where(F.col("home") <= FAR).withColumn("x", F.explode(F.filter("near", lambda x: x["d"] <= F.col("home") + 2 * r)))
    named = reps.select(F.col("region").alias("in_region"), F.col("pivot").alias("of"), F.col("rep").alias("of_rep"))
    cell = cell.join(named, (F.col("region") == F.col("in_region")) & (F.col("x.pivot") == F.col("of")), "left")
    cell = cell.withColumns({"parent": F.col("region"), "core": F.coalesce(F.col("ball") == F.col("of_rep"), F.lit(False)), "d": F.col("x.d")})
    cell = cell.withColumn("region", F.xxhash64("parent", "x.pivot")).drop("near", "x", "in_region", "of", "of_rep")
    reach = written(cell.where("not core").groupBy("region").agg(F.min("d").alias("reach")), "reach")
    cell = cell.join(reach, "region").where(~F.col("core") | (F.col("d") + r >= F.col("reach")))
    rest = at.where(F.col("home") > FAR - r).withColumns({"parent": F.col("region"), "region": F.xxhash64("region", F.lit(0))})
    cells = written(cell.select(*MEMBER, "parent", "k").unionByName(rest.select(*MEMBER, "parent", "k")), "cells")
    stuck = cells.groupBy("parent", "region").agg(F.count("*").alias("m"), F.first("k").alias("k")).where(2 * F.col("m") > F.col("k")).select(F.col("parent").alias("region")).distinct()
    stuck = written(stuck, "stuck")
    return links, cells.join(stuck.withColumnRenamed("region", "parent"), "parent", "left_anti").select(MEMBER), at.join(stuck, "region", "left_semi").select(MEMBER)


def links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what is linked within the regions. members: region, cid, n and KEY; sets: KEY, set."""
    found: list[DataFrame] = []
    now = _with_size(members.withColumn("ball", F.lit(None).cast("long")))
    small, large = F.col("blocks") <= 2, F.col("blocks") > 2
    leaves = [now.where(small)]
    for _ in range(LEVELS):
        big = now.where(large)
        if big.isEmpty():
            break
        if not found:
            sets = written(sets, "whole")  # read at each level
        own, cells, stuck = _cells(big, sets, percent)
        found.append(own)
        now = _with_size(cells)
        leaves += [_in_blocks(stuck), now.where(small)]
    else:
        leaves.append(_in_blocks(now.where(large).select(MEMBER)))
    found.append(_leaf_links(union_all([x.select(MEMBER) for x in leaves]), sets, percent))
    return written(union_all(found), "links")


def join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """A row for each document (doc_id, text): doc_id, n_shingles, component_id, and class_id: the smallest
    doc_id with the same set."""
    sets, classes = _classes(docs, n, percent)
    alone = F.col("n_shingles") == 0
    out = sets.select("doc_id", "n_shingles", "s1", "s2").join(classes, ["s1", "s2"], "left")
    return out.select("doc_id", "n_shingles", *(F.when(alone, F.col("doc_id")).otherwise(F.col(c)).alias(c) for c in ("component_id", "class_id")))


def _classes(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """What document_sets() gives, and the classes: s1, s2, class_id, component (a number), component_id."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    arrow_rows(spark)
    counts = sc.broadcast(shingle_counts(docs, n))  # 16 MB
    sets = written(document_sets(docs, n, percent, counts), "sets")
    counts.unpersist()
    sig = ["s1", "s2"]
    some = sets.where("n_shingles > 0")
    classes = some.groupBy(*sig).agg(F.min("doc_id").alias("class_id"), F.min("n_shingles").alias("n"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    bits = bits_for(some.agg(F.sum(F.size("first"))).first()[0] or 0)
    meet = sc.broadcast(_may_meet(some.select("first"), bits))
    may = _kept_first(some, meet, bits).join(classes.drop("n"), sig).where(F.col("doc_id").eqNullSafe(F.col("class_id")))
    may = may.select("cid", "n", "cold", F.explode(F.arrays_zip("kept", "at")).alias("x")).select(F.col("x.kept").alias("shingle"), F.col("x.at").alias("place"), "cid", "n", "cold")
    ringed = written(_windows(may, percent), "ringed")
    meet.unpersist()
    members = candidates(ringed, classes.select("cid", "n"))
    members = members.join(classes, "cid")
    members = written(members.select("region", "cid", "n", *sig, F.coalesce("class_id", F.lit(-1)).alias("own")), "members")

    needed = members.select("own", *sig).distinct()
    bits = bits_for(classes.count())
    wanted = sc.broadcast(_needed_bits(needed, bits))
    # Repeated rows of a document give its set once.
    whole = _sets_of(docs, n, wanted, bits).select(*sig, F.coalesce("doc_id", F.lit(-1)).alias("own"), "set").dropDuplicates(KEY)
    found = links(members, whole, percent)

    labels = components(found)
    named = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    named = written(named, "named")
    first = written(named.groupBy("component").agg(F.min("class_id").alias("component_id")), "first")
    return sets, written(named.join(first, "component").select(*sig, "class_id", "component", "component_id"), "components")


def _kept_first(sets: DataFrame, meet, bits: int) -> DataFrame:
    """The first shingles of each document that may occur in another one, with their place in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(5).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            size = np.diff(b.column(5).offsets.to_numpy()).astype(np.int64)
            ends = np.cumsum(size)
            at = np.arange(len(flat)) - np.repeat(ends - size, size)
            on = _has(meet.value, place(flat.view(np.uint64), bits))
            offsets = np.concatenate(([0], np.concatenate(([0], np.cumsum(on)))[ends])).astype(np.int32)
            kept = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (flat[on], at[on].astype(np.int32))]
            yield pa.record_batch([*(b.column(i) for i in range(5)), *kept], ["doc_id", "n", "s1", "s2", "cold", "kept", "at"])

    return sets.select("doc_id", "n_shingles", "s1", "s2", "cold", "first").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, cold long, kept array<long>, at array<int>")


def candidates(ringed: DataFrame, classes: DataFrame) -> DataFrame:
    """Regions (region, cid) of candidates from lists of shingles: connected parts of all candidates where these fit a
    leaf, so each set goes to one region; else long lists, and stars of pairs."""
    large = ringed.where(F.col("k") > SMALL_REGION)
    # Lists with the same members are one.
    lists = written(large.groupBy("k", "h1", "h2").agg(F.min("region").alias("region"), F.min("cid").alias("first")).select("region", "first"), "lists")
    long = written(large.join(lists, "region").select("region", "cid", "first"), "long")
    pairs = _pairs(ringed.where(F.col("k") <= SMALL_REGION))
    parts = components(pairs.unionByName(long.select(F.col("first").alias("a"), F.col("cid").alias("b")).where("a != b")))
    sizes = parts.join(classes, parts["node"] == classes["cid"]).groupBy("component").agg(F.count("*").alias("k"), F.sum("n").alias("weight"))
    over = written(sizes.where((F.col("k") > LEAF) | (F.col("weight") > LEAF_SHINGLES)).select("component"), "over")
    whole = parts.join(over, "component", "left_anti").select(F.xxhash64("component", F.lit("part")).alias("region"), F.col("node").alias("cid"))
    if over.isEmpty():
        return whole
    split = written(parts.join(over, "component").select("node"), "split")
    long = long.join(split, long["cid"] == split["node"]).select("region", "cid")
    return whole.unionByName(long).unionByName(_stars(pairs.join(split, pairs["a"] == split["node"]).select("a", "b")))


def _pairs(small: DataFrame) -> DataFrame:
    """Pairs of classes (a < b) in short lists (region, spare, cid) that share enough first shingles: a linked pair
    shares spare + 1 at least. Where it meets in a long list as well, that counts instead."""
    own = small.groupBy("region").agg(F.sort_array(F.collect_set("cid")).alias("cids"), F.first("spare").alias("spare"))  # SMALL_REGION at most
    later = F.transform("cids", lambda a: F.transform(F.filter("cids", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    pairs = own.select(F.explode(F.flatten(later)).alias("x"), "spare").groupBy("x.a", "x.b").agg(F.count("*").alias("shared"), F.max("spare").alias("spare"))
    return written(pairs.where("shared > spare").select("a", "b"), "pairs")


def _stars(pairs: DataFrame) -> DataFrame:
    """Pairs as stars (region, cid): each class with the later ones of its pairs. A pair that both lie in the star of
    a third class is left to that star."""
    least = pairs.groupBy(F.col("b").alias("cid")).agg(F.min("a").alias("least"))
    least = written(least, "least")
    first = lambda c: least.select(F.col("cid").alias(c), F.col("least").alias(f"least_{c}"))
    seen = pairs.join(first("a"), "a", "left").join(first("b"), "b")
    seen = seen.where(F.col("least_a").isNull() | (F.col("least_a") != F.col("least_b")))
    arms = written(seen.select("a", "b"), "arms")
    star = lambda c: F.xxhash64(c, F.lit("star"))
    return arms.select(star("a").alias("region"), F.col("b").alias("cid")).unionByName(arms.select(star("a").alias("region"), F.col("a").alias("cid")).distinct())


def _ringed(again: DataFrame, percent: int) -> DataFrame:
    """First shingles of several documents, once for each pair of rings in whose window they are."""
    t = percent / 100
    step = -np.log(t) / RINGS * (1 + 1e-9)
    n = F.col("n")
    out = again.withColumn("ring", F.floor(F.log(n) / step + 1e-9).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.col("ring") - RINGS - 1, F.col("ring") + RINGS + 1))).where("other >= 0")
    least = F.greatest(F.floor(F.exp(F.col("other") * step) - 1e-6), F.ceil(n * t - 1e-9))
    overlap = F.ceil((n + least) * (percent / (100 + percent)) - 1e-6)
    # Both sides take the same spare: by the least size of the smaller ring.
    spare = F.floor(F.floor(F.exp(F.least("ring", "other") * step) - 1e-6) * SPARE - 1e-6).cast("int")
    out = out.withColumn("spare", F.greatest(F.lit(0), spare)).where(F.col("place") < n - overlap + 1 + F.col("spare"))
    return out.withColumns({"low": F.least("ring", "other"), "high": F.greatest("ring", "other")}).select("shingle", "low", "high", "ring", "spare", "cid")


def _windows(may: DataFrame, percent: int) -> DataFrame:
    """First shingles (shingle, place, cid, n, cold) by region: a shingle and the rings of two sizes. A set is in the
    region of its own ring and another if, with the least size of that ring, its window reaches the shingle's place.
    Only regions of several sets, and of both rings, stay. Shingles that few documents have are dealt once and all
    that follows is within their partitions; those of many are counted by aggregates and joined."""
    about = {"k": F.count("*"), "r0": F.min("ring"), "r1": F.max("ring"), "h1": F.sum(F.shiftright(F.xxhash64("cid"), 16)), "h2": F.bit_xor(F.xxhash64("cid", F.lit(1)))}
    key = ["shingle", "low", "high"]
    own = Window.partitionBy(*key)
    few = may.where("place < cold").repartition("shingle").withColumn("again", F.count("*").over(Window.partitionBy("shingle"))).where("again > 1")
    few = _ringed(few, percent).withColumns({k: c.over(own) for k, c in about.items()}).where("k > 1 and r0 = low and r1 = high")
    many = written(may.where("place >= cold"), "hot")
    often = written(many.groupBy("shingle").count().where("count > 1").select("shingle"), "often")
    many = written(_ringed(many.join(often, "shingle"), percent), "hot_ringed")
    regions = written(many.groupBy(*key).agg(*(c.alias(k) for k, c in about.items())).where("k > 1 and r0 = low and r1 = high"), "hot_regions")
    many = many.join(regions, key)
    region = F.xxhash64(*key).alias("region")
    return few.select(region, "k", "h1", "h2", "spare", "cid").unionByName(many.select(region, "k", "h1", "h2", "spare", "cid"))


def deduplicate(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: that with the smallest doc_id, null being the largest, and of several
    texts under one doc_id that with the least hash. Rows without words are linked with nothing and all stay. Equal
    rows are one document: of rows with the kept doc_id and text, one stays."""
    sets, classes = _classes(docs, n, percent)
    some = sets.where("n_shingles > 0").join(classes.select("s1", "s2", "component"), ["s1", "s2"])
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *ROW)
    kept = some.groupBy("component").agg(F.min(order).alias("x"), F.count("*").alias("rows")).select(*(F.col(f"x.{c}").alias(c) for c in ROW), "rows")
    kept = written(kept, "kept")
    gone = written(some.select(*ROW).distinct().join(kept, [*ROW], "left_anti"), "gone")
    again = written(some.join(kept.where("rows > 1").select(*ROW), [*ROW]).groupBy(*ROW).count().where("count > 1").select(*ROW), "again")
    # Whole texts are shuffled only where a table of bits lets their row be one of these.
    special = gone.unionByName(again)
    bits = bits_for(special.count())
    hit = _may_be(docs.sparkSession.sparkContext.broadcast(_needed_bits(special.select(*ROW, F.lit(0).cast("long")), bits)), bits)
    rows = docs.select(packed(docs), *row_key(ROW)).withColumn("hit", hit(*ROW))
    asked = rows.where("hit").join(gone, [*ROW], "left_anti")
    out = rows.where("not hit")
    if again.isEmpty():
        return unpacked(out.unionByName(asked), docs.columns)
    one = asked.join(again, [*ROW], "left_semi").dropDuplicates([*ROW])
    return unpacked(union_all([out, asked.join(again, [*ROW], "left_anti"), one]), docs.columns)
