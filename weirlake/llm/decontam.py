"""Benchmark decontamination by pigeonhole edit matching.

Texts are normalised: lower case, ASCII punctuation and white space as single spaces. A test item of m
characters may differ from a passage by k = m * rate edits. Of its k + 1 pieces at least one then stands
in the passage as it is, so an Aho-Corasick automaton finds the exact hits of all pieces, and Myers'
bit-parallel algorithm verifies the passage about each hit. With rate 0.05, items of fewer than 20 characters
have no edits to spare.

The test set is taken in blocks of bounded size. A block is broadcast, is one pass over all documents, which are
not shuffled, and is let go once the pass is written, so neither driver nor executors hold more than one. Null
or empty items match nothing; items without an edit to spare must stand as they are between spaces. Null and
empty texts match nothing. Very long texts are searched whole. Items with equal texts and repeated rows are all
reported. Further columns, whatever their names, are not read. An empty table on either side gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from weirlake.llm.common import arrow_rows, batched, only, packed, row_key, rows_of, union_all, unpacked, written

RATE = 0.05
BLOCK_CHARS = 4_000_000
PUNCTUATION = str.maketrans({c: " " for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"})


def normalise(text: str | None) -> str:
    """Lower case, with a space for each run of ASCII punctuation and white space; spaces at the ends."""
    return f" {' '.join(text.lower().translate(PUNCTUATION).split())} " if text else " "


def budget(m: int, rate: float = RATE) -> int:
    """Edits that an item of m characters may have."""
    return int(m * rate + 1e-9)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of about one size, each with its place."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks(pattern: str) -> dict[str, int]:
    """For each character the bits of its places."""
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | (1 << i)
    return out


def best_match(bits: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """The least edit distance between a pattern of m characters and any passage of text, and where the
    first such passage ends. A column of the edit matrix is held as the bits of its steps up and down."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = bits.get(c, 0)
        x = eq | down
        d0 = ((((x & up) + up) ^ up) | x) & full
        hp, hn = (down | ~(d0 | up)) & full, up & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
            if score < best:
                best, end = score, j + 1
        hp, hn = (hp << 1) & full, (hn << 1) & full  # any passage may begin here, so nothing comes in below
        up, down = (hn | ~(d0 | hp)) & full, hp & d0
    return best, end


class Matcher:
    """The automaton of a block of items (item_id, text)."""

    def __init__(self, items: list[tuple[int | None, str | None]], rate: float = RATE):
        import ahocorasick

        self.items: list[tuple[int | None, str, int]] = []
        self.bits: dict[int, dict[str, int]] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            item = normalise(text)
            if item == " ":
                continue
            k = budget(len(item) - 2, rate)
            item = item.strip() if k else item
            for at, piece in pieces(item, k):
                found.setdefault(piece, []).append((len(self.items), at))
            self.items.append((item_id, item, k))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> Iterator[tuple[int | None, int, int]]:
        """item_id, distance, and the end in the normalised text of each item's best passage."""
        if not self.items or not text:
            return
        text = normalise(text)
        windows: dict[int, list[list[int]]] = {}
        for last, (n, places) in self.automaton.iter(text):
            for i, at in places:
                _, item, k = self.items[i]
                start = last + 1 - n - at
                lo, hi = max(0, start - k), start + len(item) + k
                own = windows.setdefault(i, [])
                if own and lo <= own[-1][1] and lo >= own[-1][0]:
                    own[-1][1] = max(own[-1][1], hi)
                else:
                    own.append([lo, hi])
        for i, own in windows.items():
            item_id, item, k = self.items[i]
            best = (k + 1, 0)
            for lo, hi in own:
                if (at := text.find(item, lo, hi)) >= 0:
                    best = (0, at + len(item))
                elif k:
                    if i not in self.bits:
                        self.bits[i] = masks(item)
                    d, end = best_match(self.bits[i], len(item), text[lo:hi])
                    best = min(best, (d, lo + end))
                if not best[0]:
                    break
            if best[0] <= k:
                yield item_id, *best


def blocks(items: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    """The test set in blocks of about BLOCK_CHARS characters, one at a time on the driver."""
    own, size = [], 0
    for r in only(items, "item_id", "text").toLocalIterator():
        own.append((r[0], r[1]))
        size += len(r[1] or "")
        if size >= BLOCK_CHARS:
            yield own
            own, size = [], 0
    if own:
        yield own


ROW = ("_t1", "_t2")
SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int64()), ("item_end", pa.int64())])
DDL = "doc_id long, item_id long, distance long, item_end long"


@lru_cache(1)
def _matcher(held, rate: float) -> Matcher:
    """One for each worker process and block, kept from task to task. held: a broadcast variable."""
    return Matcher(held.value, rate)


def _passes(docs: DataFrame, items: DataFrame, rate: float, key: list[str]) -> Iterator[DataFrame]:
    """key of docs (longs) and SCHEMA's other columns for each block of items in turn, as written tables."""
    spark = docs.sparkSession
    arrow_rows(spark)
    schema = pa.schema([*((c, pa.int64()) for c in key), *list(SCHEMA)[1:]])
    for block in blocks(items):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(held, rate)
            yield from batched(((*own, *m) for *own, text in rows_of(batches, *key, "text") for m in matcher.matches(text)), schema)

        yield written(docs.select(*key, "text").mapInArrow(run, ", ".join(f"{c.name} long" for c in schema)), "passages")
        held.destroy()


def find(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """A row for each document (doc_id, text) and item (item_id, text) that stands in it within the item's
    budget of edits: distance, and where the passage ends in the normalised text."""
    found = list(_passes(only(docs, "doc_id", "text"), items, rate, ["doc_id"]))
    return union_all(found) if found else docs.sparkSession.createDataFrame([], DDL)


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """docs without the rows that an item stands in, whatever their doc_id, nulls included. All columns stay."""
    keyed = docs.select(packed(docs), *row_key(ROW), "text")
    found = [f.select(*ROW) for f in _passes(keyed, items, rate, [*ROW])]
    if not found:
        return docs
    return unpacked(keyed.drop("text").join(written(union_all(found).distinct(), "found"), [*ROW], "left_anti"), docs.columns)
