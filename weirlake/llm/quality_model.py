"""Quality classifier from a weak-label model.

Labellers are heuristics that vote good, bad or nothing on a text; they overlap and none is right always.
Expectation-maximisation over the counts of all vote patterns estimates each labeller's accuracy and the
share of good texts, and gives each pattern a posterior. These posteriors, not any given labels, train a
linear scorer on hashed features: shapes of words and of pairs of words, and bins of the statistics.

Vote counts cover all documents; there are at most 3 ** 9 patterns. The scorer is fitted on a bounded
sample: the TRAIN_ROWS documents (all, if there are fewer) with the least hashes of doc_id and text. A document
is kept unless its score is below KEEP. Null and empty texts have no words: they are voted bad by length and
scored by it. Null and repeated doc_ids don't matter. Repeated rows count as often as they occur in the counts
and once in the sample, and all get the same verdict. Texts are read whole. keep() hands on further columns,
whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlake.llm import words as W
from weirlake.llm.common import arrow_rows, batched, only, row_key, rows_of, utf8, written
from weirlake.llm.quality_rules import statistics

TRAIN_ROWS = 8_000
ROW = ("_t1", "_t2")
BITS = 14
KEEP = 0.35
ROUNDS = 60

#: Frequent function words of languages that common crawls hold most of. Fixed values.
FUNCTION_WORDS = "the of and to in is was for that on with as at by are from this la le les des et en un une du de que el los las una por para con der die das und ist ein eine nicht mit von den zu".split()

_byte = np.arange(256)
#: Classes of bytes: space, lower case and letters beyond ASCII, capitals, digits, and marks each by itself.
SHAPE = np.where(W.SPACE, 32, np.where((_byte >= 65) & (_byte <= 90), 65, np.where((_byte >= 48) & (_byte <= 57), 48, np.where((_byte >= 128) | (_byte >= 97) & (_byte <= 122), 97, _byte)))).astype(np.uint8)


def _word_hash(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), np.uint8)
    return W.hashes(data, np.array([0]), np.array([len(data)]))[0]


FUNCTION_HASHES = np.sort(np.array([_word_hash(w) for w in sorted(set(FUNCTION_WORDS))], np.uint64))


def measures(text: bytes) -> dict[str, float]:
    """What labellers look at."""
    n, word_chars, symbols, dups, repeated, vector = statistics(text)
    data, starts, ends = W.text_words(text.translate(W.LOWER))
    hashed = W.hashes(data, starts, ends)
    at = np.searchsorted(FUNCTION_HASHES, hashed)
    at[at == len(FUNCTION_HASHES)] = 0
    lines = max(1, text.count(b"\n") + 1)
    per_char = 1 / max(1, word_chars)
    return {
        "words": n, "word_length": word_chars / max(1, n), "symbols": symbols * per_char, "dup_lines": dups / lines, "lines": lines, "repeats": repeated / max(1, n),
        "capitals": vector[4] ** 2, "marks": vector[5] ** 2, "distinct": vector[6], "function": float((FUNCTION_HASHES[at] == hashed).mean()) if n else 0.0,
    }


def vote(good: bool, bad: bool) -> str:
    return "-" if bad else "+" if good else "0"


LABELLERS = {
    "length": lambda m: vote(m["words"] >= 40, m["words"] < 8),
    "word_length": lambda m: vote(3.5 <= m["word_length"] <= 9, m["word_length"] < 2.5 or m["word_length"] > 14),
    "symbols": lambda m: vote(m["symbols"] < 0.01, m["symbols"] > 0.06),
    "dup_lines": lambda m: vote(m["lines"] >= 4 and m["dup_lines"] < 0.1, m["dup_lines"] > 0.5 and m["lines"] >= 4),
    "repeats": lambda m: vote(m["words"] >= 40 and m["repeats"] < 0.1, m["repeats"] > 0.6),
    "capitals": lambda m: vote(0.002 < m["capitals"] < 0.1, m["capitals"] > 0.4),
    "marks": lambda m: vote(0.005 < m["marks"] < 0.08, m["marks"] > 0.15 or m["words"] >= 60 and m["marks"] < 0.001),
    "distinct": lambda m: vote(m["words"] >= 40 and m["distinct"] > 0.9, m["words"] >= 40 and m["distinct"] < 0.75),
    "function": lambda m: vote(m["function"] > 0.08, m["words"] >= 60 and m["function"] < 0.01),
}


def votes(m: dict[str, float]) -> str:
    return "".join(f(m) for f in LABELLERS.values())


class LabelModel:
    """The share of good texts and, for each labeller that votes, how often it votes good on good and on bad
    texts. Not to vote says nothing: a short text is not worse for what can't be judged."""

    def __init__(self, counts: dict[str, int]):
        patterns = sorted(counts)
        n = np.array([counts[p] for p in patterns], float)
        v = self._table(patterns)
        q = np.where((v == 0).any(1), 0.1, 0.9)  # to begin with, any bad vote makes a text bad
        self.share, self.good = 0.5, np.full((len(LABELLERS), 2), 0.5)
        for _ in range(ROUNDS):
            for c, w in enumerate((n * (1 - q), n * q)):
                for j in range(len(LABELLERS)):
                    own = np.bincount(v[:, j], w, 3) if len(v) else np.zeros(3)
                    prior = (1.0, 1.0) if c == 0 else (0.2, 1.8)  # good texts get few bad votes
                    self.good[j, c] = (own[2] + prior[1]) / (own[0] + own[2] + sum(prior))
            self.share = float(((n * q).sum() + 1) / (n.sum() + 2))
            q = self._posterior(v)
        self.by = dict(zip(patterns, q.tolist(), strict=True))

    @staticmethod
    def _table(patterns: list[str]) -> np.ndarray:
        return np.array([["-0+".index(c) for c in p] for p in patterns], np.int64).reshape(len(patterns), len(LABELLERS))

    def _posterior(self, v: np.ndarray) -> np.ndarray:
        says = np.log(np.stack([1 - self.good, np.ones_like(self.good), self.good], 1))  # labeller, vote, class
        odds = np.log(self.share / (1 - self.share)) + sum((says[j, v[:, j], 1] - says[j, v[:, j], 0] for j in range(len(LABELLERS))), np.zeros(len(v)))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))

    def posterior(self, pattern: str) -> float:
        if pattern not in self.by:
            self.by[pattern] = float(self._posterior(self._table([pattern]))[0])
        return self.by[pattern]


def hashed_features(text: bytes, m: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Places and values: shares of word shapes and pairs of shapes, and bins of the measures."""
    shape = SHAPE[np.frombuffer(text, np.uint8)]
    if len(shape):
        keep = np.ones(len(shape), bool)
        keep[1:] = (shape[1:] != shape[:-1]) | (shape[1:] == 32)
        shape = shape[keep]
    one = W.hashes(shape, *W.spans(shape))
    marks = [np.uint64(1) + np.uint64(k) * np.uint64(64) + np.uint64(min(40, max(0, int(4 * np.log2(1e-3 + x) + 40)))) for k, x in enumerate(m.values())]
    every = np.concatenate([one, W.windows(one, 2), W.mix(np.array(marks, np.uint64) * W.STEP)])
    weight = np.concatenate([np.full(len(one), 1 / max(1, len(one))), np.full(max(0, len(one) - 1), 1 / max(1, len(one) - 1)), np.full(len(marks), 0.25)])
    at, inverse = np.unique((every >> np.uint64(64 - BITS)).astype(np.int64), return_inverse=True)
    return at, np.sqrt(np.bincount(inverse, weight, len(at)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic scorer for soft labels; both classes weigh the same in all."""
    weights, bias = np.zeros(1 << BITS), 0.0
    if not rows:
        return weights, bias
    size = np.array([len(r[0]) for r in rows])
    at, value, owner = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.repeat(np.arange(len(rows)), size)
    y = np.array([r[2] for r in rows])
    own = np.where(y >= 0.5, 0.5 / max(1e-9, (y >= 0.5).mean()), 0.5 / max(1e-9, (y < 0.5).mean()))
    own /= own.sum()
    square, step = np.full(1 << BITS, 1e-8), 0.5
    for _ in range(300):
        p = 1 / (1 + np.exp(-(np.bincount(owner, value * weights[at], len(rows)) + bias)))
        g = own * (p - y)
        grad = np.bincount(at, value * g[owner], 1 << BITS) + 1e-6 * weights
        square += grad**2
        weights -= step * grad / np.sqrt(square)
        bias -= 0.5 * float(g.sum())
    return weights, bias


def train(docs: DataFrame) -> tuple[LabelModel, np.ndarray, float]:
    """The label model over all documents, and the scorer's weights and bias."""
    spark = docs.sparkSession
    arrow_rows(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, int] = {}
        for (text,) in rows_of(batches, "text"):
            p = votes(measures(utf8(text)))
            own[p] = own.get(p, 0) + 1
        yield from batched(iter(own.items()), pa.schema([("pattern", pa.string()), ("n", pa.int64())]))

    got = only(docs, "text").mapInArrow(count, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # at most 3 ** 9
    counts = {r["pattern"]: r["n"] for r in got}
    model = LabelModel(counts)
    held = spark.sparkContext.broadcast(model)
    schema = pa.schema([("at", pa.list_(pa.int64())), ("value", pa.list_(pa.float64())), ("y", pa.float64())])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (text,) in rows_of(batches, "text"):
                m = measures(utf8(text))
                yield (*hashed_features(utf8(text), m), held.value.posterior(votes(m)))

        yield from batched(rows(), schema, 200)

    # The order is by hash alone, so the sample is the same at any number of rows and partitions. Only hashes are
    # ordered; the sampled texts stay in the tasks that read them.
    own = only(docs, "doc_id", "text").select("text", *row_key(ROW))
    sample = written(own.select(*ROW).distinct().orderBy(*ROW).limit(TRAIN_ROWS), "sample")
    last = sample.agg(F.max(F.struct(*ROW)).alias("x")).select("x.*").first()  # one row
    if last[0] is None:
        return model, *fit([])
    within = (F.col(ROW[0]) < last[0]) | (F.col(ROW[0]) == last[0]) & (F.col(ROW[1]) <= last[1])
    # Copies of a row give one, combined before the shuffle.
    rows = own.where(within).groupBy(*ROW).agg(F.first("text").alias("text")).select("text").mapInArrow(describe, "at array<long>, value array<double>, y double")
    got = sorted(rows.collect(), key=lambda r: (r[2], r[0], r[1]))  # TRAIN_ROWS at most
    return model, *fit([(np.array(r[0], np.int64), np.array(r[1]), r[2]) for r in got])


SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("posterior", pa.float64()), ("votes", pa.string()), ("kept", pa.bool_())])


def classify(docs: DataFrame) -> DataFrame:
    """A row for each document (doc_id, text): score, the label model's posterior, votes, and kept."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(train(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, weights, bias = held.value

        def rows() -> Iterator[tuple]:
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                yield (doc_id, *judge(utf8(text), model, weights, bias))

        yield from batched(rows(), SCHEMA)

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double, posterior double, votes string, kept boolean")


def judge(text: bytes, model: LabelModel, weights: np.ndarray, bias: float) -> tuple[float, float, str, bool]:
    m = measures(text)
    at, value = hashed_features(text, m)
    p = votes(m)
    score = float(1 / (1 + np.exp(-np.clip(weights[at] @ value + bias, -30, 30))))
    return score, model.posterior(p), p, score >= KEEP


def keep(docs: DataFrame) -> DataFrame:
    """The documents that are kept, as they are, in one pass that ships no text back and forth twice."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(train(docs))
    # Columns go by place, whatever their names; the text is a column of its own.
    at = docs.columns.index("text")
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([judge(utf8(t), *held.value)[3] for t in b.column(at).to_pylist()], pa.bool_()))

    arrow_rows(spark)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
