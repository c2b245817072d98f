"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

The features are densities of a lexicon, how near its words stand to the second person, capitals,
punctuation and obfuscation. The lexicon is learned from labelled texts: words and word beginnings that
are far more frequent in toxic ones. All learning uses a bounded sample of at most TRAIN_ROWS labelled
rows, taken by a hash of doc_id, and never rows that are held out (crc32 of doc_id mod 5 is 0). Features
of a training row come from the lexicon of the other folds, and the calibration from trees that have not
seen the row. Scores depend on the text alone.

Null text is empty; it has a score like any other. A null doc_id is not held out. Labels that are null or
neither 0 nor 1 are not used; of several labels of a document the highest counts. Without labels of both
kinds every score is the smoothed share of toxic labels (a half with none). Repeated rows give repeated
results; of several texts under one labelled doc_id that with the least hash is learned from. Further columns,
whatever their names, are not read. Texts are read whole. An empty table gives an empty one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlake.llm.common import arrow_rows, batched, only, rows_of, written

TRAIN_ROWS = 20_000
FOLDS = 4
LEXICON = 4_000
LEAST_DOCS, LEAST_ODDS = 3, 3.0
TREES, DEPTH, RATE, BINS = 60, 3, 0.15, 64
NEAR = 5
BEGINNINGS = (4, 5)

WORDS = re.compile(r"[^\W\d_]+")
#: Second person, in the languages of common crawls. Fixed values.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer sie tu te toi ton ta tes vous votre vos usted ustedes vosotros tú ti contigo os vuestra vuestro".split())
#: Digits and marks that stand for letters. Fixed values.
LETTERS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
OBFUSCATED = re.compile(r"(?<![\w@$*!])(?=[\w@$*!]*[^\W\d_])(?=[\w@$*!]*[\d@$*])[\w@$*!]{3,}")

FEATURES = (
    "log_words lexicon_density lexicon_log lexicon_kinds beginning_density beginning_log weight_top weight_sum near_second near_share second_density capitals caps_words exclamations marks obfuscated obfuscated_hits runs".split()
)


def terms(words: list[str]) -> set[str]:
    """Distinct words and, marked, word beginnings."""
    own = set(words)
    return own | {w[:k] + "*" for w in own for k in BEGINNINGS if len(w) > k}


def near_second(at: np.ndarray, second: np.ndarray) -> int:
    """How many of the places stand within NEAR words of one of the second person's; both are sorted."""
    after = np.searchsorted(second, at)
    gap = np.minimum(np.abs(second[np.minimum(after, len(second) - 1)] - at), np.abs(at - second[np.maximum(after - 1, 0)]))
    return int((gap <= NEAR).sum())


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    words = WORDS.findall(text.lower())
    n = max(1, len(words))
    at = [i for i, w in enumerate(words) if w in lexicon]
    found = [words[i] for i in at]
    begin = [w for w in words if len(w) > BEGINNINGS[0] and any(w[:k] + "*" in lexicon for k in BEGINNINGS)]
    weights = sorted((lexicon[w] for w in set(found)), reverse=True)
    second = [i for i, w in enumerate(words) if w in SECOND]
    near = near_second(np.array(at), np.array(second)) if at and second else 0
    letters = max(1, len(text))
    upper = sum(map(str.isupper, text)) if not text.isascii() else sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    hidden = OBFUSCATED.findall(text) if re.search(r"[\d@$*]", text) else []
    hits = sum(w.lower().translate(LETTERS).replace("*", "") in lexicon for w in hidden)
    caps = len(re.findall(r"\b[A-Z]{3,}\b", text))
    marks = sum(map(text.count, ".,;:!?"))
    return [
        np.log1p(len(words)), len(at) / n, np.log1p(len(at)), np.log1p(len(weights)), len(begin) / n, np.log1p(len(begin)), weights[0] if weights else 0.0, sum(weights),
        np.log1p(near), near / max(1, len(at)), len(second) / n, upper / letters, caps / n, text.count("!") / letters, marks / letters, len(hidden) / n, np.log1p(hits), len(re.findall(r"(\w)\1\1", text)) / n,
    ]


def learn_lexicon(counts: DataFrame, n_toxic: int, n_clean: int, most: int = LEXICON) -> dict[str, float]:
    """Terms (term, a, b: the toxic and clean texts that have it) with the log of how much more frequent they are in
    toxic texts: of those with LEAST_DOCS and LEAST_ODDS, the `most` with the highest."""
    odds = F.log((F.col("a") + 0.1) / (n_toxic + 1)) - F.log((F.col("b") + 0.1) / (n_clean + 1))
    found = counts.where(F.col("a") >= LEAST_DOCS).select("term", F.round(odds, 9).alias("odds")).where(F.col("odds") >= LEAST_ODDS)
    return {r.term: r.odds for r in found.orderBy(F.desc("odds"), "term").limit(most).collect()}


class Trees:
    """Boosted regression trees for the logistic loss, over quantile bins of the features."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = self._bin(x)
        p = (y.sum() + 0.5) / (len(y) + 1)
        self.start = float(np.log(p / (1 - p)))
        self.trees: list[tuple] = []
        score = np.full(len(y), self.start)
        for _ in range(TREES):
            prob = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, y - prob, prob * (1 - prob), np.arange(len(y)), DEPTH)
            self.trees.append(tree)
            score += self._apply(tree, binned)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], 1).astype(np.int64) if len(x) else np.zeros((0, len(self.cuts)), np.int64)

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> tuple:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        leaf = (RATE * total_g / (total_h + 1.0),)
        if depth == 0 or len(rows) < 10:
            return leaf
        best = (1e-6, 0, 0)
        for j in range(binned.shape[1]):
            k = len(self.cuts[j]) + 1
            if k < 2:
                continue
            gs = np.cumsum(np.bincount(binned[rows, j], g[rows], k))[:-1]
            hs = np.cumsum(np.bincount(binned[rows, j], h[rows], k))[:-1]
            gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
            gain[(hs < 0.5) | (total_h - hs < 0.5)] = 0
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), j, i)
        if best[0] <= 1e-6:
            return leaf
        left = binned[rows, best[1]] <= best[2]
        return best[1], best[2], self._grow(binned, g, h, rows[left], depth - 1), self._grow(binned, g, h, rows[~left], depth - 1)

    def _apply(self, tree: tuple, binned: np.ndarray) -> np.ndarray:
        if len(tree) == 1:
            return np.full(len(binned), tree[0])
        left = binned[:, tree[0]] <= tree[1]
        return np.where(left, self._apply(tree[2], binned), self._apply(tree[3], binned))

    def score(self, x: np.ndarray) -> np.ndarray:
        binned = self._bin(x)
        return self.start + sum((self._apply(t, binned) for t in self.trees), np.zeros(len(x)))


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores and the rising probabilities at them (pooling neighbours that fall)."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first score, last score
    for s, v in zip(score[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(s), float(s)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a[0], blocks[-1][1] + a[1], blocks[-1][2], a[3]]
    x = np.array([v for b in blocks for v in (b[2], b[3])])
    p = np.repeat([(b[0] + 0.05) / (b[1] + 0.1) for b in blocks], 2)
    return x, np.maximum.accumulate(p)


class Model:
    """Lexicon, trees and calibration."""

    def __init__(self, lexicon: dict[str, float], trees: Trees | None, steps: tuple[np.ndarray, np.ndarray] | None, prior: float):
        self.lexicon, self.trees, self.steps, self.prior = lexicon, trees, steps, prior

    def scores(self, texts: list[str]) -> list[float]:
        if self.trees is None or not texts:
            return [self.prior] * len(texts)
        raw = self.trees.score(np.array([features(t, self.lexicon) for t in texts], float))
        # Calibrated, with a little of the raw score so that ties keep its order.
        flat = 0.98 * np.interp(raw, *self.steps) + 0.02 / (1 + np.exp(-raw))
        return np.clip(flat, 0.0, 1.0).tolist()


def fold_of(doc_id: int) -> int:
    return zlib.crc32(f"fold {doc_id}".encode()) % FOLDS


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text and toxic of at most TRAIN_ROWS labelled rows that are not held out."""
    known = only(labels, "doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS), "sample")
    rows = only(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id")  # TRAIN_ROWS rows of two numbers
    # Of several rows with one doc_id that whose text has the least hash: a partial aggregate.
    text = F.coalesce("text", F.lit(""))
    return written(rows.groupBy("doc_id").agg(F.min_by(text, F.xxhash64(text)).alias("text"), F.first("toxic").alias("toxic")), "train")


def _lexicons(train: DataFrame) -> list[dict[str, float]]:
    """The lexicon of all folds but k, for each k, and last that of all."""
    schema = pa.schema([("term", pa.string()), ("fold", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for doc_id, text, toxic in rows_of(batches, "doc_id", "text", "toxic"):
            k = fold_of(doc_id)
            counts.update((t, k, toxic) for t in terms(WORDS.findall((text or "").lower())))
            counts["", k, toxic] += 1
        yield from batched(((t, k, n * y, n * (1 - y)) for (t, k, y), n in counts.items()), schema, 10_000)

    counts = train.mapInArrow(run, "term string, fold long, a long, b long").groupBy("term", "fold").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    folds = [F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in range(FOLDS) for c in "ab"]
    # What too few toxic texts have can be in no lexicon; the empty term stands for the texts themselves.
    whole = counts.groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), *folds)
    whole = written(whole.where((F.col("a") >= LEAST_DOCS) | (F.col("term") == "")), "terms")
    n = whole.where("term = ''").first()
    n = n.asDict() if n else {}
    own, out = whole.where("term != ''"), []
    for k in range(FOLDS):
        less = own.select("term", *((F.col(c) - F.col(f"{c}{k}")).alias(c) for c in "ab"))
        out.append(learn_lexicon(less, *(n.get(c, 0) - n.get(f"{c}{k}", 0) for c in "ab")))
    return [*out, learn_lexicon(own.select("term", "a", "b"), n.get("a", 0), n.get("b", 0))]


def train(docs: DataFrame, labels: DataFrame) -> Model:
    spark = docs.sparkSession
    arrow_rows(spark)
    rows = training_rows(docs, labels)
    lexicons = spark.sparkContext.broadcast(_lexicons(rows))  # at most FOLDS + 1 times LEXICON words
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.float64()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lexicons.value
        yield from batched(((d, float(y), features(t or "", own[fold_of(d)])) for d, t, y in rows_of(batches, "doc_id", "text", "toxic")), schema)

    got = sorted(rows.mapInArrow(run, "doc_id long, y double, x array<double>").collect(), key=lambda r: (r[0], r[1]))  # TRAIN_ROWS at most
    y = np.array([r[1] for r in got])
    prior = float((y.sum() + 0.5) / (len(y) + 1))
    if len(y) < 20 or len(np.unique(y)) < 2:
        return Model({}, None, None, prior)
    x, fold = np.array([r[2] for r in got]), np.array([fold_of(r[0]) for r in got])
    outside = np.zeros(len(y))
    for k in range(FOLDS):
        if (fold == k).any() and len(np.unique(y[fold != k])) == 2:
            outside[fold == k] = Trees().fit(x[fold != k], y[fold != k]).score(x[fold == k])
    return Model(lexicons.value[-1], Trees().fit(x, y), isotonic(outside, y), prior)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each document (doc_id, text): held_out, score and predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            scores = held.value.scores([t or "" for t in b.column(1).to_pylist()])
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip((ids, map(is_held_out, ids), scores, [int(s >= 0.5) for s in scores]), SCHEMA, strict=True)], schema=SCHEMA)

    arrow_rows(docs.sparkSession)
    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
