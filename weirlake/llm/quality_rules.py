"""Quality rules with robust multivariate outliers.

Simple statistics of each text give the base verdict. Texts that pass it are then compared with others
of their language and source: their statistics, transformed, form vectors, and the minimum covariance
determinant (MCD) estimates of centre and scatter give Mahalanobis distances. Texts beyond the cutoff
are rejected.

The MCD of a group is the estimate from that SHARE of its rows whose scatter has the least determinant.
Starts come from a sample of bounded size of each group: medians, and small random subsets, improved within
the sample. From the best STARTS, concentration steps over all rows go on until no determinant falls any
more, and of the starts that with the least determinant counts. Up to a quarter of a group may so be
outliers, clustered or not. A step needs the sums of each group's half with the least distances; the distance
that bounds this half comes from a histogram of fixed size. Both are aggregates that Spark combines before it
shuffles, so a hot source costs no task more than another. The estimates stay a table with a row for each
group, as do the sums of languages; the driver gets the one row over all.

Estimates are mixed by numbers of rows, without a bound at which they switch: a group of n rows weighs
n / (n + PRIOR_ROWS), the rest is its language's, of that again all rows', and of these a prior that says
that little is known. So a small group is judged as its language is, a large one by itself, and in a table
of a few rows nothing is unusual.

Null text has no words, so its base verdict is failure; null language or source is a group of its own.
Empty texts fail as well; a group with nothing but failures has no distance (null). Ties at the bound are
all in the half. Repeated rows count as often as they occur. Further columns, whatever their names, are not
read. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirlake.llm import words as W
from weirlake.llm.common import arrow_rows, batched, only, rows_of, utf8, written

_byte = np.arange(256)
#: Bytes that are symbols, that begin a code point of a word, capitals, and punctuation marks.
CLASSES = np.stack([np.isin(_byte, list(b"#*$%&|<>")), ((_byte & 0xC0) != 0x80) & ~W.SPACE, (_byte >= 65) & (_byte <= 90), np.isin(_byte, list(b".,;:!?"))]).astype(np.int64)

REPEAT_WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30

#: Parts of the vector, each with the least standard deviation that it is taken to have: most texts
#: have no symbols or repeated lines at all, and a scatter of nothing would reject the first that has one.
#: A notice at a text's start and end repeats lines in all honesty, so repeats have more room: of 1,298 good
#: texts in sf0.1, 999 in 1,000 have at most 0.58 (dup_lines) and 0.46 (repeats), and the floors put these
#: within CUTOFF. What the base rules let pass (repeats up to the root of 0.3) can be beyond it.
FEATURES = {"word_length": 0.05, "symbols": 0.05, "dup_lines": 0.12, "repeats": 0.095, "capitals": 0.05, "marks": 0.05, "distinct": 0.05}
FLOORS = np.array(list(FEATURES.values()))
#: Standard deviations of a table of which nothing is known yet.
UNKNOWN = {"word_length": 0.5, "symbols": 0.3, "dup_lines": 0.4, "repeats": 0.4, "capitals": 0.4, "marks": 0.3, "distinct": 0.3}
PRIOR_ROWS = 50
SAMPLE, SUBSETS, STARTS = 512, 60, 2
STEPS, SETTLED = 6, 0.01
BINS = 2048
SHARE = 0.75
#: The scatter of the nearest 75 % of normal vectors of 7 parts, to that of all, upside down.
CONSISTENCY = 1.33
#: The 0.9999 quantile of chi squared with 7 degrees of freedom. It doesn't depend on the table.
CUTOFF = 29.9


def statistics(text: bytes) -> tuple[int, int, int, int, int, list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the transformed vector."""
    data, starts, ends = W.text_words(text)
    n = len(starts)
    symbols, word_chars, capitals, marks = (int(x) for x in CLASSES @ np.bincount(data, minlength=256))
    seen: set[bytes] = set()
    dups = lines = 0
    for line in text.split(b"\n"):
        if line.strip(b" \t\n\v\f\r"):
            lines += 1
            dups += line in seen
            seen.add(line)
    hashed = W.hashes(data, starts, ends)
    repeated = 0
    if n > REPEAT_WINDOW:
        found = W.windows(hashed, REPEAT_WINDOW)
        ordered = np.sort(found)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            again = np.flatnonzero(np.isin(found, twice))
            cover = np.bincount(again, minlength=n + 1) - np.bincount(again + REPEAT_WINDOW, minlength=n + 1)[: n + 1]
            repeated = int((np.cumsum(cover)[:n] > 0).sum())
    if not n:
        return 0, word_chars, symbols, dups, 0, [0.0] * len(FEATURES)
    per_word, per_char = 1 / n, 1 / max(1, word_chars)
    # The share of distinct words falls with length; over its usual fall it is a number around nothing.
    distinct = np.log(len(np.unique(hashed))) / np.log(max(2, n)) if n > 1 else 1.0
    vector = [
        float(np.log(word_chars * per_word)),
        float(np.sqrt(symbols * per_char)),
        float(np.sqrt(dups / max(1, lines))),
        float(np.sqrt(repeated * per_word)),
        float(np.sqrt(capitals * per_char)),
        float(np.sqrt(marks * per_char)),
        float(distinct),
    ]
    return n, word_chars, symbols, dups, repeated, vector


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()), *((c, pa.int64()) for c in STATS), *((f"x{i}", pa.float64()) for i in range(len(FEATURES)))])
DDL = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in STATS) + "".join(f", x{i} double" for i in range(len(FEATURES)))
XS = [f"x{i}" for i in range(len(FEATURES))]
PAIRS = [(i, j) for i in range(len(XS)) for j in range(i, len(XS))]


def measure(docs: DataFrame) -> DataFrame:
    """Statistics and vector of each document (doc_id, text, lang, source)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc_id, text, lang, source in rows_of(batches, "doc_id", "text", "lang", "source"):
                *stats, vector = statistics(utf8(text))
                yield (doc_id, lang, source, *stats, *vector)

        yield from batched(rows(), SCHEMA, 2000)

    arrow_rows(docs.sparkSession)
    return only(docs, "doc_id", "text", "lang", "source").mapInArrow(run, DDL)


def scatter_of(n: float, total: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and scatter from sums and sums of products; the floors of FEATURES are added to the diagonal."""
    d = len(XS)
    mean, square = np.asarray(total, float) / max(1, n), np.zeros((d, d))
    for (i, j), p in zip(PAIRS, products, strict=True):
        square[i, j] = square[j, i] = p / max(1, n)
    return mean, (square - np.outer(mean, mean)) * CONSISTENCY + np.diag(FLOORS**2)


def distances(x: np.ndarray, centre: np.ndarray, scatter: np.ndarray) -> np.ndarray:
    diff = x - centre
    return np.einsum("ij,jk,ik->i", diff, np.linalg.inv(scatter), diff)


def half(n: int) -> int:
    """How many of n rows are the half whose scatter counts."""
    return max(1, int(np.ceil(SHARE * n)))


def concentrate(x: np.ndarray, rows: np.ndarray, most_steps: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Concentration steps from the rows' estimate, until the determinant falls no more: its log, centre, scatter."""
    best = (np.inf, np.zeros(x.shape[1]), np.eye(x.shape[1]))
    for _ in range(most_steps):
        own = x[rows]
        centre, scatter = own.mean(0), np.cov(own, rowvar=False, bias=True).reshape(x.shape[1], -1) * CONSISTENCY + np.diag(FLOORS**2)
        det = float(np.linalg.slogdet(scatter)[1])
        if det >= best[0] - 1e-12:
            break
        best = det, centre, scatter
        rows = np.argsort(distances(x, centre, scatter), kind="stable")[: half(len(x))]
    return best


def starts(x: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """The best STARTS estimates for a sample, by the least determinant: from medians and median deviations, and from
    random subsets of one row more than there are features, each improved by concentration steps."""
    n, d = x.shape
    x = x[np.lexsort(x.T[::-1])]  # the order in which rows come changes nothing
    middle = np.median(x, 0)
    spread = np.maximum(FLOORS, 1.4826 * np.median(np.abs(x - middle), 0))
    first = [np.argsort((((x - middle) / spread) ** 2).sum(1), kind="stable")[: half(n)]]
    rng = np.random.default_rng(n)
    first += [rng.choice(n, min(n, d + 1), replace=False) for _ in range(SUBSETS if n > 2 else 0)]
    # Two steps from each, and to the end from the best few.
    tried = []
    for rows in first:
        centre, scatter = x[rows].mean(0), np.cov(x[rows], rowvar=False, bias=True).reshape(d, d) + np.diag(FLOORS**2)
        rows = np.argsort(distances(x, centre, scatter), kind="stable")[: half(n)]
        tried.append((concentrate(x, rows, 2)[0], rows.tolist()))
    out: list[tuple[float, np.ndarray, np.ndarray]] = []
    for _, rows in sorted(tried)[: 5 * STARTS]:
        got = concentrate(x, np.array(rows), 100)
        if all(abs(got[0] - o[0]) > 1e-9 for o in out):
            out.append(got)
    return sorted(out, key=lambda o: o[0])[:STARTS]


ESTIMATE_SCHEMA = pa.schema([("group", pa.string()), ("start", pa.int64()), ("det", pa.float64()), ("centre", pa.list_(pa.float64())), ("inverse", pa.list_(pa.float64()))])
ESTIMATE_DDL = "group string, start long, det double, centre array<double>, inverse array<double>"


def _first_estimates(good: DataFrame) -> DataFrame:
    """Starts of each group out of a sample of at most SAMPLE rows: in each slot that with the least hash, so the
    sample is a partial aggregate."""
    h = F.xxhash64(*XS)
    slots = good.groupBy("group", F.pmod(h, F.lit(SAMPLE)).alias("slot")).agg(F.min_by(F.array(*XS), F.xxhash64(h)).alias("x"))
    own = slots.groupBy("group").agg(F.collect_list("x").alias("rows"))  # SAMPLE at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for group, rows in rows_of(batches, "group", "rows"):
                for k, (_, centre, scatter) in enumerate(starts(np.array(rows, float))):
                    yield group, k, np.inf, centre.tolist(), np.linalg.inv(scatter).ravel().tolist()

        yield from batched(found(), ESTIMATE_SCHEMA, 100)

    return written(own.mapInArrow(run, ESTIMATE_DDL), "starts")


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    """Count, sums and sums of products of the vectors."""
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in PAIRS]
    return rows.groupBy(*by).agg(F.max("size").alias("size"), F.count("*").alias("n"), *(F.sum(x).alias(x) for x in XS), *products)


def _distance(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows with the squared Mahalanobis distance d2 to the estimates of their group. Spark broadcasts the table of
    estimates if it is small enough by its own threshold, and else splits the partition of a hot group."""
    d = len(XS)
    joined = rows.join(table, "group", "left")
    diff = [F.col(f"x{i}") - F.col("centre")[i] for i in range(d)]
    terms = [diff[i] * diff[j] * F.col("inverse")[i * d + j] * (1 if i == j else 2) for i, j in PAIRS]
    return joined.withColumn("d2", reduce(lambda a, b: a + b, terms)).drop("centre", "inverse")


def _half(rows: DataFrame) -> DataFrame:
    """The rows of each group and start with the least distances, SHARE of it, and size, the count of all its rows:
    by a histogram of log distance."""
    binned = rows.withColumn("bin", F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.log(F.col("d2") + 1e-6) + 14) * 64))).cast("int"))
    counts = binned.groupBy("group", "start", "bin").agg(F.count("*").alias("n"))
    own = Window.partitionBy("group", "start")  # BINS rows at most
    so_far = counts.withColumns({"run": F.sum("n").over(own.orderBy("bin")), "all": F.sum("n").over(own)})
    bound = written(so_far.where(F.col("run") >= SHARE * F.col("all")).groupBy("group", "start").agg(F.min("bin").alias("bound"), F.max("all").alias("size")), "bounds")
    return binned.join(bound, ["group", "start"]).where("bin <= bound").drop("bin", "bound")


COLUMNS = [*XS, *(f"p{i}_{j}" for i, j in PAIRS)]


def _stepped(good: DataFrame, table: DataFrame) -> DataFrame:
    """The table (group, start, det, centre, inverse) after a concentration step over all rows, with the sums of the
    halves, and was, the log of the determinant before. An estimate that didn't get better stays as it is."""
    sums = written(_sums(_half(_distance(good, table.select("group", "start", "centre", "inverse"))), "group", "of", "start"), "sums")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for group, start, n, *x in rows_of(batches, "group", "start", "n", *COLUMNS):
                centre, scatter = scatter_of(n, x[: len(XS)], x[len(XS) :])
                yield group, start, float(np.linalg.slogdet(scatter)[1]), centre.tolist(), np.linalg.inv(scatter).ravel().tolist()

        yield from batched(found(), ESTIMATE_SCHEMA, 1000)

    new = sums.mapInArrow(run, ESTIMATE_DDL).join(sums, ["group", "start"])
    old = table.select("group", "start", F.col("det").alias("was"), *(F.struct(*(F.col(c) for c in table.columns if c not in ("group", "start", "was"))).alias("old"),))
    both = new.join(old, ["group", "start"])
    if "n" not in table.columns:  # the starts: nothing is known of their halves yet
        return written(both.drop("old"), "estimates")
    rest = [c for c in new.columns if c not in ("group", "start")]
    kept = F.when(F.col("det") < F.col("was"), F.struct(*rest)).otherwise(F.struct(*(F.col(f"old.{c}").alias(c) for c in rest)))
    return written(both.select("group", "start", "was", kept.alias("k")).select("group", "start", "was", "k.*"), "estimates")


def determinant_estimates(good: DataFrame) -> DataFrame:
    """The sums of the half with the least determinant of each group of good (group, of, XS)."""
    table = _stepped(good, _first_estimates(good))
    for _ in range(STEPS):
        table = _stepped(good, table)
        if table.where(F.col("det") < F.col("was") - SETTLED).isEmpty():
            break
    rest = [c for c in table.columns if c not in ("group", "was")]
    best = table.groupBy("group").agg(F.min_by(F.struct(*rest), F.struct("det", "start")).alias("k"))
    return written(best.select("group", "k.*").select("group", "of", "size", "n", *COLUMNS), "best")


def mixed(size: float, own: np.ndarray, wider: np.ndarray) -> np.ndarray:
    """Mean sums of a group of so many rows, with those of PRIOR_ROWS rows of the wider group."""
    share = size / (size + PRIOR_ROWS)
    return share * own + (1 - share) * wider


def prior(mean: np.ndarray) -> np.ndarray:
    """Mean sums of rows about a centre whose scatter says that little is known."""
    spread = np.array(list(UNKNOWN.values())) ** 2
    return np.array([*mean, *(mean[i] * mean[j] + (spread[i] / CONSISTENCY if i == j else 0.0) for i, j in PAIRS)])


def _mixed(sums: DataFrame) -> DataFrame:
    """Estimates of each group, mixed with those of its language, of all rows, and the prior."""
    total = [F.sum(c).alias(c) for c in ("size", "n", *COLUMNS)]
    languages = written(sums.groupBy("of").agg(*total), "languages")
    size, n, *every = (x or 0 for x in languages.agg(*total).first())  # one row
    own = np.array(every, float) / max(1, n)
    whole = mixed(size, own, prior(own[: len(XS)]))
    wide = languages.select("of", *(F.col(c).alias(f"w_{c}") for c in ("size", "n", *COLUMNS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for group, size, n, w_size, w_n, *x in rows_of(batches, "group", "size", "n", "w_size", "w_n", *COLUMNS, *(f"w_{c}" for c in COLUMNS)):
                own, wider = np.array(x[: len(COLUMNS)]) / n, np.array(x[len(COLUMNS) :]) / w_n
                mean = mixed(size, own, mixed(w_size, wider, whole))
                centre, scatter = scatter_of(1, mean[: len(XS)], mean[len(XS) :])
                yield group, 0, 0.0, centre.tolist(), np.linalg.inv(scatter).ravel().tolist()

        yield from batched(found(), ESTIMATE_SCHEMA, 1000)

    return written(sums.join(wide, "of").mapInArrow(run, ESTIMATE_DDL).drop("det"), "mixed")


def judge(docs: DataFrame) -> DataFrame:
    """The base verdict, the squared distance and the method's verdict of each document."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    of = F.coalesce(F.concat(F.lit("+"), "lang"), F.lit("-"))
    group = F.concat_ws("\x00", of, F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-")))
    rows = written(measure(docs).withColumns({"base_failed": base, "of": of, "group": group}), "stats")
    good = rows.where("not base_failed").select("group", "of", *XS)
    table = _mixed(determinant_estimates(good))
    # A last step by the mixed estimates: what is unusual in a small group is known from its language.
    table = _mixed(written(_sums(_half(_distance(good, table)), "group", "of"), "sums"))
    # Groups of failed rows alone have no estimates, and their rows no distance.
    out = _distance(rows, table)
    return out.select("doc_id", *STATS, "base_failed", (~F.col("base_failed") & F.coalesce(F.col("d2") <= CUTOFF, F.lit(False))).alias("kept"), F.col("d2").alias("distance2"))
