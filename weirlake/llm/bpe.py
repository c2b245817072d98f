"""Byte-level BPE by speculation and verification.

Texts are cut into words by the tokenizer's pattern. Greedy longest match proposes tokens for each new
word. A proposal is right if each two adjacent tokens are what merging gives for their bytes alone; all
adjacent pairs of all proposals of a batch are looked up at once, and pairs not met before are merged
once. Only words with a pair that fails are merged exactly. Words and pairs are kept between batches
in tables of bounded size (words by their bytes).

Null text is empty: no tokens. Null and repeated doc_ids are handed on; rows are independent of each other, so
ties don't arise. Texts are encoded whole, in pieces of memory that follow the longest text of a batch. Repeated
rows give repeated results. Further columns, whatever their names, are not read. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weirlake.llm.common import arrow_rows, batched, only, rows_of

#: How byte-level tokenizers cut text before merging; the pattern is part of the vocabulary's format.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MOST_BYTES, MOST_PAIRS = 64 << 20, 1_000_000  # of words with their ids, and of pairs
LONG_WORD = 64


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary, backwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def check_spec(spec: dict) -> None:
    """Raise for what a vocabulary file can ask for and this encoder doesn't do."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    wrong = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    wrong += [k for k in ("lstrip", "rstrip", "single_word", "normalized") if any(t.get(k) for t in spec.get("added_tokens", []))]
    wrong += ["normalizer"] if spec.get("normalizer") else []
    wrong += ["pre_tokenizer"] if (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex", True)) != ("ByteLevel", False, True) else []
    wrong += ["model"] if model.get("type", "BPE") != "BPE" else []
    if wrong:
        raise ValueError(f"not a plain byte-level BPE file: {', '.join(wrong)}")


class Codec:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_spec(spec)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token = {i: as_bytes(s) for s, i in vocab.items() if s not in self.added} | {i: s.encode() for s, i in self.added.items()}
        self.id = {b: i for i, b in self.token.items() if i not in self.added.values()}
        self.longest = max(map(len, self.id))
        self.size = max(self.token) + 1
        self.rank: dict[int, int] = {}  # of two ids, as one number
        self.new: list[int] = []  # by rank
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = map(as_bytes, m.split(" ") if isinstance(m, str) else m)
            self.rank[self.id[a] * self.size + self.id[b]] = rank
            self.new.append(self.id[a + b])
        self.byte = [self.id[bytes([i])] for i in range(256)]
        self.words = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else None
        self.known: dict[str, bytes] = {}
        self.held = 0  # bytes of known
        self.pairs: dict[int, bool] = {}
        self.exact = 0  # words that needed merging

    def merged(self, word: bytes) -> list[int]:
        """The exact encoding: of all adjacent tokens that merge, the lowest rank first, leftmost first."""
        ids = [self.byte[b] for b in word]
        if len(ids) > LONG_WORD:
            return self._merged_long(ids)
        size, rank, none = self.size, self.rank.get, len(self.new)
        ranks = [rank(a * size + b, none) for a, b in pairwise(ids)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            ids[i : i + 2] = [self.new[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] * size + ids[i], none)
            if i < len(ranks):
                ranks[i] = rank(ids[i] * size + ids[i + 1], none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a queue, for words too long to look through again and again."""
        n, size, rank = len(ids), self.size, self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        queue: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if (r := rank(ids[i] * size + ids[j])) is not None:
                heapq.heappush(queue, (r, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = self.new[r], False, after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [x for x, on in zip(ids, alive, strict=True) if on]

    def proposed(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, i, n, ids = [], 0, len(word), self.id
        while i < n:
            for j in range(min(n, i + self.longest), i, -1):
                if (t := ids.get(word[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
        return out

    def learn(self, words: list[str]) -> None:
        """Put the encodings of new words into the table."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        tokens = [self.proposed(b) for b in raw]
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat = np.fromiter((t for own in tokens for t in own), np.int64, int(size.sum()))
        inner = np.ones(max(0, len(flat) - 1), bool)
        ends = np.cumsum(size)[:-1] - 1
        inner[ends] = False
        wrong = np.zeros(len(words), bool)
        keys = (flat[:-1] * self.size + flat[1:])[inner]
        if len(keys):
            owner = np.repeat(np.arange(len(words)), np.maximum(size - 1, 0))
            distinct, at = np.unique(keys, return_inverse=True)
            fits = np.fromiter((self.fits(int(k)) for k in distinct), bool, len(distinct))
            wrong[owner[~fits[at]]] = True
        for i in np.flatnonzero(wrong):
            tokens[i] = self.merged(raw[i])
        self.exact += int(wrong.sum())
        for w, own in zip(words, tokens, strict=True):
            self.known[w] = np.array(own, "<u4").tobytes()
        self.held += sum(map(len, raw)) + 4 * sum(map(len, tokens)) + 150 * len(words)

    def fits(self, key: int) -> bool:
        """Whether merging the bytes of two tokens gives these tokens again."""
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            a, b = divmod(key, self.size)
            got = self.pairs[key] = self.merged(self.token[a] + self.token[b]) == [a, b]
        return got

    def cut(self, text: str) -> list[str]:
        """Words, and added tokens as they stand."""
        if self.split is None or not any(a in text for a in self.added):
            return self.words(text)
        out: list[str] = []
        for part in self.split(text):
            out += [part] if part in self.added else self.words(part)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if self.held > MOST_BYTES:
            self.known.clear()
            self.held = 0
        if not self.known:
            self.known.update({s: np.array([i], "<u4").tobytes() for s, i in self.added.items()})
        known = self.known
        cut = [self.cut(t) for t in texts]
        if new := list({w for own in cut for w in own if w not in known}):
            self.learn(new)
        return [b"".join([known[w] for w in own]) for own in cut]

    def decode(self, ids: bytes) -> str:
        token = self.token
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(1)
def codec_of(path: str) -> Codec:
    """One for each worker process, which keeps its words and pairs from task to task."""
    return Codec(path)


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Token ids of each document (doc_id, text), as binary: little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(tokenizer_path)
        for b in batches:
            ids = codec.encode([t or "" for t in b.column(1).to_pylist()])
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    arrow_rows(docs.sparkSession)
    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """The texts of encode()'s ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(tokenizer_path)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([codec.decode(x or b"") for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    arrow_rows(encoded.sparkSession)
    return only(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Encode each document and decode its ids: the number of tokens and both digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(tokenizer_path)

        def rows() -> Iterator[tuple]:
            for b in batches:
                doc_ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
                for doc_id, ids in zip(doc_ids, codec.encode(texts), strict=True):
                    back = codec.decode(ids).encode("utf-8", "surrogatepass")
                    yield doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()

        yield from batched(rows(), SCHEMA)

    arrow_rows(docs.sparkSession, 200)
    return only(docs, "doc_id", "text").mapInArrow(run, DDL)
