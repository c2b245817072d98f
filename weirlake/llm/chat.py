"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as one text, encoded once with offsets, and the sorted spans of its turns
are intersected with the sorted spans of its tokens by binary search. Control strings inside texts get
a backslash after their bracket, which reading takes away again.

Turns go by turn number, then role, then text, so ties and repeated rows have one order; null turns
come first. Null roles and texts are empty. A row with a null conv_id is a conversation by itself, so that
such rows are no group that grows with the table. A conversation is rendered in one task, as its text is one
value; tasks stream over conversations and hold one at a time. Further columns, whatever their names, are not
read. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlake.llm.common import arrow_rows, batched, only, rows_of

START, END = "<|im_start|>", "<|im_end|>"
#: A bracket, backslashes, and what makes a control string of it for common chat templates.
CONTROL = re.compile(r"([<\[])(\\*)(\||/?s>|/?INST\])")
ESCAPED = re.compile(r"([<\[])\\(\\*)(\||/?s>|/?INST\])")
TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.DOTALL)


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    """A role is one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The text, and the span of each turn's escaped text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """Role, text, and the span of the escaped text for each turn of a rendered conversation."""
    out, at = [], 0
    while m := TURN.match(formatted, at):
        out.append((unescape_role(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a rendered conversation")
    return out


def mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """For each token whether it overlaps one of the spans; both are sorted (n x 2 integers)."""
    out = np.zeros(len(offsets), bool)
    if len(offsets) and len(spans):
        first = np.searchsorted(offsets[:, 1], spans[:, 0], "right")
        last = np.searchsorted(offsets[:, 0], spans[:, 1], "left")
        for a, b in zip(first, last, strict=True):
            out[a:b] = True
        out &= offsets[:, 1] > offsets[:, 0]
    return out


def masked_text(formatted: str, turns: list[tuple[str, str, int, int]], offsets: np.ndarray, on: np.ndarray) -> list[str]:
    """What is under the mask in each turn that it touches, unescaped: tokens cut at the turn's ends;
    tokens that share a character (parts of one code point) give it once."""
    held = offsets[on]
    out = []
    if len(held):
        first = np.searchsorted(held[:, 1], [t[2] for t in turns], "right")
        last = np.searchsorted(held[:, 0], [t[3] for t in turns], "left")
        # Places where a token begins beyond all before it: between them the text runs on.
        reach = np.maximum.accumulate(held[:, 1])
        gaps = np.flatnonzero(held[1:, 0] > reach[:-1]) + 1
        for (_, _, a, b), i, j in zip(turns, first.tolist(), last.tolist(), strict=True):
            if i < j:
                cuts = [i, *gaps[np.searchsorted(gaps, i, "right") : np.searchsorted(gaps, j, "left")].tolist(), j]
                parts = [formatted[max(int(held[x, 0]), a) : min(int(held[x:y, 1].max()), b)] for x, y in zip(cuts, cuts[1:], strict=False)]
                if any(parts):
                    out.append(unescape("".join(parts)))
    return out


class Formatter:
    """Renders, encodes and masks; loss_roles are the roles whose texts the loss covers."""

    def __init__(self, tokenizer_path: str, loss_roles: tuple[str, ...] = ("assistant",)):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.loss_roles = Tokenizer.from_file(tokenizer_path), loss_roles

    def __call__(self, turns: list[tuple[str, str]]) -> tuple[str, list[int], np.ndarray, np.ndarray]:
        """The text, token ids, token offsets and loss mask."""
        formatted, spans = render(turns)
        got = self.tokenizer.encode(formatted, add_special_tokens=False)
        offsets = np.fromiter(chain.from_iterable(got.offsets), np.int64, 2 * len(got)).reshape(-1, 2)
        own = np.array([r in self.loss_roles for r, _ in turns], bool) & (spans[:, 1] > spans[:, 0])
        return formatted, got.ids, offsets, mask(offsets, spans[own])


@lru_cache(1)
def formatter_of(tokenizer_path: str, loss_roles: tuple[str, ...]) -> Formatter:
    """One for each worker process, kept from task to task."""
    return Formatter(tokenizer_path, loss_roles)


SCHEMA = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_()))])
DDL = "conv_id long, formatted string, ids array<int>, starts array<int>, ends array<int>, loss_mask array<boolean>"


def format_conversations(turns: DataFrame, tokenizer_path: str, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A row for each conversation of (conv_id, turn, role, text): text, ids, token offsets, mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = formatter_of(tokenizer_path, tuple(loss_roles))

        def rows() -> Iterator[tuple]:
            alone = count()  # a row without conv_id is a conversation by itself
            for (conv_id, _), own in groupby(rows_of(batches, "conv_id", "role", "text"), key=lambda r: (r[0], next(alone) if r[0] is None else 0)):
                text, ids, offsets, on = form([(r or "", t or "") for _, r, t in own])
                yield conv_id, text, ids, offsets[:, 0], offsets[:, 1], on

        yield from batched(rows(), SCHEMA, 100)

    arrow_rows(turns.sparkSession)
    ordered = only(turns, "conv_id", "turn", "role", "text").repartition("conv_id", F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))).sortWithinPartitions("conv_id", "turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    return ordered.mapInArrow(run, DDL)


DIGEST_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64()), ("n_loss_tokens", pa.int64())]
)
DIGEST_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"


def digests(formatted: DataFrame) -> DataFrame:
    """What format_conversations() gave, read back: turns from the text, loss texts from the mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                texts, ids = b.column(1).to_pylist(), b.column(0).to_pylist()
                at = b.column(3).offsets.to_numpy()
                offsets = np.stack([b.column(k).values.to_numpy(zero_copy_only=False) for k in (3, 4)], 1)
                under = b.column(5).values.to_numpy(zero_copy_only=False)
                for k, (conv_id, text) in enumerate(zip(ids, texts, strict=True)):
                    turns, on = parse(text), under[at[k] : at[k + 1]]
                    loss = "".join(masked_text(text, turns, offsets[at[k] : at[k + 1]], on))
                    said = "".join([f"{role}\n{t}\n" for role, t, _, _ in turns])
                    sha = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (said, loss)]
                    yield conv_id, len(turns), sha[0], len(loss), sha[1], len(text), len(on), int(on.sum())

        yield from batched(rows(), DIGEST_SCHEMA)

    arrow_rows(formatted.sparkSession)
    return formatted.mapInArrow(run, DIGEST_DDL)
