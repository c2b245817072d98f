"""Secret scans with structural confirmation.

Patterns find the base spans. Base64 and hex candidates are then decoded, and only what decodes to a
key encoding (DER with nested lengths that add up, or length-prefixed SSH key data) or to the header
of a signed token is reported as well.

Nulls and empty texts have no spans. Null and repeated doc_ids are handed on. Of spans with one start, kinds go
in the order of KINDS. Very long texts are scanned whole; each pattern takes time in proportion to the text.
Repeated rows give repeated results. Further columns, whatever their names, are not read. An empty table gives an
empty one.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from weirlake.llm.common import arrow_rows, batched, only, rows_of

Span = tuple[str, int, int]

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "der", "ssh", "jwt")
ORDER = {k: i for i, k in enumerate(KINDS)}

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
#: One of these, in lower case, is in every text that ASSIGN matches; looking for them is much faster.
ASSIGN_WORDS = ("passw", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: [0-9a-f]+ takes whole runs, so asking for 16 at once finds the same spans.
HEX = re.compile(r"[0-9a-f]{16,}")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s\\]+?)-----END \1-----")
ENCODED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}={0,2}")
HEX_BYTES = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){24,}(?![0-9A-Fa-f])")
TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def from_base64(text: str) -> bytes:
    """The bytes of standard or URL-safe base64 with or without padding, or none."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return b""
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def der_item(data: bytes, at: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the value of the DER item at a place; none unless it lies within data."""
    if at + 2 > len(data):
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if size < 0x80:
            return None
    return (tag, at, at + size) if at + size <= len(data) else None


def is_der_key(data: bytes) -> bool:
    """A SEQUENCE that fills data and whose items fill it in turn: a version number, then the
    integers of an RSA key, the octets of an EC key, or an algorithm and wrapped octets."""
    whole = der_item(data, 0)
    if not whole or whole[0] != 0x30 or whole[2] != len(data):
        return False
    items, at = [], whole[1]
    while at < whole[2]:
        item = der_item(data, at)
        if not item or item[2] > whole[2]:
            return False
        items.append(item)
        at = item[2]
    tags = [x[0] for x in items]
    if len(tags) < 2 or tags[0] != 0x02 or items[0][2] - items[0][1] != 1 or data[items[0][1]] > 1:
        return False
    rsa = len(tags) >= 9 and all(t == 0x02 for t in tags[:9])
    ec = tags[1] == 0x04 and items[1][2] - items[1][1] >= 16
    wrapped = len(tags) >= 3 and tags[1] == 0x30 and tags[2] == 0x04 and (x := der_item(data, items[1][1])) is not None and x[0] == 0x06
    return rsa or ec or wrapped


def is_ssh_key(data: bytes) -> bool:
    """The private key container, or a public key: fields with four-byte lengths that fill data."""
    magic = b"openssh-key-v1\0"
    private = data.startswith(magic)
    at, fields = len(magic) if private else 0, []
    while at + 4 <= len(data) and len(fields) < 16:
        n = int.from_bytes(data[at : at + 4], "big")
        if private and len(fields) == 3:  # a count of keys stands here
            return 1 <= n <= 64 and len(data) > at + 8
        if n > len(data) - at - 4:
            return False
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return not private and at == len(data) and len(fields) >= 2 and fields[0].startswith((b"ssh-", b"ecdsa-sha2-"))


def is_token_header(data: bytes) -> bool:
    try:
        head = json.loads(data)
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def key_kind(data: bytes) -> str | None:
    if len(data) >= 16 and data[0] == 0x30 and is_der_key(data):
        return "der"
    if len(data) >= 16 and (data[0] == 0 or data[:8] == b"openssh-") and is_ssh_key(data):
        return "ssh"
    return None


def confirmed_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if "PRIVATE KEY-----" in text:
        for m in PEM.finditer(text):
            if key_kind(from_base64(re.sub(r"\\[nr]|\s", "", m[2]))):
                out.append(("pem", *m.span()))
    if "eyJ" in text:
        out += [("jwt", *m.span()) for m in TOKEN.finditer(text) if is_token_header(from_base64(m[1]))]
    for m in ENCODED.finditer(text):
        if kind := key_kind(from_base64(m[0])):
            out.append((kind, *m.span()))
    for m in HEX_BYTES.finditer(text):
        if kind := key_kind(bytes.fromhex(m[0])):
            out.append((kind, *m.span()))
    return out


def joined(spans: list[Span]) -> str:
    """By start, then kind as listed."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], ORDER[s[0]], s[2])))


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and confirmed ones."""
    return (base_spans(text), sorted(set(confirmed_spans(text)))) if text else ([], [])


SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_confirmed", pa.int64())]
)
DDL = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"


def scan(docs: DataFrame) -> DataFrame:
    """A row for each document (doc_id, text): counts of the base kinds, digest of the base spans,
    all spans (code points, end exclusive), and the number of confirmed ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc_id, text in rows_of(batches, "doc_id", "text"):
                base, more = find(text)
                n = [sum(k == kind for k, _, _ in base) for kind in BASE_KINDS]
                yield (doc_id, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more))

        yield from batched(rows(), SCHEMA)

    arrow_rows(docs.sparkSession)
    return only(docs, "doc_id", "text").mapInArrow(run, DDL)
