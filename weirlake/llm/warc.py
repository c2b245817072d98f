"""WARC archives and their index, merged externally.

Writing: captures are sorted by URL key and time within each task, packed each as a gzip member of its own, and
written by Spark's text writer, so archives go to any file system that Spark writes to and its commit protocol
covers lost tasks. (A member ends with the top byte of its length, which is zero; that byte is the writer's row
end.) Files are cut by bytes. Reading: each archive is unpacked member by member and gives one index run, sorted as
its captures are, with the place and packed length of each record; read_record() reads one by these alone. Merging:
runs are dealt to ranges of (URL key, time, page), as many as keep a range at about ROWS_A_RANGE rows, so what a
task holds doesn't grow with the index; Spark's shuffle is the external storage. In each range the pieces of the
runs, which come sorted, are merged by a loser tree, so the whole is one ordered capture history.

Of records with equal payloads of at least min_payload bytes, that with the smallest page_id is a
response and the others revisit it. Repeated rows of that smallest page_id are responses all. Null html
is the empty payload; null urls are empty; a null page_id can't be referred to and is written as such.
Whole payloads are hashed, however long; one record has to fit into memory. Further columns, whatever their names,
are not read. An empty table gives empty archives and an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlake.llm.common import arrow_rows, batched, only, rows_of, scratch, written

RECORD_END = "\r\n\r\n"
MEMBER = (1 << 24) - 1  # of fewer bytes the top byte of the length is zero
FILE_BYTES, ROWS_A_RANGE, CHUNK = 64 << 20, 500_000, 8 << 10
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 as 32 upper-case base32 letters: five hex digits make four letters."""
    digest, letters = F.sha1(payload), []
    for i in range(8):
        v = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), (F.shiftright(v, s).bitwiseAND(31) + 1), F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def url_key(url: Column) -> Column:
    """A key that sorts hosts by domain: labels reversed, then port, path and query in lower case."""
    clean = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://|#.*$", ""))
    host = F.regexp_replace(F.regexp_extract(clean, r"^([^/?]*)", 1), r"^www\d*\.|:(80|443)$", "")
    rest = F.regexp_replace(clean, r"^[^/?]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", F.lit("/")).otherwise(rest))


def page_key(url: str) -> str:
    """url_key() for one string."""
    clean = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://|#.*$", "", url).lower()
    host = re.match(r"[^/?]*", clean)[0]
    rest = clean[len(host) :] or "/"
    host = re.sub(r"^www\d*\.|:(80|443)$", "", host)
    return ",".join(host.split(".")[::-1]) + ")" + rest


def captures(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Pages (page_id, url, html) with digest, key, time and, for revisits, refers_to."""
    html = F.coalesce("html", F.lit(""))
    rows = only(pages, "page_id", "url", "html").select(
        "page_id",
        F.coalesce("url", F.lit("")).alias("url"),
        html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"),
        base32_sha1(html).alias("payload_digest"),
        url_key(F.col("url")).alias("urlkey"),
        F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(100_000_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
    )
    # Only digests that occur again are kept, each with its first page. As a table of its own it has a known
    # size: Spark broadcasts it below its threshold, and otherwise can split the partition of a hot digest.
    first = rows.where(F.col("payload_bytes") >= min_payload).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    first = written(first.where("n > 1").select("payload_digest", "first_id"), "firsts")
    return rows.join(first, "payload_digest", "left").withColumn("refers_to", F.when(F.col("first_id") != F.col("page_id"), F.col("first_id"))).drop("first_id")


def record(with_payload: bool = True) -> Column:
    """A WARC record without its end, from a row of captures()."""
    page = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    block = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(F.col("html")))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), page(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")),
        F.concat(F.lit("WARC-Date: "), F.col("date")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), page(F.col("refers_to")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(RECORD_END), block)


def packed(record: bytes) -> bytes:
    """A record as gzip members of which each ends with a zero byte: one, or more if it is 16 MB or longer."""
    out = []
    for k in range(0, max(1, len(record)), MEMBER):
        pack = zlib.compressobj(1, zlib.DEFLATED, 31)
        out.append(pack.compress(record[k : k + MEMBER]) + pack.flush())
    return b"".join(out)


def write_archives(rows: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Rows of captures() as WARC files; the captures of a file are sorted by key, time and page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = size = pos = 0
        for b in batches:
            values = [packed(r) for r in b.column(0).cast(pa.binary()).to_pylist()]
            files = []
            for v in values:
                if size and size + len(v) > file_bytes:
                    file, size = file + 1, 0
                size += len(v)
                files.append(file)
            yield pa.record_batch([pa.array([v[:-1] for v in values], pa.binary()), pa.array(files, pa.int32()), pa.array(range(pos, pos + len(values)), pa.int64())], ["value", "file", "pos"])
            pos += len(values)

    arrow_rows(rows.sparkSession)
    runs = rows.sortWithinPartitions("urlkey", "date", "page_id").select(F.concat(record(), F.lit(RECORD_END)).alias("record"))
    out = runs.mapInArrow(run, "value binary, file int, pos long").sortWithinPartitions("file", "pos")
    out.select(F.col("value").cast("string").alias("value"), "file").write.partitionBy("file").option("lineSep", "\0").text(path)


def members(data: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """Start, end and content of each gzip member."""
    at = 0
    while at < len(data):
        start, unpack, parts = at, zlib.decompressobj(31), []
        while not unpack.eof:
            if at >= len(data):
                raise ValueError(f"member at {start} is cut short")
            parts.append(unpack.decompress(data[at : at + CHUNK]))
            at = min(len(data), at + CHUNK)
        at -= len(unpack.unused_data)
        yield start, at, b"".join(parts)


def fields(head: bytes) -> dict[str, str]:
    """The header fields of a record, names in lower case."""
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    pairs = (line.partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def records(data: memoryview) -> Iterator[tuple[dict[str, str], int, int, bytes]]:
    """Header fields, place, packed length and block of each record of an archive."""
    start, held = 0, b""
    for _, end, content in members(data):
        held = held + content if held else content
        head_end = held.find(RECORD_END.encode())
        if head_end < 0:
            continue
        head = fields(held[:head_end])
        size = int(head["content-length"])
        if len(held) >= head_end + 8 + size:
            yield head, start, end - start, held[head_end + 4 : head_end + 4 + size]
            start, held = end, b""
    if held:
        raise ValueError(f"record at {start} is cut short")


def read_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of the one record in the bytes that an index row names: file, offset and length."""
    head, _, _, block = next(records(memoryview(data)))
    return head, block


def page_of(uri: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(m[1]) if m else None


INDEX_SCHEMA = pa.schema(
    [("urlkey", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)
INDEX_DDL = "urlkey string, date string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def index_entry(head: dict[str, str], start: int, length: int, block: bytes, archive: str) -> tuple:
    """An index row; a response's payload is measured and hashed anew and must be what its header says."""
    kind, digest, size = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:"), int(head["warc-payload-length"])
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        got = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if (got, len(payload)) != (digest, size):
            raise ValueError(f"payload at {start} of {archive} is not what its header says")
    refers = page_of(head.get("warc-refers-to")) if kind == "revisit" else None
    return page_key(head["warc-target-uri"]), head["warc-date"], page_of(head["warc-record-id"]), size, digest, kind, refers, archive, start, length


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The index run of each archive, in the archive's order. One archive is held at a time, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    archive = "/".join(urlsplit(name).path.rsplit("/", 2)[-2:])
                    for head, start, length, block in records(memoryview(content.as_buffer())):
                        yield index_entry(head, start, length, block, archive)

        yield from batched(rows(), INDEX_SCHEMA, 4096)

    arrow_rows(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("path", "content").mapInArrow(run, INDEX_DDL)


def loser_tree_merge(runs: list[list[tuple]]) -> Iterator[tuple]:
    """Rows of sorted runs in order. Inner nodes hold the loser of their match and the root's winner goes
    out next, so each row costs one match a level. Ties go to the earlier run."""
    k = len(runs)
    if k == 0:
        return
    heads: list[tuple | None] = [r[0] if r else None for r in runs]
    at = [1] * k

    def beats(a: int, b: int) -> bool:
        if b < 0 or heads[b] is None:
            return a >= 0 and (heads[a] is not None or b < 0)
        if a < 0 or heads[a] is None:
            return False
        return (heads[a], a) < (heads[b], b)

    losers = [-1] * k
    winners = [-1] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if beats(a, b) else (b, a)
    best = winners[1] if k > 1 else 0
    while heads[best] is not None:
        yield heads[best]
        own = runs[best]
        heads[best], at[best] = (own[at[best]] if at[best] < len(own) else None), at[best] + 1
        node = (best + k) // 2
        while node:
            if beats(losers[node], best):
                losers[node], best = best, losers[node]
            node //= 2


def sorted_runs(rows: Iterator[tuple], run_of: Callable[[tuple], object], key: Callable[[tuple], tuple]) -> list[list[tuple]]:
    """Rows as the sorted runs in which they come, as (key, row). A run whose next row is smaller has been sent in
    several pieces, in any order; then another run begins."""
    now: dict[object, list[tuple]] = {}
    runs: list[list[tuple]] = []
    for r in rows:
        k, name = key(r), run_of(r)
        own = now.get(name)
        if own is None or k < own[-1][0]:
            own = now[name] = []
            runs.append(own)
        own.append((k, r))
    return runs


def merge_index(index: DataFrame, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """Index runs as one history ordered by key, time and page over all partitions. Ranges are cut by
    the whole order, so a hot host or URL is split as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, r[7], r[8])
        runs = sorted_runs(rows_of(batches, *INDEX_SCHEMA.names), lambda r: r[7], key)
        yield from batched((r for _, r in loser_tree_merge(runs)), INDEX_SCHEMA, 4096)

    spark = index.sparkSession
    arrow_rows(spark)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-index.count() // rows_a_range))
    return index.repartitionByRange(n, "urlkey", "date", "page_id", "archive", "offset").mapInArrow(run, INDEX_DDL)


def archive(pages: DataFrame, path: str | None = None, min_payload: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages as archives, read these back, and return the merged index."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_archives(captures(pages, min_payload), path, file_bytes)
    return merge_index(written(read_archives(spark, path), "cdx"))
