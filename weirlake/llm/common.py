"""What the text operators share: tables, the shared scratch folder, and Arrow batches in bounded slices."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that go to a Python worker at a time. Texts average a few KB, so a batch stays a few MB.
BATCH_ROWS = 500
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_rows(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep the batches that Python workers get small: long texts make large batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name under spark.checkpoint.dir, which driver and executors share.

    Only a local session without that setting gets a temporary folder of its own.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="weirlake-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/weirlake-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: later steps read it and don't compute it again, and a
    lost executor costs no more than the task it ran."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def utf8(value: str | None) -> bytes:
    """The text's bytes; null is empty."""
    return b"" if value is None else value.encode("utf-8", "surrogatepass")


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows as tuples of Python values, one batch at a time."""
    for b in batches:
        yield from zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in columns), strict=True)


def batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 1000) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most so many rows."""
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Those columns alone, so that further ones, whatever their names, are never touched."""
    return df.select(*(F.col(f"`{c}`") for c in columns))


def packed(df: DataFrame) -> Column:
    """A whole row as one value, _row, so that its columns' names, dots included, clash with none."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(F.col("_row").getField(c).alias(c) for c in columns))


def row_key(names: tuple[str, str]) -> list[Column]:
    """128 bits of a row's doc_id and text under two names; nulls have keys of their own."""
    own = (F.coalesce("doc_id", F.lit(0)).cast("long"), F.col("doc_id").isNull(), F.col("text").isNull(), F.coalesce("text", F.lit("")))
    return [F.xxhash64(F.lit(k), *own).alias(c) for k, c in enumerate(names)]
