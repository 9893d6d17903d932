"""Helpers shared by the training-data operators.

Row key: ``doc_id`` may be null or repeated, so operators that must bring decisions back
to a text address a row by (``ROW_ID``, ``ROW_TEXT``): the id (a null gets the smallest
long, other types a hash) and a 64-bit hash of the text.  Rows equal in both are copies of
one row and share every decision.  All internal columns start with ``__hl_``, so columns
that a caller brings along cannot clash.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.session import checkpoint_dir

ROW_ID, ROW_TEXT = "__hl_id", "__hl_text"
ROW_KEY = [ROW_ID, ROW_TEXT]
#: A side is broadcast only after a count has shown that it has no more rows than this.
BROADCAST_ROWS = 50_000


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: a lineage cut
    that survives lost executors.  Every call gets a folder of its own."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, size: int = 16 << 20) -> None:
    """Let no more than ``size`` bytes of texts go to a Python worker at once: Spark's own
    bound (64 MB) is for each task, on both sides.  A lower setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(-?\d+)b?", spark.conf.get(key))
    if now is None or not 0 < int(now[1]) <= size:
        spark.conf.set(key, str(size))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``rows`` rows (reads no more than one row beyond)."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its size is checked to be small, else unmarked:
    Spark then shuffles both sides, and its skew handling splits hot keys."""
    return F.broadcast(df) if fits(df, rows) else df


def with_row_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    kind = df.schema[id_col].dataType
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        rid: Column = F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63)))
    else:
        rid = F.xxhash64(F.col(id_col).cast("string"))
    return df.withColumns({ROW_ID: rid, ROW_TEXT: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})


def arrow_rows(batches: Iterable[pa.RecordBatch], max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``max_bytes``, so that Python objects made from
    one slice stay small however many long texts a batch holds."""
    for batch in batches:
        n = batch.num_rows
        step = max(1, min(n, n * max_bytes // max(1, batch.nbytes))) if n else 1
        for i in range(0, n, step):
            yield batch.slice(i, step)


def encoded(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
