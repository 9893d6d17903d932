"""Line dedup by content-defined chunks (operator 7).

Lines are hashed, and a rolling hash runs over two line hashes.  A boundary stands
where the rolling hash is no larger than that of a neighbouring position; so of any two
neighbouring positions one is a boundary, the chunks of two lines that begin at the
boundaries cover the text, and an insertion shifts no boundary beyond the lines beside it.
Chunks found again anywhere are matches.  Two copies of a passage agree on every boundary
inside it; at its ends they may differ by one position, so matches are grown by the line
before and the line after where those are repeated with them.  A passage of three lines or
more is thus found whole, wherever it stands; of two lines, if both copies have a boundary
there.  Shorter ones (a repeated single line) are none of this operator's.

Lines of more than ``long`` bytes are split at sentence ends, and each sentence is a line
here (``units``), so that passages within long paragraphs are found too.

Of all places of a chunk the first (smallest id, then text hash, then place) is kept, the
others are removed.  The first place of a line is never removed: a chunk that would remove
it has an earlier place, which holds the line too.  Chunks meet by the 64-bit hashes of
their lines, aggregated with map-side combining; the bytes of all lines of all matches are
compared, and chunks with a line whose bytes differ under one hash stay.

The chunks, and the matches among them, are written once each.  Texts are shuffled once, by
the exchange that the byte comparison and the removal share; it is a join's own, so Spark
may split a hot row key.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.llm.common import ROW_KEY, arrow_rows, bounded_batches, encoded, stored, with_row_key
from hirelake.llm.quality import replaced

WINDOW, LONG = 2, 512
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: ASCII sentence ends before blanks, and the ideographic full stop with its full-width like.
_SENTENCE_END = re.compile(rb"(?<=[.!?])[ \t]+|(?<=\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)[ \t]*")
COUNTS = ["__hl_lines", "__hl_removed_lines", "__hl_removed_chunks"]


def units(text: bytes, long: int = LONG) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text, long ones by sentence, and what stands after each of them."""
    parts, gaps = [], []
    for line in text.split(b"\n"):
        if len(line) > long:
            start = 0
            for m in _SENTENCE_END.finditer(line):
                if start < m.start() and m.end() < len(line):
                    parts.append(line[start:m.start()])
                    gaps.append(m[0])
                    start = m.end()
            line = line[start:]
        parts.append(line)
        gaps.append(b"\n")
    return parts, gaps


def without(parts: list[bytes], gaps: list[bytes], gone: set[int]) -> bytes:
    """The text of what is left: a line feed where one stood between two neighbours, else
    what followed the first."""
    out, newline = [], False
    for i, (p, g) in enumerate(zip(parts, gaps, strict=True)):
        if i not in gone:
            if out:
                out.append(b"\n" if newline else gap)
            out.append(p)
            gap, newline = g, g == b"\n"
        else:
            newline = newline or g == b"\n"
    return b"".join(out)


def boundaries(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the boundaries, and whether the chunk at each of them is grown by the
    line before and by the line after; ``text`` tells which text a line hash belongs to.

    A neighbouring position whose rolling hash is no larger is a boundary in every copy of
    the lines of both, so a chunk is grown only towards larger ones."""
    n = len(hashes) - WINDOW + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, bool), np.empty(0, bool)
    rolled = hashes[:-1] * _BASE + hashes[1:]
    mixed = (rolled ^ (rolled >> np.uint64(32))) * _MIX
    own = text[:-1] == text[1:]
    beside = own[:-1] & own[1:]
    low = own.copy()                     # no neighbour, or one that is not smaller
    some = np.zeros(n, bool)
    some[:-1] |= beside
    some[1:] |= beside
    low &= ~some
    low[:-1] |= beside & (mixed[:-1] <= mixed[1:])
    low[1:] |= beside & (mixed[1:] <= mixed[:-1])
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    after[:-1] = beside & (mixed[1:] > mixed[:-1])
    before[1:] = beside & (mixed[:-1] > mixed[1:])
    p = np.flatnonzero(low)
    return p, before[p], after[p]


def _hashed(texts: Iterable[bytes], long: int) -> tuple[np.ndarray, np.ndarray]:
    digest = xxhash.xxh3_64_intdigest
    hashes, counts = [], []
    for t in texts:
        own = [digest(p) for p in units(t, long)[0]]
        hashes += own
        counts.append(len(own))
    return np.array(hashes, np.uint64), np.repeat(np.arange(len(counts)), np.array(counts, np.int64))


def _chunked(text_col: str, long: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_rows(batches):
            hashes, text = _hashed(encoded(b[text_col]), long)
            p, before, after = boundaries(hashes, text)
            own = text[p]
            signed = np.concatenate([[0], hashes.view(np.int64), [0]])      # line i stands at i + 1
            yield pa.RecordBatch.from_arrays(
                [*(b[c].take(pa.array(own, pa.int64())) for c in ROW_KEY), pa.array(p - np.searchsorted(text, own), pa.int32()),
                 pa.array(signed[p + 1], pa.int64()), pa.array(signed[p + 2], pa.int64()),
                 pa.array(signed[p], pa.int64(), mask=~before), pa.array(signed[p + 3 - (p + 3 >= len(signed))], pa.int64(), mask=~after)],
                [*ROW_KEY, "at", "c1", "c2", "before", "after"])

    return run


def _marked(marks: list[int] | None) -> set[int]:
    """The lines of marks, each of which is 4 x place + size."""
    return {i for m in marks or () for i in range(m >> 2, (m >> 2) + (m & 3))}


def _line_bytes(text_col: str, long: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_rows(batches):
            lines = set()
            for t, marks in zip(encoded(b[text_col]), b["__hl_marks"].to_pylist(), strict=True):
                parts = units(t, long)[0]
                lines.update(parts[i] for i in _marked(marks))
            content = list(lines)
            h = np.array([xxhash.xxh3_64_intdigest(x) for x in content], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(content, pa.binary())], ["h", "content"])

    return run


def remove_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars",
                  long: int = LONG) -> DataFrame:
    """``docs`` without later copies of chunks, plus ``COUNTS`` (lines as in ``units``,
    those removed, and the runs that they form); where a text changes, ``chars_col`` (if
    there is such a column) gets its new length.

    Null and empty texts stay as they are (one empty line).  A text of one line has no
    chunk.  Rows equal in id and text share every decision, so repeated rows do not remove
    each other's chunks.  Empty table: no rows."""
    bounded_batches(docs.sparkSession)
    columns = docs.columns
    rows = with_row_key(docs, id_col, text_col)
    found = stored(rows.select(*ROW_KEY, text_col).mapInArrow(
        _chunked(text_col, long), f"{ROW_KEY[0]} bigint, {ROW_KEY[1]} bigint, at int, c1 bigint, c2 bigint, before bigint, after bigint"), "chunks")
    # places differ if any part of them does
    parts = [f(c).alias(f"{c}_{f.__name__}") for c in (*ROW_KEY, "at") for f in (F.min, F.max)]
    again = (found.groupBy("c1", "c2").agg(*parts).where(" or ".join(f"{c}_min <> {c}_max" for c in (*ROW_KEY, "at"))).select("c1", "c2"))

    def match(at, size: int, *lines: str):
        return F.struct(F.expr(at).alias("at"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(lines)),
                        *([F.lit(0).cast("bigint").alias("k2")] if size == 2 else []), F.lit(size).alias("size"))

    grown = F.array(match("at", 2, "c1", "c2"), F.when(F.col("before").isNotNull(), match("at - 1", 3, "before", "c1", "c2")),
                    F.when(F.col("after").isNotNull(), match("at", 3, "c1", "c2", "after")))
    met = (found.join(again, ["c1", "c2"], "left_semi").select(*ROW_KEY, F.explode(grown).alias("g")).where("g is not null").select(*ROW_KEY, "g.*"))
    met = stored(met, "matches")
    key = ["k0", "k1", "k2", "size"]
    place = F.struct(*ROW_KEY, "at")
    firsts = met.groupBy(*key).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last")
    placed = met.join(firsts, key).select(*ROW_KEY, *key, (F.col("at").cast("bigint") * 4 + F.col("size")).alias("mark"),
                                          (place != F.col("first")).alias("later"))

    def marked(chosen: DataFrame) -> DataFrame:
        # a set: rows equal in id and text give equal marks, of which each row needs one
        return chosen.groupBy(*ROW_KEY).agg(F.collect_set("mark").alias("__hl_marks"))

    differ = (rows.join(marked(placed), ROW_KEY).mapInArrow(_line_bytes(text_col, long), "h bigint, content binary")
              .groupBy("h").agg(F.min("content").alias("a"), F.max("content").alias("b")).where("a <> b").select("h"))
    unequal = firsts.select(*key, F.explode(F.array("k0", "k1", "k2")).alias("h")).join(differ, "h").select(*key).distinct()
    marks = marked(placed.where("later").join(unequal, key, "left_anti"))
    out = T.StructType(list(docs.schema.fields))
    for c in COUNTS:
        out = out.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_rows(batches):
            texts, counts = [], []
            for t, found in zip(encoded(b[text_col]), b["__hl_marks"].to_pylist(), strict=True):
                parts, gaps = units(t, long)
                gone = _marked(found)
                counts.append((len(parts), len(gone), sum(i - 1 not in gone for i in gone)))
                texts.append(without(parts, gaps, gone) if gone else None)
            new = replaced(b, columns, text_col, chars_col, texts)
            extra = [pa.array(x, pa.int64()) for x in (zip(*counts, strict=True) if counts else ((), (), ()))]
            yield pa.RecordBatch.from_arrays([*new.columns, *extra], [*columns, *COUNTS])

    return rows.join(marks, ROW_KEY, "left").mapInArrow(run, out)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` without later copies of chunks; rows that lose their last word this way go."""
    done = remove_chunks(docs, id_col, text_col, chars_col)
    left = (F.col(COUNTS[1]) == 0) | F.col(text_col).rlike(r"[^\x20\x09-\x0D]")
    return done.where(left).drop(*COUNTS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 7 over all documents: doc_id, n_lines, n_removed_lines, n_removed_chunks, kept_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_chunks(docs).select("doc_id", *(F.col(c).alias(n) for c, n in zip(COUNTS, ("n_lines", "n_removed_lines", "n_removed_chunks"), strict=True)),
                                      F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
