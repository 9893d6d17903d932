r"""Quality rules with cross-document line frequency (operator 10).

Pass 1 hashes every line of every text in a normalised form (A-Z lower-cased, white space
collapsed; lines without a word are skipped), and Spark counts for each host and line the
distinct texts that hold it, so exact copies of one document count once.  A line is over
the limit if more than ``max_share`` of its host's distinct texts and more than
``min_docs`` of them hold it; the share decides at every size of host, the floor only rules
out chance (two copies of a text with one changed word).  Pass 2 removes these lines; a document that keeps less than
``min_kept`` percent of its words is depleted and rejected, as is one that fails the base
rules (too few words, too many words in repeated three-word windows).

Lines over the limit per host are bounded by (mean distinct lines of a text) / ``max_share``,
so a host's list is small; it is broadcast if the hosts are few by count, else joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm.common import arrow_rows, bounded_batches, encoded, small, stored

MIN_WORDS, MAX_REPEAT, MAX_SHARE, MIN_DOCS, MIN_KEPT = 50, 50, 0.1, 3, 30
SYMBOLS = b"#*$%&|<>"
LONGS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_frequent_lines", "n_kept_words"]


def _line_hash(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def repeat_words(words: list[bytes]) -> int:
    """Words in three-word windows found twice or more in the text, the first included."""
    n = len(words)
    if n < 4:
        return 0
    fresh, ids = count(), {}
    at = np.fromiter((ids[w] if w in ids else ids.setdefault(w, next(fresh)) for w in words), np.int64, n)
    pair = at[:-1] * len(ids) + at[1:]
    if len(ids) > 2_000_000:  # keep the product below 2**63
        pair = np.unique(pair, return_inverse=True)[1]
    _, inverse, found = np.unique(pair[:-1] * len(ids) + at[2:], return_inverse=True, return_counts=True)
    again = found[inverse] > 1
    mark = np.zeros(n, bool)
    for k in range(3):
        mark[k:n - 2 + k] |= again
    return int(mark.sum())


def measures(text: bytes, frequent: frozenset[int] | set[int]) -> tuple[list[int], bytes]:
    """``LONGS`` of a text, and the text without its lines over the limit."""
    words = text.split()
    seen: set[bytes] = set()
    dup = gone = kept_words = 0
    kept = []
    for line in text.split(b"\n"):
        own = line.split()
        if own:
            if line in seen:
                dup += 1
            seen.add(line)
            if frequent and _line_hash(line.lower().split()) in frequent:
                gone += 1
                continue
        kept_words += len(own)
        kept.append(line)
    chars = len(b"".join(words).decode())
    symbols = sum(text.count(bytes([c])) for c in SYMBOLS)
    return [len(words), chars, symbols, dup, repeat_words(words), gone, kept_words], b"\n".join(kept)


def _host(host_col: str):
    return F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit(""))


def frequent_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", max_share: float = MAX_SHARE,
                   min_docs: int = MIN_DOCS) -> DataFrame:
    """(``__hl_host``, ``__hl_lines`` array of line hashes) of hosts with lines over the limit."""
    bounded_batches(docs.sparkSession)
    read = docs.select(_host(host_col).alias("__hl_host"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("__hl_t"),
                       F.col(text_col).alias("__hl_x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_rows(batches):
            lines = [list({_line_hash(w) for x in t.lower().split(b"\n") if (w := x.split())}) for t in encoded(b["__hl_x"])]
            yield pa.RecordBatch.from_arrays([b["__hl_host"], b["__hl_t"], pa.array(lines, pa.list_(pa.int64()))],
                                             ["__hl_host", "__hl_t", "lines"])

    lines = stored(read.mapInArrow(run, "__hl_host string, __hl_t bigint, lines array<bigint>"), "lines")
    texts = lines.groupBy("__hl_host", "__hl_t").agg(F.lit(1).alias("one")).groupBy("__hl_host").agg(F.count("one").alias("texts"))
    held = (lines.select("__hl_host", "__hl_t", F.explode("lines").alias("line")).distinct()
            .groupBy("__hl_host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_docs))
    over = held.join(small(texts), "__hl_host").where(F.col("n") > max_share * F.col("texts"))
    return stored(over.groupBy("__hl_host").agg(F.collect_set("line").alias("__hl_lines")), "frequent")


def _judged(docs: DataFrame, columns: list[str], host_col: str, text_col: str, limits: dict, out, emit) -> DataFrame:
    lines = frequent_lines(docs, host_col, text_col, limits["max_share"], limits["min_docs"])
    read = docs.select(*columns, _host(host_col).alias("__hl_host")).join(small(lines, 5_000), "__hl_host", "left").drop("__hl_host")
    min_words, max_repeat, min_kept = limits["min_words"], limits["max_repeat"], limits["min_kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_rows(batches):
            found, texts, failed, kept = [], [], [], []
            for t, over in zip(encoded(b[text_col]), b["__hl_lines"].to_pylist(), strict=True):
                m, rest = measures(t, set(over or ()))
                bad = m[0] < min_words or 100 * m[4] > max_repeat * m[0]
                found.append(m)
                texts.append(rest if m[5] else None)
                failed.append(bad)
                kept.append(not bad and 100 * m[6] >= min_kept * m[0])
            yield emit(b, found, texts, failed, kept)

    return read.mapInArrow(run, out)


def verdicts(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text",
             min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT, max_share: float = MAX_SHARE,
             min_docs: int = MIN_DOCS, min_kept: int = MIN_KEPT) -> DataFrame:
    """One row per row: ``id_col``, the counts of ``LONGS``, ``base_failed``, ``kept``.

    A null text counts as empty (no words: it fails), null hosts form one host, repeated
    rows get equal verdicts and count once in line frequencies.  Empty table: no rows.
    """
    limits = {"min_words": min_words, "max_repeat": max_repeat, "max_share": max_share, "min_docs": min_docs, "min_kept": min_kept}
    out = docs.select(id_col).schema
    for c in LONGS:
        out = out.add(c, "long")
    out = out.add("base_failed", "boolean").add("kept", "boolean")

    def emit(b, found, texts, failed, kept):
        cols = [pa.array([m[i] for m in found], pa.int64()) for i in range(len(LONGS))]
        return pa.RecordBatch.from_arrays([b[id_col], *cols, pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())],
                                          [id_col, *LONGS, "base_failed", "kept"])

    return _judged(docs, [id_col, text_col], host_col, text_col, limits, out, emit)


def apply_rules(docs: DataFrame, host_col: str = "source", text_col: str = "text", chars_col: str = "n_chars",
                min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT, max_share: float = MAX_SHARE,
                min_docs: int = MIN_DOCS, min_kept: int = MIN_KEPT) -> DataFrame:
    """The kept rows with all columns, their texts without lines over the limit; where a
    text changes, ``chars_col`` (if there is such a column) gets its new length."""
    limits = {"min_words": min_words, "max_repeat": max_repeat, "max_share": max_share, "min_docs": min_docs, "min_kept": min_kept}

    columns = docs.columns

    def emit(b, found, texts, failed, kept):
        return replaced(b, columns, text_col, chars_col, texts).filter(pa.array(kept, pa.bool_()))

    return _judged(docs, columns, host_col, text_col, limits, docs.schema, emit)


def replaced(b: pa.RecordBatch, columns: list[str], text_col: str, chars_col: str, texts: list[bytes | None]) -> pa.RecordBatch:
    """``columns`` of a batch; where ``texts`` is not None, it is the new text."""
    new = pa.array([None if t is None else t.decode() for t in texts], pa.string())
    cols = {c: b[c] for c in columns}
    changed = pc.is_valid(new)
    kind = cols[text_col].type
    cols[text_col] = pc.if_else(changed, new.cast(kind), cols[text_col])
    if chars_col in cols:
        cols[chars_col] = pc.if_else(changed, pc.utf8_length(new).cast(cols[chars_col].type), cols[chars_col])
    return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 10 over all documents."""
    return verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
grams AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n
  FROM (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1),
               lambda j: ws[j] || ' ' || ws[j + 1] || ' ' || ws[j + 2])) AS g
        FROM d WHERE len(ws) >= 3)),
rep AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM grams, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1 GROUP BY rid),
lines AS (
  SELECT rid, source, t, line, len(lw) AS n,
         array_to_string(lw, ' ') AS norm
  FROM (SELECT rid, source, t, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS lw
        FROM (SELECT rid, source, t, unnest(string_split(t, chr(10))) AS line FROM d))
  WHERE len(lw) > 0),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY rid),
hosts AS (SELECT source, count(DISTINCT t) AS texts FROM d GROUP BY source),
freq AS (
  SELECT f.source, f.norm FROM (SELECT source, norm, count(DISTINCT t) AS n FROM lines GROUP BY ALL) f
  JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source WHERE f.n > 3 AND f.n > 0.1 * h.texts),
gone AS (
  SELECT rid, count(*) AS n_frequent_lines, sum(n) AS gone_words FROM lines l
  JOIN freq f ON l.source IS NOT DISTINCT FROM f.source AND l.norm = f.norm GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_frequent_lines, 0) AS n_frequent_lines,
         CAST(len(ws) - coalesce(gone_words, 0) AS BIGINT) AS n_kept_words
  FROM d LEFT JOIN rep USING (rid) LEFT JOIN dups USING (rid) LEFT JOIN gone USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_kept_words >= 30 * n_words AS kept
FROM m
"""
