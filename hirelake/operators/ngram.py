"""Substring matching of many patterns against many texts.

Semantics of one pair: ``lower(text) LIKE '%' || lower(pattern) || '%'`` — a
case-insensitive substring test in which ``%`` and ``_`` typed by the user act as
wildcards and a backslash takes the next character literally (a last one takes the
closing ``%``).

Two physical strategies, same answer for every pattern:

* ``ngram`` (default): bitmap posting lists.  The index holds, for every distinct unigram
  and bigram of the lower-cased texts and every block of 32,768 ids, one bitmap of the ids
  whose text has the gram.  A pattern's literal pieces, with escapes resolved, yield the
  grams that any match must contain; the bitmaps of *all* of them are intersected block by
  block, and only the ids that are left are verified on their texts.  Candidates are a
  superset of the matches, so the result is exact.
  Texts are dealt out by id block once and their grams never move.  A stored index is
  partitioned by gram bucket, so that a lookup reads only the buckets of its grams, and it
  grows by appending: bitmaps that several batches wrote for one gram and block are united
  when they are read.  A gram of very many texts is many blocks, each of 4 KB at most.
  Patterns without a literal character match by length alone.
* ``scan``: every text is read once by an automaton of the patterns (``automaton``); those with
  wildcards are broadcast and tested one by one, which is for a few of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import automaton

WILDCARDS = r"[%_]"
# a wildcard after an even number of backslashes
_OPEN_WILDCARD = r"(?<=(?<!\\)(?:\\\\){0,200})[%_]"
_ODD_END = r"(?<!\\)(?:\\\\)*\\$"
BUCKETS = 64  # partitions of a stored index
BLOCK = 32_768  # ids of a bitmap (Spark's bitmap functions)
BITMAPS = 4_096  # bitmaps that a task builds at a time
# a pattern table, or the candidates, are broadcast only if a count finds no more rows
BROADCAST_PATTERNS, BROADCAST_PAIRS = 20_000, 500_000


def _grams_of(lowered: Column) -> Column:
    """Distinct unigrams and bigrams of a lower-cased string (array<string>)."""
    n = F.length(lowered)
    uni = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(lowered, i, 1))
    bi = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(lowered, i, 2))
    out = F.array_distinct(F.concat(uni, F.filter(bi, lambda g: F.length(g) == 2)))
    return F.when(n > 0, F.filter(out, lambda g: F.length(g) > 0)).otherwise(F.array().cast("array<string>"))


def gram_rows(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(tid, gram): one row per distinct gram of each text; ``text_col`` may be an array
    of texts of one id, whose grams count once."""
    if texts.schema[text_col].dataType.typeName() == "array":
        grams = F.array_distinct(F.flatten(F.transform(F.col(text_col), lambda t: _grams_of(F.lower(t)))))
    else:
        grams = _grams_of(F.lower(F.col(text_col)))
    return texts.select(F.col(id_col).cast("bigint").alias("tid"), F.explode(grams).alias("gram"))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, gram, bits) of each Arrow batch of (block, at, texts): a distinct text's grams
    are cut once, and the places of a gram are set in one bitmap."""
    for b in batches:
        lists = b["texts"]
        where = np.repeat(np.arange(b.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        texts = lists.flatten().dictionary_encode()
        known = texts.is_valid().to_numpy(zero_copy_only=False)
        code = texts.indices.fill_null(0).to_numpy(zero_copy_only=False)[known]
        block, at = b["block"].to_numpy()[where[known]], b["at"].to_numpy()[where[known]]
        ids: dict[str, int] = {}
        cut = [sorted({ids.setdefault(t[i:i + n], len(ids)) for n in (1, 2) for i in range(len(t) - n + 1)}) for t in texts.dictionary.to_pylist()]
        names = pa.array(list(ids), pa.string())
        count = np.array([len(c) for c in cut], np.int64)
        flat = np.array([g for c in cut for g in c], np.int64)
        start = np.cumsum(count) - count
        for k in np.unique(block):
            here, places = code[block == k], at[block == k]
            n = count[here]
            row = np.repeat(np.arange(len(here)), n)
            gram = flat[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + start[here][row]]
            held, line = np.unique(gram, return_inverse=True)
            for lo in range(0, len(held), BITMAPS):
                part = (line >= lo) & (line < lo + BITMAPS)
                bits = np.zeros((min(BITMAPS, len(held) - lo), BLOCK // 8), np.uint8)
                place = places[row[part]]
                np.bitwise_or.at(bits, (line[part] - lo, place >> 3), (1 << (place & 7)).astype(np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bits), k), pa.int64()), names.take(pa.array(held[lo:lo + BITMAPS])),
                                                  pa.array([x.tobytes() for x in bits], pa.binary())], ["block", "gram", "bits"])


def gram_index(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, gram, bits): the bitmap posting lists.  Ids are integers; an id may have
    several rows.  The one shuffle deals the texts out by block; a task reads them block by
    block in Arrow batches and makes each batch's bitmaps, which are united.  What is held at
    a time is a batch, however many ids a block or texts an id has; no gram is a row."""
    tid = F.col(id_col).cast("bigint")
    several = texts.schema[text_col].dataType.typeName() == "array"
    lowered = F.transform(F.col(text_col), lambda t: F.lower(t)) if several else F.array(F.lower(F.col(text_col)))
    rows = texts.select(F.bitmap_bucket_number(tid).alias("block"), F.bitmap_bit_position(tid).alias("at"), lowered.alias("texts"))
    dealt = rows.where("block is not null").repartition("block").sortWithinPartitions("block")
    parts = dealt.mapInArrow(_bitmaps, "block bigint, gram string, bits binary")
    return parts.groupBy("block", "gram").agg(F.bitmap_or_agg("bits").alias("bits"))


def _bucket(gram) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def append_index(index: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Add bitmaps to a stored index; what was there is not read or rewritten.  Range
    partitions include the block, so a gram of very many texts is written by many tasks."""
    (index.withColumn("bucket", _bucket("gram")).repartitionByRange("bucket", "gram", "block")
     .sortWithinPartitions("bucket", "gram", "block").write.mode(mode).option("compression", "zstd").partitionBy("bucket").parquet(path))
    return index.sparkSession.read.parquet(path)


def store_index(index: DataFrame, path: str) -> DataFrame:
    """The index as a stored table, replacing what was at ``path``."""
    return append_index(index, path, "overwrite")


def _explode_ids(lists: DataFrame, out: str) -> DataFrame:
    """One row for each id of the bitmaps ``bits`` of ``block``.  Words of 64 bits without
    a set bit are skipped before bits are looked at; both steps are generated code."""
    kept = [c for c in lists.columns if c not in ("block", "bits")]
    word = F.substring("bits", F.col("_w") * 8 + 1, F.lit(8))
    words = lists.withColumn("_w", F.explode(F.sequence(F.lit(0), F.lit(BLOCK // 64 - 1)))).where(word != F.lit(bytes(8)))
    # bit b of byte k stands for place 8k + b; the word is read with byte 0 highest
    words = words.select(*kept, "block", "_w", F.conv(F.hex(word), 16, -10).cast("bigint").alias("_bits"))
    shift = (F.lit(7) - F.shiftright("_i", 3)) * 8 + F.col("_i").bitwiseAND(7)
    bits = words.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(63)))).where(F.getbit("_bits", shift) == 1)
    at = F.col("_w") * 64 + F.col("_i")
    return bits.select(*kept, F.when(F.col("block") > 0, (F.col("block") - 1) * BLOCK + at + 1).otherwise(F.col("block") * BLOCK - at).alias(out))


def _closed(pattern: Column) -> Column:
    """A backslash at the very end takes the ``%`` that closes the LIKE pattern."""
    return F.when(pattern.rlike(_ODD_END), F.concat(pattern, F.lit("%"))).otherwise(pattern)


def _required_grams(pattern_lower: Column, literal: bool = False) -> Column:
    """Grams every match must contain: unigram of 1-char pieces, bigrams of longer ones."""
    if literal:
        pieces = F.array(pattern_lower)
    else:
        pieces = F.transform(F.split(_closed(pattern_lower), _OPEN_WILDCARD),
                             lambda p: F.regexp_replace(p, r"(?s)\\(.)", "$1"))
    pieces = F.filter(pieces, lambda p: F.length(p) > 0)

    def piece_grams(p):
        n = F.length(p)
        bi = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(p, i, 2))
        return F.when(n == 1, F.array(p)).otherwise(bi)

    return F.array_distinct(F.flatten(F.transform(pieces, piece_grams)))


def verify(text: Column, pattern: Column, literal: bool = False) -> Column:
    """Exact predicate: case-insensitive substring, with user wildcards unless literal."""
    lt, lp = F.lower(text), F.lower(pattern)
    if literal:
        return F.instr(lt, lp) > 0
    # Spark's LIKE allows an escape before wildcards and itself only; elsewhere it is redundant
    plain = F.regexp_replace(lp, r"(?<!\\)((?:\\\\)*)\\([^%_\\])", "$1$2")
    like = F.like(lt, F.concat(F.lit("%"), plain, F.lit("%")))
    return F.when(lp.rlike(WILDCARDS + r"|\\"), like).otherwise(F.instr(lt, lp) > 0)


def scan_pairs(patterns: DataFrame, texts: DataFrame, pid: str = "pid", pattern: str = "pattern",
               tid: str = "tid", text: str = "text", literal: bool = False) -> DataFrame:
    """Every text is read once, where it is: the patterns without wildcards are compiled into an
    automaton, the others tested one by one (the caller guarantees that they are few)."""
    p = patterns.select(F.col(pid).alias("_pid"), F.col(pattern).alias("_pat"), F.lower(F.col(pattern)).alias("_low"))
    t = texts.select(F.col(tid).alias("_tid"), F.col(text).alias("_txt"))
    several = texts.schema[text].dataType.typeName() == "array"
    p = materialize(p, "patterns")
    wild = F.lit(False) if literal else F.col("_low").rlike(WILDCARDS + r"|\\")
    plain = p.where(~wild)
    lowered = t.withColumn("_txt", F.transform("_txt", F.lower) if several else F.lower("_txt"))
    few = F.broadcast if plain.limit(BROADCAST_PATTERNS + 1).count() <= BROADCAST_PATTERNS else (lambda df: df)
    pairs = automaton.Terms(plain, "_low").hits(lowered, "_tid", "_txt", "_low").join(few(plain), "_low").select("_pid", "_tid")
    if not p.where(wild).isEmpty():
        test = lambda x: verify(x, F.col("_pat"), literal)
        odd = t.join(F.broadcast(p.where(wild)), F.exists("_txt", test) if several else test(F.col("_txt")), "inner")
        pairs = pairs.unionByName(odd.select("_pid", "_tid"))
    return pairs.select(F.col("_pid").alias(pid), F.col("_tid").alias(tid))


def candidates(asked: DataFrame, index: DataFrame) -> DataFrame:
    """(``_pid``, ``_pat``, ``_tid``): texts that hold every one of a pattern's ``_grams``.
    ``asked`` is stored; a table of many patterns is not broadcast but shuffled."""
    mark = F.broadcast if asked.count() <= BROADCAST_PATTERNS else (lambda df: df)
    each = asked.select("_pid", "_pat", F.size("_grams").alias("_n"), F.explode("_grams").alias("gram"))
    needed, on = each.select("gram").distinct(), ["gram"]
    if "bucket" in index.columns:  # a stored index: the join prunes its partitions
        needed, on = needed.withColumn("bucket", _bucket("gram")), ["bucket", "gram"]
    # dealt out by block once: lists of several batches unite, then a pattern's grams intersect
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = (index.join(mark(needed), on).select("block", "gram", "bits").repartition(parts, "block")
             .groupBy("block", "gram").agg(F.bitmap_or_agg("bits").alias("bits")))
    both = (lists.join(mark(each), "gram").groupBy("block", "_pid", "_pat", "_n")
            .agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("_held")))
    return _explode_ids(both.where("_held = _n").select("_pid", "_pat", "block", "bits"), "_tid")


def ngram_pairs(patterns: DataFrame, texts: DataFrame, index: DataFrame | None = None, pid: str = "pid", pattern: str = "pattern",
                tid: str = "tid", text: str = "text", literal: bool = False) -> DataFrame:
    """Index strategy (exact).  ``index`` may be prebuilt and stored; it may cover more
    texts than ``texts``, whose text column may be an array of texts of one id.

    The patterns with their grams and the candidates are stored once.  Few candidates (by
    count) are broadcast to the texts, which then are scanned without a shuffle."""
    if index is None:
        index = gram_index(texts, tid, text)
    p = materialize(patterns.select(F.col(pid).alias("_pid"), F.col(pattern).alias("_pat"))
                    .withColumn("_grams", _required_grams(F.lower(F.col("_pat")), literal)), "patterns")
    t = texts.select(F.col(tid).alias("_tid"), F.col(text).alias("_txt"))
    several = texts.schema[text].dataType.typeName() == "array"

    def held(test):
        return F.exists("_txt", test) if several else test(F.col("_txt"))

    cand = materialize(candidates(p.where(F.size("_grams") > 0), index), "candidates")
    if cand.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS:
        cand = F.broadcast(cand)
    pairs = t.join(cand, "_tid").where(held(lambda x: verify(x, F.col("_pat"), literal))).select("_pid", "_tid")
    wild = p.where(F.size("_grams") == 0)
    if wild.limit(1).count():
        # only wildcards: their few distinct lengths meet the texts
        wild = wild.select("_pid", (F.lit(0) if literal else F.length(F.regexp_replace("_pat", "[^_]", ""))).alias("_n"))
        lengths = F.broadcast(wild.select("_n").distinct())
        by_length = t.join(lengths, held(lambda x: F.length(x) >= F.col("_n"))).select("_tid", "_n").join(wild, "_n").select("_pid", "_tid")
        pairs = pairs.unionByName(by_length)
    return pairs.select(F.col("_pid").alias(pid), F.col("_tid").alias(tid))


def substring_pairs(patterns: DataFrame, texts: DataFrame, method: str = "ngram", **kw) -> DataFrame:
    """(pid, tid) for every pattern contained in a text (see module doc)."""
    if method == "scan":
        keep = {k: v for k, v in kw.items() if k in ("pid", "pattern", "tid", "text", "literal")}
        return scan_pairs(patterns, texts, **keep)
    return ngram_pairs(patterns, texts, **kw)
