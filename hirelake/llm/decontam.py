"""Benchmark decontamination (operator 1), with DataFrame functions only.

Windows of as many words as an item has are taken from every text, fingerprinted by the
SimHash of their shingles, matched to item fingerprints by a multi-index over 8 blocks of
8 bits, and confirmed by the exact similarity of their shingle multisets (weights are
occurrences): shared / (window + item - shared) >= ``threshold``.

*Which windows.*  A window can reach the threshold only if it holds most of the item's
shingles; of any ``spare`` + 1 of the item's shingle occurrences it must hold one.  So each
item offers its ``spare`` + 1 shingles that are rarest among the items, and only windows
around a text's hits on those are fingerprinted.  That drops no window above the threshold.

*Multi-index.*  Fingerprints within ``radius`` = 23 bits differ by at most 2 bits in one of
the 8 blocks; items are stored under all values within 2 bits of each block, so a window
finds every item fingerprint within the radius by equi-joins; a pair counts at its first
such block only.  Windows of equal similarity differ by about 10 bits at 0.8 and 64 bits.

All work on a text happens in one pass over it without a shuffle; items (small, their
number is checked) are broadcast, else the joins shuffle by shingle and block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm.common import ROW_KEY, small, stored, with_row_key

SHINGLE, THRESHOLD, BLOCKS, NEAR = 5, 0.8, 8, 2
RADIUS = BLOCKS * (NEAR + 1) - 1
#: The index has 296 narrow rows for each item; up to so many it is broadcast (about 10 MB).
INDEX_ROWS = 200_000


#: What stands between words: ASCII and Latin-1 characters other than letters and digits,
#: general punctuation and CJK punctuation.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\xBF\xD7\xF7\u2000-\u206F\u3000-\u303F]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits (of all but ``GAP``)."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP), "")


def _shingles(w: Column, size: Column | int) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    last = F.size(w) - size + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
                                         lambda i: F.array_join(F.slice(w, i, size), " "))).otherwise(F.array().cast("array<string>"))


def simhash(df: DataFrame, hashes: str, out: str, lane: int) -> DataFrame:
    """Adds the SimHash of an array of longs: a bit is set if over half of them have it.

    The 64 counters are kept in ``lane``-bit lanes of ``lane`` longs; the lanes hold up to
    2**(lane - 1) - 1 hashes."""
    mask = sum(1 << i for i in range(0, 64, lane))

    def lanes(k: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("bigint"), lambda a, x: a + F.shiftrightunsigned(x, k).bitwiseAND(F.lit(mask)))

    sums = {f"__hl_s{k}": lanes(k) for k in range(lane)}
    df = df.withColumns(sums).withColumn("__hl_half", F.size(hashes))
    bits = [F.when(F.shiftrightunsigned(F.col(f"__hl_s{k}"), at).bitwiseAND(F.lit((1 << lane) - 1)) * 2 > F.col("__hl_half"),
                   F.lit((1 << at + k) - (1 << 64 if at + k == 63 else 0))).otherwise(F.lit(0).cast("bigint"))
            for at in range(0, 64, lane) for k in range(lane)]
    return df.withColumn(out, reduce(lambda a, b: a.bitwiseOR(b), bits)).drop(*sums, "__hl_half")


def _block(fp: Column, i) -> Column:
    return F.shiftrightunsigned(fp, i * 8 if isinstance(i, int) else i).bitwiseAND(F.lit(255))


def item_table(items: DataFrame, item_col: str, text_col: str, threshold: float) -> DataFrame:
    """One row per item with a word: id, words' number, shingles, their length and anchors.
    Equal rows count once; items that share an id stay apart."""
    it = items.select(F.col(item_col).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0).distinct()
    it = it.select("item", F.size("w").alias("len"), F.least(F.size("w"), F.lit(SHINGLE)).alias("k"), "w")
    it = it.withColumn("sh", _shingles(F.col("w"), F.col("k"))).withColumn("m", F.size("sh")).drop("w")
    it = it.withColumn("once", F.size(F.array_distinct("sh")) == F.col("m"))
    each = it.select("*", F.explode("sh").alias("s"))
    often = each.groupBy("s").agg(F.count(F.lit(1)).alias("c"))
    # A window of the item's length misses at most m - 2tm/(1+t) of its shingles; a text
    # shorter than the item is one window and misses at most m - tm.
    at_most = lambda share: F.col("m") - F.ceil(F.col("m") * F.lit(share) - 1e-9)
    return (each.join(often, "s").groupBy("item", "len", "k", "sh", "m", "once")
            .agg(F.sort_array(F.collect_list(F.struct("c", F.xxhash64("s").alias("h"), "s"))).alias("rare"))
            .select("item", "len", "k", "sh", "m", "once",
                    F.slice("rare", F.lit(1), (at_most(2 * threshold / (1 + threshold)) + 1).cast("int")).alias("full"),
                    F.slice("rare", F.lit(1), (at_most(threshold) + 1).cast("int")).alias("short")))


def matches(docs: DataFrame, items: DataFrame, keys: list[str] | None = None, text_col: str = "text", item_col: str = "item_id",
            item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(``keys``, ``item_id``, ``similarity``, ``distance``, ``start_word``, ``n_words``) of
    the best window of each text and item at or above ``threshold`` (the most similar, then
    the first); texts without one have no row.

    Words are lower-cased runs of letters and digits.  Null and empty texts and items match
    nothing.  A text shorter than an item is one window; items of fewer than five words are
    one shingle.  Rows with equal keys are reported as one, items with equal ids too.
    Empty tables: no rows."""
    keys = keys or ["doc_id"]
    own = [f"__hl_k{i}" for i in range(len(keys))]
    table = stored(item_table(items, item_col, item_text_col, threshold), "items")
    shape = table.agg(F.collect_set("k").alias("k"), F.max("m").alias("m")).first()
    read = docs.select(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True)), words(F.col(text_col)).alias("w"))
    lane = next(x for x in (8, 16, 32) if (shape.m or 1) < 1 << x - 1)
    hits = None
    for k in sorted(shape.k):  # at most five shingle lengths, all but one from items of under five words
        # The outer form keeps Spark from inferring a filter that would split every text twice.
        every = F.when(F.size("w") >= k, F.sequence(F.lit(1), F.greatest(F.size("w") - (k - 1), F.lit(1))))
        at = read.select(*own, "w", F.explode_outer(every).alias("i")).where("i is not null")
        at = at.withColumn("s", F.xxhash64(*(F.element_at("w", F.col("i") + j) for j in range(k))))
        anchors = (table.where(F.col("k") == k).select("len", "k", "m", F.explode(F.array_union("full", "short")).alias("a"),
                                                        F.array_contains(F.transform("full", lambda x: x["s"]), F.col("a.s")).alias("full"))
                   .withColumn("p", F.split("a.s", " ")).withColumn("s", F.xxhash64(*(F.element_at("p", j + 1) for j in range(k))))
                   .groupBy("len", "k", "m", "s").agg(F.max("full").alias("full")))
        found = (at.join(small(anchors), "s").where(F.col("full") | (F.size("w") < F.col("len")))
                 .select(*own, "len", "k", "i", "m", F.size("w").alias("n"),
                         F.greatest(F.col("i") - F.col("m"), F.lit(0)).alias("from"), "w")
                 .select(*own, "len", "k", "n", "from", F.least(F.col("i") - 1, F.greatest(F.col("n") - F.col("len"), F.lit(0))).alias("to"),
                         F.slice("w", F.col("from") + 1, 2 * F.col("len")).alias("w")))
        hits = found if hits is None else hits.union(found)
    if hits is None:
        empty = docs.select(*keys).limit(0)
        return empty.select("*", F.lit(0).cast("bigint").alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("distance"),
                            F.lit(0).alias("start_word"), F.lit(0).alias("n_words"))
    # One row per window; short texts have their whole as the only one.
    at = hits.withColumn("ch", _shingles(F.col("w"), F.col("k"))).withColumn("h", F.transform("ch", lambda x: F.xxhash64(x)))
    at = at.withColumn("start", F.explode(F.sequence("from", "to"))).withColumn("size", F.least("len", "n"))
    many = F.col("size") - F.col("k") + 1
    at = at.select(*own, "len", "k", "start", "size", F.slice("ch", F.col("start") - F.col("from") + 1, many).alias("ws"),
                   F.slice("h", F.col("start") - F.col("from") + 1, many).alias("wh"))
    at = simhash(at, "wh", "fp", lane).drop("wh")
    marked = simhash(table.withColumn("h", F.transform("sh", lambda x: F.xxhash64(x))), "h", "ifp", lane).drop("h")
    near = marked.select("item", "len", "ifp", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"))
    near = (near.select("*", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("value"))
            .where(F.bit_count(F.col("value").cast("bigint").bitwiseXOR(_shift(F.col("ifp"), F.col("block")))) <= NEAR))
    blocks = F.explode(F.array(*(F.struct(F.lit(i).alias("block"), _block(F.col("fp"), i).cast("int").alias("value")) for i in range(BLOCKS))))
    pairs = (at.select("*", blocks.alias("b")).select(*own, "len", "start", "size", "ws", "fp", "b.block", "b.value")
             .join(small(near, INDEX_ROWS), ["len", "block", "value"])
             .withColumn("diff", F.col("fp").bitwiseXOR(F.col("ifp"))))
    first = reduce(lambda a, b: a & b, ((F.col("block") <= i) | (F.bit_count(_block(F.col("diff"), i)) > NEAR) for i in range(BLOCKS)))
    pairs = pairs.where(first & (F.bit_count("diff") <= RADIUS)).join(small(marked.select("item", "ifp", "sh", "once").distinct()), ["item", "ifp"])
    both = F.array_intersect("ws", "sh")
    count = lambda a, x: F.size(F.filter(a, lambda y: y == x))
    shared = F.aggregate(both, F.lit(0), lambda a, x: a + F.least(count(F.col("ws"), x), count(F.col("sh"), x)))
    # An item without repeated shingles shares each one once.
    pairs = pairs.withColumn("shared", F.when(F.col("once"), F.size(both)).otherwise(shared))
    like = F.col("shared") / (F.size("ws") + F.size("sh") - F.col("shared"))
    best = F.struct(like.alias("similarity"), (-F.col("start")).alias("start"), F.bit_count("diff").alias("distance"), F.col("size").alias("n"))
    return (pairs.select(*own, "item", best.alias("best")).groupBy(*own, "item").agg(F.max("best").alias("best"))
            .where(F.col("best.similarity") >= threshold)
            .select(*(F.col(o).alias(k) for k, o in zip(keys, own, strict=True)), F.col("item").alias("item_id"), "best.similarity",
                    "best.distance", (-F.col("best.start")).alias("start_word"), F.col("best.n").alias("n_words")))


def _shift(fp: Column, block: Column) -> Column:
    """Byte ``block`` (a column) of a long."""
    return F.expr("shiftrightunsigned(ifp, block * 8)").bitwiseAND(F.lit(255))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """``docs`` without the rows that match an item; all columns stay."""
    keyed = with_row_key(docs, id_col, text_col)
    found = stored(matches(keyed, items, ROW_KEY, text_col, **more).select(*ROW_KEY).distinct(), "contaminated")
    return keyed.join(small(found), ROW_KEY, "left_anti").drop(*ROW_KEY)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1: all documents against all benchmark items."""
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
