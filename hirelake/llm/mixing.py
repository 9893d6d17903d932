r"""Mixing sources to target weights (operator 2).

Targets: sources in code point order (null last) weigh ``weights`` in turn and share
``share`` times all words; a target stops at ``cap`` times its source's words and the
excess is shared again by weight (water-filling, computed as a level by windows over the
table of sources).

Taking: each source is a histogram of exact document lengths.  Whole rounds of the source
come first.  What is left is a share of the source, and every stretch of lengths gives that
share of its documents: the running count over the lengths, times the share, plus a seeded
offset, is rounded down, and a length takes the steps that fall in it (systematic rounding;
a length that occurs once is taken with that chance).  This misses the target by less than
about the longest document.  An excess is undone by the shortest taken document that covers
it, and the budget that remains is filled by a bounded knapsack by dynamic programming, long
lengths first, for the largest sum that fits, so that few documents are moved for it (up to
a few taken ones may be exchanged for it).  Each
length's documents are then chosen by seeded hash.  Groups of one source and length are
ranked in salted parts of about ``PART`` rows, so a hot length does not meet in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hirelake.llm.common import small, stored, with_row_key, ROW_KEY

WEIGHTS, SHARE, CAP, SEED, PART = (3.0, 1.0, 2.0), 1.5, 2, "mix", 20_000
#: So many documents of a source may be exchanged by the knapsack, the fewest that fit.
FREE = (0, 1, 2, 4, 8)


def knapsack(sizes: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each size to take so that their sum is the largest one <= ``budget``.

    ``reached[v]`` is the first bundle (a power-of-two number of one size) that made the
    sum v; sums it was built on were reached by earlier bundles, so no bundle counts twice."""
    take = [0] * len(sizes)
    reached = np.full(budget + 1, -1, np.int32)
    reached[0] = 0
    bundles: list[tuple[int, int]] = [(0, 0)]
    for i, (size, left) in enumerate(zip(sizes, counts, strict=True)):
        left, step = min(left, budget // size), 1
        while left and reached[budget] < 0:
            n = min(step, left)
            left -= n
            step *= 2
            if n * size <= budget:
                fresh = np.flatnonzero((reached[:budget + 1 - n * size] >= 0) & (reached[n * size:] < 0)) + n * size
                reached[fresh] = len(bundles)
                bundles.append((i, n))
        if reached[budget] >= 0:
            break
    v = int(np.flatnonzero(reached >= 0)[-1])
    while v:
        i, n = bundles[reached[v]]
        take[i] += n
        v -= n * sizes[i]
    return take


def plan_source(sizes: list[int], counts: list[int], target: float, cap: int, offset: float = 0.5,
                reserve: int = 1 << 16) -> tuple[int, list[int]]:
    """(rounds of the whole source, further documents of each of the ascending sizes).

    A rest above ``reserve`` words (texts longer than that) takes the longest that fit
    before the knapsack, whose table it bounds."""
    total = sum(s * c for s, c in zip(sizes, counts, strict=True))
    if not total:
        return 0, [0] * len(sizes)
    rounds = min(int(target // total), cap)
    rest = max(0, round(target - rounds * total)) if rounds < cap else 0
    worded = [c if s else 0 for s, c in zip(sizes, counts, strict=True)]
    steps = np.floor(np.cumsum([0, *worded]) * (rest / total) + offset).astype(np.int64)
    take = [min(n, c) for n, c in zip(np.diff(steps).tolist(), worded, strict=True)]
    budget = rest - sum(s * t for s, t in zip(sizes, take, strict=True))
    while budget < 0:
        taken = [i for i, n in enumerate(take) if n]
        i = next((i for i in taken if sizes[i] >= -budget), taken[-1])
        take[i] -= 1
        budget += sizes[i]
    order = [i for i in range(len(sizes) - 1, -1, -1) if sizes[i]]
    for i in order:
        n = min(counts[i] - take[i], max(0, budget - reserve) // sizes[i])
        take[i] += n
        budget -= n * sizes[i]
    # Without an exact fit, one, two and more taken documents, spread over the lengths, may be exchanged.
    best, short = take, budget
    for free in FREE:
        trial, room = list(take), budget
        upto = np.cumsum(take)
        for j in range(free if upto[-1] else 0):
            i = int(np.searchsorted(upto, (2 * j + 1) * int(upto[-1]) // (2 * free), "right"))
            if trial[i] and room + sizes[i] <= reserve:
                trial[i] -= 1
                room += sizes[i]
        left = [counts[i] - trial[i] for i in order]
        room_for = min(room, sum(sizes[i] * n for i, n in zip(order, left, strict=True)))
        for i, n in zip(order, knapsack([sizes[i] for i in order], left, room_for), strict=True):
            trial[i] += n
            room -= n * sizes[i]
        if room < short or not free:
            best, short = trial, room
        if not short:
            break
    return rounds, best


def targets(histogram: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """histogram(src, none, size, n) -> (src, source_size long, target double)."""
    by = histogram.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    turn = Window.orderBy(F.col("src") == "", "src")  # one row per source
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.row_number().over(turn) - 1) % len(weights)) + 1)
    by = by.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    full = Window.orderBy(F.col("most") / F.col("w"), "src")
    everything = Window.partitionBy(F.lit(1))
    # The level is reached once all sources before a row are full; it is the largest such quotient.
    before = F.coalesce(F.sum("most").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("w").over(full.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - before) / after)
    by = by.withColumn("level", F.max("level").over(everything))
    return by.select("src", "source_size", F.least("most", F.col("level") * F.col("w")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights=WEIGHTS,
        share: float = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """``docs`` plus ``size`` (words), ``source_size``, ``target``, ``copies`` (0 to ``cap``)
    and ``taken`` (words, repeats counted); columns of these names are replaced.

    A null text has size 0; documents of size 0 and sources without words give nothing.  A
    null source is a source of its own, after all others.  Repeated rows are documents of
    their own.  Ties in the seeded hash go by id and text hash.  Empty table: no rows."""
    added = ("size", "source_size", "target", "copies", "taken")
    kept = [c for c in docs.columns if c.lower() not in added or c in (id_col, source_col, text_col)]
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    src = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    rows = with_row_key(docs.select(*kept), id_col, text_col).withColumns({"__hl_size": size, "__hl_src": src})
    histogram = stored(rows.groupBy(F.col("__hl_src").alias("src"), F.col("__hl_size").alias("size")).agg(F.count(F.lit(1)).alias("n")), "lengths")
    goal = stored(targets(histogram, weights, share, cap), "targets")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        offset = xxhash.xxh64_intdigest(f"{seed}{pdf['src'].iloc[0]}") / 2**64
        rounds, more = plan_source(pdf["size"].tolist(), pdf["n"].tolist(), float(pdf["target"].iloc[0]), cap, offset)
        return pdf.assign(rounds=rounds, more=more)

    plan = (histogram.join(small(goal), "src").groupBy("src")
            .applyInPandas(fill, "src string, size long, n long, source_size long, target double, rounds int, more long"))
    plan = stored(plan.select(F.col("src").alias("__hl_src"), F.col("size").alias("__hl_size"), "n", "source_size", "target", "rounds", "more"), "plan")
    plan = plan.select("__hl_src", "__hl_size", *(F.col(c).alias(f"__hl_{c}") for c in ("source_size", "target", "rounds", "more")),
                       F.ceil(F.col("n") / PART).alias("__hl_parts"))
    rows = rows.join(small(plan), ["__hl_src", "__hl_size"]).withColumn("__hl_hash", F.xxhash64(F.lit(seed), *ROW_KEY))
    group = ["__hl_src", "__hl_size", "__hl_part"]
    part = F.pmod(F.col("__hl_hash"), F.col("__hl_parts"))
    rows = rows.withColumn("__hl_part", part)
    parts = rows.where("__hl_parts > 1").groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("__hl_src", "__hl_size").orderBy("__hl_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored(parts.select(*group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__hl_before")), "parts")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("__hl_hash", *ROW_KEY))
    rows = (rows.join(small(parts), group, "left").withColumn("__hl_rank", rank + F.coalesce("__hl_before", F.lit(0)))
            .withColumn("__hl_copies", F.col("__hl_rounds") + (F.col("__hl_rank") <= F.col("__hl_more")).cast("int")))
    copies = F.when(F.col("__hl_size") > 0, F.col("__hl_copies")).otherwise(0)
    return rows.select(*kept, F.col("__hl_size").alias("size"), F.col("__hl_source_size").alias("source_size"),
                       F.col("__hl_target").alias("target"), copies.alias("copies"), (F.col("__hl_size") * copies).alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2 over all documents: doc_id, size, source_size, target, taken, copies."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")
