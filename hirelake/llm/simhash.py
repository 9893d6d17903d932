"""SimHash near-dedup with BK-trees (operator 5).

Fingerprints of one component are linked at ``max_distance`` (4) or fewer differing bits.
Two such fingerprints agree fully in two of six bit blocks, so each distinct fingerprint
goes to 15 shards (pairs of blocks); fingerprints within the distance always meet in a
shard.  Each shard builds a BK-tree, children keyed by their integer Hamming distance to
the parent, and floods it: a query follows only edges within the radius and takes what it
finds out of the tree, so each shard reports a spanning forest instead of all pairs.

The trees are routed to the shards' tasks by a shuffle instead of being broadcast: together
they are as large as the corpus.  A shard of more than ``max_shard`` fingerprints is dealt
again by pairs of blocks of its remaining bits until it is small or so few bits remain that
it cannot be larger; no shard is cut short.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelake.llm.common import ROW_KEY, arrow_rows, bounded_batches, encoded, fits, stored, with_row_key
from hirelake.llm.components import components

SEED = 42
MAX_SHARD = 8192
_SIGN = 1 << 63


def fingerprint(text: bytes, shingle: int) -> int:
    """The 64-bit SimHash of a UTF-8 text, as a signed long; 0 without words."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    whole = b" ".join(words)
    if n <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(whole, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(whole[s:e], SEED) for s, e in
                              zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1:].tolist(), strict=True)),
                             np.uint64, n - shingle + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[i:i + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, row key, ``__hl_fp``) of every row: A-Z lower-cased, words are runs of
    anything but ASCII white space, ``shingle``-word shingles with repeats, XXH64 seed 42,
    a bit set if over half of the hashes have it.  Fewer words: the whole sequence is the
    one shingle; no words or null: 0."""
    bounded_batches(docs.sparkSession)
    keyed = with_row_key(docs.select(id_col, text_col), id_col, text_col)
    out = keyed.drop(text_col).withColumn("__hl_fp", F.lit(0).cast("bigint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_rows(batches):
            fps = pa.array([fingerprint(x, shingle) for x in encoded(b[text_col])], pa.int64())
            yield pa.RecordBatch.from_arrays([b[id_col], *(b[k] for k in ROW_KEY), fps], [id_col, *ROW_KEY, "__hl_fp"])

    return keyed.mapInArrow(run, out)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= _SIGN else x


def child_masks(mask: int, max_distance: int) -> list[int]:
    """The masks that refine ``mask``: its bits and those of two of ``max_distance + 2``
    blocks of the free bits (all free bits if there are fewer than blocks)."""
    free = [b for b in range(64) if not mask >> b & 1]
    blocks = [sum(1 << int(b) for b in x) for x in np.array_split(free, max_distance + 2)]
    return sorted({mask | x | y for x, y in combinations(blocks, 2)})


class BKTree:
    """Children are keyed by the integer Hamming distance to their parent; ``live`` counts
    the members of a subtree that no flood has taken yet."""

    def __init__(self, items: list[int]) -> None:
        self.items = items
        self.children: list[dict[int, int]] = [{} for _ in items]
        self.parent = [-1] * len(items)
        self.live = [1] * len(items)
        self.taken = [False] * len(items)
        for i in range(1, len(items)):
            at, x = 0, items[i]
            while True:
                self.live[at] += 1
                d = (items[at] ^ x).bit_count()
                nxt = self.children[at].setdefault(d, i)
                if nxt == i:
                    self.parent[i] = at
                    break
                at = nxt

    def take(self, i: int) -> None:
        self.taken[i] = True
        while i >= 0:
            self.live[i] -= 1
            i = self.parent[i]

    def near(self, x: int, radius: int) -> list[int]:
        """The members not yet taken within ``radius`` of ``x``."""
        found, stack = [], [0]
        items, children, live, taken = self.items, self.children, self.live, self.taken
        while stack:
            at = stack.pop()
            if not live[at]:
                continue
            d = (items[at] ^ x).bit_count()
            if d <= radius and not taken[at]:
                found.append(at)
            kids = children[at]
            if len(kids) <= 2 * radius:
                stack += [c for e, c in kids.items() if -radius <= e - d <= radius]
            else:
                stack += [kids[e] for e in range(d - radius, d + radius + 1) if e in kids]
        return found

    def forest(self, radius: int) -> list[tuple[int, int]]:
        """(member, first member of its group) for all groups of two or more."""
        out = []
        for i in range(len(self.items)):
            if self.taken[i]:
                continue
            self.take(i)
            queue = [i]
            while queue:
                for j in self.near(self.items[queue.pop()], radius):
                    self.take(j)
                    out.append((self.items[j], self.items[i]))
                    queue.append(j)
        return out


def _shard_links(radius: int):
    """Rows sorted by shard -> links; holds one shard at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []
        a: list[int] = []
        b: list[int] = []

        def close() -> None:
            if len(members) > 1:
                for x, y in BKTree([m & (1 << 64) - 1 for m in members]).forest(radius):
                    a.append(_signed(x))
                    b.append(_signed(y))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a.clear()
            b.clear()
            return out

        for batch in batches:
            for k in zip(*(batch[c].to_pylist() for c in ("mask", "val", "fp")), strict=True):
                if k[:2] != key:
                    close()
                    key, members = k[:2], []
                members.append(k[2])
            if len(a) >= 10_000:
                yield flush()
        close()
        yield flush()

    return run


def links(fps: DataFrame, max_distance: int = 4, max_shard: int = MAX_SHARD) -> DataFrame:
    """Distinct non-null ``fps(fp)`` -> links ``(a, b)`` whose components are those of all
    pairs at ``max_distance`` or fewer differing bits."""
    spark = fps.sparkSession
    out = None
    masks = {(0, c) for c in child_masks(0, max_distance)}
    level = fps.select("fp", F.explode(F.array(*(F.lit(_signed(c)) for _, c in sorted(masks)))).alias("mask"))
    while True:
        dealt = level.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("val"))
        sizes = dealt.groupBy("mask", "val").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = stored(dealt.join(sizes, ["mask", "val"]), "shards")
        # A shard with so few free bits that each has a block of its own is small anyway.
        large = (F.col("n") > max_shard) & (F.bit_count("mask") < 64 - (max_distance + 2))
        found = (shared.where(~large).select("mask", "val", "fp").repartition("mask", "val").sortWithinPartitions("mask", "val", "fp")
                 .mapInArrow(_shard_links(max_distance), "a bigint, b bigint"))
        out = found if out is None else out.union(found)
        level = shared.where(large).select("fp", "mask")
        if fits(level, 0):
            return out.distinct()
        masks = {(c, g) for c in {c for _, c in masks} for g in child_masks(c, max_distance)}
        steps = spark.createDataFrame([(_signed(p), _signed(c)) for p, c in masks], "mask bigint, child bigint")
        level = level.join(F.broadcast(steps), "mask").select("fp", F.col("child").alias("mask")).distinct()  # parents can share a child


def classes(docs: DataFrame, shingle: int = 4, max_distance: int = 4, id_col: str = "doc_id",
            text_col: str = "text", max_shard: int = MAX_SHARD) -> DataFrame:
    """One row per row of ``docs``: (``id_col``, row key, ``__hl_fp``, ``__hl_comp`` (the
    smallest linked fingerprint), ``component_id``), the smallest id reachable over links, itself included (null ids do not count; null if
    a component has no other).  Repeated rows are members like any other.  Empty table: no
    rows."""
    rows = stored(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    groups = rows.groupBy("__hl_fp").agg(F.min(id_col).alias("__hl_first"))
    comp = components(links(groups.select(F.col("__hl_fp").alias("fp")), max_distance, max_shard))
    named = groups.join(comp, F.col("__hl_fp") == F.col("node"), "left").select(
        "__hl_fp", "__hl_first", F.coalesce("component", "__hl_fp").alias("__hl_comp"))
    named = stored(named, "classes")
    first = named.groupBy("__hl_comp").agg(F.min("__hl_first").alias("component_id"))
    return rows.join(named.join(first, "__hl_comp").select("__hl_fp", "__hl_comp", "component_id"), "__hl_fp")


def deduplicate(docs: DataFrame, shingle: int = 4, max_distance: int = 4, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the smallest id (null last), of equal ids the
    smallest text hash, of equal rows any one.  All columns stay."""
    cls = stored(classes(docs, shingle, max_distance, id_col, text_col), "members")
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), *ROW_KEY)
    keep = cls.groupBy("__hl_comp").agg(F.min(order).alias("o")).select(*(F.col(f"o.{k}").alias(k) for k in ROW_KEY))
    w = Window.partitionBy(*ROW_KEY).orderBy(F.lit(0))
    return (with_row_key(docs, id_col, text_col).join(keep, ROW_KEY, "left_semi")
            .withColumn("__hl_n", F.row_number().over(w)).where("__hl_n = 1").drop(*ROW_KEY, "__hl_n"))


def query(spark, sf_dir: str) -> DataFrame:
    """Operator 5 over all documents: doc_id, fingerprint (16 hex digits), component_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("__hl_fp"), 16, "0")).alias("fingerprint"), "component_id")
