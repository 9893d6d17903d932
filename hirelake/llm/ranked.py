"""Ranked lexical search with range-maximum tables over posting lists (operator 11).

A document's impact for a term is what one unit of the term's weight adds to its score, so
it does not depend on the item that asks.  Documents are cut into segments of a bounded
number of postings.  A segment keeps its posting lists end to end, by term and then by
document position, with one sparse table over all impacts: two look-ups give the largest
impact of a term in any interval of documents, and the document that has it.

An item searches a segment best first.  The bound of an interval is the sum of its terms'
range maxima, each times the term's weight.  The interval with the largest bound is split
at the document of its largest contribution: that document is scored exactly and the parts
before and after it become intervals of their own.  A segment is done when no bound can
beat the k-th score; with equal scores the smaller id wins, so an interval whose bound
equals that score is opened only if its smallest id (a second sparse table) is smaller.
The k best scores found go on to the next segment of the task, and Spark merges the tasks.

Documents are read once for each block of items (``BLOCK_BYTES`` of item text) and never
shuffled; only counts by term and ``k`` rows for each item and task move.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.llm.common import arrow_rows, bounded_batches, encoded, stored

K = 10
#: Items go to the tasks in blocks of about this much text; a segment holds about so many postings.
BLOCK_BYTES, SEGMENT = 8 << 20, 1 << 20
#: So many intervals are opened together (a frontier with fewer is opened whole).
TOGETHER = 128
_LAST = np.iinfo(np.int64).max
# Fixed values of the contract: term characters are ASCII letters and digits and all that is
# not ASCII; in UTF-8 the latter are the bytes from 0x80 on.  Only A-Z are lower-cased.
_TERM = bytes(ord(chr(b).lower()) if b >= 0x80 or chr(b).isalnum() and b < 0x80 else 0x20 for b in range(0x80)) + bytes(range(0x80, 0x100))


def terms(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text in order."""
    return text.translate(_TERM).split()


def index(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(``id``, ``n``, ``terms``, ``tfs``) of every document with a term: the number of its
    terms, and the numbers and frequencies of those that ``vocabulary`` holds."""
    bounded_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    read = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value.get
        for b in arrow_rows(batches):
            keep, n, ends, ids, tfs = [], [], [0], [], []
            for i, text in enumerate(encoded(b["text"])):
                if found := terms(text):
                    held = Counter(map(number, found))
                    held.pop(None, None)
                    keep.append(i)
                    n.append(len(found))
                    ids.extend(held.keys())
                    tfs.extend(held.values())
                    ends.append(len(ids))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (ids, tfs)]
            yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), *lists], ["id", "n", "terms", "tfs"])

    return read.mapInArrow(run, "id bigint, n bigint, terms array<int>, tfs array<int>")


def sparse_table(values: np.ndarray, longest: int) -> np.ndarray:
    """Row ``j`` holds, for each place, where the largest of the ``2**j`` values from there
    on is (the first of equals); ranges of up to ``longest`` values can be asked."""
    rows = [np.arange(len(values), dtype=np.int32)]
    for j in range(max(1, longest).bit_length() - 1):
        below, step = rows[-1], 1 << j
        row = below.copy()
        a, b = below[:-step], below[step:]
        row[: len(a)] = np.where(values[a] >= values[b], a, b)
        rows.append(row)
    return np.stack(rows)


_LOG = np.zeros(2, np.int64)


def range_max(table: np.ndarray, values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Where the largest value of each range [lo, hi) is; an empty range gives any place."""
    global _LOG
    size = hi - lo
    if (most := int(size.max(initial=1))) >= len(_LOG):
        _LOG = np.log2(np.maximum(np.arange(2 * most + 2), 1) + 0.5).astype(np.int64)
    j = _LOG[np.maximum(size, 1)]
    last = table.shape[1] - 1
    a = table[j, np.minimum(lo, last)]
    b = table[j, np.clip(hi - (1 << j), 0, last)]
    return np.where(values[a] >= values[b], a, b)


class Segment:
    """Posting lists of some documents, in the order of their length norm, then id: like
    documents, copies above all, lie together, which keeps bounds close to scores."""

    def __init__(self, ids: np.ndarray, norms: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, n_terms: int) -> None:
        order = np.lexsort((ids, norms))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        owner = np.repeat(np.arange(len(ids)), sizes)
        self.n, self.row, self.ids = len(ids), order, ids[order]
        tf = tf.astype(np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * norms[owner])
        key = term.astype(np.int64) * self.n + place[owner]
        by = np.argsort(key)
        self.key, self.impact = key[by], impact[by]
        self.ends = np.searchsorted(self.key, np.arange(n_terms + 1) * self.n)
        self.table = sparse_table(self.impact, int(np.diff(self.ends).max(initial=1)))
        self.least = sparse_table(-self.ids, self.n)

    def search(self, term: np.ndarray, weight: np.ndarray, best: list[tuple], k: int, tag: int) -> None:
        """Bring ``best``, a sorted list of (-score, id, segment ``tag``, row) of at most
        ``k`` entries, up to date with this segment."""
        held = (self.ends[term + 1] > self.ends[term]) & (weight > 0)
        term, weight = term[held], weight[held]
        if not len(term):
            return
        base = term * self.n
        key, impact = self.key, self.impact
        left, right = [self.ends[term]], [self.ends[term + 1]]
        lo, hi = [0], [self.n]
        heap: list[tuple[int, int]] = []
        split: list[int] = []

        def enter(first: np.ndarray, last: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
            """Bounds of the intervals [a, b), whose postings of each term are [first, last)."""
            top = range_max(self.table, impact, first, last)
            adds = np.where(last > first, impact[top] * weight, 0)
            bound = adds.sum(1)
            at = key[top[np.arange(len(top)), adds.argmax(1)]] % self.n
            live = bound > 0
            if len(best) == k:
                floor, worst = -best[-1][0], best[-1][1]
                live &= bound >= floor
                tied = np.flatnonzero(live & (bound == floor))
                live[tied] = self.ids[range_max(self.least, -self.ids, a[tied], b[tied])] < worst
            for i in np.flatnonzero(live).tolist():
                heapq.heappush(heap, (-int(bound[i]), len(split)))
                split.append(int(at[i]))
                left.append(first[i])
                right.append(last[i])
                lo.append(int(a[i]))
                hi.append(int(b[i]))

        left_0, right_0 = left.pop(), right.pop()
        lo.clear(), hi.clear()
        enter(left_0[None], right_0[None], np.array([0]), np.array([self.n]))
        while heap and (len(best) < k or -heap[0][0] >= -best[-1][0]):
            rows = [heapq.heappop(heap)[1] for _ in range(min(TOGETHER, len(heap)))]
            d = np.array([split[r] for r in rows])
            first, last = np.stack([left[r] for r in rows]), np.stack([right[r] for r in rows])
            a, b = np.array([lo[r] for r in rows]), np.array([hi[r] for r in rows])
            for r in rows:
                left[r] = right[r] = None
            want = base + d[:, None]
            at = np.clip(np.searchsorted(key, want), first, last)
            there = (at < last) & (key[np.minimum(at, len(key) - 1)] == want)
            score = np.where(there, impact[np.minimum(at, len(key) - 1)] * weight, 0).sum(1)
            for s, x in zip(score.tolist(), d.tolist()):
                entry = (-s, int(self.ids[x]), tag, int(self.row[x]))
                if s > 0 and (len(best) < k or entry < best[-1]):
                    best.append(entry)
                    best.sort()
                    del best[k:]
            enter(np.concatenate([first, at + there]), np.concatenate([at, last]), np.concatenate([a, d + 1]), np.concatenate([d, b]))


def segments(batches: Iterator[pa.RecordBatch], docs: int, total: int, n_terms: int, postings: int) -> Iterator[tuple[Segment, list]]:
    """Segments of about ``postings`` postings each, with their ids (None for null)."""
    got, held = [], 0

    def build() -> tuple[Segment, list]:
        ids = pa.concat_arrays([b["id"] for b in got])
        n = np.concatenate([b["n"].to_numpy() for b in got])
        lists = [pa.concat_arrays([b[c].combine_chunks() if isinstance(b[c], pa.ChunkedArray) else b[c] for b in got]) for c in ("terms", "tfs")]
        sizes = lists[0].value_lengths().to_numpy()
        values = [x.flatten().to_numpy() for x in lists]
        numbers = ids.fill_null(_LAST).to_numpy()
        return Segment(numbers, 25 + 75 * n * docs // total, sizes, *values, n_terms), ids.to_pylist()

    for batch in batches:
        for b in arrow_rows([batch], postings):
            got.append(b)
            held += len(b["terms"].flatten())
            if held >= postings:
                yield build()
                got, held = [], 0
    if got:
        yield build()


def _rank_block(rows: DataFrame, items: pa.Table, queries: list[Counter], vocabulary: dict[bytes, int], k: int, id_type: T.DataType, item_col: str,
                block: int, postings: int) -> DataFrame:
    spark = rows.sparkSession
    docs, total = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
    df = np.zeros(len(vocabulary), np.int64)
    # At most one row for each term of the block.
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():
        df[r.t] = r.df
    weights = [math.floor(1000 * math.log((2 * docs + 2) / (2 * int(x) + 1))) for x in df]
    asked = [(np.array(list(q), np.int64), np.array([weights[t] * c for t, c in q.items()], np.int64)) for q in queries]
    shared = spark.sparkContext.broadcast((items, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, wanted = shared.value
        best: list[list[tuple]] = [[] for _ in wanted]
        ids: dict[tuple[int, int], object] = {}
        for tag, (seg, names) in enumerate(segments(batches, docs, total, len(vocabulary), postings)):
            for (term, weight), found in zip(wanted, best):
                if len(term):
                    seg.search(term, weight, found, k, tag)
            live = {e[2:] for found in best for e in found}
            ids = {e: ids[e] if e[0] < tag else names[e[1]] for e in live}
        out = [(i, ids[e[2:]], -e[0]) for i, found in enumerate(best) for e in found]
        if out:
            at, doc, score = zip(*out)
            item = table[item_col].combine_chunks().take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), item, pa.array(doc, pa.int64()), pa.array(score, pa.int64())],
                                             ["__hl_item", "item", "id", "score"])

    schema = T.StructType().add("__hl_item", "integer").add("item", id_type).add("id", "long").add("score", "long")
    return rows.select("id", "n", "terms", "tfs").mapInArrow(run, schema).withColumn("__hl_block", F.lit(block))


def rank(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text: str = "text", block_bytes: int = BLOCK_BYTES, segment: int = SEGMENT) -> DataFrame:
    """The ``k`` best documents of every item: (``item_id``, ``rank`` from 1, ``doc_id``,
    ``score``), equal scores by ascending id.

    Ids of documents are integers; a null id comes after all others of its score.  Null and
    term-less texts of documents are none of the documents counted, those of items find
    nothing.  Items equal in id and text are one item, items equal in id alone are ranked
    each for itself; repeated documents are documents of their own.  Other columns are not
    read.  An empty table on either side gives no rows."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_col), F.col(item_text).alias("__hl_query")).where("__hl_query is not null").distinct()
    size = asked.agg(F.sum(F.octet_length("__hl_query"))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    parts = []
    for block in range(blocks):
        # Bounded: a block is about block_bytes of text.
        got = asked.where(F.pmod(F.xxhash64(item_col, "__hl_query"), F.lit(blocks)) == block).toArrow()
        words = [Counter(terms(x)) for x in encoded(got["__hl_query"].combine_chunks())]
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for q in words for w in q))}
        if not vocabulary:
            continue
        queries = [Counter({vocabulary[w]: c for w, c in q.items()}) for q in words]
        rows = stored(index(docs, vocabulary, id_col, text_col), "postings")
        parts.append(_rank_block(rows, got.select([item_col]), queries, vocabulary, k, items.schema[item_col].dataType, item_col, block, segment))
    if not parts:
        return spark.createDataFrame([], T.StructType().add(item_col, items.schema[item_col].dataType).add("rank", "integer")
                                     .add(id_col, "long").add("score", "long"))
    order = Window.partitionBy("__hl_block", "__hl_item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 11: all documents ranked for each benchmark item."""
    return rank(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), n AS (
  SELECT r, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0
), s AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM n
), tf AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL
), wt AS (
  SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS weight
  FROM (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term), s
), i AS (
  SELECT item_id, term, count(*)::BIGINT AS reps FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL
), score AS (
  SELECT item_id, r, sum(reps * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
  FROM i JOIN wt USING (term) JOIN tf USING (term) JOIN n USING (r), s GROUP BY item_id, r
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM score JOIN n USING (r) WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
