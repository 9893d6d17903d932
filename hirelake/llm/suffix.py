"""Repeated byte strings by prefix-free parsing (operator 8).

A string of ``length`` (200) bytes that starts anywhere else is removed wherever it stands.

*Parsing.*  The rolling hash of every 48-byte string makes triggers: the trigger of a
``length``-byte window is the leftmost smallest hash in it, so every window has one and
equal windows have the same one at the same place.  The consecutive windows of one trigger
are a phrase (they overlap, each window lies in exactly one phrase); the parse of a text is
its sequence of phrases (trigger, content hash, place).

*Dictionary.*  Spark counts triggers with map-side combining.  A trigger seen once has no
repeated window, so its phrases leave here.  If all phrases of a trigger are equal, all
their windows are repeated.  Where phrases of a trigger differ, equal ones are counted and
collapsed: all their windows are repeated, and one of them stands for them in the
dictionary.

*Order.*  The dictionary's phrases meet by trigger and their suffixes are put in order, to the depth
that matters: by two independent 64-bit hashes of the first ``length`` bytes instead of
lexicographically, since only "equal for ``length`` bytes" is asked.  Neighbours that agree
are repeated windows.  A trigger with more than ``max_group`` dictionary phrases does not
meet in one task: their windows are counted one by one with map-side combining, and the
counts joined back.

Texts are parsed where they are read (twice: to count triggers, then to keep the phrases of
repeated ones, which are stored) and shuffled once (one exchange by row key that the stages
after that share); what else moves is a few longs for each phrase, and the contents of the
dictionary's phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.llm.common import ROW_KEY, arrow_rows, bounded_batches, encoded, partitions, stored, with_row_key

LENGTH, TRIGGER, MAX_GROUP = 200, 48, 8000
_PIECE = 1 << 18  # bytes in one numpy pass: its arrays of longs stay within a core's cache
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_CACHE: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverses modulo 2**64, for i < n."""
    size = 1 << max(16, (n - 1).bit_length())
    if (base, size) not in _CACHE:
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(1, np.uint64)
            while len(p) < size:
                p = np.concatenate((p, p * np.uint64(pow(b, len(p), 1 << 64))))
            pair.append(p)
        _CACHE.clear() if len(_CACHE) > 4 else None
        _CACHE[base, size] = (pair[0], pair[1])
    up, down = _CACHE[base, size]
    return up[:n], down[:n]


def rolling(data: np.ndarray, width: int, base: int = _BASES[0]) -> np.ndarray:
    """A hash of each ``width``-byte string of ``data`` (uint8), equal for equal strings."""
    n = len(data) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers(base, len(data))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)))
    h = (total[width:] - total[:-width]) * down[:n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    pad = -len(x) % width
    full = np.concatenate((x, np.full(pad, np.iinfo(np.uint64).max))).reshape(-1, width)
    head = np.minimum.accumulate(full, axis=1).ravel()
    tail = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n], head[width - 1:width - 1 + n])


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Whole texts packed together, or parts of a long one that overlap by ``length`` - 1:
    (data, text number and first byte of each part, where each part starts in data)."""
    part: list[tuple[int, int, bytes]] = []
    size = 0
    for k, t in enumerate(texts):
        for at in range(0, len(t) - length + 1, _PIECE):
            x = t[at:at + _PIECE + length - 1]
            if part and size + len(x) > _PIECE:
                yield _packed(part)
                part, size = [], 0
            part.append((k, at, x))
            size += len(x)
    if part:
        yield _packed(part)


def _packed(part):
    sizes = np.fromiter((len(x) for _, _, x in part), np.int64, len(part))
    return (np.frombuffer(b"".join(x for _, _, x in part), np.uint8), np.array([k for k, _, _ in part]),
            np.array([at for _, at, _ in part]), np.concatenate(([0], np.cumsum(sizes))))


def phrases(texts: list[bytes], length: int = LENGTH, trigger: int = TRIGGER):
    """(text number, first window, windows, trigger's place from the first window, trigger
    hash, content hash) of every phrase, as arrays."""
    none = np.empty(0, np.int64)
    out = [(none, none, none, none, none, none)]
    for data, number, first, starts in _pieces(texts, length):
        h = rolling(data, trigger)
        place = np.uint64((1 << 24) - 1)
        keyed = (h & ~place) | np.arange(len(h), dtype=np.uint64)
        at = (_sliding_min(keyed, length - trigger + 1) & place).astype(np.int64)
        part = np.repeat(np.arange(len(number)), np.diff(starts))[:len(at)]
        good = np.arange(length, len(at) + length) <= starts[1:][part]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (part[1:] != part[:-1])
        lo = np.flatnonzero(new & good)
        new |= ~good
        hi = np.concatenate((np.flatnonzero(new), [len(at)]))
        hi = hi[np.searchsorted(hi, lo, "right")]
        off = at[lo] - lo
        raw = data.tobytes()
        digest = xxhash.xxh3_64_intdigest
        content = np.fromiter((digest(raw[a:b], o) for a, b, o in zip(lo.tolist(), (hi - 1 + length).tolist(), off.tolist(), strict=True)),
                              np.uint64, len(lo))
        out.append((number[part[lo]], lo - starts[part[lo]] + first[part[lo]], hi - lo, off,
                    h[at[lo]].view(np.int64), content.view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _parse(length: int, trigger: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_rows(batches, 4 << 20):
            k, lo, n, off, th, ch = phrases(encoded(b["text"]), length, trigger)
            keys = [b[c].take(pa.array(k, pa.int64())) for c in ROW_KEY]
            yield pa.RecordBatch.from_arrays(
                [*keys, pa.array(lo, pa.int32()), pa.array(n.astype(np.int16)), pa.array(off.astype(np.int16)),
                 pa.array(th, pa.int64()), pa.array(ch, pa.int64())], [*ROW_KEY, "lo", "n", "off", "th", "ch"])

    return run


_KEY = f"{ROW_KEY[0]} bigint, {ROW_KEY[1]} bigint"
_PARSE = f"{_KEY}, lo int, n smallint, off smallint, th bigint, ch bigint"
_SPAN = f"{_KEY}, lo int, size int"
_CONTENT = f"{_KEY}, lo int, size int, th bigint, content binary"
_WINDOWS = f"{_KEY}, lo int, h1 bigint, h2 bigint"
# What becomes of a phrase whose trigger repeats: all of it is repeated; it goes to the
# dictionary to meet others or to have its windows counted; the latter two for a phrase
# that is repeated itself (its dictionary entry).
ALIKE, MEET, COUNT, MEET_ALIKE, COUNT_ALIKE = range(5)


def marked(column: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The row of each element of a column of lists of structs, and its fields; a null list
    has none."""
    values = column.flatten()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    return np.repeat(np.arange(len(column)), sizes), {f.name: values.field(f.name).to_numpy() for f in values.type}


def _contents(length: int, whole: tuple[int, ...], kinds: tuple[int, ...]):
    """Texts with their phrases -> rows without content for ``whole`` (they get a place of
    their own instead of the trigger, which spreads them), with content for ``kinds``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_rows(batches, 4 << 20):
            rows, m = marked(b["marks"])
            parts = [np.flatnonzero(np.isin(m["kind"], k)) for k in (whole, kinds)]
            chosen = np.concatenate(parts)
            alike = np.arange(len(chosen)) < len(parts[0])
            rows, lo, th = rows[chosen], m["lo"][chosen], m["th"][chosen]
            size = m["n"][chosen].astype(np.int32) + (length - 1)
            key = b[ROW_KEY[1]].to_numpy()[rows]
            texts = encoded(b["text"])
            content = [None if a else texts[i][x:x + n] for a, i, x, n in
                       zip(alike.tolist(), rows.tolist(), lo.tolist(), size.tolist(), strict=True)]
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [*(b[c].take(at) for c in ROW_KEY), pa.array(lo, pa.int32()), pa.array(size, pa.int32()), pa.array(np.where(alike, key ^ lo, th), pa.int64()),
                 pa.array(content, pa.binary())], [*ROW_KEY, "lo", "size", "th", "content"])

    return run


def _hashes(contents: list[bytes], length: int):
    """(number of the content, window in it, two hashes) of every window."""
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(contents), np.uint8)
    h = [rolling(data, length, b) for b in _BASES]
    part = np.repeat(np.arange(len(sizes)), sizes)[:len(h[0])]
    good = np.flatnonzero(np.arange(length, len(h[0]) + length) <= ends[part])
    part = part[good]
    return part, good - (ends - sizes)[part], h[0][good], h[1][good]


def _window_hashes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_rows(batches, 1 << 19):
            part, i, h1, h2 = _hashes(encoded(b["content"]), length)
            at = pa.array(part, pa.int64())
            lo = b["lo"].take(at).to_numpy(zero_copy_only=False) + i
            yield pa.RecordBatch.from_arrays([*(b[c].take(at) for c in ROW_KEY), pa.array(lo.astype(np.int32)), pa.array(h1.view(np.int64)),
                                              pa.array(h2.view(np.int64))], [*ROW_KEY, "lo", "h1", "h2"])

    return run


def _ordered(length: int, budget: int = 1 << 19):
    """Phrases sorted by trigger -> spans of repeated windows; holds whole triggers of
    about ``budget`` bytes at a time (one trigger's phrases are bounded by max_group)."""

    def spans(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        part, i, h1, h2 = _hashes(encoded(b["content"]), length)
        order = np.lexsort((h2, h1))
        same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
        again = np.zeros(len(part), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        at = np.flatnonzero(again)  # windows of a phrase follow one another
        head = np.ones(len(at), bool)
        head[1:] = (np.diff(at) != 1) | (np.diff(part[at]) != 0)
        first = np.flatnonzero(head)
        runs = np.diff(np.concatenate((first, [len(at)])))
        rows = pa.array(part[at[first]], pa.int64())
        lo = b["lo"].take(rows).to_numpy(zero_copy_only=False) + i[at[first]]
        return pa.RecordBatch.from_arrays([*(b[c].take(rows) for c in ROW_KEY), pa.array(lo.astype(np.int32)),
                                           pa.array((runs + length - 1).astype(np.int32))], [*ROW_KEY, "lo", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for b in batches:
            plain = pc.is_null(b["content"])
            yield b.filter(plain).select([*ROW_KEY, "lo", "size"])
            b = b.filter(pc.invert(plain))
            if not b.num_rows:
                continue
            th = b["th"].to_numpy()
            weight = np.concatenate(([0], np.cumsum(b["size"].to_numpy(), dtype=np.int64)))
            starts = np.flatnonzero(np.diff(th)) + 1
            begin = 0
            for c in ([0] if held and last != th[0] else []) + starts.tolist():
                if size + weight[c] - weight[begin] >= budget:  # every trigger before c is whole
                    yield spans([*held, b.slice(begin, c - begin)])
                    held, size, begin = [], 0, c
            held.append(b.slice(begin))
            size, last = size + weight[-1] - weight[begin], th[-1]
        if held:
            yield spans(held)

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal [start, end) runs of (start, size) spans; touching ones are one run."""
    out: list[tuple[int, int]] = []
    for lo, size in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], lo + size))
        else:
            out.append((lo, lo + size))
    return out


def cut(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in runs:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept)


def repeated_spans(keyed: DataFrame, rows: DataFrame, length: int = LENGTH, trigger: int = TRIGGER, max_group: int = MAX_GROUP) -> DataFrame:
    """``keyed(row key, text)``, and the same ``rows`` dealt by row key -> (row key, lo,
    size) byte spans whose union is what repeats; they may overlap.  All columns of
    ``rows`` are read everywhere, so that its one exchange serves all reads."""
    parse = keyed.mapInArrow(_parse(length, trigger), _PARSE)
    seen = parse.groupBy("th").agg(F.count(F.lit(1)).alias("seen"), F.min("ch").alias("c1"), F.max("ch").alias("c2")).where("seen > 1")
    # Stored first: only a join of two plain exchanges has its hot keys split.
    seen = stored(seen.select("th", (F.col("c1") == F.col("c2")).alias("alike")), "triggers")
    live = stored(parse.join(seen, "th"), "phrases")
    # Grouped by one hash of trigger and content, so that a hot trigger's phrases spread.
    mixed = live.where(~F.col("alike")).withColumn("phrase", F.xxhash64("th", "ch"))
    place = F.struct(*ROW_KEY, "lo")
    entries = mixed.groupBy("phrase", "ch").agg(F.first("th").alias("th"), F.count(F.lit(1)).alias("equal"), F.min(place).alias("entry"))
    many = entries.groupBy("th").agg(F.count(F.lit(1)).alias("phrases")).where(F.col("phrases") > max_group).withColumn("many", F.lit(True))
    entries = entries.join(many, "th", "left").select("phrase", "ch", "equal", "entry", F.coalesce("many", F.lit(False)).alias("many"))
    once = F.when(F.col("many"), COUNT).otherwise(MEET)
    both = F.when(F.col("many"), COUNT_ALIKE).otherwise(MEET_ALIKE)
    kind = F.when(F.col("equal") == 1, once).when(place == F.col("entry"), both).otherwise(ALIKE)
    columns = [*ROW_KEY, "lo", "n", "th"]
    kinds = (live.where("alike").select(*columns, F.lit(ALIKE).alias("kind"))
             .unionByName(mixed.join(entries, ["phrase", "ch"]).select(*(mixed[c] for c in columns), kind.alias("kind"))))
    # a set: rows equal in id and text give equal marks, of which each row needs one
    marks = kinds.groupBy(*ROW_KEY).agg(F.collect_set(F.struct("lo", "n", "th", F.col("kind").cast("tinyint").alias("kind"))).alias("marks"))

    def contents(whole: tuple[int, ...], kinds: tuple[int, ...]) -> DataFrame:
        some = marks.where(F.exists("marks", lambda m: m["kind"].isin(*whole, *kinds)))
        return rows.join(some, ROW_KEY).mapInArrow(_contents(length, whole, kinds), _CONTENT)

    met = (contents((ALIKE, MEET_ALIKE, COUNT_ALIKE), (MEET, MEET_ALIKE)).repartition(partitions(rows.sparkSession), "th").sortWithinPartitions("th")
           .mapInArrow(_ordered(length), _SPAN))
    windows = contents((), (COUNT, COUNT_ALIKE)).mapInArrow(_window_hashes(length), _WINDOWS)
    often = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    counted = windows.join(often, ["h1", "h2"]).select(*ROW_KEY, "lo", F.lit(length).alias("size"))
    return met.unionByName(counted)


def keyed_texts(docs: DataFrame, columns: list[str], id_col: str, text_col: str) -> DataFrame:
    """``columns``, the row key and ``text``."""
    return with_row_key(docs, id_col, text_col).select(*(F.col(c).alias(f"__hl_c{i}") for i, c in enumerate(columns)), *ROW_KEY,
                                                       F.col(text_col).alias("text"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   trigger: int = TRIGGER, max_group: int = MAX_GROUP) -> DataFrame:
    """(``id_col``, ``n_bytes``, ``n_removed``, ``n_spans``, ``spans`` [start, end) bytes,
    ``kept`` bytes) of every row.

    A null text counts as empty, texts shorter than ``length`` lose nothing, repeated rows
    are texts of their own and so repeat each other.  Empty table: no rows."""
    bounded_batches(docs.sparkSession, 4 << 20)
    keyed = keyed_texts(docs, [id_col], id_col, text_col)
    rows = keyed.repartition(partitions(docs.sparkSession), *ROW_KEY)
    spans = repeated_spans(keyed, rows, length, trigger, max_group)
    per_text = spans.groupBy(*ROW_KEY).agg(F.collect_set(F.struct("lo", "size")).alias("marks"))
    out = docs.select(id_col).schema
    for c in ("n_bytes", "n_removed", "n_spans"):
        out = out.add(c, "long")
    span = T.StructType().add("start", "long").add("stop", "long")
    out = out.add("spans", T.ArrayType(span)).add("kept", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_rows(batches):
            n, gone, runs, kept = [], [], [], []
            rows, m = marked(b["marks"])
            ends = np.searchsorted(rows, np.arange(b.num_rows), "right").tolist()
            spans = list(zip(m["lo"].tolist(), m["size"].tolist(), strict=True))
            for t, start, end in zip(encoded(b["text"]), [0, *ends], ends):
                r = merged(spans[start:end])
                n.append(len(t))
                gone.append(sum(y - x for x, y in r))
                runs.append([{"start": x, "stop": y} for x, y in r])
                kept.append(cut(t, r))
            yield pa.RecordBatch.from_arrays(
                [b["__hl_c0"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([len(r) for r in runs], pa.int64()),
                 pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())],
                [id_col, "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return rows.join(per_text, ROW_KEY, "left").mapInArrow(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 8 over all documents: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
