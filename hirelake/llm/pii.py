r"""Personal data by bootstrapped contextual extraction (operator 6).

Seeds are the base spans (emails, IPs, cards, phones by fixed patterns).  Every identifier-
like stretch of a text (one with a digit or an ``@``), seed or not, is an instance with its
lexical patterns: the last word before it and the last two.  Spark builds the graph of
patterns and distinct instance values and scores it in rounds: a pattern's confidence for a
kind is the mean score of the distinct values it is seen with (seeds score 1, unseen values
0 at first), a value's score the best confidence among its patterns.  Values that were not
seeds join as spans of a kind where a pattern with ``MIN_SEEDS`` or more distinct seeds of
the kind has a confidence of ``MIN_CONFIDENCE`` or more.

Only spans, contexts and values leave the texts, so texts are read once and never shuffled;
the graph is pre-aggregated to distinct (pattern, value) edges, a frequent pattern or value
being one edge however often it occurs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.llm.common import ROW_KEY, arrow_rows, bounded_batches, small, stored, with_row_key

KINDS = ["email", "ip", "card", "phone"]
ROUNDS, MIN_SEEDS, MIN_CONFIDENCE = 3, 5, 0.8
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Tried at the start of a digit run only and without going back: inside a run it would fail alike.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK, _SPACE = re.compile("[0-9@]"), re.compile(r"[\x20\x09-\x0D]")
_BLANK = " \t\n\x0b\x0c\r"
_EDGE = ".,;:!?\"'()[]{}<>|=*#$%&"


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the contract's pattern.  An ``@`` is in none of
    its classes, so each one is looked at once: the local part is the run before it (what
    an earlier match took excepted), the domain what follows."""
    out, pos, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, end := m.end()))
            pos = end
        pos = max(pos, at + 1)
        at = text.find("@", end)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _part_ok(x: str) -> bool:
    x = x.lstrip("0")
    return len(x) < 3 or len(x) == 3 and x <= "255"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in code points, by kind, then start; matches that fail a
    kind's check are dropped without another try."""
    out = [(0, *s) for s in emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_part_ok, m.group().split(".")))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append((3, *m.span()))
    return out


def _context(text: str, start: int) -> list[str]:
    """The patterns of a place: its last word, and its last two words, before it in its line."""
    before = text[max(0, start - 120):start].rsplit("\n", 1)[-1].lower().split()
    return [" ".join(before[-n:]) for n in (1, 2) if len(before) >= n]


def _marked_words(text: str) -> Iterator[tuple[int, int]]:
    """Words with a digit or an ``@``."""
    pos = 0
    while m := _MARK.search(text, pos):
        s = m.start()
        while s > pos and text[s - 1] not in _BLANK:
            s -= 1
        gap = _SPACE.search(text, m.end())
        pos = gap.start() if gap else len(text)
        yield s, pos


def instances(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds, and identifier-like words that touch no seed, with their patterns."""
    out = [{"kind": k, "start": s, "end": e, "value": text[s:e].lower(), "patterns": _context(text, s)} for k, s, e in base]
    taken = sorted((s, e) for _, s, e in base)
    i, last = 0, 0
    for s, e in _marked_words(text):
        while s < e and text[s] in _EDGE:
            s += 1
        while e > s and text[e - 1] in _EDGE:
            e -= 1
        while i < len(taken) and taken[i][0] < e:
            last = max(last, taken[i][1])
            i += 1
        if s < e and s >= last:
            out.append({"kind": -1, "start": s, "end": e, "value": text[s:e].lower(), "patterns": _context(text, s)})
    return out


_SPAN = T.StructType().add("kind", "integer").add("start", "long").add("end", "long")
_INSTANCE = T.StructType().add("kind", "integer").add("start", "long").add("end", "long").add("value", "string").add("patterns", T.ArrayType(T.StringType()))


def extract(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(``id_col``, row key, ``__hl_base`` spans, ``__hl_found`` instances) of every row."""
    bounded_batches(docs.sparkSession)
    read = with_row_key(docs.select(id_col, text_col), id_col, text_col)
    out = read.drop(text_col).schema.add("__hl_base", T.ArrayType(_SPAN)).add("__hl_found", T.ArrayType(_INSTANCE))
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    inst = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow_rows(batches):
            bases, found = [], []
            for t in b[text_col].to_pylist():
                base = base_spans(t or "")
                bases.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
                found.append(instances(t or "", base))
            yield pa.RecordBatch.from_arrays([b[id_col], *(b[k] for k in ROW_KEY), pa.array(bases, span), pa.array(found, inst)], out.names)

    return read.mapInArrow(run, out)


def confident_patterns(edges: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Distinct ``edges(pattern, value, kind)`` (kind -1: unseen) -> (``pattern``, ``kind``,
    ``confidence``) of the patterns that discover, after ``rounds`` rounds over the graph."""
    values = edges.groupBy("pattern").agg(F.count_distinct("value").alias("values"))
    seeds = edges.where("kind >= 0").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("seeds"))
    base = stored(seeds.join(values, "pattern"), "patterns")
    unseen = stored(edges.where("kind < 0").select("pattern", "value"), "unseen")
    scores = base.withColumn("confidence", F.col("seeds") / F.col("values"))
    for _ in range(rounds - 1):
        # What unseen values add to the patterns they are seen with.
        value = unseen.join(scores.where(F.col("confidence") > 0.5), "pattern").groupBy("value", "kind").agg(F.max("confidence").alias("score"))
        gain = unseen.join(value, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("gain"))
        scores = stored(base.join(gain, ["pattern", "kind"], "left").select(
            *base.columns, ((F.col("seeds") + F.coalesce("gain", F.lit(0.0))) / F.col("values")).alias("confidence")), "patterns")
    return scores.where((F.col("seeds") >= min_seeds) & (F.col("confidence") >= min_confidence)).select("pattern", "kind", "confidence")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS,
         min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(``id_col``, ``base`` and ``spans``: arrays of (kind, start, end), kind a number in
    ``KINDS``, sorted, in code points, end exclusive) of every row.

    ``spans`` holds ``base`` and what the patterns add, each added place under one kind (the
    most confident, then the first).  A null text is empty; repeated rows get equal
    results and add nothing to the scores, which count distinct values.  Empty table: no
    rows."""
    rows = stored(extract(docs, id_col, text_col), "instances")
    each = rows.select(*ROW_KEY, F.explode("__hl_found").alias("x")).select(*ROW_KEY, "x.*").select(
        *ROW_KEY, "kind", "start", "end", "value", F.explode("patterns").alias("pattern"))
    good = stored(confident_patterns(stored(each.select("pattern", "value", "kind").distinct(), "edges"), rounds, min_seeds, min_confidence), "confident")
    best = F.max(F.struct("confidence", (-F.col("new")).alias("new"))).alias("b")
    added = (each.where("kind < 0").drop("kind").join(small(good.withColumnRenamed("kind", "new")), "pattern")
             .groupBy(*ROW_KEY, "start", "end").agg(best)
             .groupBy(*ROW_KEY).agg(F.collect_set(F.struct((-F.col("b.new")).cast("int").alias("kind"), "start", "end")).alias("__hl_added")))
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    base = F.array_sort("__hl_base")
    return rows.join(added, ROW_KEY, "left").select(
        id_col, base.alias("base"), F.array_sort(F.concat("__hl_base", F.coalesce("__hl_added", none))).alias("spans"))


def _text(spans: str):
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 over all documents: doc_id, base counts, base_sha256, spans, n_added."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def n(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{KINDS[kind]}")

    return found.select("doc_id", *map(n, range(len(KINDS))), F.sha2(_text("base").cast("binary"), 256).alias("base_sha256"),
                        _text("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("bigint").alias("n_added"))
