r"""Secret scans with a token-efficiency test (operator 13).

Base spans come from three fixed patterns: values assigned to telling names, access keys,
hex runs.  The method adds spans of kind ``random``.  A BPE vocabulary has learned what
text is made of: words, names and numbers that people write come out as few long tokens,
random strings as many short ones.  Every maximal run of key characters that touches no base
span is a candidate; known digests and identifiers are taken out, and what is left is a
span if its characters per token under a tiktoken vocabulary are at most ``MAX_RATIO``.

Not random, whatever the ratio: digests (a UUID; hex in either case of a digest's length;
runs after ``sha256-`` and the like; a caller's list of them), and identifiers (no digit or
no letter at all; mostly words and numbers between ``_ - . / = +`` and at camel humps, where
digits stand at the ends of a part; URLs, paths and mail addresses by what stands beside the run).

A text is read once, where it is, and nothing is shuffled: one projection in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.llm.alignment import ship
from hirelake.llm.common import arrow_rows, bounded_batches
from hirelake.llm.tokens import BASE, TOKENIZERS, encoder

KINDS = ["assign", "access", "hex", "random"]
#: Shortest candidate, and most characters per token of a random one.  Base 62 and base 64
#: strings give 1.3 to 1.9 under the 50k vocabulary, text and names 2.5 and more.
MIN_CHARS, MAX_RATIO = 20, 2.1

# Fixed values of the contract.  ASCII: the long s and the Kelvin sign are no letters of a name.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_MIN_VALUE, _MIN_ACCESS = 12, 18

_RUN = re.compile(r"[A-Za-z0-9_+/=.-]{%d,}" % MIN_CHARS)
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_DIGEST_SIZES = {32, 40, 56, 64, 96, 128}
_ALL_HEX = re.compile(r"[0-9A-Fa-f]+")
_DIGEST_NAME = re.compile(r"(?:md5|sha-?(?:1|224|256|384|512)|blake2[bs]?|crc32)[-:=_]", re.IGNORECASE | re.ASCII)
_PART = re.compile(r"[_+/=.-]+")
_HUMP = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}(?![a-z])|[0-9]+|[A-Za-z]")
#: A hump of this many letters counts as a word; an identifier is at least so much of words and numbers.
_WORD, _WORDS_SHARE = 3, 0.6
_DIGITS = frozenset("0123456789")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) in code points of the fixed patterns, in that order."""
    out = [(*m.span(), 0) for m in _ASSIGN.finditer(text) if m.end() - m.start(2) >= _MIN_VALUE]
    out += [(*m.span(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _MIN_ACCESS]
    out += [(*m.span(), 2) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def is_digest(run: str, before: str, known: frozenset[str]) -> bool:
    """A known digest: listed, a UUID, named as one, or hex of a digest's length."""
    named = _DIGEST_NAME.match(run) or re.search(_DIGEST_NAME.pattern + r"$", before, _DIGEST_NAME.flags)
    return bool(run.lower() in known or named or _UUID.fullmatch(run) or len(run) in _DIGEST_SIZES and _ALL_HEX.fullmatch(run))


def is_identifier(run: str, before: str, after: str) -> bool:
    """A name, number, path or address that a person or program chose."""
    if before.endswith(("@", "://", "/", "\\")) or after.startswith(("@", "://", "\\")) or run.startswith(("/", "./", "//")):
        return True
    if _DIGITS.isdisjoint(run) or not any(c.isalpha() for c in run):
        return True
    total = plain = 0
    for part in _PART.split(run):
        humps = _HUMP.findall(part)
        total += len(part)
        if not any(h[0] in _DIGITS for h in humps[1:-1]):  # digits amid letters are no name's
            plain += sum(len(h) for h in humps if h[0] in _DIGITS or len(h) >= _WORD)
    return plain >= _WORDS_SHARE * total


def candidates(text: str, base: list[tuple[int, int, int]], known: frozenset[str] = frozenset()) -> list[tuple[int, int]]:
    """Maximal runs of key characters (end marks cut off) that touch no base span and are
    neither digests nor identifiers."""
    out, i, reach = [], 0, 0
    for m in _RUN.finditer(text):
        run = m.group().rstrip(".-/_")
        s = m.start() + len(run) - len(run.lstrip(".-=_"))
        e = m.start() + len(run)
        while i < len(base) and base[i][0] < e:
            reach = max(reach, base[i][1])
            i += 1
        before, after = text[max(0, s - 16):s], text[e:e + 3]
        if e - s >= MIN_CHARS and reach <= s and not is_digest(text[s:e], before, known) and not is_identifier(text[s:e], before, after):
            out.append((s, e))
    return out


_SPAN = T.StructType().add("kind", "integer").add("start", "long").add("end", "long").add("ratio", "double")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_ratio: float = MAX_RATIO, known: list[str] | None = None,
         vocabulary: str = BASE, folder: str = TOKENIZERS) -> DataFrame:
    """(``id_col``, ``spans``: array of (kind, start, end, ratio)) of every row: kind a number
    in ``KINDS``, in code points, end exclusive, sorted by start, then kind; ``ratio`` is the
    characters per token of an added span, null for base spans.

    ``known`` lists digests that are no secrets (in any case of letters).  A null text is
    empty; repeated rows and null ids are rows of their own; other columns are not read; an
    empty table gives no rows.  Runs of any length are encoded whole."""
    spark = docs.sparkSession
    bounded_batches(spark)
    name = ship(spark, f"{folder}/{vocabulary}.tiktoken")
    listed = frozenset(x.lower() for x in known or ())
    read = docs.select(id_col, F.col(text_col).alias("__hl_text"))
    out = T.StructType([docs.schema[id_col]]).add("spans", T.ArrayType(_SPAN))
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("ratio", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = SparkFiles.get(name)
        for b in arrow_rows(batches):
            rows = []
            for text in b["__hl_text"].to_pylist():
                base = base_spans(text or "")
                spans = [(*s, None) for s in base]
                for s, e in candidates(text or "", base, listed):
                    ratio = (e - s) / len(encoder(path).encode_ordinary(text[s:e]))
                    if ratio <= max_ratio:
                        spans.append((s, e, len(KINDS) - 1, ratio))
                rows.append([{"kind": k, "start": s, "end": e, "ratio": r} for s, e, k, r in sorted(spans, key=lambda x: (x[0], x[2]))])
            yield pa.RecordBatch.from_arrays([b[id_col], pa.array(rows, kind)], out.names)

    return read.mapInArrow(run, out)


def _text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str, folder: str = TOKENIZERS) -> DataFrame:
    """Operator 13 over all documents: base counts, base_sha256, spans, n_random."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder=folder)

    def n(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{KINDS[kind]}")

    base = F.filter("spans", lambda s: s["kind"] < len(KINDS) - 1)
    return found.select("doc_id", *map(n, range(len(KINDS) - 1)), F.sha2(_text(base).cast("binary"), 256).alias("base_sha256"),
                        _text(F.col("spans")).alias("spans"), n(len(KINDS) - 1))
