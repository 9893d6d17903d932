"""Cross-tokenizer alignment by interval coalescing (operator 12).

Two tokenizers cut the same bytes (a space, then the text) into tokens; A is a byte-level
BPE, B a piece BPE with byte fallback.  For a batch of texts all tokens of A and B are laid
on one byte axis and sorted by start; ``maximum.accumulate`` over the ends gives how far
the tokens seen so far reach, and a group begins where a start reaches that maximum: the
groups are the smallest stretches that both tokenizers cut alike.  Within them every pair
of tokens that share a byte is a link, found by two binary searches for each A token and
expanded by ``repeat``; two tilings of a text have fewer links than tokens together.

Documents are read and encoded once.  What is counted over the corpus are distinct id pairs
of a document with their number of links: they are pre-aggregated in the tasks before they
move, and their counts come back by a join that is broadcast only after a count has shown
how many pairs there are, else shuffled with Spark's skew split.
"""

from __future__ import annotations

import json
import os
import random
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.llm.common import arrow_rows, bounded_batches, encoded, small, stored
from hirelake.llm.tokens import PATTERN, TOKENIZERS

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Most distinct id pairs whose counts are broadcast (about 64 bytes each in memory).
BROADCAST_PAIRS = 1 << 20
#: Ids of both vocabularies have fewer bits than this; with the document they make one sort key.
_BITS = 20
_LOADED: dict[str, tuple[Callable[[list[str]], list[list[int]]], list[bytes]]] = {}
_SHIPPED: set[tuple[str, str]] = set()


def _alphabet() -> dict[str, int]:
    """Byte of each character of the byte-level alphabet: printable Latin-1 characters
    stand for themselves, the other bytes for the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(0x100) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _byte_level(path: str) -> tuple[Callable, list[bytes]]:
    """Encoder and token bytes of a byte-level BPE file.  Where its merges stand in the
    order of their ids and its splitting rule is the usual one, which is checked, ranks say
    all and the quicker tiktoken encodes; else the tokenizers library does."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte, vocab, special = _alphabet(), spec["model"]["vocab"], {t["content"] for t in spec["added_tokens"] if t["special"]}
    table = {i: w.encode() if w in special else bytes(byte[c] for c in w) for w, i in vocab.items()}
    size = max([*table, *(t["id"] for t in spec["added_tokens"])]) + 1
    tokens = [table.get(i, b"") for i in range(size)]
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in spec["model"]["merges"]]
    order = [vocab[m] for m in merges]
    usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if order == sorted(order) and spec["normalizer"] is None and usual.items() <= (spec["pre_tokenizer"] or {}).items():
        import tiktoken
        ranks = {table[i]: i for w, i in vocab.items() if w not in special}
        enc = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [enc.encode_ordinary(t) for t in texts], tokens
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
    from tokenizers import Tokenizer
    enc = Tokenizer.from_file(path)
    enc.encode_special_tokens = True
    return lambda texts: [e.ids for e in enc.encode_batch(texts, add_special_tokens=False)], tokens


def _pieces(path: str) -> tuple[Callable, list[bytes]]:
    import sentencepiece
    enc = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = [bytes([int(enc.id_to_piece(i)[1:-1], 16)]) if enc.is_byte(i) else enc.id_to_piece(i).replace("▁", " ").encode()
              for i in range(enc.vocab_size())]
    return lambda texts: enc.encode(texts, num_threads=1), tokens


def tokenizer(path: str) -> tuple[Callable[[list[str]], list[list[int]]], list[bytes]]:
    """(encoder of a list of texts, bytes of each id), loaded once in each Python worker.
    Encoders of piece models put a space before a text themselves."""
    if path not in _LOADED:
        _LOADED[path] = _byte_level(path) if path.endswith(".json") else _pieces(path)
    return _LOADED[path]


def ship(spark: SparkSession, path: str) -> str:
    """Send a file to the executors, once for each application; its name there."""
    sc = spark.sparkContext
    if (sc.applicationId, path) not in _SHIPPED:
        sc.addFile(path)
        _SHIPPED.add((sc.applicationId, path))
    return os.path.basename(path)


def _lists(values: pa.Array, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


class Aligner:
    """Alignment of batches of texts by two tokenizer files."""

    def __init__(self, a: str, b: str) -> None:
        self.encode_a, self.bytes_a = tokenizer(a)
        self.encode_b, self.bytes_b = tokenizer(b)
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # A token as it is written in a group: after what stands before it.
        written = [f"{mark}{i}" for mark, t in ((";", self.bytes_a), (",", self.bytes_a), ("|", self.bytes_b), (",", self.bytes_b)) for i in range(len(t))]
        self.written = np.array(written, object)

    def ids(self, texts: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each text under both; none where it is empty or the bytes differ."""
        plain = [t.decode() for t in texts]
        a = self.encode_a([f" {t}" if t else "" for t in plain])
        b = self.encode_b(plain)
        for i, t in enumerate(texts):
            whole = b" " + t
            if not t or b"".join(map(self.bytes_a.__getitem__, a[i])) != whole or b"".join(map(self.bytes_b.__getitem__, b[i])) != whole:
                a[i], b[i] = [], []
        return a, b

    def __call__(self, texts: list[bytes]) -> dict[str, np.ndarray | pa.Array]:
        a_ids, b_ids = self.ids(texts)
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a_ids, b_ids))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (a_ids, b_ids))
        docs = len(texts)
        doc_a, doc_b = np.repeat(np.arange(docs), n_a), np.repeat(np.arange(docs), n_b)
        # One byte axis for the whole batch: both sides of a text have the same length.
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        start_a, start_b = end_a - self.size_a[a], end_b - self.size_b[b]
        start, end = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
        order = np.lexsort((end, start))
        reach = np.maximum.accumulate(end[order])
        first = np.ones(len(order), bool)
        first[1:] = start[order][1:] >= reach[:-1]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(first) - 1
        group_a, group_b = group[: len(a)], group[len(a):]

        lead_a, lead_b = (np.concatenate([[True], g[1:] != g[:-1]])[: len(g)] for g in (group_a, group_b))
        n_groups = np.bincount(doc_a[lead_a], minlength=docs)
        place = np.concatenate([np.where(lead_a, 0, len(self.bytes_a)) + a, 2 * len(self.bytes_a) + np.where(lead_b, 0, len(self.bytes_b)) + b])
        row = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        words = self.written[place[row]].tolist()
        cut = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        groups = ["".join(words[i:j])[1:] for i, j in zip(cut, cut[1:])]

        low, high = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
        n = high - low
        at = np.repeat(np.arange(len(a)), n)
        other = np.arange(len(at)) + np.repeat(low - (np.cumsum(n) - n), n)
        key = (doc_a[at] << 2 * _BITS) | (a[at] << _BITS) | b[other]
        pair, times = np.unique(key, return_counts=True)
        ends = np.searchsorted(pair, np.arange(docs + 1) << 2 * _BITS)
        low_bits = (1 << _BITS) - 1
        links = pa.StructArray.from_arrays([pa.array((pair >> _BITS) & low_bits, pa.int32()), pa.array(pair & low_bits, pa.int32()), pa.array(times, pa.int32())],
                                           ["a", "b", "n"])
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": np.bincount(doc_a[at], minlength=docs), "groups": pa.array(groups, pa.string()),
                "links": _lists(links, ends)}


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = A, b: str = B, folder: str = TOKENIZERS) -> DataFrame:
    """(``id_col``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups``, ``links``, row
    number ``__hl_task``, ``__hl_row``) of every row.

    ``groups`` writes the alignment as ``a1,a2|b1;a3|b2,b3``; ``links`` holds (a, b, n) for
    each distinct id pair, n being how many links have it.  Null and empty texts, and texts
    that either tokenizer does not give back byte for byte (B writes U+2581 as a space),
    have no tokens.  Strings of special tokens are plain text.  Repeated rows and null ids
    are rows of their own; other columns are not read; an empty table gives no rows.
    ``__hl_task`` is drawn at random by each task, so store the result before it is read
    twice."""
    spark = docs.sparkSession
    bounded_batches(spark)
    names = [ship(spark, f"{folder}/{x}") for x in (a, b)]
    read = docs.select(id_col, F.col(text_col).alias("__hl_text"))
    out = T.StructType([docs.schema[id_col]])
    for c in ("n_a", "n_b", "n_groups", "n_links"):
        out.add(c, "long")
    pair = T.StructType().add("a", "integer").add("b", "integer").add("n", "integer")
    out.add("groups", "string").add("links", T.ArrayType(pair)).add("__hl_task", "long").add("__hl_row", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*map(SparkFiles.get, names))
        task, row = random.SystemRandom().getrandbits(62), 0
        for part in arrow_rows(batches, 1 << 20):
            got = aligner(encoded(part["__hl_text"]))
            size = part.num_rows
            got |= {id_col: part[id_col], "__hl_task": np.full(size, task), "__hl_row": np.arange(row, row + size)}
            row += size
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in map(got.get, out.names)], out.names)

    return read.mapInArrow(run, out)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(``a``, ``b``, ``docs``, ``best``) of every linked id pair: how many rows of
    ``aligned`` hold it, and whether no other pair of its A id is held by more."""
    counts = stored(aligned.select(F.explode("links").alias("l")).groupBy("l.a", "l.b").agg(F.count(F.lit(1)).alias("docs")), "pairs")
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return stored(counts.join(most, "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best")), "pair_counts")


def weigh(aligned: DataFrame, counts: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(``__hl_task``, ``__hl_row``, ``n_best``, ``count_sum``) of the rows with links: the
    links whose pair is its A id's best, and the sum of all links' counts."""
    each = aligned.select("__hl_task", "__hl_row", F.explode("links").alias("l")).select("__hl_task", "__hl_row", "l.a", "l.b", "l.n")
    return (each.join(small(counts, broadcast_pairs), ["a", "b"])
            .groupBy("__hl_task", "__hl_row")
            .agg(F.sum(F.when(F.col("best"), F.col("n").cast("bigint")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum")))


def query(spark: SparkSession, sf_dir: str, folder: str = TOKENIZERS) -> DataFrame:
    """Operator 12 over all documents: token, group and link counts, the groups' digest, and
    how usual the links are in the corpus."""
    aligned = align(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder=folder)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256)).alias("groups_sha256")
    aligned = stored(aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "links", "__hl_task", "__hl_row"), "aligned")
    sums = weigh(aligned, pair_counts(aligned))
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_best", "count_sum")]
    return aligned.join(sums, ["__hl_task", "__hl_row"], "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
