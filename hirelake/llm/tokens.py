"""Token counts as delta-maintained rollups (operator 3).

A change batch says what is true of a document under a tokenizer version: ``upsert`` (a new
or a revised count) or ``delete``.  It becomes signed entries, minus what the ledger holds
and plus what is new, and their sums by source, language and version are the batch's delta;
totals are the sum of all deltas and never recount a text.

A batch writes its entries and its delta to folders of its own name and then a commit file
set.  Only committed batches are read; a batch that was lost half-way is written again from
the start, and a committed one is skipped when it comes again, so replays change nothing.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm.common import ROW_TEXT, arrow_rows, bounded_batches, stored, with_row_key

TOKENIZERS = "/opt/tokenizers"
BASE, MULTI = "byte_bpe_50k", "byte_bpe_multi_50k"
#: How both vocabularies split a text before merging (a fixed value of these tokenizers).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LOADED: dict[str, object] = {}
ENTRY = "doc string, source string, lang string, version string, n_tokens bigint"
KEYS = ["source", "lang", "version"]


def encoder(path: str):
    """The tokenizer of a .tiktoken file, loaded once in each Python worker."""
    if path not in _LOADED:
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def count_tokens(docs: DataFrame, version: str = BASE, folder: str = TOKENIZERS, id_col: str = "doc_id", source_col: str = "source",
                 lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(``doc``, ``source``, ``lang``, ``version``, ``n_tokens``) of every row.

    ``doc`` is the id as a string; rows with a null id are named by their text's hash.
    Special tokens' strings are ordinary text; a null text has no tokens; null sources and
    languages are groups of their own."""
    bounded_batches(docs.sparkSession)
    path = f"{folder}/{version}.tiktoken"
    read = with_row_key(docs.select(id_col, source_col, lang_col, text_col), id_col, text_col).select(
        F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.col(ROW_TEXT).cast("string"))).alias("doc"),
        F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in arrow_rows(batches, 2 << 20):
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc"], b["source"], b["lang"], pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())],
                                             ["doc", *KEYS, "n_tokens"])

    return read.mapInArrow(run, ENTRY)


class Rollup:
    """Token totals kept below ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def committed(self, batch: str) -> bool:
        return self._exists(f"{self.path}/commits/batch={batch}/_SUCCESS")

    def _read(self, kind: str, schema: str) -> DataFrame:
        """What committed batches wrote; the list of batches is Spark's own partition listing."""
        if not self._exists(f"{self.path}/commits"):
            return self.spark.createDataFrame([], schema)
        done = self.spark.read.schema("ok boolean, batch string").parquet(f"{self.path}/commits").where("ok").select("batch").distinct()
        names = schema.split(", ")
        return (self.spark.read.schema(f"{schema}, batch string").option("basePath", f"{self.path}/{kind}").parquet(f"{self.path}/{kind}")
                .join(F.broadcast(done), "batch").select(*(n.split()[0] for n in names)))

    def current(self) -> DataFrame:
        """The live entry of each document and version."""
        signed = self._read("entries", f"{ENTRY}, sign int")
        return (signed.groupBy("doc", *KEYS, "n_tokens").agg(F.sum("sign").alias("sign")).where("sign > 0").drop("sign"))

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit ``changes`` (``op`` upsert or delete, then the columns of ENTRY) once;
        False if ``batch`` is already committed.  Of several changes of one document and
        version a delete wins, then the largest count (ties: the largest source and
        language), so the order of rows does not matter.  Deleting what is not there, and
        an upsert of what is there unchanged, add nothing."""
        if self.committed(batch):
            return False
        last = F.max(F.struct((F.col("op") == "delete").alias("gone"), "n_tokens", "source", "lang")).alias("x")
        new = changes.groupBy("doc", "version").agg(last).select("doc", "version", "x.*")
        old = self.current().select("doc", "version", F.struct("source", "lang", "n_tokens").alias("old"))
        both = new.join(old, ["doc", "version"], "left").withColumn("new", F.struct("source", "lang", "n_tokens"))
        both = both.select("doc", "version", "old", F.when(~F.col("gone"), F.col("new")).alias("new")).where("not (old <=> new)")
        part = lambda c, s: F.struct(F.col(c).alias("e"), F.lit(s).alias("sign"))
        signed = (both.select("doc", "version", F.explode(F.array(part("old", -1), part("new", 1))).alias("p")).where("p.e is not null")
                  .select("doc", "p.e.source", "p.e.lang", "version", "p.e.n_tokens", "p.sign"))
        folder = f"{self.path}/entries/batch={batch}"
        signed.write.mode("overwrite").parquet(folder)
        signed = self.spark.read.schema(f"{ENTRY}, sign int").parquet(folder)
        delta = signed.groupBy(*KEYS).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
        delta.write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch}")
        self.spark.range(1).select(F.lit(True).alias("ok")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """(``source``, ``lang``, ``version``, ``n_docs``, ``n_tokens``) of what is live."""
        deltas = self._read("deltas", "source string, lang string, version string, n_docs bigint, n_tokens bigint")
        return (deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs > 0"))


def query(spark: SparkSession, sf_dir: str, folder: str = TOKENIZERS) -> DataFrame:
    """Operator 3 over all documents, as four batches: all documents are counted; later
    copies of a text (all but its smallest id) are deleted; what is left in languages other
    than English is counted anew by the multilingual tokenizer in place of the first count;
    and the deletes come a second time, which changes nothing."""
    import uuid

    from hirelake.session import checkpoint_dir

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rollup = Rollup(spark, f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}")
    rollup.apply("load", count_tokens(docs, BASE, folder).withColumn("op", F.lit("upsert")))
    text = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    ids = docs.select(F.col("doc_id"), text.alias("t"))
    first = ids.groupBy("t").agg(F.min("doc_id").alias("first"))
    copies = stored(ids.join(first, "t").where("doc_id > first").select(F.col("doc_id").cast("string").alias("doc")), "copies")
    empty = [F.lit(None).cast("string").alias(c) for c in ("source", "lang")]
    deletes = copies.select(F.lit("delete").alias("op"), "doc", *empty, F.lit(BASE).alias("version"), F.lit(0).cast("bigint").alias("n_tokens"))
    rollup.apply("copies", deletes)
    foreign = docs.where("lang <> 'en'").withColumn("__hl_doc", F.col("doc_id").cast("string"))
    foreign = foreign.join(copies, F.col("__hl_doc") == F.col("doc"), "left_anti")
    moved = rollup.current().where("lang <> 'en'").withColumn("op", F.lit("delete"))
    rollup.apply("recount", count_tokens(foreign, MULTI, folder).withColumn("op", F.lit("upsert")).unionByName(moved))
    rollup.apply("copies", deletes)
    return rollup.totals().withColumnRenamed("version", "tokenizer_version")
