"""JSON fixtures (S13): relevance judgments as JSON Lines, some judgments of one query per line.

``{"query_id": 7, "rels": {"1001": 3, "1002": 0}}`` — records of about ``LINE`` judgments of
one query keep every line independent and small (a single whole-file JSON object would be
read by one task, and a query with very many judgments would be gathered in one row).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = 1000
JUDGMENT_SCHEMA = "query_id long, rels map<string, int>"


def write_judgments(judgments: DataFrame, path: str) -> None:
    parts = judgments.groupBy("query_id").agg(F.ceil(F.count(F.lit(1)) / LINE).alias("_n"))
    (judgments.join(parts, "query_id").groupBy("query_id", F.pmod(F.xxhash64("doc_id"), F.col("_n")).alias("_part"))
     .agg(F.map_from_entries(F.collect_list(F.struct(F.col("doc_id").cast("string"), F.col("rel")))).alias("rels")).drop("_part")
     .write.mode("overwrite").json(path))


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, rel) rows from JSON Lines judgment files."""
    j = spark.read.schema(JUDGMENT_SCHEMA).json(path)
    return j.select("query_id", F.explode("rels").alias("doc_id", "rel")) \
        .select("query_id", F.col("doc_id").cast("bigint").alias("doc_id"), "rel")
