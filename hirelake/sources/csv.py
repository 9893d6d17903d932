"""CSV loader (S1, S3): header-named posting files, UTF-8 with or without BOM.

Columns are read as strings by an explicit schema (no inference pass).  The reference
date of relative deadlines is the first ``YYYY-MM-DD`` in the file path, else
``as_of``; a file with neither is rejected as a whole.  Files are ordered by name: the arrival ordinal is (file name, line).
Malformed lines land in ``_corrupt`` and are returned as rejects, not dropped silently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.keys import sequential_ids
from ..session import materialize

# FIXED VALUES: the header names of the posting CSV files, in file order
CSV_HEADER = ["기업명", "공고명", "경력", "학력", "형태", "지역", "연봉", "마감일", "설명", "링크"]
RAW_NAMES = ["company", "title", "career_raw", "education_raw", "form_raw", "location_raw",
             "salary_raw", "deadline_raw", "description_raw", "link"]
PATH_DATE = r"(\d{4})-(\d{2})-(\d{2})"


def read_csv_postings(spark: SparkSession, path: str, as_of: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(raw posting rows, refused rows with the reason in ``_corrupt``: the malformed line,
    or ``no date``) of the CSV files below ``path``."""
    schema = T.StructType([T.StructField(h, T.StringType()) for h in CSV_HEADER]
                          + [T.StructField("_corrupt", T.StringType())])
    df = (spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True)
          .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
          .schema(schema).csv(path))
    file = F.col("_metadata.file_path")
    d = F.regexp_extract(file, PATH_DATE, 0)
    today = F.coalesce(F.try_to_date(F.when(d != "", d), "yyyy-MM-dd"), F.lit(as_of).cast("date"))
    df = df.select(*[F.col(h).alias(n) for h, n in zip(CSV_HEADER, RAW_NAMES)], "_corrupt",
                   file.alias("source_file"), F.col("_metadata.file_block_start").alias("_blk"),
                   today.alias("batch_date"))
    df = materialize(df.withColumn("_corrupt", F.coalesce("_corrupt", F.when(F.col("batch_date").isNull(), F.lit("no date"))))
                     .withColumn("_mid", F.monotonically_increasing_id()), "csv-rows")
    bad = df.where(F.col("_corrupt").isNotNull()).select("source_file", "_corrupt", *RAW_NAMES)
    ok = (df.where(F.col("_corrupt").isNull()).drop("_corrupt")
          .withColumn("position_raw", F.lit(None).cast("string"))
          .withColumn("created_at", F.col("batch_date").cast("timestamp")))
    raw = sequential_ids(ok, ["source_file", "_blk", "_mid"], id_col="posting_id").drop("_blk", "_mid")
    return raw, bad
