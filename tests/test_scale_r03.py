"""Shared steps that made the warehouse slow: the gram index, the parsers, the batch ingest."""

from pyspark.sql import functions as F

from hirelake.functions import text as T
from hirelake.operators import ngram
from hirelake.plans import warehouse as W


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_gram_index_makes_no_gram_rows(spark):
    """bitmaps are built from Arrow batches, equal to the ones of a row for every gram."""
    rows = [(i * 7919 % 100_000 - 20_000 if i % 50 else None, ["Ab c", "é가나다", None, "x" * (i % 5), f"t{i % 97}"][i % 5:] if i % 11 else None) for i in range(12_000)]
    t = spark.createDataFrame(rows + rows[:40], "id bigint, texts array<string>")
    index = ngram.gram_index(t, "id", "texts")
    assert "Generate" not in _plan(index)
    long = ngram.gram_rows(t.select("id", F.explode("texts").alias("text")).where("id is not null"), "id", "text")
    plain = long.groupBy(F.bitmap_bucket_number("tid").alias("block"), "gram").agg(F.bitmap_construct_agg(F.bitmap_bit_position("tid")).alias("bits"))
    assert {tuple(r) for r in index.collect()} == {tuple(r) for r in plain.collect()}


def test_strip_without_regex(spark):
    """every character, at both ends, as the Unicode regex has it."""
    texts = [None, "", " ", " \n", " a b\r\n"] + [f"{chr(c)}q{chr(c)}" for c in range(1, 0xd800)]
    d = spark.createDataFrame([(x,) for x in texts], "x string")
    got = d.select("x", T.strip("x").alias("s"))
    assert "regexp" not in _plan(got)
    assert got.where(~F.col("s").eqNullSafe(F.regexp_replace("x", r"(?U)^\s+|\s+$", ""))).count() == 0


def test_batch_is_parsed_once(spark):
    """what a batch ingest returns reads stored rows; no table of it parses the raw text again."""
    raw = spark.createDataFrame([(i, "2024-01-02", f"co{i % 3}", f"job{i % 4}", "경력 3년", "대졸", "정규직", "서울 강남구", "3000만원", "오늘마감", "java, sql", "dev", f"u{i}") for i in range(12)],
                                "posting_id bigint, d string, company string, title string, career_raw string, education_raw string, form_raw string, location_raw string, "
                                "salary_raw string, deadline_raw string, description_raw string, position_raw string, link string")
    raw = raw.withColumn("batch_date", F.col("d").cast("date")).withColumn("created_at", F.col("d").cast("timestamp")).drop("d")
    w1 = W.build(raw.where("posting_id < 6"))
    w2 = W.build(raw.where("posting_id >= 6"), existing=w1)
    for df in (w2.fact, w2.norm, w2.bridge, w2.quality, w2.rejects):
        assert "career_raw" not in _plan(df) or "regexp" not in _plan(df)
        assert "Scan ExistingRDD" not in _plan(df) and "LocalTableScan" not in _plan(df)
    assert w2.fact.count() == 12 and w2.companies.count() == 3
