"""Skew-safe building blocks: distributed ids, aggregation dedup, salted join, top-k plan."""

from pyspark.sql import functions as F

from hirelake.operators.keys import sequential_ids
from hirelake.operators.search import salted_join, top_k
from hirelake.operators.tables import first_wins_dedup


def test_sequential_ids_dense_and_ordered(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).cast("string").alias("name")).repartition(7)
    rows = sequential_ids(df, ["name"]).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(1, 5001))
    assert [r.name for r in rows] == sorted(r.name for r in rows)


def test_sequential_ids_of_many_wide_rows(spark):
    n = 3_000_000
    df = spark.range(n).select((F.col("id") * 7919 % 1000).alias("g"), F.xxhash64("id").alias("h"), F.col("id").alias("v"),
                               F.concat(F.lit("row "), F.col("id")).alias("w"))
    r = sequential_ids(df, ["g", "h"]).agg(F.count("*"), F.count_distinct("id"), F.min("id"), F.max("id"), F.count_distinct("v")).first()
    assert tuple(r) == (n, n, 1, n, n)


def test_dedup_hot_key_first_wins(spark):
    # one natural key holds most rows; the earliest arrival must win
    hot = spark.range(0, 20000).select(
        F.col("id").alias("posting_id"), F.lit("c").alias("company_name"),
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("t"), F.col("id").cast("string"))).otherwise(F.lit("hot"))
        .alias("announcement_name"),
        F.lit("2026-01-01").cast("date").alias("deadline"),
        (F.lit("2026-01-01").cast("date") + (20000 - F.col("id")).cast("int")).alias("batch_date"))
    out = first_wins_dedup(hot)
    w = out.where(F.col("announcement_name") == "hot").collect()
    assert len(w) == 1 and w[0].posting_id == 19999   # latest id has the earliest batch date
    assert out.count() == 2001
    nulls = hot.withColumn("announcement_name", F.lit(None).cast("string")).limit(5)
    assert first_wins_dedup(nulls).count() == 5         # NULL keys never collide


def test_salted_join_equals_plain_join(spark):
    big = spark.range(0, 10000).select(F.col("id").alias("pid"), (F.col("id") % 3 == 0).cast("int").alias("k"))
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k int, v string")
    a = {tuple(r) for r in salted_join(big, small, ["k"], buckets=16, salt_from="pid").select("pid", "v").collect()}
    b = {tuple(r) for r in big.join(small, "k").select("pid", "v").collect()}
    assert a == b


def test_top_k_uses_group_limit(spark):
    pairs = spark.range(0, 10000).select((F.col("id") % 3).alias("query_id"), F.col("id").alias("posting_id"))
    plan = top_k(pairs, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
