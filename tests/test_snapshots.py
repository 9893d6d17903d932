"""The sweep equals single snapshots; merged sketches are within their rank error."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hirelake.operators import market as M
from hirelake.operators import quality as Q
from hirelake.plans import catalog as C

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("from_creation", [True, False])
def test_sweep_equals_single_snapshots(spark, from_creation):
    fact = C._wh(C._tables(spark, SMALL)).fact
    odd = fact.limit(40).withColumns({"posting_id": F.col("posting_id") + 10**9, "region_name": F.lit(None).cast("string"), "annual_salary": F.lit(None).cast(fact.schema["annual_salary"].dataType),
                                      "tags": F.array().cast("array<string>"), "experience": F.lit(-1).cast(fact.schema["experience"].dataType)})
    fact = fact.unionByName(odd).unionByName(odd.limit(5).withColumn("created_at", F.lit(None).cast("timestamp"))).cache()
    days = [dt.date(1998, 3, 18) + dt.timedelta(days=k) for k in range(90)]
    got = {r.date: r for r in M.market_snapshots(fact, str(days[0]), str(days[-1]), from_creation).collect()}
    assert sorted(got) == days
    for day in days[::9] + [days[-1]]:
        known = fact.where(F.to_date("created_at") <= F.lit(str(day)).cast("date")) if from_creation else fact
        assert rows(M.market_snapshot(known, str(day))) == [str(got[day])]
    fact.unpersist()


def test_days_without_postings_have_rows(spark):
    fact = C._wh(C._tables(spark, SMALL)).fact
    late = M.market_snapshots(fact.where("deadline < '1996-01-01'"), "1997-01-01", "1997-01-03")
    assert [(r.total_valid_jobs, r.avg_salary, r.top_tags) for r in late.collect()] == [(0, None, [])] * 3


def test_merged_sketches(spark):
    df = spark.range(200_000).select((F.pmod(F.xxhash64("id"), F.lit(9000)) * F.pmod(F.xxhash64("id"), F.lit(7))).alias("annual_salary"),
                                     F.expr("timestamp'2026-01-01' + make_interval(0, 0, 0, cast(id % 60 as int))").alias("created_at"))
    sketches = Q.salary_sketches(df.unionByName(df.limit(10).withColumn("annual_salary", F.lit(None).cast("bigint"))))
    assert sketches.count() == 60
    for start, end in (("2026-01-10", "2026-02-10"), (None, None)):
        part = df.where(F.to_date("created_at").between(start, end)) if start else df
        got = Q.sketched_salary_dist(sketches, start, end).first()
        assert got.cnt == part.count()
        for p in Q.PERCENTILES:
            v = got[f"p{int(p * 100)}"]
            below, upto = part.agg(F.avg((F.col("annual_salary") < v).cast("int")), F.avg((F.col("annual_salary") <= v).cast("int"))).first()
            assert below - 0.01 < p < upto + 0.01
    none = Q.sketched_salary_dist(sketches, "2030-01-01", None).first()
    assert none.cnt == 0 and none.p50 is None
