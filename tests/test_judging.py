"""Rule judgments, stratified sample and reranking against values worked out by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from hirelake.operators import assist as A
from hirelake.operators import evaluate as E

CAND = "query_id int, posting_id int, title string, region string, form string, experience string, salary string"
RULE = ("query_id int, keywords array<string>, regions array<string>, req_form string, exp_kind string, exp_years int, "
        "min_salary int, must_have array<string>, floor int, ceiling int, bonus array<string>")


def judge(spark, cand, rule):
    c = spark.createDataFrame([(1, 1, *cand)], CAND)
    r = spark.createDataFrame([(1, *rule)], RULE)
    return E.rule_judgments(c, r).first().rel


@pytest.mark.parametrize("experience, want", [("신입", 3), ("무관", 3), (None, 3), ("1년 이상", 2), ("2년 이상", 1)])
def test_newcomer_query_by_years(spark, experience, want):
    rule = (["dev"], [], None, "신입", None, None, None, None, None, None)
    assert judge(spark, ("a Dev b", "서울", None, experience, None), rule) == want


def test_one_year_with_region_mismatch(spark):
    assert judge(spark, ("dev", "부산", None, "1년 이상", None), (["dev"], ["서울"], None, "신입", None, None, None, None, None, None)) == 1


@pytest.mark.parametrize("years, want", [(5, 3), (4, 2), (3, 1)])
def test_asked_years(spark, years, want):
    assert judge(spark, ("dev", "x", None, f"{years}년 이상", None), ([], [], None, "years", 5, None, None, None, None, None)) == want


def test_rules_of_single_queries(spark):
    base = ([], [], None, None, None, None)
    cand = lambda t: (t, "x", None, None, None)
    assert judge(spark, cand("서버 개발"), (*base, ["백엔드", "서버"], 1, None, None)) == 2
    assert judge(spark, cand("디자인"), (*base, ["백엔드", "서버"], 1, None, None)) == 0
    assert judge(spark, cand("any"), (*base[:3], "신입", None, None, None, None, 2, None)) == 2
    assert judge(spark, cand("Growth lead"), (*base, None, None, 2, ["그로스", "Growth"])) == 3
    assert judge(spark, cand("lead"), (*base, None, None, 2, ["그로스", "Growth"])) == 2
    assert judge(spark, (None, None, "계약직", None, "1000만원/년"), ([], [], "정규직", None, None, 3000, None, None, None, None)) == 0


def test_sample_truncates_refills_and_takes_nulls(spark):
    rows = [(i, None if i % 10 == 0 else i < 4) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, tagged boolean")
    got = {r.id for r in E.stratified_sample(df, "id", F.col("tagged"), 15).collect()}
    key = lambda i: (hashlib.md5(f"{i}:42".encode()).hexdigest(), i)
    yes = [i for i, t in rows if t]
    rest = sorted((i for i, t in rows if not t), key=key)
    assert got == set(yes) | set(rest[:15 - len(yes)]) and len(got) == 15
    many = spark.range(100).select("id", F.lit(True).alias("tagged"))
    assert E.stratified_sample(many, "id", F.col("tagged"), 15).count() == 10


def test_rerank_batches_fail_alone(spark):
    res = spark.createDataFrame([(1, i, 100 + i, "and") for i in range(1, 14)], "query_id bigint, rank int, posting_id bigint, mode string")
    fact = spark.createDataFrame([(100 + i, f"title {i}", ["t"] * 7) for i in range(1, 14)], "posting_id bigint, announcement_name string, tags array<string>")
    q = spark.createDataFrame([(1, "word")], "query_id bigint, keyword string")

    def answer(items, query):
        assert len(items) <= 10 and all(x["text"].count(" t") == 5 + 0 for x in items)
        if items[0]["rank"] > 10:
            raise TimeoutError
        return "1, 9，x, 3\n7"

    got = [(r.posting_id, r.score) for r in A.rerank(res, fact, q, answer).orderBy("rank").collect()]
    assert got[0] == (102, 9.0) and got[-2:] == [(103, 3.0), (101, 1.0)]
    assert [p for p, s in got[1:-2]] == [100 + i for i in range(4, 14)] and {s for _, s in got[1:-2]} == {5.0}
