"""Query parsing: hand-written cases, and Spark vs the DuckDB statement of F2."""

import random

import duckdb

from hirelake.operators.queryparse import first_contained, parse_queries
from oracle.parse import parse_ctes

CASES = [
    "연봉 9천", "경력 0년 신입 공고", "서울시 백엔드", "개발자 공고 보여줘", "부산 채용 공고",
    "삼성 채용", "FE 인턴 5천만원 이상", "13월 마감 공고", "다음 달 마감 데이터분석가",
    "1억 2천만원 연봉 경력 3년차 서울 정규직", "오늘 마감 연봉 3000", "카카오 공고",
    "이번달 인천 계약직 3년 이상", "2월 마감 UX 디자이너", "경기 프리랜서 데이터 분석 150만원",
    "　대전  아르바이트\t주말 ", "", "백엔드 개발자 구해요",
]
AS_OF = "2026-03-15"


def test_known_outputs(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "query_id int, text string")
    r = {x.query_id: x for x in parse_queries(df, AS_OF).collect()}
    assert (r[0].min_annual_salary, r[0].keyword) == (9, "천")
    assert (r[1].max_experience, r[1].keyword) == (0, "0년")
    assert (r[2].region, r[2].keyword) == ("서울", "시 백엔드")
    assert r[3].company_name is None and r[3].keyword == "개발자"
    assert r[4].region == "부산" and r[4].company_name is None
    assert r[5].company_name == "삼성"
    assert (r[6].keyword, r[6].form_code, r[6].min_annual_salary) == ("프론트엔드", 3, 5000)
    assert r[7].error is True
    assert str(r[8].min_deadline) == "2026-04-01" and r[8].keyword == "데이터 분석"
    assert (r[9].min_annual_salary, r[9].max_experience, r[9].form_code) == (12000, 3, 1)
    assert str(r[13].min_deadline) == "2027-02-01"


def test_matches_duckdb(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "query_id int, text string")
    regions = ["서울", "경기", "인천", "부산", "대전"]
    s = {x.query_id: (x.keyword, x.region, x.form, x.form_code, x.max_experience, x.min_annual_salary,
                      str(x.min_deadline) if x.min_deadline else None, x.company_name, x.error)
         for x in parse_queries(df, AS_OF, regions=regions).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE qs(query_id INT, text VARCHAR)")
    con.executemany("INSERT INTO qs VALUES (?, ?)", list(enumerate(CASES)))
    con.execute("CREATE TABLE rv(name VARCHAR)")
    con.executemany("INSERT INTO rv VALUES (?)", [(r,) for r in regions])
    rows = con.execute("WITH " + parse_ctes("qs", AS_OF, "rv") + " SELECT * FROM pq").fetchall()
    d = {r[0]: (r[2], r[3], r[4], r[5], r[6], r[7], str(r[8]) if r[8] else None, r[9], r[10]) for r in rows}
    assert s == d


def test_vocabulary_tables_equal_lists(spark):
    """The same vocabularies as tables and as lists; nulls, empty and repeated words."""
    df = spark.createDataFrame([*enumerate(CASES), (90, None), (91, "쿠팡 공고"), (92, "배달 채용 부산 서울")], "query_id int, text string")
    regions, jobs = ["서울", "경기", "인천", "부산", "대전"], ["삼성", "배달"]
    words = spark.createDataFrame([(w, i) for i, w in enumerate(regions)] + [("부산", 9), ("", -1), (None, -2)], "word string, ord int")
    from hirelake.functions import vocab as V
    as_list = parse_queries(df, AS_OF, regions=regions, job_keywords=V.JOB_KEYWORDS + jobs)
    as_table = parse_queries(df, AS_OF, regions=words, job_keywords=spark.createDataFrame([(w,) for w in [*jobs, *jobs, None]], "word string"))
    assert as_table.columns == as_list.columns
    assert sorted(map(str, as_table.collect())) == sorted(map(str, as_list.collect()))
    assert {r.query_id: r.company_name for r in as_table.collect()}[91] == "쿠팡"


def test_first_contained_by_brute_force(spark):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("가나ab ") for _ in range(n))
    words = [(word(rnd.randint(1, 5)), rnd.randint(0, 10**6)) for _ in range(300)]
    texts = [word(rnd.randint(0, 12)) for _ in range(400)]
    got = {r.text: r.word for r in first_contained(spark.createDataFrame([(t,) for t in texts + texts], "t string"), "t",
                                                   spark.createDataFrame(words, "word string, ord int")).collect()}
    want = {}
    for t in texts:
        hits = [(o, w) for w, o in words if w in t]
        if hits:
            want[t] = min(hits)[1]
    assert got == want
    none = spark.createDataFrame([], "word string, ord int")
    assert first_contained(spark.createDataFrame([("a",)], "t string"), "t", none).count() == 0
