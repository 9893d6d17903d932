"""Edge cases of the posting normalisation (own strings, one row per case)."""

from pyspark.sql import functions as F

from hirelake.functions import text as T


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_sanitize(spark):
    assert one(spark, T.sanitize("v"), None) is None
    assert one(spark, T.sanitize("v"), "") is None
    assert one(spark, T.sanitize("v"), "　 \t") is None
    assert one(spark, T.sanitize("v"), ",,,") is None
    assert one(spark, T.sanitize("v"), "　a, b\t") == "a b"


def test_experience(spark):
    e = T.parse_experience("v")
    assert one(spark, e, "신입·경력 3년") == 0
    assert one(spark, e, "경력무관") == 0
    assert one(spark, e, "경력 40년↑") == 40
    assert one(spark, e, "") is None
    assert one(spark, e, "12345678901234567890123") is None  # beyond bigint -> null
    v = T.validate_experience(F.lit(40))
    assert one(spark, v["rule"], "x") == "above_maximum(30)"


def test_salary(spark):
    s = T.parse_salary("v")
    assert one(spark, s, "3,200만원") == 3200
    assert one(spark, s, "3천만원") == 3
    assert one(spark, s, "2400~9000만원") == 2400
    assert one(spark, s, "월 0만원") is None
    assert one(spark, s, "월급 250만원") == 3000
    assert one(spark, s, "일급 12만원") is None
    assert one(spark, s, "협의") is None
    assert one(spark, T.validate_salary(F.lit(3))["rule"], "x") == "below_minimum(600)"


def test_region(spark):
    r = T.parse_region("v")
    assert one(spark, r, "서울 강남구 외").asDict() == {"region": "서울", "subregion": "강남구"}
    assert one(spark, r, "외국계 서울").asDict() == {"region": "국계", "subregion": "서울"}
    assert one(spark, r, "서울 정규직") is None
    assert one(spark, r, "부산") .asDict() == {"region": "부산", "subregion": None}
    assert one(spark, r, "  ") is None


def test_form_and_education(spark):
    f = T.parse_form("v")
    assert one(spark, f, "계약직·정규직") == 1      # vocabulary order, not text order
    assert one(spark, f, "3000만원") is None
    assert one(spark, f, "개인사업자") == 6
    assert one(spark, f, "교육생") == 8
    assert one(spark, T.parse_education("v"), " 대졸↑ ") == 3
    assert one(spark, T.parse_education("v"), "대졸") is None


def test_deadline(spark):
    df = spark.createDataFrame(
        [("~02/30(월)", "2026-03-15"), ("~02/29", "2027-01-10"), ("~02/29", "2028-01-10"),
         ("~03/14", "2026-03-15"), (" 오늘마감 ", "2026-03-15"), ("모레마감", "2026-12-31"),
         ("상시채용", "2026-03-15"), (None, "2026-03-15"), ("마감 ~05/01", "2026-03-15")],
        "v string, d string").withColumn("d", F.col("d").cast("date"))
    rows = df.select(T.parse_deadline("v", F.col("d")).alias("r")).collect()
    got = [(str(r.r.deadline) if r.r.deadline else None, r.r.error) for r in rows]
    assert got == [(None, True), (None, True), ("2028-02-29", False), ("2027-03-14", False),
                   ("2026-03-15", False), ("2027-01-02", False), ("9999-12-31", False),
                   ("9999-12-31", False), ("9999-12-31", False)]


def test_tags(spark):
    df = spark.createDataFrame([("Vue, JAVA,, java , Vue", "STEEL·red ring,JAVA")], "d string, p string")
    tags = df.select(T.merge_tags(T.parse_description_tags("d"), T.parse_position_tags("p")).alias("t")).first().t
    assert tags == ["Vue.js", "Java", "java", "STEEL", "red ring", "JAVA"]
