"""Plan properties: no Python in the parse jobs, pushdown reaches the scan."""

from hirelake.operators.normalize import normalize_postings
from hirelake.plans.catalog import QUERIES
from hirelake.sources.fixtures import Tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_normalize_has_no_python(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    p = plan(normalize_postings(t["postings_raw"]))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_searches_never_pair_patterns_with_texts(spark):
    for name in ("ngram_search", "search_name_only", "salary_by_keyword"):
        p = plan(QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "CartesianProduct" not in p


def test_index_lookup_prunes_buckets(spark):
    from hirelake.operators import ngram
    from hirelake.plans import catalog as C
    index = C._wh(Tables(spark, "/root/testdata/sf0.001")).gram_index
    asked = spark.createDataFrame([(1, "ring", ["ri", "in", "ng"])], "_pid int, _pat string, _grams array<string>")
    p = plan(ngram.candidates(asked, index))
    assert "bucket" in p and "dynamicpruning" in p


def test_list_valid_pushes_the_deadline_down(spark):
    p = plan(QUERIES["list_valid"](spark, "/root/testdata/sf0.001"))
    assert "GreaterThanOrEqual(deadline" in p and "TakeOrderedAndProject" in p
