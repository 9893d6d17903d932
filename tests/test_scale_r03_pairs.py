"""F1-F27 of round 3: pairs stay where they are made, tables are made when they are read."""

from pyspark.sql import functions as F

from hirelake.operators import alerts as AL
from hirelake.operators import market as M
from hirelake.operators import search as SR
from hirelake.operators import tables as S
from hirelake.plans import catalog as C
from hirelake.sources.fixtures import Tables
from hirelake.streaming import jobs as ST

SMALL = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _inputs(spark):
    posts = spark.createDataFrame(
        [(i if i % 23 else None, ["red job", "blue job", "red ring job", "plain"][i % 4], ["tag red"] if i % 5 == 0 else None,
          [None, "", "Seoul Gangnam", "Busan"][i % 4], [None, 1, 2][i % 3], [None, 0, 3, 9][i % 4], [None, 2500, 4000][i % 3]) for i in range(60)]
        + [(7, "red again", None, "Seoul", 1, 1, 3000)],
        "posting_id bigint, announcement_name string, tags array<string>, region_name string, form bigint, experience bigint, annual_salary bigint")
    subs = spark.createDataFrame(
        [(f"u{u}" if u else None, k, [None, "red", "blue", "ring", " "][(u + k) % 5]) for u in range(12) for k in range(1, 1 + u % 4)]
        + [("u3", 2, "red"), ("u3", 2, "blue"), ("u5", None, "red")], "user_id string, seq int, keyword string")
    prof = spark.createDataFrame([("u1", "Seoul", 1, None, None), ("u2", None, None, 3, 3000), ("u3", "", 2, 5, None), ("u3", "Busan", None, None, None),
                                  ("u5", "Seoul", None, 5, None), ("u7", "Gang", None, None, 2000)],
                                 "user_id string, region string, form bigint, max_experience bigint, min_salary bigint")
    return posts, subs, prof


def test_first_hits_equal_grouped_pairs_and_no_pair_is_shuffled(spark):
    """The first hit is decided where a pair is made; odd users and ids as by grouping."""
    posts, subs, prof = _inputs(spark)
    every = AL.match_subscriptions(posts, subs, prof)
    plan = _plan(every)
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    first = AL.user_matches(AL.match_subscriptions(posts, subs, prof, first=True))
    want = sorted(map(str, AL.user_matches(every).select("user_id", "posting_id", "seq").collect()))
    assert want and sorted(map(str, first.collect())) == want


def test_offers_in_several_blocks(spark, monkeypatch):
    """the offers may be many broadcasts; the pairs are the same."""
    posts, subs, prof = _inputs(spark)
    one = sorted(map(str, AL.match_subscriptions(posts, subs, prof).collect()))
    monkeypatch.setattr(AL, "OFFERS_OF_BLOCK", 40)
    assert sorted(map(str, AL.match_subscriptions(posts, subs, prof).collect())) == one


def test_pending_and_log_by_lists(spark):
    """nulls never equal in the subtraction, and equal in the log's keys."""
    big = 1 << 23
    now = spark.createDataFrame([("a", 1, 1), ("a", big, 2), (None, 1, 1), ("b", None, 1), ("b", 5, 3), ("c", 9, 1)], "user_id string, posting_id bigint, seq int")
    log = spark.createDataFrame([("a", 1), ("a", 1), (None, 1), ("b", None), ("b", 6), ("c", big)], "user_id string, posting_id bigint")
    pending = AL.alerts_pending(now, log)
    want = now.join(log, ["user_id", "posting_id"], "left_anti")
    assert pending.columns == want.columns and "posting_id" not in _plan(pending).split("Exchange hashpartitioning(")[1].split(")")[0]
    assert sorted(map(str, pending.collect())) == sorted(map(str, want.collect()))
    union = log.unionByName(pending.select("user_id", "posting_id")).distinct()
    assert sorted(map(str, AL.alert_log(log, pending).collect())) == sorted(map(str, union.collect()))


def test_children_of_expired_postings_are_not_shuffled(spark):
    """a log's rows stay where they are if few postings are in it."""
    fact = spark.createDataFrame([(i, "2024-01-01" if i % 2 else "2023-01-01") for i in range(50)], "posting_id bigint, d string").withColumn("deadline", F.col("d").cast("date"))
    log = spark.createDataFrame([(f"u{u}", i) for u in range(4) for i in (1, 2, 3, 99, None)], "user_id string, posting_id bigint")
    _, (kept,) = S.expire_postings(fact, "2023-06-01", [log])
    assert "BroadcastHashJoin" in _plan(kept)
    assert sorted(map(tuple, kept.select("user_id", "posting_id").collect())) == sorted((f"u{u}", i) for u in range(4) for i in (1, 3))


def test_folder_of_many_rows_is_written_by_many_tasks(spark, tmp_path):
    """rows of a folder may be split over tasks."""
    new = spark.range(10).select(F.col("id").alias("posting_id"), F.lit("x").alias("part"))
    seen = {}

    def spy(df):
        seen["plan"] = df._jdf.queryExecution().analyzed().toString()
        return df.write

    class Spy:
        def __init__(self, df): self.df = df
        def withColumn(self, *a): return Spy(self.df.withColumn(*a))
        def hint(self, *a): return Spy(self.df.hint(*a))
        def repartition(self, *a): return Spy(self.df.repartition(*a))
        @property
        def write(self): return spy(self.df)

    ST.write_parts(Spy(new), str(tmp_path / "sink"), 0)
    assert "RebalancePartitions" in seen["plan"]
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 10


def test_warehouse_tables_are_stored_when_read(spark):
    """a query of the fact alone builds no gram index and no dimension."""
    import os
    from hirelake.plans import warehouse as W
    from hirelake.session import scratch
    path = scratch(spark, "lazy").removeprefix("file:")
    w = W.build_stored(Tables(spark, SMALL).postings_stream(), path)
    assert w.fact.count() > 0 and sorted(os.listdir(path)) == ["fact", "norm"]
    assert w.tags.count() > 0 and w.gram_index.count() > 0 and {"bridge", "tags", "gram_index"} <= set(os.listdir(path))


def test_scan_reads_a_text_once(spark):
    """no nested loop over the keywords."""
    fact = spark.createDataFrame([(1, "Red Ring", ["a red tag", None]), (2, None, ["RING"]), (3, "x%y", None)], "posting_id bigint, announcement_name string, tags array<string>")
    kws = spark.createDataFrame([("red",), ("Ring",), ("x\\%",), ("r_ng",)], "keyword string").withColumn("kid", F.col("keyword"))
    hits = M.keyword_hits(fact, kws, method="scan")
    assert {tuple(r) for r in hits.collect()} == {("red", 1), ("Ring", 1), ("Ring", 2), ("x\\%", 3), ("r_ng", 1), ("r_ng", 2)}
    plain = M.keyword_hits(fact, kws.where("kid in ('red', 'Ring')"), method="scan")
    assert "NestedLoop" not in _plan(plain) and plain.count() == 3


def test_requests_are_broadcast_to_the_matches(spark):
    """pairs of requests and postings are not shuffled by keyword."""
    fact = C._wh(C._tables(spark, SMALL)).fact
    cols = "query_id bigint, keyword string, min_deadline date, min_annual_salary bigint, company_name string, max_experience bigint, form_code bigint, region string, _regions array<string>"
    q = spark.createDataFrame([(i, "red", None, None, None, None, None, None, None) for i in range(5)], cols)
    m = fact.select(F.when(F.col("posting_id") >= 0, "red").alias("keyword"), "posting_id")
    got = SR._filtered(m, q, fact, "keyword")
    assert "BroadcastHashJoin [keyword" in _plan(got)
    assert got.count() == 5 * fact.count()


def test_judgment_checks_in_many_tasks(spark):
    """the judgments of a query are made and checked in one task out of many."""
    t = Tables(spark, SMALL)
    many = t.dealt("lineitem", "l_orderkey", 500)
    assert many["lineitem"].rdd.getNumPartitions() > 8
    assert _plan(C.E.judgment_checks(many["judgments"])).count("Exchange") == 1
    assert sorted(map(tuple, C.E.judgment_checks(many["judgments"]).collect())) == sorted(map(tuple, C.E.judgment_checks(t["judgments"]).collect()))
