"""Keyed stream sinks: a batch reads what its keys touch; the automaton equals the scan."""

import os

import pytest
from pyspark.sql import functions as F

from hirelake.operators import alerts as AL
from hirelake.operators import automaton, ngram
from hirelake.plans import catalog as C
from hirelake.streaming import jobs as ST

SMALL = "/root/testdata/sf0.001"
TERMS = ["ring", "red", "r", "hot pl", "ate", "plate", "zzz", "", "né", "%", "_", "a", "aa", "aaa", "가나"]
TEXTS = ["a red ring", "hot plate", "", None, "né%_", "aaaa", "가나다", "ringring"]


@pytest.mark.parametrize("shard_chars", [1 << 20, 7])
def test_automaton_equals_scan(spark, shard_chars):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "tid bigint, text string")
    terms = spark.createDataFrame([(t,) for t in TERMS + [None, "ring"]], "term string")
    compiled = automaton.Terms(terms, shard_chars=shard_chars)
    assert len(compiled.shards) == (1 if shard_chars > 100 else len(compiled.shards)) and (shard_chars > 100 or len(compiled.shards) > 3)
    got = sorted(map(tuple, compiled.hits(texts).collect()))
    pats = terms.where("term is not null").distinct().select(F.col("term").alias("pid"), F.col("term").alias("pattern"))
    want = sorted(map(tuple, ngram.scan_pairs(pats, texts, literal=True).collect()))
    assert got == want and len(got) > 20
    assert automaton.Terms(terms.limit(0)).hits(texts).count() == 0


@pytest.mark.parametrize("expanded", [True, False])
def test_matcher_equals_scan(spark, expanded):
    t = C._tables(spark, SMALL)
    fact, subs, prof, exp = C._alert_inputs(t)
    subs = subs.unionByName(spark.createDataFrame([("1", 90, "  "), ("2", 91, None), ("nobody", 1, None), ("4", 92, "Ring  red")], "user_id string, seq int, keyword string"))
    odd = spark.createDataFrame([("1", "", None, None, None), ("2", "A", 3, None, None), ("nobody", "Nowhere", None, 0, 0), ("4", None, None, None, None)], prof.schema)
    prof = prof.join(odd.select("user_id"), "user_id", "left_anti").unionByName(odd)
    posts = C._new(fact)
    posts = posts.unionByName(posts.limit(20).withColumns({"posting_id": F.col("posting_id") + 10**9, "region_name": F.lit(None).cast("string"), "form": F.lit(None).cast(posts.schema["form"].dataType)}))
    got = AL.match_subscriptions(posts, subs, prof, exp if expanded else None)
    # every subscription against every posting, rule by rule
    terms = AL.subscription_terms(subs, exp if expanded else None)
    hits = terms.join(AL.match_text(posts), F.instr("text", F.col("term")) > 0).groupBy("keyword", F.col("tid").alias("posting_id")).agg(
        F.count("*").alias("n"), F.max("n_terms").alias("need")).where("n >= need").select("keyword", "posting_id")
    side = subs.join(AL._profiles_side(prof, spark), "user_id", "left")
    with_kw = side.where("trim(keyword) <> ''").join(hits, "keyword").join(posts, "posting_id").where(AL._profile_ok())
    no_kw = side.where("keyword is null or trim(keyword) = ''").crossJoin(posts).where(AL._profile_ok())
    cols = ["user_id", "seq", "posting_id"]
    want = with_kw.select(*cols).unionAll(no_kw.select(*cols))
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_a_batch_reads_only_the_folders_it_touches(spark, tmp_path):
    raw = C._tables(spark, SMALL)["postings_raw"]
    day = F.to_date("batch_date")
    sink = str(tmp_path / "fact")
    read = []
    held_before = ST.held_before

    def counted(new, path, batch):
        held = held_before(new, path, batch)
        read.append((held.count() if held is not None else 0, spark.read.parquet(path).count() if os.path.exists(path) else 0))
        return held

    ST.held_before = counted
    try:
        for k, years in enumerate((0, 1, 2, 3, 4, 5)):  # one quarter's postings, again and again in later years
            part = raw.where((F.year(day) == 1996) & (F.month(day) <= 3) & ~F.col("deadline_raw").isin("상시채용"))
            part = part.withColumns({c: F.add_months(day, 12 * years).cast(raw.schema[c].dataType) if c == "batch_date" else F.col(c) for c in raw.columns})
            part = part.withColumn("posting_id", F.col("posting_id") + 10_000_000 * k)
            part.write.mode("append").parquet(str(tmp_path / "raw"))
            ST.stream_ingest(spark, str(tmp_path / "raw"), raw.schema, sink, str(tmp_path / "ckpt"))
    finally:
        ST.held_before = held_before
    stored = [s for _, s in read]
    assert stored[-1] > 4 * stored[1] > 0          # the sink grew
    assert max(r for r, _ in read) <= stored[1]    # what a batch reads did not
    keys = spark.read.parquet(sink)
    assert keys.count() == keys.select("company_name", "announcement_name", "deadline").distinct().count()


def test_alert_log_is_keyed_and_replay_safe(spark, tmp_path):
    log = spark.createDataFrame([("u", 5), ("u", 3_000_000)], "user_id string, posting_id bigint")
    ST.write_log(log, str(tmp_path / "log"))
    new = spark.createDataFrame([("u", 5), ("v", 6)], "user_id string, posting_id bigint").withColumn("part", ST.log_part())
    held = ST.held_before(new, str(tmp_path / "log"), 0)
    assert [tuple(r)[:2] for r in held.collect()] == [("u", 5)] and len(held.inputFiles()) == 1
    for _ in range(2):
        ST.write_parts(AL.alerts_pending(new, ST.held_before(new, str(tmp_path / "log"), 0)), str(tmp_path / "log"), 0)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3
