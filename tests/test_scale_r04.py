"""F1-F9 of round 4: a user's postings stay bits until they are rows."""

import random

import pytest
from pyspark.sql import functions as F

from hirelake.operators import alerts as AL
from hirelake.operators import board as B
from hirelake.operators import tables as S


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df, *cols):
    return sorted(map(str, (df.select(*cols) if cols else df).collect()))


def _inputs(spark, twice=True, seed=1):
    r = random.Random(seed)
    names = ["red job", "blue Job", "red ring job", "plain", None]
    post = [(i if i % 23 else None, r.choice(names), r.choice([None, [], ["tag red"], ["RING", None]]), r.choice([None, "", "Seoul Gangnam", "Busan", "Seoul"]),
             r.choice([None, 1, 2]), r.choice([None, 0, 3, 9]), r.choice([None, 2500, 3000, 4000, 2**40])) for i in range(90)]
    if not twice:
        post = [p for p in post if p[0] is not None]
    post += [(7, "red again", None, "Seoul", 1, 1, 3000), (7, "blue again", None, "Busan", None, None, None)] if twice else []
    posts = spark.createDataFrame(post, "posting_id bigint, announcement_name string, tags array<string>, region_name string, form bigint, experience bigint, annual_salary bigint")
    subs = spark.createDataFrame(
        [(f"u{u}" if u else None, r.choice([k, k, None]), r.choice([None, "red", "blue", "ring", " ", "Red  job", "nothing"])) for u in range(40) for k in range(1, 2 + u % 4)]
        + [("u3", 2, "red"), ("u3", 2, "blue"), ("u5", None, "red"), ("u9", 1, "red"), ("u9", 1, "red")], "user_id string, seq int, keyword string")
    prof = spark.createDataFrame([(f"u{u}", r.choice([None, "", "Seoul", "Busan", "Gang", "Nowhere"]), r.choice([None, None, 1, 2]), r.choice([None, 0, 3, 5, 20]), r.choice([None, 0, 2600, 3000, 5000]))
                                  for u in [*range(0, 36), 3, 3, 11, 12]], "user_id string, region string, form bigint, max_experience bigint, min_salary bigint")
    exp = subs.select("keyword").distinct().withColumn("expanded", F.array(F.coalesce("keyword", F.lit("x")), F.lit("plain")))
    return posts, subs, prof, exp


def _all_pairs(spark, posts, subs, prof):
    """Every subscription against every posting, rule by rule (an id's rows share their hits)."""
    terms = AL.subscription_terms(subs)
    hits = terms.join(AL.match_text(posts), F.instr("text", F.col("term")) > 0).groupBy("keyword", F.col("tid").alias("posting_id")).agg(
        F.count("*").alias("n"), F.max("n_terms").alias("need")).where("n >= need").select("keyword", "posting_id")
    side = subs.join(AL._profiles_side(prof, spark), "user_id", "left")
    blank = "keyword is null or trim(keyword) = ''"
    cols = ["user_id", "seq", "keyword", "posting_id"]
    return side.where(f"not ({blank})").join(hits, "keyword").join(posts, "posting_id").where(AL._profile_ok()).select(*cols).unionAll(
        side.where(blank).crossJoin(posts).where(AL._profile_ok()).select(*cols))


@pytest.mark.parametrize("block", [250_000, 40])
def test_pairs_are_made_by_no_join(spark, monkeypatch, block):
    """a subscription's postings are found as bits; rows are the last step."""
    monkeypatch.setattr(AL, "OFFERS_OF_BLOCK", block)
    posts, subs, prof, _ = _inputs(spark)
    want = _all_pairs(spark, posts, subs, prof)
    got = AL.match_subscriptions(posts, subs, prof)
    assert _rows(got) == _rows(want) and got.count() > 200
    plan = _plan(got)
    assert 0 < plan.index("Generate explode") < plan.index("Join")
    flagged = AL.match_subscriptions(posts, subs, prof, first=True)
    first = AL.user_matches(flagged)
    assert _rows(first) == _rows(want.groupBy("user_id", "posting_id").agg(F.min("seq").alias("seq")))
    assert "Join" not in _plan(first) and "Window" not in _plan(first)
    assert flagged.count() == want.count() and _rows(flagged.where("first"), "user_id", "posting_id", "seq") == _rows(first)


def test_many_keywords_are_not_broadcast(spark, monkeypatch):
    """more distinct keywords than a broadcast holds come with the lists."""
    posts, subs, prof, _ = _inputs(spark)
    monkeypatch.setattr(AL, "BROADCAST_MAX_ROWS", 3)
    got = AL.match_subscriptions(posts, subs, prof)
    assert "Join" not in _plan(got) and _rows(got) == _rows(_all_pairs(spark, posts, subs, prof))


def _run(spark, posts, subs, prof, exp):
    """The pairs of a run and the log that an earlier run over some of its postings left."""
    req = AL.Requests(subs, prof, exp, first=True)
    match = lambda p: AL.user_matches(AL.match_subscriptions(p, subs, requests=req))
    old = posts.where("posting_id % 3 = 0 or posting_id is null").unionByName(posts.limit(9).withColumn("posting_id", F.col("posting_id") + 1000))
    return match(posts), AL.store_log(match(old))


@pytest.mark.parametrize("block", [60])
def test_pending_and_log_from_bits(spark, monkeypatch, block):
    """the log is stored, subtracted and united as bits: as by joins of the pairs."""
    monkeypatch.setattr(AL, "OFFERS_OF_BLOCK", block)
    now, log = _run(spark, *_inputs(spark))
    plain_now = spark.createDataFrame(now.collect(), now.schema)
    plain_log = spark.createDataFrame(log.collect(), log.schema)
    assert log.columns == ["user_id", "posting_id"] and plain_log.count() > 100
    want = plain_now.join(plain_log, ["user_id", "posting_id"], "left_anti")
    pending = AL.alerts_pending(now, log)
    assert sorted(pending.columns) == sorted(want.columns)
    assert _rows(pending, "user_id", "posting_id", "seq") == _rows(want, "user_id", "posting_id", "seq")
    assert _rows(AL.alerts_pending(now, plain_log), "user_id", "posting_id", "seq") == _rows(want, "user_id", "posting_id", "seq")
    assert _rows(AL.alert_log(log, pending)) == _rows(plain_log.unionByName(want.select("user_id", "posting_id")).distinct())
    for df in (pending, AL.alert_log(log, pending)):
        assert _plan(df).index("Generate explode") < _plan(df).index("Exchange")      # no pair is shuffled
    assert B.made_of(log).df.count() <= plain_log.select("user_id").distinct().count() * len(B.made_of(now).board.shared) * 2


def test_log_of_kept_postings_from_bits(spark):
    """what is not kept of a stored log never becomes rows."""
    _, log = _run(spark, *_inputs(spark))
    plain = spark.createDataFrame(log.collect(), log.schema)
    fact = spark.range(95).select(F.col("id").alias("posting_id"), F.when(F.col("id") % 2 == 0, F.lit("2024-01-01")).otherwise("2023-01-01").cast("date").alias("deadline"))
    (got,), (want,) = S.expire_postings(fact, "2023-06-01", [log])[1], S.expire_postings(fact, "2023-06-01", [plain])[1]
    assert _rows(got) == _rows(want, "user_id", "posting_id") and 0 < got.count() < plain.count()
    assert "Join" not in _plan(got)
    assert _rows(AL.alerts_pending(plain, got)) == _rows(AL.alerts_pending(plain, want))


@pytest.mark.parametrize("block,twice", [(60, False), (250_000, True)])
def test_digest_from_bits(spark, monkeypatch, block, twice):
    """the best are found among bits; no pending pair is stored or joined."""
    posts, subs, prof, exp = _inputs(spark, twice)
    monkeypatch.setattr(AL, "OFFERS_OF_BLOCK", block)
    now, log = _run(spark, posts, subs, prof, exp)
    pending = AL.alerts_pending(now, log)
    want = AL.alert_digest(pending, subs, posts, scorer=AL._lexical_user_scores, show=4)
    stored, materialize = [], AL.materialize
    monkeypatch.setattr(AL, "materialize", lambda df, name: (stored.append(name), materialize(df, name))[1])
    got = AL.alert_digest(pending, subs, posts, show=4)
    assert _rows(got) == _rows(want) and got.count() > 50
    assert ("pending" in stored) is twice     # rows of one id: as before, by pairs


@pytest.mark.parametrize("as_bits", [True, False])
def test_stream_log_as_bits(spark, tmp_path, as_bits):
    """a batch writes bits over its postings, reads batches of the same ids, and can be replayed."""
    from hirelake.streaming import jobs as ST
    posts, subs, prof, exp = _inputs(spark)
    _, log = _run(spark, posts, subs, prof, exp)
    plain = spark.createDataFrame(log.collect(), log.schema)
    path, arrived = str(tmp_path / "log"), str(tmp_path / "posts")
    ST.write_log(log if as_bits else plain, path)
    req = AL.Requests(subs, prof, exp, first=True)
    days = [posts.where("posting_id < 30 or posting_id is null"), posts.where("posting_id >= 30 and posting_id < 60"), posts.where("posting_id >= 50")]
    want = plain
    for i, day in enumerate(days):
        day.coalesce(1).write.mode("append").parquet(arrived)
        ST.stream_alerts(spark, arrived, posts.schema, subs, prof, exp, path, str(tmp_path / "ckpt"), req)
        found = AL.match_subscriptions(day, subs, requests=req).select("user_id", "posting_id").distinct()
        new = found.join(want, ["user_id", "posting_id"], "left_anti")
        want = spark.createDataFrame(want.unionByName(new).collect(), want.schema)
        assert _rows(ST.read_log(spark, path)) == _rows(want)
    assert ST.held_batches(spark, f"{path}/_bits") == ([-1] if as_bits else []) + [0, 1, 2]
    if not as_bits:
        return
    held = ST.bits_before(spark, path, days[2], 2, "bigint")     # of the day before and the log
    assert len(B.made_of(held).books) == 2
    assert len(B.made_of(ST.bits_before(spark, path, days[0], 2, "bigint")).books) == 2
    assert ST.bits_before(spark, path, posts.withColumn("posting_id", F.col("posting_id") + 10**6), 2, "bigint") is None
    new = AL.alerts_pending(AL.user_matches(AL.match_subscriptions(days[2], subs, requests=req)), held)
    ST.write_bits(B.made_of(new).bits(), path, 2)                # a replay
    assert _rows(ST.read_log(spark, path)) == _rows(want)


def test_query_log_is_not_broadcast(spark, monkeypatch):
    """F8: tables with a row for each query of a long log are merged, whatever their file size."""
    from hirelake.operators import evaluate as E
    from hirelake.operators import search as SR
    r = random.Random(2)
    fact = spark.createDataFrame([(i, f"c{i % 5}", r.choice(["red job", "blue job", "red ring", "plain"]), ["red"] if i % 7 == 0 else [], r.choice(["Seoul", "Busan", None]),
                                   i % 3, i % 9, 2000 + 100 * (i % 30), "2025-01-01") for i in range(300)],
                                 "posting_id bigint, company_name string, announcement_name string, tags array<string>, region_name string, form bigint, experience bigint, annual_salary bigint, d string")
    fact = fact.withColumn("deadline", F.col("d").cast("date"))
    cols = "query_id bigint, keyword string, min_deadline date, min_annual_salary bigint, company_name string, max_experience bigint, form_code bigint, region string"
    q = spark.createDataFrame([(i, [None, "red", "blue ring", "nothing", "red job"][i % 5], None, 2000 + i, None, [None, 4][i % 3 == 0], None, [None, "Seoul"][i % 2]) for i in range(24)], cols)
    exp = q.where("keyword is not null").select("query_id", F.array("keyword", F.lit("plain")).alias("expanded"))
    want = _rows(SR.search_adaptive(q, fact, "2024-01-01", 5, exp), "query_id", "rank", "posting_id")
    monkeypatch.setattr(SR, "BROADCAST_MAX_ROWS", 2)
    got = SR.search_adaptive(q, fact, "2024-01-01", 5, exp)
    for x in (got, E.overlap_at_k(got, got.limit(9), 5)):
        assert "BroadcastHashJoin [query_id" not in _plan(x)
    assert _rows(got, "query_id", "rank", "posting_id") == want and len(want) > 60
