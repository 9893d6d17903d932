"""Registered queries: each one reads the fixture tables of a scale factor, runs an
operator (or a composition) over the whole input, and returns a DataFrame whose
column names match the oracle SQL of the same key.

Dates and arrays are rendered as text in these outputs so both engines hash them
the same way; the operators themselves return typed columns.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import market as M
from ..operators import normalize as N
from ..operators import alerts as AL
from ..operators import assist as A
from ..operators import display as D
from ..operators import evaluate as E
from ..operators import queryparse as QP
from ..operators import search as SR
from ..operators import quality as Q
from ..operators import tables as S
from ..operators import users as U
from ..sources.fixtures import AS_OF, AS_OF_TS, Tables
from . import warehouse as W

SPLIT_DATE = "1997-01-01"   # two-batch incremental runs: before / from this date


def _tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)


_STORED: dict = {}


def _wh(t: Tables) -> W.Warehouse:
    """The fixture warehouse: ingested once per session and scale factor, written as
    parquet below the session's checkpoint folder, then read by every query."""
    from ..session import scratch
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _STORED:
        _STORED[key] = W.build_stored(t.postings_stream(), scratch(t.spark, "warehouse"))
    return _STORED[key]


def _d(c: str):
    return F.date_format(F.col(c), "yyyy-MM-dd").alias(c)


def _tags_text(c: str = "tags"):
    return F.array_join(F.sort_array(F.col(c)), "|").alias(c)


def q_normalize_postings(spark, sf_dir):
    t = _tables(spark, sf_dir)
    n = N.normalize_postings(t.postings_stream())
    return n.select("posting_id", "company_name", "announcement_name", "experience", "experience_rule",
                    "education", "form", "region_name", "subregion_name", "annual_salary", "salary_rule",
                    _d("deadline"), "rejected", _tags_text())


def q_rejects(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return N.rejected(N.normalize_postings(t.postings_stream())).select("posting_id", "reason")


FACT_OUT = ["posting_id", "company_name", "announcement_name", "experience", "education", "form",
            "region_name", "subregion_name", "annual_salary"]


def _fact_out(fact: DataFrame) -> DataFrame:
    return fact.select(*FACT_OUT, _d("deadline"), "link", _tags_text())


def q_first_wins_dedup(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return _fact_out(_wh(t).fact)


def q_ingest_batch(spark, sf_dir):
    """Two daily batches, the second on top of the first: equals a one-shot ingest."""
    t = _tables(spark, sf_dir)
    raw = t.postings_stream()
    w1 = W.build(raw.where(F.col("batch_date") < F.lit(SPLIT_DATE).cast("date")))
    w2 = W.build(raw.where(F.col("batch_date") >= F.lit(SPLIT_DATE).cast("date")), existing=w1)
    return _fact_out(w2.fact)


def q_dim_upsert(spark, sf_dir):
    t = _tables(spark, sf_dir)
    raw = t.postings_stream()
    w1 = W.build(raw.where(F.col("batch_date") < F.lit(SPLIT_DATE).cast("date")))
    w2 = W.build(raw.where(F.col("batch_date") >= F.lit(SPLIT_DATE).cast("date")), existing=w1)
    return w2.companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"))


def q_posting_tags(spark, sf_dir):
    return _wh(_tables(spark, sf_dir)).bridge.select("posting_id", "tag")


def q_quality_events(spark, sf_dir):
    w = _wh(_tables(spark, sf_dir))
    return w.quality.select("posting_id", "field", "rule", "original_value", "parsed_value")


def q_top_tags(spark, sf_dir):
    return M.top_tags(_wh(_tables(spark, sf_dir)).fact, AS_OF, 10)


def q_top_tags_all(spark, sf_dir):
    return M.top_tags(_wh(_tables(spark, sf_dir)).fact, None, 10)


def _legacy_fact(t: Tables) -> DataFrame:
    """Postings stored without range validation (the CSV loader path)."""
    ok = N.accepted(N.normalize_postings(t.postings_stream()))
    ok = ok.withColumn("experience", F.col("experience_parsed")).withColumn("annual_salary", F.col("salary_parsed"))
    return S.first_wins_dedup(ok)


def q_quality_clean(spark, sf_dir):
    f = Q.quality_clean(_legacy_fact(_tables(spark, sf_dir)))
    return f.select("posting_id", "experience", "annual_salary")


def q_quality_clean_log(spark, sf_dir):
    return Q.quality_clean_log(_legacy_fact(_tables(spark, sf_dir))).select(
        "posting_id", "announcement_name", "field", "rule", "parsed_value")


def q_completeness(spark, sf_dir):
    return Q.completeness(_wh(_tables(spark, sf_dir)).fact).select("field", "total", "filled", "pct")


def q_salary_dist(spark, sf_dir):
    return Q.salary_dist(_wh(_tables(spark, sf_dir)).fact)


def q_salary_sketch_dist(spark, sf_dir):
    """Q4 by stored per-day sketches, merged over the year before AS_OF (approximate)."""
    t = _tables(spark, sf_dir)
    sketches = _once(t, "salary-sketches", lambda: Q.salary_sketches(_wh(t).fact))
    return Q.sketched_salary_dist(sketches, "1997-06-16", AS_OF)


def q_experience_bands(spark, sf_dir):
    return Q.experience_bands(_legacy_fact(_tables(spark, sf_dir)))


def q_form_dist(spark, sf_dir):
    return Q.form_dist(_wh(_tables(spark, sf_dir)).fact, S.employment_types(spark))


def q_quality_event_summary(spark, sf_dir):
    return Q.quality_event_summary(_wh(_tables(spark, sf_dir)).quality)


def q_quality_recent(spark, sf_dir):
    return Q.quality_recent(_wh(_tables(spark, sf_dir)).quality)


def q_quality_report(spark, sf_dir):
    w = _wh(_tables(spark, sf_dir))
    return Q.quality_report(w.fact, w.quality, S.employment_types(spark))


def q_salary_by_keyword(spark, sf_dir):
    t = _tables(spark, sf_dir)
    w = _wh(t)
    return M.salary_by_keyword(w.fact, t["keywords"], AS_OF, index=w.gram_index)


def q_regional_dist(spark, sf_dir):
    return M.regional_dist(_wh(_tables(spark, sf_dir)).fact, AS_OF, 8)


def q_experience_dist(spark, sf_dir):
    return M.experience_dist(_wh(_tables(spark, sf_dir)).fact, AS_OF)


def q_daily_new(spark, sf_dir):
    return M.daily_new(_wh(_tables(spark, sf_dir)).fact, AS_OF, 7).select(_d("day"), "count")


def _flat(c: str):
    return F.array_join(F.transform(F.col(c), lambda s: F.concat(s["name"], F.lit(":"), s["count"].cast("string"))),
                        "|").alias(c)


def _snapshot_out(df: DataFrame) -> DataFrame:
    return df.select(_d("date"), "total_valid_jobs", "new_jobs", "avg_salary",
                     _flat("top_tags"), _flat("region_dist"), _flat("experience_dist"))


def q_market_snapshot(spark, sf_dir):
    return _snapshot_out(M.market_snapshot(_wh(_tables(spark, sf_dir)).fact, AS_OF))


SNAPSHOT_FROM = "1998-03-18"   # 90 days up to AS_OF


def q_market_snapshot_range(spark, sf_dir):
    """M6 for 90 days, each of the postings known on that day, in one sweep."""
    return _snapshot_out(M.market_snapshots(_wh(_tables(spark, sf_dir)).fact, SNAPSHOT_FROM, AS_OF))


def q_snapshot_upsert(spark, sf_dir):
    """Snapshots of three days from the first batch, then the last day recomputed on
    the whole stream and upserted over the stored one."""
    import datetime as _dt
    t = _tables(spark, sf_dir)
    early = W.build(t.postings_stream().where(F.col("batch_date") < F.lit(SPLIT_DATE).cast("date"))).fact
    day = _dt.date.fromisoformat(AS_OF)
    stored = None
    for k in (2, 1, 0):
        snap = M.market_snapshot(early, (day - _dt.timedelta(days=k)).isoformat())
        stored = snap if stored is None else stored.unionByName(snap)
    again = M.market_snapshot(_wh(t).fact, AS_OF)
    return _snapshot_out(M.snapshot_upsert(stored, again))


def q_insight_report(spark, sf_dir):
    w = _wh(_tables(spark, sf_dir))
    return M.insight_report(w.fact, AS_OF, index=w.gram_index)


def q_expire_postings(spark, sf_dir):
    """Expiry cascades to the bridge: the tag rows of kept postings."""
    w = _wh(_tables(spark, sf_dir))
    _, (bridge,) = S.expire_postings(w.fact, AS_OF, [w.bridge])
    return bridge.select("posting_id", "tag")


def q_expire_fact(spark, sf_dir):
    return S.expire_postings(_wh(_tables(spark, sf_dir)).fact, AS_OF).select("posting_id", _d("deadline"))


def q_expire_notifications(spark, sf_dir):
    """Expiry cascades to the notification log: the rows of kept postings."""
    t = _tables(spark, sf_dir)
    _, (log,) = S.expire_postings(_wh(t).fact, AS_OF, [_previous_log(t)])
    return log.select("user_id", "posting_id")


def _before_split():
    return F.col("batch_date") < F.lit(SPLIT_DATE).cast("date")


def _legacy_location_wh(t: Tables) -> W.Warehouse:
    """Postings of the first batch were loaded before the location column existed."""
    raw = t.postings_stream()
    raw = raw.withColumn("location_raw", F.when(_before_split(), F.lit(None).cast("string"))
                         .otherwise(F.col("location_raw")))
    return W.build(raw)


def q_region_backfill(spark, sf_dir):
    t = _tables(spark, sf_dir)
    w = _legacy_location_wh(t)
    out = S.region_backfill(w.fact, t.postings_stream(), w.regions)
    return out.select("posting_id", "region_name", "subregion_name", "updated")


def q_fill_rate(spark, sf_dir):
    t = _tables(spark, sf_dir)
    w = _legacy_location_wh(t)
    after = S.region_backfill(w.fact, t.postings_stream(), w.regions)
    return (S.fill_rate(w.fact, "region_name").withColumn("stage", F.lit("before"))
            .unionByName(S.fill_rate(after, "region_name").withColumn("stage", F.lit("after"))))


def _unmapped_wh(t: Tables) -> W.Warehouse:
    """Tags stored as written, before the synonym map existed."""
    return W.build(t.postings_stream(), synonyms=[])


def q_tag_merge(spark, sf_dir):
    w = _unmapped_wh(_tables(spark, sf_dir))
    return S.tag_merge(w.bridge, S.synonym_table(spark)).select("posting_id", "tag")


def q_tag_merge_report(spark, sf_dir):
    w = _unmapped_wh(_tables(spark, sf_dir))
    return S.tag_merge_report(w.tags, S.synonym_table(spark))


def _profile_changes(t: Tables) -> DataFrame:
    """Version 1 of every profile; users without a form later clear their region and
    raise their salary floor."""
    p = t["profiles"]
    v1 = p.withColumn("seq", F.lit(1))
    v2 = p.where(F.col("form").isNull()).select(
        "user_id", F.lit(None).cast("string").alias("region"), "form", "max_experience",
        F.lit(3000).alias("min_salary"), F.lit(2).alias("seq"))
    return v1.unionByName(v2)


def q_profile_upsert(spark, sf_dir):
    return U.profile_upsert(_profile_changes(_tables(spark, sf_dir)))


def q_profile_display(spark, sf_dir):
    return U.profile_display(_tables(spark, sf_dir)["profiles"])


def q_subscription_delete_all(spark, sf_dir):
    """Users without a preferred region drop all their subscriptions."""
    t = _tables(spark, sf_dir)
    return U.subscription_delete_all(_stored_subscriptions(t), t["profiles"].where(F.col("region").isNull())).select(
        "user_id", "seq", "keyword")


def q_subscription_cap(spark, sf_dir):
    return U.subscription_cap(_tables(spark, sf_dir)["subscriptions"]).select(
        "user_id", "seq", "keyword", "position", "accepted")


def _stored_subscriptions(t: Tables) -> DataFrame:
    return U.subscription_cap(t["subscriptions"]).where("accepted").select("user_id", "seq", "keyword")


def q_subscription_delete(spark, sf_dir):
    """Every user deletes position 2, and asks for position 9 (out of range)."""
    subs = _stored_subscriptions(_tables(spark, sf_dir))
    users = subs.select("user_id").distinct()
    deletes = users.withColumn("position", F.lit(2)).unionByName(users.withColumn("position", F.lit(9)))
    return U.subscription_delete(subs, deletes).select("user_id", "seq", "keyword")


def _vocab(df: DataFrame, col: str) -> DataFrame:
    """A vocabulary table (word, ord), in name order."""
    return df.select(F.col(col).alias("word"), F.col(col).alias("ord")).where(F.col(col).isNotNull()).distinct()


def _parsed(t: Tables, job_words: bool = False) -> DataFrame:
    jobs = _vocab(t["keywords"], "keyword") if job_words else None
    return QP.parse_queries(t["query_log"], AS_OF, regions=_vocab(t["region_vocab"], "name"), job_keywords=jobs)


PARSE_OUT = ["query_id", "keyword", "region", "form", "form_code", "max_experience", "min_annual_salary",
             "company_name", "error"]


def q_parse_queries(spark, sf_dir):
    return _parsed(_tables(spark, sf_dir)).select(*PARSE_OUT, _d("min_deadline"))


def q_parse_queries_jobwords(spark, sf_dir):
    return _parsed(_tables(spark, sf_dir), job_words=True).select(*PARSE_OUT, _d("min_deadline"))


_PARSED: dict = {}


def _search_queries(t: Tables) -> DataFrame:
    """Parsed fixture queries that can run (a month that does not exist cannot), parsed
    once per session and scale factor and stored, as a search service would."""
    from ..session import materialize
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _PARSED:
        _PARSED[key] = materialize(_parsed(t), "parsed")
    return _PARSED[key].where(~F.col("error"))


def _index(t: Tables) -> dict:
    """The stored gram index, as arguments of the searches."""
    w = _wh(t)
    return {"index": w.gram_index}


_ONCE: dict = {}


def _once(t: Tables, name: str, build, store=None) -> DataFrame:
    """A table that a service would keep: built and stored (by ``store``) once per session and
    scale factor."""
    from ..session import materialize
    key = (t.spark.sparkContext.applicationId, t.sf_dir, name)
    if key not in _ONCE:
        _ONCE[key] = store(build()) if store else materialize(build(), name)
    return _ONCE[key]


def _thesaurus(t: Tables) -> DataFrame:
    return _once(t, "thesaurus", lambda: A.cooccurrence_thesaurus(t["part"].select(F.col("p_name").alias("text"))))


def _expansions(t: Tables, queries: DataFrame) -> DataFrame:
    exp = A.thesaurus_expansions(queries.select("keyword"), _thesaurus(t))
    return SR.log_sized(queries)(queries.select("query_id", "keyword")).join(exp, "keyword").select("query_id", "expanded")


def q_search_and(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return SR.search(_search_queries(t), _wh(t).fact, AS_OF, 5, use_tags=True, fallback=False, **_index(t))


def q_search_fallback(spark, sf_dir):
    """limit 2 < 3: every multi-token query below the threshold falls back to OR."""
    t = _tables(spark, sf_dir)
    return SR.search(_search_queries(t), _wh(t).fact, AS_OF, 2, use_tags=True, fallback=True, **_index(t))


def q_search_name_only(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return SR.search(_search_queries(t), _wh(t).fact, AS_OF, 10, use_tags=False, fallback=True, **_index(t))


def q_search_expanded(spark, sf_dir):
    t = _tables(spark, sf_dir)
    q = _search_queries(t)
    eq = q.join(_expansions(t, q), "query_id")
    return SR.search_expanded(eq, _wh(t).fact, AS_OF, 10, **_index(t))


def q_search_baseline(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return SR.search(_search_queries(t), _wh(t).fact, AS_OF, 5, **_index(t)).select("query_id", "rank", "posting_id")


def q_search_adaptive(spark, sf_dir):
    t = _tables(spark, sf_dir)
    q = _search_queries(t)
    return SR.search_adaptive(q, _wh(t).fact, AS_OF, 5, expansions=_expansions(t, q), **_index(t)).select(
        "query_id", "rank", "posting_id")


def q_ab_compare(spark, sf_dir):
    a = q_search_baseline(spark, sf_dir).withColumnRenamed("rank", "rank_a")
    b = q_search_adaptive(spark, sf_dir).withColumnRenamed("rank", "rank_b")
    return a.join(b, ["query_id", "posting_id"], "full_outer").select("query_id", "posting_id", "rank_a", "rank_b")


def q_ab_overlap(spark, sf_dir):
    return E.overlap_at_k(q_search_baseline(spark, sf_dir), q_search_adaptive(spark, sf_dir), 5)


def q_pool_modes(spark, sf_dir):
    """The search modes run and pooled, in this order: title only, with tags, expanded,
    adaptive (the expanded results where title only found fewer than three)."""
    t = _tables(spark, sf_dir)
    q, w = _search_queries(t), _wh(t)
    base = SR.search(q, w.fact, AS_OF, 10, use_tags=False, fallback=True, **_index(t))
    tags = SR.search(q, w.fact, AS_OF, 10, use_tags=True, fallback=True, **_index(t))
    wide = SR.search_expanded(q.join(_expansions(t, q), "query_id"), w.fact, AS_OF, 10, **_index(t))
    from ..session import materialize
    runs = None
    for mode, r in (("base", base), ("tags", tags), ("wide", wide)):
        r = r.select("query_id", F.lit(mode).alias("mode"), F.col("posting_id").alias("doc_id"), "rank")
        runs = r if runs is None else runs.unionByName(r)
    runs = materialize(runs, "runs")
    enough = runs.where("mode = 'base'").groupBy("query_id").count().where("count >= 3").select("query_id")
    some = runs.where("mode = 'base'").join(enough, "query_id", "left_semi")
    few = runs.where("mode = 'wide'").join(enough, "query_id", "left_anti")
    runs = runs.unionByName(some.unionByName(few).withColumn("mode", F.lit("adaptive")))
    return E.pool_candidates(runs, ["base", "tags", "wide", "adaptive"], 10)


def q_expand_keywords(spark, sf_dir):
    t = _tables(spark, sf_dir)
    exp = A.thesaurus_expansions(_search_queries(t).select("keyword"), _thesaurus(t))
    return exp.select("keyword", F.array_join(F.sort_array("expanded"), "|").alias("expanded"))


def q_list_valid(spark, sf_dir):
    return SR.list_valid(_wh(_tables(spark, sf_dir)).fact, AS_OF, 100, order_desc=True).select(
        "posting_id", "company_name", "announcement_name")


def q_lookup_ids(spark, sf_dir):
    t = _tables(spark, sf_dir)
    ids = t["orders"].where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").alias("posting_id"))
    return SR.lookup_ids(_wh(t).fact, ids).select("posting_id", "announcement_name", _d("deadline"))


def q_text_match(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return M.keyword_hits(_wh(t).fact, t["keywords"].withColumn("kid", F.col("keyword")), method="scan") \
        .select(F.col("kid").alias("keyword"), "posting_id")


def q_ngram_search(spark, sf_dir):
    """Same answer as text_match, through the gram index stored with the warehouse."""
    t = _tables(spark, sf_dir)
    w = _wh(t)
    return M.keyword_hits(w.fact, t["keywords"].withColumn("kid", F.col("keyword")), method="ngram",
                          index=w.gram_index) \
        .select(F.col("kid").alias("keyword"), "posting_id")


def q_text_match_selective(spark, sf_dir):
    """The search protocol's selective half: the 50 rarest whole titles, by the scan."""
    t = _tables(spark, sf_dir)
    return M.keyword_hits(_wh(t).fact, t["selective_keywords"].withColumn("kid", F.col("keyword")), method="scan") \
        .select(F.col("kid").alias("keyword"), "posting_id")


def q_ngram_search_selective(spark, sf_dir):
    """Same answer as text_match_selective, through the stored bitmap posting lists."""
    t = _tables(spark, sf_dir)
    w = _wh(t)
    return M.keyword_hits(w.fact, t["selective_keywords"].withColumn("kid", F.col("keyword")), method="ngram", index=w.gram_index) \
        .select(F.col("kid").alias("keyword"), "posting_id")


def q_postings_denorm(spark, sf_dir):
    w = _wh(_tables(spark, sf_dir))
    d = SR.postings_denorm(w.fact, w.bridge)
    return d.select("posting_id", "company_name", "region_name", _tags_text())


def q_region_names(spark, sf_dir):
    return SR.region_names(_wh(_tables(spark, sf_dir)).fact)


ALERT_HOURS = 24 * 7           # alert window of the fixture runs, closed at their "now"
PREVIOUS_RUN_TS = "1998-06-12 12:00:00"   # an earlier run that already notified users


def _alert_inputs(t: Tables):
    fact = _wh(t).fact
    subs = _once(t, "subscriptions", lambda: _stored_subscriptions(t))
    exp = _once(t, "subscribed-terms", lambda: A.thesaurus_expansions(subs.select("keyword"), _thesaurus(t)))
    return fact, subs, t["profiles"], exp


def _new(fact: DataFrame, as_of_ts: str = AS_OF_TS) -> DataFrame:
    return AL.new_postings(fact, as_of_ts, ALERT_HOURS, as_of_ts)


def _expanded_matches(t: Tables, as_of_ts: str, first: bool = False):
    fact, subs, prof, exp = _alert_inputs(t)
    return AL.match_subscriptions(_new(fact, as_of_ts), subs, prof, exp, first=first)


def _previous_log(t: Tables) -> DataFrame:
    """The log left by a run at PREVIOUS_RUN_TS (it saw postings created before it)."""
    return _once(t, "alert-log", lambda: AL.user_matches(_expanded_matches(t, PREVIOUS_RUN_TS, first=True)), AL.store_log)


def _pending(t: Tables) -> DataFrame:
    return AL.alerts_pending(AL.user_matches(_expanded_matches(t, AS_OF_TS, first=True)), _previous_log(t))


def q_new_postings(spark, sf_dir):
    return _new(_wh(_tables(spark, sf_dir)).fact).select(
        "posting_id", "announcement_name")


def q_match_subscriptions(spark, sf_dir):
    t = _tables(spark, sf_dir)
    fact, subs, prof, _ = _alert_inputs(t)
    return AL.match_subscriptions(_new(fact), subs, prof).select(
        "user_id", "seq", "posting_id")


def q_match_expanded(spark, sf_dir):
    return _expanded_matches(_tables(spark, sf_dir), AS_OF_TS).select("user_id", "seq", "posting_id")


def q_user_matches(spark, sf_dir):
    return AL.user_matches(_expanded_matches(_tables(spark, sf_dir), AS_OF_TS, first=True))


def q_alerts_pending(spark, sf_dir):
    return _pending(_tables(spark, sf_dir)).select("user_id", "posting_id", "seq")


def q_alert_log(spark, sf_dir):
    t = _tables(spark, sf_dir)
    log = _previous_log(t)   # what the earlier run stored
    now = AL.user_matches(_expanded_matches(t, AS_OF_TS, first=True))
    return AL.alert_log(log, AL.alerts_pending(now, log))


def q_alert_digest(spark, sf_dir):
    t = _tables(spark, sf_dir)
    fact, subs, _, _ = _alert_inputs(t)
    return AL.alert_digest(_pending(t), subs, fact)


EVAL_MODES = ["A", "N", "R"]


def _r9(c: str):
    return F.round(F.col(c), 9).alias(c)


def q_ndcg(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return E.per_query(t["runs"], t["judgments"], 10).select("query_id", "mode", _r9("ndcg"))


def q_precision_at_k(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return E.per_query(t["runs"], t["judgments"], 10).select("query_id", "mode", _r9("precision"))


def q_hit_at_k(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return E.per_query(t["runs"], t["judgments"], 5).select("query_id", "mode", _r9("hit"))


def q_eval_summary(spark, sf_dir):
    t = _tables(spark, sf_dir)
    s = E.summary(t["runs"], t["judgments"])
    return s.select("mode", *[_r9(c) for c in s.columns if c != "mode"])


def q_eval_summary_all(spark, sf_dir):
    """E7 with the sums divided by the number of all queries, judged or not."""
    t = _tables(spark, sf_dir)
    s = E.summary(t["runs"], t["judgments"], all_queries=t["orders"].select(F.col("o_orderkey").alias("query_id")))
    return s.select("mode", *[_r9(c) for c in s.columns if c != "mode"])


def _types(t: Tables) -> DataFrame:
    return t["orders"].select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("qtype"))


def q_eval_by_type(spark, sf_dir):
    t = _tables(spark, sf_dir)
    r = E.by_type(t["runs"], t["judgments"], _types(t), 10, baseline_mode="N")
    return r.select("qtype", "mode", _r9("ndcg"), _r9("delta"))


def q_eval_detail(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return E.detail(t["runs"], t["judgments"], EVAL_MODES).select("query_id", *[_r9(m) for m in EVAL_MODES])


def q_pool_candidates(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return E.pool_candidates(t["runs"], EVAL_MODES, 10)


def q_judgment_dist(spark, sf_dir):
    return E.judgment_dist(_tables(spark, sf_dir)["judgments"])


def q_judgment_checks(spark, sf_dir):
    return E.judgment_checks(_tables(spark, sf_dir).dealt("lineitem", "l_orderkey")["judgments"])


def q_unmapped_judgments(spark, sf_dir):
    """Judgments of documents that the document table does not hold (any more)."""
    t = _tables(spark, sf_dir)
    return E.unmapped_judgments(t["judgments"], t["documents"].select("doc_id"))


def q_quality_gate(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return E.quality_gate(t["runs"], t["judgments"], 5).select("query_id", "mode", _r9("mean_rel"), "hits", "passed")


def _targets(t: Tables) -> DataFrame:
    """The known item of each query: the part on the order's first line."""
    return t["lineitem"].where(F.col("l_linenumber") == 1).select(
        F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id"))


def q_known_item_eval(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return E.known_item(t["runs"], _targets(t))


def q_stratified_sample(spark, sf_dir):
    fact = _wh(_tables(spark, sf_dir)).fact
    tagged = F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 3
    return E.stratified_sample(fact, "posting_id", tagged, 100).select("posting_id", tagged.alias("tagged"))


def q_filter_regression(spark, sf_dir):
    t = _tables(spark, sf_dir)
    cols = ["query_id", "keyword", "region", "form", "max_experience", "min_annual_salary", "company_name"]
    return E.filter_regression(_parsed(t).select(*cols), _parsed(t, job_words=True).select(*cols))


def _scratch(spark, name: str) -> str:
    from ..session import scratch
    return scratch(spark, name)


def q_stream_ingest(spark, sf_dir):
    """The raw stream replayed as yearly files through a streaming ingest."""
    from ..streaming import jobs as ST
    t = _tables(spark, sf_dir)
    base = _scratch(spark, "stream-ingest")
    raw = t.postings_stream()
    ST.write_in_order(raw, "batch_date", F.year("batch_date"), f"{base}/staged")
    for _ in ST.arrivals(spark, f"{base}/staged", f"{base}/raw"):
        ST.stream_ingest(spark, f"{base}/raw", raw.schema, f"{base}/fact", f"{base}/ckpt")
    return _fact_out(spark.read.parquet(f"{base}/fact"))


def q_events_daily_new(spark, sf_dir):
    """Event counts per day and type from a watermarked stream of monthly arrivals."""
    from ..streaming import jobs as ST
    t = _tables(spark, sf_dir)
    base = _scratch(spark, "stream-events")
    ev = t["events"]
    ST.write_in_order(ev, "ts", F.year("ts") * 100 + F.month("ts"), f"{base}/staged")
    for _ in ST.arrivals(spark, f"{base}/staged", f"{base}/events"):
        ST.stream_daily_counts(spark, f"{base}/events", ev.schema, f"{base}/counts", f"{base}/ckpt")
    return ST.current_daily_counts(spark, f"{base}/counts").select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "count")


def q_posting_cards(spark, sf_dir):
    """All valid postings as cards, ranked within their company, newest first."""
    from pyspark.sql import Window
    w = _wh(_tables(spark, sf_dir))
    newest = Window.partitionBy("company_name").orderBy(F.col("posting_id").desc())
    ranked = SR.valid_postings(w.fact, AS_OF).select("posting_id", F.row_number().over(newest).alias("rank"))
    return D.posting_cards(ranked, w.fact, AS_OF).select("posting_id", "card")


def _crawl_rows(t: Tables) -> DataFrame:
    """Listing rows with a 'posted' text derived from the order date relative to as_of."""
    d = F.datediff(F.lit(AS_OF).cast("date"), F.col("batch_date"))
    text = (F.when(d == 0, F.lit("3시간 전 등록"))
            .when((d > 0) & (d < 30), F.concat(d.cast("string"), F.lit("일 전 등록")))
            .otherwise(F.date_format("batch_date", "MM/dd")))
    return t["postings_raw"].select("posting_id", F.col("company_key").alias("run_id"), "batch_date",
                                    text.alias("time_text"))


def q_recent_postings(spark, sf_dir):
    r = _crawl_rows(_tables(spark, sf_dir))
    return r.where(D.posted_within("time_text", F.lit(AS_OF).cast("date"), 7)).select("posting_id", "time_text")


def q_crawl_prefix(spark, sf_dir):
    """Each company's listing, newest first, read until the first row older than 30 days."""
    r = _crawl_rows(_tables(spark, sf_dir)).withColumn(
        "fresh", D.posted_within("time_text", F.lit(AS_OF).cast("date"), 30))
    r = r.withColumn("pos", -F.col("posting_id"))
    return D.crawl_prefix(r, "run_id", "pos", "fresh").select("run_id", "posting_id")


def q_listing_fields(spark, sf_dir):
    return D.listing_fields(_tables(spark, sf_dir)["listing_rows"], "https://example.com")


def q_page_fields(spark, sf_dir):
    return D.page_fields(_tables(spark, sf_dir)["pages"])


def _responses(t: Tables) -> DataFrame:
    """Stand-in model responses: the assistant turns of the conversations table."""
    return t["conversations"].where(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("response"))


def q_parse_scores(spark, sf_dir):
    r = _tables(spark, sf_dir)["score_responses"]
    return r.select("conv_id", "turn", F.posexplode(A.parse_scores(F.col("response"), 10)).alias("pos", "score"))


def q_parse_tags(spark, sf_dir):
    r = _responses(_tables(spark, sf_dir))
    return r.select("conv_id", "turn", F.posexplode(A.parse_tags(F.col("response"))).alias("pos", "tag"))


def _tag_responses(t: Tables) -> DataFrame:
    """One response per posting: every assistant turn answers for one posting id."""
    return _responses(t).select((F.col("conv_id") * 32 + F.col("turn")).alias("posting_id"), "response")


def q_tag_enrich(spark, sf_dir):
    t = _tables(spark, sf_dir)
    e = A.tag_enrich(_wh(t).fact, _tag_responses(t))
    return e.select("posting_id", F.explode("added").alias("tag"))


def q_tag_outcomes(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return A.tag_enrich(_wh(t).fact, _tag_responses(t)).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def q_tag_backlog(spark, sf_dir):
    return A.tag_backlog(_wh(_tables(spark, sf_dir)).fact, AS_OF)


def q_judge_incremental(spark, sf_dir):
    """Pairs of the pooled candidates not yet in the judgment cache, judged from stand-in responses."""
    t = _tables(spark, sf_dir)
    pool = E.pool_candidates(t["runs"], EVAL_MODES, 10).select("query_id", "doc_id")
    return A.judge_incremental(pool, t["judgments"], t["judge_responses"])


def q_rerank(spark, sf_dir):
    """L2: title-only search results (up to 25 a query, so up to three batches) reranked."""
    t = _tables(spark, sf_dir)
    q = _search_queries(t)
    w = _wh(t)
    found = SR.search(q, w.fact, AS_OF, 25, use_tags=False, fallback=True, **_index(t))
    return A.rerank(found, w.fact, q).select("query_id", "rank", "posting_id", _r9("score"))


def q_ingest_csv(spark, sf_dir):
    """The raw rows exported as one CSV per year (named with the year's first day),
    loaded back through the CSV path (no range validation, no position tags, deadline
    reference date from the file name), first writer wins in (file, row) order."""
    from ..sources import csv as CSV
    t = _tables(spark, sf_dir)
    base = _scratch(spark, "csv")
    crawl = F.concat(F.year("batch_date").cast("string"), F.lit("-01-01"))
    (t["postings_raw"].withColumn("crawl", crawl).repartitionByRange("crawl", "posting_id").sortWithinPartitions("crawl", "posting_id")
     .select("crawl", *[F.col(n).alias(h) for h, n in zip(CSV.CSV_HEADER, CSV.RAW_NAMES)])
     .write.option("header", True).partitionBy("crawl").csv(base))
    rows, _bad = CSV.read_csv_postings(spark, f"{base}/*")
    ok = N.accepted(N.normalize_postings(rows))
    ok = ok.withColumn("experience", F.col("experience_parsed")).withColumn("annual_salary", F.col("salary_parsed"))
    fact = S.first_wins_dedup(ok)
    return fact.select("company_name", "announcement_name", _d("deadline"), "experience", "annual_salary", "link",
                       _tags_text())


def q_csv_rejects(spark, sf_dir):
    """What the CSV path refuses, with the reason: here the re-crawl's files, whose
    names hold no date, beside a dated file of each year."""
    from ..sources import csv as CSV
    t = _tables(spark, sf_dir)
    base = _scratch(spark, "csv-rejects")
    for rows, name in ((t["postings_raw"].withColumn("crawl", F.concat(F.year("batch_date").cast("string"), F.lit("-01-01"))), "dated"),
                       (t["postings_recrawl"].withColumn("crawl", F.lit("undated")), "other")):
        (rows.select("crawl", *[F.col(n).alias(h) for h, n in zip(CSV.CSV_HEADER, CSV.RAW_NAMES)])
         .write.option("header", True).partitionBy("crawl").csv(f"{base}/{name}"))
    _, bad = CSV.read_csv_postings(spark, f"{base}/*/*")
    return bad.select(F.col("_corrupt").alias("reason"), "company", "title", "link")


def q_expansion_impact(spark, sf_dir):
    """Part-name keywords matched over the alert window before / after expansion."""
    t = _tables(spark, sf_dir)
    fact = _wh(t).fact
    posts = _new(fact)
    kws = t["keywords"].select(F.col("keyword").alias("user_id"), F.lit(1).alias("seq"), "keyword")
    exp = A.thesaurus_expansions(kws.select("keyword"), _thesaurus(t))
    before = AL.match_subscriptions(posts, kws)
    after = AL.match_subscriptions(posts, kws, expansions=exp)
    return E.expansion_impact(before, after)


def q_expansion_totals(spark, sf_dir):
    return E.expansion_totals(q_expansion_impact(spark, sf_dir))


def q_judgments_explode(spark, sf_dir):
    """Judgments written as JSON Lines and read back as long rows."""
    from ..sources import jsonio as J
    t = _tables(spark, sf_dir)
    path = _scratch(spark, "judgments-json")
    J.write_judgments(t["judgments"], path)
    return J.read_judgments(spark, path)


def q_parse_expansion(spark, sf_dir):
    """L1: assistant turns parsed as expansion responses for the first word of the
    user turn just before them."""
    t = _tables(spark, sf_dir)
    c = t["conversations"]
    user = c.where(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("turn"),
        F.regexp_extract("text", r"(?U)^\s*(\S+)", 1).alias("keyword"))
    r = _responses(t).join(user, ["conv_id", "turn"]).where(F.col("keyword") != "")
    return r.select("conv_id", "turn", F.posexplode(A.parse_expansion(F.col("keyword"), F.col("response")))
                    .alias("pos", "term"))


def q_rerank_impact(spark, sf_dir):
    """E12 with the lexical scorer: keyword-token share of title + tags."""
    from ..functions import text as TT
    t = _tables(spark, sf_dir)
    posts = _new(_wh(t).fact)
    kws = t["keywords"].select(F.col("keyword").alias("user_id"), F.lit(1).alias("seq"), "keyword")
    exp = A.thesaurus_expansions(kws.select("keyword"), _thesaurus(t))
    cand = AL.match_subscriptions(posts, kws, expansions=exp)
    rel = AL.match_subscriptions(posts, kws)
    toks = F.filter(F.split(F.lower(TT.strip("keyword")), TT.WS_RUN), lambda x: x != "")
    txt = AL.match_text(posts).withColumnRenamed("tid", "posting_id")
    sc = (cand.select("keyword", "posting_id").distinct().join(txt, "posting_id")
          .withColumn("_t", toks)
          .withColumn("score", F.aggregate("_t", F.lit(0), lambda a, x: a + F.when(F.instr("text", x) > 0, 1)
                                           .otherwise(0)) * 10.0 / F.size("_t")))
    return E.rerank_impact(cand, rel, sc)


def q_match_source_share(spark, sf_dir):
    """Part-name keywords searched (title or tag, top 10); where did they hit."""
    t = _tables(spark, sf_dir)
    fact = _wh(t).fact
    q = t["keywords"].select(F.col("keyword").alias("query_id"), "keyword",
                             F.lit(None).cast("date").alias("min_deadline"),
                             F.lit(None).cast("bigint").alias("min_annual_salary"),
                             F.lit(None).cast("string").alias("company_name"),
                             F.lit(None).cast("bigint").alias("max_experience"),
                             F.lit(None).cast("bigint").alias("form_code"),
                             F.lit(None).cast("string").alias("region"))
    res = SR.search(q, fact, AS_OF, 10, use_tags=True, fallback=True, **_index(t))
    return E.match_source_share(res, fact, q).withColumnRenamed("query_id", "keyword")


def q_alert_stream(spark, sf_dir):
    """The alert window's postings replayed as daily arrivals through the streaming
    matcher, starting from the previous run's log; the final log equals the batch one."""
    from ..streaming import jobs as ST
    t = _tables(spark, sf_dir)
    fact, subs, prof, exp = _alert_inputs(t)
    base = _scratch(spark, "stream-alerts")
    posts = _new(fact)
    ST.write_in_order(posts, "created_at", F.to_date("created_at").cast("timestamp").cast("bigint"), f"{base}/staged")
    ST.write_log(_previous_log(t), f"{base}/log")
    requests = AL.Requests(subs, prof, exp, first=True)
    for _ in ST.arrivals(spark, f"{base}/staged", f"{base}/posts"):
        ST.stream_alerts(spark, f"{base}/posts", posts.schema, subs, prof, exp, f"{base}/log", f"{base}/ckpt", requests)
    return ST.read_log(spark, f"{base}/log", posts.schema["posting_id"].dataType)


def q_rule_judgments(spark, sf_dir):
    """The baseline search results judged by rules derived from each parsed query."""
    from ..functions import text as TT
    t = _tables(spark, sf_dir)
    fact = _wh(t).fact
    q = _search_queries(t)
    res = SR.search(q, fact, AS_OF, 5, **_index(t)).select("query_id", "posting_id").distinct()
    cand = res.join(fact, "posting_id").select(
        "query_id", "posting_id", F.col("announcement_name").alias("title"), F.col("region_name").alias("region"),
        TT.form_name("form").alias("form"), TT.display_experience("experience").alias("experience"),
        TT.display_salary("annual_salary").alias("salary"))
    toks = F.filter(F.split(TT.strip("keyword"), TT.WS_RUN), lambda x: x != "")
    rules = q.select(
        "query_id", F.when(F.col("keyword").isNull(), F.array().cast("array<string>")).otherwise(toks).alias("keywords"),
        F.when(F.col("region").isNull(), F.array().cast("array<string>")).otherwise(F.array("region")).alias("regions"),
        F.col("form").alias("req_form"),
        F.when(F.col("max_experience") == 0, F.lit("신입"))
         .when(F.col("max_experience").isNotNull(), F.lit("years")).alias("exp_kind"),
        F.col("max_experience").alias("exp_years"), F.col("min_annual_salary").alias("min_salary"))
    return E.rule_judgments(cand, rules)


QUERIES = {
    "normalize_postings": q_normalize_postings,
    "rejects": q_rejects,
    "first_wins_dedup": q_first_wins_dedup,
    "ingest_batch": q_ingest_batch,
    "dim_upsert": q_dim_upsert,
    "posting_tags": q_posting_tags,
    "quality_events": q_quality_events,
    "top_tags": q_top_tags,
    "top_tags_all": q_top_tags_all,
    "quality_clean": q_quality_clean,
    "quality_clean_log": q_quality_clean_log,
    "completeness": q_completeness,
    "salary_dist": q_salary_dist,
    "salary_sketch_dist": q_salary_sketch_dist,
    "experience_bands": q_experience_bands,
    "form_dist": q_form_dist,
    "quality_event_summary": q_quality_event_summary,
    "quality_recent": q_quality_recent,
    "quality_report": q_quality_report,
    "salary_by_keyword": q_salary_by_keyword,
    "regional_dist": q_regional_dist,
    "experience_dist": q_experience_dist,
    "daily_new": q_daily_new,
    "market_snapshot": q_market_snapshot,
    "market_snapshot_range": q_market_snapshot_range,
    "snapshot_upsert": q_snapshot_upsert,
    "insight_report": q_insight_report,
    "expire_postings": q_expire_postings,
    "expire_fact": q_expire_fact,
    "expire_notifications": q_expire_notifications,
    "profile_display": q_profile_display,
    "subscription_delete_all": q_subscription_delete_all,
    "ab_overlap": q_ab_overlap,
    "pool_modes": q_pool_modes,
    "eval_summary_all": q_eval_summary_all,
    "unmapped_judgments": q_unmapped_judgments,
    "expansion_totals": q_expansion_totals,
    "listing_fields": q_listing_fields,
    "region_backfill": q_region_backfill,
    "fill_rate": q_fill_rate,
    "tag_merge": q_tag_merge,
    "tag_merge_report": q_tag_merge_report,
    "profile_upsert": q_profile_upsert,
    "subscription_cap": q_subscription_cap,
    "subscription_delete": q_subscription_delete,
    "parse_queries": q_parse_queries,
    "parse_queries_jobwords": q_parse_queries_jobwords,
    "search_and": q_search_and,
    "search_fallback": q_search_fallback,
    "search_name_only": q_search_name_only,
    "search_expanded": q_search_expanded,
    "search_baseline": q_search_baseline,
    "search_adaptive": q_search_adaptive,
    "ab_compare": q_ab_compare,
    "expand_keywords": q_expand_keywords,
    "list_valid": q_list_valid,
    "lookup_ids": q_lookup_ids,
    "text_match": q_text_match,
    "ngram_search": q_ngram_search,
    "text_match_selective": q_text_match_selective,
    "ngram_search_selective": q_ngram_search_selective,
    "postings_denorm": q_postings_denorm,
    "region_names": q_region_names,
    "new_postings": q_new_postings,
    "match_subscriptions": q_match_subscriptions,
    "match_expanded": q_match_expanded,
    "user_matches": q_user_matches,
    "alerts_pending": q_alerts_pending,
    "alert_log": q_alert_log,
    "alert_digest": q_alert_digest,
    "ndcg": q_ndcg,
    "precision_at_k": q_precision_at_k,
    "hit_at_k": q_hit_at_k,
    "eval_summary": q_eval_summary,
    "eval_by_type": q_eval_by_type,
    "eval_detail": q_eval_detail,
    "pool_candidates": q_pool_candidates,
    "judgment_dist": q_judgment_dist,
    "judgment_checks": q_judgment_checks,
    "quality_gate": q_quality_gate,
    "known_item_eval": q_known_item_eval,
    "stratified_sample": q_stratified_sample,
    "filter_regression": q_filter_regression,
    "stream_ingest": q_stream_ingest,
    "events_daily_new": q_events_daily_new,
    "posting_cards": q_posting_cards,
    "recent_postings": q_recent_postings,
    "crawl_prefix": q_crawl_prefix,
    "page_fields": q_page_fields,
    "parse_scores": q_parse_scores,
    "parse_tags": q_parse_tags,
    "tag_enrich": q_tag_enrich,
    "tag_outcomes": q_tag_outcomes,
    "tag_backlog": q_tag_backlog,
    "judge_incremental": q_judge_incremental,
    "rerank": q_rerank,
    "ingest_csv": q_ingest_csv,
    "csv_rejects": q_csv_rejects,
    "expansion_impact": q_expansion_impact,
    "judgments_explode": q_judgments_explode,
    "parse_expansion": q_parse_expansion,
    "rerank_impact": q_rerank_impact,
    "match_source_share": q_match_source_share,
    "alert_stream": q_alert_stream,
    "rule_judgments": q_rule_judgments,
}
