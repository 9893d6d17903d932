"""Retrieval evaluation (E1-E16) over long tables.

``runs(query_id, mode, doc_id, rank)`` holds ranked results, ``judgments(query_id,
doc_id, rel)`` graded relevance (0..3).  Every metric is a join + grouped aggregate;
per-query ideal rankings use ``row_number() <= k`` (a partial top-k runs before the
shuffle), so a query with a huge judgment list never sorts it in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

MODES_ORDER_COL = "mode_ord"


def _gain(rank_col: str = "rank"):
    return F.col("rel") / F.log2(F.col(rank_col) + 1)


def ideal_dcg(judgments: DataFrame, k: int) -> DataFrame:
    """(query_id, idcg@k): gains of the query's best k judged documents."""
    w = Window.partitionBy("query_id").orderBy(F.col("rel").desc(), F.col("doc_id"))
    top = judgments.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return top.groupBy("query_id").agg(F.sum(F.col("rel") / F.log2(F.col("_r") + 1)).alias("idcg"))


def per_query(runs: DataFrame, judgments: DataFrame, k: int, p_threshold: int = 1,
              hit_threshold: int = 2) -> DataFrame:
    """(query_id, mode, ndcg, precision, hit) at cut-off k, for every (query, mode)
    with at least one result and at least one judgment (unjudged documents count 0;
    the precision divisor is k even with fewer results)."""
    top = runs.where(F.col("rank") <= k).join(judgments, ["query_id", "doc_id"], "left") \
        .withColumn("rel", F.coalesce(F.col("rel"), F.lit(0)))
    agg = top.groupBy("query_id", "mode").agg(
        F.sum(_gain()).alias("dcg"),
        F.sum(F.when(F.col("rel") >= p_threshold, 1).otherwise(0)).alias("_p"),
        F.max(F.when(F.col("rel") >= hit_threshold, 1).otherwise(0)).alias("hit"))
    ideal = ideal_dcg(judgments, k)
    return (agg.join(ideal, "query_id")
            .select("query_id", "mode",
                    F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(F.lit(0.0)).alias("ndcg"),
                    (F.col("_p") / F.lit(float(k))).alias("precision"),
                    F.col("hit").cast("double").alias("hit")))


def summary(runs: DataFrame, judgments: DataFrame, ks=(5, 10), all_queries: DataFrame | None = None) -> DataFrame:
    """Per mode, mean of each metric over (query, mode) pairs that have results and
    judgments; with ``all_queries`` the sum is divided by the number of all queries.

    One pass for all ``ks``: results join the judgments once, the ideal ranking is made
    once up to the largest k, and each k is a conditional sum."""
    def within(k, rank, x):
        return F.sum(F.when(F.col(rank) <= k, x))

    top = max(ks)
    seen = (runs.where(F.col("rank") <= top).join(judgments, ["query_id", "doc_id"], "left")
            .withColumn("rel", F.coalesce("rel", F.lit(0))))
    got = seen.groupBy("query_id", "mode").agg(
        *[within(k, "rank", _gain()).alias(f"dcg_{k}") for k in ks],
        *[(within(k, "rank", F.when(F.col("rel") >= 1, 1).otherwise(0)) / float(k)).alias(f"p_{k}") for k in ks],
        *[F.max(F.when((F.col("rank") <= k) & (F.col("rel") >= 2), 1.0).otherwise(0.0)).alias(f"hit_{k}") for k in ks])
    w = Window.partitionBy("query_id").orderBy(F.col("rel").desc(), F.col("doc_id").asc())
    ideal = (judgments.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top)
             .groupBy("query_id").agg(*[within(k, "_r", _gain("_r")).alias(f"idcg_{k}") for k in ks]))
    j = got.join(ideal, "query_id")
    names = []
    for k in ks:
        j = j.withColumn(f"ndcg_{k}", F.when(F.col(f"idcg_{k}") > 0, F.col(f"dcg_{k}") / F.col(f"idcg_{k}")).otherwise(0.0))
        names += [f"ndcg_{k}", f"p_{k}", f"hit_{k}"]
    if all_queries is None:
        return j.groupBy("mode").agg(*[F.avg(c).alias(c) for c in names])
    n = all_queries.select("query_id").distinct().count()
    return j.groupBy("mode").agg(*[(F.sum(c) / n).alias(c) for c in names])


def overlap_at_k(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """per query with results on either side, how many of the first ``k`` results the
    two share, and that as a share of ``k``.  Inputs are (query_id, rank, posting_id)."""
    side = lambda df, name: df.where(F.col("rank") <= k).select("query_id", "posting_id", F.lit(1).alias(name))
    j = side(a, "_a").join(side(b, "_b"), ["query_id", "posting_id"], "full_outer")
    both = F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1))
    return j.groupBy("query_id").agg(both.alias("shared"), (both / F.lit(float(k))).alias("overlap"))


def unmapped_judgments(judgments: DataFrame, documents: DataFrame) -> DataFrame:
    """Judged pairs whose document id no longer exists."""
    return judgments.select("query_id", "doc_id").join(documents.select("doc_id"), "doc_id", "left_anti").select("query_id", "doc_id")


def by_type(runs: DataFrame, judgments: DataFrame, types: DataFrame, k: int = 10,
            baseline_mode: str | None = None) -> DataFrame:
    """E7 per query type: mean NDCG@k per (type, mode), and the delta to a baseline mode."""
    pq = per_query(runs, judgments, k).join(types.select("query_id", "qtype"), "query_id")
    m = pq.groupBy("qtype", "mode").agg(F.avg("ndcg").alias("ndcg"))
    if baseline_mode is None:
        return m
    base = m.where(F.col("mode") == baseline_mode).select("qtype", F.col("ndcg").alias("_b"))
    return m.join(base, "qtype", "left").withColumn("delta", F.col("ndcg") - F.col("_b")).drop("_b")


def detail(runs: DataFrame, judgments: DataFrame, modes: list[str], k: int = 10) -> DataFrame:
    """Per query, NDCG@k of each mode side by side (explicit pivot values)."""
    pq = per_query(runs, judgments, k)
    return pq.groupBy("query_id").pivot("mode", modes).agg(F.first("ndcg"))


def pool_candidates(runs: DataFrame, modes: list[str], k: int = 10) -> DataFrame:
    """Union of each mode's top k; a document keeps its first-seen position
    (modes in the given order, then rank)."""
    order = F.create_map(*[x for i, m in enumerate(modes) for x in (F.lit(m), F.lit(i))])
    r = runs.where(F.col("rank") <= k).withColumn(MODES_ORDER_COL, F.try_element_at(order, F.col("mode")))
    first = r.groupBy("query_id", "doc_id").agg(F.min(F.struct(MODES_ORDER_COL, "rank")).alias("_f"))
    w = Window.partitionBy("query_id").orderBy("_f")
    return first.withColumn("pool_pos", F.row_number().over(w)).select(
        "query_id", "doc_id", "pool_pos", F.col("_f.mode_ord").alias("first_mode"))


def judgment_dist(judgments: DataFrame) -> DataFrame:
    """E2 distribution: documents per (query, rel)."""
    return judgments.groupBy("query_id", "rel").agg(F.count(F.lit(1)).alias("n"))


def judgment_checks(judgments: DataFrame, min_relevant_share: float = 0.10,
                    exempt: DataFrame | None = None) -> DataFrame:
    """Violations as rows (query_id, check): rel outside 0..3, duplicate pairs,
    no document with the top score 3, share of rel >= 2 below the minimum."""
    per = judgments.groupBy("query_id").agg(
        F.sum(F.when((F.col("rel") < 0) | (F.col("rel") > 3), 1).otherwise(0)).alias("bad"),
        (F.count(F.lit(1)) - F.count_distinct("doc_id")).alias("dups"),
        F.max("rel").alias("top"),
        F.avg(F.when(F.col("rel") >= 2, 1.0).otherwise(0.0)).alias("share"))
    checks = F.array(
        F.when(F.col("bad") > 0, F.lit("score_range")),
        F.when(F.col("dups") > 0, F.lit("duplicate")),
        F.when(F.col("top") < 3, F.lit("no_top_score")),
        F.when(F.col("share") < min_relevant_share, F.lit("relevant_share")))
    out = per.select("query_id", F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("check"))
    if exempt is not None:
        out = out.join(exempt.select("query_id").withColumn("check", F.lit("relevant_share")),
                       ["query_id", "check"], "left_anti")
    return out


def quality_gate(runs: DataFrame, judgments: DataFrame, k: int = 5, min_mean: float = 1.0) -> DataFrame:
    """Per (query, mode), mean judged relevance of the top k (judged only) and
    hits with rel >= 2; queries with nothing judged in the top k are skipped."""
    top = runs.where(F.col("rank") <= k).join(judgments, ["query_id", "doc_id"])
    return (top.groupBy("query_id", "mode")
            .agg(F.avg("rel").alias("mean_rel"), F.sum(F.when(F.col("rel") >= 2, 1).otherwise(0)).alias("hits"))
            .withColumn("passed", (F.col("mean_rel") >= min_mean) & (F.col("hits") >= 1)))


def known_item(runs: DataFrame, targets: DataFrame, ks=(5, 10)) -> DataFrame:
    """Per mode, Hit@k, MRR (miss = 0) and zero-result rate over all targets,
    rounded to 4 decimals.  ``targets(query_id, doc_id)``: the one correct document."""
    modes = runs.select("mode").distinct()
    names = F.array_sort(F.collect_set("mode"))  # of the runs' systems, a handful
    t = targets.withColumn("mode", F.explode(F.array(*(F.lit(m) for m in modes.agg(names).first()[0]))))
    n_res = runs.groupBy("query_id", "mode").agg(F.count(F.lit(1)).alias("_n"))
    found = runs.join(targets, ["query_id", "doc_id"]).groupBy("query_id", "mode").agg(F.min("rank").alias("_rk"))
    j = t.join(found, ["query_id", "mode"], "left").join(n_res, ["query_id", "mode"], "left")
    aggs = [F.round(F.avg(F.when(F.col("_rk") <= k, 1.0).otherwise(0.0)), 4).alias(f"hit_{k}") for k in ks]
    return j.groupBy("mode").agg(*aggs, F.round(F.avg(F.coalesce(1.0 / F.col("_rk"), F.lit(0.0))), 4).alias("mrr"),
                                 F.round(F.avg(F.when(F.coalesce("_n", F.lit(0)) == 0, 1.0).otherwise(0.0)), 4)
                                 .alias("zero_rate"))


def stratified_sample(df: DataFrame, id_col: str, stratum, n: int, share: float = 0.7, seed: int = 42) -> DataFrame:
    """``int(n * share)`` rows where ``stratum`` (a boolean column) holds, or all there
    are; then rows where it does not (a NULL counts as such) until ``n``, or all there are.
    Each stratum goes in the order of md5(id || ':' || seed), then the id, through a
    distributed top-k (every task keeps its first ``n`` only)."""
    yes = F.coalesce(stratum, F.lit(False))
    order = [F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")).cast("binary")), F.col(id_col)]
    first = df.where(yes).orderBy(*order).limit(int(n * share))
    first = materialize(first, "stratum")
    return first.unionByName(df.where(~yes).orderBy(*order).limit(n - first.count()))


def filter_regression(expected: DataFrame, actual: DataFrame, key: str = "query_id") -> DataFrame:
    """Per key, the filter fields whose values differ (NULLs dropped first)."""
    def long(df, side):
        cols = [c for c in df.columns if c != key]
        kv = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in cols])
        return df.select(key, F.explode(kv).alias("kv")).where(F.col("kv.value").isNotNull()) \
            .select(key, "kv.field", F.col("kv.value").alias(side))
    j = long(expected, "expected").join(long(actual, "actual"), [key, "field"], "full_outer")
    return j.where(~F.col("expected").eqNullSafe(F.col("actual")))


def expansion_impact(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per keyword, postings matched before (AND of tokens) and after (OR over
    the expansion), the new ones (after minus before) and the ratio (NULL when
    nothing matched before).  Inputs are (keyword, posting_id) match tables."""
    b = before.select("keyword", "posting_id").distinct().withColumn("_b", F.lit(1))
    a = after.select("keyword", "posting_id").distinct().withColumn("_a", F.lit(1))
    j = b.join(a, ["keyword", "posting_id"], "full_outer")
    return (j.groupBy("keyword").agg(F.count("_b").alias("matched_before"), F.count("_a").alias("matched_after"),
                                     F.sum(F.when(F.col("_a").isNotNull() & F.col("_b").isNull(), 1).otherwise(0))
                                     .alias("new_matches"))
            .withColumn("expansion_ratio", F.when(F.col("matched_before") > 0,
                                                  F.round(F.col("matched_after") / F.col("matched_before"), 2))))


def expansion_totals(impact: DataFrame) -> DataFrame:
    """E11 totals row: sums over all keywords and the ratio of the sums."""
    return (impact.agg(F.count(F.lit(1)).alias("keywords"), F.sum("matched_before").alias("matched_before"),
                       F.sum("matched_after").alias("matched_after"), F.sum("new_matches").alias("new_matches"))
            .withColumn("expansion_ratio", F.when(F.col("matched_before") > 0, F.round(F.col("matched_after") / F.col("matched_before"), 2))))


def rerank_impact(candidates: DataFrame, relevant: DataFrame, scores: DataFrame, k: int = 10,
                  pool: int = 50) -> DataFrame:
    """Per keyword, precision@k of the candidates by id descending (before) and of
    the first ``pool`` candidates in input (id ascending) order reranked stably by
    score (after); a hit is a candidate in ``relevant``.  Inputs are (keyword,
    posting_id) tables plus scores (keyword, posting_id, score)."""
    rel = relevant.select("keyword", "posting_id").distinct().withColumn("_hit", F.lit(1))
    c = candidates.select("keyword", "posting_id").distinct().join(rel, ["keyword", "posting_id"], "left")
    wb = Window.partitionBy("keyword").orderBy(F.col("posting_id").desc())
    before = (c.withColumn("_r", F.row_number().over(wb)).where(F.col("_r") <= k)
              .groupBy("keyword").agg((F.count("_hit") / F.lit(float(k))).alias("p_before")))
    wp = Window.partitionBy("keyword").orderBy(F.col("posting_id").asc())
    first = c.withColumn("_r", F.row_number().over(wp)).where(F.col("_r") <= pool) \
        .join(scores.select("keyword", "posting_id", "score"), ["keyword", "posting_id"])
    wa = Window.partitionBy("keyword").orderBy(F.col("score").desc(), F.col("_r").asc())
    after = (first.withColumn("_a", F.row_number().over(wa)).where(F.col("_a") <= k)
             .groupBy("keyword").agg((F.count("_hit") / F.lit(float(k))).alias("p_after")))
    n = c.groupBy("keyword").agg(F.count(F.lit(1)).alias("candidates"))
    return (n.join(before, "keyword").join(after, "keyword")
            .select("keyword", "candidates", F.round("p_before", 3).alias("p_before"),
                    F.round("p_after", 3).alias("p_after"),
                    F.round(F.col("p_after") - F.col("p_before"), 3).alias("delta")))


def match_source_share(results: DataFrame, fact: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Per query, among its top-k results: how many hold the query text in the
    title, how many only in a tag, and both as shares of min(k, results)."""
    q = queries.select("query_id", F.lower("keyword").alias("_kw"))
    f = fact.select("posting_id", F.lower(F.coalesce("announcement_name", F.lit(""))).alias("_title"),
                    F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.lower(t)).alias("_tags"))
    j = results.where(F.col("rank") <= k).join(q, "query_id").join(f, "posting_id")
    in_title = F.instr("_title", F.col("_kw")) > 0
    in_tag = F.exists("_tags", lambda t: F.instr(t, F.col("_kw")) > 0)
    a = j.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("results"),
        F.sum(F.when(in_title, 1).otherwise(0)).alias("hits_name"),
        F.sum(F.when(~in_title & in_tag, 1).otherwise(0)).alias("hits_tag_only"))
    d = F.least(F.lit(k), F.col("results"))
    return a.select("query_id", "results", "hits_name", "hits_tag_only",
                    F.round(F.col("hits_name") / d, 4).alias("share_name"),
                    F.round((F.col("hits_name") + F.col("hits_tag_only")) / d, 4).alias("share_any"))


def parse_salary_display(c) -> F.Column:
    """E3: '3000만원/년' -> 3000; '협의' or anything without 'N만원' -> NULL."""
    v = F.regexp_extract(c, r"(\d+)만원", 1)
    return F.when(c.isNull() | (c == "협의") | (v == ""), F.lit(None).cast("bigint")).otherwise(v.try_cast("bigint"))


def parse_experience_display(c) -> F.Column:
    """E3: '신입' -> 0; '무관' -> NULL; 'N년 ...' -> N."""
    v = F.regexp_extract(c, r"(\d+)년", 1)
    return (F.when(c.isNull() | (c == ""), F.lit(None).cast("bigint"))
            .when(c.contains("신입"), F.lit(0).cast("bigint"))
            .when(c.contains("무관"), F.lit(None).cast("bigint"))
            .when(v != "", v.try_cast("bigint")))


def rule_judgments(candidates: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule-based relevance 0..3 of (query, posting) candidates.

    ``candidates``: query_id, posting_id, title, region, form, experience, salary
    (display texts); ``rules``: query_id, keywords array, regions array, form,
    exp_kind ('신입' | '경력' | 'years' | NULL), exp_years, min_salary.
    Job keywords must hit the title (else 0; no keywords -> base 2); -1 for a region
    or form mismatch; experience: 신입 -> -1 if > 1 year, +1 if 0 or unknown; 경력 -> -1
    if 0; N years -> +1 if >= N, -1 if < N-1; -1 if the salary is below the minimum;
    clamped to 0..3.

    Rules of single queries are optional columns of ``rules``: ``must_have`` (one of these
    words must stand in the title, as written, else 0), ``floor`` (least score then),
    ``ceiling`` (most score) and ``bonus`` (one of these words lifts the score by one to 3
    at most; without one the ceiling holds).
    """
    for c, kind in (("must_have", "array<string>"), ("floor", "int"), ("ceiling", "int"), ("bonus", "array<string>")):
        if c not in rules.columns:
            rules = rules.withColumn(c, F.lit(None).cast(kind))
    j = candidates.join(rules, "query_id")
    title = F.lower(F.coalesce("title", F.lit("")))
    kws = F.coalesce("keywords", F.array().cast("array<string>"))
    regs = F.coalesce("regions", F.array().cast("array<string>"))
    job = F.exists(kws, lambda k: F.instr(title, F.lower(k)) > 0)
    yrs = parse_experience_display(F.col("experience"))
    sal = parse_salary_display(F.col("salary"))
    s = F.lit(2)
    s = s - F.when((F.size(regs) > 0) & ~F.exists(regs, lambda r: F.instr(F.coalesce("region", F.lit("")), r) > 0), 1) \
        .otherwise(0)
    s = s - F.when(F.col("req_form").isNotNull() & ~F.col("req_form").eqNullSafe(F.col("form")), 1).otherwise(0)
    exp_adj = (F.when(F.col("exp_kind") == "신입",
                      F.when(yrs > 1, -1).when(yrs.isNull() | (yrs == 0), 1).otherwise(0))
               .when(F.col("exp_kind") == "경력", F.when(yrs == 0, -1).otherwise(0))
               .when(F.col("exp_kind") == "years",
                     F.when(yrs.isNull(), 0).when(yrs >= F.col("exp_years"), 1)
                     .when(yrs < F.col("exp_years") - 1, -1).otherwise(0))
               .otherwise(0))
    s = s + exp_adj
    s = s - F.when(F.col("min_salary").isNotNull() & (F.col("min_salary") != 0) & sal.isNotNull()
                   & (sal < F.col("min_salary")), 1).otherwise(0)
    def named(words):
        return F.exists(words, lambda w: F.instr(F.coalesce("title", F.lit("")), w) > 0)

    s = F.greatest(s, F.coalesce("floor", s))
    s = F.when(F.coalesce(named("bonus"), F.lit(False)), F.least(s + 1, F.lit(3))).otherwise(F.least(s, F.coalesce("ceiling", s)))
    none = ((F.size(kws) > 0) & ~job) | F.coalesce(~named("must_have"), F.lit(False))
    score = F.when(none, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(3), s)))
    return j.select("query_id", "posting_id", score.cast("int").alias("rel"))
