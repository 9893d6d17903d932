"""Batch search (F3-F12): a table of parsed queries against the posting table.

Plan shape for keyword queries:

  for each segment of the postings, newest ids first, and the queries still short of rows:
  query tokens --(distinct token = pattern)--> substring pairs (scan or n-gram)
      -> (token, posting) hits --salted join--> (query, posting, token idx)
      -> count distinct tokens per (query, posting): AND = all, OR = any
      -> join postings (valid only) + per-query predicates
      -> row_number() per query by posting id desc <= limit   (WindowGroupLimit:
         a partial top-k runs before the shuffle, so a query matching a third of
         all postings never ships them to one task)
  a query with enough rows leaves before older postings are joined

Queries without a keyword match on their structured filters only: their distinct
filter tuples are joined to the postings on region and form keys.  The
AND -> OR fallback is decided per query by a joined count, never by a driver-side
``if``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from ..session import materialize
from . import ngram

FILTER_COLS = ["min_deadline", "min_annual_salary", "company_name", "max_experience", "form_code", "region"]
BROADCAST_MAX_ROWS = 100_000
SEGMENT_SHARES = [0.2]   # postings of the newest segments, cumulative


def blocks(side: DataFrame, rows: int = BROADCAST_MAX_ROWS) -> list[DataFrame]:
    """``side`` in blocks of about ``rows`` rows by hash, each marked for broadcast: a
    stated table too large for one broadcast meets the other side block by block."""
    n = -(-side.count() // rows)
    h = F.pmod(F.xxhash64(*side.columns), F.lit(max(n, 1)))
    return [F.broadcast(side if n == 1 else side.where(h == i)) for i in range(n)]


def log_sized(queries: DataFrame):
    """What marks the tables that have a row (or some) for each of ``queries``: if a count finds
    many, joins must merge them.  The planner would go by file sizes, and the stored copy of
    millions of alike rows is a small file: it would broadcast them through the driver."""
    many = queries.limit(BROADCAST_MAX_ROWS + 1).count() > BROADCAST_MAX_ROWS
    return (lambda df: df.hint("merge")) if many else (lambda df: df)


def salted_join(big: DataFrame, small: DataFrame, on: list[str], buckets: int | None = None,
                salt_from: str | None = None) -> DataFrame:
    """Inner equi-join whose big side may hold a hot key.  Spark's skew join splits the
    hot key by its measured size; with ``buckets`` the big side is spread over so many
    salts (a hash of ``salt_from``, so recomputation is deterministic) and the small side
    replicated to every salt."""
    if buckets is None:
        return big.join(small, on)
    sf = salt_from or big.columns[0]
    b = big.withColumn("_salt", F.pmod(F.xxhash64(F.col(sf)), F.lit(buckets)))
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return b.join(s, on + ["_salt"]).drop("_salt")


def valid_postings(fact: DataFrame, as_of: str) -> DataFrame:
    return fact.where(F.col("deadline") >= F.lit(as_of).cast("date"))


def posting_texts(postings: DataFrame, use_tags: bool) -> DataFrame:
    t = postings.select(F.col("posting_id").alias("tid"), F.col("announcement_name").alias("text"))
    if use_tags:
        t = t.unionByName(postings.select(F.col("posting_id").alias("tid"),
                                          F.explode(F.array_distinct("tags")).alias("text")))
    return t


def keyword_tokens(queries: DataFrame, key: str = "query_id") -> DataFrame:
    """(``key``, tok_idx, token, n_tokens) of each query keyword (whitespace split)."""
    toks = F.filter(F.split(T.strip("keyword"), T.WS_RUN), lambda t: t != "")
    q = queries.where(F.col("keyword").isNotNull()).select(key, toks.alias("_t")).distinct()
    return q.select(key, F.size("_t").alias("n_tokens"), F.posexplode("_t").alias("tok_idx", "token"))


def term_hits(terms: DataFrame, postings: DataFrame, use_tags: bool, method: str = "ngram",
              index: DataFrame | None = None) -> DataFrame:
    """(token, posting_id) for every distinct term contained in a title (or tag).

    ``index``: a stored gram index over titles and tags of at least these postings."""
    pats = terms.select(F.col("token").alias("pid"), F.col("token").alias("pattern")).distinct()
    pairs = ngram.substring_pairs(pats, posting_texts(postings, use_tags), method=method, index=index)
    return pairs.select(F.col("pid").alias("token"), F.col("tid").alias("posting_id")).distinct()


def _predicates(fact_prefix: str = "") -> Column:
    """Per-query structured filters on a (query x posting) row (F4 null rules)."""
    c = F.col
    ok = F.lit(True)
    ok = ok & (c("min_deadline").isNull() | (c("deadline") >= c("min_deadline")))
    sal = c("min_annual_salary")
    ok = ok & (sal.isNull() | (sal == 0) | (c("annual_salary").isNotNull() & (c("annual_salary") >= sal)))
    mx = c("max_experience")
    ok = ok & (mx.isNull() | c("experience").isNull() | (c("experience") <= mx))
    ok = ok & (c("form_code").isNull() | (c("form") == c("form_code")))
    ok = ok & (c("region").isNull() | F.coalesce(F.array_contains("_regions", c("region_name")), F.lit(False)))
    ok = ok & (c("company_name").isNull() | F.coalesce(ngram.verify(c("p_company"), c("company_name")), F.lit(False)))
    return ok


def with_regions(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """``queries`` with ``_regions``: the region names of postings that contain the asked
    region, found once among the distinct names instead of for every posting."""
    names = postings.select("region_name").where("region_name is not null").distinct()
    asked = queries.select("region").where("region is not null").distinct()
    found = [names.join(side, F.coalesce(ngram.verify(F.col("region_name"), F.col("region")), F.lit(False))) for side in blocks(asked)]
    if not found:
        return queries.withColumn("_regions", F.array().cast("array<string>"))
    held = reduce(DataFrame.unionByName, found).groupBy("region").agg(F.collect_set("region_name").alias("_regions"))
    return queries.join(held, "region", "left")


POSTING_COLS = ["posting_id", "deadline", "annual_salary", "experience", "form", "region_name"]


def _postings_side(postings: DataFrame) -> DataFrame:
    return postings.select(*POSTING_COLS, F.col("company_name").alias("p_company"))


def top_k(pairs: DataFrame, limit: int) -> DataFrame:
    """Per query, the ``limit`` highest posting ids (rank 1 = highest)."""
    w = Window.partitionBy("query_id").orderBy(F.col("posting_id").desc())
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def _filtered(matches: DataFrame, queries: DataFrame, postings: DataFrame, key: str) -> DataFrame:
    """(query_id, posting_id) of matches by ``key`` (what queries ask for) that pass their filters."""
    q = queries.select("query_id", key, *FILTER_COLS, "_regions")
    offered = matches.join(_postings_side(postings), "posting_id")
    # many requests share a key: they are broadcast block by block, and pairs stay where they are made
    found = [offered.join(side, key).where(_predicates()).select("query_id", "posting_id") for side in blocks(q)]
    return reduce(DataFrame.unionByName, found) if found else offered.join(q, key).select("query_id", "posting_id")


def segments(postings: DataFrame) -> list[tuple[int | None, int | None]]:
    """[from, to) ranges of posting ids, newest first: ``SEGMENT_SHARES`` of the postings,
    then the rest.  None stands for no bound."""
    cuts = postings.agg(F.percentile_approx("posting_id", F.array(*[F.lit(1 - s) for s in SEGMENT_SHARES]), 1000)).first()[0] or []
    cuts = [None, *dict.fromkeys(int(c) for c in cuts), None]
    return [(lo, hi) for hi, lo in zip(cuts, cuts[1:])]


def _within(df: DataFrame, lo: int | None, hi: int | None, col: str = "posting_id") -> DataFrame:
    if lo is not None:
        df = df.where(F.col(col) >= lo)
    return df if hi is None else df.where(F.col(col) < hi)


def _rounds(asked: DataFrame, key: str, postings: DataFrame, ranges: list, limit: int, evaluate) -> DataFrame:
    """(``key``, posting_id): the ``limit`` newest postings for every row of ``asked``, which
    is cheap to read again.

    The order is by id, so newer postings are searched first: each round evaluates one
    segment for those who still lack rows, and who has ``limit`` leaves.  Requests with
    many hits never meet the older postings; a request with few meets each posting once,
    as it would in one pass.  ``evaluate(active, segment postings, lo, hi)`` gives
    (``key``, posting_id)."""
    if asked.isEmpty():
        return asked.select(key, F.lit(None).cast("bigint").alias("posting_id")).limit(0)
    mark = log_sized(asked)
    active, found = asked, None
    for lo, hi in ranges:
        w = Window.partitionBy(key).orderBy(F.col("posting_id").desc())
        best = evaluate(mark(active), _within(postings, lo, hi), lo, hi)
        best = materialize(best.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).select(key, "posting_id"), "found")
        found = best if found is None else found.unionByName(best)
        if (lo, hi) == ranges[-1]:
            break
        done = found.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= limit)
        active = active.join(mark(done), key, "left_anti").select(*asked.columns)
        if active.isEmpty():
            break
    return found


def _no_keyword(queries: DataFrame, postings: DataFrame, ranges: list, limit: int) -> DataFrame:
    """Queries without keyword: their distinct filter tuples meet the postings, a segment at
    a time, on a region key and a form key (``*`` where a tuple asks for none; a posting
    carries its own keys and ``*``, so it meets a tuple once at most), then all queries."""
    nk = queries.where(F.col("keyword").isNull())
    fid = F.to_json(F.struct(*FILTER_COLS))
    asked = materialize(nk.select(*FILTER_COLS, "_regions", fid.alias("_fid")).dropDuplicates(["_fid"]), "filters")
    star, name = F.array(F.lit("*")), F.concat(F.lit("="), "region_name")

    def evaluate(active, part, lo, hi):
        regions = F.when(F.col("region").isNull(), star).otherwise(F.transform("_regions", lambda r: F.concat(F.lit("="), r)))
        keyed = (active.withColumn("_rk", F.explode(regions)).withColumn("_fk", F.coalesce(F.col("form_code").cast("string"), F.lit("*"))))
        own = _postings_side(part).withColumn("_rk", F.explode(F.when(F.col("region_name").isNull(), star).otherwise(F.array(F.lit("*"), name))))
        own = own.withColumn("_fk", F.explode(F.when(F.col("form").isNull(), star).otherwise(F.array(F.lit("*"), F.col("form").cast("bigint").cast("string")))))
        return own.join(keyed, ["_rk", "_fk"]).where(_predicates()).select("_fid", "posting_id")

    best = _rounds(asked, "_fid", postings, ranges, limit, evaluate)
    return log_sized(nk)(nk.select("query_id", fid.alias("_fid"))).join(best, "_fid").select("query_id", "posting_id")


def match_counts(tokens: DataFrame, hits: DataFrame, key: str = "query_id") -> DataFrame:
    """(``key``, posting_id, matched, n_tokens) - distinct tokens of the query hit."""
    j = salted_join(hits, tokens, ["token"], salt_from="posting_id")
    return j.groupBy(key, "posting_id").agg(F.count(F.lit(1)).alias("matched"),
                                                   F.max("n_tokens").alias("n_tokens"))


def _asked(queries: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """(distinct requests under their smallest query id, all ids with that one): a query
    log repeats itself, and equal requests have equal answers."""
    key = F.to_json(F.struct(F.col("keyword"), *FILTER_COLS, *more), {"ignoreNullFields": "false"})
    ids = queries.select("query_id", key.alias("_k"))
    first = ids.groupBy("_k").agg(F.min("query_id").alias("_first"))
    mark = log_sized(queries)
    same = mark(ids).join(first, "_k").select("query_id", "_first")
    return queries.join(mark(first.select(F.col("_first").alias("query_id"))), "query_id", "left_semi"), mark(same)


def _answered(results: DataFrame, same: DataFrame) -> DataFrame:
    return results.withColumnRenamed("query_id", "_first").join(same, "_first").drop("_first")


def search(queries: DataFrame, fact: DataFrame, as_of: str, limit: int = 5, use_tags: bool = True,
           fallback: bool = True, method: str = "ngram", hits: DataFrame | None = None,
           index: DataFrame | None = None) -> DataFrame:
    """F4 without expansion: AND of tokens, OR fallback (per query), top ``limit``.

    Returns (query_id, rank, posting_id, mode) with mode 'and' | 'or' | 'filter'.  Equal
    requests are searched once.
    """
    queries, same = _asked(queries)
    out = _search(queries, fact, as_of, limit, use_tags, fallback, method, hits, index)
    return _answered(out, same).select("query_id", "rank", "posting_id", "mode")


def _search(queries: DataFrame, fact: DataFrame, as_of: str, limit: int, use_tags: bool, fallback: bool, method: str,
            hits: DataFrame | None, index: DataFrame | None) -> DataFrame:
    postings = valid_postings(fact, as_of)
    ranges = segments(postings)
    queries = materialize(with_regions(queries, postings), "requests")
    mark = log_sized(queries)
    tokens = keyword_tokens(queries, "keyword")
    if hits is None:
        hits = term_hits(tokens, postings, use_tags, method, index)
    # requests share their keywords: tokens are counted once for each keyword and posting
    counts = materialize(match_counts(tokens, hits, "keyword"), "matched")

    def top(ids: DataFrame, every: bool) -> DataFrame:
        """The newest postings that hold every token of a query, or any."""
        held = counts.where(F.col("matched") == F.col("n_tokens")) if every else counts

        def evaluate(active, part, lo, hi):
            return _filtered(_within(held, lo, hi).select("keyword", "posting_id"), queries.join(active, "query_id", "left_semi"), part, "keyword")

        return top_k(_rounds(ids, "query_id", postings, ranges, limit, evaluate), limit)

    n_tokens = F.size(F.filter(F.split(T.strip("keyword"), T.WS_RUN), lambda t: t != ""))
    with_and = queries.where(F.col("keyword").isNotNull() & (n_tokens > 0)).select("query_id")
    multi = queries.where(F.col("keyword").isNotNull() & (n_tokens > 1)).select("query_id")
    thr = V.FALLBACK_MIN_WITH_TAGS if use_tags else V.FALLBACK_MIN_NAME_ONLY
    if fallback and limit < thr:  # whatever they find is below the threshold
        with_and = with_and.join(mark(multi), "query_id", "left_anti")
    and_top = top(with_and, True)
    out = and_top.withColumn("mode", F.lit("and"))
    if fallback:
        n_and = and_top.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
        fb = materialize(multi.join(mark(n_and), "query_id", "left").where(F.coalesce(F.col("_n"), F.lit(0)) < thr).select("query_id"), "fallback")
        out = (out.join(mark(fb), "query_id", "left_anti")
               .unionByName(top(fb, False).withColumn("mode", F.lit("or"))))
    nk = _no_keyword(queries, postings, ranges, limit)
    out = out.unionByName(top_k(nk, limit).withColumn("mode", F.lit("filter")))
    return out.select("query_id", "rank", "posting_id", "mode")


def search_expanded(queries: DataFrame, fact: DataFrame, as_of: str, limit: int, method: str = "ngram",
                    index: DataFrame | None = None) -> DataFrame:
    """F4 with expansion: OR over the ``expanded`` terms, always title + tags."""
    postings = valid_postings(fact, as_of)
    queries, same = _asked(queries, "expanded")
    queries = materialize(with_regions(queries.where(F.size("expanded") > 0), postings), "requests")
    terms = queries.select("expanded").distinct().select("expanded", F.explode(F.array_distinct("expanded")).alias("token"))
    hits = term_hits(terms, postings, True, method, index)
    held = materialize(salted_join(hits, terms, ["token"], salt_from="posting_id").select("expanded", "posting_id").distinct(), "matched")

    def evaluate(active, part, lo, hi):
        return _filtered(_within(held, lo, hi), queries.join(active, "query_id", "left_semi"), part, "expanded")

    found = _rounds(queries.select("query_id"), "query_id", postings, segments(postings), limit, evaluate)
    out = top_k(found, limit).withColumn("mode", F.lit("expanded"))
    return _answered(out, same).select("query_id", "rank", "posting_id", "mode")


def list_valid(fact: DataFrame, as_of: str, limit: int = 10000, order_desc: bool = False) -> DataFrame:
    """valid postings by id, first ``limit``."""
    o = F.col("posting_id").desc() if order_desc else F.col("posting_id").asc()
    return valid_postings(fact, as_of).orderBy(o).limit(limit)


def lookup_ids(fact: DataFrame, ids: DataFrame) -> DataFrame:
    """postings whose id is in ``ids`` (no validity filter)."""
    return fact.join(ids.select("posting_id"), "posting_id", "left_semi")


def postings_denorm(fact: DataFrame, bridge: DataFrame) -> DataFrame:
    """F8: posting with its tag names gathered from the bridge (sorted set)."""
    tags = bridge.groupBy("posting_id").agg(F.sort_array(F.collect_set("tag")).alias("tag_list"))
    return fact.drop("tags").join(tags, "posting_id", "left").withColumn(
        "tags", F.coalesce("tag_list", F.array().cast("array<string>"))).drop("tag_list")


def region_names(fact: DataFrame) -> DataFrame:
    """distinct (region, subregion, 'region subregion') with a subregion."""
    return (fact.where(F.col("subregion_name").isNotNull() & F.col("region_name").isNotNull())
            .select(F.col("region_name").alias("region"), F.col("subregion_name").alias("subregion"))
            .distinct()
            .withColumn("full_region_name", F.concat_ws(" ", "region", "subregion")))


def lexical_scores(results: DataFrame, fact: DataFrame, queries: DataFrame) -> DataFrame:
    """Default relevance scorer: 10 x share of keyword tokens found in title + tags."""
    toks = F.filter(F.split(F.lower(T.strip("keyword")), T.WS_RUN), lambda t: t != "")
    q = log_sized(queries)(queries.select("query_id", toks.alias("_toks")))
    p = fact.select("posting_id", F.lower(F.concat_ws(" ", F.col("announcement_name"),
                                                     F.array_join("tags", " "))).alias("_txt"))
    j = results.join(q, "query_id").join(p, "posting_id")
    hit = F.aggregate(F.col("_toks"), F.lit(0), lambda acc, t: acc + F.when(F.instr("_txt", t) > 0, 1).otherwise(0))
    return j.withColumn("score", F.when(F.size("_toks") > 0, hit * 10.0 / F.size("_toks")).otherwise(F.lit(5.0))) \
        .drop("_toks", "_txt")


def rerank_results(results: DataFrame, scores: DataFrame, mark=lambda df: df) -> DataFrame:
    """Stable sort per query: score desc, then the input rank.  ``mark``: as of ``log_sized``."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("rank").asc())
    return (results.join(mark(scores.select("query_id", "posting_id", "score")), ["query_id", "posting_id"])
            .withColumn("rank", F.row_number().over(w)))


def search_adaptive(queries: DataFrame, fact: DataFrame, as_of: str, limit: int = 5,
                    expansions: DataFrame | None = None, scorer=None, method: str = "ngram",
                    index: DataFrame | None = None) -> DataFrame:
    """pool = max(5 x limit, 50) by F4 (with fallback); fewer than 3 rows and a
    keyword -> the expanded OR search replaces the pool; rerank when a keyword and
    more than one row; keep ``limit``.

    ``expansions`` is (query_id, expanded array); ``scorer(results, fact, queries)``
    returns (query_id, posting_id, score), the lexical scorer by default.
    """
    pool = max(limit * V.ADAPTIVE_POOL_FACTOR, V.ADAPTIVE_POOL_MIN)
    # per-query pools are bounded (pool x queries rows); each is referenced by several
    # branches below, so it is stored once instead of being recomputed per branch
    mark = log_sized(queries)
    first = materialize(search(queries, fact, as_of, pool, True, True, method, None, index), "pools")
    n1 = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    need = (queries.where(F.col("keyword").isNotNull()).select("query_id")
            .join(mark(n1), "query_id", "left").where(F.coalesce(F.col("_n"), F.lit(0)) < V.ADAPTIVE_THRESHOLD)
            .select("query_id"))
    need = mark(materialize(need, "short"))
    out = first.join(need, "query_id", "left_anti")
    # a missing expansion falls back to the keyword alone (the expander's failure contract)
    eq = queries.join(need, "query_id", "left_semi")
    if expansions is not None:
        eq = eq.join(mark(expansions.select("query_id", "expanded")), "query_id", "left")
    else:
        eq = eq.withColumn("expanded", F.lit(None).cast("array<string>"))
    eq = eq.withColumn("expanded", F.coalesce("expanded", F.array("keyword")))
    out = materialize(out.unionByName(search_expanded(eq, fact, as_of, pool, method, index)), "pools")
    scorer = scorer or lexical_scores
    with_kw = queries.where(F.col("keyword").isNotNull()).select("query_id")
    cnt = out.groupBy("query_id").agg(F.count(F.lit(1)).alias("_c"))
    rr_ids = mark(with_kw.join(mark(cnt.where(F.col("_c") > 1)), "query_id", "left_semi"))
    to_rr = out.join(rr_ids, "query_id", "left_semi")
    reranked = rerank_results(to_rr, scorer(to_rr, fact, queries), mark).drop("score")
    final = out.join(rr_ids, "query_id", "left_anti").unionByName(reranked.select(*out.columns))
    return final.where(F.col("rank") <= limit)
