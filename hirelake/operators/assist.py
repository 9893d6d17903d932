"""Model-assisted steps (L1-L5) as Spark jobs around a supplied function.

The reference calls a model one item at a time.  Here the *contracts* are kept:
batching, response parsing, fallbacks and merging are column expressions or
groupings; the model itself is a caller-supplied ``mapInPandas`` function, and the
built-in default is a deterministic dictionary / lexical function that runs natively.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from .keys import sequential_ids


def _first_line(c: Column) -> Column:
    """First line of the stripped response (null/blank -> null)."""
    s = T.strip(c)
    return T.blank_to_null(F.split(s, r"\r?\n|\r", 2).getItem(0))


def parse_expansion(keyword: Column, response: Column) -> Column:
    """L1 response contract: first line, comma split, strip, keep 1..20 characters,
    the keyword prepended when missing; no usable response -> [keyword]."""
    items = F.filter(F.transform(F.split(_first_line(response), ","), lambda t: T.strip(t)),
                     lambda t: (F.length(t) >= 1) & (F.length(t) <= V.MODEL_TOKEN_MAX_LEN))
    items = F.coalesce(items, F.array().cast("array<string>"))
    with_kw = F.when(F.array_contains(items, keyword), items).otherwise(F.concat(F.array(keyword), items))
    return F.when(response.isNull(), F.array(keyword)).otherwise(with_kw)


def thesaurus_expansions(keywords: DataFrame, thesaurus: DataFrame, k: int = 3) -> DataFrame:
    """Default expander: (keyword) -> (keyword, expanded).

    Each whitespace token of the keyword contributes its ``k`` strongest related terms
    of ``thesaurus(term, related, weight)`` (weight desc, term asc); the keyword comes
    first; terms are kept once, 1..20 characters.  The per-term top-k keeps the
    collected list bounded by k x tokens.
    """
    kws = keywords.select("keyword").where(F.col("keyword").isNotNull()).distinct()
    toks = kws.select("keyword", F.posexplode(F.filter(F.split(T.strip("keyword"), T.WS_RUN),
                                                       lambda t: t != "")).alias("tok_idx", "term"))
    w = Window.partitionBy("term").orderBy(F.col("weight").desc(), F.col("related").asc())
    top = thesaurus.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    rel = toks.join(top, "term").where(F.length("related").between(1, V.MODEL_TOKEN_MAX_LEN))
    grouped = rel.groupBy("keyword").agg(
        F.sort_array(F.collect_list(F.struct("tok_idx", "_r", "related"))).alias("_l"))
    out = kws.join(grouped, "keyword", "left").select(
        "keyword", F.coalesce(F.transform("_l", lambda s: s["related"]), F.array().cast("array<string>")).alias("_e"))
    return out.select("keyword", F.array_distinct(F.concat(F.array("keyword"),
                                                           F.array_remove("_e", F.col("keyword")))).alias("expanded"))


def cooccurrence_thesaurus(texts: DataFrame, text_col: str = "text", window: int = 5) -> DataFrame:
    """(term, related, weight): number of texts in which the two words occur within
    ``window`` words of each other.  Pairs per text grow with words x window, not with
    words squared, so long documents stay cheap."""
    words = texts.select(F.filter(F.split(T.strip(text_col), T.WS_RUN), lambda t: t != "").alias("_w"))
    n = F.size("_w")

    def at(i, d):
        return F.when(i + d < n, F.array(F.struct(F.element_at("_w", i + 1).alias("term"),
                                                  F.element_at("_w", i + d + 1).alias("related")),
                                         F.struct(F.element_at("_w", i + d + 1).alias("term"),
                                                  F.element_at("_w", i + 1).alias("related"))))

    near = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))),
                                 lambda i: F.flatten(F.filter(F.transform(F.sequence(F.lit(1), F.lit(window)),
                                                                          lambda d: at(i, d)),
                                                              lambda x: x.isNotNull()))))
    pairs = words.where(n > 1).select(F.explode(F.array_distinct(near)).alias("p")).select("p.term", "p.related")
    return (pairs.where(F.col("term") != F.col("related"))
            .groupBy("term", "related").agg(F.count(F.lit(1)).alias("weight")))


def parse_scores(response: Column, n) -> Column:
    """L2 response contract: first line, full-width commas as commas, numeric tokens
    only, padded with the default score and cut to ``n`` (a Column or int)."""
    n = F.lit(n) if isinstance(n, int) else n
    line = F.regexp_replace(F.coalesce(_first_line(response), F.lit("")), "，", ",")
    vals = F.filter(F.transform(F.split(line, ","), lambda t: T.strip(t).try_cast("double")),
                    lambda x: x.isNotNull())
    pad = F.array_repeat(F.lit(V.RERANK_DEFAULT_SCORE), n)
    return F.slice(F.concat(vals, pad), 1, n)


def lexical_responder(items: list[dict], query: str) -> str | None:
    """The default model stand-in: for each item, ten times the share of the query's words
    found in its title and tags, as one line; an empty query gets no answer."""
    words = query.lower().split()
    if not words:
        return None
    return ", ".join(str(10.0 * sum(w in x["text"] for w in words) / len(words)) for x in items)


def rerank(results: DataFrame, fact: DataFrame, queries: DataFrame, responder=lexical_responder,
           batch: int = V.RERANK_BATCH) -> DataFrame:
    """L2: (query_id, rank, posting_id, score) with the results of each query sorted stably
    by score.

    ``responder(items, query)`` answers for one batch of consecutive results, each with
    its lower-cased title and first five tags; an answer that fails (an exception) or is
    missing scores the whole batch 5.0, too few scores are padded with it.  A query's
    batches are scored in parallel, wherever Spark places them."""
    first = F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, 5)
    text = F.lower(F.concat_ws(" ", F.coalesce("announcement_name", F.lit("")), F.array_join(first, " ")))
    items = (results.join(fact.select("posting_id", text.alias("text")), "posting_id")
             .withColumn("batch_no", F.floor((F.col("rank") - 1) / batch)))
    batches = (items.groupBy("query_id", "batch_no")
               .agg(F.sort_array(F.collect_list(F.struct("rank", "posting_id", "text"))).alias("items"))
               .join(queries.select("query_id", F.coalesce("keyword", F.lit("")).alias("query")), "query_id"))

    def answer(frames):
        for df in frames:
            out = []
            for items, query in zip(df["items"], df["query"], strict=True):
                try:
                    out.append(responder(list(items), query))
                except Exception:  # noqa: BLE001 - the contract: a failed call scores 5.0
                    out.append(None)
            yield df.assign(response=out)

    scored = batches.mapInPandas(answer, "query_id bigint, batch_no bigint, items array<struct<rank:int,posting_id:bigint,text:string>>, "
                                         "query string, response string")
    each = (scored.select("query_id", F.posexplode(F.arrays_zip("items", parse_scores(F.col("response"), F.size("items")).alias("s"))).alias("p", "x"))
            .select("query_id", F.col("x.items.rank").alias("rank"), F.col("x.items.posting_id").alias("posting_id"), F.col("x.s").alias("score")))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("rank").asc())
    return each.withColumn("rank", F.row_number().over(w)).select("query_id", "rank", "posting_id", "score")


def rerank_batches(results: DataFrame, batch: int = V.RERANK_BATCH, key: str = "query_id") -> DataFrame:
    """L2 batching: consecutive groups of ``batch`` results per key, in rank order, as
    (key, batch_no, items) — the unit a model call scores."""
    b = results.withColumn("batch_no", F.floor((F.col("rank") - 1) / batch))
    return b.groupBy(key, "batch_no").agg(
        F.sort_array(F.collect_list(F.struct("rank", "posting_id"))).alias("items"))


def parse_tags(response: Column) -> Column:
    """L3 response contract: first line, comma split, strip, 1..20 characters and at
    most one space; nothing usable -> NULL (the call failed)."""
    items = F.filter(F.transform(F.split(_first_line(response), ","), lambda t: T.strip(t)),
                     lambda t: (F.length(t) >= 1) & (F.length(t) <= V.MODEL_TOKEN_MAX_LEN)
                     & (F.length(t) - F.length(F.regexp_replace(t, " ", "")) <= 1))
    return F.when(F.size(items) > 0, items)


def tag_enrich(fact: DataFrame, responses: DataFrame) -> DataFrame:
    """L3: per posting with a response: the tags to add (not already present,
    deduplicated) and the outcome tagged / skipped / failed."""
    r = responses.select("posting_id", parse_tags(F.col("response")).alias("_t"))
    j = fact.select("posting_id", "tags").join(r, "posting_id")
    new = F.array_except(F.array_distinct("_t"), F.coalesce("tags", F.array().cast("array<string>")))
    return j.select("posting_id", F.when(F.col("_t").isNull(), F.array().cast("array<string>")).otherwise(new)
                    .alias("added"),
                    F.when(F.col("_t").isNull(), F.lit("failed"))
                    .when(F.size(new) > 0, F.lit("tagged")).otherwise(F.lit("skipped")).alias("outcome"))


def tag_backlog(fact: DataFrame, as_of: str, created_on: str | None = None, limit: int | None = None,
                batch: int = V.TAG_BATCH) -> DataFrame:
    """L4: postings to tag — created on a day, else valid ones — by id (the first
    ``limit`` if one is given), in batches of ``batch``, numbered by distributed ids."""
    if created_on:
        f = fact.where(F.to_date("created_at") == F.lit(created_on).cast("date"))
    else:
        f = fact.where(F.col("deadline") >= F.lit(as_of).cast("date"))
    top = f.select("posting_id")
    if limit is not None:
        top = top.orderBy("posting_id").limit(limit)
    return sequential_ids(top, ["posting_id"], id_col="n").select("posting_id", F.floor((F.col("n") - 1) / batch).alias("batch_no"))


def judge_score(response: Column) -> Column:
    """The first character in 0..3 anywhere in the stripped response, else 0."""
    d = F.regexp_extract(F.coalesce(T.strip(response), F.lit("")), "[0-3]", 0)
    return F.when(d == "", F.lit(0)).otherwise(d.cast("int"))


def judge_incremental(pairs: DataFrame, cache: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """Only (query, doc) pairs missing from the cache are judged; returns the
    unseen pairs, scored when ``responses(query_id, doc_id, response)`` is given."""
    unseen = pairs.select("query_id", "doc_id").distinct().join(cache.select("query_id", "doc_id"),
                                                               ["query_id", "doc_id"], "left_anti")
    if responses is None:
        return unseen
    return unseen.join(responses, ["query_id", "doc_id"], "left").select(
        "query_id", "doc_id", judge_score(F.col("response")).alias("rel"))
