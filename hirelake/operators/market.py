"""Labour-market analytics (M1-M8).

The fact table carries its tags as an array and its region name, so tag and region
aggregates need no join: an ``explode`` + partial aggregation per tag.  Top-N lists
are ``orderBy(...).limit(n)`` -> ``TakeOrderedAndProject`` (per-partition top-N,
then a merge of N rows per partition).  Ties are broken by name ascending.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab as V
from . import ngram


def _valid(fact: DataFrame, as_of: str) -> DataFrame:
    return fact.where(F.col("deadline") >= F.lit(as_of).cast("date"))


def top_tags(fact: DataFrame, as_of: str | None, limit: int = 10) -> DataFrame:
    """M1: tag, count of postings carrying it; valid postings only unless as_of is None."""
    f = _valid(fact, as_of) if as_of else fact
    return (f.select(F.explode(F.array_distinct("tags")).alias("name"))
            .groupBy("name").agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col("name").asc())
            .limit(limit))


def posting_texts(fact: DataFrame) -> DataFrame:
    """(tid, text) rows that a keyword may hit: the title, and every tag name."""
    titles = fact.select(F.col("posting_id").alias("tid"), F.col("announcement_name").alias("text"))
    tags = fact.select(F.col("posting_id").alias("tid"), F.explode(F.array_distinct("tags")).alias("text"))
    return titles.unionByName(tags)


def keyword_hits(fact: DataFrame, keywords: DataFrame, method: str = "ngram",
                 kid: str = "kid", keyword: str = "keyword", index: DataFrame | None = None) -> DataFrame:
    """(kid, posting_id): title ILIKE %kw% OR some tag ILIKE %kw%.

    ``index`` is a stored gram index over ``posting_texts`` (n-gram method).  The scan reads a
    posting's texts as one array, so a pair comes once for it, not once for each text."""
    texts = posting_texts(fact)
    if method == "scan":
        texts = fact.select(F.col("posting_id").alias("tid"), F.concat(F.array("announcement_name"), F.coalesce("tags", F.array().cast("array<string>"))).alias("text"))
    pairs = ngram.substring_pairs(keywords.select(F.col(kid).alias("pid"), F.col(keyword).alias("pattern")),
                                  texts, method=method, index=index)
    return pairs.select(F.col("pid").alias(kid), F.col("tid").alias("posting_id")).distinct()


def salary_by_keyword(fact: DataFrame, keywords: DataFrame, as_of: str, method: str = "ngram",
                      index: DataFrame | None = None) -> DataFrame:
    """M2: per keyword, int-truncated mean and count of valid postings with a salary.

    ``keywords`` is (keyword); keywords with no posting are absent.
    """
    f = _valid(fact, as_of).where(F.col("annual_salary").isNotNull())
    kw = keywords.select("keyword").distinct().withColumn("kid", F.col("keyword"))
    hits = keyword_hits(f, kw, method, index=index)
    return (hits.join(f.select("posting_id", "annual_salary"), "posting_id")
            .groupBy(F.col("kid").alias("keyword"))
            .agg(F.avg("annual_salary").cast("bigint").alias("avg_salary"),
                 F.count(F.lit(1)).alias("count")))


def regional_dist(fact: DataFrame, as_of: str, top_n: int = 8) -> DataFrame:
    """M3."""
    return (_valid(fact, as_of).where(F.col("region_name").isNotNull())
            .groupBy(F.col("region_name").alias("region"))
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col("region").asc())
            .limit(top_n))


def experience_label(c) -> F.Column:
    L = V.MARKET_EXPERIENCE_LABELS
    e = F.col(c) if isinstance(c, str) else c
    return (F.when(e.isNull(), F.lit(L[0])).when(e == 0, F.lit(L[1]))
            .when(e <= 3, F.lit(L[2])).when(e <= 7, F.lit(L[3])).otherwise(F.lit(L[4])))


def experience_dist(fact: DataFrame, as_of: str) -> DataFrame:
    """M4: labels over valid postings; negatives fall in the 1~3 label."""
    return (_valid(fact, as_of).groupBy(experience_label("experience").alias("label"))
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.col("count").desc(), F.col("label").asc()))


def daily_new(fact: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """M5: postings per creation day from as_of-(days-1) on; empty days absent."""
    d = F.to_date("created_at")
    since = F.date_sub(F.lit(as_of).cast("date"), days - 1)
    return (fact.where(d >= since).groupBy(d.alias("day"))
            .agg(F.count(F.lit(1)).alias("count")).orderBy("day"))


def _packed(section: str) -> F.Column:
    """Array of (name, count) of one section, in list order (count desc, name asc)."""
    item = F.when(F.col("section") == section,
                  F.struct((-F.col("count")).alias("k"), F.col("name"), F.col("count")))
    return F.transform(F.sort_array(F.collect_list(item)),
                       lambda s: F.struct(s["name"].alias("name"), s["count"].alias("count")))


def market_snapshot(fact: DataFrame, as_of: str) -> DataFrame:
    """M6: one row per as_of; list columns are arrays of (name, count).

    Head counts and the three bounded lists (top 10 tags, top 6 regions, 5 labels)
    are unioned in long form and folded by one global aggregate, so the row is built
    without joins and the collected arrays are bounded by construction.
    """
    d = F.lit(as_of).cast("date")
    head = fact.agg(
        F.count(F.when(F.col("deadline") >= d, 1)).alias("total_valid_jobs"),
        F.count(F.when(F.to_date("created_at") == d, 1)).alias("new_jobs"),
        F.avg(F.when((F.col("deadline") >= d), F.col("annual_salary"))).cast("bigint").alias("avg_salary"),
    )
    heads = head.select(F.lit("head").alias("section"), F.lit(None).cast("string").alias("name"),
                        F.lit(None).cast("bigint").alias("count"), "total_valid_jobs", "new_jobs", "avg_salary")
    pad = [F.lit(None).cast("bigint").alias(c) for c in ("total_valid_jobs", "new_jobs", "avg_salary")]
    lists = (top_tags(fact, as_of, 10).select(F.lit("tag").alias("section"), "name", "count", *pad)
             .unionByName(regional_dist(fact, as_of, 6)
                          .select(F.lit("region").alias("section"), F.col("region").alias("name"), "count", *pad))
             .unionByName(experience_dist(fact, as_of)
                          .select(F.lit("exp").alias("section"), F.col("label").alias("name"), "count", *pad)))
    return heads.unionByName(lists).agg(
        d.alias("date"),
        F.max("total_valid_jobs").alias("total_valid_jobs"),
        F.max("new_jobs").alias("new_jobs"),
        F.max("avg_salary").alias("avg_salary"),
        _packed("tag").alias("top_tags"),
        _packed("region").alias("region_dist"),
        _packed("exp").alias("experience_dist"),
    )


def market_snapshots(fact: DataFrame, start: str, end: str, from_creation: bool = True) -> DataFrame:
    """M6 for every day from ``start`` to ``end`` in one pass over the postings: the rows
    that ``market_snapshot`` gives for each day, of the postings created up to that day
    (``from_creation``) or of the whole table as it is.

    A sweep over the intervals from creation to deadline: a posting adds 1 to its tags,
    region, label and the total on the first day of the range that it is valid on, and
    takes it away on the day after its deadline.  These events are pre-aggregated by name
    and day, so at most one row for each name and day is shuffled, a running sum over a
    name's days gives its counts, and each holds until the name's next event.
    """
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    first = F.greatest(F.to_date("created_at"), lo) if from_creation else lo
    if from_creation:
        fact = fact.where(F.col("created_at").isNotNull())
    live = fact.withColumn("_from", first).where((F.col("deadline") >= F.col("_from")) & (F.col("_from") <= hi))
    none = F.lit(None).cast("string")
    item = lambda section, name: F.struct(F.lit(section).alias("section"), name.alias("name"))
    items = F.concat(F.array(item("head", none), item("exp", experience_label("experience"))),
                     F.when(F.col("region_name").isNotNull(), F.array(item("region", F.col("region_name")))).otherwise(F.array().cast("array<struct<section:string,name:string>>")),
                     F.transform(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>"))), lambda t: item("tag", t)))
    event = lambda day, sign: F.struct(day.alias("day"), F.lit(sign).alias("sign"))
    events = F.array(event(F.col("_from"), 1), event(F.date_add("deadline", 1), -1))
    moves = (live.select(F.explode(items).alias("i"), events.alias("events"), "annual_salary")
             .select("i.*", F.explode("events").alias("e"), "annual_salary").where(F.col("e.day") <= hi)
             .groupBy("section", "name", F.col("e.day").alias("day"))
             .agg(F.sum("e.sign").alias("n"),
                  F.sum(F.col("e.sign") * F.col("annual_salary").isNotNull().cast("int")).alias("paid"),
                  F.sum(F.col("e.sign") * F.coalesce(F.col("annual_salary"), F.lit(0)).cast("bigint")).alias("salary")))
    by_name = Window.partitionBy("section", "name").orderBy("day")
    until = by_name.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = moves.select("section", "name", "day", *[F.sum(c).over(until).alias(c) for c in ("n", "paid", "salary")],
                        F.coalesce(F.date_sub(F.lead("day").over(by_name), 1), hi).alias("last"))
    daily = (sums.where("n > 0").withColumn("date", F.explode(F.sequence("day", "last", F.expr("interval 1 day"))))
             .select("date", "section", "name", F.col("n").alias("count"), "paid", "salary"))
    rank = Window.partitionBy("date", "section").orderBy(F.col("count").desc(), F.col("name").asc())
    top = daily.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= 10)
    top = top.where((F.col("section") != "region") | (F.col("_r") <= 6)).drop("_r")
    created = F.to_date("created_at")
    new = (fact.where(created.between(lo, hi)).groupBy(created.alias("date")).agg(F.count(F.lit(1)).alias("count"))
           .select("date", F.lit("new").alias("section"), none.alias("name"), "count", F.lit(0).alias("paid"), F.lit(0).alias("salary")))
    days = fact.sparkSession.range(1).select(F.explode(F.sequence(lo, hi, F.expr("interval 1 day"))).alias("date"))
    every = days.select("date", F.lit("day").alias("section"), none.alias("name"), F.lit(0).alias("count"), F.lit(0).alias("paid"), F.lit(0).alias("salary"))
    only = lambda section, c: F.coalesce(F.max(F.when(F.col("section") == section, F.col(c))), F.lit(0)).cast("bigint")
    head = F.max(F.when((F.col("section") == "head") & (F.col("paid") > 0), F.col("salary") / F.col("paid")))
    return top.unionByName(new).unionByName(every).groupBy("date").agg(
        only("head", "count").alias("total_valid_jobs"), only("new", "count").alias("new_jobs"), head.cast("bigint").alias("avg_salary"),
        _packed("tag").alias("top_tags"), _packed("region").alias("region_dist"), _packed("exp").alias("experience_dist"))


def snapshot_upsert(snapshots: DataFrame | None, new: DataFrame) -> DataFrame:
    """M7: key = date; a new row replaces the stored one."""
    if snapshots is None:
        return new
    return snapshots.join(new.select("date"), "date", "left_anti").unionByName(new)


def insight_report(fact: DataFrame, as_of: str, method: str = "ngram", index: DataFrame | None = None) -> DataFrame:
    """M8: top-10 tags with the mean salary of the first five (as keywords)."""
    tt = top_tags(fact, as_of, 10)
    ranked = tt.select("name", "count").withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("count").desc(), F.col("name").asc())))
    top5 = ranked.where(F.col("rank") <= 5).select(F.col("name").alias("keyword"))
    sal = salary_by_keyword(fact, top5, as_of, method, index)
    return (ranked.join(sal.select(F.col("keyword").alias("name"), "avg_salary"), "name", "left")
            .select("rank", "name", "count", "avg_salary"))
