"""Data quality (Q2-Q9): retroactive cleaning, completeness, distributions, report.

All aggregates are single-pass global or low-cardinality group aggregates (partial
aggregation on the map side, one small final stage).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V

PERCENTILES = [0.25, 0.5, 0.75, 0.95]
SAMPLES = 5            # newest events in the report
SKETCH_K, MERGED_K = 800, 800  # sizes of a day's sketch and of a merged one (rank error about 0.35 %)


def quality_clean(fact: DataFrame) -> DataFrame:
    """Q2: out-of-range salary / experience become NULL (rows unchanged otherwise)."""
    sal = T.validate_salary("annual_salary")
    exp = T.validate_experience("experience")
    return fact.withColumn("annual_salary", sal["value"]).withColumn("experience", exp["value"])


def quality_clean_log(fact: DataFrame, batch_id: str = "backfill") -> DataFrame:
    """Q2 log: one event per cleaned value, with the true old value and rule."""
    ev = F.array(
        F.struct(F.lit("annual_salary").alias("field"), T.validate_salary("annual_salary")["rule"].alias("rule"),
                 F.col("annual_salary").cast("string").alias("parsed_value")),
        F.struct(F.lit("experience").alias("field"), T.validate_experience("experience")["rule"].alias("rule"),
                 F.col("experience").cast("string").alias("parsed_value")),
    )
    return (fact.select(F.lit(batch_id).alias("batch_id"), "posting_id", "announcement_name",
                        F.explode(ev).alias("e"))
            .where(F.col("e.rule").isNotNull())
            .select("batch_id", "posting_id", "announcement_name", "e.field", "e.rule", "e.parsed_value"))


COMPLETENESS_FIELDS = [
    ("annual_salary", "연봉"), ("experience", "경력"), ("region_name", "지역"),
    ("form", "고용형태"), ("education", "학력"),
]


def completeness(fact: DataFrame) -> DataFrame:
    """Q3: per field, filled count and percentage (one pass, then stacked)."""
    agg = fact.agg(F.count(F.lit(1)).alias("total"),
                   *[F.count(c).alias(c) for c, _ in COMPLETENESS_FIELDS])
    stack = ", ".join(f"'{c}', '{label}', {i}, {c}" for i, (c, label) in enumerate(COMPLETENESS_FIELDS))
    return agg.selectExpr("total", f"stack({len(COMPLETENESS_FIELDS)}, {stack}) AS (field, label, ord, filled)") \
        .select("ord", "field", "label", "total", "filled",
                F.when(F.col("total") > 0, F.round(F.col("filled") / F.col("total") * 100, 1)).alias("pct"))


def salary_dist(fact: DataFrame) -> DataFrame:
    """Q4: count, min, max, rounded mean and continuous percentiles, NULL excluded.

    ``percentile`` is exact; its buffer holds one counter per distinct value, and
    valid salaries live in a bounded range, so the buffer is bounded too.
    """
    s = F.col("annual_salary")
    p = F.percentile(s, F.array(*[F.lit(x) for x in PERCENTILES]))
    return (fact.where(s.isNotNull())
            .agg(F.count(F.lit(1)).alias("cnt"), F.min(s).alias("min"), F.max(s).alias("max"),
                 F.round(F.avg(s)).cast("bigint").alias("avg"), p.alias("_p"))
            .select("cnt", "min", "max", "avg",
                    *[F.col("_p")[i].alias(f"p{int(x * 100)}") for i, x in enumerate(PERCENTILES)]))


def salary_sketches(fact: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """Q4, opt-in approximate form, to be stored: one mergeable quantile sketch of the
    salaries of each creation day (``day``, ``cnt``, ``sketch``), NULL excluded.

    A sketch keeps a few thousand values however many postings a day has, partial
    sketches are built before the shuffle, and a new day's rows are appended."""
    paid = fact.where(F.col("annual_salary").isNotNull())
    return (paid.groupBy(F.to_date("created_at").alias("day"))
            .agg(F.count(F.lit(1)).alias("cnt"), F.kll_sketch_agg_bigint(F.col("annual_salary").cast("bigint"), F.lit(k)).alias("sketch")))


def sketched_salary_dist(sketches: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Count and percentiles of the days from ``start`` to ``end`` (all, if not given), by
    merging stored sketches: no posting is read.  A percentile is a salary that occurs,
    its rank off by less than 1 % at the default size of a sketch; no days give no
    percentiles."""
    days = sketches
    for limit, op in ((start, F.Column.__ge__), (end, F.Column.__le__)):
        if limit is not None:
            days = days.where(op(F.col("day"), F.lit(limit).cast("date")))
    merged = days.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("cnt"), F.kll_merge_agg_bigint("sketch", F.lit(MERGED_K)).alias("_s"))
    return merged.select("cnt", *[F.when(F.col("cnt") > 0, F.kll_sketch_get_quantile_bigint("_s", F.lit(x))).alias(f"p{int(x * 100)}") for x in PERCENTILES])


def experience_bands(fact: DataFrame) -> DataFrame:
    """Q5: 0 / 1-3 / 4-7 / >=8 over non-null experience; negatives form a NULL band."""
    e = F.col("experience")
    B = V.QUALITY_EXPERIENCE_BANDS
    band = (F.when(e == 0, F.lit(B[0])).when(e.between(1, 3), F.lit(B[1]))
            .when(e.between(4, 7), F.lit(B[2])).when(e >= 8, F.lit(B[3])))
    return (fact.where(e.isNotNull()).groupBy(band.alias("band"))
            .agg(F.count(F.lit(1)).alias("cnt"), F.min(e).alias("ord"))
            .orderBy("ord"))


def form_dist(fact: DataFrame, employment_types: DataFrame) -> DataFrame:
    """Q6: postings per employment type (inner join with the fixed 10-row table)."""
    et = F.broadcast(employment_types.select(F.col("id").alias("form"), F.col("name")))
    return (fact.groupBy("form").agg(F.count(F.lit(1)).alias("cnt"))
            .join(et, "form").select("form", "name", "cnt")
            .orderBy(F.col("cnt").desc(), F.col("form")))


def quality_event_summary(events: DataFrame) -> DataFrame:
    """Q7: events by (field, rule), with the grand total on every row."""
    by = events.groupBy("field", "rule").agg(F.count(F.lit(1)).alias("cnt"))
    total = events.agg(F.count(F.lit(1)).alias("total"))
    return (by.unionByName(total.select(F.lit(None).cast("string").alias("field"),
                                        F.lit(None).cast("string").alias("rule"),
                                        F.col("total").alias("cnt")))
            .orderBy(F.col("cnt").desc()))


def quality_recent(events: DataFrame, n: int = 5) -> DataFrame:
    """Q8: the n newest events (ties: later posting first, then field)."""
    return (events.orderBy(F.col("created_at").desc(), F.col("posting_id").desc(), F.col("field"))
            .limit(n)
            .select("company_name", "announcement_name", "field", "rule", "original_value", "parsed_value"))


def quality_report(fact: DataFrame, events: DataFrame, employment_types: DataFrame) -> DataFrame:
    """Q9: sections 1-6 as ordered (section, ord, label, value) rows; section 6 lists the
    newest events (ties as in ``quality_recent``), their text in the label."""
    s1 = completeness(fact).select(F.lit(1).alias("section"), F.col("ord").cast("int").alias("ord"),
                                   F.col("label"), F.col("pct").cast("double").alias("value"))
    s1t = fact.agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit(1).alias("section"), F.lit(-1).alias("ord"), F.lit("total").alias("label"), "value")
    sd = salary_dist(fact)
    stats = ["cnt", "min", "p25", "p50", "p75", "p95", "max", "avg"]
    stack = ", ".join(f"{i}, '{c}', CAST({c} AS DOUBLE)" for i, c in enumerate(stats))
    s2 = sd.selectExpr(f"stack({len(stats)}, {stack}) AS (ord, label, value)").select(
        F.lit(2).alias("section"), F.col("ord").cast("int"), "label",
        F.floor("value").cast("double").alias("value"))
    s3 = experience_bands(fact).select(F.lit(3).alias("section"), F.col("ord").cast("int"),
                                       F.coalesce("band", F.lit("NULL")).alias("label"),
                                       F.col("cnt").cast("double").alias("value"))
    s4 = form_dist(fact, employment_types).select(F.lit(4).alias("section"), F.col("form").cast("int").alias("ord"),
                                                 F.col("name").alias("label"), F.col("cnt").cast("double").alias("value"))
    s5 = quality_event_summary(events).select(
        F.lit(5).alias("section"), F.lit(0).alias("ord"),
        F.coalesce(F.concat_ws(" / ", "field", "rule"), F.lit("total")).alias("label"),
        F.col("cnt").cast("double").alias("value"))
    s5 = s5.withColumn("label", F.when(F.col("label") == "", F.lit("total")).otherwise(F.col("label")))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    newest = Window.orderBy(F.col("created_at").desc(), F.col("posting_id").desc(), F.col("field"))
    sample = events.orderBy(F.col("created_at").desc(), F.col("posting_id").desc(), F.col("field")).limit(SAMPLES)
    s6 = sample.select(F.lit(6).alias("section"), (F.row_number().over(newest) - 1).alias("ord"),
                       F.concat(F.lit("["), "field", F.lit("/"), "rule", F.lit("] "), text("company_name"), F.lit(" | "), text("announcement_name"),
                                F.lit(": "), text("original_value"), F.lit(" -> "), text("parsed_value")).alias("label"),
                       F.lit(None).cast("double").alias("value"))
    return s1t.unionByName(s1).unionByName(s2).unionByName(s3).unionByName(s4).unionByName(s5).unionByName(s6)
