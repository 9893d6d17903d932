"""Star-schema maintenance: dedup, dimensions, bridge, expiry, backfill, tag merge.

S5-S7, S10-S12.  Every operator is DataFrame -> DataFrame; writing is the caller's
choice (``plans.warehouse``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V
from .keys import sequential_ids

BROADCAST_IDS = 500_000   # posting ids of a broadcast
FACT_KEY = ["company_name", "announcement_name", "deadline"]
FACT_COLUMNS = [
    "posting_id", "company_name", "announcement_name", "experience", "education", "form",
    "region_name", "subregion_name", "annual_salary", "deadline", "link", "created_at",
    "batch_date", "tags",
]


def first_wins_dedup(rows: DataFrame, existing: DataFrame | None = None,
                     order_cols=("batch_date", "posting_id")) -> DataFrame:
    """One row per natural key, the earliest arrival wins; keys already stored lose.

    A NULL in the key never conflicts (UNIQUE semantics), so such rows all survive.
    Implemented as an aggregation, not a window: map-side partial aggregation
    collapses a hot key before the shuffle, so a key holding a third of the rows
    never lands in one task.
    """
    cols = [c for c in FACT_COLUMNS if c in rows.columns]
    guard = F.when(F.col("announcement_name").isNull(), F.col("posting_id")).alias("_null_guard")
    order = F.struct(*[F.col(c) for c in order_cols])
    winners = (rows.groupBy(*FACT_KEY, guard)
               .agg(F.min_by(F.struct(*[F.col(c) for c in cols]), order).alias("_w"))
               .select("_w.*"))
    if existing is not None:
        winners = winners.join(existing.select(*FACT_KEY), FACT_KEY, "left_anti")
    return winners


def dim_upsert(names: DataFrame, existing: DataFrame | None = None,
               name_col: str = "name", id_col: str = "id") -> DataFrame:
    """Insert-if-absent; new names get keys after the current maximum, in name order.

    Returns the whole dimension (existing rows unchanged plus the new ones).
    """
    new = names.select(F.col(name_col).alias("name")).where(F.col("name").isNotNull()).distinct()
    if existing is None:
        return sequential_ids(new, ["name"], id_col=id_col).select(id_col, "name")
    old = existing.select(id_col, "name")
    new = new.join(old.select("name"), "name", "left_anti")
    # one scalar (the current maximum key) comes back to the driver
    top = old.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
    keyed = sequential_ids(new, ["name"], id_col=id_col, start=top)
    return old.unionByName(keyed.select(id_col, "name"))


def posting_tags(fact: DataFrame) -> DataFrame:
    """Bridge (posting_id, tag) with set semantics."""
    return (fact.select("posting_id", F.explode("tags").alias("tag"))
            .dropDuplicates(["posting_id", "tag"]))


def employment_types(spark) -> DataFrame:
    """S8 seed: the fixed 10-row code table."""
    return spark.createDataFrame(V.EMPLOYMENT_TYPES, "id bigint, name string")


def expire_postings(fact: DataFrame, as_of: str, children: list[DataFrame] | None = None):
    """Keep postings with deadline >= as_of; children keep rows of kept postings."""
    kept = fact.where(F.col("deadline") >= F.lit(as_of).cast("date"))
    if not children:
        return kept
    return kept, [_of_kept(c, kept.select("posting_id")) for c in children]


def _of_kept(child: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``child`` whose posting is among ``ids``.  A child may hold a posting in many
    rows: its distinct ids meet the kept ones, and if they are few (by count) its rows stay
    where they are.  Of a log stored as bits, its board's ids meet them, and only what is kept
    becomes rows."""
    from ..session import materialize
    from .board import Lists, made_of
    if isinstance(made_of(child), Lists):
        return made_of(child).only(ids).pairs()
    held = materialize(child.select("posting_id").distinct().join(ids, "posting_id", "left_semi"), "kept")
    few = held.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return child.join(F.broadcast(held) if few else ids, "posting_id", "left_semi")


def region_backfill(fact: DataFrame, raw: DataFrame, regions: DataFrame,
                    order_cols=("batch_date", "posting_id")) -> DataFrame:
    """Refill region/subregion from re-read raw rows.

    Raw rows whose region does not parse, or names a region missing from the
    ``regions`` dimension, are dropped first; then the *last* remaining row per
    (company, title, deadline) wins.  A posting is updated when its region is NULL or
    its subregion differs NULL-safely.  Company and title are stripped and
    comma-stripped on the raw side only, as in the re-read job.  Rows whose deadline
    names no real date are dropped (the re-read job would abort on them).
    """
    r = raw.select(
        T.sanitize("company").alias("company_name"),
        T.sanitize("title").alias("announcement_name"),
        T.parse_deadline("deadline_raw", F.col("batch_date")).getField("deadline").alias("deadline"),
        T.parse_region("location_raw").alias("_reg"),
        F.struct(*[F.col(c) for c in order_cols]).alias("_ord"),
    ).where(F.col("deadline").isNotNull() & F.col("_reg").isNotNull())
    r = r.join(regions.select(F.col("name").alias("_rname")),
               F.col("_reg.region") == F.col("_rname"), "left_semi")
    last = (r.groupBy(*FACT_KEY)
            .agg(F.max_by("_reg", "_ord").alias("_reg"))
            .select(*FACT_KEY, F.col("_reg.region").alias("new_region"),
                    F.col("_reg.subregion").alias("new_subregion")))
    j = fact.join(last, FACT_KEY, "left")
    change = (F.col("new_region").isNotNull()
              & (F.col("region_name").isNull() | ~F.col("subregion_name").eqNullSafe(F.col("new_subregion"))))
    return j.select(
        *[c for c in fact.columns if c not in ("region_name", "subregion_name")],
        F.when(change, F.col("new_region")).otherwise(F.col("region_name")).alias("region_name"),
        F.when(change, F.col("new_subregion")).otherwise(F.col("subregion_name")).alias("subregion_name"),
        change.alias("updated"),
    )


def fill_rate(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), F.count(col).alias("filled"),
                  F.round(F.count(col) / F.count(F.lit(1)) * 100, 1).alias("fill_pct"))


def tag_merge(bridge: DataFrame, synonyms: DataFrame) -> DataFrame:
    """S12 on the bridge: old tag names become their canonical name, pairs deduped.

    ``synonyms`` is (old, new); it is a fixed vocabulary table, so it is broadcast.
    """
    m = F.broadcast(synonyms.select(F.col("old").alias("tag"), F.col("new")))
    return (bridge.join(m, "tag", "left")
            .select("posting_id", F.coalesce("new", "tag").alias("tag"))
            .dropDuplicates(["posting_id", "tag"]))


def tag_merge_report(tags: DataFrame, synonyms: DataFrame) -> DataFrame:
    """S12 report: per synonym entry, renamed / merged / skipped, in dictionary order.

    Entries are applied in order: an old name that is absent is skipped; if its target
    exists (before, or created by an earlier rename in this run) it is merged,
    otherwise it is renamed (and the target then exists for later entries).
    """
    s = synonyms.select("ord", "old", "new")
    names = tags.select(F.col("name")).distinct()
    present_old = s.join(names.withColumnRenamed("name", "old"), "old", "left_semi").select("ord").withColumn("old_present", F.lit(True))
    present_new = s.join(names.withColumnRenamed("name", "new"), "new", "left_semi").select("ord").withColumn("new_present", F.lit(True))
    x = (s.join(present_old, "ord", "left").join(present_new, "ord", "left")
         .fillna(False, ["old_present", "new_present"]))
    # the first present source of a target that was absent renames; the rest merge
    w = Window.partitionBy("new").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("earlier_present", F.coalesce(F.max(F.col("old_present").cast("int")).over(w), F.lit(0)) == 1)
    action = (F.when(~F.col("old_present"), F.lit("skipped"))
              .when(F.col("new_present") | F.col("earlier_present"), F.lit("merged"))
              .otherwise(F.lit("renamed")))
    return x.select("ord", "old", "new", action.alias("action"))


def synonym_table(spark) -> DataFrame:
    return spark.createDataFrame([(i + 1, o, n) for i, (o, n) in enumerate(V.TAG_SYNONYMS)],
                                 "ord int, old string, new string")
