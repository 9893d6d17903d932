"""Posting normalisation job (raw strings -> typed rows), P1-P12 + quality events.

One projection of native column expressions; Catalyst fuses it into a single
whole-stage-codegen stage with the scan, so normalisation costs no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

RAW_COLUMNS = [
    "company", "title", "career_raw", "education_raw", "form_raw", "location_raw",
    "salary_raw", "deadline_raw", "description_raw", "position_raw", "link",
]


def normalize_postings(raw: DataFrame, today: str | None = None, synonyms=None) -> DataFrame:
    """Parse every raw posting row.

    ``raw`` needs the eleven text columns plus ``posting_id`` (the arrival ordinal),
    ``batch_date`` and ``created_at``.  ``today`` (ISO date) overrides the per-row
    ``batch_date`` as the reference date of relative deadlines.

    Output keeps one row per input row; ``rejected`` marks rows the reference would
    refuse to store (impossible deadline, missing company name).
    """
    ref = F.lit(today).cast("date") if today else F.col("batch_date")
    desc = T.parse_description_tags("description_raw", synonyms)
    pos = T.parse_position_tags("position_raw")
    # stage 1: every parse runs once per row; validation reads the parsed columns in
    # stage 2 (each validator references its value several times inside CASE branches)
    parsed = raw.select(
        "posting_id", "batch_date", "created_at",
        F.col("company").alias("company_name"),
        F.col("title").alias("announcement_name"),
        T.parse_experience("career_raw").alias("experience_parsed"),
        T.parse_education("education_raw").alias("education"),
        T.parse_form("form_raw").alias("form"),
        T.parse_region("location_raw").alias("_region"),
        T.parse_salary("salary_raw").alias("salary_parsed"),
        T.parse_deadline("deadline_raw", ref)["deadline"].alias("deadline"),
        T.merge_tags(desc, pos).alias("tags"),
        "link", "career_raw", "salary_raw",
    )
    sal = T.validate_salary("salary_parsed")
    exp = T.validate_experience("experience_parsed")
    return parsed.select(
        "posting_id", "batch_date", "created_at", "company_name", "announcement_name",
        "experience_parsed",
        exp["value"].alias("experience"),
        exp["rule"].alias("experience_rule"),
        "education", "form",
        F.col("_region.region").alias("region_name"),
        F.col("_region.subregion").alias("subregion_name"),
        "salary_parsed",
        sal["value"].alias("annual_salary"),
        sal["rule"].alias("salary_rule"),
        "deadline",
        (F.col("deadline").isNull() | F.col("company_name").isNull()).alias("rejected"),
        "tags", "link", "career_raw", "salary_raw",
    )


def accepted(norm: DataFrame) -> DataFrame:
    return norm.where(~F.col("rejected"))


def rejected(norm: DataFrame) -> DataFrame:
    """Reject table: rows the store refuses, with the reason."""
    return norm.where(F.col("rejected")).select(
        "posting_id", "batch_date", "company_name", "announcement_name",
        F.when(F.col("company_name").isNull(), F.lit("company_missing"))
         .otherwise(F.lit("impossible_deadline")).alias("reason"),
    )


def quality_events(norm: DataFrame, batch_id=None) -> DataFrame:
    """Q1: one event per violated field (salary, experience) of every raw row.

    Events are recorded before the row is stored, so rejected and duplicate rows
    produce events too.
    """
    bid = F.lit(batch_id) if batch_id is not None else F.date_format("batch_date", "yyyyMMdd")
    ev = F.array(
        F.struct(F.lit("annual_salary").alias("field"), F.col("salary_rule").alias("rule"),
                 F.col("salary_raw").alias("original_value"),
                 F.col("salary_parsed").cast("string").alias("parsed_value")),
        F.struct(F.lit("experience").alias("field"), F.col("experience_rule").alias("rule"),
                 F.col("career_raw").alias("original_value"),
                 F.col("experience_parsed").cast("string").alias("parsed_value")),
    )
    return (norm.select(bid.alias("batch_id"), "posting_id", "created_at", "company_name",
                        "announcement_name", F.explode(ev).alias("e"))
            .where(F.col("e.rule").isNotNull())
            .select("batch_id", "posting_id", "created_at", "company_name", "announcement_name",
                    "e.field", "e.rule", "e.original_value", "e.parsed_value"))
