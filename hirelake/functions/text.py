"""Column expressions for parsing posting text.

Every function maps Columns to a Column built from native Spark functions, so a
whole normalisation stays inside one whole-stage-codegen projection: no Python UDF.

Unicode: Python's ``str.strip``/``split``/``\\d`` are Unicode-aware; Java regex is
not unless ``(?U)`` is set, and ``trim`` strips only U+0020.  Every regex below
therefore carries ``(?U)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V

# every character that (?U)\s matches: the White_Space property
WS_CHARS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"
WS_RUN = r"(?U)\s+"
FIRST_NUMBER = r"(?U)(\d+)"
ANY_DIGIT = r"(?U)\d"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Unicode-aware strip of leading/trailing whitespace (a trim of that set of characters:
    no regex is run over the whole text to look at its ends)."""
    return F.btrim(col_(c), F.lit(WS_CHARS))


def blank_to_null(c) -> Column:
    c = col_(c)
    return F.when(c != "", c)


def sanitize(c) -> Column:
    """null/empty -> null; strip, then delete every comma; empty result -> null."""
    return blank_to_null(F.replace(strip(c), F.lit(","), F.lit("")))


def first_number(c) -> Column:
    """First run of digits as bigint; null when absent (or beyond bigint)."""
    return F.regexp_extract(col_(c), FIRST_NUMBER, 1).try_cast("bigint")  # '' casts to null


def contains_any(c, words) -> Column:
    c = col_(c)
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def parse_experience(raw) -> Column:
    """신입/경력무관 anywhere -> 0, else the first number."""
    s = sanitize(raw)
    return (F.when(s.isNull(), F.lit(None).cast("bigint"))
            .when(contains_any(s, V.EXPERIENCE_ZERO_MARKERS), F.lit(0).cast("bigint"))
            .otherwise(first_number(s)))


def parse_region(raw) -> Column:
    """struct(region, subregion) or null.

    Texts naming an employment type are not regions; every 외 is deleted; the rest is
    split once on whitespace.
    """
    raw = col_(raw)
    v = strip(F.replace(raw, F.lit(V.REGION_SUFFIX_DROP), F.lit("")))
    parts = F.split(v, WS_RUN, 2)
    parsed = F.struct(parts.getItem(0).alias("region"), F.try_element_at(parts, F.lit(2)).alias("subregion"))
    return (F.when(raw.isNull() | (raw == ""), F.lit(None))
            .when(contains_any(raw, V.REGION_BLOCKERS), F.lit(None))
            .when(v == "", F.lit(None))
            .otherwise(parsed))


def _literal_map(pairs) -> Column:
    args = []
    for k, v in pairs:
        args += [F.lit(k), F.lit(v)]
    return F.create_map(*args)


def parse_education(raw) -> Column:
    """P5: exact match of the sanitized text."""
    return F.try_element_at(_literal_map(V.EDUCATION_LEVELS), sanitize(raw)).cast("bigint")


def parse_form(raw) -> Column:
    """Any digit -> null; else first hit in vocabulary order (not text order)."""
    raw = col_(raw)
    v = strip(raw)
    out = F.lit(None).cast("bigint")
    for word, code in reversed(V.FORM_PATTERNS):
        out = F.when(v.contains(word), F.lit(code).cast("bigint")).otherwise(out)
    return (F.when(raw.isNull() | (raw == ""), F.lit(None).cast("bigint"))
            .when(v.rlike(ANY_DIGIT), F.lit(None).cast("bigint"))
            .otherwise(out))


def parse_salary(raw) -> Column:
    """일 -> null; 월 -> 12 x first number (0 -> null); 만원 -> first number."""
    s = sanitize(raw)
    n = first_number(s)
    monthly = F.when(n.isNull() | (n == 0), F.lit(None).cast("bigint")).otherwise(F.try_multiply(n, F.lit(12)))
    return (F.when(s.isNull(), F.lit(None).cast("bigint"))
            .when(s.contains("일"), F.lit(None).cast("bigint"))
            .when(s.contains("월"), monthly)
            .when(s.contains("만원"), n)
            .otherwise(F.lit(None).cast("bigint")))


DEADLINE_PATTERN = r"(?U)^~(\d{2})/(\d{2})"


def _date_in_year(year: Column, mm: Column, dd: Column) -> Column:
    text = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), mm, F.lit("-"), dd)
    return F.try_to_date(text, "yyyy-MM-dd")


def parse_deadline(raw, today) -> Column:
    """struct(deadline date, error bool).

    ``error`` marks a ``~MM/DD`` text that names no real date in the year of
    ``today`` (or, once rolled forward, in the next year): such rows are rejected.
    """
    raw = col_(raw)
    today = col_(today)
    v = strip(raw)
    open_ = F.lit(V.OPEN_DEADLINE).cast("date")
    mm = F.regexp_extract(v, DEADLINE_PATTERN, 1)
    dd = F.regexp_extract(v, DEADLINE_PATTERN, 2)
    matched = v.rlike(DEADLINE_PATTERN)
    y = F.year(today)
    this_year = _date_in_year(y, mm, dd)
    next_year = _date_in_year(y + 1, mm, dd)
    dated = F.when(this_year.isNull(), F.lit(None).cast("date")) \
        .when(this_year < today, next_year).otherwise(this_year)
    deadline = (F.when(raw.isNull() | (raw == ""), open_)
                .when(v == "오늘마감", today)
                .when(v == "내일마감", F.date_add(today, 1))
                .when(v == "모레마감", F.date_add(today, 2))
                .when(v.contains("상시"), open_)
                .when(matched, dated)
                .otherwise(open_))
    return F.struct(deadline.alias("deadline"), deadline.isNull().alias("error"))


def _trimmed_items(arr: Column) -> Column:
    return F.filter(F.transform(arr, lambda t: strip(t)), lambda t: t != "")


def parse_description_tags(raw, synonyms=None) -> Column:
    """Comma list, stripped, blanks dropped, exact synonym map; empty -> empty array.

    ``synonyms`` overrides the fixed map (an empty list keeps the tags as written).
    """
    raw = col_(raw)
    pairs = V.TAG_SYNONYMS if synonyms is None else synonyms
    items = _trimmed_items(F.split(raw, ","))
    if pairs:
        syn = _literal_map(pairs)
        mapped = F.transform(items, lambda t: F.coalesce(F.try_element_at(syn, t), t))
    else:
        mapped = items
    return F.when(raw.isNull(), F.array().cast("array<string>")).otherwise(mapped)


def parse_position_tags(raw) -> Column:
    """P10: '·' and ',' separated, stripped, not synonym-mapped."""
    raw = col_(raw)
    items = _trimmed_items(F.split(raw, "[,·]"))
    return F.when(raw.isNull(), F.array().cast("array<string>")).otherwise(items)


def merge_tags(desc: Column, pos: Column) -> Column:
    """Description tags first, then position tags not already present (set semantics)."""
    return F.array_distinct(F.concat(desc, F.array_except(pos, desc)))


def validate_salary(v) -> Column:
    """struct(value, rule)."""
    v = col_(v)
    rule = (F.when(v < V.SALARY_MIN, F.lit(V.RULE_BELOW_MIN))
            .when(v > V.SALARY_MAX, F.lit(V.RULE_ABOVE_MAX_SALARY)))
    return F.struct(F.when(rule.isNull(), v).alias("value"), rule.alias("rule"))


def validate_experience(v) -> Column:
    """struct(value, rule)."""
    v = col_(v)
    rule = (F.when(v < 0, F.lit(V.RULE_NEGATIVE))
            .when(v > V.EXPERIENCE_MAX, F.lit(V.RULE_ABOVE_MAX_EXPERIENCE)))
    return F.struct(F.when(rule.isNull(), v).alias("value"), rule.alias("rule"))


# ------------------------------------------------------------------ display

def display_deadline(deadline, today) -> Column:
    d, t = col_(deadline), col_(today)
    delta = F.datediff(d, t)
    return (F.when(d.isNull() | (d >= F.lit(V.OPEN_DEADLINE_DISPLAY_FROM).cast("date")), F.lit(V.DISPLAY_OPEN))
            .when(delta == 0, F.lit(V.DISPLAY_DUE[0]))
            .when(delta == 1, F.lit(V.DISPLAY_DUE[1]))
            .when(delta == 2, F.lit(V.DISPLAY_DUE[2]))
            .otherwise(F.concat(F.lit("~"), F.date_format(d, "MM/dd"))))


def display_salary(v) -> Column:
    v = col_(v)
    return F.when(v.isNull(), F.lit(V.DISPLAY_SALARY_NEGOTIABLE)) \
        .otherwise(F.concat(v.cast("string"), F.lit(V.DISPLAY_SALARY_UNIT)))


def display_experience(v) -> Column:
    v = col_(v)
    return (F.when(v.isNull(), F.lit(V.DISPLAY_EXPERIENCE_ANY))
            .when(v == 0, F.lit(V.DISPLAY_EXPERIENCE_NEW))
            .otherwise(F.concat(v.cast("string"), F.lit(V.DISPLAY_EXPERIENCE_YEARS))))


def display_education(v) -> Column:
    m = _literal_map([(lvl, name) for name, lvl in V.EDUCATION_LEVELS])
    return F.coalesce(F.try_element_at(m, col_(v).cast("int")), F.lit(V.DISPLAY_EDUCATION_OTHER))


def form_name(v) -> Column:
    """P14 as an expression over the fixed 10-row code table."""
    return F.try_element_at(_literal_map(V.EMPLOYMENT_TYPES), col_(v).cast("int"))
