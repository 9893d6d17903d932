"""Building blocks of the DuckDB oracle queries.

The oracle is an independent re-statement of each operator in plain SQL over the
same driver tables; only the fixture bridge text is shared with the Spark side.
DuckDB's regex engine is RE2: ``\\s`` is ASCII there, so Unicode blanks are listed.
"""

from __future__ import annotations

from hirelake.functions import vocab as V
from hirelake.sources.fixtures import AS_OF, AS_OF_TS, duck_with

WS = r"[\s\x{3000}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{1680}\x{85}]"
NWS = r"[^\s\x{3000}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{1680}\x{85}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sanitize(x: str) -> str:
    return f"nullif(replace({strip(x)}, ',', ''), '')"


def first_number(x: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({x}, '(\\d+)', 1), '') AS BIGINT)"


def any_contains(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def case_map(x: str, pairs, cast: str = "BIGINT") -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {v if not isinstance(v, str) else q(v)}" for k, v in pairs)
    return f"CAST(CASE {x} {whens} END AS {cast})"


def tag_list(desc: str, pos: str, synonyms=None) -> str:
    pairs = V.TAG_SYNONYMS if synonyms is None else synonyms
    syn = " ".join(f"WHEN {q(o)} THEN {q(n)}" for o, n in pairs)
    mapped = f"lambda t: CASE t {syn} ELSE t END" if pairs else "lambda t: t"
    d = (f"coalesce(list_transform(list_filter(list_transform(string_split({desc}, ','), lambda t: {strip('t')}), "
         f"lambda t: t <> ''), {mapped}), [])")
    p = (f"coalesce(list_filter(list_transform(string_split_regex({pos}, '[,·]'), lambda t: {strip('t')}), "
         f"lambda t: t <> ''), [])")
    return f"list_distinct(list_concat({d}, {p}))"


def norm_cte(src: str = "stream", px: str = "", synonyms=None) -> str:
    """CTEs ``{px}n0``..``{px}normr``: every raw row of ``src`` parsed (mirror of P1-P12)."""
    form_whens = " ".join(f"WHEN contains(fv, {q(w)}) THEN {c}" for w, c in V.FORM_PATTERNS)
    return f"""
{px}n0 AS (
 SELECT *, {sanitize('career_raw')} AS cs, {sanitize('salary_raw')} AS ss, {strip('form_raw')} AS fv,
  {strip("replace(location_raw, '외', '')")} AS lv, {strip('deadline_raw')} AS dv, batch_date AS today
 FROM {src}),
{px}n1 AS (
 SELECT *,
  CASE WHEN cs IS NULL THEN NULL WHEN {any_contains('cs', V.EXPERIENCE_ZERO_MARKERS)} THEN 0
       ELSE {first_number('cs')} END AS experience_parsed,
  CASE WHEN ss IS NULL THEN NULL WHEN contains(ss, '일') THEN NULL
       WHEN contains(ss, '월') THEN CASE WHEN coalesce({first_number('ss')}, 0) = 0 THEN NULL ELSE {first_number('ss')} * 12 END
       WHEN contains(ss, '만원') THEN {first_number('ss')} ELSE NULL END AS salary_parsed,
  {case_map(sanitize('education_raw'), V.EDUCATION_LEVELS)} AS education,
  CAST(CASE WHEN form_raw IS NULL OR form_raw = '' THEN NULL WHEN regexp_matches(fv, '\\d') THEN NULL
       {form_whens} END AS BIGINT) AS form,
  CASE WHEN location_raw IS NULL OR location_raw = '' THEN NULL
       WHEN {any_contains('location_raw', V.REGION_BLOCKERS)} THEN NULL
       WHEN lv = '' THEN NULL ELSE regexp_extract(lv, '^({NWS}+)', 1) END AS region_name,
  CASE WHEN location_raw IS NULL OR location_raw = '' THEN NULL
       WHEN {any_contains('location_raw', V.REGION_BLOCKERS)} THEN NULL
       WHEN regexp_matches(lv, '{WS}') THEN regexp_extract(lv, '^{NWS}+{WS}+((?s).*)$', 1) ELSE NULL END AS subregion_name,
  TRY_CAST(printf('%04d-%s-%s', year(today), regexp_extract(dv, '^~(\\d{{2}})/(\\d{{2}})', 1), regexp_extract(dv, '^~(\\d{{2}})/(\\d{{2}})', 2)) AS DATE) AS d1,
  TRY_CAST(printf('%04d-%s-%s', year(today) + 1, regexp_extract(dv, '^~(\\d{{2}})/(\\d{{2}})', 1), regexp_extract(dv, '^~(\\d{{2}})/(\\d{{2}})', 2)) AS DATE) AS d2,
  {tag_list('description_raw', 'position_raw', synonyms)} AS tag_list
 FROM {px}n0),
{px}norm AS (
 SELECT posting_id, batch_date, created_at, company AS company_name, title AS announcement_name,
  experience_parsed,
  CASE WHEN experience_parsed < 0 OR experience_parsed > {V.EXPERIENCE_MAX} THEN NULL ELSE experience_parsed END AS experience,
  CASE WHEN experience_parsed < 0 THEN {q(V.RULE_NEGATIVE)} WHEN experience_parsed > {V.EXPERIENCE_MAX} THEN {q(V.RULE_ABOVE_MAX_EXPERIENCE)} END AS experience_rule,
  education, form, region_name, subregion_name, salary_parsed,
  CASE WHEN salary_parsed < {V.SALARY_MIN} OR salary_parsed > {V.SALARY_MAX} THEN NULL ELSE salary_parsed END AS annual_salary,
  CASE WHEN salary_parsed < {V.SALARY_MIN} THEN {q(V.RULE_BELOW_MIN)} WHEN salary_parsed > {V.SALARY_MAX} THEN {q(V.RULE_ABOVE_MAX_SALARY)} END AS salary_rule,
  CASE WHEN deadline_raw IS NULL OR deadline_raw = '' THEN DATE '{V.OPEN_DEADLINE}'
       WHEN dv = '오늘마감' THEN today WHEN dv = '내일마감' THEN today + 1 WHEN dv = '모레마감' THEN today + 2
       WHEN contains(dv, '상시') THEN DATE '{V.OPEN_DEADLINE}'
       WHEN regexp_matches(dv, '^~\\d{{2}}/\\d{{2}}') THEN CASE WHEN d1 IS NULL THEN NULL WHEN d1 < today THEN d2 ELSE d1 END
       ELSE DATE '{V.OPEN_DEADLINE}' END AS deadline,
  tag_list AS tags, link, career_raw, salary_raw, company, title, location_raw, deadline_raw
 FROM {px}n1),
{px}normr AS (SELECT *, (deadline IS NULL OR company_name IS NULL) AS rejected FROM {px}norm)
"""


RAW_STREAM = "SELECT * FROM postings_raw UNION ALL SELECT * FROM postings_recrawl"


def stream_with(*extra: str, stream: str = RAW_STREAM, synonyms=None) -> str:
    """WITH prefix: fixture views + ``stream`` (base crawl + re-crawl) + norm + fact."""
    return (duck_with("postings_raw", "postings_recrawl", *extra).rstrip()
            + f",\nstream AS ({stream}),"
            + norm_cte("stream", "", synonyms) + ",\n"
            + fact_cte())


def fact_cte(px: str = "") -> str:
    """``{px}fact``: first arrival per (company, title, deadline); NULL titles never collide."""
    return f"""
{px}ranked AS (
 SELECT *, row_number() OVER (PARTITION BY company_name, announcement_name, deadline,
   CASE WHEN announcement_name IS NULL THEN posting_id END ORDER BY batch_date, posting_id) AS rn
 FROM {px}normr WHERE NOT rejected),
{px}fact AS (SELECT posting_id, company_name, announcement_name, experience, education, form, region_name,
  subregion_name, annual_salary, deadline, link, created_at, batch_date, tags FROM {px}ranked WHERE rn = 1)
"""


ASOF = f"DATE '{AS_OF}'"
ASOF_TS = f"TIMESTAMP '{AS_OF_TS}'"
