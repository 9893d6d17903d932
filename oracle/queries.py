"""Oracle SQL (DuckDB) per registered query key."""

from __future__ import annotations

from .base import ASOF, stream_with

SPLIT = "DATE '1997-01-01'"

FACT_OUT = ("posting_id, company_name, announcement_name, experience, education, form, region_name, "
            "subregion_name, annual_salary, CAST(deadline AS VARCHAR) AS deadline, link, "
            "array_to_string(list_sort(tags), '|') AS tags")

SQL: dict[str, str] = {}

SQL["normalize_postings"] = stream_with() + """
SELECT posting_id, company_name, announcement_name, experience, experience_rule, education, form,
 region_name, subregion_name, annual_salary, salary_rule, CAST(deadline AS VARCHAR) AS deadline, rejected,
 array_to_string(list_sort(tags), '|') AS tags
FROM normr"""

SQL["rejects"] = stream_with() + """
SELECT posting_id, CASE WHEN company_name IS NULL THEN 'company_missing' ELSE 'impossible_deadline' END AS reason
FROM normr WHERE rejected"""

SQL["first_wins_dedup"] = stream_with() + f"SELECT {FACT_OUT} FROM fact"

SQL["ingest_batch"] = SQL["first_wins_dedup"]

SQL["dim_upsert"] = stream_with() + f""",
old AS (SELECT DISTINCT company_name FROM normr WHERE NOT rejected AND batch_date < {SPLIT}),
old_k AS (SELECT row_number() OVER (ORDER BY company_name) AS company_id, company_name FROM old),
new AS (SELECT DISTINCT company_name FROM normr WHERE NOT rejected AND batch_date >= {SPLIT}
        AND company_name NOT IN (SELECT company_name FROM old))
SELECT company_id, company_name FROM old_k
UNION ALL
SELECT (SELECT coalesce(max(company_id), 0) FROM old_k) + row_number() OVER (ORDER BY company_name), company_name FROM new"""

SQL["posting_tags"] = stream_with() + """
SELECT DISTINCT posting_id, unnest(tags) AS tag FROM fact"""

SQL["quality_events"] = stream_with() + """
SELECT posting_id, 'annual_salary' AS field, salary_rule AS rule, salary_raw AS original_value,
 CAST(salary_parsed AS VARCHAR) AS parsed_value FROM normr WHERE salary_rule IS NOT NULL
UNION ALL
SELECT posting_id, 'experience', experience_rule, career_raw, CAST(experience_parsed AS VARCHAR)
FROM normr WHERE experience_rule IS NOT NULL"""

SQL["top_tags"] = stream_with() + f""",
t AS (SELECT posting_id, unnest(tags) AS name FROM fact WHERE deadline >= {ASOF})
SELECT name, count(*) AS count FROM t GROUP BY name ORDER BY count DESC, name LIMIT 10"""

SQL["top_tags_all"] = stream_with() + """,
t AS (SELECT posting_id, unnest(tags) AS name FROM fact)
SELECT name, count(*) AS count FROM t GROUP BY name ORDER BY count DESC, name LIMIT 10"""

LEGACY = """,
lranked AS (
 SELECT *, row_number() OVER (PARTITION BY company_name, announcement_name, deadline,
   CASE WHEN announcement_name IS NULL THEN posting_id END ORDER BY batch_date, posting_id) AS rn
 FROM normr WHERE NOT rejected),
legacy AS (SELECT posting_id, announcement_name, experience_parsed AS experience, salary_parsed AS annual_salary
 FROM lranked WHERE rn = 1)
"""

SQL["quality_clean"] = stream_with() + LEGACY + """
SELECT posting_id,
 CASE WHEN experience < 0 OR experience > 30 THEN NULL ELSE experience END AS experience,
 CASE WHEN annual_salary < 600 OR annual_salary > 50000 THEN NULL ELSE annual_salary END AS annual_salary
FROM legacy"""

SQL["quality_clean_log"] = stream_with() + LEGACY + """
SELECT posting_id, announcement_name, 'annual_salary' AS field,
 CASE WHEN annual_salary < 600 THEN 'below_minimum(600)' ELSE 'above_maximum(50000)' END AS rule,
 CAST(annual_salary AS VARCHAR) AS parsed_value
FROM legacy WHERE annual_salary < 600 OR annual_salary > 50000
UNION ALL
SELECT posting_id, announcement_name, 'experience',
 CASE WHEN experience < 0 THEN 'negative_value' ELSE 'above_maximum(30)' END, CAST(experience AS VARCHAR)
FROM legacy WHERE experience < 0 OR experience > 30"""

SQL["completeness"] = stream_with() + """,
a AS (SELECT count(*) AS total, count(annual_salary) AS s, count(experience) AS e, count(region_name) AS r,
  count(form) AS f, count(education) AS ed FROM fact)
SELECT 'annual_salary' AS field, total, s AS filled, round(s * 100.0 / total, 1) AS pct FROM a
UNION ALL SELECT 'experience', total, e, round(e * 100.0 / total, 1) FROM a
UNION ALL SELECT 'region_name', total, r, round(r * 100.0 / total, 1) FROM a
UNION ALL SELECT 'form', total, f, round(f * 100.0 / total, 1) FROM a
UNION ALL SELECT 'education', total, ed, round(ed * 100.0 / total, 1) FROM a"""

SQL["salary_dist"] = stream_with() + """
SELECT count(*) AS cnt, min(annual_salary) AS min, max(annual_salary) AS max,
 CAST(round(avg(annual_salary)) AS BIGINT) AS avg,
 quantile_cont(annual_salary, 0.25) AS p25, quantile_cont(annual_salary, 0.5) AS p50,
 quantile_cont(annual_salary, 0.75) AS p75, quantile_cont(annual_salary, 0.95) AS p95
FROM fact WHERE annual_salary IS NOT NULL"""

SQL["experience_bands"] = stream_with() + LEGACY + """
SELECT CASE WHEN experience = 0 THEN '신입' WHEN experience BETWEEN 1 AND 3 THEN '1~3년'
  WHEN experience BETWEEN 4 AND 7 THEN '4~7년' WHEN experience >= 8 THEN '8년 이상' END AS band,
 count(*) AS cnt, min(experience) AS ord
FROM legacy WHERE experience IS NOT NULL GROUP BY band"""

ET = ("(VALUES (1,'정규직'),(2,'계약직'),(3,'인턴'),(4,'파견직'),(5,'프리랜서'),(6,'위촉직'),"
      "(7,'도급'),(8,'연수생'),(9,'병역특례'),(10,'아르바이트')) et(id, name)")

SQL["form_dist"] = stream_with() + f"""
SELECT CAST(et.id AS BIGINT) AS form, et.name, count(*) AS cnt FROM fact JOIN {ET} ON fact.form = et.id
GROUP BY et.id, et.name"""

QEV = """,
qev AS (
 SELECT posting_id, created_at, company_name, announcement_name, 'annual_salary' AS field, salary_rule AS rule,
  salary_raw AS original_value, CAST(salary_parsed AS VARCHAR) AS parsed_value FROM normr WHERE salary_rule IS NOT NULL
 UNION ALL
 SELECT posting_id, created_at, company_name, announcement_name, 'experience', experience_rule, career_raw,
  CAST(experience_parsed AS VARCHAR) FROM normr WHERE experience_rule IS NOT NULL)
"""

SQL["quality_event_summary"] = stream_with() + QEV + """
SELECT field, rule, count(*) AS cnt FROM qev GROUP BY field, rule
UNION ALL SELECT NULL, NULL, count(*) FROM qev"""

SQL["quality_recent"] = stream_with() + QEV + """
SELECT company_name, announcement_name, field, rule, original_value, parsed_value FROM qev
ORDER BY created_at DESC, posting_id DESC, field LIMIT 5"""

SQL["quality_report"] = stream_with() + QEV + f""",
a AS (SELECT count(*) AS total, count(annual_salary) AS s, count(experience) AS e, count(region_name) AS r,
  count(form) AS f, count(education) AS ed FROM fact),
sd AS (SELECT count(*) AS cnt, min(annual_salary) AS mn, max(annual_salary) AS mx, round(avg(annual_salary)) AS av,
  quantile_cont(annual_salary, 0.25) AS p25, quantile_cont(annual_salary, 0.5) AS p50,
  quantile_cont(annual_salary, 0.75) AS p75, quantile_cont(annual_salary, 0.95) AS p95
  FROM fact WHERE annual_salary IS NOT NULL)
SELECT 1 AS section, -1 AS ord, 'total' AS label, CAST(total AS DOUBLE) AS value FROM a
UNION ALL SELECT 1, 0, '연봉', round(s * 100.0 / total, 1) FROM a
UNION ALL SELECT 1, 1, '경력', round(e * 100.0 / total, 1) FROM a
UNION ALL SELECT 1, 2, '지역', round(r * 100.0 / total, 1) FROM a
UNION ALL SELECT 1, 3, '고용형태', round(f * 100.0 / total, 1) FROM a
UNION ALL SELECT 1, 4, '학력', round(ed * 100.0 / total, 1) FROM a
UNION ALL SELECT 2, 0, 'cnt', floor(cnt) FROM sd
UNION ALL SELECT 2, 1, 'min', floor(mn) FROM sd
UNION ALL SELECT 2, 2, 'p25', floor(p25) FROM sd
UNION ALL SELECT 2, 3, 'p50', floor(p50) FROM sd
UNION ALL SELECT 2, 4, 'p75', floor(p75) FROM sd
UNION ALL SELECT 2, 5, 'p95', floor(p95) FROM sd
UNION ALL SELECT 2, 6, 'max', floor(mx) FROM sd
UNION ALL SELECT 2, 7, 'avg', floor(av) FROM sd
UNION ALL SELECT 3, min(experience), coalesce(CASE WHEN experience = 0 THEN '신입' WHEN experience BETWEEN 1 AND 3 THEN '1~3년'
  WHEN experience BETWEEN 4 AND 7 THEN '4~7년' WHEN experience >= 8 THEN '8년 이상' END, 'NULL'), count(*)
  FROM fact WHERE experience IS NOT NULL GROUP BY 3
UNION ALL SELECT 4, et.id, et.name, count(*) FROM fact JOIN {ET} ON fact.form = et.id GROUP BY et.id, et.name
UNION ALL SELECT 5, 0, field || ' / ' || rule, count(*) FROM qev GROUP BY field, rule
UNION ALL SELECT 5, 0, 'total', count(*) FROM qev
UNION ALL SELECT 6, CAST(r AS INT), '[' || field || '/' || rule || '] ' || coalesce(company_name, '') || ' | ' || coalesce(announcement_name, '')
  || ': ' || coalesce(original_value, '') || ' -> ' || coalesce(CAST(parsed_value AS VARCHAR), ''), NULL
 FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, posting_id DESC, field) - 1 AS r FROM qev) q WHERE r < 5"""

KW_HITS = f""",
kw AS (SELECT * FROM keywords),
vf AS (SELECT * FROM fact WHERE deadline >= {ASOF} AND annual_salary IS NOT NULL),
hits AS (
 SELECT DISTINCT kw.keyword, vf.posting_id, vf.annual_salary FROM kw JOIN vf
 ON vf.announcement_name ILIKE '%' || kw.keyword || '%'
    OR len(list_filter(vf.tags, lambda t: t ILIKE '%' || kw.keyword || '%')) > 0)
"""

SQL["salary_by_keyword"] = stream_with("keywords") + KW_HITS + """
SELECT keyword, CAST(trunc(avg(annual_salary)) AS BIGINT) AS avg_salary, count(*) AS count
FROM hits GROUP BY keyword"""

SQL["regional_dist"] = stream_with() + f"""
SELECT region_name AS region, count(*) AS count FROM fact WHERE deadline >= {ASOF} AND region_name IS NOT NULL
GROUP BY region_name ORDER BY count DESC, region LIMIT 8"""

EXP_LABEL = ("CASE WHEN experience IS NULL THEN '경력무관' WHEN experience = 0 THEN '신입' "
             "WHEN experience <= 3 THEN '1~3년' WHEN experience <= 7 THEN '4~7년' ELSE '8년 이상' END")

SQL["experience_dist"] = stream_with() + f"""
SELECT {EXP_LABEL} AS label, count(*) AS count FROM fact WHERE deadline >= {ASOF} GROUP BY label"""

SQL["daily_new"] = stream_with() + f"""
SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) AS count FROM fact
WHERE CAST(created_at AS DATE) >= {ASOF} - 6 GROUP BY CAST(created_at AS DATE)"""


def snapshot_sql(src: str, day: str) -> str:
    return f"""
 SELECT CAST({day} AS VARCHAR) AS date,
  (SELECT count(*) FROM {src} WHERE deadline >= {day}) AS total_valid_jobs,
  (SELECT count(*) FROM {src} WHERE CAST(created_at AS DATE) = {day}) AS new_jobs,
  (SELECT CAST(trunc(avg(annual_salary)) AS BIGINT) FROM {src} WHERE deadline >= {day}) AS avg_salary,
  (SELECT string_agg(name || ':' || c, '|' ORDER BY c DESC, name) FROM (
     SELECT name, count(*) AS c FROM (SELECT unnest(tags) AS name FROM {src} WHERE deadline >= {day}) u
     GROUP BY name ORDER BY c DESC, name LIMIT 10) x) AS top_tags,
  (SELECT string_agg(name || ':' || c, '|' ORDER BY c DESC, name) FROM (
     SELECT region_name AS name, count(*) AS c FROM {src} WHERE deadline >= {day} AND region_name IS NOT NULL
     GROUP BY region_name ORDER BY c DESC, name LIMIT 6) x) AS region_dist,
  (SELECT string_agg(name || ':' || c, '|' ORDER BY c DESC, name) FROM (
     SELECT {EXP_LABEL} AS name, count(*) AS c FROM {src} WHERE deadline >= {day} GROUP BY 1) x) AS experience_dist"""


SQL["market_snapshot"] = stream_with() + snapshot_sql("fact", ASOF)

def _listed(name: str, source: str, n: int) -> str:
    return f"""(SELECT d, string_agg(name || ':' || c, '|' ORDER BY c DESC, name) AS {name} FROM (
  SELECT d, name, count(*) AS c, row_number() OVER (PARTITION BY d ORDER BY count(*) DESC, name) AS r FROM ({source}) u GROUP BY d, name) x
  WHERE r <= {n} GROUP BY d)"""


SQL["market_snapshot_range"] = stream_with() + f""",
days AS (SELECT CAST(t AS DATE) AS d FROM range(DATE '1998-03-18', {ASOF} + 1, INTERVAL 1 DAY) r(t)),
v AS (SELECT d, f.* FROM days JOIN fact f ON CAST(f.created_at AS DATE) <= d AND f.deadline >= d),
h AS (SELECT d, count(*) AS n, CAST(trunc(avg(annual_salary)) AS BIGINT) AS s FROM v GROUP BY d),
w AS (SELECT CAST(created_at AS DATE) AS d, count(*) AS n FROM fact GROUP BY 1)
SELECT CAST(days.d AS VARCHAR) AS date, coalesce(h.n, 0) AS total_valid_jobs, coalesce(w.n, 0) AS new_jobs, h.s AS avg_salary,
 coalesce(top_tags, '') AS top_tags, coalesce(region_dist, '') AS region_dist, coalesce(experience_dist, '') AS experience_dist
FROM days LEFT JOIN h USING (d) LEFT JOIN w USING (d)
LEFT JOIN {_listed("top_tags", "SELECT d, unnest(list_distinct(tags)) AS name FROM v", 10)} t USING (d)
LEFT JOIN {_listed("region_dist", "SELECT d, region_name AS name FROM v WHERE region_name IS NOT NULL", 6)} g USING (d)
LEFT JOIN {_listed("experience_dist", f"SELECT d, {EXP_LABEL} AS name FROM v", 10)} e USING (d)"""

SQL["snapshot_upsert"] = stream_with() + f""",
early AS (SELECT * FROM fact WHERE batch_date < {SPLIT}),
stored AS ({snapshot_sql("early", ASOF + " - 2")} UNION ALL {snapshot_sql("early", ASOF + " - 1")}
  UNION ALL {snapshot_sql("early", ASOF)})
SELECT * FROM stored WHERE date <> CAST({ASOF} AS VARCHAR)
UNION ALL {snapshot_sql("fact", ASOF)}"""

SQL["insight_report"] = stream_with() + f""",
tt AS (SELECT name, count(*) AS count FROM (SELECT unnest(tags) AS name FROM fact WHERE deadline >= {ASOF}) u
  GROUP BY name ORDER BY count DESC, name LIMIT 10),
rk AS (SELECT row_number() OVER (ORDER BY count DESC, name) AS rank, name, count FROM tt),
kw AS (SELECT name AS keyword FROM rk WHERE rank <= 5),
vf AS (SELECT * FROM fact WHERE deadline >= {ASOF} AND annual_salary IS NOT NULL),
hits AS (
 SELECT DISTINCT kw.keyword, vf.posting_id, vf.annual_salary FROM kw JOIN vf
 ON vf.announcement_name ILIKE '%' || kw.keyword || '%'
    OR len(list_filter(vf.tags, lambda t: t ILIKE '%' || kw.keyword || '%')) > 0),
sal AS (SELECT keyword, CAST(trunc(avg(annual_salary)) AS BIGINT) AS avg_salary FROM hits GROUP BY keyword)
SELECT rank, name, count, avg_salary FROM rk LEFT JOIN sal ON sal.keyword = rk.name"""

SQL["expire_postings"] = stream_with() + f"""
SELECT DISTINCT posting_id, unnest(tags) AS tag FROM fact WHERE deadline >= {ASOF}"""

from .base import RAW_STREAM, norm_cte, sanitize  # noqa: E402

LEGACY_LOC = ("SELECT * REPLACE (CASE WHEN batch_date < DATE '1997-01-01' THEN NULL ELSE location_raw END "
              "AS location_raw) FROM (" + RAW_STREAM + ")")

BACKFILL = f""",
rstream AS ({RAW_STREAM}),{norm_cte("rstream", "r_")},
regions AS (SELECT DISTINCT region_name AS name FROM normr WHERE NOT rejected AND region_name IS NOT NULL),
rr AS (SELECT {sanitize('company')} AS company_name, {sanitize('title')} AS announcement_name, deadline,
  region_name AS new_region, subregion_name AS new_subregion, batch_date, posting_id
  FROM r_normr WHERE deadline IS NOT NULL AND region_name IS NOT NULL AND region_name IN (SELECT name FROM regions)),
lastr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_name, announcement_name, deadline
  ORDER BY batch_date DESC, posting_id DESC) AS k FROM rr) WHERE k = 1),
bf AS (SELECT f.posting_id, f.region_name AS old_region, f.subregion_name AS old_sub, l.new_region, l.new_subregion,
  (l.new_region IS NOT NULL AND (f.region_name IS NULL OR f.subregion_name IS DISTINCT FROM l.new_subregion)) AS updated
  FROM fact f LEFT JOIN lastr l ON f.company_name = l.company_name AND f.announcement_name = l.announcement_name
  AND f.deadline = l.deadline),
after AS (SELECT posting_id, CASE WHEN updated THEN new_region ELSE old_region END AS region_name,
  CASE WHEN updated THEN new_subregion ELSE old_sub END AS subregion_name, updated FROM bf)
"""

SQL["region_backfill"] = stream_with(stream=LEGACY_LOC) + BACKFILL + """
SELECT posting_id, region_name, subregion_name, updated FROM after"""

SQL["fill_rate"] = stream_with(stream=LEGACY_LOC) + BACKFILL + """
SELECT count(*) AS total, count(region_name) AS filled, round(count(region_name) * 100.0 / count(*), 1) AS fill_pct,
 'before' AS stage FROM fact
UNION ALL
SELECT count(*), count(region_name), round(count(region_name) * 100.0 / count(*), 1), 'after' FROM after"""

SYN_VALUES = ("(VALUES (1,'JAVA','Java'),(2,'SPRING','Spring'),(3,'vue.js','Vue.js'),(4,'vuejs','Vue.js'),"
              "(5,'Vue','Vue.js'),(6,'springboot','Spring Boot'),(7,'spring Framework개발','Spring'),"
              "(8,'React 기반','React'),(9,'Backend','백엔드'),(10,'Front-end 개발','프론트엔드')) syn(ord, old, new)")

SQL["tag_merge"] = stream_with(synonyms=[]) + f""",
br AS (SELECT DISTINCT posting_id, unnest(tags) AS tag FROM fact)
SELECT DISTINCT posting_id, coalesce(syn.new, br.tag) AS tag FROM br LEFT JOIN {SYN_VALUES} ON syn.old = br.tag"""

SQL["tag_merge_report"] = stream_with(synonyms=[]) + f""",
names AS (SELECT DISTINCT unnest(tags) AS name FROM fact),
s AS (SELECT ord, old, new, old IN (SELECT name FROM names) AS op, new IN (SELECT name FROM names) AS np
      FROM {SYN_VALUES}),
x AS (SELECT s.*, coalesce((SELECT bool_or(e.op) FROM s e WHERE e.new = s.new AND e.ord < s.ord), false) AS ep FROM s)
SELECT ord, old, new, CASE WHEN NOT op THEN 'skipped' WHEN np OR ep THEN 'merged' ELSE 'renamed' END AS action FROM x"""

from hirelake.sources.fixtures import duck_with as _dw  # noqa: E402

SQL["profile_upsert"] = _dw("profiles") + """,
ch AS (SELECT user_id, region, form, max_experience, min_salary, 1 AS seq FROM profiles
  UNION ALL SELECT user_id, NULL, form, max_experience, 3000, 2 FROM profiles WHERE form IS NULL)
SELECT user_id, region, form, max_experience, min_salary FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS k FROM ch) WHERE k = 1"""

SQL["subscription_cap"] = _dw("subscriptions") + """
SELECT user_id, seq, keyword, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS position,
 row_number() OVER (PARTITION BY user_id ORDER BY seq) <= 5 AS accepted FROM subscriptions"""

SQL["subscription_delete"] = _dw("subscriptions") + """,
st AS (SELECT user_id, seq, keyword, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS position
  FROM subscriptions QUALIFY position <= 5)
SELECT user_id, seq, keyword FROM st WHERE position NOT IN (2, 9)"""

from hirelake.functions import vocab as _V  # noqa: E402

from .parse import parse_ctes  # noqa: E402

PARSE_OUT = ("query_id, keyword, region, form, form_code, max_experience, min_annual_salary, company_name, error, "
             "CAST(min_deadline AS VARCHAR) AS min_deadline")

SQL["parse_queries"] = _dw("query_log", "region_vocab") + "," + parse_ctes(
    "query_log", "1998-06-15", "region_vocab") + f"SELECT {PARSE_OUT} FROM pq"

SQL["parse_queries_jobwords"] = _dw("query_log", "region_vocab", "keywords") + "," + parse_ctes(
    "query_log", "1998-06-15", "region_vocab") .replace(
    "AND cand NOT IN (SELECT name FROM region_vocab)",
    "AND cand NOT IN (SELECT name FROM region_vocab) AND cand NOT IN (SELECT keyword FROM keywords)") \
    + f"SELECT {PARSE_OUT} FROM pq"

from .search import expanded_ctes, search_ctes, text_hit, thesaurus_ctes  # noqa: E402

PQ = ("," + parse_ctes("query_log", "1998-06-15", "region_vocab")
      + ",\nsq AS (SELECT * FROM pq WHERE NOT error)")
SEARCH_PREFIX = stream_with("query_log", "region_vocab") + PQ
THES = thesaurus_ctes("SELECT p_name AS text FROM part", "sq")
EXPQ = ",\neq AS (SELECT sq.*, exp.expanded FROM sq JOIN exp USING (keyword))"

SQL["search_and"] = SEARCH_PREFIX + search_ctes("a_", "sq", 5, True, False) + "SELECT * FROM a_res"
SQL["search_fallback"] = SEARCH_PREFIX + search_ctes("a_", "sq", 2, True, True) + "SELECT * FROM a_res"
SQL["search_name_only"] = SEARCH_PREFIX + search_ctes("a_", "sq", 10, False, True) + "SELECT * FROM a_res"
SQL["search_expanded"] = SEARCH_PREFIX + THES + EXPQ + expanded_ctes("e_", "eq", 10) + "SELECT * FROM e_res"
SQL["search_baseline"] = (SEARCH_PREFIX + search_ctes("a_", "sq", 5, True, True)
                          + "SELECT query_id, rank, posting_id FROM a_res")

from .base import WS as WS_  # noqa: E402
from .base import strip as _strip  # noqa: E402

strip_kw = _strip("sq.keyword")

ADAPTIVE = (SEARCH_PREFIX + THES + search_ctes("f_", "sq", 50, True, True) + """,
need AS (SELECT query_id FROM sq WHERE keyword IS NOT NULL
  AND query_id NOT IN (SELECT query_id FROM f_res GROUP BY query_id HAVING count(*) >= 3)),
eq AS (SELECT sq.*, coalesce(exp.expanded, [sq.keyword]) AS expanded FROM sq LEFT JOIN exp USING (keyword)
  WHERE query_id IN (SELECT query_id FROM need))""" + expanded_ctes("x_", "eq", 50) + """,
pool AS (SELECT query_id, rank, posting_id FROM f_res WHERE query_id NOT IN (SELECT query_id FROM need)
  UNION ALL SELECT query_id, rank, posting_id FROM x_res),
rrq AS (SELECT query_id FROM pool WHERE query_id IN (SELECT query_id FROM sq WHERE keyword IS NOT NULL)
  GROUP BY query_id HAVING count(*) > 1),
sc AS (SELECT p.query_id, p.rank, p.posting_id, list_filter(string_split_regex(lower(""" + strip_kw + """), '""" + WS_ + """+'),
  lambda t: t <> '') AS toks, lower(concat_ws(' ', f.announcement_name, array_to_string(f.tags, ' '))) AS txt
  FROM pool p JOIN sq USING (query_id) JOIN fact f USING (posting_id) WHERE p.query_id IN (SELECT query_id FROM rrq)),
sc2 AS (SELECT query_id, rank, posting_id, CASE WHEN len(toks) > 0 THEN
  len(list_filter(toks, lambda t: strpos(txt, t) > 0)) * 10.0 / len(toks) ELSE 5.0 END AS score FROM sc),
rr AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank, posting_id FROM sc2),
fin AS (SELECT query_id, rank, posting_id FROM pool WHERE query_id NOT IN (SELECT query_id FROM rrq)
  UNION ALL SELECT query_id, rank, posting_id FROM rr)
""")

SQL["search_adaptive"] = ADAPTIVE + "SELECT query_id, rank, posting_id FROM fin WHERE rank <= 5"

SQL["ab_compare"] = ADAPTIVE + """,
ab AS (SELECT query_id, rank, posting_id FROM fin WHERE rank <= 5)""" + search_ctes("a_", "sq", 5, True, True) + """
SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.posting_id, b.posting_id) AS posting_id,
 a.rank AS rank_a, b.rank AS rank_b
FROM (SELECT query_id, rank, posting_id FROM a_res) a FULL OUTER JOIN ab b ON a.query_id = b.query_id AND a.posting_id = b.posting_id"""

SQL["expand_keywords"] = SEARCH_PREFIX + THES + """
SELECT keyword, array_to_string(list_sort(expanded), '|') AS expanded FROM exp"""

SQL["list_valid"] = stream_with() + f"""
SELECT posting_id, company_name, announcement_name FROM fact WHERE deadline >= {ASOF} ORDER BY posting_id DESC LIMIT 100"""

SQL["lookup_ids"] = stream_with() + """
SELECT posting_id, announcement_name, CAST(deadline AS VARCHAR) AS deadline FROM fact
WHERE posting_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')"""

SQL["text_match"] = stream_with("keywords") + f"""
SELECT DISTINCT k.keyword, f.posting_id FROM keywords k JOIN fact f ON {text_hit('k.keyword', 'f', True)}"""

SQL["ngram_search"] = SQL["text_match"]

SQL["text_match_selective"] = stream_with("selective_keywords") + f"""
SELECT DISTINCT k.keyword, f.posting_id FROM selective_keywords k JOIN fact f ON {text_hit('k.keyword', 'f', True)}"""

SQL["ngram_search_selective"] = SQL["text_match_selective"]

SQL["postings_denorm"] = stream_with() + """
SELECT posting_id, company_name, region_name, array_to_string(list_sort(list_distinct(tags)), '|') AS tags FROM fact"""

SQL["region_names"] = stream_with() + """
SELECT DISTINCT region_name AS region, subregion_name AS subregion, region_name || ' ' || subregion_name AS full_region_name
FROM fact WHERE subregion_name IS NOT NULL AND region_name IS NOT NULL"""


def _alert_ctes(ts: str, px: str) -> str:
    upper = f" AND CAST(created_at AS TIMESTAMP) < TIMESTAMP '{ts}'"
    return f""",
{px}np AS (SELECT * FROM fact WHERE CAST(created_at AS TIMESTAMP) >= TIMESTAMP '{ts}' - INTERVAL 168 HOUR{upper}),
{px}npt AS (SELECT posting_id, lower(concat_ws(' ', coalesce(announcement_name, ''), array_to_string(tags, ' '))) AS txt,
  region_name, form, experience, annual_salary FROM {px}np),
{px}kx AS (SELECT DISTINCT st.keyword, exp.expanded FROM st JOIN exp USING (keyword)),
{px}km AS (SELECT kx.keyword, n.posting_id FROM {px}kx kx JOIN {px}npt n
  ON len(list_filter(kx.expanded, lambda t: strpos(n.txt, lower(t)) > 0)) > 0),
{px}mm AS (SELECT st.user_id, st.seq, km.posting_id FROM st JOIN {px}km km USING (keyword)
  UNION ALL SELECT st.user_id, st.seq, n.posting_id FROM st, {px}npt n WHERE st.keyword IS NULL OR {strip_kw2} = ''),
{px}ok AS (SELECT m.user_id, m.seq, m.posting_id FROM {px}mm m JOIN {px}npt n USING (posting_id)
  LEFT JOIN profiles p USING (user_id) WHERE {PROFILE_OK}),
{px}um AS (SELECT user_id, posting_id, min(seq) AS seq FROM {px}ok GROUP BY ALL)
"""


from .base import strip as _strip2  # noqa: E402

strip_kw2 = _strip2("st.keyword")
PROFILE_OK = """(p.region IS NULL OR p.region = '' OR n.region_name IS NULL OR n.region_name = ''
   OR strpos(n.region_name, p.region) > 0)
  AND (p.form IS NULL OR coalesce(n.form = p.form, false))
  AND (p.max_experience IS NULL OR n.experience IS NULL OR n.experience <= p.max_experience)
  AND (p.min_salary IS NULL OR n.annual_salary IS NULL OR n.annual_salary >= p.min_salary)"""

ALERT_PREFIX = (stream_with("subscriptions", "profiles") + """,
st AS (SELECT user_id, seq, keyword FROM subscriptions
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq) <= 5)"""
                + thesaurus_ctes("SELECT p_name AS text FROM part", "st"))
ALERTS = ALERT_PREFIX + _alert_ctes("1998-06-15 12:00:00", "c_") + _alert_ctes("1998-06-12 12:00:00", "o_") + """,
pend AS (SELECT * FROM c_um WHERE (user_id, posting_id) NOT IN (SELECT (user_id, posting_id) FROM o_um))
"""

SQL["new_postings"] = stream_with() + """
SELECT posting_id, announcement_name FROM fact
WHERE CAST(created_at AS TIMESTAMP) >= TIMESTAMP '1998-06-15 12:00:00' - INTERVAL 168 HOUR
 AND CAST(created_at AS TIMESTAMP) < TIMESTAMP '1998-06-15 12:00:00'"""

SQL["match_subscriptions"] = ALERT_PREFIX + _alert_ctes("1998-06-15 12:00:00", "c_") + f""",
kt AS (SELECT keyword, list_filter(string_split_regex({_strip2('keyword')}, '{WS_}+'), lambda t: t <> '') AS toks
  FROM (SELECT DISTINCT keyword FROM st WHERE keyword IS NOT NULL AND {_strip2('keyword')} <> '')),
akm AS (SELECT kt.keyword, n.posting_id FROM kt JOIN c_npt n
  ON len(list_filter(kt.toks, lambda t: strpos(n.txt, lower(t)) > 0)) = len(kt.toks)),
amm AS (SELECT st.user_id, st.seq, akm.posting_id FROM st JOIN akm USING (keyword)
  UNION ALL SELECT st.user_id, st.seq, n.posting_id FROM st, c_npt n WHERE st.keyword IS NULL OR {strip_kw2} = '')
SELECT m.user_id, m.seq, m.posting_id FROM amm m JOIN c_npt n USING (posting_id) LEFT JOIN profiles p USING (user_id)
WHERE {PROFILE_OK}"""

SQL["match_expanded"] = ALERTS + "SELECT user_id, seq, posting_id FROM c_ok"
SQL["user_matches"] = ALERTS + "SELECT user_id, posting_id, seq FROM c_um"
SQL["alerts_pending"] = ALERTS + "SELECT user_id, posting_id, seq FROM pend"
SQL["alert_log"] = ALERTS + """
SELECT DISTINCT user_id, posting_id FROM (SELECT user_id, posting_id FROM o_um UNION ALL SELECT user_id, posting_id FROM pend)"""
SQL["alert_digest"] = ALERTS + f""",
fk AS (SELECT user_id, arg_min(keyword, seq) AS keyword FROM st GROUP BY user_id),
r0 AS (SELECT user_id, posting_id, row_number() OVER (PARTITION BY user_id ORDER BY seq, posting_id) AS rank FROM pend),
ft AS (SELECT posting_id, lower(concat_ws(' ', coalesce(announcement_name, ''), array_to_string(tags, ' '))) AS txt FROM fact),
sc AS (SELECT r0.*, list_filter(string_split_regex(lower({_strip2('fk.keyword')}), '{WS_}+'), lambda t: t <> '') AS toks, ft.txt
  FROM r0 LEFT JOIN fk USING (user_id) JOIN ft USING (posting_id)),
sc2 AS (SELECT user_id, posting_id, rank, CASE WHEN len(coalesce(toks, [])) > 0
  THEN len(list_filter(toks, lambda t: strpos(txt, t) > 0)) * 10.0 / len(toks) ELSE 5.0 END AS score FROM sc)
SELECT user_id, rank, posting_id FROM (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, rank) AS rnk, posting_id FROM sc2)
  x(user_id, rank, posting_id) WHERE rank <= 10"""


def _per_query(k: int) -> str:
    return f""",
tp AS (SELECT r.query_id, r.mode, r.rank, coalesce(j.rel, 0) AS rel FROM runs r LEFT JOIN judgments j
  ON r.query_id = j.query_id AND r.doc_id = j.doc_id WHERE r.rank <= {k}),
ag AS (SELECT query_id, mode, sum(rel / log2(rank + 1)) AS dcg, sum(CASE WHEN rel >= 1 THEN 1 ELSE 0 END) AS p,
  max(CASE WHEN rel >= 2 THEN 1 ELSE 0 END) AS hit FROM tp GROUP BY ALL),
idl AS (SELECT query_id, sum(rel / log2(r + 1)) AS idcg FROM (SELECT query_id, rel,
  row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS r FROM judgments) WHERE r <= {k} GROUP BY ALL),
pq AS (SELECT ag.query_id, ag.mode, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END AS ndcg, p / {float(k)} AS precision,
  CAST(hit AS DOUBLE) AS hit FROM ag JOIN idl USING (query_id))
"""


EV = _dw("runs", "judgments")
SQL["ndcg"] = EV + _per_query(10) + "SELECT query_id, mode, round(ndcg, 9) AS ndcg FROM pq"
SQL["precision_at_k"] = EV + _per_query(10) + "SELECT query_id, mode, round(precision, 9) AS precision FROM pq"
SQL["hit_at_k"] = EV + _per_query(5) + "SELECT query_id, mode, round(hit, 9) AS hit FROM pq"
SQL["eval_summary"] = EV + _per_query(5).replace("tp AS", "tp5 AS").replace("FROM tp ", "FROM tp5 ").replace(
    "ag AS", "ag5 AS").replace("FROM ag ", "FROM ag5 ").replace("ag.", "ag5.").replace("idl AS", "idl5 AS").replace(
    "JOIN idl ", "JOIN idl5 ").replace("pq AS", "pq5 AS") + _per_query(10) + """
SELECT a.mode, round(a.n5, 9) AS ndcg_5, round(a.p5, 9) AS p_5, round(a.h5, 9) AS hit_5,
 round(b.n10, 9) AS ndcg_10, round(b.p10, 9) AS p_10, round(b.h10, 9) AS hit_10
FROM (SELECT mode, avg(ndcg) AS n5, avg(precision) AS p5, avg(hit) AS h5 FROM pq5 GROUP BY mode) a
JOIN (SELECT mode, avg(ndcg) AS n10, avg(precision) AS p10, avg(hit) AS h10 FROM pq GROUP BY mode) b USING (mode)"""
SQL["eval_by_type"] = _dw("runs", "judgments") + _per_query(10) + """,
m AS (SELECT o.o_orderpriority AS qtype, pq.mode, avg(pq.ndcg) AS ndcg FROM pq JOIN orders o ON o.o_orderkey = pq.query_id
  GROUP BY ALL)
SELECT m.qtype, m.mode, round(m.ndcg, 9) AS ndcg, round(m.ndcg - b.ndcg, 9) AS delta FROM m
LEFT JOIN (SELECT qtype, ndcg FROM m WHERE mode = 'N') b USING (qtype)"""
SQL["eval_detail"] = EV + _per_query(10) + """
SELECT query_id, round(max(CASE WHEN mode = 'A' THEN ndcg END), 9) AS A, round(max(CASE WHEN mode = 'N' THEN ndcg END), 9) AS N,
 round(max(CASE WHEN mode = 'R' THEN ndcg END), 9) AS R FROM pq GROUP BY query_id"""
SQL["pool_candidates"] = EV + """
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY mo, rk) AS pool_pos, mo AS first_mode FROM (
 SELECT query_id, doc_id, arg_min(mo, mo * 1000000 + rank) AS mo, arg_min(rank, mo * 1000000 + rank) AS rk FROM (
  SELECT query_id, doc_id, rank, CASE mode WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 END AS mo FROM runs WHERE rank <= 10)
 GROUP BY ALL)"""
SQL["judgment_dist"] = EV + "SELECT query_id, rel, count(*) AS n FROM judgments GROUP BY ALL"
SQL["judgment_checks"] = EV + """,
per AS (SELECT query_id, sum(CASE WHEN rel < 0 OR rel > 3 THEN 1 ELSE 0 END) AS bad, count(*) - count(DISTINCT doc_id) AS dups,
  max(rel) AS top, avg(CASE WHEN rel >= 2 THEN 1.0 ELSE 0.0 END) AS share FROM judgments GROUP BY query_id)
SELECT query_id, 'score_range' AS "check" FROM per WHERE bad > 0
UNION ALL SELECT query_id, 'duplicate' FROM per WHERE dups > 0
UNION ALL SELECT query_id, 'no_top_score' FROM per WHERE top < 3
UNION ALL SELECT query_id, 'relevant_share' FROM per WHERE share < 0.1"""
SQL["quality_gate"] = EV + """
SELECT r.query_id, r.mode, round(avg(j.rel), 9) AS mean_rel, sum(CASE WHEN j.rel >= 2 THEN 1 ELSE 0 END) AS hits,
 avg(j.rel) >= 1.0 AND sum(CASE WHEN j.rel >= 2 THEN 1 ELSE 0 END) >= 1 AS passed
FROM runs r JOIN judgments j ON r.query_id = j.query_id AND r.doc_id = j.doc_id WHERE r.rank <= 5 GROUP BY ALL"""
SQL["known_item_eval"] = EV + """,
tg AS (SELECT l_orderkey AS query_id, l_partkey AS doc_id FROM lineitem WHERE l_linenumber = 1),
md AS (SELECT DISTINCT mode FROM runs),
fd AS (SELECT r.query_id, r.mode, min(r.rank) AS rk FROM runs r JOIN tg ON r.query_id = tg.query_id AND r.doc_id = tg.doc_id GROUP BY ALL),
nr AS (SELECT query_id, mode, count(*) AS n FROM runs GROUP BY ALL),
j AS (SELECT tg.query_id, md.mode, fd.rk, nr.n FROM tg CROSS JOIN md LEFT JOIN fd ON fd.query_id = tg.query_id AND fd.mode = md.mode
  LEFT JOIN nr ON nr.query_id = tg.query_id AND nr.mode = md.mode)
SELECT mode, round(avg(CASE WHEN rk <= 5 THEN 1.0 ELSE 0.0 END), 4) AS hit_5, round(avg(CASE WHEN rk <= 10 THEN 1.0 ELSE 0.0 END), 4) AS hit_10,
 round(avg(coalesce(1.0 / rk, 0.0)), 4) AS mrr, round(avg(CASE WHEN coalesce(n, 0) = 0 THEN 1.0 ELSE 0.0 END), 4) AS zero_rate
FROM j GROUP BY mode"""
SQL["stratified_sample"] = stream_with() + """,
s AS (SELECT posting_id, len(coalesce(tags, [])) > 3 AS tagged, md5(CAST(posting_id AS VARCHAR) || ':42') AS h FROM fact),
a AS (SELECT posting_id, tagged FROM s WHERE tagged ORDER BY h, posting_id LIMIT 70),
b AS (SELECT posting_id, tagged FROM s WHERE NOT tagged ORDER BY h, posting_id LIMIT (SELECT 100 - count(*) FROM a))
SELECT * FROM a UNION ALL SELECT * FROM b"""
SQL["filter_regression"] = (_dw("query_log", "region_vocab", "keywords") + "," + parse_ctes(
    "query_log", "1998-06-15", "region_vocab") + ",\nd1 AS (SELECT * FROM pq)," + parse_ctes(
    "query_log", "1998-06-15", "region_vocab").replace("pq", "zq").replace(
    "AND cand NOT IN (SELECT name FROM region_vocab)",
    "AND cand NOT IN (SELECT name FROM region_vocab) AND cand NOT IN (SELECT keyword FROM keywords)") + """,
l1 AS (SELECT query_id, f AS field, v AS expected FROM d1, LATERAL (VALUES ('keyword', keyword), ('region', region),
  ('form', form), ('max_experience', CAST(max_experience AS VARCHAR)), ('min_annual_salary', CAST(min_annual_salary AS VARCHAR)),
  ('company_name', company_name)) t(f, v) WHERE v IS NOT NULL),
l2 AS (SELECT query_id, f AS field, v AS actual FROM zq, LATERAL (VALUES ('keyword', keyword), ('region', region),
  ('form', form), ('max_experience', CAST(max_experience AS VARCHAR)), ('min_annual_salary', CAST(min_annual_salary AS VARCHAR)),
  ('company_name', company_name)) t(f, v) WHERE v IS NOT NULL)
SELECT coalesce(l1.query_id, l2.query_id) AS query_id, coalesce(l1.field, l2.field) AS field, expected, actual
FROM l1 FULL OUTER JOIN l2 ON l1.query_id = l2.query_id AND l1.field = l2.field
WHERE expected IS DISTINCT FROM actual""")
SQL = {k: v for k, v in SQL.items() if v is not None}

SQL["stream_ingest"] = SQL["first_wins_dedup"]
SQL["events_daily_new"] = """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS count FROM events GROUP BY ALL"""

SQL["posting_cards"] = stream_with() + f""",
top AS (SELECT posting_id, row_number() OVER (PARTITION BY company_name ORDER BY posting_id DESC) AS rank FROM fact WHERE deadline >= {ASOF})
SELECT f.posting_id, concat_ws(chr(10),
 '📌 [' || CAST(top.rank AS VARCHAR) || '] ' || coalesce(announcement_name, '') || ' @ ' || coalesce(company_name, ''),
 '- 경력: ' || CASE WHEN experience IS NULL THEN '경력무관' WHEN experience = 0 THEN '신입' ELSE CAST(experience AS VARCHAR) || '년 이상' END,
 '- 학력: ' || coalesce(CASE education WHEN 0 THEN '학력무관' WHEN 1 THEN '고졸↑' WHEN 2 THEN '초대졸↑' WHEN 3 THEN '대졸↑'
   WHEN 4 THEN '석사↑' WHEN 5 THEN '박사↑' END, '기타'),
 '- 형태: ' || coalesce(CASE form WHEN 1 THEN '정규직' WHEN 2 THEN '계약직' WHEN 3 THEN '인턴' WHEN 4 THEN '파견직'
   WHEN 5 THEN '프리랜서' WHEN 6 THEN '위촉직' WHEN 7 THEN '도급' WHEN 8 THEN '연수생' WHEN 9 THEN '병역특례'
   WHEN 10 THEN '아르바이트' END, '정보 없음'),
 '- 연봉: ' || CASE WHEN annual_salary IS NULL THEN '협의' ELSE CAST(annual_salary AS VARCHAR) || '만원/년' END,
 '- 마감일: ' || CASE WHEN deadline >= DATE '9999-01-01' THEN '상시채용' WHEN deadline - {ASOF} = 0 THEN '오늘마감'
   WHEN deadline - {ASOF} = 1 THEN '내일마감' WHEN deadline - {ASOF} = 2 THEN '모레마감' ELSE '~' || strftime(deadline, '%m/%d') END,
 '🔗 ' || coalesce(link, '')) AS card
FROM fact f JOIN top USING (posting_id)"""

CRAWL = _dw("postings_raw") + f""",
cr AS (SELECT posting_id, company_key AS run_id, batch_date,
  CASE WHEN {ASOF} - batch_date = 0 THEN '3시간 전 등록'
       WHEN {ASOF} - batch_date > 0 AND {ASOF} - batch_date < 30 THEN CAST({ASOF} - batch_date AS VARCHAR) || '일 전 등록'
       ELSE strftime(batch_date, '%m/%d') END AS time_text FROM postings_raw),
cr2 AS (SELECT *, TRY_CAST(nullif(regexp_extract(time_text, '(\\d+)\\s*일\\s*전\\s*등록', 1), '') AS BIGINT) AS n,
  TRY_CAST(printf('%04d-%s-%s', year({ASOF}), regexp_extract(time_text, '(\\d{{2}})/(\\d{{2}})', 1),
    regexp_extract(time_text, '(\\d{{2}})/(\\d{{2}})', 2)) AS DATE) AS ty,
  TRY_CAST(printf('%04d-%s-%s', year({ASOF}) - 1, regexp_extract(time_text, '(\\d{{2}})/(\\d{{2}})', 1),
    regexp_extract(time_text, '(\\d{{2}})/(\\d{{2}})', 2)) AS DATE) AS ly FROM cr),
cr3 AS (SELECT *, CASE WHEN ty > {ASOF} THEN ly ELSE ty END AS posted FROM cr2)
"""


def _within(days: int) -> str:
    return f"""CASE WHEN contains(time_text, '분 전 등록') OR contains(time_text, '시간 전 등록') THEN true
  WHEN n IS NOT NULL THEN n <= {days}
  WHEN regexp_matches(time_text, '\\d{{2}}/\\d{{2}}') THEN coalesce({ASOF} - posted <= {days}, false) ELSE false END"""


SQL["recent_postings"] = CRAWL + f"SELECT posting_id, time_text FROM cr3 WHERE {_within(7)}"
SQL["crawl_prefix"] = CRAWL + f""",
fr AS (SELECT run_id, posting_id, -posting_id AS pos, {_within(30)} AS fresh FROM cr3),
st AS (SELECT run_id, min(pos) AS stop FROM fr WHERE NOT fresh GROUP BY run_id)
SELECT fr.run_id, fr.posting_id FROM fr LEFT JOIN st USING (run_id) WHERE st.stop IS NULL OR fr.pos < st.stop"""

_ST = lambda x: f"regexp_replace({x}, '^{WS_}+|{WS_}+$', '', 'g')"
_ART = ("regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>', ' ', 'g'), "
        f"'{WS_}+', ' ', 'g')")
SQL["page_fields"] = f"""
SELECT page_id, {_ST("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title,
 {_ST("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS heading,
 coalesce(nullif(regexp_extract(html, '(?s)<link rel="canonical" href="([^"]*)"', 1), ''), url) AS link,
 {_ST(_ART)} AS article_text, len(string_split({_ST(_ART)}, ' ')) AS n_words
FROM pages"""

RESP = _dw("conversations") + """,
resp AS (SELECT conv_id, turn, text AS response FROM conversations WHERE role = 'assistant')"""
_FL = lambda x: f"nullif(string_split_regex({_ST(x)}, '\\r?\\n|\\r')[1], '')"

SQL["parse_scores"] = _dw("score_responses") + f""",
resp AS (SELECT * FROM score_responses),
ps AS (SELECT conv_id, turn, list_filter(list_transform(string_split(replace(coalesce({_FL('response')}, ''), '，', ','), ','),
   lambda t: TRY_CAST({_ST('t')} AS DOUBLE)), lambda x: x IS NOT NULL) AS v FROM resp),
ps2 AS (SELECT conv_id, turn, list_slice(list_concat(v, [5.0,5.0,5.0,5.0,5.0,5.0,5.0,5.0,5.0,5.0]), 1, 10) AS s FROM ps)
SELECT conv_id, turn, unnest(range(len(s))) AS pos, unnest(s) AS score FROM ps2"""

PTAGS = f"""list_filter(list_transform(string_split({_FL('response')}, ','), lambda t: {_ST('t')}),
   lambda t: length(t) BETWEEN 1 AND 20 AND length(t) - length(replace(t, ' ', '')) <= 1)"""
SQL["parse_tags"] = RESP + f""",
pt AS (SELECT conv_id, turn, CASE WHEN len({PTAGS}) > 0 THEN {PTAGS} END AS tg FROM resp)
SELECT conv_id, turn, unnest(range(len(tg))) AS pos, unnest(tg) AS tag FROM pt WHERE tg IS NOT NULL"""

TAGX = (stream_with("conversations") + f""",
resp AS (SELECT conv_id, turn, text AS response FROM conversations WHERE role = 'assistant'),
r1 AS (SELECT conv_id * 32 + turn AS posting_id, response FROM resp),
pt AS (SELECT posting_id, CASE WHEN len({PTAGS}) > 0 THEN {PTAGS} END AS tg FROM r1),
te AS (SELECT f.posting_id, pt.tg, CASE WHEN pt.tg IS NULL THEN [] ELSE
  list_filter(list_distinct(pt.tg), lambda x: NOT list_contains(f.tags, x)) END AS added FROM fact f JOIN pt USING (posting_id))
""")
SQL["tag_enrich"] = TAGX + "SELECT posting_id, unnest(added) AS tag FROM te"
SQL["tag_outcomes"] = TAGX + """
SELECT CASE WHEN tg IS NULL THEN 'failed' WHEN len(added) > 0 THEN 'tagged' ELSE 'skipped' END AS outcome, count(*) AS n
FROM te GROUP BY 1"""
SQL["tag_backlog"] = stream_with() + f"""
SELECT posting_id, CAST(floor((row_number() OVER (ORDER BY posting_id) - 1) / 100) AS BIGINT) AS batch_no
FROM (SELECT posting_id FROM fact WHERE deadline >= {ASOF})"""
SQL["judge_incremental"] = _dw("runs", "judgments", "judge_responses") + f""",
pool AS (SELECT DISTINCT query_id, doc_id FROM runs WHERE rank <= 10),
un AS (SELECT * FROM pool WHERE (query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM judgments)),
resp AS (SELECT * FROM judge_responses)
SELECT un.query_id, un.doc_id, CAST(coalesce(nullif(regexp_extract(coalesce({_ST('resp.response')}, ''), '[0-3]', 0), ''), '0') AS INT) AS rel
FROM un LEFT JOIN resp USING (query_id, doc_id)"""

SQL["ingest_csv"] = stream_with(stream="""SELECT posting_id, make_date(year(batch_date), 1, 1) AS batch_date,
  CAST(make_date(year(batch_date), 1, 1) AS TIMESTAMP) AS created_at, company_key, company, title, career_raw,
  education_raw, form_raw, location_raw, salary_raw, deadline_raw, description_raw, NULL AS position_raw, link
  FROM postings_raw""") + """,
cr AS (SELECT *, row_number() OVER (PARTITION BY company_name, announcement_name, deadline,
   CASE WHEN announcement_name IS NULL THEN posting_id END ORDER BY batch_date, posting_id) AS k FROM normr WHERE NOT rejected)
SELECT company_name, announcement_name, CAST(deadline AS VARCHAR) AS deadline, experience_parsed AS experience,
 salary_parsed AS annual_salary, link, array_to_string(list_sort(tags), '|') AS tags FROM cr WHERE k = 1"""

SQL["csv_rejects"] = _dw("postings_recrawl") + """
SELECT 'no date' AS reason, company, title, link FROM postings_recrawl"""

SQL["expansion_impact"] = stream_with("keywords") + thesaurus_ctes("SELECT p_name AS text FROM part", "keywords") + f""",
np AS (SELECT posting_id, lower(concat_ws(' ', coalesce(announcement_name, ''), array_to_string(tags, ' '))) AS txt FROM fact
  WHERE CAST(created_at AS TIMESTAMP) >= TIMESTAMP '1998-06-15 12:00:00' - INTERVAL 168 HOUR
  AND CAST(created_at AS TIMESTAMP) < TIMESTAMP '1998-06-15 12:00:00'),
kt AS (SELECT keyword, list_filter(string_split_regex({_strip2('keyword')}, '{WS_}+'), lambda t: t <> '') AS toks FROM keywords),
bf AS (SELECT kt.keyword, np.posting_id FROM kt JOIN np ON len(list_filter(kt.toks, lambda t: strpos(np.txt, lower(t)) > 0)) = len(kt.toks)),
af AS (SELECT exp.keyword, np.posting_id FROM exp JOIN np ON len(list_filter(exp.expanded, lambda t: strpos(np.txt, lower(t)) > 0)) > 0),
j AS (SELECT coalesce(bf.keyword, af.keyword) AS keyword, bf.posting_id AS b, af.posting_id AS a FROM bf FULL OUTER JOIN af
  ON bf.keyword = af.keyword AND bf.posting_id = af.posting_id)
SELECT keyword, count(b) AS matched_before, count(a) AS matched_after,
 sum(CASE WHEN a IS NOT NULL AND b IS NULL THEN 1 ELSE 0 END) AS new_matches,
 CASE WHEN count(b) > 0 THEN round(count(a) / count(b), 2) END AS expansion_ratio FROM j GROUP BY keyword"""

SQL["judgments_explode"] = _dw("judgments") + "SELECT query_id, doc_id, rel FROM judgments"

SQL["parse_expansion"] = RESP + f""",
us AS (SELECT conv_id, turn + 1 AS turn, regexp_extract(text, '^{WS_}*([^{WS_[1:-1]}]+)', 1) AS keyword
  FROM conversations WHERE role = 'user'),
pe AS (SELECT resp.conv_id, resp.turn, us.keyword, list_filter(list_transform(string_split({_FL('resp.response')}, ','),
  lambda t: {_ST('t')}), lambda t: length(t) BETWEEN 1 AND 20) AS items, resp.response
  FROM resp JOIN us USING (conv_id, turn) WHERE us.keyword <> ''),
pe2 AS (SELECT conv_id, turn, CASE WHEN response IS NULL THEN [keyword]
  WHEN list_contains(coalesce(items, []), keyword) THEN coalesce(items, [])
  ELSE list_concat([keyword], coalesce(items, [])) END AS terms FROM pe)
SELECT conv_id, turn, unnest(range(len(terms))) AS pos, unnest(terms) AS term FROM pe2"""

SQL["rerank_impact"] = SQL["expansion_impact"].split("\nSELECT keyword, count(b)")[0].replace(
    "j AS (SELECT coalesce", "jx AS (SELECT coalesce") + f""",
c AS (SELECT DISTINCT af.keyword, af.posting_id, (bf.posting_id IS NOT NULL) AS hit FROM af
  LEFT JOIN bf ON bf.keyword = af.keyword AND bf.posting_id = af.posting_id),
bef AS (SELECT keyword, sum(CASE WHEN hit THEN 1 ELSE 0 END) / 10.0 AS p_before FROM (
  SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY posting_id DESC) AS r FROM c) WHERE r <= 10 GROUP BY keyword),
fp AS (SELECT c.*, row_number() OVER (PARTITION BY keyword ORDER BY posting_id) AS r FROM c),
sc AS (SELECT fp.*, len(list_filter(kt.toks, lambda t: strpos(np.txt, lower(t)) > 0)) * 10.0 / len(kt.toks) AS score
  FROM fp JOIN np USING (posting_id) JOIN kt USING (keyword) WHERE fp.r <= 50),
aft AS (SELECT keyword, sum(CASE WHEN hit THEN 1 ELSE 0 END) / 10.0 AS p_after FROM (
  SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY score DESC, r) AS a FROM sc) WHERE a <= 10 GROUP BY keyword),
n AS (SELECT keyword, count(*) AS candidates FROM c GROUP BY keyword)
SELECT keyword, candidates, round(p_before, 3) AS p_before, round(p_after, 3) AS p_after,
 round(p_after - p_before, 3) AS delta FROM n JOIN bef USING (keyword) JOIN aft USING (keyword)"""

SQL["match_source_share"] = stream_with("keywords") + f""",
sq AS (SELECT keyword AS query_id, keyword, CAST(NULL AS DATE) AS min_deadline, CAST(NULL AS BIGINT) AS min_annual_salary,
  CAST(NULL AS VARCHAR) AS company_name, CAST(NULL AS BIGINT) AS max_experience, CAST(NULL AS BIGINT) AS form_code,
  CAST(NULL AS VARCHAR) AS region FROM keywords)""" + search_ctes("a_", "sq", 10, True, True) + """,
j AS (SELECT r.query_id, lower(coalesce(f.announcement_name, '')) AS title, list_transform(f.tags, lambda x: lower(x)) AS tg,
  lower(r.query_id) AS kw FROM a_res r JOIN fact f USING (posting_id) WHERE r.rank <= 10),
j2 AS (SELECT query_id, strpos(title, kw) > 0 AS it, len(list_filter(tg, lambda x: strpos(x, kw) > 0)) > 0 AS itg FROM j),
a AS (SELECT query_id, count(*) AS results, sum(CASE WHEN it THEN 1 ELSE 0 END) AS hits_name,
  sum(CASE WHEN NOT it AND itg THEN 1 ELSE 0 END) AS hits_tag_only FROM j2 GROUP BY query_id)
SELECT query_id AS keyword, results, hits_name, hits_tag_only, round(hits_name / least(10, results), 4) AS share_name,
 round((hits_name + hits_tag_only) / least(10, results), 4) AS share_any FROM a"""
SQL["alert_stream"] = SQL["alert_log"]

SQL["rule_judgments"] = SEARCH_PREFIX + search_ctes("a_", "sq", 5, True, True) + f""",
cand AS (SELECT DISTINCT r.query_id, r.posting_id, f.announcement_name AS title, f.region_name AS region,
  CASE f.form WHEN 1 THEN '정규직' WHEN 2 THEN '계약직' WHEN 3 THEN '인턴' WHEN 4 THEN '파견직' WHEN 5 THEN '프리랜서'
   WHEN 6 THEN '위촉직' WHEN 7 THEN '도급' WHEN 8 THEN '연수생' WHEN 9 THEN '병역특례' WHEN 10 THEN '아르바이트' END AS form,
  f.experience AS yrs, f.annual_salary AS sal FROM a_res r JOIN fact f USING (posting_id)),
ru AS (SELECT query_id, CASE WHEN keyword IS NULL THEN [] ELSE
   list_filter(string_split_regex({_strip2('keyword')}, '{WS_}+'), lambda t: t <> '') END AS kws,
  region, form AS req_form, max_experience, min_annual_salary FROM sq),
sc AS (SELECT c.query_id, c.posting_id,
  len(list_filter(ru.kws, lambda k: strpos(lower(coalesce(c.title, '')), lower(k)) > 0)) > 0 AS job, len(ru.kws) AS nk,
  2 - CASE WHEN ru.region IS NOT NULL AND strpos(coalesce(c.region, ''), ru.region) = 0 THEN 1 ELSE 0 END
    - CASE WHEN ru.req_form IS NOT NULL AND c.form IS DISTINCT FROM ru.req_form THEN 1 ELSE 0 END
    + CASE WHEN ru.max_experience = 0 THEN CASE WHEN c.yrs > 1 THEN -1 WHEN c.yrs IS NULL OR c.yrs = 0 THEN 1 ELSE 0 END
           WHEN ru.max_experience IS NOT NULL THEN CASE WHEN c.yrs IS NULL THEN 0 WHEN c.yrs >= ru.max_experience THEN 1
             WHEN c.yrs < ru.max_experience - 1 THEN -1 ELSE 0 END ELSE 0 END
    - CASE WHEN ru.min_annual_salary IS NOT NULL AND ru.min_annual_salary <> 0 AND c.sal IS NOT NULL
           AND c.sal < ru.min_annual_salary THEN 1 ELSE 0 END AS s
  FROM cand c JOIN ru USING (query_id))
SELECT query_id, posting_id, CAST(CASE WHEN nk > 0 AND NOT job THEN 0 ELSE greatest(0, least(3, s)) END AS INT) AS rel FROM sc"""

SQL["rerank"] = SEARCH_PREFIX + search_ctes("a_", "sq", 25, False, True) + f""",
rt AS (SELECT r.query_id, r.rank, r.posting_id, floor((r.rank - 1) / 10) AS b,
  list_filter(string_split_regex(lower(coalesce({_strip2('sq.keyword')}, '')), '{WS_}+'), lambda t: t <> '') AS toks,
  lower(concat_ws(' ', coalesce(f.announcement_name, ''), array_to_string(list_slice(coalesce(f.tags, []), 1, 5), ' '))) AS txt
  FROM a_res r JOIN fact f USING (posting_id) JOIN sq USING (query_id)),
rs AS (SELECT query_id, rank, posting_id, CASE WHEN len(toks) = 0 THEN 5.0
  ELSE 10.0 * len(list_filter(toks, lambda t: strpos(txt, t) > 0)) / len(toks) END AS score FROM rt)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank, posting_id, round(score, 9) AS score FROM rs"""

SQL["expire_fact"] = stream_with() + f"SELECT posting_id, CAST(deadline AS VARCHAR) AS deadline FROM fact WHERE deadline >= {ASOF}"
SQL["expire_notifications"] = ALERTS + f"""
SELECT user_id, posting_id FROM o_um WHERE posting_id IN (SELECT posting_id FROM fact WHERE deadline >= {ASOF})"""
SQL["profile_display"] = _dw("profiles") + """
SELECT user_id, coalesce(region, '상관없음') AS region_text, coalesce(CASE form WHEN 1 THEN '정규직' WHEN 2 THEN '계약직' WHEN 3 THEN '인턴'
  WHEN 4 THEN '파견직' WHEN 5 THEN '프리랜서' WHEN 6 THEN '위촉직' WHEN 7 THEN '도급' WHEN 8 THEN '연수생' WHEN 9 THEN '병역특례'
  WHEN 10 THEN '아르바이트' END, '상관없음') AS form_text,
 CASE WHEN max_experience IS NULL THEN '상관없음' WHEN max_experience = 0 THEN '신입' ELSE CAST(max_experience AS VARCHAR) || '년 이상' END AS experience_text,
 CASE WHEN min_salary IS NULL THEN '상관없음' ELSE CAST(min_salary AS VARCHAR) || '만원/년' END AS salary_text
FROM profiles"""
SQL["subscription_delete_all"] = _dw("subscriptions", "profiles") + """,
st AS (SELECT user_id, seq, keyword FROM subscriptions QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq) <= 5)
SELECT user_id, seq, keyword FROM st WHERE user_id NOT IN (SELECT user_id FROM profiles WHERE region IS NULL)"""
SQL["ab_overlap"] = ("SELECT query_id, count(CASE WHEN rank_a IS NOT NULL AND rank_b IS NOT NULL THEN 1 END) AS shared, "
                     "count(CASE WHEN rank_a IS NOT NULL AND rank_b IS NOT NULL THEN 1 END) / 5.0 AS overlap FROM ("
                     + SQL["ab_compare"] + ") GROUP BY query_id")
SQL["pool_modes"] = (SEARCH_PREFIX + THES + EXPQ + search_ctes("b_", "sq", 10, False, True) + search_ctes("t_", "sq", 10, True, True)
                     + expanded_ctes("e_", "eq", 10) + """,
ok3 AS (SELECT query_id FROM b_res GROUP BY query_id HAVING count(*) >= 3),
rr AS (SELECT query_id, posting_id, rank, 0 AS mo FROM b_res UNION ALL SELECT query_id, posting_id, rank, 1 FROM t_res
  UNION ALL SELECT query_id, posting_id, rank, 2 FROM e_res
  UNION ALL SELECT query_id, posting_id, rank, 3 FROM b_res WHERE query_id IN (SELECT query_id FROM ok3)
  UNION ALL SELECT query_id, posting_id, rank, 3 FROM e_res WHERE query_id NOT IN (SELECT query_id FROM ok3)),
pl AS (SELECT query_id, posting_id AS doc_id, min(mo * 1000 + rank) AS p FROM rr GROUP BY ALL)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY p) AS pool_pos, CAST(floor(p / 1000) AS INT) AS first_mode FROM pl""")
SQL["eval_summary_all"] = SQL["eval_summary"].replace("avg(", "1.0 / (SELECT count(*) FROM orders) * sum(")
SQL["unmapped_judgments"] = EV + """
SELECT query_id, doc_id FROM judgments WHERE doc_id NOT IN (SELECT doc_id FROM documents)"""
SQL["expansion_totals"] = ("SELECT count(*) AS keywords, sum(matched_before) AS matched_before, sum(matched_after) AS matched_after, "
                           "sum(new_matches) AS new_matches, CASE WHEN sum(matched_before) > 0 THEN round(sum(matched_after) / sum(matched_before), 2) "
                           "END AS expansion_ratio FROM (" + SQL["expansion_impact"] + ")")
_X = lambda pat, g=1: f"regexp_extract(html, '(?s){pat}', {g})"
_TIT = r'<td class="tplTit">\s*<strong>\s*<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
_CELL = lambda i: _ST(f"coalesce(cells[{i}], '')")
SQL["listing_fields"] = _dw("listing_rows") + f""",
lr AS (SELECT posting_id, html, regexp_extract_all(html, '(?s)<span class="cell">(.*?)</span>', 1) AS cells FROM listing_rows
  WHERE regexp_matches(html, '(?s){_TIT}'))
SELECT posting_id, {_ST(_X(_TIT, 2))} AS title, 'https://example.com' || {_X(_TIT, 1)} AS link,
 {_ST(_X('<td class="tplCo">[^<]*<a[^>]*>(.*?)</a>'))} AS company, {_CELL(1)} AS career, {_CELL(2)} AS education, {_CELL(3)} AS location,
 {_CELL(4)} AS form, {_CELL(5)} AS salary, {_CELL(6)} AS position,
 {_ST(_X('<td class="odd">.*?<span class="date[^"]*">(.*?)</span>'))} AS deadline, {_ST(_X('<p class="dsc">(.*?)</p>'))} AS description
FROM lr"""
