"""Bridge from the driver's TPC-H-like tables to the posting domain.

Each view is one SQL template over ``{table}`` placeholders.  The same text runs in
Spark (the placeholders become DataFrames through ``spark.sql(..., **frames)``) and in
DuckDB (the placeholders become the pre-registered view names), so inputs are
identical on both sides of the correctness check.  Nothing here is an operator: these
are test inputs derived from the given tables, and their size grows with them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# reference date for validity checks on the fixtures
AS_OF = "1998-06-15"
# "now" for the 24-hour new-postings window
AS_OF_TS = "1998-06-15 12:00:00"

POSTINGS_RAW = """
SELECT o.o_orderkey AS posting_id, CAST(o.o_orderdate AS DATE) AS batch_date, o.o_orderdate AS created_at,
 o.o_custkey AS company_key, c.c_name AS company, p.p_name || ' ' || p.p_type AS title,
 CASE o.o_orderkey % 6 WHEN 0 THEN '신입' WHEN 1 THEN '경력무관' WHEN 2 THEN '경력 ' || CAST(o.o_orderkey % 40 AS VARCHAR(20)) || '년↑' WHEN 3 THEN '신입·경력' WHEN 4 THEN '' ELSE '경력' || CAST(o.o_orderkey % 12 AS VARCHAR(20)) || '년' END AS career_raw,
 CASE o.o_orderkey % 7 WHEN 0 THEN '학력무관' WHEN 1 THEN '고졸↑' WHEN 2 THEN '초대졸↑' WHEN 3 THEN ' 대졸↑ ' WHEN 4 THEN '석사↑' WHEN 5 THEN '박사↑' ELSE '대졸' END AS education_raw,
 CASE o.o_orderkey % 9 WHEN 0 THEN '정규직' WHEN 1 THEN '계약직·정규직' WHEN 2 THEN '인턴' WHEN 3 THEN '개인사업자' WHEN 4 THEN '교육생' WHEN 5 THEN '3000만원' WHEN 6 THEN '아르바이트' WHEN 7 THEN '기타' ELSE '파견직' END AS form_raw,
 CASE WHEN o.o_orderkey % 13 = 0 THEN '정규직' WHEN o.o_orderkey % 4 = 0 THEN replace(r.r_name, ' ', '_') || ' ' || n.n_name || ' 외' WHEN o.o_orderkey % 11 = 0 THEN replace(r.r_name, ' ', '_') ELSE replace(r.r_name, ' ', '_') || ' ' || n.n_name END AS location_raw,
 CASE o.o_orderkey % 6 WHEN 0 THEN '월급 ' || CAST(20 + o.o_orderkey % 500 AS VARCHAR(20)) || '만원' WHEN 1 THEN '3,' || CAST(200 + o.o_orderkey % 700 AS VARCHAR(20)) || '만원' WHEN 2 THEN '일급 12만원' WHEN 3 THEN '협의' WHEN 4 THEN CAST(CAST(floor(o.o_totalprice) AS BIGINT) AS VARCHAR(20)) || '만원/년' ELSE CAST(2400 + o.o_orderkey % 5000 AS VARCHAR(20)) || '~9000만원' END AS salary_raw,
 CASE WHEN o.o_orderkey % 64 = 7 THEN '~02/30(월)' WHEN o.o_orderkey % 8 = 0 THEN '오늘마감' WHEN o.o_orderkey % 8 = 1 THEN '내일마감' WHEN o.o_orderkey % 8 = 2 THEN '모레마감' WHEN o.o_orderkey % 8 = 3 THEN '상시채용' ELSE '~' || lpad(CAST(1 + o.o_orderkey % 12 AS VARCHAR(20)), 2, '0') || '/' || lpad(CAST(1 + o.o_orderkey % 28 AS VARCHAR(20)), 2, '0') || '(화)' END AS deadline_raw,
 'Vue, JAVA, ' || p.p_brand || ',, ' || p.p_type AS description_raw, p.p_type || '·' || p.p_name AS position_raw,
 'https://example.com/p/' || CAST(o.o_orderkey AS VARCHAR(20)) AS link
FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey JOIN {nation} n ON n.n_nationkey = c.c_nationkey JOIN {region} r ON r.r_regionkey = n.n_regionkey
JOIN (SELECT l_orderkey, MIN(l_partkey) AS pk FROM {lineitem} GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey JOIN {part} p ON p.p_partkey = l.pk
"""

# same natural key as every ninth posting, arriving later with a different salary
POSTINGS_RECRAWL = """
SELECT posting_id + 10000000 AS posting_id, batch_date, created_at, company_key, company, title,
 career_raw, education_raw, form_raw, location_raw, '협의' AS salary_raw, deadline_raw,
 description_raw, position_raw, link
FROM {postings_raw} b WHERE posting_id % 9 = 0
"""

QUERY_LOG = """
SELECT c_custkey AS query_id,
 CASE c_custkey % 4 WHEN 0 THEN '' ELSE replace(r_name,' ','_') || ' ' END
 || CASE c_custkey % 6 WHEN 0 THEN 'red ring' WHEN 1 THEN 'small' WHEN 2 THEN 'hot plate' WHEN 3 THEN 'anvil ECONOMY' WHEN 4 THEN 'gadget' ELSE 'blue zzz' END
 || CASE c_custkey % 5 WHEN 0 THEN ' 정규직' WHEN 1 THEN ' 신입' WHEN 2 THEN ' 경력 3년 이상' ELSE '' END
 || CASE c_custkey % 7 WHEN 0 THEN ' 연봉 4천만원 이상' WHEN 1 THEN ' 연봉 1억 5천만원' WHEN 2 THEN ' 연봉 3000' ELSE '' END
 || ' 공고 보여줘' AS text
FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey JOIN {region} ON r_regionkey = n_regionkey
"""

# the region vocabulary of the fixture queries (parameter of query parsing)
REGION_VOCAB = "SELECT DISTINCT replace(r_name, ' ', '_') AS name FROM {region}"

PROFILES = """
SELECT CAST(c_custkey AS VARCHAR(20)) AS user_id,
 CASE WHEN c_custkey % 30 = 0 THEN NULL ELSE replace(r_name,' ','_') END AS region,
 CASE WHEN c_custkey % 20 = 0 THEN 1 + c_custkey % 7 END AS form,
 CASE WHEN c_custkey % 40 <> 0 THEN c_custkey % 12 END AS max_experience,
 CASE WHEN c_custkey % 50 <> 0 THEN 2000 + c_custkey % 3000 END AS min_salary
FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey JOIN {region} ON r_regionkey = n_regionkey
"""

SUBSCRIPTIONS = """
SELECT CAST(c_custkey AS VARCHAR(20)) AS user_id, k AS seq,
 CASE (c_custkey + k) % 5 WHEN 0 THEN 'red' WHEN 1 THEN 'ring' WHEN 2 THEN 'hot plate' WHEN 3 THEN 'ECONOMY' END AS keyword
FROM {customer} CROSS JOIN (VALUES (1),(2),(3),(4),(5),(6),(7)) v(k)
WHERE k <= 1 + c_custkey % 7
"""

RUNS = """
SELECT l_orderkey AS query_id, l_returnflag AS mode, l_partkey AS doc_id,
 row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY p DESC, l_partkey) AS rank
FROM (SELECT l_orderkey, l_returnflag, l_partkey, max(l_extendedprice) AS p FROM {lineitem} GROUP BY 1, 2, 3) t
"""

JUDGMENTS = """
SELECT l_orderkey AS query_id, l_partkey AS doc_id, min(CAST((l_partkey + l_orderkey) % 4 AS INT)) AS rel
FROM {lineitem} WHERE l_partkey % 5 <> 0 GROUP BY 1, 2
"""

# a bigger tag bridge: every line of an order tags its posting with brand and type
LINE_TAGS = """
SELECT DISTINCT l_orderkey AS posting_id, t AS tag
FROM (SELECT l.l_orderkey, p.p_brand AS t FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey
      UNION ALL
      SELECT l.l_orderkey, p.p_type AS t FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey) x
"""

# keywords for per-keyword aggregates: part types and the words of part names
KEYWORDS = """
SELECT DISTINCT keyword FROM (
 SELECT p_type AS keyword FROM {part}
 UNION ALL SELECT split_part(p_name, ' ', 1) FROM {part}
 UNION ALL SELECT split_part(p_name, ' ', 2) FROM {part}) k
"""

# the selective half of a keyword benchmark: the 50 titles that fewest parts carry
SELECTIVE_KEYWORDS = """
SELECT p_name || ' ' || p_type AS keyword FROM {part} GROUP BY 1 ORDER BY count(*), 1 LIMIT 50
"""

# stand-in model responses: score lists with full-width commas, words, too few and too
# many values and a second line; judgments as a digit in some text, blank or missing
SCORE_RESPONSES = """
SELECT conv_id, turn, CAST(length(text) % 11 AS VARCHAR(20)) || ', ' || CAST(conv_id % 7 AS VARCHAR(20)) || '.5，' || split_part(text, ' ', 1)
 || ', ' || CAST(turn AS VARCHAR(20)) || CASE WHEN conv_id % 3 = 0 THEN ', 1, 2, 3, 4, 5, 6, 7, 8, 9, 10' ELSE '' END || chr(10) || '9, 9' AS response
FROM {conversations} WHERE role = 'assistant'
"""

JUDGE_RESPONSES = """
SELECT l_orderkey AS query_id, l_partkey AS doc_id,
 min(CASE (l_orderkey * 7 + l_partkey) % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'none' WHEN 3 THEN ' none, so 2'
  ELSE ' ' || CAST((l_orderkey + l_partkey) % 6 AS VARCHAR(20)) || ' of 3' END) AS response
FROM {lineitem} GROUP BY 1, 2
"""

# listing rows as a crawl would keep them: cells may be missing at the end, and some rows
# lack the elements a posting needs
LISTING_ROWS = """
SELECT posting_id, '<tr class="row"><td class="tplCo"><a href="/co/' || CAST(company_key AS VARCHAR(20)) || '"> ' || company || ' </a></td>'
 || CASE WHEN posting_id % 17 = 0 THEN '<td class="tplTit">' ELSE '<td class="tplTit"><strong><a class="link" href="/p/' || CAST(posting_id AS VARCHAR(20)) || '">' || title || ' </a></strong>' END
 || '<p class="etc"><span class="cell">' || career_raw || '</span><span class="cell">' || education_raw || '</span>'
 || CASE WHEN posting_id % 5 = 0 THEN '' ELSE '<span class="cell">' || location_raw || '</span><span class="cell">' || form_raw || '</span><span class="cell">' || salary_raw || '</span>' END
 || CASE WHEN posting_id % 3 = 0 THEN '' ELSE '<span class="cell">' || position_raw || '</span>' END
 || '</p>' || CASE WHEN posting_id % 4 = 0 THEN '' ELSE '<p class="dsc">' || description_raw || '</p>' END || '</td>'
 || CASE WHEN posting_id % 7 = 0 THEN '' ELSE '<td class="odd"><span class="date dotum">' || deadline_raw || '</span></td>' END || '</tr>' AS html
FROM {postings_raw}
"""

VIEWS = {
    "listing_rows": LISTING_ROWS,
    "score_responses": SCORE_RESPONSES,
    "judge_responses": JUDGE_RESPONSES,
    "keywords": KEYWORDS,
    "selective_keywords": SELECTIVE_KEYWORDS,
    "postings_raw": POSTINGS_RAW,
    "postings_recrawl": POSTINGS_RECRAWL,
    "query_log": QUERY_LOG,
    "region_vocab": REGION_VOCAB,
    "profiles": PROFILES,
    "subscriptions": SUBSCRIPTIONS,
    "runs": RUNS,
    "judgments": JUDGMENTS,
    "line_tags": LINE_TAGS,
}

_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def _deps(name: str) -> list[str]:
    return _PLACEHOLDER.findall(VIEWS[name])


def duck_view(name: str) -> str:
    """The view body as DuckDB SQL (placeholders become plain table / CTE names)."""
    return _PLACEHOLDER.sub(lambda m: m.group(1), VIEWS[name])


def duck_with(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` prefix for an oracle query; dependencies first."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in _deps(n):
            if d in VIEWS:
                visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        if n in VIEWS:      # driver tables are already registered
            visit(n)
    parts = [f"{n} AS ({duck_view(n)})" for n in order] or ["_none AS (SELECT 1)"]
    return "WITH " + ",\n".join(parts) + "\n"


class Tables:
    """Lazy access to the driver tables and the bridge views of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name in VIEWS:
                frames = {d: self[d] for d in set(_deps(name))}
                self._cache[name] = self.spark.sql(VIEWS[name], **frames)
            else:
                self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[name]

    def dealt(self, name: str, key: str, rows: int = 500_000) -> "Tables":
        """These tables with ``name`` dealt out by ``key``, about ``rows`` rows to a task: views
        grouped by ``key`` and more columns are made where the rows are, however many."""
        out = Tables(self.spark, self.sf_dir)
        out._cache[name] = self[name].repartition(max(1, -(-self[name].count() // rows)), key)
        return out

    def postings_stream(self) -> DataFrame:
        """Base crawl plus the later re-crawl (same natural keys, later ordinals)."""
        return self["postings_raw"].unionByName(self["postings_recrawl"])
