"""Oracle SQL for batch search (F4 and compositions)."""

from __future__ import annotations

from .base import ASOF, WS, strip


def pred(q: str = "q", p: str = "vp") -> str:
    return f"""({q}.min_deadline IS NULL OR {p}.deadline >= {q}.min_deadline)
 AND ({q}.min_annual_salary IS NULL OR {q}.min_annual_salary = 0 OR ({p}.annual_salary IS NOT NULL AND {p}.annual_salary >= {q}.min_annual_salary))
 AND ({q}.company_name IS NULL OR {p}.company_name ILIKE '%' || {q}.company_name || '%')
 AND ({q}.max_experience IS NULL OR {p}.experience IS NULL OR {p}.experience <= {q}.max_experience)
 AND ({q}.form_code IS NULL OR {p}.form = {q}.form_code)
 AND ({q}.region IS NULL OR {p}.region_name ILIKE '%' || {q}.region || '%')"""


def text_hit(term: str, p: str = "vp", use_tags: bool = True) -> str:
    name = f"{p}.announcement_name ILIKE '%' || {term} || '%'"
    if not use_tags:
        return f"({name})"
    return f"({name} OR len(list_filter({p}.tags, lambda g: g ILIKE '%' || {term} || '%')) > 0)"


def search_ctes(px: str, src: str, limit: int, use_tags: bool = True, fallback: bool = True) -> str:
    """CTEs ending in ``{px}res(query_id, rank, posting_id, mode)`` for queries ``src``."""
    thr = 3 if use_tags else 1
    return f""",
{px}q AS (SELECT *, list_filter(string_split_regex({strip('keyword')}, '{WS}+'), lambda t: t <> '') AS toks FROM {src}),
{px}vp AS (SELECT * FROM fact WHERE deadline >= {ASOF}),
{px}qt AS (SELECT query_id, len(toks) AS n, unnest(toks) AS token, unnest(range(len(toks))) AS tok_idx
  FROM {px}q WHERE keyword IS NOT NULL),
{px}hits AS (SELECT DISTINCT qt.query_id, qt.tok_idx, qt.n, vp.posting_id FROM {px}qt qt JOIN {px}vp vp
  ON {text_hit('qt.token', 'vp', use_tags)}),
{px}mc AS (SELECT query_id, posting_id, count(DISTINCT tok_idx) AS m, max(n) AS n FROM {px}hits GROUP BY ALL),
{px}okp AS (SELECT mc.query_id, mc.posting_id, mc.m, mc.n FROM {px}mc mc JOIN {px}q q USING (query_id)
  JOIN {px}vp vp USING (posting_id) WHERE {pred('q', 'vp')}),
{px}and_top AS (SELECT query_id, posting_id, row_number() OVER (PARTITION BY query_id ORDER BY posting_id DESC) AS rank
  FROM {px}okp WHERE m = n QUALIFY rank <= {limit}),
{px}fb AS (SELECT DISTINCT query_id FROM {px}qt WHERE n > 1 AND {'true' if fallback else 'false'}
  AND query_id NOT IN (SELECT query_id FROM {px}and_top GROUP BY query_id HAVING count(*) >= {thr})),
{px}or_top AS (SELECT query_id, posting_id, row_number() OVER (PARTITION BY query_id ORDER BY posting_id DESC) AS rank
  FROM {px}okp WHERE query_id IN (SELECT query_id FROM {px}fb) QUALIFY rank <= {limit}),
{px}nk AS (SELECT q.query_id, vp.posting_id, row_number() OVER (PARTITION BY q.query_id ORDER BY vp.posting_id DESC) AS rank
  FROM {px}q q JOIN {px}vp vp ON {pred('q', 'vp')} WHERE q.keyword IS NULL QUALIFY rank <= {limit}),
{px}res AS (
  SELECT query_id, rank, posting_id, 'and' AS mode FROM {px}and_top WHERE query_id NOT IN (SELECT query_id FROM {px}fb)
  UNION ALL SELECT query_id, rank, posting_id, 'or' FROM {px}or_top
  UNION ALL SELECT query_id, rank, posting_id, 'filter' FROM {px}nk)
"""


def expanded_ctes(px: str, src: str, limit: int) -> str:
    """``{px}res`` for queries ``src(..., expanded)``: OR over expanded terms, title + tags."""
    return f""",
{px}q AS (SELECT * FROM {src}),
{px}vp AS (SELECT * FROM fact WHERE deadline >= {ASOF}),
{px}qt AS (SELECT DISTINCT query_id, unnest(expanded) AS token FROM {px}q),
{px}hits AS (SELECT DISTINCT qt.query_id, vp.posting_id FROM {px}qt qt JOIN {px}vp vp ON {text_hit('qt.token', 'vp', True)}),
{px}res AS (SELECT h.query_id, row_number() OVER (PARTITION BY h.query_id ORDER BY h.posting_id DESC) AS rank,
  h.posting_id, 'expanded' AS mode FROM {px}hits h JOIN {px}q q USING (query_id) JOIN {px}vp vp USING (posting_id)
  WHERE {pred('q', 'vp')} QUALIFY rank <= {limit})
"""


def thesaurus_ctes(texts_sql: str, keywords_src: str, k: int = 3) -> str:
    """``thes(term, related, weight)`` from word co-occurrence, ``exp(keyword, expanded)``."""
    return f""",
tw AS (SELECT list_distinct(list_filter(string_split_regex({strip('text')}, '{WS}+'), lambda t: t <> '')) AS w
  FROM ({texts_sql})),
thes AS (SELECT term, related, count(*) AS weight FROM (
  SELECT term, unnest(w) AS related FROM (SELECT unnest(w) AS term, w FROM tw)) WHERE term <> related GROUP BY ALL),
ttop AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY weight DESC, related) AS r FROM thes QUALIFY r <= {k}),
ek AS (SELECT DISTINCT keyword FROM {keywords_src} WHERE keyword IS NOT NULL),
ekt AS (SELECT keyword, unnest(toks) AS term, unnest(range(len(toks))) AS tok_idx FROM (
  SELECT keyword, list_filter(string_split_regex({strip('keyword')}, '{WS}+'), lambda t: t <> '') AS toks FROM ek)),
erel AS (SELECT ekt.keyword, ttop.related, ekt.tok_idx, ttop.r FROM ekt JOIN ttop USING (term)
  WHERE length(ttop.related) BETWEEN 1 AND 20),
exp AS (SELECT ek.keyword, list_distinct(list_concat([ek.keyword], coalesce(g.rel, []))) AS expanded
  FROM ek LEFT JOIN (SELECT keyword, list(related) AS rel FROM erel GROUP BY keyword) g USING (keyword))
"""
