"""Display and crawl-side row logic (P13-P18) as column expressions and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V

DAYS_AGO = r"(?U)(\d+)\s*일\s*전\s*등록"
MONTH_DAY = r"(?U)(\d{2})/(\d{2})"


def posting_cards(results: DataFrame, fact: DataFrame, today: str, rank_col: str = "rank",
                  include_education: bool = True) -> DataFrame:
    """One multi-line card per ranked result row."""
    d = F.lit(today).cast("date")
    j = results.join(fact, "posting_id")
    lines = [
        F.concat(F.lit(V.CARD_HEAD + " ["), F.col(rank_col).cast("string"), F.lit("] "),
                 F.coalesce("announcement_name", F.lit("")), F.lit(" @ "), F.coalesce("company_name", F.lit(""))),
        F.concat(F.lit(V.CARD_EXPERIENCE), T.display_experience("experience")),
    ]
    if include_education:
        lines.append(F.concat(F.lit(V.CARD_EDUCATION), T.display_education("education")))
    lines += [
        F.concat(F.lit(V.CARD_FORM), F.coalesce(T.form_name("form"), F.lit(V.DISPLAY_FORM_MISSING))),
        F.concat(F.lit(V.CARD_SALARY), T.display_salary("annual_salary")),
        F.concat(F.lit(V.CARD_DEADLINE), T.display_deadline("deadline", d)),
        F.concat(F.lit(V.CARD_LINK + " "), F.coalesce("link", F.lit(""))),
    ]
    return j.select(*results.columns, F.concat_ws("\n", *lines).alias("card"))


def listing_fields(rows: DataFrame, site: str, html_col: str = "html") -> DataFrame:
    """A listing row's fields: title, absolute link, company, the six cells by
    position (career, education, location, form, salary, position; missing ones empty),
    deadline and description.  Rows without a title link or a company are skipped."""
    html = F.col(html_col)

    def one(pattern: str, group: int = 1):
        return F.regexp_extract(html, "(?s)" + pattern, group)

    title = r'<td class="tplTit">\s*<strong>\s*<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
    company = r'<td class="tplCo">\s*<a\b[^>]*>(.*?)</a>'
    cells = F.regexp_extract_all(html, F.lit(r'(?s)<span class="cell">(.*?)</span>'), 1)
    names = ["career", "education", "location", "form", "salary", "position"]
    found = rows.where(html.rlike("(?s)" + title) & html.rlike("(?s)" + company))
    return found.select(
        *[c for c in rows.columns if c != html_col], T.strip(one(title, 2)).alias("title"),
        F.concat(F.lit(site), one(title, 1)).alias("link"), T.strip(one(company)).alias("company"),
        *[T.strip(F.coalesce(F.get(cells, F.lit(i)), F.lit(""))).alias(n) for i, n in enumerate(names)],
        T.strip(one(r'<td class="odd">.*?<span class="date[^"]*">(.*?)</span>')).alias("deadline"),
        T.strip(one(r'<p class="dsc">(.*?)</p>')).alias("description"))


def posted_within(time_text, today, days: int):
    """P16 predicate: minutes/hours ago -> true; 'N일 전 등록' -> N <= days; 'MM/DD'
    -> age in days <= days (a future date means last year); anything else false."""
    t = T.col_(time_text)
    today = T.col_(today)
    n = T.blank_to_null(F.regexp_extract(t, DAYS_AGO, 1)).try_cast("bigint")
    mm = F.regexp_extract(t, MONTH_DAY, 1)
    dd = F.regexp_extract(t, MONTH_DAY, 2)
    this_year = F.try_to_date(F.concat(F.year(today).cast("string"), F.lit("-"), mm, F.lit("-"), dd), "yyyy-MM-dd")
    last_year = F.try_to_date(F.concat((F.year(today) - 1).cast("string"), F.lit("-"), mm, F.lit("-"), dd),
                              "yyyy-MM-dd")
    posted = F.when(this_year > today, last_year).otherwise(this_year)
    return (F.when(t.contains(V.RECENT_MINUTES) | t.contains(V.RECENT_HOURS), F.lit(True))
            .when(n.isNotNull(), n <= days)
            .when(t.rlike(MONTH_DAY), F.coalesce(F.datediff(today, posted) <= days, F.lit(False)))
            .otherwise(F.lit(False)))


def crawl_prefix(rows: DataFrame, run_col: str, pos_col: str, fresh_col: str) -> DataFrame:
    """Per crawl run (rows newest first by ``pos_col``), keep the rows before the
    first stale one.  The first stale position per run is an aggregate (partial
    aggregation first), then a join: no window over a whole run."""
    first_stale = (rows.where(~F.col(fresh_col)).groupBy(run_col)
                   .agg(F.min(pos_col).alias("_stop")))
    return (rows.join(first_stale, run_col, "left")
            .where(F.col("_stop").isNull() | (F.col(pos_col) < F.col("_stop"))).drop("_stop"))


TITLE = r"(?s)<title>(.*?)</title>"
H1 = r"(?s)<h1>(.*?)</h1>"
CANONICAL = r'(?s)<link rel="canonical" href="([^"]*)"'
ARTICLE = r"(?s)<article>(.*?)</article>"
TAG = r"<[^>]*>"


def page_fields(pages: DataFrame) -> DataFrame:
    """Fields of stored pages; a missing field is ''.  The whole html is read."""
    art = F.regexp_extract("html", ARTICLE, 1)
    text = T.strip(F.regexp_replace(F.regexp_replace(art, TAG, " "), r"(?U)\s+", " "))
    return pages.select(
        "page_id",
        T.strip(F.regexp_extract("html", TITLE, 1)).alias("title"),
        T.strip(F.regexp_extract("html", H1, 1)).alias("heading"),
        F.coalesce(T.blank_to_null(F.regexp_extract("html", CANONICAL, 1)), F.col("url")).alias("link"),
        text.alias("article_text"),
        F.size(F.split(text, " ")).alias("n_words"),
    )
