"""Query understanding (F1, F2): free text -> structured filter columns.

Seven ordered stages share a ``rem`` (remaining text) column; each stage is one
projection of native expressions, so a batch of millions of queries parses inside
whole-stage codegen with no Python.  "Replace once" is a splice at ``instr`` of the
matched text (Spark's ``replace``/``regexp_replace`` change every occurrence); a
regex's leftmost match always starts at the first occurrence of its matched text, so
the splice removes exactly the regex match.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab as V

EXP_CAREER = r"(?U)(경력\s*(\d+)\s*년\s*(?:이상|차)?)"
EXP_YEARS = r"(?U)((\d+)\s*년\s*(?:이상|차))"
SAL_EOK = r"(?U)((\d+)\s*억\s*(?:(\d+)\s*천\s*만\s*원?)?)"
SAL_CHEON = r"(?U)((\d+)\s*천\s*만\s*원)"
SAL_MAN = r"(?U)((\d+)\s*만\s*원)"
SAL_WORD = r"(?U)(연봉\s*(\d+))"
THIS_MONTH = r"(?U)(이번\s*달)"
NEXT_MONTH = r"(?U)(다음\s*달)"
MONTH_N = r"(?U)((\d{1,2})\s*월)"
COMPANY = r"(?U)^(\S+)\s+(?:공고|채용)"


def _splice(rem: Column, hit: Column, repl: str) -> Column:
    """Replace the first occurrence of ``hit`` in ``rem`` by ``repl`` (hit null -> rem)."""
    i = F.instr(rem, hit)
    out = F.concat(F.substring(rem, F.lit(1), i - 1), F.lit(repl),
                   F.substring(rem, i + F.length(hit), F.lit(1 << 30)))
    return F.when(hit.isNull() | (i == 0), rem).otherwise(out)


def _first_contained(rem: Column, words) -> Column:
    out = F.lit(None).cast("string")
    for w in reversed(list(words)):
        out = F.when(rem.contains(w), F.lit(w)).otherwise(out)
    return out


def first_contained(texts: DataFrame, text_col: str, words: DataFrame) -> DataFrame:
    """(text, word): for each distinct text that contains a word of ``words(word, ord)``, the
    contained word with the least ``ord``.

    A dictionary join: the substrings of a text that have the length of some word, once
    each, meet the words by equality, so a vocabulary of any size is one hash join and
    never a literal in the plan.  Only the distinct word lengths come to the driver.
    Null and empty words are void."""
    words = words.where(F.length("word") > 0).groupBy("word").agg(F.min("ord").alias("ord"))
    lengths = sorted(r[0] for r in words.select(F.length("word")).distinct().collect())
    text = F.col("text")

    def cut(n: int) -> Column:
        last = F.length(text) - n + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))

    none = F.array().cast("array<string>")
    pieces = F.array_distinct(F.concat(none, *(F.coalesce(cut(n), none) for n in lengths)))
    grams = texts.select(F.col(text_col).alias("text")).distinct().select("text", F.explode(pieces).alias("word"))
    return grams.join(words, "word").groupBy("text").agg(F.min_by("word", "ord").alias("word"))


def _hit(rem: Column, pattern: str, group: int = 1) -> Column:
    return T.blank_to_null(F.regexp_extract(rem, pattern, group))


def _num(rem: Column, pattern: str, group: int) -> Column:
    return T.blank_to_null(F.regexp_extract(rem, pattern, group)).try_cast("bigint")


def normalize_query(text) -> Column:
    """token-exact synonym rewrite, rejoined with single spaces."""
    syn = F.create_map(*[x for k, v in V.QUERY_SYNONYMS for x in (F.lit(k), F.lit(v))])
    toks = F.filter(F.split(T.strip(text), T.WS_RUN), lambda t: t != "")
    return F.array_join(F.transform(toks, lambda t: F.coalesce(F.try_element_at(syn, t), t)), " ")


def parse_queries(queries: DataFrame, as_of: str, regions=None, form_keywords=None,
                  stopwords=None, job_keywords=None, text_col: str = "text",
                  materialize: bool = True) -> DataFrame:
    """F2 on a table of queries; adds keyword, region, form, form_code, max_experience,
    min_annual_salary, min_deadline, company_name and ``error`` (a month that does
    not exist; such a query cannot run).

    The stages nest ``rem`` expressions; a later filter on an output column would be
    pushed through every stage and inline them all.  With ``materialize`` (default)
    the parsed batch is checkpointed to the session's checkpoint folder, which cuts
    the lineage (a query batch is small next to the postings it searches).

    ``regions`` is a list, or a table (word, ord) whose least ``ord`` wins;
    ``job_keywords`` is a list, or a table (word) that adds to the fixed job words.  Tables
    are joined, so they may be of any size; the batch is checkpointed once more for that.
    """
    tables = [x.select("word") for x in (regions, job_keywords) if isinstance(x, DataFrame)]
    region_table = regions if isinstance(regions, DataFrame) else None
    regions = [] if region_table is not None else regions
    job_keywords = None if isinstance(job_keywords, DataFrame) else job_keywords
    regions = V.REGIONS if regions is None else regions
    form_keywords = V.FORM_KEYWORDS if form_keywords is None else form_keywords
    stopwords = V.STOPWORDS if stopwords is None else stopwords
    job_keywords = V.JOB_KEYWORDS if job_keywords is None else job_keywords
    today = F.lit(as_of).cast("date")
    cols = [c for c in queries.columns]
    rem = F.col("_rem")

    df = queries.withColumn("_rem", normalize_query(F.col(text_col)))
    # (1) region, (2) employment type: first vocabulary word contained, replaced by a space
    if region_table is None:
        df = df.withColumn("region", _first_contained(rem, regions))
    else:
        found = first_contained(df, "_rem", region_table).select(F.col("text").alias("_rem"), F.col("word").alias("region"))
        df = df.join(found, "_rem", "left")
    df = df.withColumn("_rem", _splice(rem, F.col("region"), " "))
    df = df.withColumn("form", _first_contained(rem, form_keywords))
    df = df.withColumn("_rem", _splice(rem, F.col("form"), " "))
    # (3) experience
    df = df.withColumn("_e1", _hit(rem, EXP_CAREER)).withColumn("_e2", _hit(rem, EXP_YEARS))
    new = rem.contains("신입")
    df = df.withColumn("max_experience",
                       F.when(new, F.lit(0).cast("bigint"))
                       .when(F.col("_e1").isNotNull(), _num(rem, EXP_CAREER, 2))
                       .when(F.col("_e2").isNotNull(), _num(rem, EXP_YEARS, 2)))
    df = df.withColumn("_rem", F.when(new, _splice(rem, F.lit("신입"), " "))
                       .when(F.col("_e1").isNotNull(), _splice(rem, F.col("_e1"), ""))
                       .otherwise(_splice(rem, F.col("_e2"), "")))
    # (4) salary
    df = df.select("*", _hit(rem, SAL_EOK).alias("_s1"), _hit(rem, SAL_CHEON).alias("_s2"),
                   _hit(rem, SAL_MAN).alias("_s3"), _hit(rem, SAL_WORD).alias("_s4"))
    eok = F.try_add(F.try_multiply(_num(rem, SAL_EOK, 2), F.lit(10000)),
                    F.coalesce(F.try_multiply(_num(rem, SAL_EOK, 3), F.lit(1000)), F.lit(0)))
    df = df.withColumn("min_annual_salary",
                       F.when(F.col("_s1").isNotNull(), eok)
                       .when(F.col("_s2").isNotNull(), F.try_multiply(_num(rem, SAL_CHEON, 2), F.lit(1000)))
                       .when(F.col("_s3").isNotNull(), _num(rem, SAL_MAN, 2))
                       .when(F.col("_s4").isNotNull(), _num(rem, SAL_WORD, 2)))
    sal_hit = F.coalesce("_s1", "_s2", "_s3", "_s4")
    df = df.withColumn("_rem", _splice(rem, sal_hit, ""))
    # (5) deadline
    df = df.select("*", _hit(rem, THIS_MONTH).alias("_d2"), _hit(rem, NEXT_MONTH).alias("_d3"),
                   _hit(rem, MONTH_N).alias("_d4"), _num(rem, MONTH_N, 2).alias("_mon"))
    today_hit = rem.contains("오늘")
    month_ok = F.col("_mon").between(1, 12)
    month_year = F.when(F.col("_mon") >= F.month(today), F.year(today)).otherwise(F.year(today) + 1)
    month_date = F.when(month_ok, F.make_date(month_year, F.col("_mon").cast("int"), F.lit(1)))
    df = df.withColumn("min_deadline",
                       F.when(today_hit, today)
                       .when(F.col("_d2").isNotNull(), F.trunc(today, "month"))
                       .when(F.col("_d3").isNotNull(), F.add_months(F.trunc(today, "month"), 1))
                       .when(F.col("_d4").isNotNull(), month_date))
    df = df.withColumn("error", ~today_hit & F.col("_d2").isNull() & F.col("_d3").isNull()
                       & F.col("_d4").isNotNull() & ~month_ok)
    df = df.withColumn("_rem", F.when(today_hit, _splice(rem, F.lit("오늘"), " "))
                       .when(F.col("_d2").isNotNull(), _splice(rem, F.col("_d2"), " "))
                       .when(F.col("_d3").isNotNull(), _splice(rem, F.col("_d3"), " "))
                       .otherwise(_splice(rem, F.col("_d4"), "")))
    # (6) company: "<word> 공고|채용" at the start of the stripped rest
    blocked = list(dict.fromkeys(list(regions) + list(form_keywords) + V.EXPERIENCE_WORDS
                                 + list(job_keywords) + list(stopwords)))
    cand = _hit(T.strip(rem), COMPANY)
    is_company = cand.isNotNull() & ~F.array_contains(F.array(*[F.lit(w) for w in blocked]), cand)
    if tables:
        words = reduce(DataFrame.unionByName, tables).distinct().select(F.col("word").alias("_word"), F.lit(True).alias("_blocked"))
        # most texts name no company: they join by their own text, not on one null key; the
        # key is checkpointed, else the join's null check would inline all stages again
        df = _cut(df.withColumn("_key", F.coalesce(cand, F.concat(F.lit("\u0000"), rem))))
        df = df.join(words, F.col("_key") == F.col("_word"), "left")
        is_company = is_company & F.col("_blocked").isNull()
    df = df.withColumn("company_name", F.when(is_company, cand))
    df = df.withColumn("_rem", _splice(rem, F.col("company_name"), " "))
    # (7) keyword: remaining tokens minus stopwords
    stop = F.array(*[F.lit(w) for w in stopwords])
    toks = F.filter(F.split(T.strip(rem), T.WS_RUN), lambda t: (t != "") & ~F.array_contains(stop, t))
    df = df.withColumn("keyword", T.blank_to_null(F.array_join(toks, " ")))
    df = df.withColumn("form_code", T.parse_form(F.coalesce(F.col("form"), F.lit(""))))
    out = df.select(*cols, "keyword", "region", "form", "form_code", "max_experience",
                    "min_annual_salary", "min_deadline", "company_name", "error")
    return _cut(out) if materialize else out


def _cut(df: DataFrame) -> DataFrame:
    from ..session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
