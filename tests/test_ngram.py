"""The n-gram candidate join returns exactly what the scan returns."""

from pyspark.sql import functions as F

from hirelake.operators import ngram
from hirelake.session import scratch

PATTERNS = ["ring", "r", "ec%my", "b_ss", "%", "zz", "RED", "e", "_", "anvil medium", "가나", "", "__", "%_%",
            r"100\%", r"a\%b", r"a\b", r"a\\b", "b\\", r"\_x", r"\\", "\\", "É"]
TEXTS = ["100% pay", "a%b", "axb", r"a\b", "ab", "b%", "_x", "", "\\", "école", "100x pay", None]


def test_ngram_equals_scan(spark):
    texts = (spark.read.parquet("/root/testdata/sf0.001/part.parquet")
             .select(F.col("p_partkey").alias("tid"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text")))
    texts = texts.unionByName(spark.createDataFrame([(1_000_000 + i, t) for i, t in enumerate(TEXTS)], "tid bigint, text string"))
    pats = spark.createDataFrame(list(enumerate(PATTERNS)), "pid int, pattern string")
    a = {tuple(r) for r in ngram.scan_pairs(pats, texts).collect()}
    b = {tuple(r) for r in ngram.ngram_pairs(pats, texts).collect()}
    assert a == b and len(a) > 0
    stored = ngram.store_index(ngram.gram_index(texts, "tid", "text"), scratch(spark, "test-index"))
    c = {tuple(r) for r in ngram.ngram_pairs(pats, texts, stored).collect()}
    assert a == c
    found = {p: {TEXTS[t - 1_000_000] for q, t in a if PATTERNS[q] == p and t >= 1_000_000} for p in PATTERNS}
    assert found[r"100\%"] == {"100% pay"} and found[r"a\%b"] == {"a%b"} and found[r"a\b"] == {"ab"}
    assert found[r"a\\b"] == {r"a\b"} and found["b\\"] == {"b%"} and found[""] == set(TEXTS) - {None}
    assert found["__"] == {t for t in TEXTS if t and len(t) > 1} and found["É"] == {"école"}


def test_literal_mode(spark):
    texts = spark.createDataFrame([(1, "a%b"), (2, "axb")], "tid int, text string")
    pats = spark.createDataFrame([(0, "%")], "pid int, pattern string")
    lit = {tuple(r) for r in ngram.ngram_pairs(pats, texts, literal=True).collect()}
    assert lit == {(0, 1)}


def test_appended_batches_and_odd_ids(spark):
    """Ids of any sign on both sides of a block's edge, arrays of texts, an index that grew
    in two appends: equal to the scan, and the first batch's files are left as they were."""
    import os
    ids = [0, 1, -1, 5, 32767, 32768, 32769, 65536, 65537, -32767, -32768, -32769, 10**12, None]
    rows = [(i, [f"red {j} ring", "Blue%" if j % 2 else "x"]) for j, i in enumerate(ids)]
    a = spark.createDataFrame(rows[:7], "tid bigint, text array<string>")
    b = spark.createDataFrame(rows[7:] + [(5, ["green ring"])], "tid bigint, text array<string>")
    path = scratch(spark, "grown-index")
    local = path.removeprefix("file:")
    ngram.store_index(ngram.gram_index(a, "tid", "text"), path)
    before = {f for _, _, files in os.walk(local) for f in files if f.startswith("part-")}
    index = ngram.append_index(ngram.gram_index(b, "tid", "text"), path)
    assert before < {f for _, _, files in os.walk(local) for f in files if f.startswith("part-")}
    texts = a.unionByName(b)
    pats = spark.createDataFrame(list(enumerate(["ring", "red 3", "d 1", r"e\%", "e%g", "green", "nothing", "_", "x"])), "pid int, pattern string")
    want = {tuple(r) for r in ngram.scan_pairs(pats, texts.where("tid is not null")).collect()}
    assert {tuple(r) for r in ngram.ngram_pairs(pats, texts.where("tid is not null"), index).collect()} == want
    assert len({t for p, t in want if p == 0}) == 13


def test_large_pattern_tables_are_shuffled(spark, monkeypatch):
    texts = spark.range(70_000).selectExpr("id as tid", "concat('w', id % 97, ' v', id % 89) as text")
    pats = spark.createDataFrame([(i, f"w{i} v{i % 7}") for i in range(40)], "pid int, pattern string")
    want = {tuple(r) for r in ngram.scan_pairs(pats, texts).collect()}
    assert {tuple(r) for r in ngram.ngram_pairs(pats, texts).collect()} == want
    monkeypatch.setattr(ngram, "BROADCAST_PATTERNS", 3)
    monkeypatch.setattr(ngram, "BROADCAST_PAIRS", 3)
    assert {tuple(r) for r in ngram.ngram_pairs(pats, texts).collect()} == want
