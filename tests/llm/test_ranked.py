"""Ranked search against scores of every document, and the SQL statement."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from hirelake.llm import ranked as R

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return TERM.findall((t or "").translate(LOWER))


def brute(docs, items, k):
    held = [(i, w) for i, t in docs if (w := words(t))]
    n, total = len(held), sum(len(w) for _, w in held)
    df = Counter(x for _, w in held for x in set(w))
    out = []
    for item, text in sorted({(i, t) for i, t in items if t is not None}, key=repr):
        asked, found = Counter(words(text)), []
        for i, w in held:
            tf, m = Counter(w), 25 + 75 * len(w) * n // total
            score = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (1_000_000_000 * tf[x] // (1000 * tf[x] + 8 * m)) for x, c in asked.items() if x in tf)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, item_id string").repartition(5)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id int, text string, doc_id int")
    return sorted((tuple(r) for r in R.rank(d, q, **more).collect()), key=repr)


def corpus(seed, n=300):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["É", "été", "a1", "日本", "Z"]
    pick = lambda k: " ".join(vocab[min(int(rnd.paretovariate(0.6)) - 1, len(vocab) - 1)] + rnd.choice(["", ",", ".", "\n", "!"]) for _ in range(k))
    docs = [(i, pick(rnd.choice([1, 3, 10, 40, 200]))) for i in range(n)]
    docs += [(1000 + i, docs[7][1]) for i in range(80)]  # a large group of copies: ties
    docs += [(None, docs[7][1]), (None, docs[8][1]), (5, docs[9][1]), (5, docs[9][1]), (2000, None), (2001, ""), (2002, "!!! ..."), (2003, pick(5000))]
    rnd.shuffle(docs)
    items = [(i, pick(rnd.randint(1, 30))) for i in range(12)] + [(50, docs[0][1]), (51, None), (52, ""), (53, "unknownword"), (54, "w0"), (54, "w1 w1 W1"), (55, "w0 w0"), (55, "w0 w0")]
    items.append((60, next(t for i, t in docs if i == 1000)))
    return docs, items


@pytest.mark.parametrize("segment", [50, 700, 1 << 20])
def test_equals_scoring_every_document(spark, segment):
    docs, items = corpus(segment)
    assert run(spark, docs, items, segment=segment) == brute(docs, items, 10)


def test_blocks_of_items_and_other_k(spark):
    docs, items = corpus(2)
    assert run(spark, docs, items, block_bytes=120, k=3) == brute(docs, items, 3)
    assert run(spark, docs, items, k=500) == brute(docs, items, 500)


def test_empty_tables_and_items_without_terms(spark):
    docs, items = corpus(3)
    assert run(spark, [], items) == [] and run(spark, docs, []) == []
    assert run(spark, docs, [(1, None), (2, "."), (3, "nosuchword")]) == []
    assert run(spark, [(1, None), (2, "")], items) == []


def test_sparse_table():
    rnd = np.random.default_rng(1)
    v = rnd.integers(0, 50, 333)
    table = R.sparse_table(v, len(v))
    lo, hi = rnd.integers(0, 333, 2000), rnd.integers(0, 334, 2000)
    lo, hi = np.minimum(lo, hi), np.maximum(lo, hi)
    at = R.range_max(table, v, lo, hi)
    for a, b, p in zip(lo, hi, at):
        assert a == b or a <= p < b and v[p] == v[a:b].max()


def test_prunes():
    """An item's search scores a small part of the documents."""
    rnd = random.Random(9)
    n, vocab = 4000, 3000
    ids = np.arange(n)
    bags = [Counter(min(int(rnd.paretovariate(0.5)), vocab) - 1 for _ in range(60)) for _ in range(n)]
    seg = R.Segment(ids, np.full(n, 100), np.array([len(b) for b in bags]), np.array([t for b in bags for t in b]), np.array([c for b in bags for c in b.values()]), vocab)
    looked = []
    table = R.range_max
    R.range_max = lambda *a: looked.append(len(a[2])) or table(*a)
    try:
        best = []
        q = bags[17]
        df = Counter(t for b in bags for t in b)
        seg.search(np.array(list(q)), np.array([int(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in q]), best, 10, 0)
    finally:
        R.range_max = table
    assert best[0][1] == 17 and sum(looked) < n


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = R.query(spark, sf)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(R.SQL).fetchall())
