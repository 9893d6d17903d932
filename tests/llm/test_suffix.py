"""Removal of repeated byte strings against brute force over all windows."""

import hashlib
import random
import time
from collections import Counter

import pytest

from hirelake.llm import suffix as S


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i:i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = [False] * len(x)
        for i in range(len(x) - length + 1):
            if seen[x[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(x), sum(gone), runs, kept))
    return out


def check(spark, texts, length, trigger, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.remove_repeats(df, length=length, trigger=trigger, **more).collect()}
    assert got == dict(enumerate(brute(texts, length)))


@pytest.mark.parametrize("max_group", [2, 2000])
def test_random_texts(spark, max_group):
    rnd = random.Random(3)
    bits = ["".join(rnd.choice("abé\n") for _ in range(rnd.randint(5, 60))) for _ in range(25)]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12))) for _ in range(60)]
    texts += [None, "", "x" * 19, "x" * 20, "x" * 300, "ab" * 100, texts[5], texts[5], "\0" * 50 + "q"]
    check(spark, texts, 20, 6, max_group=max_group)


def test_documents_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = brute([r.text for r in docs], 200)
    got = {r.doc_id: tuple(r)[1:] for r in S.query(spark, sf).collect()}
    assert got == {d.doc_id: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for d, w in zip(docs, want, strict=True)}


def test_long_texts_cross_pieces(monkeypatch):
    monkeypatch.setattr(S, "_PIECE", 500)
    rnd = random.Random(2)
    text = bytes(rnd.randrange(256) for _ in range(4000))
    k, lo, n, off, th, ch = S.phrases([text, b"", text[100:900]], 60, 12)
    for i, size in ((0, 4000), (2, 800)):
        windows = [w for a, m in zip(lo[k == i], n[k == i], strict=True) for w in range(a, a + m)]
        assert sorted(windows) == list(range(size - 59))


def test_repeated_and_null_rows(spark):
    t = "".join(random.Random(1).choice("abcdefgh ") for _ in range(300))
    df = spark.createDataFrame([(None, t, "k"), (None, t, "k"), (7, t[:150], "z"), (7, None, None)], "doc_id bigint, text string, marks string")
    got = sorted((r.n_bytes, r.n_removed) for r in S.remove_repeats(df).collect())
    assert got == [(0, 0), (150, 0), (300, 300), (300, 300)]
    assert S.remove_repeats(df.limit(0)).count() == 0


def test_many_null_id_copies_cost_no_square(spark):
    """Copies of one text without an id are one row key: each gets its marks once, and all
    of them repeat each other."""
    rnd = random.Random(6)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(20_000))
    df = spark.createDataFrame([(None, text)] * 500 + [(1, "short"), (2, text[:150])], "doc_id bigint, text string").repartition(8)
    start = time.time()
    rows = S.remove_repeats(df).collect()
    assert time.time() - start < 90
    assert sum(r.doc_id is None and r.n_removed == r.n_bytes and r.n_spans == 1 for r in rows) == 500
    assert all(r.n_removed == 0 for r in rows if r.doc_id is not None)
