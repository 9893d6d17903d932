"""Line dedup against brute force, whole passages, and the boundaries' resistance to shifts."""

import random
import time
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from hirelake.llm import lines as L


def starts(parts):
    """Boundaries by their definition, one position after the other."""
    hashes = np.array([xxhash.xxh3_64_intdigest(p) for p in parts], np.uint64)
    return [int(i) for i in L.boundaries(hashes, np.zeros(len(parts), np.int64))[0]]


def brute(docs):
    """Chunks and their neighbours' lines, compared as bytes in dictionaries."""
    texts = {(-(1 << 63) if i is None else i, t or ""): L.units((t or "").encode()) for i, t in docs}
    order = {key: (key[0], xx(key[1])) for key in texts}
    once = defaultdict(set)
    for key, (parts, _) in texts.items():
        for s in starts(parts):
            once[tuple(parts[s:s + 2])].add((order[key], s))
    places = defaultdict(set)
    for key, (parts, _) in texts.items():
        for s in starts(parts):
            if len(once[tuple(parts[s:s + 2])]) > 1:
                for a, e in ((s, s + 2), (s - 1, s + 2), (s, s + 3)):
                    if a >= 0 and e <= len(parts):
                        places[tuple(parts[a:e])].add((order[key], a))
    gone = defaultdict(set)
    for k, where in places.items():
        for key, a in sorted(where)[1:]:
            gone[key] |= set(range(a, a + len(k)))
    out = {}
    for i, t in docs:
        key = (-(1 << 63) if i is None else i, t or "")
        g, (parts, gaps) = gone[order[key]], texts[key]
        out[i] = (L.without(parts, gaps, g).decode(), len(parts), len(g), sum(x - 1 not in g for x in g))
    return out


def xx(text):
    """Spark's xxhash64 of a string."""
    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def check(spark, docs):
    df = spark.createDataFrame([(i, t, 3, "k") for i, t in docs], "doc_id bigint, text string, n_chars bigint, later string")
    got = L.remove_chunks(df)
    rows = {r.doc_id: (r.text or "", *(r[c] for c in L.COUNTS)) for r in got.collect()}
    want = brute(docs)
    assert rows == want
    return df, got, want


def test_shared_passages(spark):
    rnd = random.Random(4)
    line = lambda: " ".join(rnd.choice("abcdefgh") * 3 for _ in range(6))
    shared = [[line() for _ in range(12)] for _ in range(4)]
    docs = []
    for i in range(60):
        x = [line() for _ in range(rnd.randint(0, 5))] + (rnd.choice(shared) if i % 2 else []) + [line() for _ in range(rnd.randint(0, 5))]
        docs.append((i, "\n".join(x)))
    docs += [(100, None), (101, ""), (102, "\n"), (103, "\n"), (104, "one"), (105, "one"), (106, "z\n" * 5000), (107, docs[1][1]), (108, docs[1][1])]
    df, got, want = check(spark, docs)
    assert sum(w[3] for w in want.values()) >= 28
    assert want[107][0] == "" and want[108][0] == ""
    by = {r.doc_id: r for r in got.collect()}
    assert by[100].text is None and by[0].n_chars == 3 and by[108].n_chars == 0
    left = {r.doc_id for r in L.dedup_lines(df).collect()}
    assert 107 not in left and 108 not in left and {0, 1, 100, 101, 102, 105} <= left


@pytest.mark.parametrize("size", [2, 3, 4, 5, 8, 20])
def test_passages_are_found_whole(spark, size):
    """One passage in two unrelated texts, 200 pairs: from three lines on every line of the
    later copy goes and nothing else; of two lines, over a third of the passages."""
    rnd = random.Random(size)

    def fresh(n):
        return [str(rnd.random()) for _ in range(n)]

    docs, want = [], {}
    for n in range(200):
        p = fresh(size)
        a, b, c, d = (fresh(rnd.randint(0, 20)) for _ in range(4))
        docs += [(2 * n, "\n".join([*a, *p, *b])), (2 * n + 1, "\n".join([*c, *p, *d]))]
        want |= {2 * n: docs[-2][1], 2 * n + 1: "\n".join([*c, *d])}
    got = {r.doc_id: r.text for r in L.remove_chunks(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    if size > 2:
        assert got == want
    else:
        assert sum(got[k] == want[k] for k in want if k % 2) > 70
        assert all(got[k] in (t, want[k]) for k, t in docs)


def test_bounds_by_all_windows(spark):
    """On whole documents: every line of a three-line window with an earlier place goes, and
    no line goes that is in no two-line window with one; the first place of a line stays."""
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(docs)
    got = {r.doc_id: (r.n_lines, r.n_removed_lines, r.n_removed_chunks) for r in L.query(spark, sf).collect()}
    assert got == {i: w[1:] for i, w in want.items()}
    assert sum(w[2] for w in want.values()) > 0
    texts = {r.doc_id: r.text or "" for r in L.remove_chunks(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    seen = {2: set(), 3: set()}
    for i, t in sorted(docs, key=lambda d: (d[0], xx(d[1] or ""))):
        parts, gaps = L.units((t or "").encode())
        must, may = set(), set()
        for w, into in ((3, must), (2, may)):
            for s in range(len(parts) - w + 1):
                k = tuple(parts[s:s + w])
                if k in seen[w]:
                    into |= set(range(s, s + w))
                seen[w].add(k)
        assert len(must) <= got[i][1] <= len(may)
        if must == may:
            assert texts[i] == L.without(parts, gaps, must).decode()


def test_sentences_of_long_lines(spark):
    rnd = random.Random(2)

    def prose(n):
        return " ".join(" ".join(rnd.choice("abcdefghij") * 4 for _ in range(12)) + "." for _ in range(n))

    p = prose(4)
    docs = [(1, f"{prose(9)} {p} {prose(6)}\nlast"), (2, f"first\n{prose(7)} {p} {prose(8)}"), (3, f"short. {prose(1)}\nshort. end")]
    _, _, want = check(spark, docs)
    assert p not in want[2][0] and len(want[2][0]) == len(docs[1][1]) - len(p) - 1 and want[1][0] == docs[0][1]
    for t in (b"", b"\n", b"a. b\n\n" * 200, b"a. " * 400, "字。".encode() * 300, b"x" * 3000):
        parts, gaps = L.units(t)
        assert b"".join(x for pair in zip(parts, gaps, strict=True) for x in pair)[:-1] == t
        assert L.without(parts, gaps, set()) == t


def test_empty_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a\nb\nc\nd"), (5, "a\nb\nc\nd"), (5, "a\nb\nc\nd")], "doc_id bigint, text string")
    assert L.remove_chunks(df.limit(0)).count() == 0
    got = sorted((str(r.doc_id), r.text) for r in L.remove_chunks(df).collect())
    assert got == [("5", ""), ("5", ""), ("None", "a\nb\nc\nd")]


def test_boundaries_cover_and_survive_a_shift():
    rnd = random.Random(9)
    ls = [str(rnd.random()).encode() for _ in range(400)]
    a, b = starts(ls), starts([b"new", *ls])
    assert {i + k for i in a for k in range(2)} >= set(range(1, 399))
    assert len(set(a) ^ {s - 1 for s in b}) <= 2
    assert starts([]) == [] and starts([b"x"]) == [] and starts([b"x", b"y"]) == [0]
    # texts of one batch do not touch each other
    h = np.array([xxhash.xxh3_64_intdigest(x) for x in ls], np.uint64)
    cut = np.sort(np.array([rnd.randrange(400) for _ in range(150)]))
    text = np.searchsorted(cut, np.arange(400), side="right")
    apart = [int(np.flatnonzero(text == i)[0]) + s for i in np.unique(text) for s in starts([ls[j] for j in np.flatnonzero(text == i)])]
    assert list(L.boundaries(h, text)[0]) == apart


def test_many_null_id_copies_cost_no_square(spark):
    """Copies of one text without an id are one row key: each gets its marks once."""
    text = "\n".join(f"line {i} of a text that is copied" for i in range(600))
    rows = [(None, text)] * 1500 + [(7, text), (8, "own line\nother line")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    start = time.time()
    got = L.remove_chunks(df).groupBy("doc_id").agg({L.COUNTS[1]: "max", "*": "count"}).collect()
    assert time.time() - start < 90
    assert {r.doc_id: r["count(1)"] for r in got} == {None: 1500, 7: 1, 8: 1}
    # the copies with the smallest key keep the text, the row with an id loses its chunks
    assert {r.doc_id: r[f"max({L.COUNTS[1]})"] for r in got} == {None: 0, 7: 600, 8: 0}
