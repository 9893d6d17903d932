"""Benchmark decontamination against brute force over all item-sized windows."""

import random
from collections import Counter

import regex
import xxhash

from hirelake.llm import decontam as D


def split(text):
    return [w for w in regex.split(D.GAP, (text or "").lower()) if w]


def grams(ws, k):
    return [" ".join(ws[i:i + k]) for i in range(len(ws) - k + 1)]


def fp(gs):
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in gs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(docs, items, threshold=0.8):
    out = {}
    for di, text in docs:
        w = split(text)
        for ii, it in items:
            x = split(it)
            if not x or not w:
                continue
            k, size = min(5, len(x)), min(len(x), len(w))
            want = Counter(grams(x, k))
            best = None
            for s in range(len(w) - size + 1):
                got = Counter(grams(w[s:s + size], k))
                shared = sum((want & got).values())
                like = shared / (sum(want.values()) + sum(got.values()) - shared)
                if like >= threshold:
                    dist = (fp(grams(w[s:s + size], k)) ^ fp(grams(x, k))).bit_count()
                    if dist <= D.RADIUS:
                        best = max(best or (0, 0, 0, 0), (like, -s, dist, size))
            if best:
                out[di, ii] = (round(best[0], 9), best[2], -best[1], best[3])
    return out


def got(df):
    return {(r.doc_id, r.item_id): (round(r.similarity, 9), r.distance, r.start_word, r.n_words) for r in df.collect()}


def check(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, item_id string, w int")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    assert got(D.matches(d, b)) == brute(docs, items)
    return d, b


def test_planted_and_edge_cases(spark):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(400)] + ["the", "of", "é"]
    make = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(make(n))) for i, n in enumerate((60, 35, 35, 15, 4, 1))]
    items += [(6, None), (7, ""), (8, "the the the the the the the of of of of of of of of"), (9, items[1][1])]
    docs = [(0, " ".join(make(80))), (1, None), (2, ""), (3, "the")]
    for n, (_, t) in enumerate(items[:6] + items[8:9]):
        x = t.split()
        docs.append((10 + n, " ".join(make(30)) + " " + t.upper().replace(" ", ",  ") + ". " + " ".join(make(30))))  # whole
        docs.append((20 + n, " ".join(make(9) + x[2:] + make(9))))  # shortened
        docs.append((30 + n, " ".join(x[:-3])))  # a text shorter than the item
        y = list(x)
        y[len(y) // 2] = "changed"
        docs.append((40 + n, " ".join(make(5) + y + make(5))))
        docs.append((50 + n, " ".join(make(5) + x[len(x) // 2:] + x[:len(x) // 2] + make(5))))
    docs += [(60, "the " * 300 + "of " * 300), (61, items[0][1]), (61, items[0][1])]
    d, b = check(spark, docs, items)
    flagged = {i for i, _ in brute(docs, items)}
    kept = D.clean(d, b)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in docs if i not in flagged)


def test_documents_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = brute(docs, items)
    assert want
    assert got(D.query(spark, sf)) == want


def test_empty_tables_null_ids_and_native_plan(spark):
    d = spark.createDataFrame([(None, "a b c d e f g")], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, "b c d e f")], "item_id bigint, text string")
    assert got(D.matches(d, b)) == {(None, 1): (1.0, 0, 1, 5)}
    assert D.matches(d.limit(0), b).count() == 0 and D.matches(d, b.limit(0)).count() == 0
    assert D.clean(d, b.limit(0)).count() == 1 and D.clean(d, b).count() == 0
    plan = D.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
