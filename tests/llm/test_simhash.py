"""SimHash near-dedup against brute force over all pairs."""

import random

import pytest
import xxhash

from hirelake.llm import simhash as S
from hirelake.llm.components import components


def brute_fp(text, k):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


def rows_of(docs):
    fps = {i: brute_fp(t, 4) for i, t in docs}
    return fps, brute_components(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)


def check(spark, docs):
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: r for r in S.classes(df).collect()}
    fps, comp = rows_of(docs)
    assert {i: r["__hl_fp"] & (1 << 64) - 1 for i, r in got.items()} == fps
    assert {i: r.component_id for i, r in got.items()} == comp


def test_all_documents_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    fps, comp = rows_of(docs)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.query(spark, sf).collect()}
    assert got == {i: (f"{fps[i]:016x}", comp[i]) for i in fps}


def test_edge_texts(spark):
    check(spark, [(1, None), (2, ""), (3, "one two"), (4, "ONE  two\n"), (5, "a b c d e"), (6, "é É x"),
                  (7, "z " * 70_000), (9, "  x y z w v"), (8, "Z\tz z z z")])


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert S.classes(df).count() == 0 and S.deduplicate(df).count() == 0
    df = spark.createDataFrame([(None, "p q r s t", 1), (None, "u v w x y", 2), (4, "p q r s t", 3), (4, "p q r s t", 3)],
                               "doc_id bigint, text string, node int")
    got = S.deduplicate(df)
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(["Row(doc_id=4, text='p q r s t', node=3)",
                                                      "Row(doc_id=None, text='u v w x y', node=2)"])


@pytest.mark.parametrize("max_shard", [40, 8192])
def test_links_keep_every_component(spark, max_shard):
    rnd = random.Random(5)
    fps = {rnd.getrandbits(64) for _ in range(40)}
    for base in list(fps)[:8]:  # dense balls and drifting chains
        x = base
        for _ in range(25):
            x ^= sum(1 << b for b in rnd.sample(range(64), rnd.choice((1, 3, 4, 5, 6))))
            fps.add(x)
    fps = sorted(S._signed(x) for x in fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp bigint")
    got = {r.node: r.component for r in components(S.links(df, 4, max_shard)).collect()}
    want = brute_components(fps, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 4)
    assert {x: got.get(x, x) for x in fps} == want


def test_bk_tree_finds_all_within_radius():
    rnd = random.Random(1)
    items = list({rnd.getrandbits(12) for _ in range(300)})
    tree = S.BKTree(items)
    for x in items[:40]:
        assert sorted(tree.near(x, 3)) == [i for i, y in enumerate(items) if (x ^ y).bit_count() <= 3]
