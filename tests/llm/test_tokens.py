"""Token rollups against counting one by one."""

import uuid
from collections import Counter

from hirelake.llm import tokens as K
from hirelake.session import checkpoint_dir


def rollup(spark):
    return K.Rollup(spark, f"{checkpoint_dir(spark)}/test-{uuid.uuid4().hex}")


def changes(spark, rows):
    return spark.createDataFrame(rows, "op string, doc string, source string, lang string, version string, n_tokens bigint")


def totals(r):
    return {(x.source, x.lang, x.version): (x.n_docs, x.n_tokens) for x in r.totals().collect()}


def test_inserts_revisions_deletes_and_replays(spark):
    r = rollup(spark)
    assert totals(r) == {}
    first = changes(spark, [("upsert", "1", "a", "en", "v", 10), ("upsert", "2", "a", "en", "v", 5), ("upsert", "2", "a", "en", "v", 5),
                            ("upsert", "3", None, "de", "v", 0), ("upsert", "1", "a", "en", "u", 7)])
    assert r.apply("b1", first) and not r.apply("b1", first)
    assert totals(r) == {("a", "en", "v"): (2, 15), (None, "de", "v"): (1, 0), ("a", "en", "u"): (1, 7)}
    assert r.apply("b2", changes(spark, [("upsert", "1", "a", "en", "v", 12), ("delete", "2", None, None, "v", 0), ("upsert", "2", "a", "en", "v", 99),
                                         ("delete", "9", None, None, "v", 0), ("upsert", "3", None, "de", "v", 0), ("upsert", "4", "b", "en", "v", 1)]))
    want = {("a", "en", "v"): (1, 12), (None, "de", "v"): (1, 0), ("a", "en", "u"): (1, 7), ("b", "en", "v"): (1, 1)}
    assert totals(r) == want
    assert not r.apply("b2", first) and totals(r) == want
    assert r.apply("b3", changes(spark, [("upsert", "1", "moved", "en", "v", 12)]).limit(1))
    assert totals(r)["moved", "en", "v"] == (1, 12) and ("a", "en", "v") not in totals(r)
    assert r.apply("b4", changes(spark, [])) and totals(r)["moved", "en", "v"] == (1, 12)


def test_a_batch_lost_half_way_is_written_again(spark):
    r = rollup(spark)
    rows = changes(spark, [("upsert", "1", "a", "en", "v", 10)])
    r.apply("b1", rows)
    changes(spark, [("upsert", "8", "x", "en", "v", 1)]).drop("op").selectExpr("*", "1 sign").write.parquet(f"{r.path}/entries/batch=b2")
    spark.range(1).selectExpr("'x' source", "'en' lang", "'v' version", "1L n_docs", "1L n_tokens").write.parquet(f"{r.path}/deltas/batch=b2")
    assert totals(r) == {("a", "en", "v"): (1, 10)}
    assert r.apply("b2", changes(spark, [("upsert", "1", "a", "en", "v", 11)]))
    assert totals(r) == {("a", "en", "v"): (1, 11)}


def test_counts_of_edge_texts(spark):
    texts = [None, "", "<|endoftext|> x", "é" * 50, "a" * 20_000, " \n\t "]
    df = spark.createDataFrame([(i or None, t, None, "en", 4) for i, t in enumerate(texts)], "doc_id bigint, text string, source string, lang string, n_tokens int")
    enc = K.encoder(f"{K.TOKENIZERS}/{K.BASE}.tiktoken")
    got = sorted(r.n_tokens for r in K.count_tokens(df).collect())
    assert got == sorted(len(enc.encode_ordinary(t)) if t else 0 for t in texts)
    assert enc.decode(enc.encode_ordinary(texts[3])) == texts[3]
    assert K.count_tokens(df.limit(0)).count() == 0


def test_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    enc = {v: K.encoder(f"{K.TOKENIZERS}/{v}.tiktoken") for v in (K.BASE, K.MULTI)}
    first = {}
    for r in sorted(docs, key=lambda r: r.doc_id):
        first.setdefault(r.text, r.doc_id)
    n, total = Counter(), Counter()
    for r in docs:
        if first[r.text] == r.doc_id:
            key = r.source, r.lang, K.BASE if r.lang == "en" else K.MULTI
            n[key] += 1
            total[key] += len(enc[key[2]].encode_ordinary(r.text))
    got = {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in K.query(spark, sf).collect()}
    assert got == {k: (n[k], total[k]) for k in n}
