"""The pipeline, stage by stage, against brute force; and on odd tables."""

from collections import defaultdict

import corpus_pipeline as P
import test_decontam
import test_lines
import test_simhash
from hirelake.llm import quality as Q
from hirelake.llm.common import stored

SF = "/root/testdata/sf0.001"


def brute_quality(rows):
    texts, held = defaultdict(set), defaultdict(set)
    for r in rows:
        texts[r["source"]].add(r["text"])
        for x in (r["text"] or "").encode().lower().split(b"\n"):
            if x.split():
                held[r["source"], b" ".join(x.split())].add(r["text"])
    over = {k for k, v in held.items() if len(v) > Q.MIN_DOCS and len(v) > Q.MAX_SHARE * len(texts[k[0]])}
    out = []
    for r in rows:
        words = (r["text"] or "").split()
        grams = defaultdict(list)
        for i in range(len(words) - 2):
            grams[tuple(words[i:i + 3])].append(i)
        again = {i + k for v in grams.values() if len(v) > 1 for i in v for k in range(3)}
        lines = (r["text"] or "").split("\n")
        keep = [x for x in lines if (r["source"], b" ".join(x.encode().lower().split())) not in over]
        if len(words) >= 50 and 100 * len(again) <= 50 * len(words) and 100 * sum(len(x.split()) for x in keep) >= 30 * len(words):
            out.append(changed(r, "\n".join(keep)))
    return out


def changed(r, text):
    return r if text == r["text"] else r | {"text": text, "n_chars": len(text)}


def brute_lines(rows):
    done = test_lines.brute([(r["doc_id"], r["text"]) for r in rows])
    return [changed(r, done[r["doc_id"]][0]) for r in rows if not done[r["doc_id"]][2] or done[r["doc_id"]][0].split()]


def brute_near(rows):
    _, comp = test_simhash.rows_of([(r["doc_id"], r["text"]) for r in rows])
    return [r for r in rows if comp[r["doc_id"]] == r["doc_id"]]


def brute_clean(rows, items):
    hit = {d for d, _ in test_decontam.brute([(r["doc_id"], r["text"]) for r in rows], items)}
    return [r for r in rows if r["doc_id"] not in hit]


def key(rows):
    return sorted(tuple(sorted((k, str(v)) for k, v in r.items())) for r in rows)


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    brute = {"quality_rules": brute_quality, "line_dedup": brute_lines, "near_dedup": brute_near,
             "decontaminate": lambda rows: brute_clean(rows, items)}
    assert [n for n, _ in P.STAGES] == [*brute, "mix_sources"]
    columns, before = docs.columns, [r.asDict() for r in docs.collect()]
    for name, stage in P.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == columns, name
        rows = [r.asDict() for r in docs.collect()]
        assert key(rows) == key(brute[name](before)), name
        before = rows
    mixed = P.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in mixed} <= {r["doc_id"] for r in before} and all(r.copies in (1, 2) for r in mixed)
    taken, target, least = defaultdict(int), {}, defaultdict(lambda: 10**9)
    for r in before:
        least[r["source"]] = min(least[r["source"]], len(r["text"].split()))
    for r in mixed:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(-least[s] <= taken[s] - target[s] <= 1 for s in target)
    assert sorted(map(str, P.run(spark, SF).collect())) == sorted(map(str, mixed))


def test_odd_tables(spark):
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, node string, mask int, copies int, host string, later int"
    body = " ".join(f"w{i}" for i in range(70))
    rows = [(1, body, "en", None, 5, 1, "a", 2, 3, "h", 4), (1, body, "en", None, 5, 1, "a", 2, 3, "h", 4), (None, body + " x", None, "s", None, 1, "a", 2, 3, "h", 4),
            (None, None, None, None, None, None, None, None, None, None, None), (2, "", "", "", 0, 0, "", 0, 0, "", 0),
            (3, "z " * 60_000 + body, "en", "s", 1, 1, "a", 2, 3, "h", 4), (4, "q\n" * 5000, "en", "s", 1, 1, "a", 2, 3, "h", 4)]
    odd = spark.createDataFrame(rows, kind)
    for name, stage in P.STAGES:
        for df in (odd, odd.limit(0)):
            got = stage(spark, df, SF)
            if name != "mix_sources":
                assert got.columns == odd.columns, name
            got.count()
    docs = odd
    for _, stage in P.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), "odd")
    assert [r.doc_id for r in docs.collect()] == [1]
