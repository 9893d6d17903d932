"""Quality rules against their SQL on hard cases, and line removal."""

import duckdb
import pandas as pd

from hirelake.llm import quality as Q


def edge_docs():
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    docs = [(i, f"Common  LINE here\n{body(i)}", "h") for i in range(60)]
    docs += [(100 + i, "\n".join(["common line HERE"] * 3 + [" ".join(["tail"] * 3)] + [body(900)] * (i % 2)), "h") for i in range(3)]
    docs += [(200, None, None), (201, "", "h"), (202, " \n\t\n", "é"), (203, "a b c " * 40, None), (204, "x\n" * 90, None),
             (205, "#*$%&|<> é ñ\x0b\x0c\r" + body(5), "h"), (206, body(6), None), (206, body(6), None), (207, "a a a", ""),
             (208, "common line here\n" * 30 + "and few more words", "h"), (209, "q " * 30_000, "x")]
    return docs


def test_against_sql_on_edge_cases(spark):
    docs = edge_docs()
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").repartition(5)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text", "source"]))
    want = con.execute(Q.SQL)
    names = [d[0] for d in want.description]
    rows = sorted(tuple(r) for r in want.fetchall())
    got = Q.verdicts(df)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == rows
    by = {r[0]: dict(zip(names, r, strict=True)) for r in rows}
    assert by[0]["n_frequent_lines"] == 1 and by[0]["kept"]
    assert not by[208]["kept"] and by[208]["n_frequent_lines"] == 30


def test_removed_lines_and_clashing_columns(spark):
    docs = [(i, t, s, 7, i) for i, t, s in edge_docs()]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, n_chars bigint, n_words int")
    got = Q.apply_rules(df)
    assert got.schema == df.schema
    kept = {r.doc_id: r for r in got.collect()}
    assert kept[0].text == edge_docs()[0][1].split("\n")[1] and kept[0].n_chars == len(kept[0].text)
    assert kept[206].n_chars == 7 and 208 not in kept and 200 not in kept
    assert Q.apply_rules(df.limit(0)).count() == 0 and Q.verdicts(df.limit(0)).count() == 0


def test_exact_copies_count_once(spark):
    text = "same line of a copied text\n" + " ".join(f"u{j}" for j in range(80))
    df = spark.createDataFrame([(i, text, "h") for i in range(300)], "doc_id bigint, text string, source string")
    assert Q.verdicts(df).where("kept").count() == 300


def test_the_share_decides_at_every_size_of_host(spark):
    """A host and one ten times its size lose the same lines."""
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(60))

    def gone(n):
        docs = [(i, ("footer of every fifth page\n" if i % 5 == 0 else "") + ("line of few\n" if i % 20 == 0 else "") + body(i), "h") for i in range(n)]
        rows = Q.verdicts(spark.createDataFrame(docs, "doc_id bigint, text string, source string")).collect()
        return sum(r.n_frequent_lines for r in rows), n // 5
    assert gone(40) == (8, 8) and gone(400) == (80, 80)
