"""Personal data: base spans against plain regular expressions, discovery against the
scores computed by hand."""

import hashlib
import random
import re

import pytest

from hirelake.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(t):
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(t):
        d = [int(c) for c in m.group() if c.isdigit()]
        total = sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_base_spans_on_random_strings():
    rnd = random.Random(8)
    for _ in range(30_000):
        t = "".join(rnd.choice("a1@.+ -(é9\n02") for _ in range(rnd.randint(0, 40)))
        assert P.base_spans(t) == plain(t), t
    for _ in range(2000):
        t = "".join(rnd.choice("0123456789 -") for _ in range(60))
        assert P.base_spans(t) == plain(t), t


def test_long_hostile_texts_are_quick():
    for t in ("a" * 300_000, "1" * 300_000, "@" * 300_000, "a@" * 150_000, "1." * 150_000, "+1" * 150_000, "+1" + " " * 300_000, "a@b-" * 80_000):
        P.instances(t, P.base_spans(t))


def span_text(spans):
    return ",".join(f"{P.KINDS[k]}:{s}:{e}" for k, s, e in spans)


def test_all_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = P.query(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = plain(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in base) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(span_text(base).encode()).hexdigest()
        assert set(span_text(base).split(",")) <= set(r.spans.split(",")) and (r.n_added or r.spans == span_text(base))


def corpus():
    docs = [(i, f"write to mail: u{i}@site{i}.org or fax +1 (20{i}) 555-010{i} now {i}") for i in range(8)]
    docs += [(20, "é mail: someone(at)site.org9, fax 5550177 end"), (21, "the fax 5550188."), (22, "seen 5550177 elsewhere, near 5550177"),
             (23, None), (24, ""), (25, "mail: "), (26, "4111 1111 1111 1111 and mail: 7")]
    return docs


def test_patterns_discover_unseen_identifiers(spark):
    df = spark.createDataFrame([(i, t, 0) for i, t in corpus()], "doc_id bigint, text string, n_email int")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in P.find(df, min_confidence=0.75).collect()}
    text = dict(corpus())
    new = {i: [(P.KINDS[k], text[i][s:e]) for k, s, e in got[i] if (k, s, e) not in plain(text[i] or "")] for i in got}
    # "mail:" holds 8 seeds of 10 values, "fax" 8 of 10; "to mail:", "or fax" are seeds only.
    assert new[20] == [("email", "someone(at)site.org9"), ("phone", "5550177")]
    assert new[21] == [("phone", "5550188")]
    assert new[26] == [("email", "7")]
    assert all(not new[i] for i in new if i not in (20, 21, 26))
    none = {r.doc_id: len(r.spans) for r in P.find(df, min_seeds=9).collect()}
    assert none == {i: len(plain(t or "")) for i, t in corpus()}


def test_scores_in_rounds(spark):
    edges = [("p", f"s{i}", 1) for i in range(6)] + [("p", "x", -1), ("p", "y", -1)] + [("q", "s0", 1), ("q", "x", -1), ("q", "y", -1)]
    df = spark.createDataFrame(edges, "pattern string, value string, kind int")

    def scores(rounds):
        return {(r.pattern, r.kind): r.confidence for r in P.confident_patterns(df, rounds, 1, 0.0).collect()}

    assert scores(1) == {("p", 1): 6 / 8, ("q", 1): 1 / 3}
    got = scores(2)
    assert got["p", 1] == pytest.approx((6 + 2 * 6 / 8) / 8) and got["q", 1] == pytest.approx((1 + 2 * 6 / 8) / 3)


def test_empty_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a@b.c"), (2, "x 1.2.3.4"), (2, "x 1.2.3.4")], "doc_id bigint, text string")
    got = sorted((str(r.doc_id), [tuple(s) for s in r.spans]) for r in P.find(df).collect())
    assert got == [("2", [(1, 2, 9)])] * 2 + [("None", [(0, 0, 5)])]
    assert P.find(df.limit(0)).count() == 0
