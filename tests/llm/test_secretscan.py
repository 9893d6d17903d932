"""Secret scans: base spans against the contract's patterns, added spans against planted
random strings, digests and names."""

import hashlib
import random
import re
import string
import time
import uuid

import pytest

from hirelake.llm import secretscan as S
from hirelake.llm.tokens import BASE, TOKENIZERS, encoder

NAMES = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m.group(2)) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 16]
    return [(s, e, k) for s, k, e in sorted(out)]


def test_base_spans_on_random_strings():
    rnd = random.Random(13)
    bits = ["token", "Token", "API_KEY", "apikey", "passwd", "paſſword", "toKen", "secret", "AKIA", "=", ":", " ", '"', "'", "0a1b2c3d4e5f6789", "ABCDEFGH1234567", "é", "\n", "x", ".", "-"]
    for _ in range(20_000):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14)))
        assert S.base_spans(t) == plain(t), t


def text_of(spans):
    return ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, e, k in spans)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_all_documents(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = S.query(spark, sf).collect()
    assert len(rows) == len(docs) and sum(r.n_hex for r in rows) > 0
    for r in rows:
        base = plain(docs[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for *_, k in base) for i in range(3)]
        assert r.base_sha256 == hashlib.sha256(text_of(base).encode()).hexdigest()
        assert r.n_random == 0 and r.spans == text_of(base)  # clean documents gain no spans


ALPHABETS = {"base62": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "base36": string.ascii_lowercase + string.digits,
             "base32": string.ascii_uppercase + "234567"}


@pytest.mark.parametrize("name", ALPHABETS)
def test_random_strings_are_found(spark, name):
    rnd = random.Random(name)
    texts = []
    for i in range(300):
        key = "".join(rnd.choice(ALPHABETS[name]) for _ in range(rnd.choice([24, 32, 40])))
        texts.append((i, f"the words before {key} and, after it: words", key))
    df = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id bigint, text string")
    got = {r.doc_id: r.spans for r in S.scan(df).collect()}
    found = 0
    for i, t, key in texts:
        s = t.index(key)
        found += any(x.kind == 3 and abs(x.start - s) <= 2 and abs(x.end - s - len(key)) <= 2 for x in got[i])
    assert found >= 0.95 * len(texts)
    assert all(x.ratio <= S.MAX_RATIO for spans in got.values() for x in spans if x.kind == 3)


CLEAN = ["my_long_identifier_name_v2", "getUserAccountById2", "com.example.project.module1", "2024-01-15T10:00:00.000", "IMG_20240115_123456.jpg", "package-lock-1.2.3.tgz",
         "x86_64-unknown-linux-gnu", "550e8400-e29b-41d4-a716-446655440000", "ABCD-1234-EFGH-5678-IJKL", "file_name_2023_final_v3.docx", "https://host.example.org/a/b/c1/d2/e3?x",
         "some.person.12345@mail.example.org", "../relative/path/to/file123.txt", "4111-1111-1111-1111-1111", "D41D8CD98F00B204E9800998ECF8427E", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
         "sha256-47DEQpj8HBSa+/TImW+5JCeuQeRkm5NMpJWZG3hSuFU=", "sha512:9b71d224bd62f378Z5d96d46ad3ea3d73319", "Donaudampfschiffahrtsgesellschaft7"]


def test_digests_and_identifiers_are_left_alone():
    enc = encoder(f"{TOKENIZERS}/{BASE}.tiktoken")
    for x in CLEAN:
        t = f"see {x} there"
        added = [t[s:e] for s, e in S.candidates(t, S.base_spans(t)) if (e - s) / len(enc.encode_ordinary(t[s:e])) <= S.MAX_RATIO]
        assert added == [], x
    rnd = random.Random(5)
    t = "id " + str(uuid.UUID(int=rnd.getrandbits(128))).upper() + " end"
    assert S.candidates(t, []) == []
    key = "sT9vQ2xLm7RpZ4kWc8Yb"
    assert S.candidates(f"a {key} b", []) == [(2, 22)] and S.candidates(f"a {key} b", [], frozenset([key.lower()])) == []


def test_base_spans_stay_and_added_ones_touch_none(spark):
    key = "sT9vQ2xLm7RpZ4kWc8Yb"
    rows = [(None, f"{key} token={key}", "x"), (None, f"{key} token={key}", "x"), (2, None, "x"), (3, "", "x"), (4, "é😀 " + key + ".", "x"), (4, "é😀 " + key + ".", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans string")
    got = sorted((str(r.doc_id), [(s.kind, s.start, s.end) for s in r.spans]) for r in S.scan(df).collect())
    assert got == [("2", []), ("3", []), ("4", [(3, 3, 23)]), ("4", [(3, 3, 23)])] + [("None", [(3, 0, 20), (0, 21, 47)])] * 2
    assert S.scan(df, known=[key.upper()]).where("doc_id = 4 and size(spans) > 0").count() == 0
    assert S.scan(df.limit(0)).count() == 0


def test_long_hostile_texts_are_quick():
    enc = encoder(f"{TOKENIZERS}/{BASE}.tiktoken")
    start = time.time()
    for t in ("a" * 300_000, "1" * 300_000, "token" * 60_000, "token=" * 50_000, "token " + " " * 300_000, "AKIA" * 80_000, "Ab" * 150_000 + "1", "A1b" * 100_000, "=" * 300_000 + "a1", "a-" * 150_000 + "1"):
        base = S.base_spans(t)
        for s, e in S.candidates(t, base):
            enc.encode_ordinary(t[s:e])
    assert time.time() - start < 30
