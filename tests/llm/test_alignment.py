"""Alignment against a brute-force version with the tokenizers' own libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from hirelake.llm import alignment as X
from hirelake.llm.tokens import TOKENIZERS

SF = "/root/testdata/sf0.001"


class Plain:
    """Token by token, all pairs; A by the tokenizers library itself."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer
        from tokenizers.decoders import ByteLevel
        self.a = Tokenizer.from_file(f"{TOKENIZERS}/{X.A}")
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/{X.B}")
        self.alphabet = {}
        for c in range(0x180):  # the library's own decoder says which byte a character is
            if (s := ByteLevel().decode([chr(c)])) != chr(c) and len(s) == 1 and s != "�":
                self.alphabet[chr(c)] = ord(s)
        keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.alphabet |= {chr(c): c for c in keep}
        rest = [b for b in range(256) if b not in keep]
        self.alphabet |= {chr(0x100 + i): b for i, b in enumerate(rest)}

    def spans(self, text):
        if not text:
            return [], []
        a = [(i, bytes(self.alphabet[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            p = self.b.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()))
        out = []
        for side in (a, b):
            if b"".join(x for _, x in side) != (" " + text).encode():
                return [], []
            at, spans = 0, []
            for i, x in side:
                spans.append((i, at, at + len(x)))
                at += len(x)
            out.append(spans)
        return out

    def row(self, text):
        a, b = self.spans(text)
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= c) for side in (a, b)))
            low = c
        links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
        return len(a), len(b), groups, links


def expected(texts):
    plain = Plain()
    rows = [plain.row(t) for t in texts]
    docs = Counter(p for *_, links in rows for p in set(links))
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    return [(n_a, n_b, len(g), len(links), sum(docs[p] == most[p[0]] for p in links), sum(docs[p] for p in links),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for n_a, n_b, g, links in rows]


COLS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def run(spark, rows, tmp_path, schema="doc_id bigint, text string, links int, n_a string"):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return X.query(spark, str(tmp_path)).collect()


def test_given_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    short = [(i, t) for i, t in docs if len(t or "") < 3000]
    got = {r.doc_id: tuple(r[c] for c in COLS) for r in X.query(spark, SF).collect()}
    assert len(got) == len(docs)
    plain = Plain()
    for i, t in short:
        n_a, n_b, groups, links = plain.row(t)
        assert got[i][:4] == (n_a, n_b, len(groups), len(links))
        assert got[i][6] == (hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")


def test_odd_texts_and_corpus_counts(spark, tmp_path):
    rnd = random.Random(4)
    texts = [None, "", " ", "a", "a", "  two  blanks \n\n\ttab\r\n", "special <|endoftext|> <s> </s> <unk> <0x41>", "has ▁ in it", "\x00nul \x00", "é é ﬁ ①",
             "日本語のテキスト と 한국어", "😀😀👩‍👩‍👧 \U0001F1E9\U0001F1EA", "x" * 400, "don't we'll I'M 12345 3.14", "\u0085  nbsp", "tail "]
    chars = "aeinrst  \n.,01éñ日😀́"
    texts += ["".join(rnd.choice(chars) for _ in range(rnd.randint(1, 80))) for _ in range(150)]
    texts += [texts[-1]] * 3
    rows = run(spark, [(i, t, 1, "x") for i, t in enumerate(texts)], tmp_path)
    got = {r.doc_id: tuple(r[c] for c in COLS) for r in rows}
    want = expected(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert got[0] == got[1] == (0, 0, 0, 0, 0, 0, "") and got[7][0] == 0
    assert rows[0].asDict().keys() == {"doc_id", *COLS}


def test_shuffled_join_gives_the_same(spark):
    aligned = X.stored(X.align(spark.read.parquet(f"{SF}/documents.parquet")).drop("groups"), "test_aligned")
    counts = X.pair_counts(aligned)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(X.weigh(aligned, counts, 10)) == key(X.weigh(aligned, counts))
    assert "BroadcastHashJoin" in X.weigh(aligned, counts)._jdf.queryExecution().toString()


def test_null_ids_repeated_rows_long_text_and_empty_table(spark, tmp_path):
    long = "word räksmörgås 12 " * 20_000
    rows = run(spark, [(None, "same text", 0, ""), (None, "same text", 0, ""), (7, "same text", 0, ""), (7, "other", 0, ""), (8, long, 0, "")], tmp_path)
    assert len(rows) == 5
    same = next(r for r in rows if r.doc_id is None)
    assert sum(tuple(r)[1:] == tuple(same)[1:] for r in rows) == 3
    assert same.count_sum == 3 * same.n_links and same.n_best == same.n_links
    big = next(r for r in rows if r.doc_id == 8)
    assert big.n_a > 80_000 and big.n_groups <= min(big.n_a, big.n_b) and big.n_links < big.n_a + big.n_b
    assert run(spark, [], tmp_path / "none") == []


def test_library_encoder_gives_the_same_ids(tmp_path):
    """A file whose merges are not known to stand in id order goes to the library."""
    import json
    spec = json.load(open(f"{TOKENIZERS}/{X.A}", encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True  # no longer the usual rule
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    texts = [" Hello there, don't 123 !!", " ñandú  \n x"]
    slow, bytes_slow = X.tokenizer(str(path))
    quick, bytes_quick = X.tokenizer(f"{TOKENIZERS}/{X.A}")
    assert slow(texts) == quick(texts) and bytes_slow == bytes_quick


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|endoftext|>b"])
def test_special_strings_are_text(text):
    encode, table = X.tokenizer(f"{TOKENIZERS}/{X.A}")
    assert b"".join(table[i] for i in encode([text])[0]) == text.encode()
