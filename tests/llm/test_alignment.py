"""Alignment of two tokenizers against comparing all pairs of tokens."""

import hashlib
from collections import Counter

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from lodestone.llm import token_alignment as T

PATHS = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, P.path("piece_bpe_32k.model"))
ODD = [None, "", "a▁b", "<|endoftext|> </s> <s> <0x41>", "日本語 テキスト🎉 é́", " ", "  x", "\n\n", "x" * 300, "a b  c \x1c d", "a  b c", "same text", "same text", "m². cm². x ²", "\tq  \n w ", "don't  'll stop"]


@pytest.fixture(scope="module")
def pair():
    return T.Pair(*PATHS)


def spans(ids, table):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(table[i].as_py()), i))
        at = out[-1][1]
    return out


def brute(pair, texts):
    rows, held = [], Counter()
    for t in texts:
        whole = (" " + (t or "")).encode()
        a = spans(pair.a_own.encode(" " + t, add_special_tokens=False).ids if t else [], pair.bytes[0])
        b = spans(pair.b.encode(t) if t else [], pair.bytes[1])
        if not t or any(b"".join(table[i].as_py() for *_, i in s) != whole for s, table in zip((a, b), pair.bytes)):
            rows.append(None)
            continue
        links = [(i, j) for s, e, i in a for s2, e2, j in b if s < e2 and s2 < e]
        groups, start = [], 0
        for end in sorted({e for _, e, _ in a} & {e for _, e, _ in b}):
            groups.append("|".join(",".join(str(i) for _, e, i in x if start < e <= end) for x in (a, b)))
            start = end
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        held.update(set(links))
    best = {}
    for (i, _), n in held.items():
        best[i] = max(best.get(i, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(held[x] == best[x[0]] for x in r[3]), sum(held[x] for x in r[3]), r[4]) for r in rows]


def found(spark, texts, n=3):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"n_a": F.lit("x"), "block": F.lit(1)}).repartition(n)
    return [tuple(r)[1:] for r in sorted(T.alignment(df, *PATHS).collect())]


def test_alignment_equals_all_pairs(spark, pair):
    texts = ODD + [r.text[:500] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(80).collect()]
    want = [(*w[:4], w[4], w[5], w[6]) for w in brute(pair, texts)]
    assert found(spark, texts) == want


def test_alignment_of_whole_and_long_texts(spark, pair, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 10_000)
    long = "word and " * 60_000
    runs = "a" + " " * 50_000 + "b"
    got = found(spark, [long, runs, "x" * 100_000], 1)
    for g, t in zip(got, (long, runs, "x" * 100_000)):
        assert g[:2] == (len(pair.a_own.encode(" " + t, add_special_tokens=False).ids), len(pair.b.encode(t)))


def test_parts_encode_as_whole_texts_do(pair):
    """Every code point beside blanks, letters and marks; the rank file's ids are the JSON file's."""
    chars = [chr(i) for i in range(1, 0x3000) if i != 0x2581]  # that one leaves a document without tokens
    texts = [shape.replace("?", "".join(c + " " + c + "a" for c in chars[i : i + 40])) for shape in ("?", "x ? .", "  ?") for i in range(0, len(chars), 40)]
    a, b = pair.encoded(texts)
    assert b.to_pylist() == pair.b.encode(texts)
    assert a.to_pylist() == [e.ids for e in pair.a_own.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_alignment_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert T.alignment(empty, *PATHS).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    rows = [tuple(r) for r in T.alignment(nulls, *PATHS).collect()]
    assert sorted(r[1] for r in rows) == [0, 2, 2, 2] and {r[6] for r in rows} == {0, 6}
