"""Operators on small fixtures: brute force, round trips, nulls, empties, ties, repeats and clashing columns."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import arc_convert, audio_fingerprint, chat_format, edit_counts, jaccard_join, language_id, mixing, quality_rules, sentencepiece_codec, toxicity
from tests.compare import duck, rows

P = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, taken long"


def docs(spark, texts, **more):
    return spark.createDataFrame([(i, t, more.get("lang", "en"), ("a", "b", None)[i % 3], len(t or ""), 5, 0.5, 1) for i, t in enumerate(texts)], DOC)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(r.randrange(40)) for _ in range(n))


def linked_groups(texts):
    sets = {}
    for i, t in enumerate(texts):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and 100 * both >= 75 * len(sets[a] | sets[b]):
            a, b = sorted((top(a), top(b)))
            root[b] = a
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_jaccard_join(spark):
    r = random.Random(5)
    texts = [None, "", "  \n", "One two", "one TWO", "one two three", prose(1, 3000)]
    for g in range(6):
        base = prose(g, 60 + 20 * g).split()
        for _ in range(14):
            w = list(base)
            for _ in range(r.randrange(0, 7)):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(w))
        texts.append(" ".join(base))
    shared = prose(77, 60)
    texts += [shared + " " + prose(100 + i, 25) for i in range(25)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.components(docs(spark, texts)).collect()}
    assert got == linked_groups(texts)
    assert jaccard_join.components(docs(spark, texts).limit(0)).count() == 0


def test_jaccard_join_repeated_and_null_ids(spark):
    import corpus_pipeline

    texts = [prose(i // 2, 70) + (" end" if i % 2 else "") for i in range(12)] + ["", None] + [prose(90 + i, 70) for i in range(10)]
    for i in range(10):  # shares 66 of 132 shingles and no more: half of the set, counted twice it would link
        texts.append(prose(90 + i, 70) + " " + prose(190 + i, 60))
    d = docs(spark, texts).coalesce(1)
    got = jaccard_join.components(d.union(d)).collect()
    want = linked_groups(texts)
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == sorted((i, *v) for i, v in want.items() for _ in range(2))
    same_id = d.withColumn("doc_id", F.lit(7).cast("long"))
    got = jaccard_join.classes(same_id.union(d).union(d.withColumn("doc_id", F.lit(None).cast("long")))).collect()
    assert len(got) == 3 * len(texts) and len({x.label for x in got if x.label}) == len({v[1] for v in want.values() if v[0]})
    alone = jaccard_join.components(d.withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert len(alone) == len(texts) and {x.component_id for x in alone} == {None}
    kept = corpus_pipeline.dedup(spark, same_id.union(d), SF).collect()
    assert sum(bool(x.text) for x in kept) == len({v[1] for v in want.values() if v[0]}) and sum(not x.text for x in kept) == 4


def test_sentencepiece(spark):
    import sentencepiece as sp

    lib = sp.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = [None, "", " ", "a", "  a   b ", " " * 37 + "x", "你好 мир\n\n x", "▁x▁ y", "😀a\tb", "<s> <0x0A> </s>", "a" * 5000, prose(3, 5000), "é\0 12345", prose(3, 50), prose(3, 50)]
    got = {x.doc_id: x for x in sentencepiece_codec.encoded(docs(spark, texts), P.path("piece_bpe_32k.model")).collect()}
    codec = sentencepiece_codec.Codec(P.path("piece_bpe_32k.model"))
    for i, t in enumerate(texts):
        ids = lib.encode(t or "")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)))
        assert codec.encode(t) == ids and codec.decode(ids) == lib.decode(ids)
    assert sentencepiece_codec.encoded(docs(spark, texts).limit(0), P.path("piece_bpe_32k.model")).count() == 0


def test_sentencepiece_marks_after_any_character():
    import sentencepiece as sp

    path = P.path("piece_bpe_32k.model")
    lib, codec = sp.SentencePieceProcessor(model_file=path), sentencepiece_codec.Codec(path)
    texts = ["m².", "cm².", "x ². y", "10 km². Then", "a²b².c", "²²..", "ab².,;:!?"]
    chars = {c for p in codec.rank for c in p if c.isalnum()} | set("²³¹¼½¾⅓①②⁴₂Ⅳ〇一١९٣")
    texts += [f"{w}{c}{m}{z}" for c in sorted(chars) for m in ".,;:!?" for w, z in (("", ""), ("km", ""), ("a ", "b"))]
    assert [t for t in texts if codec.encode(t) != lib.encode(t)] == []


def test_mixing(spark):
    quota = mixing.targets({"a": 100, "b": 10, None: 1000})
    assert quota["a"] == pytest.approx(1110 * 1 / 6 + (1110 * 2 / 6 - 30) / 4) and quota["b"] == 30 and sum(quota.values()) == pytest.approx(1110)
    sent = mixing.flow({("a",): 100, ("a", "b"): 50, ("b",): 10}, {"a": 120, "b": 40})
    assert sum(s.get("a", 0) for s in sent.values()) == 120 and sum(s.get("b", 0) for s in sent.values()) == 40
    assert all(sum(s.values()) <= n for s, n in zip(sent.values(), (100, 50, 10)))  # nothing repeats while fresh tokens do
    texts = [None, "", *[prose(i, 1 + i % 50) for i in range(600)]]
    got = mixing.query(docs(spark, texts)).collect()
    assert got and sorted(got) == sorted(mixing.query(docs(spark, texts).repartition(3)).collect())
    by = {}
    for x in got:
        assert x["size"] == len(WORD.findall(texts[x.doc_id] or "")) and x.taken <= 3 * x["size"]
        by.setdefault((x.target, x.source_size), [0])[0] += x.taken
    assert all(abs(t[0] - target) <= 50 for (target, _), t in by.items())
    assert mixing.query(docs(spark, texts).limit(0)).count() == 0


def test_mixing_shared_members(spark):
    r = random.Random(8)
    held = [["a"], ["a", "b"], ["b", "a", "b"], ["b"], ["b", None], ["a", "b", None]]
    data = [(i, r.randrange(1, 20), r.choices(held, (60, 20, 10, 4, 4, 2))[0]) for i in range(1500)]
    key = lambda m: tuple(sorted(set(m), key=lambda s: (s is None, s or "")))
    patterns, sizes = {}, {}
    for _, n, m in data:
        patterns[key(m)] = patterns.get(key(m), 0) + n
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    quota = mixing.targets(sizes)
    flow = mixing.flow(patterns, quota)
    sent = {p: sum(x.values()) for p, x in flow.items()}
    assert len(patterns) == 5 and any(sum(x.get(s, 0) > 0 for x in flow.values()) > 1 for s in sizes)  # patterns share a source
    got = mixing.mixed(spark.createDataFrame(data, "doc_id long, size long, members array<string>")).collect()
    assert sorted(x.doc_id for x in got) == list(range(1500)) and all(x.taken % x["size"] == 0 and x.taken <= 3 * x["size"] for x in got)
    for p in patterns:
        mine = [x for x in got if key(x.members) == p]
        assert abs(sum(x.taken for x in mine) - sent[p]) <= 20
        assert {x.source_size for x in mine} == {sum(sizes[s] for s in p)}
        passes = [x.taken // x["size"] for x in mine]
        assert max(passes) - min(passes) <= 1  # nothing repeats again while others wait


def test_quality(spark):
    line = "the cat and a dog of it"
    texts = [None, "", "\n\n", "a b a b a b a b", "\n".join([line] * 20), prose(1, 100) + " the of", prose(2, 20000), "#" * 500, line, line]
    for x in quality_rules.with_quality(docs(spark, texts)).collect():
        w = WORD.findall(texts[x.doc_id] or "")
        seen = {}
        for k in range(len(w) - 2):
            seen.setdefault(tuple(w[k : k + 3]), []).append(k)
        assert x.n_repeat_words == len({k + o for v in seen.values() if len(v) > 1 for k in v for o in range(3)})
        assert x.n_words == len(w) and x.word_chars == sum(map(len, w)) and x.base_failed == (len(w) < 50 or 2 * x.n_repeat_words > len(w))
        assert not (x.base_failed and x.kept) and x.source == ("a", "b", None)[x.doc_id % 3]
    assert quality_rules.query(docs(spark, texts).limit(0)).count() == 0
    got = quality_rules.query(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    assert rows(got) == rows(duck(SF, quality_rules.oracle_sql()))


def test_chat(spark):
    got = chat_format.query(spark.read.parquet(f"{SF}/conversations.parquet")).toPandas()
    assert rows(got) == rows(duck(SF, chat_format.ORACLE_SQL))
    t = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "a&lt;[x]</s>\n"), (1, 2, None, "z"), (1, 3, "assistant", "r2"), (1, 3, "assistant", "r2"), (None, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    e = chat_format.examples(t)
    full = {(x.conv_id, x.example_no): x for x in chat_format.expanded(e).collect()}
    assert [full[1, k].text[full[1, k].loss_start : full[1, k].loss_end] for k in range(3)] == ["a&amp;lt;&lb;x&rb;&lt;/s&gt;\n", "r2", "r2"]
    assert full[1, 1].text.startswith(full[1, 0].text)
    d = {x.conv_id: x for x in chat_format.digests(e).collect()}
    assert d[1].loss_sha256 == hashlib.sha256(b"a&lt;[x]</s>\nr2r2").hexdigest() and d[None].loss_chars == 0 and d[1].n_turns == 5
    assert chat_format.digests(chat_format.examples(t.limit(0))).count() == 0


@pytest.mark.parametrize("version", ["1", "2"])
def test_arc(spark, version):
    html = [None, "", "x\r\n\r\nWARC/1.1\r\n", "same", "same", "é" * 3000, "\nfiledesc:"]
    p = spark.createDataFrame([(i, None if i == 2 else f"http://h/a b{i}", h, "z") for i, h in enumerate(html)], "page_id long, url string, html string, path string")
    got = {x.page_id: x for x in arc_convert.query(p, version).collect()}
    for i, h in enumerate(html):
        first = next(k for k, x in enumerate(html) if (x or "") == (h or ""))
        data = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(data), arc_convert.digest(data), "response" if first == i else "revisit", None if first == i else first)
    assert arc_convert.query(p.limit(0), version).count() == 0


def test_toxicity(spark):
    r = random.Random(1)
    words = [f"w{a}{b}" for a in "abcdefgh" for b in "aeioulmn"]
    text = lambda bad: " ".join(r.choice(["wretchful", "blastedly"]) if bad and r.random() < 0.05 else r.choice(words) for _ in range(80))
    texts = [text(i % 2) for i in range(400)] + [None, ""]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(400)] + [(None, 1, 1), (0, 1, None)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.query(docs(spark, texts), labels).collect()}
    held = [i for i in range(400) if got[i].held_out]
    assert sum(got[i].predicted == i % 2 for i in held) >= 0.9 * len(held)
    assert got[400].predicted == 0 == got[401].predicted and all(0 <= x.score <= 1 for x in got.values())
    assert toxicity.query(docs(spark, texts).limit(0), labels.limit(0)).count() == 0


def test_toxicity_learns_behind_headers_and_in_long_texts(spark):
    r = random.Random(4)
    words = [f"w{a}{b}" for a in "abcdefgh" for b in "aeioulmn"]
    text = lambda bad: "one header that all of these texts share " + " ".join(r.choice(words) for _ in range(2500)) + " " + " ".join(r.choice(["wretchful", "blastedly"]) if bad and r.random() < 0.1 else r.choice(words) for _ in range(60))
    texts = [text(i % 2) for i in range(160)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(160)], "doc_id long, quality int, toxic int")
    held = [x for x in toxicity.query(docs(spark, texts), labels).collect() if x.held_out]
    assert sum(x.predicted == x.doc_id % 2 for x in held) >= 0.9 * len(held)
    base = prose(1, 100)
    assert toxicity.copied([base, base + " end", prose(2, 100), None, None, "a b", base[:60] + prose(3, 90)]).tolist() == [False, True] + [False] * 5


def test_language(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.query(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got >= 0.95
    odd = language_id.identified(docs(spark, [None, "", "12 !?", "x"]), None).collect()
    assert {x.lang_pred for x in odd} == {"und"}
    assert language_id.query(d.limit(0)).count() == 0


def test_edit_counts(spark):
    c = edit_counts.Counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    r = random.Random(2)
    for text in ["", " ", "a  b\n\n c 12", prose(4, 800)]:
        tree = edit_counts.Tree(text, c)
        for _ in range(30):
            tree.edit(r.randrange(len(tree.text) + 1), r.choice([0, 1, 5, 900]), r.choice(["", " ", "\n", "don't", "  x ", prose(9, 90)]))
            assert tree.total == len(c.encoding.encode_ordinary(tree.text)) and tree.sums[1, 0] == len(tree.text)
    tree = edit_counts.Tree(" ".join(prose(k, 800) for k in range(16)), c)
    for k in range(20):
        tree.edit(r.randrange(len(tree.text)), 0, " some more words")
    assert tree.built == 1 and tree.total == len(c.encoding.encode_ordinary(tree.text))
    tree.edit(100, 0, prose(3, 9000))
    assert tree.built == 2 and tree.total == len(c.encoding.encode_ordinary(tree.text))
    d = docs(spark, [None, "", " ", "Hi", "a\n\n b  c 12.5 don't", *[prose(k, 30 * k) for k in range(1, 12)], prose(5, 6000)])
    counted = {x.doc_id: x for x in edit_counts.query(d, P.path("byte_bpe_50k.tiktoken")).collect()}
    for row in edit_counts.own_edits(d).collect():
        text = row.text or ""
        for e in row.edits:
            at = min(e.start, len(text))
            text = text[:at] + (e.put or "") + text[at + e.length :]
        got = counted[row.doc_id]
        assert (got.tokens_after, got.chars_after) == (len(c.encoding.encode_ordinary(text)), len(text))
        assert got.tokens_before == len(c.encoding.encode_ordinary(row.text or ""))
    got = edit_counts.query(docs(spark, [None, "", "one two three four five"]), P.path("byte_bpe_50k.tiktoken")).collect()
    assert got[0].tokens_before == 0 == got[1].tokens_after
    assert edit_counts.query(docs(spark, ["a"]).limit(0), P.path("byte_bpe_50k.tiktoken")).count() == 0


def test_fingerprints(spark):
    r = random.Random(3)
    make = lambda: [r.gauss(0, 0.125) for _ in range(64)]
    vectors = [make() for _ in range(60)]
    vectors[50] = vectors[0][5:] + make()[:5]  # the same recording, five notes later
    vectors += [None, [], vectors[3]]
    v = spark.createDataFrame([(i * 10 if i else 0, x, 1) for i, x in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    got = {x.query_id: x for x in audio_fingerprint.query(v).collect()}
    assert (got[0].vec_id, got[0].offset) == (500, -10) and got[0].bit_error < 0.1
    same = audio_fingerprint.query(v.withColumn("vec_id", F.col("vec_id") * 10)).filter("query_id = 300").first()
    assert same.vec_id == 6200 and same.bit_error == 0 and same.copies == 1
    twice = audio_fingerprint.query(v.union(v.withColumn("embedding", F.transform("embedding", lambda x: F.when(x > 9, x).otherwise(x)))).withColumn("hits", F.lit("clash")))
    assert (0, 500) in {(x.query_id, x.vec_id) for x in twice.collect()}
    assert audio_fingerprint.query(v.limit(0)).count() == 0


def test_fingerprints_against_brute_force(spark):
    import numpy as np

    r = random.Random(6)
    make = lambda n: [r.gauss(0, 0.125) for _ in range(n)]
    vectors = []
    for _ in range(12):
        passage = make(16)
        base = passage + make(16) + passage + make(16)  # repeats a passage
        vectors += [base, base, base[10:] + make(10), base[24:] + make(24)]
        vectors += [[x if r.random() > 0.08 else y for x, y in zip(base, make(64))] for _ in range(3)]
    v = spark.createDataFrame([(i * 100, x) for i, x in enumerate(vectors)], "vec_id long, embedding array<double>")
    prints = [audio_fingerprint.fingerprint(audio_fingerprint.samples(x)) for x in vectors]
    first = {}
    of = [first.setdefault(p.tobytes(), i) for i, p in enumerate(prints)]
    want = set()
    for i, j in itertools.permutations(range(len(prints)), 2):
        n = len(prints[i])
        errors = [np.bitwise_count(prints[i][max(0, -o) :][: n - abs(o)] ^ prints[j][max(0, o) :][: n - abs(o)]).sum() / (32 * (n - abs(o))) for o in range(-(n // 2), n // 2 + 1)]
        if min(errors) <= 0.25 and (of[j] == j or of[i] == of[j]):
            want.add((i * 100, j * 100, round(float(min(errors)), 6)))
    got = {(x.query_id, x.vec_id, x.bit_error) for x in audio_fingerprint.matches(v, v).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 100
    assert {(x.query_id, x.vec_id, x.bit_error) for x in audio_fingerprint.query(v).collect()} == got  # every match


def test_fingerprints_in_noise(spark):
    """Recall by band of wrong bits; the limit of 0.25 stands here, whatever the module's is."""
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(4)
    clean = [audio_fingerprint.samples(r.normal(0, 0.125, 64)) for _ in range(60)]
    prints, queries, keys, want = [], [], ([], [], []), {}
    for i, x in enumerate(clean):
        prints.append((i, audio_fingerprint.fingerprint(x).tolist()))
        for k, sd in enumerate((0.5, 0.75, 1.0, 1.25, 1.5)):  # noise up to twice the power of the tone
            values = audio_fingerprint.levels(x + r.normal(0, sd, len(x)))
            mine, q = audio_fingerprint.packed(values), 1000 * (k + 1) + i
            queries.append((q, mine.tolist()))
            found, places = audio_fingerprint.probe_rows(values)
            for column, part in zip(keys, ([q] * len(found), found.tolist(), places)):
                column.extend(part)
            error = float(np.bitwise_count(mine ^ np.array(prints[i][1], np.uint32)).mean() / 32)
            if error <= 0.25:
                want[q, i] = error
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, print array<long>")
    table = pa.table({"query_id": pa.array(keys[0], pa.int64()), "key": pa.array(keys[1], pa.int64()), "qs": pa.array(keys[2], pa.list_(pa.int32()))})
    found = audio_fingerprint.aligned(frame(prints), frame(queries), spark.createDataFrame(table)).collect()
    got = {(x.query_id, x.vec_id) for x in found if x.offset == 0}
    assert len(want) > 200 and len(want.keys() & got) >= 0.9 * len(want)
    near = {k for k, e in want.items() if e <= 0.2}
    assert len(near) > 100 and len(near & got) >= 0.97 * len(near)
    far = [k for k, e in want.items() if e > 0.2]
    print("from 0.2 to 0.25:", len(far), len(set(far) & got))


def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0 < got.count() and got.select("doc_id").distinct().count() <= n
    d = spark.read.parquet(f"{SF}/documents.parquet").withColumn("kept", F.lit(1)).withColumn("size", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d, SF).columns == d.columns, name
        stage(spark, d.limit(0), SF).count()


def test_sentencepiece_of_a_long_part_without_spaces():
    import time

    import sentencepiece

    model = P.path("piece_bpe_32k.model")
    codec, library, r = sentencepiece_codec.Codec(model), sentencepiece.SentencePieceProcessor(model_file=model), random.Random(9)
    text = "".join(r.choice("abcdefghijklmnopqrstuvwxyzäé漢字") for _ in range(320_000))
    codec.encode(text[:20_000])
    began = time.process_time()
    assert codec.encode(text) == library.encode(text)
    assert time.process_time() - began < 8  # a second or two; it was 12.7 and grew with the square


def test_quality_stage_keeps_columns_of_any_name(spark):
    import corpus_pipeline

    rows = spark.createDataFrame([(1, prose(1, 80), "KEEP", "kept?"), (2, "no", "KEEP", "kept?")], "doc_id long, text string, _m string, kept string")
    got = corpus_pipeline.quality(spark, rows, "")
    assert got.columns == rows.columns and all(r["_m"] == "KEEP" and r["kept"] == "kept?" for r in got.collect())


def test_chat_turns_without_a_number_come_last(spark):
    t = spark.createDataFrame([(1, None, "assistant", "z"), (1, 5, "user", "a"), (1, None, "assistant", "b"), (1, 0, None, None)], "conv_id long, turn long, role string, text string").withColumns({"segment": F.lit(1), "last": F.lit(2), "turns": F.lit(3)})
    got = chat_format.query(t).filter("conv_id = 1").first()
    said = "".join(f"{r}\n{x}\n" for r, x in (("", ""), ("user", "a"), ("assistant", "b"), ("assistant", "z")))
    assert got.turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got.loss_sha256 == hashlib.sha256(b"bz").hexdigest()
    full = {r.example_no: r for r in chat_format.expanded(chat_format.examples(t)).collect()}
    assert [full[k].text[full[k].loss_start : full[k].loss_end] for k in sorted(full)] == ["b", "z"] and full[1].text.startswith(full[0].text)


def test_pages_without_an_id_revisit_the_one_that_has_one(spark):
    p = spark.createDataFrame([(None, "u", "same"), (5, "u", "same"), (None, "v", "same"), (7, "v", "same"), (None, "w", "alone"), (None, "x", "alone"), (9, "y", "z" * 9_000_000)], "page_id long, url string, html string")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in arc_convert.query(p).collect()), key=str)
    assert got == sorted([(None, 4, "revisit", 5), (5, 4, "response", None), (None, 4, "revisit", 5), (7, 4, "revisit", 5), (None, 5, "response", None), (None, 5, "response", None), (9, 9_000_000, "response", None)], key=str)


def test_fingerprints_leave_no_pair_out(spark):
    """All pairs within 0.25 wrong bits, also those without an integer in common, of several lengths, with repeated and missing ids."""
    import numpy as np

    r = random.Random(12)
    make = lambda n: [r.gauss(0, 0.125) for _ in range(n)]
    vectors = []
    for n in (24, 24, 31):
        base = make(n)
        for sd in range(10):  # every note a little off
            vectors += [[x + r.gauss(0, sd / 200) for x in part] for part in (base, base[4:])]
    prints = [audio_fingerprint.fingerprint(audio_fingerprint.samples(x)) for x in vectors]

    def error(p, q):
        out = []
        for o in range(-len(p) + 1, len(q)):
            a, b = p[max(0, -o) :], q[max(0, o) :]
            n = min(len(a), len(b))
            if 2 * n >= min(len(p), len(q)):
                out.append(int(np.bitwise_count(a[:n] ^ b[:n]).sum()) / (32 * n))
        return min(out)

    want = {(i * 100, j * 100): e for i, j in itertools.permutations(range(len(prints)), 2) if (e := error(prints[i], prints[j])) <= 0.25}
    bare = {(i, j) for i, j in want if not set(audio_fingerprint.probed(audio_fingerprint.levels(audio_fingerprint.samples(vectors[i // 100]))).ravel().tolist()) & set(prints[j // 100].tolist())}
    assert len(want) > 300 and len(bare) > 100  # some pairs share no integer, however many bits are turned
    v = spark.createDataFrame([(i * 100, x) for i, x in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = audio_fingerprint.query(v).collect()
    assert sorted((x.query_id, x.vec_id) for x in found) == sorted(want) and all(abs(x.bit_error - want[x.query_id, x.vec_id]) < 1e-6 for x in found)
    odd = v.filter("vec_id < 300").union(v.filter("vec_id = 0")).union(v.filter("vec_id < 200").withColumn("vec_id", F.lit(None).cast("long")))
    got = {(x.query_id, x.vec_id): x.copies for x in audio_fingerprint.query(odd).collect()}
    assert got[0, 0] == 2 and got[0, 100] == 2 and got[100, None] == 1 and got[100, 0] == 3 and (None, 0) not in got


def test_chat_examples_hold_their_whole_context(spark):
    said = [(k, ("user", "assistant", "tool")[k % 3], f"t{k} [x]</s>") for k in range(3000)]
    t = spark.createDataFrame([(1, *x) for x in said] + [(2, 0, "user", "alone"), (3, 0, "assistant", None)], "conv_id long, turn long, role string, text string")
    e = chat_format.examples(t)
    shown = [f"[{role}]{text.replace('<', '&lt;').replace('>', '&gt;').replace('[', '&lb;').replace(']', '&rb;')}</s>\n" for _, role, text in said]
    got = {x.example_no: x for x in e.filter("conv_id = 1 and (example_no < 2 or example_no > 998)").collect()}
    for no, n in ((0, 2), (1, 5), (999, 2999), (1000, 3000)):
        x = got[no]
        assert x.text == "".join(shown[:n]) and x.n_turns == n and x.trained == (no < 1000) and x.whole == (no == 1000)
        assert not x.trained or x.text[x.loss_start : x.loss_end] == shown[n - 1][len("[assistant]") : -len(chat_format.END)]
    rest = {x.conv_id: x for x in e.filter("conv_id > 1").collect()}
    assert (rest[2].text, rest[2].trained, rest[3].text, rest[3].loss_start, rest[3].loss_end) == ("[user]alone</s>\n", False, "[assistant]</s>\n", 11, 11)
    d = {x.conv_id: x for x in chat_format.digests(e).collect()}  # read from each example's own text
    assert d[1].loss_sha256 == hashlib.sha256("".join(x for _, role, x in said if role == "assistant").encode()).hexdigest() and d[1].n_turns == 3000
    other = chat_format.digests(e.withColumn("text", F.when(F.col("example_no") == 7, F.regexp_replace("text", "t22 ", "T22 ")).otherwise(F.col("text")))).filter("conv_id = 1").first()
    assert other.loss_sha256 != d[1].loss_sha256 and other.turns_sha256 == d[1].turns_sha256


def test_sentencepiece_part_caches_within_the_given_bound(spark):
    texts = [" ".join(f"w{k}x{j}" for k in range(400)) for j in range(30)]
    d = docs(spark, texts)
    small = sentencepiece_codec.encoded(d, P.path("piece_bpe_32k.model"), 50_000)
    assert sorted(small.collect()) == sorted(sentencepiece_codec.encoded(d, P.path("piece_bpe_32k.model")).collect())
    codec = sentencepiece_codec.Codec(P.path("piece_bpe_32k.model"), 50_000)
    for x in texts:
        codec.encode(x)
        assert (len(codec.cache) + len(codec.older)) * sentencepiece_codec.ENTRY < 110_000


def test_fingerprints_of_mixed_lengths_take_little_memory(monkeypatch):
    """Short queries meet a long recording without the spectra of all of them at once; each recording is transformed once a block."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(5)
    long, starts = r.integers(0, 2**32, (1, 20_000), np.uint32), r.integers(0, 19_988, 100)
    tracemalloc.start()
    i, j, offset, error, hits = audio_fingerprint.votes(long[0][starts[:, None] + np.arange(12)], long)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert i.tolist() == list(range(100)) and offset.tolist() == starts.tolist() and not error.any() and (hits == 12).all() and not j.any()
    assert peak < 100e6, peak

    made, spectra = [], audio_fingerprint._spectra
    monkeypatch.setattr(audio_fingerprint, "_spectra", lambda x, size: made.append(len(x)) or spectra(x, size))
    prints = r.integers(0, 2**32, (300, 112), np.uint32).astype(np.int64)
    prints[200:] = prints[:100] ^ (1 << 5)
    block = lambda name, at: pa.table({name: pa.array(at), "print": pa.array([prints[k].tolist() for k in at], pa.list_(pa.int64()))})
    found = audio_fingerprint.met(block("query_id", range(256)), block("vec_id", range(300))).to_pylist()
    assert sum(made) == 256 + 300
    assert {(x["query_id"], x["vec_id"], x["offset"], x["bit_error"]) for x in found} == {(a, b, 0, 0.03125) for k in range(100) for a, b in ((k, k + 200), (k + 200, k)) if a < 256} and len(found) == 156


def test_names_are_not_broadcast(spark):
    """Names grow with the documents, and `spread` repeats them: a broadcast would meet the driver's memory."""
    rows = spark.range(1000).select(F.col("id").alias("cid"), (F.col("id") % 7).alias("comp"))
    names = spark.range(6).select(F.col("id").alias("comp"), (F.col("id") * 10).alias("label"))
    out = jaccard_join.spread(rows, names, "comp")
    got = {r.cid: r.label for r in out.collect()}
    assert got == {i: i % 7 * 10 if i % 7 < 6 else None for i in range(1000)}
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
