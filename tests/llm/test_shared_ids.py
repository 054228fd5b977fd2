"""Ids that several texts share, boilerplate in many documents, and columns of like names."""

import hashlib
import random

import corpus_pipeline
from loomlog.llm import packing, phrases, pii
from loomlog.llm.shared import told_apart, written


def plain(rows, window=13):
    first = {}
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - window + 1):
            if i is not None:
                g = tuple(w[k : k + window])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w = (t or "").split()
        gone = {p for k in range(len(w) - window + 1) if i is not None and first[tuple(w[k : k + window])] < i for p in range(k, k + window)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def test_texts_of_one_id_lose_only_their_own_words(spark, monkeypatch):
    r = random.Random(2)
    words = lambda n: " ".join(f"w{r.randrange(10_000)}" for _ in range(n))
    a, b, c, k = words(40), words(30), words(60), words(11)
    part = " ".join(c.split()[20:38])
    rows = [(1, a), (7, a), (7, b), (8, c), (8, k + " " + part), (9, part + " " + k), (9, words(25)), (9, b), (3, c), (3, None), (3, ""), (10, a + " " + b), (10, b), (10, b), (None, a)]
    rows += [(i // 2, words(3) + " " + part + " " + words(2)) for i in range(20, 60)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for shards in (phrases.SHARD_SEGMENTS, 2):
        monkeypatch.setattr(phrases, "SHARD_SEGMENTS", shards)
        assert sorted((tuple(x) for x in phrases.without_repeats(table).collect()), key=str) == plain(rows)


def test_a_line_that_long_documents_repeat(spark):
    line = " ".join(f"boiler{i}" for i in range(17))
    rows = [(i, f"own{i} " + " ".join([line, f"x{i}"] * 40)) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted((tuple(x) for x in phrases.without_repeats(table).collect()), key=str) == plain(rows)


def test_names_that_differ_in_case_only():
    assert told_apart(["doc_id", "TEXT", "text", "Text"]) == ["doc_id", "TEXT_2", "text", "Text_3"]
    assert told_apart(["A", "a_2", "a", "b"]) == ["A_3", "a_2", "a", "b"]
    assert told_apart(["x", "x"]) == ["x", "x_2"]


def test_stages_with_clashing_columns(spark):
    rows = [(i, f"{i} " + " ".join(f"word{(i * j) % 97}" for j in range(40)), "en", f"s{i % 3}", 1, "T", "m") for i in range(30)] + [(None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, TEXT string, _metadata string").toDF("doc_id", "text", "lang", "source", "n_chars", "TEXT", "_metadata")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, ""), name)
        assert [c.lower() for c in docs.columns][:5] == ["doc_id", "text", "lang", "source", "n_chars"] and docs.columns[5:] == ["TEXT_2", "_metadata"]
    packed = packing.pack_in_order(docs).collect()
    assert {p.doc_id for p in packed} == {d.doc_id for d in docs.collect()}
    assert packing.pack_in_order(written(docs.limit(0), "none")).collect() == []


def test_private_keys_of_any_length(spark):
    key = lambda n: "-----BEGIN RSA PRIVATE KEY-----\n" + "A1+/" * n + "\n-----END RSA PRIVATE KEY-----"
    texts = ["key: " + key(100), "a " + key(6_000) + " b " + key(60_000), "-----BEGIN PRIVATE KEY-----" * 4_000, key(5).replace("END", "DONE")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.text.count("BEGIN RSA") for r in pii.redacted(docs).select("doc_id", "text").collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 1}
