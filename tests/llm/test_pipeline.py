"""The whole pipeline against a plain version of its five stages, on awkward rows."""

import os
import random
import re
import struct
import sys
import zlib
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from test_text_operators import components, given_tokenizer

import corpus_pipeline
from loomlog.llm import mixing, pii
from loomlog.llm.shared import _TABLES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=0):
    r = random.Random(seed)
    words = lambda k: [r.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(r.randrange(80)) for _ in range(k)]
    base, rows = words(120), []
    for i in range(150):
        kind, host = i % 10, r.choice(["a.org", "https://www.a.org/x", "b.org", None])
        if kind == 0:
            text = " ".join(base)
        elif kind == 1:
            own = list(base)
            own[r.randrange(120)] = f"new{i}"
            text = "\t".join(own)
        elif kind == 2:
            text, host = "#$% " * 9 + " ".join(words(30)), "bad.org"
        elif kind == 3:
            text = r.choice([None, "", "two words", "again and again so " * 9])
        elif kind == 4:
            text = " ".join(words(20)) + r.choice([f" write to me{i}@ex.org", f" call +1 (168) 555-{1000 + i}", " card 4111 1111 1111 1111"])
        elif kind == 5:
            text, host = " ".join(words(30)), "bad.org" if i % 50 == 5 else host
        else:
            text = " ".join(words(r.choice([15, 60, 400, 1500])))
        rows.append((i, text, host, None if text is None else len(text)))
    return rows + [rows[6], rows[6], (None, " ".join(words(40)), "b.org", 1), (9, "another text under an id that is taken " + " ".join(words(12)), None, 5)]


def by_host(rows):
    """The rows that the rules keep."""
    judged, hosts = [], {}
    for row in rows:
        text = row[1] or ""
        w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        counts = Counter(grams)
        twice = {p for k, g in enumerate(grams) if counts[g] > 1 for p in range(k, k + 5)}
        base = len(w) < 10 or 100 * len(twice) > 20 * len(w)
        soft = 100 * sum(c in "#*$%&|<>" for c in text) > 10 * sum(map(len, w)) or 100 * (len(lines) - len(set(lines))) > 30 * len(lines)
        host = re.sub(r"^https://www\.|/.*$", "", row[2] or "")
        judged.append((row, base, soft, host))
        n, f = hosts.get(host, (0, 0))
        hosts[host] = n + 1, f + (base or soft)
    total, failed = sum(n for n, _ in hosts.values()), sum(f for _, f in hosts.values())
    m, k = failed / total, len(hosts)
    v = (sum(f * f / n for n, f in hosts.values()) - total * m * m - (k - 1) * m * (1 - m)) / (total - sum(n * n for n, _ in hosts.values()) / total - (k - 1))
    s = m * (1 - m) / v - 1
    bad = {h for h, (n, f) in hosts.items() if (f + m * s) / (n + s) >= 0.5}
    assert "bad.org" in bad
    return [row for row, base, soft, host in judged if not base and not (soft and host in bad)]


def test_pipeline(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    key = lambda r: str(tuple(r))
    before = set(_TABLES)
    outs = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, ""), name)
        outs.append(docs)
    ruled, single, clean, mixed = outs
    want = by_host(rows)
    assert sorted(map(tuple, ruled.collect()), key=key) == sorted(want, key=key) and 60 < len(want) < 140

    classes = components([(r[0], r[1]) for r in want], 5, 80)
    kept, seen = [], set()
    for row, (_, _, _, ok) in zip(want, classes, strict=True):
        if ok and (row[0] is None or (row[0], row[1]) not in seen):
            kept.append(row)
            seen.add((row[0], row[1]))
    assert sorted(map(tuple, single.collect()), key=key) == sorted(kept, key=key) and len(kept) < len(want) - 20

    redacted = []
    for i, text, source, n in kept:
        new = re.sub(r"me\d+@ex\.org", "<email>", text)
        new = re.sub(r"\+1 \(168\) 555-\d{4}", "<phone>", new).replace("4111 1111 1111 1111", "<card>")
        assert not pii.find(new)
        redacted.append((i, new, source, len(new)))
    assert sorted(map(tuple, clean.collect()), key=key) == sorted(redacted, key=key) and {tuple(r) for r in redacted} != set(kept)

    assert sorted(map(tuple, mixed.collect()), key=key) == sorted(redacted, key=key)
    slots = {(r.c0, r.c1): (r._slot, r._start) for r in mixing.mixed_blocks(clean).collect()}
    order = [slots[r.doc_id, r.text] for r in mixed.selectExpr("*", "_metadata.file_name AS f", "_metadata.row_index AS n").orderBy("f", "n").collect()]
    assert order == sorted(order)

    tokenizer, pieces = given_tokenizer(), []
    for i, text, _, _ in redacted:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        head = len(ids) % 1024 or 1024
        cuts = [0] if len(ids) <= 1024 else [0, *range(head, len(ids), 1024)]
        pieces += [(i, k, s, e - s, zlib.crc32(struct.pack(f"<{e - s}I", *ids[s:e]))) for k, (s, e) in enumerate(zip(cuts, [*cuts[1:], len(ids)], strict=True))]
    got = corpus_pipeline.STAGES[-1][1](spark, mixed, "").collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(pieces, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:])) and sorted(parts)[0][0] == 0 and sum(n for _, n in parts) <= 1024
    assert len(bins) <= sum(p[3] for p in pieces) / 1024 * 1.02 + 1
    assert set(_TABLES) > before


def test_run_is_its_stages_and_leaves_little(spark, tmp_path):
    docs = spark.createDataFrame(corpus(1), "doc_id long, text string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    before = set(_TABLES)
    total = corpus_pipeline.run(spark, str(tmp_path))
    left = {p.rsplit("/", 1)[1].split("-")[1] for p in set(_TABLES) - before}
    assert left == {"source_mix", "pieces"}  # the last stage's input and pieces; every other table is gone
    assert total.count() > 60 and total.select("doc_id").distinct().count() < 150


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
