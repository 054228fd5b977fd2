"""Leaked passages, periodic runs and hard negatives against plain versions, on awkward rows."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from loomlog.llm import leaks, negatives, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "extra string, doc_id long, text string, TEXT string, spans string, n_words int"
ITEMS = "item_id long, text string, ITEM_ID string, pattern string"


def folded(t):
    return FOLDED.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def plain_leaks(docs, items, window=10):
    held = {}
    for item, t in items:
        ws = folded(t)
        k = min(window, len(ws))
        for i in range(len(ws) - k + 1 if k else 0):
            held.setdefault(tuple(ws[i : i + k]), set()).add(item)
    sizes, out = {len(w) for w in held}, []
    for doc, t in docs:
        ws, hit, found = folded(t), set(), set()
        for k in sizes:
            for i in range(len(ws) - k + 1):
                if (w := tuple(ws[i : i + k])) in held:
                    hit |= set(range(i, i + k))
                    found |= held[w]
        out.append((doc, len(ws), len(hit), sorted(str(i) for i in found if i is not None)))
    return sorted(out, key=str)


def leak_rows(seed=3):
    r = random.Random(seed)
    word = lambda: r.choice(["Straße", "eins", "TWO", "drei", "é4", "x", "日本", "ÀB", "five", "6"])
    line = lambda n: " ".join(word() for _ in range(n))
    items = [(i, line(r.choice([1, 3, 9, 10, 11, 25]) if i else 30)) for i in range(25)]
    items += [(3, items[0][1]), (None, line(14)), (40, None), (41, ""), (42, "?!"), (43, items[0][1].upper())]
    docs = []
    for i in range(60):
        parts = [line(r.randrange(0, 12)) for _ in range(4)]
        if i % 3 == 0:
            parts.insert(2, r.choice([t for _, t in items if t]).replace(" ", r.choice([" ", "\n", ", ", "-\x00'"])))
        docs.append((i, "·".join(parts) if i % 2 else " ".join(parts)))
    docs += [docs[0], (None, docs[3][1]), (90, None), (91, ""), (92, "\t"), (93, items[0][1]), (94, (items[0][1] + " ") * 400 + line(20_000))]
    return docs, items


def test_leaks(spark):
    docs, items = leak_rows()
    table = spark.createDataFrame([("e", i, t, "T", "s", 1) for i, t in docs], DOCS)
    tests = spark.createDataFrame([(i, t, "I", "p") for i, t in items], ITEMS)
    expected = plain_leaks(docs, items)
    texts = {d: t for d, t in docs if d is not None}
    for size in (leaks.PATTERN_BYTES, 3_000):  # one automaton, several
        rows = leaks.passages(table, tests, pattern_bytes=size).collect()
        assert sorted(((r.doc_id, r.n_words, sum(s.end - s.begin for s in r.spans), list(r["items"])) for r in rows), key=str) == expected
        for r in rows:
            assert all(a.end < b.begin for a, b in zip(r.spans, r.spans[1:], strict=False))
            words = folded(texts.get(r.doc_id))
            for s in r.spans if r.doc_id is not None else []:  # spans are told in the original's own characters
                assert folded(texts[r.doc_id][s.start : s.stop]) == words[s.begin : s.end]
    none = tests.limit(0)
    assert all(not r.spans and not r["items"] for r in leaks.passages(table, none).collect())
    assert leaks.passages(table.limit(0), tests).collect() == []


def test_leaks_of_a_line_that_many_items_share(spark):
    line = " ".join(f"w{i}" for i in range(12))
    items = spark.createDataFrame([(i, f"{line} own{i}") for i in range(3_000)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"a {line} b") for i in range(50)], "doc_id long, text string")
    rows = leaks.passages(docs, items).collect()
    assert {(len(r["items"]), tuple((s.begin, s.end) for s in r.spans)) for r in rows} == {(3_000, ((1, 13),))}


def plain_runs(ws, repeats=4, least=6):
    found = {}
    for q in range(1, len(ws) // repeats + 1):
        i = 0
        while i + q < len(ws):
            if ws[i] != ws[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(ws) and ws[j] == ws[j + q]:
                j += 1
            if j + q - i >= max(least, repeats * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(ws, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


@pytest.mark.parametrize("repeats, least", [(4, 6), (3, 3), (5, 20)])
def test_runs_of_short_words(repeats, least):
    r = random.Random(repeats)
    for n in range(1_200):
        ws = [r.choice("ab" if n % 2 else "abc") for _ in range(r.randrange(0, 70))]
        if n % 3 == 0:
            ws = (ws[: r.randrange(1, 12)] or ["a"]) * r.randrange(1, 9) + ws[:9]
        codes = runs.np.array([ord(c) for c in ws], dtype=runs.np.int64)
        assert runs.runs_of(codes, repeats, least) == plain_runs(ws, repeats, least)
        cut = [(int(a) + s, k, q) for a, b in zip(*runs.stretches(codes, codes * 0, repeats, least), strict=True) for s, k, q in runs.runs_of(codes[a:b], repeats, least)]
        assert cut == plain_runs(ws, repeats, least)


def test_blocks_of_ordered_ends(monkeypatch):
    monkeypatch.setattr(runs, "BLOCK", 4)
    r = random.Random(1)
    order = r.sample(range(500), 500)
    ends, known = runs._Ends(order[0]), [order[0]]
    for x in order[1:]:
        assert ends.add(x) == (max((k for k in known if k < x), default=-1), min((k for k in known if k > x), default=-1))
        known.append(x)
    assert list(ends) == sorted(order)
    assert runs.runs_of(runs.np.zeros(3_000, dtype=runs.np.int64)) == [(0, 3_000, 1)]


def run_rows(seed=5):
    r = random.Random(seed)
    word = lambda: r.choice("alpha beta gamma é日 # 1".split())
    rows = []
    for i in range(70):
        ws = [word() for _ in range(r.randrange(0, 60))]
        if i % 3 == 0:
            ws += [word() for _ in range(r.randrange(1, 9))] * r.randrange(1, 8) + ws[:5]
        rows.append((i, r.choice([" ", "\n", "\t "]).join(ws)))
    fixed = [word() + str(r.randrange(9)) for _ in range(700)]
    return rows + [rows[3], (None, "a b " * 9), (200, None), (201, ""), (202, "\n \t"), (203, "one"), (204, " ".join(fixed * 5 + ["x"] * 900 + fixed)), (205, "z " * 3_000), (206, " ".join(r.choice("ab") + str(i % 7) for i in range(9_000)))]


def planted(doc, t):
    ws = WORD.findall(t or "")
    if doc is None or not ws or (h := zlib.crc32(str(doc).encode())) % 10:
        return ws
    g = h // 10
    a = g % len(ws)
    p = 1 + (len(ws) - a) // (3 + g % 8)
    return [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]


def test_periodic_runs(spark, tmp_path):
    rows = run_rows()
    table = spark.createDataFrame([("e", i, t, "T", "s", 1) for i, t in rows], DOCS)
    plain = lambda ws: (len(ws), f := plain_runs(ws), collapsed(ws, f))
    found = runs.periodic_runs(table).collect()
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found), key=str) == sorted(((i, *plain(WORD.findall(t or ""))) for i, t in rows), key=str)
    assert runs.periodic_runs(table.limit(0)).collect() == []
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for i, t in rows:
        _, f, left = plain(planted(i, t))
        best = min(f, key=lambda x: (-x[1], x[0], x[2])) if f else None
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(f, key=lambda x: (x[0], x[2])))
        expected.append((i, len(f), *(best or (None,) * 3), 1000 * best[1] // best[2] if f else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, left))))
    assert sorted(map(tuple, runs.op12_periodic_runs(spark, str(tmp_path)).collect()), key=str) == sorted(expected, key=str)


def integers(v, scale=256):
    whole = lambda x: math.floor(x * scale) if abs(x) < 2.0**900 else int(x) * scale
    return [whole(x) for x in v]


def plain_negatives(rows, positives=5, negatives_=5):
    good = [(i, b, integers(v)) for i, v, b in rows if i is not None and b is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: min(max(sum(x * y for x, y in zip(a, b, strict=True)), negatives.LEAST), negatives.MOST)
    out = []
    for i, b, v in good:
        if i % 10:
            continue
        others = sorted(((-score(v, w), j, c) for j, c, w in good if j != i and len(w) == len(v)))
        for s, j, _ in [o for o in others if o[2] == b][:positives]:
            fit = [o for o in others if o[2] != b and 80 * -s <= 100 * -o[0] <= 100 * -s][:negatives_]
            out += [(i, j, n + 1, o[1], -s, -o[0]) for n, o in enumerate(fit)]
    return sorted(out)


def vector_rows(kind, seed=11):
    r = random.Random(seed)
    d = 6
    vector = lambda: [r.uniform(-1, 1) for _ in range(d)]
    common = vector()
    rows = [(i, vector() if i % 3 else list(common), r.randrange(4)) for i in range(400)]
    if kind == "awkward":
        rows += [(500 + i, x, y) for i, (x, y) in enumerate([(None, 1), ([], 1), ([1.0, None] * 3, 1), ([math.nan] * 6, 2), ([math.inf] * 6, 2), (vector(), None), ([0.5, 0.25], 1), ([0.5, 0.3], 2), ([0.0] * 6, 1)])]
        rows += [rows[10], rows[10], (20, vector(), 1), (None, vector(), 1), (20, list(common), 2), (30, rows[30][1], 3), (520, [1.0, 0.5], 1)]
        rows += [(600, [-x for x in common], 1)]
    if kind == "huge":
        rows = rows[:60] + [(700 + i, [r.choice([1e300, -1e300, 1.7e308, 3e5, 1e-3, -5e18]) for _ in range(d)], i % 3) for i in range(30)]
    return rows


@pytest.mark.parametrize("kind", ["plain", "awkward", "huge"])
def test_hard_negatives(spark, kind, monkeypatch):
    rows = vector_rows(kind)
    for cells, group, scan in ((negatives.BLOCK_CELLS, 4, 128), (150, 3, 4)):  # one block; many, in groups
        monkeypatch.setattr(negatives, "BLOCK_CELLS", cells)
        monkeypatch.setattr(negatives, "GROUP_BLOCKS", group)
        monkeypatch.setattr(negatives, "SCAN", scan)
        table = spark.createDataFrame([("x", i, v, b, "L", 0.0) for i, v, b in rows], "rid string, vec_id long, embedding array<double>, label int, LABEL string, v double").repartition(3)
        found = negatives.hard_negatives(negatives.labelled_vectors(table), F.col("vec_id") % 10 == 0)
        assert sorted(map(tuple, found.collect())) == plain_negatives(rows)
    nothing = negatives.labelled_vectors(table.limit(0))
    assert negatives.hard_negatives(nothing, F.col("vec_id") % 10 == 0).collect() == []
