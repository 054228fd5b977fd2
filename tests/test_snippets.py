"""Snippets against a plain search for the best stretch."""

import random
import re

from loomlog.operators import snippets


def plain(text, query, width):
    asked = set(re.findall(r"[^\W_]+", query.lower()))
    places = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text or "") if m.group().lower() in asked]
    best = None
    for _, start, stop in places:
        near = [p for p in places if p[1] >= start and (p[2] <= start + width or p[2] == stop)]
        ends = {}
        for t, _, e in near:
            ends[t] = min(e, ends.get(t, e))
        key = (-len(ends), max(ends.values()) - start, start)
        best = min(best, (*key, max(ends.values())), key=lambda x: x[:3]) if best else (*key, max(ends.values()))
    if not best:
        return None
    c, n, start, stop = best
    begin = max(min(start - max(width - n, 0) // 2, len(text) - width), 0)
    end = min(max(begin + width, stop), len(text))
    return -c, ("..." if begin else "") + text[begin:end] + ("..." if end < len(text) else "")


def test_snippets(spark):
    r = random.Random(6)
    word = lambda: r.choice("Alpha beta GAMMA été naïve x1 zeta eta".split() + [f"w{r.randrange(50)}" for _ in range(12)])
    texts = [r.choice([" ", ", ", "\n— "]).join(word() for _ in range(n)) for n in (1, 5, 40, 200, 900) for _ in range(6)] + [None, "", "?!", "gamma", "z" * 300 + " alpha " + "y" * 300, "alpha" + "b" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    asked = [(1, "alpha BETA gamma"), (2, "été"), (3, "absent"), (4, "alpha" + "b" * 500)]
    queries = spark.createDataFrame(asked, "query_id int, query string")
    hits = queries.select("query_id").crossJoin(docs.select("id"))
    for width in (30, 240):
        got = {(x.query_id, x.id): (x.covered, x.snippet) for x in snippets.snippets(hits, docs, "id", "text", queries, width).collect()}
        want = {(q, i): found for q, query in asked for i, t in enumerate(texts) if (found := plain(t, query, width))}
        assert got == want


def test_pieces_are_not_shuffled(spark):
    """Words that nobody asked for don't leave their row, and places go on over blocks."""
    docs = spark.createDataFrame([(1, "été, " * 700 + "beta" + " x" * 900 + " Beta"), (2, ""), (3, None)], "id int, text string")
    asked = spark.createDataFrame([(1, "beta")], "query_id int, query string")
    found = snippets.term_places(asked.select("query_id").crossJoin(docs.select("id")), docs, "id", "text", asked)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, "beta", 3500, 3504), (1, 1, "beta", 5305, 5309)]
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
