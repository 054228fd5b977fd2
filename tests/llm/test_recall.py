"""Near duplicates of the test documents against an exact search over all pairs that share a shingle."""

import re
from collections import Counter, defaultdict

import pytest

from loomlog.llm import neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def exact(rows, k, percent):
    """doc_id: smallest doc_id reachable by links, from counts of common shingles."""
    sets, postings = {}, defaultdict(list)
    for i, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
        for g in sets[i]:
            postings[g].append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, own in sets.items():
        for j, n in Counter(x for g in own for x in postings[g] if x < i).items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("k", [4, 5])
def test_no_link_is_lost(spark, k):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = exact([(r.doc_id, r.text) for r in docs.collect()], k, 80)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, k).collect()}
    assert got == want
    assert sum(i != c for i, c in want.items()) > 50
