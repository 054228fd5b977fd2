"""The packing stage keeps the order of the mix."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline
from loomlog.llm import mixing, packing
from loomlog.llm.shared import written


def test_sequences_follow_the_weights(spark):
    """Sources a and b share the slots alike although a has four times the documents, until b runs out."""
    made = spark.range(20_000).selectExpr("id AS doc_id", "IF(id % 5 < 4, 'a', 'b') AS source", "concat('number ', cast(1000000 + id AS string), ' of many') AS text")
    mixed = written(mixing.mixed_order(made, block_bytes=1000, weights={"a": 1.0, "b": 1.0}), "test-mix")
    packed = corpus_pipeline.packed(spark, mixed, "")
    got = packed.select("doc_id", "sequence_id", "offset", "length").collect()
    assert sorted(r.doc_id for r in got) == list(range(20_000))
    got.sort(key=lambda r: (r.sequence_id, r.offset))
    # three whole windows, in which both sources still have blocks
    head = got[: 3 * packing.WINDOW_PIECES]
    assert abs(sum(r.doc_id % 5 < 4 for r in head) / len(head) - 0.5) < 0.02
    tail = got[-packing.WINDOW_PIECES :]
    assert all(r.doc_id % 5 < 4 for r in tail)
    slots = {r.c0: (r._slot, r._start) for r in mixing.mixed_blocks(made, block_bytes=1000, weights={"a": 1.0, "b": 1.0}).collect()}
    order = {doc: n for n, doc in enumerate(sorted(slots, key=slots.get))}
    assert all((r.sequence_id >> 36) == order[r.doc_id] // packing.WINDOW_PIECES for r in got)


def test_pieces_of_long_documents_stay_in_order(spark):
    texts = [(i, " ".join(f"w{i}x{j}" for j in range(10 + 700 * (i % 3)))) for i in range(30)]
    table = written(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), "test-long")
    got = packing.pack_in_order(table, window_pieces=7).collect()
    same = packing.pack(table).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, got)) == sorted(map(key, same))
    for n, r in enumerate(sorted(got, key=lambda r: (r.doc_id, r.piece))):
        assert r.sequence_id >> 36 == n // 7
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024


def test_thousands_of_sources_keep_their_targets(spark):
    """Each block lies in the window of the target weight itself, also for a source of 0.2 among 3000 others."""
    made = spark.range(6000).selectExpr("id AS doc_id", "IF(id < 3000, concat('s', cast(id AS string)), 'big') AS source", "repeat('x', 100) AS text")
    weights = {f"s{i}": 0.8 / 3000 for i in range(3000)} | {"big": 0.2}
    rows = mixing.mixed_blocks(made, block_bytes=100, weights=weights).collect()
    assert len(rows) == 6000 and len({r._slot for r in rows}) == 6000
    for r in rows:
        w = weights[r._source]
        assert r._block / w - 1.001 < r._slot < (r._block + 1) / w + 0.001
    served = 0
    for r in sorted((r for r in rows if r._source == "big"), key=lambda r: r._slot):
        assert abs(served - 0.2 * r._slot) < 1.001
        served += 1


def test_more_than_a_hundred_thousand_sources(spark):
    made = spark.range(100_001).selectExpr("id AS doc_id", "cast(id AS string) AS source", "'x' AS text")
    assert mixing.mixed_blocks(made).select("_slot").distinct().count() == 100_001


def test_slots_are_those_of_a_plain_scheduler(spark):
    """Slot by slot: of the sources whose next block is released, the one of the earliest deadline; ties by name."""
    from fractions import Fraction

    import random

    r = random.Random(6)
    made = [(i, r.choice(["a", "a", "a", "b", "b", "c"]) if i < 290 else "d", "y" * r.choice([0, 10, 90, 350])) for i in range(300)] + [(300, None, None), (7, "a", "yyyy"), (7, "a", "yyyy")]
    weights = {"a": 0.23, "b": 0.41, "c": 0.11, "d": 0.25}
    rows = mixing.mixed_blocks(spark.createDataFrame(made, "doc_id long, source string, text string"), weights=weights, block_bytes=300).collect()
    quota = mixing.quotas(weights | {"": 0.11}, mixing.RESOLUTION)
    w = {s: Fraction(q, sum(quota.values())) for s, q in quota.items()}
    assert all(abs(w[s] - Fraction(x) / Fraction(1.11)) < Fraction(1, 10**9) for s, x in weights.items())
    sizes = {}
    for _, s, x in made:
        sizes[s or ""] = sizes.get(s or "", 0) + len(x or "")
    left = {s: n // 300 + 1 for s, n in sizes.items()}
    served, plain, t = dict.fromkeys(left, 0), {}, 0
    while any(served[s] < left[s] for s in left):
        ready = [s for s in left if served[s] < left[s] and served[s] / w[s] // 1 <= t]
        if ready:
            s = min(ready, key=lambda s: (-(-(served[s] + 1) / w[s] // 1), s))
            plain[s, served[s]] = t
            served[s] += 1
        t += 1
    assert {(x._source, x._block): x._slot for x in rows}.items() <= plain.items()
    assert len(rows) == len(made)
