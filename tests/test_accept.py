"""Snapshots accepted in turn, against a plain fold."""

import random

from loomlog.operators import accept

SPEC = accept.AcceptSpec(("k",), "arrival", "written", "started", "ended", "state", ("c1", "c2"), ("pid", "model"), ("pid", "effort"))
SCHEMA = "k string, arrival long, written long, started long, ended long, state string, c1 long, c2 long, pid long, model string, effort string, body string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def made(seed=3, n=900):
    r = random.Random(seed)
    some = lambda v: v if r.random() < 0.8 else None
    out = []
    for i in range(n):
        k = r.choice(["hot", "hot", "a", "b", None, f"x{r.randrange(40)}"])
        out.append((k, i, some(i + r.randrange(-40, 10)), some(r.choice([1, 1, 1, 2])), some(r.randrange(n)) if r.random() < 0.1 else None, some(r.choice(["active"] * 9 + ["done", "failed"])), some(i // 9 + r.randrange(3)), some(i // 5), some(r.choice([7] * 9 + [8])), some("m"), some(r.choice("lh")), f"b{i}"))
    return out


def plain(rows):
    """The rules told once more, row by row."""
    held = {}
    for row in sorted(rows, key=lambda x: (x[1] is not None, x[1])):
        n = dict(zip(NAMES, row, strict=True))
        if n["k"] not in held:
            held[n["k"]] = [n, 0, 0, 0]
            continue
        o, *_ = h = held[n["k"]]
        if o["started"] is None or n["started"] is None or o["started"] != n["started"] or any(None not in (o[c], n[c]) and o[c] != n[c] for c in ("pid", "model")):
            h[3] += 1
            continue
        pid, effort = (o[c] if o[c] is not None else n[c] for c in ("pid", "effort"))
        ok = o["state"] == "active" and None not in (o["written"], n["written"])
        ok = ok and (n["written"] > o["written"] or (n["written"] == o["written"] and n["state"] not in (None, "active")))
        ok = ok and (n["ended"] is None or n["ended"] >= o["written"]) and not any(None not in (o[c], n[c]) and n[c] < o[c] for c in ("c1", "c2"))
        h[1 if ok else 2] += 1
        h[0] = (n if ok else o) | {"pid": pid, "effort": effort}
    return sorted((tuple(h[0][c] for c in NAMES) + tuple(h[1:]) for h in held.values()), key=str)


def test_accepted_in_turn(spark):
    rows = made()
    want = plain(rows)
    shuffled = random.Random(1).sample(rows, len(rows))
    got = accept.accept_fold(spark.createDataFrame(shuffled, SCHEMA).repartition(5), SPEC)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert sum(w[-3] for w in want) > 20 and sum(w[-1] for w in want) > 20
    assert accept.accept_fold(spark.createDataFrame([], SCHEMA), SPEC).collect() == []


def test_refreshes_in_parts_are_one_refresh(spark):
    rows = made(8, 400)
    table = accept.accept_fold(spark.createDataFrame(rows[:150], SCHEMA), SPEC)
    for a, b in ((150, 151), (151, 400)):
        table = accept.refreshed(table, spark.createDataFrame(rows[a:b], SCHEMA), SPEC)
    assert sorted(map(tuple, table.collect()), key=str) == plain(rows)


def test_a_final_snapshot_stays(spark):
    row = lambda arrival, written, state, c1: ("k", arrival, written, 1, None, state, c1, None, None, None, None, f"b{arrival}")
    rows = [row(1, 10, "active", 5), row(2, 20, "active", 4), row(3, 15, "active", 6), row(4, 15, "done", 6), row(5, 99, "active", 99)]
    (got,) = accept.accept_fold(spark.createDataFrame(rows, SCHEMA), SPEC).collect()
    # the second falls, so the third, written before it, is held against the first
    assert (got.body, got.n_accepted, got.n_refused) == ("b4", 2, 2)
