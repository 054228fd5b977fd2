"""Tables that swap together, upserts of touched buckets, results made anew only when something changed."""

import os

import pytest

from loomlog.operators.merge import MergeSpec
from loomlog.streaming import tables

SPEC = MergeSpec(("k",), {"v": "UPDATE"}, "at")


def rows(spark, values, at=1):
    return spark.createDataFrame([(k, v, at) for k, v in values], "k int, v string, at int")


def content(df):
    return sorted(tuple(r) for r in df.select("k", "v").collect())


def test_readers_see_all_old_or_all_new(spark, tmp_path, monkeypatch):
    s = tables.TableSet(spark, str(tmp_path), buckets=4)
    assert s.read("a") is None and s.number() == 0
    one = s.rebuild({"a": (rows(spark, [(1, "x"), (2, "y")]), ["k"]), "b": (rows(spark, [(9, "z")]), ["k"])}, "g1")
    a = s.read("a", one)
    # a rebuild that dies after its first table names nothing
    write, calls = s._write, []

    def dies(df, table, *rest):
        calls.append(table)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return write(df, table, *rest)

    monkeypatch.setattr(s, "_write", dies)
    with pytest.raises(RuntimeError):
        s.rebuild({"a": (rows(spark, [(5, "n")]), ["k"]), "b": (rows(spark, [(6, "n")]), ["k"])}, "g2")
    monkeypatch.undo()
    assert s.number() == one and content(s.read("a")) == [(1, "x"), (2, "y")] and content(s.read("b")) == [(9, "z")]
    two = s.rebuild({"a": (rows(spark, [(5, "n")]), ["k"]), "b": (rows(spark, []), ["k"])}, "g3")
    assert content(s.read("a")) == [(5, "n")] and content(s.read("b")) == [] and content(a) == [(1, "x"), (2, "y")] and content(s.read("b", one)) == [(9, "z")]
    with pytest.raises(FileExistsError):  # of two that began with the same manifest one fails
        s._publish(one, {}, {})
    assert s.sweep(keep=1) == ["g1", "g2"] and s.number() == two and content(s.read("a")) == [(5, "n")]


def test_upserts_write_touched_buckets_only(spark, tmp_path):
    s = tables.TableSet(spark, str(tmp_path), buckets=16)
    s.upsert({"a": (rows(spark, [(i, "old") for i in range(60)]), SPEC)}, "g1")
    before = s.manifest()["tables"]["a"]["buckets"]
    s.upsert({"a": (rows(spark, [(3, "new"), (99, "new")], at=2), SPEC)}, "g2")
    after = s.manifest()["tables"]["a"]["buckets"]
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(changed) <= 2 and {n for n in os.listdir(tmp_path / "tables" / "g2" / "a") if n.startswith("bucket")} == {f"bucket={b}" for b in changed}
    assert content(s.read("a")) == sorted([(i, "old") for i in range(60) if i != 3] + [(3, "new"), (99, "new")])
    assert content(s.read("a", 1)) == [(i, "old") for i in range(60)]


def test_results_are_made_anew_when_something_changed(spark, tmp_path):
    source, made = str(tmp_path / "in"), []
    rows(spark, [(1, "x")]).write.parquet(source)
    gate = tables.Gated(spark, str(tmp_path / "out"))

    def make():
        made.append(1)
        return spark.read.parquet(source)

    ask = lambda now: content(gate.result("r", tables.listing_token(spark, source), make, now))
    assert ask(0) == [(1, "x")] and ask(30) == [(1, "x")] and ask(800) == [(1, "x")] and len(made) == 1  # nothing was read again
    rows(spark, [(2, "y")]).write.mode("append").parquet(source)
    assert ask(50) == [(1, "x")] and len(made) == 1  # too early
    assert ask(900) == [(1, "x"), (2, "y")] and len(made) == 2
    assert ask(1_900) == [(1, "x"), (2, "y")] and len(made) == 3  # too old

    def fails():
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        gate.result("r", "other", fails, 9_000)
    assert ask(1_950) == [(1, "x"), (2, "y")] and len(made) == 3
