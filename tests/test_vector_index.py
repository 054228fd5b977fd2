"""Inverted lists: recall, filters first, pruned folders, the exact way."""

import math
import random

from pyspark.sql import functions as F

from loomlog.operators import vector_index


def clustered(n=4_000, d=16, seed=4):
    r = random.Random(seed)
    heads = [[r.gauss(0, 1) for _ in range(d)] for _ in range(60)]
    return [(i, [x + r.gauss(0, 0.25) for x in heads[i % 60]], i % 7) for i in range(n)]


def plain(rows, queries, k, keep=lambda row: True):
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    return {q: [i for _, i in sorted((-cos(v, w), i) for i, w, b in rows if keep((i, w, b)))[:k]] for q, v in queries}


def test_index(spark, tmp_path):
    rows = clustered()
    queries = [(i, rows[i * 37][1]) for i in range(50)]
    bad = [(9_000, None, 1), (9_001, [0.0] * 16, 1), (9_002, [math.nan] * 16, 1), (9_003, [], 1)]
    table = spark.createDataFrame(rows + bad, "id int, vector array<double>, label int")
    asked = spark.createDataFrame([*queries, (999, None), (998, [0.0] * 16)], "query_id int, vector array<double>")
    folder = str(tmp_path / "index")
    assert vector_index.build(table, "id", "vector", folder) == 63
    assert spark.read.parquet(f"{folder}/rows").count() == len(rows)  # every row is in a list
    truth = plain(rows, queries, 10)

    def found(**how):
        out = {}
        for r in vector_index.search(spark, folder, asked, "id", **how).orderBy("query_id", "rank").collect():
            out.setdefault(r.query_id, []).append(r.id)
        return out

    assert found(exact=True) == truth and found() == truth  # so few rows are all compared
    got = found(threshold=100, probes=6)
    share = sum(len(set(got[q]) & set(truth[q])) for q in truth) / sum(map(len, truth.values()))
    assert set(got) == set(truth) and share >= 0.9
    # what a filter leaves is asked for first: a list that holds none of it loses nothing
    rare = found(only=F.col("id") % 400 == 3, threshold=100)
    assert rare == plain(rows, queries, 10, lambda row: row[0] % 400 == 3)
    plan = vector_index.search(spark, folder, asked.limit(1), "id", threshold=100, probes=2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan


def test_blocks_of_queries_and_nothing(spark, tmp_path, monkeypatch):
    rows = clustered(300)
    table = spark.createDataFrame(rows, "id int, vector array<double>, label int")
    asked = spark.createDataFrame([(i, v) for i, v, _ in rows[:40]], "query_id int, vector array<double>")
    vector_index.build(table, "id", "vector", str(tmp_path / "a"), lists=5)
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 9)
    got = vector_index.search(spark, str(tmp_path / "a"), asked, "id", k=3).groupBy("query_id").agg(F.count("*").alias("n")).collect()
    assert {(r.query_id, r.n) for r in got} == {(i, 3) for i in range(40)}
    assert vector_index.search(spark, str(tmp_path / "a"), asked.limit(0), "id").collect() == []


def test_nobody_to_ask_with(spark):
    from loomlog.operators import vectors

    rows = spark.createDataFrame([(1, [1.0, 0.0])], "id int, vector array<double>")
    assert vectors.vector_of(rows.filter("id = 2"), "vector") == [] and vectors.vector_of(rows, "vector") == [1.0, 0.0]
    assert vectors.nearest(rows, "id", "vector", [], 3).collect() == []
