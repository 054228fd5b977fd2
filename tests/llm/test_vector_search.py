"""Vector search against brute force in whole numbers: ties, repeated ids, large components, awkward columns."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlog.llm import vafile


def brute(table, asked, k=10):
    """table: (id, components); asked: which ids are queries."""
    whole = lambda v: v.numerator * 1024 // v.denominator
    from fractions import Fraction

    good = [(i, [whole(Fraction(c)) for c in x]) for i, x in table if i is not None and x and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for q in sorted({i for i, _ in good if asked(i)}):
        best = {}
        for own in (x for i, x in good if i == q):
            for i, x in good:
                if i != q and len(x) == len(own):
                    s = max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(own, x, strict=True))))
                    best[i] = max(best.get(i, s), s)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted((-s, i) for i, s in best.items())[:k])]
    return out


def found(spark, table, k=10):
    v = vafile.integer_vectors(spark.createDataFrame(table, "vec_id long, embedding array<double>"))
    got = vafile.top_k(v, v.filter(F.col("vec_id") % 100 == 0), k)
    return sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect()))


@pytest.fixture(params=["whole", "small blocks"])
def blocks(request, monkeypatch):
    if request.param != "whole":
        monkeypatch.setattr(vafile, "QUERY_BLOCK", 2)
        monkeypatch.setattr(vafile, "BLOCK_CELLS", 400)
        monkeypatch.setattr(vafile, "GROUP_BLOCKS", 2)


def test_awkward_rows(spark, blocks):
    rng = np.random.default_rng(0)
    table = [(i, rng.normal(size=8).round(2).tolist()) for i in range(400)]
    table += [(400, None), (401, [1.0, None, *[0.0] * 6]), (402, [float("nan")] + [0.0] * 7), (403, [float("inf")] + [0.0] * 7), (404, []), (None, [0.5] * 8)]
    table += [(500 + i, [0.25] * 8) for i in range(40)] + [(600, [0.25] * 8)]  # ties
    table += [(700, [0.5] * 3), (701, [-0.5] * 3), (702, [0.1, -0.0, 0.0])]  # another length
    assert found(spark, table) == brute(table, lambda i: i % 100 == 0)
    assert found(spark, table[:4]) == brute(table[:4], lambda i: i % 100 == 0)
    assert found(spark, []) == []


@pytest.mark.parametrize("size", [1e4, 1e9, 1e160, 1.7e308])
def test_components_of_any_size(spark, size):
    rng = np.random.default_rng(1)
    table = [(i, (rng.normal(size=6) * 10.0 ** rng.integers(0, 3)).tolist()) for i in range(120)]
    table += [(i, (rng.uniform(-1, 1, size=6) * size).tolist()) for i in range(195, 260)]
    table += [(300, [size, -size, size, 0.0, 1.0, -0.5]), (301, [size, size, 0.25, 0.0, 0.0, 0.0]), (302, [math.nextafter(size, 0), size, 0.25, 0.0, 0.0, 0.0])]
    assert found(spark, table) == brute(table, lambda i: i % 100 == 0)


def test_one_vector_many_times(spark, blocks):
    """A third of the rows share a vector; the smallest ids win the ties."""
    rng = np.random.default_rng(2)
    table = [(i, [0.5, -0.25, 0.125, 0.0] if i % 3 == 0 else rng.normal(size=4).tolist()) for i in range(450)]
    random.Random(0).shuffle(table)
    assert found(spark, table) == brute(table, lambda i: i % 100 == 0)


def test_repeated_ids_count_once(spark, blocks):
    rng = np.random.default_rng(3)
    table = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    table += [(7, (np.array(table[q][1]) * (3 + rng.random())).tolist()) for q in (0, 100, 200) for _ in range(40)]  # the best of each query
    table += [(9, table[9][1])] * 25 + [(100, table[3][1])] * 12
    assert found(spark, table) == brute(table, lambda i: i % 100 == 0)
    few = [x for x in table if x[0] in (0, 7, 9)]
    assert found(spark, few) == brute(few, lambda i: i % 100 == 0)


def test_columns_of_like_names(spark):
    made = spark.createDataFrame([("a", 100, [1.0, 2.0], "b"), ("c", 101, [2.0, 1.0], "d")], "VEC_ID string, vec_id long, embedding array<double>, EMBEDDING string")
    v = vafile.integer_vectors(made)
    assert [tuple(r) for r in vafile.top_k(v, v.filter("vec_id = 100")).collect()] == [(100, 1, 101, 4 * 1024 * 1024)]


def test_cells_bound_the_products():
    rng = np.random.default_rng(1)
    for size in (1.0, 1e9, 1e200):
        vectors = np.floor(1024 * rng.normal(size=(500, 16)) * size) / 1024
        cells, *grid = vafile.quantised(vectors)
        row = {"d": 16, "places": np.zeros(500, np.int64).tobytes(), "rids": np.arange(500).tobytes(), "ids": np.arange(500).tobytes(), "grid": np.concatenate(grid).tobytes(), "cells": cells.tobytes()}
        sums, down, up = vafile._Bounds(row, 10).of(vectors[:20])
        with np.errstate(all="ignore"):
            exact = vectors[:20] @ vectors.T
        if size == 1e200:
            assert np.isinf(up).all() and np.isinf(down).all()  # beyond float64: nothing is ruled out
            continue
        assert (sums - down[:, None] <= exact).all() and (exact <= sums + up[:, None]).all()
        assert np.median((up + down) / np.abs(exact).max(axis=1)) < 0.1
