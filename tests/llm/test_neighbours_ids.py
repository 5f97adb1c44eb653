"""Links of vectors without an id, and of different vectors under one id."""

from __future__ import annotations

import math

from gridsla.llm import neighbours


def at(degrees: float) -> list[float]:
    return [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]


def test_null_and_repeated_ids(spark):
    # cosine 0.98 is about 11.5 degrees: 1 and 2 are joined only through the vector without an id
    rows = [(1, at(0), 0), (None, at(10), 0), (2, at(20), 0),
            (7, at(90), 0), (7, at(95), 0), (8, at(104), 0),  # different vectors of one id
            (None, at(180), 0), (None, at(185), 0)]  # null ids only
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in neighbours.near_vectors(table, block=2, cell_rows=2).collect())
    assert got == sorted([(1, 1, 1), (0, 2, 1), (2, 1, 1), (7, 1, 7), (7, 2, 7), (8, 1, 7), (0, 1, 0), (0, 1, 0)])
