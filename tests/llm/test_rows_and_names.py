"""op5 and the SimHash stage: many repeated rows, columns of any name, very long texts in stretches."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsla.llm import simhash, suffixes

NAMES = ["my col", "a`b", "_text", "_doc", "_none", "_twin", "rest", "none", "doc", "twin", "whole", "dotted.name", "text"]
SCHEMA = "doc_id long, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in NAMES)


def words(n, seed):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randint(0, 9_999)}" for _ in range(n))


def row(doc_id, text):
    return (doc_id, *[c for c in NAMES[:-1]], text)


def brute(rows, length=100):
    """Removed bytes of each distinct (doc_id, text), in the operator's order."""
    from collections import defaultdict
    firsts, out = {}, {}
    for doc_id, text in rows:
        data, gone = text.encode(), set()
        for i in range(len(data) - length + 1):
            w = data[i:i + length]
            if w in firsts:
                gone.update(range(i, i + length))
            else:
                firsts[w] = i
        out[(doc_id, text)] = len(gone)
    return defaultdict(int, out)


def test_repeated_rows_are_searched_once(spark):
    text = words(500, 1)
    other = words(30, 2) + " " + text[200:900] + " " + words(30, 3)
    rows = [row(None, text)] * 4_000 + [row(1, other)] * 2 + [row(2, other), row(3, "short"), row(4, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(8)
    start = time.time()
    got = suffixes.cut_repeats(docs).select("rest.doc_id", "n_bytes", F.octet_length("kept").alias("left")).collect()
    assert time.time() - start < 120  # 2,000 copies took 196 s when every copy was searched
    gone = brute([(1, other), (2, other), (None, text)])
    want = sorted([(9 if i is None else i, len((t or "").encode()), len((t or "").encode()) - gone[(i, t)])
                   for i, t in ((r[0], r[-1]) for r in rows)])
    assert sorted((9 if r.doc_id is None else r.doc_id, r.n_bytes, r.left) for r in got) == want


def test_stretches_do_not_change_the_result(monkeypatch, spark):
    rng = random.Random(4)
    parts = [words(60, k) for k in range(6)]
    texts = [" ".join(rng.choice(parts) for _ in range(6)) for _ in range(6)]
    rows = list(enumerate(texts))
    want = brute(rows)
    whole = [tuple(map(np.concatenate, zip(*suffixes.runs(t.encode(), 100, 48)))) for t in texts]
    monkeypatch.setattr(suffixes, "STRETCH", 257)
    for t, (first, last, anchor, context) in zip(texts, whole):
        f, n, a, _ = map(np.concatenate, zip(*suffixes.runs(t.encode(), 100, 48)))
        spread = lambda x, y, z: {k: d for p, q, d in zip(x, y, z) for k in range(p, q + 1)}
        assert spread(f, n, a) == spread(first, last, anchor)  # each window once, with the anchor it had
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixes.cut_repeats(docs).select("rest.doc_id", (F.col("n_bytes") - F.octet_length("kept")).alias("gone")).collect()
    assert {r.doc_id: r.gone for r in got} == {i: want[(i, t)] for i, t in rows}


def test_a_very_long_text_takes_bounded_memory():
    import tracemalloc
    data = np.random.default_rng(1).integers(97, 123, 12_000_000, dtype=np.uint8).tobytes()
    tracemalloc.start()
    n = sum(len(x[0]) for x in suffixes.runs(data, 100, 48))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 200_000 and peak < 250_000_000  # it was 82 bytes a text byte


@pytest.mark.parametrize("copies", [1, 3])
def test_keep_one_keeps_columns_of_any_name(spark, copies):
    a, b = words(40, 5), words(40, 6)
    rows = ([row(5, a), row(3, a), row(None, a), row(None, b), row(8, None), row(9, "")]) * copies
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([row(3, a), row(None, b), row(8, None)], key=repr)
