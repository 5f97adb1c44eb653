"""Repeated windows are exact beyond the packed positions and where packed hash bits clash."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridsla.llm import quality


@pytest.mark.parametrize("bits", [3, 24, 58, 61])  # few positions; few hash bits (clashes)
def test_repeated_words_of_any_length(spark, bits):
    rnd = random.Random(bits)
    texts = [[rnd.randrange(k) for _ in range(n)] for n, k in ((0, 2), (3, 2), (4, 1), (9, 2), (40, 5), (300, 6), (700, 9))]
    want = []
    for t in texts:
        windows = Counter(zip(t, t[1:], t[2:]))
        want.append(len({i + k for i in range(len(t) - 2) if windows[tuple(t[i:i + 3])] > 1 for k in range(3)}) if len(t) > 3 else 0)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, h array<long>")
    got = rows.select("i", quality.repeated_words(F.col("h"), bits).alias("n")).collect()
    assert [r.n for r in sorted(got)] == want
