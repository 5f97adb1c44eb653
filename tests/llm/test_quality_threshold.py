"""The threshold comes from every labelled text of the table, however many labels lie outside it."""

from __future__ import annotations

import random

from gridsla.llm import quality


def test_labels_of_a_larger_corpus(spark):
    rnd = random.Random(1)
    kinds = {1: [f"river{i}" for i in range(400)], 0: [f"junk{i}" for i in range(400)]}
    rows = [(i, " ".join(rnd.choice(kinds[i % 2]) for _ in range(80))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.range(200_000).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality", "0 AS toxic")
    verdicts = []
    for bound in (quality.MAX_BROADCAST_ROWS, 0):  # with a broadcast of the labels, and without
        got = quality.score_quality(docs, labels, max_broadcast_rows=bound).select("doc_id", "quality.*").collect()
        assert {r.doc_id for r in got if r.kept} == {i for i in range(60) if i % 2}
        verdicts.append(sorted(got))
    assert verdicts[0] == verdicts[1]
    means = [[r.llr for r in verdicts[0] if r.doc_id % 2 == q] for q in (0, 1)]
    bad, good = (sum(m) / len(m) for m in means)
    at = int((bad + 2 * good) / 3)
    assert all(r.kept == (not r.base_failed and r.llr >= at) for r in verdicts[0])
