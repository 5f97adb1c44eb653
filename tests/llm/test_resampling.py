"""op11: against a plain count of every word run of every document, for runs of one and of three words."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from gridsla.llm import resampling
from tests.llm.test_operators import ROWS, SCHEMA

TARGET = ["the stone7 river3\nof seven1 bridges2 and sings4", None, "", "Ünïcode — 世界"]
LONG = "The river " * 50 + "\n\nof\n" + "a old TREES9\n" * 40 + "x"


def features(text: str | None, run: int) -> list[str]:
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return [" ".join(words[i:i + m]) for m in range(1, run + 1) for i in range(len(words) - m + 1)]


def brute(rows, target, run, buckets, percent, min_words, seed):
    def counts(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t, run))
    s, t = counts(x[1] for x in rows), counts(target)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text in ((r[0], r[1]) for r in rows):
        found = features(text, run)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found)
        h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(features(text, 1)), len(found), weight,
                    weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= min_words), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    return Counter(out), [x[0] for x in able[:percent * len(able) // 100]]


@pytest.mark.parametrize("run,buckets,percent", [(1, 10_000, 10), (3, 97, 60)])
def test_resampling_equals_brute_force(spark, run, buckets, percent):
    rows = ROWS + [(100 + k, LONG, None, "s9", 1, None, None, None) for k in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("item", "row").withColumnRenamed("copy", "a key").repartition(3)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = resampling.resample(docs, target, run, buckets, percent).collect()
    want, drawn = brute(rows, TARGET, run, buckets, percent, 20, 2024)
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == want
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [r.doc_id for r in ranked] == drawn


def test_resampling_of_nothing_and_towards_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    docs = spark.createDataFrame([(1, "a b " * 30, None, None, 1, "", "", "")] * 30, SCHEMA)
    assert resampling.resample(none, docs).count() == 0
    got = resampling.resample(docs, none, percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 16))


def test_heavy_lines_meet_their_gain_without_a_shuffle(spark, monkeypatch):
    from gridsla.llm import order
    monkeypatch.setattr(order, "MAX_BROADCAST_ROWS", 0)
    rows = [(k, f"common line\nown words of {k} " + "w " * (k % 7), None, None, 1, "", "", "") for k in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    target = spark.createDataFrame([("common words",)], "text string")
    got = resampling.resample(docs, target, min_words=2).collect()
    want, drawn = brute(rows, ["common words"], 1, 10_000, 10, 2, 2024)
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == want
    assert [r.doc_id for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == drawn
