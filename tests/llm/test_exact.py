"""op12: the filter and the index by themselves, the operator against plain grouping."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

from gridsla.llm import exact
from tests.llm.test_operators import ROWS, SCHEMA


def digest(k) -> bytes:
    return hashlib.sha256(str(k).encode()).digest()


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def test_filter_keeps_what_was_inserted_and_drops_what_was_deleted():
    f = exact.CuckooFilter(256)
    keys = [digest(k) for k in range(700)]
    assert all(f.insert(k) for k in keys)
    assert all(f.contains(k) for k in keys)
    assert all(f.delete(k) for k in keys[:400])
    assert all(f.contains(k) for k in keys[400:])
    assert sum(f.contains(k) for k in keys[:400]) < 10
    assert sum(f.contains(digest(-k)) for k in range(1, 5_000)) < 50


def test_index_resizes_and_verifies_hits():
    index, live, rng = exact.CuckooIndex(2), {}, random.Random(3)
    for step in range(6_000):
        k = rng.randrange(2_000)
        if rng.random() < 0.3:
            assert index.delete(digest(k)) == (k in live)
            live.pop(k, None)
        else:
            index.insert(digest(k), k if k % 5 else None, step)
            live.setdefault(k, []).append(step)
    assert index.resizes > 0
    assert {e[0]: e[1:] for e in index.entries()} == {
        digest(k): [k if k % 5 else None, min(v), len(v)] for k, v in live.items()}
    again = exact.CuckooIndex.load(index.row(0))
    assert all(again.find(digest(k)) for k in live)
    assert all(again.find(digest(k)) is None for k in range(2_000, 4_000))


def test_a_false_hit_of_the_filter_joins_nothing():
    index = exact.CuckooIndex(4)
    a, b = bytes(32), bytes(31) + b"x"  # one tag, one bucket, two digests
    index.insert(a, 1, 0)
    index.insert(b, 2, 1)
    assert index.false_hits == 1 and index.find(a)[1] == 1 and index.find(b)[1] == 2
    for k in range(20):  # more than two buckets of one tag hold: the filter cannot place them at this size
        index.insert(bytes(8) + bytes([0, 0, 0, k]) + bytes(20), k, k)
    assert index.resizes and index.size == 21  # the first of them is a


def test_groups_equal_plain_grouping(spark, monkeypatch):
    rows = ROWS + [(50 + k, "Same Text" if k % 2 else "same text", None, "row", 1, None, None, None) for k in range(300)]
    rows += [(None, "null ids", None, None, 1, None, None, None)] * 40
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("item", "digest").withColumnRenamed("copy", "a row").repartition(5)
    monkeypatch.setattr(exact, "LOCAL_KEYS", 5)
    monkeypatch.setattr(exact, "SHARD_KEYS", 4)
    got = exact.exact_groups(docs).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[low(r[1])].append(r[0])
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        for i in ids:
            want[(i, keep, len(ids), sha)] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact.exact_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_stored_index_takes_insertions_and_deletions(spark, monkeypatch):
    monkeypatch.setattr(exact, "SHARD_KEYS", 50)

    def rows(pairs):
        return spark.createDataFrame([(bytearray(digest(k)), i, r) for r, (k, i) in enumerate(pairs)],
                                     "digest binary, doc_id long, row long")
    first = exact.update_index(None, inserted=rows([(k % 300, k) for k in range(400)]))
    second = exact.update_index(first, inserted=rows([(k, 1_000 + k) for k in range(250, 320)]),
                                deleted=rows([(k, None) for k in [*range(0, 290), 999]]).select("digest"))
    want = {}
    for k in range(400):
        i, n = want.get(k % 300, (0, 0))
        want[k % 300] = (max(i, k), n + 1)
    for k in range(290):
        want.pop(k, None)
    for k in range(250, 320):
        want[k] = (1_000 + k, want.get(k, (0, 0))[1] + 1)
    got = {bytes(r.digest): (r.keep_id, r["size"]) for r in exact.index_entries(second).collect()}
    assert got == {digest(k): v for k, v in want.items()}
