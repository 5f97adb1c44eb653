"""op10: hot texts of null or repeated ids are dealt over the shards; sizes, checksums and slots against DuckDB."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
import zlib

from gridsla.llm.sharding import place, shard_documents

SCHEMA = "doc_id long, text string, row string"


@pytest.mark.parametrize("hot_id", [None, 7])
def test_a_hot_text_of_one_id_is_cut(spark, hot_id):
    rows = [(hot_id, "the same text for very many rows " * 8, "x")] * 6_000
    rows += [(10_000 + k, f"own text {k} " * (1 + k % 40), None) for k in range(2_000)]
    got = shard_documents(spark.createDataFrame(rows, SCHEMA).repartition(4), shards=8).toPandas()
    assert len(got) == len(rows)
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() <= 1.01 * sizes.min()
    for _, slots in got.groupby("shard")["slot"]:
        assert sorted(slots) == list(range(len(slots)))


def test_sizes_and_checksums_equal_duckdb(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = shard_documents(docs).toPandas()
    con = duckdb.connect()
    con.register("got", got)
    sizes = con.execute("""SELECT count(*) FROM read_parquet('/root/testdata/sf0.001/documents.parquet') d JOIN got g USING (doc_id)
                           WHERE g.size = strlen(coalesce(d.text, '')) + 8""").fetchone()[0]
    assert sizes == len(got) == docs.count()
    assert con.execute("SELECT count(*) FROM (SELECT shard FROM got GROUP BY shard HAVING max(slot) + 1 <> count(*) "
                       "OR count(DISTINCT slot) <> count(*) OR min(slot) <> 0)").fetchone()[0] == 0
    crc = {r.doc_id: zlib.crc32((r.text or "").encode()) for r in docs.collect()}
    assert dict(zip(got["doc_id"], got["text_crc32"])) == crc


def test_place_follows_the_dot_product_rule():
    rng = np.random.default_rng(2)
    items = rng.integers(0, 50, (40, 3)).astype(float)
    shards, left = 5, np.ones((5, 3))
    need = items / items.sum(axis=0) * shards
    want = np.zeros(40, int)
    for i in sorted(range(40), key=lambda k: (-need[k][0], k)):
        able = [s for s in range(shards) if left[s][0] >= need[i][0]]
        if able:
            best = max(able, key=lambda s: (sum(left[s] * need[i]), -s))
        else:
            best = max(range(shards), key=lambda s: (left[s][0], -s))
        want[i] = best
        left[best] = left[best] - need[i]
    assert place(items, shards).tolist() == want.tolist()
