"""Components whose documents all have a null doc_id are components of their own."""

from __future__ import annotations

from gridsla.llm import simhash

ONE = "the stone bridge over the river sings to the old trees every morning"
TWO = "quarterly figures of seven companies were published late on friday evening"


def test_different_texts_of_null_ids_are_all_kept(spark):
    rows = [(None, ONE), (None, TWO), (None, TWO), (None, None), (None, ""), (1, "a third text that has an id of its own here"),
            ((1 << 63) - 1, ONE + " and then it goes on about something else entirely for many more words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.keep_one(docs).collect()
    assert sorted(r.text for r in got if r.doc_id is None and r.text) == sorted([ONE, TWO])
    assert len(got) == 5 and sum(r.doc_id is not None for r in got) == 2
    found = simhash.simhash_components(docs).collect()
    assert len({r.component for r in found}) == 5 and len(found) == len(rows)
