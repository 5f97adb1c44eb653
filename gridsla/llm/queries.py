"""Registered queries of the training-data operators and their DuckDB statements."""

from __future__ import annotations

from gridsla.llm import (exact, html, langid, manifest, mixing, neighbours, packing, quality, resampling, sharding,
                         simhash, suffixes, toxicity)

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_packing": packing.op2_packing,
    "op3_quality": quality.op3_quality,
    "op4_simhash": simhash.op4_simhash,
    "op5_suffixes": suffixes.op5_suffixes,
    "op6_neighbours": neighbours.op6_neighbours,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_langid": langid.op8_langid,
    "op9_html": html.op9_html,
    "op10_sharding": sharding.op10_sharding,
    "op11_resampling": resampling.op11_resampling,
    "op12_exact": exact.op12_exact,
    "op13_manifest": manifest.op13_manifest,
}

ORACLE_SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op11_resampling": resampling.OP11_SQL,
    "op12_exact": exact.OP12_SQL,
    "op13_manifest": manifest.OP13_SQL,
}
