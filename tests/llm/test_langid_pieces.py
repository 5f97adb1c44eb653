"""Dictionaries hold a share of every learned text, also past a common opening in another language."""

from __future__ import annotations

import random

from gridsla.llm import langid

STEMS = {"aa": "tion ment able er ing the".split(), "bb": "keit ung schaft der zu ein".split()}


def text(rnd: random.Random, lang: str, n: int) -> str:
    return " ".join(rnd.choice(STEMS[lang]) + rnd.choice(STEMS[lang]) for _ in range(n))


def test_a_common_header_does_not_fill_the_dictionary():
    rnd = random.Random(6)
    header = text(rnd, "bb", 30)
    sample = {"aa": [f"{header} {text(rnd, 'aa', 60)}" for _ in range(150)], "bb": [text(rnd, "bb", 60) for _ in range(150)]}
    raw = langid.dictionaries(sample)
    assert all(len(d) <= langid.DICT_BYTES for d in raw.values())
    assert raw["aa"].decode().count(header[:20]) <= 1
    c = langid.Classifier(raw)
    assert all(c.classify(text(rnd, lang, 40))[0] == lang for lang in STEMS for _ in range(50))


def test_every_learned_text_has_a_share():
    for n in (1, 7, 150, 300, 900):
        texts = [" ".join(f"{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}é{'x' * (k % 9)}" for k in range(50)) for i in range(n)]
        held = langid.dictionaries({"aa": texts})["aa"].decode()
        assert all(t.split()[0] in held for t in texts)
        assert len(held.encode()) <= max(langid.DICT_BYTES, n * (langid.LEAST_PIECE + 1))


def test_pieces_keep_the_whole_text():
    for t in ("a " * 500, "é" * 99, "one two three", "", "12 !"):
        cut = langid.pieces(t, 24)
        assert all(0 < len(p.encode()) <= 24 for p in cut)
        assert "".join(cut).replace(" ", "") == langid.plain(t).replace(" ", "")
