"""op2: ids put together from pre-tokens equal the tokenizer's own; which words reach the tokenizer."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from gridsla.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
MARKS = list(" \n\t\r\x0b\x1c\x1f\x85\xa0 　'strevmldST019_.,;#<|>é²ªµ×÷ßǅɏɐʰж中🙂́")


@pytest.fixture(scope="module")
def words():
    return packing.WordIds(PATH)


def _whole(words, text):
    return [*words.tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_ids_are_those_of_whole_texts(words):
    rnd = random.Random(3)
    marks = MARKS + [chr(c) for c in range(0x250)]
    texts = ["", " ", "  ", "a", " a", "a  ", "a \n b", "don't we'll 'tis", "x" * 70 + "," + " y" * 70]
    texts += ["".join(rnd.choices(MARKS if k % 2 else marks, k=rnd.randint(0, 14))) for k in range(20_000)]
    for s in range(0, len(texts), 700):
        for text, ids in zip(texts[s:s + 700], words.ids(texts[s:s + 700]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == _whole(words, text), repr(text)
    assert list(words.ids([])) == [] and list(words.ids(["", ""])) == [bytes(4)] * 2


def test_added_tokens_are_found_before_words_are_cut(words):
    texts = ["a  <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y  z", "plain", "a <|endoftext| >", " <|endoftext|>"]
    assert [np.frombuffer(i, "<u4").tolist() for i in words.ids(texts)] == [_whole(words, t) for t in texts]


def test_the_pattern_cuts_as_the_tokenizer_does(words):
    cut = words.tokenizer.pre_tokenizer.pre_tokenize_str
    for c in (chr(c) for c in range(0x250) if packing._PLAIN.fullmatch(chr(c))):
        for text in (c, c + "a", "a" + c, " " + c, f" {c} {c}", f"1{c}1", f".{c}.", f"\n{c}", f"{c}\n", f"'{c}"):
            assert [text[x:y] for _, (x, y) in cut(text)] == packing._PIECES.findall(text), repr(text)


def test_new_words_of_known_parts_are_not_encoded_again():
    words = packing.WordIds(PATH)
    parts = [f"{a}{b}" for a in "stone river light cloud".split() for b in "abcdefghij"]
    texts = [f"start {a}.\n{b}, {b}-{a};" for a in parts for b in parts]  # 3,200 words of 40 parts
    calls = []
    encode, merge = words.encode, words._piece
    words.encode = lambda text: calls.append(text) or encode(text)
    words._piece = lambda piece: calls.append(piece) or merge(piece)
    got = [np.frombuffer(i, "<u4").tolist() for i in words.ids(texts)]
    assert got == [_whole(words, t) for t in texts]
    assert len(calls) < 150  # before: one for each of the 3,200 words, and one for each text's first


def test_full_caches_and_small_chunks_change_nothing():
    texts = [f"word{k} of été {k % 7}!" for k in range(300)] * 2
    small, large = packing.WordIds(PATH, limit=10), packing.WordIds(PATH)
    assert list(small.ids(texts)) == list(large.ids(texts)) and len(small.words) == len(small.word_ids) == 10 == len(small.pieces)
    batch = pa.record_batch([pa.array([None, *range(599)], pa.int64()), pa.array([None, *texts[1:]])], names=["doc_id", "text"])
    chunks = list(packing._chunks(batch, chars=100))
    assert len(chunks) > 50 and sum((c[0] for c in chunks), []) == [None, *range(599)]
    assert sum((c[1] for c in chunks), []) == ["", *texts[1:]]


def test_a_tokenizer_of_another_pattern_gets_whole_words(tmp_path):
    from tokenizers import Regex, Tokenizer, pre_tokenizers
    other = Tokenizer.from_file(PATH)
    other.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(r" ?[0-9]{1,3}| ?[^\s0-9]+|\s+(?!\S)|\s+"), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    other.save(str(tmp_path / "other.json"))
    words = packing.WordIds(str(tmp_path / "other.json"))
    texts = ["a1234,b 12345678 it's.\nso", "we'll 1"]
    assert [np.frombuffer(i, "<u4").tolist() for i in words.ids(texts)] == [_whole(words, t) for t in texts]
