"""Packing documents into training sequences by best-fit decreasing."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsla.llm.common import table

WINDOW = 1024
_BEFORE_WORD = re.compile(r" (?=\S)")
_SPACES = re.compile(r" \s")
# Python's re has no \p{L}: the byte-level pattern with the letters up to U+024F, exact where no other character beyond ASCII occurs
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+", re.ASCII)
_PLAIN = re.compile(rf"[\x00-\x7f{_LETTERS}]*")
# the byte-level alphabet: bytes without a visible Latin-1 character stand as the characters from U+0100 on
_ALPHABET = {b: 256 + k for k, b in enumerate((*range(33), *range(127, 161), 173))}


class WordIds:
    """Ids of a word and the space before it, put together on first sight.

    The byte-level pattern always starts a new pre-token at a space that a non-space
    follows, so a text's ids are those of its pieces cut before such spaces. Arrow finds the
    distinct words of a chunk of texts, looks them up among the kept ones and lays their ids out, so Python sees new words only.
    A new word is cut on into its pre-tokens, which repeat more often than whole words (stops,
    line breaks and digits stick to words); the tokenizer's model merges each pre-token on first sight.
    Words with characters that ``_PIECES`` does not know, and all words of a tokenizer with
    another pattern, are encoded whole, and so are texts that hold an added token, which is found before the pattern applies.
    ``limit`` bounds the memory: the words kept, and the pre-tokens kept; a full cache takes no more.
    """

    def __init__(self, tokenizer_path: str, limit: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        self.limit = limit
        self.words, self.word_ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.pieces: dict[str, bytes] = {}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        cut = self.tokenizer.pre_tokenizer
        self.cuts = (isinstance(cut, ByteLevel) and cut.use_regex and not cut.add_prefix_space
                     and self.tokenizer.normalizer is None)

    def encode(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, key: str) -> bytes:
        """``key``: a word; the first of a text, which no space goes before, with a space in front."""
        word = key[1:] if key[:1] == " " else " " + key
        if self.cuts and (word.isascii() or _PLAIN.fullmatch(word)):
            known = self.pieces
            return b"".join([known[p] if p in known else self._piece(p) for p in _PIECES.findall(word)])
        return self.encode(word)

    def _ids_of(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words; new ones are kept while there is room: frequent words are met early and stay."""
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(at.is_null())
        ids = pa.array([self._word(w) for w in new.to_pylist()], type=pa.large_binary())
        places = at.fill_null(0).to_numpy(zero_copy_only=False).copy()
        places[at.is_null().to_numpy(zero_copy_only=False)] = np.arange(len(new)) + len(self.words)
        found = pa.concat_arrays([self.word_ids, ids]).take(pa.array(places))
        if room := self.limit - len(self.words):
            kept = pc.indices_nonzero(pc.less_equal(pc.binary_length(new), 64))[:room]
            self.words = pa.concat_arrays([self.words, new.take(kept)])
            self.word_ids = pa.concat_arrays([self.word_ids, ids.take(kept)])
        return found

    def _piece(self, piece: str) -> bytes:
        found = self.model.tokenize(piece.encode().decode("latin-1").translate(_ALPHABET))
        ids = struct.pack(f"<{len(found)}I", *[t.id for t in found])
        if len(piece) <= 64 and len(self.pieces) < self.limit:
            self.pieces[piece] = ids
        return ids

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """All ids of each text and id 0, little-endian unsigned 32-bit."""
        words, ends, whole = [], [0], {}
        for k, text in enumerate(texts):
            if any(t in text for t in self.added):
                whole[k] = self.encode(text)
            else:
                found = _BEFORE_WORD.split(text) if _SPACES.search(text) else text.split(" ")
                found[0] = " " + found[0]
                words += found
            ends.append(len(words))
        coded = pa.array(words, type=pa.large_string()).dictionary_encode()
        laid = self._ids_of(coded.dictionary).take(coded.indices)
        _, offsets, data = laid.buffers()
        at = np.frombuffer(offsets, dtype="int64")[ends].tolist()
        for k in range(len(texts)):
            yield (whole[k] if k in whole else data[at[k]:at[k + 1]].to_pybytes()) + bytes(4)


_KEPT: dict[str, WordIds] = {}


def words_of(tokenizer_path: str) -> WordIds:
    """One cache per worker process, kept between tasks."""
    if tokenizer_path not in _KEPT:
        _KEPT[tokenizer_path] = WordIds(tokenizer_path)
    return _KEPT[tokenizer_path]


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int], int]:
    """Bin and offset of each piece, and the number of bins.

    Pieces go by length, longest first, into the open bin with the least room that
    still holds them. A segment tree over the remaining capacities 0..window finds that bin:
    a node counts the open bins below it.
    """
    leaves = 1 << window.bit_length()
    tree = [0] * (2 * leaves)
    open_bins: list[list[int]] = [[] for _ in range(window + 1)]

    def add(room: int, by: int) -> None:
        node = room + leaves
        while node:
            tree[node] += by
            node >>= 1

    def tightest(need: int) -> int:
        node = need + leaves
        if tree[node]:
            return need
        while node > 1:  # up to the first right sibling with an open bin, then down to its left
            if not node & 1 and tree[node + 1]:
                node += 1
                while node < leaves:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
                return node - leaves
            node >>= 1
        return -1

    bins, offsets, made = [0] * len(lengths), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        room = tightest(lengths[i])
        if room < 0:
            b, room, made = made, window, made + 1
        else:
            b = open_bins[room].pop()
            add(room, -1)
        bins[i], offsets[i] = b, window - room
        if left := room - lengths[i]:
            open_bins[left].append(b)
            add(left, 1)
    return bins, offsets, made


def _chunks(batch: pa.RecordBatch, chars: int = 8_000_000) -> Iterator[tuple[list, list[str]]]:
    """Doc ids and texts of consecutive rows with about ``chars`` characters."""
    docs, texts, held = [], [], 0
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        docs.append(doc)
        texts.append(text.as_py() or "")
        held += len(texts[-1])
        if held > chars:
            yield docs, texts
            docs, texts, held = [], [], 0
    if docs:
        yield docs, texts


def _pieces(tokenizer_path: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(tokenizer_path)
        for docs, texts in (chunk for batch in batches for chunk in _chunks(batch)):
            out = [[] for _ in range(5)]
            for doc, ids in zip(docs, words.ids(texts)):
                n = len(ids) // 4
                for s in range(0, n, window):
                    cut = ids[4 * s:4 * (s + window)]
                    for col, v in zip(out, (doc, s, len(cut) // 4, n, cut)):
                        col.append(v)
            yield _batch(out)

    def _batch(out):
        return pa.record_batch([pa.array(c, type=t) for c, t in zip(
            out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
            names=["doc_id", "start", "length", "doc_tokens", "ids"])
    return run


def _pack(window: int, buffer_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, buffer = TaskContext.get().partitionId() << 40, 0, []

        def flush():
            nonlocal made, held, buffer
            t = pa.Table.from_batches(buffer).combine_chunks()
            t = t.take(pc.sort_indices(t, [("length", "descending"), ("doc_id", "ascending"),
                                                   ("start", "ascending")]))
            bins, offsets, n = best_fit_decreasing(t.column("length").to_pylist(), window)
            t = t.append_column("sequence_id", pa.array(np.asarray(bins, dtype="int64") + made))
            t = t.append_column("offset", pa.array(np.asarray(offsets, dtype="int64")))
            made, held, buffer = made + n, 0, []
            return t.to_batches(max_chunksize=4_096)

        for batch in batches:
            buffer.append(batch)
            held += pc.sum(batch.column(2)).as_py() or 0
            if held >= buffer_tokens:
                yield from flush()
        if held:
            yield from flush()
    return run


PIECE = "doc_id long, start long, length long, doc_tokens long, ids binary"


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW,
                   buffer_tokens: int = 8_000_000) -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    A document's ids end with id 0 (null text: only that id). Overlong documents are cut
    into full windows; the rests go by best-fit decreasing into sequences of at most ``window``
    ids. Pieces are dealt evenly over the tasks and packed in buffers of
    ``buffer_tokens`` ids, so memory is bounded and the padding is a fraction of one window per buffer.
    The packing depends on the pieces and on how the table is cut into partitions, on nothing else. A text is encoded whole, by
    one task. Repeated rows are packed as often as they occur; null doc_ids are kept; an empty table gives
    an empty result. Returns doc_id, start, length, doc_tokens, ids (little-endian unsigned
    32-bit), sequence_id, offset.
    """
    cut = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _pieces(tokenizer_path, window), PIECE)
    # by its place among the pieces, so that repeated rows are spread; in that order, so that a task that runs again after
    # a lost executor cuts the same buffers from shuffle blocks that arrive in another order
    dealt = cut.withColumn("at", F.monotonically_increasing_id()).repartition("at").sortWithinPartitions("at").drop("at")
    return dealt.mapInArrow(_pack(window, buffer_tokens), PIECE + ", sequence_id long, offset long")


def op2_packing(spark, sf_dir) -> DataFrame:
    import public_tokenizers
    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")
