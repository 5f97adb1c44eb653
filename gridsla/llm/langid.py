"""Language identification by compression with per-language zstandard raw-content dictionaries."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridsla.llm.common import broadcast_if_small, discard, materialize, table

MAX_ROWS = 150            # learned documents of each language
MAX_TRAIN_BYTES = 16_000  # longer documents are not learned from (all texts are classified whole)
DICT_BYTES = 8_000        # of a language's dictionary
LEAST_PIECE, MOST_PIECE = 24, 100  # bytes of a piece of a learned document
WINDOW = 3_000            # characters compressed at a time
MARGIN = 0.02
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Lower-case letters with single spaces between words."""
    return _OTHER.sub(" ", text.lower())


def learned_sample(docs: DataFrame, max_rows: int = MAX_ROWS) -> dict[str, list[str]]:
    """Texts per language from documents whose crc32(doc_id) mod 3 is not 1.

    Of each language the ``max_rows`` doc_ids with the least hashes are learned from, one text of each (that of the least
    hash). All languages are drawn in one pass over the ids and one over the texts; ``max_rows`` texts of at most
    ``MAX_TRAIN_BYTES`` bytes per language come to the driver.
    """
    ident = F.col("doc_id").cast("string")
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= MAX_TRAIN_BYTES)
                       & (F.crc32(ident.cast("binary")) % 3 != 1)).select(
        "lang", "doc_id", "text", F.xxhash64("text").alias("hash"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    drawn = materialize(known.groupBy("lang", "doc_id").agg(F.min("hash").alias("hash"))
                        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_rows).drop("rank"))
    rows = (known.join(broadcast_if_small(drawn), ["lang", "doc_id", "hash"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
            .collect())
    discard(drawn)
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.doc_id)):
        out.setdefault(r.lang, []).append(r.text)
    return {k: v for k, v in out.items() if any(_LETTER.search(t) for t in v)}


def pieces(text: str, size: int) -> list[str]:
    """A whole text in pieces of at most ``size`` bytes, cut between words (inside a word that is longer)."""
    out, held = [], ""
    for word in plain(text).split():
        while len(word.encode()) > size:
            head = word.encode()[:size].decode(errors="ignore")
            out.append(head)
            word = word[len(head):]
        if held and len(held.encode()) + 1 + len(word.encode()) > size:
            out.append(held)
            held = ""
        held = f"{held} {word}" if held else word
    return [*out, held] if held else out


def dictionaries(sample: dict[str, list[str]], size: int = DICT_BYTES) -> dict[str, bytes]:
    """Raw content per language: distinct pieces of the sampled texts, at most ``size`` bytes in all.

    A piece holds ``size`` divided by the number of distinct texts in bytes, from ``LEAST_PIECE`` (there the bound
    grows with the texts) to ``MOST_PIECE``. The pieces of the whole text are taken in hash order, one of
    each text in turn, none twice: what many texts share fills the dictionary once.
    """
    out = {}
    for lang, texts in sorted(sample.items()):
        texts = sorted(set(texts))
        share = min(MOST_PIECE, max(LEAST_PIECE, size // max(1, len(texts)) - 1))
        room = max(size, len(texts) * (share + 1))
        cut = [sorted(set(pieces(t, share)), key=lambda p: (zlib.crc32(p.encode()), p), reverse=True) for t in texts]
        seen: set[str] = set()
        picked, held = [], 0
        while any(cut) and held < room:
            for left in cut:
                while left and left[-1] in seen:
                    left.pop()
                if left and held + len(left[-1].encode()) + 1 <= room:
                    picked.append(left.pop())
                    seen.add(picked[-1])
                    held += len(picked[-1].encode()) + 1
                elif left:
                    held = room
        out[lang] = " ".join(picked).encode()
    return out


# short matches count: the lazy strategy from four bytes on, tables sized for the small dictionaries
PARAMS = zstandard.ZstdCompressionParameters(
    window_log=17, hash_log=13, chain_log=14, search_log=4, min_match=4, strategy=zstandard.STRATEGY_LAZY,
    write_content_size=False, write_dict_id=False, write_checksum=False)


class Classifier:
    def __init__(self, raw: dict[str, bytes]):
        self.langs = sorted(raw)
        self.compressors = []
        for lang in self.langs:
            d = zstandard.ZstdCompressionDict(raw[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=PARAMS)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, compression_params=PARAMS))

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, margin: the margin is the share of bytes the best saves on the second best."""
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0, 0.0
        clean = plain(text)
        parts = [clean[i:i + WINDOW].encode() for i in range(0, len(clean), WINDOW)]
        sizes = np.array([sum(len(c.compress(p)) - 8 for p in parts) for c in self.compressors], dtype=float)
        best = int(np.argmin(sizes))
        if len(sizes) == 1:
            return self.langs[0], 1.0, 1.0
        second = np.partition(sizes, 1)[1]
        margin = float((second - sizes[best]) / max(second, 1.0))
        odds = np.exp(-(sizes - sizes[best]) / max(second, 1.0) * 60)
        return self.langs[best], float(1 / odds.sum()), margin


def identify_language(docs: DataFrame, max_rows: int = MAX_ROWS, margin: float = MARGIN) -> DataFrame:
    """Language of every whole text.

    Learned from a bounded sample of texts with a language, of which every text gives distinct pieces to
    a dictionary of ``DICT_BYTES`` bytes; predictions use the text alone. ``lang_pred`` is the language whose dictionary compresses the text best, ``und``
    for a text that is null or has no letters (or when nothing could be learned);
    ``accepted`` is false where the margin to the second best is narrow. Repeated rows and
    null doc_ids are kept. Returns doc_id, held_out, lang_pred, score, margin, accepted.
    """
    raw = dictionaries(learned_sample(docs, max_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Classifier(raw)
        for b in batches:
            got = [c.classify(t.as_py()) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array([g[0] for g in got], pa.string()),
                                   pa.array([g[1] for g in got], pa.float64()),
                                   pa.array([g[2] for g in got], pa.float64())],
                                  names=["doc_id", "lang_pred", "score", "margin"])

    found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, margin double")
    return found.select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).alias("held_out"),
        "lang_pred", "score", "margin", ((F.col("margin") >= margin) & (F.col("lang_pred") != "und")).alias("accepted"))


def op8_langid(spark, sf_dir) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))
