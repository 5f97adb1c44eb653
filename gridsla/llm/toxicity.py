"""Toxicity by compression distance between a toxic and an ordinary zstandard dictionary.

Both dictionaries are chosen from labelled texts. A window is a word; windows that compress
better by ``GAIN`` bytes with the toxic dictionary are counted, and a logistic curve calibrated on
labelled rows turns the counts of a whole text into a score.

Words are compressed in the prefix-hash encoding of ``wide``, not as plain text: this comes near a
lookup of word prefixes in the toxic list. Phrases of ordinary words are not recognised (README
has figures of the plain form).
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsla.llm.common import table

THRESHOLD = 0.3
MAX_ROWS = 2_000          # labelled rows of each class that training reads
MAX_TRAIN_BYTES = 32_000  # longer labelled texts are not trained on (all texts are scored whole)
TOXIC_BYTES = 16_000
PLAIN_BYTES = 600_000
MARK_SHARE = 0.02         # a toxic word must be in this share of the toxic training texts
GAIN = 7                  # bytes by which a window must be nearer to toxic text
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def wide(word: str) -> bytes:
    """Four bytes per character, hashed from the word up to there.

    A match in a dictionary thus starts at a word's start and costs one phrase, the rest are
    literals that cannot be compressed: the length tells how much of the word the dictionary knows.
    """
    out, h = [], zlib.crc32(b" ")
    for ch in word + " ":
        h = zlib.crc32(ch.encode("utf-8", "replace"), h)
        out.append(h.to_bytes(4, "little"))
    return b"".join(out)


def dictionary(frequency: Counter, least: int, size: int) -> bytes:
    """Dictionary content: the words found in the most texts, the most frequent last (nearest)."""
    picked, held = [], 0
    for w in sorted((w for w, n in frequency.items() if n >= least), key=lambda w: (-frequency[w], w)):
        b = wide(w)
        if held + len(b) > size:
            break
        picked.append(b)
        held += len(b)
    return b"".join(reversed(picked)) or bytes(8)


def train_pair(texts: list[list[str]], toxic: list[int]) -> tuple[bytes, bytes]:
    """Dictionaries of the toxic and the ordinary texts (lists of words).

    Words of ordinary texts, and rare ones, are left out of the toxic dictionary, so
    it holds what sets toxic texts apart.
    """
    plain = Counter(w for t, y in zip(texts, toxic) if not y for w in set(t))
    marks = Counter(w for t, y in zip(texts, toxic) if y for w in set(t) if w not in plain)
    least = max(2, int(MARK_SHARE * sum(toxic)))
    return dictionary(marks, least, TOXIC_BYTES), dictionary(plain, 1, PLAIN_BYTES)


class Gains(dict):
    """Ordinary minus toxic compressed length of a window (one word), kept per word.

    ``limit`` bounds the memory; a full cache is emptied and filled anew.
    """

    def __init__(self, pair: tuple[bytes, bytes], limit: int = 400_000):
        self.limit = limit
        self.toxic, self.plain = (zstandard.ZstdCompressor(
            level=3, write_content_size=False, write_dict_id=False, write_checksum=False,
            dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for d in pair)

    def __missing__(self, word: str) -> int:
        w = wide(word)
        gain = len(self.plain.compress(w)) - len(self.toxic.compress(w))
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = gain
        return gain

    def features(self, words: list[str]) -> tuple[float, float, float]:
        """Of the windows nearer to toxic text: their kinds (logarithm), their share, their share of kinds."""
        if not words:
            return 0.0, 0.0, 0.0
        kinds = Counter(words)
        marks = [n for w, n in kinds.items() if self[w] >= GAIN]
        return math.log1p(len(marks)), 10 * sum(marks) / len(words), 10 * len(marks) / len(kinds)


_KEPT: dict[tuple[bytes, bytes], Gains] = {}


def gains_of(pair: tuple[bytes, bytes]) -> Gains:
    """One cache per worker process and pair of dictionaries, kept between tasks."""
    if pair not in _KEPT:
        _KEPT.clear()
        _KEPT[pair] = Gains(pair)
    return _KEPT[pair]


def fit(texts: list[list[str]], toxic: list[int]) -> tuple[tuple[bytes, bytes], np.ndarray]:
    """Dictionaries of all given texts and the weights of a logistic score.

    The weights come from two-fold features: each half is scored by dictionaries
    of the other, so a text never meets a dictionary that holds it.
    """
    y = np.array(toxic, dtype=float)
    fold = np.zeros(len(texts), dtype=int)
    for c in (0, 1):
        at = np.flatnonzero(y == c)
        fold[at] = np.arange(len(at)) % 2
    x = np.zeros((len(texts), 4))
    x[:, 0] = 1
    for f in (0, 1):
        train = np.flatnonzero(fold != f)
        gains = Gains(train_pair([texts[i] for i in train], [toxic[i] for i in train]))
        for i in np.flatnonzero(fold == f):
            x[i, 1:] = gains.features(texts[i])
    w = np.zeros(4)
    if 0 < y.sum() < len(y):
        for _ in range(50):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(4)
            w += np.linalg.solve(h, x.T @ (y - p) - 0.05 * w)
    elif len(y):
        w[0] = 5 if y.all() else -5
    return train_pair(texts, toxic), w


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> list[tuple[str, int]]:
    """At most ``max_rows`` texts of each class whose crc32(doc_id) mod 4 is not 2, by hash order; of rows that share a
    doc_id one text."""
    ident = F.col("doc_id").cast("string")
    known = labels.where(F.col("toxic").isin(0, 1) & (F.crc32(ident.cast("binary")) % 4 != 2)).select("doc_id", "toxic")
    picked = []
    for c in (0, 1):
        picked += known.where(F.col("toxic") == c).distinct().orderBy(F.md5(ident), "doc_id").limit(max_rows).collect()
    ids = docs.sparkSession.createDataFrame([(r.doc_id, r.toxic) for r in picked], "doc_id long, toxic int")
    rows = (docs.select("doc_id", "text").where(F.octet_length("text") <= MAX_TRAIN_BYTES).join(F.broadcast(ids), "doc_id")
            .groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect())  # at most 2 * max_rows texts
    return [(r.text, r.toxic) for r in sorted(rows, key=lambda r: (r.doc_id, r.toxic, r.text))]


def score_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS,
                   threshold: float = THRESHOLD) -> DataFrame:
    """Toxicity score (0 to 1) and prediction of every whole text.

    Trained on a bounded sample of labelled rows; a score depends on the text alone.
    Null and empty texts get the score of a text without marks; with no labels
    (or one class) the score is constant. Repeated rows and null doc_ids are kept.
    Returns doc_id, held_out, score, predicted, marks (windows nearer to toxic text).
    """
    sample = labelled_sample(docs, labels, max_rows)
    pair, w = fit([words_of(t) for t, _ in sample], [y for _, y in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = gains_of(pair)
        for b in batches:
            x = np.array([(1.0, *gains.features(words_of(t.as_py()))) for t in b.column(1)]).reshape(-1, 4)
            score = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            marks = np.rint(np.expm1(x[:, 1])).astype("int64")
            yield pa.record_batch([b.column(0), pa.array(score), pa.array(marks)], names=["doc_id", "score", "marks"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, marks long")
    return scored.select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out"),
        "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "marks")


def op7_toxicity(spark, sf_dir) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
