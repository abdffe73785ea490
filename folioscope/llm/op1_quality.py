"""Quality classifier: nearest-neighbour voting on latent-semantic vectors.

A text's terms are the shapes of its words (letters, capitals and digits each as one sign, runs
written once, other characters as they are), pairs of neighbouring shapes, words that repeat the word
before, and, with less weight, the words themselves; a shape of more than PIECE signs is cut into
consecutive pieces that each count as a shape; all hashed to DIMS numbers, weighted by a log of
their count and by how few training texts have them. A truncated singular value decomposition of the
labelled texts' vectors gives a latent space of RANK dimensions. The labelled latent vectors (at most
FIT_ROWS) are broadcast; every document's exact cosines with all of them are computed in blocks, and
the NEAREST neighbours vote with their label, weighted by a power of their similarity.

Training reads at most FIT_ROWS labelled documents (those whose identifiers hash lowest), which
bounds the model; every document is scored on its whole text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, pages_of, ship

FIT_ROWS = 4_096
DIMS = 4_096
RANK = 48
NEAREST = 15
POWER = 4
REJECT = 0.3
WORD_WEIGHT = 0.2
BLOCK = 256
#: Signs of a shape that are one term.
PIECE = 40
#: The number that counts words like the word before.
_REPEATS = 0
#: Bytes that a task keeps of words and their numbers, and what a word's entry takes besides the word; more empty the cache,
#: and so does the task's end, as a worker goes on to other stages. Neither changes a result.
MAX_CACHED_BYTES, ENTRY_BYTES = 40_000_000, 160

_SHAPE = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S).sub
_SHAPES = DIMS // 2
_LOW = (1 << 32) - 1
#: Marks words whose shape has several pieces.
_LONG = 1 << 62


class _Words(dict):
    """For each word (bytes) a hash of its shape and, above it, the number of the word itself."""

    def __init__(self):
        self.pieces: dict[bytes, list[int]] = {}
        self.bytes = 0

    def __missing__(self, word: bytes) -> int:
        shape = _RUNS(rb"\1", word.translate(_SHAPE))
        found = zlib.crc32(shape[:PIECE]) | (zlib.crc32(word.lower()) % (DIMS - _SHAPES) + _SHAPES) << 32
        if len(shape) > PIECE:
            self.pieces[word] = [zlib.crc32(shape[i : i + PIECE]) for i in range(0, len(shape), PIECE)]
            found |= _LONG
            self.bytes += ENTRY_BYTES + 40 * len(self.pieces[word])
        self[word] = found
        self.bytes += ENTRY_BYTES + len(word)
        return found

    def clear(self) -> None:
        super().clear()
        self.pieces.clear()
        self.bytes = 0


_words = _Words()


def terms(text: str | None) -> np.ndarray:
    """Weighted log counts of the terms; all zero for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    size = len(words)
    if not size:
        return np.zeros(DIMS, np.float32)
    if _words.bytes > MAX_CACHED_BYTES:
        _words.clear()
    packed = np.fromiter(map(_words.__getitem__, words), np.int64, size)
    long = packed >= _LONG
    shape, word = packed & _LOW, (packed & ~_LONG) >> 32
    if long.any():
        shape = np.array([p for w, s, several in zip(words, shape.tolist(), long.tolist(), strict=True) for p in (_words.pieces[w] if several else (s,))], np.int64)
    pair = (shape[:-1] * 1_000_003 + shape[1:] * 8_191) % 2_147_483_647 % _SHAPES
    repeats = sum(map(eq, words, islice(words, 1, None)))
    out = np.bincount(shape % _SHAPES, minlength=DIMS) + np.bincount(pair, minlength=DIMS) + WORD_WEIGHT * np.bincount(word, minlength=DIMS)
    out[_REPEATS] += 4 * repeats
    # Shares rather than counts, so that a text's length plays no part; the log damps common terms.
    return np.log1p(100 / len(shape) * out).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 1e-12)


def _unit_rows(x: np.ndarray, weights: float | np.ndarray, out: np.ndarray) -> np.ndarray:
    """Unit vectors of many weighted rows, put into ``out`` block by block, so that no other array of their size is made."""
    for at in range(0, len(x), BLOCK):
        out[at : at + BLOCK] = _unit(x[at : at + BLOCK] * weights)
    return out


class Model:
    def __init__(self, idf: np.ndarray, basis: np.ndarray, vectors: np.ndarray, labels: np.ndarray):
        self.idf, self.basis, self.vectors, self.labels = idf, basis, vectors, labels

    def latent(self, rows: np.ndarray) -> np.ndarray:
        return _unit(_unit(rows * self.idf) @ self.basis)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """0 for a text without words, whose vector is zero; the labels' mean where no neighbour is similar at all.

        Of equally near neighbours those of smaller doc_id vote."""
        rows = np.stack([terms(t) for t in texts])
        if not len(self.labels):
            return np.zeros(len(rows))
        cosines = self.latent(rows) @ self.vectors.T
        k = min(NEAREST, len(self.labels))
        least = np.partition(cosines, -k, axis=1)[:, -k, None]
        nearer, equal = cosines > least, cosines == least
        room = k - nearer.sum(axis=1, keepdims=True)
        top = np.nonzero(nearer | (equal & (np.cumsum(equal, axis=1) <= room)))[1].reshape(len(cosines), k)
        weight = np.maximum(np.take_along_axis(cosines, top, axis=1), 0).astype(float) ** POWER
        total = weight.sum(axis=1)
        vote = np.divide((weight * self.labels[top]).sum(axis=1), total, out=np.full(len(rows), float(self.labels.mean())), where=total > 0)
        return np.where(rows.any(axis=1), np.clip(vote, 0, 1), 0.0)


def learn(x: np.ndarray, labels: list[int]) -> Model:
    """Truncated decomposition by a randomised range finder with a fixed seed."""
    n = len(x)
    idf = np.log((1 + n) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    x = _unit_rows(x, idf, np.empty_like(x))
    rank = max(1, min(RANK, *x.shape)) if n else 1
    draw = np.random.default_rng(7).normal(size=(DIMS, rank + 8)).astype(np.float32)
    y = x @ draw
    for _ in range(3):
        y = np.linalg.qr(x @ (x.T @ y))[0] if n else y
    basis = np.linalg.svd(y.T @ x, full_matrices=False)[2][:rank].T if n else draw[:, :1]
    return Model(idf, np.ascontiguousarray(basis, np.float32), _unit(_unit_rows(x, np.float32(1), x) @ basis.astype(np.float32)), np.array(labels, float))


def _fit_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    try:
        for batch in batches:
            found = [terms(t) for t in batch["t"]]
            slots = [np.flatnonzero(x).astype("<i4") for x in found]
            weights = [x[i].astype("<f4").tobytes() for x, i in zip(found, slots, strict=True)]
            yield pd.DataFrame({"id": batch["id"], "q": batch["q"], "slots": [i.tobytes() for i in slots], "weights": weights})
    finally:
        _words.clear()


def _dense(rows: pd.DataFrame) -> np.ndarray:
    x = np.zeros((len(rows), DIMS), np.float32)
    for i, (slots, weights) in enumerate(zip(rows["slots"], rows["weights"], strict=True)):
        x[i, np.frombuffer(slots, "<i4")] = np.frombuffer(weights, "<f4")
    return x


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from labelled documents that aren't held out. Rows without text, identifier or label teach nothing;
    a document that has several labels teaches each, and each text of a repeated doc_id."""
    marked = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("q")).where("id is not null and q is not null").where(~held_out(F.col("id")))
    chosen = marked.orderBy(F.xxhash64("id"), "id", "q").limit(FIT_ROWS)
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("t")).where("t is not null")
    ship(docs.sparkSession)
    # Terms of FIT_ROWS documents at most (more only where a doc_id repeats), of DIMS numbers each at most.
    rows = texts.join(F.broadcast(chosen), "id").mapInPandas(_fit_terms, "id bigint, q int, slots binary, weights binary").toPandas()
    rows = rows.sort_values(["id", "q"], kind="stable")
    return learn(_dense(rows), rows["q"].tolist())


def quality_column(spark: SparkSession, model: Model, text: str = "text") -> Column:
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        try:
            for batch in batches:
                texts = batch.tolist()
                yield pd.Series(np.concatenate([model.score(texts[at : at + BLOCK]) for at in range(0, len(texts), BLOCK)] or [np.empty(0)]))
        finally:
            _words.clear()

    return score(F.col(text).cast("string"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; null and empty texts score 0.

    Repeated rows and null doc_ids are kept; of documents only doc_id and text are read."""
    model = fit(docs, labels)
    out = docs.select("doc_id", quality_column(docs.sparkSession, model).alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= REJECT, 1).otherwise(0).alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(pages_of(spark, sf_dir, "documents"), pages_of(spark, sf_dir, "labels"))
