"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters, digits and non-ASCII characters, lower-cased. One pass over the texts
joins their n-grams with those of the test items and takes the stretches of words around them.
Every n-gram of an item is a seed, however common it is or however few of them occur; an item of fewer
than GRAM words is its own seed, whole. A stretch is
scored by local alignment with the item: a match counts 1, a substitution or a gap costs PENALTY.
The score is the best sum over the item's length; from LEAK on the document leaks the item. A word
changed, dropped or put in costs little, so edited copies score high. Only stretches that lack so
many of the item's words that they can't reach LEAK, whatever their order, are not aligned.

Items travel to the executors in parts of at most about PART_BYTES of text, one pass over the texts for each
part, so that neither driver nor workers hold more of a large benchmark; within a part the seeds are sorted
arrays with the items and places of each (some 40 MB in a worker for a part of 2 MB of distinct words).
"""

from __future__ import annotations

import math
import string
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pages_of, text_rows

GRAM = 3
LEAK = 0.4
PENALTY = 0.5
PART_BYTES = 2_000_000
MARGIN = 8
#: Cells aligned at once, which bounds memory.
CELLS = 2_000_000

_BREAK = bytes(32 if chr(b) in string.punctuation or b < 32 or b == 127 else b for b in range(256))
_HIT = "array<struct<item_id:bigint,score:double,word:int>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_BREAK).split()


class Seeds:
    """The n-grams of one size: sorted, with the items and places where each stands."""

    def __init__(self, grams: dict[int, np.ndarray]):
        """``grams``: the n-grams of each item, in order of place."""
        every = np.concatenate([*grams.values(), np.empty(0, np.int64)])
        order = np.argsort(every, kind="stable")
        self.item = np.repeat(np.fromiter(grams, np.int32, len(grams)), [len(g) for g in grams.values()])[order]
        self.place = np.concatenate([*(np.arange(len(g), dtype=np.int32) for g in grams.values()), np.empty(0, np.int32)])[order]
        self.all, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every))

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position among ``grams``, item and place in it of each match."""
        if not len(grams) or not len(self.all):
            none = np.empty(0, np.int64)
            return none, none, none
        at = np.searchsorted(self.all, grams)
        at[at == len(self.all)] = 0
        where = np.flatnonzero(self.all[at] == grams)
        low, n = self.first[at[where]], self.first[at[where] + 1] - self.first[at[where]]
        rows = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(where, n), self.item[rows], self.place[rows]


class Items:
    """The test items of one part: vocabulary, words and n-grams."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.ids = [i for i, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        put = self.vocabulary.setdefault
        self.words = [np.array([put(w, len(self.vocabulary)) for w in words_of(t)], np.int64) for _, t in items]
        self.base = max(2, len(self.vocabulary))
        if self.base**GRAM >= 1 << 63:
            raise ValueError("the items' vocabulary is too large for one part; lower PART_BYTES")
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        sizes = {i: min(GRAM, len(w)) for i, w in enumerate(self.words) if len(w)}
        self.seeds = {n: Seeds({i: self.keys(self.words[i], n) for i, m in sizes.items() if m == n}) for n in sorted(set(sizes.values()))}

    def keys(self, words: np.ndarray, size: int = GRAM) -> np.ndarray:
        """A number for each run of ``size`` known words, -1 where one isn't known."""
        n = len(words) - size + 1
        if n <= 0:
            return np.empty(0, np.int64)
        runs = [words[i : n + i] for i in range(size)]
        out = np.zeros(n, np.int64)
        for r in runs:
            out = out * self.base + r
        out[np.min(runs, axis=0) < 0] = -1
        return out

    def look(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))

    def reached(self, item: int, words: np.ndarray) -> bool:
        """Whether so many words of the item are among these that an alignment can score LEAK: each match adds 1 at most."""
        target = self.words[item]
        return np.count_nonzero(np.isin(target, words)) / len(target) >= LEAK


def local_scores(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of the item with each row, and where in the row it ends. Cells of -2 match nothing."""
    rows, size = windows.shape
    ramp = PENALTY * np.arange(size + 1, dtype=np.float32)
    last = np.zeros((rows, size + 1), np.float32)
    best, at = np.zeros(rows, np.float32), np.zeros(rows, np.int64)
    for word in item:
        now = np.zeros_like(last)
        np.maximum(last[:, :-1] + np.where(windows == word, np.float32(1), np.float32(-PENALTY)), last[:, 1:] - np.float32(PENALTY), out=now[:, 1:])
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + ramp, axis=1) - ramp
        where = now.argmax(axis=1)
        top = now[np.arange(rows), where]
        better = top > best
        best[better], at[better] = top[better], where[better]
        last = now
    return best, at


def meetings(items: Items, text: str | None) -> list[tuple[int, int, np.ndarray]]:
    """The stretches of a text around the items' n-grams, one for each item and place, that can reach LEAK.

    A stretch has the item's number, where it starts and its words as numbers of the vocabulary (-1: none);
    stretches of an item that overlap are merged."""
    words = items.look(text)
    out = []
    for n, seeds in items.seeds.items():
        pos, item, place = seeds.find(items.keys(words, n))
        if not len(pos):
            continue
        size = items.sizes[item]
        slack = MARGIN + size // 4
        low, high = np.maximum(0, pos - place - slack), np.minimum(len(words), pos - place + size + slack)
        order = np.lexsort((low, item))
        item, low, high = item[order], low[order], high[order]
        # A stretch begins where the item changes or nothing before it in the item reaches so far.
        apart = item.astype(np.int64) * (len(words) + 1)
        first = np.flatnonzero(np.append(True, (apart + low)[1:] > np.maximum.accumulate(apart + high)[:-1]))
        out += zip(item[first].tolist(), low[first].tolist(), np.maximum.reduceat(high, first).tolist(), strict=True)
    stretches = [(item, low, words[low:high].astype(np.int32)) for item, low, high in out]
    return [x for x in stretches if items.reached(x[0], x[2])]


def _align(items: Items, rows: list[list[tuple[int, int, np.ndarray]]]) -> list[list[dict]]:
    """For each row, given its stretches, the items that leak into it, each at its best alignment."""
    jobs = defaultdict(list)
    for row, stretches in enumerate(rows):
        for item, low, words in stretches:
            jobs[item].append((row, low, words))
    best: list[dict[int, tuple[float, int]]] = [{} for _ in rows]
    for item, found in jobs.items():
        target = items.words[item]
        found.sort(key=lambda x: len(x[2]))
        at = 0
        while at < len(found):
            # Rows of like width are aligned together.
            n = 1
            while at + n < len(found) and (n + 1) * len(found[at + n][2]) <= CELLS:
                n += 1
            some = found[at : at + n]
            windows = np.full((n, len(some[-1][2])), -2, np.int32)
            for i, (_, _, words) in enumerate(some):
                windows[i, : len(words)] = words
            scores, ends = local_scores(target, windows)
            for (row, low, _), score, end in zip(some, scores, ends, strict=True):
                share = float(score) / len(target)
                if share >= LEAK and share > best[row].get(item, (0.0, 0))[0]:
                    best[row][item] = share, low + int(end)
            at += n
    return [[{"item_id": items.ids[i], "score": s, "word": w} for i, (s, w) in sorted(b.items())] for b in best]


def _aligned(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = shared.value
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.iloc[at : at + 256]
                hits = _align(items, [meetings(items, text) for text in some["text"]])
                held = [bool(h) for h in hits]
                ids = pd.array([None if pd.isna(i) else int(i) for i in some["doc_id"][held]], "Int64")
                yield pd.DataFrame({"doc_id": ids, "text_hash": some["text_hash"][held].to_numpy(), "hits": pd.Series([h for h in hits if h], dtype=object)})

    return run


def item_parts(benchmark: DataFrame) -> Iterator[Items]:
    """The items in parts whose text is at most about PART_BYTES: only one part at a time is held."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / PART_BYTES))
    for part in range(n):
        mine = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == part) if n > 1 else rows
        yield Items([(r["item_id"], r["text"]) for r in mine.orderBy("item_id", "text").collect()])


def leaked_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id, score, word: one row for each document row and item that leaks into it.

    word is where the best alignment ends in the document. A null or empty text leaks nothing. Items
    without words match nothing; of one or two words, which must stand whole, they are found like others. Items and documents
    that repeat are each reported; null identifiers are kept. Empty tables give an empty result."""
    spark = docs.sparkSession
    rows = text_rows(docs).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    out = spark.createDataFrame([], f"doc_id bigint, text_hash bigint, hits {_HIT}")
    for items in item_parts(benchmark):
        if not items.seeds:
            continue
        out = out.union(rows.mapInPandas(_aligned(spark.sparkContext.broadcast(items)), f"doc_id bigint, text_hash bigint, hits {_HIT}"))
    return out.select("doc_id", "text_hash", F.explode("hits").alias("hit")).select("doc_id", "text_hash", "hit.item_id", "hit.score", "hit.word")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` into whose text no item leaks, with all their columns."""
    found = leaked_items(docs, benchmark).select(F.col("doc_id").alias("leaky_id"), F.col("text_hash").alias("leaky_hash")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(found["leaky_id"]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == found["leaky_hash"])
    return docs.join(found, same, "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(pages_of(spark, sf_dir, "documents"), pages_of(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "score")
