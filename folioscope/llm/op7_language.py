"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for each piece of a fixed public vocabulary. A word's probability
is the sum, over all ways to cut it into pieces, of the product of the pieces' probabilities: a
forward pass over the word gives the sum without listing the ways. A text's score is the product
over its words (runs of letters, lower-cased, each with the vocabulary's mark of a word start).

The piece probabilities are learned by expectation-maximisation: a forward and a backward pass give
each piece's expected count in the training words. A character that no piece covers costs the same
in all languages. Words are a table; each round is a job over it that sums expected counts by language
and piece, as whole numbers of 1 / UNIT, so that neither order nor partitions change a sum.

Training reads about FIT_DOCS documents of each language (those whose identifier and text hash lowest),
and all their words, whatever their number or length. The prior counts all labelled documents that
aren't held out. Everything else sees every text whole. The model is bounded by the vocabulary and
MAX_LANGUAGES; more languages than that are refused.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, held_out, materialise, pages_of, ship

FIT_DOCS = 2_000
MAX_LANGUAGES = 100
ROUNDS = 3
UNIT = 1 << 16
#: A probability for pieces that a language's training words don't show, and for uncovered characters.
FLOOR = 1e-7
#: Words up to this length are scored together, longer ones alone.
WIDE = 40
#: Words whose pieces are counted at once.
COUNTED = 1024
#: Bytes that a process keeps of words and their scores, and what a word's entry takes besides its characters and scores.
#: Beyond that only words of many texts are kept, which changes no result.
MAX_CACHED_BYTES, ENTRY_BYTES = 40_000_000, 200
UNKNOWN = "und"
MARK = "▁"

_LETTERS = re.compile(r"[^\W\d_]+")


def vocabulary(path: str) -> dict[str, int]:
    """Lower-case pieces of letters (with or without the mark) of a SentencePiece file, numbered from 1."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {p.lower() for p in map(model.id_to_piece, range(model.get_piece_size()))}
    kept = sorted(p for p in pieces if p and all(c == MARK or c.isalpha() for c in p))
    return {p: i + 1 for i, p in enumerate(kept)}


class Pieces:
    """Finds pieces by a hash of their characters, for many substrings at once: two tables by address, the second
    for pieces whose place in the first is taken. A find is one only if the whole 64-bit hashes agree."""

    BITS = 20
    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, numbers: dict[str, int]):
        self.numbers = numbers
        self.longest = max(map(len, numbers), default=1)
        self.hashes = np.zeros(len(numbers) + 1, np.uint64)
        self.tables = np.zeros((2, 1 << self.BITS), np.int32)
        for piece, number in numbers.items():
            h = np.zeros(1, np.uint64)
            for c in piece:
                h = self.step(h, np.uint64(ord(c)))
            self.hashes[number] = h[0]
        for number in range(1, len(self.hashes)):
            free = [t for t in range(2) if self.tables[t, self.place(self.hashes[number], t)] == 0]
            if not free:
                raise ValueError("the vocabulary doesn't fit the tables; raise BITS")
            self.tables[free[0], self.place(self.hashes[number], free[0])] = number

    def step(self, h: np.ndarray, code: np.ndarray) -> np.ndarray:
        h = (h + code + np.uint64(1)) * self.BASE
        return h ^ (h >> np.uint64(29))

    def place(self, h, table: int):
        return (h >> np.uint64(64 - self.BITS)) if table == 0 else ((h >> np.uint64(20)) & np.uint64((1 << self.BITS) - 1))

    def find(self, h: np.ndarray) -> np.ndarray:
        first = self.tables[0][self.place(h, 0)]
        out = np.where(self.hashes[first] == h, first, 0)
        second = self.tables[1][self.place(h, 1)]
        return np.where(self.hashes[second] == h, second, out)


def _cuts(words: list[str], pieces: Pieces) -> np.ndarray:
    """Piece numbers by word, end and length of the piece; 0 where there is none. Words have one length."""
    n, size = len(words), len(words[0])
    codes = np.array(words, f"<U{size}").view(np.uint32).reshape(n, size).astype(np.uint64)
    out = np.zeros((n, size + 1, pieces.longest + 1), np.int32)
    h = np.zeros((n, size), np.uint64)
    for length in range(1, min(pieces.longest, size) + 1):
        # Column i holds the hash of the substring of this length that starts at i.
        h = pieces.step(h[:, : size - length + 1], codes[:, length - 1 :])
        out[:, length:, length] = pieces.find(h)
    return out


def _forward(cuts: np.ndarray, p: np.ndarray) -> np.ndarray:
    """alpha[word, place, language]; p[0] is zero, and a single character has FLOOR at least."""
    n, places, longest = cuts.shape
    alpha = np.zeros((n, places, p.shape[1]))
    alpha[:, 0] = 1
    for end in range(1, places):
        alpha[:, end] = alpha[:, end - 1] * np.maximum(p[cuts[:, end, 1]], FLOOR)
        for length in range(2, min(longest - 1, end) + 1):
            ids = cuts[:, end, length]
            if ids.any():
                alpha[:, end] += alpha[:, end - length] * p[ids]
    return alpha


def _long_word(word: str, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """The same sum for one word of any length, rescaled at each place; log of the total."""
    numbers, longest = pieces.numbers, pieces.longest
    window = [np.ones(p.shape[1])]
    scale = np.zeros(p.shape[1])
    for end in range(1, len(word) + 1):
        now = window[-1] * np.maximum(p[numbers.get(word[end - 1], 0)], FLOOR)
        for length in range(2, min(longest, end) + 1):
            i = numbers.get(word[end - length : end])
            if i:
                now = now + window[-length] * p[i]
        window = [*window[-longest + 1 :], now]
        top = now.copy()
        scale += np.log(top)
        window = [x / top for x in window]
    return scale


def _expected_of_long(word: str, pieces: Pieces, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces and their expected counts in one word of any length, by passes over logarithms."""
    numbers, size = pieces.numbers, len(word)
    cuts = [[(n, i) for n in range(1, min(pieces.longest, end) + 1) if (i := numbers.get(word[end - n : end], 0)) or n == 1] for end in range(size + 1)]
    price = [np.log([max(q[i], FLOOR) if n == 1 else q[i] for n, i in c]) for c in cuts]
    alpha = np.zeros(size + 1)
    for end in range(1, size + 1):
        alpha[end] = np.logaddexp.reduce(price[end] + alpha[[end - n for n, _ in cuts[end]]])
    beta = np.full(size + 1, -np.inf)
    beta[size] = 0
    ids, counts = [], []
    for end in range(size, 0, -1):
        starts = [end - n for n, _ in cuts[end]]
        beta[starts] = np.logaddexp(beta[starts], price[end] + beta[end])
        ids += [i for _, i in cuts[end]]
        counts.append(np.exp(alpha[starts] + price[end] + beta[end] - alpha[size]))
    return np.array(ids, np.int64), np.concatenate(counts)


def _all_pieces(cuts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pieces of each word, all counted once: where the first round starts."""
    flat = cuts.reshape(len(cuts), -1)
    return [(flat, np.ones_like(flat, float))]


def _expected(cuts: np.ndarray, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Arrays of pieces by word, and how often each is expected under the probabilities q."""
    alpha = _forward(cuts, q[:, None])[:, :, 0]
    beta = np.zeros_like(alpha)
    beta[:, -1] = 1
    out = []
    places = alpha.shape[1]
    for start in range(places - 2, -1, -1):
        for length in range(1, min(cuts.shape[2] - 1, places - 1 - start) + 1):
            ids = cuts[:, start + length, length]
            share = q[ids] if length > 1 else np.maximum(q[ids], FLOOR)
            after = share * beta[:, start + length]
            beta[:, start] += after
            out.append((ids[:, None], (alpha[:, start] * after / alpha[:, -1])[:, None]))
    return out


def expected_counts(words: dict[str, int], pieces: Pieces, q: np.ndarray | None) -> np.ndarray:
    """Expected counts of all pieces, in units of 1 / UNIT, over words (with their mark) and their counts; q None: the first round."""
    out = np.zeros(len(pieces.hashes))

    def add(ids: np.ndarray, shares: np.ndarray, n: np.ndarray) -> None:
        # Whole numbers below 2**53, so that sums of them are exact.
        out[:] += np.bincount(ids.ravel(), np.rint(shares * UNIT * n).ravel(), len(out))

    by_size: dict[int, list[str]] = defaultdict(list)
    for w in words:
        by_size[len(w)].append(w)
    for size, some in by_size.items():
        if size > WIDE:
            for w in some:
                if q is None:
                    add(*((x := _cuts([w], pieces).ravel()), np.ones(len(x)), np.float64(words[w])))
                else:
                    add(*_expected_of_long(w, pieces, q), np.float64(words[w]))
            continue
        for at in range(0, len(some), COUNTED):
            block = some[at : at + COUNTED]
            n = np.array([words[w] for w in block], float)[:, None]
            cuts = _cuts(block, pieces)
            for ids, shares in _all_pieces(cuts) if q is None else _expected(cuts, q):
                add(ids, shares, n)
    out[0] = 0
    return out


def _runs(word: str) -> list[str]:
    """Runs of letters (characters of the letter categories, which other word characters aren't)."""
    if word.isalpha():
        return [word]
    found = _LETTERS.findall(word)
    return found if all(map(str.isalpha, found)) else "".join(c if c.isalpha() else " " for c in word).split()


class Model:
    def __init__(self, langs: list[str], pieces: Pieces, p: np.ndarray, prior: np.ndarray):
        self.langs, self.pieces, self.p, self.prior = langs, pieces, p, prior
        self._forget()

    def _forget(self) -> None:
        """Row 0 is for words without a letter."""
        self.rows: dict[str, int] = {}
        self.bytes = 0
        self.table = np.zeros((1 << 12, len(self.langs)))
        #: How many texts each row's word stood in; halved whenever words are let go.
        self.hits = np.zeros(1 << 12, np.int32)
        self.used = 1

    def _size(self, words: list[str]) -> int:
        """Bytes that these words take in the cache; the table may be twice as long as it is used, and a character takes 4 bytes at most."""
        return len(words) * (ENTRY_BYTES + 16 * len(self.langs)) + 4 * sum(map(len, words))

    def _put(self, words: list[str], scores: np.ndarray, rows: Iterable[int], hits: np.ndarray | int = 0) -> None:
        """Appends rows of scores, and the words with the row of each."""
        first, self.used = self.used, self.used + len(scores)
        if self.used > len(self.table):
            more = max(self.used - len(self.table), len(self.table))
            self.table = np.concatenate((self.table, np.zeros((more, len(self.langs)))))
            self.hits = np.concatenate((self.hits, np.zeros(more, np.int32)))
        self.table[first : self.used], self.hits[first : self.used] = scores, hits
        self.rows.update(zip(words, rows, strict=True))
        self.bytes += self._size(words)

    def _keep_frequent(self) -> None:
        """Lets go of the words but for a quarter, those that stood in most texts."""
        words = [w for w, at in self.rows.items() if at]
        rows = np.array([at for at in self.rows.values() if at], np.int64)
        order = np.argsort(-self.hits[rows], kind="stable")[: len(words) // 4]
        scores, hits = self.table[rows[order]], self.hits[rows[order]] // 2
        self._forget()
        self._put([words[i] for i in order.tolist()], scores, range(1, len(order) + 1), hits)

    def __getstate__(self):
        return {"langs": self.langs, "pieces": self.pieces, "p": self.p, "prior": self.prior}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._forget()

    def _score(self, parts: list[str]) -> np.ndarray:
        """Log probabilities of runs of letters, by language."""
        out = np.zeros((len(parts), len(self.langs)))
        by_size: dict[int, list[int]] = defaultdict(list)
        for i, x in enumerate(parts):
            by_size[len(x)].append(i)
        for size, some in by_size.items():
            if size > WIDE:
                for i in some:
                    out[i] = _long_word(parts[i], self.pieces, self.p)
                continue
            for at in range(0, len(some), 2048):
                block = some[at : at + 2048]
                out[block] = np.log(_forward(_cuts([parts[i] for i in block], self.pieces), self.p)[:, -1])
        return out

    def words(self, words: list[str]) -> None:
        """Scores words, of any form, and keeps them: a word is the product of its runs of letters."""
        numbers: dict[str, int] = {}
        owner, part = [], []
        for i, w in enumerate(words):
            for x in _runs(w):
                owner.append(i)
                part.append(numbers.setdefault(MARK + x.lower(), len(numbers)))
        new = np.zeros((len(words), len(self.langs)))
        if part:
            np.add.at(new, owner, self._score(list(numbers))[part])
        lettered = np.zeros(len(words), bool)
        lettered[owner] = True
        self._put(words, new, [self.used + i if has else 0 for i, has in enumerate(lettered.tolist())])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        counts = [Counter((t or "").split()) for t in texts]
        missing = list({w for c in counts for w in c if w not in self.rows})
        if self.bytes + self._size(missing) > MAX_CACHED_BYTES:
            self._keep_frequent()
            if self.bytes + self._size(missing) > MAX_CACHED_BYTES:
                self._forget()
            missing = list({w for c in counts for w in c if w not in self.rows})
        if missing:
            self.words(missing)
        out = []
        for c in counts:
            rows = np.fromiter(map(self.rows.__getitem__, c), np.int64, len(c))
            if not rows.any() or not self.langs:
                out.append((UNKNOWN, 0.0))
                continue
            self.hits[rows] += 1
            total = np.log(self.prior) + np.fromiter(c.values(), np.float64, len(c)) @ self.table[rows]
            share = np.exp(total - total.max())
            best = int(share.argmax())
            out.append((self.langs[best], float(share[best] / share.sum())))
        return out


def probabilities(counts: np.ndarray, last: bool = False) -> np.ndarray:
    """From expected counts [piece, language]; the last ones have FLOOR where training shows nothing."""
    if last:
        p = np.maximum(counts / np.maximum(counts.sum(axis=0), 1.0), FLOOR)
    else:
        p = (counts / UNIT + 1e-3) / (counts.sum(axis=0) / UNIT + 1e-3 * len(counts))
    p[0] = 0
    return p


def learn(counts: dict[str, dict[str, int]], documents: dict[str, int], vocabulary: dict[str, int]) -> Model:
    """The same as ``fit`` on one machine. counts: word (with its mark) and count, by language; documents gives the prior."""
    langs, pieces = sorted(documents), Pieces(vocabulary)
    p = None
    for r in range(ROUNDS + 1):
        found = [expected_counts(counts.get(x, {}), pieces, None if p is None else p[:, at]) for at, x in enumerate(langs)]
        p = probabilities(np.stack(found, axis=1) if langs else np.zeros((len(pieces.hashes), 0)), r == ROUNDS)
    seen = np.array([documents[x] for x in langs], float)
    return Model(langs, pieces, p, seen / seen.sum() if langs else seen)


def _summed(shared):
    """Of a task's words: language, piece and expected count, one row for each pair that occurs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, p = shared.value
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, some in batch.groupby("at"):
                found = expected_counts(dict(zip(some["w"], some["n"], strict=True)), pieces, None if p is None else p[:, at])
                totals[at] = totals.get(at, 0) + found
        for at, total in totals.items():
            where = np.flatnonzero(total)
            yield pd.DataFrame({"at": int(at), "piece": where, "units": total[where].astype(np.int64)})

    return run


def training_words(docs: DataFrame) -> tuple[dict[str, int], DataFrame]:
    """Documents a language, of all rows that may teach, and the words of the chosen rows: at (the language's place), w (with its mark), n."""
    spark = docs.sparkSession
    marked = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("t"), F.col("lang").alias("l"))
    marked = marked.where("l is not null and t is not null and id is not null").where(~held_out(F.col("id")))
    found = marked.groupBy("l").count().limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    documents = {r["l"]: r["count"] for r in sorted(found, key=lambda r: r["l"])}
    shares = spark.createDataFrame([(l, at, FIT_DOCS / n) for at, (l, n) in enumerate(documents.items())], "l string, at int, share double")
    # A number from 0 to 1 for each row, so that about FIT_DOCS rows fall below a language's share; no rows meet in one task.
    drawn = F.pmod(F.xxhash64("id", "t"), F.lit(1 << 32)) / (1 << 32)
    chosen = marked.join(F.broadcast(shares), "l").where(drawn < F.col("share"))
    words = chosen.select("at", F.explode(F.regexp_extract_all(F.lower("t"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("w")).groupBy("at", "w").agg(F.count("*").alias("n"))
    return documents, words.select("at", F.concat(F.lit(MARK), "w").alias("w"), "n")


def fit(docs: DataFrame, path: str) -> Model:
    """Learns from text and lang of documents that aren't held out; rows without lang, text or doc_id teach nothing."""
    spark = docs.sparkSession
    documents, words = training_words(docs)
    langs, pieces = list(documents), Pieces(vocabulary(path))
    words = materialise(words, "language-words")
    p = None
    for r in range(ROUNDS + 1):
        sums = words.mapInPandas(_summed(spark.sparkContext.broadcast((pieces, p))), "at int, piece int, units bigint").groupBy("at", "piece").agg(F.sum("units").alias("units")).toPandas()
        counts = np.zeros((len(pieces.hashes), len(langs)))
        counts[sums["piece"], sums["at"]] = sums["units"]
        p = probabilities(counts, r == ROUNDS)
    drop_table(words)
    seen = np.array(list(documents.values()), float)
    return Model(langs, pieces, p, seen / seen.sum() if langs else seen)


def language_column(spark: SparkSession, model: Model, text: str = "text") -> Column:
    """A column struct(lang_pred, score). ``und`` and 0 for a null text, one without a letter, or a model of no language."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            texts, out = batch.tolist(), []
            for at in range(0, len(texts), 128):
                out += model.predict(texts[at : at + 128])
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    return predict(F.col(text).cast("string"))


def identify(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``.

    score is the language's share of the probability. Ties go to the language that sorts first. Rows
    that repeat and null doc_ids are kept; other columns are not read."""
    model = fit(docs, path)
    out = docs.select("doc_id", language_column(docs.sparkSession, model).alias("found"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "found.lang_pred", "found.score")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return identify(pages_of(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
