"""MinHash near-duplicates with b-bit signatures.

1. Each text's distinct word shingles are hashed; texts with equal sets form a class, which is named
   by a print of the set (a doc_id that repeats may have several texts) and has its smallest doc_id.
   Only classes go on, so exact copies make no pairs.
2. A class has LANES minima. BANDS groups of them give band keys; only the low BITS bits of each
   minimum are kept, packed into a few longs.
3. Classes that share a band key are candidates. A bucket isn't paired out: its members are paired
   with two of them, the one of smallest id and the one that shares most buckets with others (the
   text that copies were edited from, where there is one).
4. Similarity is estimated from the packed bits: equal lanes, corrected for lanes that agree by
   chance. Pairs whose estimate is more than SLACK below the threshold are let go; the others are
   confirmed on the full sets.
5. Components of the confirmed links. Buckets whose members are still in different components are
   then compared across components, and pairs that pass the estimate are confirmed too; a pair within
   one component can't change the result. So nothing that shares a band is lost. Buckets of up to
   SMALL members are joined with themselves; the members of larger ones get signatures of FINE lanes,
   which are compared in blocks by bit counts, so that of a large group only pairs close to the
   threshold leave the comparison.

With 32 bands of 4 lanes, a pair of similarity 0.8 shares no band with probability 5e-8, and its
estimate over 128 lanes of 4 bits is SLACK too low with a probability of about 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, pages_of, text_rows
from .components import components
from .shingles import mix, shingle_hashes, word_hashes

BANDS, ROWS, BITS = 32, 4, 4
LANES = BANDS * ROWS
WORDS = LANES * BITS // 64
SLACK = 0.18
#: Members of larger buckets get a finer signature for the comparison across components.
SMALL = 32
FINE = 1024
#: Identifiers (8 bytes each) that are broadcast at most; beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
FINE_SLACK = 0.065
BLOCK = 1024
_STEP = 4096
_LOW = int("1" * (64 // BITS), 1 << BITS)

_FINE = np.random.default_rng(20_25).integers(0, 1 << 63, FINE, np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = np.random.default_rng(20_24).integers(0, 1 << 63, LANES, np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and packed low bits of the minima of LANES multiplicative permutations."""
    least = np.full(LANES, ~np.uint64(0), np.uint64)
    for at in range(0, len(shingles), _STEP):
        np.minimum(least, (shingles[None, at : at + _STEP] * _FACTORS[:, None]).min(axis=1), out=least)
    least = mix(least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + row)
    lanes = (least & np.uint64((1 << BITS) - 1)).reshape(WORDS, 64 // BITS)
    packed = (lanes << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)
    return keys.view(np.int64), packed.view(np.int64)


def _print_a(s: np.ndarray) -> int:
    return int(mix(s ^ np.uint64(0xA5A5)).sum(dtype=np.uint64).view(np.int64))


def _sign(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n_shingles", "print_a", "print_b", "keys", "bits")}
            for text in batch["text"]:
                s = shingle_hashes(word_hashes(text or ""), k)
                keys, bits = signature(s) if len(s) else (None, None)
                # Two sums over the set, which don't depend on order, name the set.
                a, b = _print_a(s), int(mix(s * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).view(np.int64))
                for c, v in zip(out, (len(s), a, b, keys, bits), strict=True):
                    out[c].append(v)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], **out})

    return run


def _sets(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_hashes(word_hashes(t or ""), k).view(np.int64) for t in batch["text"]]
            prints = [_print_a(s.view(np.uint64)) for s in sets]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "id": prints, "shingles": sets})

    return run


def estimate(a: str, b: str) -> Column:
    """Collision-corrected similarity from two arrays of packed lanes."""
    differ: Column = F.lit(0)
    for i in range(WORDS):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        any_bit = x
        for s in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, s))
        differ = differ + F.bit_count(any_bit.bitwiseAND(F.lit(_LOW)))
    chance = 1 / (1 << BITS)
    return ((1 - differ / LANES) - chance) / (1 - chance)


def _fine(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints, bits = [], []
            for text in batch["text"]:
                s = shingle_hashes(word_hashes(text or ""), k)
                least = np.full(FINE, ~np.uint64(0), np.uint64)
                for at in range(0, len(s), 512):
                    np.minimum(least, (s[None, at : at + 512] * _FINE[:, None]).min(axis=1), out=least)
                lanes = (mix(least) & np.uint64((1 << BITS) - 1)).reshape(-1, 64 // BITS)
                bits.append((lanes << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64))
                prints.append(_print_a(s))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "id": prints, "fine": bits})

    return run


def _similar(x: np.ndarray) -> np.ndarray:
    """Corrected similarity from the last axis of XORed packed lanes."""
    any_bit = x.copy()
    for s in range(1, BITS):
        any_bit |= x >> np.uint64(s)
    differ = np.bitwise_count(any_bit & np.uint64(_LOW)).sum(axis=-1, dtype=np.int32)
    chance = 1 / (1 << BITS)
    return ((1 - differ / (x.shape[-1] * 64 // BITS)) - chance) / (1 - chance)


def _across(least: float):
    """Pairs of two blocks of a bucket, from different components, that may be similar; each at the first band that the two share."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []})
        band = int(left["band"].iloc[0])
        bits = [np.stack(x["fine"].to_numpy()).view(np.uint64) for x in (left, right)]
        keys = [np.stack(x["keys"].to_numpy()) for x in (left, right)]
        ids = [x["id"].to_numpy() for x in (left, right)]
        comps = [x["component"].to_numpy() for x in (left, right)]
        found = [np.empty((2, 0), np.int64)]
        for at in range(0, len(left), 64):
            part = slice(at, at + 64)
            # The first lanes rule most pairs out; the rest of the signature decides on the others.
            rough = _similar(bits[0][part, None, :WORDS] ^ bits[1][None, :, :WORDS]) >= least - SLACK
            i, j = np.nonzero(rough & (comps[0][part, None] != comps[1][None, :]) & (ids[0][part, None] < ids[1][None, :]))
            i += at
            first = (keys[0][i] == keys[1][j]).argmax(axis=1) == band
            i, j = i[first], j[first]
            for lo in range(0, len(i), 20_000):
                some = slice(lo, lo + 20_000)
                close = _similar(bits[0][i[some]] ^ bits[1][j[some]]) >= least - FINE_SLACK
                found.append(np.stack([ids[0][i[some][close]], ids[1][j[some][close]]]))
        a, b = np.concatenate(found, axis=1)
        return pd.DataFrame({"a": a, "b": b})

    return run


def _texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """Texts of documents by doc_id. Where a doc_id repeats with different texts, other classes' texts come too."""
    wanted = materialise(ids.select("doc_id").distinct(), "wanted")
    # Few identifiers go to the texts; many meet them in a shuffle.
    few = wanted.count() <= BROADCAST_IDS
    return text_rows(docs).join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")


def _confirm(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b: names of classes) whose full sets reach the threshold, as u, v."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(nodes.select("id", "doc_id"), "id").select("id", "doc_id")
    sets = _texts_of(ids, docs).mapInPandas(_sets(k), "doc_id bigint, id bigint, shingles array<bigint>")
    sets = materialise(sets.join(ids, ["id", "doc_id"], "left_semi").dropDuplicates(["id"]).select("id", "shingles"), "sets")
    side = lambda n: sets.select(F.col("id").alias(n), F.col("shingles").alias(f"s_{n}"))
    both = F.size(F.array_intersect("s_a", "s_b")).cast("long")
    union = F.size("s_a") + F.size("s_b") - both
    return pairs.join(side("a"), "a").join(side("b"), "b").where(100 * both >= percent * union).select(F.col("a").alias("u"), F.col("b").alias("v"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_hash, n_shingles, group, component_id and kept (doc_id = component_id) for each row of ``docs``.

    group names the linked texts, component_id is the smallest doc_id among them.

    A text without words (null, empty, white space) has no shingles and is linked with nothing; one of
    fewer than k words has its whole sequence as its only shingle. Rows that repeat a doc_id are one
    document where a text is the same; different texts of a doc_id are linked only if they are similar. A row
    with a null doc_id gets the component of equal texts that have one, else null, and is kept only then.
    group is null without shingles and where no equal text has a doc_id. Other columns are not read. An empty table gives an empty result."""
    signed = materialise(
        text_rows(docs).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit("")))).mapInPandas(_sign(k), "doc_id bigint, text_hash bigint, n_shingles bigint, print_a bigint, print_b bigint, keys array<bigint>, bits array<bigint>"),
        "signatures",
    )
    prints = ["print_a", "print_b"]
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy(*prints).agg(F.min("doc_id").alias("doc_id"))
    nodes = materialise(
        classes.join(signed.select("doc_id", *prints, "keys", "bits"), ["doc_id", *prints]).dropDuplicates(["doc_id", *prints]).withColumn("id", F.col("print_a")), "classes"
    )
    bands = nodes.select("id", F.posexplode("keys").alias("band", "key"))

    sizes = bands.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1")
    members = materialise(bands.join(sizes, "key").select("id", "band", "key", "least", "n"), "members")
    weight = members.groupBy("id").agg(F.sum("n").alias("weight"))
    central = members.join(weight, "id").groupBy("key").agg(F.max_by("id", F.struct("weight", F.bitwise_not("id"))).alias("central"))
    to_least = members.select("id", F.col("least").alias("hub"))
    to_central = members.select("id", "key").join(central, "key").select("id", F.col("central").alias("hub"))
    stars = to_least.union(to_central).where("id != hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    bits = lambda n: nodes.select(F.col("id").alias(n), F.col("bits").alias(f"bits_{n}"))
    least = percent / 100 - SLACK
    likely = stars.join(bits("a"), "a").join(bits("b"), "b").where(estimate("bits_a", "bits_b") >= least).select("a", "b")
    links = materialise(_confirm(materialise(likely, "likely"), docs, nodes, k, percent), "links")
    found = components(links)

    # Buckets that still hold more than one component.
    held = members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = held.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low != high")
    mixed_members = materialise(held.select("id", "band", "key", "component").join(mixed.select("key", "size"), "key"), "mixed")
    few = mixed_members.where(F.col("size") <= SMALL)
    one, two = few.select("key", F.col("id").alias("a"), F.col("component").alias("of_a")), few.select("key", F.col("id").alias("b"), F.col("component").alias("of_b"))
    close = one.join(two, "key").where("a < b and of_a != of_b").select("a", "b").distinct().join(stars, ["a", "b"], "left_anti")
    close = close.join(bits("a"), "a").join(bits("b"), "b").where(estimate("bits_a", "bits_b") >= least).select("a", "b")

    many = mixed_members.where(F.col("size") > SMALL)
    fine = _texts_of(many.select("id").distinct().join(nodes.select("id", "doc_id"), "id"), docs).mapInPandas(_fine(k), "doc_id bigint, id bigint, fine array<bigint>")
    fine = nodes.select("id", "doc_id", "keys").join(fine, ["id", "doc_id"]).dropDuplicates(["id"]).drop("doc_id")
    split = many.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    split = materialise(split.join(fine, "id"), "large")
    each = F.sequence(F.lit(0), F.col("blocks") - 1)
    columns = ["id", "band", "component", "keys", "fine"]
    left = split.withColumn("row", F.col("block")).withColumn("col", F.explode(each)).select("key", "row", "col", *columns)
    right = split.withColumn("col", F.col("block")).withColumn("row", F.explode(each)).select(F.col("key").alias("key2"), F.col("row").alias("row2"), F.col("col").alias("col2"), *[F.col(c).alias(c) for c in columns])
    large = left.groupBy("key", "row", "col").cogroup(right.groupBy("key2", "row2", "col2")).applyInPandas(_across(percent / 100), "a bigint, b bigint")
    more = materialise(close.union(large.join(stars, ["a", "b"], "left_anti")).distinct(), "across")
    if not more.isEmpty():
        links = links.union(_confirm(more, docs, nodes, k, percent))
        found = components(links)

    linked = nodes.select("id", "doc_id").join(found, "id")
    least_id = linked.groupBy("component").agg(F.min("doc_id").alias("least_id"))
    named = linked.join(least_id, "component").select("id", "component", "least_id")
    of_class = nodes.select("id", "doc_id", *prints).join(named, "id", "left")
    of_class = of_class.select(*prints, F.coalesce("component", "id").alias("group"), F.coalesce("least_id", "doc_id").alias("component_id"))
    out = signed.select("doc_id", "text_hash", "n_shingles", *prints).join(of_class, prints, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("group")).alias("group"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(pages_of(spark, sf_dir, "documents"), k=4, percent=80).drop("text_hash", "group")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with all columns, less the rows whose text another row stands for: of each group that of the
    smallest doc_id stays, once; rows without a group all stay, equal ones once. Rows of null doc_id stay if no
    row with one has an equal text."""
    found = materialise(near_duplicates(docs, k, percent), "groups")
    told = F.when(F.col("group").isNull(), F.col("text_hash"))
    stay = found.where("kept").groupBy("doc_id", "group", told).agg(F.min("text_hash").alias("stay_hash")).select(F.col("doc_id").alias("stay_id"), "stay_hash").distinct()
    hashed = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    kept = docs.join(stay, docs["doc_id"].cast("long").eqNullSafe(stay["stay_id"]) & (hashed == stay["stay_hash"]), "left_semi")
    if found.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        return kept
    return kept.dropDuplicates(["doc_id", "text"])


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s
  FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v
  FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.doc_id, links.v FROM reach JOIN links ON links.u = reach.r),
least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept
FROM sets s JOIN least l USING (doc_id)
"""
