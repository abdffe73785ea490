"""Approximate nearest neighbours by stable projections and a kd-tree.

Unit vectors are projected on DIMS random Gaussian directions, made orthogonal to each other. By
2-stability the squared projected distance of two vectors, over their squared distance, follows a
chi-square law of DIMS degrees; orthogonal directions only draw it closer to its mean. Every vector is
indexed in projected space: first by cell (splitting planes laid on a bounded sample), within a cell by a
kd-tree of leaves with their boxes.

A query opens leaves in order of their projected distance and verifies vectors one after the other in
order of *their* projected distance, by the exact cosine in double precision: a vector's turn comes when no
unopened leaf can hold a nearer one. It stops when the chi-square test holds: when a vector as near as the
K-th found would lie within the projected distance reached with probability STOP. It first searches its own
cell; the radius found there, by the same test, says which other cells it must visit. Rounds of STEP
vectors are verified between two tests.

A cell of more than CELL_ROWS vectors is searched in parts, and one that more than QUERY_ROWS queries
reach by parts of the queries, so that no group outgrows a task. Equal vectors are indexed once, with their
K + 1 smallest identifiers: no more can be in a result. Vectors of different lengths have no cosine; each
length has cells of its own.

STOP and DIMS are chosen by measured recall (see the README): on isotropic vectors, the hardest case, a
query verifies a tenth to a fifth of them.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, pages_of

DIMS = 24
K = 5
STOP = 0.85
CELL_ROWS = 16_384
QUERY_ROWS = 16_384
#: Vectors, of which only projections are gathered, that lay the cells.
SAMPLE = 20_000
#: Cells that the sample lays at most; more vectors go to parts of cells.
MAX_DEPTH = 12
LEAF = 128
STEP = 64
EVERY = 50


def chi_square(x: np.ndarray, degrees: int) -> np.ndarray:
    """Distribution function for an even number of degrees."""
    half = np.minimum(x / 2, 500)
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, degrees // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def chi_square_bound(p: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(np.array(mid), degrees) < p else (low, mid)
    return high


@lru_cache(64)
def bound(length: int) -> float:
    """Squared projected distance, over the squared distance, that STOP of the vectors stay within."""
    return chi_square_bound(STOP, dims(length))


def dims(length: int) -> int:
    """An even number of directions, no more than the vectors' length; one or two for the shortest."""
    return min(DIMS, max(2, length - length % 2))


@lru_cache(16)
def projection(length: int) -> np.ndarray:
    """Directions of the norm that independent Gaussian ones have on average, orthogonal where there is room."""
    m = dims(length)
    g = np.random.default_rng(11).normal(size=(length, m))
    return np.linalg.qr(g)[0] * math.sqrt(length) if length >= m else g


def stacked(embeddings) -> np.ndarray:
    return np.stack(embeddings.to_numpy()).astype(float)


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors divided by a power of two near their largest component, which is exact and keeps squares finite, and their norms."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x, np.sqrt((x * x).sum(axis=1))


def low(embeddings) -> np.ndarray:
    """Projections of vectors of one length."""
    x, size = scaled(stacked(embeddings))
    return x / size[:, None] @ projection(x.shape[1])


class Cells:
    """Splitting planes of projected space as a complete binary tree."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.at = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)

        def split(node: int, points: np.ndarray, level: int) -> None:
            if level == depth:
                return
            axis = int(points.var(axis=0).argmax()) if len(points) else 0
            at = float(np.median(points[:, axis])) if len(points) else 0.0
            self.axis[node], self.at[node] = axis, at
            below = points[:, axis] < at if len(points) else np.zeros(0, bool)
            split(2 * node, points[below], level + 1)
            split(2 * node + 1, points[~below], level + 1)

        split(1, sample, 0)

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] >= self.at[node])
        return node - (1 << self.depth)

    def within(self, point: np.ndarray, squared: float) -> list[int]:
        """Cells whose region comes as near to the point as the squared radius."""
        out, stack = [], [(1, np.zeros(len(point)))]
        while stack:
            node, gaps = stack.pop()
            if (gaps**2).sum() > squared:
                continue
            if node >= 1 << self.depth:
                out.append(node - (1 << self.depth))
                continue
            axis, gap = self.axis[node], point[self.axis[node]] - self.at[node]
            far = gaps.copy()
            far[axis] = max(far[axis], abs(gap))
            side = int(gap >= 0)
            stack += [(2 * node + side, gaps), (2 * node + 1 - side, far)]
        return out


def _tree(points: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Rows of each leaf, and the leaves' boxes."""
    leaves, stack = [], [np.arange(len(points))]
    while stack:
        rows = stack.pop()
        if len(rows) <= LEAF:
            leaves.append(rows)
            continue
        axis = int(np.ptp(points[rows], axis=0).argmax())
        half = np.argpartition(points[rows, axis], len(rows) // 2)
        stack += [rows[half[len(rows) // 2 :]], rows[half[: len(rows) // 2]]]
    return leaves, np.stack([points[x].min(axis=0) for x in leaves]), np.stack([points[x].max(axis=0) for x in leaves])


class Index:
    """The vectors of a cell, or of a part of one."""

    def __init__(self, vectors: np.ndarray, ids: list[np.ndarray]):
        self.raw, self.size = scaled(vectors)
        self.ids = ids
        self.low = self.raw / self.size[:, None] @ projection(vectors.shape[1])
        self.leaves, self.least, self.most = _tree(self.low)
        self.bound = bound(vectors.shape[1])

    def search(self, query: np.ndarray, query_id: int, floor: float, k: int) -> tuple[list[tuple[float, int]], int]:
        """The k best found of at least the floor's cosine, as (score, id), best first, and how many vectors were verified."""
        q, q_size = scaled(query[None])
        q, q_size = q[0], q_size[0]
        p = q / q_size @ projection(len(q))
        gap = np.maximum(np.maximum(self.least - p, p - self.most), 0)
        to_leaf = (gap * gap).sum(axis=1)
        order = np.argsort(to_leaf, kind="stable")
        best: list[tuple[float, int]] = []
        worst, verified, opened, opening = floor, 0, 0, 4
        waiting, distance = np.empty(0, np.int64), np.empty(0)
        # Squared distance of unit vectors is 2 - 2 cos; before k are found, and without a floor, nothing stops the search.
        reach = self.bound * max(2 - 2 * worst, 0) if worst > -2 else np.inf
        while opened < len(order) or len(waiting):
            if opened < len(order):
                new = np.concatenate([self.leaves[i] for i in order[opened : opened + opening]])
                opened, opening = opened + opening, 2 * opening
                gap = self.low[new] - p
                waiting, distance = np.concatenate((waiting, new)), np.concatenate((distance, (gap * gap).sum(axis=1)))
                rank = np.argsort(distance, kind="stable")
                waiting, distance = waiting[rank], distance[rank]
            far = to_leaf[order[opened]] if opened < len(order) else np.inf
            ready = int(np.searchsorted(distance, far, "right"))
            at = 0
            while at < ready and distance[at] <= reach:
                rows = waiting[at : min(ready, at + STEP)]
                at += len(rows)
                verified += len(rows)
                scores = self.raw[rows] @ q / (self.size[rows] * q_size)
                helps = np.flatnonzero(scores >= worst)
                if len(helps):
                    best += [(float(scores[i]), int(v)) for i in helps for v in self.ids[rows[i]] if v != query_id]
                    best = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
                    if len(best) >= k and best[-1][0] > worst:
                        worst = best[-1][0]
                        reach = self.bound * max(2 - 2 * worst, 0)
            if at < ready or far > reach:
                break
            waiting, distance = waiting[at:], distance[at:]
        return best, verified


def _search(k: int):
    """Of one part of a cell: each query with the best it finds there, given the least cosine that still helps (floor)."""

    def run(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": [], "verified": []}
        if not len(queries) or not len(points):
            return pd.DataFrame(out)
        index = Index(stacked(points["embedding"]), [np.sort(x) for x in points["ids"]])
        for query_id, embedding, floor in zip(queries["query_id"], queries["embedding"], queries["floor"], strict=True):
            best, n = index.search(np.asarray(embedding, float), query_id, floor, k)
            # A row without vec_id carries the number of verified vectors.
            for score, v, x in [*((s, v, 0) for s, v in best), (None, None, n)]:
                for c, value in zip(out, (query_id, v, score, x), strict=True):
                    out[c].append(value)
        return pd.DataFrame(out | {"vec_id": pd.array(out["vec_id"], "Int64")})

    return run


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array of double) of vectors that are neither null nor zero, all of finite components."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return v.where(finite & F.exists("embedding", lambda x: x != 0))


def _places(cells: dict[int, Cells], embeddings: pd.Series) -> np.ndarray:
    """Cell of each vector, by length."""
    out = np.zeros(len(embeddings), np.int32)
    sizes = embeddings.map(len).to_numpy()
    for n in np.unique(sizes):
        if n in cells:
            some = np.flatnonzero(sizes == n)
            out[some] = cells[n].of(low(embeddings.iloc[some]))
    return out


def _reached(cells: dict[int, Cells], embedding: np.ndarray, floor: float) -> list[int]:
    n = len(embedding)
    if n not in cells:
        return [0]
    return cells[n].within(low(pd.Series([embedding]))[0], bound(n) * max(2 - 2 * floor, 0))


def lay_cells(distinct: DataFrame, cell_rows: int) -> dict[int, Cells]:
    """Planes for each length, from the projections of about SAMPLE vectors, dealt to lengths by their share; a length without planes is one cell."""
    counts = {r["n"]: r["count"] for r in distinct.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(100).collect()}
    total = sum(counts.values())

    @F.pandas_udf("array<double>")
    def projected(embeddings: pd.Series) -> pd.Series:
        return pd.Series([low(pd.Series([x]))[0] for x in embeddings], dtype=object)

    drawn = F.pmod(F.xxhash64("embedding"), F.lit(1 << 32)) / (1 << 32)
    wide = [n for n, count in counts.items() if count > cell_rows]
    if not wide:
        return {}
    rows = distinct.where(F.size("embedding").isin(wide)).where(drawn < SAMPLE / total).select(F.size("embedding").alias("n"), projected("embedding").alias("p")).toPandas()
    found: dict[int, list] = defaultdict(list)
    for n, p in zip(rows["n"], rows["p"], strict=True):
        found[n].append(p)
    return {n: Cells(np.stack(p), min(MAX_DEPTH, math.ceil(math.log2(counts[n] / cell_rows)), max(0, int(math.log2(len(p) / 4))))) for n, p in found.items() if len(p) >= 4}


def neighbours(vectors: DataFrame, k: int = K, every: int = EVERY, cell_rows: int = CELL_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score, verified: for each vec_id divisible by ``every`` the k vectors of largest cosine found,
    and how many (distinct) vectors were verified for it.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without
    vec_id. Rows that repeat a vec_id with one vector count once; with different vectors each is a
    candidate and the smallest is the query. Ties go to the smaller vec_id; with fewer than k candidates
    all are given. A query's candidates are vectors of its length. Empty: no rows."""
    spark = vectors.sparkSession
    good = valid_vectors(vectors)
    order = Window.partitionBy("embedding").orderBy("vec_id")
    firsts = good.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    distinct = materialise(firsts.groupBy("embedding").agg(F.collect_list("vec_id").alias("ids")), "vectors")
    cells = spark.sparkContext.broadcast(lay_cells(distinct, cell_rows))

    @F.pandas_udf("int")
    def cell(embeddings: pd.Series) -> pd.Series:
        return pd.Series(_places(cells.value, embeddings))

    @F.pandas_udf("array<int>")
    def reach(embeddings: pd.Series, floors: pd.Series) -> pd.Series:
        return pd.Series([_reached(cells.value, e, f) for e, f in zip(embeddings, floors, strict=True)], dtype=object)

    size, place = F.size("embedding").alias("length"), cell("embedding").alias("cell")
    parts = lambda n, of: F.ceil(F.col(n) / of).cast("int")
    part = lambda n: F.pmod(F.xxhash64("embedding"), F.col(n)).cast("int")
    placed = materialise(distinct.select("embedding", "ids", size, place), "placed")
    # One row for each cell and each part: as many as CELL_ROWS goes into the vectors.
    split = placed.groupBy("length", "cell").agg(F.count("*").alias("rows")).select("length", "cell", parts("rows", cell_rows).alias("parts"))
    points = placed.join(split, ["length", "cell"]).withColumn("part", part("parts"))
    queries = good.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).select(F.col("vec_id").alias("query_id"), "embedding", size, place)
    queries = materialise(queries.join(split, ["length", "cell"]).withColumn("part", part("parts")), "queries")

    def met(asked: DataFrame) -> DataFrame:
        """Queries, dealt to parts of cells, with what they find there; both sides are cut to groups that a task can hold."""
        key = ["length", "cell", "part"]
        crowd = asked.groupBy(*key).agg(F.count("*").alias("asked")).select(*key, parts("asked", QUERY_ROWS).alias("rounds"))
        left = asked.join(crowd, key).withColumn("round", F.pmod(F.xxhash64("query_id"), F.col("rounds")).cast("int"))
        right = points.join(crowd, key).withColumn("round", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)))
        left = left.select(*[F.col(c).alias(f"q_{c}") for c in key], F.col("round").alias("q_round"), "query_id", "embedding", "floor")
        right = right.select(*key, "round", "embedding", "ids")
        return left.groupBy("q_length", "q_cell", "q_part", "q_round").cogroup(right.groupBy(*key, "round")).applyInPandas(_search(k), "query_id bigint, vec_id bigint, score double, verified bigint")

    first = materialise(met(queries.withColumn("floor", F.lit(-2.0))), "home")
    floors = first.groupBy("query_id").agg(F.count("vec_id").alias("n"), F.min("score").alias("low"))
    floor = F.when(F.coalesce(F.col("n"), F.lit(0)) < k, -2.0).otherwise(F.col("low"))
    abroad = queries.withColumnsRenamed({"cell": "home", "part": "home_part"}).drop("parts").join(floors, "query_id", "left").withColumn("floor", floor)
    abroad = abroad.withColumn("cell", F.explode(reach("embedding", "floor"))).join(split, ["length", "cell"])
    abroad = abroad.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("cell != home or part != home_part")
    second = met(abroad.select("query_id", "embedding", "floor", "length", "cell", "part"))
    found = first.union(second)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    each = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.sum("verified").alias("verified"))
    ranked = each.withColumn("verified", F.sum("verified").over(Window.partitionBy("query_id"))).where("vec_id is not null").withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "verified")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(pages_of(spark, sf_dir, "embeddings"))
