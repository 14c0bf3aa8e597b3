"""Approximate nearest neighbours through a forest of random-projection trees.

Trees are built from a bounded sample; each split lies between two of its vectors. Every row is then led to one
leaf of each tree. A query opens the leaves of all trees in one order, that of the distance to the splits it lies on
the wrong side of, until the opened leaves hold a share of the rows, and the rows of those leaves are scored exactly.

Vectors are not copied to leaves. They travel once, to one of a fixed number of slices, and every slice meets the
queries with their opened leaves: a row takes part for a query if one of its leaves is open. So what is shuffled
follows the rows, whatever share the leaves hold, and a task holds queries while rows stream past.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rainloom.llm.common import parts, query, table
from rainloom.llm.pivots import empty
from rainloom.llm.search import BEST, finite, matrix, ranked

#: Sample rows, trees, sample rows of a leaf, and the share of distinct vectors that the opened leaves hold together.
#: Vectors without structure, as in the test tables, need about this share for a recall of 0.9; clustered ones far less.
SAMPLE, TREES, LEAF, SHARE = 8192, 8, 128, 1.5
#: Slices of the rows, each of which gives k rows a query; queries that a task holds, and rows and queries compared at once.
SLICES, HELD, ROWS, GROUP = 12, 1 << 17, 4096, 256


class Tree:
    """Splits as arrays: direction, threshold, and the two children (a leaf is ~number)."""

    def __init__(self, x: np.ndarray, leaf: int, rng):
        self.direction, self.threshold, self.child, self.leaves = [], [], [], 0
        self.root = self.grow(x, leaf, rng)
        self.direction = np.asarray(self.direction).reshape(-1, x.shape[1])

    def grow(self, x, leaf, rng) -> int:
        if len(x) > leaf:
            for _ in range(3):
                i, j = rng.choice(len(x), 2, replace=False)
                d = x[i] - x[j]
                norm = np.sqrt((d ** 2).sum())
                side = x @ (d / norm) if norm > 0 else np.zeros(len(x))
                cut = np.median(side)
                left = side < cut
                if left.any():
                    k = len(self.direction)
                    self.direction.append(d / norm)
                    self.threshold.append(cut)
                    self.child.append(None)
                    self.child[k] = (self.grow(x[left], leaf, rng), self.grow(x[~left], leaf, rng))
                    return k
        self.leaves += 1
        return ~(self.leaves - 1)

    def route(self, x: np.ndarray) -> np.ndarray:
        out, stack = np.zeros(len(x), np.int64), [(self.root, np.arange(len(x)))]
        while stack:
            k, rows = stack.pop()
            if k < 0:
                out[rows] = ~k
            elif len(rows):
                left = (x[rows] * self.direction[k]).sum(1) < self.threshold[k]
                stack += [(self.child[k][0], rows[left]), (self.child[k][1], rows[~left])]
        return out


def opened(trees: list[Tree], size: np.ndarray, q: np.ndarray, budget: float) -> np.ndarray:
    """Queries by leaves: whether a leaf is open. Leaves of all trees open by their distance until they hold the budget.

    The distance of a leaf is the largest to a split that has the query on the other side; equal ones open by place.
    """
    far, at = np.zeros((len(q), len(size))), 0
    for t in trees:
        side = q @ t.direction.T - np.asarray(t.threshold)
        stack = [(t.root, np.zeros(len(q)))]
        while stack:
            node, d = stack.pop()
            if node < 0:
                far[:, at + ~node] = d
                continue
            m = side[:, node]
            left, right = t.child[node]
            stack += [(left, np.maximum(d, np.where(m < 0, 0, m))), (right, np.maximum(d, np.where(m < 0, -m, 0)))]
        at += t.leaves
    order = np.argsort(far, axis=1, kind="stable")
    before = np.cumsum(size[order], axis=1) - size[order]
    out = np.zeros(far.shape, bool)
    np.put_along_axis(out, order, before < budget, 1)
    return out


class Held:
    """Queries of a task with their opened leaves (packed bits) and the best k rows so far: -inf where there are fewer."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, bits: np.ndarray, k: int):
        self.ids, self.q, self.bits, self.k = ids, q, bits, k
        self.score, self.found = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)

    def meet(self, ids: np.ndarray, x: np.ndarray, places: np.ndarray) -> None:
        """Rows of one slice against all queries. places: rows by trees.

        A product of blocks chooses with some slack, and take() sums again. Rows that repeat an id and a vector count once.
        """
        if len(np.unique(ids)) < len(ids):
            one = list({(i, r.tobytes()): n for n, (i, r) in enumerate(zip(ids.tolist(), x))}.values())
            ids, x, places = ids[one], x[one], places[one]
        for lo in range(0, len(self.ids), GROUP):
            own = slice(lo, min(lo + GROUP, len(self.ids)))
            rough = self.q[own] @ x.T
            slack = 1e-9 * (1 + np.abs(rough).max(initial=0.0))
            hit = rough >= self.score[own, -1:] - slack
            leaf = np.unpackbits(self.bits[own], axis=1).view(bool)
            if hit.sum() > 64 * GROUP:  # little is known yet, or many rows are equal: of these rows the best k go on
                there = leaf[:, places[:, 0]]
                for c in places.T[1:]:
                    there |= leaf[:, c]
                hit &= there & (ids != self.ids[own][:, None])
                rough[~hit] = -np.inf
                if len(ids) > self.k:
                    hit &= rough >= np.partition(rough, len(ids) - self.k, axis=1)[:, [len(ids) - self.k]] - slack
                a, m = np.nonzero(hit)
            else:
                a, m = np.nonzero(hit)
                some = (ids[m] != self.ids[own][a]) & leaf[a[:, None], places[m]].any(axis=1)
                a, m = a[some], m[some]
            if len(a):
                self.take(a + lo, ids[m], np.concatenate([(x[m[n:n + 8 * ROWS]] * self.q[a[n:n + 8 * ROWS] + lo]).sum(axis=1) for n in range(0, len(a), 8 * ROWS)]))

    def take(self, at: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Rows found for the queries at these positions. Scores are sums in one fixed order, so equal vectors have equal ones and ties go to the smaller id."""
        who = np.unique(at)
        at = np.append(np.repeat(who, self.k), at)
        score, ids = np.append(self.score[who].ravel(), score), np.append(self.found[who].ravel(), ids)
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        fresh = np.append(True, (at[1:] != at[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1]))
        at, score, ids = at[fresh], score[fresh], ids[fresh]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        top = rank < self.k
        self.score[who] = -np.inf
        self.score[at[top], rank[top]], self.found[at[top], rank[top]] = score[top], ids[top]

    def rows(self, most: int = 2048):
        for n in range(0, len(self.ids), most):
            score = self.score[n:n + most]
            a, b = np.nonzero(score > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[n + a]), pa.array(self.found[n + a, b]), pa.array(score[a, b])], ["query_id", "vec_id", "score"])


def neighbours(vectors: DataFrame, queries: DataFrame, k: int, trees: int = TREES, share: float = SHARE, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score of the k largest inner products found.

    vectors, queries: id, v (array of floats or doubles, finite). Each row lies in one leaf of each tree, copies of a
    vector in the same ones; the budget counts distinct vectors, so copies do not use it up. Fewer than k found give
    fewer rows, an empty side none. Where a query's own copies come up under other ids they are results like others;
    rows that repeat an id and a vector are one.
    """
    width = vectors.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return ranked(empty(vectors), k)
    width = max(1, width)
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column("v")
    rng = np.random.default_rng(seed)
    x = np.unique(matrix(sample, width), axis=0)
    grown = [Tree(x, LEAF, rng) for _ in range(trees)]
    base = np.cumsum([0] + [t.leaves for t in grown])

    def routed(x):
        return np.stack([at + t.route(x) for at, t in zip(base, grown)], axis=1)

    def place(batches):
        for b in batches:
            if b.num_rows:
                at = routed(matrix(b.column("v"), width))
                yield pa.RecordBatch.from_arrays([pa.array(at.ravel().astype(np.int32)), pa.array(np.repeat(b.column("h").to_numpy(), trees))], ["place", "h"])

    held = vectors.select("v", F.xxhash64("v").alias("h")).mapInArrow(place, "place int, h long").groupBy("place")
    size = np.zeros(int(base[-1]))
    for r in held.agg(F.approx_count_distinct("h").alias("n")).collect():
        size[r["place"]] = r["n"]
    budget = share * size[:base[1]].sum()

    def visit(batches):
        for b in batches:
            for n in range(0, b.num_rows, 1024):
                part = b.slice(n, 1024)
                bits = np.packbits(opened(grown, size, matrix(part.column("v"), width), budget), axis=1)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), pa.array([r.tobytes() for r in bits], pa.binary())], ["id", "v", "bits"])

    def search(batches):
        ids, q, bits, best = [], [], [], None
        for b in batches:
            asks = b.num_rows - sum(b.column("row").to_pylist())
            if asks:
                ids.append(b.column("id").slice(0, asks).to_numpy())
                q.append(matrix(b.column("v").slice(0, asks), width))
                bits.append(np.frombuffer(b"".join(b.column("bits").slice(0, asks).to_pylist()), np.uint8).reshape(asks, -1))
            for n in range(asks, b.num_rows if ids else 0, ROWS):
                best = best or Held(np.concatenate(ids), np.concatenate(q), np.concatenate(bits), k)
                x = matrix(b.column("v").slice(n, ROWS), width)
                best.meet(b.column("id").slice(n, ROWS).to_numpy(), x, routed(x))
        if best:
            yield from best.rows()

    groups = max(1, -(-queries.count() // HELD))
    kind = vectors.schema["v"].dataType.simpleString()
    asked = queries.select("id", "v").repartition(parts(vectors.sparkSession), "id").distinct().mapInArrow(visit, f"id long, v {kind}, bits binary")
    slot, group = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(SLICES)), F.pmod(F.xxhash64("id", F.lit(5)), F.lit(groups))
    rows = vectors.select(slot.alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(True).alias("row"), "id", "v", F.lit(None).cast("binary").alias("bits"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"), group.alias("group"), F.lit(False).alias("row"), "id", "v", "bits")
    dealt = rows.unionByName(asked).repartitionById(SLICES * groups, (F.col("slice") * groups + F.col("group")).cast("int")).sortWithinPartitions("row")
    return ranked(dealt.select("row", "id", "v", "bits").mapInArrow(search, BEST), k)


@query("op10_projection_forest")
def projection_forest(spark, sf, k: int = 20):
    """Twenty nearest by inner product for every vec_id divisible by 20, against every other row; zero vectors take no part."""
    e = table(spark, sf, "embeddings").where(finite() & F.col("vec_id").isNotNull() & F.exists("embedding", lambda c: c != 0))
    e = e.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v"))
    return neighbours(e, e.where(F.col("id") % 20 == 0), k)
