"""Exact top-k inner products through a pivot-distance index.

One coordinate more makes all vectors equally long, so the largest inner product is the smallest distance. Each
vector is keyed by its nearest pivot and by its distance to it, in rings. A query opens its nearest rings first;
its k-th best score so far bounds the distance that can still matter, and by the triangle inequality a ring
whose distances to its pivot are too far from the query's own is never opened.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rainloom.llm.common import query, table
from rainloom.llm.search import compare, cells_of, counts, finite, matrix, ranked
from rainloom.session import cut_lineage

PIVOTS, RINGS, SAMPLE = 16, 4, 2048


def far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """Pivots from a sample, each the farthest from those before; fewer where the sample has fewer distinct vectors."""
    chosen = [0]
    dist = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < n and dist.max() > 0:
        chosen.append(int(dist.argmax()))
        dist = np.minimum(dist, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def lengthened(x: np.ndarray, square: float) -> np.ndarray:
    """One coordinate more, which gives every vector the squared norm `square`."""
    return np.column_stack([x, np.sqrt(np.maximum(square - (x ** 2).sum(1), 0))])


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score for the k largest inner products of each query with every other id.

    vectors, queries: id, v (array<double>, finite). Rows that repeat an id and vector count once; an id with
    several vectors keeps each. Fewer than k others give fewer rows, an empty side none. Pivots come from SAMPLE rows.
    """
    about = vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)).alias("square"), F.max(F.size("v")).alias("width")).first()
    if about["width"] is None:
        return ranked(empty(vectors), k)
    square, width = float(about["square"]), max(1, about["width"])
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column("v")
    pivots = far_apart(lengthened(matrix(sample, width), square), PIVOTS)
    # A ring's width follows the largest possible distance, twice the common norm.
    step = max(2 * square ** 0.5 / RINGS / 2, 1e-12)

    def key(batches):
        for b in batches:
            if b.num_rows:
                x = lengthened(matrix(b.column("v"), width), square)
                d = np.sqrt(np.maximum((x ** 2).sum(1)[:, None] + (pivots ** 2).sum(1) - 2 * x @ pivots.T, 0))
                near = d.argmin(1)
                dist = d[np.arange(len(x)), near]
                ring = np.minimum((dist / step).astype(np.int64), 2 * RINGS - 1)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array((near * 2 * RINGS + ring).astype(np.int32)), pa.array(dist)], ["id", "v", "place", "dist"])

    index = cut_lineage(vectors.distinct().mapInArrow(key, "id long, v array<double>, place int, dist double"))
    rings = sorted((r["place"], r["n"], r["low"], r["high"]) for r in index.groupBy("place").agg(F.count("*").alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high")).collect())
    place, size, low, high = (np.asarray(c) for c in zip(*rings))
    held = {int(p): int(n) for p, n in zip(place, size)}
    nearest = 4 * k

    def annuli(opened: bool):
        """Places that a query opens: first those that hold enough near vectors, later every other one within the bound."""
        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                x = matrix(b.column("v"), width)
                norm = (x ** 2).sum(1)
                d = np.sqrt(np.maximum(norm[:, None] + square - 2 * np.column_stack([x, np.zeros(len(x))]) @ pivots.T, 0))
                dp = d[:, place // (2 * RINGS)]
                bound = np.maximum(np.maximum(dp - high, low - dp), (dp - d.min(1)[:, None]) / 2)
                order = np.argsort(bound, axis=1, kind="stable")
                before = np.cumsum(size[order], axis=1) - size[order]
                first = np.zeros(bound.shape, bool)
                np.put_along_axis(first, order, before < nearest, axis=1)
                if opened:
                    least = b.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
                    reach = np.sqrt(np.maximum(norm + square - 2 * least, 0)) * (1 + 1e-9) + 1e-6
                    take = ~first & (np.maximum(bound, 0) <= reach[:, None])
                else:
                    least, take = np.full(len(x), -np.inf), first
                r, c = np.nonzero(take)
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(r)), b.column("v").take(pa.array(r)), pa.array(place[c].astype(np.int32)), pa.array(least[r])], ["id", "v", "place", "least"])

        return run

    def search(q: DataFrame, opened: bool) -> DataFrame:
        visits = cut_lineage(q.mapInArrow(annuli(opened), "id long, v array<double>, place int, least double"))
        return compare(cells_of(index.select("place", "id", "v"), visits, held, counts(visits)), k, width)

    queries = queries.distinct()
    first = cut_lineage(search(queries, False))
    kth = ranked(first, k).groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    rest = search(queries.join(kth, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))), True)
    return ranked(first.unionByName(rest), k)


def empty(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.lit(False)).select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))


SQL = """with e as (select distinct vec_id, list_transform(embedding, lambda c: floor(256 * c::double)) as v from embeddings
 where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or isnan(c) or isinf(c))) = 0),
s as (select distinct q.vec_id as query_id, m.vec_id, list_sum(list_transform(list_zip(q.v, m.v), lambda z: z[1] * z[2]))::bigint as score from e q join e m on m.vec_id <> q.vec_id where q.vec_id % 50 = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select * from r where rank <= 5"""


@query("op4_pivot_distance", SQL)
def pivot_distance(spark, sf, k: int = 5):
    """The five largest integer inner products for every vec_id divisible by 50, against every other row."""
    e = table(spark, sf, "embeddings").where(finite() & F.col("vec_id").isNotNull())
    e = e.select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda c: F.floor(F.lit(256) * c.cast("double")).cast("double")).alias("v"))
    return top_k(e, e.where(F.col("id") % 50 == 0), k).withColumn("score", F.col("score").cast("long"))
