"""Shared steps of the vector searches: clean vectors, cells of queries against members, best-k rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Members and queries of a cell: what one task compares at once.
MEMBERS, GROUP = 2048, 256
BEST = "query_id long, vec_id long, score double"


def finite(v: str = "embedding") -> Column:
    """Vectors that take part: not null, and no null or non-finite component."""
    x = F.col(v)
    return x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles; shorter vectors are filled with zeros, which add nothing to an inner product."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < size[:, None]] = flat
    return out


def best_of(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, q: np.ndarray, least: np.ndarray, k: int) -> tuple[list, list, list]:
    """The k members of largest inner product for each query, its own id left out; only those of at least `least`.

    The product by blocks chooses; what is near the k-th place is summed again row by row in one fixed order, so
    equal vectors have equal scores wherever they lie, and ties go to the smaller id.
    """
    a, b, c = [], [], []
    rough = q @ x.T
    slack = 1e-9 * (1 + np.abs(rough).max(initial=0.0))
    for i in range(len(queries)):
        s = np.where(ids == queries[i], -np.inf, rough[i])
        floor = max(least[i], np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -np.inf) - slack
        at = np.flatnonzero((s >= floor) & (s > -np.inf))
        exact = (x[at] * q[i]).sum(axis=1)
        top = np.lexsort((ids[at], -exact))[:k]
        a += [int(queries[i])] * len(top)
        b += ids[at[top]].tolist()
        c += exact[top].tolist()
    return a, b, c


def compare(cells: DataFrame, k: int, width: int) -> DataFrame:
    """Best k members of each query inside each cell. Rows of cells: cell, id, v, least (null for members)."""
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, x = t.column("id").to_numpy(), matrix(t.column("v"), width)
        least = t.column("least").to_numpy(zero_copy_only=False).astype(np.float64)
        query = ~np.isnan(least)
        order = np.argsort(ids[~query], kind="stable")
        got = best_of(ids[~query][order], x[~query][order], ids[query], x[query], least[query], k) if query.any() and not query.all() else ([], [], [])
        return pa.table([pa.array(got[0], pa.int64()), pa.array(got[1], pa.int64()), pa.array(got[2], pa.float64())], ["query_id", "vec_id", "score"])

    return cells.groupBy("cell").applyInArrow(run, BEST)


def cells_of(members: DataFrame, visits: DataFrame, held: dict[int, int], asked: dict[int, int]) -> DataFrame:
    """Cells of visits (place, id, v, least) with members (place, id, v): places cut by hash into rows of MEMBERS and columns of GROUP.

    held, asked: rows of each place on either side, as many entries as the index has places. A vector that a third
    of all rows hold lies in one place, which is cut into many cells.
    """
    rows = {p: -(-n // MEMBERS) for p, n in held.items()}
    cols = {p: -(-asked.get(p, 0) // GROUP) for p in held}

    def number(of: dict[int, int]) -> Column:
        some = {p: n for p, n in of.items() if n != 1}
        if not some:
            return F.lit(1)
        table = F.create_map(*(F.lit(x) for pair in some.items() for x in pair))
        return F.coalesce(F.element_at(table, F.col("place")), F.lit(1))

    spot = F.xxhash64("id", F.lit(3))
    m = members.withColumn("_c", F.explode(F.when(number(cols) > 0, F.sequence(F.lit(0), number(cols) - 1)))).withColumn("_r", F.pmod(spot, number(rows)))
    v = visits.withColumn("_r", F.explode(F.sequence(F.lit(0), number(rows) - 1))).withColumn("_c", F.pmod(spot, number(cols)))
    cell = F.concat_ws(":", "place", "_r", "_c").alias("cell")
    return m.select(cell, "id", "v", F.lit(None).cast("double").alias("least")).unionByName(v.select(cell, "id", "v", "least"))


def counts(df: DataFrame) -> dict[int, int]:
    """Rows of each place: bounded by the places of the index."""
    return {r["place"]: r["n"] for r in df.groupBy("place").agg(F.count("*").alias("n")).collect()}


def ranked(best: DataFrame, k: int) -> DataFrame:
    """Rank from 1 by score, ties to the smaller id; a row found twice counts once."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.dense_rank().over(w)).where(F.col("rank") <= k).dropDuplicates(["query_id", "rank"]).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
