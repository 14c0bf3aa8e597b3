"""Packing of token documents by cutting-stock column generation.

Documents longer than a sequence are cut into full pieces and a rest. Piece lengths are counted in classes of
UNIT tokens; a linear program over patterns of classes is solved by column generation, whose pricing is a
knapsack dynamic program, and rounded down; the few pieces left over are placed first-fit decreasing, still as
counts. Only counts of at most capacity / UNIT classes reach the driver. Pieces are then ranked inside their
class, and the rank alone says in which use of which pattern a piece lies.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from rainloom.llm.bpe import WordCoder, coder
from rainloom.llm.common import map_batches, parts, query, split_repeats, table, text_or_empty
from rainloom.session import cut_lineage

CAPACITY, UNIT, END = 4096, 16, 2
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of at most capacity tokens; each document's ids are followed by the end id, so an empty one has a piece too."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        docs, start, length, crc, total = [], [], [], [], []
        for d, ids in zip(b.column("doc_id").to_pylist(), coder(WordCoder, tokenizer).ids(b.column("text").to_pylist())):
            ids = np.append(ids, end).astype("<u4")
            for k in range(0, len(ids), capacity):
                piece = ids[k:k + capacity]
                docs.append(d)
                start.append(k)
                length.append(len(piece))
                crc.append(zlib.crc32(piece.tobytes()))
                total.append(len(ids))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (docs, start, length, crc, total)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), run, PIECES)


def best_pattern(value: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of most value in room."""
    best, take = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        n = np.searchsorted(sizes, c, side="right")
        got = best[c - sizes[:n]] + value[:n]
        best[c], take[c] = best[c - 1], -1
        if n and got.max() > best[c]:
            take[c] = got.argmax()
            best[c] = got[take[c]]
    pattern, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if take[c] >= 0:
            pattern[take[c]] += 1
            c -= sizes[take[c]]
        else:
            c -= 1
    return best[room], pattern


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 1e-3, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Fractional uses of patterns (one in each row) that meet the demand with nearly the fewest sequences.

    Revised simplex on the basis of as many patterns as sizes; stops when the knapsack bound proves the
    number within `gap` of the least.
    """
    m = len(sizes)
    patterns = np.diag(room // sizes).astype(float)
    inverse, use = np.diag(1 / np.diag(patterns)), demand / np.diag(patterns)
    for _ in range(rounds):
        price = inverse.sum(axis=0)
        value, new = best_pattern(price, sizes, room)
        if value <= 1 + gap:
            break
        column = inverse @ new
        up = column > 1e-9
        ratio = np.full(m, np.inf)
        ratio[up] = np.maximum(use[up], 0) / column[up]
        out = int(ratio.argmin())
        step = ratio[out]
        use -= step * column
        use[out] = step
        patterns[out] = new
        row = inverse[out] / column[out]
        inverse -= np.outer(column, row)
        inverse[out] = row
    return patterns.astype(np.int64), np.maximum(use, 0)


def first_fit(sizes: np.ndarray, left: np.ndarray, room: int) -> list[np.ndarray]:
    """Patterns of one use each for the counts left over, largest size first: each takes what still fits."""
    out, left = [], left.copy()
    while left.any():
        pattern, free = np.zeros(len(sizes), np.int64), room
        for k in range(len(sizes) - 1, -1, -1):
            n = min(left[k], free // sizes[k])
            pattern[k] = n
            free -= n * sizes[k]
        left -= pattern
        out.append(pattern)
    return out


def plan_patterns(counts: dict[int, int], room: int) -> list[tuple[np.ndarray, int, np.ndarray]]:
    """Patterns with whole uses that hold every piece just once: [(size classes, uses, number of each)]."""
    sizes = np.asarray(sorted(counts), np.int64)
    demand = np.asarray([counts[s] for s in sizes.tolist()], np.int64)
    if not len(sizes):
        return []
    patterns, use = solve_patterns(sizes, demand.astype(float), room)
    plan, left = [], demand.copy()
    for pattern, x in sorted(zip(patterns.tolist(), np.floor(use + 1e-6).astype(np.int64).tolist()), reverse=True):
        pattern = np.asarray(pattern)
        some = pattern > 0
        n = min(x, int((left[some] // pattern[some]).min()))
        if n > 0:
            plan.append((sizes, n, pattern))
            left -= n * pattern
    return plan + [(sizes, 1, p) for p in first_fit(sizes, left, room)]


def assign(ranked: DataFrame, plan: list) -> DataFrame:
    """sequence_id and place of each piece from its class and its rank there."""
    by_class: dict[int, list] = {}
    base = 0
    for sizes, n, pattern in plan:
        for k in np.flatnonzero(pattern).tolist():
            held = by_class.setdefault(int(sizes[k]), [])
            held.append((held[-1][0] + held[-1][1] * held[-1][3] if held else 0, n, base, int(pattern[k])))
        base += n
    table_ = {s: np.asarray(v, np.int64).T for s, v in by_class.items()}

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        kind, rank = np.asarray(b.column("class")), np.asarray(b.column("rank"))
        seq, slot = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
        for s in np.unique(kind):
            at = np.flatnonzero(kind == s)
            first, _, begin, per = table_[int(s)]
            j = np.searchsorted(first, rank[at], side="right") - 1
            seq[at] = begin[j] + (rank[at] - first[j]) // per[j]
            slot[at] = (rank[at] - first[j]) % per[j]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(seq), pa.array(slot)], [*b.schema.names, "sequence_id", "place"])

    return map_batches(ranked, run, PIECES + ", class int, rank long, sequence_id long, place long", by=None)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """Pieces of all documents with sequence_id and offset; sequences hold at most capacity tokens.

    A null text is an empty document of one end id. Repeated rows and null ids are pieces like others. Ranks in
    a class are made of salted groups, as many as the session has shuffle partitions, so a length that a third
    of all pieces share is spread; rows repeated wholly are counted and salted in parts. No sequence has more than capacity / unit pieces.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    p = (pieces_of(docs, path, capacity).withColumn("class", F.ceil(F.col("length") / unit).cast("int")))
    p = cut_lineage(split_repeats(p).withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "part"), F.lit(max(16, parts(docs.sparkSession))))))
    held = p.groupBy("class", "_salt").agg(F.count("*").alias("_n"))
    counts = {r["class"]: r["n"] for r in held.groupBy("class").agg(F.sum("_n").alias("n")).collect()}
    before = W.partitionBy("class").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    starts = held.select("class", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = F.row_number().over(W.partitionBy("class", "_salt").orderBy("doc_id", "start", "ids_crc32"))
    ranked = p.withColumn("_r", within).join(starts, ["class", "_salt"]).withColumn("rank", F.col("_first") + F.col("_r") - 1)
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "rank")
    placed = assign(ranked, plan_patterns(counts, capacity // unit))
    run = W.partitionBy("sequence_id").orderBy(F.desc("class"), "place").rowsBetween(W.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(run), F.lit(0)).alias("offset"))


@query("op9_cutting_stock")
def cutting_stock(spark, sf):
    """All documents in sequences of 4096 tokens."""
    return pack(table(spark, sf, "documents"))
