"""Ranked lexical search: hashed max-sketches give upper bounds, exact scores are computed in descending order of the bounds.

A document's term frequencies become saturated impacts. Its sketch has WIDTH coordinates; each term falls on one of
them by hash, and a coordinate keeps the largest impact that fell on it. So the weighted sum of the coordinates of a
query's terms is never below the query's exact score. A task bounds a block of documents for a batch of queries by one
product of the sketches with the queries' weights, then scores documents exactly, largest bound first, until the bound
falls below the k-th best score that the query has in this task. What is left is ranked by a window.

Corpus statistics (documents with terms, terms, documents of each query term) cover every document. Texts are never
shuffled: a task sends at most k rows of each query, and counts once.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window as W, functions as F

from rainloom.llm.common import query, slices, table, text_or_empty
from rainloom.session import cut_lineage

#: Coordinates of a sketch; documents bounded at once; queries, and bytes of their texts, of a batch.
WIDTH, BLOCK, BATCH, BATCH_BYTES = 4096, 512, 256, 1 << 22
#: Groups in which the rows of a query are thinned before they meet.
GROUPS = 64
#: ASCII letters in lower case and digits stay, other ASCII becomes a space, bytes of longer characters stay.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of any other characters beyond ASCII; only A-Z are lower-cased."""
    return text.encode().translate(TERM_BYTES).split()


def impact(tf, m):
    """Saturated term frequency: 64-bit integers, rounded down."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def length_factor(n, docs: int, total: int):
    return 75 + (25 * n * docs) // total


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def corpus_counts(docs: DataFrame, vocabulary: set[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """Documents with terms, their terms, and documents of each term of a vocabulary, over all documents.

    A task sends one row for each vocabulary term it met, and two more.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows, total = Counter(), 0, 0
        for b in slices(batches):
            for text in b.column("text").to_pylist():
                t = terms(text)
                if t:
                    rows, total = rows + 1, total + len(t)
                    df.update(vocabulary.intersection(t))
        yield pa.RecordBatch.from_arrays([pa.array([None, b"", *df], pa.binary()), pa.array([rows, total, *df.values()], pa.int64())], ["term", "n"])

    got = docs.select(text_or_empty().alias("text")).mapInArrow(count, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    n = {None if r["term"] is None else bytes(r["term"]): r["n"] for r in got}
    return n.pop(None, 0), n.pop(b"", 0), n


class Batch:
    """Queries of one batch: terms with multiplicities and weights, and the weights by sketch coordinate."""

    def __init__(self, queries: list[Counter], docs: int, total: int, df: dict[bytes, int], width: int = WIDTH):
        self.docs, self.total, self.width = docs, total, width
        self.weighted = [{t: k * weight(docs, df[t]) for t, k in q.items() if t in df} for q in queries]
        used = sorted({zlib.crc32(t) % width for q in self.weighted for t in q})
        place = {c: k for k, c in enumerate(used)}
        self.used, self.by_coordinate = np.asarray(used, np.int64), np.zeros((len(used), len(queries)))
        for k, q in enumerate(self.weighted):
            for t, w in q.items():
                self.by_coordinate[place[zlib.crc32(t) % width], k] += w

    def sketches(self, counts: list[Counter], m: np.ndarray) -> np.ndarray:
        """One row a document: the largest impact on each coordinate, over all of its terms."""
        out = np.zeros(len(counts) * self.width, np.int64)
        size = [len(c) for c in counts]
        row = np.repeat(np.arange(len(counts)), size)
        at = np.fromiter((zlib.crc32(t) for c in counts for t in c), np.int64, sum(size)) % self.width + row * self.width
        tf = np.fromiter((n for c in counts for n in c.values()), np.int64, sum(size))
        np.maximum.at(out, at, impact(tf, m[row]))
        return out.reshape(len(counts), self.width)

    def bounds(self, sketches: np.ndarray) -> np.ndarray:
        """Documents by queries: never below the exact score. All sums are integers below 2**53, so doubles hold them exactly."""
        return sketches[:, self.used].astype(np.float64) @ self.by_coordinate

    def score(self, k: int, counts: Counter, m: int) -> int:
        return sum(w * impact(counts[t], m) for t, w in self.weighted[k].items() if t in counts)


class Best:
    """The k best (score, id) of each query so far; a missing id ranks last among equal scores."""

    def __init__(self, queries: int, k: int):
        self.k, self.rows = k, [[] for _ in range(queries)]
        self.least = np.ones(queries)

    def offer(self, q: int, score: int, doc) -> None:
        rows = self.rows[q]
        rows.append((-score, doc is None, doc or 0))
        if len(rows) >= 2 * self.k:
            self.trim(q)

    def trim(self, q: int) -> None:
        rows = self.rows[q]
        rows.sort()
        del rows[self.k:]
        if len(rows) == self.k:
            self.least[q] = -rows[-1][0]


def search_block(batch: Batch, best: Best, ids: list, texts: list[str]) -> int:
    """Bound all documents of a block, then score by descending bound until it falls below the query's threshold; returns exact scores computed."""
    counts = [Counter(terms(t)) for t in texts]
    some = [k for k, c in enumerate(counts) if c]
    if not some or not len(batch.used):
        return 0
    counts, ids, done = [counts[k] for k in some], [ids[k] for k in some], 0
    m = length_factor(np.asarray([c.total() for c in counts], np.int64), batch.docs, batch.total)
    bound = batch.bounds(batch.sketches(counts, m))
    for q in np.flatnonzero((bound >= best.least).any(0)):
        at = np.flatnonzero(bound[:, q] >= best.least[q])
        for d in at[np.argsort(-bound[at, q], kind="stable")]:
            if bound[d, q] < best.least[q]:
                break
            done += 1
            s = batch.score(q, counts[d], int(m[d]))
            if s >= best.least[q]:
                best.offer(q, s, ids[d])
        best.trim(q)
    return done


def batches_of(items: DataFrame, most: int, most_bytes: int) -> Iterator[list[Row]]:
    """Distinct items in batches, one by one through the driver: it holds one batch at a time."""
    held, size = [], 0
    rows = items.select("item_id", F.col("text").alias("text")).where("text is not null").distinct().orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        if held and (len(held) == most or size + len(r["text"]) > most_bytes):
            yield held
            held, size = [], 0
        held.append(r)
        size += len(r["text"])
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, k: int = 20, batch: int = BATCH, batch_bytes: int = BATCH_BYTES, width: int = WIDTH) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 for each item (all, if fewer), ties to the smaller doc_id.

    A null text has no terms: such documents count nowhere and such items have no rows. Rows of documents are
    independent: a repeated doc_id may rank repeatedly, and a null one ranks last among equal scores. Items repeated
    wholly count once; an id with several texts gets a ranking for each. Empty tables give no rows; other columns are
    not looked at. Items are searched in batches of at most `batch` rows and `batch_bytes` characters, each batch over all documents.
    """
    out, schema = None, "item_id long, item int, doc_id long, score long"
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    for b, rows in enumerate(batches_of(items, batch, batch_bytes)):
        asked = [Counter(terms(r["text"])) for r in rows]
        counts = corpus_counts(docs, set().union(*asked))
        ready, item_ids = Batch(asked, *counts, width), [r["item_id"] for r in rows]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(item_ids), k)
            for piece in slices(batches):
                for at in range(0, piece.num_rows, BLOCK):
                    p = piece.slice(at, BLOCK)
                    search_block(ready, best, p.column("doc_id").to_pylist(), p.column("text").to_pylist())
            found = [(item_ids[q], b * batch + q, None if none else d, -s) for q, some in enumerate(best.rows) for s, none, d in some]
            yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], kind) for j, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["item_id", "item", "doc_id", "score"])

        part = named.mapInArrow(run, schema)
        best_first = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
        for keys in (["item", F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS))], ["item"]):
            part = part.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*best_first))).where(F.col("rank") <= k)
        part = part.select("item_id", "rank", "doc_id", "score")
        out = cut_lineage(part) if out is None else out.unionByName(cut_lineage(part))
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


TERMS_SQL = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = f"""with d as (select row_number() over () as k, doc_id, {TERMS_SQL.format("text")} as t from documents where text is not null),
l as (select k, doc_id, len(t) as n from d where len(t) > 0), s as (select count(*) as docs, sum(n)::bigint as total from l),
i as (select distinct item_id, text from benchmark where text is not null), j as (select row_number() over (order by item_id, text) as item, item_id, {TERMS_SQL.format("text")} as t from i),
q as (select item, item_id, term, count(*) as times from (select item, item_id, unnest(t) as term from j) group by 1, 2, 3),
tf as (select k, term, count(*) as tf from (select k, unnest(t) as term from d) where term in (select term from q) group by 1, 2),
w as (select term, floor(1000 * ln((2 * max(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, s group by 1),
p as (select l.k, l.doc_id, 75 + (25 * n * docs) // total as m from l, s),
r as (select item, item_id, p.k, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score from q join tf using (term) join w using (term) join p on p.k = tf.k group by 1, 2, 3, 4),
o as (select item_id, row_number() over (partition by item order by score desc, doc_id nulls last)::int as rank, doc_id, score from r where score > 0)
select * from o where rank <= 20"""


@query("op11_max_sketches", SQL)
def max_sketches(spark, sf):
    """The 20 best documents of every benchmark item."""
    return search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
