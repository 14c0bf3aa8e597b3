"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text and their beginnings, hashed. A bounded sample of labelled rows gives the terms
that tell the classes apart best and then fits a weight and a vector for each, so that pairs of terms weigh
more, or less, together than alone. Scoring reads every whole text once and needs the fitted model only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructType

from rainloom.llm.common import query, slices, table, text_or_empty
from rainloom.session import cut_lineage

SPACE, SELECTED, FACTORS = 1 << 18, 1024, 8
#: Labelled rows that selection and fitting read at most, the first by a hash of the id.
MAX_ROWS = 20_000
EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
PREFIXES = (3, 4, 5, 6, 7, 8)


def terms(word: str) -> set[int]:
    """Hashed terms of a lower-case word: itself and its beginnings."""
    w = word.strip(EDGE)
    if not w:
        return set()
    return {xxhash.xxh3_64_intdigest(t) % SPACE for t in ("=" + w, *(w[:n] for n in PREFIXES if len(w) >= n))}


class TermCounter:
    """Distinct terms of texts; `keep` narrows them to selected ones. Holds at most `most` words."""

    most = 1 << 18

    def __init__(self, keep: np.ndarray | None = None):
        self.keep = None if keep is None else {int(t): k for k, t in enumerate(keep)}
        self.known: dict[str, tuple] = {}

    def of(self, text: str) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
        words, known = set(text.lower().split()), self.known
        for w in words.difference(known):
            got = terms(w)
            known[w] = tuple(got) if self.keep is None else tuple(self.keep[t] for t in got if t in self.keep)
        return np.asarray(sorted({t for w in words for t in known[w]}), np.int64)


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """name, text and label of at most max_rows rows. Contradicting labels count as toxic; null ids and labels are left out.

    Only ids and labels are sorted; their number is bounded, so they are broadcast. Rows that repeat an id and a text
    count once, and the first max_rows by `name`, a hash of both, are taken: an id may have any number of rows.
    Within a task repeats go before the shuffle, so one id with a third of all rows sends one row a task.
    """
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    some = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(some), "doc_id").select("doc_id", "text", "label", F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), "text"), 256).alias("name"))
    kept = rows.select("name").distinct().orderBy("name").limit(max_rows)
    return rows.join(F.broadcast(kept), "name", "left_semi").groupBy("name").agg(F.any_value("text").alias("text"), F.any_value("label").alias("label"))


def select_terms(sample: DataFrame, selected: int, min_rows: int = 5) -> list[int]:
    """The terms with the largest likelihood-ratio statistic of term against label. Counts leave a task once, at most SPACE rows."""
    def count(batches):
        held, pos, neg, rows = TermCounter(), np.zeros(SPACE, np.int64), np.zeros(SPACE, np.int64), [0, 0]
        for b in slices(batches):
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
                (pos if label else neg)[held.of(text)] += 1
                rows[bool(label)] += 1
        at = np.flatnonzero(pos + neg)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(pos[at], rows[1])), pa.array(np.append(neg[at], rows[0]))], ["term", "pos", "neg"])

    c = sample.mapInArrow(count, "term long, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("a"), F.sum("neg").alias("b"))
    whole = c.where("term = -1").first()
    if whole is None or not whole["a"] or not whole["b"]:
        return []
    p, n = F.lit(float(whole["a"])), F.lit(float(whole["b"]))
    a, b = F.col("a") + 0.0, F.col("b") + 0.0

    def part(seen, share, total):
        return F.when(seen > 0, seen * F.log(seen / (share * total))).otherwise(0.0)

    g = part(a, p / (p + n), a + b) + part(b, n / (p + n), a + b) + part(p - a, p / (p + n), p + n - a - b) + part(n - b, n / (p + n), p + n - a - b)
    return [r["term"] for r in c.where("term >= 0").where(a + b >= min_rows).orderBy(F.desc(F.round(g, 6)), "term").limit(selected).collect()]


def term_rows(sample: DataFrame, keep: np.ndarray) -> DataFrame:
    def run(batches):
        held = TermCounter(keep)
        for b in slices(batches):
            got = [held.of(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("name"), b.column("label"), pa.array([x.tolist() for x in got], pa.list_(pa.int32()))], ["name", "label", "terms"])

    return sample.mapInArrow(run, "name string, label int, terms array<int>")


def fit(x: np.ndarray, y: np.ndarray, factors: int = FACTORS, epochs: int = 40, batch: int = 256, rate: float = 0.02, ridge: float = 1e-4, seed: int = 7) -> dict:
    """Logistic factorization machine on 0/1 rows by Adam; the labels' own frequency starts the bias."""
    rng = np.random.default_rng(seed)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    p = {"bias": np.log(share / (1 - share)) * np.ones(1), "w": np.zeros(x.shape[1]), "v": rng.normal(0, 0.01, (x.shape[1], factors))}
    m, s = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), batch):
            at = order[k:k + batch]
            xb = x[at].astype(np.float64)
            sums = xb @ p["v"]
            z = p["bias"] + xb @ p["w"] + 0.5 * ((sums ** 2).sum(1) - xb @ (p["v"] ** 2).sum(1))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[at]) / len(at)
            xg = xb.T @ g
            grad = {"bias": g.sum(keepdims=True), "w": xg + ridge * p["w"], "v": xb.T @ (g[:, None] * sums) - p["v"] * xg[:, None] + ridge * p["v"]}
            step += 1
            for name, d in grad.items():
                m[name] = 0.9 * m[name] + 0.1 * d
                s[name] = 0.999 * s[name] + 0.001 * d * d
                p[name] = p[name] - rate * (m[name] / (1 - 0.9 ** step)) / (np.sqrt(s[name] / (1 - 0.999 ** step)) + 1e-8)
    return p


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, selected: int = SELECTED) -> dict:
    """Model from at most max_rows labelled rows: the selected terms, weights and vectors.

    Rows are fitted in the order of their names, so the file layout does not matter. Without rows of both classes the model is a constant: the share of toxic labels, 0 if there are none.
    """
    sample = cut_lineage(labelled(docs, labels, max_rows))
    keep = np.asarray(select_terms(sample, selected), np.int64)
    rows = sorted(term_rows(sample, keep).collect(), key=lambda r: r["name"])
    y = np.asarray([r["label"] for r in rows], np.float64)
    if not len(keep):
        return {"keep": keep, "bias": np.full(1, 30.0 if len(y) and y.mean() >= 0.5 else -30.0), "w": np.zeros(0), "v": np.zeros((0, FACTORS))}
    x = np.zeros((len(rows), len(keep)), np.uint8)
    for k, r in enumerate(rows):
        x[k, r["terms"]] = 1
    return {"keep": keep} | fit(x, y)


def score(docs: DataFrame, model: dict, name: str = "toxicity") -> DataFrame:
    """Documents with a column of that name in 0..1, which replaces one they had; a null or empty text scores by the bias alone."""
    keep, bias, w, v = model["keep"], float(model["bias"][0]), model["w"], model["v"]
    square = (v ** 2).sum(1)

    def run(batches):
        held = TermCounter(keep)
        for b in slices(batches):
            out = np.zeros(b.num_rows)
            for k, text in enumerate(b.column("text").to_pylist()):
                t = held.of(text or "")
                sums = v[t].sum(0)
                out[k] = bias + w[t].sum() + 0.5 * ((sums ** 2).sum() - square[t].sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30))))], [*b.schema.names, name])

    docs = docs.drop(name)
    return docs.mapInArrow(run, StructType(list(docs.schema)).add(name, DoubleType()))


def held_out():
    """Rows that no label may be learned from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


@query("op8_factorization_machine")
def factorization_machine(spark, sf):
    """Every document scored by a model that never saw the labels of the held-out fifth."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf, "labels").where(~held_out()))
    return score(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
