"""Language identification by unigram pieces, summed over all segmentations.

The vocabulary is that of a public piece model and never changes. Each language has a probability for every piece. A
forward pass gives the probability of a word under a language as the sum over all ways to cut the word into pieces; a
text is the product of its words. Probabilities start equal for all pieces and languages and become expected piece
counts (forward and backward passes, all segmentations weighted) over a bounded number of labelled texts of each
language in a fixed number of rounds, each one aggregation: a task sends at most one row for each piece of a language.
The shares of the languages count all labelled rows.

Words run between white space and begin with the vocabulary's word mark, so no piece crosses them and each distinct
word is computed once while a task's cache holds it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from rainloom.llm.bpe import coder
from rainloom.llm.common import query, slices, table, text_or_empty
from rainloom.llm.toxicity import held_out
from rainloom.session import cut_lineage

#: Rounds of expected counts; what each piece has in every language beside its count; steps of a unit count; languages at most (more stop the job).
ROUNDS, SMOOTHING, UNIT, LANGUAGES = 2, 0.05, 1 << 12, 256
#: Distinct texts of a language that the fit reads at most, the first by a hash of the text.
MAX_TEXTS = 5000
#: Characters of the words in one matrix, over the number of languages; words that a cache holds, likewise.
CHARS, CACHED = 1 << 20, 1 << 21
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


class Vocabulary:
    """Pieces of a public model by a 64-bit hash of their characters; a character without a piece is spelled in byte pieces."""

    base = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        ids = range(sp.get_piece_size())
        pieces = {sp.id_to_piece(k): k for k in ids if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k))}
        self.size, self.longest = len(ids), max(map(len, pieces))
        self.bytes = np.zeros(256, np.int64)
        for k in filter(sp.is_byte, ids):
            self.bytes[int(sp.id_to_piece(k)[1:-1], 16)] = k
        self.used = np.asarray(sorted([*pieces.values(), *self.bytes]), np.int64)
        names = [np.uint64(self.name(p)) for p in pieces]
        order = np.argsort(names)
        self.names, self.ids = np.asarray(names, np.uint64)[order], np.asarray(list(pieces.values()), np.int64)[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.names >> np.uint64(44)] = True

    def name(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(self.base) + ord(c) + 1) % (1 << 64)
        return h

    def matches(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each length k from 1: piece ids (-1: none) of the k characters from each position on; codes: words of equal length by rows."""
        h, out = np.zeros_like(codes), []
        for k in range(min(self.longest, codes.shape[1])):
            h = h[:, :codes.shape[1] - k] * self.base + codes[:, k:] + np.uint64(1)
            ids = np.full(h.shape, -1, np.int32)
            some = np.nonzero(self.seen[h >> np.uint64(44)])
            asked = h[some]
            at = np.minimum(np.searchsorted(self.names, asked), len(self.names) - 1)
            ids[some] = np.where(self.names[at] == asked, self.ids[at], -1)
            out.append(ids)
        return out

    def spelled(self, code: int) -> np.ndarray:
        return self.bytes[list(chr(code).encode())]


class Forward:
    """Sums over the segmentations of words of one length, each behind the word mark, under each language; logp: pieces by languages."""

    def __init__(self, words: list[str], vocabulary: Vocabulary, logp: np.ndarray):
        self.v, self.logp, n = vocabulary, logp, len(words[0]) + 1
        self.codes = np.full((len(words), n), ord("▁"), np.uint64)
        self.codes[:, 1:] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), n - 1)
        self.found = vocabulary.matches(self.codes)
        self.new = {int(c): vocabulary.spelled(int(c)) for c in np.unique(self.codes[self.found[0] < 0])}
        self.spelling = {c: logp[s].sum(0) for c, s in self.new.items()}
        self.alpha = np.full((n + 1, len(words), logp.shape[1]), -np.inf)
        self.alpha[0] = 0.0
        for end in range(1, n + 1):
            for start, rows, p, _ in self.steps_to(end):
                self.alpha[end, rows] = np.logaddexp(self.alpha[end, rows], self.alpha[start, rows] + p)

    def steps_to(self, end: int):
        """Starts of pieces that end there, the words that have them, log probabilities and ids (None: spelled in bytes)."""
        for k in range(1, min(self.v.longest, end) + 1):
            ids = self.found[k - 1][:, end - k]
            rows = np.flatnonzero(ids >= 0)
            if len(rows):
                yield end - k, rows, self.logp[ids[rows]], ids[rows]
        rows = np.flatnonzero(self.found[0][:, end - 1] < 0)
        if len(rows):
            yield end - 1, rows, np.asarray([self.spelling[int(c)] for c in self.codes[rows, end - 1]]), None

    def total(self) -> np.ndarray:
        return self.alpha[-1]

    def expected(self, times: np.ndarray) -> np.ndarray:
        """Pieces by languages: expected counts in steps of 1 / UNIT, for words that occur `times` (words by languages). Sums of integers have one value in every order."""
        n, out = self.codes.shape[1], np.zeros(self.logp.shape, np.int64)
        beta = np.full(self.alpha.shape, -np.inf)
        beta[n] = -self.alpha[n]
        for end in range(n, 0, -1):
            for start, rows, p, ids in self.steps_to(end):
                through = beta[end, rows] + p
                share = np.rint(np.exp(np.minimum(self.alpha[start, rows] + through, 0.0)) * UNIT).astype(np.int64) * times[rows]
                if ids is None:
                    for c, s in zip(self.codes[rows, end - 1], share):
                        np.add.at(out, self.new[int(c)], s)
                else:
                    np.add.at(out, ids, share)
                beta[start, rows] = np.logaddexp(beta[start, rows], through)
        return out


def in_matrices(words: Iterable[str], languages: int) -> Iterator[list[str]]:
    """Words by length, a bounded number of characters or one word at a time."""
    by: dict[int, list] = {}
    for w in words:
        by.setdefault(len(w), []).append(w)
    for n in sorted(by):
        step = max(1, CHARS // max(4, languages) // n)
        for k in range(0, len(by[n]), step):
            yield by[n][k:k + step]


def learn_round(rows: DataFrame, languages: list[str], logp: np.ndarray, model: str) -> np.ndarray:
    """Expected counts of all pieces in each language over all rows (lang, text), in steps of 1 / UNIT."""
    place = {x: k for k, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, total = coder(Vocabulary, model), np.zeros(logp.shape, np.int64)
        held: list[Counter] = [Counter() for _ in languages]

        def settle():
            for some in in_matrices(set().union(*held), len(held)):
                times = np.asarray([[h[w] for h in held] for w in some], np.int64)
                np.add(total, Forward(some, v, logp).expected(times), out=total)
            for h in held:
                h.clear()

        for b in slices(batches):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                held[place[lang]].update(text.split())
            if sum(map(len, held)) > CACHED // 8:
                settle()
        settle()
        at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(total[at])], ["piece", "lang", "n"])

    out = np.zeros(logp.shape)
    for r in rows.mapInArrow(count, "piece long, lang long, n long").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["piece"], r["lang"]] = r["n"]
    return out


def sample(rows: DataFrame, counts: dict[str, int], most: int) -> DataFrame:
    """At most `most` distinct texts of each language (lang, text), the first by hash.

    Hashes are thinned by the language's rows before they meet, and repeats before the shuffle, so copies that are a
    third of all rows send one hash a task; the hashes that stay are bounded and broadcast. No text is sorted.
    """
    fate = F.lit(0.0)
    for lang, n in counts.items():
        fate = F.when(F.col("lang") == lang, F.lit(min(1.0, 4.0 * most / n))).otherwise(fate)
    named = rows.select("lang", "text", F.xxhash64("text").alias("name"))
    first = named.where(F.pmod(F.col("name"), F.lit(1 << 32)) < fate * float(1 << 32)).select("lang", "name").distinct()
    first = first.withColumn("_n", F.row_number().over(W.partitionBy("lang").orderBy("name"))).where(F.col("_n") <= most).drop("_n")
    return named.join(F.broadcast(first), ["lang", "name"], "left_semi").groupBy("lang", "name").agg(F.any_value("text").alias("text"))


def train(docs: DataFrame, model: str | None = None, rounds: int = ROUNDS, smoothing: float = SMOOTHING, max_texts: int = MAX_TEXTS) -> dict:
    """Model from rows whose lang and text are not null: languages, their log shares, log probabilities of pieces.

    Shares count all rows, pieces those of at most max_texts distinct texts of each language. The model has one number
    for each piece and language; more than LANGUAGES languages stop the call.
    """
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.where("lang is not null and text is not null").select("lang", "text")
    seen = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(LANGUAGES + 1).collect()
    if len(seen) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    v = Vocabulary(path)
    logp = np.full((v.size, len(seen)), -np.inf)
    logp[v.used] = -np.log(len(v.used))
    languages = [r["lang"] for r in seen]
    if seen:
        rows = cut_lineage(sample(rows, {r["lang"]: r["n"] for r in seen}, max_texts))
    for _ in range(rounds if seen else 0):
        n = learn_round(rows, languages, logp, path)[v.used] / UNIT + smoothing
        logp[v.used] = np.log(n) - np.log(n.sum(0))
    share = np.asarray([r["n"] for r in seen], np.float64)
    return {"model": path, "languages": languages, "share": np.log(share / share.sum()) if len(seen) else share, "logp": logp}


class Scorer:
    """Log probabilities of texts under each language; distinct words are computed once while the cache holds."""

    def __init__(self, model: dict):
        self.v, self.model = coder(Vocabulary, model["model"]), model
        self.most = max(1024, CACHED // max(1, len(model["languages"])))
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(model["languages"])))

    def of(self, texts: list[str]) -> np.ndarray:
        words = [t.split() for t in texts]
        new = set().union(*words).difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.known, self.table, new = {}, self.table[:0], set().union(*words)
        found = [self.table]
        for some in in_matrices(new, self.table.shape[1]):
            self.known.update(zip(some, range(len(self.known), len(self.known) + len(some))))
            found.append(Forward(some, self.v, self.model["logp"]).total())
        self.table = np.concatenate(found)
        return np.stack([self.table[np.fromiter(map(self.known.__getitem__, w), np.int64, len(w))].sum(0) for w in words]) + self.model["share"]


def predict(docs: DataFrame, model: dict, name: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """Documents with the likeliest language and its probability among all, in two columns that replace any of these names.

    `und` with 0.0 where a text is null or has no letter, or nothing was learned. Ties go to the first language in
    order. Rows are independent: repeated and null ids get a row each, an empty table none.
    """
    languages = model["languages"]
    docs = docs.drop(name, score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if languages else None
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            at = [k for k, t in enumerate(texts) if t and LETTER.search(t)] if languages else []
            pred, p = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if at:
                z = scorer.of([texts[k] for k in at])
                best = z.argmax(1)
                p[at] = 1 / np.exp(z - z.max(1, keepdims=True)).sum(1)
                for k, j in zip(at, best):
                    pred[k] = languages[j]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred), pa.array(p)], [*b.schema.names, name, score])

    return docs.mapInArrow(run, StructType(list(docs.schema)).add(name, StringType()).add(score, DoubleType()))


@query("op13_marginal_unigrams")
def marginal_unigrams(spark, sf):
    """Every document's language by a model that saw no row of the held-out fifth."""
    docs = table(spark, sf, "documents")
    model = train(docs.where(~held_out()))
    p = predict(docs.select("doc_id", "text"), model)
    return p.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
