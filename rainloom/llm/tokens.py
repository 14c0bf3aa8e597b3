"""Token operators: byte-level encoding and decoding, and greedy word-piece counts by a failure-link automaton."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rainloom.llm.bpe import RankCoder, coder
from rainloom.llm.common import map_batches, query, table, text_or_empty

CODES = "doc_id long, n_tokens long, ids binary"


def encode(docs: DataFrame, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of each whole text; a null text has no ids.

    Rows are independent: repeated, tied and null doc_ids give a row each, an empty table none.
    """
    path = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = coder(RankCoder, path, pattern).ids(b.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], ["doc_id", "n_tokens", "ids"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), run, CODES)


def decode(codes: DataFrame, ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Adds the decoded bytes to rows of encode()."""
    path = ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = coder(RankCoder, path, pattern)
        back = pa.array([c.decode(np.frombuffer(x, "<u4")) for x in b.column("ids").to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([*b.columns, back], [*b.schema.names, "decoded"])

    return map_batches(codes.select("doc_id", "n_tokens", "ids"), run, CODES + ", decoded binary", by="ids")


@query("op5_byte_bpe")
def byte_bpe(spark, sf):
    """Digests of the ids of every whole text and of the bytes decoded from them."""
    d = decode(encode(table(spark, sf, "documents")))
    return d.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


class LongestMatch:
    """Greedy longest-match piece counts in one pass over a word.

    Two tries, of pieces that begin a word and of pieces that go on inside one, share their nodes. The failure
    link of a node leads to where matching goes on after the longest pieces of the node's string are popped;
    only the number of those pieces is kept. So each character moves down the trie once, and counting needs no
    list of pieces and no step back in the word.
    """

    def __init__(self, begins: list[str], goes_on: list[str]):
        self.child: dict[tuple[int, str], int] = {}
        self.inside = 1
        text, piece = ["", ""], [False, False]
        for root, words in ((0, begins), (self.inside, goes_on)):
            for w in words:
                at = root
                for c in w:
                    key = (at, c)
                    if key not in self.child:
                        self.child[key] = len(piece)
                        piece.append(False)
                    at = self.child[key]
                if w:
                    piece[at] = True
        self.link, self.pops = [-1] * len(piece), [0] * len(piece)
        below: dict[int, list] = {}
        for (at, c), to in self.child.items():
            below.setdefault(at, []).append((c, to))
        level = [0, self.inside]
        while level:
            following = []
            for at in level:
                for c, to in below.get(at, []):
                    if piece[to]:
                        self.link[to], self.pops[to] = self.inside, 1
                    else:
                        z, pops = self.link[at], self.pops[at]
                        while z >= 0 and (z, c) not in self.child:
                            pops += self.pops[z]
                            z = self.link[z]
                        if z >= 0:
                            self.link[to], self.pops[to] = self.child[z, c], pops
                    following.append(to)
            level = following

    def count(self, word: str) -> int:
        """Pieces of a word; -1 where greedy matching gets stuck."""
        child, link, pops = self.child, self.link, self.pops
        at = n = 0
        for c in word:
            to = child.get((at, c))
            while to is None:
                n += pops[at]
                at = link[at]
                if at < 0:
                    return -1
                to = child.get((at, c))
            at = to
        while at > self.inside:
            n += pops[at]
            at = link[at]
            if at < 0:
                return -1
        return n


class WordCounter:
    """Counts of texts, each distinct word counted once while the cache of `most` words holds."""

    most = 1 << 19

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [sp.id_to_piece(k) for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k))]
        mark = "▁"
        self.automaton = LongestMatch([p[1:] for p in pieces if p[:1] == mark and mark not in p[1:]], [p for p in pieces if mark not in p])
        self.known: dict[str, int] = {}

    def count(self, text: str) -> tuple[int, int, int]:
        """Words, tokens and unknown words; an unknown word is one token."""
        if len(self.known) > self.most:
            self.known.clear()
        words, known = text.split(), self.known
        for w in set(words).difference(known):
            known[w] = self.automaton.count(w)
        counts = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        return len(words), int(np.abs(counts).sum()), int((counts < 0).sum())


def count_tokens(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown of each whole text: words between white space, cut greedily into the
    pieces of a piece model (its word-begin mark tells first pieces from later ones). A null or empty text has
    zeros; rows are independent, so repeated doc_ids give a row each."""
    path = model or public_tokenizers.path("piece_bpe_32k.model")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = coder(WordCounter, path)
        rows = [c.count(t) for t in b.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), run, "doc_id long, n_words long, n_tokens long, n_unknown long")


@query("op7_word_piece_counts")
def word_piece_counts(spark, sf):
    """Greedy word-piece counts of every document."""
    return count_tokens(table(spark, sf, "documents"))
