"""Byte-pair encoding of many pieces at once in padded numpy matrices.

Pieces of similar length share a matrix, one piece to a row. In each round every row merges its leftmost
pair of least rank; pair ranks come from an open-addressing hash table. Rows without a mergeable pair leave
the matrix. Rows beyond the longest bucket are merged with a heap, which needs n log n steps where rounds
over a matrix would need n * n.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterable

import numpy as np
import regex
import tiktoken

NO_RANK = np.int32(2**31 - 1)
#: Piece lengths up to which a row shares a matrix; longer pieces take the heap.
BUCKETS = (4, 8, 12, 16, 24, 32, 48, 64, 96, 128)
#: Rows of a matrix at most.
ROWS = 1 << 14
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Hash table from a pair of ids to the rank of its merge and the merged id."""

    def __init__(self, left, right, rank, merged):
        keys = self.key(np.asarray(left, np.uint64), np.asarray(right, np.uint64))
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, 0, np.uint64)
        self.rank = np.full(1 << bits, NO_RANK, np.int32)
        self.merged = np.zeros(1 << bits, np.uint32)
        at, left_over = self.slot(keys), np.arange(len(keys))
        while len(left_over):
            free = self.keys[at[left_over]] == 0
            spot, first = np.unique(at[left_over][free], return_index=True)
            won = left_over[free][first]
            self.keys[spot], self.rank[spot], self.merged[spot] = keys[won], np.asarray(rank)[won], np.asarray(merged)[won]
            left_over = left_over[self.keys[at[left_over]] != keys[left_over]]
            at[left_over] = (at[left_over] + 1) & self.mask

    @staticmethod
    def key(a, b):
        return ((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)) + np.uint64(1)

    def slot(self, keys):
        return ((keys * MULTIPLIER) >> self.shift).astype(np.int64)

    def find(self, a, b):
        """Table positions of the pairs; a position whose rank is NO_RANK where there is none."""
        keys = self.key(a, b).ravel()
        at = self.slot(keys)
        there = self.keys[at]
        open_ = np.flatnonzero((there != keys) & (there != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            there = self.keys[at[open_]]
            open_ = open_[(there != keys[open_]) & (there != 0)]
        return at.reshape(np.shape(a))


def merge_rows(ids: np.ndarray, size: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge every row of a padded matrix to the end: the ids, left-aligned, and the number of them in each row."""
    n, width = ids.shape
    out, left = ids.copy(), size.copy()
    if width < 2:
        return out, left
    cols = np.arange(width)
    rows, work = np.arange(n), ids
    rank = pairs.rank[pairs.find(ids[:, :-1], ids[:, 1:])]
    rank[cols[1:] >= size[:, None]] = NO_RANK
    while True:
        at = rank.argmin(axis=1)
        live = rank[np.arange(len(rows)), at] != NO_RANK
        if not live.all():
            done = ~live
            out[rows[done], :work.shape[1]] = work[done]
            rows, work, rank, at = rows[live], work[live], rank[live], at[live]
            if not len(rows):
                return out, left
        i, size = np.arange(len(rows)), left[rows]
        new = pairs.merged[pairs.find(work[i, at], work[i, at + 1])]
        left[rows] = size = size - 1
        width = int(size.max())
        source = cols[:width][None, :] + (cols[:width][None, :] > at[:, None])
        work = np.take_along_axis(work, np.minimum(source, work.shape[1] - 1), axis=1)
        work[i, at] = new
        if width < 2:
            out[rows, :width] = work
            return out, left
        rank = np.take_along_axis(rank, np.minimum(source[:, :width - 1], rank.shape[1] - 1), axis=1)
        for shift in (-1, 0):
            j = at + shift
            ok = np.flatnonzero((j >= 0) & (j + 1 < size))
            rank[ok, j[ok]] = pairs.rank[pairs.find(work[ok, j[ok]], work[ok, j[ok] + 1])]
        rank[cols[:width - 1][None, :] + 1 >= size[:, None]] = NO_RANK


def merge_long(ids: list[int], pairs: PairTable) -> list[int]:
    """Merge one long piece with a heap of (rank, position)."""
    n = len(ids)
    after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    start = pairs.find(np.asarray(ids[:-1], np.uint32), np.asarray(ids[1:], np.uint32))
    heap = [(int(r), i, ids[i], ids[i + 1], int(m)) for i, (r, m) in enumerate(zip(pairs.rank[start], pairs.merged[start])) if r != NO_RANK]
    heapq.heapify(heap)

    def push(i, j):
        at = pairs.find(np.asarray([ids[i]], np.uint32), np.asarray([ids[j]], np.uint32))[0]
        if pairs.rank[at] != NO_RANK:
            heapq.heappush(heap, (int(pairs.rank[at]), i, ids[i], ids[j], int(pairs.merged[at])))

    while heap:
        _, i, a, b, new = heapq.heappop(heap)
        j = after[i] if live[i] else n
        if j >= n or ids[i] != a or ids[j] != b:
            continue
        ids[i], live[j] = new, False
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            push(i, k)
        if before[i] >= 0:
            push(before[i], i)
    return [x for x, keep in zip(ids, live) if keep]


def encode_pieces(pieces: list[bytes], inner: np.ndarray, last: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of all pieces in order, and the number of ids of each. inner, last: the id of a byte inside a piece and at its end."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    start = np.cumsum(size) - size
    first = inner[flat].astype(np.uint32)
    some = size > 0
    first[(start + size - 1)[some]] = last[flat[(start + size - 1)[some]]]
    counts, found = size.copy(), []
    low = 1
    for high in BUCKETS:
        group = np.flatnonzero((size > low) & (size <= high))
        low = high
        for g in (group[k:k + ROWS] for k in range(0, len(group), ROWS)):
            cols = np.arange(size[g].max())
            index = np.minimum(start[g][:, None] + cols, len(flat) - 1)
            ids, left = merge_rows(first[index], size[g], pairs)
            counts[g] = left
            found.append((g, ids, left))
    long = {}
    for k in np.flatnonzero(size > BUCKETS[-1]):
        long[k] = np.asarray(merge_long(first[start[k]:start[k] + size[k]].tolist(), pairs), np.uint32)
        counts[k] = len(long[k])
    at = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint32)
    ones = np.flatnonzero(size == 1)
    out[at[ones]] = first[start[ones]]
    for g, ids, left in found:
        keep = np.arange(ids.shape[1])[None, :] < left[:, None]
        out[(at[g][:, None] + np.arange(ids.shape[1]))[keep]] = ids[keep]
    for k, v in long.items():
        out[at[k]:at[k] + len(v)] = v
    return out, counts


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i]+1, ... of counts[i] each, one after the other."""
    total = int(counts.sum())
    shift = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return shift + np.arange(total)


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for; keys not yet encoded wait in `fresh`."""

    def __init__(self, shared: list):
        super().__init__()
        self.fresh = shared

    def __missing__(self, key):
        self[key] = n = self.fresh[0]
        self.fresh[0] = n + 1
        self.fresh.append((self, key))
        return n


class ChunkCoder:
    """Ids of texts by chunks that are met again and again: each distinct chunk is encoded once while the cache holds.

    A subclass cuts texts into chunks whose ids may be put one after the other and encodes new chunks. The
    cache is emptied when it holds `most` chunks, so memory stays bounded whatever the vocabulary.
    """

    most = 1 << 18

    def clear(self):
        self.fresh: list = [0]
        self.known, self.spaced = Numbers(self.fresh), Numbers(self.fresh)
        self.flat, self.count, self.start = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, text: str) -> np.ndarray:
        raise NotImplementedError

    def encode_chunks(self, fresh: list) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def ids(self, texts: Iterable[str]) -> list[np.ndarray]:
        if self.fresh[0] > self.most:
            self.clear()
        rows = [self.numbers(text) for text in texts]
        if len(self.fresh) > 1:
            flat, count = self.encode_chunks(self.fresh[1:])
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count) - count])
            self.flat, self.count = np.concatenate([self.flat, flat]), np.concatenate([self.count, count])
            del self.fresh[1:]
        return [self.flat[ragged(self.start[r], self.count[r])] for r in rows]


def at_index(found: dict, keys: list) -> np.ndarray:
    return np.fromiter(map(found.__getitem__, keys), np.int64, len(keys))


#: Text in which some white space is not a single character between two others.
UNEVEN = re.compile(r"\s\s|^\s|\s$")
SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: White space as Unicode's White_Space property has it, which the tokenizers' \s means; Python's \s holds four control characters more.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A space and letters: one piece.
SPACED_WORD = re.compile("[ ][A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")


def rank_file(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@functools.cache
def category(kind: str) -> str:
    """Ranges of the characters whose general category begins so, for a character class."""
    out, first = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)).startswith(kind)
        if inside and first is None:
            first = c
        elif not inside and first is not None:
            out.append(f"\\U{first:08x}-\\U{c - 1:08x}")
            first = None
    return "".join(out)


class RankCoder(ChunkCoder):
    """Byte-level coder of a rank file: each match of the pattern is a piece, merged by the rank of the joined bytes.

    Letters and numbers are Python's; chunks with characters newer than Python's tables, which the library may
    know, are left to it.
    """

    def __init__(self, path: str, pattern: str):
        ranks = rank_file(path)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, r in ranks.items():
            self.tokens[r] = token
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        letter, number, self.new = category("L"), category("N"), re.compile(f"[{category('Cn')}]")
        own = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{WHITE}{letter}{number}]").replace(r"(?!\S)", f"(?![^{WHITE}])").replace(r"\s", f"[{WHITE}]")
        self.pattern = re.compile(own.replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]"))
        rows = [(ranks[t[:k]], ranks[t[k:]], r, r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, rank, merged = map(np.asarray, zip(*rows))
        self.pairs = PairTable(left, right, rank, merged)
        self.bytes = np.asarray([ranks[bytes([b])] for b in range(256)], np.uint32)
        self.clear()
        self.whole = ranks

    def numbers(self, text: str) -> np.ndarray:
        """Cut before each single space between other characters, and around single line feeds: no match goes on over such a place."""
        if not text:
            return np.zeros(0, np.int64)
        if UNEVEN.search(text):
            head, *rest = SINGLE_SPACE.split(text)
        else:
            head, *rest = text.replace("\n", " \n").split(" ")
        return np.concatenate([[self.known[head]], at_index(self.spaced, rest)])

    def encode_chunks(self, fresh: list):
        chunks = [c if source is self.known or c[0] == "\n" else " " + c for source, c in fresh]
        found, word = self.pattern.findall, SPACED_WORD.fullmatch
        cut = [[c] if word(c) else found(c) if c.isascii() or not self.new.search(c) else [] for c in chunks]
        pieces = [p.encode() for f in cut for p in f]
        whole = np.fromiter((self.whole.get(p, -1) for p in pieces), np.int64, len(pieces))
        rest = np.flatnonzero(whole < 0)
        ids, counts = encode_pieces([pieces[k] for k in rest], self.bytes, self.bytes, self.pairs)
        n = np.ones(len(pieces), np.int64)
        n[rest] = counts
        at = np.cumsum(n) - n
        flat = np.zeros(int(n.sum()), np.uint32)
        flat[at[whole >= 0]] = whole[whole >= 0]
        flat[ragged(at[rest], counts)] = ids
        return by_library(flat, per_chunk(n, cut), {k: self.library.encode_ordinary(chunks[k]) for k, f in enumerate(cut) if not f and chunks[k]})

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


#: Characters whose lower case and composed form are one character each; other chunks go to the library.
PLAIN = re.compile("[!-~\u00c0-\u012f\u0131-\u017f]*")
#: One piece once in lower case.
WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")


class WordCoder(ChunkCoder):
    """Coder of a tokenizer file with word ends; chunks between ASCII white space are independent.

    Plain chunks are merged here, all others (special tokens, composed characters, other alphabets) by the library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        vocab, model = spec["model"]["vocab"], spec["model"]
        end = model["end_of_word_suffix"]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = [t["content"] for t in spec["added_tokens"]]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.pairs = PairTable(*(np.asarray(x) for x in zip(*((vocab[a], vocab[b], r, vocab[a + b]) for r, (a, b) in enumerate(merges)))))
        shown = byte_characters()
        self.inner = np.asarray([vocab[shown[b]] for b in range(256)], np.uint32)
        self.last = np.asarray([vocab[shown[b] + end] for b in range(256)], np.uint32)
        self.clear()

    def numbers(self, text: str) -> np.ndarray:
        return at_index(self.known, text.encode().split())

    def encode_chunks(self, fresh: list):
        chunks = [c.decode() for _, c in fresh]
        found, word = self.pattern.findall, WORD.fullmatch
        cut = [[c.lower()] if word(c) else found(c.lower()) if self.plain(c) else [] for c in chunks]
        ids, n = encode_pieces([p.encode() for f in cut for p in f], self.inner, self.last, self.pairs)
        return by_library(ids, per_chunk(n, cut), {k: self.library.encode(chunks[k], add_special_tokens=False).ids for k, f in enumerate(cut) if not f})

    def plain(self, chunk: str) -> bool:
        return PLAIN.fullmatch(chunk) is not None and not any(s in chunk for s in self.special)


def per_chunk(n: np.ndarray, cut: list) -> np.ndarray:
    """Ids of each chunk, from the ids of each piece."""
    ends = np.concatenate([[0], np.cumsum(n)])
    upto = np.concatenate([[0], np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))])
    return ends[upto[1:]] - ends[upto[:-1]]


def by_library(ids: np.ndarray, counts: np.ndarray, found: dict[int, list]) -> tuple[np.ndarray, np.ndarray]:
    """Put the ids of single chunks in place."""
    if not found:
        return ids, counts
    rows = np.split(ids, np.cumsum(counts)[:-1])
    for k, got in found.items():
        rows[k] = np.asarray(got, np.uint32)
        counts[k] = len(got)
    return np.concatenate(rows).astype(np.uint32), counts


def byte_characters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself where visible, else the next free one from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


CODERS: dict = {}


def coder(kind, *args):
    """One coder for each Python worker: building its tables takes about a second."""
    key = (kind.__name__, *args)
    if key not in CODERS:
        CODERS[key] = kind(*args)
    return CODERS[key]
