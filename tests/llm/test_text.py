"""Byte-level coding, word-piece counts, packing and personal data against the libraries and plain versions."""

import random
import sys
import unicodedata

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from rainloom.llm import bpe, packing, pii, tokens
from tests.llm.helpers import ODD, brute_context_pii, brute_pii, crc, documents, empty, sha, word_ids


def library():
    ranks = bpe.rank_file(P.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def noise(n=400, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(" \n\t  abcde\u00e9\u4e2d\u03a31'sS\u0130.,\x1c\u0301\U0001f389") for _ in range(r.randint(0, 80))) for _ in range(n)]


def test_byte_codes_match_library():
    coder, lib = bpe.RankCoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), library()
    texts = [t or "" for t in ODD] + noise() + [" \u0558x \u1c89y", "\ua7cb"]
    for got, text in zip(coder.ids(texts), texts):
        assert got.tolist() == lib.encode_ordinary(text)
        assert coder.decode(got) == text.encode()


def test_classes_of_all_characters_match_library():
    """Letters, numbers and white space as the library has them: c joins a letter, a digit or a space into one piece."""
    coder = bpe.RankCoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    chars = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) not in ("Cs", "Cn", "Co")]
    for p in "a1.":
        ranks = {bytes([b]): b for b in range(256)} | {(p + c).encode(): 256 + k for k, c in enumerate(chars)}
        lib = tiktoken.Encoding("classes", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        assert [c for c in chars if (len(lib.encode_ordinary(p + c)) == 1) != (len(coder.pattern.findall(p + c)) == 1)] == []


def test_cache_is_bounded_and_emptied():
    coder, lib = bpe.RankCoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), library()
    coder.most = 50
    texts = noise(300, 5)
    got = [x for k in range(0, 300, 10) for x in coder.ids(texts[k:k + 10])]
    assert [g.tolist() for g in got] == [lib.encode_ordinary(t) for t in texts]
    assert coder.fresh[0] < 1000


def test_byte_bpe_rows(spark):
    docs, lib = documents(spark), library()
    rows = tokens.decode(tokens.encode(docs)).collect()
    want = sorted((str(r.doc_id), tuple(lib.encode_ordinary(r.text or ""))) for r in docs.collect())
    assert sorted((str(r.doc_id), tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == want
    assert sorted(sha(bytes(r.decoded)) for r in rows) == sorted(sha((r.text or "").encode()) for r in docs.collect())
    assert tokens.encode(empty(docs)).count() == 0


def test_longest_match_equals_library():
    from tokenizers import Tokenizer, models

    begins, later = ["a", "ab", "abcd", "x", "xy"], ["b", "c", "bc", "cde", "d", "e", "dd"]
    auto = tokens.LongestMatch(begins, later)
    model = Tokenizer(models.WordPiece({t: k for k, t in enumerate(["?", *begins, *("##" + p for p in later)])}, unk_token="?", max_input_chars_per_word=10_000))
    r = random.Random(1)
    for _ in range(3000):
        w = "".join(r.choice("abcdexy") for _ in range(r.randint(1, 12)))
        ids = model.encode(w).ids
        assert auto.count(w) == (-1 if 0 in ids else len(ids)), w
    assert auto.count("a" + "b" * 100_000) == 1 + 99_999


def test_count_tokens(spark):
    docs = documents(spark)
    got = tokens.count_tokens(docs).collect()
    assert sorted(r.n_words for r in got) == sorted(len((r.text or "").split()) for r in docs.collect())
    assert all(r.n_tokens >= r.n_words >= r.n_unknown for r in got) and tokens.count_tokens(empty(docs)).count() == 0


@pytest.mark.parametrize("texts", [ODD, ["word " * 9000, *ODD]])
def test_packing(spark, texts):
    docs = documents(spark, texts)
    rows = packing.pack(docs).collect()
    by_seq, ids = {}, {}
    for r in docs.collect():
        ids.setdefault(r.doc_id, word_ids(r.text))
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start:r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
    assert sum(r.length for r in rows) == sum(len(word_ids(r.text)) for r in docs.collect())
    assert packing.pack(empty(docs)).count() == 0


def test_patterns_hold_every_piece_once_with_little_room_left():
    r = np.random.default_rng(2)
    counts = {int(s): int(n) for s, n in zip(r.choice(np.arange(1, 257), 120, replace=False), r.integers(1, 400, 120))}
    plan = packing.plan_patterns(counts, 256)
    held = sum(n * p for _, n, p in plan)
    assert held.tolist() == [counts[s] for s in sorted(counts)] and all(int((s * p).sum()) <= 256 for s, _, p in plan)
    used, sequences = sum(s * n for s, n in counts.items()), sum(n for _, n, _ in plan)
    assert sequences * 256 <= used * 1.02 + 256
    assert packing.plan_patterns({}, 256) == []


PRIVATE = ["mail john.d@mail.example.com now", "ip 256.1.1.1 and 10.0.0.1.5 and 001.002.003.004", "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "call +1 (415) 555-2671 or +1", "a@b.c_d@e.f a@b x@y.z.",
           "🎉 é 10.1.2.3 🎉 a@b.co", "+" + "1" * 30, "1" * 20_000, "a" * 20_000 + "@b.c", "a.b@c.de " * 300, "1 " * 5000, "+1" + "(" * 3000, None, ""]


def test_base_spans_match_plain_regex(spark):
    r = random.Random(4)
    texts = PRIVATE + ["".join(r.choice("a1.@+- ()é4_%") for _ in range(r.randint(0, 70))) for _ in range(600)]
    docs = documents(spark, texts)
    rows = pii.spans(docs).collect()
    want = {r.doc_id: brute_pii(r.text) for r in docs.collect()}
    for x in rows:
        assert [f"{k}:{s.start}:{s.end}" for k in pii.KINDS for s in x[k]] == want[x.doc_id]
    assert len(rows) == docs.count() and pii.spans(empty(docs)).count() == 0


def test_context_finds_what_no_base_pattern_matches(spark):
    known = [f"write to mailbox: user{k}x@mail{k}.example.com at once and say the word {k}" for k in range(8)] + [f"the 4{k:03d} is a number" for k in range(20)]
    docs = documents(spark, known + ["write to mailbox: hidden.user@intranet at once", "the person user@intranet was here", "nothing"])
    got = {x.doc_id: x.extra for x in pii.spans(docs).collect() if x.extra}
    assert {k: [(s.kind, s.m) for s in v] for k, v in got.items()} == {28: [("email", "hidden.user@intranet")], 29: [("email", "user@intranet")]} or \
        {k: [(s.kind, s.m) for s in v] for k, v in got.items()} == {28: [("email", "hidden.user@intranet")]}


def told(seed=7):
    """Three generations: seeds stand behind `mailbox`, strings found there behind `reply to`, strings found there behind `desk`; `to` alone is common."""
    r = random.Random(seed)
    texts = [f"note {k} mailbox user{k}x@mail{k}.example.com" for k in range(40)]
    texts += [f"note {k} mailbox staff{k}@intranet" for k in range(8)]
    texts += [f"please Reply  to staff{k}@intranet soon" for k in range(8)] + [f"1 goes to town {k} and to bed" for k in range(30)]
    texts += [f"reply to clerk{k}@floor" for k in range(4)] + [f"desk clerk{k}@floor" for k in range(4)] + ["desk staff1@intranet", "desk staff2@intranet", "desk last@room", "sofa last@room", "table other@room"]
    texts += [f"server 10.0.0.{k}{' or server 10.0.0.999' if k < 3 else ''}" for k in range(9)] + ["", None, "w" * 200 + " a@b", "mailbox mailbox mailbox"] + [" ".join(r.choice(["desk0", "1", "to", "x@y", "12345678", "word"]) for _ in range(12)) for _ in range(40)]
    return texts


def test_found_instances_induce_patterns(spark):
    texts = told()
    got = {x.doc_id: sorted((s.kind, s.start, s.end, s.m) for s in x.extra) for x in pii.spans(documents(spark, texts)).collect() if x.extra}
    assert got == brute_context_pii(texts)
    found = {m for x in got.values() for *_, m in x}
    assert {"staff3@intranet", "clerk3@floor", "last@room", "10.0.0.999"} <= found and not {"other@room", "x@y", "12345678"} & found
    assert all(texts.index("sofa last@room") != k for k in got)


def test_query_lists_spans_found_by_context(spark, tmp_path):
    texts = told()
    docs = documents(spark, texts)
    docs.unionByName(docs.where("doc_id is null")).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_context_pii(texts)
    for r in pii.bootstrapped_pii(spark, str(tmp_path)).where("doc_id is not null").collect():
        order = {k: n for n, k in enumerate(pii.KINDS)}
        base = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in brute_pii(texts[r.doc_id]))]
        every = sorted(base + [x[:3] for x in want.get(r.doc_id, [])], key=lambda x: (order[x[0]], *x[1:]))
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in every) and r.n_by_context == len(want.get(r.doc_id, []))
        assert (r.n_email, r.n_ip) == (sum(x[0] == "email" for x in base), sum(x[0] == "ip" for x in base))


def test_masked_keeps_rows_and_columns(spark):
    docs = documents(spark, PRIVATE)
    out = pii.masked(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[0] == "mail [EMAIL] now" and text[12] is None and text[5] == "🎉 é [IP] 🎉 [EMAIL]" and "4111 1111" not in text[2] and text[2].endswith("4111-1111-1111-1112")
    assert "Python" not in out._jdf.queryExecution().toString() and sys.version


def test_word_coder_matches_library():
    from tokenizers import Tokenizer

    coder, lib = bpe.WordCoder(P.path("word_bpe_49k.json")), Tokenizer.from_file(P.path("word_bpe_49k.json"))
    plain = [chr(c) for c in [*range(33, 127), *range(0xC0, 0x180)]]
    texts = [t or "" for t in ODD] + noise() + [f"a{c}b 1{c}2 {c} {c}{c}'s" for c in plain] + ["x<|startoftext|>y <|endoftext|>", "<| start"]
    for got, text in zip(coder.ids(texts), texts):
        assert got.tolist() == lib.encode(text, add_special_tokens=False).ids, text
