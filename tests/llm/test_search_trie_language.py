"""Ranked lexical search, the prefix trie of conversations and language identification against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from rainloom.llm import language, lexical, trie
from rainloom.llm.bpe import coder
from tests.llm.helpers import ODD, documents, empty

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(docs, items, k=20):
    terms = [(i, Counter(TERM.findall((t or "").translate(UPPER)))) for i, t in docs]
    terms = [(i, c) for i, c in terms if c]
    n, total = len(terms), sum(c.total() for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in sorted({x for x in items if x[1] is not None}, key=str):
        asked = Counter(TERM.findall(text.translate(UPPER)))
        rows = []
        for i, c in terms:
            m = 100 - 25 + (25 * c.total() * n) // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if s > 0:
                rows.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(rows)[:k])]
    return Counter(out)


def some_docs(seed=4, n=700):
    r = random.Random(seed)
    texts = [" ".join(r.choice(["The", "é", "ñandú", "x1", f"w{r.randint(0, 40)}", f"W{r.randint(0, 900)}"]) + r.choice(["", ",", ". ", "\n", "_"]) for _ in range(r.choice([1, 3, 20, 60, 300]))) for _ in range(n)]
    return ODD + texts + [texts[0]] * 30


def test_search_equals_brute_force(spark, monkeypatch):
    docs = documents(spark, some_docs())
    items = spark.createDataFrame([(1, "the w1 w2 w2 É é", 0), (2, "W17 w900 none of these", 0), (2, "a second text w5", 0), (3, None, 0), (4, "", 0), (None, "ñandú x1", 0), (1, "the w1 w2 w2 É é", 1), (9, "absent0", 0)], "item_id long, text string, rank int")
    want = brute_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    for width, block, batch in ((4096, 512, 256), (8, 7, 2)):
        monkeypatch.setattr(lexical, "BLOCK", block)
        assert Counter(map(tuple, lexical.search(docs.repartition(3), items, batch=batch, width=width).collect())) == want
    for a, b in ((empty(docs), items), (docs, empty(items))):
        assert lexical.search(a, b).count() == 0
    assert lexical.search(docs.where("text is null"), items).count() == 0


def test_bounds_never_fall_below_scores_and_stop_early():
    texts = [t or "" for t in some_docs(8, 2000)]
    counts = [Counter(lexical.terms(t)) for t in texts]
    held = [c for c in counts if c]
    df, total = Counter(t for c in held for t in c), sum(c.total() for c in held)
    asked = [Counter(lexical.terms(t)) for t in ("w1 w33 w700 w800", "ñandú the the x1", "w899")]
    batch, best = lexical.Batch(asked, len(held), total, df), lexical.Best(3, 5)
    m = lexical.length_factor(np.asarray([c.total() for c in held], np.int64), len(held), total)
    bound = batch.bounds(batch.sketches(held, m))
    exact = np.asarray([[batch.score(q, c, int(x)) for q in range(3)] for c, x in zip(held, m)])
    assert (bound >= exact).all() and (bound == exact).mean() > 0.9
    done = sum(lexical.search_block(batch, best, list(range(at, at + 500)), texts[at:at + 500]) for at in range(0, 2000, 500))
    assert done < 0.2 * 3 * len(held)


def brute_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, x) for _, _, r, _, x in sorted(t)] for c, t in convs.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:])
    members = {}
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    out = []
    for node, who in members.items():
        below = [x for x in members if x[:len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(y[:len(x)] == x and len(y) == len(x) + 1 for y in below)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(str(c) for c in sorted(who) if whole[c] == node)
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def some_conversations(seed, n=150):
    r, rows = random.Random(seed), []
    for c in r.sample(range(-20, 400), n):
        for turn in range(r.choice([1, 1, 2, 3, 5, 9, 12])):
            rows.append((c, r.choice([turn, turn, None, 0]) if r.random() < 0.1 else turn, r.choice(["user", "user", None]), r.choice(["hi", "hi", "é ", None, "", f"t{r.randint(0, 3)}"])))
    rows += [(7, 40 + k, "user", "same") for k in range(300)] + [(None, 1, "user", "lost")] + rows[:5]
    return rows


@pytest.mark.parametrize("positions, chunk", [(1024, 4096), (4, 3)])
def test_trie_equals_brute_force(spark, monkeypatch, positions, chunk):
    monkeypatch.setattr(trie, "POSITIONS", positions)
    monkeypatch.setattr(trie, "CHUNK", chunk)
    rows = some_conversations(positions)
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(3)
    got = trie.build(df)
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows)
    assert trie.build(empty(df)).count() == 0


def test_trie_of_equal_and_turnless_conversations(spark):
    """A group of equal conversations meets in one sequence; its end list has every id in numeric order."""
    short = [c for c in range(5000) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1 and c - c % 5 != 0][:200]
    rows = [(c, 0, "user", "x") for c in short if c - c % 5 not in short] + [(20_000 + 5 * k, 0, "user", "same") for k in range(400)]
    got = trie.build(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows)


def test_forward_sums_all_segmentations():
    v = coder(language.Vocabulary, language.public_tokenizers.path("piece_bpe_32k.model"))
    r = np.random.default_rng(3)
    logp = np.log(r.dirichlet(np.ones(v.size), 2)).T
    pieces = dict(zip(v.names.tolist(), v.ids.tolist()))

    def cuts(w):
        for marks in itertools.product((0, 1), repeat=len(w) - 1):
            at = [0, *(k + 1 for k, m in enumerate(marks) if m), len(w)]
            yield [w[a:b] for a, b in zip(at, at[1:])]

    def ids(piece):
        k = pieces.get(v.name(piece))
        return [k] if k is not None else v.bytes[list(piece.encode())].tolist() if len(piece) == 1 else None

    words = ["the", "ñand", "\U0001f389ab", "x", "thing"]
    for w in words:
        f = language.Forward([w], v, logp)
        known = [sum(some, []) for cut in cuts("▁" + w) if None not in (some := [ids(p) for p in cut])]
        p = np.asarray([np.exp(logp[k].sum(0)) for k in known])
        assert f.total()[0] == pytest.approx(np.log(p.sum(0)), rel=1e-9)
        want = np.zeros(logp.shape)
        for k, share in zip(known, p / p.sum(0)):
            np.add.at(want, k, share)
        assert np.abs(f.expected(np.asarray([[1, 3]])) / language.UNIT - want * [1, 3]).max() < 0.01
    assert language.Forward(words[:1] + ["ñan"], v, logp).total()[0] == pytest.approx(language.Forward(words[:1], v, logp).total()[0])
    assert np.isfinite(language.Forward(["\U0001f389a" * 3000], v, logp).total()).all()


SOUNDS = {"aa": ["the", "ing", "tion", "and", "th"], "bb": ["ung", "sch", "ein", "der", "ich"], "cc": ["ción", "ñas", "que", "los", "ra"]}


def language_rows(seed=6, n=300):
    r, rows = random.Random(seed), []
    for k in range(n):
        lang = r.choice(list(SOUNDS))
        rows.append((k, " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.choice([2, 5, 40]))), lang))
    return rows


def test_language_held_out(spark, tmp_path):
    rows = language_rows()
    more = [(1000, None, "aa"), (1001, "12 34!? ²", "aa"), (1002, "", "bb"), (None, "the thing", "cc"), (1003, "thing and thing", None), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame([(*r, "src", "old") for r in rows + more], "doc_id long, text string, lang string, source string, lang_pred string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = entry.queries()["op13_marginal_unigrams"](spark, str(tmp_path)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + len(more) and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in by.items() if i is not None) and by[None].held_out is False
    assert all((by[k].lang_pred, by[k].score) == ("und", 0.0) for k in (1000, 1001, 1002)) and by[1003].lang_pred == by[None].lang_pred == "aa"
    held = [(by[i].lang_pred == lang) for i, _, lang in rows if by[i].held_out]
    assert len(held) > 30 and np.mean(held) > 0.98 and all(0 <= r.score <= 1 for r in got)
    again = language.train(docs.repartition(5).where(~language.held_out()))
    first = language.train(docs.coalesce(1).where(~language.held_out()))
    assert (again["logp"] == first["logp"]).all() and again["languages"] == ["aa", "bb", "cc"]
    few = language.sample(docs.unionByName(docs).where("lang is not null and text is not null"), {"aa": 100, "bb": 100, "cc": 100}, 7).collect()
    assert sorted(r.lang for r in few) == ["aa"] * 7 + ["bb"] * 7 + ["cc"] * 7 and len({r.text for r in few}) == 21
    out = language.predict(docs, first)
    assert out.columns == ["doc_id", "text", "lang", "source", "lang_pred", "lang_score"] and language.predict(empty(docs), first).count() == 0
    none = language.train(empty(docs))
    assert {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}


@pytest.mark.parametrize("name", ["op11_max_sketches", "op12_sequence_trie"])
def test_query_equals_its_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        db.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    cur = db.execute(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, sf).select(*[d[0] for d in cur.description])
    want = Counter(cur.fetchall())
    assert want and Counter(map(tuple, df.collect())) == want
