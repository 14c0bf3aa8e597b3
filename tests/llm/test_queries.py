"""Every registered query of the package called on a small folder and compared with plain versions, all contract columns."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from rainloom.llm import bpe, warc
from tests.llm.helpers import ODD, brute_components, brute_pii, crc, sha, word_ids

QUERIES = ["op1_warc_round_trip", "op2_virtual_slots", "op3_bootstrapped_pii", "op4_pivot_distance", "op5_byte_bpe", "op6_partenum_components", "op7_word_piece_counts",
           "op8_factorization_machine", "op9_cutting_stock", "op10_projection_forest", "op11_max_sketches", "op12_sequence_trie", "op13_marginal_unigrams"]
SCHEMAS = {"documents": "doc_id long, text string, lang string, source string, n_chars long, part int", "pages": "page_id long, url string, html string, copies int",
           "labels": "doc_id long, quality int, toxic int", "embeddings": "vec_id long, embedding array<float>, label int", "benchmark": "item_id long, text string",
           "conversations": "conv_id long, turn long, role string, text string"}


def prose(r, n):
    return " ".join(f"w{r.randint(0, 700)}" for _ in range(n))


def rows():
    """Nulls, empty and long texts, copies, personal data, toxic pairs of words, and one row that is a third of the table."""
    r = random.Random(11)
    texts = [*ODD, *(prose(r, r.choice([3, 12, 60])) for _ in range(60))]
    base = prose(r, 90)
    texts += [base, base + " tail", base.replace("w1", "n1", 1), *(f"{prose(r, 30)} mail k{k}@host{k}.org or 10.0.0.{k} now" for k in range(12))]
    for k in range(80):
        texts.append(prose(r, 25) + (" insult" if k % 4 in (1, 3) else "") + (" group" if k % 4 in (2, 3) else ""))
    docs = [(k, t, ["en", "de", None][k % 3], "s", len(t or ""), 1) for k, t in enumerate(texts)]
    return docs + [(None, "no id at all", "en", None, 1, None)] + [docs[30]] * (len(docs) // 2)


def tables():
    docs, r = rows(), random.Random(2)
    pages = [(k, f"http://h/{k % 7}", "same" if k % 5 == 0 else None if k % 11 == 0 else f"page {k} " * (k % 40), 3) for k in range(60)] + [(None, None, "no id", 0), (7, "http://other/", "é" * 9000, 1)] + [(9, "u", "again", 1)] * 40
    x = np.random.default_rng(4).normal(size=(140, 8)).astype(np.float32)
    x[30:60] = x[30]
    emb = [(k, x[k].tolist(), 0) for k in range(140)] + [(200, None, 0), (220, [None, 1.0] * 4, 0), (240, [0.0] * 8, 0), (260, [float("nan")] * 8, 0), (None, x[0].tolist(), 0)] + [(30, x[30].tolist(), 0)] * 70
    toxic = [(i, 1, int("insult" in t and "group" in t)) for i, t, *_ in docs if i is not None and t][::2] + [(None, 1, 1), (5, 0, None)]
    conv = [(c, t, "user", r.choice(["a", "b"])) for c in range(25) for t in range(c % 4)] + [(3, None, None, None)]
    return {"documents": docs, "pages": pages, "labels": toxic, "embeddings": emb, "benchmark": [(1, "w1 w2 w3 w4"), (2, None)], "conversations": conv}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    for name, data in tables().items():
        spark.createDataFrame(data, SCHEMAS[name]).repartition(3).write.parquet(f"{out}/{name}.parquet")
    return out


@pytest.fixture(scope="module")
def got(spark, folder):
    return {name: entry.queries()[name](spark, folder).collect() for name in QUERIES[:9]}


def test_archive_rows(got):
    pages = tables()["pages"]
    by = {}
    for i, u, h, _ in pages:
        by.setdefault(h or "", []).append((i is not None, i or 0, u or "", i, u))
    want = []
    for i, u, h, _ in pages:
        first = max(by[h or ""])
        own = (i, u) == first[3:]
        data = (h or "").encode()
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own else "revisit", None if own else first[3]))
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got["op1_warc_round_trip"]) == Counter(want)


def test_slot_rows(got):
    docs = tables()["documents"]
    rows = got["op2_virtual_slots"]
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in docs)
    by = {}
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())


def test_equal_rows_do_not_fill_one_shard(spark, tmp_path):
    """A third of the table is one row: law `bytes` holds all the same."""
    docs = [(k, f"text {k} " * 40, "en", "s", 1, 1) for k in range(1200)] + [(5000, "again " * 60, "en", "s", 1, 1)] * 600
    spark.createDataFrame(docs, SCHEMAS["documents"]).write.parquet(f"{tmp_path}/documents.parquet")
    load = Counter()
    for r in entry.queries()["op2_virtual_slots"](spark, str(tmp_path)).collect():
        load[r.shard] += r["size"]
    assert len(load) == 8 and max(load.values()) - min(load.values()) <= 64 * 361


def test_personal_data_rows(got):
    want = []
    for i, t, *_ in tables()["documents"]:
        found = brute_pii(t)
        n = Counter(x.split(":")[0] for x in found)
        want.append((i, n["email"], n["ip"], n["card"], n["phone"], sha(",".join(found).encode())))
    rows = got["op3_bootstrapped_pii"]
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows) == Counter(want)
    texts = {i: t for i, t, *_ in tables()["documents"]}
    assert all(set(brute_pii(texts[r.doc_id])) <= set(r.spans.split(",")) | {""} for r in rows)


def test_token_rows(got):
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.rank_file(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = Counter()
    for i, t, *_ in tables()["documents"]:
        ids = lib.encode_ordinary(t or "")
        want[i, len(ids), sha(np.asarray(ids, "<u4").tobytes()), sha((t or "").encode())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got["op5_byte_bpe"]) == want


def test_component_rows(got):
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got["op6_partenum_components"]) == Counter(brute_components([d[:2] for d in tables()["documents"]]))


def test_piece_count_rows(got):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    pieces = [sp.id_to_piece(k) for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k))]
    begins, later = {p[1:] for p in pieces if p[0] == "▁" and "▁" not in p[1:]}, {p for p in pieces if "▁" not in p}

    def greedy(word):
        at = n = 0
        while at < len(word):
            end = next((e for e in range(min(len(word), at + 20), at, -1) if word[at:e] in (later if at else begins)), None)
            if end is None:
                return -1
            at, n = end, n + 1
        return n

    want = Counter()
    for i, t, *_ in tables()["documents"]:
        c = [greedy(w) for w in (t or "").split()]
        want[i, len(c), sum(map(abs, c)), sum(x < 0 for x in c)] += 1
    assert Counter((r.doc_id, r.n_words, r.n_tokens, r.n_unknown) for r in got["op7_word_piece_counts"]) == want


def test_toxicity_rows(got):
    docs, out = tables()["documents"], got["op8_factorization_machine"]
    assert Counter(r.doc_id for r in out) == Counter(d[0] for d in docs)
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def check_pieces(out, ids):
    """ids: document id -> its token ids, one entry for each of its rows."""
    by, held = {}, Counter()
    for r in out:
        by.setdefault(r.sequence_id, []).append(r)
        assert any(r.ids_crc32 == crc(x[r.start:r.start + r.length]) and r.doc_tokens == len(x) for x in ids[r.doc_id])
        held[r.doc_id] += r.length
    assert held == Counter({i: sum(map(len, x)) for i, x in ids.items()})
    for pieces in by.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096


def test_packing_rows(got):
    ids = {}
    for i, t, *_ in tables()["documents"]:
        ids.setdefault(i, []).append(word_ids(t))
    check_pieces(got["op9_cutting_stock"], ids)


def test_search_queries_equal_sql(spark, folder):
    db = duckdb.connect()
    for t in SCHEMAS:
        db.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    for name in ("op4_pivot_distance", "op11_max_sketches", "op12_sequence_trie"):
        cur = db.execute(entry.oracle_sql()[name])
        df = entry.queries()[name](spark, folder).select(*[d[0] for d in cur.description])
        assert Counter(map(tuple, df.collect())) == Counter(cur.fetchall()), name


def test_pipeline_run(spark, folder):
    """Rows of run() from scores, brute-force groups, plain masking and the tokenizer's own ids."""
    docs = [d[:2] for d in tables()["documents"]]
    score = {}
    for r in entry.queries()["op8_factorization_machine"](spark, folder).collect():
        score[r.doc_id] = max(score.get(r.doc_id, 0.0), r.score)
    kept = [d for d in docs if score[d[0]] < 0.5]
    keep, ids = Counter(), {}
    groups = brute_components(kept)
    for (i, t), (_, n, c) in zip(kept, groups):
        if not n or (i == c and not keep[c]):
            keep[c] += n > 0
            text = t
            if t:
                for kind, a, b in sorted((x.split(":") for x in brute_pii(t)), key=lambda x: -int(x[1])):
                    text = text[:int(a)] + f"[{kind.upper()}]" + text[int(b):]
            ids.setdefault(i, []).append(word_ids(text))
    out = corpus_pipeline.run(spark, folder).collect()
    check_pieces(out, ids)


def test_empty_tables(spark, tmp_path):
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in [*QUERIES, "pipeline"]:
        assert entry.queries()[name](spark, str(tmp_path)).count() == 0, name


def test_archive_of_repeats_over_many_shards(spark, tmp_path, monkeypatch):
    """One id fills several shards, rows repeated wholly travel as parts, and a second run of a shard leaves the same file."""
    monkeypatch.setattr(warc, "REPEATS", 8)
    pages = spark.createDataFrame([(5, f"http://a/{k}", f"text {k}") for k in range(60)] + [(5, "http://same/", "again")] * 45 + [(k, None, "x") for k in (1, 9, 9)], "page_id long, url string, html string")
    manifest = warc.write_warc(pages, f"file://{tmp_path}/w", shards=12, roll_bytes=1 << 20).collect()
    back = warc.read_warc(spark, f"file://{tmp_path}/w").collect()
    assert Counter((r.page_id, r.url) for r in back) == Counter((r.page_id, r.url) for r in pages.collect())
    assert max(m.records for m in manifest) < 40 and len({m.shard for m in manifest}) > 6
    assert [m for m in warc.write_warc(pages.repartition(5), f"file://{tmp_path}/w", shards=12, roll_bytes=1 << 20).collect() if m not in manifest] == []
    one, two = warc.ShardFile(f"file://{tmp_path}", 1, 0), warc.ShardFile(f"file://{tmp_path}", 1, 0)
    for f in (one, two):
        f.add(b"record")
    assert one.close() == two.close() and (tmp_path / one.name).read_bytes() == warc.gzip.compress(b"record", 6, mtime=0)


def test_forest_recall_on_the_given_vectors(spark):
    """At least 0.9 of the true neighbours among vectors of 64 dimensions without structure."""
    sf = "/root/testdata/sf0.01"
    e = [(r.vec_id, np.asarray(r.embedding, float)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ids, x = np.asarray([i for i, _ in e]), np.stack([v for _, v in e])
    found = {(r.query_id, r.vec_id) for r in entry.queries()["op10_projection_forest"](spark, sf).collect()}
    want = {(i, ids[j]) for i, v in e if i % 20 == 0 for j in [j for j in np.lexsort((ids, -(x @ v))) if ids[j] != i][:20]}
    assert x.shape[1] == 64 and len(found & want) >= 0.9 * len(want)
