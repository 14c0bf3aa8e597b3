"""WARC files, slots, toxicity, near duplicates, searches and the pipeline against plain versions."""

import base64
import hashlib
import os
import random

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from rainloom import session
from rainloom.llm import forest, jaccard, pivots, slots, toxicity, warc
from rainloom.llm.common import slices
from tests.llm.helpers import brute_components, brute_pii, documents, empty


def pages(spark, extra=()):
    rows = [(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, None, ""), (4, "http://c/é\n", None), (5, "http://d/", "é" * 50_000), (6, "http://e/", "<p>x</p>"), (7, "u", "only\r\n\r\nWARC/1.1\r\n"), (None, "n", "null id"), *extra]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    p = pages(spark, [(k, f"http://z/{k}", f"page {k} " * 50) for k in range(10, 60)])
    manifest = warc.write_warc(p, folder, shards=3, roll_bytes=600)
    back = {r.page_id: r for r in warc.read_warc(spark, folder).collect()}
    assert manifest.agg({"records": "sum"}).first()[0] == p.count() == len(back) and manifest.count() > 3
    assert not [f for f in os.listdir(f"{tmp_path}/w") if f.startswith("_temporary")]
    for r in p.collect():
        data = (r.html or "").encode()
        got = back[r.page_id]
        assert got.payload_bytes == len(data) and got.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        if got.record_type == "response":
            assert bytes(got.payload) == data and got.refers_to is None
    assert [back[k].refers_to for k in (1, 2, 6)] == [6, 6, None] and back[3].refers_to == 4
    names = sorted(f for f in os.listdir(f"{tmp_path}/w") if f.endswith(".gz"))
    first = {f: hashlib.sha256(open(f"{tmp_path}/w/{f}", "rb").read()).hexdigest() for f in names}
    warc.write_warc(p.repartition(7), f"file://{tmp_path}/again", shards=3, roll_bytes=600)
    assert first == {f: hashlib.sha256(open(f"{tmp_path}/again/{f}", "rb").read()).hexdigest() for f in names}


def test_warc_limits_and_leftovers(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/w"
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    warc.write_warc(pages(spark), folder, shards=1, min_revisit_bytes=1)
    open(f"{tmp_path}/w/part-000009-00000.warc.gz", "wb").write(b"left by a lost task")
    back = {r.page_id: r for r in warc.read_warc(spark, folder).collect()}
    assert back[3].record_type == back[4].record_type == "response" and back[1].refers_to == 6 and len(back) == 8
    warc.write_warc(empty(pages(spark)), f"file://{tmp_path}/none", shards=2)
    assert warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0


def test_slots_place_every_row_once(spark):
    docs = documents(spark, [f"text {k} " * (k % 17) for k in range(300)])
    docs.createOrReplaceTempView("slot_docs")
    d = spark.sql("select doc_id, octet_length(coalesce(text, '')) + 1L as size, crc32(cast(coalesce(text, '') as binary)) as text_crc32 from slot_docs")
    d = slots.with_slot(d, "doc_id", "text_crc32")
    sizes = slots.slot_sizes(d)
    shard_map = slots.deal(sizes, 4)
    m = spark.createDataFrame([(s, k) for s, k in shard_map.items()], "virtual_slot int, shard int")
    rows = slots.place(d, m, "doc_id", "text_crc32").collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
        assert shard_map[r.virtual_slot] == r.shard
    assert len(rows) == 302 and all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    total = [sum(r.size for r in v) for v in by.values()]
    assert max(total) - min(total) <= max(s for s, _ in sizes.values())


def test_rebalance_moves_little_and_versions_stay(spark, tmp_path):
    r = random.Random(3)
    sizes = {s: (r.randint(1, 100), 1) for s in range(slots.SLOTS)}
    old = slots.deal(sizes, 8)
    assert slots.rebalance(old, sizes, 8) == old
    grown = slots.rebalance(old, sizes, 9)
    load = [sum(sizes[s][0] for s in grown if grown[s] == k) for k in range(9)]
    assert max(load) - min(load) < 0.05 * sum(load) / 9 and all(grown[s] == old[s] or grown[s] == 8 for s in old)
    fewer = slots.rebalance(old, sizes, 7)
    assert all(fewer[s] == old[s] for s in old if old[s] < 7) and max(fewer.values()) == 6
    slots.store_map(spark, str(tmp_path), 1, old, sizes)
    assert {x.virtual_slot: x.shard for x in slots.store_map(spark, str(tmp_path), 2, grown, sizes).collect()} == grown
    assert {x.virtual_slot: x.shard for x in slots.load_map(spark, str(tmp_path), 1).collect()} == old


def toxic_rows(n=600, seed=5):
    """Label 1 where an insult and a group stand together; either alone is clean."""
    r, rows = random.Random(seed), []
    for k in range(n):
        words = [f"w{r.randint(0, 300)}" for _ in range(30)]
        kind = k % 4
        words += (["insult"] if kind in (1, 3) else []) + (["group"] if kind in (2, 3) else [])
        r.shuffle(words)
        rows.append((k, " ".join(words), int(kind == 3)))
    return rows


def test_machine_learns_a_pair_that_no_sum_of_weights_can():
    rows = toxic_rows()
    held = toxicity.TermCounter()
    keep = sorted(toxicity.terms("insult") | toxicity.terms("group"))
    x = np.zeros((len(rows), len(keep)))
    for k, (_, text, _) in enumerate(rows):
        x[k] = np.isin(keep, held.of(text))
    y = np.asarray([r[2] for r in rows], float)
    both = toxicity.fit(x[:400], y[:400], epochs=120)
    sums = x[400:] @ both["v"]
    z = both["bias"] + x[400:] @ both["w"] + 0.5 * ((sums ** 2).sum(1) - x[400:] @ (both["v"] ** 2).sum(1))
    assert ((z > 0) == y[400:]).mean() > 0.99


def test_toxicity_held_out(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t, None) for i, t, _ in rows] + [(None, None, "x"), (7, "", "y")], "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels.where("doc_id < 450 or doc_id is null"))
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs.where("text != ''"), model).collect()}
    right = [(got[i] >= 0.5) == bool(y) for i, _, y in rows[450:]]
    assert np.mean(right) > 0.8 and toxicity.score(docs, model).count() == 602 and toxicity.score(empty(docs), model).count() == 0
    alone = toxicity.train(docs, empty(labels))
    assert all(r.toxicity < 0.01 for r in toxicity.score(docs, alone).collect())


def copies(seed=1, n=60):
    r, out = random.Random(seed), []
    for f in range(n):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.choice([1, 3, 5, 6, 8, 9, 10, 14, 30, 80, 200]))]
        out.append(" ".join(base))
        for _ in range(r.randint(0, 3)):
            v = list(base)
            for _ in range(r.randint(0, max(1, len(v) // 25))):
                v[r.randrange(len(v))] = f"n{r.randint(0, 9)}"
            out.append(("  " if r.random() < 0.5 else "").join(["", ""]) + " ".join(v).upper())
        if r.random() < 0.3:
            out.append(" ".join(base + ["tail"]))
    return out


def check_near(spark, texts):
    docs = documents(spark, texts)
    got = sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect())))
    assert got == sorted(map(str, brute_components([(r.doc_id, r.text) for r in docs.collect()])))


def test_near_duplicates_match_brute_force(spark):
    check_near(spark, copies() + ["", None, " \t", "same", "Same", "x " * 3000])


def test_large_clusters_in_cells(spark, monkeypatch):
    for k, v in {"SMALL": 2, "MEMBERS": 3, "PROBES": 2, "BROADCAST_IDS": 0, "RARE": 3}.items():
        monkeypatch.setattr(jaccard, k, v)
    r = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    family = []
    for k in range(40):
        v = list(base)
        for _ in range(r.randint(0, 3)):
            v[r.randrange(60)] = f"n{k}"
        family.append(" ".join(v))
    check_near(spark, family + copies(4, 10))


def test_a_common_passage_does_not_make_all_pairs(spark, monkeypatch):
    """documents that share a passage but are no copies lie in one large cluster; its cells, which were broadcast, grew with the square of it."""
    for k, v in {"SMALL": 20, "MEMBERS": 8, "PROBES": 8, "RARE": 3}.items():
        monkeypatch.setattr(jaccard, k, v)
    r, rows, compare = random.Random(3), [], jaccard.compare
    passage = " ".join(f"p{k}" for k in range(64))
    texts = [" ".join([passage, *(f"t{i}x{k}" for k in range(20))]) for i in range(120)]
    for i in range(12):
        words = texts[10 * i].split()
        words[66 + i] = "new"
        texts.append(" ".join(words))
    r.shuffle(texts)

    def counted(cells):
        rows.append(cells.count())
        assert "BroadcastExchange" not in cells._jdf.queryExecution().executedPlan().toString() or len(rows) == 1
        return compare(cells)

    monkeypatch.setattr(jaccard, "compare", counted)
    check_near(spark, texts)
    assert len(rows) == 3 and rows[2] < len(texts)


@pytest.mark.parametrize("size", [4, 5, 9, 23, 90, 333])
def test_signatures_meet_for_every_linked_pair(size):
    """Pairs at the threshold share a signature, and as many as each asks for."""
    r = np.random.default_rng(size)
    for trial in range(200):
        pool = r.integers(0, 2**63, 2 * size, dtype=np.uint64)
        gone = r.integers(0, size // 9 + 1)
        a = np.unique(pool[:size])
        b = np.unique(np.concatenate([pool[gone:size], pool[size:size + r.integers(0, size // 9 + 1)]]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * len(np.union1d(a, b)) or both == len(a) == len(b):
            continue
        sig, who, need = jaccard.signatures(np.asarray([1, 2]), [a, b])
        common = np.intersect1d(sig[who == 1], sig[who == 2])
        assert len(common) >= max(1, need[who == 1].min(), need[who == 2].min())


def test_no_rows_and_no_words(spark):
    docs = documents(spark)
    assert jaccard.near_duplicates(empty(docs)).count() == 0 and jaccard.keep_one(empty(docs)).count() == 0
    assert jaccard.near_duplicates(docs.where("text is null")).collect()[0].component_id == 1


def test_keep_one(spark):
    docs = documents(spark, copies(2, 20) + ["", None, "same", "same"])
    kept = jaccard.keep_one(docs)
    brute = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    want = {c for _, n, c in brute if n} | {i for i, n, _ in brute if not n}
    assert kept.columns == docs.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, want))


def vectors(spark, n=400, width=8, seed=2):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, width)).astype(np.float32)
    x[50:120] = x[50]
    return x, spark.createDataFrame([(int(k), x[k].tolist()) for k in range(n)], "id long, v array<double>")


def brute_top(x, queries, k):
    x = x.astype(float)
    ids = np.arange(len(x))
    out = set()
    for i in queries:
        s = (x * x[i]).sum(1)
        out |= {(i, rank + 1, int(j)) for rank, j in enumerate([j for j in np.lexsort((ids, -s)) if j != i][:k])}
    return out


def test_pivot_search_is_exact(spark, monkeypatch):
    from rainloom.llm import search

    monkeypatch.setattr(search, "MEMBERS", 16)
    monkeypatch.setattr(search, "GROUP", 4)
    x, df = vectors(spark)
    got = {(r.query_id, r.rank, r.vec_id) for r in pivots.top_k(df, df.where("id % 20 = 0 or id = 60"), 5).collect()}
    assert got == brute_top(x, [*range(0, 400, 20)] + [60] * (60 % 20 > 0), 5)
    few = df.where("id < 3")
    assert pivots.top_k(few, few, 5).count() == 6 and pivots.top_k(empty(df), empty(df), 5).count() == 0 and pivots.top_k(df, empty(df), 5).count() == 0
    assert pivots.top_k(df.unionByName(df), few, 5).count() == 15


def test_forest_ships_vectors_once(spark, monkeypatch):
    """vectors were written once a tree and again for every group of queries; a row that repeats fills no more than one rank."""
    x, df = vectors(spark, 300)
    x[150] *= 10
    rows = spark.createDataFrame([(k, x[k].tolist()) for k in [*range(300)] + [150] * 200], "id long, v array<double>")
    seen, ranked, written = [], forest.ranked, len(session.WRITTEN)
    monkeypatch.setattr(forest, "ranked", lambda best, k: seen.append(best.count()) or ranked(best, k))
    monkeypatch.setattr(forest, "ROWS", 64)
    monkeypatch.setattr(forest, "GROUP", 4)
    for held in (1 << 17, 5):
        monkeypatch.setattr(forest, "HELD", held)
        got = {(r.query_id, r.rank, r.vec_id) for r in forest.neighbours(rows, rows.where("id % 20 = 0"), 10, share=100.0).collect()}
        assert got == brute_top(x, range(0, 300, 20), 10)
        assert seen.pop() <= forest.SLICES * 15 * 10 and len(session.WRITTEN) == written


def test_forest_recall(spark):
    x, df = vectors(spark, 900, 16)
    got = forest.neighbours(df, df.where("id % 20 = 0"), 10)
    rows = {(r.query_id, r.rank, r.vec_id) for r in got.collect()}
    want = brute_top(x, range(0, 900, 20), 10)
    assert len({(a, c) for a, _, c in rows} & {(a, c) for a, _, c in want}) >= 0.9 * len(want) and len(rows) == 450
    for r in got.collect():
        assert abs(r.score - float((x[r.query_id].astype(float) * x[r.vec_id]).sum())) < 1e-12
    same = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(300)], "id long, v array<double>")
    assert [r.vec_id for r in forest.neighbours(same, same.where("id = 1"), 3).orderBy("rank").collect()] == [0, 2, 3]
    assert forest.neighbours(empty(df), empty(df), 3).count() == 0


def test_searches_leave_out_broken_vectors(spark, tmp_path):
    rows = [(k, [float(k), 1.0]) for k in range(60)] + [(60, None), (61, [1.0, None]), (62, [float("nan"), 1.0]), (63, [float("inf"), 1.0]), (100, [0.0, 0.0]), (None, [1.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    exact = entry.queries()["op4_pivot_distance"](spark, str(tmp_path)).collect()
    near = entry.queries()["op10_projection_forest"](spark, str(tmp_path)).collect()
    assert {r.query_id for r in exact} == {0, 50, 100} and {r.query_id for r in near} == {0, 20, 40}
    assert not {60, 61, 62, 63, None} & {r.vec_id for r in exact + near} and [r.vec_id for r in exact if r.query_id == 50] == [59, 58, 57, 56, 55]


def test_pipeline_stages(spark, tmp_path):
    rows = toxic_rows(240)
    r = random.Random(1)
    clean = [f"{' '.join(f'c{r.randint(0, 900)}' for _ in range(60))} mail me at u{k}@host{k}.example.com" for k in range(20)]
    docs = [(i, t, "en", "s", len(t)) for i, t, _ in rows] + [(1000 + k, t, "en", "s", len(t)) for k, t in enumerate(clean)] + [(2000 + k, t + " end", "en", "s", len(t)) for k, t in enumerate(clean[:5])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table = before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, table, str(tmp_path))
        after.write.parquet(f"{tmp_path}/{name}")
        table, last = spark.read.parquet(f"{tmp_path}/{name}"), table
        if name != "packing":
            assert table.columns == before.columns
        if name == "near_duplicates":
            want = {c for _, n, c in brute_components([(x.doc_id, x.text) for x in last.collect()])}
            assert {x.doc_id for x in table.collect()} == want and 2000 not in want
        if name == "personal_data":
            assert not any(brute_pii(x.text) for x in table.collect()) and all(x.n_chars == len(x.text) for x in table.collect()) and table.count() == last.count()
    assert {x.doc_id for x in table.collect()} == {x.doc_id for x in last.collect()} >= {1000 + k for k in range(20)}


def test_every_query_is_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names


def test_slices_hold_few_bytes_or_one_row():
    import pyarrow as pa

    b = pa.RecordBatch.from_pydict({"text": ["a" * n for n in (5, 5, 1, 50, 0, 3)] + [None], "k": list(range(7))})
    got = [x.column("k").to_pylist() for x in slices([b, b.slice(0, 0)], most=10)]
    assert got == [[0, 1], [2], [3], [4, 5, 6]]


def test_toxicity_does_not_follow_the_layout_and_bounds_rows(spark):
    """Equal scores under two layouts where a third of the table is one row, and a sample bounded in rows."""
    rows = toxic_rows(300)
    same = [rows[3][:2]] * 150
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + same + [(3, f"another text of one id {k}") for k in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    a, b = (toxicity.train(d, labels, selected=64) for d in (docs.coalesce(1), docs.repartition(9)))
    assert all(np.array_equal(a[k], b[k]) for k in a)
    assert toxicity.labelled(docs, labels, 1000).count() == 350 and toxicity.labelled(docs, labels, 40).count() == 40
    got = toxicity.score(docs, a)
    assert got.count() == docs.count() and got.where("doc_id = 3").select("text", "toxicity").distinct().count() == 51
