"""Near-duplicate components under a Jaccard threshold over word shingles, by PartEnum signatures.

Sizes fall into bands; two sets that reach the threshold lie in one band or in neighbouring ones, and differ in
at most k elements, where k follows from the band. The domain of elements is cut by hash into more than k parts,
so two such sets agree on some part wholly: the part's content is a signature of the set. Enough parts are taken
that a set nearly always has more than k parts with elements in them, and then an agreement on a part with
elements is certain; the other sets repeat the step with other cuts and at last sign their empty parts too.

Sets are compared exactly afterwards. Equal sets are one class from the start. More parts than k + 1 mean that a
linked pair shares several signatures; pairs that share too few are dropped, counted where a signature is rare
and bounded by the number of a set's common signatures where it is not. What is left forms clusters; a cluster
of usual size is compared inside one task through an inverted index. A large cluster is
thinned first by comparing each class with a few neighbours that many share; what is not in the largest component
then is compared, in cells of bounded size, with the classes that share one of their rarest elements. No pair is ever
a row, and none is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from rainloom.llm.common import parts, query, slices, table, text_or_empty
from rainloom.llm.graph import components
from rainloom.session import cut_lineage

WIDTH, PERCENT, SEEDS = 5, 80, 4
#: Sets that share a rare signature at most; their pairs are counted. Common signatures are followed by stars.
RARE = 8
#: Classes of a cluster that are compared in one task, members and probes of a cell, and ids that may be broadcast.
SMALL, MEMBERS, PROBES, BROADCAST_IDS, HUBS = 256, 256, 1024, 500_000, 3
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hashes of words, emptied when it holds `most`."""

    most = 1 << 18

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


WORDS = Words()


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles: ASCII letters in lower case, words between ASCII white space; a shorter text is one shingle."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(WORDS) > WORDS.most:
        WORDS.clear()
    h = np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, np.uint64(min(len(h), width)))
    for k in range(min(width, len(h))):
        out = (out * ODD + h[k:k + n]) * ODD
    return np.unique(mix(out))


def bands(percent: int = PERCENT, most: int = 1 << 40) -> np.ndarray:
    """Largest size of each band: a set and any set that reaches the threshold with it differ by one band at most."""
    out, low = [], 1
    while low < most:
        out.append(low * 100 // percent)
        low = out[-1] + 1
    return np.asarray(out, np.int64)


BANDS = bands()


def cut(band: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Most differing elements k of a pair whose smaller set lies in the band, and the number of parts."""
    k = BANDS[band] * (100 - percent) // percent
    return k, np.where(k == 0, 1, k + 2 + -(-k // 5))


def signatures(ids: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signature, id and least number of shared signatures of each set, for its own band and the one below.

    In bands whose sets must be equal (k = 0) there is nothing to sign.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    own = np.searchsorted(BANDS, size)
    sig, who, need = [], [], []
    for lower in (0, 1):
        band = own - lower
        todo = np.flatnonzero((size > 0) & (band >= 0))
        k, n = cut(np.maximum(band, 0))
        todo = todo[k[todo] > 0]
        start = np.cumsum(size) - size
        for seed in range(SEEDS):
            if not len(todo):
                break
            m = size[todo]
            row = np.repeat(np.arange(len(todo)), m)
            at = np.repeat(start[todo] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            h = flat[at]
            base = np.cumsum(n[todo]) - n[todo]
            place = ((mix(h + np.uint64(seed + 1) * ODD) >> np.uint64(32)) * n[todo].astype(np.uint64)[row] >> np.uint64(32)).astype(np.int64)
            slot = base[row] + place
            order = np.argsort(slot, kind="stable")
            first = np.flatnonzero(np.diff(slot[order], prepend=-1))
            full = slot[order][first]
            held = row[order][first]
            content = np.add.reduceat(mix(h[order] ^ ODD), first)
            filled = np.bincount(held, minlength=len(todo))
            where = ((band[todo][held] * SEEDS + seed).astype(np.uint64) << np.uint64(40)) + (full - base[held]).astype(np.uint64)
            share = filled - k[todo]
            sig.append(mix(content + mix(where + ODD)))
            who.append(ids[todo][held])
            need.append(np.where((seed == 0) & (share > 0), share, 1)[held])
            weak = np.flatnonzero(share < 1)
            if seed == SEEDS - 1 and len(weak):
                there = np.zeros(int(n[todo].sum()), bool)
                there[full] = True
                for w in weak.tolist():
                    empty = np.flatnonzero(~there[base[w]:base[w] + n[todo[w]]]).astype(np.uint64)
                    sig.append(mix(mix((np.uint64(int(band[todo[w]]) * SEEDS + seed) << np.uint64(40)) + empty) + np.uint64(1)))
                    who.append(np.full(len(empty), ids[todo[w]]))
                    need.append(np.ones(len(empty), np.int64))
            todo = todo[weak]
    if not sig:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(sig), np.concatenate(who), np.concatenate(need)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def set_id(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and the two fingerprints f1, f2 of each row's set (null without words)."""
    def run(batches):
        for b in slices(batches):
            got = [shingles(t) for t in b.column("text").to_pylist()]
            f1 = [set_id(s) if len(s) else None for s in got]
            f2 = [int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), 1)).view(np.int64)) if len(s) else None for s in got]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_text_hash"), pa.array([len(s) for s in got], pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64())],
                                             ["doc_id", "_text_hash", "n_shingles", "f1", "f2"])

    d = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).withColumn("_text_hash", F.xxhash64("text"))
    return d.mapInArrow(run, "doc_id long, _text_hash long, n_shingles long, f1 long, f2 long")


def shared(docs: DataFrame) -> DataFrame:
    """What sets share: rows a, b, n, need for pairs under rare signatures (n of them in this task), and rows
    sig, id, 0, need for the members of common ones.

    A task sends each (signature, set) once, however many copies of the set it reads. A rare signature has RARE
    sets at most, so pairs grow with the rows.
    """
    def sign(batches):
        for b in slices(batches):
            got = {set_id(s): s for s in map(shingles, b.column("text").to_pylist()) if len(s)}
            sig, who, need = signatures(np.fromiter(got, np.int64, len(got)), list(got.values()))
            yield pa.RecordBatch.from_arrays([pa.array(signed(sig)), pa.array(who), pa.array(need.astype(np.int32))], ["sig", "id", "need"])

    def meet(batches):
        # Rows come sorted by signature. What is held over to the next batch is a signature with RARE sets at most;
        # of a common one only its name is kept, and its further members go out as they come.
        kept, common, last = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)], None, None
        for b in batches:
            if not b.num_rows:
                continue
            sig, who, need = (np.concatenate([k, b.column(c).to_numpy(zero_copy_only=False)]) for k, c in zip(kept, ("sig", "id", "need")))
            fresh = np.append(sig[0] != common or who[0] != last, (sig[1:] != sig[:-1]) | (who[1:] != who[:-1]))
            rows = [x[fresh] for x in (sig, who, need)]
            cut = int(np.searchsorted(rows[0], sig[-1]))
            if sig[-1] == common or len(rows[0]) - cut > RARE:
                yield from met(*rows, common)
                kept, common, last = [x[:0] for x in rows], sig[-1], who[-1]
            else:
                yield from met(*(x[:cut] for x in rows), common)
                kept, common, last = [x[cut:] for x in rows], None, None
        yield from met(*kept, None)

    d = docs.select(text_or_empty().alias("text"))
    signed_rows = d.mapInArrow(sign, "sig long, id long, need int").repartition(parts(docs.sparkSession), "sig").sortWithinPartitions("sig", "id")
    return signed_rows.mapInArrow(meet, "a long, b long, n int, need int")


def met(sig: np.ndarray, who: np.ndarray, need: np.ndarray, common):
    """Rows of shared() for whole groups of sorted signatures; `common` names one that is known to be common."""
    if not len(sig):
        return
    start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
    size = np.diff(np.append(start, len(sig)))
    many = (size > RARE) | (sig[start] == common)
    a, b, least = [], [], []
    for c in range(2, RARE + 1):
        at = start[(size == c) & ~many][:, None] + np.arange(c)
        for x in range(c if len(at) else 0):
            for y in range(x + 1, c):
                a.append(who[at[:, x]])
                b.append(who[at[:, y]])
                least.append(np.maximum(need[at[:, x]], need[at[:, y]]))
    if a:
        a, b, least = map(np.concatenate, (a, b, least))
        order = np.lexsort((b, a))
        a, b, least = a[order], b[order], least[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        yield from rows_of(a[first], b[first], np.diff(np.append(first, len(a))), np.minimum.reduceat(least, first))
    member = np.repeat(many, size)
    if member.any():
        yield from rows_of(sig[member], who[member], np.zeros(int(member.sum()), np.int64), need[member])


def rows_of(a: np.ndarray, b: np.ndarray, n: np.ndarray, need: np.ndarray, most: int = 1 << 18):
    for k in range(0, len(a), most):
        s = slice(k, k + most)
        yield pa.RecordBatch.from_arrays([pa.array(a[s]), pa.array(b[s]), pa.array(n[s].astype(np.int32)), pa.array(need[s].astype(np.int32))], ["a", "b", "n", "need"])


def candidates(s: DataFrame) -> DataFrame:
    """Edges a, b over shared(): within their clusters lies every linked pair.

    A linked pair shares `need` signatures at least. What it can share under common ones is bounded by the
    number of these that either set has; a pair that meets under common ones alone needs that many of them.
    """
    common = s.where("n = 0")
    held = cut_lineage(common.groupBy(F.col("b").alias("id")).agg(F.count("*").alias("h"), F.min("need").alias("least")))
    rare = s.where("n > 0").groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("need").alias("need"))
    of = lambda c: held.select(F.col("id").alias(c), F.col("h").alias("h_" + c))
    rare = rare.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.col("n") + F.least(F.coalesce("h_a", F.lit(0)), F.coalesce("h_b", F.lit(0))) >= F.col("need"))
    often = common.join(held.where("h >= least").select(F.col("id").alias("b")), "b").select(F.col("a").alias("sig"), F.col("b").alias("a"))
    lead = often.groupBy("sig").agg(F.min("a").alias("b"))
    stars = often.join(lead, "sig").select("a", "b").where("a <> b")
    return rare.select("a", "b").unionByName(stars).distinct()


def links_in(keys: np.ndarray, sets: list[np.ndarray], probe: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """For each probed row the first other row that it reaches the threshold with, and likewise the last, as pairs of keys."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    a, b = [], []
    for x in probe.tolist():
        lo, hi = np.searchsorted(flat, sets[x]), np.searchsorted(flat, sets[x], side="right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        same = np.bincount(row[at], minlength=len(sets))
        ok = 100 * same >= percent * (size[x] + size - same)
        ok[x] = False
        for y in np.flatnonzero(ok).tolist():
            a.append(keys[x])
            b.append(keys[y])
    return np.asarray(a, np.int64), np.asarray(b, np.int64)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[list, list]:
    """Enough of the links to keep their components: at most one for each vertex."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return [x for x, _ in out], [y for _, y in out]


def compare(cells: DataFrame) -> DataFrame:
    """Links a, b inside each cell (rows: cell, id, probe, elements): every probed row against all rows of its cell."""
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, first = np.unique(t.column("id").to_numpy(), return_index=True)
        probe = np.isin(ids, t.column("id").to_numpy()[t.column("probe").to_numpy(zero_copy_only=False)])
        column = t.column("elements")
        sets = [column[int(k)].values.to_numpy(zero_copy_only=False) for k in first]
        a, b = spanning(*links_in(ids, sets, np.flatnonzero(probe)))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cells.groupBy("cell").applyInArrow(run, "a long, b long")


def fetch_sets(docs: DataFrame, rows: DataFrame, sized: DataFrame) -> DataFrame:
    """sized (id, label, n) with the elements of each id. rows: classes(). One row of each class is read again; up to
    BROADCAST_IDS ids are broadcast, which spares the texts a shuffle, more are joined by shuffle."""
    first = rows.where("f1 is not null").groupBy(F.col("f1").alias("id")).agg(F.min("_text_hash").alias("_text_hash"))
    want = cut_lineage(first.join(sized.select("id"), "id"))
    hashes = want.select("_text_hash").distinct()
    if want.count() <= BROADCAST_IDS:
        hashes = F.broadcast(hashes)
    d = docs.select(text_or_empty().alias("text")).withColumn("_text_hash", F.xxhash64("text")).join(hashes, "_text_hash", "left_semi").select("text")

    def run(batches):
        for b in slices(batches):
            got = {set_id(s): s for s in map(shingles, b.column("text").to_pylist()) if len(s)}
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array([signed(s).tolist() for s in got.values()], pa.list_(pa.int64()))], ["id", "elements"])

    return d.mapInArrow(run, "id long, elements array<long>").groupBy("id").agg(F.first("elements").alias("elements")).join(sized, "id")


def links(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Enough links a, b between different sets (by f1) to give every component of the similarity join."""
    near = cut_lineage(candidates(cut_lineage(shared(docs))))
    cluster = components(near)
    sized = cut_lineage(cluster.join(cluster.groupBy("label").agg(F.count("*").alias("n")), "label").select(F.col("v").alias("id"), "label", "n"))
    sets = cut_lineage(fetch_sets(docs, rows, sized))
    found = compare(sets.where(F.col("n") <= SMALL).select(F.col("label").cast("string").alias("cell"), "id", F.lit(True).alias("probe"), "elements"))
    large = sets.where(F.col("n") > SMALL)
    if large.limit(1).count():
        found = found.unionByName(large_links(large, near))
    return found


def large_links(large: DataFrame, near: DataFrame) -> DataFrame:
    """Links of clusters too large for a task.

    Each class is compared with its HUBS neighbours of most neighbours first. What then is not in the largest
    component of its cluster (loose) is compared with those of the cluster that can reach the threshold with it: the
    cluster is parted by kindred(), and a part is compared in cells of MEMBERS by PROBES classes. Cells are exploded,
    which Spark's size estimates do not see, so their joins are kept from being broadcast.
    """
    both = near.join(large.select(F.col("id").alias("a")), "a", "left_semi")
    both = cut_lineage(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    degree = both.groupBy("b").agg(F.count("*").alias("d"))
    turn = F.row_number().over(W.partitionBy("a").orderBy(F.desc("d"), "b"))
    hub = cut_lineage(both.join(degree, "b").withColumn("_t", turn).where(F.col("_t") <= HUBS).select("a", "b"))
    block = F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / PROBES)).cast("int").alias("k")
    asked = cut_lineage(hub.join(hub.groupBy("b").agg(F.count("*").alias("n")), "b").select("a", "b", block))
    cell = F.concat_ws(":", "b", "k").alias("cell")
    members = asked.select(cell, F.col("b").alias("id"), F.lit(False).alias("probe")).distinct()
    cells = members.unionByName(asked.select(cell, F.col("a").alias("id"), F.lit(True).alias("probe")))
    sets = large.select("id", "elements").hint("merge")
    first = cut_lineage(compare(cells.join(sets, "id").select("cell", "id", "probe", "elements")))
    part = components(first)
    sized = part.groupBy(F.col("label").alias("part")).agg(F.count("*").alias("m"))
    whole = large.select("id", "label").join(part.select(F.col("v").alias("id"), F.col("label").alias("part")), "id", "left").join(sized, "part", "left")
    whole = whole.withColumn("part", F.coalesce("part", "id")).withColumn("m", F.coalesce("m", F.lit(1)))
    best = whole.groupBy("label").agg(F.max(F.struct("m", F.col("part").alias("p"))).alias("best"))
    whole = cut_lineage(whole.join(best, "label").select("id", "label", (F.col("part") != F.col("best.p")).alias("loose")))
    parted = components(kindred(whole.join(sets, "id")))
    rest = whole.select("id", "loose").join(parted.select(F.col("v").alias("id"), "label"), "id")
    todo = rest.join(rest.groupBy("label").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("rows"), F.ceil(F.count_if("loose") / PROBES).cast("int").alias("cols")), "label")
    todo = cut_lineage(todo.where("cols > 0"))
    spot = F.xxhash64("id", F.lit(1))
    members = todo.select("id", "label", F.pmod(spot, F.col("rows")).cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("c"), F.lit(False).alias("probe"))
    probes = todo.where("loose").select("id", "label", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"), F.pmod(spot, F.col("cols")).cast("int").alias("c"), F.lit(True).alias("probe"))
    cells = members.unionByName(probes).select(F.concat_ws(":", "label", "r", "c").alias("cell"), "id", "probe")
    return first.unionByName(compare(cells.join(sets, "id").select("cell", "id", "probe", "elements")))


def kindred(sets: DataFrame) -> DataFrame:
    """Edges a, b over the sets of large clusters (id, label, loose, elements): within their components lies every linked pair with a loose set.

    The elements of a cluster are ordered by the number of its sets that hold them. Two sets that reach the threshold
    share one of their first n - ceil(n * PERCENT / 100) + 1 elements in that order, or else too few would be left.
    Those that no other set holds come first and only take up room; a passage that all sets hold comes last.
    """
    by = W.partitionBy("label", "e")
    held = sets.select("label", "id", "loose", F.size("elements").alias("n"), F.explode("elements").alias("e")).withColumn("c", F.count("*").over(by))
    common = held.where("c > 1").groupBy("label", "id", "loose", "n").agg(F.sort_array(F.collect_list(F.struct("c", "e"))).alias("e"))
    first = common.withColumn("p", F.size("e") + 1 - F.expr(f"int((n * {PERCENT} + 99) div 100)")).where("p > 0")
    first = first.select("label", "id", "loose", F.explode(F.slice("e", 1, F.col("p"))).alias("e")).select("label", "id", "loose", F.col("e.e").alias("e"))
    met = first.withColumn("b", F.min("id").over(by)).withColumn("some", F.max("loose").over(by))
    return met.where("some and id <> b").select(F.col("id").alias("a"), "b").distinct()


def grouped(docs: DataFrame) -> DataFrame:
    """classes() of docs with the group of each row (null without words) and component_id, the group's smallest doc_id."""
    rows = cut_lineage(classes(docs))
    own = rows.where("f1 is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("first"))
    label = components(links(docs, rows)).select(F.col("v").alias("f1"), "label")
    tagged = cut_lineage(own.join(label, "f1", "left"))
    least = tagged.where("label is not null").groupBy("label").agg(F.min("first").alias("least"))
    named = tagged.join(least, "label", "left").select("f1", "f2", F.coalesce("label", "f1").alias("group"), F.coalesce("least", "first").alias("component_id"))
    return rows.join(cut_lineage(named), ["f1", "f2"], "left")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs.

    component_id is the smallest doc_id that links reach, the row's own included; rows without words have their
    own doc_id. Rows with a null doc_id link as others do but never name a component unless it has no other id
    (then null). Repeated rows give a row each; an empty table gives none.
    """
    return grouped(docs).select("doc_id", "n_shingles", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group, that with the smallest doc_id (null last), with all its columns; rows without words stay.

    Rows that go are found by id and text hash, so texts are not shuffled while the ids that stay number
    BROADCAST_IDS at most. Of rows that repeat a whole id and text one stays.
    """
    g = cut_lineage(grouped(docs).select("doc_id", "_text_hash", "group"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_text_hash")
    first = cut_lineage(g.where("group is not null").groupBy("group").agg(F.min(order).alias("k"), F.count("*").alias("n")).select(F.col("k.doc_id").alias("_id"), F.col("k._text_hash").alias("_hash")))
    d = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("_text_hash"), F.regexp_like(text_or_empty(), F.lit("[^ \\t-\\r]")).alias("_some"), F.struct("*").alias("_row"))
    few = F.broadcast(first) if first.count() <= BROADCAST_IDS else first
    kept = d.where("_some").join(few, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left_semi")
    again = g.groupBy("doc_id", "_text_hash").agg(F.count("*").alias("n")).where("n > 1").join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left_semi")
    again = cut_lineage(again.select("_text_hash").distinct())
    if again.limit(1).count():
        twice = kept.join(again, "_text_hash", "left_semi").groupBy("doc_id", "_text_hash").agg(F.first("_row").alias("_row"))
        kept = kept.join(again, "_text_hash", "left_anti").select("_row").unionByName(twice.select("_row"))
    return kept.select("_row.*").unionByName(d.where("not _some").select("_row.*"))


@query("op6_partenum_components")
def partenum_components(spark, sf):
    """Components of all documents at a Jaccard similarity of 0.8 over five-word shingles."""
    return near_duplicates(table(spark, sf, "documents"))
