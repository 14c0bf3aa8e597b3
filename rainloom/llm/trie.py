"""Prefix trie of rebuilt conversations by collapsing whole sequences.

Turns travel as digests and byte counts; texts are read once and never shuffled. Identical rebuilt conversations
become one weighted sequence with the list of conversations that end there. Sequences that are proper prefixes of
others go by an anti-join, which leaves the leaves; weights, leaves and bytes are then summed over the prefixes of
the sequences, so the work follows the turns of distinct sequences.

A prefix is named by its depth and the exclusive or of 128 bits for each (position, turn). Running sums within a
conversation go through blocks of positions, so a conversation that holds a third of all turns is cut like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rainloom.llm.common import parts, query, table
from rainloom.session import cut_lineage

#: Longest head that a conversation takes over, conversations of one family, positions of a block, ids of a chunk.
HEADS, FAMILY, POSITIONS, CHUNK = 9, 5, 1024, 4096


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), the 128 bits a and b of (role, text), bytes of the text.

    Order: turn, null first; then role and the digest of the text, so that ties have one order in every layout. Rows
    are numbered inside ranges of (conv_id, turn); a conversation that spans ranges continues the count of the range before.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat_ws(":", F.octet_length(role), role, text).cast("binary"))
    t = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-1 << 63)).alias("turn"),
        F.col("turn").isNotNull().alias("known"), role.alias("role"), F.md5(text.cast("binary")).alias("order"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    order = ["conv_id", "known", "turn", "role", "order"]
    n = parts(conversations.sparkSession)
    ranged = cut_lineage(t.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()))
    by_range = ranged.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    before = by_range.select("conv_id", "range", F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before")).where("before > 0")
    half = lambda k: F.conv(F.substring("digest", k, 16), 16, -10).cast("long")
    local = ranged.withColumn("pos", F.row_number().over(W.partitionBy("conv_id", "range").orderBy(*order[1:])).cast("long") - 1)
    out = local.join(before, ["conv_id", "range"], "left").withColumn("pos", F.col("pos") + F.coalesce("before", F.lit(0)))
    return cut_lineage(out.select("conv_id", "pos", half(1).alias("a"), half(17).alias("b"), "bytes"))


def head_length(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def rebuild(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, depth from 1, x, y, bytes) and all conversations (conv_id).

    A head has fewer than HEADS turns and serves at most the conversations of one family, so both joins are small a key.
    """
    convs = own.groupBy("conv_id").agg(F.count("*").alias("turns"))
    heads = own.where(F.col("pos") < HEADS).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b", "bytes"))).alias("head"))
    c = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), head_length(F.col("conv_id")).cast("int").alias("h"))
    c = c.join(heads, "base", "left").select("conv_id", "h", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("h")).alias("head"))
    c = cut_lineage(c.withColumn("taken", F.size("head")))
    first = c.select("conv_id", F.explode("head").alias("t")).select("conv_id", (F.col("t.pos") + 1).alias("depth"), "t.a", "t.b", "t.bytes")
    rest = own.join(c.select("conv_id", "h", "taken"), "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken") + 1).alias("depth"), "a", "b", "bytes")
    mixed = lambda k, v: F.xxhash64(F.lit(k), "depth", v)
    return first.unionByName(rest).select("conv_id", "depth", mixed(1, "a").alias("x"), mixed(2, "b").alias("y"), "bytes"), c.select("conv_id")


def collapse(rebuilt: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weighted sequences (x, y, depth, conv_id: the smallest of them, weight, total bytes), and every conversation with its sequence."""
    whole = rebuilt.groupBy("conv_id").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.count("*").alias("depth"), F.sum("bytes").alias("total"))
    zero = F.lit(0).cast("long")
    member = cut_lineage(convs.join(whole, "conv_id", "left").select("conv_id", *(F.coalesce(k, zero).alias(k) for k in ("x", "y", "depth", "total"))))
    return member.groupBy("x", "y", "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight"), F.min("total").alias("total")), member


def end_lists(member: DataFrame) -> DataFrame:
    """x, y, depth, ends_sha256 of each sequence: its conversations' ids in ascending order, comma-joined.

    Ranges of the sorted ids become chunks of bounded length, wherever their sequence begins or ends; a digest then
    runs over the chunks of a sequence, one at a time.
    """
    keys = ["x", "y", "depth"]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate([pa.int64()] * 4 + [pa.string()])], [*keys, "first", "ids"])

        key, ids, rows = None, [], []
        for b in batches:
            for *k, i in zip(*(b.column(name).to_pylist() for name in (*keys, "conv_id"))):
                if ids and (k != key or len(ids) == CHUNK):
                    rows.append((*key, ids[0], ",".join(map(str, ids))))
                    ids = []
                    if len(rows) == 1024:
                        yield out(rows)
                        rows = []
                key = k
                ids.append(i)
        yield out(rows + ([(*key, ids[0], ",".join(map(str, ids)))] if ids else []))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate([pa.int64()] * 3 + [pa.string()])], [*keys, "ends_sha256"])

        key, running = None, None
        for b in batches:
            rows = []
            for *k, ids in zip(*(b.column(name).to_pylist() for name in (*keys, "ids"))):
                if k != key:
                    if running:
                        rows.append((*key, running.hexdigest()))
                    key, running = k, hashlib.sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
            yield out(rows)
        yield out([(*key, running.hexdigest())] if running else [])

    n = parts(member.sparkSession)
    order = [*keys, "conv_id"]
    c = member.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(chunks, "x long, y long, depth long, first long, ids string")
    return c.repartition(n, *keys).sortWithinPartitions(*keys, "first").mapInArrow(digests, "x long, y long, depth long, ends_sha256 string")


def prefixes(rebuilt: DataFrame, sequences: DataFrame) -> DataFrame:
    """Every prefix of every sequence, the root (depth 0) included.

    seq (conversation that stands for the sequence), weight, total; depth; px, py name the prefix, ox, oy the one before;
    last: bytes of the last text; before: bytes of the texts before it. Running values inside blocks of positions start from those of the blocks before.
    """
    s = sequences.select(F.col("conv_id").alias("seq"), "weight", "total")
    t = rebuilt.join(s, rebuilt["conv_id"] == s["seq"]).select("seq", "weight", "total", "depth", "x", "y", "bytes", F.floor(F.col("depth") / POSITIONS).alias("block"))
    t = cut_lineage(t)
    earlier = W.partitionBy("seq").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = t.groupBy("seq", "block").agg(F.bit_xor("x").alias("bx"), F.bit_xor("y").alias("by"), F.sum("bytes").alias("bb"))
    blocks = blocks.select("seq", "block", *(F.coalesce(f(k).over(earlier), F.lit(0)).alias(k) for f, k in ((F.bit_xor, "bx"), (F.bit_xor, "by"), (F.sum, "bb")))).where("block > 0")
    so_far = W.partitionBy("seq", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    t = t.select("*", F.bit_xor("x").over(so_far).alias("px"), F.bit_xor("y").over(so_far).alias("py"), F.sum("bytes").over(so_far).alias("sum"))
    t = t.join(blocks, ["seq", "block"], "left")
    mixed = lambda k, b: F.col(k).bitwiseXOR(F.coalesce(b, F.lit(0).cast("long")))
    t = t.select("seq", "weight", "total", "depth", mixed("px", "bx").alias("px"), mixed("py", "by").alias("py"), "x", "y", F.col("bytes").alias("last"), (F.col("sum") + F.coalesce("bb", F.lit(0)) - F.col("bytes")).alias("before"))
    t = t.select("seq", "weight", "total", "depth", "px", "py", F.col("px").bitwiseXOR(F.col("x")).alias("ox"), F.col("py").bitwiseXOR(F.col("y")).alias("oy"), "last", "before")
    zero = F.lit(0).cast("long")
    root = s.select("seq", "weight", "total", zero.alias("depth"), zero.alias("px"), zero.alias("py"), zero.alias("ox"), zero.alias("oy"), zero.alias("last"), zero.alias("before"))
    return cut_lineage(t.unionByName(root))


def build(conversations: DataFrame) -> DataFrame:
    """One row per node of the prefix trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts count as empty. Rows without conv_id belong to no conversation. Equal turn numbers are put in
    order by role and digest of the text; rows repeated wholly are turns of their own. A conversation may be turnless and
    then ends at the root. c - c % 5 rounds towards zero for negative ids. An empty table has no node; other columns are not looked at.
    """
    rebuilt, convs = rebuild(turns(conversations))
    sequences, member = collapse(rebuilt, convs)
    sequences = cut_lineage(sequences)
    p = prefixes(rebuilt, sequences)

    key = lambda x, y, d: (F.col(x).alias("x"), F.col(y).alias("y"), d.alias("depth"))
    inner = p.where("depth > 0").select(*key("ox", "oy", F.col("depth") - 1)).distinct()
    leaves = cut_lineage(sequences.join(inner, ["x", "y", "depth"], "left_anti").select(F.col("conv_id").alias("seq")))

    p = p.join(leaves.withColumn("leaf", F.lit(1)), "seq", "left")
    nodes = cut_lineage(p.groupBy("px", "py", "depth").agg(
        F.min("seq").alias("conv_id"), F.sum("weight").alias("n_convs"), F.count("leaf").alias("n_leaves"), F.min(F.when(F.col("leaf") == 1, F.col("seq"))).alias("owner"),
        F.min("ox").alias("ox"), F.min("oy").alias("oy"), F.min("before").alias("before"), F.sum(F.col("weight") * (F.col("total") - F.col("before"))).alias("weighed")))

    # Each node belongs to the smallest of its leaves, so a leaf owns the end of its path: texts of distinct nodes are counted once.
    owned = nodes.groupBy(F.col("owner").alias("seq")).agg(F.min_by("before", "depth").alias("first"))
    distinct = p.where("leaf = 1").join(owned, "seq").groupBy("px", "py", "depth").agg(F.sum(F.col("total") - F.greatest("before", "first")).alias("once"))

    parents = nodes.select(F.col("px").alias("ox"), F.col("py").alias("oy"), F.col("depth").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    children = nodes.where("depth > 0").groupBy(*key("ox", "oy", F.col("depth") - 1)).agg(F.count("*").alias("n_children"))
    out = nodes.withColumn("above", F.col("depth") - 1).join(parents, ["ox", "oy", "above"], "left").join(distinct, ["px", "py", "depth"], "left")
    out = out.withColumnsRenamed({"px": "x", "py": "y"}).join(children, ["x", "y", "depth"], "left").join(end_lists(member), ["x", "y", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves",
                      (F.col("weighed") - F.col("once")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


CRC32 = """xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split({0}::varchar, ''), lambda s: ascii(s)::bigint)),
 lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

SQL = f"""with t as (select conv_id, coalesce(role, '') as r, coalesce(text, '') as x, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) - 1 as pos from conversations where conv_id is not null),
c as (select conv_id, {CRC32.format("conv_id")} % 9 as h from (select distinct conv_id from t)),
b as (select c.conv_id, 0 as part, pos, r, x from c join t on t.conv_id = c.conv_id - c.conv_id % 5 and pos < h union all select c.conv_id, 1, pos, r, x from c join t on t.conv_id = c.conv_id and pos >= h),
o as (select conv_id, row_number() over (partition by conv_id order by part, pos) as depth, md5(r) || md5(x) as k, strlen(x) as bytes from b),
p as (select conv_id, depth, string_agg(k, '') over (partition by conv_id order by depth) as path, bytes from o union all select conv_id, 0, '', 0 from c),
e as (select conv_id, max(depth) as depth from p group by 1),
n as (select path, p.depth, min(p.conv_id) as conv_id, count(*) as n_convs, max(bytes) as bytes, coalesce(string_agg(case when e.depth = p.depth then p.conv_id::varchar end, ',' order by p.conv_id), '') as ends from p join e on e.conv_id = p.conv_id group by 1, 2),
u as (select distinct v.path as top, w.path as path from p v join p w on w.conv_id = v.conv_id and w.depth >= v.depth),
s as (select top, sum((n_convs - 1) * bytes)::bigint as saved, sum(case when not exists (select 1 from n d where d.depth = n.depth + 1 and left(d.path, len(d.path) - 64) = n.path) then 1 else 0 end)::bigint as leaves from u join n on n.path = u.path group by 1),
k as (select left(path, len(path) - 64) as above, count(*) as n from n where depth > 0 group by 1)
select n.conv_id::bigint as conv_id, n.depth::bigint as depth, m.conv_id::bigint as parent_conv_id, n.n_convs::bigint as n_convs, coalesce(k.n, 0)::bigint as n_children, s.leaves as n_leaves, s.saved as saved_tokens, sha256(n.ends) as ends_sha256
from n join s on s.top = n.path left join n m on m.depth = n.depth - 1 and m.path = left(n.path, len(n.path) - 64) left join k on k.above = n.path"""


@query("op12_sequence_trie", SQL)
def sequence_trie(spark, sf):
    """All nodes of the prefix trie of the rebuilt conversations."""
    return build(table(spark, sf, "conversations"))
