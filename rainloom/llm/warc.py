"""Deterministic sharded WARC writer and reader.

Records are cut into shards by exact quantiles of their id, so the same rows give the same files on any
cluster. A shard is written in id order into gzip members, one to a record; a file is closed when its
compressed size passes a limit and then renamed from a temporary name. A manifest, written last, names the
files that count: what a lost task left behind is never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import os
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from rainloom.functions.order import quantiles
from rainloom.llm.common import parts, query, table
from rainloom.session import cut_lineage, new_folder

MANIFEST = "shard int, roll int, path string, records long, compressed_bytes long, sha256 string"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
#: Copies of a payload are joined to their response in so many salted groups.
SALTS = 32
#: Rows repeated wholly that travel as one at most.
REPEATS = 1024
#: Digests, of about 200 bytes each with the response's url, that are broadcast at most.
BROADCAST_DIGESTS = 100_000
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, url, text: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{text}')}>"


def plan_records(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Each page with the page that stands for its payload (null where it is its own).

    Of pages with equal payloads of at least min_revisit_bytes the one with the largest id (then url) is the
    response; rows that repeat it wholly are responses too. A null html is an empty payload. Only the digests
    held more than once are joined back. Up to BROADCAST_DIGESTS of them are broadcast, which spares the payloads
    a shuffle; more are joined by shuffle, each in SALTS groups, so a payload shared by a third of all pages is split.
    """
    p = pages.select("page_id", "url", "copies", "part", F.coalesce("html", F.lit("")).cast("binary").alias("_payload"))
    p = p.withColumn("_sha", F.sha1("_payload")).withColumn("_len", F.octet_length("_payload"))
    same = p.where(F.col("_len") >= min_revisit_bytes).groupBy("_sha", "_len").agg(
        F.count("*").alias("_n"), F.max(F.struct(F.coalesce("page_id", F.lit(-2**63)).alias("rank"), "page_id", "url")).alias("_first"))
    same = cut_lineage(same.where("_n > 1").drop("_n"))
    if same.count() <= BROADCAST_DIGESTS:
        j = p.join(F.broadcast(same), ["_sha", "_len"], "left")
    else:
        same = same.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        p = p.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url", "part"), F.lit(SALTS)).cast("int"))
        j = p.join(same, ["_sha", "_len", "_salt"], "left")
    own = F.col("_first").isNull() | (F.col("_first.page_id").eqNullSafe(F.col("page_id")) & F.col("_first.url").eqNullSafe(F.col("url")))
    return j.select("page_id", "url", "copies", "part", F.col("_payload").alias("payload"), F.when(~own, F.col("_first")).alias("first"))


def with_copies(pages: DataFrame) -> DataFrame:
    """page_id, url, html, copies, part: rows repeated wholly more than REPEATS times become parts that stand for at most REPEATS rows each.

    Which rows do is found from digests, added up before the shuffle; only where there are such rows is their payload taken out once.
    """
    p = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("_sha"))
    one = p.select("page_id", "url", "html", F.lit(1).alias("copies"), F.lit(0).cast("long").alias("part"))
    many = cut_lineage(p.groupBy("page_id", "url", "_sha").agg(F.count("*").alias("_n")).where(F.col("_n") > REPEATS))
    if many.isEmpty():
        return one
    k = many.select(F.col("page_id").alias("_p"), F.col("url").alias("_u"), F.col("_sha").alias("_s"), "_n")
    same = F.col("page_id").eqNullSafe(F.col("_p")) & F.col("url").eqNullSafe(F.col("_u")) & (F.col("_sha") == F.col("_s"))
    rest = p.join(k, same, "left_anti").select("page_id", "url", "html", F.lit(1).alias("copies"), F.lit(0).cast("long").alias("part"))
    held = p.join(k, same).groupBy("page_id", "url", "_sha").agg(F.any_value("html").alias("html"), F.any_value("_n").alias("_n"))
    held = held.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {REPEATS}"))))
    return rest.unionByName(held.select("page_id", "url", "html", F.least(F.lit(REPEATS), F.col("_n") - F.col("part") * REPEATS).cast("int").alias("copies"), "part"))


def with_shard(records: DataFrame, pages: DataFrame, shards: int) -> DataFrame:
    """Shard by exact quantiles of page_id; null ids go to the first shard.

    The cuts, one a shard, are asked for and looked up as arrays, so the plan has the same size for any number of
    shards. An id that fills several shards lies on several equal cuts: its records are dealt over those shards by url,
    payload and part.
    """
    if shards < 2:
        return records.withColumn("shard", F.lit(0))
    wanted = F.transform(F.sequence(F.lit(1), F.lit(shards - 1)), lambda k: F.struct(k.alias("idx"), (k / float(shards)).alias("prob")))
    cuts = np.sort(np.asarray([r["value"] for r in quantiles(pages, "page_id", wanted).select("value").toLocalIterator()], np.float64))

    @F.pandas_udf("int")
    def shard_of(page_id: pd.Series, spread: pd.Series) -> pd.Series:
        x = page_id.to_numpy(np.float64)
        low, high = np.searchsorted(cuts, x, "left"), np.searchsorted(cuts, x, "right")
        low = np.where(high > low + 1, low, high)
        return pd.Series(np.where(np.isnan(x), 0, low + spread.to_numpy(np.int64) % (high - low + 1)).astype(np.int32))

    return records.withColumn("shard", shard_of(F.col("page_id").cast("double"), F.pmod(F.xxhash64("url", "payload", "part"), F.lit(1 << 31))))


def header(fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode()


def clean_uri(url: str | None) -> str | None:
    """A header value cannot hold line breaks or other control characters."""
    return None if url is None else urllib.parse.quote(url, safe="".join(map(chr, range(33, 127)))) if re.search(r"[^!-~]", url) else url


def record(page_id, url, payload: bytes, first, date: str) -> bytes:
    """One record: a response with its payload, or a revisit that names the response it repeats."""
    sha = digest(payload)
    block = HTTP.format(len(payload)).encode() + (b"" if first else payload)
    fields = [
        ("WARC-Type", "revisit" if first else "response"), ("WARC-Record-ID", record_id(page_id, url, sha)), ("WARC-Date", date), ("WARC-Target-URI", clean_uri(url)),
        ("WARC-Page-ID", page_id), ("WARC-Payload-Digest", f"sha1:{sha}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if first else None),
        ("WARC-Refers-To", record_id(first["page_id"], first["url"], sha) if first else None),
        ("WARC-Refers-To-Target-URI", clean_uri(first["url"]) if first else None), ("WARC-Refers-To-Page-ID", first["page_id"] if first else None),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return header(fields) + block + b"\r\n\r\n"


class ShardFile:
    """A file under a temporary name until it is closed."""

    def __init__(self, folder: str, shard: int, roll: int):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.shard, self.roll, self.records, self.size, self.sha = shard, roll, 0, 0, hashlib.sha256()
        self.name = f"part-{shard:06d}-{roll:05d}.warc.gz"
        self.temp, self.final = f"{root}/_temporary-{uuid.uuid4().hex}-{self.name}", f"{root}/{self.name}"
        self.out = self.fs.open_output_stream(self.temp, compression=None)

    def add(self, raw: bytes):
        member = gzip.compress(raw, 6, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.records += 1

    def close(self) -> dict:
        self.out.close()
        self.fs.move(self.temp, self.final)
        return {"shard": self.shard, "roll": self.roll, "path": self.name, "records": self.records, "compressed_bytes": self.size, "sha256": self.sha.hexdigest()}


def write_warc(pages: DataFrame, folder: str, shards: int, roll_bytes: int = 64 << 20, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write page_id, url, html as WARC files below folder; returns the manifest, which is stored beside them.

    A null url has no header line, a null html an empty payload, a null page_id no id and the first shard. Repeated
    ids and rows are records of their own; an empty table writes no file; other columns are not looked at. A task that
    is run again writes the same bytes under another temporary name and renames them over the same file.
    """
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = None
        for b in batches:
            done = []
            for shard, page_id, url, payload, first, copies in zip(*(b.column(c).to_pylist() for c in ("shard", "page_id", "url", "payload", "first", "copies"))):
                raw = record(page_id, url, payload, first, date)
                for _ in range(copies):
                    if file and (file.shard != shard or file.size >= roll_bytes):
                        done.append(file.close())
                        file = ShardFile(folder, shard, file.roll + 1 if file.shard == shard else 0)
                    file = file or ShardFile(folder, shard, 0)
                    file.add(raw)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=MANIFEST_ARROW)
        if file:
            yield pa.RecordBatch.from_pylist([file.close()], schema=MANIFEST_ARROW)

    rows = with_shard(plan_records(with_copies(pages), min_revisit_bytes), pages, shards)
    rows = rows.repartitionById(shards, "shard").sortWithinPartitions("shard", "page_id", "url", F.xxhash64("payload"))
    manifest = rows.mapInArrow(run, MANIFEST)
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


MANIFEST_ARROW = pa.schema([("shard", pa.int32()), ("roll", pa.int32()), ("path", pa.string()), ("records", pa.int64()), ("compressed_bytes", pa.int64()), ("sha256", pa.string())])
RECORDS_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                           ("refers_to", pa.int64()), ("payload", pa.binary())])


def members(stream) -> Iterator[bytes]:
    """The gzip members of a file, one after the other."""
    plain, z = io.BytesIO(), zlib.decompressobj(31)
    data = stream.read(1 << 20)
    while data:
        plain.write(z.decompress(data))
        data = z.unused_data or (b"" if z.eof else stream.read(1 << 20))
        if z.eof:
            yield plain.getvalue()
            plain, z = io.BytesIO(), zlib.decompressobj(31)
            data = data or stream.read(1 << 20)
    if plain.tell():
        raise ValueError("archive ends inside a record")


def parse(raw: bytes) -> dict:
    """One record, its digests made anew and compared with the header's."""
    head, rest = raw.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    revisit = fields["WARC-Type"] == "revisit"
    sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Block-Digest"] != f"sha1:{digest(block)}" or not revisit and digest(payload) != sha:
        raise ValueError(f"digest of record {fields['WARC-Record-ID']} does not match")
    whole = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": whole("WARC-Page-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "payload_digest": sha, "refers_to": whole("WARC-Refers-To-Page-ID"),
            "payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]), "payload": None if revisit else payload}


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Records of the files that the manifest names; the payload of a revisit is null. Long files are streamed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for name in b.column("path").to_pylist():
                found, size = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for raw in members(f):
                        found.append(parse(raw))
                        if not payloads:
                            found[-1]["payload"] = None
                        size += len(found[-1]["payload"] or b"")
                        if len(found) >= 10_000 or size > 16 << 20:
                            yield pa.RecordBatch.from_pylist(found, schema=RECORDS_ARROW)
                            found, size = [], 0
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=RECORDS_ARROW)

    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    n = max(1, files.count())
    return files.select("path").repartition(n, "path").mapInArrow(run, RECORDS)


@query("op1_warc_round_trip")
def warc_round_trip(spark, sf):
    """Every page written as a WARC record and read back: about 8 MB of html to a shard, at most one shard for each shuffle partition of the session."""
    pages = table(spark, sf, "pages")
    size = pages.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()[0]
    folder = new_folder(spark, "warc")
    folder = folder if re.match(r"\w+:", folder) else f"file://{os.path.abspath(folder)}"
    write_warc(pages, folder, shards=min(1 + size // (8 << 20), parts(spark)), roll_bytes=4 << 20)
    back = read_warc(spark, folder, payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
