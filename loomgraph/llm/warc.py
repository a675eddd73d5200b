"""WARC archives: writing, normalising monolithic gzip files, indexed reading.

write_monolithic() gives each task's pages to archives that are one gzip stream each. normalise() takes
such a file, inflates its stream once in small pieces, writes every record as a gzip member of its own
and a sidecar index with each record's offset and length; memory holds one record and a piece, however
far the stream is compressed, and a stream that is cut is refused. read_records() uses the index to read
members by byte range, in evenly dealt groups, and checks each response's SHA-1.

Records are WARC/1.1: a date, an HTTP head before the payload (alone in a revisit), and ids that differ,
also those of equal rows. A revisit names its response by id and URL.

Archives lie in the folder that the caller names, as a URI that pyarrow can open (file, hdfs, s3, gs).
Tasks write under a name of their own and move the file into place, so a repeated task is harmless.

Revisits: of records with equal payloads (SHA-1 and length) of at least REVISIT_FROM bytes, that with
the largest page_id is the response and the others refer to it. Defined results: a null html is the
empty payload; a null url is left out; a null page_id is written as null and is never referred to
unless all its group's are null; rows with equal page_id are all kept, one of them as response (that with
the largest url; of rows equal in that too, any one); an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import maybe_in, shared_path, written

REVISIT_FROM = 1000
PIECE = 1 << 20
ROLL_AT = 64 << 20
_END = b"\r\n\r\n"


# ---- records ----


def record_id(page_id: int | None, url: str | None, digest: str, place: str = "") -> str:
    """The id of a record; place tells apart those that no other record refers to."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([page_id, url, digest, place]))}>"


def _uri(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def record(kind: str, name: str, date: str, page_id: int | None, url: str | None, digest: str, size: int, payload: bytes, refers_to: int | None = None, refers_url: str | None = None) -> bytes:
    """One record with this id; a revisit has no payload but says the full payload's digest and size."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: {record_id(refers_to, refers_url, digest)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        head += [] if refers_url is None else [f"WARC-Refers-To-Target-URI: {_uri(refers_url)}"]
        head += [] if refers_to is None else [f"X-Refers-To-Page-ID: {refers_to}"]
        payload = b""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}".encode() + _END + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _END + block + _END


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


# ---- files ----


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Out:
    """A file that appears under its name only when it is whole."""

    def __init__(self, uri: str):
        self.fs, self.path = _open(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.stream, self.at = self.fs.open_output_stream(self.part), 0

    def write(self, data: bytes) -> int:
        self.stream.write(data)
        self.at += len(data)
        return self.at

    def done(self) -> None:
        self.stream.close()
        self.fs.move(self.part, self.path)


def _members(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The inflated bytes of a gzip file of one or more members, at most PIECE at a time."""
    unzip = None
    for piece in pieces:
        full = False
        while piece or full:
            unzip = unzip or zlib.decompressobj(31)
            data = unzip.decompress(piece, PIECE)
            yield data
            full = len(data) == PIECE and not unzip.eof
            piece, unzip = (unzip.unused_data, None) if unzip.eof else (unzip.unconsumed_tail, unzip)
    if unzip is not None:
        raise ValueError("the archive ends inside a gzip member")


def records(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, dict[str, str]]]:
    """(whole record, its fields) of an inflated WARC stream."""
    have = bytearray()
    for piece in pieces:
        have += piece
        while (cut := have.find(_END)) >= 0:
            fields = parse_head(bytes(have[:cut]))
            end = cut + 4 + int(fields["content-length"]) + 4
            if len(have) < end:
                break
            yield bytes(have[:end]), fields
            del have[:end]
    if bytes(have).strip():
        raise ValueError("the archive ends inside a record")


def _pieces(stream) -> Iterator[bytes]:
    while piece := stream.read(PIECE):
        yield piece


def normalise(source: str, target: str) -> int:
    """Rewrite a gzip archive with a member for each record and a sidecar index; the number of records."""
    fs, path = _open(source)
    out, index, n = _Out(target), _Out(f"{target}.idx"), 0
    with fs.open_input_stream(path, compression=None) as stream:
        for whole, fields in records(_members(_pieces(stream))):
            start = out.at
            zipper = zlib.compressobj(6, zlib.DEFLATED, 31)
            out.write(zipper.compress(whole) + zipper.flush())
            index.write(json.dumps({"offset": start, "length": out.at - start, "type": fields["warc-type"], "id": fields["warc-record-id"]}).encode() + b"\n")
            n += 1
    out.done()
    index.done()
    return n


# ---- Spark jobs ----


def with_revisits(pages: DataFrame, at_least: int = REVISIT_FROM) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, refers_url, named (others may refer to it).

    Which page is the response of equal payloads is found among rows without payloads. Only the payloads
    that a bitmap of the repeated ones lets through are shuffled, to meet their response's name: in as many
    shares as there are tasks, so that a payload of a third of all pages isn't one task.
    """
    payload = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    sized = payload.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    by, names = ["payload_digest", "payload_bytes"], ["page_id", "url"]
    kinds = sized.filter(F.col("payload_bytes") >= at_least).groupBy(*by, *names).agg(F.count("*").alias("n"))
    # A null counts as smaller than any value.
    first = kinds.groupBy(*by).agg(F.max(F.struct(*names, "n")).alias("keep"), F.sum("n").alias("all")).filter(F.col("all") > 1)
    first = written(first.select(*by, F.col("keep.page_id").alias("keep"), F.col("keep.url").alias("keep_url"), F.col("keep.n").alias("alike"), "all"), "warc-first")
    # A payload gets a salt for each share of the pages that a task would hold of it.
    most = max(1, (first.agg(F.sum("all")).first()[0] or 0) // int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = F.ceil(F.col("all") / most).cast("int")
    split = sized.withColumn("salt", F.xxhash64("page_id", "url", F.spark_partition_id()))
    told = maybe_in(split, first, *by, flag="met")
    hot = first.filter(F.col("all") > most).select(*by, shares.alias("shares"))
    salted = told.filter("met").join(F.broadcast(hot), by, "left").withColumn("salt", F.pmod("salt", F.coalesce("shares", F.lit(1))).cast("int")).drop("shares")
    targets = first.withColumn("salt", F.explode(F.sequence(F.lit(0), shares - 1))).drop("all")
    met = salted.join(targets, [*by, "salt"], "left").drop("salt", "met")
    alone = told.filter("not met").drop("salt", "met").withColumns({"keep": F.lit(None).cast("long"), "keep_url": F.lit(None).cast("string"), "alike": F.lit(None).cast("long")})
    response = F.col("alike").isNull() | (F.col("page_id").eqNullSafe(F.col("keep")) & F.col("url").eqNullSafe(F.col("keep_url")))
    told = met.unionByName(alone).withColumn("record_type", F.when(response, "response").otherwise("revisit"))
    if first.filter("alike > 1").take(1):  # rows alike in all: one is the response, the others revisit it
        alike = (F.col("record_type") == "response") & (F.coalesce("alike", F.lit(1)) > 1)
        each = told.filter(alike).groupBy(*[c for c in told.columns if c not in ("payload", "record_type")]).agg(F.min("payload").alias("payload"), F.count("*").alias("times"))
        each = each.withColumn("record_type", F.explode(F.concat(F.array(F.lit("response")), F.array_repeat(F.lit("revisit"), F.col("times").cast("int") - 1)))).drop("times")
        told = told.filter(~alike).unionByName(each)
    again = F.col("record_type") == "revisit"
    return told.select("page_id", "url", "payload", *by[::-1], "record_type", F.when(again, F.col("keep")).alias("refers_to"), F.when(again, F.col("keep_url")).alias("refers_url"), (F.col("alike").isNotNull() & ~again).alias("named"))


def write_monolithic(rows: DataFrame, folder: str, roll_at: int = ROLL_AT) -> DataFrame:
    """Write the rows of with_revisits() as archives of one gzip stream each; their names and sizes."""
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, out, zipper, inside, n, made = TaskContext.get().partitionId(), 0, None, None, 0, 0, []
        for batch in batches:
            for page_id, url, payload, size, digest, kind, refers, refers_url, named in zip(*(batch[c] for c in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "refers_url", "named")), strict=True):
                if out is None:
                    name = f"{folder}/part-{part:05d}-{seq:04d}.warc.gz"
                    out, zipper, inside, n = _Out(name), zlib.compressobj(6, zlib.DEFLATED, 31), 0, 0
                page = None if pd.isna(page_id) else int(page_id)
                own = record_id(page, url, digest, "" if named else f"{name} {n}")
                data = record(kind, own, date, page, url, digest, int(size), bytes(payload), None if pd.isna(refers) else int(refers), refers_url)
                out.write(zipper.compress(data))
                inside, n = inside + len(data), n + 1
                if inside >= roll_at:
                    out.write(zipper.flush())
                    out.done()
                    made.append((name, n))
                    out, seq = None, seq + 1
        if out is not None:
            out.write(zipper.flush())
            out.done()
            made.append((name, n))
        yield pd.DataFrame(made, columns=["file", "n"])

    # Nullable integers travel as text: in pandas they would turn into floats.
    return rows.withColumns({"page_id": F.col("page_id").cast("string"), "refers_to": F.col("refers_to").cast("string")}).mapInPandas(write, "file string, n long")


def normalise_all(files: DataFrame, folder: str) -> DataFrame:
    """Normalise each file of (file, n) into folder, a task's files one after another."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for source, n in zip(batch["file"], batch["n"], strict=True):
                target = f"{folder}/{source.rsplit('/', 1)[1]}"
                if (got := normalise(source, target)) != n:
                    raise ValueError(f"{source}: {got} records of {n}")
                rows.append((target, n))
            yield pd.DataFrame(rows, columns=["file", "n"])

    return files.mapInPandas(each, "file string, n long")


def read_index(files: DataFrame) -> DataFrame:
    """The sidecar indexes of normalised files: file, offset, length, type, id."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["file"]:
                fs, path = _open(f"{name}.idx")
                with fs.open_input_stream(path) as stream:
                    rows = [json.loads(line) for line in io.BytesIO(stream.read()).readlines()]
                yield pd.DataFrame({"file": name, **{k: [r[k] for r in rows] for k in ("offset", "length", "type", "id")}})

    return files.select("file").mapInPandas(each, "file string, offset long, length long, type string, id string")


def read_records(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records that index names, each inflated from its own byte range and checked.

    page_id, url, payload_bytes, payload_digest, record_type, refers_to, and payload if asked for.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, some in batch.groupby("file"):
                fs, path = _open(name)
                with fs.open_input_file(path) as f:
                    for offset, length in zip(some["offset"], some["length"], strict=True):
                        f.seek(int(offset))
                        whole, fields = next(records(_members(iter([f.read(int(length))]))))
                        block = whole[whole.index(_END) + 4 : -4]
                        payload = block[block.index(_END) + 4 :]
                        kind, digest, size = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
                        if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                            raise ValueError(f"{name} at {offset}: the payload doesn't match its digest")
                        rows.append((fields.get("x-page-id"), fields.get("warc-target-uri"), size, digest, kind, fields.get("x-refers-to-page-id"), *([payload] if with_payload else [])))
            yield pd.DataFrame(rows, columns=columns)

    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if with_payload else [])]
    kinds = {"payload_bytes": "long", "payload": "binary"}
    read = index.mapInPandas(each, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in columns))
    return read.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None, n_tasks: int | None = None) -> DataFrame:
    """Write pages as normalised archives with sidecar indexes; (file, n) of each archive."""
    folder = folder or shared_path(spark, "warc")
    tasks = n_tasks or max(6, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = with_revisits(pages)
    raw = write_monolithic(rows, f"{folder}/raw")
    raw.write.parquet(f"{folder}/raw-files")
    listed = spark.read.schema("file string, n long").parquet(f"{folder}/raw-files")
    normalise_all(listed.repartition(tasks, "file"), f"{folder}/archives").write.parquet(f"{folder}/files")
    return spark.read.schema("file string, n long").parquet(f"{folder}/files")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """op8's rows: pages written as archives and read back through the sidecar indexes."""
    files = archive(spark, pages)
    tasks = max(6, int(spark.conf.get("spark.sql.shuffle.partitions")))
    index = read_index(files.repartition(tasks, "file"))
    return read_records(index.repartition(tasks, "file", F.floor(F.col("offset") / ROLL_AT * 16)))
