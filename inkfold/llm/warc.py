"""WARC archives as a PySpark Python data source, with revisit records for repeated payloads.

Writing: every task streams its Arrow batches into files of gzip members, one for each record, under names of
its own; the commit lists the files of the successful attempts in a manifest, which is all that readers
look at, so failed or repeated attempts leave no records behind. A member's gzip header holds the member's length in an extra field.
Reading: files are planned into partitions by size; predicates on the record type and on header fields are pushed down and decided on
the parsed header, for which only a member's first bytes are inflated; where no kept record needs the payload, the reader goes to the next member at once. Archives of other
writers, without that field, are read through.

Paths may be any that `pyarrow.fs` opens (file, hdfs, s3, gs).

Defined cases: null html is an empty payload; null url an empty header; a null id is written and read back as
null and never referred to; repeated rows of the smallest id are all responses; very long payloads are whole records; empty tables write no
file and read back as no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

SCHEMA = "record_id string, target_uri string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary"
ARROW = pa.schema([("record_id", pa.string()), ("target_uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
#: Payloads shorter than this are stored every time.
LEAST_REVISIT = 100
#: Fixed by the WARC 1.1 standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = {"warc-record-id": "record_id", "warc-target-uri": "target_uri", "warc-type": "record_type", "warc-refers-to": "refers_to", "warc-payload-digest": "payload_digest", "x-full-payload-length": "payload_bytes"}
FILE_BYTES, PARTITION_BYTES, BATCH_BYTES = 128 << 20, 32 << 20, 8 << 20
#: Head of a gzip member with one extra field (RFC 1952): name, size and value, the length of the whole member.
_FIELD = struct.Struct("<10sH2sHQ")
_FIXED, _NAME = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff", b"IK"
#: Keys that a payload digest with more than one page is spread over in a join.
SALTS = 16


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def _record(row: dict) -> bytes:
    """One record; the block is an HTTP response whose body is the payload, or that response's head for a revisit."""
    revisit, body = row["record_type"] == "revisit", row["payload"] or b""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_bytes"]
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {row['record_id']}", f"WARC-Target-URI: {' '.join((row['target_uri'] or '').split())}",
        "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{row['payload_digest']}", f"X-Full-Payload-Length: {row['payload_bytes']}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {row['refers_to']}", f"WARC-Profile: {REVISIT_PROFILE}"]
    block += b"" if revisit else body
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return _FIELD.pack(_FIXED, 12, _NAME, 8, _FIELD.size + len(body) + 8) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class _Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        store, root = _open(self.path)
        files, out, size = [], None, 0
        try:
            for batch in iterator:
                store.create_dir(root, recursive=True)
                for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                    if out is None or size > FILE_BYTES:
                        if out:
                            out.close()
                        files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = store.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
                    member = _member(_record(row))
                    out.write(member)
                    size += len(member)
        finally:
            if out:
                out.close()
        return _Written(files)

    def commit(self, messages):
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages):
        store, root = _open(self.path)
        for name in (f for m in messages if m for f in m.files):
            store.delete_file(f"{root}/{name}")


class _Files(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(files)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.equal: dict[str, set] = {}
        self.prefix: dict[str, str] = {}

    def pushFilters(self, filters):
        for f in filters:
            name = getattr(f, "attribute", ("",))[0]
            if name in ARROW.names[:5] and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.equal[name] = self.equal[name] & values if name in self.equal else values
            elif name in ARROW.names[:5] and isinstance(f, StringStartsWith) and name not in self.prefix:
                self.prefix[name] = f.value
            else:
                yield f

    def partitions(self):
        store, root = _open(self.path)
        infos = [x for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.type == fs.FileType.File]
        listed = [x for x in infos if x.base_name.startswith("_manifest-")]
        if listed:
            names = {n for x in listed for n in json.loads(store.open_input_stream(x.path).read())}
            infos = [x for x in infos if x.base_name in names]
        plan, size = [[]], 0
        for x in sorted((x for x in infos if x.base_name.endswith((".warc", ".warc.gz"))), key=lambda x: x.base_name):
            if plan[-1] and size + x.size > PARTITION_BYTES:
                plan, size = [*plan, []], 0
            plan[-1].append(x.path)
            size += x.size
        return [_Files(p) for p in plan]

    def _wanted(self, head: dict) -> bool:
        return all(head.get(k) in v for k, v in self.equal.items()) and all((head.get(k) or "").startswith(v) for k, v in self.prefix.items())

    def read(self, partition):
        store, _ = _open(self.path)
        rows, size = [], 0
        for path in partition.value:
            with store.open_input_file(path) as raw, io.BufferedReader(raw, 1 << 18) as f:
                for row in self._members(f) if path.endswith(".gz") else self._records(f):
                    rows.append(row)
                    size += len(row["payload"] or b"") + 300
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    @staticmethod
    def _head(lines) -> tuple[dict, int]:
        """(columns but the payload, length of the block) from header lines."""
        head, length = dict.fromkeys(ARROW.names), 0
        for line in lines:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            name, value = name.strip().lower(), value.strip()
            if name == "content-length":
                length = int(value)
            elif name in HEADERS:
                head[HEADERS[name]] = value.removeprefix("sha256:") if name == "warc-payload-digest" else value
        head["payload_bytes"] = int(head["payload_bytes"]) if head["payload_bytes"] else None
        return head, length

    def _decodes(self, head: dict) -> bool:
        return self._wanted(head) and head["record_type"] == "response" and (self.payload or self.verify)

    def _with_payload(self, head: dict, block: bytes) -> dict:
        body = block[block.index(b"\r\n\r\n") + 4 :]
        if self.verify:
            digest = hashlib.sha256(body).hexdigest()
            if head["payload_digest"] not in (None, digest):
                raise ValueError(f"{head['record_id']}: payload does not match its digest")
            head |= {"payload_digest": digest, "payload_bytes": len(body)}
        return head | {"payload": body if self.payload else None}

    def _members(self, f):
        """Records of a file of members that know their length."""
        at = 0
        while True:
            f.seek(at)
            start = f.read(_FIELD.size)
            if not start:
                return
            fixed, _, name, _, size = _FIELD.unpack(start) if len(start) == _FIELD.size else (b"", 0, b"", 0, 0)
            f.seek(at)
            if fixed != _FIXED or name != _NAME:
                with gzip.GzipFile(fileobj=f) as rest:
                    yield from self._records(rest)
                return
            at += size
            unpack, text, pending = zlib.decompressobj(31), b"", b""
            while (cut := text.find(b"\r\n\r\n")) < 0:
                pending = pending or f.read(min(size, 4096))
                if not pending:
                    raise EOFError(f"a record at byte {at - size} has no end of its header")
                text += unpack.decompress(pending, 2048)
                pending = unpack.unconsumed_tail
            head, length = self._head(text[:cut].split(b"\r\n")[1:])
            if self._decodes(head):
                while not unpack.eof and (pending := pending or f.read(1 << 20)):
                    text += unpack.decompress(pending)
                    pending = b""
                yield self._with_payload(head, text[cut + 4 : cut + 4 + length])
            elif self._wanted(head):
                yield head

    def _records(self, f):
        """Records of a stream, from first to last."""
        while line := f.readline():
            if not line.startswith(b"WARC/"):
                continue
            head, length = self._head(iter(lambda: f.readline().strip(), b""))
            if self._decodes(head):
                yield self._with_payload(head, f.read(length))
                continue
            while length > 0 and (skipped := len(f.read(min(length, 1 << 20)))):
                length -= skipped
            if self._wanted(head):
                yield head


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def page_records(pages: DataFrame) -> DataFrame:
    """A WARC record for each page; equal payloads of LEAST_REVISIT bytes or more refer to the smallest page_id.

    The grouping moves ids and digests only, first a row a task and digest, then by salted digest; the html is shuffled once, by page, so that a payload that
    much of the table shares makes no large group.
    """
    html = F.coalesce("html", F.lit(""))
    seen = pages.select("page_id", "url", html.alias("html"), F.sha2(F.encode(html, "UTF-8"), 256).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    ids = seen.filter(F.col("payload_bytes") >= LEAST_REVISIT).select("page_id", "payload_digest")
    first = ids.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
    spread = first.select("payload_digest", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = ids.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    again = salted.join(spread, ["payload_digest", "salt"]).filter("page_id > first_id").select("page_id", "payload_digest", "first_id").distinct()
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    return seen.join(again, ["page_id", "payload_digest"], "left").select(
        urn("page_id").alias("record_id"),
        F.col("url").alias("target_uri"),
        F.when(F.col("first_id").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.when(F.col("first_id").isNotNull(), urn("first_id")).alias("refers_to"),
        "payload_digest",
        "payload_bytes",
        F.when(F.col("first_id").isNull(), F.encode("html", "UTF-8")).alias("payload"),
    )


def write_warc(records: DataFrame, path: str) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, *, payload: bool = True, verify: bool = False) -> DataFrame:
    """The records of an archive folder. verify: digests and lengths of responses are those of the bytes read."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload)).option("verify", str(verify)).load(path)


def page_of(urn: str):
    """The page id in a record's URN, null if it has none."""
    return F.regexp_extract(urn, r"urn:page:(-?[0-9]+)>", 1).try_cast("long")
