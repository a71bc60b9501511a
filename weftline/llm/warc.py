"""WARC: a deterministic sharded writer, and the reader of its archives.

Records are sorted by identifier and cut into shards of about equal size at exact sums, so a record's shard
does not depend on how Spark dealt the rows out. In a shard, files roll when the next record would take the
compressed size past ``FILE_BYTES``. Every record is a gzip member with no time stamp of its own; headers
(record id, length, block and payload digests) are made anew from the payload. Files are written under
temporary names, renamed when whole, and count only once the manifest names them.

Payloads are compressed where they are read, so the one shuffle of payloads carries compressed members.
Which records repeat an earlier payload is found apart, on digests: groups are summed per task before they
are shuffled, and their small rows meet the payloads in the shards by sort order, not by a join.

Of records with equal payloads of at least ``min_revisit_bytes`` bytes, the one with the smallest id is the
``response``; others are ``revisit`` records that refer to it and hold no payload.

Defined cases. Null html: empty payload. Null url: the header ``WARC-Target-URI`` is left out. Null ids:
sorted first, never referred to unless all ids of the group are null (then each is a response). Rows that
repeat the smallest id with its payload are all responses; other repeated rows are all written. Empty
table: no files, no rows. Other columns are ignored. Payloads of any length are written whole.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import files
from weftline.llm.common import range_cuts, read, shard_count, shard_of, shared_dir

QUERY = "op1_warc"
#: Files roll at so many compressed bytes; a shard holds about so many bytes of payload at most.
FILE_BYTES, SHARD_BYTES = 16 << 20, 256 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _base32_of_hex(digest: str) -> str:
    return base64.b32encode(bytes.fromhex(digest)).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}>"


def page_of(uri: str) -> int | None:
    found = uri.rsplit(":", 2)[1]
    return int(found) if found else None


def member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member: the same bytes for the same record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return gzip.compress(b"WARC/1.1\r\n" + head.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _clean(url: str | None) -> str | None:
    return None if url is None else "".join(c if c >= " " else "%%%02X" % ord(c) for c in url)


def _fields(kind: str, page_id, url, digest: str, length: int, block: bytes, content: str, more=()) -> list[tuple[str, str]]:
    out = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE)]
    if url is not None:
        out.append(("WARC-Target-URI", _clean(url)))
    return [*out, *more, ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("X-Payload-Length", str(length)), ("Content-Type", content), ("Content-Length", str(len(block)))]


def response(page_id, url, payload: bytes, digest: str) -> bytes:
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    return member(_fields("response", page_id, url, digest, len(payload), block, "application/http; msgtype=response"), block)


def revisit(page_id, url, digest: str, length: int, refers_to: int) -> bytes:
    more = [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
    return member(_fields("revisit", page_id, url, digest, length, b"", "application/http; msgtype=response", more), b"")


def _repeats(pages: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """(page_id, digest, refers_to) of the records that repeat a payload.

    Only digests that occur twice or more join back, and a digest with very many pages is a skewed key of
    narrow rows, which adaptive execution splits.
    """
    heads = pages.where(F.col("length") >= min_revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    heads = heads.where("n > 1 and refers_to is not null").select("digest", "refers_to")
    return pages.select("page_id", "digest").join(heads, "digest").where("page_id is null or page_id <> refers_to")


def write(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html); the manifest has a row for each file.

    Manifest: shard, file, records, bytes, sha256 of the file.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    narrow = rows.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("length"))
    sized = narrow.select("page_id", (F.col("length") + 512).alias("size"))
    total = sized.agg(F.sum("size")).first()[0] or 0
    cuts = range_cuts(sized, "page_id", "size", max(shard_count(spark), -(-total // SHARD_BYTES)))
    schema = "shard int, page_id long, digest string, kind int, refers_to long, url string, length long, member binary"
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def compress(batches):
        for batch in batches:
            ids, urls = batch.column("page_id").to_pylist(), batch.column("url").to_pylist()
            payloads = batch.column("payload").to_pylist()
            digests = [base32_sha1(p) for p in payloads]
            columns = [[shard_of(cuts, i) for i in ids], ids, digests, [1] * len(ids), [None] * len(ids), urls, [len(p) for p in payloads], [response(*x) for x in zip(ids, urls, payloads, digests, strict=True)]]
            types = (pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def place(batches):
        for batch in batches:
            ids, digests, heads = (batch.column(c).to_pylist() for c in ("page_id", "digest", "refers_to"))
            n = len(ids)
            columns = [[shard_of(cuts, i) for i in ids], ids, [_base32_of_hex(d) for d in digests], [0] * n, heads, [None] * n, [None] * n, [None] * n]
            types = (pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def store(batches):
        shard = number = None
        stack = stream = done = known = None
        records = size = 0
        digest = hashlib.sha256()

        def close():
            nonlocal stack
            stack.__exit__(None, None, None)
            stack = None
            done.append((shard, name(), records, size, digest.hexdigest()))

        def name():
            return f"shard-{shard:07d}-{number:06d}.warc.gz"

        for batch in batches:
            done = []
            for s, page_id, d, kind, head, url, length, data in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if kind == 0:
                    known = (s, page_id, d, head)
                    continue
                if known and known[:3] == (s, page_id, d):
                    data = revisit(page_id, url, d, length, known[3])
                if stack and (s != shard or size + len(data) > file_bytes):
                    close()
                if not stack:
                    number = number + 1 if s == shard else 0
                    shard, records, size, digest = s, 0, 0, hashlib.sha256()
                    stack = files.output(folder, name())
                    stream = stack.__enter__()
                stream.write(data)
                digest.update(data)
                records, size = records + 1, size + len(data)
            if done:
                yield manifest(done)
        done = []
        if stack:
            close()
            yield manifest(done)

    def manifest(done):
        types = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], ["shard", "file", "records", "bytes", "sha256"])

    records = rows.mapInArrow(compress, schema).unionByName(_repeats(narrow, min_revisit_bytes).mapInArrow(place, schema))
    dealt = records.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
    return files.commit(dealt.mapInArrow(store, "shard int, file string, records long, bytes long, sha256 string"), folder)


def parse(data) -> list[tuple[dict[str, str], bytes]]:
    """Headers and block of each gzip member of an archive."""
    out, data = [], memoryview(data).cast("B")
    at = 0
    while at < len(data):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= len(data):
                raise ValueError("an archive ends inside a record")
            parts.append(inflate.decompress(data[at : at + 16384]))
            at = min(len(data), at + 16384) - len(inflate.unused_data)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        out.append((fields, rest[: int(fields["Content-Length"])]))
    return out


def read_back(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every committed record.

    Digests are taken from the payloads of responses anew and must equal their headers; a revisit record
    has those of its headers.
    """

    def scan(batches):
        for batch in batches:
            for content, size in zip(batch.column("content"), batch.column("bytes").to_pylist(), strict=True):
                data = content.as_buffer()
                if data.size != size:
                    raise ValueError("a file differs from its manifest")
                rows = []
                for fields, block in parse(data):
                    digest, length = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                    if fields["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if base32_sha1(payload) != digest or len(payload) != length:
                            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
                    head = fields.get("WARC-Refers-To")
                    rows.append((page_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), length, digest, fields["WARC-Type"], page_of(head) if head else None))
                types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    found = files.committed(spark, folder, ".warc.gz", manifest.select("file", "bytes")).select("content", "bytes")
    return found.mapInArrow(scan, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    manifest = write(read(spark, sf_dir, "pages"), folder)
    return read_back(spark, folder, manifest).drop("url")
