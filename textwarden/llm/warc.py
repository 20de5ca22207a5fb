"""WARC archives: one gzip member per record, written in shards and read back sequentially.

The reader never holds a whole archive: it inflates one member at a time with an incremental zlib decompressor, frames
the record by its Content-Length and checks block and payload digests. A revisit record carries the HTTP header of the
page it stands for (its Content-Length is that of the full payload) and names the response that holds the payload.

Cases: null html counts as an empty payload; a null url gets a urn target; a null page_id is never the response of
others while its group has any identifier, and repeated page_ids share their type; an empty table writes no archive and
reads as no rows; control characters in a url are percent-encoded, so they can't end a header line. Archives of others
are read too: records of any type, with or without digests; fields that they lack are null.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.llm.common import attach, open_fs, shared_dir, write_atomically, written

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
CHUNK = 1 << 18
READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


class BadArchive(ValueError):
    """A record that isn't framed as it says, or whose digest doesn't match."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"urn:x-page:{'none' if page_id is None else page_id}"


def _from_urn(text: str | None) -> int | None:
    """The page of a record of our own; none for records of others."""
    head, _, name = (text or "").strip("<>").rpartition(":")
    return int(name) if head == "urn:x-page" and name != "none" else None


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record as one gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = quote(url, safe=":/?#[]@!$&'()*+,;=%-._~") if url else _urn(page_id)
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_urn(page_id)}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: <{_urn(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


def members(stream) -> Iterator[bytes]:
    """The records of an archive, one inflated gzip member at a time."""
    inflate, out, data = zlib.decompressobj(31), bytearray(), b""
    while True:
        data = data or stream.read(CHUNK)
        if not data:
            if out:
                raise BadArchive("the archive ends within a record")
            return
        out += inflate.decompress(data)
        data = inflate.unused_data
        if inflate.eof:
            yield bytes(out)
            inflate, out = zlib.decompressobj(31), bytearray()


def _headers(raw: bytes, at: int, end: int) -> dict[str, str]:
    pairs = (line.partition(":") for line in raw[at:end].decode(errors="replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _digest_fits(named: str | None, data: bytes) -> bool:
    """Whether a SHA-1 digest in base 32 or 16 is that of data; other algorithms and missing digests can't be checked."""
    algorithm, _, value = (named or "").partition(":")
    if algorithm.lower() != "sha1":
        return True
    return value.upper() == base32_sha1(data) or value.lower() == hashlib.sha1(data).hexdigest()


def parse(raw: bytes) -> dict:
    """A record's fields, after its frame and those digests that it has are checked.

    Records of any type are read: the payload of HTTP messages is what follows their header, that of others the block.
    """
    if not raw.startswith(b"WARC/"):
        raise BadArchive("no record begins here")
    if (cut := raw.find(b"\r\n\r\n")) < 0:
        raise BadArchive("the header has no end")
    head = _headers(raw, 0, cut)
    if not head.get("content-length", "").isdigit() or "warc-type" not in head:
        raise BadArchive("the header lacks its length or type")
    start, size = cut + 4, int(head["content-length"])
    block = raw[start : start + size]
    if len(block) != size or raw[start + size :] != b"\r\n\r\n":
        raise BadArchive("Content-Length doesn't frame the record")
    if not _digest_fits(head.get("warc-block-digest"), block):
        raise BadArchive("the block's digest doesn't match")
    kind, digest = head["warc-type"], head.get("warc-payload-digest")
    payload, http = block, {}
    if head.get("content-type", "").startswith("application/http"):
        end = block.find(b"\r\n\r\n")
        end = len(block) if end < 0 else end
        payload, http = block[end + 4 :], _headers(block, 0, end)
    length = len(payload)
    if kind == "revisit":
        length = int(http["content-length"]) if http.get("content-length", "").isdigit() else 0
    elif "warc-truncated" not in head and (not _digest_fits(digest, payload) or (_from_urn(head.get("warc-record-id")) is not None and http.get("content-length") != str(length))):
        raise BadArchive("the payload's digest or length doesn't match")
    return {
        "page_id": _from_urn(head.get("warc-record-id")), "payload_bytes": length, "payload_digest": digest and digest.partition(":")[2], "record_type": kind,
        "refers_to": _from_urn(head.get("warc-refers-to")), "url": head.get("warc-target-uri"), "payload": None if kind == "revisit" else payload,
    }


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Writes the pages below folder; returns a table of the shards (path, records), already materialised.

    Of pages whose payloads agree (length and two digests) and have min_revisit_bytes or more, the smallest page_id
    becomes the response and the others revisit it.
    """
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    keys = ["_size", "_sha1", "_check"]
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
        F.octet_length(body).cast("long").alias("_size"), F.sha1(body).alias("_sha1"), F.xxhash64(body).alias("_check"),
    )
    same = written(rows.groupBy(*keys).agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "payloads")
    total = same.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    repeated = same.where((F.col("copies") > 1) & (F.col("_size") >= min_revisit_bytes))
    plan = attach(rows, repeated, keys, "copies", total).select("page_id", "url", "html", "_sha1", "first_id")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        stream, name, count = None, f"{uuid.uuid4().hex}.warc.gz", 0
        for batch in batches:
            for page_id, url, html, sha1, first in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if stream is None:
                    stream, commit = write_atomically(folder, name)
                payload = (html or "").encode()
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                stream.write(record_bytes(page_id, url, payload, digest, first, first is not None and first != page_id))
                count += 1
        if stream is not None:
            commit()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [count]})

    # The manifest is written before it is read: files of attempts that were lost are not in it.
    return written(plan.mapInArrow(shard, "path string, records long"), "warc-shards")


def read_warc(shards: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives in shards (a column path), one archive per task at a time."""
    schema = READ_SCHEMA if payloads else READ_SCHEMA.removesuffix(", payload binary")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string() if " string" in x else pa.binary() if " binary" in x else pa.int64() for x in schema.split(", ")]

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paths in batches:
            for path in paths.column(0).to_pylist():
                fs, name = open_fs(path)
                rows, held = [], 0
                with fs.open_input_stream(name, compression=None) as stream:
                    for raw in members(stream):
                        rows.append(parse(raw))
                        held += len(raw) if payloads else 200
                        if held > 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    spread = shards.select("path").repartition(max(1, shards.count()), "path")
    return spread.mapInArrow(scan, schema)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Per page, from archives that were written and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    shards = write_warc(pages, shared_dir(spark, "warc"))
    return read_warc(shards, payloads=False).drop("url")
