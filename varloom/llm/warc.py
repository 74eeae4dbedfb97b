"""WARC archives in Zstandard form: writing, and the reader.

An archive begins with a skippable frame that holds its dictionary; each record is a frame of its
own. The writer puts about ARCHIVE bytes of records into an archive, trains its dictionary on some
of them and writes it to the shared folder under a name no other attempt uses; only the archives in
the manifest that finished tasks return count, so a lost executor leaves at most an unread file.
The reader loads the dictionary, decodes frame by frame in bounded chunks and checks the version
line, the needed headers, lengths and digests; a fault raises.

Records with equal payloads: the one with the smallest page_id is the response, the others are
revisits of it without payload. Every record has an id of its own: a response's comes from its page_id
and digest, so that revisits can name it; others' come from the archive and the place in it. Defined
results: null html is an empty payload; rows that repeat the smallest page_id are responses, too, and
revisits of them carry the page_id only; where all ids are null, all are responses; a null url leaves
out the target header; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import has_columns, saved, scratch_path

ARCHIVE = 16 << 20
DICTIONARY, SAMPLES, SAMPLE = 32 << 10, 200, 8 << 10
MAGIC, ZSTD = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
CHUNK = 16 << 10
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, name)}>"


def page_urn(page_id: int, digest: str) -> str:
    """The id of the only response of a page and payload."""
    return urn(f"page:{page_id}:{digest}")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, own: str = "", single: bool = True) -> bytes:
    """One WARC record: a response, or with refers_to a revisit. `own` names it, unless it is the single
    response of its page and payload; `single` for a revisit: its target is."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    digest = sha1_base32(payload)
    name = page_urn(page_id, digest) if single and refers_to is None and page_id is not None else urn(own)
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name}",
        "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        head += [f"X-Refers-To-Page-Id: {refers_to}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        if single:
            head.append(f"WARC-Refers-To: {page_urn(refers_to, digest)}")
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def information(name: str) -> bytes:
    """The archive's first record, which describes it."""
    block = b"software: varloom\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: {urn(name)}", "WARC-Date: 2024-01-01T00:00:00Z",
            f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """The bytes of one archive."""
    some = [r[:SAMPLE] for r in records[::max(1, len(records) // SAMPLES)]]
    raw = b""
    if len(some) >= 16:
        try:
            raw = zstandard.train_dictionary(DICTIONARY, some, k=256, d=8).as_bytes()
        except zstandard.ZstdError:  # too little or too uniform samples: no dictionary
            raw = b""
    d = zstandard.ZstdCompressionDict(raw) if raw else None
    out = zstandard.ZstdCompressor(level=3, dict_data=d, write_checksum=True)
    return b"".join([struct.pack("<II", MAGIC, len(raw)), raw, *map(out.compress, records)])


def write(pages: DataFrame, path: str) -> DataFrame:
    """Archives of (page_id, url, html, refers_to, single) rows below path -> (archive, n_records)."""

    def put(batches):
        fs, root = _fs(path)
        fs.create_dir(root, recursive=True)
        name, held, size = f"{uuid.uuid4().hex}.warc.zst", [], 0

        def flush():
            with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(archive([information(name), *held]))
            return pd.DataFrame({"archive": [name], "n_records": [len(held)]})

        for pdf in batches:
            for i, url, html, to, single in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["refers_to"], pdf["single"]):
                r = record(None if pd.isna(i) else int(i), url, (html or "").encode("utf-8", "replace"),
                           None if pd.isna(to) else int(to), f"{name}/{len(held)}", bool(single))
                held.append(r)
                size += len(r)
                if size >= ARCHIVE:
                    yield flush()
                    name, held, size = f"{uuid.uuid4().hex}.warc.zst", [], 0
        if held:
            yield flush()

    text = lambda c: F.col(c).cast("string")  # noqa: E731  # ids as text: pandas would make floats of nullable ones
    rows = pages.select(text("page_id").alias("page_id"), "url", "html", text("refers_to").alias("refers_to"), "single")
    return rows.mapInPandas(put, "archive string, n_records long")


class BadArchive(ValueError):
    pass


def frames(stream):
    """The decoded records of an archive's stream, one a frame."""
    head = stream.read(8)
    if len(head) < 8:
        raise BadArchive("no leading frame")
    magic, n = struct.unpack("<II", head)
    if magic != MAGIC:
        raise BadArchive("the leading frame is no dictionary")
    raw = stream.read(n)
    if len(raw) != n:
        raise BadArchive("the dictionary is cut short")
    if raw[:4] == ZSTD:
        raw = zstandard.ZstdDecompressor().decompress(raw)
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    rest = b""
    while rest or (rest := stream.read(CHUNK)):
        one, parts = d.decompressobj(), []
        while True:
            parts.append(one.decompress(rest))
            if one.eof:
                rest = one.unused_data
                break
            if not (rest := stream.read(CHUNK)):
                raise BadArchive("a frame is cut short")
        yield b"".join(parts)


def parse(raw: bytes) -> dict:
    """A checked record's values."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise BadArchive("no WARC version line")
    h = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    for k in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if k not in h:
            raise BadArchive(f"header {k} is missing")
    n = int(h["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise BadArchive("the block's length is not as stated")
    if h["warc-type"] == "warcinfo":
        return {"record_type": "warcinfo"}
    http, sep, payload = rest[:n].partition(b"\r\n\r\n")
    length = [x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not sep or not length:
        raise BadArchive("no HTTP head")
    digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
    if h["warc-type"] == "response" and (len(payload) != int(length[0]) or digest != sha1_base32(payload)):
        raise BadArchive("the payload's length or digest is not as stated")
    if h["warc-type"] == "revisit" and (payload or "x-refers-to-page-id" not in h):
        raise BadArchive("a revisit with payload or without target")
    return {"page_id": h.get("x-page-id"), "url": h.get("warc-target-uri"), "payload_bytes": int(length[0]),
            "payload_digest": digest, "record_type": h["warc-type"], "refers_to": h.get("x-refers-to-page-id"),
            "payload": payload}


def read(manifest: DataFrame, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives listed in (archive)."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload

    def get(batches):
        fs, root = _fs(path)
        for pdf in batches:
            for name in pdf["archive"]:
                rows, size = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for raw in frames(f):
                        r = parse(raw)
                        if r["record_type"] == "warcinfo":
                            continue
                        rows.append([r[k] for k in names])
                        size += len(raw) if payload else 400
                        if size > 8 << 20:
                            yield pd.DataFrame(rows, columns=names)
                            rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    kinds = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    out = manifest.select("archive").mapInPandas(get, kinds + ", payload binary" * payload)
    return out.withColumns({k: F.col(k).cast("long") for k in ("page_id", "refers_to")})


def deduplicated(pages: DataFrame) -> DataFrame:
    """pages with refers_to: the smallest page_id of an equal payload, null where that is its own; and
    single: no other row has that page_id and payload."""
    pages = has_columns(pages, "page_id", "url", "html")
    key = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    first = (pages.where(F.col("page_id").isNotNull()).groupBy(key.alias("key"), "page_id").agg(F.count("*").alias("n"))
             .groupBy("key").agg(F.min(F.struct("page_id", "n")).alias("first")))
    rows = pages.withColumn("key", key).join(first, "key", "left")
    return rows.select("page_id", "url", "html", F.when(~F.col("first.page_id").eqNullSafe(F.col("page_id")), F.col("first.page_id")).alias("refers_to"),
                       F.coalesce(F.col("first.n") == 1, F.lit(False)).alias("single"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes every page to archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    manifest = saved(write(deduplicated(pages), path), "warc-manifest")
    spread = manifest.repartition(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), "archive")
    return read(spread, path, payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
