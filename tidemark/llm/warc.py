"""WARC archives in dictionary-compressed Zstandard, with revisit records for repeated payloads.

Every archive is a sequence of frames: first a skippable frame (magic 0x184D2A5D) that holds the Zstandard
dictionary, then one frame a record.  The dictionary is trained on a bounded sample of the records to be
archived: `SAMPLE_RECORDS` of them, by hash of the page id, `SAMPLE_BYTES` of each; all records are archived whole.
Archives go to the shared folder through pyarrow's file systems, under names that no other attempt of a task
uses; the manifest, written by Spark, lists the archives of the attempts that succeeded, and only those are read.

Defined results: null html is an empty payload; a null url leaves its header out; of equal payloads of at least
`REVISIT_BYTES` bytes the one with the smallest page id is the response; rows without page id are responses;
a row given twice is archived twice, alike; an empty table gives no archive; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, narrowed, new_path, shared_dir, whole_text

DICTIONARY_MAGIC = 0x184D2A5D
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 8192, 65536
REVISIT_BYTES = 100
#: An archive is closed once it holds this many compressed bytes.
ARCHIVE_BYTES = 4 << 20
SALTS = 16
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONTROL = re.compile(r"[\x00-\x20\x7f]")
MANIFEST = "file string, records long, bytes long"
RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>"


def build_record(page_id, url, payload: bytes, refers_to=None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record; a revisit carries no payload but its digest and length."""
    digest = hashlib.sha256(payload).hexdigest()
    revisit = refers_to is not None
    block = HTTP_HEAD + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"WARC-Page: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"record {fields['WARC-Record-ID']} has a wrong length")
    payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if payload is not None and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(fields["WARC-Payload-Length"])):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("WARC-Page"), "url": fields.get("WARC-Target-URI"), "payload": payload,
        "payload_bytes": int(fields["WARC-Payload-Length"]), "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To-Page"),
    }


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or where the samples are too few to train one, their own bytes; empty without samples."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 16 else b"".join(samples)[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _dictionary(raw: bytes):
    return zstandard.ZstdCompressionDict(raw) if raw else None


def dictionary_frame(raw: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw


def compressor(raw: bytes, level: int = 3):
    return zstandard.ZstdCompressor(level=level, dict_data=_dictionary(raw), write_checksum=True)


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    magic, size = struct.unpack_from("<II", data, 0)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    opener = zstandard.ZstdDecompressor(dict_data=_dictionary(data[8 : 8 + size]))
    at, view = 8 + size, memoryview(data)
    while at < len(data):
        frame, parts = opener.decompressobj(), []
        while not frame.eof:
            if at >= len(data):
                raise ValueError("the archive ends inside a frame")
            piece = view[at : at + 16384]
            parts.append(frame.decompress(piece))
            at += len(piece) - len(frame.unused_data)
        yield b"".join(parts)


def writer(folder: str, dictionary: bytes, archive_bytes: int = ARCHIVE_BYTES):
    """A function for mapInPandas that archives the rows of a partition and returns the manifest's rows."""

    def write(batches):
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base)
        task, pack, part, held = TaskContext.get(), compressor(dictionary), 0, [dictionary_frame(dictionary)]
        stem, records, size = f"part-{task.partitionId():05d}-{task.taskAttemptId()}", 0, 0

        def close():
            nonlocal part, held, records, size
            name = f"{stem}-{part:04d}.warc.zst"
            with where.open_output_stream(f"{base}/{name}", compression=None) as out:
                for x in held:
                    out.write(x)
            done = {"file": name, "records": records, "bytes": sum(map(len, held))}
            part, held, records, size = part + 1, [dictionary_frame(dictionary)], 0, 0
            return done

        for batch in batches:
            done = []
            for page, url, html, first in zip(batch.page_id, batch.url, batch.html, batch.refers_to, strict=True):
                packed = pack.compress(build_record(None if pd.isna(page) else int(page), url, html.encode("utf-8", "surrogatepass"), None if pd.isna(first) else int(first)))
                held.append(packed)
                records, size = records + 1, size + len(packed)
                if size >= archive_bytes:
                    done.append(close())
            if done:
                yield pd.DataFrame(done)
        if records:
            yield pd.DataFrame([close()])

    return write


def revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, digest and the response's page_id, of the pages that revisit another."""
    rows = pages.filter(F.octet_length("html") >= least).select("page_id", "digest", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).alias("salt"))
    firsts = rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = firsts.select("digest", "refers_to", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return rows.join(firsts, ["digest", "salt"]).filter("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, least: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archive all pages (page_id, url, html) under `folder`; returns the manifest, already written."""
    pages = narrowed(pages, ["page_id", "url", "html"]).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), whole_text("html").alias("html"))
    # about SAMPLE_RECORDS rows pass the filter, whatever their number, so little reaches the driver from each task
    every = max(1, pages.count() // SAMPLE_RECORDS)
    chosen = pages.filter(F.pmod(F.xxhash64("page_id", F.lit(3)), F.lit(every).cast("long")) == 0).filter("html != ''")
    sample = chosen.select(F.xxhash64("page_id").alias("h"), F.substring("html", 1, SAMPLE_BYTES).alias("html")).orderBy("h", "html").limit(SAMPLE_RECORDS).collect()
    dictionary = train_dictionary([HTTP_HEAD + r.html.encode("utf-8", "surrogatepass") for r in sample])
    pages = pages.withColumn("digest", F.sha2("html", 256))
    marked = pages.join(revisits(pages, least), ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")
    return materialize(marked.mapInPandas(writer(folder, dictionary, archive_bytes), MANIFEST), "manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives in the manifest; payload is null for revisits."""

    def parse(batches):
        for batch in batches:
            for data in batch.content:
                rows, size = [], 0
                for raw in read_archive(data):
                    rows.append(parse_record(raw))
                    size += len(raw)
                    if size > 8 << 20:
                        yield _frame(rows)
                        rows, size = [], 0
                if rows:
                    yield _frame(rows)

    files = manifest.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    files = files.withColumn("file", F.element_at(F.split("path", "/"), -1)).join(manifest.select("file"), "file", "left_semi")
    return files.select("content").mapInPandas(parse, RECORDS)


def _frame(rows: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame(rows)
    return frame.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "int64"})


def archive_and_read(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Write all pages to archives in the shared folder and return what reading them back gives."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    if "://" not in folder and not folder.startswith(("/", "file:")):
        raise ValueError(f"{shared_dir(spark)} is not an absolute path")
    manifest = write_archives(pages, folder, least)
    if manifest.isEmpty():
        return spark.createDataFrame([], RECORDS)
    return read_archives(manifest, folder)
