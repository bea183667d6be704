"""BAM: alignments of BGZF-compressed files, in pure Python and as a Spark data source `bam`, and reads to 5' ends.

A file is read as a stream that holds one block at a time.  Where the index of a file lies beside it (`.bai`), the file is
split where the index says that alignments begin, so that many tasks read it; without one a task reads a file.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.intervals import five_prime, width
from .bigwig import opened

# fixed values of the format
BGZF, BAI = b"\x1f\x8b\x08\x04", b"BAI\1"
#: CIGAR operations that use up reference bases, of MIDNSHP=X.
ON_REFERENCE = (0, 2, 3, 7, 8)
UNMAPPED, REVERSE = 4, 16
#: The index's bin that holds numbers of reads rather than places.
NUMBERS_BIN = 37450
#: Compressed bytes of a file that a task reads, about, and bytes fetched at once.
SPLIT, FETCH = 64 << 20, 4 << 20


class Stream:
    """The bytes of a BGZF file from a virtual offset (place of a block, place within it) on."""

    def __init__(self, path: str, offset: int = 0) -> None:
        self.path, self.file = path, opened(path)
        self.fetched, self.fetched_at = b"", 0
        self.following, self.block, self.at = offset >> 16, b"", 0
        if offset & 0xFFFF:
            self._next()
            self.at = offset & 0xFFFF

    def _fetch(self, at: int, n: int) -> bytes:
        low = at - self.fetched_at
        if low < 0 or low + n > len(self.fetched):
            self.file.seek(at)
            self.fetched, self.fetched_at, low = self.file.read(max(n, FETCH)), at, 0
        return self.fetched[low : low + n]

    def _next(self) -> bool:
        """Go on to the next block; false at the end of the file."""
        at = self.following
        head = self._fetch(at, 12)
        if not head:
            return False
        if head[:4] != BGZF:
            raise ValueError(f"{self.path} has no BGZF block at {at}")
        extra, size = struct.unpack_from("<H", head, 10)[0], None
        fields = self._fetch(at + 12, extra)
        while fields:
            tag, n = fields[:2], struct.unpack_from("<H", fields, 2)[0]
            if tag == b"BC":
                size = struct.unpack_from("<H", fields, 4)[0] + 1
            fields = fields[4 + n :]
        if size is None:
            raise ValueError(f"{self.path} has a BGZF block without its size")
        packed = self._fetch(at, size)
        if len(packed) < size:
            raise ValueError(f"{self.path} ends within a block")
        self.block, self.at, self.following = zlib.decompress(packed[12 + extra : -8], -15), 0, at + size
        self.begin = at
        return True

    def tell(self) -> int:
        """The virtual offset of the next byte."""
        return self.begin << 16 | self.at if self.at < len(self.block) else self.following << 16

    def take(self, n: int) -> bytes:
        """The next n bytes; none at the end of the file."""
        if self.at + n <= len(self.block):
            self.at += n
            return self.block[self.at - n : self.at]
        parts, left = [], n
        while left:
            if self.at == len(self.block) and not self._next():
                break
            part = self.block[self.at : self.at + left]
            self.at += len(part)
            left -= len(part)
            parts.append(part)
        if 0 < left < n:
            raise ValueError(f"{self.path} ends within an alignment")
        return b"".join(parts)


def names_of(stream: Stream) -> list[str]:
    """The references that a file's header names; the stream is left at the first alignment."""
    if stream.take(4) != b"BAM\1":
        raise ValueError(f"{stream.path} is not a BAM file")
    number = lambda: struct.unpack("<i", stream.take(4))[0]
    stream.take(number())
    names = []
    for _ in range(number()):
        names.append(stream.take(number())[:-1].decode())
        number()
    return names


def alignments(path: str, low: int = 0, high: int | None = None) -> Iterator[tuple[str, int, int, str, int, int]]:
    """Reference, start and end (1-based, closed), strand, mapping quality and flag of the mapped reads that begin at the
    virtual offsets [low, high); a `low` of 0 is the first alignment."""
    stream = Stream(path)
    names = names_of(stream)
    if low:
        stream = Stream(path, low)
    while (high is None or stream.tell() < high) and (size := stream.take(4)):
        body = stream.take(struct.unpack("<i", size)[0])
        ref, start, name_size, quality, _, n_cigar, flag = struct.unpack_from("<iiBBHHH", body)
        if ref >= 0 and not flag & UNMAPPED:
            length = sum(c >> 4 for c in struct.unpack_from(f"<{n_cigar}I", body, 32 + name_size) if (c & 15) in ON_REFERENCE)
            yield names[ref], start + 1, start + length, "-" if flag & REVERSE else "+", quality, flag


def indexed_offsets(raw: bytes) -> list[int]:
    """The virtual offsets at which alignments begin, in order, that an index states."""
    if raw[:4] != BAI:
        raise ValueError("not an index of a BAM file")
    found: set[int] = set()
    n_refs, at = struct.unpack_from("<i", raw, 4)[0], 8
    for _ in range(n_refs):
        n_bins, at = struct.unpack_from("<i", raw, at)[0], at + 4
        for _ in range(n_bins):
            which, n = struct.unpack_from("<Ii", raw, at)
            if which != NUMBERS_BIN:
                found.update(struct.unpack_from(f"<{2 * n}Q", raw, at + 8)[::2])
            at += 8 + 16 * n
        n, at = struct.unpack_from("<i", raw, at)[0], at + 4
        found.update(struct.unpack_from(f"<{n}Q", raw, at))
        at += 8 * n
    return sorted(found - {0})


@dataclass
class Piece(InputPartition):
    """The alignments of a file that begin at the virtual offsets [low, high)."""

    path: str
    low: int
    high: int | None


def pieces(path: str, split: int = SPLIT) -> list[Piece]:
    try:
        offsets = indexed_offsets(opened(f"{path}.bai").read())
    except FileNotFoundError:
        offsets = []
    cuts = [0]
    for v in offsets:
        if (v >> 16) - (cuts[-1] >> 16) >= split:
            cuts.append(v)
    return [Piece(path, low, high) for low, high in zip(cuts, [*cuts[1:], None], strict=True)]


def bam_bytes(reads, references: dict[str, int]) -> bytes:
    """A BAM file of reads (reference, start, cigar as text, strand), for tests and exports; sequences are left out."""
    number = {n: i for i, n in enumerate(references)}
    raw = bytearray(b"BAM\1" + struct.pack("<ii", 0, len(number)))
    for n in number:
        raw += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", references[n])
    for i, (ref, start, cigar, strand) in enumerate(reads):
        ops = [(int(k) << 4) | "MIDNSHP=X".index(o) for k, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
        name = f"r{i}".encode() + b"\0"
        body = struct.pack("<iiBBHHHiiii", number[ref], start - 1, len(name), 60, 0, len(ops), REVERSE if strand == "-" else 0, 0, -1, -1, 0) + name + struct.pack(f"<{len(ops)}I", *ops)
        raw += struct.pack("<i", len(body)) + body
    out = bytearray()
    for low in range(0, len(raw), 60_000):
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        piece = raw[low : low + 60_000]
        packed = deflate.compress(piece) + deflate.flush()
        out += BGZF + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(piece), len(piece))
    return bytes(out)


def write_bam_parts(df: DataFrame, seqinfo: DataFrame, folder: str) -> list[str]:
    """Reads (seqname, start, cigar, strand) as BAM files in a folder, one for each batch of a task; returns their paths.

    A task that runs again writes under new names; only files of finished tasks are returned.
    """
    lengths = {r.seqname: int(r.seqlength) for r in seqinfo.select("seqname", "seqlength").collect()}

    def write(batches):
        for t in batches:
            path = f"{folder}/{uuid.uuid4().hex}.bam"
            where, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
            where.create_dir(name.rsplit("/", 1)[0], recursive=True)
            with where.open_output_stream(name, compression=None) as out:
                out.write(bam_bytes(t.itertuples(index=False, name=None), lengths))
            yield pd.DataFrame({"path": [path]})

    return [r.path for r in df.select("seqname", "start", "cigar", "strand").mapInPandas(write, "path string").collect()]


class BamReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths, self.split = [p for p in options["path"].split(",") if p], int(options.get("split", SPLIT))

    def partitions(self):
        return [x for p in self.paths for x in pieces(p, self.split)]

    def read(self, partition: Piece):
        rows: list = []

        def batch() -> pa.RecordBatch:
            columns = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), TYPES, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([partition.path] * len(rows))], names=NAMES)

        for r in alignments(partition.path, partition.low, partition.high):
            rows.append(r)
            if len(rows) == 50_000:
                yield batch()
                rows.clear()
        if rows:
            yield batch()


NAMES = ["seqname", "start", "end", "strand", "quality", "flag", "path"]
TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()]


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return "seqname string, start long, end long, strand string, quality int, flag int, path string"

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)


def read_bam(spark: SparkSession, paths: str | list[str], split: int = SPLIT) -> DataFrame:
    """seqname, start, end, strand, mapping quality, flag and path of mapped reads; filter by any of them."""
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("path", paths if isinstance(paths, str) else ",".join(paths)).option("split", split).load()


def reads_to_ctss(reads: DataFrame, min_length: int = 1) -> DataFrame:
    """Counts of the 5' ends of reads that are long enough."""
    own = (F.col("start"), F.col("end"))
    ends = reads.filter(width(*own) >= min_length).select("seqname", five_prime(*own, F.col("strand")).alias("start"), "strand")
    return ends.groupBy("seqname", "start", "strand").agg(F.count(F.lit(1)).alias("score")).withColumn("end", F.col("start"))
