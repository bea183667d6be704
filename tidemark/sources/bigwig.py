"""BigWig, read and written in pure Python, and as a Spark data source `bigwig`.

The file format is that published with the UCSC tools: a header, zoom headers, data in zlib blocks, an index of
R-tree nodes over them, and a B+ tree of chromosome names.  Reading goes through the index, so a task that wants a
stretch of the genome reads only its blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from ..plans.settle import settled

# fixed values of the format
MAGIC, CHROM_MAGIC, INDEX_MAGIC = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
HEADER, SUMMARY, SECTION = "<IHHQQQHHQQIQ", "<Qdddd", "<IIIIIBBH"
BEDGRAPH, VARIABLE, FIXED = 1, 2, 3
ITEMS, FAN_OUT = 1024, 256
#: Packed bytes that a task reads, about; rows in a batch; sections in a batch that is written.
TASK_BYTES, BATCH, SECTIONS = 1 << 22, 50_000, 2000


def opened(path: str):
    """A random-access file of any file system that pyarrow knows, local paths included."""
    where, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return where.open_input_file(name)


@dataclass(frozen=True)
class Header:
    order: str
    chromosomes: dict[str, tuple[int, int]]  # name: number, length
    data: int
    index: int
    packed: int


class BigWig:
    def __init__(self, path: str) -> None:
        self.path, self.file = path, opened(path)
        raw = self._read(0, 64)
        order = "<" if struct.unpack("<I", raw[:4])[0] == MAGIC else ">"
        magic, _, _, tree, data, index, _, _, _, _, packed, _ = struct.unpack(order + HEADER[1:], raw)
        if magic != MAGIC:
            raise ValueError(f"{path} is not a BigWig file")
        self.header = Header(order, self._names(order, tree), data, index, packed)
        self.named = {i: n for n, (i, _) in self.header.chromosomes.items()}

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _names(self, order: str, at: int) -> dict[str, tuple[int, int]]:
        magic, _, key, _, _, _ = struct.unpack(order + "IIIIQQ", self._read(at, 32))
        if magic != CHROM_MAGIC:
            raise ValueError(f"{self.path} has no table of chromosomes")
        found, todo = {}, [at + 32]
        while todo:
            node = todo.pop()
            leaf, _, n = struct.unpack(order + "BBH", self._read(node, 4))
            size = key + 8
            raw = self._read(node + 4, n * size)
            for i in range(n):
                name, rest = raw[i * size : i * size + key].rstrip(b"\0").decode(), raw[i * size + key : (i + 1) * size]
                if leaf:
                    found[name] = struct.unpack(order + "II", rest)
                else:
                    todo.append(struct.unpack(order + "Q", rest)[0])
        return found

    def _node(self, at: int) -> tuple[int, np.ndarray]:
        """Whether an index node is a leaf, and its entries."""
        order = self.header.order
        leaf, _, n = struct.unpack(order + "BBH", self._read(at, 4))
        kind = (LEAF if leaf else INNER).newbyteorder(order)
        return leaf, np.frombuffer(self._read(at + 4, n * kind.itemsize), kind)

    def blocks(self, wanted: set[int] | None = None, span: tuple[int, int] | None = None, low: tuple[int, int] | None = None, high: tuple[int, int] | None = None) -> list[tuple[int, int]]:
        """Offset and size of the data blocks that touch the chromosomes, of one chromosome the bases [low, high) of `span`, and the
        genome from `low` up to `high`, places of (number, base)."""
        found, todo = [], [self.header.index + 48]
        numbers = None if wanted is None else np.array(sorted(wanted), np.int64)
        while todo:
            leaf, rows = self._node(todo.pop())
            keep = np.ones(len(rows), bool)
            if low is not None:
                keep &= (rows["c2"] > low[0]) | ((rows["c2"] == low[0]) & (rows["b2"] > low[1]))
            if high is not None:
                keep &= (rows["c1"] < high[0]) | ((rows["c1"] == high[0]) & (rows["b1"] < high[1]))
            if span is not None:
                keep &= (rows["c1"] != rows["c2"]) | ((rows["b2"] > span[0]) & (rows["b1"] < span[1]))
            if numbers is not None:
                keep &= np.searchsorted(numbers, rows["c1"], "left") < np.searchsorted(numbers, rows["c2"], "right")
            rows = rows[keep]
            if leaf:
                found += zip(rows["at"].tolist(), rows["size"].tolist(), strict=True)
            else:
                todo += rows["at"].tolist()
        return sorted(found)

    def splits(self, n: int) -> list[tuple[int, int]]:
        """Places that part the sections into about `n` equal groups: where nodes of the first level with enough of them begin."""
        leaf, rows = self._node(self.header.index + 48)
        while not leaf and len(rows) < n:
            found = [self._node(at) for at in rows["at"].tolist()]
            leaf, rows = found[0][0], np.concatenate([r for _, r in found])
        order = np.lexsort((rows["b1"], rows["c1"]))
        chosen = rows[order[np.arange(1, n) * len(rows) // n]] if len(rows) else rows
        return list(zip(chosen["c1"].tolist(), chosen["b1"].tolist(), strict=True))

    def columns(self, blocks: Iterable[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of every block the chromosome's number and arrays of start (0-based), end, value."""
        order = self.header.order
        for at, size in blocks:
            raw = self._read(at, size)
            raw = zlib.decompress(raw) if self.header.packed else raw
            chrom, start, _, step, span, kind, _, n = struct.unpack_from(order + SECTION[1:], raw)
            if kind not in ITEM:
                raise ValueError(f"{self.path} has a section of unknown kind {kind}")
            items = np.frombuffer(raw, ITEM[kind].newbyteorder(order), n, 24)
            a = start + np.arange(n, dtype=np.int64) * step if kind == FIXED else items["a"].astype(np.int64)
            yield chrom, a, items["b"].astype(np.int64) if kind == BEDGRAPH else a + span, items["v"].astype(float)

    def records(self, blocks: Iterable[tuple[int, int]]) -> Iterator[tuple[str, int, int, float]]:
        """Chromosome, start (0-based), end, value."""
        for chrom, *arrays in self.columns(blocks):
            for a, b, v in zip(*(x.tolist() for x in arrays), strict=True):
                yield self.named[chrom], a, b, v


LEAF = np.dtype([("c1", "<u4"), ("b1", "<u4"), ("c2", "<u4"), ("b2", "<u4"), ("at", "<u8"), ("size", "<u8")])
INNER = np.dtype(LEAF.descr[:-1])
ITEM = {BEDGRAPH: np.dtype([("a", "<u4"), ("b", "<u4"), ("v", "<f4")]), VARIABLE: np.dtype([("a", "<u4"), ("v", "<f4")]), FIXED: np.dtype([("v", "<f4")])}


def _tree(entries: np.ndarray, base: int) -> bytes:
    """R-tree nodes over leaf entries, the root first."""
    levels = [entries]
    while len(levels[0]) > FAN_OUT:
        low, first = levels[0], np.arange(0, len(levels[0]), FAN_OUT)
        far = np.maximum.reduceat(low["c2"].astype(np.uint64) << np.uint64(32) | low["b2"].astype(np.uint64), first)
        up = np.zeros(len(first), INNER)
        up["c1"], up["b1"], up["c2"], up["b2"] = low["c1"][first], low["b1"][first], far >> np.uint64(32), far & np.uint64(0xFFFFFFFF)
        levels.insert(0, up)
    out, at = [], base
    for depth, level in enumerate(levels):
        leaf = depth == len(levels) - 1
        starts = range(0, max(1, len(level)), FAN_OUT)
        at += 4 * len(starts) + level.nbytes
        if not leaf:  # a child holds FAN_OUT entries but for the last
            child = 4 + FAN_OUT * levels[depth + 1].itemsize
            level["at"] = at + np.arange(len(level)) * child
        for i in starts:
            node = level[i : i + FAN_OUT]
            out += [struct.pack("<BBH", leaf, 0, len(node)), node.tobytes()]
    return b"".join(out)


def _names_tree(names: list[str], lengths: dict[str, int], at: int) -> bytes:
    """The B+ tree of names in order, the root first; a node holds FAN_OUT names at most."""
    key = max([1, *(len(n.encode()) for n in names)])
    keys = [n.encode().ljust(key, b"\0") for n in names]
    fan_out = min(FAN_OUT, max(1, len(names)))
    levels = [[(k, struct.pack("<II", i, lengths[n])) for i, (k, n) in enumerate(zip(keys, names, strict=True))]]
    while len(levels[0]) > fan_out:
        levels.insert(0, [(k, b"") for k, _ in levels[0][::fan_out]])
    out, end = [struct.pack("<IIIIQQ", CHROM_MAGIC, fan_out, key, 8, len(names), 0)], at + 32
    for depth, level in enumerate(levels):
        leaf = depth == len(levels) - 1
        starts = range(0, max(1, len(level)), fan_out)
        end += 4 * len(starts) + (key + 8) * len(level)
        for i in starts:
            node = level[i : i + fan_out]
            out.append(struct.pack("<BBH", leaf, 0, len(node)))
            # a child holds fan_out names but for the last
            out += [k + (v if leaf else struct.pack("<Q", end + (i + j) * (4 + fan_out * (key + 8)))) for j, (k, v) in enumerate(node)]
    return b"".join(out)


#: A section: at most ITEMS ranges of a chromosome, packed, with what header and index need to know of it.
SECTION_ROWS = "chrom int, low long, high long, raw int, bases double, least double, most double, total double, squares double, packed binary"


def packed_sections(batches: Iterable[tuple[np.ndarray, ...]]) -> Iterator[tuple]:
    """Sections of batches of arrays (chromosome's number, start, end, value), 0-based and half-open, sorted by number and start."""

    def packed(chrom, a, b, v) -> tuple:
        items = np.empty(len(a), ITEM[BEDGRAPH])
        items["a"], items["b"], items["v"] = a, b, v
        raw = struct.pack(SECTION, chrom[0], a[0], b[-1], 0, 0, BEDGRAPH, 0, len(a)) + items.tobytes()
        n = (b - a).astype(float)
        return int(chrom[0]), int(a[0]), int(b.max()), len(raw), n.sum(), v.min(), v.max(), (n * v).sum(), (n * v * v).sum(), zlib.compress(raw)

    held: list[np.ndarray] = []
    for batch in batches:
        rows = [np.concatenate(x) for x in zip(held, batch, strict=True)] if held else list(batch)
        held = []
        if not len(rows[0]):
            continue
        edges = [0, *(np.flatnonzero(np.diff(rows[0])) + 1).tolist(), len(rows[0])]
        for low, high in zip(edges, edges[1:], strict=False):
            for i in range(low, high, ITEMS):
                part = [x[i : min(i + ITEMS, high)] for x in rows]
                if high == edges[-1] and len(part[0]) < ITEMS:
                    held = part  # the next batch may go on with it
                else:
                    yield packed(*part)
    if held:
        yield packed(*held)


@dataclass(frozen=True)
class Totals:
    """What is known of all sections together."""

    count: int = 0
    size: int = 0
    raw: int = 0
    bases: float = 0.0
    least: float = 0.0
    most: float = 0.0
    total: float = 0.0
    squares: float = 0.0


def bigwig_parts(sections: Iterable[tuple[int, int, int, bytes]], known: Totals, lengths: dict[str, int]) -> Iterator[bytes]:
    """A file, part by part, of sections (chromosome's number, low, high, packed) in order; only index entries are held."""
    names = sorted(lengths)
    tree_at = 64 + 40
    tree = _names_tree(names, lengths, tree_at)
    data_at = tree_at + len(tree)
    index_at = data_at + 8 + known.size
    yield struct.pack(HEADER, MAGIC, 4, 0, tree_at, data_at, index_at, 0, 0, 0, 64, known.raw, 0)
    yield struct.pack(SUMMARY, int(known.bases), known.least, known.most, known.total, known.squares)
    yield tree + struct.pack("<Q", known.count)
    entries, at = np.zeros(known.count, LEAF), data_at + 8
    for i, (chrom, low, high, packed) in enumerate(sections):
        entries[i] = chrom, low, chrom, high, at, len(packed)
        at += len(packed)
        yield packed
    if at != index_at:
        raise ValueError("sections are missing")
    ends = (*entries[0].item()[:2], *entries[-1].item()[2:4]) if known.count else (0, 0, 0, 0)
    yield struct.pack("<IIQIIIIQII", INDEX_MAGIC, FAN_OUT, known.count, *ends, index_at, ITEMS, 0) + _tree(entries, index_at + 48)


def bigwig_bytes(rows: Iterable[tuple[str, int, int, float]], lengths: dict[str, int]) -> bytes:
    """A small file of rows (chromosome, start, end, value), 0-based and half-open."""
    number = {n: i for i, n in enumerate(sorted(lengths))}
    ordered = sorted((number[c], a, b, v) for c, a, b, v in rows)
    found = list(packed_sections([tuple(np.array(x) for x in zip(*ordered, strict=True))])) if ordered else []
    known = Totals(len(found), sum(len(s[-1]) for s in found), max(s[3] for s in found), sum(s[4] for s in found), min(s[5] for s in found), max(s[6] for s in found), sum(s[7] for s in found), sum(s[8] for s in found)) if found else Totals()
    return b"".join(bigwig_parts([(*s[:3], s[-1]) for s in found], known, lengths))


SCHEMA = "seqname string, start long, end long, score double, path string"


@dataclass
class Tile(InputPartition):
    """The ranges of a file that begin from `low` on and before `high`, places of (chromosome's number, base); None: no bound."""

    path: str
    low: tuple[int, int] | None = None
    high: tuple[int, int] | None = None


class BigWigReader(DataSourceReader):
    """As many partitions for each file as its packed data make up tasks; tiles are kept whole."""

    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options["path"].split(",") if p]
        self.tile = int(options.get("tileWidth", 0))
        self.chroms: set[str] | None = None

    def partitions(self):
        """Stretches of files with about TASK_BYTES of packed data, cut where sections begin or, given a width of tiles, at a tile."""
        out, tile = [], max(1, self.tile)
        for p in self.paths:
            file = BigWig(p)
            tasks = -(-max(0, file.header.index - file.header.data) // TASK_BYTES)
            edges: list = sorted({(c, b // tile * tile) for c, b in file.splits(tasks)}) if tasks > 1 else []
            out += [Tile(p, low, high) for low, high in zip([None, *edges], [*edges, None], strict=True)]
        return out

    def read(self, partition: Tile):
        file, low, high = BigWig(partition.path), partition.low, partition.high
        names = np.empty(max(file.named, default=-1) + 1, object)
        for number, name in file.named.items():
            names[number] = name
        wanted = None if self.chroms is None else {number for number, name in file.named.items() if name in self.chroms}
        held, size = [], 0
        for chrom, a, b, v in file.columns(file.blocks(wanted, low=low, high=high)):
            if wanted is not None and chrom not in wanted:
                continue
            if (low is not None and chrom <= low[0]) or (high is not None and chrom >= high[0]):  # a range belongs to the tile it begins in
                own = np.ones(len(a), bool)
                if low is not None:
                    own &= (chrom > low[0]) | ((chrom == low[0]) & (a >= low[1]))
                if high is not None:
                    own &= (chrom < high[0]) | ((chrom == high[0]) & (a < high[1]))
                a, b, v = a[own], b[own], v[own]
            held.append((np.full(len(a), chrom), a, b, v))
            size += len(a)
            if size >= BATCH:
                yield _batch(held, names, partition.path)
                held, size = [], 0
        if size:
            yield _batch(held, names, partition.path)


def _batch(held: list, names: np.ndarray, path: str) -> pa.RecordBatch:
    chrom, a, b, v = (np.concatenate(x) for x in zip(*held, strict=True))
    columns = [pa.array(names[chrom], pa.string()), pa.array(a + 1, pa.int64()), pa.array(b, pa.int64()), pa.array(v, pa.float64()), pa.array([path] * len(a), pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["seqname", "start", "end", "score", "path"])


class SelectiveReader(BigWigReader):
    """Filters on seqname select chromosomes before anything is read."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("seqname",):
                self._only({f.value})
            elif isinstance(f, In) and f.attribute == ("seqname",):
                self._only(set(f.value))
            yield f  # Spark looks again at all of them

    def _only(self, names: set) -> None:
        self.chroms = names if self.chroms is None else self.chroms & names


class BigWigSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BigWigReader:
        return (SelectiveReader if self.options.get("pushdown") == "true" else BigWigReader)(self.options)


def read_bigwig(spark, paths: str | list[str], strand: str, tile_width: int | None = None):
    """seqname, start, end, strand, score and path of BigWig files."""
    spark.dataSource.register(BigWigSource)
    reader = spark.read.format("bigwig").option("path", paths if isinstance(paths, str) else ",".join(paths))
    # Spark hands filters to Python sources only where the session allows it
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    rows = reader.option("tileWidth", tile_width or 0).option("pushdown", pushdown).load()
    return rows.select("seqname", "start", "end", F.lit(strand).alias("strand"), "score", "path")


def write_bigwig(df, seqinfo, path: str) -> None:
    """Write ranges with scores as one BigWig file.

    Tasks sort and pack ranges of the genome into sections; as a file has one index, a last task lines the packed sections up,
    holding one of them and 32 bytes for each.
    """
    lengths = {r.seqname: int(r.seqlength) for r in seqinfo.select("seqname", "seqlength").collect()}
    number = {n: i for i, n in enumerate(sorted(lengths))}

    def pack(batches):
        arrays = ((t["seqname"].map(number.__getitem__).to_numpy(np.int64), t["start"].to_numpy(np.int64) - 1, t["end"].to_numpy(np.int64), t["score"].to_numpy(float)) for t in batches if len(t))
        for some in batched(packed_sections(arrays), SECTIONS):
            yield pd.DataFrame(some, columns=fields)

    fields = [x.split()[0] for x in SECTION_ROWS.split(", ")]
    ordered = df.select("seqname", "start", "end", F.col("score").cast("double").alias("score")).repartitionByRange("seqname", "start").sortWithinPartitions("seqname", "start")
    sections = settled(ordered.mapInPandas(pack, SECTION_ROWS))
    size = F.sum(F.length("packed"))
    known = Totals(*sections.agg(F.count(F.lit(1)), size, F.max("raw"), F.sum("bases"), F.min("least"), F.max("most"), F.sum("total"), F.sum("squares")).first())

    def write(found, known) -> None:
        where, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        with where.open_output_stream(name, compression=None) as out:
            for part in bigwig_parts(found, known, lengths):
                out.write(part)

    def line_up(batches):
        write((s for t in batches for s in t.itertuples(index=False, name=None)), known)
        yield pd.DataFrame({"sections": [known.count]})

    if known.count:
        sections.select("chrom", "low", "high", "packed").repartition(1).sortWithinPartitions("chrom", "low").mapInPandas(line_up, "sections long").collect()
    else:
        write((), Totals())
