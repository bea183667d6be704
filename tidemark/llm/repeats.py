"""Removal of repeated byte strings, by a sparse suffix array over document bytes.

Every string of `length` bytes holds exactly one anchor: of the `length`/2-byte pieces in it, the first with the
smallest hash.  Equal strings have equal anchors, so suffixes need to be sorted only where anchors begin.  A suffix is
written as fixed-width tokens, fingerprints of its pieces: the leading token is the anchor's piece, the next
one all the text that the strings sharing this anchor cover.  Sampled splitters range-partition the suffixes by
their leading tokens, ties by the rest, so that a frequent string spreads over several buckets; each bucket is
sorted by multikey quicksort over its tokens and compared with its neighbours, across bucket boundaries too.

    1. equal in all tokens: every string at the anchor occurs elsewhere;
    2. equal in the leading token only: the strings at the anchor are sorted again one by one, each as a suffix
       of its own with two fingerprints of its `length` bytes, together with one of each kind of 1 that has the
       same leading token;
    3. unique leading token: no string at the anchor occurs elsewhere.

Defined results: null text is empty; texts under `length` bytes stay whole; rows given twice repeat each other
and lose all strings of that length; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, narrowed, partitions, row_key, whole_text

LENGTH = 400
#: Bytes of a document that are hashed at once; longer documents are read in overlapping stretches.
STRETCH = 1 << 19
_rng = np.random.default_rng(20_240_502)
BYTE_VALUES = _rng.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + _rng.integers(0, 2, (2, 256), dtype=np.uint64)
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and inverse powers modulo 2**64."""
    if which not in _powers or len(_powers[which][0]) < n:
        size = max(n, 1 << 14)
        up, down = (np.full(size, base, dtype=np.uint64) for base in (BASES[which], pow(BASES[which], -1, 1 << 64)))
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        _powers[which] = up, down
    up, down = _powers[which]
    return up[:n], down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


class Prefixes:
    """Fingerprints of any stretch of some bytes, from sums over prefixes."""

    def __init__(self, data: np.ndarray, which: int) -> None:
        up, self.down = powers(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUES[which][data] * up[:-1], out=self.sums[1:])

    def windows(self, width: int) -> np.ndarray:
        s = self.sums
        return mixed((s[width:] - s[:-width]) * self.down[: len(s) - width])

    def stretches(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def sliding_first_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """For every window of `width` values the place of its first smallest."""
    low = np.uint64((1 << 20) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        m = np.minimum(m[: len(m) - span], m[span:])
        span *= 2
    if span < width:
        rest = width - span
        m = np.minimum(m[: len(m) - rest], m[rest:])
    return (m & low).astype(np.int64)


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Leading token, second token, first and last start of the strings at each anchor of a document."""
    n, piece, found = len(data), length // 2, []
    for low in range(0, max(1, n - length + 1), STRETCH):
        part = data[low : low + STRETCH + length - 1]
        if len(part) < length:
            break
        one, two = Prefixes(part, 0), Prefixes(part, 1)
        h = one.windows(piece)
        at = sliding_first_minimum(h, length - piece + 1)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:], [len(at)]]) - 1
        where = at[first]
        tag = ((where - first).astype(np.uint64) << np.uint64(32)) | (last - first).astype(np.uint64)
        second = mixed(two.stretches(first, last + length) + tag * np.uint64(BASES[1]))
        found.append((h[where], second, first + low, last + low))
    if not found:
        empty = np.zeros(0, dtype=np.int64)
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """Multikey quicksort, breadth first: rows are sorted by a token, then only ties by the next one."""
    order = np.argsort(columns[0])
    tied, group = np.arange(len(order)), np.zeros(len(order), dtype=np.int64)
    for done, following in zip(columns, columns[1:], strict=False):
        value = done[order[tied]]
        begins = np.ones(len(tied), dtype=bool)
        begins[1:] = (value[1:] != value[:-1]) | (group[1:] != group[:-1])
        alone = begins.copy()
        alone[:-1] &= begins[1:]
        tied, group = tied[~alone], np.cumsum(begins)[~alone]
        if not len(tied):
            break
        rows = order[tied]
        order[tied] = rows[np.lexsort((following[rows], group))]
    return order


def like_neighbours(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """2 where a sorted row has both tokens of a neighbour, 1 where only the leading one, else 0."""
    status = np.zeros(len(one), dtype=np.int8)
    if len(one) > 1:
        lead = one[1:] == one[:-1]
        pair = np.where(lead & (two[1:] == two[:-1]), 2, lead.astype(np.int8)).astype(np.int8)
        status[1:] = pair
        status[:-1] = np.maximum(status[:-1], pair)
    return status


def representatives(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Of sorted rows, the first of each run of equal rows whose leading token also has other second tokens."""
    n = len(one)
    lead, new = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
    lead[1:] = one[1:] != one[:-1]
    new[1:] = lead[1:] | (two[1:] != two[:-1])
    group = np.cumsum(lead) - 1
    return new & (np.bincount(group, weights=new)[group] > 1)


STATUS = "key long, first long, last long, status byte, speaks boolean, edge byte, bucket int, one long, two long"


def repeated_suffixes(suffixes: DataFrame, tag: str, least: int) -> DataFrame:
    """Of rows (one, two, key, first, last) those whose status is `least` at least: 2 for a suffix equal to another one in
    both tokens, 1 for one equal in the leading token.  `speaks` marks one at least of those that are equal in both
    tokens, where others share only the leading one."""
    spark = suffixes.sparkSession
    dealt = suffixes.select("one", "two", "key", "first", "last").repartitionByRange(partitions(spark), "one", "two", "key", "first")

    def bucket(batches):
        parts = [[b[c].to_numpy() for c in ("one", "two", "key", "first", "last")] for b in batches if len(b)]
        if not parts:
            return
        one, two, key, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        order = multikey_order([one, two])
        status = like_neighbours(one[order], two[order])
        edge = np.zeros(len(order), dtype=np.int8)
        edge[0], edge[-1] = 1, 2 if len(order) > 1 else 3
        speaks = representatives(one[order], two[order])
        keep = np.flatnonzero((status >= least) | (edge > 0))
        rows = order[keep]
        for low in range(0, len(rows), 100_000):
            r, k = rows[low : low + 100_000], keep[low : low + 100_000]
            yield pd.DataFrame({"key": key[r], "first": first[r], "last": last[r], "status": status[k], "speaks": speaks[k], "edge": edge[k], "bucket": np.int32(TaskContext.get().partitionId()), "one": one[r], "two": two[r]})

    found = materialize(dealt.mapInPandas(bucket, STATUS), tag)
    # two rows a bucket at most: compare the last of each bucket with the first of the next
    edges = sorted(found.filter("edge > 0").collect(), key=lambda r: (r.bucket, r.edge))
    right = {i: like_neighbours(np.array([a.one, b.one]), np.array([a.two, b.two]))[0] for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a.bucket != b.bucket}
    fixed = [(r.key, r["first"], r["last"], int(max(r.status, right.get(i, 0), right.get(i - 1, 0))), r.speaks or 1 in (right.get(i), right.get(i - 1))) for i, r in enumerate(edges)]
    fixed = spark.createDataFrame([r for r in fixed if r[3] >= least], "key long, first long, last long, status int, speaks boolean")
    return found.filter("edge = 0").select("key", "first", "last", F.col("status").cast("int").alias("status"), "speaks").unionByName(fixed)


def find_spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """From rows (key, text) the starts of all repeated strings, as (key, first, last) stretches of starts."""

    def suffix_rows(batches):
        for batch in batches:
            out: list = []
            for key, text in zip(batch.key.to_numpy(), batch.text, strict=True):
                if len(text) * 4 >= length:
                    one, two, first, last = anchors(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), length)
                    if len(one):
                        out.append((one, two, np.full(len(one), key), first, last))
            if out:
                one, two, key, first, last = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pd.DataFrame({"one": one.view(np.int64), "two": two.view(np.int64), "key": key, "first": first, "last": last})

    schema = "one long, two long, key long, first long, last long"
    found = materialize(repeated_suffixes(rows.mapInPandas(suffix_rows, schema), "anchors", 1), "anchored")

    def string_rows(batches):
        for batch in batches:
            out: list = []
            for key, text, runs in zip(batch.key.to_numpy(), batch.text, batch.runs, strict=True):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
                for run in runs:
                    part = data[run["first"] : run["last"] + length]
                    one, two = Prefixes(part, 0).windows(length), Prefixes(part, 1).windows(length)
                    first = np.arange(run["first"], run["last"] + 1)
                    out.append((one, two, np.full(len(one), key), first))
            if out:
                one, two, key, first = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pd.DataFrame({"one": one.view(np.int64), "two": two.view(np.int64), "key": key, "first": first, "last": first})

    runs = found.filter("status = 1 OR speaks").groupBy("key").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("runs"))
    again = repeated_suffixes(rows.join(runs, "key").mapInPandas(string_rows, schema), "strings", 2)
    return found.filter("status = 2").select("key", "first", "last").unionByName(again.select("key", "first", "last"))


def covered(runs, length: int) -> list[tuple[int, int]]:
    """The maximal stretches of bytes [start, end) covered by the strings that begin in the runs."""
    spans: list[list[int]] = []
    for first, last in runs:
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], last + length)
        else:
            spans.append([first, last + length])
    return [tuple(s) for s in spans]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start:end, joined by commas)."""
    rows = narrowed(docs, [id_col, text_col]).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), whole_text(text_col).alias("text")).withColumn("key", row_key("doc_id", "text"))
    runs = find_spans(rows.select("key", "text"), length).groupBy("key").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("runs"))

    def cut(batches):
        for batch in batches:
            out = []
            for text, runs in zip(batch.text, batch.runs, strict=True):
                data = text.encode("utf-8", "surrogatepass")
                spans = [] if runs is None else covered(((r["first"], r["last"]) for r in runs), length)
                kept, at = hashlib.sha256(), 0
                for start, end in spans:
                    kept.update(data[at:start])
                    at = end
                kept.update(data[at:])
                out.append((len(data), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), ",".join(f"{a}:{b}" for a, b in spans)))
            frame = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])
            frame.insert(0, "doc_id", batch.doc_id.to_numpy())
            yield frame

    return rows.join(runs, "key", "left").select("doc_id", "text", "runs").mapInPandas(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string")
