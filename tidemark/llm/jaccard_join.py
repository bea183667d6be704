"""Similarity join on word n-grams: candidates from MinHash bands, pruned by Bayes' rule, verified exactly.

A document is the set of its five-word shingles (lower case, split at white space); shorter texts are one shingle.
Documents with equal sets form a class and are represented by one of them.  Representatives meet in the buckets
of `BANDS` MinHash bands of `ROWS` values: a pair at the threshold of 0.8 shares no band with a probability of
5e-8.  A pair is looked at in every band it shares.  Its MinHash values are compared `STEP` at a time; as
soon as the posterior probability that its similarity reaches the threshold falls below `TOLERANCE`, it is
dropped.  Survivors' components decide which texts meet again for verification: there all pairs of a component are
pruned in the same way and the rest compared exactly, set by set.

Buckets and components of more than `BLOCK` members are dealt out as pairs of blocks, so that no task sees an unbounded
group; pairs are never rows: a task returns spanning forests and sums of links.

Defined results: null text is empty; texts without words have no links and are classes of their own; a row given
twice is a copy of itself; class_id is the smallest id of the class, null only where no row has one; n_links
counts the other rows of similarity 0.8 or more, copies included; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, narrowed, partitions, row_key, whole_text, without
from .components import connected_components, with_group_value

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS, STEP, TOLERANCE = 32, 4, 16, 1e-7
HASHES = BANDS * ROWS
BLOCK, LARGE_BLOCK, SALTS = 256, 2048, 16
_rng = np.random.default_rng(20_240_504)
MULTIPLY = _rng.integers(0, 1 << 62, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
P1, P2 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * P1
    x = (x ^ (x >> np.uint64(29))) * P2
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Distinct 64-bit shingle hashes of texts; word hashes are remembered, up to a bound."""

    def __init__(self, n: int = WORDS, most: int = 100_000) -> None:
        self.n, self.most, self.seen = n, most, {}

    def __call__(self, text: str) -> np.ndarray:
        ws = text.lower().split()
        if not ws:
            return np.zeros(0, dtype=np.uint64)
        if len(self.seen) > self.most:
            self.seen.clear()
        seen = self.seen
        for w in set(ws).difference(seen):
            seen[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        h = np.fromiter(map(seen.__getitem__, ws), dtype=np.uint64, count=len(ws))
        n = min(self.n, len(ws))
        total = np.zeros(len(h) - n + 1, dtype=np.uint64)
        for k in range(n):
            total = total * P2 + mixed(h[k : len(h) - n + 1 + k] + np.uint64(k + 1))
        return np.unique(mixed(total + np.uint64(n)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of a set, 32 bits each."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for low in range(0, len(shingles), 256):
        np.minimum(least, (shingles[low : low + 256, None] * MULTIPLY + ADD).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def short(sig: np.ndarray) -> np.ndarray:
    """Eight bits of every MinHash value, to compare pairs with."""
    return (sig * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, step: int = STEP, total: int = HASHES) -> dict[int, int]:
    """For every number of values compared, the fewest matches with which a pair stays: with a uniform prior on the similarity,
    fewer make P(similarity >= threshold) fall below the tolerance.  Unequal values agree in eight bits once in 256."""
    s = (np.arange(20_000) + 0.5) / 20_000
    match = s + (1 - s) / 256
    out = {}
    for n in range(step, total + 1, step):
        for m in range(n + 1):
            log = m * np.log(match) + (n - m) * np.log1p(-match)
            weight = np.exp(log - log.max())
            if weight[s >= threshold].sum() >= tolerance * weight.sum():
                out[n] = m
                break
    return out


FEWEST = least_matches()


def surviving_pairs(one: np.ndarray, two: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of `one` and `two` (or of `one` with itself, i < j) that Bayesian pruning leaves."""
    other = one if two is None else two
    kept = []
    for low in range(0, len(one), 256):
        part = one[low : low + 256]
        for start in range(0 if two is not None else low, len(other), 256):
            piece = other[start : start + 256]
            same = np.zeros((len(part), len(piece)), dtype=np.uint8)
            for k in range(STEP):
                same += part[:, k, None] == piece[None, :, k]
            i, j = np.nonzero(same >= FEWEST[STEP])
            if two is None:
                later = i + low < j + start
                i, j = i[later], j[later]
            matches = same[i, j].astype(np.int32)
            for n in range(2 * STEP, HASHES + 1, STEP):
                if not len(i):
                    break
                matches += (part[i, n - STEP : n] == piece[j, n - STEP : n]).sum(1, dtype=np.int32)
                stay = matches >= FEWEST[n]
                i, j, matches = i[stay], j[stay], matches[stay]
            kept.append((i + low, j + start))
    if not kept:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([a for a, _ in kept]), np.concatenate([b for _, b in kept])


def forest(pairs) -> list[tuple[int, int]]:
    """Every node of the pairs with the root of its component, roots left out."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, r) for x in parent if (r := root(x)) != x]


def least_members(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of the numbers below n, the least one of its component under the pairs (a, b)."""
    least = np.arange(n)
    while len(a):
        x, y = least[a], least[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while ((up := least[least]) != least).any():
            least = up
    return least


def by_group(batches, names: list[str]):
    """Groups of rows with equal values of `names` from batches sorted by them, as lists of columns."""
    held, columns = None, None
    for batch in batches:
        if not len(batch):
            continue
        columns = list(batch.columns)
        batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
        new = np.zeros(len(batch), dtype=bool)
        for n in names:
            v = batch[n].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(new).tolist()]
        values = {c: batch[c].to_numpy() for c in columns}
        for low, high in zip(cuts, cuts[1:], strict=False):
            yield {c: v[low:high] for c, v in values.items()}
        held = batch.iloc[cuts[-1] :]
    if held is not None and len(held):
        yield {c: held[c].to_numpy() for c in columns}


def in_blocks(rows: DataFrame, group: str, size: Column, member: str) -> DataFrame:
    """Rows once for every pair of blocks (i <= j) of their group that they belong to, as columns i, j and own."""
    block = F.when(size > 20 * LARGE_BLOCK, LARGE_BLOCK).otherwise(BLOCK)
    rows = rows.withColumn("__n", F.ceil(size / block).cast("int")).withColumn("own", F.pmod(F.xxhash64(group, member), F.col("__n").cast("long")).cast("int"))
    rows = rows.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    return rows.withColumn("i", F.least("own", "__other")).withColumn("j", F.greatest("own", "__other")).drop("__n", "__other")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)


def signatures(rows: DataFrame) -> DataFrame:
    """From key, doc_id, text: the set's size and 128-bit fingerprint, hashes of its bands, and the short signature."""

    def run(batches):
        shingler = Shingler()
        for batch in batches:
            out = []
            for text in batch.text:
                s = shingler(text)
                if not len(s):
                    out.append((0, 0, 0, None, None))
                    continue
                sig = signature(s)
                bands = np.zeros(BANDS, dtype=np.uint64)
                for k in range(ROWS):
                    bands = mixed(bands * P2 + sig.reshape(BANDS, ROWS)[:, k])
                bands = mixed(bands + np.arange(BANDS, dtype=np.uint64))
                out.append((len(s), *np.array([mixed(s).sum(), mixed(s ^ P1).sum()], dtype=np.uint64).view(np.int64).tolist(), bands.view(np.int64), short(sig).tobytes()))
            frame = pd.DataFrame(out, columns=["n", "s1", "s2", "bands", "sig"])
            frame.insert(0, "doc_id", batch.doc_id.to_numpy())
            frame.insert(0, "key", batch.key.to_numpy())
            yield frame

    return rows.mapInPandas(run, "key long, doc_id long, n long, s1 long, s2 long, bands array<long>, sig binary")


def candidate_links(reps: DataFrame) -> DataFrame:
    """Forests (a, b) over pairs of representatives (rep, bands, sig) that Bayesian pruning leaves in any bucket."""
    spread = reps.select("rep", F.explode("bands").alias("bucket"))
    sizes = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = spread.join(sizes, "bucket").join(reps.select("rep", "sig"), "rep")
    members = in_blocks(members, "bucket", F.col("size"), "rep").select("bucket", "i", "j", "own", "rep", "sig")

    def run(batches):
        edges: list = []
        for g in by_group(batches, ["bucket", "i", "j"]):
            order = np.argsort(g["rep"])  # the same members give the same forest in every band
            sig = np.frombuffer(b"".join(g["sig"]), dtype=np.uint8).reshape(-1, HASHES)[order]
            rep, own, i, j = g["rep"][order], g["own"][order], g["i"][0], g["j"][0]
            if i == j:
                a, b = surviving_pairs(sig, None)
            else:
                left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
                a, b = surviving_pairs(sig[left], sig[right])
                a, b = left[a], right[b]
            least = least_members(a, b, len(rep))
            linked = np.flatnonzero(least < np.arange(len(rep)))
            edges += zip(rep[linked].tolist(), rep[least[linked]].tolist(), strict=True)
            if len(edges) > 50_000:
                yield pd.DataFrame(edges, columns=["a", "b"])
                edges = []
        yield pd.DataFrame(edges, columns=["a", "b"]).astype("int64")

    return dealt(members, "bucket", "i", "j").mapInPandas(run, "a long, b long")


def jaccard(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def verified_links(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """From rep, copies, text, root, size: forests over the exact links as rows (a, b, null), and the linked rows of every
    representative as rows (rep, null, links)."""
    members = in_blocks(members, "root", F.col("size"), "rep").select("root", "i", "j", "own", "rep", "copies", "text")

    def run(batches):
        shingler, out = Shingler(), []
        for g in by_group(batches, ["root", "i", "j"]):
            arrays = [shingler(t) for t in g["text"]]
            sig = short(np.stack([signature(s) for s in arrays]))
            sets: dict[int, set] = {}
            rep, copies, i, j = g["rep"].tolist(), g["copies"].tolist(), g["i"][0], g["j"][0]
            left, right = np.flatnonzero(g["own"] == i), np.flatnonzero(g["own"] == j)
            a, b = surviving_pairs(sig[left], None if i == j else sig[right])
            links, exact = {}, []
            for x, y in zip(left[a].tolist(), right[b].tolist(), strict=True):
                p, q = len(arrays[x]), len(arrays[y])
                if min(p, q) < threshold * max(p, q):
                    continue
                for z in (x, y):
                    if z not in sets:
                        sets[z] = set(arrays[z].tolist())
                if jaccard(sets[x], sets[y]) >= threshold:
                    exact.append((rep[x], rep[y]))
                    links[x] = links.get(x, 0) + copies[y]
                    links[y] = links.get(y, 0) + copies[x]
            out += [(p, q, None) for p, q in forest(exact)] + [(rep[x], None, n) for x, n in links.items()]
            if len(out) > 50_000:
                yield _links(out)
                out = []
        yield _links(out)

    return dealt(members, "root", "i", "j").mapInPandas(run, "a long, b long, links long")


def _links(rows: list) -> pd.DataFrame:
    columns = zip(*rows, strict=True) if rows else ([], [], [])
    return pd.DataFrame({n: pd.array(list(c), dtype="Int64") for n, c in zip(("a", "b", "links"), columns, strict=True)})


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, class_id, n_links, and key, which tells rows with equal ids but unequal texts apart."""
    rows = narrowed(docs, [id_col, text_col]).select(row_key(id_col, text_col).alias("key"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    signed = materialize(signatures(rows), "signatures")
    sets = signed.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least_id"))
    sets = materialize(sets, "sets")
    reps = signed.select(F.col("key").alias("rep"), "bands", "sig").join(sets.select("rep"), "rep", "left_semi").dropDuplicates(["rep"])
    near = connected_components(candidate_links(reps))
    near = with_group_value(near, "root", "node", "size", F.count(F.lit(1)), F.sum("size")).join(sets.select(F.col("rep").alias("node"), "copies"), "node")
    texts = rows.select(F.col("key").alias("node"), "text").join(near, "node").dropDuplicates(["node"])
    found = materialize(verified_links(texts.select(F.col("node").alias("rep"), "copies", "text", "root", "size")), "verified")
    classes = connected_components(found.filter("b IS NOT NULL").select("a", "b"))
    degrees = found.filter("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    known = sets.join(degrees, "rep", "left").join(classes.select(F.col("node").alias("rep"), "root"), "rep", "left").filter("copies > 1 OR links IS NOT NULL")
    known = known.withColumn("root", F.coalesce("root", "rep"))
    known = with_group_value(known, "root", "rep", "class_id", F.min("least_id"), F.min("class_id")).select("n", "s1", "s2", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    salted = signed.select("key", "doc_id", "n", "s1", "s2", F.pmod("key", F.lit(SALTS).cast("long")).alias("salt"))
    joined = salted.join(known, ["n", "s1", "s2", "salt"], "left")
    alone = F.col("n_links").isNull()
    return joined.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "key")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of every class, that with the smallest id."""
    found = jaccard_join(docs, id_col, text_col)
    return without(docs, found.filter(~F.col("doc_id").eqNullSafe(F.col("class_id"))), id_col, text_col)
