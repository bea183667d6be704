"""Benchmark decontamination: latent semantic retrieval, then longest-common-subsequence and answer checks.

Documents are read once into the places and numbers of the terms that the benchmark knows.  Terms are weighted by
their inverse document frequency over all documents.  A passage is two neighbouring blocks of `BLOCK` words.  The
matrix A has the TF-IDF passages of all documents that could match an item, and the benchmark's own, whose rows weigh
`EMPHASIS` times as much as all others together.  A distributed randomised SVD gives its leading `RANK` right singular
vectors: partitions sum A'(A Q), a sum whose size depends on the benchmark's terms alone, once for a random Q and once for the
orthonormal basis of that, and the small matrix (A Q)'(A Q) of the second is decomposed.  Every passage is compared with
every item by cosine in blocks; a passage of cosine `LEAST_COSINE` or more is a candidate for the item.  Items longer than a
passage are searched for as a whole and by overlapping pieces of a passage's length.

A candidate is verified on the words around it: of windows a little longer than the item, the best longest
common subsequence must hold `SURE` of the item's words, or `LIKELY` of them if it also holds `ANSWER` of the
item's last quarter, where answers stand.  Only the item's own words can be common, so their places are all that is needed.
Items of fewer than `LEAST_WORDS` words have no paraphrase to speak of and are found where they stand word for word.

The benchmark is a stated query set.  It is taken in groups of about `GROUP_WORDS` words, each with terms, an SVD and a search of
its own, so that what the driver holds and broadcasts is bounded for any number of items.

Defined results: null texts are empty and match nothing; items without words are not searched for; a document given twice is
found once an item; equal items are each found; tables without rows give none; rows without an id count; further columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibration import summed
from .common import materialize, narrowed, row_key, whole_text, without

BLOCK, RANK, EMPHASIS, SEED = 20, 96, 30.0, 20_240_503
SUM_PARTITIONS = 64
#: Inverse document frequency of terms that always count.
RARE = 4.0
LEAST_COSINE, SURE, LIKELY, ANSWER, LEAST_WORDS = 0.4, 0.75, 0.55, 0.75, 5
#: A window's length as a multiple of the item's.
STRETCH = 1.35
#: Words of the items that are searched for at once; an item is never cut.
GROUP_WORDS = 200_000
WORD = re.compile(r"\w+")
FOUND = "doc_id long, item_id long, lcs double, answer double, cosine double, first_word long, last_word long, key long"


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Terms:
    """Numbers of the items' terms."""

    def __init__(self, items: list[list[str]]) -> None:
        names = sorted({w for item in items for w in item})
        self.size = len(names)
        self.number = {w: i for i, w in enumerate(names)}

    def of(self, ws: list[str]) -> np.ndarray:
        """For every word its number, or -1."""
        return np.fromiter(map(self.number.get, ws, repeat(-1)), dtype=np.int32, count=len(ws))


def queries_of(items: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """What is searched for, and the item that each belongs to: the items, and pieces as long as a passage of those that are longer."""
    queries, of = list(items), list(range(len(items)))
    for i, x in enumerate(items):
        if len(x) > 2 * BLOCK:
            starts = [*range(0, len(x) - 2 * BLOCK, BLOCK), len(x) - 2 * BLOCK]
            queries += [x[s : s + 2 * BLOCK] for s in starts]
            of += [i] * len(starts)
    return queries, np.array(of, dtype=np.int32)


def lcs_length(item: list, ws: list) -> int:
    """Bit-parallel longest common subsequence."""
    masks: dict = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | (1 << i)
    full = (1 << len(item)) - 1
    v = full
    for w in ws:
        u = v & masks.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def best_match(item: list, places: np.ndarray, ws: np.ndarray, low: int, high: int) -> tuple[float, float, int, int]:
    """Share of the item and of its last quarter in the best window of the words [low, high), and that window.

    `places` and `ws` have the words of the document that the item could share; windows count all its words.
    """
    size = max(len(item) + 2, int(STRETCH * len(item)))
    step = max(1, len(item) // 6)
    tail = item[-max(2, len(item) // 4) :]
    best = (0.0, 0.0, low, low)
    high = min(high, int(places[-1]) + 1) if len(places) else low
    starts = np.arange(low, max(low + 1, high - size + step), step)
    first, last = np.searchsorted(places, starts), np.searchsorted(places, np.minimum(starts + size, high))
    for start, a, b in zip(starts.tolist(), first.tolist(), last.tolist(), strict=True):
        if b - a <= best[0] * len(item):
            continue  # too few shared words to be better
        window = ws[a:b].tolist()
        got = lcs_length(item, window) / len(item)
        if got > best[0]:
            best = (got, lcs_length(tail, window) / len(tail), start, min(high, start + size))
    return best


def is_leak(lcs: float, answer: float) -> bool:
    return lcs >= SURE or (lcs >= LIKELY and answer >= ANSWER)


def read_terms(docs: DataFrame, terms) -> DataFrame:
    """doc_id, key, and the known terms as pairs of place and number, 32 bits each."""

    def run(batches):
        for batch in batches:
            pairs = []
            for text in batch.text:
                n = terms.value.of(words(text))
                at = np.flatnonzero(n >= 0)
                pairs.append(np.stack([at, n[at]], axis=1).astype(np.int32).tobytes())
            yield pd.DataFrame({"doc_id": batch.doc_id.astype("Int64"), "key": batch.key, "terms": pairs})

    return docs.mapInPandas(run, "doc_id long, key long, terms binary")


def unpacked(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch: where each document's terms begin, with the end of the last, and all places and numbers."""
    ends = np.cumsum([len(t) // 8 for t in batch.terms])
    pairs = np.frombuffer(b"".join(batch.terms), dtype=np.int32).reshape(-1, 2)
    return np.concatenate([[0], ends]).astype(np.int64), np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])


def document_frequency(read: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Documents that hold each term, and their number, over all documents."""

    def run(batches):
        total = np.zeros(size + 1)
        for batch in batches:
            starts, _, number = unpacked(batch)
            for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False):
                total[np.unique(number[a:b])] += 1
            total[size] += len(batch)
        yield pd.DataFrame({"key": [0], "value": [total.tobytes()]})

    total = summed(read.select("terms").mapInPandas(run, "key int, value binary")).get(0, np.zeros(size + 1))
    return total[:size], int(total[size])


class Weights:
    """Which terms count, and their inverse document frequencies.

    Left out are terms so common that no item needs them: every item keeps the rarer half of its terms, six at least,
    so that an item which stands in much of the corpus can still be found by them.
    """

    def __init__(self, items: list[np.ndarray], frequency: np.ndarray, n: int) -> None:
        self.idf = np.log((n + 1.0) / (frequency + 0.5)).clip(0.05)
        kept = self.idf >= RARE
        for x in items:
            own = np.unique(x)
            own = own[np.argsort(-self.idf[own], kind="stable")]
            kept[own[: max(6, (len(own) + 1) // 2)]] = True
        self.idf[~kept] = 0.0
        self.square = self.idf**2

    def lengths(self, items: list[np.ndarray]) -> np.ndarray:
        return np.sqrt(np.array([self.square[x].sum() for x in items])).clip(1e-3)


def blocks_of(starts: np.ndarray, place: np.ndarray, number: np.ndarray, square: np.ndarray, least: float):
    """Of an unpacked batch: block number and term of the tokens that count, the first block of each document, the passages
    (passage i is block i and the next one) that are at least `least` long.

    Blocks of different documents are never neighbours.  `square` holds the terms' squared weights, 0 for those that don't
    count.  A shorter passage has too little of any item's weight to be near it.
    """
    if not len(place):
        return None
    sizes, last = np.diff(starts), np.full(len(starts) - 1, -1, dtype=np.int64)
    last[sizes > 0] = place[starts[1:][sizes > 0] - 1] // BLOCK
    first = np.concatenate([[0], np.cumsum(last + 2)])
    block = np.repeat(first[:-1], sizes) + place // BLOCK
    own = np.bincount(block, weights=square[number], minlength=int(first[-1]) + 1)
    length = np.sqrt(own[:-1] + own[1:])
    long = length >= least
    long[first[1:] - 1] = False  # between documents
    at = np.flatnonzero(long)
    if not len(at):
        return None
    wanted = np.zeros(len(own), dtype=bool)
    wanted[at] = wanted[at + 1] = True
    use = wanted[block] & (square[number] > 0)
    return block[use], number[use], first, at


def sums_by(heads: np.ndarray, rows: np.ndarray, of: np.ndarray, step: int = 16) -> np.ndarray:
    """Sums of the rows `of[rows]` from each head to the next, `step` rows of every stretch at a time."""
    sizes = np.diff(np.append(heads, len(rows)))
    parts = -(-sizes // step)
    first = np.cumsum(parts) - parts
    start = np.repeat(heads, parts) + step * (np.arange(parts.sum()) - np.repeat(first, parts))
    end = np.minimum(start + step, np.repeat(heads + sizes, parts))
    total = of[rows[start]]
    for k in range(1, step):
        more = np.flatnonzero(start + k < end)
        if not len(more):
            break
        total[more] += of[rows[start[more] + k]]
    out, long = total[first], np.flatnonzero(parts > 1)
    if len(long):
        inside = np.repeat(parts > 1, parts)
        out[long] = np.add.reduceat(total[inside], np.cumsum(parts[long]) - parts[long], axis=0)
    return out


def heads_of(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, dtype=np.int64)


def passages(block: np.ndarray, number: np.ndarray, at: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The projections of the passages `at`."""
    heads = heads_of(block)
    full = block[heads]
    sums = np.vstack([sums_by(heads, number, basis), np.zeros((1, basis.shape[1]), dtype=basis.dtype)])
    return sums[index_in(full, at)] + sums[index_in(full, at + 1)]


def index_in(ordered: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where each x stands in `ordered`, or behind its end."""
    k = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
    return np.where(ordered[k] == x, k, len(ordered))


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-6)


TERM_BLOCK = 4096


def gram_times(read: DataFrame, shape: tuple[int, int], shared) -> tuple[np.ndarray, float]:
    """The sum of A'(A basis) over all passages, and the number of passages; the basis has the weights in it, the sum lacks them."""
    size, rank = shape
    pieces = -(-size // TERM_BLOCK)

    def run(batches):
        w, square, least = shared.value
        z, n = np.zeros((size, rank)), 0
        for batch in batches:
            if (got := blocks_of(*unpacked(batch), square, least)) is None:
                continue
            block, number, _, at = got
            y = passages(block, number, at, w)
            n += len(at)
            # a token of block i stands in the passages i - 1 and i
            both = np.vstack([y, np.zeros((1, rank), dtype=y.dtype)])
            order = np.argsort(number, kind="stable")
            heads = heads_of(number[order])
            z[number[order][heads]] += sums_by(heads, index_in(at, block)[order], both) + sums_by(heads, index_in(at, block - 1)[order], both)
        yield pd.DataFrame({"key": range(pieces + 1), "value": [*[z[i * TERM_BLOCK : (i + 1) * TERM_BLOCK].tobytes() for i in range(pieces)], np.array([float(n)]).tobytes()]})

    found = summed(read.select("terms").coalesce(SUM_PARTITIONS).mapInPandas(run, "key int, value binary"))
    if not found:
        return np.zeros((size, rank)), 0.0
    return np.vstack([found[i].reshape(-1, rank) for i in range(pieces)]), float(found[pieces][0])


def latent_basis(read: DataFrame, items: list[np.ndarray], weights: Weights) -> np.ndarray:
    """Terms by right singular vectors, weights included: sum the rows of a passage's tokens to project it."""
    sc, idf, least = read.sparkSession.sparkContext, weights.idf, LEAST_COSINE * weights.lengths(items).min()
    rank = min(len(idf), RANK)

    def product(q: np.ndarray) -> np.ndarray:
        """A'A q, documents' rows weighed by their number, the benchmark's EMPHASIS times as much together."""
        w = (q * idf[:, None]).astype(np.float32)
        shared = sc.broadcast((w, weights.square, least))  # RANK numbers for each of the group's terms
        z, n = gram_times(read, w.shape, shared)
        shared.unpersist()
        own = np.zeros(w.shape)
        for x in items:
            np.add.at(own, x, w[x].sum(0, dtype=np.float64))
        return (z / max(1.0, n) + EMPHASIS / len(items) * own) * idf[:, None]

    q = np.linalg.qr(product(np.random.default_rng(SEED).standard_normal((len(idf), rank))))[0]
    small = q.T @ product(q)  # (A q)'(A q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    leading = values > 1e-9 * max(values[-1], 1e-30)
    return ((q @ vectors[:, leading][:, ::-1]) * idf[:, None]).astype(np.float32)


def near_blocks(batch: tuple, square: np.ndarray, least: float, w: np.ndarray, goal: np.ndarray, length: np.ndarray):
    """Of an unpacked batch: row, query, block and cosine of all passages near a query.

    The cosine has the query's length for passages that are shorter, so that one rare term is not much alike.
    """
    if not len(goal) or (got := blocks_of(*batch, square, least)) is None:
        return
    block, number, first, at = got
    for low in range(0, len(at), 20_000):
        some = at[low : low + 20_000]
        a, b = np.searchsorted(block, [some[0], some[-1] + 2])
        y = passages(block[a:b], number[a:b], some, w)
        own = np.sqrt((y * y).sum(1))
        for start in range(0, len(goal), 2_000):
            cosine = y @ goal[start : start + 2_000].T
            a, b = np.nonzero(cosine >= LEAST_COSINE)
            value = cosine[a, b] / np.maximum(1.0, own[a] / length[start + b])
            near = value >= LEAST_COSINE
            where = some[a[near]]
            row = np.searchsorted(first, where, side="right") - 1
            yield row, b[near] + start, where - first[row], np.minimum(value[near], 1.0)


def by_pair(found, of: np.ndarray):
    """Row, item, blocks in order and largest cosine of every pair of a document and an item in the arrays `found`."""
    parts = [(row, of[query], block, cosine) for row, query, block, cosine in found if len(row)]
    if not parts:
        return
    row, item, block, cosine = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((block, item, row))
    row, item, block, cosine = row[order], item[order], block[order], cosine[order]
    heads = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1])]))
    most = np.maximum.reduceat(cosine, heads)
    for k, (a, b) in enumerate(zip(heads.tolist(), [*heads[1:].tolist(), len(row)], strict=True)):
        yield int(row[a]), int(item[a]), block[a:b].tolist(), float(most[k])


def stretches_of(blocks: list[int], size: int) -> list[tuple[int, int]]:
    """Words around the passages that begin at the blocks, a whole item on both sides; neighbours are joined."""
    out: list[list[int]] = []
    for block in blocks:
        low, high = max(0, block * BLOCK - size), (block + 2) * BLOCK + size
        if out and low <= out[-1][1]:
            out[-1][1] = high
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


class Phrases:
    """Short items, looked up word for word."""

    def __init__(self, items: list[np.ndarray], which: list[int]) -> None:
        self.by_size: dict[int, dict[tuple, list[int]]] = {}
        for i in which:
            self.by_size.setdefault(len(items[i]), {}).setdefault(tuple(items[i].tolist()), []).append(i)
        self.first = {n: np.array(sorted({p[0] for p in found}), dtype=np.int32) for n, found in self.by_size.items()}

    def within(self, place: np.ndarray, number: np.ndarray):
        """Item and place of all of them that stand in a document."""
        for n, found in self.by_size.items():
            if len(place) < n:
                continue
            run = place[n - 1 :] - place[: len(place) - n + 1] == n - 1
            for at in np.flatnonzero(run & np.isin(number[: len(run)], self.first[n])).tolist():
                for item in found.get(tuple(number[at : at + n].tolist()), ()):
                    yield item, int(place[at])


def search(read: DataFrame, basis: np.ndarray, listed: list[tuple], items: list[np.ndarray], queries: list[np.ndarray], of: np.ndarray, weights: Weights) -> DataFrame:
    """The documents and items that belong together, verified: FOUND."""
    if len(queries):
        projected = np.stack([basis[x].sum(0) for x in queries])
        length = np.sqrt((projected**2).sum(1)).clip(1e-3)
        goal, least = projected / (length**2)[:, None], LEAST_COSINE * weights.lengths(queries).min()
    else:
        goal, length, least = np.zeros((0, 1), dtype=np.float32), np.zeros(0), 1.0
    ids = [item_id for item_id, _ in listed]
    short = Phrases(items, [i for i, x in enumerate(items) if len(x) < LEAST_WORDS])
    shared = read.sparkSession.sparkContext.broadcast((basis, weights.square, goal, length, least, of, ids, items, short))

    def run(batches):
        w, square, goal, length, least, of, ids, items, short = shared.value
        wanted = np.zeros(len(square), dtype=bool)
        for batch in batches:
            out, docs, keys, got = [], batch.doc_id.to_numpy(), batch.key.to_numpy(), unpacked(batch)
            of_row = lambda r, starts, *columns: (x[starts[r] : starts[r + 1]] for x in columns)
            for r, i, blocks, cosine in by_pair(near_blocks(got, square, least, w, goal, length), of):
                item, (place, number) = items[i], of_row(r, *got)
                wanted[item] = True
                own = np.flatnonzero(wanted[number])
                wanted[item] = False
                if len(own) < LIKELY * len(item):
                    continue  # the document has too few of the item's words
                best = (0.0, 0.0, 0, 0)
                for low, high in stretches_of(blocks, len(item)):
                    best = max(best, best_match(item.tolist(), place[own], number[own], low, high), key=lambda x: x[:2])
                if is_leak(best[0], best[1]):
                    out.append((docs[r], ids[i], best[0], best[1], cosine, best[2], best[3], keys[r]))
            if short.by_size:
                for r in range(len(batch)):
                    for i, at in dict(short.within(*of_row(r, *got))).items():
                        out.append((docs[r], ids[i], 1.0, 1.0, 1.0, at, at + len(items[i]), keys[r]))
            if out:
                frame = pd.DataFrame(out, columns=["doc_id", "item_id", "lcs", "answer", "cosine", "first_word", "last_word", "key"])
                yield frame.astype({"doc_id": "Int64", "item_id": "Int64"})

    return read.mapInPandas(run, FOUND)


def find_group(rows: DataFrame, listed: list[tuple]) -> DataFrame:
    """FOUND for some items, as (id, words)."""
    spark = rows.sparkSession
    terms = Terms([ws for _, ws in listed])
    read = materialize(read_terms(rows, spark.sparkContext.broadcast(terms)), "terms")
    items = [terms.of(ws) for _, ws in listed]
    long = [i for i, x in enumerate(items) if len(x) >= LEAST_WORDS]
    queries, of = queries_of([items[i] for i in long])
    of = np.array(long, dtype=np.int32)[of] if long else of
    frequency, n = document_frequency(read, terms.size) if long else (np.zeros(terms.size), 0)
    weights = Weights(queries, frequency, n)
    basis = latent_basis(read, queries, weights) if long else np.zeros((terms.size, 1), dtype=np.float32)
    return search(read, basis, listed, items, queries, of, weights)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", group_words: int = GROUP_WORDS) -> DataFrame:
    """A row for every document and benchmark item in it: doc_id, item_id, lcs, answer, cosine, first_word, last_word, key."""
    spark = docs.sparkSession
    known = narrowed(benchmark, [item_col, item_text_col]).select(F.col(f"`{item_col}`").cast("long").alias("item_id"), whole_text(item_text_col).alias("text"))
    size = known.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    groups = max(1, -(-int(size) // group_words))
    known = known.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)).cast("int"))
    rows = narrowed(docs, [id_col, text_col]).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), whole_text(text_col).alias("text"), row_key(id_col, text_col).alias("key"))
    found = []
    for part in range(groups):
        listed = sorted(((r.item_id, ws) for r in known.filter(F.col("part") == part).collect() if (ws := words(r.text))), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        if listed:
            found.append(find_group(rows, listed))
    if not found:
        return spark.createDataFrame([], FOUND)
    # rows given twice, and items that share an id, have one row, the one that matches best
    names = ["lcs", "answer", "cosine", "first_word", "last_word"]
    best = reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id", "key").agg(F.max(F.struct(*names)).alias("best"))
    return best.select("doc_id", "item_id", *[f"best.{n}" for n in names], "key")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that hold a benchmark item."""
    return without(docs, find_leaks(docs, benchmark, id_col, text_col), id_col, text_col)
