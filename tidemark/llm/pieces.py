"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and lossless decoding.

The lattice of a text has an edge for every piece of the vocabulary that matches at a place, and for characters
without a piece one edge of their UTF-8 bytes as byte pieces.  Spaces are written as U+2581, as the vocabulary
has them; a U+2581 of the text itself and line ends have no piece and become bytes, so no text is changed and
joining the pieces gives it back.  A piece of rank r has the probability 1/(r + 10), up to a factor and the power
`theta`.  Forward filtering sums the probabilities of all segmentations of each prefix; backward sampling then
draws a segmentation from its exact distribution.  No piece spans the start of a run of spaces or a line end, so
lattices are filtered word by word, each distinct word of a batch once, all words at the same time; words over
`LONGEST` characters take a path of their own with scaled sums.  Draws come from a counter-based generator keyed by
the row's key, the word's place and the step, so they do not depend on batches, partitions or retries.

Defined results: null text is encoded like the empty one, to no pieces; rows given twice get the same pieces;
a row without key counts as key 0; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrowed, whole_text

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
WORD = re.compile(r" *[^ \n]+|\n+| +")
LONGEST, STEPS = 48, 1 << 16
SPACE, OWN_SPACE = 0x2581, 0x110000
#: Characters that are encoded at once.
GROUP = 4_000_000
#: Probabilities of a word's prefixes are scaled by this factor a character, to stay within doubles.
SCALE = 64.0
POWERS = SCALE ** np.arange(LONGEST + 1)
M1, M2, GOLDEN = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
HASH_BASE = np.uint64(0x5851F42D4C957F2D)


def splitmix(x: np.ndarray) -> np.ndarray:
    x = x + GOLDEN
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that depend on key and counter alone."""
    return (splitmix(key ^ splitmix(counter)) >> np.uint64(11)) * (1.0 / (1 << 53))


class Vocabulary:
    def __init__(self, raw: bytes, theta: float = 1.0) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        n = model.get_piece_size()
        self.bytes = [b""] * n
        self.byte_id = np.zeros(256, dtype=np.int64)
        pieces: dict[str, int] = {}
        weight = np.zeros(n)
        for i in range(n):
            piece, score = model.id_to_piece(i), model.get_score(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                pieces[piece] = i
                self.bytes[i] = piece.replace("▁", " ").encode()
                weight[i] = (1.0 / (min(-score, n) + 10.0)) ** theta
        self.byte_weight = (1.0 / (n + 10.0)) ** theta
        total = weight.sum() + 256 * self.byte_weight
        self.weight, self.byte_weight = weight / total, self.byte_weight / total
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        self.starts = {p[:k] for p in pieces for k in range(1, len(p) + 1)}
        longer = {p[:k] for p in pieces for k in range(1, len(p))}
        self.tables = []
        for size in range(1, self.longest + 1):
            own = sorted(p for p in self.starts if len(p) == size)
            self.tables.append(Table(self.hashes(own, size), np.array([pieces.get(p, -1) * 2 + (p in longer) for p in own], dtype=np.int64)))

    @staticmethod
    def hashes(texts: list[str], size: int) -> np.ndarray:
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).reshape(-1, size) if texts else np.zeros((0, size), dtype=np.uint32)
        h = np.zeros(len(points), dtype=np.uint64)
        for k in range(size):
            h = step_hash(h, points[:, k])
        return h


def step_hash(h: np.ndarray, point: np.ndarray) -> np.ndarray:
    h = (h ^ (point.astype(np.uint64) + np.uint64(1))) * HASH_BASE
    return h ^ (h >> np.uint64(32))


class Table:
    """Values by 64-bit hash, in open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 8).bit_length())
        size = 1 << self.bits
        self.keys, self.values, self.probes = np.zeros(size, dtype=np.uint64), np.full(size, -3, dtype=np.int64), 1
        for k, v in zip(keys.tolist(), values.tolist(), strict=True):
            at, probes = k >> (64 - self.bits), 1
            while self.values[at] != -3:
                at, probes = (at + 1) % size, probes + 1
            self.keys[at], self.values[at], self.probes = k, v, max(self.probes, probes)

    def get(self, h: np.ndarray) -> np.ndarray:
        """The values, or -2 for hashes that are not there."""
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.keys[at] == h, self.values[at], -3)
        for _ in range(self.probes - 1):
            again = np.flatnonzero((out == -3) & (self.values[at] != -3))
            if not len(again):
                break
            at[again] = (at[again] + 1) % len(self.keys)
            out[again] = np.where(self.keys[at[again]] == h[again], self.values[at[again]], -3)
        return np.maximum(out, -2)


def points_of(words: list[str]) -> np.ndarray:
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    points[points == SPACE] = OWN_SPACE
    points[points == 32] = SPACE
    return points


def n_bytes(points: np.ndarray) -> np.ndarray:
    points = np.where(points == OWN_SPACE, SPACE, points)
    return 1 + (points >= 0x80) + (points >= 0x800).astype(np.int64) + (points >= 0x10000)


class Lattices:
    """The filtered lattices of some distinct words, none over LONGEST characters.

    Places are numbered over all words; word w has the places first[w] .. first[w] + length.  The edges that end at a
    place are neighbours; `share` is the part of the place's probability up to and with the edge.
    """

    def __init__(self, words: list[str], vocab: Vocabulary) -> None:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        points = points_of(words)
        self.first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(words) else np.zeros(0, dtype=np.int64)
        self.last = self.first + lengths
        offset = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        place, left = np.repeat(self.first, lengths) + offset, np.repeat(lengths, lengths) - offset
        alive, h = np.arange(len(points)), np.zeros(len(points), dtype=np.uint64)
        starts, ends, ids, single = [], [], [], np.zeros(len(points), dtype=bool)
        for size in range(1, vocab.longest + 1):
            h = step_hash(h, points[alive + size - 1])
            value = vocab.tables[size - 1].get(h)
            hit = np.flatnonzero(value >= 0)
            if size == 1:
                single[alive[hit]] = True
            starts.append(place[alive[hit]])
            ends.append(starts[-1] + size)
            ids.append(value[hit] >> 1)
            go = np.flatnonzero((value & 1).astype(bool) & (value > -2) & (left[alive] > size))
            alive, h = alive[go], h[go]
            if not len(alive):
                break
        lone = np.flatnonzero(~single)
        starts.append(place[lone])
        ends.append(place[lone] + 1)
        ids.append(-points[lone].astype(np.int64) - 1)
        start, end, ids = (np.concatenate(x[::-1]) for x in (starts, ends, ids))  # the longest edges first, as the likeliest
        weight = np.where(ids >= 0, vocab.weight[np.maximum(ids, 0)], 0.0)
        weight[ids < 0] = vocab.byte_weight ** n_bytes(-ids[ids < 0] - 1)
        weight *= POWERS[end - start]
        total = int(self.last[-1]) + 1 if len(words) else 0
        within = np.zeros(total, dtype=np.uint8)  # a place's offset in its word
        within[place + 1] = offset + 1
        alpha = np.zeros(total)
        alpha[self.first] = 1.0
        order = np.argsort(end, kind="stable")
        start, end, ids, weight = start[order], end[order], ids[order], weight[order]
        level = within[end]
        by_offset = np.argsort(level, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(level, minlength=LONGEST + 1)[1:])])
        share = np.empty(len(end))
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            if low == high:
                continue
            e = by_offset[low:high]  # in the order of their ends
            part, to = alpha[start[e]] * weight[e], end[e]
            heads = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            sums = np.add.reduceat(part, heads)
            alpha[to[heads]] = sums
            counts = np.diff(np.append(heads, len(e)))
            running = np.cumsum(part / np.repeat(sums, counts))
            running -= np.repeat(np.concatenate([[0.0], running[heads[1:] - 1]]), counts)
            share[e] = np.minimum(running, 1.0)
            share[e[np.append(heads[1:], len(e)) - 1]] = 1.0
        self.start, self.ids, self.share, self.alpha = start, ids, share, alpha
        counts = np.bincount(end, minlength=total)
        self.edge = np.cumsum(counts) - counts  # a place's first edge

    def sample(self, word: np.ndarray, key: np.ndarray, counter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every occurrence a sampled path: the occurrence of each piece and its id, in the order of the text."""
        place, goal, who = self.last[word], self.first[word], np.arange(len(word))
        count, kept = np.zeros(len(word), dtype=np.int64), []
        while len(who):
            u = uniform(key[who], counter[who] + np.uint64(len(kept)))
            edge = self.edge[place]
            beyond = np.flatnonzero(u >= self.share[edge])
            while len(beyond):
                edge[beyond] += 1
                beyond = beyond[u[beyond] >= self.share[edge[beyond]]]
            kept.append((who, self.ids[edge]))
            count[who] += 1
            place = self.start[edge]
            go = np.flatnonzero(place > goal)
            place, goal, who = place[go], goal[go], who[go]
        ids, after = np.empty(int(count.sum()), dtype=np.int64), np.cumsum(count)
        for step, (who, piece) in enumerate(kept):  # paths are drawn from their ends
            ids[after[who] - 1 - step] = piece
        return np.repeat(np.arange(len(word)), count), ids


def edges_at(points: list[int], i: int, vocab: Vocabulary) -> list[tuple[int, int, float]]:
    """End, id and probability of the edges that begin at a place."""
    text, out = "", []
    for j in range(i, min(len(points), i + vocab.longest)):
        if points[j] == OWN_SPACE:
            break
        text += chr(points[j])
        if text not in vocab.starts:
            break
        if (p := vocab.pieces.get(text)) is not None:
            out.append((j + 1, p, vocab.weight[p]))
    if not out or out[0][0] != i + 1:
        out.append((i + 1, -points[i] - 1, vocab.byte_weight ** int(n_bytes(np.array(points[i])))))
    return out


def sample_long(word: str, key: np.uint64, counter: np.uint64, vocab: Vocabulary) -> list[int]:
    """The same for one word of any length, with sums scaled at every place."""
    points = points_of([word]).tolist()
    n = len(points)
    into: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
    alpha, scale = np.zeros(n + 1), np.zeros(n + 1)  # the sum at a place is alpha * exp(scale)
    alpha[0] = 1.0
    for i in range(n + 1):
        if into[i]:
            top = max(scale[s] for s, _, _ in into[i])
            into[i] = [(s, p, alpha[s] * np.exp(scale[s] - top) * w) for s, p, w in into[i]]
            total = sum(w for _, _, w in into[i])
            alpha[i], scale[i] = 1.0, top + np.log(total)
        if i < n:
            for end, p, w in edges_at(points, i, vocab):
                into[end].append((i, p, w))
    out, at, step = [], n, 0
    while at:
        u = float(uniform(np.array([key]), np.array([counter + np.uint64(step)]))[0]) * sum(w for _, _, w in into[at])
        for s, p, w in into[at]:
            u -= w
            if u < 0:
                break
        out.append(p)
        at, step = s, step + 1
    return out[::-1]


def spelled(who: np.ndarray, ids: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Characters without piece, given as negative ids, become their byte pieces."""
    lone = ids < 0
    if not lone.any():
        return who, ids
    point = np.where(lone, -ids - 1, 0)
    point = np.where(point == OWN_SPACE, SPACE, point)
    counts = np.where(lone, n_bytes(point), 1)
    out, at = np.repeat(ids, counts), np.cumsum(counts) - counts
    table = {int(c): chr(int(c)).encode("utf-8", "surrogatepass") for c in np.unique(point[lone])}
    for k in range(4):
        has = lone & (counts > k)
        if has.any():
            values = np.unique(point[has])
            byte = np.array([table[int(c)][k] for c in values])
            out[at[has] + k] = vocab.byte_id[byte[np.searchsorted(values, point[has])]]
    return np.repeat(who, counts), out


def encode_group(texts: list[str], keys: np.ndarray, vocab: Vocabulary, seed: int = 0) -> list[np.ndarray]:
    """Sampled piece ids of every text."""
    split = [WORD.findall(t) for t in texts]
    counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    flat = [w for ws in split for w in ws]
    place = dict(zip(dict.fromkeys(flat), range(len(flat)), strict=False))
    word = np.fromiter(map(place.__getitem__, flat), dtype=np.int64, count=len(flat))
    doc = np.repeat(np.arange(len(texts)), counts)
    counter = (np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.uint64) * np.uint64(STEPS)
    key = splitmix(keys.astype(np.uint64) ^ np.uint64(seed))[doc] if len(texts) else keys.astype(np.uint64)
    distinct = list(place)
    long_words = np.fromiter((len(w) > LONGEST for w in distinct), dtype=bool, count=len(distinct))
    lattices = Lattices(["" if b else w for w, b in zip(distinct, long_words, strict=True)], vocab)
    short = np.flatnonzero(~long_words[word]) if len(word) else word
    who, ids = lattices.sample(word[short], key[short], counter[short])
    who = short[who] if len(short) else who
    if long_words.any():
        extra = [(i, sample_long(flat[i], key[i], counter[i], vocab)) for i in np.flatnonzero(long_words[word])]
        who = np.concatenate([who, *[np.full(len(p), i) for i, p in extra]])
        ids = np.concatenate([ids, *[np.array(p, dtype=np.int64) for _, p in extra]])
        order = np.argsort(who, kind="stable")
        who, ids = who[order], ids[order]
    who, ids = spelled(who, ids, vocab)
    ends = np.searchsorted(doc[who] if len(who) else who, np.arange(len(texts)), side="right")
    return np.split(ids.astype(np.int32), ends[:-1]) if len(texts) else []


def decode_ids(ids, vocab: Vocabulary) -> str:
    return b"".join(map(vocab.bytes.__getitem__, ids)).decode("utf-8", "surrogatepass")


_vocabularies: dict[tuple, Vocabulary] = {}


def vocabulary(raw: bytes, theta: float) -> Vocabulary:
    """Built once a process."""
    if (raw[:64], len(raw), theta) not in _vocabularies:
        _vocabularies[raw[:64], len(raw), theta] = Vocabulary(raw, theta)
    return _vocabularies[raw[:64], len(raw), theta]


def groups(lengths: list[int], most: int = GROUP):
    """Consecutive stretches of rows of about `most` characters."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        total += n
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(lengths):
        yield start, len(lengths)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY, seed: int = 0, theta: float = 1.0) -> DataFrame:
    """One row a document: doc_id, n_pieces, ids, text_sha256 of the text that decoding the ids gives, lossless.

    The vocabulary's file is read on the driver and broadcast; its size is fixed.
    """
    with open(path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        vocab = vocabulary(model.value, theta)
        for batch in batches:
            texts, keys = batch.text.to_list(), batch.key.to_numpy()
            for low, high in groups(list(map(len, texts))):
                ids = encode_group(texts[low:high], keys[low:high].view(np.uint64), vocab, seed)
                back = [b"".join(map(vocab.bytes.__getitem__, x.tolist())) for x in ids]
                yield pd.DataFrame(
                    {
                        "doc_id": batch.doc_id[low:high].to_numpy(),
                        "n_pieces": [len(x) for x in ids],
                        "ids": ids,
                        "text_sha256": [hashlib.sha256(t).hexdigest() for t in back],
                        "lossless": [a == b.encode("utf-8", "surrogatepass") for a, b in zip(back, texts[low:high], strict=True)],
                    }
                )

    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(0).cast("long")).alias("key")
    rows = narrowed(docs, [id_col, text_col]).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), key, whole_text(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_pieces long, ids array<int>, text_sha256 string, lossless boolean")


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and text of encoded rows (doc_id, ids); null ids give an empty text."""
    with open(path, "rb") as f:
        model = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        vocab = vocabulary(model.value, 1.0)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id, "text": ["" if x is None else decode_ids(x.tolist(), vocab) for x in batch.ids]})

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInPandas(run, "doc_id long, text string")
