"""Secrets in texts: three fixed patterns, and random strings by token efficiency.

The base kinds are `assign`, `access` and `hex`.  The method adds kind `random`: a run of at least `LEAST_RUN`
base64 or url characters that a byte-pair vocabulary can only split into short tokens.  Natural words and
identifiers need few tokens; random strings need about one for every one or two characters.  Known digests
(hex of a digest's length, UUIDs) and identifiers (real words joined by separators or capitals, numbers) are excluded first.

Defined results: null text is empty and has no secrets; rows given twice are scanned twice; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrowed, whole_text

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's texts are cut before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KINDS = ("assign", "access", "hex", "random")
LEAST_RUN, MOST_RATIO = 16, 2.1
#: Letters of a real word, and characters of it to a token.
LEAST_WORD, WORD_RATIO = 4, 3.5
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so a shorter run is what would be dropped
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}")
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})|(?:[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
WORDS = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}(?![a-z])|[0-9]{1,4}(?![0-9])|[/_=+-]+")
RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"

_encoders: dict[int, object] = {}


def encoder(raw: bytes):
    """The vocabulary as a tiktoken encoding, built once a process."""
    if (found := _encoders.get(hash(raw))) is None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        found = _encoders[hash(raw)] = tiktoken.Encoding("scan", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


def is_identifier(run: str, encode) -> bool:
    """Words joined by separators or capitals, with short numbers: what people name things.

    Half of its letters and digits at least must stand in real words, which the vocabulary holds in long tokens; a
    run without letters is a number.
    """
    rest = WORDS.sub("", run)
    if rest and len(rest) * 8 > len(run):
        return False
    if not any(c.isalpha() for c in run):
        return True
    parts = [m[0].lower() for m in WORDS.finditer(run) if m[0].isalpha() and len(m[0]) >= LEAST_WORD]
    real = sum(len(p) for p in parts if len(p) >= WORD_RATIO * len(encode(p)))
    return 2 * real >= sum(c.isalnum() for c in run)


def random_spans(text: str, encode, most: float = MOST_RATIO) -> list[tuple[int, int, str]]:
    found = []
    for m in RUN.finditer(text):
        run = m[0].strip("=-_/+")
        if len(run) < LEAST_RUN or run.isdigit():
            continue
        if DIGEST.fullmatch(run) or is_identifier(run, encode):
            continue
        if len(run) / len(encode(run)) < most:
            start = m.start() + m[0].index(run)
            found.append((start, start + len(run), "random"))
    return found


def scan(text: str, encode, most: float = MOST_RATIO) -> tuple[list, list]:
    """The base spans, and all spans; a random string inside a base span is the same secret and adds nothing."""
    order = lambda s: (s[0], KINDS.index(s[2]))
    base = sorted(base_spans(text), key=order)
    more = [s for s in random_spans(text, encode, most) if not any(b[0] <= s[0] and s[1] <= b[1] for b in base)]
    return base, sorted(base + more, key=order)


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, most: float = MOST_RATIO) -> DataFrame:
    """One row a document with its counts and spans.  `vocabulary` is read on the driver and broadcast; its size is fixed."""
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        encode = encoder(ranks.value).encode_ordinary
        for batch in batches:
            rows = []
            for doc, text in zip(batch.doc_id, batch.text, strict=True):
                base, spans = scan(text, encode, most)
                count = [sum(s[2] == k for s in spans) for k in KINDS]
                rows.append((doc, *count[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), count[3]))
            frame = pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])
            frame["doc_id"] = batch.doc_id.to_numpy()
            yield frame

    return narrowed(docs, [id_col, text_col]).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInPandas(run, RESULT)
