"""Genomes: tables of sequences with their lengths, from BigWig headers or given."""

from __future__ import annotations

import os
import re
import warnings

from pyspark.sql import DataFrame, SparkSession

from .bigwig import BigWig

SEQINFO = "seqname string, seqlength long, seq_rank int"


def natural_key(name: str) -> tuple:
    """Numbers in names sort as numbers."""
    return tuple((0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.findall(r"\d+|\D+", name))


def make_seqinfo(spark: SparkSession, lengths: dict[str, int]) -> DataFrame:
    return spark.createDataFrame([(n, lengths[n], i + 1) for i, n in enumerate(sorted(lengths, key=natural_key))], SEQINFO)


def bigwig_lengths(path: str) -> dict[str, int]:
    return {n: size for n, (_, size) in BigWig(path).header.chromosomes.items()}


def check_files(paths: dict[str, str] | list[str], extension: str, named: bool = True) -> bool:
    """Files must have names, exist, be readable and have the extension."""
    if named and not isinstance(paths, dict):
        raise ValueError("give the files by sample name")
    for path in paths.values() if isinstance(paths, dict) else paths:
        if not path.endswith(extension):
            raise ValueError(f"{path} does not end with {extension}")
        if "://" not in path and not os.access(path, os.R_OK):
            raise ValueError(f"{path} can't be read")
    return True


def check_source(paths: str | list[str], extension: str) -> bool:
    """Files to convert must exist and be readable; another extension only gives a warning."""
    paths = [paths] if isinstance(paths, str) else paths
    check_files(paths, "", named=False)
    return check_extensions(paths, extension)


def check_extensions(paths: list[str], extension: str) -> bool:
    """Whether all files have the extension; warns of those that do not."""
    wrong = [p for p in paths if not p.endswith(extension)]
    for path in wrong:
        warnings.warn(f"{path} does not end with {extension}", stacklevel=3)
    return not wrong


def check_bigwigs(paths: dict[str, str] | str) -> bool:
    """BigWig files must be valid: named, with the extension .bw, readable, with a readable header."""
    one = isinstance(paths, str)
    check_files([paths] if one else paths, ".bw", named=not one)
    for path in [paths] if one else paths.values():
        bigwig_lengths(path)
    return True


def common_genome(spark: SparkSession, plus: dict[str, str], minus: dict[str, str], method: str = "intersect") -> DataFrame:
    """The sequences that all files have, or that any has; lengths must agree."""
    if method not in ("intersect", "union"):
        raise ValueError("the method is intersect or union")
    genomes = [bigwig_lengths(p) for p in (*plus.values(), *minus.values())]
    names = set.intersection(*map(set, genomes)) if method == "intersect" else set.union(*map(set, genomes))
    lengths: dict[str, int] = {}
    for g in genomes:
        for n in names & set(g):
            if lengths.setdefault(n, g[n]) != g[n]:
                raise ValueError(f"{n} differs in length between files")
    return make_seqinfo(spark, lengths)


def check_compatible(plus: dict[str, str], minus: dict[str, str], seqinfo: DataFrame) -> bool:
    """Sequences that a file shares with the genome must be equally long."""
    known = {r.seqname: r.seqlength for r in seqinfo.collect()}
    for path in (*plus.values(), *minus.values()):
        if wrong := [n for n, size in bigwig_lengths(path).items() if n in known and known[n] != size]:
            raise ValueError(f"{path} differs from the genome in the length of {', '.join(wrong)}")
    return True
