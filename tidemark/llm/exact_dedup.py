"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only.

A text is cut where its own content says so: a chunk ends at the first punctuation mark with white space
after at least `MIN_CHUNK` characters, or after `MAX_CHUNK` characters.  Equal texts are therefore cut alike.
Each chunk becomes a 64-bit identifier, verified against its SHA-256: an identifier that stands for two
different chunks is refined by the digest.  A document is then the ordered list of its identifiers, its
recipe; two texts are equal when their recipes are.  Only identifiers and digests are shuffled, never texts.

Defined results: null text counts as empty, and all empty texts are equal; without an id the row can stay
only where no row of its group has one; a row given twice is decided alike both times; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, narrowed, whole_text

MIN_CHUNK, MAX_CHUNK = 256, 1024
#: Rows of a hot group are joined with their decision on this many salted keys.
SALTS = 16


def chunk_pattern(least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> str:
    return rf"(?s).{{{least},{most}}}?[.,;:!?]\s|.{{1,{most}}}"


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> DataFrame:
    """One row a document: id, the ordered chunk identifiers, the chunks' digests and the whole text's digest."""
    cut = narrowed(docs, [id_col, text_col]).select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.sha2(whole_text(text_col), 256).alias("text_sha256"),
        F.regexp_extract_all(whole_text(text_col), F.lit(chunk_pattern(least, most)), F.lit(0)).alias("chunks"),
    )
    return cut.select(
        "doc_id",
        "text_sha256",
        F.transform("chunks", lambda c: F.xxhash64(c)).alias("recipe"),
        F.transform("chunks", lambda c: F.unhex(F.sha2(c, 256))).alias("digests"),
    )


def collisions(cut: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one chunk."""
    chunks = cut.select(F.explode(F.arrays_zip("recipe", "digests")).alias("c")).select("c.recipe", "c.digests")
    return chunks.groupBy("recipe", "digests").agg(F.count(F.lit(1)).alias("n")).groupBy("recipe").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("recipe")


def with_verified_recipes(cut: DataFrame) -> DataFrame:
    """Adds `refined`: for documents that hold a colliding identifier the digests at those places, else null."""
    places = cut.select("doc_id", "text_sha256", F.posexplode(F.arrays_zip("recipe", "digests")).alias("place", "c")).select("doc_id", "text_sha256", "place", F.col("c.recipe").alias("recipe"), "c.digests")
    salted = collisions(cut).select("recipe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    places = places.withColumn("salt", F.pmod(F.xxhash64("doc_id", "place"), F.lit(SALTS).cast("long")))
    refined = places.join(salted, ["recipe", "salt"], "left_semi").groupBy("doc_id", "text_sha256").agg(F.sort_array(F.collect_set(F.struct("place", "digests"))).alias("refined"))
    refined = refined.select(F.col("doc_id").alias("r_id"), F.col("text_sha256").alias("r_sha"), "refined")
    return cut.join(refined, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_sha256") == F.col("r_sha")), "left").drop("r_id", "r_sha")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> DataFrame:
    """Decide for every row of `docs`; of equal texts the row with the largest id stays.

    Returns doc_id, keep_id, group_size, kept, text_sha256, n_chunks.
    """
    cut = materialize(recipes(docs, id_col, text_col, least, most), "recipes")
    listed = with_verified_recipes(cut).select("doc_id", "text_sha256", "recipe", "refined", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    groups = listed.groupBy("recipe", "refined").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    groups = groups.select("recipe", "refined", "keep_id", "group_size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    a, b = listed.alias("a"), groups.alias("b")
    same = (F.col("a.recipe") == F.col("b.recipe")) & F.col("a.refined").eqNullSafe(F.col("b.refined")) & (F.col("a.salt") == F.col("b.salt"))
    found = F.col("b.group_size").isNotNull()
    return a.join(b, same, "left").select(
        F.col("a.doc_id"),
        F.when(found, F.col("b.keep_id")).otherwise(F.col("a.doc_id")).alias("keep_id"),
        F.coalesce(F.col("b.group_size"), F.lit(1)).cast("long").alias("group_size"),
        F.when(found, F.col("a.doc_id").eqNullSafe(F.col("b.keep_id"))).otherwise(True).alias("kept"),
        F.col("a.text_sha256"),
        F.size("a.recipe").cast("long").alias("n_chunks"),
    )


def keep_largest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that an equal text with a larger id stands for."""
    gone = exact_dedup(docs, id_col, text_col).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone_id"), F.col("text_sha256").alias("__gone_sha")).distinct()
    same = docs[id_col].eqNullSafe(gone["__gone_id"]) & (F.sha2(F.coalesce(docs[text_col].cast("string"), F.lit("")), 256) == gone["__gone_sha"])
    return docs.join(gone, same, "left_anti")
