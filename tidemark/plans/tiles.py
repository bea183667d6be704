"""Ordered computations along sequences, without a window over a whole sequence.

Rows are dealt by (keys, tile).  What a tile needs from the tiles before it is carried over a summary with one
row a tile, whose number is bounded by genome length / tile width whatever the depth of the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TILE = 1 << 16


def with_tile(df: DataFrame, position: Column, tile: int | Column = TILE) -> DataFrame:
    """`tile` is the width of tiles, or the number of each row's tile, which must not fall as positions rise."""
    return df.withColumn("__tile", tile if isinstance(tile, Column) else F.floor(position / tile))


def _dealt(df: DataFrame, keys: Sequence[str], position: Column, tile: int | Column) -> DataFrame:
    """Rows dealt by (__key, __tile), once for all that is computed from them.

    The keys are one struct, which is never null, so that joins on it are plain ones that need no other dealing.
    """
    rest = [c for c in df.columns if c not in keys]
    rows = with_tile(df, position, tile).select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("__key"), "__tile", *[F.col(f"`{c}`") for c in rest])
    return rows.repartition("__key", "__tile")


def _undealt(df: DataFrame, columns: Sequence[str], keys: Sequence[str], *more: Column) -> DataFrame:
    return df.select(*[F.col(f"__key.`{c}`").alias(c) if c in keys else F.col(f"`{c}`") for c in columns], *more)


def _earlier():
    return Window.partitionBy("__key").orderBy("__tile").rowsBetween(Window.unboundedPreceding, -1)


def _later():
    return Window.partitionBy("__key").orderBy("__tile").rowsBetween(1, Window.unboundedFollowing)


def _carried(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """`rows` with the columns of their tile's summary."""
    return rows.join(summary.withColumnsRenamed({"__key": "__s_key", "__tile": "__s_tile"}), (F.col("__key") == F.col("__s_key")) & (F.col("__tile") == F.col("__s_tile")), "left").drop("__s_key", "__s_tile")


def islands(df: DataFrame, keys: Sequence[str], gap: int, start: str = "start", end: str = "end", name: str = "island", tile: int = TILE, runs: tuple[str, str] | None = None) -> DataFrame:
    """Adds the start of each interval's island: intervals of a key whose gaps are under `gap` form one.

    With `runs`, the names of a value and of a column to add, also whether the interval behind a row lacks its value or does not
    begin right behind it; intervals of a key must then be disjoint.
    """
    order = Window.partitionBy("__key", "__tile").orderBy(start, end)
    rows = _dealt(df, keys, F.col(start), tile)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__begins", F.when(before.isNull() | (F.col(start) - before - 1 >= gap), F.col(start)))
    rows = rows.withColumn("__own", F.max("__begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = []
    if runs is not None:
        rows = rows.withColumn("__next", F.lead(F.struct(F.col(start).alias("at"), F.col(runs[0]).alias("v"))).over(order))
        first = [F.min(F.struct(F.col(start).alias("at"), F.col(runs[0]).alias("v"))).alias("__first")]
    # what earlier tiles reach hides a tile's beginnings up to there; if it hides the last, it hides all
    summary = rows.groupBy("__key", "__tile").agg(F.max(end).alias("__reach"), F.max("__begins").alias("__last"), *first)
    more = [F.first("__first").over(_later()).alias("__ahead")] if runs is not None else []
    summary = summary.select("__key", "__tile", "__last", F.max("__reach").over(_earlier()).alias("__before"), *more)
    seen = lambda at: F.when(F.col("__before").isNull() | (at - F.col("__before") - 1 >= gap), at)
    summary = summary.withColumn("__open", F.max(seen(F.col("__last"))).over(_earlier())).drop("__last")
    rows = _carried(rows, summary)
    found = [F.coalesce(seen(F.col("__own")), F.col("__open")).alias(name)]
    if runs is not None:
        ahead = F.coalesce("__next", "__ahead")
        found.append((~F.coalesce((ahead["at"] == F.col(end) + 1) & (ahead["v"] == F.col(runs[0])), F.lit(False))).alias(runs[1]))
    return _undealt(rows, df.columns, keys, *found)


def running_sums(df: DataFrame, keys: Sequence[str], position: str, columns: Sequence[str], tile: int | Column = TILE, totals: bool = False) -> DataFrame:
    """Replaces columns by their sums up to each position; positions of a key must be distinct.

    With `totals` the key's sums are added as columns total_*.
    """
    rows = _dealt(df, keys, F.col(position), tile)
    sums = rows.groupBy("__key", "__tile").agg(*[F.sum(c).alias(f"__sum_{c}") for c in columns])
    whole = [F.sum(f"__sum_{c}").over(Window.partitionBy("__key")).alias(f"total_{c}") for c in columns] if totals else []
    sums = sums.select("__key", "__tile", *[F.sum(f"__sum_{c}").over(_earlier()).alias(f"__carry_{c}") for c in columns], *whole)
    order = Window.partitionBy("__key", "__tile").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    rows = _carried(rows.withColumns({f"__up_{c}": F.sum(c).over(order) for c in columns}), sums)
    rows = rows.withColumns({c: F.col(f"__up_{c}") + F.coalesce(F.col(f"__carry_{c}"), F.lit(0)) for c in columns})
    return _undealt(rows, df.columns, keys, *[F.col(f"total_{c}") for c in columns if totals])


def ends_of_runs(df: DataFrame, keys: Sequence[str], position: str, value: str, name: str, tile: int = TILE) -> DataFrame:
    """Adds whether the position behind a row, of the same key, lacks the row's value; positions of a key must be distinct.

    Only a row on the first place of a tile can be the next of one in the tile before: it is sent there, too.
    """
    at = F.floor(F.col(position) / tile)
    first = F.when(F.col(position) % tile == 0, F.array(F.struct(at.alias("t"), F.lit(True).alias("own")), F.struct((at - 1).alias("t"), F.lit(False).alias("own"))))
    rows = df.withColumn("__to", F.explode(F.coalesce(first, F.array(F.struct(at.alias("t"), F.lit(True).alias("own")))))).withColumn("__tile", F.col("__to.t"))
    order = Window.partitionBy(*keys, "__tile").orderBy(position)
    following = F.lead(F.struct(position, value)).over(order)
    goes_on = (following[position] == F.col(position) + 1) & (following[value] == F.col(value))
    return rows.withColumn(name, ~F.coalesce(goes_on, F.lit(False))).filter("__to.own").drop("__to", "__tile")


def next_position(df: DataFrame, keys: Sequence[str], position: str, name: str, tile: int = TILE) -> DataFrame:
    """Adds the next position of the key, null at the last."""
    rows = _dealt(df, keys, F.col(position), tile)
    first = rows.groupBy("__key", "__tile").agg(F.min(position).alias("__first"))
    first = first.select("__key", "__tile", F.min("__first").over(_later()).alias("__ahead"))
    rows = rows.withColumn("__next", F.lead(position).over(Window.partitionBy("__key", "__tile").orderBy(position)))
    return _undealt(_carried(rows, first), df.columns, keys, F.coalesce("__next", "__ahead").alias(name))


def row_index(df: DataFrame, keys: Sequence[str], position: str, ties: Sequence[str], name: str = "row_idx", where: Column | None = None, tile: int = TILE) -> DataFrame:
    """Adds the number of each row, from 1, in the order of keys, position and ties; with `where` only such rows are counted."""
    counts = F.lit(True) if where is None else where
    rows = _dealt(df.withColumn("__counts", counts.cast("int")), keys, F.col(position), tile)
    sizes = rows.groupBy("__key", "__tile").agg(F.sum("__counts").alias("__size"))
    # one row a tile: the only computation that is not dealt out
    sizes = sizes.select("__key", "__tile", F.sum("__size").over(Window.orderBy("__key", "__tile").rowsBetween(Window.unboundedPreceding, -1)).alias("__offset"))
    order = Window.partitionBy("__key", "__tile").orderBy(position, *ties).rowsBetween(Window.unboundedPreceding, 0)
    rows = _carried(rows.withColumn("__up", F.sum("__counts").over(order)), sizes)
    return _undealt(rows, df.columns, keys, (F.col("__up") + F.coalesce("__offset", F.lit(0))).alias(name))
