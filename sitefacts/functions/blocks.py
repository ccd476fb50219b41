"""Ordered computations over keys of any size.

A plain window puts all rows of a key in one task. Here every key is cut into blocks of ``width``
consecutive positions; windows run inside (key, block), and only one summary row per block is
ordered over the whole key. Positions are integers, unique within the key, and may have gaps.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitefacts.session import land

WIDTH = 65_536
BLOCK = "_block"


def _blocked(df: DataFrame, pos: str, width: int) -> DataFrame:
    return df.withColumn(BLOCK, F.floor(F.col(pos) / width))


def _join_blocks(df: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    # (key, block) holds at most ``width`` rows, so the join has no hot key; NULL is a key like others
    named = summary.withColumnsRenamed({k: f"_r_{k}" for k in (*keys, BLOCK)})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in (*keys, BLOCK)])
    return df.join(named, same, "left").drop(*[f"_r_{k}" for k in (*keys, BLOCK)])


def scan(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    sums: Mapping[str, Column] | None = None,
    last: Mapping[str, Column] | None = None,
    first: Mapping[str, Column] | None = None,
    width: int = WIDTH,
) -> DataFrame:
    """Running values within each key, all in one pass over the rows.

    ``sums`` adds up to and with this row; ``last`` and ``first`` give the last and the first non-null
    value up to and with this row.
    """
    keys, sums, last, first = list(keys), dict(sums or {}), dict(last or {}), dict(first or {})
    blocked = _blocked(df.withColumns({**sums, **last, **first}), pos, width)
    filled = lambda c: F.when(F.col(c).isNotNull(), F.col(pos))
    summary = blocked.groupBy(*keys, BLOCK).agg(
        *[F.sum(c).alias(f"_s_{c}") for c in sums],
        *[F.max_by(c, filled(c)).alias(f"_s_{c}") for c in last],
        *[F.min_by(c, filled(c)).alias(f"_s_{c}") for c in first],
    )
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *keys,
        BLOCK,
        *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_c_{c}") for c in sums],
        *[F.last(f"_s_{c}", ignorenulls=True).over(before).alias(f"_c_{c}") for c in last],
        *[F.first(f"_s_{c}", ignorenulls=True).over(before).alias(f"_c_{c}") for c in first],
    )
    inside = Window.partitionBy(*keys, BLOCK).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    carry = lambda c: F.col(f"_c_{c}")
    rows = _join_blocks(blocked, carried, keys).withColumns(
        {
            **{c: F.coalesce(F.sum(c).over(inside), F.lit(0)) + carry(c) for c in sums},
            **{c: F.coalesce(F.last(c, ignorenulls=True).over(inside), carry(c)) for c in last},
            **{c: F.coalesce(carry(c), F.first(c, ignorenulls=True).over(inside)) for c in first},
        }
    )
    return rows.drop(BLOCK, *[f"_c_{c}" for c in (*sums, *last, *first)])


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows in ranges of about equal size by key and order, landed with the number of their range.

    For orders with gaps of any size. A key of any weight spreads over as many ranges as it fills.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return land(df.repartitionByRange(parts, *keys, *order).withColumn(BLOCK, F.spark_partition_id()), "ranges")


def range_sum(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """Adds the sum of the value from the key's first row up to this one; ``rows`` come from ``ranged``.

    One summary row per key and range is ordered over the key; the rows are sorted inside their range.
    """
    totals = rows.groupBy(*keys, BLOCK).agg(F.sum(value.cast("bigint")).alias("_sum"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, BLOCK, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return _join_blocks(rows, offsets, keys).withColumn(name, F.sum(value.cast("bigint")).over(inside) + F.col("_before")).drop("_before")


def numbered(df: DataFrame, keys: Sequence[str], pos: str, name: str, width: int = WIDTH) -> DataFrame:
    """Adds the 1-based row number within the key, in order of position."""
    return scan(df, keys, pos, sums={name: F.lit(1).cast("bigint")}, width=width)


def running_sum(df: DataFrame, keys: Sequence[str], pos: str, value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """Adds the sum of the value from the first row of the key up to this row."""
    return scan(df, keys, pos, sums={name: value}, width=width)


def forward_fill(df: DataFrame, keys: Sequence[str], pos: str, value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """Adds the last non-null value at or before this row."""
    return scan(df, keys, pos, last={name: value}, width=width)


def neighbours(df: DataFrame, keys: Sequence[str], pos: str, value: str, prev: str, following: str, width: int = WIDTH) -> DataFrame:
    """Adds the value of the row before and of the row after; NULL at the ends of the key."""
    keys = list(keys)
    blocked = _blocked(df, pos, width).withColumn("_v", F.struct(F.col(value).alias("v")))
    over_blocks = Window.partitionBy(*keys).orderBy(BLOCK)
    edges = (
        blocked.groupBy(*keys, BLOCK)
        .agg(F.min_by("_v", pos).alias("_first"), F.max_by("_v", pos).alias("_last"))
        .select(
            *keys,
            BLOCK,
            F.lag("_last").over(over_blocks).alias("_before"),
            F.lead("_first").over(over_blocks).alias("_after"),
        )
    )
    inside = Window.partitionBy(*keys, BLOCK).orderBy(pos)
    return (
        _join_blocks(blocked, edges, keys)
        .withColumn(prev, F.coalesce(F.lag("_v").over(inside), F.col("_before"))["v"])
        .withColumn(following, F.coalesce(F.lead("_v").over(inside), F.col("_after"))["v"])
        .drop(BLOCK, "_v", "_before", "_after")
    )


def with_lookahead(df: DataFrame, keys: Sequence[str], number: str, ahead: int, width: int = WIDTH) -> tuple[DataFrame, Window]:
    """Blocks that also hold the first ``ahead`` rows of the next block.

    ``number`` is a gapless row number (see ``numbered``). A frame of up to ``ahead`` following rows
    over the returned window is exact on rows where ``_own`` is true; the caller keeps those.
    """
    home = F.floor((F.col(number) - 1) / width)
    spread = (
        df.withColumn("_home", home)
        .withColumn(
            BLOCK,
            F.explode(
                F.when(
                    (F.col("_home") > 0) & ((F.col(number) - 1) % width < ahead),
                    F.array(F.col("_home"), F.col("_home") - 1),
                ).otherwise(F.array("_home"))
            ),
        )
        .withColumn("_own", F.col(BLOCK) == F.col("_home"))
        .drop("_home")
    )
    return spread, Window.partitionBy(*keys, BLOCK).orderBy(number)
