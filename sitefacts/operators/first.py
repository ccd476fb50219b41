"""First-wins and best-of per key, as aggregates that combine before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the one that comes first in the order.

    ``min_by`` keeps a single row per key in every map task, so a hot key costs one row per task.
    """
    names = df.columns
    key_columns = [F.col(k) if isinstance(k, str) else k for k in keys]
    order_columns = [F.col(o) if isinstance(o, str) else o for o in order]
    keyed = df.select(
        *[c.alias(f"_k{i}") for i, c in enumerate(key_columns)],
        F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order_columns)]).alias("_o"),
        F.struct(*names).alias("_row"),
    )
    return (
        keyed.groupBy(*[f"_k{i}" for i in range(len(key_columns))])
        .agg(F.min_by("_row", "_o").alias("_row"))
        .select("_row.*")
    )


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of each key. Spark cuts every map task to n rows per key before the shuffle."""
    from pyspark.sql import Window

    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def collect_ordered(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, sep: str | None = "; ") -> DataFrame:
    """The values of a key in order, as one cell (joined when a separator is given)."""
    pairs = F.array_sort(F.collect_list(F.struct(*order, value)))
    values = F.transform(pairs, lambda p: p[value])
    return df.groupBy(*keys).agg((F.array_join(values, sep) if sep is not None else values).alias(name))
