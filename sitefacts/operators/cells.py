"""Values of a key of any size: as numbered rows, and as cells cut into numbered parts.

A joined cell is one row and needs its values in one task. Here values are put in ranges by key and order
and numbered there, so a key with any number of values spreads over as many tasks as it fills; a cell
part holds a stated number of values at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefacts.functions.blocks import BLOCK, range_sum, ranged
from sitefacts.operators.first import collect_ordered

PART_VALUES = 1_000


def numbered_values(df: DataFrame, keys: Sequence[str], order: Sequence[Column], number: str = "value_no") -> DataFrame:
    """Adds the 1-based place of each value within its key. Rows are landed; the order may have ties, whose places are then any."""
    return range_sum(ranged(df, keys, order), keys, order, F.lit(1), number).drop(BLOCK)


def cell_parts(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, out: str, most: int = PART_VALUES, sep: str | None = "; ") -> DataFrame:
    """(keys, part, out): the values of a key in order, ``most`` to a part, parts numbered from 1.

    ``order`` holds ascending columns. Joining the parts of a key in order gives the whole cell. A value that is NULL has no place in a joined cell, but counts.
    """
    rows = numbered_values(df.select(*keys, *[o.alias(f"_o{i}") for i, o in enumerate(order)], value), keys, [F.col(f"_o{i}") for i in range(len(order))], "_no")
    part = F.floor((F.col("_no") - 1) / most) + 1
    return collect_ordered(rows.withColumn("part", part), [*keys, "part"], ["_no"], value, out, sep)
