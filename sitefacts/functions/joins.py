"""Joins of many rows with one lookup row per key, safe for hot keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefacts.session import land

_KEY = "_lookup_{}"


def lookup_join(rows: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left", null_safe: bool = False, strategy: str | None = None, landed: bool = False) -> DataFrame:
    """``rows`` with the columns of ``lookup``'s one row per key.

    The lookup is landed first. An aggregate keeps the rows of a key together, so a join straight on one
    can't be split; with a landed lookup both inputs of the join come from a plain shuffle, and AQE cuts a
    hot key's rows into tasks that each read the same lookup row. That holds as long as the next step does
    not ask for the same keys together again; such a step starts with an aggregate in the map tasks.
    A small lookup is broadcast by its known size. A null key meets nothing, unless ``null_safe``.
    ``strategy`` is a join hint for the lookup, such as ``shuffle_hash``; ``landed`` says that it is landed already.
    """
    named = (lookup if landed else land(lookup, "lookup")).withColumnsRenamed({k: _KEY.format(k) for k in on})
    named = named.hint(strategy) if strategy else named
    pair = lambda k: (F.col(k), F.col(_KEY.format(k)))
    same = [a.eqNullSafe(b) if null_safe else a == b for a, b in map(pair, on)]
    return rows.join(named, reduce(lambda a, b: a & b, same), how).drop(*[_KEY.format(k) for k in on])
