"""Reading and landing tables: CSV, JSON items, URL lists, result pages, projected and keyed writes."""

from __future__ import annotations

import csv
from collections.abc import Callable, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefacts.functions import text as T
from sitefacts.functions.blocks import BLOCK, range_sum, ranged, scan
from sitefacts.operators.first import first_per_key
from sitefacts.operators.urls import with_start_url
from sitefacts.session import land  # noqa: F401  part of this module's interface

CSV_OPTIONS = {"header": True, "multiLine": True, "escape": '"', "quote": '"', "enforceSchema": False}


def _hadoop_path(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def paths_matching(spark: SparkSession, pattern: str) -> list[str]:
    """Sorted paths of a glob on any file system Spark reads."""
    path, fs = _hadoop_path(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(path) or [])


def csv_options(multi_line: bool) -> dict:
    """Quoted line breaks need ``multi_line``, and then a file is one task; without them files are split."""
    return {**CSV_OPTIONS, "multiLine": multi_line}


def read_csv_table(spark: SparkSession, path: str, bom: bool = False, multi_line: bool = True) -> DataFrame:
    """A CSV table with header as trimmed strings; absent or empty files give an empty table.

    ``bom`` drops a byte order mark in front of the first column name; for ``multi_line`` see ``csv_options``.
    """
    if not paths_matching(spark, path):
        return spark.createDataFrame([], "`_empty` string").drop("_empty")
    df = spark.read.options(**csv_options(multi_line)).csv(path)
    if bom and df.columns:
        df = df.toDF(df.columns[0].lstrip("﻿"), *df.columns[1:])
    # a quoted header cell may itself hold dots, hence the back quotes
    return df.select(*[T.strip(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(c) for c in df.columns])


def csv_headers(spark: SparkSession, paths: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """The header of each file, from one job over all of them; a header's cells hold no line breaks."""
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias("at"), "value")
    first = lines.groupBy("path").agg(F.min_by("value", "at").alias("head")).collect()  # one row per file
    plain = lambda p: unquote(p).replace("file:///", "/").replace("file:/", "/")
    found = {plain(r["path"]): tuple(next(csv.reader([r["head"]]), ())) for r in sorted(first, key=lambda r: r["path"], reverse=True)}
    # a path may be the directory of one table's parts, which share a header
    by_parent = {name.rpartition("/")[0]: head for name, head in found.items()}
    return {p: found.get(plain(p), by_parent.get(plain(p), ())) for p in paths}


def merge_csv_files(spark: SparkSession, root: str, kind: str | None = None, pattern: str | None = None, multi_line: bool = True) -> DataFrame:
    """All rows of the matching CSV files; the header is the union of headers in first-seen order."""
    paths = paths_matching(spark, f"{root}/{pattern or f'*/{kind}.csv'}")
    if not paths:
        raise ValueError(f"no CSV files below {root}")
    headers = csv_headers(spark, paths)
    header = list(dict.fromkeys(c for p in paths for c in headers[p]))
    if not header:
        raise ValueError("no CSV columns in the selected files")
    # files of one header are read as one scan, so the plan grows with headers, not with files
    by_header: dict[tuple[str, ...], list[str]] = {}
    for p in paths:
        by_header.setdefault(headers[p], []).append(p)
    scans = [spark.read.options(**csv_options(multi_line)).csv(group) for columns, group in by_header.items() if columns]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)
    return merged.select(*[F.col(f"`{c}`") for c in header]).na.fill("")


def resolve_column(df: DataFrame, candidates: Sequence[str], requested: str | None = None, containing: str | None = None, default_first: bool = False) -> str:
    """Name of the column to use: the requested one, else the first candidate that exists without
    regard to case, else one that contains a word, else (if allowed) the first; empty when none fits."""
    by_lower = {c.lower(): c for c in df.columns}
    wanted = [requested] if requested else []
    for name in (*wanted, *candidates):
        if name.lower() in by_lower:
            return by_lower[name.lower()]
    if containing:
        for c in df.columns:
            if containing in c.lower():
                return c
    return df.columns[0] if default_first and df.columns else ""


def resolved(df: DataFrame, candidates: Sequence[str], out: str, **options) -> DataFrame:
    """The non-blank values of the resolved column, trimmed."""
    name = resolve_column(df, candidates, **options)
    rows = df.withColumn(out, T.strip(T.text_of(F.col(f"`{name}`").cast("string")))) if name else df.withColumn(out, F.lit(""))
    return rows.filter(F.col(out) != "")


def looks_like_url(c: Column) -> Column:
    return F.lower(c).rlike(r"^https?://") | F.lower(c).rlike(r"t\.me/|telegram\.me/")


def slice_rows(df: DataFrame, order_by: str, ident: str, start_row: int = 1, end_row: int | None = None, limit: int | None = None) -> DataFrame:
    """Rows of a 1-based inclusive range of the whole table; then those with an id, up to the limit.

    The order column has no repeats and may have any gaps. Rows are cut into ranges and counted per
    range, so no task orders or limits the whole table.
    """
    order = [F.col(order_by)]
    rows = range_sum(ranged(df, [], order), [], order, F.lit(1), "row_number").filter(F.col("row_number") >= start_row)
    if end_row is not None:
        rows = rows.filter(F.col("row_number") <= end_row)
    rows = rows.filter(T.strip(T.text_of(F.col(ident).cast("string"))) != "")
    if limit is not None:
        rows = range_sum(rows, [], order, F.lit(1), "_kept").filter(F.col("_kept") <= limit).drop("_kept")
    return rows.drop(BLOCK)


def load_url_list(spark: SparkSession, path: str) -> DataFrame:
    """(start_url, error, pos): start URLs of a text file, first occurrence kept; blank and ``#`` lines skipped.

    A line that is no usable URL stays in with its error, under the NULL URL's own text.
    """
    lines = spark.read.text(path).select(
        T.strip(F.col("value")).alias("raw"),
        # file, place of the split in it, place in the split
        F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias("pos"),
    )
    return url_list(lines.filter("raw <> '' AND NOT startswith(raw, '#')"))


def url_list(lines: DataFrame, raw: str = "raw", pos: str = "pos") -> DataFrame:
    rows = with_start_url(lines, raw, "start_url")
    return first_per_key(rows, [F.coalesce("start_url", raw)], [pos]).select("start_url", "error", pos)


def flatten_items(items: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Items as one wide table: nested objects and lists become JSON text, other values stay.

    ``columns`` gives the header order (the order keys were first seen in); without any key there is
    the single column ``item_json``.
    """
    names = list(columns) if columns else items.columns
    if not names:
        return items.select(F.lit(None).cast("string").alias("item_json"))
    nested = ("array", "struct", "map", "variant")
    kinds = dict(items.dtypes)
    return items.select(
        *[(F.to_json(c) if kinds[c].startswith(nested) else F.col(c)).alias(c) if c in kinds else F.lit(None).cast("string").alias(c) for c in names]
    )


def read_items(spark: SparkSession, payloads: DataFrame, json_col: str, order: str | None = None) -> DataFrame:
    """Heterogeneous JSON objects as a table of the union of their keys, in first-seen order.

    ``order`` names the input order; without it, it is that of Spark's splits. Keys are combined in the
    map tasks; what reaches the driver is the header, one row per distinct key.
    """
    at = F.col(order) if order else F.monotonically_increasing_id()
    keys = (
        payloads.select(at.alias("_row"), F.posexplode(F.json_object_keys(json_col)).alias("_i", "key"))
        .groupBy("key")
        .agg(F.min(F.struct("_row", "_i")).alias("_at"))
        .orderBy("_at")
    )
    names = [r["key"] for r in keys.collect()]
    return payloads.select(*[F.get_json_object(json_col, f"$['{n}']").alias(n) for n in names]) if names else flatten_items(payloads.select())


def explode_payload_pages(df: DataFrame, payload: str, item_schema: str) -> DataFrame:
    """One row per item of the landed result pages: (page columns, item_pos, item)."""
    parsed = df.withColumn("_p", F.from_json(payload, f"items array<{item_schema}>"))
    return parsed.select(*df.columns, F.posexplode("_p.items").alias("item_pos", "item")).drop(payload)


def pagination_audit(pages: DataFrame, query: str, page: str, payload: str, max_pages: int | None = None) -> DataFrame:
    """Per query: expected and collected totals, whether they agree, and the page the reader stops at.

    A page is the last if it is empty, if it completes the total, if the stated number of pages ends
    with it, or at the page cap. Pages are numbered from 0.
    """
    rows = pages.select(query, page, F.from_json(payload, "items array<string>, total bigint, pages int").alias("_p"))
    rows = rows.select(query, page, F.coalesce(F.size("_p.items"), F.lit(0)).alias("n"), F.col("_p.total").alias("total"), F.col("_p.pages").alias("pages"))
    rows = scan(rows, [query], page, sums={"_sum": F.col("n")}, first={"_total": F.col("total")})
    last = (F.col("n") == 0) | (F.col("_sum") >= F.col("_total")) | (F.col(page) + 1 >= F.col("pages"))
    if max_pages is not None:
        last = last | (F.col(page) + 1 >= max_pages)
    audit = rows.groupBy(query).agg(
        F.min_by("total", page).alias("expected"),
        F.sum("n").alias("collected"),
        F.min(F.when(last, F.col(page))).alias("last_page"),
    )
    return audit.withColumn("mismatch", F.coalesce(F.col("expected") != F.col("collected"), F.lit(False)))


def projected(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The listed columns as text: absent ones and NULLs empty, lists joined by ``; ``, flags 1 or 0."""
    kinds = dict(df.dtypes)

    def cell(name: str) -> Column:
        if name not in kinds:
            return F.lit("")
        if kinds[name].startswith("array"):
            return F.coalesce(F.array_join(name, "; "), F.lit(""))
        if kinds[name] == "boolean":
            return F.when(F.col(name), F.lit("1")).otherwise(F.lit("0"))
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    return df.select(*[cell(n).alias(n) for n in fields])


def write_projected(df: DataFrame, path: str, fields: Sequence[str], mode: str = "overwrite", row: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Writes the listed columns as CSV with header; ``row`` may reshape the rows first."""
    projected(df.transform(row) if row else df, fields).write.mode(mode).options(header=True, escape='"', emptyValue="").csv(path)


def write_per_site(df: DataFrame, root: str, key: str = "domain", fmt: str = "parquet") -> None:
    """One directory per site; only the directories of sites in this batch are replaced."""
    # small sites share a task, a large one is split over several
    df.hint("rebalance", F.col(key)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).format(fmt).save(root)


def append_unique(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows to append: all key parts filled, key not stored yet, first of its key in the batch."""
    filled = reduce(lambda a, b: a & b, [T.strip(T.text_of(F.col(k).cast("string"))) != "" for k in keys])
    trimmed = [T.strip(F.col(k).cast("string")) for k in keys]
    fresh = first_per_key(incoming.filter(filled), trimmed, order)
    known = existing.select(*[T.strip(F.col(k).cast("string")).alias(f"_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [t == F.col(f"_{k}") for t, k in zip(trimmed, keys)])
    return fresh.join(known, same, "left_anti")


def pending_after_resume(all_df: DataFrame, done_df: DataFrame, key: str, done_key: str | None = None) -> DataFrame:
    """Inputs whose key is not in the earlier output, compared trimmed and without regard to case."""
    done = done_df.select(F.lower(T.strip(F.col(done_key or key))).alias("_done")).distinct()
    return all_df.join(done, F.lower(T.strip(F.col(key))) == F.col("_done"), "left_anti")


LINK_SINKS = {"hh": ("hh",), "telegram": ("telegram",), "max": ("max",), "dzen": ("dzen",), "drive2": ("drive2",), "other": ("other",), "video": ("video", "other"), "social": ("social", "other")}


def route_links(links: DataFrame, firm: str, url: str, kind: str = "kind", source: str = "source", order: Sequence[str] = ("pos",), stored: DataFrame | None = None) -> DataFrame:
    """(sink, link columns): every link with the sinks it goes to, new and once per sink, firm and URL.

    Video and social links go to their own table and to the table of other links. ``stored`` holds what
    earlier runs wrote, with its sink.
    """
    sinks = F.create_map(*[x for k, v in LINK_SINKS.items() for x in (F.lit(k), T.literals(v))])
    rows = links.filter(F.col(kind).isin(*LINK_SINKS)).withColumn("sink", F.explode(sinks[F.col(kind)]))
    rows = rows.withColumn(source, F.concat_ws("_", source, kind))
    if stored is None:
        filled = (T.strip(T.text_of(firm)) != "") & (T.strip(T.text_of(url)) != "")
        return first_per_key(rows.filter(filled), ["sink", T.strip(F.col(firm)), T.strip(F.col(url))], order)
    return append_unique(stored, rows, ["sink", firm, url], order)


def write_links(routed: DataFrame, root: str) -> None:
    routed.hint("rebalance", F.col("sink")).write.mode("append").partitionBy("sink").parquet(root)
