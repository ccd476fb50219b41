"""Helpers of the training-data jobs: the shared folder, words and hashes, fixed-size count sketches.

Words are runs of characters other than space, tab, line feed, vertical tab, form feed and carriage
return; that is what ``bytes.split()`` cuts, so texts are handled as UTF-8 bytes.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BASE = 0x9E3779B97F4A7C15
SECOND_BASE = 0xD6E8FEB86659FD93
MASK = (1 << 64) - 1
BLOCK_BITS = 16
HASH_MEMO = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the driver and all executors share.

    The folder is ``spark.checkpoint.dir``. Only a local session that names none gets a private one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
        root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root}/{name}-{uuid.uuid4().hex}"


def land(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: cuts lineage, survives lost executors.

    ``by`` gives each value of a column of few values a folder of its own.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class WordHash(dict):
    """64-bit hashes of words; forgets all of them when it holds ``HASH_MEMO``."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HASH_MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(words: list[bytes], memo: WordHash) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))


def ngram_hashes(values: np.ndarray, n: int, base: int = BASE) -> np.ndarray:
    """A polynomial hash modulo 2^64 of each run of ``n`` values, built from runs of 1, 2, 4, ..."""
    if len(values) < n:
        return np.empty(0, dtype=np.uint64)
    out, size, block, span, power = None, 0, values, 1, base & MASK
    while size < n:
        if n & span:
            m = len(values) - (size + span) + 1
            out = block if out is None else out[:m] * np.uint64(power) + block[size : size + m]
            size += span
        if size < n:
            m = len(values) - 2 * span + 1
            block = block[:m] * np.uint64(power) + block[span : span + m] if m > 0 else block[:0]
            power, span = power * power & MASK, span * 2
    return out[: len(values) - n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each input bit over all 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values."""
    if len(values) < width:
        return np.empty(0, dtype=values.dtype)
    out, size, block, span = None, 0, values, 1
    while size < width:
        if width & span:
            m = len(values) - (size + span) + 1
            out = block if out is None else np.minimum(out[:m], block[size : size + m])
            size += span
        if size < width:
            m = len(values) - 2 * span + 1
            block = np.minimum(block[:m], block[span : span + m]) if m > 0 else block[:0]
            span *= 2
    return out[: len(values) - width + 1]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in small pieces, so that few rows at a time become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.Table]]:
    """Of sorted rows, each run of one key with its rows, across batches; one run is held at a time."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        listed = list(zip(*columns(batch, *keys)))
        starts = [0, *(i for i in range(1, len(listed)) if listed[i] != listed[i - 1])]
        for a, b in zip(starts, [*starts[1:], len(listed)]):
            if held and listed[a] != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = listed[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def places(rows: DataFrame, group: str, order: list, name: str) -> DataFrame:
    """Adds ``pos``, the place within the group from 0 on, and ``size``, the group's number of rows; landed.

    ``group`` is never null. The rows are range-partitioned by group and order, so a group of any weight
    spreads over tasks; one row per group and task is ordered over the group. The rows should be landed,
    since sampling the ranges reads them once more.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    held = land(dealt.withColumn("_at", F.monotonically_increasing_id()), name).withColumn("_part", F.shiftright("_at", 33))
    heads = held.groupBy(group, "_part").agg(F.min("_at").alias("_head"), F.count("*").alias("_n"))
    own = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select(group, "_part", (before - F.col("_head")).alias("_shift"), F.sum("_n").over(own).alias("size"))
    return held.join(heads, [group, "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


# fixed-size sketches: ``depth`` rows of 2^bits cells, kept as one bit per cell ("reached the least count")

SKETCH = "block int, cells binary"


class CellCounts:
    """Gathers the cells that one partition hits and gives them as rows (block, cells), each cell at most ``most`` times."""

    def __init__(self, bits: int, depth: int, most: int, flush: int = 1 << 22):
        self.bits, self.depth, self.most, self.flush, self.held, self.n = bits, depth, most, flush, [], 0

    def add(self, hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(sketch_cells(hashes, self.bits, self.depth).ravel())
        self.n += len(self.held[-1])
        if self.n >= self.flush:
            yield from self.rows()

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        cells, times = np.unique(np.concatenate(self.held), return_counts=True)
        self.held, self.n = [], 0
        cells = np.repeat(cells, np.minimum(times, self.most))
        block = (cells >> np.uint64(BLOCK_BITS)).astype(np.int32)
        low = (cells & np.uint64((1 << BLOCK_BITS) - 1)).astype("<u2")
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        ends = np.r_[starts[1:], len(block)]
        yield pa.RecordBatch.from_arrays([pa.array(block[starts]), pa.array([low[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())], ["block", "cells"])


def sketch_cells(hashes: np.ndarray, bits: int, depth: int) -> np.ndarray:
    """Cell numbers of shape (depth, n); row r owns the numbers from r * 2^bits on."""
    return np.stack([(mix(hashes ^ np.uint64(BASE * (r + 1) & MASK)) >> np.uint64(64 - bits)) + np.uint64(r << bits) for r in range(depth)])


def merged_sketch(rows: DataFrame, bits: int, depth: int, least: int) -> Broadcast:
    """Adds up the partitions' rows per block and broadcasts one bit per cell: it was hit ``least`` times or more.

    What reaches the driver is ``depth * 2^bits / 8`` bytes at most, whatever the input.
    """
    blocks = max(1, depth << bits >> BLOCK_BITS)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, at = np.zeros(1 << BLOCK_BITS, dtype=np.int64), None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(counts >= least, bitorder="little").tobytes()], pa.binary())], ["block", "cells"])
        for batch in batches:
            for block, cells in zip(*columns(batch, "block", "cells")):
                if block != at:
                    if at is not None:
                        yield done()
                    at, counts = block, np.zeros(1 << BLOCK_BITS, dtype=np.int64)
                np.add(counts, np.bincount(np.frombuffer(cells, "<u2"), minlength=1 << BLOCK_BITS), out=counts)
        if at is not None:
            yield done()

    merged = rows.repartition(F.col("block")).sortWithinPartitions("block").mapInArrow(merge, SKETCH)
    out = np.zeros((blocks, (1 << BLOCK_BITS) // 8), dtype=np.uint8)
    for row in merged.toLocalIterator():
        out[row.block] = np.frombuffer(row.cells, np.uint8)
    return rows.sparkSession.sparkContext.broadcast(out.reshape(-1))


def in_sketch(bitmap: np.ndarray, hashes: np.ndarray, bits: int, depth: int) -> np.ndarray:
    """True where every row's cell is set: the count's upper estimate reaches the least count."""
    found = np.ones(len(hashes), dtype=bool)
    for cells in sketch_cells(hashes, bits, depth):
        found &= (bitmap[(cells >> np.uint64(3)).astype(np.int64)] >> (cells & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def sketch_bits(items: float, cells_per_item: int, most: int) -> int:
    return int(np.clip(np.ceil(np.log2(max(1.0, items * cells_per_item))), BLOCK_BITS, most))


def member_filter(ids: DataFrame, max_bits: int = 26):
    """A function of an id column: true for every id of ``ids`` (one long column) and for few others.

    The bitmap behind it has 16 cells an id and 2^max_bits at most; an exact join has to follow.
    """
    bits = sketch_bits(ids.count(), 16, max_bits)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = CellCounts(bits, 2, 1)
        for batch in batches:
            yield from counts.add(batch.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64))
        yield from counts.rows()

    bitmap = merged_sketch(ids.mapInArrow(cells, SKETCH), bits, 2, 1)

    def maybe(values: pa.Array) -> pa.Array:
        return pa.array(in_sketch(bitmap.value, values.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64), bits, 2))

    return F.arrow_udf(maybe, "boolean")


# first occurrences over a range-partitioned, sorted stream of keys

KEYED = "h1 long, h2 long, doc long, tag long, pos int"


def later_occurrences(rows: DataFrame, name: str) -> DataFrame:
    """Of rows (h1, h2, doc, tag, pos), those whose key (h1, h2) also stands in a smaller ``doc``: (doc, tag, pos).

    The rows are range-partitioned by key, document and position, so that one key of a third of all rows
    spreads over many tasks, and sorted inside. Each task streams its rows and holds one key. A key that runs on
    from the task before is settled by what every task says of its first and last key: at most two small
    rows per task, joined back to the few rows of a run's first document.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, opening, seen = None, None, True, False

        def out(kind, h1, h2, doc, tag, pos):
            n = len(doc)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, dtype=np.int32)), pa.array(h1), pa.array(h2), pa.array(doc), pa.array(tag), pa.array(pos)], ["kind", "h1", "h2", "doc", "tag", "pos"])

        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc, tag, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            begins = np.r_[not seen or (h1[0], h2[0]) != key, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            run = np.maximum.accumulate(np.where(begins, np.arange(len(doc)), -1))
            head = np.where(run >= 0, doc[run], first if seen else 0)
            # runs begun in this task before; the very first run stays open
            starts = np.flatnonzero(begins)
            if not seen:
                starts = starts[1:]
            limit = starts[0] if len(starts) else len(doc)
            is_open = np.arange(len(doc)) < limit if opening else np.zeros(len(doc), dtype=bool)
            late = doc > head
            if late.any():
                yield out(0, h1[late], h2[late], doc[late], tag[late], pos[late])
            held = is_open & ~late
            if held.any():
                yield out(1, h1[held], h2[held], doc[held], tag[held], pos[held])
            opening = opening and not len(starts)
            key, first, seen = (h1[-1], h2[-1]), head[-1], True
        if seen:
            one = lambda v, t=np.int64: np.array([v], dtype=t)
            yield out(2, one(key[0]), one(key[1]), one(first), one(0), one(0, np.int32))

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select("h1", "h2", "doc", "tag", "pos").repartitionByRange(parts, "h1", "h2", "doc", "tag", "pos").sortWithinPartitions("h1", "h2", "doc", "tag", "pos")
    said = land(ordered.mapInArrow(stream, "kind int, " + KEYED), name)
    firsts = said.where("kind > 0").groupBy("h1", "h2").agg(F.min("doc").alias("first"))
    settled = said.where("kind = 1").join(firsts, ["h1", "h2"]).where("doc > first")
    return said.where("kind = 0").select("doc", "tag", "pos").unionByName(settled.select("doc", "tag", "pos"))
