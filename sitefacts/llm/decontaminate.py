"""Benchmark decontamination by greedy string tiling.

Words are lower-cased (ASCII) and lose punctuation at their ends. Runs of five words of the benchmark
are the seeds (a shorter item is one seed). A fixed-size bitmap of the seeds lets each document name the
few places where a seed may stand; these places are joined with the rarer seeds of each item exactly
(``rare_seeds``), and every pair of a document and an item that shares enough of them is tiled: the longest common run of words not yet covered
is marked again and again, so that passages in another order still cover the item. The pair counts when
the tiles cover ``min_percent`` of the item's words.

Only the words around seeds leave a document, so no text is shuffled.

Rules for odd input: items without words match nothing, items of any other length are looked for whole or in
tiles, a single common word too, since the benchmark's owner decides what an item is; an item without an
item_id is one as well; null or empty texts hold no seeds; rows without
a doc_id are judged by ``row_hits`` only, as their texts; rows of one doc_id are judged one by one and the best coverage stands; rows of
one item_id with different texts are different passages of it. Ties between equally long tiles go to the earlier place in the
item, then in the document. Empty tables give an empty result; only doc_id, item_id and text are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitefacts.llm.common import BASE, MASK, SECOND_BASE, SKETCH, CellCounts, WordHash, columns, in_sketch, land, merged_sketch, mix, ngram_hashes, signed, sketch_bits, slices, utf8, word_hashes
from sitefacts.llm.line_dedup import text_tag
from sitefacts.llm.quality_rules import bare

SEED = 5
MIN_PERCENT = 80
DEPTH, MAX_BITS = 2, 29


def tokens(text: str | None, memo: WordHash) -> np.ndarray:
    """64-bit hashes of a text's bare words."""
    return word_hashes([w for w in bare(utf8(text).split()) if w], memo)


def seeds_of(values: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; runs of different lengths have different hashes."""
    return mix(ngram_hashes(values, n, BASE) ^ np.uint64(n * SECOND_BASE & MASK))


def running_hashes(values: list[int], n: int) -> list[int]:
    """Karp-Rabin: the hash of each run of n values, each from the one before."""
    if len(values) < n:
        return []
    top, h = pow(BASE, n - 1, 1 << 64), 0
    for v in values[:n]:
        h = (h * BASE + v) & MASK
    out = [h]
    for gone, come in zip(values, values[n:]):
        h = ((h - gone * top) * BASE + come) & MASK
        out.append(h)
    return out


def tiles(item: list[int], doc: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, item place, document place): always the longest run of unmarked words, at least ``least``."""
    where: dict[int, list[int]] = {}
    for i, h in enumerate(running_hashes(item, least)):
        where.setdefault(h, []).append(i)
    heap = []
    for d, h in enumerate(running_hashes(doc, least)):
        for i in where.get(h, ()):
            if i and d and item[i - 1] == doc[d - 1]:
                continue  # inside a run that began earlier
            n = 0
            while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n]:
                n += 1
            if n >= least:
                heap.append((-n, i, d))
    heapq.heapify(heap)
    item_free, doc_free, out = [True] * len(item), [True] * len(doc), []
    while heap:
        n, i, d = heapq.heappop(heap)
        n, k = -n, 0
        free = [item_free[i + x] and doc_free[d + x] for x in range(n)]
        if all(free):
            out.append((n, i, d))
            item_free[i : i + n] = [False] * n
            doc_free[d : d + n] = [False] * n
            continue
        while k < n:  # what is left of it goes back as shorter runs
            if not free[k]:
                k += 1
                continue
            start = k
            while k < n and free[k]:
                k += 1
            if k - start >= least:
                heapq.heappush(heap, (start - k, i + start, d + start))
    return out


def covered(item: list[int], doc: list[int], least: int) -> int:
    """Words of the item under tiles; items shorter than ``least`` must stand whole."""
    return sum(n for n, _, _ in tiles(item, doc, min(least, len(item)))) if item else 0


def seed_places(values: np.ndarray, sizes: list[int], found) -> tuple[np.ndarray, np.ndarray]:
    """(distinct seed hashes that may be the benchmark's, mask of the words under them)."""
    mask, hits = np.zeros(len(values) + 1, dtype=np.int64), []
    for n in sizes:
        own = seeds_of(values, n)
        at = np.flatnonzero(found(own))
        if len(at):
            hits.append(own[at])
            np.add.at(mask, at, 1)
            np.add.at(mask, at + n, -1)
    return np.unique(np.concatenate(hits)) if hits else np.empty(0, np.uint64), np.cumsum(mask)[:-1] > 0


def rare_seeds(held: DataFrame, bench: DataFrame, min_percent: int, seed: int) -> DataFrame:
    """(hit, times, item_id, item_tag, least): the seeds of an item that pairs are joined on.

    A pair at ``min_percent`` shares ``need`` seed places of the item or more, since a seed covers ``seed``
    words at most at each place. The item's most frequent seeds, up to half of that, stay out of the join;
    what a pair must share of the others is ``least``. A common phrase that many items and texts hold thus
    makes no pairs, unless it is most of an item.
    """
    n_times = F.explode(F.arrays_zip(F.col("seeds").alias("hit"), F.col("times").alias("times"))).alias("s")
    need = F.ceil(F.size("words") * F.lit(min_percent) / F.lit(100 * seed))
    seeds = bench.select("item_id", "item_tag", need.alias("need"), n_times).select("item_id", "item_tag", "need", "s.hit", "s.times")
    often = held.select(F.explode("hits").alias("hit")).groupBy("hit").agg(F.count("*").alias("n"))
    item = Window.partitionBy("item_id", "item_tag")
    seeds = seeds.join(often, "hit").withColumn("upto", F.sum("times").over(item.orderBy(F.col("n").desc(), "hit").rowsBetween(Window.unboundedPreceding, 0)))
    seeds = seeds.withColumn("common", F.col("upto") * 2 < F.col("need"))
    seeds = seeds.withColumn("least", F.col("need") - F.coalesce(F.max(F.when(F.col("common"), F.col("upto"))).over(item), F.lit(0)))
    return seeds.where(~F.col("common")).select("hit", "times", "item_id", "item_tag", "least")


def row_hits(docs: DataFrame, items: DataFrame, min_percent: int = MIN_PERCENT, seed: int = SEED, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, tag, item_id, n_words, n_covered): rows, told apart by doc_id and text tag, whose tiles cover ``min_percent`` of the item or more."""

    def item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for batch in slices(batches):
            ids, texts, tags = columns(batch, "item_id", "text", "item_tag")
            words = [tokens(t, memo) for t in texts]
            hashes = [np.unique(seeds_of(w, min(seed, len(w))), return_counts=True) if len(w) else (np.empty(0, np.uint64), np.empty(0, np.int64)) for w in words]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array([signed(w) for w in words], pa.list_(pa.int64())), pa.array([signed(h) for h, _ in hashes], pa.list_(pa.int64())), pa.array([n for _, n in hashes], pa.list_(pa.int64()))],
                ["item_id", "item_tag", "words", "seeds", "times"],
            )

    read = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), text_tag().alias("item_tag")).distinct()
    bench = land(read.mapInArrow(item_rows, "item_id long, item_tag long, words array<long>, seeds array<long>, times array<long>").where("size(words) > 0"), "benchmark")
    said = bench.agg(F.sum(F.size("seeds")).alias("n"), F.collect_set(F.least(F.size("words"), F.lit(seed))).alias("sizes")).first()
    sizes, bits = sorted(said.sizes), sketch_bits(said.n or 0, 64, max_bits)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = CellCounts(bits, DEPTH, 1)
        for batch in slices(batches):
            for own in columns(batch, "seeds")[0]:
                yield from counts.add(np.array(own, dtype=np.int64).view(np.uint64))
        yield from counts.rows()

    sketch = merged_sketch(bench.select("seeds").mapInArrow(cells, SKETCH), bits, DEPTH, 1)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for batch in slices(batches):
            ids, tags, hits, parts = [], [], [], []
            for doc, tag, text in zip(*columns(batch, "doc_id", "tag", "text")):
                values = tokens(text, memo)
                own, mask = seed_places(values, sizes, lambda h: in_sketch(sketch.value, h, bits, DEPTH))
                if len(own):
                    edges = np.flatnonzero(np.diff(np.r_[False, mask, False])).reshape(-1, 2)
                    ids.append(doc)
                    tags.append(tag)
                    hits.append(signed(own))
                    parts.append([signed(values[a:b]) for a, b in edges])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.list_(pa.int64())))], ["doc_id", "tag", "hits", "parts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_tag().alias("tag"), F.col("text").cast("string").alias("text"))
    held = land(rows.mapInArrow(places, "doc_id long, tag long, hits array<long>, parts array<array<long>>"), "seed-places")
    pairs = held.select("doc_id", "tag", F.explode("hits").alias("hit")).distinct().join(land(rare_seeds(held, bench, min_percent, seed), "seeds"), "hit")
    pairs = pairs.groupBy("doc_id", "tag", "item_id", "item_tag").agg(F.sum("times").alias("n_seeds"), F.first("least").alias("least"))
    able = pairs.where("n_seeds >= least")
    texts = held.dropDuplicates(["doc_id", "tag"]).select(F.col("doc_id").alias("of_doc"), F.col("tag").alias("of_tag"), "parts")
    met = able.join(texts, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("tag") == F.col("of_tag")))
    of_items = bench.select(F.col("item_id").alias("of_item"), F.col("item_tag").alias("of_item_tag"), "words")
    one = met.join(of_items, F.col("item_id").eqNullSafe(F.col("of_item")) & (F.col("item_tag") == F.col("of_item_tag"))).select("doc_id", "tag", "item_id", "parts", "words")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, tags, items_, parts, words = columns(batch, "doc_id", "tag", "item_id", "parts", "words")
            got = []
            for of_doc, of_item in zip(parts, words):
                text: list[int] = []
                for i, part in enumerate(of_doc):
                    text.extend([(1 << 63) + i, *(v & MASK for v in part)])  # parts do not run into each other
                got.append(covered([v & MASK for v in of_item], text[1:], seed))
            n = [len(w) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, tags, items_, n, got)], ["doc_id", "tag", "item_id", "n_words", "n_covered"])

    return one.mapInArrow(tile, "doc_id long, tag long, item_id long, n_words long, n_covered long").where(F.col("n_covered") * 100 >= F.col("n_words") * min_percent)


def benchmark_hits(docs: DataFrame, items: DataFrame, min_percent: int = MIN_PERCENT, seed: int = SEED, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, item_id, n_words, n_covered) of rows with a doc_id: the best coverage of each pair."""
    judged = row_hits(docs.where("doc_id IS NOT NULL"), items, min_percent, seed, max_bits)
    return judged.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n_words", "n_covered"), F.col("n_covered") / F.col("n_words")).alias("best")).select("doc_id", "item_id", "best.n_words", "best.n_covered")
