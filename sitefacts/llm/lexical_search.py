"""Ranked lexical search by pipelined term partitioning.

The index is cut twice. Documents fall into shards of SHARD_DOCS or fewer, as they are read. Terms fall
to OWNERS owners by how many documents hold them, the rarest first, so that each owner holds about the
same number of postings. Items travel in bundles of BUNDLE_ITEMS: for each shard a bundle carries sparse
accumulators (item, document, score) through the owners one after the other. An owner's stage is a cogroup
of the bundles with its postings; it adds the integer contributions of its terms for every item. After the
last owner each bundle gives the best documents of its shard, and the best of all shards are the result.

A bundle lets go of a document only where that can't change the result: when TOP documents of the shard
already have more than the document's score plus the most that the owners to come can add to it.

Terms are told apart by 64-bit hashes (below one chance in a million for 10,000 terms asked and a
billion different words). Postings are kept only for terms that some item may have, by a bitmap of the
items' terms with a fixed greatest size. Items go in waves of WAVE_TERMS (item, term) pairs, whose weights
are broadcast; a further wave reads the landed postings once more. An item stays whole.

Rules for odd input: a null or empty text has no terms; an item without terms, or whose terms no document
holds, has no rows; each row of ``items`` is an item and each row of ``docs`` a document, repeated rows
and equal ids included; among equal scores rows without a doc_id come last, and rows of one doc_id take
ranks in any order, since their rows are alike. Empty tables give an empty result. Extra columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitefacts.llm.common import SKETCH, CellCounts, WordHash, columns, in_sketch, land, merged_sketch, sketch_bits, slices, utf8, word_hashes

TOP = 10
SHARD_DOCS, SHARD_POSTINGS = 8192, 1 << 22
OWNERS, BUNDLE_ITEMS = 4, 256
WAVE_TERMS = 1 << 18
DEPTH, MAX_BITS = 2, 28
#: Scores: weights are per mille of a logarithm, and a term's occurrences saturate at the scale's full value.
SCALE, HALF = 1_000_000_000, 8
SEPARATORS = bytes(c for c in range(128) if not (chr(c).isdigit() or chr(c).isalpha()))
TERM_BYTES = bytes.maketrans(SEPARATORS + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(SEPARATORS) + b"abcdefghijklmnopqrstuvwxyz")
POSTINGS = "shard long, n_held long, n_terms long, ids array<long>, lengths array<int>, terms binary, places binary, times binary"
BUNDLES = "bundle int, shard long, items binary, places binary, scores binary"
OWNED = "owner int, bundle int, shard long, terms binary, places binary, gains binary, ids array<long>"


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased."""
    return utf8(text).translate(TERM_BYTES).split()


def weight(n_docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


def damping(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Of documents by their number of terms, in hundredths: 100 for the mean length."""
    return 100 - 90 + 90 * lengths.astype(np.int64) * n_docs // max(1, n_terms)


def gain(times: np.ndarray, damped: np.ndarray) -> np.ndarray:
    """What a term's occurrences count for, to be multiplied by its weight."""
    return SCALE * times.astype(np.int64) // (1000 * times.astype(np.int64) + HALF * damped)


# the index


def build_postings(docs: DataFrame, wanted, bits: int) -> DataFrame:
    """Landed shards: each has its documents in order of id, and postings sorted by term for terms that may be asked."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        held: list[tuple[int | None, int, np.ndarray, np.ndarray]] = []
        n_postings = 0

        def shard() -> pa.RecordBatch:
            order = sorted(range(len(held)), key=lambda i: (held[i][0] is None, held[i][0] or 0))
            terms = np.concatenate([held[i][2] for i in order])
            places = np.repeat(np.arange(len(order), dtype=np.uint16), [len(held[i][2]) for i in order])
            times = np.concatenate([held[i][3] for i in order])
            by = np.argsort(terms, kind="stable")
            lengths = [held[i][1] for i in order]
            values = (sum(n > 0 for n in lengths), sum(lengths), [held[i][0] for i in order], lengths, terms[by].tobytes(), places[by].tobytes(), times[by].tobytes())
            types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], [c.split()[0] for c in POSTINGS.split(", ")[1:]])

        for batch in slices(batches):
            for doc, text in zip(*columns(batch, "doc_id", "text")):
                words = terms_of(text)
                hashes = word_hashes(words, memo)
                asked, times = np.unique(hashes[in_sketch(wanted.value, hashes, bits, DEPTH)], return_counts=True)
                held.append((doc, len(words), asked, times.astype(np.int32)))
                n_postings += len(asked)
                if len(held) >= SHARD_DOCS or n_postings >= SHARD_POSTINGS:
                    yield shard()
                    held, n_postings = [], 0
        if held:
            yield shard()

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = read.mapInArrow(rows, POSTINGS.split(", ", 1)[1])
    return land(made.select(F.monotonically_increasing_id().alias("shard"), "*"), "postings")


def holders(postings: DataFrame) -> DataFrame:
    """(term, df): the documents that hold each term that may be asked."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8):
            for data in columns(batch, "terms")[0]:
                terms, n = np.unique(np.frombuffer(data, np.uint64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n, pa.int64())], ["term", "n"])

    return land(postings.select("terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("df")), "holders")


def owner_of(df: DataFrame, owners: int) -> list[int]:
    """Least numbers of holders, in powers of two, that begin each owner but the first: about equal postings each.

    The driver sees at most 64 sums.
    """
    sums = {r.power: r.n for r in df.groupBy(F.floor(F.log2("df")).cast("int").alias("power")).agg(F.sum("df").alias("n")).collect()}
    total, done, starts = sum(sums.values()), 0, []
    for power in sorted(sums):
        done += sums[power]
        while len(starts) < owners - 1 and done * owners >= total * (len(starts) + 1):
            starts.append(1 << (power + 1))
    return starts + [1 << 62] * (owners - 1 - len(starts))


# a wave of items


class Wave:
    """Terms and weights of a bounded number of items, by bundle and owner."""

    def __init__(self, asked: list, starts: list[int], n_docs: int):
        """``asked`` has rows (item, term, df)."""
        terms = sorted({(r.term, r.df) for r in asked})
        self.terms = np.array([t for t, _ in terms], dtype=np.int64).view(np.uint64)
        by_term = np.argsort(self.terms)
        self.terms = self.terms[by_term]
        df = np.array([d for _, d in terms], dtype=np.int64)[by_term]
        self.weights = np.array([weight(n_docs, int(d)) for d in df], dtype=np.int64)
        self.owner = np.searchsorted(np.array(starts, dtype=np.int64), df, side="right")
        self.items = sorted({r.item for r in asked})
        number = {x: i for i, x in enumerate(self.items)}
        slot = {int(t): i for i, t in enumerate(self.terms.view(np.int64))}
        of_item: list[list[int]] = [[] for _ in self.items]
        for r in asked:
            of_item[number[r.item]].append(slot[r.term])
        self.of_item = [np.array(sorted(x), dtype=np.int64) for x in of_item]

    @property
    def n_bundles(self) -> int:
        return -(-len(self.items) // BUNDLE_ITEMS)

    def members(self, bundle: int) -> range:
        return range(bundle * BUNDLE_ITEMS, min((bundle + 1) * BUNDLE_ITEMS, len(self.items)))


def waves(asked: DataFrame, most: int = WAVE_TERMS) -> Iterator[list]:
    """The (item, term, df) rows in parts of about ``most`` by a hash of the item; an item stays whole."""
    n_parts = max(1, -(-asked.count() // most))
    for part in range(n_parts):
        if rows := asked.where(F.pmod(F.xxhash64("item"), F.lit(n_parts)) == part).collect():
            yield rows


def owned_postings(postings: DataFrame, wave, n_docs: int, n_terms: int, owners: int) -> DataFrame:
    """The postings of each owner for each bundle and shard, with contributions that no longer depend on a term's rarity: landed by owner."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = wave.value
        for batch in slices(batches, 4):
            for shard, ids, lengths, terms, places, times in zip(*columns(batch, "shard", "ids", "lengths", "terms", "places", "times")):
                terms, places = np.frombuffer(terms, np.uint64), np.frombuffer(places, np.uint16)
                slot = np.searchsorted(of.terms, terms)
                known = (slot < len(of.terms)) & (of.terms[np.minimum(slot, len(of.terms) - 1)] == terms)
                slot, places = slot[known], places[known]
                damped = damping(np.array(lengths, dtype=np.int64), n_docs, n_terms)
                gains = of.weights[slot] * gain(np.frombuffer(times, np.int32)[known], damped[places])
                for owner in range(owners):
                    own = of.owner[slot] == owner
                    if not own.any():
                        continue
                    values = (slot[own].astype(np.int32).tobytes(), places[own].tobytes(), gains[own].tobytes())
                    for bundle in range(of.n_bundles):
                        row = (owner, bundle, shard, *values, ids)
                        types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], [c.split()[0] for c in OWNED.split(", ")])

    made = postings.select("shard", "ids", "lengths", "terms", "places", "times").mapInArrow(deal, OWNED)
    return land(made, "owned-postings", "owner")


def stage(wave, owner: int, top: int):
    """The cogroup of one bundle's accumulators over a shard with the owner's postings there."""

    def add(key: tuple, bundles: pa.Table, owned: pa.Table) -> pa.Table:
        of, (bundle, shard) = wave.value, (key[0].as_py(), key[1].as_py())
        carried = [np.empty(0, np.int32), np.empty(0, np.uint16), np.empty(0, np.int64)]
        if bundles.num_rows:
            carried = [np.frombuffer(bundles.column(c)[0].as_py(), t) for c, t in (("items", np.int32), ("places", np.uint16), ("scores", np.int64))]
        slots, places, gains = (np.empty(0, t) for t in (np.int32, np.uint16, np.int64))
        if owned.num_rows:
            slots, places, gains = (np.frombuffer(owned.column(c)[0].as_py(), t) for c, t in (("terms", np.int32), ("places", np.uint16), ("gains", np.int64)))
        held = np.zeros(SHARD_DOCS, dtype=np.int64)
        starts = np.searchsorted(carried[0], np.r_[of.members(bundle), of.members(bundle).stop])
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        for item, a, b in zip(of.members(bundle), starts, starts[1:]):
            held[:] = 0
            held[carried[1][a:b]] = carried[2][a:b]
            terms = of.of_item[item]
            mine = terms[of.owner[terms] == owner]
            for x, y in zip(np.searchsorted(slots, mine), np.searchsorted(slots, mine, side="right")):
                held[places[x:y]] += gains[x:y]  # a term names a document once
            at = np.flatnonzero(held)
            if len(at) > top:
                # the most that the owners to come can add to any document
                rest = int(of.weights[terms[of.owner[terms] > owner]].sum()) * (SCALE // 1000)
                at = at[held[at] + rest >= np.partition(held[at], len(at) - top)[len(at) - top]]
            if len(at):
                out.append((item, at.astype(np.uint16), held[at]))
        values = (bundle, shard, b"".join(np.full(len(at), i, np.int32).tobytes() for i, at, _ in out), b"".join(at.tobytes() for _, at, _ in out), b"".join(s.tobytes() for _, _, s in out))
        return pa.table({c.split()[0]: pa.array([v], t) for c, v, t in zip(BUNDLES.split(", "), values, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))})

    return add


def best_of_shards(bundles: DataFrame, postings: DataFrame, wave, top: int) -> DataFrame:
    """(item, doc_id, score): the ``top`` of each bundle's items in each shard."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = wave.value
        for batch in slices(batches, 16):
            for items, places, scores, ids in zip(*columns(batch, "items", "places", "scores", "ids")):
                items, places, scores = np.frombuffer(items, np.int32), np.frombuffer(places, np.uint16), np.frombuffer(scores, np.int64)
                order = np.lexsort((places, -scores, items))
                items, places, scores = items[order], places[order], scores[order]
                first = np.searchsorted(items, items)
                keep = (np.arange(len(items)) - first < top) & (scores > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([of.items[i] for i in items[keep]], pa.int64()), pa.array([ids[p] for p in places[keep]], pa.int64()), pa.array(scores[keep])], ["item", "doc_id", "score"]
                )

    named = bundles.join(postings.select(F.col("shard").alias("of"), "ids"), F.col("shard") == F.col("of")).select("items", "places", "scores", "ids")
    return named.mapInArrow(choose, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, owners: int = OWNERS, max_bits: int = MAX_BITS, wave_terms: int = WAVE_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0."""

    def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for batch in slices(batches):
            numbers, texts = columns(batch, "item", "text")
            found = [np.unique(word_hashes(terms_of(t), memo)) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(numbers, dtype=np.int64), [len(f) for f in found])), pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))], ["item", "term"])

    spark = docs.sparkSession
    asked = land(items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id"), F.col("text").cast("string").alias("text")), "items")
    pairs = land(asked.mapInArrow(item_terms, "item long, term long"), "item-terms")
    bits = sketch_bits(pairs.count(), 64, max_bits)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = CellCounts(bits, DEPTH, 1)
        for batch in batches:
            yield from counts.add(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        yield from counts.rows()

    wanted = merged_sketch(pairs.select("term").distinct().mapInArrow(cells, SKETCH), bits, DEPTH, 1)
    postings = build_postings(docs, wanted, bits)
    size = postings.agg(F.sum("n_held").alias("n_docs"), F.sum("n_terms").alias("n_terms")).first()
    n_docs, n_terms = size.n_docs or 0, size.n_terms or 0
    # only terms that some item has: the bitmap lets a few others through
    known = land(pairs.join(holders(postings), "term").select("item", "term", "df"), "asked-terms")
    starts = owner_of(known.select("term", "df").distinct(), owners)
    found = None
    for rows in waves(known, wave_terms):
        wave = spark.sparkContext.broadcast(Wave(rows, starts, n_docs))
        owned = owned_postings(postings, wave, n_docs, n_terms, owners)
        bundles = spark.createDataFrame([], BUNDLES)
        for owner in range(owners):
            here = owned.where(F.col("owner") == owner).groupBy("bundle", "shard")
            bundles = bundles.groupBy("bundle", "shard").cogroup(here).applyInArrow(stage(wave, owner, top), BUNDLES)
        best = best_of_shards(bundles, postings, wave, top)
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    named = ranked.join(asked.select(F.col("item").alias("of"), "item_id"), F.col("item") == F.col("of"))
    return named.select("item_id", "rank", "doc_id", "score")
