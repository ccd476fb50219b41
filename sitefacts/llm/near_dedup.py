"""Near-duplicate classes: MinHash bands find candidates, odd sketches verify them, full sets confirm them.

1. Every text becomes its set of 5-word shingles, a digest of the set, bands of 5 MinHash values, and
   an odd sketch of further MinHash samples: the least value in each of 2,048 bins of the hash space,
   folded into a parity bitmap, beside a bitmap of the bins that hold any. Texts of one set form a
   class, represented by its smallest doc_id; only representatives go on.
2. Star round: in each band bucket, members are paired with the smallest one. The XOR population counts
   of two sketches give the samples that differ, and so the similarity, within a few thousandths for
   texts of few hundred words; pairs that may reach the threshold, allowing five standard errors, are
   confirmed on their full sets and connected. A bucket of m members costs m pairs.
3. Cross round: only in buckets that still hold members of several components, members of different
   components are compared, in square blocks of at most BLOCK rows, and what may reach the threshold is
   confirmed. So no link is lost that shares a band, and no bucket is expanded into all its pairs.

At the threshold s itself, a pair shares no band with a probability of (1 - s^5)^bands. As many bands are
made as bring that below 1e-8: 32 at 0.85, 47 at 0.8.

Rules for odd input: fewer than five words are one shingle; a text without words has an empty set and
is linked with nothing; rows without a doc_id are left out of the result; rows of one doc_id count
once, and if their texts differ each of them may link it. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefacts.llm.common import BASE, MASK, SECOND_BASE, WordHash, columns, land, member_filter, mix, ngram_hashes, signed, slices, utf8, word_hashes

SHINGLE = 5
BANDS, ROWS, MAX_MISS = 32, 5, 1e-8
BINS, SKETCH_BITS = 2048, 2048
MIN_PERCENT = 85
ERRORS = 5.0
BLOCK = 2048


def shingle_set(text: bytes, memo: WordHash) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles (ASCII lower case)."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    values = word_hashes(words, memo)
    n = min(SHINGLE, len(words))
    found = mix(ngram_hashes(values, n, BASE) ^ np.uint64(n * SECOND_BASE & MASK))
    return np.unique(found)


def permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    """k odd multipliers and k addends, from a fixed rule."""
    n = np.arange(1, 2 * k + 1, dtype=np.uint64)
    x = (mix(n * np.uint64(BASE)) >> np.uint64(32)).astype(np.uint32)
    return x[:k] | np.uint32(1), x[k:]


def bands_for(min_percent: int) -> int:
    """Bands that leave a pair at the threshold without a common one in fewer than MAX_MISS of all cases; BANDS at least."""
    return max(BANDS, math.ceil(math.log(MAX_MISS) / math.log1p(-min(0.99, min_percent / 100) ** ROWS)))


def minhash(shingles: np.ndarray, multiply: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The least value of each permutation of 32-bit shingle hashes, in steps of bounded memory."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(add), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 1024):
        block = low[at : at + 1024]
        np.minimum(best, (multiply[:, None] * block[None, :] + add[:, None]).min(axis=1), out=best)
    return best


def odd_sketch(shingles: np.ndarray) -> tuple[int, bytes, bytes]:
    """(number of samples, parity bitmap, bitmap of occupied bins) of sorted shingle hashes.

    The first hash of a bin is its sample; each sample flips the one parity bit that its hash chooses.
    """
    bins, first = np.unique(shingles & np.uint64(BINS - 1), return_index=True)
    place = mix(shingles[first] ^ np.uint64(SECOND_BASE)) % np.uint64(SKETCH_BITS)
    parity = (np.bincount(place.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    occupied = np.zeros(BINS, dtype=np.uint8)
    occupied[bins.astype(np.int64)] = 1
    return len(bins), np.packbits(parity).tobytes(), np.packbits(occupied).tobytes()


def band_keys(samples: np.ndarray) -> np.ndarray:
    values = samples.reshape(-1, ROWS).astype(np.uint64)
    key = np.arange(1, len(values) + 1, dtype=np.uint64) * np.uint64(SECOND_BASE)
    for i in range(ROWS):
        key = mix(key * np.uint64(BASE) + values[:, i])
    return key


def similarity(m_a, m_b, parity_xor, occupied_xor, n_a, n_b, at: float):
    """(estimate, standard error near similarity ``at``) from two sketches' sizes and XOR population counts.

    With d differing samples, the odd bits x of b expect d = -b/2 * ln(1 - 2x/b). Equal samples are half
    of what the sizes leave, and the bins that either side occupies are known exactly. The error has a
    part from sampling, which goes to zero as the bins hold the whole set, and one from the parities.
    """
    b = SKETCH_BITS
    d = -b / 2 * np.log(np.maximum(1 - 2 * parity_xor / b, 1e-9))
    union = np.maximum((m_a + m_b + occupied_xor) / 2, 1)
    equal = np.clip((m_a + m_b - d) / 2, 0, None)
    whole = (n_a + n_b) / (1 + at)
    sampling = at * (1 - at) / union * np.clip(1 - union / np.maximum(whole, 1), 0, 1)
    load = np.minimum(4 * d / b, 20)
    parity = b / 4 * (1 - np.exp(-load) * (1 + load)) * np.exp(load) / (4 * union**2)
    return equal / union, np.sqrt(sampling + parity)


def may_link(a: tuple, b: tuple, min_percent: int) -> np.ndarray:
    """Whether sizes and sketches allow the threshold; a and b are (n, m, parity, occupied), arrays that broadcast."""
    odd = np.bitwise_count(a[2] ^ b[2]).sum(axis=-1, dtype=np.int64)
    apart = np.bitwise_count(a[3] ^ b[3]).sum(axis=-1, dtype=np.int64)
    estimate, error = similarity(a[1], b[1], odd, apart, a[0], b[0], min_percent / 100)
    fit = 100 * np.minimum(a[0], b[0]) >= min_percent * np.maximum(a[0], b[0])
    return fit & (estimate + ERRORS * error + 0.01 >= min_percent / 100)


def bitmaps(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=np.uint64).reshape(len(values), -1)


def document_sets(docs: DataFrame, n_bands: int = BANDS) -> DataFrame:
    """(doc, n, s1, s2, bands, m, parity, occupied) for each row with a doc_id; s1, s2 are the digest of its set."""
    multiply, add = permutations(n_bands * ROWS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        for batch in slices(batches):
            ids, texts = columns(batch, "doc_id", "text")
            n, digests, bands, sketches = [], [], [], []
            for text in texts:
                found = shingle_set(utf8(text), memo)
                n.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                bands.append(signed(band_keys(minhash(found, multiply, add))) if len(found) else np.empty(0, np.int64))
                sketches.append(odd_sketch(found))
            h = np.frombuffer(b"".join(digests), dtype=">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(bands, pa.list_(pa.int64())), *(pa.array([x[i] for x in sketches], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary())))],
                ["doc", "n", "s1", "s2", "bands", "m", "parity", "occupied"],
            )

    known = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return known.mapInArrow(rows, "doc long, n long, s1 long, s2 long, bands array<long>, m long, parity binary, occupied binary")


def estimated(pairs: DataFrame, classes: DataFrame, min_percent: int) -> DataFrame:
    """Of distinct pairs (a, b), those that may link by their sketches."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            side = lambda x: tuple(batch.column(f"{c}_{x}").to_numpy(zero_copy_only=False) for c in ("n", "m")) + tuple(bitmaps(columns(batch, f"{c}_{x}")[0]) for c in ("parity", "occupied"))
            keep = may_link(side("a"), side("b"), min_percent) if batch.num_rows else np.zeros(0, dtype=bool)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    of = lambda x: classes.select(F.col("doc").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "m", "parity", "occupied")])
    return pairs.join(of("b"), "b").join(of("a"), "a").mapInArrow(check, "a long, b long").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, min_percent: int) -> DataFrame:
    """Of pairs (a, b) of doc_ids, those whose full sets reach the threshold; ``texts`` holds (doc, text) of all of them."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHash()
        last, its_set = None, None
        for batch in slices(batches):
            a, b, text_a, text_b = columns(batch, "a", "b", "text_a", "text_b")
            keep = []
            for ta, tb in zip(text_a, text_b):
                if ta != last:  # rows come sorted by a, so a star's centre is cut once
                    last, its_set = ta, shingle_set(utf8(ta), memo)
                other = shingle_set(utf8(tb), memo)
                common = len(np.intersect1d(its_set, other, assume_unique=True))
                keep.append(100 * common >= min_percent * (len(its_set) + len(other) - common))
            keep = np.array(keep, dtype=bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)[keep]), pa.array(np.array(b, np.int64)[keep])], ["a", "b"])

    of = lambda side: texts.select(F.col("doc").alias(side), F.col("text").alias(f"text_{side}"))
    return pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long").distinct()


def texts_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc, text) of the documents that stand in a pair, landed; a bitmap of the ids keeps other texts out of the shuffle."""
    needed = land(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "pair-ids")
    own = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    return land(own.where(member_filter(needed)("doc")).join(needed, "doc", "left_semi").distinct(), "pair-texts")


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node reachable over edges (a, b).

    Each round takes the least label among the neighbours and then that label's own label, so paths
    shrink by more than half; a hub's messages are combined in the map tasks. Rounds are landed.
    """
    both = land(edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.*").distinct(), "links")
    labels = land(both.groupBy("node").agg(F.least(F.first("node"), F.min("other")).alias("label")), "labels")
    while True:
        said = both.join(labels, "node").select(F.col("other").alias("node"), "label")
        best = said.unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = best.join(above, "label", "left").select("node", F.least("label", "above").alias("new"))
        moved = land(jumped.join(labels, "node").select("node", F.col("new").alias("label"), (F.col("new") < F.col("label")).alias("moved")), "labels")
        labels = moved.select("node", "label")
        if moved.where("moved").isEmpty():
            return labels


def cross_pairs(members: DataFrame, min_percent: int) -> DataFrame:
    """Pairs of different components that share a bucket and may link; ``members`` holds (key, doc, comp) and the sketches.

    A bucket of m members is cut into ceil(m / BLOCK) parts, and each pair of parts is one group, so a
    group has 2 * BLOCK rows at most.
    """
    sized = members.join(members.groupBy("key").agg(F.count("*").alias("rows"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high"), "key")
    parts = F.ceil(F.col("rows") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc"), parts).cast("int")
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    held = ("key", "doc", "comp", "n", "m", "parity", "occupied")
    laid = sized.select(*held, own.alias("own"), other.alias("other")).select(*held, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(group: pa.Table) -> pa.Table:
        doc, comp, own, n, m = (group.column(c).to_numpy() for c in ("doc", "comp", "own", "n", "m"))
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        parity, occupied = (bitmaps(group.column(c).to_pylist()) for c in ("parity", "occupied"))
        found_a, found_b = [], []
        for x in range(len(doc)):
            fit = comp[x + 1 :] != comp[x]
            if i != j:
                fit &= own[x + 1 :] != own[x]
            at = np.flatnonzero(fit) + x + 1
            if len(at):
                at = at[may_link((n[x], m[x], parity[x], occupied[x]), (n[at], m[at], parity[at], occupied[at]), min_percent)]
                found_a.append(np.minimum(doc[at], doc[x]))
                found_b.append(np.maximum(doc[at], doc[x]))
        cat = lambda v: pa.array(np.concatenate(v) if v else np.empty(0, np.int64), pa.int64())
        return pa.table({"a": cat(found_a), "b": cat(found_b)})

    return laid.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, min_percent: int = MIN_PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per document with an id."""
    sets = land(document_sets(docs, bands_for(min_percent)), "sets")
    classes = land(sets.where("n > 0").groupBy("s1", "s2").agg(F.min("doc").alias("doc"), *[F.first(c).alias(c) for c in ("n", "bands", "m", "parity", "occupied")]), "classes")
    buckets = classes.select("doc", F.explode("bands").alias("key")).distinct()
    heads = buckets.groupBy("key").agg(F.min("doc").alias("head"), F.count("*").alias("m")).where("m > 1")
    shared = land(buckets.join(heads, "key").select("key", "doc", "head"), "buckets")
    stars = shared.where("doc > head").select(F.col("head").alias("a"), F.col("doc").alias("b")).distinct()
    stars = land(estimated(stars, classes, min_percent), "stars")
    edges = land(confirmed(stars, texts_of(docs, stars), min_percent), "edges")
    labels = component_labels(edges)

    comp = F.coalesce("label", "doc").alias("comp")
    members = shared.join(labels.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", comp)
    open_keys = members.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    open_members = members.join(open_keys, "key").join(classes.select("doc", "n", "m", "parity", "occupied"), "doc")
    crossed = land(cross_pairs(open_members, min_percent), "cross-pairs")
    if not crossed.isEmpty():
        more = confirmed(crossed, texts_of(docs, crossed), min_percent)
        labels = component_labels(land(edges.unionByName(more), "edges"))
    heads_of = classes.select("s1", "s2", "doc").join(labels.withColumnRenamed("node", "doc"), "doc", "left").select("s1", "s2", comp)
    joined = sets.select("doc", "n", "s1", "s2").join(heads_of, ["s1", "s2"], "left")
    done = joined.groupBy("doc").agg(F.max("n").alias("n_shingles"), F.least(F.min("comp"), F.first("doc")).alias("component_id"))
    return done.select(F.col("doc").alias("doc_id"), "n_shingles", "component_id", (F.col("doc") == F.col("component_id")).alias("kept"))
