"""Merkle manifest of a dataset: trees per source in van Emde Boas blocks, proofs and their check.

A leaf is the SHA-256 of a row's fields. Per source the leaves, by ascending doc_id, are the ground of a
tree in which every FANOUT nodes have one parent; the sources' roots are the ground of one more tree.
Trees are stored as blocks: aligned subtrees of LEVELS levels, FANOUT ** LEVELS leaves at most. The nodes
of a block stand in van Emde Boas order: a tree is cut at half its height, the top is stored first, then
each subtree below it, all cut again in the same way, so that a walk from a leaf to the root stays within
few stretches of memory whatever their size. ``address`` turns a level and a place into the node's slot;
construction and sibling retrieval both go through it. The roots of the blocks are the leaves of the next
tier of blocks, until each tree has one.

Proofs come down the tiers: a block's path is the siblings above its root, and each of its leaves gets the
siblings inside the block, then that path.

Rules for odd input: a null field is written as ``-``; a null source is a source of its own, first in
order; rows without a doc_id stand first in theirs and are never tampered with. Rows of one doc_id are
leaves of their own, ordered by digest, so that repeated rows give the same rows in each run. An empty
text is a value of length 0. An empty table gives an empty result. Only the five named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefacts.llm.common import columns, land, places, runs, slices

FANOUT, LEVELS = 16, 3
BLOCK = FANOUT**LEVELS
DIGEST = 32
TAMPER_EVERY = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left:binary,right:binary>>"
PATH_TYPE = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))
BLOCKS = "grp string, block long, size long, n int, levels int, nodes binary, root binary"
PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


# one block


def tree_size(height: int) -> int:
    """Nodes of a full tree of ``height`` levels of nodes."""
    return (FANOUT**height - 1) // (FANOUT - 1)


def address(height: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Slots of the nodes ``index`` (from the left) at ``depth`` below the root, in a tree of ``height`` levels of nodes."""
    at = np.zeros_like(index)
    while height > 1:
        top = height // 2
        if depth < top:
            height = top
            continue
        height, depth = height - top, depth - top
        subtree, index = np.divmod(index, FANOUT**depth)
        at = at + tree_size(top) + subtree * tree_size(height)
    return at


def levels_over(n: int) -> int:
    """Levels of parents until one node remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def parent(hexed: bytes) -> bytes:
    return hashlib.sha256(hexed).digest()


class Block:
    """An aligned subtree: ``n`` leaves and ``levels`` levels of parents, its nodes in one array of slots."""

    def __init__(self, n: int, levels: int, nodes: np.ndarray):
        self.n, self.levels, self.nodes = n, levels, nodes
        self.held: dict[tuple[int, int], bytes] = {}

    def width(self, level: int) -> int:
        return -(-self.n // FANOUT**level)

    def slots(self, level: int, index: np.ndarray) -> np.ndarray:
        return address(self.levels + 1, self.levels - level, index)

    @classmethod
    def of(cls, leaves: np.ndarray, levels: int) -> Block:
        """Builds all parents; ``leaves`` has one digest per row. Slots beyond the last one in use are cut off."""
        block = cls(len(leaves), levels, np.zeros((0, DIGEST), dtype=np.uint8))
        last = max(int(block.slots(level, np.array([block.width(level) - 1]))[0]) for level in range(levels + 1))
        block.nodes = np.zeros((last + 1, DIGEST), dtype=np.uint8)
        block.nodes[block.slots(0, np.arange(block.n))] = leaves
        for level in range(levels):
            made = [parent(block.run(level, i)) for i in range(block.width(level + 1))]
            block.nodes[block.slots(level + 1, np.arange(len(made)))] = np.frombuffer(b"".join(made), np.uint8).reshape(-1, DIGEST)
        block.held.clear()
        return block

    @property
    def root(self) -> bytes:
        return self.nodes[0].tobytes()

    def run(self, level: int, number: int) -> bytes:
        """The digests of a run's nodes as hex text."""
        if (level, number) not in self.held:
            index = np.arange(number * FANOUT, min((number + 1) * FANOUT, self.width(level)))
            self.held[level, number] = self.nodes[self.slots(level, index)].tobytes().hex().encode()
        return self.held[level, number]

    def siblings(self, leaf: int, start: int = 0) -> list[tuple[bytes, bytes]]:
        """Hex text left and right of the leaf's ancestor, level by level from ``start`` on."""
        out = []
        for level in range(start, self.levels):
            number, place = divmod(leaf // FANOUT**level, FANOUT)
            hexed = self.run(level, number)
            out.append((hexed[: 2 * DIGEST * place], hexed[2 * DIGEST * (place + 1) :]))
        return out


# all blocks of many trees


@dataclass
class Forest:
    """Trees by group: the landed tiers of blocks, from the ground up."""

    tiers: list[DataFrame]

    def roots(self) -> DataFrame:
        """(grp, root): a tree's root is that of the only block of its top tier."""
        found = [t.where(F.col("size") <= BLOCK).select("grp", "root") for t in self.tiers]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out


def build_forest(ground: DataFrame, name: str) -> Forest:
    """Builds the trees over rows (grp, pos, size, digest), whose places run from 0 to size - 1 in each group."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (grp, number, size), rows in runs(batches, "grp", "block", "size"):
            leaves = np.frombuffer(b"".join(rows.column("digest").to_pylist()), np.uint8).reshape(-1, DIGEST)
            levels = LEVELS if size > BLOCK else levels_over(len(leaves))
            block = Block.of(leaves, levels)
            values = (grp, number, size, block.n, levels, block.nodes.tobytes(), block.root)
            types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], ["grp", "block", "size", "n", "levels", "nodes", "root"])

    tiers = []
    while True:
        dealt = ground.select("grp", F.floor(F.col("pos") / BLOCK).alias("block"), "size", "pos", "digest").repartition("grp", "block")
        tiers.append(land(dealt.sortWithinPartitions("grp", "block", "pos").mapInArrow(build, BLOCKS), name))
        above = tiers[-1].where(F.col("size") > BLOCK)
        if above.isEmpty():
            return Forest(tiers)
        ground = above.select("grp", F.col("block").alias("pos"), F.ceil(F.col("size") / BLOCK).alias("size"), F.col("root").alias("digest"))


def leaf_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of blocks with their own path, the path of each leaf: (grp, pos, path)."""
    for batch in slices(batches, 8):
        for grp, number, n, levels, nodes, path in zip(*columns(batch, "grp", "block", "n", "levels", "nodes", "path")):
            block = Block(n, levels, np.frombuffer(nodes, np.uint8).reshape(-1, DIGEST))
            found = [[{"left": a, "right": b} for a, b in block.siblings(i)] + path for i in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array([grp] * n, pa.string()), pa.array(range(number * BLOCK, number * BLOCK + n), pa.int64()), pa.array(found, PATH_TYPE)], ["grp", "pos", "path"])


def ground_blocks(forest: Forest, above: DataFrame) -> DataFrame:
    """The forest's lowest blocks with the path above each; ``above`` has (grp, path) of each tree's root."""
    lower = None
    for tier in reversed(forest.tiers):
        tops = tier.where(F.col("size") <= BLOCK).join(above, "grp")
        blocks = tops if lower is None else tops.unionByName(tier.where(F.col("size") > BLOCK).join(lower, ["grp", "block"]))
        if tier is not forest.tiers[0]:
            lower = blocks.mapInArrow(leaf_paths, f"grp string, pos long, path {PATH}").withColumnRenamed("pos", "block")
    return blocks


# the dataset


@dataclass
class Manifest:
    """``leaves`` (grp, pos, size, doc_id, digest, forged), the trees of the sources, and the tree over their roots."""

    leaves: DataFrame
    sources: Forest
    ranked: DataFrame
    whole: Forest
    root: bytes


def told(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(told(F.col("doc_id")), told(F.col("source")), told(F.col("lang")), told(F.col("n_chars")), told(text)), 256))


def build_manifest(docs: DataFrame) -> Manifest | None:
    """The manifest of a table of documents, or None if it has no rows. ``forged`` is the digest of a row after tampering."""
    text = F.col("text").cast("string")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0
    grp = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # null before the empty name
    read = docs.select(grp.alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), row_digest(text).alias("digest"), F.when(chosen, row_digest(F.translate(text, UPPER, LOWER))).alias("forged"))
    leaves = land(places(land(read, "leaves"), "grp", ["doc_id", "digest"], "ordered-leaves"), "placed-leaves")
    sources = build_forest(leaves, "source-blocks")
    ranked = land(places(land(sources.roots().select(F.lit("").alias("all"), F.col("grp").alias("source"), F.col("root").alias("digest")), "subroots"), "all", ["source"], "ordered-subroots"), "ranked")
    whole = build_forest(ranked.withColumnRenamed("all", "grp"), "whole-blocks")
    top = whole.roots().first()
    return Manifest(leaves, sources, ranked, whole, bytes(top["root"])) if top else None


def proofs(manifest: Manifest) -> DataFrame:
    """Each leaf's proof, and the root folded from its tampered (else own) digest and the original siblings."""
    spark = manifest.leaves.sparkSession
    of_root = spark.range(1).select(F.lit("").alias("grp"), F.expr(f"cast(array() as {PATH})").alias("path"))
    of_sources = ground_blocks(manifest.whole, of_root).mapInArrow(leaf_paths, f"grp string, pos long, path {PATH}")
    above = of_sources.join(manifest.ranked, "pos").select(F.col("source").alias("grp"), "path", F.col("digest").alias("subroot"))
    blocks = land(ground_blocks(manifest.sources, above.drop("subroot")).join(above.select("grp", "subroot"), "grp"), "blocks-with-paths")
    none = lambda t: F.lit(None).cast(t)
    stored = blocks.select("grp", "block", F.lit(-1).cast("long").alias("pos"), none("long").alias("doc_id"), none("binary").alias("digest"), none("binary").alias("forged"), "n", "levels", "nodes", "path", "subroot")
    asked = manifest.leaves.select("grp", F.floor(F.col("pos") / BLOCK).alias("block"), "pos", "doc_id", "digest", "forged", none("int").alias("n"), none("int").alias("levels"), none("binary").alias("nodes"), none(PATH).alias("path"), none("binary").alias("subroot"))
    root = manifest.root

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, path, upper, subroot, run, tail, tail_bytes = None, [], b"", "", -1, [], b""
        for batch in slices(batches, 2048):
            out = {c.split()[0]: [] for c in PROOF.split(", ")}
            for pos, doc_id, digest, forged, n, levels, nodes, above_, sub in zip(*columns(batch, "pos", "doc_id", "digest", "forged", "n", "levels", "nodes", "path", "subroot")):
                if pos < 0:
                    block, path, subroot, run = Block(n, levels, np.frombuffer(nodes, np.uint8).reshape(-1, DIGEST)), [(x["left"], x["right"]) for x in above_], sub.hex(), -1
                    upper = b"".join(a + b for a, b in path)
                    continue
                place = pos % BLOCK
                if place // FANOUT != run:  # what a run's leaves have in common
                    run, tail = place // FANOUT, block.siblings(place, 1)
                    tail_bytes = b"".join(a + b for a, b in tail) + upper
                steps = [*(block.siblings(place)[:1] if block.levels else ()), *tail, *path]
                first = b"".join(steps[0]) if block.levels else b""
                node = (forged or digest).hex().encode()
                for left, right in steps:
                    node = parent(left + node + right).hex().encode()
                folded = node.decode()
                values = (doc_id, digest.hex(), subroot, root.hex(), hashlib.sha256(first + tail_bytes).hexdigest(), folded, folded == root.hex())
                for held, value in zip(out.values(), values):
                    held.append(value)
            types = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array(out[c.split()[0]], types[c.split()[1]]) for c in PROOF.split(", ")], list(out))

    both = stored.unionByName(asked).repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")
    return both.mapInArrow(prove, PROOF)


def dataset_proofs(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of ``docs``."""
    manifest = build_manifest(docs)
    return proofs(manifest) if manifest else docs.sparkSession.createDataFrame([], PROOF)
