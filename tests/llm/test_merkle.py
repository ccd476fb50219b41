"""The Merkle manifest against a plain tree: slots, odd input, trees of more than one block."""

import hashlib
import zlib

import numpy as np
import pytest

from sitefacts.llm import merkle
from tests.llm.odd import ascii_lower, no_documents, odd_documents, odd_texts


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def path_of(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = i // 16 * 16
        out.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 16])))
        i //= 16
    return out


def brute(rows):
    """Of rows (doc_id, source, lang, n_chars, text), the proofs in any order."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, brute_leaf(row), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([x[2] for x in sorted(groups[s])]) for s in names}
    whole = levels_of([trees[s][-1][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for i, (_, _, leaf, row) in enumerate(sorted(groups[s])):
            steps = path_of(trees[s], i) + path_of(whole, at)
            node = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                node = brute_leaf((*row[:4], None if row[4] is None else ascii_lower(row[4])))
            for a, b in steps:
                node = sha(a, node, b)
            out.append((row[0], leaf, trees[s][-1][0], whole[-1][0], sha(*(a + b for a, b in steps)), node, node == whole[-1][0]))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select(*[c.split()[0] for c in merkle.PROOF.split(", ")]).collect()), key=repr)


@pytest.mark.parametrize("height", range(1, 5))
def test_slots(height):
    """Every slot is taken once; a parent stands before its children; each half-height subtree is one stretch."""
    slots = [merkle.address(height, d, np.arange(merkle.FANOUT**d)) for d in range(height)]
    assert sorted(np.concatenate(slots)) == list(range(merkle.tree_size(height)))
    for d in range(1, height):
        assert (slots[d - 1].repeat(merkle.FANOUT) < slots[d]).all()
    if height > 1:
        top = height // 2
        below = [np.concatenate([slots[d].reshape(merkle.FANOUT**top, -1)[i] for d in range(top, height)]) for i in range(merkle.FANOUT**top)]
        assert all(max(x) - min(x) + 1 == merkle.tree_size(height - top) for x in below)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 256, 257, 4095, 4096])
def test_block(n):
    leaves = np.frombuffer(b"".join(hashlib.sha256(b"%d" % i).digest() for i in range(n)), np.uint8).reshape(-1, 32)
    block = merkle.Block.of(leaves, merkle.levels_over(n))
    plain = levels_of([x.tobytes().hex() for x in leaves])
    assert block.root.hex() == plain[-1][0]
    for i in {0, n // 2, n - 1}:
        assert [(a.decode(), b.decode()) for a, b in block.siblings(i)] == path_of(plain, i)
    assert len(block.nodes) <= max(2 * n + 300, 1)


def test_odd_rows(spark):
    rows = [(i, None, "en" if (i or 0) % 2 else None, len(t or ""), t) for i, t in odd_texts()]
    assert got(merkle.dataset_proofs(odd_documents(spark))) == brute(rows)
    assert merkle.dataset_proofs(no_documents(spark)).collect() == []


def test_more_than_one_block_and_tier(spark):
    rows = [(i, "hot", None, None, f"Text {i}") for i in range(4100)] + [(7, "hot", None, None, "Text 7")]
    rows += [(i, f"s{i:03}", "en", i, "Ab") for i in range(5000, 5040)] + [(1, "", "en", 1, ""), (2, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(13)
    found = got(merkle.dataset_proofs(docs))
    assert found == brute(rows)
    assert {r[0] for r in found if not r[-1]} == {r[0] for r in rows if r[4] and r[4] != r[4].lower() and zlib.crc32(str(r[0]).encode()) % 5 == 0}


def test_one_row(spark):
    assert got(merkle.dataset_proofs(spark.createDataFrame([(5, "a", "en", 1, "x")], "doc_id long, source string, lang string, n_chars long, text string"))) == brute([(5, "a", "en", 1, "x")])
