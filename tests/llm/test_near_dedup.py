"""Near-duplicate classes against brute force: copies, stars, links that miss a star's centre, odd input."""

import random

import numpy as np
import pytest

from sitefacts.llm import near_dedup
from tests.llm.odd import ascii_lower, no_documents, odd_documents, odd_texts, words_of


def brute(rows, percent=85):
    def shingles(t):
        w = words_of(ascii_lower(t))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in rows if i is not None}
    above = {i: i for i in sets}

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            both = len(a & b)
            if both and 100 * both >= percent * len(a | b) and top(i) != top(j):
                above[max(top(i), top(j))] = min(top(i), top(j))
    return {i: (len(sets[i]), top(i)) for i in ids}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_odd_input(spark):
    done = near_dedup.near_duplicates(odd_documents(spark))
    assert found(done) == brute(odd_texts())
    assert near_dedup.near_duplicates(no_documents(spark)).count() == 0


@pytest.mark.parametrize("block", [2048, 16])
def test_groups_without_a_common_centre(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(3)
    rows = []
    for group in range(3):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        for step in range(25):  # a chain: each differs a little from the one before, far ones do not link
            words = list(words)
            for _ in range(2):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
            rows.append((group * 100 + rng.sample(range(100), 100)[step], " ".join(words)))
    rows = list(dict(rows).items())
    rows += [(1000 + i, f"unrelated text number {i} " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(40))) for i in range(40)]
    assert found(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_component_labels_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r.node: r.label for r in near_dedup.component_labels(edges).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


@pytest.mark.parametrize("size", [30, 300, 3000, 60000])
def test_odd_sketch_estimates(size):
    rng = np.random.default_rng(5)
    for share in (0.8, 0.85, 0.9, 0.97):
        for _ in range(5):
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2))
            n = int(len(a) * (1 - share) / (1 + share))
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[n:]], rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)]))
            x, y = ((s, near_dedup.odd_sketch(near_dedup.mix(s)[np.argsort(near_dedup.mix(s))])) for s in (a, b))
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            odd, apart = (np.bitwise_count(near_dedup.bitmaps([x[1][i]]) ^ near_dedup.bitmaps([y[1][i]])).sum() for i in (1, 2))
            estimate, error = near_dedup.similarity(x[1][0], y[1][0], odd, apart, len(a), len(b), 0.85)
            assert abs(estimate - j) < near_dedup.ERRORS * error + 0.01 < (0.15 if size < 100 else 0.09)


def test_shared_signature_leaves_few_misses():
    assert (1 - 0.85**near_dedup.ROWS) ** near_dedup.BANDS < 1e-8


def test_bands_follow_the_threshold():
    assert near_dedup.bands_for(85) == near_dedup.BANDS and near_dedup.bands_for(80) == 47
    assert all((1 - (p / 100) ** near_dedup.ROWS) ** near_dedup.bands_for(p) < 1e-8 for p in (50, 80, 85, 95, 100))
