"""Line and substring dedup against brute force, over odd input and keys that span partitions."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitefacts.llm import common, line_dedup, substring_dedup
from tests.llm.odd import ascii_lower, no_documents, odd_documents, odd_texts, words_of

BLANKS = " \t\n\r\x0b\x0c"


def brute_lines(rows, least=10):
    holder = {}
    key = lambda x: ascii_lower(x.strip(BLANKS))
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= least:
                holder[key(x)] = min(i, holder.get(key(x), i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or len(key(x)) < least or holder[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def test_lines(spark):
    done = line_dedup.drop_repeated_lines(odd_documents(spark))
    got = sorted(((r.row.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in done.collect()), key=repr)
    assert got == brute_lines(odd_texts())
    assert line_dedup.drop_repeated_lines(no_documents(spark)).count() == 0


def test_hot_line_over_many_partitions(spark):
    rows = [(i, f"the very same line\nown line number {i:06d}\nthe very same line") for i in range(3000)]
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        done = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
        assert {r.row.doc_id: r.n_dropped for r in done.collect()} == {i: 2 * (i > 0) for i, _ in rows}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@given(st.sets(st.integers(0, 300), min_size=1))
@settings(max_examples=50, deadline=None)
def test_bitmap_round_trip(dropped):
    n = max(dropped) + 5
    assert set(np.flatnonzero(~line_dedup.unpack_keep(line_dedup.pack_keep(sorted(dropped)), n))) == dropped


def brute_windows(rows, w=50):
    first = {}
    for i, t in rows:
        words = words_of(t)
        for k in range(len(words) - w + 1):
            if i is not None:
                key = tuple(words[k : k + w])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, t in rows:
        words, gone = words_of(t), set()
        for k in range(len(words) - w + 1):
            if i is not None and first[tuple(words[k : k + w])] < i:
                gone |= set(range(k, k + w))
        out.append((i, len(words), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(words) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("max_bits", [29, 16])
def test_windows(spark, max_bits):
    done = substring_dedup.remove_repeated_windows(odd_documents(spark), max_bits=max_bits)
    got = sorted(((r.row.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in done.collect()), key=repr)
    assert got == brute_windows(odd_texts())
    assert substring_dedup.remove_repeated_windows(no_documents(spark)).count() == 0


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 2**63, 60, dtype=np.uint64)
    a, b = (np.concatenate([rng.integers(0, 2**63, n, dtype=np.uint64), passage, rng.integers(0, 2**63, 20, dtype=np.uint64)]) for n in (5, 33))
    assert (substring_dedup.anchors(a, 50, 16)[5:16] == substring_dedup.anchors(b, 50, 16)[33:44]).all()


@given(st.lists(st.integers(0, 3), min_size=0, max_size=80), st.integers(1, 60))
@settings(max_examples=60, deadline=None)
def test_runs(values, n):
    x = np.array(values, dtype=np.uint64)
    got = common.ngram_hashes(x, n)
    runs = [tuple(values[i : i + n]) for i in range(len(values) - n + 1)]
    assert len(got) == len(runs) and len(set(got.tolist())) == len(set(runs))
    assert common.window_min(x, n).tolist() == [min(r) for r in runs]


def test_sketch_never_underestimates(spark):
    keys = np.arange(5000, dtype=np.uint64)
    once, twice = keys[:4000], keys[4000:]

    def rows(_):
        counts = common.CellCounts(16, 2, 2, flush=700)
        for part in (once[::2], once[1::2], twice, twice):
            yield from counts.add(part)
        yield from counts.rows()

    df = spark.range(1, numPartitions=1).mapInArrow(lambda it: rows(list(it)), common.SKETCH)
    bitmap = common.merged_sketch(df, 16, 2, 2).value
    assert common.in_sketch(bitmap, twice, 16, 2).all()
    assert common.in_sketch(bitmap, once, 16, 2).mean() < 0.2
