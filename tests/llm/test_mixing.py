"""Mixing sources: targets and thresholds against a sorted brute force, odd input, nested budgets."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sitefacts.llm import mixing
from sitefacts.llm.common import land
from tests.llm.odd import EXTRA, no_documents, odd_documents, odd_texts, words_of

KIND = "doc_id long, source string, text string"


def brute(rows, weights=(1, 2, 3)):
    """Of rows (doc_id, source, text): (doc_id, size, source_size, target, copies, taken)."""
    size, held = Counter(), defaultdict(Counter)
    read = []
    for i, s, t in rows:
        h = int(hashlib.md5(f"{'-' if i is None else i}:{t or ''}".encode()).hexdigest()[:15], 16)
        n = len(words_of(t))
        read.append((i, s, n, h))
        size[s] += n
        held[s][h] += n
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    stopped = set()
    while True:  # reshare the excess until no target is above its stop
        free = [s for s in names if s not in stopped]
        level = (sum(size.values()) - sum(3 * size[s] for s in stopped)) / sum(weight[s] for s in free) if free else 0
        more = {s for s in free if weight[s] * level > 3 * size[s]}
        if not more:
            break
        stopped |= more
    target = {s: float(3 * size[s]) if s in stopped else weight[s] * level for s in names}
    copies = {}
    for s in names:
        rounds = min(3, int(target[s] // size[s])) if size[s] else 0
        budget, below, chosen = target[s] - rounds * size[s], 0, set()
        for h in sorted(held[s]):
            if abs(below + held[s][h] - budget) >= abs(below - budget) and below + held[s][h] > budget:
                break
            below += held[s][h]
            chosen.add(h)
        copies[s] = lambda h, rounds=rounds, chosen=chosen: rounds + (h in chosen)
    out = [(i, n, size[s], target[s], copies[s](h), n * copies[s](h)) for i, s, n, h in read]
    return out


def same(got, want):
    """Rows of no words may be counted as taken or not."""
    plain = lambda rows: sorted(((i, n, s, round(t, 6), taken) for i, n, s, t, _, taken in rows), key=repr)
    assert plain(got) == plain(want)


def columns(df):
    return [tuple(r) for r in df.select("doc_id", "size", "source_size", "target", "copies", "taken").collect()]


def test_odd_rows(spark):
    same(columns(mixing.mixed(odd_documents(spark))), brute([(i, None, t) for i, t in odd_texts()]))
    assert mixing.mixed(no_documents(spark)).collect() == []
    blank = spark.createDataFrame([(1, "a", None), (2, None, ""), (None, None, None)], KIND)
    assert {(r.size, r.target, r.taken) for r in mixing.mixed(blank).collect()} == {(0, 0.0, 0)}


def many_rows():
    rng = random.Random(3)
    rows = []
    for i in range(6000):
        source = "hot" if i % 3 == 0 else rng.choice([None, "", "a", "b", "é", "zz"])
        rows.append((i, source, "w " * rng.choice([1, 5, 30, 400])))
    rows += [(9000 + i, f"tiny{i}", "one two three") for i in range(5)]  # reach three times their size
    return rows + [(7, "same", "one one one")] * 50  # fully equal rows


@pytest.fixture(scope="module")
def rows():
    return many_rows()


def test_targets_and_takes(spark, rows):
    docs = spark.createDataFrame(rows, KIND).repartition(11)
    got = columns(mixing.mixed(docs))
    same(got, brute(rows))
    assert sorted(columns(mixing.mixed(docs.repartition(3))), key=repr) == sorted(got, key=repr)
    sums, stop = defaultdict(int), {}
    for _, n, s, t, copies, taken in got:
        assert 0 <= taken <= 3 * n
        sums[s, t] += taken
        stop[s, t] = s
    for (s, t), taken in sums.items():
        assert t <= 3 * s + 1e-6
        assert abs(taken - t) <= 400 or s == 150  # the equal rows go together
    assert abs(sum(t * n / s for _, n, s, t, *_ in got if s) - sum(n for _, n, *_ in got)) < 1  # all targets are all words


def test_nested_budgets(spark, rows):
    sized = land(spark.createDataFrame(rows, KIND).select("doc_id", *mixing.measured(F.col("doc_id"), F.col("source"), F.col("text"))), "sizes")
    total = {r.grp: r.n for r in sized.groupBy("grp").agg(F.sum("size").alias("n")).collect()}
    at = []
    for share in (0.0, 0.1, 0.11, 0.5, 0.999):
        budgets = spark.createDataFrame([(g, share * n) for g, n in total.items()], "grp string, budget double")
        at.append({r.grp: r.threshold for r in mixing.thresholds(sized, budgets).collect()})
        below = {r.grp: r.n or 0 for r in sized.join(spark.createDataFrame(list(at[-1].items()), "grp string, t long"), "grp").groupBy("grp").agg(F.sum(F.when(F.col("h") < F.col("t"), F.col("size"))).alias("n")).collect()}
        assert all(abs(below[g] - share * n) <= 200 for g, n in total.items() if g != "=same")
    assert all(a[g] <= b[g] for a, b in zip(at, at[1:]) for g in total)


def test_drawn_rows_and_shuffled_plan(spark, monkeypatch):
    docs = spark.createDataFrame(many_rows()[:500], KIND).withColumns({c: F.lit(1) for c in [*EXTRA, "grp", "size", "h", "copies", "rounds"]})
    want = {r.doc_id: r.copies for r in mixing.mixed(docs).collect() if r.copies}
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = mixing.drawn_rows(docs).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert Counter(r.row.doc_id for r in got) == want
    assert len({(r.row.doc_id, r["copy"]) for r in got}) == len(got) and got[0].row.asDict().keys() == set(docs.columns)
