"""Lexical search against brute force: odd input, several shards, bundles and waves."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitefacts.llm import lexical_search
from tests.llm.odd import EXTRA, ascii_lower, no_documents, odd_documents, odd_texts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(ascii_lower(text))


def brute(docs, items, top=10):
    """Of rows (doc_id, text) and (item_id, text): (item_id, rank, doc_id, score)."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(found, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def table(spark, rows, kind):
    return spark.createDataFrame(rows, kind)


def test_terms():
    text = "A-b_C9 é日本\x00x\x7fÉ~Z`q{r}[s]@t^ \n"
    assert [t.decode() for t in lexical_search.terms_of(text)] == terms(text)
    every = "".join(f"a{chr(c)}B" for c in range(0x250)) + " x\U0001f600y"
    assert [t.decode() for t in lexical_search.terms_of(every)] == terms(every)
    assert lexical_search.terms_of(None) == lexical_search.terms_of("") == []


def test_odd_rows(spark):
    rows = odd_texts()
    items = [(1, rows[0][1][:400]), (2, None), (3, ""), (4, "one two É"), (4, "one two É"), (None, "endoftext ONE"), (5, "..."), (6, rows[0][1]), (7, "nowhere-to-be-found"), (8, "日本語のテキスト" * 300)]
    bench = table(spark, items, "item_id long, text string").withColumns({c: F.lit(1) for c in ["item", "term", "doc_id", "score", "shard", "df"]})
    assert got(lexical_search.search(odd_documents(spark), bench)) == brute(rows, items)
    assert got(lexical_search.search(no_documents(spark), bench)) == []
    assert got(lexical_search.search(odd_documents(spark), bench.limit(0))) == []


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    heavy = [1 / (i + 1) for i in range(400)]
    docs = [(i, " ".join(["the"] * (i % 3 == 0) + rng.choices(vocabulary, heavy, k=rng.randint(1, 30)))) for i in range(9000)]
    items = [(i, " ".join(["the", *rng.choices(vocabulary, heavy, k=rng.randint(1, 12))])) for i in range(40)]
    return docs, items


def test_shards_bundles_and_waves(spark, corpus):
    docs, items = corpus
    want = brute(docs, items)
    text = "doc_id long, text string"
    one = table(spark, docs, text).coalesce(1)  # more documents than a shard holds
    assert got(lexical_search.search(one, table(spark, items, "item_id long, text string"))) == want
    many = table(spark, docs, text).repartition(9)
    assert got(lexical_search.search(many, table(spark, items, "item_id long, text string"), owners=7, wave_terms=60)) == want
    assert got(lexical_search.search(many, table(spark, items, "item_id long, text string"), top=3, owners=1)) == brute(docs, items, 3)


def test_more_items_than_a_bundle(spark):
    docs = [(i, f"common w{i % 50} x{i % 7}") for i in range(300)]
    items = [(i, f"common w{i % 60}") for i in range(lexical_search.BUNDLE_ITEMS + 20)]
    made = lexical_search.search(table(spark, docs, "doc_id long, text string"), table(spark, items, "item_id long, text string"))
    assert got(made) == brute(docs, items)


def test_integer_parts():
    lengths = np.array([0, 1, 5, 10**6])
    assert lexical_search.damping(lengths, 7, 3).tolist() == [10 + 90 * int(n) * 7 // 3 for n in lengths]
    assert lexical_search.gain(np.array([1, 3]), np.array([10, 999])).tolist() == [10**9 // 1080, 3 * 10**9 // (3000 + 8 * 999)]
    assert 0 == lexical_search.weight(10**9, 10**9) and lexical_search.gain(np.array([10**6]), np.array([10]))[0] <= lexical_search.SCALE // 1000
