"""The pipeline's stages on odd input, and its result against a brute-force version."""

import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sitefacts.llm import decontaminate, quality_rules
from sitefacts.llm.common import land, table
from tests.llm.odd import bare_numbers, no_documents, odd_documents, odd_texts
from tests.llm.test_line_and_substring import brute_lines
from tests.llm.test_near_dedup import brute

SF = "/root/testdata/sf0.001"


def test_stages_take_odd_rows(spark):
    docs = odd_documents(spark)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        assert stage(spark, no_documents(spark), SF).count() == 0, name
    whole = len(odd_texts())
    count = {name: stage(spark, docs, SF).count() for name, stage in corpus_pipeline.STAGES}
    assert count["line_dedup"] == count["decontaminate"] == count["bpe"] == whole
    # copies and near copies of 3 leave, repeated rows too; rows without an id stay
    groups = brute(odd_texts())
    assert count["near_dedup"] == sum(i == top for i, (_, top) in groups.items()) + sum(i is None for i, _ in odd_texts())


def test_run_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    kept = {r.row.doc_id for r in quality_rules.judge_quality(table(spark, SF, "documents")).where("kept").collect()}
    docs = {i: t for i, t in docs.items() if i in kept}
    docs = {i: t for i, _, _, t in brute_lines(list(docs.items()))}
    docs = {i: docs[i] for i, (_, top) in brute(list(docs.items()), 80).items() if i == top}
    items = [w for r in table(spark, SF, "benchmark").collect() if (w := bare_numbers(r.text))]
    docs = {i: t for i, t in docs.items() if not any(100 * decontaminate.covered(w, bare_numbers(t), 5) >= 80 * len(w) for w in items)}
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    want = {i: (t, library.encode(t, add_special_tokens=False).ids) for i, t in docs.items()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: (r.text, list(r.ids)) for r in got} == want and len(got) == len(want)
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_stages_chain_over_parquet(spark):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = land(stage(spark, docs, SF), f"odd-{name}")
    # the odd texts are far from any language, so few or none of them may be left
    assert docs.columns == ["doc_id", "n_tokens", "ids", "text"] and docs.count() <= len(odd_texts())


def test_near_dedup_stage_takes_pairs_from_80_percent(spark):
    rng, rows = random.Random(8), []
    for i in range(40):  # each edit inside a text of 104 words changes five of its 100 shingles
        words = [f"w{rng.randrange(10**6)}" for _ in range(104)]
        near, apart = list(words), list(words)
        for k in (20, 60):
            near[k] = f"n{rng.randrange(10**6)}"
        for k in (20, 50, 80):
            apart[k] = f"n{rng.randrange(10**6)}"
        rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join(near)), (1000 + i, " ".join(f"a{w}" for w in words)), (2000 + i, " ".join(f"a{w}" for w in apart))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    want = {i for i, (_, top) in brute(rows, 80).items() if i == top}
    assert kept == want and not any(10 * i + 1 in kept for i in range(40)) and {i for i, (_, top) in brute(rows, 85).items() if i == top} > want


def test_decontaminate_stage_judges_rows_without_an_id(spark):
    item = max((r.text for r in table(spark, SF, "benchmark").collect()), key=len)
    clean = [t for _, t in odd_texts() if t][:3]
    rows = [(None, item), (None, f"before {item} after"), (None, clean[0]), (None, clean[0]), (None, None), (7, clean[1]), (8, item), (9, item), (9, clean[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tag", F.lit(1))
    got = corpus_pipeline.decontaminate(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(None, clean[0]), (None, clean[0]), (None, None), (7, clean[1])], key=repr)
