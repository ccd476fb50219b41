"""Quality rules, decontamination, URL trust and the PU classifier against brute force and held-out labels."""

import random
import zlib
from collections import Counter
from functools import partial

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitefacts.llm import decontaminate, pu_classifier, quality_rules, queries, url_trust
from tests.llm.odd import bare_numbers, no_documents, odd_documents, odd_texts, sentences, words_of

SF = "/root/testdata/sf0.01"


def brute_base(text):
    words = words_of(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    under = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(under) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(under), failed


def test_base_counts(spark):
    done = quality_rules.judge_quality(odd_documents(spark)).collect()
    got = sorted(((r.row.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in done), key=repr)
    assert got == sorted(((i, *brute_base(t)) for i, t in odd_texts()), key=repr)
    assert all(not (r.base_failed and r.kept) for r in done)
    assert quality_rules.judge_quality(no_documents(spark)).count() == 0


@given(st.lists(st.sampled_from(["a", "b", "c"]), max_size=60))
@settings(max_examples=100, deadline=None)
def test_repeats(words):
    assert quality_rules.repeat_words([w.encode() for w in words]) == brute_base(" ".join(words))[4]


def test_distance():
    p, q = np.array([3, 1, 0]), np.array([0.25, 0.25, 0.5])
    m = (p / 4 + q) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m) if x)
    assert quality_rules.js_distance(p, q) == pytest.approx(np.sqrt((kl(p / 4) + kl(q)) / 2))
    assert quality_rules.js_distance(np.array([5, 0]), np.array([0.0, 1.0])) == pytest.approx(1.0)
    assert quality_rules.js_distance(np.array([2, 2]), np.array([0.5, 0.5])) == 0.0


def test_references_count_all_documents(spark):
    body = " ".join(f"w{i}" for i in range(20)) + " Ab, ab x1."
    docs = spark.createDataFrame([(i, f"{body} n{i // 2}" if i % 3 else "zz", "aa" if i % 3 else "bb") for i in range(9)] + [(20, body, None)], "doc_id long, text string, lang string")
    said = quality_rules.language_references(docs.repartition(4), common_words=1, min_documents=4)
    assert set(said) == {"aa"} and (said["aa"]["words"], said["aa"]["counts"], said["aa"]["total"]) == (["ab"], [12], 6 * 24)
    digits = sum(c.isdigit() for i in range(9) if i % 3 for c in f"{body} n{i // 2}")
    assert said["aa"]["classes"][quality_rules.CLASSES.index("digit")] == digits
    # six rows, but five texts
    assert quality_rules.language_references(docs, min_documents=6) == {}


def texts_of(rng, prefix, n):
    words = [prefix + "".join(rng.choice("aeioubcdlmn") for _ in range(5)) for _ in range(40)]
    return [" ".join(rng.choice(words) for _ in range(120 + i)) for i in range(n)]


@pytest.mark.parametrize("at_once", [quality_rules.LANGUAGES_AT_ONCE, 20])
def test_every_language_with_enough_texts_has_a_reference(spark, monkeypatch, at_once):
    monkeypatch.setattr(quality_rules.reference_parts, "__defaults__", (quality_rules.COMMON_WORDS, at_once, quality_rules.MIN_DOCUMENTS))
    rng, rows = random.Random(6), []
    for i in range(70):
        rows += [(f"l{i:02}", t) for t in texts_of(rng, f"{chr(97 + i % 26)}{chr(97 + i // 26)}", quality_rules.MIN_DOCUMENTS)]
    few = [("small", t) for t in texts_of(rng, "zzz", quality_rules.MIN_DOCUMENTS - 1)] * 3
    done = quality_rules.judge_quality(spark.createDataFrame(rows + few, "lang string, text string")).collect()
    assert len(done) == len(rows) + len(few)
    assert all(r.kept and r.nearest == r.row.lang for r in done if r.row.lang != "small")
    assert not any(r.kept for r in done if r.row.lang == "small")  # repeated rows are no further texts


def brute_distances(references, lang, text, base_failed):
    """(word distance, class distance, language) of the nearest reference, without the text's own counts."""
    words, kinds, found = quality_rules.bare(text), quality_rules.class_counts(b" ".join(text)), []
    for name, r in references.items():
        own = name == lang and not base_failed
        mine = np.array([words.count(w.encode()) for w in r["words"]])
        theirs, total = np.array(r["counts"]) - mine * own, r["total"] - len(words) * own
        classes = np.array(r["classes"]) - kinds * own
        found.append((
            quality_rules.js_distance(np.array([*mine, len(words) - mine.sum()]), np.array([*theirs, total - theirs.sum()]) / total),
            quality_rules.js_distance(kinds, classes / classes.sum()), name,
        ))
    return min(found)


def test_judge_equals_distances_one_by_one():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    references = {}
    for lang in "abcde":
        counts = [rng.randint(400, 900) for _ in range(rng.randint(2, 12))]
        references[lang] = {"classes": [rng.randint(5000, 9000) for _ in quality_rules.CLASSES], "words": rng.sample(words, len(counts)), "counts": counts, "total": sum(counts) + rng.randint(500, 2000)}
    judge = quality_rules.Judge(references)
    for n in (1, 3, 50, 400):
        for lang in ("b", "elsewhere", None):
            text = [rng.choice(words[: n + 3]).encode() for _ in range(n)]
            got = judge.distances(b" ".join(text), text, 0, 1, lang)
            want = brute_distances(references, lang, text, False)
            assert (got["word_distance"], got["class_distance"], got["nearest"]) == (pytest.approx(want[0]), pytest.approx(want[1]), want[2])


def kept_junk(spark, docs):
    """Share of documents of label 0 that pass the base rule and are kept."""
    bad = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").select("doc_id")
    done = quality_rules.judge_quality(docs).where("NOT base_failed").select("row.doc_id", "row.lang", "kept")
    return done.join(bad, "doc_id").collect()


def test_junk_can_not_speak_for_itself(spark):
    """Neither one copy of a rejected text under a name of its own nor twenty of them change a verdict."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    before = {r.doc_id: r.kept for r in kept_junk(spark, docs)}
    gone = sorted(i for i, kept in before.items() if not kept)
    assert len(gone) >= 20 and sum(before.values()) <= 0.1 * len(before)
    copy = docs.unionByName(docs.where(F.col("doc_id") == gone[0]).withColumn("lang", F.lit("zz")))
    assert {(r.doc_id, r.kept) for r in kept_junk(spark, copy)} == set(before.items())
    named = docs.withColumn("lang", F.when(F.col("doc_id").isin(gone[:20]), F.concat(F.lit("z"), F.col("doc_id"))).otherwise(F.col("lang")))
    after = {r.doc_id: r.kept for r in kept_junk(spark, named)}
    assert not any(after[i] for i in gone[:20]) and sum(after.values()) <= sum(before.values()) + 1


def test_verdicts_equal_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    held = {}
    for r in rows:
        words = (r.text or "").encode().split()
        if r.lang is not None and not brute_base(r.text)[5]:
            held.setdefault(r.lang, []).append((r.text, words))
    references = {}
    for lang, texts in held.items():
        if len({t for t, _ in texts}) >= quality_rules.MIN_DOCUMENTS:
            counts = Counter(w for _, words in texts for w in quality_rules.bare(words))
            top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: quality_rules.COMMON_WORDS]
            references[lang] = {"classes": sum(quality_rules.class_counts(t.encode()) for t, _ in texts), "words": [w.decode() for w, _ in top], "counts": [n for _, n in top], "total": sum(counts.values())}
    got = {r.row.doc_id: r for r in quality_rules.judge_quality(spark.createDataFrame(rows)).collect()}
    for r in rows:
        text, failed = (r.text or "").encode(), brute_base(r.text)[5]
        words = text.split()
        kept = not failed
        if kept:
            found = []
            for lang, ref in references.items():
                own, bare = lang == r.lang, quality_rules.bare(words)
                mine = np.array([bare.count(w.encode()) for w in ref["words"]])
                theirs, total = np.array(ref["counts"]) - mine * own, ref["total"] - len(words) * own
                kinds = quality_rules.class_counts(text)
                classes = ref["classes"] - kinds * own
                by_word = quality_rules.js_distance(np.array([*mine, len(words) - mine.sum()]), np.array([*theirs, total - theirs.sum()]) / total) if len(words) >= 40 else 0.0
                by_class = quality_rules.js_distance(kinds, classes / classes.sum()) if kinds.sum() >= 250 else 0.0
                found.append((by_word or by_class, by_word, by_class))
            kept = min(found)[1] <= quality_rules.MAX_WORD_DISTANCE and min(found)[2] <= quality_rules.MAX_CLASS_DISTANCE
        assert got[r.doc_id].kept == kept, r.doc_id


def test_verdicts_follow_labels(spark):
    kept = queries.op4_quality_rules(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("NOT base_failed")
    share = {r.quality: r.share for r in kept.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share[1] >= 0.99 and share[0] <= 0.2


def brute_tiles(item, doc, least):
    """The textbook form: in each round scan all pairs for the longest unmarked match."""
    a, b, out = [True] * len(item), [True] * len(doc), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and a[i + n] and b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return sum(x[0] for x in out)
        out.append(best)
        n, i, j = best
        a[i : i + n] = [False] * n
        b[j : j + n] = [False] * n


@given(st.lists(st.integers(0, 3), max_size=24), st.lists(st.integers(0, 3), max_size=40), st.integers(1, 4))
@settings(max_examples=200, deadline=None)
def test_tiles(item, doc, least):
    found = decontaminate.tiles(item, doc, least)
    for n, i, d in found:
        assert item[i : i + n] == doc[d : d + n] and n >= least
    for side, x in ((1, len(item)), (2, len(doc))):
        places = [p for t in found for p in range(t[side], t[side] + t[0])]
        assert len(places) == len(set(places)) and all(p < x for p in places)
    assert sum(t[0] for t in found) == brute_tiles(item, doc, least)


@given(st.lists(st.integers(0, 2**64 - 1), max_size=30), st.integers(1, 8))
@settings(max_examples=60, deadline=None)
def test_running_hashes(values, n):
    got = decontaminate.running_hashes(values, n)
    assert got == [h for i in range(len(values) - n + 1) for h in decontaminate.running_hashes(values[i : i + n], n)]


def benchmark_rows():
    rng = random.Random(11)
    items = [(i, " ".join(sentences(rng, rng.randint(1, 4)))) for i in range(12)]
    return items + [(20, "just four words here"), (21, ""), (22, None), (23, items[0][1]), (None, "item without an id at all")]


def test_decontamination(spark):
    rng, items = random.Random(12), benchmark_rows()
    filler = lambda: " ".join(sentences(rng, 5))
    docs = odd_texts()
    for k in range(12):
        words = items[k][1].split()
        third = len(words) // 3
        moved = words[2 * third :] + "x y z".split() + words[:third] + "q r".split() + words[third : 2 * third]
        docs += [(100 + k, f"{filler()} {items[k][1].upper()} {filler()}"), (200 + k, f"{filler()} {' '.join(moved)}"), (300 + k, f"{filler()} {' '.join(words[: len(words) // 2])}"), (400 + k, filler())]
    docs += [(500, "text with just four words, here."), (501, "just four other words here"), (502, "an Item without an id at all!"), (None, items[1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("tag", "hit", "words", "seeds", "parts", "item_id")})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("doc_id", "words", "n_words")})
    got = {(r.doc_id, r.item_id, r.n_words, r.n_covered) for r in decontaminate.benchmark_hits(df, bench).collect()}
    want = set()
    for i, text in items:
        item = bare_numbers(text)
        for d, t in docs:
            n = decontaminate.covered(item, bare_numbers(t), 5) if item and d is not None else 0
            if item and 100 * n >= 80 * len(item):
                want.add((d, i, len(item), n))
    assert got == want
    flagged = {d for d, *_ in got}
    assert {100 + k for k in range(12)} | {500} <= flagged and not any(400 <= d < 412 or d == 501 for d in flagged)
    # thirds of six words or more are found in any order
    assert {200 + k for k in range(12) if len(items[k][1].split()) >= 18} <= flagged
    assert decontaminate.benchmark_hits(no_documents(spark), bench).count() == 0
    assert decontaminate.benchmark_hits(df, bench.limit(0)).count() == 0


def test_a_common_phrase_makes_no_pairs(spark):
    rng, phrase = random.Random(13), "all rights reserved by the owner of this page and its friends"
    items = [(i, f"{' '.join(sentences(rng, 6))} {phrase} {' '.join(sentences(rng, 6))}") for i in range(40)] + [(100, phrase), (None, phrase + " too")]
    docs = [(i, f"{' '.join(sentences(rng, 4))} {phrase}") for i in range(300)] + [(1000 + i, f"{phrase} {' '.join(sentences(rng, 2))} {items[i][1]} {phrase}") for i in range(10)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    seeds = []
    rare, land = decontaminate.rare_seeds, decontaminate.land
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(decontaminate, "rare_seeds", lambda *a: seeds.append(rare(*a)) or seeds[-1])
        patch.setattr(decontaminate, "land", lambda d, name: held.append(land(d, name)) or held[-1] if name == "seed-places" else land(d, name))
        held = []
        got = {(r.doc_id, r.item_id, r.n_words, r.n_covered) for r in decontaminate.benchmark_hits(df, bench).collect()}
    want = set()
    for i, text in items:
        item = bare_numbers(text)
        for d, t in docs:
            n = decontaminate.covered(item, bare_numbers(t), 5)
            if 100 * n >= 80 * len(item):
                want.add((d, i, len(item), n))
    assert got == want and len(got) >= 10 + len(docs)
    # before, each of these texts met each of the 40 items at every seed of the phrase
    met = held[0].select("doc_id", F.explode("hits").alias("hit")).join(seeds[0].where("item_id < 100"), "hit").where("doc_id < 1000")
    assert met.select("doc_id", "item_id").distinct().count() < len(docs)


def brute_rank(seeds, links, rounds, damping=0.85):
    out = Counter()
    for s, _, n in links:
        out[s] += n
    rank = dict(seeds)
    for _ in range(rounds):
        new = Counter({h: (1 - damping) * x for h, x in seeds.items()})
        for s, d, n in links:
            if s in rank:
                new[d] += damping * rank[s] * n / out[s]
        rank = dict(new)
    return rank


def test_page_rank(spark):
    rng = random.Random(4)
    links = list({(f"h{rng.randrange(12)}", f"h{rng.randrange(12)}"): 0 for _ in range(40)})
    links = [(s, d, rng.randint(1, 9)) for s, d in links if s != d]
    seeds = {"h0": 0.5, "h3": 0.25, "lonely": 0.25}
    got = url_trust.spread(spark.createDataFrame(list(seeds.items()), "host string, share double"), spark.createDataFrame(links, "src string, dst string, n long"), rounds=6)
    want = brute_rank(seeds, links, 6)
    assert {r.host: r.rank for r in got.collect()} == {h: pytest.approx(x) for h, x in want.items()}


def test_distrust_reaches_along_a_chain(spark):
    n = 25  # hosts that link on to the blocked one; the farthest is more than 20 hops away
    rows = [(i, f"http://h{i}.io/", f"<a href='http://h{i + 1}.io/'>" if i + 1 < n else "<a href='http://bad.net/'>") for i in range(n)] + [(100 + i, f"http://alone{i}.io/", "") for i in range(300)]
    done = {r.host: (r.distrust, r.blocked) for r in url_trust.host_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(n):
        assert done[f"h{i}.io"] == (pytest.approx(0.15 * 0.85 ** (n - i)), True)


def test_url_verdicts(spark):
    link = lambda *hosts: "".join(f'<p><A class=x HREF = "https://{h}/p?q">t</a>' for h in hosts)
    rows = [
        (1, "http://Spam.NET/x", "<a href='/own'>"), (2, "http://a.net/en/x", None), (3, "https://www.example.net/en/x?y", ""), (4, "https://www.example.net/de/x", ""), (5, "http://example.com/de/1#t", ""),
        (6, "http://farm.io/1", link("spam.net", "b.net") + link("spam.net")), (7, "http://good.io/1", link("farm.io")), (8, "http://x.org/fr/a", link("good.io", "x.org")), (9, None, link("spam.net")), (10, "no scheme", ""),
        (11, "http://", ""), (12, "http://nett.com/", ""), (13, "http://plain.io?x=://y", '<a href="//farm.io/z">'), (1, "http://Spam.NET/x", ""), (None, "http://spam.net", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "path", "rule", "verdict", "trust", "n")})
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_trust.judge_urls(pages).collect()]
    assert len(got) == len(rows)
    own = {r[0]: r[1:] for r in got}
    assert own[1] == ("spam.net", "/x", "net/", "block") and own[2] == ("a.net", "/en/x", "net/", "block")
    assert own[3] == ("www.example.net", "/en/x", "example.net/en/", "allow") and own[4][2:] == ("net/", "block")
    assert own[5] == ("example.com", "/de/1", "example.com/de/", "block") and own[8][2:] == ("org/fr/", "allow")
    assert own[6][2:] == (None, "block") and own[7][2:] == (None, "allow") and own[13] == ("plain.io", "", None, own[13][3])
    assert own[9][:2] == own[10][:2] == own[11][:2] == ("", "") and own[12] == ("nett.com", "/", None, "allow")
    assert own[None] == ("spam.net", "", None, "block")
    assert url_trust.judge_urls(pages.limit(0)).count() == 0


def test_pages_against_sql(spark):
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in queries.op7_url_trust(spark, SF).where("rule IS NOT NULL").collect()}
    want = duckdb.sql(rf"""
        WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM '{SF}/pages.parquet'),
        p AS (SELECT page_id, lower(regexp_extract(rest, '^([^/?#]*)', 1)) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        r(rule, dom, pre, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow'))
        SELECT page_id, host, path, rule, verdict FROM p JOIN r ON (host = dom OR ends_with(host, '.' || dom)) AND starts_with(path, pre)
        QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) = 1""").fetchall()
    assert got == set(want)


def test_classifier_on_held_out_labels(spark):
    done = queries.op9_pu_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    held = done[done.held_out & done.quality.notna()]
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == h for i, h in zip(done.doc_id, done.held_out))
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    assert np.mean([(g > bad).mean() for g in good]) > 0.95
    assert (held.predicted == held.quality).mean() > 0.8 and done.score.between(0, 1).all()


def test_classifier_on_odd_input(spark):
    labels = spark.createDataFrame([(3, 1), (3, 0), (10, 1), (999, 1), (None, 1), (11, None), (30, 1), (36, 0)], "doc_id long, quality int")
    done = pu_classifier.score_quality(odd_documents(spark), labels).collect()
    assert len(done) == len(odd_texts()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in done)
    assert len({r.score for r in done if r.doc_id == 3}) == 1
    assert all(r.score == 0.5 for r in pu_classifier.score_quality(odd_documents(spark), labels.limit(0)).collect())
    assert pu_classifier.score_quality(no_documents(spark), labels).count() == 0


def made_rows():
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(1.5, 1, (4000, 3)), rng.normal(-1.5, 1, (2000, 3))])
    return x, np.arange(6000) < 1500  # some of the good ones are known


def test_prior_and_risk():
    x, positive = made_rows()
    total = pu_classifier.row_total(x, positive)
    model = pu_classifier.fit(total, 4000 / 6000)
    assert (model.margin(x[:4000]) > 0).mean() > 0.95 and (model.margin(x[4000:]) < 0).mean() > 0.95
    first = pu_classifier.fit(total, None)
    bins = lambda rows: np.bincount(np.minimum((pu_classifier.sigmoid(first.margin(rows)) * 100).astype(int), 99), minlength=100)
    assert pu_classifier.class_prior(bins(x), bins(x[positive])) == pytest.approx(4000 / 6000, abs=0.06)


def plain_risk(model, x, positive, prior):
    """The risk as it is written in the papers."""
    g = model.margin(x)
    loss = lambda margin: np.log1p(np.exp(-margin)).mean()
    decay = pu_classifier.RIDGE * (model.weights[:-1] ** 2).sum() / 2
    if prior is None:
        return loss(g[positive]) + loss(-g) + decay
    return prior * loss(g[positive]) + max(0.0, loss(-g) - prior * loss(-g[positive])) + decay


@pytest.mark.parametrize("prior", [None, 0.1, 0.6])
def test_risk_gradient_and_curvature(prior):
    x, positive = made_rows()
    rng = np.random.default_rng(3)
    at = lambda w: pu_classifier.Model(x.mean(axis=0), x.std(axis=0), w)
    risk_at = lambda w: pu_classifier.Risk(pu_classifier.risk_sums(at(w), x, positive), w, prior)
    for _ in range(3):
        w = rng.normal(0, 0.3, 4)
        risk = risk_at(w)
        assert risk.value == pytest.approx(plain_risk(at(w), x, positive, prior))
        for i in range(4):
            h = np.eye(4)[i] * 1e-5
            assert risk.slope[i] == pytest.approx((plain_risk(at(w + h), x, positive, prior) - plain_risk(at(w - h), x, positive, prior)) / 2e-5, abs=1e-5)
            assert risk.curve[i] == pytest.approx((risk_at(w + h).slope - risk_at(w - h).slope) / 2e-5, abs=1e-4)
    # a part below zero leads back: along the step it rises
    if prior == 0.6:
        w = np.array([3.0, 3.0, 3.0, 6.0])
        inner = lambda v: np.log1p(np.exp(at(v).margin(x))).mean() - 5 * np.log1p(np.exp(at(v).margin(x[positive]))).mean()
        back = pu_classifier.Risk(pu_classifier.risk_sums(at(w), x, positive), w, 5.0)
        assert inner(w) < 0 and inner(w - 1e-4 * back.slope) > inner(w)


def test_sums_of_a_table_equal_sums_of_rows(spark):
    rng = np.random.default_rng(5)
    x, positive = rng.normal(0, 1, (500, pu_classifier.FEATURES)).astype(np.float32), rng.random(500) < 0.2
    rows = spark.createDataFrame([(v.tolist(), bool(p)) for v, p in zip(x, positive)], "x array<float>, good boolean").repartition(7)
    model = pu_classifier.Model(x.mean(axis=0), x.std(axis=0), rng.normal(0, 0.1, pu_classifier.FEATURES + 1))
    for of in (pu_classifier.moments, partial(pu_classifier.risk_sums, model)):
        assert pu_classifier.table_total(rows)(of) == pytest.approx(pu_classifier.row_total(x.astype(np.float64), positive)(of))
