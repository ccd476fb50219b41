"""Jobs against golden results, brute force and hot keys."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from sitefacts import vocab
from sitefacts.operators import aggregate as A
from sitefacts.operators import candidates as N
from sitefacts.operators import columns as K
from sitefacts.operators import companies as C
from sitefacts.operators import pages as P
from sitefacts.operators import people as M
from sitefacts.operators import prices as R
from sitefacts.operators import profiles as E
from sitefacts.operators import registry as G
from sitefacts.operators.first import first_per_key, top_per_key
from sitefacts.session import land
from sitefacts.sources import tables as S


def addresses(spark, domain, last, first, middle="", **options):
    df = spark.createDataFrame([(domain, last, first, middle)], "domain string, last_name string, first_name string, middle_name string")
    return sorted(r["email"] for r in N.email_candidates(df, **options).collect())


def test_addresses_of_one_person(spark):
    got = addresses(spark, "Example.COM", "Иванов", "Иван", "Иванович", most=1, patterns=("first.last", "f.last", "last.f", "first.middle"))
    assert got == ["i.ivanov@example.com", "ivan.ivanov@example.com", "ivan.ivanovich@example.com", "ivanov.i@example.com"]
    assert addresses(spark, "https://www.t.me/some/path", "Петров", "Петр", most=1, patterns=("first", "last.first")) == ["petr@t.me", "petrov.petr@t.me"]
    assert addresses(spark, "example.com", "", "Иван") == []
    assert addresses(spark, "not a domain", "Иванов", "Иван") == []


def test_cut_entities_in_titles_and_texts(spark):
    df = spark.createDataFrame([("# A", "<title>Fish &amp; Chips&amp</title><p>x &copy</p>")], "markdown string, html string")
    assert P.with_title(df, closed=True).first()["title"] == "Fish & Chips&amp"
    assert P.with_title(df).first()["title"] == "Fish & Chips&"
    assert P.with_page_text(df, markdown="markdown", closed=True).first()["page_text"] == "# A Fish & Chips&amp x &copy"


def test_articles_are_read_from_their_elements_once(spark):
    rows = [
        (1, 0, "article", {"class": "item x"}, "all", []), (1, 1, "time", {"datetime": "2024-01-02T03:04:05Z"}, "t", [0]), (1, 2, "a", {"class": "link", "href": "/ru/companies/1"}, "One", [0]),
        (1, 3, "main", {}, "", []), (1, 4, "time", {"datetime": "2024-01-02T03:04:05Z"}, "t", [3]), (1, 5, "a", {"class": "link", "href": "/ru/companies/2"}, "Two", [3]), (2, 0, "article", {"class": "item"}, "", []),
    ]
    elements = spark.createDataFrame(rows, "page_id int, pos int, tag string, attrs map<string,string>, text string, ancestors array<int>")
    found = E.article_list(elements, item_class="item", link_class="link")
    assert [(r["page_id"], r["pos"], r["title"]) for r in found.collect()] == [(1, 0, "One")]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_log_details_are_cut_before_rows_are_sorted(spark):
    log = spark.createDataFrame([(1, "s", 1, 1, "a", "ok", "x" * 9), (1, "s", 2, 2, "b", "ok", "y" * 9)], "firm int, site string, t int, pos int, stage string, status string, details string")
    latest = A.crawl_summary(log, "firm", "site", "t", "pos", details_chars=4)
    assert [tuple(r) for r in latest.collect()] == [(1, "s", "b", "ok", "yyyy", 2)]
    plan = latest._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Aggregate") < plan.index("substring")


def test_contacts_are_looked_for_once_per_text(spark):
    df = spark.createDataFrame([("s", 1, "u", "<p>8 (383) 255-10-11</p>"), ("s", 2, "u", "<footer>a@b.example</footer> 8 (383) 255-10-12"), ("s", 3, "u", "none")], "site string, page_id int, url string, html string")
    found = P.extract_contacts(df, "site")
    assert sorted((r["page_id"], r["source_scope"], r["phones"], r["emails"]) for r in found.collect()) == [(1, "page", "+73832551011", ""), (2, "footer", "", "a@b.example")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan[: plan.index("Aggregate")] and "regexp_extract_all" not in "".join(l for l in plan.splitlines() if "Filter" in l)


def test_spellings_are_the_cut_product(spark):
    names = ["Щукин", "Юлия-Яна", "Хрыц", "O'Neil", "Гегегегегегегег", "ъь"]
    for most in (1, 3, 8):
        df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
        got = {r["i"]: r["v"] for r in df.select("i", N.variants(F.col("n"), most).alias("v")).collect()}
        for i, name in enumerate(names):
            token = re.sub("[^а-яa-z-]+", "", name.lower().replace("ё", "е"))
            if re.fullmatch("[a-z-]+", token):
                want = [token.replace("-", "")]
            else:
                # the cut keeps the first of the product, and products grow at the end
                choices = [vocab.LETTER_SPELLINGS.get(ch, ("",)) for ch in token]
                whole = ["".join(p) for p in itertools.islice(itertools.product(*choices), 4 * most)] if len(choices) < 8 else None
                if whole is None:
                    assert len(got[i]) <= most and len(set(got[i])) == len(got[i])
                    continue
                want = [w for w in dict.fromkeys(whole) if w][:most]
            assert got[i] == want, (name, most)


def test_vacancy(spark):
    payload = (
        '{"id":"10","name":"Python developer","employer":{"name":"Example"},"salary":{"from":100000,"to":150000,"currency":"RUR","gross":true},'
        '"experience":{"name":"1-3"},"schedule":{"name":"remote"},"key_skills":[{"name":"Python"},{"name":"SQL"}],"description":"<p>Build &quot;APIs&quot;</p>"}'
    )
    df = K.parse_vacancies(spark.createDataFrame([(payload,)], "p string"), "p")
    rates = spark.createDataFrame([("RUR", 1.0)], "currency string, rate double")
    row = K.vacancy_summary(df, rates).first()
    assert (row["salary_from"], row["salary_to"], row["has_salary"], row["key_skills"]) == (87000, 130500, True, ["Python", "SQL"])
    assert K.vacancy_summary(df).first()["salary_from"] == 87000
    text = K.vacancy_text(df).first()
    assert (text["employer"], text["text"]) == ("Example", 'Python developer\n\nBuild "APIs"')


def test_result_pages(spark):
    pages = spark.createDataFrame([(1, 0, '{"items":[{"id":"1"},{"id":"2"}],"total":3,"pages":2}'), (1, 1, '{"items":[{"id":"3"}],"total":3,"pages":2}'), (2, 0, '{"items":[],"total":5}')], "q int, page int, p string")
    assert sorted(r["id"] for r in S.explode_payload_pages(pages, "p", "struct<id: string>").select("item.id").collect()) == ["1", "2", "3"]
    audit = {r["q"]: r for r in S.pagination_audit(pages, "q", "page", "p").collect()}
    assert (audit[1]["expected"], audit[1]["collected"], audit[1]["last_page"], audit[1]["mismatch"]) == (3, 3, 1, False)
    assert (audit[2]["collected"], audit[2]["last_page"], audit[2]["mismatch"]) == (0, 0, True)


def test_matches_equal_brute_force(spark):
    rng = random.Random(5)
    parts = ["ann", "bob", "li", "o", "marina", "smith", "the", "и", "петр"]
    people = sorted({" ".join(rng.sample(parts, rng.randint(1, 3))) for _ in range(25)})
    profiles = [(i, rng.choice(["ann.smith", "bobli", "x", "marina_o", ""]), rng.choice(["Ann Smith", "Пётр", "Li", ""]), " ".join(rng.choices(parts + ["joanna", "zzz"], k=rng.randint(0, 4)))) for i in range(60)]

    def form(x):
        return " ".join(re.sub("[^0-9a-zа-я._@]+", " ", x.lower().replace("ё", "е")).split())

    def score(person, user, full, text):
        t, u, f = form(person), form(user), form(full)
        payload = " ".join(p for p in (u, f, form(text)) if p)
        words = [w for w in t.split() if w not in ("и", "the")]
        if t in (u, f):
            return 100
        if t in payload:
            return 90
        if len(words) >= 2 and all(w in payload for w in words):
            return 80
        if len(words) == 1 and words[0] in (u, f):
            return 70
        return 55 if len(words) == 1 and words[0] in payload else 0

    want = {(p, i): s for p in people for i, *rest in profiles if (s := score(p, *rest))}
    got = M.match_people(spark.createDataFrame([(p,) for p in people], "person string"), spark.createDataFrame(profiles, "id int, username string, full_name string, row_text string"))
    rows = got.collect()
    assert {(r["person"], r["id"]): r["match_score"] for r in rows} == want and len(rows) == len(want)


def test_names_with_a_common_word_meet_few_texts(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abdefgiklmnoprstuw", k=8))
    surnames = [word() for _ in range(60)]
    texts = [(i, "", "", " ".join((["ivan"] if i % 3 == 0 else []) + [rng.choice(surnames) if i % 20 == 0 else word()] + [word() for _ in range(6)])) for i in range(3000)]
    people = [f"ivan {s}" for s in surnames] + ["ivan", "iv", "the"]
    want = {(p, i) for p in people for i, _, _, t in texts if (all(w in t for w in p.split()))}
    profiles = spark.createDataFrame(texts, "id int, username string, full_name string, row_text string")
    names = spark.createDataFrame([(p,) for p in people], "person string")
    got = [(r["person"], r["id"]) for r in M.match_people(names, profiles).select("person", "id").collect()]
    assert set(got) == want and len(got) == len(want)
    landed = M.profile_texts(profiles.selectExpr("cast(id as string) AS _id", "'' AS _u", "'' AS _f", "row_text AS _t"))
    met = M.name_candidates(M.name_probes(names, "person"), landed).groupBy(F.col("person").like("% %").alias("two")).count().collect()
    scored = {r["two"]: r["count"] for r in met}
    found = sum(" " in p for p, _ in want)
    # 60 names x 1,000 texts hold the common word
    assert scored[False] == len(want) - found and found <= scored[True] <= 2 * found + 20, (scored, found)


def test_hot_keys_give_the_same_rows_on_any_partitioning(spark):
    rows = [("hot" if i % 3 else f"k{i % 50}", i, f"V{i % 7}" if i % 2 else f"v{i % 7}") for i in range(3000)]
    one = spark.createDataFrame(rows, "k string, p int, v string").coalesce(1)
    many = one.repartition(8)
    for job in (
        lambda d: first_per_key(d, ["k", F.lower("v")], ["p"]),
        lambda d: top_per_key(d, ["k"], [F.col("p").desc()], 4),
        lambda d: C.merge_contacts(d, "k", ["v"], ["p"]),
        lambda d: A.with_section(d, ["k"], "p", F.when(F.col("p") % 11 == 0, F.col("v")), width=64),
        lambda d: A.pair_within(d, ["k"], "p", F.col("p") % 5 == 0, F.when(F.col("p") % 3 == 0, F.col("v")), 7, width=64),
        lambda d: S.slice_rows(d.withColumn("id", F.col("v")), "p", "id", 10, 2000, 500),
    ):
        assert sorted(map(tuple, job(one).collect())) == sorted(map(tuple, job(many).collect()))
    plan = top_per_key(many, ["k"], [F.col("p")], 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # rows are cut before and after the shuffle


def test_append_unique_is_idempotent(spark):
    new = spark.createDataFrame([(1, "f1", "a"), (2, "f1", " a "), (3, "", "b"), (4, "f2", "a"), (5, "f3", None)], "pos int, firm string, url string")
    empty = new.limit(0)
    first = S.append_unique(empty, new, ["firm", "url"], ["pos"])
    assert sorted(r["pos"] for r in first.collect()) == [1, 4]
    assert S.append_unique(first, new, ["firm", "url"], ["pos"]).count() == 0


def test_upsert_knows_both_forms_of_a_domain(spark):
    ascii_host = "клиника.рф".encode("idna").decode()
    stored = spark.createDataFrame([("клиника.рф", "old"), ("a.com", "old")], "domain string, phones string")
    incoming = spark.createDataFrame([(ascii_host, "new", True), ("a.com", None, False), ("b.com", None, False)], "domain string, phones string, has_contacts boolean")
    got = {r["domain"]: r["phones"] for r in C.upsert_companies(stored, incoming, ["phones"]).collect()}
    assert got == {"клиника.рф": "new", "a.com": "old", "b.com": None}


def test_children_go_even_without_new_rows(spark):
    stored = spark.createDataFrame([("a", "x"), ("b", "y")], "domain string, service string")
    imported = spark.createDataFrame([("a",)], "domain string")
    assert [tuple(r) for r in C.replace_children(stored, stored.limit(0), imported, "domain").collect()] == [("b", "y")]


def test_prices(spark):
    lines = ["Осмотр — от 1 500 руб.", "Чистка до 2000₽", "Снимок 100-200 руб", "нет цены", "900 рублей", "Протез 5 рядов"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = {r["i"]: (r["service"], r["price_min"], r["price_max"]) for r in R.parse_prices(df).collect()}
    assert got[0] == ("Осмотр", 1500, 1500) and got[1] == ("Чистка", None, 2000) and got[2] == ("Снимок", 100, 200)
    assert 3 not in got and 5 not in got and got[4][1] == 900


def test_week_quirk(spark):
    df = spark.sql("SELECT * FROM VALUES (date'2024-01-02'), (date'2024-01-22') AS t(d)")
    weeks = [str(r["week"]) for r in C.bucket_by_week(df, "d").orderBy("week").collect()]
    assert weeks == ["2024-01-01", "2024-01-08", "2024-01-15"]
    assert C.bucket_by_week(df, "d", keep_quirk=False).count() == 4


def test_registry_sections_over_block_edges(spark):
    body = [
        "Сведения о лице, имеющем право без доверенности", "действовать от имени юридического лица", "1 Фамилия Иванов", "x", "2 Имя Иван", "3 Отчество Иванович",
        "Фамилия Петров", "Сведения о записи", "Имя Пётр", "5 Адрес юридического лица 630000, Город,", "ул. Мира", "6 Иное", "9 Адрес электронной почты a@exam", "ple.com", "ГРН 1 234567890123",
    ]
    df = spark.createDataFrame([("d", i * 3, t) for i, t in enumerate(body)], "document string, pos int, text string")
    for width in (2, 5, 1000):
        assert [r["full_name"] for r in G.registry_extract(df, width=width).collect()] == ["Иванов Иван Иванович"]
        assert [r["address"] for r in G.registry_address(df, width=width).collect()] == ["630000, Город, ул. Мира"]
        assert [(r["email"], r["grn"]) for r in G.registry_emails(df, width=width).collect()] == [("a@example.com", "1234567890123")]


def test_shuffled_head_is_stable(spark):
    df = spark.range(500)
    a = [r["id"] for r in A.shuffled_head(df.repartition(3), ["id"], 50, 9).collect()]
    assert a == [r["id"] for r in A.shuffled_head(df.coalesce(1), ["id"], 50, 9).collect()] and a != sorted(a)
    assert A.shuffled_head(df, ["id"], 0, 9).count() == 500
    order = [r["id"] for r in A.shuffled_head(df, ["id"], 0, 9).collect()]
    for n, merged in ((50, 1), (333, 3), (499, 1), (500, 20), (900, 20)):
        assert [r["id"] for r in A.shuffled_head(df.repartition(3), ["id"], n, 9, merged).collect()] == order[:n]
    same = df.select(F.lit(1).alias("id"))
    assert A.shuffled_head(same, ["id"], 7, 9, 2).count() == 7 and A.shuffled_head(df.limit(0), ["id"], 7, 9, 2).count() == 0


def test_column_choice(spark):
    df = spark.createDataFrame([(" a ", "x@y.z")], "WebSite string, work_email string")
    assert S.resolve_column(df, vocab.SITE_COLUMNS) == "WebSite"
    assert S.resolve_column(df, (), containing="email", default_first=True) == "work_email"
    assert S.resolve_column(df, (), default_first=True) == "WebSite" and S.resolve_column(df, ()) == ""
    assert [r["v"] for r in S.resolved(df, vocab.SITE_COLUMNS, "v").collect()] == ["a"]


def test_csv_edges(spark, tmp_path):
    assert S.read_csv_table(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "b.csv").write_text("﻿site,inn\n a ,\n", encoding="utf-8")
    df = S.read_csv_table(spark, str(tmp_path / "b.csv"), bom=True)
    assert df.columns == ["site", "inn"] and [tuple(r) for r in df.collect()] == [("a", "")]
    with pytest.raises(ValueError):
        S.merge_csv_files(spark, str(tmp_path), "absent")
    items = spark.createDataFrame([('{"b":1,"a":{"x":"я"}}',), ('{"c":[1]}',)], "j string")
    wide = S.read_items(spark, items.coalesce(1), "j")
    assert wide.columns == ["b", "a", "c"] and wide.first()["a"] == '{"x":"я"}'


def test_hot_keys_meet_one_lookup_row(spark):
    """One domain, and one site, hold a third of the rows: each row comes back once, and the key is joined once."""
    probes = spark.range(3000).selectExpr("concat('a', id, '@x') AS address", "if(id % 3 = 0, 'hot.ru', concat('d', id, '.ru')) AS domain", "if(id % 2 = 0, 'mx2', 'mx1') AS host", "if(id % 6 = 0, 250, 550) AS code")
    exchangers = spark.createDataFrame([("hot.ru", 20, "mx2"), ("hot.ru", 10, "mx1"), ("hot.ru", 30, "mx1"), ("d1.ru", 5, "mx1")], "domain string, preference int, host string")
    catch_all = spark.createDataFrame([("hot.ru", "accepted")], "domain string, status string")
    joined = C.join_domain_checks(probes, exchangers, catch_all)
    rows = joined.collect()
    hot = [r for r in rows if r["domain"] == "hot.ru"]
    assert len(rows) == 3000 and len(hot) == 1000 and {r["mx_hosts"] for r in hot} == {"mx1; mx2"}
    assert {(r["mx_used"], r["final_status"]) for r in hot} == {("mx2", "catch_all"), ("mx1", "invalid")}
    assert {r["final_status"] for r in rows if r["domain"] == "d2.ru"} == {"unknown"}

    sites = spark.range(3000).selectExpr("if(id % 3 = 0, 'https://hot.ru/', concat('https://s', id, '.ru/')) AS site", "id")
    lookup = spark.createDataFrame([("hot.ru; s1.ru", "7701234567", 1), ("hot.ru", "7709999999", 2)], "site string, inn string, pos int")
    own = spark.createDataFrame([("hot.ru", "5401234567"), ("s2.ru", "5409999999")], "site_key string, tax_id string")
    got = C.attach_tax_id(sites, "site", lookup, "site", "inn", ["pos"], own).collect()
    assert len(got) == 3000 and {(r["tax_id"], r["tax_id_source"]) for r in got if r["site"] == "https://hot.ru/"} == {("7701234567", "company_csv")}
    assert {(r["tax_id"], r["tax_id_source"]) for r in got if r["id"] in (1, 2, 4)} == {("7701234567", "company_csv"), ("5409999999", "site"), ("", "")}


def test_slices_of_sparse_orders(spark):
    df = spark.range(5000).selectExpr("(id * 2654435761) % 4294967291 AS p", "if(id % 5 = 0, ' ', concat('u', id)) AS ident")
    order = sorted((r["p"], r["ident"]) for r in df.collect())
    want = [(p, i + 1) for i, (p, ident) in enumerate(order) if 101 <= i + 1 <= 4000 and ident.strip()][:700]
    got = S.slice_rows(df, "p", "ident", 101, 4000, 700)
    assert sorted((r["p"], r["row_number"]) for r in got.collect()) == want


def test_registry_lines_are_read_once(spark, monkeypatch):
    df = spark.createDataFrame([(1, 1, "Сведения об участниках / учредителях юридического лица"), (1, 2, "1 Фамилия Иванов"), (1, 3, "Имя Иван")], "document int, pos int, text string")
    plans = []
    monkeypatch.setattr(G, "land", lambda rows, name: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or land(rows, name))
    found = G.registry_extract(df)
    plans.append(found._jdf.queryExecution().optimizedPlan().toString())
    assert sum(p.count("LogicalRDD") for p in plans) == 1
    assert [tuple(r) for r in found.collect()] == [(1, "founders", "Иванов Иван", 2)]
