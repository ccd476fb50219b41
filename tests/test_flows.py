"""Whole flows and streams on small fixtures."""

import pytest

from sitefacts.plans import crawl_flow, import_flow, lead_flow
from sitefacts.session import work_path
from sitefacts.sources.sites import SiteStore
from sitefacts.sources.tables import write_links
from sitefacts.streaming import jobs as J

HTML = """<html><head><title>Клиника</title></head><body><header><a href="https://instagram.com/clinic.one/?x=1">i</a></header>
<div class="team"><p>Иванов Иван врач-ортодонт 8 (383) 255-10-11</p></div><ul><li>Осмотр — от 500 руб.</li></ul>
<form action="https://n1.yclients.com/record"><input name="phone"></form><a href="https://vk.com/club1">v</a><a href="https://clck.ru/1">s</a>
<div id="footer"><a href="https://t.me/clinic_one">t</a> ИНН 7701234567, info@one.ru</div></body></html>"""


def pages(spark, column="site"):
    rows = [("https://one.ru/", 1, "https://one.ru/", HTML), ("https://one.ru/", 2, "https://one.ru/team", HTML)]
    return spark.createDataFrame(rows, f"{column} string, page_id int, url string, html string")


def test_lead_flow(spark):
    firms = spark.createDataFrame([("f1", "One", "Street", "www.one.ru", 1), ("f1", "One", "Street", "https://one.ru/x", 2), ("f2", "Two", "", "two.ru", 3)], "firm_id string, company_name string, address_name string, site_url string, pos int")
    table = spark.createDataFrame([("two.ru; other.ru", "770123456789", 1)], "site string, inn string, pos int")
    out = {k: v.collect() for k, v in lead_flow.lead_tables(firms, pages(spark), table, max_sites=3).items()}
    assert {(r["firm_id"], r["site"], r["inn"], r["inn_source"]) for r in out["companies"]} == {("f1", "https://one.ru/", "7701234567", "site"), ("f2", "https://two.ru/", "770123456789", "company_csv")}
    assert {(r["firm_id"], r["service"], r["price_min"], r["url"]) for r in out["pricing"]} == {("f1", "Осмотр", 500, "https://one.ru/"), ("f1", "Осмотр", 500, "https://one.ru/team")}
    assert [(r["full_name"], r["role"], r["phone"]) for r in out["specialists"]] == [("Иванов Иван", "ортодонт", "8 (383) 255-10-11")]
    assert [(r["booking_mode"], r["booking_widget_provider"]) for r in out["bookings"]] == [("form+widget", "yclients")]
    assert [(r["scope"], r["instagram_url"], r["handle"]) for r in out["instagram"]] == [("header", "https://www.instagram.com/clinic.one/", "clinic.one")]
    assert [(r["scope"], r["telegram_url"], r["web_url"]) for r in out["telegram"]] == [("footer", "https://t.me/clinic_one", "https://web.telegram.org/k/#@clinic_one")]


def test_leads_are_stored_by_site_and_resumed(spark, monkeypatch):
    root = work_path(spark, "leads")
    firm = "firm_id string, company_name string, address_name string, site_url string, pos int"
    firms = spark.createDataFrame([("f1", "One", "Street", "one.ru", 1), ("f2", "Two", "", "two.ru", 2), ("f2", "Two", "", "three.ru", 3)], firm)
    table = spark.createDataFrame([("two.ru", "770123456789", 1)], "site string, inn string, pos int")
    more = spark.createDataFrame([("https://two.ru/", 3, "https://two.ru/", HTML)], "site string, page_id int, url string, html string")
    write = SiteStore.write

    def killed(self, rows):
        if self.store.root.endswith("/bookings"):
            raise RuntimeError("killed")
        return write(self, rows)

    monkeypatch.setattr(SiteStore, "write", killed)
    run = lambda p: lead_flow.store_leads(spark, root, firms, p, table, n_parts=4, max_sites=1)
    with pytest.raises(RuntimeError):
        run(pages(spark))
    monkeypatch.setattr(SiteStore, "write", write)
    for p in (pages(spark), pages(spark).unionByName(more), pages(spark).unionByName(more)):
        stores = run(p)
    got = {k: sorted(r["site"] for r in s.read().collect()) for k, s in stores.items()}
    one, two = "https://one.ru/", "https://two.ru/"
    assert got == {"companies": [one, two], "pricing": [one, one, two], "specialists": [one, two], "bookings": [one, two], "instagram": [one, two], "telegram": [one, two]}
    # site one was written by the killed run and the first whole one, site two until it had pages
    assert {r["site"]: r["version"] for r in stores["pricing"].sites().collect()} == {one: 1, two: 2}


def test_crawl_flow(spark):
    cards = spark.createDataFrame(
        [("f1", 1, 1, "one.ru"), ("f1", 1, 2, "https://clck.ru/a"), ("f1", 1, 3, "https://clck.ru/lost"), ("f2", 2, 4, "https://shop.one.ru"), ("f3", 3, 5, "https://t.me/x"), ("f3", 3, 6, "https://x.jivo.chat")],
        "firm_id string, firm_pos int, pos int, raw_site string",
    )
    short = spark.createDataFrame([("https://clck.ru/a", "https://vk.com/a"), ("https://clck.ru/1", "https://dzen.ru/one")], "url string, target string")
    none = short.limit(0)
    social, sites = crawl_flow.card_sites(cards, short, none)
    assert {(r["firm_id"], r["kind"], r["link_url"]) for r in social.collect()} == {("f1", "social", "https://vk.com/a"), ("f3", "telegram", "https://t.me/x")}
    targets = crawl_flow.crawl_targets(sites, cards.select("firm_id"), 2)
    assert {(r["firm_id"], r["status"], r["details"]) for r in targets.collect()} == {
        ("f1", "queued", ""), ("f2", "skipped", "duplicate_origin_domain=one.ru"), ("f2", "failed", "no_crawl_targets_after_filtering"), ("f3", "failed", "no_crawl_targets_after_filtering"),
    }
    links = crawl_flow.crawled_links(pages(spark, "site_url"), targets, short)
    found = {(r["sink"], r["firm_id"], r["link_url"]) for r in links.collect()}
    assert found == {
        ("telegram", "f1", "https://t.me/clinic_one"), ("social", "f1", "https://vk.com/club1"), ("other", "f1", "https://vk.com/club1"), ("dzen", "f1", "https://dzen.ru/one"),
        ("social", "f1", "https://instagram.com/clinic.one?x=1"), ("other", "f1", "https://instagram.com/clinic.one?x=1"),
    }
    assert crawl_flow.crawled_links(pages(spark, "site_url"), targets, short, links).count() == 0
    path = work_path(spark, "links")
    write_links(links, path)
    assert {(r["sink"], r["firm_id"], r["link_url"]) for r in spark.read.parquet(path).collect()} == found
    booked = crawl_flow.crawled_bookings(pages(spark, "site_url"), targets)
    assert [(r["firm_id"], r["site_url"], r["booking_mode"], r["booking_widget_provider"]) for r in booked.collect()] == [("f1", "https://one.ru/", "form+widget", "yclients")]
    assert crawl_flow.crawled_bookings(pages(spark, "site_url"), targets, booked).count() == 0
    counts = spark.sql("SELECT 'https://one.ru/' AS site_url, 2 AS pages, 1 AS prices, 1 AS specialists, 2 AS contacts, 'form' AS booking_mode, map('vk', 1) AS links")
    status = crawl_flow.crawl_status(counts, targets).collect()
    assert [(r["firm_id"], r["stage"], r["status"], r["details"]) for r in status] == [("f1", "crawl", "success", "pages=2 prices=1 specialists=1 contacts=2 booking=form links={vk: 1}")]


def test_import_flow(spark):
    stored = {
        "companies": spark.createDataFrame([("one.ru", "u", "page", "1", None, None, "p", "e")], "domain string, source_url string, source_scope string, inn string, ogrn string, ogrnip string, phones string, emails string"),
        "pricing": spark.createDataFrame([("one.ru", "u", "old", None, None, None, None), ("z.ru", "u", "keep", None, None, 1, None)], "domain string, source_url string, service string, price_raw string, currency string, price_min long, price_max long"),
        "specialists": spark.createDataFrame([("two.ru", "u", "Old", None, None, None)], "domain string, source_url string, full_name string, role string, phone string, email string"),
    }
    contacts = spark.createDataFrame([("one.ru", 1, "a", "", "7; 8", "", "", "+7", "X@x"), ("one.ru", 2, "b", "footer", "8", "", "", "", "x@x; y@y")], "domain string, pos int, source_url string, source_scope string, inn string, ogrn string, ogrnip string, phones string, emails string")
    pricing = spark.createDataFrame([("one.ru", "a", "svc", "5 руб", "", "5", ""), ("one.ru", " ", "", "x", "", "", "")], "domain string, source_url string, service string, price_raw string, currency string, price_min string, price_max string")
    people = spark.createDataFrame([("two.ru", "a", "New", "", "1", "")], "domain string, source_url string, full_name string, role string, phone string, email string")
    out = import_flow.import_tables(stored, contacts, pricing, people)
    companies = {r["domain"]: r for r in out["companies"].collect()}
    assert (companies["one.ru"]["source_scope"], companies["one.ru"]["inn"], companies["one.ru"]["emails"], companies["one.ru"]["ogrn"]) == ("footer", "7; 8", "X@x; y@y", None)
    assert companies["two.ru"]["phones"] is None
    assert {(r["domain"], r["service"], r["price_min"], r["currency"]) for r in out["pricing"].collect()} == {("z.ru", "keep", 1, None), ("one.ru", "svc", 5, None)}
    assert [(r["full_name"], r["role"]) for r in out["specialists"].collect()] == [("New", None)]
    links = spark.createDataFrame([(1, "https://www.one.ru/", "https://vk.com/a", ""), (2, "one.ru", "https://vk.com/a", ""), (3, "one.ru", "https://any.net/x", "dzen_profile"), (4, "gone.ru", "https://vk.com/b", ""), (5, "", "https://vk.com/b", "")], "pos int, site_url string, url string, field_name string")
    ids = spark.createDataFrame([(7, "one.ru")], "id int, domain string")
    profiles, stats = import_flow.import_profiles(links, ids)
    assert {(r["company"], r["vk_profile"], r["dzen_profile"]) for r in profiles.collect()} == {(7, "https://vk.com/a", None), (7, None, "https://any.net/x")}
    assert {r["outcome"]: r["n"] for r in stats.collect()} == {"inserted": 2, "skipped_no_company": 1, "skipped_invalid": 1}


def test_stream_resumes_without_repeats(spark):
    source, target, checkpoint = (work_path(spark, n) for n in ("src", "dst", "chk"))
    row = lambda ids: spark.createDataFrame([(i, f"f{i % 3}", f"u{i % 5}") for i in ids], "pos int, firm string, url string")
    row(range(10)).coalesce(1).write.mode("append").parquet(source)
    schema = row([1]).schema
    run = lambda: J.stream_append_unique(J.file_stream(spark, source, schema, 1), target, ["firm", "url"], ["pos"], checkpoint).awaitTermination()
    run()
    first = J.stored_rows(spark, target, schema).count()
    row(range(5, 40)).coalesce(1).write.mode("append").parquet(source)
    run()
    rows = J.stored_rows(spark, target, schema)
    assert first == 10 and rows.count() == 15 and rows.select("firm", "url").distinct().count() == 15
    run()
    assert J.stored_rows(spark, target, schema).count() == 15


def test_stream_drops_repeats_within_a_bound(spark):
    source, target, checkpoint = (work_path(spark, n) for n in ("src", "dst", "chk"))
    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS t, id % 3 AS k FROM range(30)").write.parquet(source)
    stream = J.unique_within(J.file_stream(spark, source, spark.read.parquet(source).schema), ["k"], "t", "1 hour")
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()
    assert spark.read.parquet(target).count() == 3
