"""Files that queries write for themselves come from as many tasks as the session has."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from sitefacts.bindings import bound, sql_of
from sitefacts.checks import columns, extract, people, tables

SF = "/root/testdata/sf0.01"


def parts(path):
    return [f for f in os.listdir(path.removeprefix("file:")) if f.startswith("part-")]


def test_url_list_comes_in_several_files(spark, monkeypatch):
    paths, load = [], tables.S.load_url_list
    monkeypatch.setattr(tables.S, "load_url_list", lambda session, path: paths.append(path) or load(session, path))
    entry.queries()["load_url_list"](spark, SF)
    assert len(parts(paths[0])) > 1


def test_event_files_follow_the_shuffle_partitions(spark):
    path, schema, per_batch = people.event_files(spark, SF)
    assert len(parts(path)) > 3 and len(parts(path)) / per_batch >= 3


def test_whole_parts_of_numbers_are_alike_in_both_engines(spark, tmp_path):
    path = f"{tmp_path}/customer.parquet"
    rows = "SELECT unnest([12855, 14545, 1955, 10, 15]) AS c_custkey, unnest([-2.11, -128.42, 512.67, -0.5, 0.99])::DOUBLE AS c_acctbal"
    with duckdb.connect() as con:
        con.sql(f"COPY ({rows}) TO '{path}' (FORMAT parquet)")
        con.sql(f"CREATE VIEW customer AS SELECT * FROM '{path}'")
        want = sorted(con.sql(f"SELECT c_custkey, raw FROM {sql_of(columns.NUMBERS)}").fetchall())
    assert sorted(tuple(r) for r in bound(spark, str(tmp_path), columns.NUMBERS).select("c_custkey", "raw").collect()) == want
    assert (12855, "-2,11") in want


@pytest.mark.parametrize("name", ["email_candidates_many", "email_candidates", "render_pattern"])
def test_costly_rows_come_in_as_many_tasks_as_shuffles_have(spark, name):
    rows = entry.queries()[name](spark, SF)
    assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("name", ["firm_sites", "registry_address", "registry_lines"])
def test_costly_rows_are_dealt_out_before_they_are_read(spark, name):
    assert "Repartition " in entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_sections_come_in_as_many_tasks_as_shuffles_have(spark, monkeypatch):
    given, run = [], extract.G.labelled_sections
    monkeypatch.setattr(extract.G, "labelled_sections", lambda lines: given.append(lines) or run(lines))
    extract.labelled_sections(spark, "/root/testdata/sf0.001")
    assert given[0].rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_imports_come_in_as_many_tasks_as_shuffles_have(spark, monkeypatch):
    given = []
    monkeypatch.setattr(tables.CS, "import_to_store", lambda session, root, contacts, prices, people, **options: given.append(prices))
    tables.imported_twice(spark, "/root/testdata/sf0.001")
    assert given[0].rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_site_counts_parses_its_pages_once(spark, monkeypatch):
    parsed, elements = [], extract.html_elements
    monkeypatch.setattr(extract, "html_elements", lambda pages, **options: parsed.append(options["tags"]) or elements(pages, **options))
    entry.queries()["site_counts"](spark, SF)
    assert len(parsed) == 1


def page_table(path, rows):
    values = ", ".join(f"({i}, '{url}', '{html}')" for i, url, html in rows)
    with duckdb.connect() as con:
        con.sql(f"COPY (SELECT page_id::BIGINT AS page_id, url, html FROM (VALUES {values}) t(page_id, url, html)) TO '{path}/pages.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet'")
        return con.sql(entry.oracle_sql()["site_counts"]).fetchall()


def test_site_counts_hold_all_that_is_found_on_a_site(spark, tmp_path):
    rows = [(i, f"https://www.one.example.com/{i}", "<body><article>a</article></body>") for i in (1, 2, 4, 41)] + [(5, "https://two.example.com/", "<article>b</article>")]
    want = page_table(tmp_path, rows)
    found = entry.queries()["site_counts"](spark, str(tmp_path)).select("site", "pages", "prices", "specialists", "contacts", "links", "booking_mode")
    got = sorted(tuple(r) for r in found.collect())
    assert got == sorted(want)
    # page 4 names nobody but a namesake without a role, and pages 1 and 41 show the same contacts
    assert [r[:5] for r in got] == [("https://one.example.org/", 4, 12, 3, 3), ("https://two.example.org/", 1, 3, 1, 1)]


def test_site_counts_keep_pages_of_one_id_apart(spark, tmp_path):
    # the elements of the second page stand two places on, where its rows would take the cells of the first
    rows = [(1, "https://one.example.com/", "<article>a</article>"), (1, "https://two.example.com/", "<b>x</b><b>y</b><article>a</article>")]
    page_table(tmp_path, [*rows, rows[1], (3, "https://none.example.com/", "<p>no such parts</p>")])
    found = entry.queries()["site_counts"](spark, str(tmp_path)).select("site", "pages", "prices", "specialists", "contacts", "booking_mode")
    assert sorted(tuple(r) for r in found.collect()) == [
        ("https://none.example.org/", 1, 0, 0, 0, "none"), ("https://one.example.org/", 1, 3, 1, 1, "form+widget"), ("https://two.example.org/", 2, 3, 1, 1, "form+widget"),
    ]
