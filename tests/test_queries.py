"""The registered queries: complete, named alike on both sides, and equal to their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from sitefacts.bindings import TABLES

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "site_profile", "normalize_http_url", "classify_social_link", "json_values", "page_links", "extract_contacts_by_tag", "parse_price",
    "staff_from_lines", "booking_provider", "metric_by_year", "pagination_audit", "append_unique", "upsert_companies", "claim_domains",
    "bucket_by_week", "merge_contact_field", "collapse_members", "match_people", "best_match", "within_n_lines", "render_pattern", "stream_resume",
)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_registry(sql):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    own = {n for n in queries if not (n == "pipeline" or n.startswith("op") and n[2].isdigit())}
    assert own <= set(oracles)
    for name, text in oracles.items():
        assert sql.sql(f"SELECT * FROM ({text}) LIMIT 0").columns, name


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_equal_rows(spark, sql, name):
    def rows(columns, data):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
        return [columns[i] for i in order], sorted(tuple(show(r[i]) for i in order) for r in data)

    df, want = entry.queries()[name](spark, SF), sql.sql(entry.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
