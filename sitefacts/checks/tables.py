"""Queries over sources, sinks, keyed writes, imports and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitefacts import vocab
from sitefacts.bindings import bound, define, spread, sql_of, table
from sitefacts.checks.base import list_sql, parts_sql, query, under_sql
from sitefacts.checks.urls import FIELD, KINDS, LINKS, SHARE
from sitefacts.operators import companies as C
from sitefacts.operators import urls as O
from sitefacts.plans import company_store as CS
from sitefacts.session import land, work_path
from sitefacts.sources import tables as S
from sitefacts.sources.sites import SiteStore

# --- sources and sinks ---------------------------------------------------------------------------


@query("read_csv_table", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, trim(p_name) AS p_name, 'a \"b\", ' || p_brand || chr(10) || 'x' AS note, '' AS empty FROM part")
def read_csv_table(spark, sf):
    df = spark.sql("SELECT p_partkey, concat(' ', p_name, ' ') AS p_name, concat('a \"b\", ', p_brand, chr(10), 'x') AS note, CAST(NULL AS STRING) AS empty FROM {part}", part=table(spark, sf, "part"))
    path = work_path(spark, "csv")
    df.write.options(header=True, escape='"', quoteAll=True).csv(path)
    return S.read_csv_table(spark, path)


@query(
    "merge_csv_files",
    """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS segment, '' AS nation FROM customer
    UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, '', CAST(s_nationkey AS VARCHAR) FROM supplier""",
)
def merge_csv_files(spark, sf):
    root = work_path(spark, "merge")
    table(spark, sf, "customer").selectExpr("c_custkey id", "c_name name", "c_mktsegment segment").write.option("header", True).csv(f"{root}/a/firms.csv")
    table(spark, sf, "supplier").selectExpr("s_suppkey id", "s_nationkey nation", "s_name name").write.option("header", True).csv(f"{root}/b/firms.csv")
    return S.merge_csv_files(spark, root, "firms")


@query("resolve_column", "SELECT c_custkey, c_name AS value FROM customer WHERE c_name <> ''")
def resolve_column(spark, sf):
    df = table(spark, sf, "customer").withColumnRenamed("c_name", "Site_URL").withColumn("url", F.lit("later"))
    return S.resolved(df, vocab.SITE_COLUMNS, "value").select("c_custkey", "value")


@query(
    "slice_rows",
    """SELECT o_orderkey, CAST(n AS BIGINT) AS row_number FROM (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders)
    WHERE n BETWEEN 101 AND 9000 AND o_custkey % 3 <> 0 ORDER BY o_orderkey LIMIT 5000""",
)
def slice_rows(spark, sf):
    df = table(spark, sf, "orders").withColumn("id", F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey").cast("string")).otherwise(F.lit(" ")))
    return S.slice_rows(df, "o_orderkey", "id", 101, 9000, 5000).select("o_orderkey", "row_number")


URLS = sql_of("urls_in")


@query(
    "load_url_list",
    f"""WITH {parts_sql(URLS)}, s AS (SELECT DISTINCT CASE WHEN scheme IN ('http','https') AND netloc <> '' AND NOT {under_sql("host", "reg.ru")}
        THEN scheme || '://' || netloc || CASE WHEN path = '' THEN '/' ELSE path END END AS start_url FROM p WHERE NOT starts_with(trim(url), '#'))
    SELECT start_url FROM s WHERE start_url IS NOT NULL""",
)
def load_url_list(spark, sf):
    path = work_path(spark, "urls")
    urls = bound(spark, sf, "urls_in").select("url").unionByName(spark.sql("SELECT explode(array('', '# note')) AS url"))
    urls.write.text(path)
    return S.load_url_list(spark, path).filter("start_url IS NOT NULL").select("start_url")


ITEMS = define(
    "items_in",
    """
    SELECT event_id, concat('{{"id":', event_id, ',"name":"', event_type, ' я"', CASE WHEN event_id % 2 = 0 THEN concat(',"props":', props) ELSE '' END,
        CASE WHEN event_id % 3 = 0 THEN concat(',"tags":["', event_type, '","x"]') ELSE '' END, '}}') AS payload
    FROM {events}
    """,
)


@query(
    "flatten_items",
    f"""SELECT payload->>'id' AS id, payload->>'name' AS name, CASE WHEN event_id % 2 = 0 THEN '{{"k":' || (payload->'props'->>'k') || '}}' END AS props,
    CASE WHEN event_id % 3 = 0 THEN '["' || (payload->'tags'->>0) || '","x"]' END AS tags FROM {sql_of(ITEMS)}""".replace("'{{", "'{").replace("'}}'", "'}'"),
)
def flatten_items(spark, sf):
    path = work_path(spark, "items")
    bound(spark, sf, ITEMS).select("payload").write.text(path)
    items = spark.read.schema("id string, name string, props struct<k: bigint>, tags array<string>").json(path)
    return S.flatten_items(items)


PAYLOADS = define(
    "payload_pages_in",
    """
    SELECT o_custkey AS query, CAST(n - 1 AS INT) AS page, concat('{{"items":[{{"id":"', o_orderkey, '"}}', CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat(',{{"id":"b', o_orderkey, '"}}') END,
        '],"total":', total * 2 - o_custkey % 2, ',"pages":', total, '}}') AS payload
    FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS total FROM {orders})
    """,
)


@query(
    "land_paged_payloads",
    f"SELECT query, page, x->>'id' AS id FROM (SELECT query, page, unnest(CAST(payload->'items' AS JSON[])) AS x FROM {sql_of(PAYLOADS)})",
)
def land_paged_payloads(spark, sf):
    return S.explode_payload_pages(bound(spark, sf, PAYLOADS), "payload", "struct<id: string>").select("query", "page", "item.id")


@query(
    "pagination_audit",
    f"""WITH p AS (SELECT query, page, json_array_length(payload->'items') AS n, CAST(payload->>'total' AS BIGINT) AS total, CAST(payload->>'pages' AS BIGINT) AS pages FROM {sql_of(PAYLOADS)}),
    s AS (SELECT *, sum(n) OVER (PARTITION BY query ORDER BY page) AS c, first_value(total) OVER (PARTITION BY query ORDER BY page) AS t0 FROM p)
    SELECT query, CAST(min(t0) AS BIGINT) AS expected, CAST(sum(n) AS BIGINT) AS collected, min(page) FILTER (WHERE n = 0 OR c >= t0 OR page + 1 >= pages OR page + 1 >= 12) AS last_page, min(t0) <> sum(n) AS mismatch FROM s GROUP BY query""",
)
def pagination_audit(spark, sf):
    return S.pagination_audit(bound(spark, sf, PAYLOADS), "query", "page", "payload", max_pages=12)


@query(
    "write_projected",
    """SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, '' AS missing, 'a; ' || s_name AS tags, CASE WHEN s_acctbal > 0 THEN '1' ELSE '0' END AS good FROM supplier""",
)
def write_projected(spark, sf):
    df = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.array(F.lit("a"), "s_name").alias("tags"), (F.col("s_acctbal") > 0).alias("good"), "s_nationkey")
    path = work_path(spark, "projected")
    S.write_projected(df, path, ("id", "name", "missing", "tags", "good"))
    return S.read_csv_table(spark, path)


@query("write_per_site", "SELECT s_suppkey, s_name, 'n' || s_nationkey || '.example.com' AS domain FROM supplier")
def write_per_site(spark, sf):
    df = table(spark, sf, "supplier").select("s_suppkey", "s_name", F.concat(F.lit("n"), "s_nationkey", F.lit(".example.com")).alias("domain"))
    path = work_path(spark, "sites")
    S.write_per_site(df.withColumn("s_name", F.lit("old")), path)
    S.write_per_site(df, path)
    return spark.read.parquet(path)


@query(
    "site_store",
    """WITH s AS (SELECT *, s_nationkey % 3 = 0 AND bool_or(s_suppkey % 2 = 1) OVER (PARTITION BY s_nationkey) AS again FROM supplier)
    SELECT s_suppkey, CASE WHEN again THEN s_name ELSE 'old' END AS s_name, CASE WHEN s_nationkey <> 6 THEN 'n' || s_nationkey || '.example.com' END AS domain FROM s WHERE NOT again OR s_suppkey % 2 = 1""",
)
def site_store(spark, sf):
    df = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.when(F.col("s_nationkey") != 6, F.concat(F.lit("n"), "s_nationkey", F.lit(".example.com"))).alias("domain"))
    first = df.select("s_suppkey", F.lit("old").alias("s_name"), "domain")
    store = SiteStore(spark, work_path(spark, "site-store"), first.schema)
    store.write(first)
    # a second import of every third site, with some of its rows gone
    store.write(df.where("s_nationkey % 3 = 0 AND s_suppkey % 2 = 1"))
    return store.read()


# --- keyed writes and imports --------------------------------------------------------------------
@query(
    "append_unique",
    """SELECT event_id, user_id, event_type FROM events e WHERE ts >= TIMESTAMP '2024-01-16' AND event_type <> 'view' AND NOT EXISTS
    (SELECT 1 FROM events o WHERE o.ts < TIMESTAMP '2024-01-16' AND o.user_id = e.user_id AND o.event_type = e.event_type AND o.value > 20)
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1""",
)
def append_unique(spark, sf):
    e = table(spark, sf, "events")
    new = e.filter("ts >= timestamp_ntz'2024-01-16'").withColumn("event_type", F.when(F.col("event_type") != "view", F.col("event_type")).otherwise(F.lit(" ")))
    old = e.filter("ts < timestamp_ntz'2024-01-16' AND value > 20")
    return S.append_unique(old, new, ["user_id", "event_type"], ["event_id"]).select("event_id", "user_id", "event_type")


@query("pending_after_resume", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def pending_after_resume(spark, sf):
    everyone = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit(" Mail"), "c_custkey").alias("email"))
    done = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("mail"), "o_custkey", F.lit(" ")).alias("email"))
    return S.pending_after_resume(everyone, done, "email").select("c_custkey")


@query(
    "route_links",
    f"""WITH {KINDS}, r AS (SELECT pos, firm_id, link_url, kind, 'site_crawl_' || kind AS source, unnest(CASE WHEN kind IN ('video','social') THEN [kind, 'other'] ELSE [kind] END) AS sink FROM kinds WHERE kind IS NOT NULL)
    SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY sink, firm_id, link_url ORDER BY pos) = 1""",
)
def route_links(spark, sf):
    links = O.with_link_kind(bound(spark, sf, "links_in", costly=True), "raw_url").withColumn("source", F.lit("site_crawl"))
    return S.route_links(links, "firm_id", "link_url").select("sink", "pos", "firm_id", "link_url", "kind", "source")


@query(
    "write_links",
    f"""WITH {KINDS}, r AS (SELECT pos, firm_id, link_url, kind, unnest(CASE WHEN kind IN ('video','social') THEN [kind, 'other'] ELSE [kind] END) AS sink FROM kinds WHERE kind IS NOT NULL)
    SELECT DISTINCT sink, firm_id, link_url FROM r""",
)
def write_links(spark, sf):
    links = land(O.with_link_kind(bound(spark, sf, "links_in", costly=True), "raw_url").withColumn("source", F.lit("site_crawl")), "links")
    path = work_path(spark, "sinks")
    S.write_links(S.route_links(links.where("pos % 2 = 0"), "firm_id", "link_url"), path)
    # a second run meets all links, and adds what the first has not stored
    S.write_links(S.route_links(links, "firm_id", "link_url", stored=spark.read.parquet(path)), path)
    return spark.read.parquet(path).select("sink", "firm_id", "link_url")


@query(
    "upsert_companies",
    """SELECT coalesce(a.domain, b.domain) AS domain, CASE WHEN coalesce(b.has_contacts, false) THEN b.phones ELSE a.phones END AS phones FROM
    (SELECT 'c' || c_custkey || '.example.com' AS domain, c_name AS phones FROM customer) a FULL JOIN
    (SELECT 'c' || (c_custkey + 500) || '.example.com' AS domain, 'new ' || c_name AS phones, c_custkey % 3 <> 0 AS has_contacts FROM customer) b ON a.domain = b.domain""",
)
def upsert_companies(spark, sf):
    c = table(spark, sf, "customer")
    old = c.select(F.concat(F.lit("c"), "c_custkey", F.lit(".example.com")).alias("domain"), F.col("c_name").alias("phones"))
    new = c.select(F.concat(F.lit("www.C"), F.col("c_custkey") + 500, F.lit(".example.com")).alias("d"), F.concat(F.lit("new "), "c_name").alias("phones"), (F.col("c_custkey") % 3 != 0).alias("has_contacts"))
    return C.upsert_companies(old, O.with_domain(new, "d"), ["phones"])


@query(
    "replace_children",
    """SELECT o_custkey, o_orderpriority AS source_url, o_orderkey AS price_min FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
    UNION ALL SELECT o_custkey, 'new', o_orderkey * 10 + 7 FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F'""",
)
def replace_children(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    stored = o.select("o_custkey", F.col("o_orderpriority").alias("source_url"), F.col("o_orderkey").alias("price_min"))
    raw = o.join(c, "o_custkey", "left_semi").select(
        "o_custkey", F.when(F.col("o_orderstatus") == "F", F.lit(" new ")).otherwise(F.lit(" ")).alias("source_url"), F.concat("o_orderkey", F.lit(" 7 руб")).alias("price_min")
    )
    rows = C.child_rows(raw, "o_custkey", ["source_url"], numbers=["price_min"])
    return C.replace_children(stored, rows, c, "o_custkey")


def imported_twice(spark, sf):
    """A store after two imports: all customers with their orders as prices, then one segment anew."""
    root = work_path(spark, "companies")
    # new prices of a company are told apart in the map tasks, so each of these must not be one for the whole table
    c, o = spread(table(spark, sf, "customer")), spread(table(spark, sf, "orders"))
    building = c.where("c_mktsegment = 'BUILDING'")
    name = lambda k: F.concat(F.lit("c"), F.col(k).cast("string"), F.lit(".example.com")).alias("domain")
    nothing = spark.createDataFrame([], CS.TABLES["specialists"])

    def contacts(rows, prefix):
        empty = [F.lit("").alias(f) for f in ("source_scope", "inn", "ogrn", "ogrnip", "emails")]
        return rows.select(name("c_custkey"), F.lit(1).alias("pos"), F.lit("u").alias("source_url"), F.concat(F.lit(prefix), "c_name").alias("phones"), *empty)

    def prices(rows, extra):
        empty = [F.lit("").alias(f) for f in ("price_raw", "currency", "price_max")]
        return rows.select(name("o_custkey"), F.lit("u").alias("source_url"), F.col("o_orderpriority").alias("service"), (F.col("o_orderkey") + extra).cast("string").alias("price_min"), *empty)

    CS.import_to_store(spark, root, contacts(c, ""), prices(o, 0), nothing, buckets=16)
    new = o.where("o_orderstatus = 'F'").join(building.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    CS.import_to_store(spark, root, contacts(building, "new "), prices(new, 7), nothing)
    return root


@query(
    "import_store_companies",
    "SELECT 'c' || c_custkey || '.example.com' AS domain, CASE WHEN c_mktsegment = 'BUILDING' THEN 'new ' ELSE '' END || c_name AS phones FROM customer",
)
def import_store_companies(spark, sf):
    return CS.stored_table(spark, imported_twice(spark, sf), "companies").select("domain", "phones")


@query(
    "import_store_children",
    """SELECT 'c' || o_custkey || '.example.com' AS domain, o_orderpriority AS service, CASE WHEN c_mktsegment = 'BUILDING' THEN o_orderkey + 7 ELSE o_orderkey END AS price_min
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING' OR o_orderstatus = 'F'""",
)
def import_store_children(spark, sf):
    return CS.stored_table(spark, imported_twice(spark, sf), "pricing").select("domain", "service", "price_min")


SOCIAL = f"""{parts_sql(LINKS, "raw_url", default_scheme=False)}, {parts_sql(LINKS, "raw_url", tag="q")},
    c AS (SELECT user_id % 40 AS company, 'firm' || (user_id % 40) || '.example.com' AS domain FROM events WHERE user_id % 40 < 30 GROUP BY ALL),
    f AS (SELECT pos, {FIELD} AS field FROM q),
    o AS (SELECT p.pos, p.u AS profile_url, c.company, f.field, CASE WHEN {SHARE} THEN 'skipped_invalid' WHEN c.company IS NULL THEN 'skipped_no_company' WHEN f.field IS NULL THEN 'skipped_unknown_type' ELSE 'inserted' END AS outcome
        FROM p JOIN f ON p.pos = f.pos LEFT JOIN c ON regexp_extract(p.site_url, '//www\\.([^/]*)', 1) = c.domain),
    i AS (SELECT DISTINCT company, field, profile_url FROM o WHERE outcome = 'inserted')"""


def social_companies(spark, sf):
    return spark.sql("SELECT user_id % 40 AS company, concat('firm', user_id % 40, '.example.com') AS domain FROM {e} WHERE user_id % 40 < 30 GROUP BY ALL", e=table(spark, sf, "events"))


def social(spark, sf):
    return C.social_outcomes(bound(spark, sf, "links_in", costly=True), social_companies(spark, sf), "site_url", "raw_url", "company", "domain")


@query("import_social_profiles", f"WITH {SOCIAL} SELECT company, {', '.join(f'''CASE WHEN field = '{c}' THEN profile_url END AS {c}''' for c in vocab.PROFILE_COLUMNS)} FROM i")
def import_social_profiles(spark, sf):
    return C.import_social_profiles(social(spark, sf))


@query("import_stats", f"WITH {SOCIAL} SELECT outcome, count(*) AS n FROM o WHERE outcome <> 'inserted' GROUP BY outcome UNION ALL SELECT 'inserted', count(*) FROM i")
def import_stats(spark, sf):
    return C.import_stats(social(spark, sf))


# --- joins ---------------------------------------------------------------------------------------
COMPANY_CSV = define(
    "company_csv_in",
    """
    SELECT c_custkey AS pos, concat('HTTPS://www.firm', c_custkey % 60, '.example.com/about; firm', c_custkey % 7 + 100, '.example.com') AS website,
        CASE WHEN c_custkey % 3 = 0 THEN 'n/a' ELSE concat('ИНН ', lpad(CAST(c_custkey AS STRING), 10, '7')) END AS tax
    FROM {customer}
    """,
)
SITES = define("sites_in", "SELECT event_id, concat('http://firm', event_id % 120, '.example.com/p') AS site FROM {events}")


@query(
    "join_tax_id",
    f"""WITH l AS (SELECT pos, 'firm' || (pos % 60) || '.example.com' AS k, regexp_replace(tax, '[^0-9]', '', 'g') AS id, 1 AS i FROM {sql_of(COMPANY_CSV)}
        UNION ALL SELECT pos, 'firm' || (pos % 7 + 100) || '.example.com', regexp_replace(tax, '[^0-9]', '', 'g'), 2 FROM {sql_of(COMPANY_CSV)}),
    f AS (SELECT k, id FROM l WHERE length(id) IN (10, 12) QUALIFY row_number() OVER (PARTITION BY k ORDER BY pos, i) = 1),
    s AS (SELECT event_id, regexp_extract(site, '//([^/]*)', 1) AS k, event_id % 120 AS n FROM {sql_of(SITES)})
    SELECT event_id, coalesce(id, CASE WHEN n >= 110 THEN lpad(CAST(n AS VARCHAR), 10, '9') END, '') AS tax_id, CASE WHEN id IS NOT NULL THEN 'company_csv' WHEN n >= 110 THEN 'site' ELSE '' END AS tax_id_source
    FROM s LEFT JOIN f ON s.k = f.k""",
)
def join_tax_id(spark, sf):
    sites = bound(spark, sf, SITES)
    own = spark.sql("SELECT DISTINCT concat('firm', event_id % 120, '.example.com') AS site_key, lpad(CAST(event_id % 120 AS STRING), 10, '9') AS tax_id FROM {s} WHERE event_id % 120 >= 110", s=sites)
    return C.attach_tax_id(sites, "site", bound(spark, sf, COMPANY_CSV), "website", "tax", ["pos"], own).select("event_id", "tax_id", "tax_id_source")


@query(
    "join_company_by_domain",
    f"""SELECT pos, c.company FROM {LINKS} l LEFT JOIN (SELECT DISTINCT user_id % 40 AS company FROM events WHERE user_id % 40 < 30) c ON l.site_url = 'https://www.firm' || c.company || '.example.com/'""",
)
def join_company_by_domain(spark, sf):
    return C.join_company(bound(spark, sf, "links_in", costly=True), "site_url", social_companies(spark, sf), "company", "domain").select("pos", "company")


CLAIMS = define(
    "claims_in",
    """
    SELECT o_orderkey AS pos, o_custkey AS firm, concat('https://s', o_orderkey % 50, '.d', (o_orderkey * 7 + o_custkey) % 900, '.com/') AS site FROM {orders}
    """,
)


@query(
    "claim_domains",
    f"""WITH d AS (SELECT *, regexp_extract(site, '(d[0-9]+\\.com)', 1) AS o FROM {sql_of(CLAIMS)} QUALIFY row_number() OVER (PARTITION BY firm, site ORDER BY pos) = 1),
    t AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY firm ORDER BY pos) <= 3),
    s AS (SELECT firm, site, CASE WHEN row_number() OVER (PARTITION BY o ORDER BY firm, pos) = 1 THEN 'queued' ELSE 'skipped' END AS status, o FROM t)
    SELECT firm, site, status, CASE WHEN status = 'queued' THEN '' ELSE 'duplicate_origin_domain=' || o END AS details FROM s
    UNION ALL SELECT DISTINCT firm, '', 'failed', 'no_crawl_targets_after_filtering' FROM s WHERE firm NOT IN (SELECT firm FROM s WHERE status = 'queued')""",
)
def claim_domains(spark, sf):
    df = bound(spark, sf, CLAIMS).withColumn("firm_pos", F.col("firm"))
    return C.claim_domains(df, "firm", "firm_pos", "site", "pos", 3)


@query(
    "attach_firm",
    """SELECT l_orderkey, l_linenumber, l_partkey, s_name AS company_name, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
)
def attach_firm(spark, sf):
    entries = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("site"))
    firms = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("site"), F.col("s_name").alias("company_name"), "s_nationkey")
    return C.attach_firm(entries, firms, "site", ["company_name", "s_nationkey"]).drop("site")


PROBES = define(
    "probes_in",
    """
    SELECT concat('a', o_orderkey, '@d', o_custkey, '.com') AS address, concat('d', o_custkey, '.com') AS domain, concat('mx', try, '.d', o_custkey, '.com') AS host,
        CASE WHEN (o_orderkey + try) % 11 <> 0 THEN 200 + (o_orderkey * 37 + try * 113) % 400 END AS code
    FROM (SELECT o_orderkey, o_custkey, 1 AS try FROM {orders} UNION ALL SELECT o_orderkey, o_custkey, 2 FROM {orders} UNION ALL SELECT o_orderkey, o_custkey, 3 FROM {orders})
    """,
)


@query(
    "join_domain_checks",
    f"""WITH p AS (SELECT *, CAST(host[3] AS INTEGER) AS t, CASE WHEN code IS NULL THEN 'network_error' WHEN code BETWEEN 200 AND 299 THEN 'accepted' WHEN code BETWEEN 500 AND 599 THEN 'rejected' WHEN code BETWEEN 400 AND 499 THEN 'temporary_failure' ELSE 'unknown' END AS r FROM {sql_of(PROBES)}),
    q AS (SELECT *, CASE t WHEN 1 THEN 20 WHEN 2 THEN 10 ELSE 30 END AS pref, CAST(regexp_extract(domain, 'd([0-9]+)', 1) AS BIGINT) AS k FROM p WHERE t < 3),
    b AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY address ORDER BY r NOT IN ('accepted','rejected'), CASE WHEN r IN ('accepted','rejected') THEN pref ELSE -pref END) = 1)
    SELECT address, domain, 'mx2.' || domain || '; mx1.' || domain || '; mx3.' || domain AS mx_hosts, host AS mx_used, code, r AS rcpt_status, CASE WHEN k % 4 = 0 THEN 'accepted' ELSE 'rejected' END AS catch_all_status,
    CASE WHEN r = 'rejected' THEN 'invalid' WHEN r = 'accepted' THEN CASE WHEN k % 4 = 0 THEN 'catch_all' ELSE 'valid_like' END ELSE 'unknown' END AS final_status FROM b""",
)
def join_domain_checks(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("d"), "c_custkey", F.lit(".com")).alias("domain"))
    pairs = F.array(*[F.struct(F.lit(p).alias("preference"), F.concat(F.lit(f"mx{t}."), "domain").alias("host")) for t, p in ((1, 20), (2, 10), (3, 30), (1, 40))])
    mx = c.select("domain", F.inline(pairs))
    catch_all = c.select("domain", F.when(F.col("c_custkey") % 4 == 0, F.lit("accepted")).otherwise(F.lit("rejected")).alias("status"))
    return C.join_domain_checks(bound(spark, sf, PROBES), mx, catch_all)


WEEK_RANGE = "(SELECT date_trunc('week', min(d)) AS lo, max(d) AS hi FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders))"


@query(
    "bucket_by_week",
    f"""SELECT CAST(w AS DATE) AS week, count(d) AS articles FROM (SELECT unnest(range(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 7 DAY)) AS w FROM {WEEK_RANGE})
    LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS d FROM orders) ON d >= w AND d < w + INTERVAL 7 DAY GROUP BY w""",
)
def bucket_by_week(spark, sf):
    return C.bucket_by_week(table(spark, sf, "orders"), "o_orderdate")


@query(
    "titles_by_week",
    f"SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS week FROM orders, {WEEK_RANGE} WHERE date_trunc('week', o_orderdate) < hi",
)
def titles_by_week(spark, sf):
    return C.titles_by_week(table(spark, sf, "orders"), "o_orderdate").select("o_orderkey", "week")


NAV = r"""(SELECT page_id, host, origin, pos, CASE WHEN href = '/' THEN origin || '/' ELSE origin || rtrim(regexp_replace(href, '[?#].*$', ''), '/') END AS url, href FROM
    (SELECT page_id, regexp_extract(url, '//([^/]*)', 1) AS host, regexp_extract(url, '^([a-z]+://[^/]*)', 1) AS origin, unnest(range(len(h))) AS pos, unnest(h) AS href FROM
    (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages)))"""
HINTS = ("contact", "service", "the", "re")


def frontier_sql(kept: str) -> str:
    return rf"""WITH g AS (SELECT regexp_extract(host, '([a-z]+\.[a-z]+)$', 1) AS site, url, CAST(list_sum(list_transform({list_sql(HINTS)}, lambda h: CASE WHEN contains(lower(url_decode(url)), h) THEN 1 ELSE 0 END)) AS INTEGER) AS priority, page_id, pos FROM {NAV}),
    v AS (SELECT regexp_extract(url, '//[^/]*?([a-z]+\.[a-z]+)/', 1) AS site, regexp_replace(url, '[#?].*$', '') AS url FROM pages),
    f AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY site, url ORDER BY page_id, pos) = 1),
    n AS (SELECT f.* FROM f ANTI JOIN v ON f.site = v.site AND f.url = v.url),
    r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY priority DESC, page_id, pos) AS rank FROM n)
    SELECT r.site, r.url, r.priority, r.rank FROM r LEFT JOIN (SELECT site, count(DISTINCT url) AS c FROM v GROUP BY site) s ON r.site = s.site WHERE {kept}"""


def frontier_links(spark, sf):
    from sitefacts.checks.urls import hrefs

    links = O.with_origin_domain(O.with_url_host(hrefs(spark, sf), "url"), "host", "site")
    links = O.with_internal_url(links, "href", "url", "site", "link").filter("link IS NOT NULL")
    links = O.with_link_priority(links.withColumn("anchor", F.lit("")), "link", "anchor", hints=HINTS)
    links = links.select("site", F.col("link").alias("url"), "priority", "page_id", "pos")
    seen = O.with_origin_domain(O.with_url_host(table(spark, sf, "pages"), "url"), "host", "site").select("site", F.regexp_replace("url", "[#?].*$", "").alias("url"))
    return seen, links


@query("frontier", frontier_sql("true"))
def frontier(spark, sf):
    seen, links = frontier_links(spark, sf)
    return C.crawl_frontier(seen, links, "site", "url", "priority", ["page_id", "pos"]).select("site", "url", "priority", "rank")


@query("frontier_capped", frontier_sql("rank + coalesce(c, 0) <= (SELECT max(n) + 50 FROM (SELECT count(DISTINCT url) AS n FROM v GROUP BY site))"))
def frontier_capped(spark, sf):
    """The cap is a top-k per site, 50 above the pages that the most visited site has."""
    seen, links = frontier_links(spark, sf)
    most = seen.distinct().groupBy("site").count().agg(F.max("count")).first()[0]
    return C.crawl_frontier(seen, links, "site", "url", "priority", ["page_id", "pos"], most + 50).select("site", "url", "priority", "rank")
