"""Queries over URL columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitefacts import vocab
from sitefacts.bindings import bound, sql_of, table
from sitefacts.checks.base import (
    FORCED_SQL, HTTP_SQL, NETLOC_SQL, QUERY_SQL, USABLE_SQL, list_sql, origin_sql, parts_sql, query, under_sql,
)
from sitefacts.operators import urls as O

URLS = sql_of("urls_in")
LINKS = sql_of("links_in")


@query(
    "normalize_site",
    f"""WITH {parts_sql(URLS)} SELECT page_id,
    CASE WHEN scheme IN ('http','https') AND host <> '' THEN 'https://' || host || '/' ELSE '' END AS site,
    CASE WHEN scheme IN ('http','https') AND host <> '' THEN 'https://' || host || '/' END AS homepage,
    CASE WHEN {USABLE_SQL} THEN {FORCED_SQL} || '://' || {NETLOC_SQL} || '/' END AS origin FROM p""",
)
def normalize_site(spark, sf):
    df = bound(spark, sf, "urls_in")
    df = O.with_site_origin(df, "url")
    df = O.with_site_origin(df, "url", "homepage", "homepage")
    return O.with_site_origin(df, "url", "origin", "origin").select("page_id", "site", "homepage", "origin")


@query("normalize_http_url", f"WITH {parts_sql(URLS, default_scheme=False)} SELECT page_id, {HTTP_SQL} AS http_url FROM p")
def normalize_http_url(spark, sf):
    return O.with_http_url(bound(spark, sf, "urls_in"), "url").select("page_id", "http_url")


@query(
    "normalize_site_url",
    f"""WITH {parts_sql(URLS)}, {parts_sql(URLS, default_scheme=False, tag="q")}
    SELECT p.page_id, CASE WHEN {USABLE_SQL.replace("scheme", "p.scheme").replace("host", "p.host").replace("port_ok", "p.port_ok")}
        THEN p.forced || '://' || p.shown || p.clean END AS crawl_url, k.kept AS kept_url
    FROM (SELECT *, {FORCED_SQL} AS forced, {NETLOC_SQL} AS shown FROM p) p
    JOIN (SELECT page_id, CASE WHEN scheme IN ('http','https') AND host <> '' AND port_ok
        THEN scheme || '://' || {NETLOC_SQL} || clean END AS kept FROM q) k ON p.page_id = k.page_id""",
)
def normalize_site_url(spark, sf):
    df = O.with_crawl_url(bound(spark, sf, "urls_in"), "url")
    return O.with_crawl_url(df, "url", "kept_url", keep_scheme=True).select("page_id", "crawl_url", "kept_url")


@query(
    "normalize_start_url",
    f"""WITH {parts_sql(URLS)}, e AS (SELECT *, CASE WHEN u = '' THEN 'Empty URL'
        WHEN scheme NOT IN ('http','https') OR netloc = '' THEN 'Invalid URL: ' || url
        WHEN {under_sql("host", "reg.ru")} THEN 'Blocked host for crawl: ' || hostname END AS error FROM p)
    SELECT page_id, error, CASE WHEN error IS NULL THEN scheme || '://' || netloc ||
        CASE WHEN path = '' THEN '/' ELSE path END END AS start_url FROM e""",
)
def normalize_start_url(spark, sf):
    return O.with_start_url(bound(spark, sf, "urls_in"), "url").select("page_id", "start_url", "error")


HREFS = "(SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages)"


def hrefs(spark, sf):
    found = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, sf, "pages").select("page_id", "url", F.posexplode(found).alias("pos", "href"))


@query(
    "normalize_internal_url",
    f"""WITH {parts_sql(HREFS)}, o AS (SELECT *, {origin_sql("host")} AS origin FROM p),
    f AS (SELECT page_id, href, origin, netloc, regexp_replace(lower(netloc), '^www\\.', '') AS server, scheme,
        regexp_extract(regexp_replace(href, '#.*$', ''), '^([^?]*)', 1) AS hp,
        regexp_extract(regexp_replace(href, '#.*$', ''), '(\\?.*)$', 1) AS hq FROM o)
    SELECT page_id, href, CASE WHEN href <> '' AND (server = origin OR ends_with(server, '.' || origin))
        AND NOT regexp_matches(lower(hp), '(?:{"|".join(e.replace(".", chr(92) + ".") for e in vocab.BINARY_EXTENSIONS)})$')
        THEN scheme || '://' || netloc || CASE WHEN length(hp) > 1 THEN regexp_replace(hp, '/+$', '') ELSE hp END ||
        CASE WHEN hq <> '?' THEN hq ELSE '' END END AS internal_url FROM f""",
)
def normalize_internal_url(spark, sf):
    df = O.with_url_host(hrefs(spark, sf), "url")
    df = O.with_origin_domain(df, "host")
    return O.with_internal_url(df, "href", "url", "origin_domain").select("page_id", "href", "internal_url")


@query(
    "site_key",
    f"WITH {parts_sql(URLS)} SELECT page_id, CASE WHEN scheme IN ('http','https') THEN host ELSE '' END AS site_key FROM p",
)
def site_key(spark, sf):
    return O.with_site_key(bound(spark, sf, "urls_in"), "url").select("page_id", "site_key")


MAILS = """(SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN '<info@WWW.' || regexp_extract(url, '//([^/]*)', 1) || '>'
    ELSE ' ' || upper(regexp_extract(url, '//(.*)$', 1)) || ' ' END AS raw, url FROM pages)"""


@query(
    "normalize_domain",
    f"""WITH {parts_sql(MAILS)}, m AS (SELECT *, regexp_replace(regexp_replace(trim(raw), '^[<(]+', ''), '[>)]+$', '') AS v FROM p),
    n AS (SELECT *, CASE WHEN contains(v, '://') THEN regexp_extract(v, '://([^/?#:]*)', 1)
        ELSE regexp_extract(CASE WHEN contains(v, '@') THEN regexp_extract(v, '@([^@]*)$', 1) ELSE v END, '^([^/?:]*)', 1) END AS h FROM m),
    o AS (SELECT *, regexp_replace(trim(lower(h), '.'), '^www\\.', '') AS mail FROM n)
    SELECT page_id, host AS domain, CASE WHEN contains(mail, '.') AND NOT regexp_matches(mail, '\\s') THEN mail ELSE '' END AS mail_domain FROM o""",
)
def normalize_domain(spark, sf):
    raw = """SELECT page_id, url, CASE page_id % 3 WHEN 0 THEN url
        WHEN 1 THEN concat('<info@WWW.', substring_index(substring_index(url, '/', 3), '/', -1), '>')
        ELSE concat(' ', upper(substring_index(url, '//', -1)), ' ') END AS raw FROM {pages}"""
    df = spark.sql(raw, pages=table(spark, sf, "pages"))
    df = O.with_domain(df, "url")
    return O.with_domain(df, "raw", "mail_domain", "mail").select("page_id", "domain", "mail_domain")


@query(
    "domain_keys",
    f"WITH {parts_sql(URLS)} SELECT page_id, rtrim(host, '.') AS domain_key FROM p WHERE host <> ''",
)
def domain_keys(spark, sf):
    return O.explode_domain_keys(bound(spark, sf, "urls_in"), "url").select("page_id", "domain_key")


@query(
    "normalize_host",
    r"""SELECT page_id, regexp_replace(lower(regexp_extract(url, '//([^/]*)', 1)), '^www\.', '') AS host FROM pages""",
)
def normalize_host(spark, sf):
    df = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "//([^/]*)", 1).alias("raw"))
    return O.with_host(df, "raw").select("page_id", "host")


@query("origin_domain", f"WITH {parts_sql(URLS)} SELECT page_id, host, {origin_sql('host')} AS origin_domain FROM p")
def origin_domain(spark, sf):
    df = O.with_url_host(bound(spark, sf, "urls_in"), "url")
    return O.with_origin_domain(df, "host").select("page_id", "host", "origin_domain")


@query(
    "is_internal",
    f"""WITH {parts_sql(LINKS, "raw_url", default_scheme=False)},
    s AS (SELECT *, regexp_replace(regexp_extract(site_url, '//([^/]*)', 1), '^www\\.', '') AS sh FROM p),
    o AS (SELECT *, {origin_sql("sh")} AS own FROM s)
    SELECT pos, host <> '' AND (host = own OR ends_with(host, '.' || own)) AS is_internal,
        host <> '' AND (host = sh OR ends_with(host, '.' || sh)) AS is_own FROM o""",
)
def is_internal(spark, sf):
    df = O.with_internal_flag(bound(spark, sf, "links_in", costly=True), "raw_url", "site_url")
    return O.with_internal_flag(df, "raw_url", "site_url", "is_own", exact=True).select("pos", "is_internal", "is_own")


def host_lists(spark):
    rows = [(d, i, n) for i, (n, ds) in enumerate((("video", vocab.VIDEO_HOSTS), ("social", vocab.SOCIAL_HOSTS))) for d in ds]
    return spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, rows)) + " AS t(domain, priority, name)")


@query(
    "host_in_domains",
    f"""WITH {parts_sql(LINKS, "raw_url")} SELECT pos, host, CASE WHEN {under_sql("host", *vocab.VIDEO_HOSTS)} THEN 'video'
    WHEN {under_sql("host", *vocab.SOCIAL_HOSTS)} THEN 'social' END AS list_name FROM p""",
)
def host_in_domains(spark, sf):
    df = O.with_url_host(bound(spark, sf, "links_in", costly=True), "raw_url")
    return O.match_domain_list(df, "host", host_lists(spark)).select("pos", "host", "list_name")


PLATFORM = f"""CASE WHEN {under_sql("host", *vocab.VIDEO_HOSTS)} THEN 'video_hosting' WHEN {under_sql("host", "drive2.ru")} THEN 'drive2'
    WHEN {under_sql("host", *vocab.SOCIAL_HOSTS)} THEN 'social_network' END"""


@query("classify_platform", f"""WITH {parts_sql(LINKS, "raw_url")} SELECT pos, {PLATFORM} AS platform FROM p""")
def classify_platform(spark, sf):
    return O.with_platform_kind(bound(spark, sf, "links_in", costly=True), "raw_url").select("pos", "platform")


HH = f"""CASE WHEN {under_sql("host", "hh.ru")} AND starts_with(path, '/employer') THEN 'https://' || host || rtrim(path, '/') ||
    coalesce(NULLIF('?' || replace(array_to_string(list_filter(string_split(query, '&'),
    lambda x: x <> '' AND NOT regexp_matches(x, '^utm_(campaign|content|medium|source)=')), '&'), '%20', '+'), '?'), '') END"""
TG = f"CASE WHEN host IN ('t.me','telegram.me') AND rtrim(path,'/') <> '' THEN 'https://' || host || rtrim(path,'/') || {QUERY_SQL} END"
SEGMENT = "lower(regexp_extract(path, '^/*([^/]*)', 1))"
MAX = f"""CASE WHEN {under_sql("host", "max.ru")} AND ({SEGMENT} IN ('channel','channels','c') OR starts_with({SEGMENT}, '@'))
    THEN 'https://' || host || rtrim(path,'/') || {QUERY_SQL} END"""
DZEN = f"""CASE WHEN {under_sql("host", "dzen.ru")} AND rtrim(path,'/') <> '' THEN 'https://' || host || rtrim(path,'/') || {QUERY_SQL} END"""
TG_STRICT = TG.replace("<> ''", f"<> '' AND {SEGMENT} NOT IN ('share','socks','proxy','login','iv','addstickers','setlanguage','invoice')", 1)
HANDLE = "regexp_replace(regexp_extract(path, '^/*([^/]*)', 1), '^@+', '')"
INSTA_OK = f"regexp_full_match({HANDLE}, '[A-Za-z0-9._]{{1,30}}') AND NOT list_contains({list_sql(vocab.INSTAGRAM_SERVICE_PATHS)}, lower({HANDLE}))"


@query(
    "canonical_profile_urls",
    f"""WITH {parts_sql(LINKS, "raw_url")} SELECT pos, {HH} AS hh_url, {TG} AS telegram_url, {TG_STRICT} AS telegram_profile_url,
    {MAX} AS max_url, {DZEN} AS dzen_url,
    CASE WHEN host IN ('instagram.com','instagr.am') AND {INSTA_OK} THEN 'https://www.instagram.com/' || {HANDLE} || '/' END AS instagram_url FROM p""",
)
def canonical_profile_urls(spark, sf):
    df = bound(spark, sf, "links_in", costly=True)
    df = O.canonical_profile_url(df, "raw_url", ("hh", "telegram", "max", "dzen", "instagram"))
    df = O.canonical_profile_url(df, "raw_url", "telegram", "telegram_profile_url", reject_service=True)
    return df.drop("firm_id", "site_url", "raw_url")


@query(
    "profile_handles",
    f"""WITH {parts_sql(LINKS, "raw_url")}, s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg FROM p),
    t AS (SELECT *, CASE WHEN {INSTA_OK} THEN {HANDLE} END AS instagram_handle,
        regexp_replace(CASE WHEN lower(seg[1]) = 's' THEN seg[2]
        WHEN lower(seg[1]) NOT IN ('joinchat','share','socks','proxy','login','iv','addstickers','setlanguage','invoice')
            AND NOT starts_with(seg[1], '+') THEN seg[1] END, '^@+', '') AS h FROM s),
    v AS (SELECT *, CASE WHEN regexp_full_match(h, '[A-Za-z0-9_]{{3,64}}') THEN h END AS telegram_handle FROM t)
    SELECT pos, instagram_handle, telegram_handle, 'https://web.telegram.org/k/#@' || telegram_handle AS web_url FROM v""",
)
def profile_handles(spark, sf):
    df = O.profile_handle(bound(spark, sf, "links_in", costly=True), "raw_url", "instagram", "instagram_handle")
    df = O.profile_handle(df, "raw_url", "telegram", "telegram_handle")
    return df.select("pos", "instagram_handle", "telegram_handle", "web_url")


KINDS = f"""{parts_sql(LINKS, "raw_url")}, {parts_sql(LINKS, "raw_url", default_scheme=False, tag="q")},
    c AS (SELECT p.*, {HH} AS hh_url, {MAX} AS max_url, {TG} AS tg_url, {DZEN} AS dzen_url, {PLATFORM} AS platform FROM p),
    h AS (SELECT pos, {HTTP_SQL} AS http_url FROM q),
    d AS (SELECT c.*, h.http_url, CASE WHEN hh_url IS NOT NULL THEN 'hh' WHEN max_url IS NOT NULL THEN 'max'
        WHEN tg_url IS NOT NULL THEN 'telegram' WHEN dzen_url IS NOT NULL THEN 'dzen' WHEN http_url IS NULL THEN NULL
        WHEN platform = 'drive2' THEN 'drive2' WHEN platform = 'video_hosting' THEN 'video'
        WHEN platform = 'social_network' THEN 'social' END AS kind FROM c JOIN h ON c.pos = h.pos),
    kinds AS (SELECT *, CASE WHEN kind IS NOT NULL THEN coalesce(hh_url, max_url, tg_url, dzen_url, http_url) END AS link_url,
        CASE WHEN kind IS NOT NULL THEN host END AS link_host FROM d)"""


@query("classify_social_link", f"WITH {KINDS} SELECT pos, kind, link_url, link_host FROM kinds")
def classify_social_link(spark, sf):
    return O.with_link_kind(bound(spark, sf, "links_in", costly=True), "raw_url").select("pos", "kind", "link_url", "link_host")


FIELD = f"""CASE WHEN {under_sql("host", "hh.ru")} THEN 'hh_profile' WHEN host IN ('t.me','telegram.me') THEN 'tg_profile'
    WHEN {under_sql("host", "max.ru")} THEN 'max_profile' WHEN {under_sql("host", "vk.com")} THEN 'vk_profile'
    WHEN {under_sql("host", "dzen.ru")} OR host = 'zen.yandex.ru' THEN 'dzen_profile' WHEN {under_sql("host", "rutube.ru")} THEN 'rutube_profile'
    WHEN {under_sql("host", "instagram.com")} THEN 'instagram_profile'
    WHEN {under_sql("host", "youtube.com")} OR host = 'youtu.be' THEN 'youtube_profile' END"""
SHARE = """(hostname = 'drive2.ru' OR ends_with(hostname, '.drive2.ru')
    OR (hostname IN ('t.me','telegram.me','vk.com') AND starts_with(path, '/share'))
    OR (hostname IN ('x.com','twitter.com') AND starts_with(path, '/intent')))"""


@query("social_field", f"""WITH {parts_sql(LINKS, "raw_url")} SELECT pos, {FIELD} AS field FROM p""")
def social_field(spark, sf):
    return O.with_social_field(bound(spark, sf, "links_in", costly=True), "raw_url").select("pos", "field")


@query(
    "drop_share_links",
    f"""WITH {parts_sql(LINKS, "raw_url", default_scheme=False)} SELECT pos, raw_url FROM p WHERE NOT {SHARE}""",
)
def drop_share_links(spark, sf):
    return O.drop_share_links(bound(spark, sf, "links_in", costly=True), "raw_url").select("pos", "raw_url")


@query(
    "valid_port",
    f"WITH {parts_sql(URLS, default_scheme=False)} SELECT page_id, url FROM p WHERE scheme NOT IN ('http','https') OR port_ok",
)
def valid_port(spark, sf):
    return O.filter_valid_port(bound(spark, sf, "urls_in"), "url").select("page_id", "url")


FQDN_IN = """(SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN lower(c_mktsegment) || '.example.com'
    WHEN 1 THEN '-' || c_custkey || '.example.com' WHEN 2 THEN 'Shop' || c_custkey || '.RU.' WHEN 3 THEN 'single' || c_custkey
    WHEN 4 THEN repeat('a', 60 + CAST(c_custkey % 9 AS INT)) || '.org' ELSE 'a..b' || c_custkey || '.io' END AS host FROM customer)"""


@query(
    "valid_fqdn",
    f"""WITH n AS (SELECT c_custkey, host, rtrim(lower(trim(host)), '.') AS h FROM {FQDN_IN}) SELECT c_custkey, host FROM n
    WHERE length(h) <= 253 AND len(string_split(h, '.')) >= 2 AND length(string_split(h, '.')[-1]) >= 2
    AND len(list_filter(string_split(h, '.'), lambda l: NOT regexp_full_match(l, '[a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?'))) = 0""",
)
def valid_fqdn(spark, sf):
    sql = FQDN_IN.strip("()").replace("FROM customer", "FROM {customer}") 
    return O.filter_valid_fqdn(spark.sql(sql, customer=table(spark, sf, "customer")), "host")


@query(
    "display_host",
    f"""WITH {parts_sql(URLS)} SELECT page_id, CASE WHEN hostname = '' THEN url ELSE scheme || '://' ||
    CASE WHEN port_ok AND port IS NOT NULL AND port <> 0 THEN hostname || ':' || port ELSE hostname END ||
    CASE WHEN path = '' THEN '/' ELSE path END || {QUERY_SQL} END AS display_url,
    regexp_replace(regexp_replace(regexp_extract(lower(landed_url), '^[a-z]+://([^/?#:]*)', 1), '^www\\.', ''), '[^\\p{{L}}\\p{{N}}_.-]', '_', 'g') AS slug FROM p""",
)
def display_host(spark, sf):
    df = O.with_display_url(bound(spark, sf, "urls_in"), "url")
    return O.with_domain_slug(df, "landed_url").select("page_id", "display_url", "slug")


ANCHORS = "(SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)', 1)) AS href, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)', 2)) AS label FROM pages)"


@query(
    "link_priority",
    f"""SELECT page_id, href, CAST(list_sum(list_transform({list_sql(vocab.CRAWL_HINTS + ("the", "re", "ion"))}, lambda h:
    CASE WHEN contains(translate(lower(url_decode(href) || ' ' || label), 'ё', 'е'), h) THEN 1 ELSE 0 END)) AS INTEGER) AS priority FROM {ANCHORS}""",
)
def link_priority(spark, sf):
    pattern = F.lit('<a href="([^"]*)">([^<]*)')
    pairs = F.arrays_zip(
        F.regexp_extract_all("html", pattern, F.lit(1)).alias("href"),
        F.regexp_extract_all("html", pattern, F.lit(2)).alias("label"),
    )
    df = table(spark, sf, "pages").select("page_id", F.inline(pairs).alias("href", "label"))
    hints = vocab.CRAWL_HINTS + ("the", "re", "ion")
    return O.with_link_priority(df, "href", "label", hints=hints).select("page_id", "href", "priority")


@query(
    "url_booking_hint",
    f"""WITH {parts_sql(LINKS, "raw_url", default_scheme=False)}, h AS (SELECT pos, lower(regexp_extract({HTTP_SQL}, '^[a-z]+://(.*)$', 1)) AS t FROM p)
    SELECT pos, coalesce(regexp_matches(t, '{"|".join(vocab.BOOKING_URL_HINTS)}'), false) AS booking_hint FROM h""",
)
def url_booking_hint(spark, sf):
    return O.with_booking_hint(bound(spark, sf, "links_in", costly=True), "raw_url").select("pos", "booking_hint")


SITES = """(SELECT page_id, origin AS firm, CASE page_id % 4 WHEN 0 THEN replace(url, 'http://', 'https://') WHEN 1 THEN site
    WHEN 2 THEN replace(url, '.example.', '.example:8080.') ELSE url END AS url FROM (SELECT page_id, url,
    regexp_extract(url, '^([a-z]+://[^/]*)', 1) || '/' AS site, regexp_extract(url, '(example\\.[a-z]+)', 1) AS origin FROM pages))"""


@query(
    "prefer_site",
    f"""WITH {parts_sql(SITES)}, s AS (SELECT *, CASE WHEN path = '' THEN '/' ELSE path END AS pp FROM p)
    SELECT firm, hostname AS site_host, url, page_id FROM s WHERE hostname <> '' QUALIFY row_number() OVER (PARTITION BY firm, hostname
    ORDER BY scheme <> 'https', pp <> '/', port IS NOT NULL, length(pp), page_id) = 1""",
)
def prefer_site(spark, sf):
    sql = """SELECT page_id, regexp_extract(url, '(example\\\\.[a-z]+)', 1) AS firm, CASE page_id % 4
        WHEN 0 THEN replace(url, 'http://', 'https://') WHEN 1 THEN concat(substring_index(url, '/', 3), '/')
        WHEN 2 THEN replace(url, '.example.', '.example:8080.') ELSE url END AS url FROM {pages}"""
    df = spark.sql(sql, pages=table(spark, sf, "pages"))
    return O.best_site_per_host(df, "firm", "url", "page_id").select("firm", "site_host", "url", "page_id")


VALUES_IN = "(SELECT p_partkey, p_name || ' ; ' || p_brand || ',,' || p_type || '; ' AS cell FROM part)"


@query(
    "split_values",
    rf"""SELECT p_partkey, v AS value FROM (SELECT p_partkey, unnest(list_transform(regexp_split_to_array(cell, '[;,]'), lambda x: trim(x))) AS v FROM {VALUES_IN}) WHERE v <> ''""",
)
def split_values(spark, sf):
    df = spark.sql(VALUES_IN.strip("()").replace("FROM part", "FROM {part}"), part=table(spark, sf, "part"))
    return O.explode_values(df, "cell").select("p_partkey", "value")


TAX_IN = """(SELECT c_custkey, 'ИНН ' || CASE c_custkey % 4 WHEN 0 THEN lpad(CAST(c_custkey * 7919 AS STRING), 10, '7')
    WHEN 1 THEN lpad(CAST(c_custkey * 104729 AS STRING), 12, '5') WHEN 2 THEN lpad(CAST(c_custkey AS STRING), 11, '3')
    ELSE '77 01-' || lpad(CAST(c_custkey AS STRING), 6, '0') END AS raw FROM customer)"""


@query(
    "normalize_inn",
    f"""SELECT c_custkey, CASE WHEN length(d) IN (10, 12) THEN d ELSE '' END AS tax_id FROM
    (SELECT c_custkey, regexp_replace(raw, '[^0-9]', '', 'g') AS d FROM {TAX_IN})""",
)
def normalize_inn(spark, sf):
    df = spark.sql(TAX_IN.strip("()").replace("FROM customer", "FROM {customer}").replace("STRING), 10", "STRING), 10"), customer=table(spark, sf, "customer"))
    return O.with_tax_id(df, "raw").select("c_custkey", "tax_id")


REDIRECTS = """SELECT DISTINCT raw_url AS url, CASE WHEN contains(raw_url, 'dzen') THEN 'https://reg.ru/parked'
    WHEN contains(raw_url, 'hh.ru') THEN concat(raw_url, '&seen=1') ELSE replace(raw_url, 'www.', 'm.') END AS target
    FROM {links} WHERE contains(raw_url, 'www') OR contains(raw_url, 'dzen') OR contains(raw_url, 'hh.ru') OR contains(raw_url, 'clck.ru/1')"""
SHORTENED = "SELECT pos, CASE WHEN pos % 20 = 18 THEN concat('https://clck.ru/', pos % 30) ELSE raw_url END AS raw_url FROM {links}"


@query(
    "apply_redirects",
    f"""WITH links AS ({SHORTENED.format(links=LINKS)}), r AS ({REDIRECTS.format(links="links")}), {parts_sql("r", "target", tag="t")}
    SELECT l.pos, l.raw_url, coalesce(t.target, l.raw_url) AS resolved_url FROM links l LEFT JOIN t ON l.raw_url = t.url
    WHERE NOT (contains(l.raw_url, '//clck.ru/') AND t.target IS NULL) AND NOT coalesce({under_sql("t.host", "reg.ru")}, false)
    AND NOT (contains(l.raw_url, '//clck.ru/') AND coalesce({under_sql("t.host", "clck.ru")}, false))""",
)
def apply_redirects(spark, sf):
    links = spark.sql(SHORTENED, links=bound(spark, sf, "links_in", costly=True))
    lookup = spark.sql(REDIRECTS, links=links)
    return O.apply_redirects(links, "raw_url", lookup).select("pos", "raw_url", "resolved_url")
