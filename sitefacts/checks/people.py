"""Queries over members, matches, candidates, summaries, ordered rows and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitefacts import vocab
from sitefacts.bindings import bound, define, spread, sql_of, table
from sitefacts.checks.base import ORACLES, list_sql, origin_sql, query
from sitefacts.checks.extract import CARD_TAGS, PRICE_TAGS, PRICED, PRICES, cards, evidence, page_items
from sitefacts.checks.pages import EXTERNAL, FOOTER, PAGES, ANY_PHONE, block_sql, externals, visible_sql
from sitefacts.operators import aggregate as A
from sitefacts.operators import candidates as N
from sitefacts.operators import companies as C
from sitefacts.operators import people as M
from sitefacts.operators import prices as R
from sitefacts.operators.booking import ELEMENT_TAGS, booking_features
from sitefacts.operators.cells import cell_parts, numbered_values
from sitefacts.operators.pages import FOOTER_TAGS, extract_contacts
from sitefacts.operators.staff import extract_specialists
from sitefacts.plans.site_profile import site_profile as profile_job
from sitefacts.session import land, work_path
from sitefacts.streaming import jobs as J

# --- the flagship --------------------------------------------------------------------------------
HOSTED = r"(SELECT *, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1), '^www\.', '') AS host FROM pages)"
HREFS = "list_filter(regexp_extract_all(html, '<a [^>]*?href=\"([^\"]*)\"', 1), lambda h: h <> '')"
PB, FB = block_sql("pt", ANY_PHONE, True), block_sql("ft", ANY_PHONE, True)


@query(
    "site_profile",
    f"""WITH t AS (SELECT page_id, {origin_sql("host")} AS site, len({HREFS}) AS n, {FOOTER} AS ft, {visible_sql("html")} AS pt FROM {HOSTED}),
    c AS (SELECT page_id, site, n, CASE WHEN len({FB['phones']}) + len({FB['emails']}) > 0 THEN {FB['phones']} ELSE {PB['phones']} END AS p,
        CASE WHEN len({FB['phones']}) + len({FB['emails']}) > 0 THEN {FB['emails']} ELSE {PB['emails']} END AS e FROM t),
    v AS (SELECT site, k, v, min((page_id, i)) AS o FROM (SELECT site, page_id, 'p' AS k, unnest(range(len(p))) AS i, unnest(p) AS v FROM c UNION ALL SELECT site, page_id, 'e', unnest(range(len(e))), unnest(e) FROM c) GROUP BY ALL)
    SELECT a.site, a.pages, a.internal_links, a.external_links, a.pages_with_contacts,
    (SELECT string_agg(v, '; ' ORDER BY o) FROM v WHERE v.site = a.site AND k = 'p') AS phones, (SELECT string_agg(v, '; ' ORDER BY o) FROM v WHERE v.site = a.site AND k = 'e') AS emails
    FROM (SELECT site, count(*) AS pages, CAST(sum(n) AS BIGINT) AS internal_links, CAST(0 AS BIGINT) AS external_links, count(*) FILTER (WHERE len(p) + len(e) > 0) AS pages_with_contacts FROM c GROUP BY site) a""",
)
def site_profile(spark, sf):
    return profile_job(spread(table(spark, sf, "pages")), phone_pattern=ANY_PHONE, likely_only=True)


# --- distinct and first values -------------------------------------------------------------------
@query(
    "unique_values",
    """SELECT p_type, value, p_partkey FROM (SELECT p_type, p_partkey, trim(CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END) AS value FROM part)
    QUALIFY row_number() OVER (PARTITION BY p_type, lower(value) ORDER BY p_partkey) = 1""",
)
def unique_values(spark, sf):
    df = spark.sql("SELECT p_type, p_partkey, concat(' ', CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END, '  ') AS raw FROM {part}", part=table(spark, sf, "part"))
    return C.ordered_distinct(df, ["p_type"], "raw", ["p_partkey"])


CELLS = define(
    "contact_cells_in",
    """
    SELECT source AS domain, doc_id AS pos, concat('https://x/', doc_id) AS source_url, CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE lang END AS source_scope,
        CASE WHEN doc_id % 9 = 0 THEN concat(lpad(CAST(doc_id % 50 AS STRING), 10, '7'), '; ') ELSE '' END AS inn, '' AS ogrn, '' AS ogrnip,
        concat('+7', doc_id % 30, ' ;; +7', doc_id % 20) AS phones, concat(CASE WHEN doc_id % 2 = 0 THEN 'Info' ELSE 'info' END, doc_id % 15, '@x.com') AS emails
    FROM {documents}
    """,
)


@query(
    "merge_contact_field",
    f"""WITH v AS (SELECT domain, f, trim(v) AS v, pos, i FROM (SELECT domain, pos, f, unnest(range(len(x))) AS i, unnest(x) AS v FROM
        (SELECT domain, pos, unnest(['inn','phones','emails']) AS f, string_split(unnest([inn, phones, emails]), ';') AS x FROM {sql_of(CELLS)})) WHERE trim(v) <> ''),
    d AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY domain, f, lower(v) ORDER BY pos, i) = 1)
    SELECT domain, string_agg(v, '; ' ORDER BY pos, i) FILTER (WHERE f = 'inn') AS inn, NULL::VARCHAR AS ogrn, NULL::VARCHAR AS ogrnip,
    string_agg(v, '; ' ORDER BY pos, i) FILTER (WHERE f = 'phones') AS phones, string_agg(v, '; ' ORDER BY pos, i) FILTER (WHERE f = 'emails') AS emails FROM d GROUP BY domain""",
)
def merge_contact_field(spark, sf):
    return C.merge_contacts(bound(spark, sf, CELLS), "domain", C.CONTACT_CELLS, ["pos"])


CONTACT_VALUES = f"""SELECT domain, f, v, row_number() OVER (PARTITION BY domain, f ORDER BY pos, i) AS n FROM (
    SELECT * FROM (SELECT domain, f, trim(v) AS v, pos, i FROM (SELECT domain, pos, f, unnest(range(len(x))) AS i, unnest(x) AS v FROM
        (SELECT domain, pos, unnest(['inn','phones','emails']) AS f, string_split(unnest([inn, phones, emails]), ';') AS x FROM {sql_of(CELLS)})) WHERE trim(v) <> '')
    QUALIFY row_number() OVER (PARTITION BY domain, f, lower(v) ORDER BY pos, i) = 1)"""


@query("contact_values", f"SELECT domain, f AS field, n AS value_no, v AS value FROM ({CONTACT_VALUES})")
def contact_values(spark, sf):
    rows = C.contact_values(bound(spark, sf, CELLS), "domain", C.CONTACT_CELLS, ["pos"])
    return numbered_values(rows, ["domain", "field"], [F.col("pos"), F.col("value_pos")]).select("domain", "field", "value_no", "value")


@query("contact_parts", f"SELECT domain, f AS field, (n - 1) // 4 + 1 AS part, string_agg(v, '; ' ORDER BY n) AS cell FROM ({CONTACT_VALUES}) GROUP BY ALL")
def contact_parts(spark, sf):
    rows = C.contact_values(bound(spark, sf, CELLS), "domain", C.CONTACT_CELLS, ["pos"])
    return cell_parts(rows, ["domain", "field"], [F.col("pos"), F.col("value_pos")], "value", "cell", 4)


@query(
    "first_non_empty",
    f"""SELECT domain, arg_min(source_url, pos) AS source_url, arg_min(source_scope, pos) FILTER (WHERE trim(source_scope) <> '') AS source_scope FROM {sql_of(CELLS)} GROUP BY domain""",
)
def first_non_empty(spark, sf):
    return C.first_non_empty(bound(spark, sf, CELLS), ["domain"], ["source_url", "source_scope"], ["pos"])


MEMBERS = define(
    "members_in",
    """
    SELECT event_id AS pos, user_id AS peer_id, CASE WHEN event_type = 'view' THEN '' ELSE concat('Name ', event_type) END AS member_name,
        CASE WHEN event_id % 5 = 0 AND user_id % 3 <> 0 THEN concat('user_', user_id) ELSE '' END AS member_username, CASE WHEN event_id % 7 = 0 THEN concat('https://t.me/own', event_id) END AS member_public_url,
        '' AS member_web_public_url, event_type AS member_status, CASE WHEN value > 30 THEN 'admin' ELSE '' END AS member_role, '' AS member_is_admin
    FROM {events}
    """,
)


@query(
    "collapse_members",
    f"""WITH m AS (SELECT peer_id, {', '.join(f"coalesce(arg_min({c}, pos) FILTER (WHERE {c} <> ''), '') AS {c}" for c in A.MEMBER_FIELDS)} FROM {sql_of(MEMBERS)} GROUP BY peer_id)
    SELECT * REPLACE (CASE WHEN member_public_url = '' AND member_username <> '' THEN 'https://t.me/' || member_username ELSE member_public_url END AS member_public_url,
    CASE WHEN member_web_public_url = '' AND member_username <> '' THEN 'https://web.telegram.org/k/#@' || member_username ELSE member_web_public_url END AS member_web_public_url) FROM m""",
)
def collapse_members(spark, sf):
    return A.collapse_members(bound(spark, sf, MEMBERS))


@query(
    "group_by_type",
    """SELECT user_id, event_type AS type, string_agg(CAST(event_id AS VARCHAR) || coalesce(':' || CASE WHEN event_id % 2 = 0 THEN props END, ':'), ', ' ORDER BY event_id) AS entries FROM events GROUP BY ALL""",
)
def group_by_type(spark, sf):
    df = table(spark, sf, "events").select("user_id", F.col("event_type").alias("type"), "event_id", F.col("event_id").cast("string").alias("value"), F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("label"))
    grouped = A.contacts_by_type(df, "user_id", pos="event_id")
    rows = grouped.select("user_id", F.explode("contacts").alias("type", "_l"))
    text = F.transform("_l", lambda x: F.concat(x["value"], F.lit(":"), F.coalesce(x["label"], F.lit(""))))
    return rows.select("user_id", "type", F.array_join(text, ", ").alias("entries"))


@query(
    "typed_contact_parts",
    """SELECT user_id, event_type AS type, (n - 1) // 8 + 1 AS part, string_agg(CAST(event_id AS VARCHAR) || coalesce(':' || CASE WHEN event_id % 2 = 0 THEN props END, ':'), ', ' ORDER BY event_id) AS entries
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) GROUP BY ALL""",
)
def typed_contact_parts(spark, sf):
    df = table(spark, sf, "events").select("user_id", F.col("event_type").alias("type"), "event_id", F.col("event_id").cast("string").alias("value"), F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("label"))
    text = F.transform("contacts", lambda x: F.concat(x["value"], F.lit(":"), F.coalesce(x["label"], F.lit(""))))
    return A.typed_contact_parts(df, "user_id", pos="event_id", most=8).select("user_id", "type", "part", F.array_join(text, ", ").alias("entries"))


# --- matches -------------------------------------------------------------------------------------
PERSONS = "SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN concat(upper(substr(p_name, 1, 1)), substr(p_name, 2)) WHEN p_partkey % 3 = 1 THEN p_type ELSE concat('the ', substr(p_name, 1, position(' ' IN p_name) - 1)) END AS person FROM {part}"
PROFILES = define(
    "profiles_in",
    """
    SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN lower(p_type) ELSE replace(p_name, ' ', '_') END AS username, CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE p_brand END AS full_name,
        concat(p_brand, ' / ', CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END, ' ! ', p_size) AS row_text
    FROM {part}
    """,
)


def form_sql(x):
    return f"trim(regexp_replace(lower({x}), '[^0-9a-zа-я._@]+', ' ', 'g'))"


@query(
    "match_people",
    f"""WITH n AS (SELECT person, {form_sql("person")} AS t, list_filter(string_split({form_sql("person")}, ' '), lambda w: w NOT IN ('', 'и', 'the')) AS w FROM ({PERSONS.format(part="part")})),
    p AS (SELECT *, {form_sql("username")} AS u, {form_sql("full_name")} AS f, concat_ws(' ', NULLIF({form_sql("username")}, ''), NULLIF({form_sql("full_name")}, ''), NULLIF({form_sql("row_text")}, '')) AS a FROM {sql_of(PROFILES)}),
    s AS (SELECT person, p_partkey, username, full_name, row_text, CASE WHEN t IN (u, f) THEN 100 WHEN contains(a, t) THEN 90
        WHEN len(w) >= 2 AND len(list_filter(w, lambda x: NOT contains(a, x))) = 0 THEN 80 WHEN len(w) = 1 AND w[1] IN (u, f) THEN 70 WHEN len(w) = 1 AND contains(a, w[1]) THEN 55 ELSE 0 END AS match_score FROM n, p WHERE t <> '')
    SELECT * FROM s WHERE match_score > 0""",
)
def match_people(spark, sf):
    people = spark.sql(PERSONS, part=table(spark, sf, "part"))
    return M.match_people(people, bound(spark, sf, PROFILES)).select("person", "p_partkey", "username", "full_name", "row_text", "match_score")


MATCHES = define(
    "matches_in",
    """
    SELECT o_orderkey AS pos, concat(CASE WHEN o_custkey % 2 = 0 THEN 'Anna' ELSE 'Igor' END, ' Customer', o_custkey % 400) AS target_person, concat('query ', o_orderkey % 3) AS searched_name,
        CASE o_orderkey % 4 WHEN 0 THEN concat('anna.customer', o_custkey % 400) WHEN 1 THEN concat('customer', o_custkey % 400) ELSE 'someone' END AS found_username, concat('Full ', o_orderpriority) AS found_full_name,
        CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE concat('https://www.instagram.com/u', o_orderkey % 7, '/') END AS found_profile_url, concat('Customer', o_custkey % 400, ' ', CASE WHEN o_orderkey % 5 = 0 THEN 'Anna' ELSE 'x' END) AS matched_text,
        CASE o_orderkey % 6 WHEN 0 THEN 'bad' ELSE CAST(50 + o_orderkey % 5 * 10 AS STRING) END AS match_score, CASE WHEN o_custkey % 10 < 7 AND o_orderstatus = 'O' THEN 'ok' WHEN o_orderstatus = 'F' THEN 'not_found' ELSE 'error' END AS status
    FROM {orders}
    """,
)
CONF = """c AS (SELECT *, 'customer' AS ln, CASE WHEN starts_with(target_person, 'Anna') THEN 'anna' ELSE 'igor' END AS fn, lower(found_username || ' ' || found_full_name || ' ' || matched_text) AS a FROM %s),
    conf AS (SELECT * EXCLUDE (ln, fn, a), CASE WHEN status <> 'ok' THEN '' WHEN contains(a, fn) AND contains(a, ln) THEN 'high' WHEN contains(lower(found_username), fn || ln) THEN 'high' WHEN contains(a, ln) THEN 'medium' ELSE 'low' END AS confidence FROM c)""" % sql_of(MATCHES)
BEST = f"""{CONF}, ranked AS (SELECT *, CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS cr, coalesce(TRY_CAST(match_score AS INTEGER), 0) AS sc FROM conf),
    best AS (SELECT * FROM ranked WHERE status = 'ok' AND found_profile_url <> '' QUALIFY row_number() OVER (PARTITION BY target_person, found_profile_url ORDER BY cr DESC, sc DESC, pos) = 1)"""


def matches(spark, sf):
    return M.with_confidence(bound(spark, sf, MATCHES))


def persons(spark, sf):
    return bound(spark, sf, MATCHES).select("target_person").distinct()


@query("match_confidence", f"WITH {CONF} SELECT pos, confidence FROM conf")
def match_confidence(spark, sf):
    return matches(spark, sf).select("pos", "confidence")


@query("best_match", f"WITH {BEST} SELECT * EXCLUDE (cr, sc) FROM best")
def best_match(spark, sf):
    return M.best_match(matches(spark, sf))


NOT_FOUND = """nf AS (SELECT * REPLACE ('' AS searched_name) FROM ranked WHERE status = 'not_found' AND target_person NOT IN (SELECT target_person FROM best)
    QUALIFY row_number() OVER (PARTITION BY target_person ORDER BY pos) = 1)"""


@query("anti_not_found", f"WITH {BEST}, {NOT_FOUND} SELECT * EXCLUDE (cr, sc) FROM nf")
def anti_not_found(spark, sf):
    rows = matches(spark, sf)
    return M.not_found_rows(persons(spark, sf), M.best_match(rows), rows)


@query(
    "detail_rows",
    f"WITH {BEST}, {NOT_FOUND} SELECT * EXCLUDE (cr, sc) FROM (SELECT * FROM best UNION ALL SELECT * FROM ranked WHERE NOT (status = 'ok' AND found_profile_url <> '') AND status <> 'not_found' UNION ALL SELECT * FROM nf)",
)
def detail_rows(spark, sf):
    return M.detail_rows(persons(spark, sf), matches(spark, sf))


@query("sort_by_rank", f"WITH {BEST} SELECT pos, target_person, found_profile_url, confidence, match_score FROM best ORDER BY target_person DESC, cr DESC, sc DESC, found_profile_url DESC")
def sort_by_rank(spark, sf):
    best = M.sort_matches(M.best_match(matches(spark, sf)))
    return best.select("pos", "target_person", "found_profile_url", "confidence", "match_score")


@query(
    "match_summary",
    f"""WITH {BEST}, seen AS (SELECT target_person, found_profile_url, min(pos) AS s FROM ranked WHERE status = 'ok' GROUP BY ALL),
    m AS (SELECT b.target_person, count(*) AS n, string_agg(found_username || ' | ' || found_full_name || ' | ' || b.found_profile_url || ' | confidence=' || confidence || ' | query=' || searched_name, '; ' ORDER BY cr DESC, sc DESC, s) AS t
        FROM best b JOIN seen ON b.target_person = seen.target_person AND b.found_profile_url = seen.found_profile_url GROUP BY b.target_person)
    SELECT p.target_person, CASE WHEN n > 0 THEN 'found' ELSE 'not_found' END AS status, coalesce(n, 0) AS matched_profiles_count, coalesce(t, '') AS matched_profiles,
    'query 0; query 1; query 2' AS queries_checked FROM (SELECT DISTINCT target_person FROM ranked) p LEFT JOIN m ON p.target_person = m.target_person""",
)
def match_summary(spark, sf):
    people = persons(spark, sf)
    tried = people.select("target_person", F.posexplode(F.array(*[F.lit(f"query {i}") for i in range(3)])).alias("query_pos", "query"))
    return M.match_summary(people, matches(spark, sf), tried)


@query(
    "match_parts",
    f"""WITH {BEST}, seen AS (SELECT target_person, found_profile_url, min(pos) AS s FROM ranked WHERE status = 'ok' GROUP BY ALL),
    m AS (SELECT b.target_person, found_username || ' | ' || found_full_name || ' | ' || b.found_profile_url || ' | confidence=' || confidence || ' | query=' || searched_name AS t, row_number() OVER (PARTITION BY b.target_person ORDER BY cr DESC, sc DESC, s) AS n
        FROM best b JOIN seen ON b.target_person = seen.target_person AND b.found_profile_url = seen.found_profile_url)
    SELECT target_person, (n - 1) // 3 + 1 AS part, string_agg(t, '; ' ORDER BY n) AS matched_profiles FROM m GROUP BY ALL""",
)
def match_parts(spark, sf):
    return M.match_parts(matches(spark, sf), most=3)


# --- summaries -----------------------------------------------------------------------------------
@query(
    "status_summary",
    """SELECT list_position(['P','F','O','X'], o_orderstatus) AS position, o_orderstatus AS status, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 1) AS share FROM orders GROUP BY o_orderstatus""",
)
def status_summary(spark, sf):
    return A.status_summary(table(spark, sf, "orders"), "o_orderstatus", ("P", "F", "O", "X"))


FACTS = define(
    "address_facts_in",
    """
    SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN concat('bad address ', o_orderkey) WHEN 1 THEN concat(' U', o_orderkey, '@Gmail.com ') ELSE concat('u', o_orderkey, '@d', o_custkey, '.com') END AS email,
        o_custkey % 4 <> 0 AS has_mx, o_custkey % 8 <> 0 AS resolves, o_custkey % 5 = 0 AS catch_all, CASE WHEN o_orderkey % 7 > 1 THEN o_orderkey % 2 = 0 END AS found
    FROM {orders}
    """,
)


@query(
    "email_status",
    f"""SELECT o_orderkey, CASE WHEN NOT regexp_matches(a, '{vocab.CHECKED_EMAIL}') THEN 'syntax_error' WHEN list_contains({list_sql(vocab.MAJOR_MAIL_HOSTS)}, split_part(a, '@', 2)) THEN 'skipped'
    WHEN NOT has_mx AND resolves THEN 'no_mx' WHEN NOT has_mx THEN 'domain_error' WHEN catch_all THEN 'catch_all' WHEN found IS NULL THEN 'smtp_error' WHEN found THEN 'valid' ELSE 'invalid' END AS status
    FROM (SELECT *, lower(trim(email)) AS a FROM {sql_of(FACTS)})""",
)
def email_status(spark, sf):
    return A.email_status(bound(spark, sf, FACTS), "email", "has_mx", "resolves", "catch_all", "found").select("o_orderkey", "status")


HITS = define("detections_in", "SELECT vec_id, vec_id % 60 AS image, label, CAST(vec_id * 7919 % 100003 AS DOUBLE) / 100003 AS confidence FROM {embeddings}")


@query(
    "detection_summary",
    f"""WITH d AS (SELECT image, round(confidence, 4) AS c FROM {sql_of(HITS)} WHERE label = 3 AND confidence >= 0.25)
    SELECT i.image, count(c) AS count, count(c) > 0 AS found, max(c) AS best_confidence, coalesce(string_agg(CAST(CAST(round(c * 10000) AS BIGINT) AS VARCHAR), ',' ORDER BY c DESC), '') AS confidences
    FROM (SELECT DISTINCT image FROM {sql_of(HITS)}) i LEFT JOIN d ON i.image = d.image GROUP BY i.image""",
)
def detection_summary(spark, sf):
    df = A.detection_summary(bound(spark, sf, HITS), "image", "label", "confidence", 3, 0.25)
    return df.withColumn("confidences", F.array_join(F.transform("confidences", lambda c: F.round(c * 10000).cast("bigint").cast("string")), ","))


@query(
    "detection_parts",
    f"""SELECT image, (n - 1) // 4 + 1 AS part, string_agg(CAST(CAST(round(c * 10000) AS BIGINT) AS VARCHAR), ',' ORDER BY c DESC) AS confidences
    FROM (SELECT image, round(confidence, 4) AS c, row_number() OVER (PARTITION BY image ORDER BY round(confidence, 4) DESC) AS n FROM {sql_of(HITS)} WHERE label = 3 AND confidence >= 0.25) GROUP BY ALL""",
)
def detection_parts(spark, sf):
    df = A.detection_parts(bound(spark, sf, HITS), "image", "label", "confidence", 3, 0.25, 4)
    return df.withColumn("confidences", F.array_join(F.transform("confidences", lambda c: F.round(c * 10000).cast("bigint").cast("string")), ","))


@query("detection_totals", f"SELECT count(DISTINCT image) AS images, count(DISTINCT CASE WHEN label = 3 AND confidence >= 0.25 THEN image END) AS images_with_hits FROM {sql_of(HITS)}")
def detection_totals(spark, sf):
    return A.detection_totals(A.detection_summary(bound(spark, sf, HITS), "image", "label", "confidence", 3, 0.25))


LOG = define(
    "status_log",
    """
    SELECT event_id AS pos, user_id AS firm, concat('https://s', event_id % 3, '.example.com/') AS site, event_type AS stage, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
        repeat(event_type, 400) AS details, ts AS updated_at FROM {events}
    """,
)


@query(
    "crawl_summary",
    f"""SELECT firm, site, stage, status, substr(details, 1, 1200) AS details, updated_at FROM {sql_of(LOG)} QUALIFY row_number() OVER (PARTITION BY firm, site ORDER BY updated_at DESC, pos DESC) = 1""",
)
def crawl_summary(spark, sf):
    return A.crawl_summary(bound(spark, sf, LOG, costly=True), "firm", "site", "updated_at", "pos")


@query("failed_attempts", f"SELECT firm, min(pos) AS pos FROM {sql_of(LOG)} WHERE status = 'failed' GROUP BY firm")
def failed_attempts(spark, sf):
    return A.failed_attempts(bound(spark, sf, LOG), "firm", "pos")


PAGE_PRICES = PRICED.replace(
    sql_of(PRICES),
    f"""(SELECT page_id AS pos, site, url, unnest(['Осмотр | ' || (page_id + 1000) || ' - ' || (page_id + 2000) || ' ₽', 'Консультация ' || page_id || ' — от ' || (page_id + 100) || ' руб.',
        'Снимок до 1 500 руб']) AS line FROM {PAGES})""",
).replace("SELECT pos, url, ", "SELECT site, url, ")


@query(
    "site_counts",
    f"""WITH {EXTERNAL}, pg AS (SELECT site, count(*) AS pages FROM {PAGES} GROUP BY site),
    pr AS (SELECT site, count(*) AS prices FROM (WITH {PAGE_PRICES} SELECT DISTINCT site, url, lower(service), lower(price_raw) FROM priced) GROUP BY site),
    sp AS (SELECT site, count(*) AS specialists FROM ({ORACLES["extract_specialists"]}) GROUP BY site),
    ct AS (SELECT site, count(*) AS contacts FROM ({ORACLES["extract_contacts"]}) GROUP BY site),
    ln AS (SELECT site, string_agg(kind || '=' || n, ', ' ORDER BY kind) AS links FROM (SELECT site, kind, count(*) AS n FROM external GROUP BY ALL) GROUP BY site)
    SELECT pg.site, pg.pages, coalesce(prices, 0) AS prices, coalesce(specialists, 0) AS specialists, coalesce(contacts, 0) AS contacts, links, 'form+widget' AS booking_mode FROM pg
    LEFT JOIN pr ON pg.site = pr.site LEFT JOIN sp ON pg.site = sp.site LEFT JOIN ct ON pg.site = ct.site LEFT JOIN ln ON pg.site = ln.site""",
)
def site_counts(spark, sf):
    # a page is told apart by all it holds, since equal ids of other pages would mix their elements; it stays where footers meet it
    pages = bound(spark, sf, "pages_in").withColumn("page_id", F.xxhash64("page_id", "url", "html"))
    pages = pages.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "page_id")
    # prices, staff cards, footers and booking signs are elements of the same pages, which are parsed once for all
    elements = page_items(spark, sf, [*PRICE_TAGS, *CARD_TAGS, *FOOTER_TAGS, *ELEMENT_TAGS], pages=pages)
    lines = R.price_lines(pages, elements).join(elements.select("page_id", "url", "site").distinct(), "page_id")
    people = extract_specialists(cards(spark, sf, elements), None, "site")
    booking = booking_features(evidence(spark, sf, elements), "site")
    # what is found in elements is landed by itself: one plan for all would take the driver's memory
    parts = {
        "pages": bound(spark, sf, "pages_in").select("site"),
        "prices": land(R.extract_prices(lines).select("site"), "prices"),
        "specialists": land(people.select("site"), "specialists"),
        "contacts": extract_contacts(pages, "site", elements),
    }
    booking = land(booking.select("site", "booking_mode"), "booking")
    df = A.site_counts(parts["pages"], "site", parts, externals(spark, sf, pages), booking=booking)
    pairs = F.transform(F.map_entries("links"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return df.withColumn("links", F.array_join(pairs, ", "))


# --- ordered rows --------------------------------------------------------------------------------
TALK = define(
    "talk_in",
    """
    SELECT role AS talk, conv_id * 100 + turn AS pos, text AS line, CASE WHEN (conv_id + turn) % 4 = 0 THEN concat('heading ', conv_id) END AS heading, turn % 3 = 0 AS is_start, CASE WHEN (conv_id * 3 + turn) % 5 < 2 THEN concat('v', conv_id, '.', turn) END AS value
    FROM {conversations}
    """,
)


@query("neighbour_lines", f"SELECT talk, pos, lag(line) OVER w AS prev_line, lead(line) OVER w AS next_line FROM {sql_of(TALK)} WINDOW w AS (PARTITION BY talk ORDER BY pos)")
def neighbour_lines(spark, sf):
    return A.with_neighbours(bound(spark, sf, TALK), ["talk"], "pos", "line", width=4096).select("talk", "pos", "prev_line", "next_line")


@query("forward_fill", f"SELECT talk, pos, last_value(heading IGNORE NULLS) OVER (PARTITION BY talk ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM {sql_of(TALK)}")
def forward_fill(spark, sf):
    return A.with_section(bound(spark, sf, TALK), ["talk"], "pos", F.col("heading"), width=4096).select("talk", "pos", "section")


@query(
    "within_n_lines",
    f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY talk ORDER BY pos) AS n FROM {sql_of(TALK)}),
    a AS (SELECT *, min(n) FILTER (WHERE is_start) OVER w AS s, min(n) FILTER (WHERE value IS NOT NULL) OVER w AS f, arg_min(value, n) FILTER (WHERE value IS NOT NULL) OVER w AS v FROM n WINDOW w AS (PARTITION BY talk ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING))
    SELECT talk, pos, CASE WHEN s IS NULL OR f < s THEN v END AS paired FROM a WHERE is_start""",
)
def within_n_lines(spark, sf):
    return A.pair_within(bound(spark, sf, TALK), ["talk"], "pos", F.col("is_start"), F.col("value"), width=4096).select("talk", "pos", "paired")


@query(
    "top_n_per_group",
    "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) <= 6",
)
def top_n_per_group(spark, sf):
    df = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return A.top_n(df, ["l_suppkey"], [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 6)


@query("shuffled_head", "SELECT c_custkey, c_name FROM customer ORDER BY md5(c_custkey || '|7'), c_custkey LIMIT 100")
def shuffled_head(spark, sf):
    return A.shuffled_head(table(spark, sf, "customer").select("c_custkey", "c_name"), ["c_custkey"], 100, 7)


@query(
    "union_sources",
    "SELECT c_custkey AS id, c_name AS name, NULL::DOUBLE AS balance, 0 AS source_rank FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, 1 FROM supplier",
)
def union_sources(spark, sf):
    header = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    footer = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return A.union_sources(header, footer)


@query("difference", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')")
def difference(spark, sf):
    done = table(spark, sf, "orders").filter("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return A.difference(table(spark, sf, "customer").select("c_custkey", "c_name"), done, ["c_custkey"])


# --- candidates ----------------------------------------------------------------------------------
NAMES = define(
    "names_in",
    """
    SELECT c_custkey, concat('D', c_custkey, '.Example.com') AS domain, CASE c_custkey % 4 WHEN 0 THEN concat('Ива', translate(CAST(c_custkey AS STRING), '0123456789', 'аеибвгджзк')) WHEN 1 THEN concat('O-', c_mktsegment)
        WHEN 2 THEN '123' ELSE concat(' Щ', translate(CAST(c_custkey AS STRING), '0123456789', 'лмнопрсъьё')) END AS last_name,
        CASE c_custkey % 3 WHEN 0 THEN 'Пётр' WHEN 1 THEN concat('Ю', translate(CAST(c_custkey AS STRING), '0123456789', 'туфхцчшыэя')) ELSE c_mktsegment END AS first_name,
        CASE WHEN c_custkey % 2 = 0 THEN 'Ильич' ELSE '' END AS middle_name
    FROM {customer}
    """,
)


def token_sql(x):
    return f"regexp_replace(translate(lower(trim({x})), 'ё', 'е'), '[^а-яa-z-]+', '', 'g')"


def spell_sql(x, aliases=False):
    out = f"translate({token_sql(x)}, 'абвгдезийклмнопрстуфыэъь-', 'abvgdeziyklmnoprstufye')"
    for k, v in (("ж", "zh"), ("х", "kh"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("щ", "shch"), ("ю", "yu"), ("я", "ya")):
        out = f"replace({out}, '{k}', '{v}')"
    return f"CASE WHEN {token_sql(x)} = 'петр' THEN 'petr' ELSE {out} END" if aliases else out


SPELT = f"(SELECT *, {spell_sql('first_name', True)} AS fn, {spell_sql('last_name')} AS ln, {spell_sql('middle_name')} AS mn FROM {sql_of(NAMES)})"


@query("clean_name", f"SELECT c_custkey, {token_sql('last_name')} AS token FROM {sql_of(NAMES)}")
def clean_name(spark, sf):
    return N.with_name_token(bound(spark, sf, NAMES), "last_name").select("c_custkey", "token")


@query("name_variants", f"SELECT c_custkey, 'first' AS part, fn AS variant FROM {SPELT} WHERE fn <> '' UNION ALL SELECT c_custkey, 'last', ln FROM {SPELT} WHERE ln <> ''")
def name_variants(spark, sf):
    names = bound(spark, sf, NAMES)
    first = N.name_variants(names, "first_name", 1, first_name=True).select("c_custkey", F.lit("first").alias("part"), "variant")
    return first.unionByName(N.name_variants(names, "last_name", 1).select("c_custkey", F.lit("last").alias("part"), "variant"))


def map_sql(table) -> str:
    return "MAP {" + ", ".join(f"'{k}': {list_sql(v)}" for k, v in table.items()) + "}"


def in_order_sql(x: str, most: int) -> str:
    """The first distinct values of a list other than the empty text, in order."""
    filled = f"list_filter({x}, lambda v: v <> '')"
    return f"list_slice(list_filter({filled}, lambda v, i: list_position({filled}, v) = i), 1, {most})"


def spellings_sql(source: str, column: str, most: int, aliases: bool, out: str) -> str:
    """CTEs that end in ``{out}``: the rows of a source with a list of the spellings of one name column."""
    letters = "list_concat([['']], list_transform(list_filter(string_split(t, ''), lambda c: c <> ''), lambda c: coalesce(list_extract(map_extract(m, c), 1), [''])))"
    product = f"list_reduce({letters}, lambda a, c: list_slice(flatten(list_transform(a, lambda p: list_transform(c, lambda s: p || s))), 1, {4 * most}))"
    usual = "coalesce(list_extract(map_extract(u, t), 1), CAST([] AS VARCHAR[]))" if aliases else "CAST([] AS VARCHAR[])"
    return f"""{out}_t AS (SELECT *, {token_sql(column)} AS t, {map_sql(vocab.LETTER_SPELLINGS)} AS m, {map_sql(vocab.FIRST_NAME_SPELLINGS)} AS u FROM {source}),
    {out}_p AS (SELECT *, CASE WHEN t = '' THEN CAST([] AS VARCHAR[]) WHEN regexp_matches(t, '^[a-z-]+$') THEN [replace(t, '-', '')] ELSE {product} END AS found FROM {out}_t),
    {out}_d AS (SELECT * EXCLUDE (found), list_concat({usual}, {in_order_sql("found", most)}) AS both_lists FROM {out}_p),
    {out} AS (SELECT * EXCLUDE (t, m, u, both_lists), {in_order_sql("both_lists", most)} AS {out}_list FROM {out}_d)"""


@query(
    "name_variants_many",
    f"WITH {spellings_sql(sql_of(NAMES), 'first_name', 8, True, 'fs')} SELECT c_custkey, CAST(unnest(range(len(fs_list))) AS INTEGER) AS variant_pos, unnest(fs_list) AS variant FROM fs",
)
def name_variants_many(spark, sf):
    return N.name_variants(bound(spark, sf, NAMES), "first_name", 8, first_name=True).select("c_custkey", "variant_pos", "variant")


def pattern_sql(pattern):
    parts = N.pattern_tokens(pattern)
    value = {"first": "fn", "last": "ln", "middle": "mn", "f": "substr(fn, 1, 1)", "l": "substr(ln, 1, 1)", "m": "substr(mn, 1, 1)"}
    named = [value[p] for p in parts if p in value]
    return f"CASE WHEN {' AND '.join(f'{n} <> {chr(39)*2}' for n in named)} THEN {' || '.join(value.get(p, f'{chr(39)}{p}{chr(39)}') for p in parts)} ELSE '' END"


LOCALS = f"[{', '.join(pattern_sql(p) for p in vocab.ADDRESS_PATTERNS)}]"


@query("render_pattern", f"SELECT c_custkey, i AS pattern, local FROM (SELECT c_custkey, unnest(range({len(vocab.ADDRESS_PATTERNS)})) AS i, unnest({LOCALS}) AS local FROM {SPELT}) WHERE local <> ''")
def render_pattern(spark, sf):
    names = bound(spark, sf, NAMES, costly=True).select("c_custkey", *[N.variants(F.col(c), 1, c == "first_name").alias(c) for c in ("first_name", "last_name", "middle_name")])
    first = lambda c: F.coalesce(F.try_element_at(c, F.lit(1)), F.lit("")).alias(c)
    names = names.select("c_custkey", *[first(c) for c in ("first_name", "last_name", "middle_name")])
    return N.render_patterns(names, "first_name", "last_name", "middle_name").select("c_custkey", "pattern", "local")


@query(
    "email_candidates",
    f"""SELECT DISTINCT c_custkey, lower(regexp_replace(local, '[._+\\-]{{2,}}', '.', 'g')) || '@' || lower(domain) AS email FROM
    (SELECT c_custkey, domain, unnest({LOCALS}) AS local FROM {SPELT} WHERE ln <> '' AND fn <> '') WHERE local <> ''""",
)
def email_candidates(spark, sf):
    # one spelling per part; a middle name has two at least, so it is given in Latin letters
    names = bound(spark, sf, NAMES, costly=True).withColumn("middle_name", F.when(F.col("middle_name") != "", F.lit("ilich")).otherwise(F.lit("")))
    return N.email_candidates(names, most=1).select("c_custkey", "email")


@query(
    "email_candidates_many",
    f"""WITH {spellings_sql(sql_of(NAMES), 'first_name', 2, True, 'fs')}, {spellings_sql('fs', 'last_name', 2, False, 'ls')}, {spellings_sql('ls', 'middle_name', 2, False, 'ms')},
    n AS (SELECT c_custkey, domain, fn, ln, mn FROM ms, unnest(fs_list) a(fn), unnest(ls_list) b(ln), unnest(CASE WHEN len(ms_list) = 0 THEN [''] ELSE ms_list END) c(mn)),
    l AS (SELECT c_custkey, domain, unnest({LOCALS}) AS local FROM n)
    SELECT DISTINCT c_custkey, lower(regexp_replace(local, '[._+\\-]{{2,}}', '.', 'g')) || '@' || lower(domain) AS email FROM l WHERE local <> ''""",
)
def email_candidates_many(spark, sf):
    return N.email_candidates(bound(spark, sf, NAMES, costly=True), most=2).select("c_custkey", "email")


@query(
    "search_queries",
    f"""WITH n AS (SELECT c_custkey, first_name || ' ' || trim(last_name) AS person, trim(last_name) AS raw_last, fn, ln, {token_sql("first_name")} AS tf, {token_sql("last_name")} AS tl FROM {SPELT}
        WHERE regexp_matches(last_name, '[A-Za-zА-Яа-яЁё]')),
    q AS (SELECT c_custkey, [person, raw_last, ln, fn || ' ' || ln, fn || ln, replace(tf || tl, '-', '')] AS qs FROM n)
    SELECT c_custkey, query FROM (SELECT DISTINCT c_custkey, unnest(qs) AS query FROM q) WHERE query <> ''""",
)
def search_queries(spark, sf):
    people = bound(spark, sf, NAMES).select("c_custkey", F.concat_ws(" ", "first_name", F.trim("last_name")).alias("person"))
    return N.search_queries(people, most=1).select("c_custkey", "query")


# --- streams -------------------------------------------------------------------------------------
def event_files(spark, sf):
    """The events as a file per shuffle partition, their schema, and how many files make one of three batches or more."""
    path, n_files = work_path(spark, "events"), max(3, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).repartitionByRange(n_files, "event_id").write.parquet(path)
    return path, spark.read.parquet(path).schema, n_files // 3


@query("stream_append_unique", "SELECT DISTINCT user_id, event_type FROM events")
def stream_append_unique(spark, sf):
    path, schema, per_batch = event_files(spark, sf)
    target, keys = work_path(spark, "unique"), ["user_id", "event_type"]
    J.stream_append_unique(J.file_stream(spark, path, schema, per_batch), target, keys, ["event_id"], work_path(spark, "checkpoint")).awaitTermination()
    return J.stored_rows(spark, target, schema).select(*keys)


@query("stream_status", "SELECT date_trunc('day', ts) AS window_start, event_type AS stage, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, count(*) AS n FROM events GROUP BY ALL")
def stream_status(spark, sf):
    # one file per batch, later rows first: the others come days late
    path = work_path(spark, "events")
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    for late in (False, True, None):
        part = F.pmod(F.dayofyear("ts"), F.lit(3)) == {False: 2, True: 1, None: 0}[late]
        rows.filter(part).write.mode("append").parquet(path)
    log = J.file_stream(spark, path, spark.read.parquet(path).schema, 1).withColumn("status", F.when(F.col("event_type") == "error", F.lit("failed")).otherwise(F.lit("success")))
    target = work_path(spark, "status")
    J.stream_status(log, target, "ts", "event_type", "status", work_path(spark, "checkpoint")).awaitTermination()
    return J.current_status(spark, target).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_resume", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')")
def stream_resume(spark, sf):
    path, schema, per_batch = event_files(spark, sf)
    inputs = J.file_stream(spark, path, schema, per_batch).withColumn("key", F.concat(F.lit("U"), "user_id"))
    done = table(spark, sf, "orders").filter("o_orderpriority = '5-LOW'").select(F.concat(F.lit("u"), "o_custkey").alias("done"))
    target, results = work_path(spark, "pending"), work_path(spark, "results")
    for part in range(3):  # results come in as they are made
        J.store_results(done.where(F.pmod(F.xxhash64("done"), F.lit(3)) == part), "done", results)
    J.stream_pending(inputs, results, "key", target, work_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(target).select("event_id")
