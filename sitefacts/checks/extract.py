"""Queries that extract prices, people, booking signs, registry facts and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitefacts import vocab
from sitefacts.bindings import bound, define, spread, sql_of, table
from sitefacts.checks.base import list_sql, query, under_sql
from sitefacts.checks.pages import PAGES
from sitefacts.functions.html import html_elements
from sitefacts.operators import booking as B
from sitefacts.operators import prices as R
from sitefacts.operators import profiles as M
from sitefacts.operators import registry as G
from sitefacts.operators import staff as S
from sitefacts.sources.tables import land

# --- prices --------------------------------------------------------------------------------------
PRICES = define(
    "price_lines_in",
    """
    SELECT p_partkey AS pos, concat('https://', lower(p_type), '.example.com/', p_brand) AS url, CASE p_partkey % 7
        WHEN 0 THEN concat(p_name, ' — от ', p_size * 100, ' руб.') WHEN 1 THEN concat(p_name, ' до 1 ', p_size + 100, ' руб')
        WHEN 2 THEN concat(p_name, ' ', p_size, '00 - ', p_size, '50 ₽') WHEN 3 THEN concat('**', p_name, '**: ', p_size + 10, ' р')
        WHEN 4 THEN concat('| ', p_name, ' | 12.', p_size + 100, ' рублей |') WHEN 5 THEN concat(p_name, ' ', p_size, ' items') ELSE concat(p_size + 10, ' ₽') END AS line
    FROM {part}
    """,
)
AMT = r"(?:\d{1,3}(?:[ \x{A0}.,]\d{3})+|\d{2,7})"
CUR = r"(?:₽|руб(?:\.|лей|ля)?|р)"
RANGE, SINGLE = rf"(?i)({AMT})\s*[-–—]\s*({AMT})\s*{CUR}", rf"(?i)(от|до)?\s*({AMT})\s*{CUR}"


def md_sql(x):
    return rf"trim(regexp_replace(regexp_replace({x}, '[*_`>#\[\]()]', '', 'g'), '[\s\x{{A0}}]+', ' ', 'g'))"


BARE = md_sql(rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(l, '{RANGE}', '', 'g'), '{SINGLE}', '', 'g'), '^[-–—:|/•*]+\s*', ''), '\s*[-–—:|/•*]+\s*$', '')")
NUM = "TRY_CAST(NULLIF(regexp_replace(%s, '[^0-9]', '', 'g'), '') AS BIGINT)"
PRICED = f"""l AS (SELECT *, {md_sql("line")} AS l FROM {sql_of(PRICES)}),
    m AS (SELECT *, regexp_extract(l, '{RANGE}', 0) AS r, regexp_extract(l, '{SINGLE}', 0) AS s, lower(regexp_extract(l, '{SINGLE}', 1)) AS px,
        {NUM % f"regexp_extract(l, '{SINGLE}', 2)"} AS v FROM l WHERE length(l) >= 4),
    priced AS (SELECT pos, url, coalesce(NULLIF({BARE}, ''), l) AS service, CASE WHEN r <> '' THEN r ELSE s END AS price_raw,
        CASE WHEN r <> '' THEN {NUM % f"regexp_extract(l, '{RANGE}', 1)"} WHEN px <> 'до' THEN v END AS price_min,
        CASE WHEN r <> '' THEN {NUM % f"regexp_extract(l, '{RANGE}', 2)"} ELSE v END AS price_max, 'RUB' AS currency FROM m WHERE r <> '' OR s <> '')"""


@query("parse_price", f"WITH {PRICED} SELECT * FROM priced")
def parse_price(spark, sf):
    return R.parse_prices(bound(spark, sf, PRICES)).drop("line")


@query("extract_prices", f"WITH {PRICED} SELECT * FROM priced QUALIFY row_number() OVER (PARTITION BY url, lower(service), lower(price_raw) ORDER BY pos) = 1")
def extract_prices(spark, sf):
    return R.extract_prices(bound(spark, sf, PRICES), order=("pos",)).drop("line")


def page_items(spark, sf, tags, strings=False, pages=None):
    pages = bound(spark, sf, "pages_in", costly=True) if pages is None else pages
    return land(html_elements(pages, keep=["page_id", "url", "site"], tags=tags, strings=strings), "elements")


PRICE_TAGS = ("tr", "th", "td", "li", "p")


@query(
    "price_lines",
    f"""SELECT page_id, i AS source, CASE i WHEN 1 THEN 'Осмотр | ' || (page_id + 1000) || ' - ' || (page_id + 2000) || ' ₽'
    ELSE ['Консультация ' || page_id || ' — от ' || (page_id + 100) || ' руб.', 'Снимок до 1 500 руб'][j] END AS line
    FROM (SELECT page_id, unnest([1, 2, 2]) AS i, unnest([1, 1, 2]) AS j FROM pages)""",
)
def price_lines(spark, sf):
    elements = page_items(spark, sf, PRICE_TAGS)
    return R.price_lines(elements.select("page_id").limit(0), elements).select("page_id", "source", "line")


# --- people --------------------------------------------------------------------------------------
PEOPLE = define(
    "staff_text_in",
    """
    SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN concat('Сидоров Олег ', CASE WHEN conv_id % 2 = 0 THEN 'Ильич' ELSE 'Петров-Водкин' END)
        WHEN 1 THEN concat('главный врач, стоматолог, 8 913 555 ', 10 + conv_id % 80, ' 20') WHEN 2 THEN text
        WHEN 3 THEN concat('mail', conv_id % 30, '@clinic.example.org Наша Клиника') ELSE concat('Ким Ли и doctor ', turn) END AS line
    FROM {conversations}
    """,
)
CAP = "[А-ЯЁ][а-яё]{1,30}"
NAME_RE = rf"(?:^|[^0-9A-Za-zА-Яа-яЁё_])({CAP}(?:-{CAP})?\s+{CAP}(?:\s+{CAP})?)"


def person_sql(x: str) -> str:
    n = f"regexp_extract({x}, '{NAME_RE}', 1)"
    w = f"string_split(lower({n}), ' ')"
    return f"""CASE WHEN {n} <> '' AND NOT list_has_any({w}, {list_sql(vocab.NOT_PERSON_WORDS)})
        AND NOT (len({w}) = 2 AND len(list_filter({w}, lambda v: length(v) < 3)) > 0) THEN {n} END"""


def role_sql(x: str) -> str:
    roles = sorted(vocab.ROLE_WORDS, key=len, reverse=True)
    return f"coalesce(list_filter({list_sql(roles)}, lambda w: contains(translate(lower({x}), 'ё', 'е'), w))[1], '')"


@query("find_person", f"SELECT conv_id, turn, {person_sql('line')} AS full_name FROM {sql_of(PEOPLE)}")
def find_person(spark, sf):
    return S.with_person_name(bound(spark, sf, PEOPLE), "line").select("conv_id", "turn", "full_name")


@query("find_role", f"SELECT conv_id, turn, {role_sql('line')} AS role FROM {sql_of(PEOPLE)}")
def find_role(spark, sf):
    return S.with_role(bound(spark, sf, PEOPLE), "line").select("conv_id", "turn", "role")


PHONE_RE = r"(?:\+7|8)\s*\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}"


@query(
    "staff_from_lines",
    rf"""WITH l AS (SELECT conv_id, turn, trim(regexp_replace(line, '\s+', ' ', 'g')) AS l FROM {sql_of(PEOPLE)}),
    d AS (SELECT * FROM l WHERE l <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, lower(l) ORDER BY turn) = 1),
    n AS (SELECT *, concat_ws(' ', l, lag(l) OVER w, lead(l) OVER w) AS t FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    p AS (SELECT conv_id, turn, {person_sql("t")} AS full_name, {role_sql("t")} AS role, trim(regexp_extract(t, '{PHONE_RE}', 0)) AS phone,
        regexp_extract(t, '{vocab.EMAIL_PATTERN}', 0) AS email FROM n WHERE length(l) <= 180)
    SELECT * FROM p WHERE full_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, lower(full_name), role, phone, email ORDER BY turn) = 1""",
)
def staff_from_lines(spark, sf):
    return S.staff_from_lines(bound(spark, sf, PEOPLE), "conv_id", "turn").drop("source")


CARDS = f"""cards AS (SELECT site, page_id, url, 'Иванов Иван' || CASE WHEN page_id % 3 = 0 THEN ' Петрович' ELSE '' END AS full_name,
    CASE WHEN page_id % 4 = 0 THEN '' ELSE 'ортодонт' END AS role, '+7 (913) 555-10-' || lpad(CAST(page_id % 100 AS VARCHAR), 2, '0') AS phone,
    'doc' || page_id || '@clinic.example.com' AS email FROM {PAGES})"""


CARD_TAGS = ("article", "section", "div", "li")


def cards(spark, sf, elements=None):
    return S.staff_from_cards(page_items(spark, sf, CARD_TAGS) if elements is None else elements, keep=("site", "url"))


@query("staff_from_cards", f"WITH {CARDS} SELECT page_id, url, full_name, role, phone, email FROM cards")
def staff_from_cards(spark, sf):
    return cards(spark, sf).select("page_id", "url", *S.PERSON_FIELDS)


@query(
    "extract_specialists",
    f"""WITH {CARDS} SELECT site, page_id, full_name, role, phone, email FROM (SELECT *, max(role <> '') OVER (PARTITION BY site, lower(full_name)) AS has FROM cards)
    WHERE role <> '' OR NOT has""",
)
def extract_specialists(spark, sf):
    return S.extract_specialists(cards(spark, sf), None, "site").select("site", "page_id", *S.PERSON_FIELDS)


# --- booking -------------------------------------------------------------------------------------
SHOWN = "regexp_replace(url, '#.*$', '')"
HOST = "regexp_extract(lower(url), '//([^/:?#]*)', 1)"
BARE_HOST = rf"regexp_replace({HOST}, '^www\.', '')"
INSIDE = under_sql(BARE_HOST, "example.org")
EVIDENCE = f"""b AS (SELECT site, page_id, url, {SHOWN} AS shown, {BARE_HOST} AS h, {HOST} AS hh, {INSIDE} AS own, regexp_extract(url, '^([a-z]+)', 1) AS scheme FROM {PAGES}),
    e AS (SELECT site, page_id, 1 AS o, 'form_action' AS kind, 'yclients' AS provider, 'n' || (page_id % 25) || '.yclients.com' AS host, 'n' || (page_id % 25) || '.yclients.com' AS d, shown FROM b
    UNION ALL SELECT site, page_id, 2, 'form', NULL, NULL, 'booking form detected', shown FROM b WHERE page_id % 5 = 0
    UNION ALL SELECT site, page_id, 3, CASE WHEN own THEN 'booking_link' ELSE 'widget_link' END, CASE WHEN own THEN NULL ELSE 'external:' || h END,
        CASE WHEN own THEN NULL ELSE h END, CASE WHEN own THEN scheme || '://' || h || '/booking/' || (page_id % 7) ELSE h END, shown FROM b
    UNION ALL SELECT site, page_id, 4, 'widget', 'medflex', 'w' || (page_id % 9) || '.medflex.ru', 'w' || (page_id % 9) || '.medflex.ru', shown FROM b
    UNION ALL SELECT site, page_id, 5, 'widget_link', 'external:partner.example.net', 'partner.example.net', 'partner.example.net', shown FROM b),
    evidence AS (SELECT site, page_id, o, kind, provider, host, kind || ':' || shown || ' (' || d || ')' AS evidence FROM e)"""


def evidence(spark, sf, elements=None):
    return B.booking_evidence(page_items(spark, sf, B.ELEMENT_TAGS) if elements is None else elements, "site")


@query("booking_evidence", f"WITH {EVIDENCE} SELECT site, page_id, kind, provider, host, evidence FROM evidence")
def booking_evidence(spark, sf):
    return evidence(spark, sf).select("site", "page_id", "kind", "provider", "host", "evidence")


@query(
    "booking_features",
    f"""WITH {EVIDENCE}, f AS (SELECT site, bool_or(kind IN ('form','form_action','booking_link')) AS has_booking_form, bool_or(kind IN ('form_action','widget','widget_link')) AS has_booking_widget,
        array_to_string(list_sort(list_distinct(list(provider) FILTER (WHERE provider IS NOT NULL))), '; ') AS booking_widget_provider,
        array_to_string(list_sort(list_distinct(list(host) FILTER (WHERE host IS NOT NULL))), '; ') AS booking_widget_host FROM evidence GROUP BY site),
    u AS (SELECT site, evidence, min((page_id, o)) AS k FROM evidence GROUP BY ALL),
    t AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY site ORDER BY k) <= 6)
    SELECT f.site, CASE WHEN has_booking_form AND has_booking_widget THEN 'form+widget' WHEN has_booking_form THEN 'form' WHEN has_booking_widget THEN 'widget' ELSE 'none' END AS booking_mode,
    has_booking_form, has_booking_widget, booking_widget_provider, booking_widget_host, x.booking_evidence FROM f
    JOIN (SELECT site, string_agg(evidence, ' | ' ORDER BY k) AS booking_evidence FROM t GROUP BY site) x ON f.site = x.site""",
)
def booking_features(spark, sf):
    return B.booking_features(evidence(spark, sf), "site", bound(spark, sf, "pages_in").select("site").distinct())


HOSTS = "(SELECT event_id, ['n1.yclients.com','ALTEG.IO','www.dikidi.ru','x.sberhealth.ru','bitrix.info','example.com','notmedflex.ru','a.b.infoclinica.ru'][event_id % 8 + 1] AS host FROM events)"


@query(
    "booking_provider",
    f"""SELECT event_id, CASE {' '.join(f"WHEN {under_sql('h', *ds)} THEN '{n}'" for n, ds in vocab.BOOKING_PROVIDERS)} END AS provider
    FROM (SELECT event_id, regexp_replace(lower(host), '^www\\.', '') AS h FROM {HOSTS})""",
)
def booking_provider(spark, sf):
    names = F.array(*[F.lit(h) for h in ("n1.yclients.com", "ALTEG.IO", "www.dikidi.ru", "x.sberhealth.ru", "bitrix.info", "example.com", "notmedflex.ru", "a.b.infoclinica.ru")])
    df = table(spark, sf, "events").select("event_id", F.element_at(names, (F.col("event_id") % 8 + 1).cast("int")).alias("host"))
    return B.with_booking_provider(df, "host").select("event_id", "provider")


# --- cards, articles, metrics --------------------------------------------------------------------
FIRM_CARDS = define(
    "cards_in",
    """
    SELECT c_custkey, concat('<div><a class="x" href="http://link.2gis.ru/a">Shop', c_custkey, '.Example.com</a><a href="https://link.2gis.ru/b"><b>no.example.com</b></a>',
        '<a href="https://other.example.com/">z.example.com</a><a href="https://link.2gis.ru/c">https://www.s', c_custkey % 7, '.ru/path</a><a href="http://link.2gis.ru/d">not a host</a>',
        '<a href="http://link.2gis.ru/e"> shop', c_custkey, '.example.com/again </a></div>') AS html
    FROM {customer}
    """,
)


@query("firm_sites", "SELECT c_custkey, CASE i WHEN 1 THEN 'shop' || c_custkey || '.example.com' ELSE 'www.s' || (c_custkey % 7) || '.ru' END AS site_host FROM (SELECT c_custkey, unnest([1, 2]) AS i FROM customer)")
def firm_sites(spark, sf):
    return M.firm_sites(bound(spark, sf, FIRM_CARDS, costly=True), "c_custkey", "html").select("c_custkey", "site_host")


ARTICLES = define(
    "articles_in",
    """
    SELECT o_orderkey AS page_id, concat('<main><article class="tm-articles-list__item wide"><time datetime="', CAST(CAST(o_orderdate AS DATE) AS STRING), 'T10:00:00.000Z">x</time>',
        '<h2><a class="tm-title__link" href="/ru/companies/c', o_custkey, '/articles/1/"><span>Title ', o_orderkey, '</span></a></h2></article>',
        '<article class="tm-articles-list__item"><time datetime="2024-01-01T00:00:00Z">x</time><a class="tm-title__link" href="/ru/articles/2/">no</a></article>',
        '<article class="tm-articles-list__item"><a class="tm-title__link" href="/ru/companies/3/">undated</a></article></main>') AS html
    FROM {orders}
    """,
)


@query("article_list", "SELECT o_orderkey AS page_id, o_orderdate + INTERVAL 10 HOUR AS date, 'Title ' || o_orderkey AS title FROM orders")
def article_list(spark, sf):
    pages = bound(spark, sf, ARTICLES, costly=True)
    df = M.article_list(html_elements(pages, keep=["page_id"], tags=["article", "time", "a"]))
    return df.select("page_id", F.col("date").cast("timestamp_ntz").alias("date"), "title")


METRICS = define(
    "metrics_in",
    """
    SELECT s_suppkey AS page_id, concat('https://x.example.com/organizations-card/', s_suppkey, '?t=1') AS url, CASE s_suppkey % 3
        WHEN 0 THEN concat('<div><h2>Отчет о финансовых результатах - Упрощенная форма</h2><table><tr><th>Показатель</th><th>2022 год</th><th>2023 год</th><th>2021</th></tr>',
            '<tr><td>Выручка, млн ₽</td><td>1 ', s_suppkey, '</td><td>2 ', s_suppkey, ',5</td><td>9</td></tr></table></div><p>Выручка, млн ₽ 77</p>')
        WHEN 1 THEN concat('<div><h2>Отчет о финансовых результатах - Упрощенная форма</h2><p><span>Выручка, млн ₽</span><b>за год</b><b>', s_suppkey, ' тыс</b></p><p>2020</p></div>')
        ELSE concat('<p>2015</p><h2>Отчет о финансовых результатах - Упрощенная форма</h2><p>2018 и 2019</p><p>Выручка, млн ₽: ', s_suppkey, ',25</p>') END AS html
    FROM {supplier}
    """,
)
SECTION, LABEL = "Отчет о финансовых результатах - Упрощенная форма", "Выручка, млн ₽"


@query(
    "labelled_metric",
    """SELECT s_suppkey AS page_id, CAST(s_suppkey AS VARCHAR) AS organization_id, CASE s_suppkey % 3 WHEN 0 THEN '2 ' || s_suppkey || ',5' WHEN 1 THEN s_suppkey || ' ' ELSE s_suppkey || ',25' END AS value_raw,
    CASE s_suppkey % 3 WHEN 0 THEN CAST('2' || s_suppkey || '.5' AS DOUBLE) WHEN 1 THEN CAST(s_suppkey AS DOUBLE) ELSE s_suppkey + 0.25::DOUBLE END AS value,
    CASE s_suppkey % 3 WHEN 0 THEN 2023 WHEN 1 THEN CASE WHEN s_suppkey BETWEEN 1900 AND 2099 THEN s_suppkey END ELSE greatest(2019, CASE WHEN s_suppkey BETWEEN 1900 AND 2099 THEN s_suppkey END) END AS year FROM supplier""",
)
def labelled_metric(spark, sf):
    pages = bound(spark, sf, METRICS, costly=True)
    elements = land(html_elements(pages, keep=["page_id"], strings=True), "elements")
    return M.labelled_metric(elements, pages, SECTION, LABEL).drop("url")


@query(
    "metric_in_text",
    rf"""SELECT doc_id, NULLIF(trim(regexp_extract(text, '(?i)the\s*[:\-]?\s*([-−]?\d[\d ]*(?:[.,]\d+)?)', 1)), '') AS value_raw,
    (SELECT max(CAST(y AS INTEGER)) FROM (SELECT unnest(regexp_extract_all(' ' || replace(text, ' ', '  ') || ' ', '[^0-9A-Za-zА-Яа-яЁё_]((?:19|20)\d{{2}})[^0-9A-Za-zА-Яа-яЁё_]', 1)) AS y)) AS year
    FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents)""",
)
def metric_in_text(spark, sf):
    value, year = M.metric_in_text(F.col("text"), "no such section", "the")
    return spread(table(spark, sf, "documents")).select("doc_id", T_trim(value).alias("value_raw"), year.alias("year"))


def T_trim(c):
    return F.when(F.trim(c) != "", F.trim(c))


OBSERVED = define(
    "observations_in",
    """
    SELECT l_suppkey, year(l_shipdate) AS year, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS pos, CASE WHEN (l_orderkey + l_linenumber) % 3 <> 0 THEN l_extendedprice END AS value FROM {lineitem}
    """,
)


@query("metric_by_year", f"SELECT l_suppkey, CAST(year AS INTEGER) AS year, pos, value FROM {sql_of(OBSERVED)} QUALIFY row_number() OVER (PARTITION BY l_suppkey, year ORDER BY value IS NULL, pos) = 1")
def metric_by_year(spark, sf):
    return M.metric_by_year(bound(spark, sf, OBSERVED), "l_suppkey")


# --- registry lines ------------------------------------------------------------------------------
REGISTRY = define(
    "registry_in",
    """
    SELECT c_nationkey AS document, c_custkey, concat_ws(chr(10),
        CASE WHEN c_custkey % 4 = 0 THEN 'Выписка из ЕГРЮЛ' END,
        CASE c_custkey % 5 WHEN 0 THEN 'Сведения о лице, имеющем право без доверенности действовать' WHEN 1 THEN 'Сведения об участниках / учредителях юридического лица' WHEN 2 THEN 'Сведения о записи' ELSE 'Прочее' END,
        CASE WHEN c_custkey % 5 = 0 THEN 'от имени юридического лица' END,
        concat(c_custkey % 90, ' Фамилия Фам', c_custkey % 37), CASE WHEN c_custkey % 3 <> 0 THEN 'пустая строка' END,
        CASE WHEN c_custkey % 7 <> 0 THEN concat('  Имя  Имя', c_custkey % 11) END, CASE WHEN c_custkey % 2 = 0 THEN '9 Отчество Отч' END,
        CASE WHEN c_custkey % 6 = 0 THEN concat('3 Адрес юридического лица 6300', c_custkey % 90, ', Город,') END, CASE WHEN c_custkey % 6 = 0 THEN concat('ул. Мира, ', c_custkey) END,
        CASE WHEN c_custkey % 3 = 0 THEN concat('12 Адрес электронной почты info', c_custkey, '@exam') END, CASE WHEN c_custkey % 3 = 0 THEN 'ple.com' END,
        CASE WHEN c_custkey % 9 = 0 THEN concat('ГРН и дата внесения 1', lpad(CAST(c_custkey AS STRING), 12, '0')) END,
        concat('01.02.2024 12:00 страница ', c_custkey % 9, ' из 9')) AS body
    FROM {customer}
    """,
)


def registry_rows(spark, sf):
    df = bound(spark, sf, REGISTRY, costly=True).select("document", "c_custkey", F.posexplode(F.split("body", "\n")).alias("i", "text"))
    lines = df.select("document", (F.col("c_custkey") * 100 + F.col("i")).alias("pos"), "text")
    return G.registry_lines(lines)


REG = f"""raw AS (SELECT document, c_custkey * 100 + unnest(range(len(x))) AS pos, unnest(x) AS text FROM (SELECT document, c_custkey, string_split(body, chr(10)) AS x FROM {sql_of(REGISTRY)})),
    reg AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY pos) AS n, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS f,
        starts_with(trim(lower(text)), 'сведения о ') OR starts_with(trim(lower(text)), 'сведения об ') AS head, regexp_matches(trim(text), '^\\d+\\s') AS num
        FROM raw WHERE NOT starts_with(lower(text), 'выписка из егрюл') AND NOT contains(text, 'страница'))"""


@query("registry_lines", f"WITH {REG} SELECT document, pos, text FROM reg")
def registry_lines(spark, sf):
    return registry_rows(spark, sf)


def value_sql(label):
    return rf"NULLIF(trim(regexp_replace(regexp_extract(trim(text), '(?i)^(?:\d+\s+)?{label}\s+(.+?)$', 1), '\s+', ' ', 'g')), '')"


@query(
    "registry_extract",
    f"""WITH {REG}, v AS (SELECT *, {value_sql("Фамилия")} AS sur, {value_sql("Имя")} AS fn, {value_sql("Отчество")} AS pat FROM reg),
    h AS (SELECT *, lead(f, 1) OVER w AS f1, lead(head OR num, 1) OVER w AS s1, lead(f, 2) OVER w AS f2, lead(head OR num, 2) OVER w AS s2, lead(f, 3) OVER w AS f3, lead(head OR num, 3) OVER w AS s3,
        coalesce(min(n) FILTER (WHERE head OR sur IS NOT NULL) OVER a, n + 8) AS stop_n,
        min(n) FILTER (WHERE fn IS NOT NULL) OVER a AS fn_n, arg_min(fn, n) FILTER (WHERE fn IS NOT NULL) OVER a AS fn_v,
        min(n) FILTER (WHERE pat IS NOT NULL) OVER a AS pat_n, arg_min(pat, n) FILTER (WHERE pat IS NOT NULL) OVER a AS pat_v
        FROM v WINDOW w AS (PARTITION BY document ORDER BY n), a AS (PARTITION BY document ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)),
    c AS (SELECT *, f || CASE WHEN s1 THEN '' ELSE coalesce(' ' || f1, '') || CASE WHEN s2 THEN '' ELSE coalesce(' ' || f2, '') || CASE WHEN s3 THEN '' ELSE coalesce(' ' || f3, '') END END END AS j FROM h),
    s AS (SELECT *, last_value(CASE WHEN NOT head THEN NULL WHEN contains(j, '{vocab.EXECUTIVE_SECTION}') THEN 'executive' WHEN contains(j, '{vocab.FOUNDERS_SECTION}') THEN 'founders' ELSE '' END IGNORE NULLS)
        OVER (PARTITION BY document ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM c),
    p AS (SELECT document, section, concat_ws(' ', sur, CASE WHEN fn_n < stop_n THEN fn_v END, CASE WHEN pat_n < stop_n THEN pat_v END) AS full_name, n FROM s
        WHERE NOT head AND section <> '' AND sur IS NOT NULL AND (fn_n < stop_n OR pat_n < stop_n))
    SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY document, section, full_name ORDER BY n) = 1""",
)
def registry_extract(spark, sf):
    return G.registry_extract(registry_rows(spark, sf))


@query(
    "registry_address",
    f"""WITH {REG}, v AS (SELECT *, {value_sql("Адрес юридического лица")} AS a FROM reg), k AS (SELECT document, min(n) AS l FROM v WHERE a IS NOT NULL GROUP BY document),
    e AS (SELECT v.document, l, coalesce(min(n) FILTER (WHERE n > l AND (head OR num)), 1000000000) AS e FROM v JOIN k ON v.document = k.document GROUP BY ALL)
    SELECT v.document, string_agg(CASE WHEN n = l THEN a ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END, ' ' ORDER BY n) AS address FROM v JOIN e ON v.document = e.document WHERE n >= l AND n < e GROUP BY v.document""",
)
def registry_address(spark, sf):
    return G.registry_address(registry_rows(spark, sf))


@query(
    "registry_emails",
    """SELECT document, email, grn FROM (SELECT c_nationkey AS document, 'info' || c_custkey || '@example.com' AS email,
    CASE WHEN c_custkey % 9 = 0 THEN '1' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') ELSE '' END AS grn FROM customer WHERE c_custkey % 3 = 0)""",
)
def registry_emails(spark, sf):
    # without other lines between, an address is read up to the next heading; the input ends each section with a heading
    lines = registry_rows(spark, sf)
    ends = lines.filter(F.contains("text", F.lit("ple.com"))).select("document", (F.col("pos") + 30).alias("pos"), F.lit("Сведения о записи").alias("text"))
    return G.registry_emails(lines.unionByName(ends))


SECTIONS = define(
    "sections_in",
    """
    SELECT c_custkey AS document, concat_ws(chr(10), 'Header', concat('Description: About ', c_name), 'second line', 'Industries', 'IT', 'it', concat('Bio ', c_custkey % 5),
        'Technologies', concat('Spark ', c_custkey % 3), 'Сайт', CASE WHEN c_custkey % 2 = 0 THEN concat('www.firm', c_custkey, '.ru/') ELSE concat('see https://firm', c_custkey, '.ru now') END,
        concat('ИНН: ', lpad(CAST(c_custkey AS STRING), 10 + CAST(c_custkey % 3 AS INT), '7')), 'Country of registration a legal entity or sole proprietorship', 'Россия', 'Беларусь',
        'Revenue', '2023', concat('1 ', 100 + c_custkey % 800, ' 000 ₽'), 'Pilots and contracts', 'none',
        'Contacts', CASE WHEN c_custkey % 4 = 0 THEN 'Full name of contact person' END, concat('Person ', c_custkey), CASE WHEN c_custkey % 4 = 0 THEN 'Email of contact person' END,
        CASE WHEN c_custkey % 4 <> 3 THEN concat('P', c_custkey, '@Firm.ru') END, concat('8 913 ', lpad(CAST(c_custkey AS STRING), 7, '5')), 'Product', 'other@mail.ru', '1997—2024') AS body
    FROM {customer}
    """,
)


@query(
    "labelled_sections",
    """SELECT c_custkey AS document, 'About ' || c_name || ' second line' AS description, 'IT; Bio ' || (c_custkey % 5) AS industries, 'Spark ' || (c_custkey % 3) AS technologies,
    CASE WHEN c_custkey % 2 = 0 THEN 'https://www.firm' || c_custkey || '.ru' ELSE 'https://firm' || c_custkey || '.ru' END AS website,
    CASE WHEN c_custkey % 3 = 1 THEN '' ELSE lpad(CAST(c_custkey AS VARCHAR), CAST(10 + c_custkey % 3 AS INTEGER), '7') END AS tin, 'Россия' AS country, '' AS legal_entity_name,
    '20231' || (100 + c_custkey % 800) || '000' AS revenue_amount, 'RUB' AS revenue_currency, 'Person ' || c_custkey AS contact_name,
    CASE WHEN c_custkey % 4 <> 3 THEN 'p' || c_custkey || '@firm.ru' ELSE '' END AS contact_email, '+7913' || lpad(CAST(c_custkey AS VARCHAR), 7, '5') AS contact_phone FROM customer""",
)
def labelled_sections(spark, sf):
    df = bound(spark, sf, SECTIONS, costly=True).select("document", F.posexplode(F.split("body", "\n")).alias("pos", "text"))
    return G.labelled_sections(df)


@query(
    "merge_profiles",
    """SELECT coalesce(a.k, d.k) AS k, coalesce(NULLIF(a.name, ''), d.name, a.name) AS name, coalesce(NULLIF(a.contact_email, ''), d.contact_email, a.contact_email) AS contact_email,
    coalesce(NULLIF(a.contact_phone, ''), d.contact_phone, a.contact_phone) AS contact_phone,
    CASE WHEN coalesce(coalesce(NULLIF(a.contact_email, ''), d.contact_email, a.contact_email), '') = '' AND coalesce(coalesce(NULLIF(a.contact_phone, ''), d.contact_phone, a.contact_phone), '') = ''
        AND coalesce(d.hidden, false) THEN 'auth_required_or_hidden_contacts' ELSE '' END AS error
    FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'a@x' ELSE '' END AS contact_email, '' AS contact_phone FROM customer) a
    FULL JOIN (SELECT c_custkey + 100 AS k, 'dom ' || c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN 'd@x' ELSE '' END AS contact_email, CASE WHEN c_custkey % 7 = 0 THEN '+7' ELSE '' END AS contact_phone,
        c_custkey % 2 = 1 AS hidden FROM customer) d ON a.k = d.k""",
)
def merge_profiles(spark, sf):
    c = table(spark, sf, "customer")
    api = spark.sql("SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN 'a@x' ELSE '' END AS contact_email, '' AS contact_phone FROM {c}", c=c)
    dom = spark.sql("SELECT c_custkey + 100 AS k, concat('dom ', c_name) AS name, CASE WHEN c_custkey % 5 = 0 THEN 'd@x' ELSE '' END AS contact_email, CASE WHEN c_custkey % 7 = 0 THEN '+7' ELSE '' END AS contact_phone, c_custkey % 2 = 1 AS hidden FROM {c}", c=c)
    return M.merge_profiles(api, dom, "k", "hidden")
