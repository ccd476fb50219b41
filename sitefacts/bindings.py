"""Inputs that the checks derive from the given tables.

Each text is plain SQL that Spark and DuckDB both accept and yields one row or more per row of the
table it reads, so the inputs grow with the tables.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

BINDINGS: dict[str, str] = {}
SPARK_BINDINGS: dict[str, str] = {}


def define(name: str, sql: str, spark: str | None = None) -> str:
    """Names an input; ``spark`` is the same rows in Spark's words, where the two read the text differently."""
    BINDINGS[name] = sql.strip()
    if spark is not None:
        SPARK_BINDINGS[name] = spark.strip()
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Puts the input of costly work per row on as many tasks as shuffles have: row groups can't be split."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def bound(spark: SparkSession, sf_dir: str, name: str, costly: bool = False) -> DataFrame:
    sql = SPARK_BINDINGS.get(name, BINDINGS[name])
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    if costly:
        used = {t: spread(df) for t, df in used.items()}
    return spark.sql(sql, **used)


def sql_of(name: str) -> str:
    """The same input as a sub-query for DuckDB."""
    return "(" + BINDINGS[name].format(**{t: t for t in TABLES}) + ")"


define(
    "urls_in",
    """
    SELECT page_id, url AS landed_url, CASE page_id % 8
        WHEN 0 THEN url
        WHEN 1 THEN replace(replace(url, 'https://', ''), 'http://', '')
        WHEN 2 THEN concat('  ', replace(replace(url, '.com/', '.com:443/'), '.net/', '.net:8080/'), ' ')
        WHEN 3 THEN replace(url, '.org/', '.org:bad/')
        WHEN 4 THEN replace(url, 'http', 'ftp')
        WHEN 5 THEN replace(replace(url, 'example.com', 'reg.ru'), 'http://', 'HTTP://WWW.')
        WHEN 6 THEN replace(replace(url, 'example.net', 'example.co.uk'), '?page', '/?page')
        ELSE replace(url, '/en/', '//book-online/') END AS url
    FROM {pages}
    """,
)
define(
    "links_in",
    """
    SELECT event_id AS pos, CAST(user_id AS STRING) AS firm_id,
        concat('https://www.firm', user_id % 40, '.example.com/') AS site_url,
        CASE event_id % 20
        WHEN 0 THEN concat('https://spb.hh.ru/employer/', user_id % 60, '?utm_source=card&from=a%20b')
        WHEN 1 THEN concat('https://hh.ru/vacancy/', user_id % 60)
        WHEN 2 THEN concat('https://t.me/Club_', user_id % 30, '/')
        WHEN 3 THEN concat('t.me/s/news_', user_id % 30, '?before=', user_id)
        WHEN 4 THEN 'https://telegram.me/share/url?url=x'
        WHEN 5 THEN concat('https://t.me/+inv', user_id)
        WHEN 6 THEN concat('https://max.ru/channels/c', user_id % 20, '#top')
        WHEN 7 THEN concat('https://max.ru/about/', user_id % 20)
        WHEN 8 THEN concat('https://dzen.ru/id/', user_id % 20, '/')
        WHEN 9 THEN concat('https://www.drive2.ru/r/', user_id % 20)
        WHEN 10 THEN concat('https://rutube.ru/channel/', user_id % 20, '/?p=1')
        WHEN 11 THEN concat('https://www.youtube.com/@studio', user_id % 20)
        WHEN 12 THEN concat('https://vk.com/club', user_id % 50, '#wall')
        WHEN 13 THEN 'https://vk.com/share.php?url=x'
        WHEN 14 THEN concat('https://www.instagram.com/clinic.', user_id % 20, '/?hl=en')
        WHEN 15 THEN concat('https://instagram.com/p/', user_id)
        WHEN 16 THEN concat('https://n', user_id % 25, '.yclients.com/company/', user_id, '/record')
        WHEN 17 THEN concat('https://www.firm', user_id % 40, '.example.com/booking/', user_id % 9)
        WHEN 18 THEN concat('https://shop', user_id % 30, '.example.org:8443/item?x=', user_id % 5)
        ELSE concat('https://twitter.com/intent/', user_id) END AS raw_url
    FROM {events}
    """,
)
# pages with the parts that the given pages lack: header, cards, prices, booking parts, contacts
define(
    "pages_in",
    """
    SELECT page_id, url, concat('https://', replace(substring(url, position('//' IN url) + 2, position('.example' IN url) - position('//' IN url) - 2), 'www.', ''), '.example.org/') AS site,
    replace(html, '</article>', concat('</article>',
        '<header><a href="https://www.instagram.com/clinic', page_id % 30, '/?hl=en">i</a><a href="https://t.me/club', page_id % 30, '#x">t</a></header>',
        '<div class="team-card" id="d', page_id, '"><h3>Иванов Иван', CASE WHEN page_id % 3 = 0 THEN ' Петрович' ELSE '' END, '</h3><p>', CASE WHEN page_id % 4 = 0 THEN '' ELSE 'врач-ортодонт' END,
        ' +7 (913) 555-10-', lpad(CAST(page_id % 100 AS STRING), 2, '0'), '</p><span>doc', page_id, '@clinic.example.com</span></div>',
        '<div class="staff">Наша Клиника</div>',
        '<ul><li>Консультация ', page_id, ' — от ', page_id + 100, ' руб.</li><li>Снимок до 1 500 руб</li></ul>',
        '<table><tr><th>Услуга</th><th>Цена</th></tr><tr><td>Осмотр</td><td>', page_id + 1000, ' - ', page_id + 2000, ' ₽</td></tr></table>',
        '<form id="f', page_id, '" action="https://n', page_id % 25, '.yclients.com/record"><input name="phone" placeholder="имя"></form>',
        CASE WHEN page_id % 5 = 0 THEN '<form id="call"><p>Онлайн запись</p><input name="phone"></form>' ELSE '' END,
        '<a class="btn" href="/booking/', page_id % 7, '">Запись</a><iframe src="https://w', page_id % 9, '.medflex.ru/w"></iframe>',
        '<a href="https://partner.example.net/visit">записаться</a>',
        '<a href="https://clck.ru/', page_id % 3, '">s</a><a href="https://code.jivo.chat/x">c</a><a href="https://bad.example.net:port/">b</a>',
        '<a href="https://vk.com/club', page_id % 11, '#w">v</a><a href="https://shop', page_id % 13, '.example.net/p?x=1">o</a>',
        '<div class="contacts">ИНН 77', lpad(CAST(page_id % 40 AS STRING), 8, '0'), ', ОГРН 1', lpad(CAST(page_id % 40 AS STRING), 12, '0'),
        ' тел. 8 (383) 255-', lpad(CAST(page_id % 40 AS STRING), 2, '0'), '-11 Info', page_id % 40, '@Example.com</div>')) AS html
    FROM {pages}
    """,
)
