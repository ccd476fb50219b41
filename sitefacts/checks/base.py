"""Registry of queries: a Spark job over the given tables, with SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is defined twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def parts_sql(source: str, url: str = "url", default_scheme: bool = True, tag: str = "p") -> str:
    """CTE chain ``{tag}`` that splits a URL column for DuckDB, as ``functions.urls.split_url`` does."""
    u = f"trim({url})"
    if default_scheme:
        u = f"CASE WHEN {u} = '' OR contains({u}, '://') THEN {u} ELSE 'https://' || {u} END"
    return rf"""
    {tag}1 AS (SELECT *, {u} AS u FROM {source}),
    {tag}2 AS (SELECT *,
        lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
        regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) AS netloc,
        regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS path,
        regexp_extract(u, '^[^?#]*\?([^#]*)', 1) AS query,
        regexp_extract(u, '#(.*)$', 1) AS fragment FROM {tag}1),
    {tag}3 AS (SELECT *,
        lower(regexp_extract(netloc, '^([^:]*)', 1)) AS hostname,
        regexp_extract(netloc, ':([^:]*)$', 1) AS port_text FROM {tag}2),
    {tag} AS (SELECT *,
        regexp_replace(hostname, '^www\.', '') AS host,
        TRY_CAST(NULLIF(port_text, '') AS BIGINT) AS port,
        port_text = '' OR coalesce(TRY_CAST(port_text AS BIGINT) BETWEEN 0 AND 65535, false) AS port_ok,
        CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(path, '/+$', '') END AS clean
        FROM {tag}3)"""


def under_sql(host: str, *domains: str) -> str:
    return "(" + " OR ".join(f"{host} = '{d}' OR ends_with({host}, '.{d}')" for d in domains) + ")"


def list_sql(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def origin_sql(host: str) -> str:
    p = f"list_filter(string_split({host}, '.'), lambda x: x <> '')"
    return f"""CASE WHEN len({p}) <= 2 THEN {host}
        WHEN length({p}[-1]) = 2 AND {p}[-2] IN ('co','com','org','net','gov','edu') THEN array_to_string({p}[-3:], '.')
        ELSE array_to_string({p}[-2:], '.') END"""


NETLOC_SQL = (
    "CASE WHEN port IS NOT NULL AND port <> 0 AND NOT (scheme = 'http' AND port = 80) "
    "AND NOT (scheme = 'https' AND port = 443) THEN host || ':' || port ELSE host END"
)
USABLE_SQL = (
    "scheme IN ('http','https') AND host <> '' AND port_ok AND NOT " + under_sql("host", "reg.ru")
)
FORCED_SQL = "CASE WHEN port IS NULL OR port IN (80, 443) THEN 'https' ELSE scheme END"
QUERY_SQL = "CASE WHEN query <> '' THEN '?' || query ELSE '' END"
HTTP_SQL = f"CASE WHEN {USABLE_SQL} THEN scheme || '://' || {NETLOC_SQL} || clean || {QUERY_SQL} END"
