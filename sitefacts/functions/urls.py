"""URL columns. A URL is split once into flat columns; every later rule reads those.

Hosts outside ASCII are encoded by the JDK's own IDNA class, reached through the built-in
``try_reflect``, and only on the rows that need it, so no rule here leaves the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefacts import vocab
from sitefacts.functions.text import empty_to_null, strip, text_of

URL_PARTS = ("scheme", "netloc", "path", "query", "fragment")
SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def encode_host(host: Column) -> Column:
    """ASCII form of a lower-cased host; a host that cannot be encoded is kept."""
    encoded = F.call_function("try_reflect", F.lit("java.net.IDN"), F.lit("toASCII"), host)
    return F.when(host.rlike(r"[^\x00-\x7F]"), F.coalesce(encoded, host)).otherwise(host)


def decode_host(host: Column) -> Column:
    """Unicode form of a host that has an ``xn--`` label."""
    decoded = F.call_function("try_reflect", F.lit("java.net.IDN"), F.lit("toUnicode"), host)
    return F.when(F.contains(host, F.lit("xn--")), F.coalesce(decoded, host)).otherwise(host)


def bare_host(host: Column) -> Column:
    """Lower case, without a leading ``www.``, ASCII."""
    low = F.lower(F.trim(text_of(host)))
    return encode_host(F.when(low.startswith("www."), F.substr(low, F.lit(5))).otherwise(low))


def split_url(df: DataFrame, url: str, prefix: str = "_", default_scheme: bool = False) -> DataFrame:
    """Adds scheme, netloc, path, query, fragment, host, port and port_ok under the prefix.

    ``port`` is NULL when absent; ``port_ok`` is false when a port is written that is no number up
    to 65535.
    """
    value = F.translate(strip(text_of(url)), "\n\r\t", "")
    if default_scheme:
        value = F.when((value == "") | F.contains(value, F.lit("://")), value).otherwise(
            F.concat(F.lit("https://"), value)
        )
    df = df.withColumn(f"{prefix}url", value)
    # every part is one pattern over the whole URL: a filter on a derived column is pushed down by
    # putting the column's expression in its place, and parts cut from parts would multiply there
    part = lambda i: F.regexp_extract(f"{prefix}url", SPLIT, i)
    parts = {f"{prefix}{name}": part(i + 1) for i, name in enumerate(URL_PARTS)}
    parts[f"{prefix}scheme"] = F.lower(parts[f"{prefix}scheme"])
    server = F.substring_index(part(2), "@", -1)
    parts[f"{prefix}hostname"] = F.lower(F.regexp_extract(server, r"^(\[[^\]]*\]|[^:]*)", 1))
    parts[f"{prefix}port_text"] = F.regexp_extract(server, r":([^:\]]*)$", 1)
    df = df.withColumns(parts)
    text = F.col(f"{prefix}port_text")
    number = F.when(text.rlike("^[0-9]+$"), text.try_cast("int"))
    return df.withColumns(
        {
            f"{prefix}host": bare_host(F.col(f"{prefix}hostname")),
            f"{prefix}port": number,
            f"{prefix}port_ok": (text == "") | F.coalesce(number <= 65535, F.lit(False)),
        }
    )


def drop_parts(df: DataFrame, prefix: str = "_") -> DataFrame:
    names = [*URL_PARTS, "url", "hostname", "port_text", "host", "port", "port_ok"]
    return df.drop(*[f"{prefix}{n}" for n in names])


def under(host: Column, domain: Column | str) -> Column:
    """The host is the domain or lies below it."""
    if isinstance(domain, str):
        return under_any(host, (domain,))
    return (host == domain) | F.endswith(host, F.concat(F.lit("."), domain))


def under_any(host: Column, domains: Iterable[str]) -> Column:
    """As ``under`` for a short fixed list."""
    return host.rlike(r"(?:^|\.)(?:" + "|".join(re.escape(d) for d in domains) + ")$")


def origin_domain(host: Column, second_level: Iterable[str] = vocab.SECOND_LEVEL_TLDS) -> Column:
    """Registrable domain: the last two labels, three below a country's second-level domains."""
    labels = F.filter(F.split(host, r"\."), lambda p: p != "")
    n = F.size(labels)
    three = (F.length(F.try_element_at(labels, F.lit(-1))) == 2) & F.try_element_at(labels, F.lit(-2)).isin(
        *second_level
    )
    return F.when(n <= 2, host).otherwise(
        F.array_join(F.slice(labels, -F.when(three, F.lit(3)).otherwise(F.lit(2)), F.lit(3)), ".")
    )


def clean_path(path: Column) -> Column:
    """``/`` for an empty path; no trailing slash on a longer one."""
    p = F.when(path == "", F.lit("/")).otherwise(path)
    return F.when(F.length(p) > 1, F.regexp_replace(p, "/+$", "")).otherwise(p)


def with_query(url: Column, query: Column) -> Column:
    return F.when(query != "", F.concat(url, F.lit("?"), query)).otherwise(url)


def shown_netloc(prefix: str = "_") -> Column:
    """Host, with the port only where it is not the scheme's own."""
    host, port, scheme = (F.col(f"{prefix}{n}") for n in ("host", "port", "scheme"))
    usual = F.when(scheme == "http", F.lit(80)).otherwise(F.lit(443))
    return F.when(port.isNotNull() & (port != 0) & (port != usual), F.concat(host, F.lit(":"), port)).otherwise(host)


def resolve(base: str, href: Column, prefix: str = "_b") -> Column:
    """The href seen from the page whose parts are in the prefixed columns of ``split_url``.

    Absolute, scheme-relative, root-relative, query-only, fragment-only and path-relative hrefs are
    told apart by their first characters; dot segments are removed from relative paths.
    """
    scheme, netloc, path, query = (F.col(f"{prefix}{n}") for n in ("scheme", "netloc", "path", "query"))
    site = F.concat(scheme, F.lit("://"), netloc)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(site, without_dots(href)))
        .when(href.startswith("?"), F.concat(site, path, href))
        .when((href == "") | href.startswith("#"), F.concat(with_query(F.concat(site, path), query), href))
        .otherwise(F.concat(site, without_dots(F.concat(folder, href))))
    )


def without_dots(target: Column) -> Column:
    """Removes ``.`` and ``..`` segments from the path in front of a query or fragment."""
    path = F.regexp_extract(target, r"^([^?#]*)", 1)
    rest = F.regexp_extract(target, r"^[^?#]*(.*)$", 1)
    segments = F.split(path, "/")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.array_join(kept, "/")
    joined = F.when(path.rlike(r"(?:^|/)\.{1,2}$") & ~F.endswith(joined, F.lit("/")), F.concat(joined, F.lit("/"))).otherwise(
        joined
    )
    return F.when(path.rlike(r"(?:^|/)\.{1,2}(?:/|$)"), F.concat(joined, rest)).otherwise(target)


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)#.*$", "")


def url_or_null(url: Column) -> Column:
    return empty_to_null(url)
