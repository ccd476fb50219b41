"""URL, host and domain columns (projections and filters over a URL column)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefacts import vocab
from sitefacts.functions import text as T
from sitefacts.functions import urls as U
from sitefacts.operators.first import first_per_key

WEB = ("http", "https")


def _parts(df: DataFrame, col: str, default_scheme: bool = True) -> DataFrame:
    return U.split_url(df, F.col(col), default_scheme=default_scheme)


def _usable(prefix: str = "_") -> Column:
    """A web URL with a host that is not blocked and a port that parses."""
    scheme, host, port_ok = (F.col(f"{prefix}{n}") for n in ("scheme", "host", "port_ok"))
    return scheme.isin(*WEB) & (host != "") & port_ok & ~U.under(host, vocab.BLOCKED_HOST)


def http_url(prefix: str = "_") -> Column:
    """Canonical web URL over the columns of ``split_url``, NULL where there is none."""
    scheme, path, query = (F.col(f"{prefix}{n}") for n in ("scheme", "path", "query"))
    value = U.with_query(F.concat(scheme, F.lit("://"), U.shown_netloc(prefix), U.clean_path(path)), query)
    return F.when(_usable(prefix), value)


def with_site_origin(df: DataFrame, col: str, out: str = "site", variant: str = "site") -> DataFrame:
    """``https://host/`` of a site.

    ``site`` gives an empty string for unusable input, ``homepage`` NULL; ``origin`` gives NULL, keeps
    a port that is not the scheme's own and refuses the blocked host.
    """
    df = _parts(df, col)
    plain = F.when(
        F.col("_scheme").isin(*WEB) & (F.col("_host") != ""), F.concat(F.lit("https://"), F.col("_host"), F.lit("/"))
    )
    if variant == "origin":
        value = F.when(_usable(), F.concat(_forced_scheme(), F.lit("://"), U.shown_netloc(), F.lit("/")))
    elif variant == "homepage":
        value = plain
    else:
        value = F.coalesce(plain, F.lit(""))
    return U.drop_parts(df.withColumn(out, value))


def _forced_scheme() -> Column:
    port = F.col("_port")
    return F.when(port.isNull() | port.isin(80, 443), F.lit("https")).otherwise(F.col("_scheme"))


def with_http_url(df: DataFrame, col: str, out: str = "http_url") -> DataFrame:
    """Fragment dropped, host normalised, default port and trailing slash dropped, query kept."""
    df = _parts(df, col, default_scheme=False)
    return U.drop_parts(df.withColumn(out, http_url()))


def with_crawl_url(df: DataFrame, col: str, out: str = "crawl_url", keep_scheme: bool = False) -> DataFrame:
    """As ``with_http_url`` without the query; https is forced unless another port is written.

    ``keep_scheme`` neither forces https, adds a scheme nor knows a blocked host.
    """
    df = _parts(df, col, default_scheme=not keep_scheme)
    scheme = F.col("_scheme") if keep_scheme else _forced_scheme()
    usable = (
        F.col("_scheme").isin(*WEB) & (F.col("_host") != "") & F.col("_port_ok") if keep_scheme else _usable()
    )
    value = F.concat(scheme, F.lit("://"), U.shown_netloc(), U.clean_path(F.col("_path")))
    return U.drop_parts(df.withColumn(out, F.when(usable, value)))


def with_start_url(df: DataFrame, col: str, out: str = "start_url", error: str = "error") -> DataFrame:
    """Scheme, server and path as written; unusable input gives NULL and says why."""
    df = _parts(df, col)
    path = F.when(F.col("_path") == "", F.lit("/")).otherwise(F.col("_path"))
    message = (
        F.when(F.col("_url") == "", F.lit("Empty URL"))
        .when(~F.col("_scheme").isin(*WEB) | (F.col("_netloc") == ""), F.concat(F.lit("Invalid URL: "), F.col(col)))
        .when(
            U.under(F.col("_host"), vocab.BLOCKED_HOST), F.concat(F.lit("Blocked host for crawl: "), F.col("_hostname"))
        )
    )
    df = df.withColumn(error, message)
    value = F.concat(F.col("_scheme"), F.lit("://"), F.col("_netloc"), path)
    return U.drop_parts(df.withColumn(out, F.when(F.col(error).isNull(), value)))


def with_internal_url(links: DataFrame, href: str, page_url: str, origin: str, out: str = "internal_url") -> DataFrame:
    """The href as a page of the same registrable domain, NULL when it is none."""
    raw = T.strip(T.text_of(href))
    df = U.split_url(links, F.col(page_url), prefix="_b")
    df = df.withColumn("_full", U.without_fragment(U.resolve("_b", raw)))
    df = U.split_url(U.drop_parts(df, "_b"), F.col("_full"))
    # the server is compared as written, a port makes it another server
    server = F.regexp_replace(F.lower("_netloc"), r"^www\.", "")
    keep = (
        (raw != "")
        & ~F.lower(raw).rlike("^(?:mailto:|tel:|javascript:|data:)")
        & F.col("_scheme").isin(*WEB)
        & (F.col("_netloc") != "")
        & ~U.under(server, vocab.BLOCKED_HOST)
        & U.under(server, F.col(origin))
        & ~_is_binary(F.col("_path"))
    )
    value = U.with_query(
        F.concat(F.col("_scheme"), F.lit("://"), F.col("_netloc"), U.clean_path(F.col("_path"))), F.col("_query")
    )
    return U.drop_parts(df.withColumn(out, F.when(keep, value)).drop("_full"))


def _is_binary(path: Column, extensions: Iterable[str] = vocab.BINARY_EXTENSIONS) -> Column:
    return F.lower(path).rlike("(?:" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$")


def with_site_key(df: DataFrame, col: str, out: str = "site_key") -> DataFrame:
    """Host of the normalised site, empty for unusable input: the join key of sites."""
    df = _parts(df, col)
    return U.drop_parts(df.withColumn(out, F.when(F.col("_scheme").isin(*WEB), F.col("_host")).otherwise(F.lit(""))))


def with_domain(df: DataFrame, col: str, out: str = "domain", variant: str = "import") -> DataFrame:
    """``import`` gives the Unicode host without a trailing dot; ``mail`` the ASCII mail domain."""
    if variant == "import":
        df = _parts(df, col)
        host = F.regexp_replace(F.regexp_replace(F.col("_hostname"), r"^www\.", ""), r"\.+$", "")
        return U.drop_parts(df.withColumn(out, U.decode_host(host)))
    value = F.regexp_replace(T.strip(T.text_of(col)), r"""^[()\[\]{}<>"']+|[()\[\]{}<>"']+$""", "")
    is_url = F.contains(value, F.lit("://"))
    value = F.when(~is_url & F.contains(value, F.lit("@")), F.substring_index(value, "@", -1)).otherwise(value)
    from_url = F.regexp_extract(value, r"^[^:]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    bare = T.strip(F.regexp_extract(value, r"^([^/?]*)", 1))
    bare = F.when(bare.startswith("["), bare).otherwise(F.regexp_extract(bare, r"^([^:]*)", 1))
    df = df.withColumn("_h", F.lower(F.when(is_url, from_url).otherwise(bare)))
    host = F.regexp_replace(F.regexp_replace("_h", r"^\.+|\.+$", ""), r"^www\.", "")
    df = df.withColumn("_h", host)
    ok = F.contains(F.col("_h"), F.lit(".")) & ~F.col("_h").rlike(T.WS)
    return df.withColumn(out, F.when(ok, U.encode_host(F.col("_h"))).otherwise(F.lit(""))).drop("_h")


def explode_domain_keys(df: DataFrame, col: str, out: str = "domain_key") -> DataFrame:
    """One row per distinct form (Unicode, ASCII) of the domain; no row for an empty one."""
    df = with_domain(df, col, "_d")
    keys = F.when(F.col("_d") != "", F.array_distinct(F.array(F.col("_d"), U.encode_host(F.col("_d")))))
    return df.withColumn(out, F.explode(keys)).drop("_d")


def with_host(df: DataFrame, col: str, out: str = "host") -> DataFrame:
    """Host column to lower case, without ``www.``, ASCII."""
    return df.withColumn(out, U.bare_host(F.col(col)))


def with_url_host(df: DataFrame, col: str, out: str = "host") -> DataFrame:
    df = _parts(df, col)
    return U.drop_parts(df.withColumn(out, F.col("_host")))


def with_origin_domain(df: DataFrame, host: str, out: str = "origin_domain") -> DataFrame:
    return df.withColumn(out, U.origin_domain(F.col(host)))


def with_internal_flag(links: DataFrame, url: str, site: str, out: str = "is_internal", exact: bool = False) -> DataFrame:
    """Whether the URL belongs to the site: by registrable domain, or (``exact``) by the site's own host."""
    df = U.split_url(links, F.col(url), prefix="_l")
    df = U.split_url(df, F.col(site), prefix="_s")
    own = F.col("_shost") if exact else U.origin_domain(F.col("_shost"))
    flag = (F.col("_lhost") != "") & (F.col("_shost") != "") & U.under(F.col("_lhost"), own)
    return U.drop_parts(U.drop_parts(df.withColumn(out, flag), "_l"), "_s")


def match_domain_list(df: DataFrame, host: str, list_df: DataFrame, domain: str = "domain", priority: str = "priority", name: str = "name", out: str = "list_name") -> DataFrame:
    """Adds the name of the first list that holds the host or a parent domain of it.

    The suffixes of each distinct host meet the list in an equi-join; no row is compared with every
    list entry, and the host column is reduced to distinct values before anything is exploded.
    """
    hosts = df.select(F.col(host).alias("_h")).distinct()
    labels = F.split("_h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = (
        hosts.withColumn("_s", F.explode(suffixes))
        .join(list_df.select(F.col(domain).alias("_s"), F.col(priority).alias("_p"), F.col(name).alias("_n")), "_s")
        .groupBy("_h")
        .agg(F.min_by("_n", F.struct("_p", "_n")).alias(out))
    )
    return df.join(found.withColumnRenamed("_h", host), host, "left")


def platform_kind(host: Column) -> Column:
    return (
        F.when(U.under_any(host, vocab.VIDEO_HOSTS), F.lit("video_hosting"))
        .when(U.under(host, vocab.DRIVE2_HOST), F.lit("drive2"))
        .when(U.under_any(host, vocab.SOCIAL_HOSTS), F.lit("social_network"))
    )


def with_platform_kind(df: DataFrame, col: str, out: str = "platform") -> DataFrame:
    df = _parts(df, col)
    return U.drop_parts(df.withColumn(out, platform_kind(F.col("_host"))))


def _form_encoded(query: Column, dropped: Iterable[str] = vocab.TRACKING_KEYS) -> Column:
    """Query without the tracking keys, each pair decoded and form-encoded again, blanks kept."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    decode = lambda c: F.coalesce(F.try_url_decode(c), c)
    key = lambda p: decode(F.substring_index(p, "=", 1))
    value = lambda p: decode(F.when(F.contains(p, F.lit("=")), F.regexp_extract(p, "=(.*)$", 1)).otherwise(F.lit("")))
    kept = F.filter(pairs, lambda p: ~F.lower(key(p)).isin(*dropped))
    encode = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.array_join(F.transform(kept, lambda p: F.concat(encode(key(p)), F.lit("="), encode(value(p)))), "&")


def profile_url(network: str, prefix: str = "_", reject_service: bool = False) -> Column:
    """Canonical profile URL of a network over the columns of ``split_url``."""
    scheme, host, query, raw = (F.col(f"{prefix}{n}") for n in ("scheme", "host", "query", "path"))
    path = F.regexp_replace(raw, "/+$", "")
    segment = F.lower(F.regexp_extract(raw, "^/*([^/]*)", 1))
    url = F.concat(F.lit("https://"), host, path)
    if network == "hh":
        return F.when(U.under(host, vocab.HH_HOST) & path.startswith("/employer"), U.with_query(url, _form_encoded(query)))
    if network == "instagram":
        handle = _instagram_handle(raw)
        known = scheme.isin(*WEB) & host.isin(*vocab.INSTAGRAM_HOSTS) & handle.isNotNull()
        return F.when(known, F.concat(F.lit("https://www.instagram.com/"), handle, F.lit("/")))
    known = {
        "telegram": host.isin(*vocab.TELEGRAM_HOSTS) & (path != ""),
        "max": U.under(host, vocab.MAX_HOST) & (segment.isin("channel", "channels", "c") | segment.startswith("@")),
        "dzen": U.under(host, vocab.DZEN_HOST) & (path != ""),
    }[network]
    if reject_service:
        known = known & scheme.isin(*WEB) & ~segment.isin(*vocab.TELEGRAM_SERVICE_PATHS)
    return F.when(known, U.with_query(url, query))


def canonical_profile_url(df: DataFrame, col: str, networks: str | Iterable[str], out: str | None = None, reject_service: bool = False) -> DataFrame:
    """Canonical profile URLs (hh, telegram, max, dzen, instagram), NULL for anything else."""
    names = [networks] if isinstance(networks, str) else list(networks)
    df = _parts(df, col)
    return U.drop_parts(df.withColumns({out or f"{n}_url": profile_url(n, reject_service=reject_service) for n in names}))


def _instagram_handle(path: Column) -> Column:
    name = F.regexp_replace(T.strip(F.regexp_extract(path, "^/*([^/]*)", 1)), "^@+", "")
    ok = name.rlike(r"^[A-Za-z0-9._]{1,30}$") & ~F.lower(name).isin(*vocab.INSTAGRAM_SERVICE_PATHS)
    return F.when(ok, name)


def profile_handle(df: DataFrame, col: str, network: str, out: str = "handle", web: str = "web_url") -> DataFrame:
    """User name in a profile URL; for telegram also the web client's URL."""
    df = _parts(df, col)
    path = F.col("_path")
    if network == "instagram":
        return U.drop_parts(df.withColumn(out, _instagram_handle(path)))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    first = F.lower(F.try_element_at(segments, F.lit(1)))
    raw = F.when(first == "s", F.try_element_at(segments, F.lit(2))).when(
        ~first.isin("joinchat", *vocab.TELEGRAM_SERVICE_PATHS) & ~first.startswith("+"), F.try_element_at(segments, F.lit(1))
    )
    name = T.strip(F.regexp_replace(raw, "^@+", ""))
    df = df.withColumn(out, F.when(name.rlike(r"^[A-Za-z0-9_]{3,64}$"), name))
    return U.drop_parts(df.withColumn(web, F.concat(F.lit("https://web.telegram.org/k/#@"), F.col(out))))


def link_kinds(df: DataFrame, kind: str, url: str, host: str, prefix: str = "_", web_prefix: str = "_w") -> DataFrame:
    """Kind, canonical URL and its host over two splits of a link: with and without a default scheme."""
    h = F.col(f"{prefix}host")
    own = {"hh": "hh", "max": "max", "telegram": "tg", "dzen": "dzen"}
    df = df.withColumns({**{f"_c_{v}": profile_url(k, prefix) for k, v in own.items()}, "_c_http": http_url(web_prefix)})
    chosen = None
    for k, v in own.items():
        found = F.col(f"_c_{v}").isNotNull()
        chosen = F.when(found, F.lit(k)) if chosen is None else chosen.when(found, F.lit(k))
    platform = platform_kind(F.when(F.col("_c_http").isNotNull(), h))
    renamed = {"drive2": "drive2", "video_hosting": "video", "social_network": "social"}
    df = df.withColumn(kind, F.coalesce(chosen, *[F.when(platform == k, F.lit(v)) for k, v in renamed.items()]))
    found = F.coalesce(*[F.col(f"_c_{v}") for v in own.values()], "_c_http")
    return df.withColumns({url: F.when(F.col(kind).isNotNull(), found), host: F.when(F.col(kind).isNotNull(), h)}).drop(
        *[f"_c_{v}" for v in own.values()], "_c_http"
    )


def with_link_kind(df: DataFrame, col: str, kind: str = "kind", url: str = "link_url", host: str = "link_host") -> DataFrame:
    """Cascade over the networks: kind, canonical URL and its host, all NULL for other links."""
    df = U.split_url(_parts(df, col), F.col(col), "_w")
    return U.drop_parts(U.drop_parts(link_kinds(df, kind, url, host)), "_w")


def with_social_field(df: DataFrame, col: str, explicit: str | None = None, out: str = "field") -> DataFrame:
    """Profile column a URL belongs to; a given column name wins over the host."""
    df = with_domain(df, col, "_d")
    h = F.col("_d")
    field = (
        F.when(U.under(h, vocab.HH_HOST), F.lit("hh_profile"))
        .when(h.isin(*vocab.TELEGRAM_HOSTS), F.lit("tg_profile"))
        .when(U.under(h, vocab.MAX_HOST), F.lit("max_profile"))
        .when(U.under(h, "vk.com"), F.lit("vk_profile"))
        .when(U.under(h, vocab.DZEN_HOST) | (h == "zen.yandex.ru"), F.lit("dzen_profile"))
        .when(U.under(h, "rutube.ru"), F.lit("rutube_profile"))
        .when(U.under(h, "instagram.com"), F.lit("instagram_profile"))
        .when(U.under(h, "youtube.com") | (h == "youtu.be"), F.lit("youtube_profile"))
    )
    if explicit:
        field = F.coalesce(T.empty_to_null(F.col(explicit)), field)
    return df.withColumn(out, field).drop("_d")


def share_link(prefix: str = "_") -> Column:
    """Condition over ``split_url`` columns: a share or intent link, or one of the dropped network."""
    h, p = F.col(f"{prefix}hostname"), F.col(f"{prefix}path")
    return (
        U.under(h, vocab.DRIVE2_HOST)
        | ((h.isin(*vocab.TELEGRAM_HOSTS) | (h == "vk.com")) & p.startswith("/share"))
        | (h.isin("x.com", "twitter.com") & p.startswith("/intent"))
    )


def drop_share_links(df: DataFrame, col: str) -> DataFrame:
    df = U.split_url(df, F.col(col))
    return U.drop_parts(df.filter(~share_link()))


def filter_valid_port(df: DataFrame, col: str) -> DataFrame:
    """Drops web URLs whose port is not a number up to 65535; other URLs pass."""
    df = U.split_url(df, F.col(col))
    return U.drop_parts(df.filter(~F.col("_scheme").isin(*WEB) | F.col("_port_ok")))


def valid_fqdn(host: Column) -> Column:
    name = U.encode_host(F.regexp_replace(F.lower(T.strip(T.text_of(host))), r"\.+$", ""))
    labels = F.split(name, r"\.")
    return (
        (F.length(name) <= 253)
        & (F.size(labels) >= 2)
        & F.forall(labels, lambda l: l.rlike(r"^[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?$"))
        & (F.length(F.element_at(labels, -1)) >= 2)
    )


def filter_valid_fqdn(df: DataFrame, host: str) -> DataFrame:
    return df.filter(valid_fqdn(F.col(host)))


def with_display_url(df: DataFrame, col: str, out: str = "display_url") -> DataFrame:
    """The URL with its host in Unicode and without fragment; kept as it is when it has no host."""
    df = _parts(df, col)
    host = U.decode_host(F.col("_hostname"))
    netloc = F.when(F.col("_port_ok") & F.col("_port").isNotNull() & (F.col("_port") != 0), F.concat(host, F.lit(":"), F.col("_port"))).otherwise(host)
    path = F.when(F.col("_path") == "", F.lit("/")).otherwise(F.col("_path"))
    value = U.with_query(F.concat(F.col("_scheme"), F.lit("://"), netloc, path), F.col("_query"))
    return U.drop_parts(df.withColumn(out, F.when(F.col("_hostname") == "", F.col(col)).otherwise(value)))


def with_domain_slug(df: DataFrame, col: str, out: str = "slug") -> DataFrame:
    """Unicode host with everything but word characters, dots and hyphens replaced by ``_``."""
    df = U.split_url(df, F.col(col))
    host = U.decode_host(F.regexp_replace("_hostname", r"^www\.", ""))
    return U.drop_parts(df.withColumn(out, F.regexp_replace(host, r"[^\p{L}\p{N}_.\-]", "_")))


def with_link_priority(links: DataFrame, url: str, anchor: str, out: str = "priority", hints: Iterable[str] = vocab.CRAWL_HINTS) -> DataFrame:
    """Number of hint words in the decoded URL and the anchor text."""
    decoded = F.coalesce(F.try_url_decode(F.replace(F.col(url), F.lit("+"), F.lit("%2B"))), F.col(url))
    links = links.withColumn("_t", T.fold_yo(F.lower(F.concat(decoded, F.lit(" "), T.text_of(anchor)))))
    return links.withColumn(out, T.count_contained(F.col("_t"), hints)).drop("_t")


def with_booking_hint(df: DataFrame, col: str, out: str = "booking_hint", hints: Iterable[str] = vocab.BOOKING_URL_HINTS) -> DataFrame:
    """A booking word occurs in server, path or query of a usable web URL."""
    df = with_http_url(df, col, "_http")
    where = T.match_text(F.regexp_extract(F.coalesce("_http", F.lit("")), r"^[a-z]+://(.*)$", 1))
    return df.withColumn(out, T.contains_any(where, hints)).drop("_http")


def best_site_per_host(df: DataFrame, firm: str, url: str, pos: str) -> DataFrame:
    """Per firm and host the best URL: https, root path, no port, shorter path, then the earlier one."""
    df = U.split_url(df, F.col(url))
    path = F.when(F.col("_path") == "", F.lit("/")).otherwise(F.col("_path"))
    df = df.withColumn("site_host", F.col("_hostname")).withColumn(
        "_score",
        F.struct(
            (F.col("_scheme") != "https").alias("a"),
            (path != "/").alias("b"),
            F.col("_port").isNotNull().alias("c"),
            F.length(path).alias("d"),
        ),
    )
    df = U.drop_parts(df.filter(F.col("_hostname") != ""))
    return first_per_key(df, [firm, "site_host"], ["_score", pos]).drop("_score")


def explode_values(df: DataFrame, col: str, out: str = "value", seps: str = ";,") -> DataFrame:
    """One row per trimmed non-empty part of a multi-value cell, with its position."""
    parts = F.filter(F.transform(F.split(T.text_of(col), f"[{seps}]"), T.strip), lambda v: v != "")
    return df.select("*", F.posexplode(parts).alias("value_pos", out))


def with_tax_id(df: DataFrame, col: str, out: str = "tax_id") -> DataFrame:
    return df.withColumn(out, T.tax_id(F.col(col)))


def apply_redirects(links: DataFrame, url: str, resolved: DataFrame, source: str = "url", target: str = "target", out: str = "resolved_url") -> DataFrame:
    """Replaces URLs by their landed redirect target.

    Short links without a target are dropped, other URLs stand for themselves; a target on the blocked
    host drops the link. The lookup holds one row per URL; the join is by URL and AQE splits a URL that
    many rows share.
    """
    found = resolved.select(F.col(source).alias("_from"), F.col(target).alias("_to"))
    df = links.withColumn("_from", T.strip(F.col(url))).join(found, "_from", "left")
    df = with_url_host(df, "_from", "_short")
    df = with_url_host(df, "_to", "_to_host")
    is_short = U.under(F.col("_short"), vocab.SHORT_LINK_HOST)
    dropped = (is_short & F.col("_to").isNull()) | (
        F.col("_to").isNotNull()
        & (U.under(F.col("_to_host"), vocab.BLOCKED_HOST) | (is_short & U.under(F.col("_to_host"), vocab.SHORT_LINK_HOST)))
    )
    return (
        df.filter(~F.coalesce(dropped, F.lit(False)))
        .withColumn(out, F.coalesce("_to", "_from"))
        .drop("_from", "_to", "_short", "_to_host")
    )
