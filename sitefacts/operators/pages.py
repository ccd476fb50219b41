"""Page jobs: titles, text, links, footers, contacts and tax ids."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefacts import vocab
from sitefacts.functions import text as T
from sitefacts.functions import urls as U
from sitefacts.functions.html import anchor_hrefs, html_elements, visible_text
from sitefacts.operators.first import collect_ordered, first_per_key
from sitefacts.operators.urls import apply_redirects, http_url, link_kinds, with_url_host


def with_title(pages: DataFrame, html: str = "html", out: str = "title", closed: bool = False) -> DataFrame:
    found = F.regexp_extract(T.text_of(html), r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    return pages.withColumn(out, T.compact(T.unescape(F.regexp_replace(found, "<[^>]*>", " "), closed)))


def markdown_text(raw: str, cited: str, fit: str) -> Column:
    """The non-blank markdown variants of a page, one after another."""
    return F.concat_ws("\n", *[F.when(T.strip(T.text_of(c)) != "", F.col(c)) for c in (raw, cited, fit)])


def with_page_text(pages: DataFrame, html: str = "html", markdown: str | None = None, out: str = "page_text", closed: bool = False) -> DataFrame:
    """Markdown text, where there is any, and the visible text of the page; ``closed`` as in ``unescape``."""
    body = visible_text(F.col(html), closed)
    if markdown is None:
        return pages.withColumn(out, body)
    return pages.withColumn(out, T.compact(F.concat_ws(" ", T.empty_to_null(F.col(markdown)), T.empty_to_null(body))))


def all_page_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Every anchor of every page: its place, the href and the URL it stands for, without fragment."""
    base = U.split_url(pages.drop(*[c for c in ("pos", "href", "link") if c in pages.columns]), F.col(url), "_b")
    rows = base.withColumn("_hrefs", anchor_hrefs(F.col(html))).drop(html)
    # without outer, pages that have hrefs are filtered for in front, which looks for all of them twice
    rows = rows.select("*", F.posexplode_outer("_hrefs").alias("pos", "href")).drop("_hrefs")
    rows = rows.withColumn("href", T.strip(F.col("href"))).filter("href <> ''")
    rows = rows.withColumn("link", U.without_fragment(U.resolve("_b", F.col("href"))))
    return U.drop_parts(rows, "_b")


def page_links(pages: DataFrame, site: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The distinct links of each site with the page that shows them first."""
    rows = all_page_links(pages.select(site, key, url, html), key, url, html)
    return first_per_key(rows, [site, "link"], [key, "pos"])


def external_links(pages: DataFrame, site: str, firm: str | None = None, redirects: DataFrame | None = None, key: str = "page_id") -> DataFrame:
    """Classified links of each site to other sites, one row per kind and URL.

    Short links go through the landed redirects (and are dropped without one); chat widgets and URLs
    with a broken port are dropped; links that belong to no network count as ``other`` unless internal.
    """
    keys = [c for c in (firm, site) if c]
    rows = all_page_links(pages.select(*keys, key, "url", "html"), key)
    rows = first_per_key(rows, [*keys, "link"], [key, "pos"])
    if redirects is None:
        short = with_url_host(rows, "link", "_h")
        rows = short.filter(~U.under(F.col("_h"), vocab.SHORT_LINK_HOST)).drop("_h").withColumn("target", F.col("link"))
    else:
        rows = apply_redirects(rows, "link", redirects, out="target")
    rows = U.split_url(rows, F.col("target"), default_scheme=True)
    rows = rows.filter(~U.under(F.col("_host"), vocab.CHAT_WIDGET_HOST) & (~F.col("_scheme").isin("http", "https") | F.col("_port_ok")))
    rows = U.split_url(rows, F.col("target"), "_w")
    rows = link_kinds(rows, "kind", "link_url", "link_host").withColumn("_http", http_url("_w"))
    rows = U.split_url(rows, F.col(site), "_s")
    own = U.under(F.col("_whost"), U.origin_domain(F.col("_shost"))) & (F.col("_shost") != "")
    rows = rows.filter(F.col("kind").isNotNull() | (F.col("_http").isNotNull() & ~own))
    rows = rows.select(
        *keys, key, "url", "pos", "link", F.coalesce("kind", F.lit("other")).alias("kind"),
        F.coalesce("link_url", "_http").alias("link_url"), F.coalesce("link_host", "_whost").alias("link_host"),
    )
    return first_per_key(rows, [*keys, "kind", "link_url"], [key, "pos"])


def with_scope(elements: DataFrame, out: str = "scope") -> DataFrame:
    """Header or footer scope of an element by tag, role, id or class; NULL for others."""
    attr = lambda n: F.coalesce(F.element_at("attrs", n), F.lit(""))
    named = lambda w: F.contains(F.lower(attr("id")), F.lit(w)) | F.contains(F.lower(attr("class")), F.lit(w))
    header = (F.col("tag") == "header") | (attr("role") == "banner") | named("header")
    footer = (F.col("tag") == "footer") | (attr("role") == "contentinfo") | named("footer")
    # one element may be both, then its links count for the header as well as for the footer
    return elements.withColumn(out, F.filter(F.array(F.when(header, F.lit("header")), F.when(footer, F.lit("footer"))), lambda s: s.isNotNull()))


def scoped_links(elements: DataFrame, site: str, key: str = "page_id", url: str = "url") -> DataFrame:
    """Links inside header or footer elements, the header's first; one row per site and URL.

    Each anchor looks up its ancestors by (page, position): an equi-join on keys that hold one row.
    """
    scoped = with_scope(elements).select(key, F.col("pos").alias("_at"), F.explode("scope").alias("scope"))
    anchors = elements.filter((F.col("tag") == "a") & (T.strip(F.coalesce(F.element_at("attrs", "href"), F.lit(""))) != ""))
    base = U.split_url(anchors, F.col(url), "_b")
    anchors = U.drop_parts(base.withColumn("link", U.resolve("_b", T.strip(F.element_at("attrs", "href")))), "_b")
    inside = (
        anchors.select(key, site, "pos", "link", F.explode("ancestors").alias("_at"))
        .join(scoped, [key, "_at"])
        .withColumn("scope_rank", F.when(F.col("scope") == "header", 0).otherwise(1))
    )
    return first_per_key(inside, [site, "link"], ["scope_rank", key, "_at", "pos"]).drop("_at", "scope_rank")


FOOTER_TAGS = ("footer", "div", "section", "aside")


def footer_like(hints: Iterable[str] = vocab.FOOTER_HINTS) -> Column:
    """Condition over elements: a footer, or a block whose id, role, label or class says contact data."""
    payload = F.lower(F.concat_ws(" ", *[F.element_at("attrs", n) for n in ("id", "role", "aria-label", "class")]))
    return F.col("tag").isin(*FOOTER_TAGS) & ((F.col("tag") == "footer") | T.contains_any(payload, hints))


def footer_text(elements: DataFrame, key: str = "page_id", least: int = 20) -> DataFrame:
    """(page, footer_text): texts of footer-like elements, distinct without regard to case, in order."""
    rows = elements.filter(footer_like()).select(key, "pos", T.compact(F.col("text")).alias("t")).filter(F.length("t") >= least)
    rows = first_per_key(rows, [key, F.lower("t")], ["pos"])
    return collect_ordered(rows, [key], ["pos"], "t", "footer_text", " ")


def plain_footer(html: Column) -> Column:
    """Text of all ``footer`` elements, equal ones once, in order; found without parsing the page."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<footer\b[^>]*>(.*?)</footer\s*>"), F.lit(1))
    return visible_text(F.array_join(F.array_distinct(found), " "))


LABELLED = {
    "inns": (r"инн" + T.WORD_END, "10,12", (10, 12)),
    "ogrns": (r"огрн" + T.WORD_END, "13", (13,)),
    "ogrnips": (r"(?:огрнип|огрн\s*ип)" + T.WORD_END, "15", (15,)),
}


def labelled_ids(text: Column, label: str, count: str, lengths: Sequence[int]) -> Column:
    """Distinct digit runs of an allowed length that follow the label within 20 other characters."""
    pattern = rf"(?iu){T.WORD_START}{label}[^\d]{{0,20}}((?:\d[\s\x{{A0}}]*){{{count}}})"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, T.digits), lambda d: F.length(d).isin(*lengths)))


def contact_block(text: Column, phone_pattern: str = vocab.PHONE_PATTERN, likely_only: bool = False) -> dict[str, Column]:
    """Phones, e-mail addresses and registry ids of a text, each distinct, in reading order."""
    phones = F.transform(F.regexp_extract_all(text, F.lit(phone_pattern), F.lit(0)), T.phone)
    if likely_only:
        phones = F.filter(phones, T.is_likely_phone)
    emails = F.transform(F.regexp_extract_all(text, F.lit(vocab.EMAIL_PATTERN), F.lit(0)), F.lower)
    ids = {n: labelled_ids(text, *rule) for n, rule in LABELLED.items()}
    return {"phones": F.array_distinct(phones), "emails": F.array_distinct(emails), **ids}


CONTACT_LISTS = ("phones", "emails", "inns", "ogrns", "ogrnips")


def extract_contact_block(df: DataFrame, text: str, **options) -> DataFrame:
    return df.withColumns(contact_block(T.text_of(text), **options))


def extract_contacts(pages: DataFrame, site: str, elements: DataFrame | None = None, key: str = "page_id", markdown: str | None = None, **options) -> DataFrame:
    """Contact rows of each site: the footer's data where it holds any, else the whole page's.

    Pages without data are dropped, and of equal rows of a site the first page's is kept. With
    ``elements`` the footer is found by tag and hint words, without it by the ``footer`` tag alone.
    """
    columns = [c for c in (site, key, "url", "html", markdown) if c]
    rows = pages.select(*columns)
    if elements is None:
        rows = rows.withColumn("footer_text", plain_footer(F.col("html")))
    else:
        rows = rows.join(footer_text(elements, key), key, "left")
    block = lambda text: F.struct(*[c.alias(n) for n, c in contact_block(T.text_of(text), **options).items()])
    filled = lambda s: sum((F.size(F.col(f"_{s}.{n}")) for n in CONTACT_LISTS), F.lit(0)) > 0
    rows = rows.withColumn("_footer", block("footer_text"))
    # the text of a page is made only where the footer holds no data
    rows = rows.withColumn("html", F.when(~filled("footer"), F.col("html")))
    rows = with_page_text(rows, "html", markdown).drop("html")
    rows = rows.withColumn("_page", F.when(~filled("footer"), block("page_text")))
    rows = rows.withColumn("source_scope", F.when(filled("footer"), F.lit("footer")).when(filled("page"), F.lit("page")))
    best = F.when(F.col("source_scope") == "footer", F.col("_footer")).otherwise(F.col("_page"))
    rows = rows.withColumn("_c", best)
    cells = {"inn": "inns", "ogrn": "ogrns", "ogrnip": "ogrnips", "phones": "phones", "emails": "emails"}
    rows = rows.select(
        site, key, F.col("url").alias("source_url"), "source_scope", *[F.array_join(f"_c.{n}", "; ").alias(c) for c, n in cells.items()]
    )
    # a filter in front of the aggregate would be pushed below the patterns and run all of them twice
    return first_per_key(rows, [site, "source_scope", *cells], [key]).filter("source_scope IS NOT NULL")


def extract_tax_ids(contacts: DataFrame, site: str, order: str = "page_id", cell: str = "inn") -> DataFrame:
    """One row per site and valid tax id, from the first contact row that names it."""
    ids = F.transform(F.split(T.text_of(cell), ";"), lambda v: T.tax_id(v))
    rows = contacts.select("*", F.posexplode(ids).alias("_i", "tax_id")).filter("tax_id <> ''")
    return first_per_key(rows, [site, "tax_id"], [order, "_i"]).drop("_i")


def failed_site_rows(sites: DataFrame, site: str, error: str) -> DataFrame:
    """Rows of sites that could not be read: the message stands in the scope column."""
    return with_url_host(sites, site, "domain").select(
        site, "domain", F.lit("").alias("source_url"), F.concat(F.lit("error:"), F.col(error)).alias("source_scope"), F.lit("").alias("tax_id")
    )


def page_elements(pages: DataFrame, site: str | None = None, tags: Sequence[str] | None = None) -> DataFrame:
    keep = [c for c in (site, "page_id", "url") if c]
    return html_elements(pages, keep=keep, tags=tags)
