"""Directory sites to crawl targets, and crawled pages to routed links and status rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefacts import vocab
from sitefacts.functions import text as T
from sitefacts.functions import urls as U
from sitefacts.functions.html import html_elements
from sitefacts.operators import booking
from sitefacts.operators.companies import claim_domains
from sitefacts.operators.first import first_per_key
from sitefacts.operators.pages import external_links
from sitefacts.operators.urls import apply_redirects, with_link_kind, with_site_origin, with_url_host
from sitefacts.sources.tables import append_unique, land, route_links

STATUS = ("firm_id", "site_url", "stage", "status", "details", "updated_at")


def card_sites(cards: DataFrame, short_links: DataFrame, redirects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sites of directory cards: (links that belong to a network, sites to read).

    Short links and redirects come from landed lookups. ``cards`` holds firm_id, firm_pos, pos, raw_site.
    """
    rows = apply_redirects(cards, "raw_site", short_links, out="url")
    rows = with_url_host(rows, "url", "_h")
    rows = rows.filter(~U.under_any(F.col("_h"), (vocab.CHAT_WIDGET_HOST, vocab.BLOCKED_HOST))).drop("_h")
    direct = with_link_kind(rows, "url")
    social = direct.filter("kind IS NOT NULL").withColumn("source", F.lit("2gis_card"))
    sites = with_site_origin(direct.filter("kind IS NULL").drop("kind", "link_url", "link_host"), "url", "site_url", "origin")
    sites = apply_redirects(sites.filter("site_url IS NOT NULL"), "site_url", redirects, out="resolved")
    again = with_link_kind(sites, "resolved")
    social = social.unionByName(again.filter("kind IS NOT NULL").withColumn("source", F.lit("2gis_card_redirect")), allowMissingColumns=True)
    return social.drop("url", "resolved", "site_url"), again.filter("kind IS NULL").select("firm_id", "firm_pos", "pos", F.col("resolved").alias("site_url"))


def crawl_targets(sites: DataFrame, firms: DataFrame, max_sites: int) -> DataFrame:
    """Status rows of the selection: queued, skipped and failed; queued rows are the targets."""
    rows = claim_domains(sites, "firm_id", "firm_pos", "site_url", "pos", max_sites, firms)
    return rows.withColumns({"stage": F.lit("preprocess"), "updated_at": F.current_timestamp()}).select(*STATUS)


def crawled_links(pages: DataFrame, targets: DataFrame, short_links: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """New link rows per sink of the crawled pages; ``pages`` holds site_url, page_id, url and html."""
    firms = targets.filter("status = 'queued'").select("firm_id", "site_url")
    links = external_links(pages.join(firms, "site_url"), "site_url", "firm_id", short_links)
    return route_links(links.withColumn("source", F.lit("site_crawl")), "firm_id", "link_url", order=("page_id", "pos"), stored=stored)


def crawled_bookings(pages: DataFrame, targets: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Booking features of the crawled sites, once per firm and site; ``stored`` holds what earlier runs wrote."""
    firms = targets.filter("status = 'queued'").select("firm_id", "site_url")
    wanted = pages.join(firms.select("site_url").distinct(), "site_url", "left_semi")
    elements = land(html_elements(wanted, keep=["site_url", "page_id", "url"], tags=booking.ELEMENT_TAGS), "elements")
    features = booking.booking_features(booking.booking_evidence(elements, "site_url"), "site_url", wanted.select("site_url").distinct())
    rows = firms.join(features, "site_url").select("firm_id", *features.columns)
    keys = ["firm_id", "site_url"]
    return first_per_key(rows, keys, keys) if stored is None else append_unique(stored, rows, keys, keys)


def crawl_status(counts: DataFrame, targets: DataFrame, details_chars: int | None = 1200) -> DataFrame:
    """Success rows of the read sites, with their numbers as details (``counts`` is by ``site_counts``)."""
    links = F.array_join(F.transform(F.map_entries("links"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")
    shown = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in ("pages", "prices", "specialists", "contacts")]
    details = F.concat_ws(" ", *shown, F.concat(F.lit("booking="), F.col("booking_mode")), F.concat(F.lit("links={"), F.coalesce(links, F.lit("")), F.lit("}")))
    rows = targets.filter("status = 'queued'").select("firm_id", "site_url").join(counts, "site_url")
    return rows.select(
        "firm_id", "site_url", F.lit("crawl").alias("stage"), F.lit("success").alias("status"), T.head(details, details_chars).alias("details"), F.current_timestamp().alias("updated_at")
    )
