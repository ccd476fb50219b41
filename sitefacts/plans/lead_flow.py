"""Firms, their sites and the pages of those to the lead tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefacts.functions.html import html_elements
from sitefacts.operators import booking, companies, pages as page_jobs, prices, staff
from sitefacts.operators.first import first_per_key, top_per_key
from sitefacts.operators.urls import canonical_profile_url, profile_handle, with_domain_slug, with_site_key, with_site_origin
from sitefacts.sources.sites import PARTS, SiteStore
from sitefacts.sources.tables import land

FIRM = ("firm_id", "company_name", "address_name")
TAGS = (*booking.ELEMENT_TAGS, "header", "footer", "nav", "div", "section", "aside", "article", "li", "p", "tr", "th", "td")


def firm_site_list(firms: DataFrame, raw_site: str, pos: str, max_sites: int | None) -> DataFrame:
    """The first ``max_sites`` normalised sites of each firm (None: all): firm columns, site and its place."""
    rows = with_site_origin(firms, raw_site, "site").filter("site <> ''")
    rows = first_per_key(rows.select(*FIRM, "site", pos), ["firm_id", "site"], [pos])
    return rows if max_sites is None else top_per_key(rows, ["firm_id"], [F.col(pos)], max(1, max_sites))


def lead_tables(firms: DataFrame, pages: DataFrame, company_table: DataFrame, raw_site: str = "site_url", pos: str = "pos", *, max_sites: int | None, markdown: str | None = None, title: str | None = None, done: DataFrame | None = None) -> dict[str, DataFrame]:
    """companies, pricing, specialists, bookings, instagram and telegram rows of all firms.

    ``pages`` holds site, page_id, url and html, and may hold a title and markdown, which then count for
    contacts, prices and people; ``company_table`` holds site, inn and pos. Pages are parsed once and
    the elements written, since five jobs read them. ``max_sites`` is the caller's choice, None is all.
    Sites in ``done`` are left out once each firm's sites have been chosen.
    """
    sites = firm_site_list(firms, raw_site, pos, max_sites)
    if done is not None:
        sites = sites.join(done.select("site").distinct(), "site", "left_anti").select(*sites.columns)
    wanted = pages.join(sites.select("site").distinct(), "site", "left_semi")
    elements = land(html_elements(wanted, keep=["site", "page_id", "url"], tags=TAGS), "elements")
    contacts = page_jobs.extract_contacts(wanted, "site", elements, markdown=markdown)
    ids = page_jobs.extract_tax_ids(contacts, "site")
    own = first_per_key(with_site_key(ids, "site"), ["site_key"], ["page_id"]).select("site_key", "tax_id")
    company_rows = companies.attach_tax_id(sites, "site", company_table, "site", "inn", ["pos"], own)
    lines = prices.price_lines(wanted, elements, markdown=markdown).join(wanted.select("page_id", "url", "site"), "page_id")
    cards = staff.staff_from_cards(elements, keep=("site", "url"))
    people = staff.extract_specialists(cards, None, "site")
    if markdown is not None:
        titled = wanted if title else wanted.withColumn("_title", F.lit(""))
        spoken = staff.staff_from_lines(staff.staff_lines(titled, markdown, title=title or "_title", keep=("site", "url")))
        people = staff.extract_specialists(cards, spoken.withColumn("pos", F.col("pos").cast("long")).select(*cards.columns), "site")
    evidence = booking.booking_evidence(elements, "site")
    read_sites = wanted.select("site").distinct()
    scoped = page_jobs.scoped_links(elements, "site")
    links = canonical_profile_url(scoped, "link", ("instagram",))
    links = canonical_profile_url(links, "link", "telegram", "telegram_url", reject_service=True)
    attach = lambda rows, *columns: companies.attach_firm(with_domain_slug(rows, "site", "domain"), sites, "site", columns)
    social = lambda url: first_per_key(links.filter(f"{url} IS NOT NULL"), ["site", url], [F.col("scope") != "header", "page_id", "pos"]).select("site", "scope", url)
    return {
        "companies": company_rows.select(*FIRM, "site", F.col("tax_id").alias("inn"), F.col("tax_id_source").alias("inn_source")),
        "pricing": attach(prices.extract_prices(lines), "firm_id", "company_name"),
        "specialists": attach(people, "firm_id", "company_name"),
        "bookings": attach(booking.booking_features(evidence, "site", read_sites), "firm_id", "company_name"),
        "instagram": attach(profile_handle(social("instagram_url"), "instagram_url", "instagram"), "firm_id", "company_name"),
        "telegram": attach(profile_handle(social("telegram_url"), "telegram_url", "telegram"), "firm_id", "company_name"),
    }


def store_leads(spark: SparkSession, root: str, firms: DataFrame, pages: DataFrame, company_table: DataFrame, n_parts: int = PARTS, **options) -> dict[str, SiteStore]:
    """Writes the lead tables of the sites that no earlier run has finished, a site store per table.

    A site is done when its pages were read and all its tables are written; that is noted last, so a run
    that is killed repeats its sites, and their rows are replaced, not doubled. Sites without pages stay open.
    """
    done = SiteStore(spark, f"{root}/done", spark.createDataFrame([], "site string").schema, "site", n_parts)
    finished = land(done.sites().select("site"), "done")
    tables = lead_tables(firms, pages, company_table, done=finished, **options)
    stores = {name: SiteStore(spark, f"{root}/{name}", df.schema, "site", n_parts) for name, df in tables.items()}
    for name, df in tables.items():
        stores[name].write(df)
    chosen = stores["companies"].read().select("site").distinct()
    read = pages.select("site").distinct().join(chosen, "site", "left_semi").join(finished, "site", "left_anti")
    done.write(read)
    return stores
