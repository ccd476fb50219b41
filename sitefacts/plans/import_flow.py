"""Extracted site tables to the company tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefacts.operators import companies as C

CONTACTS = ("source_url", "source_scope", *C.CONTACT_CELLS)


def imported_rows(contacts: DataFrame, pricing: DataFrame, specialists: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One company row per imported domain, its typed price rows and its specialists."""
    domains = reduce(lambda a, b: a.unionByName(b), [t.select("domain") for t in (contacts, pricing, specialists)]).distinct()
    merged = C.company_contacts(contacts).withColumn("has_contacts", F.lit(True))
    incoming = domains.join(merged, "domain", "left").withColumn("has_contacts", F.coalesce("has_contacts", F.lit(False)))
    prices = C.child_rows(pricing, "domain", ["source_url", "service"], ["price_raw", "currency"], ["price_min", "price_max"])
    people = C.child_rows(specialists, "domain", ["source_url", "full_name"], ["role", "phone", "email"])
    return incoming, prices, people


def import_tables(stored: dict[str, DataFrame], contacts: DataFrame, pricing: DataFrame, specialists: DataFrame) -> dict[str, DataFrame]:
    """companies, pricing and specialists after an import.

    ``stored`` holds the three tables as they are. Every domain that has a row in one of the inputs is
    imported: its company is found or added and its child rows are replaced.
    """
    incoming, prices, people = imported_rows(contacts, pricing, specialists)
    domains = incoming.select("domain")
    return {
        "companies": C.upsert_companies(stored["companies"], incoming, CONTACTS),
        "pricing": C.replace_children(stored["pricing"], prices, domains, "domain"),
        "specialists": C.replace_children(stored["specialists"], people, domains, "domain"),
    }


def import_profiles(links: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profile rows, counters) of a full refresh of social profiles.

    ``links`` holds site_url, url and, where the source table decides the column, field_name.
    """
    explicit = "field_name" if "field_name" in links.columns else None
    outcomes = C.social_outcomes(links, companies, "site_url", "url", "id", "domain", explicit)
    return C.import_social_profiles(outcomes), C.import_stats(outcomes)
