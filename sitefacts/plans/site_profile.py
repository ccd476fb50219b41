"""One row per site from a table of pages: the flagship job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefacts.functions import text as T
from sitefacts.functions import urls as U
from sitefacts.functions.html import anchor_hrefs, visible_text
from sitefacts.operators.pages import contact_block, plain_footer


LISTS = ("phones", "emails")


def _contacts(text: Column, options: dict) -> Column:
    found = contact_block(text, **options)
    return F.struct(*[found[n].alias(n) for n in LISTS])


def _tagged(kind: str) -> Column:
    return F.transform(f"_found.{kind}", lambda v, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), v.alias("value")))


def site_profile(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", **contact_options) -> DataFrame:
    """Pages, links inside and outside, and distinct phones and addresses of each registrable domain.

    Every page is read and searched once. It yields one row with its numbers and one per contact value;
    equal values of a site are combined map-side with the numbers, and what remains is put together per
    site: two shuffles, neither of which carries text of pages.
    """
    rows = U.split_url(pages.select(key, url, html), F.col(url))
    rows = rows.withColumn("site", U.origin_domain(F.col("_host")))
    rows = rows.withColumn("_hrefs", F.filter(anchor_hrefs(F.col(html)), lambda h: h != ""))
    server = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:www\.)?([^/?#:]*)"
    target = lambda h: F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:|^//"), F.lower(F.regexp_extract(h, server, 1))).otherwise(F.col("_host"))
    inside = F.size(F.filter("_hrefs", lambda h: U.under(target(h), F.col("site"))))
    rows = rows.withColumns({"inside": inside, "_footer": _contacts(plain_footer(F.col(html)), contact_options)})
    in_footer = (F.size("_footer.phones") + F.size("_footer.emails")) > 0
    rows = rows.withColumn("_found", F.when(in_footer, F.col("_footer")).otherwise(_contacts(visible_text(F.col(html)), contact_options)))
    numbers = F.array(F.struct(F.lit("page").alias("kind"), F.lit(0).alias("at"), F.lit("").alias("value")))
    rows = rows.withColumns({"outside": F.size("_hrefs") - F.col("inside"), "known": (F.size("_found.phones") + F.size("_found.emails")) > 0})
    rows = rows.select("site", key, "inside", "outside", "known", F.explode(F.concat(numbers, *[_tagged(n) for n in LISTS])).alias("_v"))
    of_page = F.col("_v.kind") == "page"
    once = lambda c: F.sum(F.when(of_page, F.col(c)).otherwise(F.lit(0)))
    cells = rows.groupBy("site", F.col("_v.kind").alias("kind"), F.lower("_v.value").alias("_low")).agg(
        F.min(F.struct(F.col(key).alias("page"), F.col("_v.at").alias("at"), F.col("_v.value").alias("value"))).alias("_first"),
        F.count_if(of_page).alias("pages"), once("inside").alias("inside"), once("outside").alias("outside"),
        F.count_if(of_page & F.col("known")).alias("known"),
    )
    listed = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("_first")))), lambda f: f["value"])
    return cells.groupBy("site").agg(
        F.sum("pages").alias("pages"), F.sum("inside").alias("internal_links"), F.sum("outside").alias("external_links"),
        F.sum("known").alias("pages_with_contacts"), *[T.empty_to_null(F.array_join(listed(n), "; ")).alias(n) for n in LISTS],
    )
