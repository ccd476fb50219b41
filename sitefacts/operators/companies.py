"""Import of companies, their child tables and profiles, and the joins around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitefacts import vocab
from sitefacts.functions import text as T
from sitefacts.functions import urls as U
from sitefacts.functions.joins import lookup_join
from sitefacts.operators.columns import smtp_class
from sitefacts.functions.blocks import BLOCK, range_sum, ranged
from sitefacts.operators.first import collect_ordered, first_per_key, top_per_key
from sitefacts.session import land
from sitefacts.operators.urls import explode_domain_keys, explode_values, share_link, with_domain, with_origin_domain, with_site_key, with_social_field, with_url_host


def ordered_distinct(df: DataFrame, group: Sequence[str], col: str, pos: Sequence[str], out: str = "value") -> DataFrame:
    """Distinct values per group without regard to case and white space: first spelling and place."""
    rows = df.select(*group, *pos, T.compact(T.text_of(col)).alias(out)).filter(F.col(out) != "")
    return first_per_key(rows, [*group, F.lower(out)], list(pos))


def contact_values(df: DataFrame, company: str, fields: Sequence[str], pos: Sequence[str]) -> DataFrame:
    """(company, field, value, pos, value_pos): the values of ``merge_contacts`` as rows, first spelling and place.

    ``operators.cells`` numbers them or cuts them into cell parts, for companies with any number of values.
    """
    names = F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).cast("string").alias("cell")) for c in fields])
    rows = df.select(company, *pos, F.explode(names).alias("_c"))
    parts = F.filter(F.transform(F.split(T.text_of("_c.cell"), ";"), T.strip), lambda v: v != "")
    rows = rows.select(company, F.col("_c.f").alias("field"), *pos, F.posexplode(parts).alias("value_pos", "value"))
    return first_per_key(rows, [company, "field", F.lower("value")], [*pos, "value_pos"])


def merge_contacts(df: DataFrame, company: str, fields: Sequence[str], pos: Sequence[str]) -> DataFrame:
    """(company, one joined cell per field): parts of all cells, distinct without regard to case.

    The fields are taken apart in one pass and deduplicated as rows; only the distinct values of a cell
    come together, since they are the cell.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).alias("cell")) for i, c in enumerate(fields)])
    rows = df.select(company, *pos, F.explode(cells).alias("_c")).select(company, *pos, F.col("_c.f").alias("_f"), F.col("_c.cell").alias("_cell"))
    parts = F.filter(F.transform(F.split(T.text_of("_cell"), ";"), T.strip), lambda v: v != "")
    # an empty cell keeps one NULL value, so that companies without any value stay in
    rows = rows.select(company, *pos, "_f", F.posexplode_outer(parts).alias("value_pos", "_v"))
    rows = first_per_key(rows, [company, "_f", F.lower("_v")], [*pos, "value_pos"])
    order = F.struct(*pos, "value_pos")
    packed = F.array_sort(F.collect_list(F.struct(F.col("_f").alias("f"), order.alias("o"), F.col("_v").alias("v"))))
    lists = rows.groupBy(company).agg(packed.alias("_all"))
    cell = lambda i: F.array_join(F.transform(F.filter("_all", (lambda x: (x["f"] == i) & x["v"].isNotNull())), lambda x: x["v"]), "; ")
    return lists.select(company, *[T.empty_to_null(cell(i)).alias(c) for i, c in enumerate(fields)])


def first_non_empty(df: DataFrame, group: Sequence[str], cols: Sequence[str], pos: Sequence[str]) -> DataFrame:
    """Per group the first non-blank value of each column in row order, NULL when all are blank."""
    order = F.struct(*pos)
    filled = lambda c: T.empty_to_null(T.strip(T.text_of(c)))
    return df.groupBy(*group).agg(*[F.min_by(filled(c), F.when(filled(c).isNotNull(), order)).alias(c) for c in cols])


CONTACT_CELLS = ("inn", "ogrn", "ogrnip", "phones", "emails")


def company_contacts(contacts: DataFrame, domain: str = "domain", pos: Sequence[str] = ("pos",)) -> DataFrame:
    """One contact row per company: first source and scope, merged id, phone and address cells."""
    first = first_non_empty(contacts, [domain], ["source_url", "source_scope"], pos)
    return first.join(merge_contacts(contacts, domain, CONTACT_CELLS, pos), domain)


def stored_names(existing: DataFrame, incoming: DataFrame, domain: str = "domain") -> DataFrame:
    """(_given, _stored): incoming domains that a company is stored under, by Unicode or ASCII form."""
    known = explode_domain_keys(existing.select(F.col(domain).alias("_stored")), "_stored", "_key")
    new = explode_domain_keys(incoming.select(F.col(domain).alias("_given")), "_given", "_key")
    # either key may match; the smallest stored domain stands for a company that two keys reach
    return new.join(known, "_key").groupBy("_given").agg(F.min("_stored").alias("_stored"))


def upsert_companies(existing: DataFrame, incoming: DataFrame, columns: Sequence[str], domain: str = "domain", has_contacts: str = "has_contacts") -> DataFrame:
    """The company table after an import: known by Unicode or ASCII domain, else added.

    Contact columns are overwritten only where the import had contact rows. Known companies keep the
    domain they are stored under.
    """
    pairs = stored_names(existing, incoming, domain)
    given = incoming.join(pairs, F.col(domain) == F.col("_given"), "left").drop("_given")
    given = given.select(F.coalesce("_stored", domain).alias("_d"), F.col(has_contacts).alias("_has"), *[F.col(c).alias(f"_n_{c}") for c in columns])
    given = first_per_key(given, ["_d"], [~F.col("_has"), *[F.col(f"_n_{c}") for c in columns]])
    both = existing.join(given, F.col(domain) == F.col("_d"), "full_outer")
    take = lambda c: F.when(F.coalesce("_has", F.lit(False)), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c)
    return both.select(F.coalesce(domain, "_d").alias(domain), *[take(c) for c in columns])


def replace_children(existing: DataFrame, incoming: DataFrame, imported: DataFrame, key: str) -> DataFrame:
    """Child rows after an import: those of imported companies go, the incoming ones come.

    ``imported`` names the companies of the import; children go even where no child row came along.
    """
    return existing.join(imported.select(key).distinct(), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def child_rows(rows: DataFrame, key: str, required: Sequence[str], optional: Sequence[str] = (), numbers: Sequence[str] = ()) -> DataFrame:
    """Typed child rows: those with no required text at all are dropped, empty options become NULL."""
    text = lambda c: T.strip(T.text_of(c))
    any_filled = F.concat(*[text(c) for c in required]) != ""
    return rows.filter(any_filled).select(
        key,
        *[text(c).alias(c) for c in required],
        *[T.empty_to_null(text(c)).alias(c) for c in optional],
        *[T.to_int(text(c)).alias(c) for c in numbers],
    )


def social_outcomes(links: DataFrame, companies: DataFrame, site: str, url: str, company: str, domain: str, explicit: str | None = None, row_id: str = "pos") -> DataFrame:
    """Every link with its company, profile column and outcome (inserted, or why it is skipped)."""
    df = links.withColumns({"_site": T.strip(T.text_of(site)), "_profile": T.strip(T.text_of(url))})
    df = with_domain(df, "_site", "_domain")
    df = U.split_url(df, F.col("_profile"))
    bad = (F.col("_site") == "") | (F.col("_profile") == "") | share_link() | (F.col("_domain") == "")
    df = U.drop_parts(df.withColumn("_bad", bad))
    df = with_social_field(df, "_profile", explicit, "field")
    keys = explode_domain_keys(companies.select(F.col(company).alias("company"), F.col(domain).alias("_cd")), "_cd", "_key")
    keys = keys.groupBy("_key").agg(F.max("company").alias("company"))
    df = lookup_join(df, keys.withColumnRenamed("_key", "_domain"), ["_domain"])
    outcome = (
        F.when(F.col("_bad"), F.lit("skipped_invalid"))
        .when(F.col("company").isNull(), F.lit("skipped_no_company"))
        .when(F.col("field").isNull(), F.lit("skipped_unknown_type"))
        .otherwise(F.lit("inserted"))
    )
    return df.withColumn("outcome", outcome).withColumn("profile_url", F.col("_profile")).drop("_site", "_profile", "_domain", "_bad")


def import_social_profiles(outcomes: DataFrame) -> DataFrame:
    """One row per company, profile column and URL, with exactly one of the eight columns filled."""
    rows = outcomes.filter("outcome = 'inserted'").groupBy("company", "field", "profile_url").agg(F.lit(1).alias("_one")).drop("_one")
    return rows.select("company", *[F.when(F.col("field") == c, F.col("profile_url")).alias(c) for c in vocab.PROFILE_COLUMNS])


def import_stats(outcomes: DataFrame, company: str = "company", field: str = "field", url: str = "profile_url") -> DataFrame:
    """(outcome, n): counters of an import; inserted profiles count once per company, column and URL."""
    inserted = F.col("outcome") == "inserted"
    cells = outcomes.groupBy("outcome", *[F.when(inserted, F.col(c)).alias(f"_{c}") for c in (company, field, url)]).agg(F.count("*").alias("_rows"))
    return cells.groupBy("outcome").agg(F.sum(F.when(inserted, F.lit(1)).otherwise(F.col("_rows"))).alias("n"))


def attach_tax_id(sites: DataFrame, site: str, lookup: DataFrame, lookup_site: str, lookup_id: str, order: Sequence[str], site_ids: DataFrame | None = None) -> DataFrame:
    """Adds tax_id and tax_id_source to sites: from the company table, else from the site's own pages.

    A lookup cell may hold several sites; the first valid row of a site counts.
    """
    found = lookup.withColumn("_id", T.tax_id(F.col(lookup_id))).filter("_id <> ''")
    found = with_site_key(explode_values(found, lookup_site, "_site"), "_site", "_key").filter("_key <> ''")
    found = first_per_key(found.select("_key", "_id", *order, "value_pos"), ["_key"], [*order, "value_pos"]).select("_key", "_id")
    empty = F.lit(None).cast("string")
    both = found.select("_key", "_id", empty.alias("_own"))
    if site_ids is not None:
        both = both.unionByName(site_ids.select(F.col("site_key").alias("_key"), empty.alias("_id"), F.col("tax_id").alias("_own")))
    # one row per key holds both, so a hot site is joined once
    both = both.groupBy("_key").agg(F.max("_id").alias("_id"), F.max("_own").alias("_own"))
    df = lookup_join(with_site_key(sites, site, "_key"), both, ["_key"])
    source = F.when(F.col("_id").isNotNull(), F.lit("company_csv")).when(F.col("_own").isNotNull(), F.lit("site")).otherwise(F.lit(""))
    return df.withColumns({"tax_id": F.coalesce("_id", "_own", F.lit("")), "tax_id_source": source}).drop("_key", "_id", "_own")


def join_company(links: DataFrame, site: str, companies: DataFrame, company: str, domain: str) -> DataFrame:
    """Adds the company of the link's site, NULL when there is none.

    A site's canonical domain is one of the keys a company is stored under, so only the company side is
    exploded and every link stays one row.
    """
    keys = explode_domain_keys(companies.select(F.col(company).alias("company"), F.col(domain).alias("_cd")), "_cd", "_key")
    keys = keys.groupBy("_key").agg(F.max("company").alias("company"))
    return lookup_join(with_domain(links, site, "_key"), keys, ["_key"]).drop("_key")


def claim_domains(candidates: DataFrame, firm: str, firm_pos: str, site: str, pos: str, max_sites: int, firms: DataFrame | None = None) -> DataFrame:
    """(firm, site, status, details): which firm may read which registrable domain.

    Per firm the distinct sites up to the cap are candidates; of all candidates of a domain the first in
    firm order gets it. Firms that get none have one failed row. Winners are found by an aggregate, and
    rows meet them by (domain, firm, place): a key of one row, so a domain that many firms name is no
    hot key.
    """
    rows = first_per_key(candidates, [firm, site], [firm_pos, pos])
    rows = top_per_key(rows, [firm], [F.col(firm_pos), F.col(pos)], max(1, max_sites))
    rows = with_origin_domain(with_url_host(rows, site, "_h"), "_h", "_origin").drop("_h")
    winners = rows.filter("_origin <> ''").groupBy("_origin").agg(F.min(F.struct(firm_pos, pos)).alias("_w"))
    winners = winners.select("_origin", F.col(f"_w.{firm_pos}").alias(firm_pos), F.col(f"_w.{pos}").alias(pos), F.lit(True).alias("_won"))
    rows = rows.join(winners, ["_origin", firm_pos, pos], "left")
    won = F.coalesce("_won", F.lit(False)) | (F.col("_origin") == "")
    status = rows.select(
        firm, site, F.when(won, F.lit("queued")).otherwise(F.lit("skipped")).alias("status"),
        F.when(won, F.lit("")).otherwise(F.concat(F.lit("duplicate_origin_domain="), U.decode_host(F.col("_origin")))).alias("details"),
    )
    everyone = (firms if firms is not None else candidates).select(firm).distinct()
    failed = everyone.join(status.filter("status = 'queued'").select(firm).distinct(), firm, "left_anti")
    return status.unionByName(failed.select(firm, F.lit("").alias(site), F.lit("failed").alias("status"), F.lit("no_crawl_targets_after_filtering").alias("details")))


def attach_firm(entries: DataFrame, firms: DataFrame, site: str, columns: Sequence[str]) -> DataFrame:
    """Adds the firm's columns to every extracted row of its site."""
    return entries.join(firms.select(site, *columns), site)


def join_domain_checks(probes: DataFrame, exchangers: DataFrame, catch_all: DataFrame, max_tries: int = 2) -> DataFrame:
    """One row per address: exchangers of its domain, the deciding reply and the final status.

    ``probes`` are landed replies (address, domain, host, code); tries go by exchanger preference, the
    first accepting or rejecting reply decides, else the last try counts. ``exchangers`` are
    (domain, preference, host), ``catch_all`` is (domain, status).
    """
    ranked = first_per_key(exchangers, ["domain", "host"], ["preference"])
    listed = land(ranked.groupBy("domain").agg(F.sort_array(F.collect_list(F.struct("preference", "host"))).alias("_hosts")), "exchangers")
    known = catch_all.groupBy("domain").agg(F.max("status").alias("catch_all_status"))
    # replies meet one row per (domain, host) and are combined by address; addresses then meet one row per domain
    places = listed.select("domain", F.posexplode(F.transform("_hosts", lambda h: h["host"])).alias("_at", "host"))
    places = places.groupBy("domain", "host").agg((F.min("_at") + 1).alias("_place"))
    place = F.col("_place")
    tried = lookup_join(probes, places, ["domain", "host"]).withColumns({"_try": F.when(place <= max(1, max_tries), place), "rcpt_status": smtp_class(F.col("code"))})
    decisive = F.col("rcpt_status").isin("accepted", "rejected")
    order = F.when(F.col("_try").isNotNull(), F.struct(~decisive, F.when(decisive, F.col("_try")).otherwise(-F.col("_try"))))
    rows = tried.groupBy("address", "domain").agg(F.min_by(F.struct("host", "code", "rcpt_status"), order).alias("_b"))
    rows = lookup_join(rows, listed.join(known, "domain", "full"), ["domain"])
    rows = rows.withColumn("mx_hosts", F.array_join(F.transform("_hosts", lambda h: h["host"]), "; "))
    status = F.coalesce("_b.rcpt_status", F.lit("network_error"))
    final = F.when(status == "rejected", F.lit("invalid")).when(
        status == "accepted", F.when(F.col("catch_all_status") == "accepted", F.lit("catch_all")).otherwise(F.lit("valid_like"))
    ).otherwise(F.lit("unknown"))
    return rows.select("address", "domain", T.text_of("mx_hosts").alias("mx_hosts"), T.text_of("_b.host").alias("mx_used"), F.col("_b.code").alias("code"), status.alias("rcpt_status"), T.text_of("catch_all_status").alias("catch_all_status"), final.alias("final_status"))


def bucket_by_week(df: DataFrame, date: str, keep_quirk: bool = True) -> DataFrame:
    """(week, articles): rows per Monday-based week from the oldest to the newest, empty weeks too.

    ``keep_quirk`` leaves out the last week when the newest date is its Monday. Weeks are met by
    equality of the truncated date.
    """
    days = df.withColumn("_d", F.to_date(date)).withColumn("_w", F.to_date(F.date_trunc("week", "_d")))
    counted = days.groupBy("_w").agg(F.count("*").alias("articles"), F.min("_d").alias("_lo"), F.max("_d").alias("_hi"))
    span = counted.agg(F.min("_w").alias("_from"), F.max("_hi").alias("_to"))
    end = F.date_sub("_to", 1) if keep_quirk else F.col("_to")
    weeks = span.filter(end >= F.col("_from")).select(F.explode(F.sequence("_from", end, F.expr("INTERVAL 7 DAYS"))).alias("week"))
    return weeks.join(counted, F.col("week") == F.col("_w"), "left").select("week", F.coalesce("articles", F.lit(0)).alias("articles"))


def titles_by_week(df: DataFrame, date: str, keep_quirk: bool = True) -> DataFrame:
    """The rows with their week; rows of a week that ``bucket_by_week`` leaves out are dropped."""
    rows = df.withColumn("week", F.to_date(F.date_trunc("week", F.to_date(date))))
    weeks = bucket_by_week(df, date, keep_quirk).select("week")
    return rows.join(weeks, "week", "left_semi")


def crawl_frontier(visited: DataFrame, links: DataFrame, site: str, url: str, priority: str, order: Sequence[str], max_pages: int | None = None) -> DataFrame:
    """(site, url, rank): the next pages of each site, hint words first, then discovery order.

    Visited pages are left out and count towards the site's cap; None is no cap. Without one,
    links are ranked in ranges, so that a hot site is in no single task.
    """
    # links and visited pages meet in one aggregate: a key of any weight is combined in the map tasks
    seen = visited.select(site, url, F.lit(True).alias("_seen"))
    both = links.select(site, url, priority, *order, F.lit(False).alias("_seen")).unionByName(seen, allowMissingColumns=True)
    place = F.when(~F.col("_seen"), F.struct(*order))
    best = both.groupBy(site, url).agg(F.max("_seen").alias("_seen"), F.min_by(F.struct(priority, *order), place).alias("_b"))
    fresh = best.filter("NOT _seen").select(site, url, "_b.*")
    if max_pages is None:
        by = [F.col(priority).desc(), *[F.col(o) for o in order]]
        return range_sum(ranged(fresh, [site], by), [site], by, F.lit(1), "rank").drop(BLOCK)
    # of a site's fresh links no more than the cap can ever be next, so that many reach the join
    fresh = top_per_key(fresh, [site], [F.col(priority).desc(), *[F.col(o) for o in order]], max_pages, "rank")
    spent = visited.select(site, url).distinct().groupBy(site).agg(F.count("*").alias("_spent"))
    fresh = fresh.join(spent, site, "left")
    return fresh.filter(F.col("rank") + F.coalesce("_spent", F.lit(0)) <= max_pages).drop("_spent")
