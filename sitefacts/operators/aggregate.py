"""Summaries over members, contacts, checks, detections, crawl logs and sites."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitefacts import vocab
from sitefacts.functions import text as T
from sitefacts.functions.blocks import WIDTH, forward_fill, neighbours, numbered, with_lookahead
from sitefacts.operators.cells import PART_VALUES, cell_parts
from sitefacts.operators.first import top_per_key

MEMBER_FIELDS = ("member_name", "member_username", "member_public_url", "member_web_public_url", "member_status", "member_role", "member_is_admin")


def collapse_members(observations: DataFrame, ident: str = "peer_id", pos: str = "pos", fields: Sequence[str] = MEMBER_FIELDS) -> DataFrame:
    """One row per member: of each field the first non-empty value; public URLs follow from a handle."""
    filled = lambda c: T.empty_to_null(F.col(c).cast("string"))
    rows = observations.groupBy(ident).agg(*[T.text_of(F.min_by(filled(c), F.when(filled(c).isNotNull(), F.col(pos)))).alias(c) for c in fields])
    if "member_username" not in fields:
        return rows
    user = F.trim("member_username")
    derived = lambda c, start: F.when((F.col(c) == "") & (user != ""), F.concat(F.lit(start), user)).otherwise(F.col(c))
    return rows.withColumns(
        {
            "member_public_url": derived("member_public_url", "https://t.me/"),
            "member_web_public_url": derived("member_web_public_url", "https://web.telegram.org/k/#@"),
        }
    )


def contacts_by_type(contacts: DataFrame, profile: str, kind: str = "type", value: str = "value", label: str = "label", pos: str = "pos") -> DataFrame:
    """(profile, contacts): a map of contact type to its values with labels, in order."""
    lists = contacts.groupBy(profile, kind).agg(F.array_sort(F.collect_list(F.struct(pos, value, label))).alias("_l"))
    lists = lists.withColumn("_l", F.transform("_l", lambda x: F.struct(x[value].alias("value"), x[label].alias("label"))))
    return lists.groupBy(profile).agg(F.map_from_entries(F.collect_list(F.struct(kind, "_l"))).alias("contacts"))


def typed_contact_parts(contacts: DataFrame, profile: str, kind: str = "type", value: str = "value", label: str = "label", pos: str = "pos", most: int = PART_VALUES) -> DataFrame:
    """(profile, type, part, contacts): as ``contacts_by_type``, with ``most`` contacts of a type in a row at most."""
    pairs = contacts.withColumn("_pair", F.struct(F.col(value).alias("value"), F.col(label).alias("label")))
    return cell_parts(pairs, [profile, kind], [F.col(pos)], "_pair", "contacts", most, None)


def status_summary(df: DataFrame, status: str, declared: Sequence[str] | None = None) -> DataFrame:
    """(position, status, n, share): rows and percentage per status; statuses without rows are left out."""
    counts = df.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    place = F.array_position(T.literals(declared), F.col("status")) if declared else F.lit(0)
    # only the counted rows, one per status, meet in one task
    rows = counts.withColumn("_total", F.sum("n").over(Window.partitionBy(F.lit(1))))
    return rows.select(place.cast("int").alias("position"), "status", "n", F.round(100 * F.col("n") / F.col("_total"), 1).alias("share"))


def email_status(df: DataFrame, email: str, has_mx: str, resolves: str, catch_all: str, exists: str, out: str = "status", major: Sequence[str] = vocab.MAJOR_MAIL_HOSTS) -> DataFrame:
    """Verdict on an address over landed facts, cheapest rule first."""
    address = F.lower(T.strip(T.text_of(email)))
    domain = F.element_at(F.split(address, "@"), -1)
    verdict = (
        F.when(~address.rlike(vocab.CHECKED_EMAIL), F.lit("syntax_error"))
        .when(domain.isin(*major), F.lit("skipped"))
        .when(~F.coalesce(has_mx, F.lit(False)), F.when(F.coalesce(resolves, F.lit(False)), F.lit("no_mx")).otherwise(F.lit("domain_error")))
        .when(F.coalesce(catch_all, F.lit(False)), F.lit("catch_all"))
        .when(F.col(exists).isNull(), F.lit("smtp_error"))
        .otherwise(F.when(F.col(exists), F.lit("valid")).otherwise(F.lit("invalid")))
    )
    return df.withColumn(out, verdict)


def detection_summary(detections: DataFrame, image: str, label: str, confidence: str, wanted: object, least: float = 0.0, images: DataFrame | None = None) -> DataFrame:
    """Per image: found, count and best confidence of one class, its confidences best first."""
    hits = detections.filter((F.col(label) == F.lit(wanted)) & (F.col(confidence) >= least)).select(image, F.round(confidence, 4).alias("_c"))
    rows = hits.groupBy(image).agg(F.count("*").alias("count"), F.max("_c").alias("best_confidence"), F.sort_array(F.collect_list("_c"), asc=False).alias("confidences"))
    everything = (images if images is not None else detections).select(image).distinct().join(rows, image, "left")
    return everything.select(
        image, F.coalesce("count", F.lit(0)).alias("count"), F.col("count").isNotNull().alias("found"), "best_confidence",
        F.coalesce("confidences", F.array().cast("array<double>")).alias("confidences"),
    )


def detection_parts(detections: DataFrame, image: str, label: str, confidence: str, wanted: object, least: float = 0.0, most: int = PART_VALUES) -> DataFrame:
    """(image, part, confidences): the confidences of ``detection_summary``, best first, ``most`` in a row at most."""
    hits = detections.filter((F.col(label) == F.lit(wanted)) & (F.col(confidence) >= least)).select(image, F.round(confidence, 4).alias("_c"))
    return cell_parts(hits, [image], [-F.col("_c")], "_c", "confidences", most, None)


def detection_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(F.count("*").alias("images"), F.count_if("found").alias("images_with_hits"))


def crawl_summary(log: DataFrame, firm: str, site: str, time: str, pos: str, columns: Sequence[str] = ("stage", "status", "details"), details_chars: int | None = 1200) -> DataFrame:
    """Latest stage and status of each firm and site in the append-only log; details are cut for display (None: whole)."""
    if "details" in columns:
        # the latest row of a key is sorted for with all it shows, so details are cut before that
        log = log.withColumn("details", T.head(F.col("details"), details_chars))
    latest = log.groupBy(firm, site).agg(F.max_by(F.struct(*columns, time), F.struct(time, pos)).alias("_l"))
    return latest.select(firm, site, "_l.*")


def failed_attempts(log: DataFrame, key: str, pos: str, status: str = "status") -> DataFrame:
    """(key, pos): what failed at least once, in order of the first failure."""
    return log.filter(F.col(status) == "failed").groupBy(key).agg(F.min(pos).alias(pos))


def site_counts(sites: DataFrame, site: str, parts: dict[str, DataFrame], links: DataFrame | None = None, kind: str = "kind", booking: DataFrame | None = None) -> DataFrame:
    """Per site the number of rows of each part, the links by kind and the booking mode."""
    out = sites.select(site).distinct()
    for name, part in parts.items():
        out = out.join(part.groupBy(site).agg(F.count("*").alias(name)), site, "left")
    out = out.na.fill(0, list(parts))
    if links is not None:
        kinds = links.groupBy(site, kind).agg(F.count("*").alias("_n"))
        kinds = kinds.groupBy(site).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "_n")))).alias("links"))
        out = out.join(kinds, site, "left")
    if booking is not None:
        out = out.join(booking.select(site, "booking_mode"), site, "left").na.fill("none", ["booking_mode"])
    return out


def with_neighbours(df: DataFrame, keys: Sequence[str], pos: str, value: str, prev: str = "prev_line", following: str = "next_line", width: int = WIDTH) -> DataFrame:
    return neighbours(df, keys, pos, value, prev, following, width)


def with_section(df: DataFrame, keys: Sequence[str], pos: str, heading: Column, out: str = "section", width: int = WIDTH) -> DataFrame:
    """Carries the last heading down to the following rows."""
    return forward_fill(df, keys, pos, heading, out, width)


def pair_within(df: DataFrame, keys: Sequence[str], pos: str, is_start: Column, value: Column, n: int = 7, out: str = "paired", width: int = WIDTH) -> DataFrame:
    """For each start row the first value in the next n rows, if no other start comes before it."""
    rows = numbered(df.withColumns({"_start": F.coalesce(is_start, F.lit(False)), "_value": value}), keys, pos, "_n", width)
    rows, window = with_lookahead(rows, keys, "_n", n, width)
    ahead = window.rowsBetween(1, n)
    rows = rows.withColumns(
        {
            "_stop": F.min(F.when(F.col("_start"), F.col("_n"))).over(ahead),
            "_found": F.min(F.when(F.col("_value").isNotNull(), F.struct("_n", "_value"))).over(ahead),
        }
    ).filter("_own AND _start")
    inside = F.col("_stop").isNull() | (F.col("_found._n") < F.col("_stop"))
    return rows.withColumn(out, F.when(inside, F.col("_found._value"))).drop("_start", "_value", "_n", "_block", "_own", "_stop", "_found")


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    return top_per_key(df, by, order, n, rank)


def shuffled_head(df: DataFrame, key: Sequence[str], n: int, seed: int, merge_rows: int = 1000) -> DataFrame:
    """The first n rows of a seeded shuffle, all rows for n = 0; the same on any partitioning.

    The order is that of the md5 of key and seed; the key tells rows apart. Up to ``merge_rows`` rows are
    merged in one task. For more, the rows are counted by the first digits of their md5 when this is
    called; the one group at the border is counted by further digits until it is small, and all groups
    before it are taken by a filter.
    """
    place = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))
    shuffled = df.orderBy(place, *key)
    if n <= merge_rows:
        return shuffled.limit(n) if n > 0 else shuffled
    edge, left, size = "", n, None
    while size is None or (size > merge_rows and len(edge) < 32):
        digits = F.substring(place, len(edge) + 1, 2)
        groups = df.where(place.startswith(edge)).groupBy(digits.alias("_digits")).count().collect()  # at most 256
        for digit, size in sorted(groups):
            if size > left:
                edge += digit
                break
            left -= size
        else:
            return shuffled
    border = df.where(place.startswith(edge)).orderBy(place, *key).limit(left)
    return df.where(place < edge).unionByName(border).orderBy(place, *key)


def union_sources(*sources: DataFrame, rank: str = "source_rank") -> DataFrame:
    """All rows of all sources, with the place of their source."""
    ranked = [s.withColumn(rank, F.lit(i)) for i, s in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b.select(*keys).distinct(), list(keys), "left_anti")
