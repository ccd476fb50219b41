"""Booking forms, widgets and links of sites."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefacts import vocab
from sitefacts.functions import text as T
from sitefacts.functions import urls as U
from sitefacts.operators.first import collect_ordered, first_per_key, top_per_key
from sitefacts.operators.urls import http_url, with_display_url

ELEMENT_TAGS = ("form", "input", "textarea", "select", "button", "a", "iframe", "script")


def booking_provider(host: Column) -> Column:
    """First provider, in list order, one of whose domains holds the host."""
    return F.coalesce(*[F.when(U.under_any(host, domains), F.lit(name)) for name, domains in vocab.BOOKING_PROVIDERS])


def with_booking_provider(df: DataFrame, host: str, out: str = "provider") -> DataFrame:
    return df.withColumn(out, booking_provider(U.bare_host(F.col(host))))


def _attr(*names: str) -> Column:
    return F.concat_ws(" ", *[F.element_at("attrs", n) for n in names])


def _web(rows: DataFrame, raw: Column, page_url: str, site: str) -> DataFrame:
    """Adds the canonical URL of a raw link, its host, whether it leaves the site and its booking hint."""
    rows = U.split_url(rows.withColumn("_raw", T.strip(T.text_of(raw))), F.col(page_url), "_b")
    rows = rows.withColumn("_abs", F.when(F.col("_raw") != "", U.without_fragment(U.resolve("_b", F.col("_raw")))))
    rows = U.split_url(U.drop_parts(rows, "_b"), F.col("_abs"))
    rows = rows.withColumns({"web_url": http_url(), "web_host": F.col("_host")})
    rows = U.split_url(U.drop_parts(rows), F.col(site), "_s")
    own = (F.col("_shost") != "") & U.under(F.col("web_host"), U.origin_domain(F.col("_shost")))
    hint = T.contains_any(T.match_text(F.regexp_extract("web_url", r"^[a-z]+://(.*)$", 1)), vocab.BOOKING_URL_HINTS)
    rows = rows.withColumns({"external": ~own, "url_hint": F.coalesce(hint, F.lit(False))})
    return U.drop_parts(rows, "_s").drop("_raw", "_abs")


def booking_evidence(
    elements: DataFrame,
    site: str,
    key: str = "page_id",
    url: str = "url",
    text_hints: Iterable[str] = vocab.BOOKING_TEXT_HINTS,
    field_hints: Iterable[str] = vocab.BOOKING_FIELD_HINTS,
    shown_chars: int | None = 160,
) -> DataFrame:
    """One row per sign of booking: kind, provider and host, and the evidence line.

    Kinds are form, form_action, widget, widget_link and booking_link. ``phase`` puts a page's forms in
    front of its links, as they are reported.
    """
    controls = (
        elements.filter(F.col("tag").isin("input", "textarea", "select", "button"))
        .select(key, F.explode("ancestors").alias("_form"), "pos", _attr("name", "id", "placeholder", "aria-label").alias("_c"))
        .groupBy(key, "_form")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_c"))), lambda c: c["_c"]), " ").alias("controls"))
    )
    forms = elements.filter("tag = 'form'").withColumn("_form", F.col("pos"))
    forms = forms.join(controls, [key, "_form"], "left")
    said = T.match_text(F.concat_ws(" ", _attr("id", "class", "name", "action"), "text", "controls"))
    forms = _web(forms.withColumn("_said", said), F.element_at("attrs", "action"), url, site)
    by_words = T.contains_any(F.col("_said"), text_hints) & T.contains_any(F.col("_said"), field_hints)
    forms = forms.filter(by_words | F.col("url_hint"))
    leaves = F.col("web_url").isNotNull() & F.col("external") & (F.col("web_host") != "")
    provider = F.coalesce(booking_provider(F.col("web_host")), F.concat(F.lit("external:"), U.decode_host(F.col("web_host"))))
    found = [
        forms.select(
            site, key, url, F.lit(0).alias("phase"), "pos", F.lit(0).alias("nth"),
            F.when(leaves, F.lit("form_action")).otherwise(F.lit("form")).alias("kind"),
            F.when(leaves, provider).alias("provider"), F.when(leaves, F.col("web_host")).alias("host"),
            F.when(leaves, U.decode_host(F.col("web_host"))).otherwise(F.lit("booking form detected")).alias("details"),
        )
    ]
    values = F.array(*[F.element_at("attrs", a) for a in vocab.LINK_ATTRIBUTES])
    tags = elements.filter(F.col("tag").isin("a", "iframe", "script"))
    tags = tags.withColumn("_said", T.match_text(F.concat_ws(" ", _attr("id", "class", "title", "aria-label"), "text")))
    tags = tags.select(site, key, url, "pos", "tag", "_said", F.posexplode(values).alias("nth", "_value")).filter("trim(_value) <> ''")
    tags = _web(tags, F.col("_value"), url, site).filter("web_url IS NOT NULL AND web_host <> ''")
    tags = tags.withColumns(
        {"_hint": F.col("url_hint") | T.contains_any(F.col("_said"), text_hints), "provider": booking_provider(F.col("web_host"))}
    )
    kind = (
        F.when(F.col("provider").isNotNull() & F.col("external"), F.lit("widget"))
        .when(F.col("external") & F.col("_hint"), F.lit("widget_link"))
        .when((F.col("tag") == "a") & ~F.col("external") & F.col("_hint"), F.lit("booking_link"))
    )
    tags = with_display_url(tags.withColumn("kind", kind).filter("kind IS NOT NULL"), "web_url", "_shown")
    shown_host = U.decode_host(F.col("web_host"))
    outside = F.col("kind") != "booking_link"
    found.append(
        tags.select(
            site, key, url, F.lit(1).alias("phase"), "pos", "nth", "kind",
            F.when(F.col("kind") == "widget", F.col("provider")).when(outside, F.concat(F.lit("external:"), shown_host)).alias("provider"),
            F.when(outside, F.col("web_host")).alias("host"),
            F.when(outside, shown_host).otherwise(F.col("_shown")).alias("details"),
        )
    )
    rows = with_display_url(found[0].unionByName(found[1]), url, "_page")
    shown = T.head(T.match_text(F.col("details")), shown_chars)
    line = F.concat(F.col("kind"), F.lit(":"), F.col("_page"), F.when(shown != "", F.concat(F.lit(" ("), shown, F.lit(")"))).otherwise(F.lit("")))
    return rows.withColumn("evidence", line).drop("_page", "details")


def booking_features(evidence: DataFrame, site: str, sites: DataFrame | None = None, order: Sequence[str] = ("page_id", "phase", "pos", "nth"), lines: int = 6) -> DataFrame:
    """Booking mode, flags, providers, hosts and the first lines of evidence of each site."""
    # equal lines of a site agree in kind, provider and host, so flags and lines share one shuffle
    distinct = first_per_key(evidence.withColumn("_shown", U.decode_host(F.col("host"))), [site, "evidence"], list(order))
    flags = distinct.groupBy(site).agg(
        F.max(F.col("kind").isin("form", "form_action", "booking_link")).alias("has_booking_form"),
        F.max(F.col("kind").isin("form_action", "widget", "widget_link")).alias("has_booking_widget"),
        F.array_join(F.array_sort(F.collect_set("provider")), "; ").alias("booking_widget_provider"),
        F.array_join(F.array_sort(F.collect_set("_shown")), "; ").alias("booking_widget_host"),
    )
    shown = top_per_key(distinct, [site], [F.col(c) for c in order], lines)
    out = flags.join(collect_ordered(shown, [site], order, "evidence", "booking_evidence", " | "), site)
    if sites is not None:
        out = sites.select(site).join(out, site, "left")
    form, widget = (F.coalesce(f"has_booking_{w}", F.lit(False)) for w in ("form", "widget"))
    mode = F.when(form & widget, F.lit("form+widget")).when(form, F.lit("form")).when(widget, F.lit("widget")).otherwise(F.lit("none"))
    texts = ("booking_widget_provider", "booking_widget_host", "booking_evidence")
    return out.select(
        site, mode.alias("booking_mode"), form.alias("has_booking_form"), widget.alias("has_booking_widget"),
        *[T.text_of(c).alias(c) for c in texts],
    )
