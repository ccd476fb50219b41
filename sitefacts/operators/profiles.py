"""Firm cards, articles, labelled metrics and profile merging."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefacts import vocab
from sitefacts.functions import text as T
from sitefacts.functions.html import visible_text
from sitefacts.operators.first import first_per_key
from sitefacts.operators.urls import valid_fqdn


def firm_sites(cards: DataFrame, firm: str, html: str, prefixes: Sequence[str] = vocab.FIRM_LINK_PREFIXES) -> DataFrame:
    """(firm, pos, site_host): domains shown as plain text of redirect anchors, first occurrence per firm."""
    starts = "|".join(re.escape(p) for p in prefixes)
    pattern = rf"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*[\"']\s*(?:{starts})[^\"']*[\"'][^>]*>([^<]*)</a\s*>"
    rows = cards.select(firm, F.posexplode(F.regexp_extract_all(T.text_of(html), F.lit(pattern), F.lit(1))).alias("pos", "_t"))
    host = lambda shown: F.when(F.contains(shown, F.lit("://")), F.regexp_extract(shown, r"://(?:[^/?#@]*@)?([^/?#:]*)", 1)).otherwise(
        T.strip(F.substring_index(shown, "/", 1))
    )
    # the host is read many times by the filter, so both are worked out in one value and the texts in another
    found = T.let(F.lower(T.strip(T.unescape(F.col("_t")))), lambda shown: F.regexp_replace(host(shown), r"\.+$", ""))
    rows = rows.withColumn("site_host", T.let(found, lambda h: F.when(valid_fqdn(h), h))).filter("site_host IS NOT NULL")
    return first_per_key(rows.drop("_t"), [firm, "site_host"], ["pos"])


def article_list(elements: DataFrame, key: str = "page_id", item_class: str = "tm-articles-list__item", link_class: str = "tm-title__link", path: str = "/ru/companies") -> DataFrame:
    """(page, pos, date, title) of the articles that carry a date and a title link below the path."""
    classes = F.split(F.coalesce(F.element_at("attrs", "class"), F.lit("")), r"\s+")
    is_article = (F.col("tag") == "article") & F.array_contains(classes, item_class)
    is_part = (F.col("tag") == "time") | ((F.col("tag") == "a") & F.array_contains(classes, link_class))
    # parts meet their article as rows of one group, so elements are read once; other ancestors' groups hold no article
    rows = elements.filter(is_article | is_part)
    rows = rows.select(key, "pos", "tag", "attrs", F.when(F.col("tag") == "a", F.col("text")).alias("text"), F.explode(F.when(is_article, F.array("pos")).otherwise(F.col("ancestors"))).alias("_article"))
    at = lambda tag: F.when(F.col("tag") == tag, F.col("pos"))
    found = rows.groupBy(key, "_article").agg(
        F.max(F.col("tag") == "article").alias("_is_article"),
        F.min_by(F.element_at("attrs", "datetime"), at("time")).alias("_when"),
        F.min_by(F.struct(F.element_at("attrs", "href").alias("href"), F.col("text").alias("title")), at("a")).alias("_link"),
    )
    found = found.filter("_is_article")
    found = found.filter(F.col("_when").isNotNull() & F.col("_link.href").startswith(path))
    return found.select(key, F.col("_article").alias("pos"), F.try_to_timestamp("_when").alias("date"), F.col("_link.title").alias("title"))


YEAR = r"(?<![0-9A-Za-zА-Яа-яЁё_])(?:19|20)\d{2}(?![0-9A-Za-zА-Яа-яЁё_])"


def _year(text: Column) -> Column:
    return T.empty_to_null(F.regexp_extract(text, YEAR, 0)).cast("int")


def _folded(text: Column) -> Column:
    return F.lower(T.compact(text))


def metric_in_text(text: Column, section: str, label: str, window: int = 5000) -> tuple[Column, Column]:
    """Number behind the label within the window after the section title, and the newest year there."""
    flat = T.compact(text)
    at = F.locate(section.lower(), F.lower(flat))
    part = F.when(at > 0, F.substr(flat, at, F.lit(window))).otherwise(flat)
    pattern = rf"(?iu){re.escape(label)}\s*[:\-]?\s*({vocab.NUMBER_PATTERN})"
    value = T.empty_to_null(F.regexp_extract(part, pattern, 1))
    years = F.transform(F.regexp_extract_all(part, F.lit(YEAR), F.lit(0)), lambda y: y.cast("int"))
    return value, F.array_max(years)


def labelled_metric(elements: DataFrame, pages: DataFrame, section: str, label: str, key: str = "page_id", url: str = "url", html: str = "html", ancestors: int | None = 11, steps: int | None = 3, strings_behind: int | None = 5) -> DataFrame:
    """(page, value_raw, value, year): a figure of a table or text, found by its label inside a section.

    The smallest element with the label is taken. Right of the label in its table row the column with
    the newest header year wins, else the first number. Outside a table the strings behind the label
    are read, and where that fails the page's text behind the section title. Needs ``strings``.
    ``ancestors`` may lie between label and section; ``steps`` elements upwards and ``strings_behind``
    the label are read outside tables. None sets no bound.
    """
    label_key, section_key = T_fold(label), T_fold(section)
    e = elements.withColumn("_f", _folded(F.col("text")))
    named = e.filter(F.contains("_f", F.lit(label_key)))
    holders = e.filter(F.contains("_f", F.lit(section_key))).select(key, F.col("pos").alias("_at"))
    first_of = lambda items, most: items if most is None else F.slice(items, 1, most)
    near = first_of(F.concat(F.array("pos"), F.reverse("ancestors")), None if ancestors is None else ancestors + 1)
    placed = named.withColumn("_at", F.explode(near)).join(holders, [key, "_at"], "left_semi").dropDuplicates([key, "pos"])
    tag = placed.groupBy(key).agg(F.min_by(F.struct("pos", "ancestors"), F.struct(F.length("_f"), "pos")).alias("_tag"))
    rows_at = e.filter("tag = 'tr'").select(key, F.col("pos").alias("_row"), F.element_at("ancestors", -1).alias("_table"))
    row = (
        tag.select(key, F.explode("_tag.ancestors").alias("_row")).join(rows_at, [key, "_row"]).groupBy(key).agg(F.max(F.struct("_row", "_table")).alias("_r"))
    ).select(key, "_r.*")
    cells = e.filter(F.col("tag").isin("th", "td")).select(key, "pos", "text", "_f", F.explode("ancestors").alias("_row"))
    cells = cells.join(rows_at, [key, "_row"])
    siblings = cells.join(row.select(key, F.col("_row").alias("_mine"), "_table"), [key, "_table"]).filter("_row <= _mine")
    # a row's cells are one small list; its place in the list is the column
    lists = siblings.groupBy(key, "_mine", "_row").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "_f"))).alias("_cells"))
    mine = lists.filter("_row = _mine")
    mine = mine.withColumn("_label_at", F.coalesce(F.array_position(F.transform("_cells", lambda c: F.contains(c["_f"], F.lit(label_key))), F.lit(True)), F.lit(0)))
    values = mine.select(key, "_label_at", F.posexplode("_cells").alias("_col", "_cell")).filter("_col >= _label_at")
    number = T.empty_to_null(F.regexp_extract(T.compact(F.col("_cell.text")), vocab.NUMBER_PATTERN, 0))
    values = values.select(key, "_col", number.alias("value_raw")).filter("value_raw IS NOT NULL")
    heads = lists.filter("_row < _mine").select(key, "_row", F.posexplode("_cells").alias("_col", "_cell"))
    heads = heads.select(key, "_row", "_col", _year(T.compact(F.col("_cell.text"))).alias("year")).filter("year IS NOT NULL")
    heads = heads.groupBy(key, "_col").agg(F.max_by("year", "_row").alias("year"))
    best = F.struct(F.coalesce("year", F.lit(-1)).alias("y"), (-F.col("_col")).alias("c"))
    table = values.join(heads, [key, "_col"], "left").groupBy(key).agg(F.max_by(F.struct("value_raw", "year"), best).alias("_t"))
    # outside tables: the element and those around it, inner ones first
    around = tag.join(row, key, "left_anti").select(
        key, F.posexplode(first_of(F.concat(F.array("_tag.pos"), F.reverse("_tag.ancestors")), steps)).alias("_step", "pos")
    )
    strings = e.select(key, "pos", F.transform("strings", T.compact).alias("_s"))
    around = around.join(strings, [key, "pos"])
    behind = F.flatten(
        F.transform("_s", lambda s, i: F.when(F.contains(F.lower(s), F.lit(label_key)), F.slice("_s", i + 2, F.size("_s") if strings_behind is None else F.lit(strings_behind))).otherwise(F.array().cast("array<string>")))
    )
    hits = F.filter(behind, lambda s: s.rlike(vocab.NUMBER_PATTERN))
    around = around.withColumn("_hit", F.try_element_at(hits, F.lit(1))).filter("_hit IS NOT NULL")
    text_hit = around.groupBy(key).agg(F.min_by("_hit", "_step").alias("_hit")).select(
        key, F.struct(F.regexp_extract("_hit", vocab.NUMBER_PATTERN, 0).alias("value_raw"), _year(F.col("_hit")).alias("year")).alias("_x")
    )
    value, year = metric_in_text(visible_text(F.col(html)), section, label)
    out = pages.select(key, url, value.alias("_v"), year.alias("_y")).join(table, key, "left").join(text_hit, key, "left")
    found = F.coalesce("_t", "_x")
    raw = F.coalesce(found["value_raw"], F.col("_v"))
    # the page's newest year only fills in where nothing was found beside the label
    when = F.when(found["value_raw"].isNotNull(), found["year"]).otherwise(F.coalesce(found["year"], F.col("_y")))
    org = T.empty_to_null(F.regexp_extract(url, r"/organizations-card/(\d+)", 1))
    return out.select(key, url, org.alias("organization_id"), raw.alias("value_raw"), T.to_number(raw).alias("value"), when.alias("year"))


def T_fold(text: str) -> str:
    return " ".join(text.replace(" ", " ").split()).lower()


def metric_by_year(observations: DataFrame, org: str, year: str = "year", value: str = "value", pos: str = "pos") -> DataFrame:
    """Per organisation and year the first observation, or the first that has a value."""
    return first_per_key(observations.filter(F.col(year).isNotNull()), [org, year], [F.col(value).isNull(), pos])


def with_rendered_fallback(plain: DataFrame, rendered: DataFrame, key: str, value: str = "value_raw") -> DataFrame:
    """Rows of the plain read; where it has no value and the rendered read has one, that row."""
    better = rendered.filter(F.col(value).isNotNull()).join(plain.filter(F.col(value).isNull()).select(key), key, "left_semi")
    return plain.join(better.select(key), key, "left_anti").unionByName(better)


def merge_profiles(api: DataFrame, dom: DataFrame, key: str, hidden: str | None = None) -> DataFrame:
    """Field by field the first non-empty value of two sources; an error where no contact is known.

    A profile of one source alone passes as it is. ``hidden`` names a flag of pages that hide contacts.
    """
    fields = [c for c in api.columns if c != key and c in dom.columns]
    both = api.alias("a").join(dom.alias("d"), F.col(f"a.{key}") == F.col(f"d.{key}"), "full_outer")
    merged = [F.coalesce(T.empty_to_null(F.col(f"a.{c}")), F.col(f"d.{c}"), F.col(f"a.{c}")).alias(c) for c in fields]
    extra = [F.col(f"d.{hidden}").alias("_hidden")] if hidden else []
    out = both.select(F.coalesce(F.col(f"a.{key}"), F.col(f"d.{key}")).alias(key), *merged, *extra)
    lacks = (T.text_of("contact_email") == "") & (T.text_of("contact_phone") == "")
    if hidden:
        lacks = lacks & F.coalesce("_hidden", F.lit(False))
        out = out.withColumn("error", F.when(lacks, F.lit("auth_required_or_hidden_contacts")).otherwise(F.lit(""))).drop("_hidden")
    return out
