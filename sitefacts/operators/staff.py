"""People on pages: names, roles, cards and text lines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefacts import vocab
from sitefacts.functions import text as T
from sitefacts.functions.blocks import neighbours
from sitefacts.operators.first import first_per_key

CAPITALIZED = r"[А-ЯЁ][а-яё]{1,30}"
NAME = rf"{T.WORD_START}{CAPITALIZED}(?:-{CAPITALIZED})?\s+{CAPITALIZED}(?:\s+{CAPITALIZED})?{T.WORD_END}"
# the last dot must touch a word character, as the source rule's boundary asks
INITIALS = rf"{T.WORD_START}{CAPITALIZED}\s+[А-ЯЁ]\.[А-ЯЁ]\.(?=[{T.WORD}])"
PERSON_FIELDS = ("full_name", "role", "phone", "email")


def person_name(text: Column, stop_words: Iterable[str] = vocab.NOT_PERSON_WORDS) -> Column:
    """First full name in the text, else surname with initials; NULL when that is no likely person."""
    full = F.regexp_extract(text, NAME, 0)
    name = T.empty_to_null(F.when(full != "", full).otherwise(F.regexp_extract(text, INITIALS, 0)))

    def likely(found: Column) -> Column:
        words = F.split(F.lower(T.compact(found)), " ")
        short = (F.size(words) == 2) & F.exists(words, lambda w: F.length(w) < 3)
        return F.when((F.size(words) >= 2) & ~F.arrays_overlap(words, T.literals(stop_words)) & ~short, found)

    return T.let(name, likely)


def with_person_name(df: DataFrame, text: str, out: str = "full_name") -> DataFrame:
    return df.withColumn(out, person_name(F.col(text)))


def role_of(text: Column, roles: Iterable[str] = vocab.ROLE_WORDS) -> Column:
    """Longest role word in the text; empty when there is none."""
    by_length = sorted(roles, key=len, reverse=True)
    return F.coalesce(T.first_contained(T.fold_yo(F.lower(text)), by_length), F.lit(""))


def with_role(df: DataFrame, text: str, out: str = "role") -> DataFrame:
    return df.withColumn(out, role_of(F.col(text)))


def _people(rows: DataFrame, text: str) -> DataFrame:
    rows = rows.withColumn("full_name", person_name(F.col(text))).filter("full_name IS NOT NULL")
    return rows.withColumns(
        {
            "role": role_of(F.col(text)),
            "phone": T.compact(F.regexp_extract(text, vocab.PHONE_PATTERN, 0)),
            "email": F.regexp_extract(text, vocab.EMAIL_PATTERN, 0),
        }
    )


def _same_person() -> list:
    return [F.lower("full_name"), "role", "phone", "email"]


def staff_from_cards(elements: DataFrame, key: str = "page_id", keep: Iterable[str] = ("url",), hints: Iterable[str] = vocab.CARD_HINTS) -> DataFrame:
    """People in blocks whose class or id says staff card; equal people of a page once."""
    payload = F.lower(F.concat_ws(" ", F.element_at("attrs", "class"), F.element_at("attrs", "id")))
    cards = elements.filter(F.col("tag").isin("article", "section", "div", "li") & T.contains_any(payload, hints))
    cards = cards.select(*keep, key, F.lit(0).alias("source"), F.col("pos").cast("long").alias("pos"), T.compact(F.col("text")).alias("_t")).filter(F.length("_t") >= 8)
    return first_per_key(_people(cards, "_t").drop("_t"), [key, *_same_person()], ["pos"])


def staff_lines(pages: DataFrame, markdown: str, key: str = "page_id", url: str = "url", title: str = "title", keep: Iterable[str] = ("url",)) -> DataFrame:
    """Lines of the pages that speak of staff in URL or title, or name a staff list in their text."""
    decoded = F.coalesce(F.try_url_decode(F.replace(F.col(url), F.lit("+"), F.lit("%2B"))), F.col(url))
    head = T.fold_yo(F.lower(F.concat(decoded, F.lit(" "), T.text_of(title))))
    body = T.fold_yo(F.lower(T.text_of(markdown)))
    staff = pages.filter(T.contains_any(head, vocab.STAFF_PAGE_HINTS) | T.contains_any(body, vocab.STAFF_TEXT_HINTS))
    return staff.select(*keep, key, F.posexplode(F.split(T.text_of(markdown), r"\r\n|[\n\r\x{0B}\x{0C}\x{85}\x{2028}\x{2029}]")).alias("pos", "line"))


def staff_from_lines(lines: DataFrame, key: str = "page_id", pos: str = "pos", line: str = "line", longest: int = 180) -> DataFrame:
    """People in a line read together with the line before and after it.

    Repeated lines of a page count once, at their first place; neighbours are those that remain.
    """
    rows = lines.withColumn("_l", T.compact(T.text_of(line))).filter("_l <> ''")
    rows = first_per_key(rows, [key, F.lower("_l")], [pos])
    rows = neighbours(rows, [key], pos, "_l", "_prev", "_next")
    rows = rows.filter(F.length("_l") <= longest).withColumn("_t", T.compact(F.concat_ws(" ", "_l", "_prev", "_next")))
    people = _people(rows, "_t").withColumn("source", F.lit(1)).drop("_l", "_prev", "_next", "_t", line)
    return first_per_key(people, [key, *_same_person()], [pos])


def extract_specialists(cards: DataFrame, lines: DataFrame | None, site: str, key: str = "page_id", pos: str = "pos") -> DataFrame:
    """People of each site from both sources; rows without a role go when the name has one elsewhere."""
    rows = cards if lines is None else cards.unionByName(lines)
    rows = first_per_key(rows, [site, *_same_person()], [key, "source", pos])
    named = rows.groupBy(F.col(site).alias("_s"), F.lower("full_name").alias("_n")).agg(F.max(F.col("role") != "").alias("_has"))
    with_role = named.filter("_has")
    bare = rows.filter("role = ''").join(
        with_role, (F.col(site) == F.col("_s")) & (F.lower("full_name") == F.col("_n")), "left_anti"
    )
    return rows.filter("role <> ''").unionByName(bare)
