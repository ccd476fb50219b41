"""Column expressions over text. All of them stay in the JVM."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitefacts import vocab

WS = r"[\p{IsWhite_Space}\x{1C}-\x{1F}]"
WORD = r"0-9A-Za-zА-Яа-яЁё_"
WORD_START = rf"(?<![{WORD}])"
WORD_END = rf"(?![{WORD}])"


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def literals(words: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is computed once per row, not once per use."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def compact(c: Column) -> Column:
    """Every run of white space becomes one blank; none is left at the ends."""
    return F.trim(F.regexp_replace(c, rf"{WS}+", " "))


def plain_markdown(c: Column) -> Column:
    return compact(F.regexp_replace(c, r"[*_`>#\[\]\(\)]", ""))


def fold_yo(c: Column) -> Column:
    return F.translate(c, "ёЁ", "еЕ")


def match_text(c: Column) -> Column:
    """The form hint words are looked up in: lower case, yo folded, compact."""
    return compact(fold_yo(F.lower(c)))


def _any_of(words: Iterable[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def contains_any(c: Column, words: Iterable[str]) -> Column:
    """True where any of the words occurs in the text; the words are plain, not patterns."""
    return c.rlike(_any_of(words))


def count_contained(c: Column, words: Iterable[str]) -> Column:
    total = F.lit(0)
    for w in words:
        total = total + F.contains(c, F.lit(w)).cast("int")
    return total


def first_contained(c: Column, words: Iterable[str]) -> Column:
    """The first word of the list that occurs in the text, NULL when none does."""
    return F.coalesce(*[F.when(F.contains(c, F.lit(w)), F.lit(w)) for w in words])


def head(c: Column, most: int | None) -> Column:
    """The first ``most`` characters of a text; None is the whole."""
    return c if most is None else F.substring(c, 1, most)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def empty_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def to_int(c: Column) -> Column:
    return empty_to_null(digits(text_of(c))).try_cast("bigint")


def to_number(c: Column) -> Column:
    bare = F.translate(F.regexp_replace(c, r"[ \x{A0}]", ""), ",", ".")
    return F.when(~bare.isin("", "-", "—", "–"), strip(bare).try_cast("double"))


def phone(c: Column) -> Column:
    d = digits(c)
    return (
        F.when((F.length(d) == 11) & d.startswith("8"), F.concat(F.lit("+7"), F.substr(d, F.lit(2))))
        .when((F.length(d) == 11) & d.startswith("7"), F.concat(F.lit("+"), d))
        .otherwise(compact(c))
    )


def is_likely_phone(c: Column) -> Column:
    value = compact(text_of(c))
    return is_phone_of(value, digits(value))


def is_phone_of(value: Column, d: Column) -> Column:
    """is_likely_phone of a compact text and its digits."""
    return (value.startswith("+") & F.length(d).between(10, 15)) | (
        (F.length(d) == 11) & F.substring(d, 1, 1).isin("7", "8")
    )


def tax_id(c: Column, lengths: Iterable[int] = vocab.TAX_ID_LENGTHS) -> Column:
    d = digits(text_of(c))
    return F.when(F.length(d).isin(*lengths), d).otherwise(F.lit(""))


def is_masked(c: Column, chars: str = vocab.MASK_CHARS) -> Column:
    return contains_any(text_of(c), chars)


def currency_code(c: Column) -> Column:
    v = F.upper(F.trim(c))
    return (
        F.when(v.isin("₽", "RUR") | v.startswith("РУБ"), F.lit("RUB"))
        .when(v.isin("$", "USDT"), F.lit("USD"))
        .when(v == "€", F.lit("EUR"))
        .otherwise(v)
    )


def amount_currency(c: Column, pattern: str = vocab.REVENUE_PATTERN) -> Column:
    """struct(amount, currency) of the first amount that is followed by a currency; empty when none is."""
    value = compact(text_of(c))
    return F.struct(
        digits(F.regexp_extract(value, "(?iu)" + pattern, 1)).alias("amount"),
        currency_code(F.regexp_extract(value, "(?iu)" + pattern, 2)).alias("currency"),
    )


ENTITY = "&(?:#[xX][0-9a-fA-F]+|#[0-9]+|[A-Za-z][A-Za-z0-9]{0,31});?"
LAST_CODE_POINT, UNKNOWN = 0x10FFFF, "\uFFFD"


def _shared_names() -> dict[str, dict[str, str]]:
    """The standard's names with a semicolon, by first letter; Python's copy of the table is read when a plan is made."""
    found: dict[str, dict[str, str]] = {}
    for name, chars in html5.items():
        if name.endswith(";"):
            found.setdefault(name[0], {})[name] = chars
    return found


def _listed(value: object, kind: str) -> Column:
    """A constant map; the optimizer folds it once per plan."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _code_point(digits: Column, number: Column, longest: int) -> Column:
    """The character of a numeric entity by the standard's rules; ``digits`` have no leading zeros."""
    n = F.when(F.length(digits) > longest, F.lit(LAST_CODE_POINT + 1)).otherwise(F.coalesce(number.try_cast("int"), F.lit(0)))
    # 0x80 to 0x9F stand for the characters of Windows-1252, where that has one
    moved = {str(i): bytes([i]).decode("cp1252") if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(i) for i in range(0x80, 0xA0)}
    nothing = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n % 65536 >= 65534)
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return (
        F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > LAST_CODE_POINT), F.lit(UNKNOWN))
        .when(n.between(0x80, 0x9F), _listed(moved, "map<string,string>")[n.cast("string")])
        .when(nothing, F.lit(""))
        .otherwise(char)
    )


def _decoded(token: Column, closed: bool = False) -> Column:
    """The characters of one entity, or the token itself where it is none."""
    name = F.substr(token, F.lit(2))
    hexadecimal = F.regexp_extract(token, "^&#[xX]0*([0-9a-fA-F]*)", 1)
    decimal = F.regexp_extract(token, "^&#0*([0-9]*)", 1)
    # a few old names also count without their semicolon, at the start of a longer word too
    old = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    start = F.regexp_extract(name, "^(" + "|".join(old) + ")", 1)
    whole = F.try_element_at(F.try_element_at(_listed(_shared_names(), "map<string,map<string,string>>"), F.substring(name, 1, 1)), name)
    cut = F.lit("") if closed else start
    found = (
        F.when(token.rlike("^&#[xX]"), _code_point(hexadecimal, F.conv(F.substring(hexadecimal, 1, 6), 16, 10), 6))
        .when(token.startswith("&#"), _code_point(decimal, F.substring(decimal, 1, 7), 7))
        .when(name == "amp;", F.lit("&"))
        .when(name == "nbsp;", F.lit("\u00A0"))
        .otherwise(
            F.coalesce(whole, F.when(cut != "", F.concat(_listed({n: html5[n] for n in old}, "map<string,string>")[start], F.substr(name, F.length(start) + 1))), token)
        )
    )
    return F.when(token.endswith(";"), found).otherwise(token) if closed else found


def unescape(c: Column, closed: bool = False) -> Column:
    """HTML entities to characters, each once; texts without an ampersand pass untouched.

    Entities count without their semicolon where browsers read them so; with ``closed`` they never do, so
    that a cut one (``&amp`` at the end of a shortened title) stays as it is.
    """
    tokens, gaps = F.regexp_extract_all(c, F.lit(ENTITY), F.lit(0)), F.split(c, ENTITY, -1)
    tail = F.transform(F.arrays_zip(tokens.alias("t"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("g")), lambda x: F.concat(_decoded(x["t"], closed), x["g"]))
    return F.when(F.contains(c, F.lit("&")), F.concat(F.get(gaps, F.lit(0)), F.array_join(tail, ""))).otherwise(c)


def plain_text(c: Column, closed: bool = False) -> Column:
    """Text of an HTML fragment: tags become blanks, entities characters, white space is compacted."""
    return compact(unescape(F.regexp_replace(text_of(c), "<.*?>", " "), closed))
