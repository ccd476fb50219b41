"""Name spellings, address candidates and search queries: one row fans out inside the row."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefacts import vocab
from sitefacts.functions import text as T
from sitefacts.operators.urls import with_domain

TOKEN_NAMES = ("middle", "first", "last", "f", "l", "m")


def constant(value: object, kind: str) -> Column:
    """A nested constant; folded once when the plan is optimised."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), kind)


def name_token(c: Column) -> Column:
    return F.regexp_replace(T.fold_yo(F.lower(T.strip(T.text_of(c)))), "[^а-яa-z-]+", "")


def with_name_token(df: DataFrame, col: str, out: str = "token") -> DataFrame:
    return df.withColumn(out, name_token(F.col(col)))


def _distinct_head(values: Column, n: int) -> Column:
    return F.slice(F.array_distinct(F.filter(values, lambda v: v != "")), 1, n)


def spellings(token: Column, most: int, letters: Mapping[str, Sequence[str]] = vocab.LETTER_SPELLINGS) -> Column:
    """Latin spellings of a clean token: the product over its letters' spellings, cut while it grows."""
    table = constant({k: list(v) for k, v in letters.items()}, "map<string,array<string>>")
    empty = F.array(F.lit(""))

    def grow(found: Column, letter: Column) -> Column:
        choices = F.coalesce(F.try_element_at(table, letter), empty)
        grown = F.flatten(F.transform(found, lambda p: F.transform(choices, lambda s: F.concat(p, s))))
        return F.slice(grown, 1, 4 * most)

    product = F.aggregate(F.filter(F.split(token, ""), lambda x: x != ""), empty, grow)
    latin = F.array(F.replace(token, F.lit("-"), F.lit("")))
    return (
        F.when(token == "", F.array().cast("array<string>"))
        .when(token.rlike("^[a-z-]+$"), _distinct_head(latin, most))
        .otherwise(_distinct_head(product, most))
    )


def variants(name: Column, most: int, first_name: bool = False, aliases: Mapping[str, Sequence[str]] = vocab.FIRST_NAME_SPELLINGS) -> Column:
    """Usual spellings of first names, then letter by letter; distinct, in order, at most ``most``."""

    def of(token: Column) -> Column:
        found = spellings(token, most)
        if first_name:
            table = constant({k: list(v) for k, v in aliases.items()}, "map<string,array<string>>")
            usual = F.coalesce(F.try_element_at(table, token), F.array().cast("array<string>"))
            found = F.concat(F.transform(usual, lambda v: F.regexp_replace(F.lower(v), "[^a-z0-9]+", "")), found)
        return _distinct_head(found, most)

    return T.let(name_token(name), of)


def name_variants(names: DataFrame, col: str, most: int = 8, first_name: bool = False, out: str = "variant") -> DataFrame:
    """One row per spelling, with its place."""
    return names.select("*", F.posexplode(variants(F.col(col), most, first_name)).alias("variant_pos", out))


def pattern_tokens(pattern: str) -> list[str] | None:
    """Tokens and separators of an address pattern; None for a pattern with anything else in it."""
    tokens, rest = [], pattern
    while rest:
        token = rest[0] if rest[0] in "._+-" else next((t for t in TOKEN_NAMES if rest.startswith(t)), None)
        if token is None:
            return None
        tokens.append(token)
        rest = rest[len(token) :]
    return tokens


def patterns_constant(patterns: Sequence[str]) -> Column:
    return constant([t for t in map(pattern_tokens, patterns) if t], "array<array<string>>")


def rendered(tokens: Column, first: Column, last: Column, middle: Column) -> Column:
    """Local part by a pattern; empty when one of its names is empty."""

    def value(t: Column) -> Column:
        return (
            F.when(t == "first", first).when(t == "last", last).when(t == "middle", middle)
            .when(t == "f", F.substring(first, 1, 1)).when(t == "l", F.substring(last, 1, 1)).when(t == "m", F.substring(middle, 1, 1))
            .otherwise(t)
        )

    return T.let(
        F.transform(tokens, value),
        lambda parts: F.when(F.exists(parts, lambda p: p == ""), F.lit("")).otherwise(
            F.regexp_replace(F.array_join(parts, ""), r"^[._+\-]+|[._+\-]+$", "")
        ),
    )


def render_patterns(names: DataFrame, first: str, last: str, middle: str, patterns: Sequence[str] = vocab.ADDRESS_PATTERNS) -> DataFrame:
    """One row per pattern that can be filled: pattern number and local part."""
    texts = [T.text_of(c) for c in (first, last, middle)]
    locals_ = F.transform(patterns_constant(patterns), lambda p: rendered(p, *texts))
    return names.select("*", F.posexplode(locals_).alias("pattern", "local")).filter("local <> ''")


def email_candidates(people: DataFrame, domain: str = "domain", last: str = "last_name", first: str = "first_name", middle: str = "middle_name", most: int = 8, patterns: Sequence[str] = vocab.ADDRESS_PATTERNS) -> DataFrame:
    """One row per distinct address that the spellings and patterns give for a person's domain.

    All combinations are built inside the row, so nothing is joined or shuffled.
    """
    most = max(1, most)
    df = with_domain(people, domain, "_domain", "mail")
    df = df.filter((F.col("_domain") != "") & (name_token(F.col(last)) != "") & (name_token(F.col(first)) != ""))
    middles = variants(F.col(middle), max(2, most // 2))
    df = df.withColumns(
        {
            "_f": variants(F.col(first), most, first_name=True),
            "_l": variants(F.col(last), most),
            "_m": T.let(middles, lambda m: F.when(F.size(m) > 0, m).otherwise(F.array(F.lit("")))),
            "_p": patterns_constant(patterns),
        }
    )
    combine = F.transform(
        "_f",
        lambda f: F.flatten(F.transform("_l", lambda l: F.flatten(F.transform("_m", lambda m: F.transform("_p", lambda p: rendered(p, f, l, m)))))),
    )
    tidy = lambda x: F.lower(F.regexp_replace(F.regexp_replace(x, r"[._+\-]{2,}", "."), r"^[._+\-]+|[._+\-]+$", ""))
    addresses = F.transform(F.filter(F.flatten(combine), lambda x: x != ""), lambda x: F.concat(tidy(x), F.lit("@"), F.col("_domain")))
    good = F.filter(F.array_distinct(addresses), lambda a: a.rlike(vocab.STRICT_EMAIL))
    return df.withColumn("email", F.explode(good)).drop("_domain", "_f", "_l", "_m", "_p")


def person_parts(person: Column, last_first: bool = False) -> tuple[Column, Column]:
    """First and last name of a written name, NULL where it has fewer than two words."""
    words = F.regexp_extract_all(person, F.lit("[A-Za-zА-Яа-яЁё-]+"), F.lit(0))
    one, two = F.try_element_at(words, F.lit(1)), F.try_element_at(words, F.lit(2))
    first, last = (two, one) if last_first else (one, two)
    return F.when(two.isNotNull(), first), F.when(two.isNotNull(), last)


def search_queries(people: DataFrame, person: str = "person", most: int = 8, last_first: bool = False) -> DataFrame:
    """One row per search text of a person, in the order to try: (…, query_pos, query)."""
    first, last = person_parts(F.col(person), last_first)
    df = people.withColumns({"_first": first, "_last": last}).filter("_first IS NOT NULL")
    df = df.withColumns({"_f": variants(F.col("_first"), most, first_name=True), "_l": variants(F.col("_last"), most)})
    pairs = lambda sep: F.flatten(F.transform(F.slice("_f", 1, 4), lambda f: F.transform(F.slice("_l", 1, 4), lambda l: F.concat(f, F.lit(sep), l))))
    bare = F.concat(name_token(F.col("_first")), name_token(F.col("_last")))
    compact = F.when((name_token(F.col("_first")) != "") & (name_token(F.col("_last")) != ""), F.regexp_replace(bare, "[^0-9a-zа-я]+", ""))
    queries = F.concat(F.array(T.compact(F.col(person)), F.col("_last")), F.col("_l"), pairs(" "), pairs(""), F.array(F.coalesce(compact, F.lit(""))))
    distinct = F.array_distinct(F.filter(queries, lambda q: q != ""))
    return df.select("*", F.posexplode(distinct).alias("query_pos", "query")).drop("_first", "_last", "_f", "_l")
