"""Names against profiles: scored matches, confidence, best rows and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefacts.functions import text as T
from sitefacts.functions.joins import lookup_join
from sitefacts.operators.cells import PART_VALUES, cell_parts
from sitefacts.operators.candidates import person_parts, variants
from sitefacts.operators.first import collect_ordered, first_per_key
from sitefacts.session import land

GRAM = 3
BIT_WORDS = 4


def name_form(c: Column) -> Column:
    return T.compact(F.regexp_replace(F.lower(T.fold_yo(T.text_of(c))), "[^0-9a-zа-я._@]+", " "))


def name_words(form: Column) -> Column:
    return F.filter(F.split(form, " "), lambda w: (w != "") & ~w.isin("и", "the"))


def grams(c: Column, sizes: range) -> Column:
    """Distinct substrings of the given lengths."""
    length = F.length(c)

    def of_size(n: int) -> Column:
        parts = F.transform(F.sequence(F.lit(1), length - n + 1), lambda i: F.substr(c, i, F.lit(n)))
        return F.when(length >= n, parts).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of_size(n) for n in sizes]))


def match_score(target: Column, words: Column, username: Column, full_name: Column, payload: Column) -> Column:
    one = F.try_element_at(words, F.lit(1))
    return (
        F.when((target == username) | (target == full_name), F.lit(100))
        .when(F.contains(payload, target), F.lit(90))
        .when((F.size(words) >= 2) & F.forall(words, lambda w: F.contains(payload, w)), F.lit(80))
        .when((F.size(words) == 1) & ((one == username) | (one == full_name)), F.lit(70))
        .when((F.size(words) == 1) & F.contains(payload, one), F.lit(55))
        .otherwise(F.lit(0))
    )


def with_gram_bits(df: DataFrame, pieces: str, prefix: str) -> DataFrame:
    """The bits of an array of pieces in place of the array; an array that holds more has all bits of these."""
    df = df.withColumn(pieces, F.transform(pieces, lambda g: F.xxhash64(g)))

    def word(k: int) -> Column:
        bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 2).bitwiseAND(F.lit(63)).cast("int"))
        return F.aggregate(pieces, F.lit(0).cast("long"), lambda acc, h: F.when(h.bitwiseAND(F.lit(3)) == k, acc.bitwiseOR(bit(h))).otherwise(acc))

    return df.withColumns({f"{prefix}{k}": word(k) for k in range(BIT_WORDS)}).drop(pieces)


def name_probes(people: DataFrame, person: str) -> DataFrame:
    """(person, _target, _words, _need, bits): names with all pieces that a scored text holds.

    Every score above 0 has all words of the name in the text, hence all their three-letter pieces; a name
    of shorter words only needs these words as they are.
    """
    names = people.select(person).distinct().withColumn("_target", name_form(F.col(person))).filter("_target <> ''")
    names = names.withColumn("_words", name_words(F.col("_target")))
    names = names.withColumn("_held", F.when(F.size("_words") > 0, F.col("_words")).otherwise(F.array("_target")))
    of_words = F.array_distinct(F.flatten(F.transform("_held", lambda w: grams(w, range(GRAM, GRAM + 1)))))
    names = names.withColumn("_long", of_words).withColumn("_need", F.when(F.size("_long") > 0, F.col("_long")).otherwise(F.col("_held")))
    return with_gram_bits(names.drop("_held"), "_long", "_b")


def text_pieces(texts: DataFrame, asked: DataFrame, *more: Column) -> DataFrame:
    """(_id, _gram, more): the pieces of texts that are asked for; nothing else leaves the row of its text.

    There are less than 71 ** 3 + 71 ** 2 + 71 pieces, since name_form leaves 71 signs: the broadcast is
    bounded. No text is cut into one and two letters unless such a piece is asked for.
    """

    def cut(sizes: range) -> DataFrame:
        wanted = F.broadcast(asked.where(F.length("_gram").between(sizes[0], sizes[-1])))
        return texts.select("_id", *more, F.explode(grams(F.col("_payload"), sizes)).alias("_gram")).join(wanted, "_gram", "left_semi")

    return cut(range(GRAM, GRAM + 1)).unionByName(cut(range(1, GRAM)))


def name_candidates(names: DataFrame, texts: DataFrame) -> DataFrame:
    """(_id, columns of a name): an exact filter in front of the score.

    A name meets the texts that hold its rarest piece, whichever word it is of, and of these only the ones
    whose bits include all bits of the name. Digests and bits travel, no texts.
    """
    probes = names.withColumn("_gram", F.explode("_need")).drop("_need")
    frequency = text_pieces(texts, probes.select("_gram").distinct()).groupBy("_gram").agg(F.count("*").alias("_n"))
    columns = [c for c in probes.columns if c != "_gram"]
    rarest = F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram")
    # one row per possible piece at most, as in text_pieces
    keyed = land(probes.join(F.broadcast(frequency), "_gram", "left").groupBy(*columns).agg(rarest), "names")
    of_name, of_text = ([f"{p}{k}" for k in range(BIT_WORDS)] for p in ("_b", "_tb"))
    pieces = text_pieces(texts, keyed.select("_gram").distinct(), *map(F.col, of_text)).withColumnRenamed("_gram", "_piece")
    within = [F.col(b).bitwiseAND(F.col(t)) == F.col(b) for b, t in zip(of_name, of_text)]
    return pieces.join(keyed, reduce(lambda a, b: a & b, within, F.col("_gram") == F.col("_piece"))).drop("_gram", "_piece", *of_name, *of_text)


def profile_texts(rows: DataFrame) -> DataFrame:
    """(_id, _u, _f, _t, _payload, bits): different texts of profiles, landed."""
    texts = rows.groupBy("_id").agg(*[F.first(c).alias(c) for c in ("_u", "_f", "_t")])
    texts = texts.withColumn("_payload", F.concat_ws(" ", *[T.empty_to_null(F.col(c)) for c in ("_u", "_f", "_t")]))
    return land(with_gram_bits(texts.withColumn("_grams", grams(F.col("_payload"), range(GRAM, GRAM + 1))), "_grams", "_tb"), "profile-texts")


def match_people(people: DataFrame, profiles: DataFrame, person: str = "person", username: str = "username", full_name: str = "full_name", text: str = "row_text") -> DataFrame:
    """Every (person, profile row) pair with a score above 0.

    The score is computed on distinct texts and only for the pairs of ``name_candidates``; texts join last,
    landed, so a text that many names meet can be split, and so can a piece that many texts hold.
    """
    rows = profiles.withColumns({"_u": name_form(F.col(username)), "_f": name_form(F.col(full_name)), "_t": name_form(F.col(text))})
    rows = rows.withColumn("_id", F.md5(F.concat_ws("\u0001", "_u", "_f", "_t")))
    texts = profile_texts(rows)
    pairs = lookup_join(name_candidates(name_probes(people, person), texts), texts.select("_id", "_u", "_f", "_t", "_payload"), ["_id"], "inner", landed=True)
    scored = pairs.withColumn("match_score", match_score(F.col("_target"), F.col("_words"), F.col("_u"), F.col("_f"), F.col("_payload")))
    # other keys than those of the joins around it, so that both can be split
    scored = scored.filter("match_score > 0").select(person, "_id", "match_score").repartition("_id", person)
    return scored.join(rows.drop("_u", "_f", "_t"), "_id").drop("_id")


def with_confidence(rows: DataFrame, person: str = "target_person", most: int = 8, last_first: bool = False, out: str = "confidence") -> DataFrame:
    """high, medium or low by the spellings of first and last name found; empty for rows not ok."""
    first, last = person_parts(F.col(person), last_first)
    forms = lambda name, is_first: F.filter(F.transform(F.concat(F.array(name), variants(name, most, is_first)), name_form), lambda v: v != "")
    payload = name_form(F.concat_ws(" ", "found_username", "found_full_name", "matched_text"))
    df = rows.withColumns({"_first": first, "_last": last})
    df = df.withColumns({"_fv": forms(F.col("_first"), True), "_lv": forms(F.col("_last"), False), "_payload": payload, "_user": name_form(F.col("found_username"))})
    any_in = lambda values, where: F.exists(values, lambda v: F.contains(F.col(where), v))
    joined = F.exists("_fv", lambda f: F.exists("_lv", lambda l: F.contains(F.col("_user"), F.concat(f, l))))
    df = df.withColumns({"_hf": any_in("_fv", "_payload"), "_hl": any_in("_lv", "_payload"), "_hc": joined})
    value = (
        F.when(F.col("status") != "ok", F.lit(""))
        .when((F.col("_hf") & F.col("_hl")) | F.col("_hc"), F.lit("high"))
        .when(F.col("_hl"), F.lit("medium"))
        .otherwise(F.lit("low"))
    )
    return df.withColumn(out, value).drop("_first", "_last", "_fv", "_lv", "_payload", "_user", "_hf", "_hl", "_hc")


def match_rank() -> list[Column]:
    """Confidence, then score, best first."""
    rank = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).when(F.col("confidence") == "low", 1).otherwise(0)
    return [-rank, -F.coalesce(F.col("match_score").try_cast("int"), F.lit(0))]


def best_match(rows: DataFrame, person: str = "target_person", profile: str = "found_profile_url", pos: str = "pos") -> DataFrame:
    """Per person and profile the ok row of the best rank; the earlier one wins ties."""
    ok = rows.filter((F.col("status") == "ok") & (T.text_of(profile) != ""))
    return first_per_key(ok, [person, profile], [*match_rank(), pos])


def not_found_rows(people: DataFrame, best: DataFrame, rows: DataFrame, person: str = "target_person", pos: str = "pos") -> DataFrame:
    """The first not_found row of every person without any match."""
    missed = first_per_key(rows.filter("status = 'not_found'"), [person], [pos]).withColumn("searched_name", F.lit(""))
    missed = missed.join(people.select(F.col(people.columns[0]).alias(person)).distinct(), person, "left_semi")
    return missed.join(best.select(person).distinct(), person, "left_anti")


def detail_rows(people: DataFrame, rows: DataFrame, person: str = "target_person", profile: str = "found_profile_url", pos: str = "pos") -> DataFrame:
    """Best matches, then error rows, then one row per person not found."""
    best = best_match(rows, person, profile, pos)
    errors = rows.filter(~((F.col("status") == "ok") & (T.text_of(profile) != "")) & (F.col("status") != "not_found"))
    return best.unionByName(errors).unionByName(not_found_rows(people, best, rows, person, pos).select(*rows.columns))


def sort_matches(best: DataFrame, person: str = "target_person", profile: str = "found_profile_url") -> DataFrame:
    rank, score = match_rank()
    return best.orderBy(F.col(person).desc(), rank, score, F.col(profile).desc())


def match_lines(rows: DataFrame, person: str = "target_person", profile: str = "found_profile_url", pos: str = "pos") -> DataFrame:
    """(person, _rank, _score, _seen, _line): the matches of ``match_summary`` as rows, with their order."""
    rank, score = match_rank()
    best = best_match(rows, person, profile, pos)
    first_seen = rows.filter(F.col("status") == "ok").groupBy(person, profile).agg(F.min(pos).alias("_seen"))
    best = best.join(first_seen, [person, profile]).withColumns({"_rank": rank, "_score": score})
    shown = F.concat_ws(
        " | ", T.text_of("found_username"), T.text_of("found_full_name"), F.col(profile),
        F.concat(F.lit("confidence="), T.text_of("confidence")), F.concat(F.lit("query="), T.text_of("searched_name")),
    )
    return best.withColumn("_line", shown).select(person, "_rank", "_score", "_seen", "_line")


def match_parts(rows: DataFrame, person: str = "target_person", profile: str = "found_profile_url", pos: str = "pos", most: int = PART_VALUES) -> DataFrame:
    """(person, part, matched_profiles): the matches of ``match_summary``, best first, ``most`` in a row at most."""
    return cell_parts(match_lines(rows, person, profile, pos), [person], [F.col(c) for c in ("_rank", "_score", "_seen")], "_line", "matched_profiles", most)


def match_summary(people: DataFrame, rows: DataFrame, queries: DataFrame, person: str = "target_person", profile: str = "found_profile_url", pos: str = "pos") -> DataFrame:
    """One row per person: found or not, how many profiles, the matches best first, the queries tried."""
    best = match_lines(rows, person, profile, pos)
    counted = best.groupBy(person).agg(F.count("*").alias("_n"))
    lines = collect_ordered(best, [person], ["_rank", "_score", "_seen"], "_line", "matched_profiles")
    tried = collect_ordered(queries, [person], ["query_pos"], "query", "queries_checked")
    out = people.select(F.col(people.columns[0]).alias(person)).distinct()
    for part in (counted, lines, tried):
        out = out.join(part, person, "left")
    n = F.coalesce("_n", F.lit(0))
    return out.select(
        person, F.when(n > 0, F.lit("found")).otherwise(F.lit("not_found")).alias("status"), n.alias("matched_profiles_count"),
        T.text_of("matched_profiles").alias("matched_profiles"), T.text_of("queries_checked").alias("queries_checked"),
    )
