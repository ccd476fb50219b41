"""Line tables (document, pos, text) to registry facts and labelled sections.

Documents may be of any length: order within a document is handled in blocks (``functions.blocks``).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefacts import vocab
from sitefacts.functions import text as T
from sitefacts.functions.blocks import WIDTH, forward_fill, numbered, scan, with_lookahead
from sitefacts.operators.first import collect_ordered, first_per_key
from sitefacts.sources.tables import land


def is_heading(text: Column) -> Column:
    folded = T.compact(F.lower(text))
    return folded.startswith(vocab.HEADING_STARTS[0]) | folded.startswith(vocab.HEADING_STARTS[1])


def is_numbered(text: Column) -> Column:
    return T.strip(text).rlike(rf"^\d+{T.WS}")


def labelled(text: Column, label: str) -> Column:
    """Value behind the label at the start of a line (a number may stand in front); NULL without one."""
    return T.empty_to_null(T.compact(F.regexp_extract(T.strip(text), rf"(?iu)^(?:\d+{T.WS}+)?{label}{T.WS}+(.+?)$", 1)))


def registry_lines(lines: DataFrame, text: str = "text") -> DataFrame:
    """Drops blank lines and the running heads and feet of an extract."""
    folded = T.compact(F.lower(F.col(text)))
    foot = folded.rlike(rf"^\d{{2}}\.\d{{2}}\.\d{{4}}{T.WORD_END}.*{T.WORD_START}страница\s+\d+\s+из\s+\d+$")
    return lines.filter((folded != "") & ~folded.startswith("выписка из егрюл") & ~foot)


def registry_extract(lines: DataFrame, doc: str = "document", pos: str = "pos", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(document, section, full_name, n): people of the two person sections, distinct, in order.

    A heading may run over three more lines. A surname line takes the first name and patronymic lines
    within the next seven, up to a heading or another surname.
    """
    t = F.col(text)
    rows = lines.select(
        doc,
        pos,
        is_heading(t).alias("_head"),
        (is_heading(t) | is_numbered(t)).alias("_stop"),
        T.compact(F.lower(t)).alias("_flat"),
        labelled(t, vocab.SURNAME_LABEL).alias("_sur"),
        labelled(t, vocab.NAME_LABEL).alias("_first"),
        labelled(t, vocab.PATRONYMIC_LABEL).alias("_patr"),
    )
    # numbering, the window and the scan below read their rows twice each, so the lines are read once before them
    rows = land(numbered(land(rows, "lines"), [doc], pos, "_n", width).drop(pos), "lines")
    rows, window = with_lookahead(rows, [doc], "_n", 7, width)
    more = [F.lead(F.struct("_stop", "_flat"), i).over(window) for i in (1, 2, 3)]
    ahead = window.rowsBetween(1, 7)
    at = lambda c: F.min(F.when(c, F.col("_n"))).over(ahead)
    rows = rows.withColumns(
        {
            "_more": F.array(*more),
            "_end": F.least(at(F.col("_head") | F.col("_sur").isNotNull()), F.col("_n") + 8),
            "_a": F.min(F.when(F.col("_first").isNotNull(), F.struct("_n", F.col("_first").alias("v")))).over(ahead),
            "_b": F.min(F.when(F.col("_patr").isNotNull(), F.struct("_n", F.col("_patr").alias("v")))).over(ahead),
        }
    ).filter("_own")
    # a continuation counts while none before it stops the heading
    joined = F.aggregate(
        "_more",
        F.struct(F.col("_flat").alias("s"), F.lit(True).alias("go")),
        lambda acc, m: F.when(
            acc["go"] & m.isNotNull() & ~m["_stop"], F.struct(F.concat(acc["s"], F.lit(" "), m["_flat"]).alias("s"), F.lit(True).alias("go"))
        ).otherwise(F.struct(acc["s"].alias("s"), F.lit(False).alias("go"))),
    )["s"]
    section = (
        F.when(F.contains(joined, F.lit(vocab.EXECUTIVE_SECTION)), F.lit("executive"))
        .when(F.contains(joined, F.lit(vocab.FOUNDERS_SECTION)), F.lit("founders"))
        .otherwise(F.lit(""))
    )
    rows = forward_fill(rows, [doc], "_n", F.when(F.col("_head"), section), "section", width)
    within = lambda c: F.when(F.col(f"{c}._n") < F.coalesce("_end", F.col("_n") + 8), F.col(f"{c}.v"))
    people = rows.filter("NOT _head AND section <> '' AND _sur IS NOT NULL")
    people = people.withColumns({"_a": within("_a"), "_b": within("_b")}).filter("_a IS NOT NULL OR _b IS NOT NULL")
    people = people.select(doc, "section", F.concat_ws(" ", "_sur", "_a", "_b").alias("full_name"), F.col("_n").alias("n"))
    return first_per_key(people, [doc, "section", "full_name"], ["n"])


def first_sections(lines: DataFrame, doc: str, pos: str, rules: Mapping[str, tuple[Column, Column]], width: int = WIDTH) -> DataFrame:
    """Marks, for every (label, stop) rule, the lines of the first labelled section of a document.

    Adds per rule a column that is ``label`` on the first labelled line, ``line`` on the lines behind it
    up to the first stop, and NULL elsewhere. A later label does not open a section again, but may be a
    stop. All rules share one pass.
    """
    # a section is open from the first label on, as long as no stop lies behind that label
    at = lambda c: F.when(c, F.col(pos))
    rows = scan(
        lines,
        [doc],
        pos,
        first={f"_l_{n}": at(label) for n, (label, _) in rules.items()},
        last={f"_x_{n}": at(stop) for n, (_, stop) in rules.items()},
        width=width,
    )
    here = lambda n: F.col(pos) == F.col(f"_l_{n}")
    is_open = lambda n: F.col(f"_l_{n}").isNotNull() & (F.coalesce(f"_x_{n}", f"_l_{n}") <= F.col(f"_l_{n}"))
    rows = rows.withColumns({n: F.when(is_open(n), F.when(here(n), F.lit("label")).otherwise(F.lit("line"))) for n in rules})
    return rows.drop(*[f"_{k}_{n}" for n in rules for k in "lx"])


def registry_address(lines: DataFrame, doc: str = "document", pos: str = "pos", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(document, address): the first address label's value and its following lines."""
    t = F.col(text)
    rule = (labelled(t, vocab.ADDRESS_LABEL).isNotNull(), is_heading(t) | is_numbered(t))
    rows = first_sections(lines.select(doc, pos, text).filter(T.strip(t) != ""), doc, pos, {"_at": rule}, width).filter("_at IS NOT NULL")
    part = F.when(F.col("_at") == "label", labelled(t, vocab.ADDRESS_LABEL)).otherwise(T.compact(t))
    return collect_ordered(rows.withColumn("_p", part), [doc], [pos], "_p", "address", " ")


EMAIL_HEADING = rf"(?iu)^\s*(?:\d+\s+)?{vocab.EMAIL_LABEL}{T.WORD_END}(.*)$"
GRN = rf"(?iu){T.WORD_START}грн{T.WORD_END}.*?((?:\d[\s\x{{A0}}]*){{13}})"
ANY_CASE_EMAIL = r"(?i)[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}"


def registry_emails(lines: DataFrame, doc: str = "document", pos: str = "pos", text: str = "text", reach: int = 12, width: int = WIDTH) -> DataFrame:
    """(document, email, grn): addresses of the e-mail sections, read over broken lines."""
    rows = numbered(lines.select(doc, pos, F.col(text).alias("_t")), [doc], pos, "_n", width)
    rows = rows.withColumns(
        {
            "_open": F.col("_t").rlike(EMAIL_HEADING),
            "_head": is_heading(F.col("_t")),
            "_grn": F.contains(T.compact(F.lower("_t")), F.lit("грн")),
        }
    )
    rows, window = with_lookahead(rows, [doc], "_n", reach, width)
    ahead = window.rowsBetween(1, reach)
    stop = F.min(F.when(F.col("_open") | F.col("_head") | F.col("_grn"), F.struct("_n", F.col("_open").alias("o"), F.col("_head").alias("h"), F.col("_t").alias("t")))).over(ahead)
    rows = rows.withColumns({"_end": stop, "_next": F.collect_list(F.struct("_n", "_t")).over(ahead)}).filter("_own AND _open")
    rest = F.transform(
        F.filter(F.array_sort("_next"), lambda l: F.col("_end").isNull() | (l["_n"] < F.col("_end._n"))), lambda l: l["_t"]
    )
    parts = F.filter(F.concat(F.array(T.strip(F.regexp_extract("_t", EMAIL_HEADING, 1))), rest), lambda p: p != "")
    rows = rows.withColumn("_parts", F.transform(parts, T.compact))
    tight = F.regexp_extract(F.array_join("_parts", ""), ANY_CASE_EMAIL, 0)
    loose = F.regexp_extract(T.compact(F.array_join("_parts", " ")), ANY_CASE_EMAIL, 0)
    grn = F.when(~F.col("_end.o") & ~F.col("_end.h"), T.digits(F.regexp_extract(F.col("_end.t"), GRN, 1)))
    rows = rows.select(
        doc, "_n", F.lower(F.when(tight != "", tight).otherwise(loose)).alias("email"), F.coalesce(grn, F.lit("")).alias("grn")
    ).filter("email <> ''")
    return first_per_key(rows, [doc, "email", "grn"], ["_n"]).drop("_n")


def label_form(text: Column) -> Column:
    return F.translate(T.compact(F.lower(text)), "`’", "''")


FORM, LABELS = "_form", "_labels"


def with_form(lines: DataFrame, doc: str, pos: str, text: str) -> DataFrame:
    """Non-blank lines with the form that labels are compared in and the sections whose labels they open with (NULL: none).

    Lines that have both pass as they are, so a caller may land them and have them worked out once per line.
    """
    if FORM in lines.columns:
        return lines
    rows = lines.select(doc, pos, text, label_form(F.col(text)).alias(FORM)).filter(f"{FORM} <> ''")
    named = F.array_compact(F.array(*[F.when(opens_with(F.col(FORM), aliases), F.lit(k)) for k, aliases in vocab.SECTION_LABELS.items()]))
    return rows.withColumn(LABELS, F.when(opens_with(F.col(FORM), ALL_ALIASES), named))


def opens_section(*keys: str) -> Column:
    """True on lines of ``with_form`` that open with a label of any of the sections."""
    return F.coalesce(F.arrays_overlap(F.col(LABELS), T.literals(keys)), F.lit(False))


def opens_with(form: Column, aliases: Iterable[str]) -> Column:
    return form.rlike("^(?:" + "|".join(re.escape(a) for a in aliases) + ")")


def inline_value(text: Column, aliases: Iterable[str]) -> Column:
    """Value on the label's own line, by the first alias that has one; empty without."""
    found = [T.empty_to_null(T.compact(F.regexp_extract(text, rf"(?iu)^\s*{re.escape(a)}\s*[:\-]?\s*(.+?)\s*$", 1))) for a in aliases]
    return F.coalesce(*found, F.lit(""))


PLAIN_KEYS = ("description", "industries", "technologies", "website", "tin", "country", "legal_entity_name")
ALL_ALIASES = tuple(a for aliases in vocab.SECTION_LABELS.values() for a in aliases)


def section_values(lines: DataFrame, keys: Sequence[str] = PLAIN_KEYS, doc: str = "document", pos: str = "pos", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(document, key, pos, value): distinct values of the sections that any label ends."""
    t, form = F.col(text), F.col(FORM)
    rows = with_form(lines, doc, pos, text)
    ends = t.startswith(vocab.PAGE_FOOTER_START) | form.isin(*vocab.REVENUE_STOPS)
    rows = rows.withColumns({"_any": F.col(LABELS).isNotNull() | ends, "_keys": F.filter(LABELS, lambda k: k.isin(*keys))})
    # one pass for all keys: every line belongs to the segment that the last label or stop opened
    rows = forward_fill(rows, [doc], pos, F.when(F.col("_any"), F.col(pos)), "_seg", width)
    first = rows.select(doc, F.explode("_keys").alias("key"), F.col(pos).alias("_seg")).groupBy(doc, "key").agg(F.min("_seg").alias("_seg"))
    inline = F.coalesce(*[F.when(F.col("key") == k, inline_value(t, vocab.SECTION_LABELS[k])) for k in keys])
    # a segment is one label's lines; only segments that a wanted label opens reach the join
    rows = rows.join(first, [doc, "_seg"])
    value = F.when(F.col(pos) == F.col("_seg"), inline).otherwise(F.when(~F.col("_any"), T.compact(t)))
    rows = rows.select(doc, "key", pos, value.alias("value")).filter("value <> ''").filter(~opens_with(label_form(F.col("value")), ALL_ALIASES))
    return first_per_key(rows, [doc, "key", F.lower("value")], [pos])


def _listed(rows: DataFrame, doc: str, pos: str, keys: Sequence[str]) -> DataFrame:
    """One row per document with the ordered values of each key as a list."""
    pairs = lambda k: F.collect_list(F.when(F.col("key") == k, F.struct(pos, "value")))
    return rows.groupBy(doc).agg(*[F.transform(F.array_sort(pairs(k)), lambda p: p["value"]).alias(f"_{k}") for k in keys])


def _first_of(values: Column, test) -> Column:
    """First non-null result of the test over a list."""
    return F.try_element_at(F.filter(F.transform(values, lambda v: test(v)), lambda v: v.isNotNull()), F.lit(1))


def labelled_sections(lines: DataFrame, doc: str = "document", pos: str = "pos", text: str = "text", width: int = WIDTH, websites: int = 3, tins: int = 2, contact_values: int = 2) -> DataFrame:
    """One profile row per document from its label and value lines.

    Of the values under a label, the first usable one among so many ``websites``, ``tins`` and
    ``contact_values`` counts.
    """
    head = lambda key, n: F.slice(F.coalesce(f"_{key}", F.array().cast("array<string>")), 1, n)
    joined = lambda key, sep: F.coalesce(F.array_join(f"_{key}", sep), F.lit(""))

    def site(v: Column) -> Column:
        url, bare = F.regexp_extract(v, r"(?i)https?://[^\s]+", 0), F.regexp_replace(v, "^/+|/+$", "")
        named = F.contains(v, F.lit(".")) & ~F.contains(v, F.lit(" ")) & F.contains(bare, F.lit("."))
        whole = F.when(bare.startswith("http"), bare).otherwise(F.concat(F.lit("https://"), bare))
        return F.when(url != "", url).when(named, whole)

    tax = lambda v: F.when(F.length(T.digits(v)).isin(*vocab.TAX_ID_LENGTHS), T.digits(v))
    documents = lines.select(doc)
    # two scans read these lines, each more than once; labels are looked up once per line
    lines = land(with_form(lines, doc, pos, text), "forms")
    plain = _listed(section_values(lines, PLAIN_KEYS, doc, pos, text, width), doc, pos, PLAIN_KEYS)
    t, form = F.col(text), F.col(FORM)
    ends = t.startswith(vocab.PAGE_FOOTER_START) | form.isin(*vocab.REVENUE_STOPS)
    rules = {
        "revenue": (opens_section("revenue"), ends | opens_section(*vocab.REVENUE_SECTION_STOPS)),
        "contacts": (opens_section("contacts"), ends | form.isin(*vocab.CONTACT_STOPS)),
    }
    marked = first_sections(lines, doc, pos, rules, width)
    value = lambda k: F.when(F.col(k) == "label", inline_value(t, vocab.SECTION_LABELS[k])).otherwise(T.compact(t))
    found = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.when(F.col(k).isNotNull(), value(k)).alias("value")) for k in rules]), lambda x: F.coalesce(x["value"] != "", F.lit(False)))
    # read three times below; the lines of these sections are few, so they are written once
    members = land(marked.select(doc, pos, F.explode(found).alias("_m")).select(doc, pos, "_m.*"), "sections")
    money = _listed(members.filter("key = 'revenue'"), doc, pos, ["revenue"]).withColumn("_money", T.amount_currency(F.array_join("_revenue", " ")))
    contacts = section_contacts(members.filter("key = 'contacts'").select(doc, pos, "value"), doc, pos, width, contact_values)
    out = documents.distinct().join(plain, doc, "left").join(money, doc, "left").join(contacts, doc, "left")
    out = out.select(
        doc, joined("description", " ").alias("description"), joined("industries", "; ").alias("industries"), joined("technologies", "; ").alias("technologies"),
        _first_of(head("website", websites), site).alias("website"), _first_of(head("tin", tins), tax).alias("tin"),
        F.try_element_at("_country", F.lit(1)).alias("country"), F.try_element_at("_legal_entity_name", F.lit(1)).alias("legal_entity_name"),
        F.col("_money.amount").alias("revenue_amount"), F.col("_money.currency").alias("revenue_currency"),
        "contact_name", "contact_email", "contact_phone",
    )
    return out.na.fill("", [c for c in out.columns if c != doc])


def section_contacts(section: DataFrame, doc: str = "document", pos: str = "pos", width: int = WIDTH, values: int = 2) -> DataFrame:
    """(document, contact_name, contact_email, contact_phone) from the lines of contacts sections.

    Labelled values win; without one the first address, phone or free line of the section is taken.
    """
    keys = {"contact_name": 1, "contact_email": values, "contact_phone": values}
    known = _listed(section_values(section, tuple(keys), doc, pos, "value", width), doc, pos, tuple(keys))
    mail = lambda m: F.when((m != "") & ~m.isin(*vocab.IGNORED_EMAILS), m)
    phone = lambda p: F.when(T.is_likely_phone(p), p)
    first_mail = lambda v: mail(F.lower(F.regexp_extract(v, vocab.EMAIL_PATTERN, 0)))
    first_phone = lambda v: phone(T.phone(F.regexp_extract(v, vocab.ANY_PHONE_PATTERN, 0)))
    v = F.col("value")
    mails = _first_of(F.regexp_extract_all(v, F.lit(vocab.EMAIL_PATTERN), F.lit(0)), lambda m: mail(F.lower(m)))
    phones = _first_of(F.regexp_extract_all(v, F.lit(vocab.ANY_PHONE_PATTERN), F.lit(0)), lambda p: phone(T.phone(p)))
    free = F.when(~opens_with(label_form(v), ALL_ALIASES) & ~v.rlike(vocab.EMAIL_PATTERN) & ~v.rlike(vocab.ANY_PHONE_PATTERN), v)
    earliest = lambda x: F.min_by(x, F.when(x.isNotNull(), F.col(pos)))
    fallback = section.groupBy(doc).agg(earliest(free).alias("_fn"), earliest(mails).alias("_fe"), earliest(phones).alias("_fp"))
    head = lambda key: F.slice(F.coalesce(f"_{key}", F.array().cast("array<string>")), 1, keys[key])
    return fallback.join(known, doc, "left").select(
        doc,
        F.coalesce(F.try_element_at(head("contact_name"), F.lit(1)), "_fn").alias("contact_name"),
        F.coalesce(_first_of(head("contact_email"), first_mail), "_fe").alias("contact_email"),
        F.coalesce(_first_of(head("contact_phone"), first_phone), "_fp").alias("contact_phone"),
    )
