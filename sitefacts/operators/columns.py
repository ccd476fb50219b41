"""Text, number, date and JSON columns as table jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefacts import vocab
from sitefacts.functions import text as T
from sitefacts.session import land


def with_compact(df: DataFrame, col: str, out: str = "compact", variant: str = "plain") -> DataFrame:
    form = {"plain": T.compact, "markdown": T.plain_markdown, "match": T.match_text}[variant]
    return df.withColumn(out, form(T.text_of(col)))


def with_plain_text(df: DataFrame, html: str, out: str = "text", closed: bool = False) -> DataFrame:
    return df.withColumn(out, T.plain_text(F.col(html), closed))


def with_any_hint(df: DataFrame, col: str, words: Sequence[str], out: str = "has_hint") -> DataFrame:
    df = df.withColumn("_t", T.match_text(T.text_of(col)))
    return df.withColumn(out, T.contains_any(F.col("_t"), words)).drop("_t")


def with_phone(df: DataFrame, col: str, out: str = "phone") -> DataFrame:
    return df.withColumn(out, T.phone(T.text_of(col)))


def filter_likely_phone(df: DataFrame, col: str) -> DataFrame:
    return df.filter(T.is_likely_phone(F.col(col)))


def to_int(df: DataFrame, col: str, out: str = "int_value") -> DataFrame:
    return df.withColumn(out, T.to_int(F.col(col)))


def to_number(df: DataFrame, col: str, out: str = "number") -> DataFrame:
    return df.withColumn(out, T.to_number(F.col(col)))


def with_amount_currency(df: DataFrame, col: str, amount: str = "amount", currency: str = "currency") -> DataFrame:
    df = df.withColumn("_m", T.amount_currency(F.col(col)))
    return df.withColumns({amount: F.col("_m.amount"), currency: F.col("_m.currency")}).drop("_m")


def with_masked_flag(df: DataFrame, col: str, out: str = "is_masked") -> DataFrame:
    return df.withColumn(out, T.is_masked(F.col(col)))


VACANCY = """id string, name string, employer struct<name: string>,
    salary struct<`from`: double, `to`: double, currency: string, gross: boolean>,
    experience struct<name: string>, schedule struct<name: string>,
    key_skills array<struct<name: string>>, description string"""


def parse_vacancies(df: DataFrame, payload: str) -> DataFrame:
    """The payload column (JSON text) as a struct ``vacancy``."""
    return df.withColumn("vacancy", F.from_json(payload, VACANCY))


def vacancy_summary(df: DataFrame, rates: DataFrame | None = None, net_share: float = 0.87) -> DataFrame:
    """Research fields of a vacancy; a rate table is (currency, rate), one row per currency."""
    v, pay = F.col("vacancy"), F.col("vacancy.salary")
    if rates is not None:
        known = rates.select(F.col("currency").alias("_cur"), F.col("rate").cast("double").alias("_rate"))
        df = df.join(known, F.col("vacancy.salary.currency") == F.col("_cur"), "left")
    else:
        df = df.withColumn("_rate", F.lit(None).cast("double"))
    share = F.when(pay["gross"], F.lit(net_share)).otherwise(F.lit(1.0))
    rate = F.when(F.col("_rate") != 0, F.col("_rate"))

    def amount(side: str) -> Column:
        net = share * pay[side]
        # a cast to a whole number cuts towards zero, as wanted
        return F.coalesce(net / rate, net).try_cast("bigint")

    return df.select(
        T.text_of(v["id"]).alias("id"),
        T.text_of(v["name"]).alias("name"),
        T.text_of(v["employer"]["name"]).alias("employer"),
        pay.isNotNull().alias("has_salary"),
        amount("from").alias("salary_from"),
        amount("to").alias("salary_to"),
        T.text_of(v["experience"]["name"]).alias("experience"),
        T.text_of(v["schedule"]["name"]).alias("schedule"),
        F.transform(F.filter(F.coalesce(v["key_skills"], F.array()), lambda s: s.isNotNull()), lambda s: T.text_of(s["name"])).alias("key_skills"),
        T.plain_text(v["description"]).alias("description"),
    )


def vacancy_text(df: DataFrame) -> DataFrame:
    """Employer and the text of a vacancy: name and description, two line breaks between."""
    v = F.col("vacancy")
    name = T.empty_to_null(T.strip(T.text_of(v["name"])))
    body = T.empty_to_null(T.plain_text(v["description"]))
    return df.select(
        T.text_of(v["id"]).alias("id"),
        T.text_of(v["employer"]["name"]).alias("employer"),
        F.concat_ws("\n\n", name, body).alias("text"),
    )


def with_registry_code(df: DataFrame, raw: str, out: str = "code", pattern: str = vocab.REGISTRY_CODE_PATTERN) -> DataFrame:
    return df.withColumn(out, T.empty_to_null(F.regexp_extract(T.text_of(raw), "(?i)" + pattern, 1)))


def classify_owner(df: DataFrame, registrant: str = "registrant", org: str = "org", raw: str = "raw") -> DataFrame:
    """Adds owner_type, confidence, reason and matched: who stands behind a domain record.

    Privacy words anywhere win, then the organisation, then the registrant's name. Keywords are looked
    up inside words as well, in list order.
    """
    df = df.withColumns(
        {
            "_org": T.empty_to_null(T.strip(T.text_of(org))),
            "_reg": T.empty_to_null(T.strip(T.text_of(registrant))),
            "_all": F.lower(F.concat_ws(" ", T.empty_to_null(F.col(registrant)), T.empty_to_null(F.col(org)), T.empty_to_null(F.col(raw)))),
        }
    )
    df = df.withColumns(
        {
            "_privacy": T.first_contained(F.col("_all"), vocab.PRIVACY_WORDS),
            "_org_word": T.first_contained(F.lower("_org"), vocab.LEGAL_KEYWORDS),
            "_reg_word": T.first_contained(F.lower("_reg"), vocab.LEGAL_KEYWORDS),
        }
    )
    say = vocab.OWNER_REASONS
    quoted = lambda field, value: F.concat(F.lit(f"{field}='"), value, F.lit("'"))
    word = lambda base, w: F.concat(base, F.lit(" кл.слово='"), w, F.lit("'"))
    org_q, reg_q = quoted("org", F.col("_org")), quoted("registrant", F.col("_reg"))
    cases = (
        (F.col("_privacy").isNotNull(), "privacy", "high", say["privacy"], F.col("_privacy")),
        (F.col("_org_word").isNotNull(), "legal", "high", say["org_word"], word(org_q, F.col("_org_word"))),
        (F.col("_org").isNotNull(), "legal", "medium", say["org"], org_q),
        (F.col("_reg_word").isNotNull(), "legal", "high", say["name_word"], word(reg_q, F.col("_reg_word"))),
        (F.col("_reg").rlike(vocab.PERSON_NAME), "person", "high", say["name_person"], reg_q),
        (F.col("_reg").isNotNull(), "person", "low", say["name"], reg_q),
        (F.lit(True), "unknown", "low", say["none"], F.lit(None).cast("string")),
    )
    verdict = None
    for condition, kind, confidence, reason, matched in cases:
        row = F.struct(
            F.lit(kind).alias("owner_type"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"), matched.alias("matched")
        )
        verdict = F.when(condition, row) if verdict is None else verdict.when(condition, row)
    df = df.withColumn("_verdict", verdict)
    return df.select("*", "_verdict.*").drop("_org", "_reg", "_all", "_privacy", "_org_word", "_reg_word", "_verdict")


def owner_report(df: DataFrame, name_servers: int | None = 4) -> DataFrame:
    """Report rows of classified owners: labels, dates as text, distinct addresses, the first name servers (None: all)."""
    labels = F.create_map(*[F.lit(x) for pair in vocab.OWNER_LABELS for x in pair])
    day = lambda c: F.coalesce(F.substring(F.col(c).cast("string"), 1, 10), F.lit("—"))
    filled = lambda c: F.filter(F.coalesce(F.col(c), F.array()), lambda v: v.isNotNull() & (v != ""))
    servers = F.array_sort(F.array_distinct(F.transform(filled("name_servers"), F.lower)))
    servers = servers if name_servers is None else F.slice(servers, 1, name_servers)
    return df.select(
        "domain",
        T.text_of("error").alias("error"),
        "owner_type",
        labels[F.col("owner_type")].alias("owner_label"),
        "confidence",
        T.text_of("registrant").alias("registrant"),
        T.text_of("org").alias("org"),
        T.text_of("code").alias("code"),
        T.text_of("registrar").alias("registrar"),
        day("creation_date").alias("creation_date"),
        day("expiration_date").alias("expiration_date"),
        F.array_join(F.array_sort(F.array_distinct(filled("emails"))), "; ").alias("emails"),
        F.array_join(servers, "; ").alias("name_servers"),
    )


def smtp_class(code: Column) -> Column:
    """Class of a reply code; no code means the network failed."""
    return (
        F.when(code.isNull(), F.lit("network_error"))
        .when(code.between(200, 299), F.lit("accepted"))
        .when(code.between(500, 599), F.lit("rejected"))
        .when(code.between(400, 499), F.lit("temporary_failure"))
        .otherwise(F.lit("unknown"))
    )


def with_smtp_class(df: DataFrame, code: str, out: str = "rcpt_status") -> DataFrame:
    return df.withColumn(out, smtp_class(F.col(code)))


def filter_email_syntax(df: DataFrame, col: str, pattern: str = vocab.CHECKED_EMAIL) -> DataFrame:
    return df.filter(T.strip(T.text_of(col)).rlike(pattern))


def _distinct_by_lower(values: Column) -> Column:
    return T.let(
        values,
        lambda all_: T.let(
            F.transform(all_, F.lower),
            lambda lowered: F.filter(all_, lambda v, i: (v != "") & (F.array_position(lowered, F.lower(v)) == i + 1)),
        ),
    )


def _variant_text(v: Column) -> Column:
    return T.compact(T.text_of(F.try_variant_get(v, "$", "string")))


def _named_text(item: Column) -> Column:
    """Text of a list item; of an object its name, else its value, else its metric value, if that is text."""

    def text(found: Column) -> Column:
        return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(found, "$", "string"))

    # one cast finds all three; a path that leads nowhere costs an exception in Spark
    named = F.try_variant_get(item, "$", "struct<name: variant, value: variant, metric_value: variant>")
    return T.let(
        named,
        lambda o: F.when(o.isNotNull(), T.compact(T.text_of(F.coalesce(*[text(o[n]) for n in ("name", "value", "metric_value")])))).otherwise(
            _variant_text(item)
        ),
    )


def variant_texts(v: Column, depth: int = 1) -> Column:
    """Texts of a JSON value: list items by name, value or metric_value, a nested value once deeper."""

    def of(value: Column) -> Column:
        def of_inner(inner: Column) -> Column:
            nested = variant_texts(inner, depth - 1) if depth else plain(inner)
            return F.when(inner.isNotNull(), nested).otherwise(plain(value))

        return T.let(
            F.try_variant_get(value, "$", "array<variant>"),
            lambda items: F.when(items.isNotNull(), _distinct_by_lower(F.transform(items, _named_text))).otherwise(
                T.let(F.try_variant_get(value, "$", "struct<value: variant>")["value"], of_inner)
            ),
        )

    plain = lambda value: F.filter(F.array(_variant_text(value)), lambda t: t != "")
    return F.when(v.isNull(), F.array().cast("array<string>")).when(F.schema_of_variant(v) == "STRING", plain(v)).otherwise(T.let(v, of))


def value_to_text_list(df: DataFrame, json_col: str, out: str = "texts") -> DataFrame:
    df = df.withColumn("_v", F.try_parse_json(json_col))
    return df.withColumn(out, variant_texts(F.col("_v"))).drop("_v")


FORMS = "forms array<struct<form: array<struct<fields: array<struct<sysName: string, value: variant>>>>>>, fullName string"


def _form_fields(doc: Column, wanted: Sequence[str]) -> Column:
    """array<struct<name, value>> of all fields of a document, in order."""
    lists = F.transform(F.coalesce(doc["forms"], F.array()), lambda f: F.transform(F.coalesce(f["form"], F.array()), lambda m: F.coalesce(m["fields"], F.array())))
    plain = lambda n: F.when(n.isin(*wanted), n).otherwise(T.compact(T.text_of(n)))
    return F.transform(F.flatten(F.flatten(lists)), lambda f: F.struct(plain(f["sysName"]).alias("name"), f["value"].alias("value")))


def _first_values(fields: Column, wanted: Sequence[str]) -> Column:
    """The first value of each name."""
    pick = lambda name: F.try_element_at(F.filter(fields, lambda f: f["name"] == name), F.lit(1))["value"]
    return F.array(*[pick(n) for n in wanted])


def pivot_form_fields(df: DataFrame, json_col: str) -> DataFrame:
    """Profile columns from nested forms; the first field of a name wins.

    A payload is one row, so its fields are flattened inside the row and nothing is shuffled.
    """
    wanted = {
        "_description": "project_note", "_industries": "project_industry", "_technologies": "project_technology",
        "_website": "questionnaire_site", "_tin": "questionnaire_inn", "_country": "questionnaire_registrationCountry",
        "_legal": "questionnaire_fullName", "_name": "questionnaire_inviteFio", "_email": "questionnaire_email",
        "_phone": "questionnaire_phoneNumber", "_revenue": "questionnaire_metricRevenue",
    }
    names = list(wanted.values())
    df = df.withColumn("_doc", F.from_json(json_col, FORMS))
    df = df.withColumn("_fields", _form_fields(F.col("_doc"), names)).withColumn("_values", _first_values(F.col("_fields"), names))
    df = df.withColumn("_texts", F.transform("_values", lambda v: variant_texts(v)))
    df = df.withColumns({k: F.element_at("_texts", i + 1) for i, k in enumerate(wanted)})
    one = lambda k: F.coalesce(F.try_element_at(F.col(k), F.lit(1)), F.lit(""))
    df = df.withColumns({"_mail1": F.lower(one("_email")), "_phone1": T.phone(one("_phone")), "_name1": one("_name")})
    # an amount never runs over the sign between two texts, so the first one of all texts is that of the first text with one
    df = df.withColumns({"_money": T.amount_currency(F.array_join("_revenue", "\0")), "_digits1": T.digits(F.col("_phone1"))})
    hidden = F.col("_mail1").isin(*vocab.IGNORED_EMAILS) | T.is_masked(F.col("_mail1"))
    shown = T.is_phone_of(F.col("_phone1"), F.col("_digits1")) & ~T.is_masked(F.col("_phone1"))
    out = {
        "tin": T.tax_id(one("_tin")),
        "country": one("_country"),
        "legal_entity_name": F.coalesce(T.empty_to_null(one("_legal")), T.compact(T.text_of("_doc.fullName"))),
        "industries": F.col("_industries"),
        "technologies": F.col("_technologies"),
        "description": one("_description"),
        "website": one("_website"),
        "revenue_amount": T.text_of("_money.amount"),
        "revenue_currency": T.text_of("_money.currency"),
        "contact_name": F.when(T.is_masked(F.col("_name1")), F.lit("")).otherwise(F.col("_name1")),
        "contact_email": F.when(hidden, F.lit("")).otherwise(F.col("_mail1")),
        "contact_phone": F.when(shown, F.col("_phone1")).otherwise(F.lit("")),
    }
    return df.withColumns(out).drop("_doc", "_fields", "_values", "_mail1", "_phone1", "_digits1", "_name1", "_money", "_texts", *wanted)


#: a string that starts like a list or an object somewhere in a JSON text
BRACKET_TEXT = r"""["'](?:[\[{]|\\u00[57][bB])"""
#: the text of a JSON number or truth value
BARE_TEXT = r"^(?:-?[0-9]+(?:\.[0-9]+)?(?:[eE][+\-]?[0-9]+)?|true|false|[+\-]?(?:NaN|INF|Infinity))$"


def _opened(level: DataFrame, key: str) -> DataFrame:
    """The members of the containers of a level, by kind; texts stay as they are, other values go.

    What a member is shows in its text, unless a string looks like a container, a number or a truth
    value; only a container with such a member is read a second time, with typed values.
    """
    none, is_object = F.lit(None).cast("string"), F.col("kind") == "object"
    texts = F.when(is_object, F.from_json("value", "map<string,string>"))
    items = T.let(F.from_json("value", "array<string>"), lambda all_: F.transform(all_, lambda v: F.struct(none.alias("key"), v.alias("value"))))
    members = F.when(F.col("kind") != "text", F.when(is_object, F.map_entries(texts)).otherwise(items))
    level = level.withColumn("_members", members)
    brackets = F.col("value").rlike(BRACKET_TEXT)
    unsure = F.exists("_members", lambda m: F.coalesce(m["value"].rlike(BARE_TEXT), F.lit(False)))
    typed = F.when(is_object, F.map_values(F.from_json("value", "map<string,variant>"))).otherwise(F.from_json("value", "array<variant>"))
    level = level.withColumn("_typed", F.when((F.col("kind") != "text") & (brackets | unsure), typed))

    level = level.withColumn("_typed", F.coalesce("_typed", F.array().cast("array<variant>")))
    itself = F.array(F.struct(F.col("key").alias("key"), F.col("value").alias("value")))
    members = F.when(F.col("kind") == "text", itself).otherwise(F.col("_members"))
    rows = level.select(key, "seq", "owner", F.col("kind").alias("_of"), F.posexplode(F.arrays_zip(members.alias("m"), F.col("_typed").alias("t"))).alias("_i", "_m"))
    rows = rows.select(key, "seq", "owner", "_of", "_i", F.col("_m.m.key").alias("key"), F.col("_m.m.value").alias("value"), F.col("_m.t").alias("_t"))
    start, stays = F.substr("value", F.lit(1), F.lit(1)), F.col("_of") == "text"
    checked = (
        F.when(~start.isin("{", "["), F.when(F.schema_of_variant("_t") == "STRING", F.lit("text")))
        .when(F.try_variant_get("_t", "$", "map<string,variant>").isNotNull(), F.lit("object"))
        .when(F.try_variant_get("_t", "$", "array<variant>").isNotNull(), F.lit("list"))
        .otherwise(F.lit("text"))
    )
    kind = (
        F.when(F.col("value").isNull(), none)
        .when(stays, F.lit("text"))
        .when(F.col("_t").isNotNull(), checked)
        .when(start == "{", F.lit("object"))
        .when(start == "[", F.lit("list"))
        .otherwise(F.lit("text"))
    )
    return rows.select(
        key,
        F.when(stays, F.col("seq")).otherwise(F.concat("seq", F.array("_i"))).alias("seq"),
        F.when(stays, F.col("owner")).when(F.col("_of") == "object", F.col("seq")).alias("owner"),
        "key", "value", kind.alias("kind"),
    ).where("kind IS NOT NULL")


def json_nodes(df: DataFrame, key: str, json_col: str, levels: int = 5) -> DataFrame:
    """One row per string value in a JSON payload: its path (``seq``, places in reading order, so that
    paths sort like the text), the path of the object that holds it (``owner``, NULL inside a plain list)
    and its field name.

    Lists and objects are opened level by level, however deep; ``levels`` of them make one landed job, over
    the containers that the one before has left. Containers travel as text, which keeps the order of fields.
    Texts that are no JSON, or that repeat a field of an object, have no nodes.
    """
    whole = F.when(F.try_parse_json(json_col).isNotNull(), F.concat(F.lit("["), F.col(json_col), F.lit("]")))
    none = F.lit(None)
    level = df.select(
        key, F.array().cast("array<int>").alias("seq"), none.cast("array<int>").alias("owner"), none.cast("string").alias("key"), whole.alias("value"), F.lit("list").alias("kind")
    ).where("value IS NOT NULL")
    found = None
    while True:
        for _ in range(levels):
            level = _opened(level, key)
        opened = land(level, "json-level")
        texts_here = opened.where("kind = 'text'").select(key, "seq", "owner", "key", "value")
        found = texts_here if found is None else found.unionByName(texts_here)
        level = opened.where("kind <> 'text'")
        if level.isEmpty():
            return found


def discover_entities(df: DataFrame, key: str, json_col: str, base: str, path: str = "/main/startups/", label: str = "startup") -> DataFrame:
    """Entity pages named anywhere in a payload: (key, rank, url, name).

    The first non-empty name per URL is kept; a URL without one is called ``{label}_{rank}``.
    """
    names = ("name", "title", "startupName", "projectName", "companyName", "shortName")
    links = ("href", "url", "link", "path", "publicUrl")
    ids = ("id", "uuid", "startupId", "questionnaireId", "entityId", "profileId")
    nodes = json_nodes(df, key, json_col)
    rank_of = lambda words: F.coalesce(*[F.when(F.col("key") == w, F.lit(i)) for i, w in enumerate(words, 1)])
    text = T.compact(T.text_of("value"))
    uuid = F.regexp_extract("value", f"\\b{vocab.UUID_PATTERN}\\b", 0)
    absolute = F.when(F.col("value").rlike("^https?://"), F.col("value")).when(
        F.col("value").startswith("/"), F.concat(F.lit(base), F.col("value"))
    )
    owned = F.col("owner").isNotNull()
    nodes = nodes.withColumns(
        {
            "_rank": F.when(owned, rank_of(names)),
            "_field": F.when(owned, rank_of(links + ids)),
            "_is_id": owned & F.coalesce(F.col("key").isin(*ids), F.lit(False)),
            "_uuid": uuid,
            "_whole": absolute,
        }
    )
    nodes = nodes.withColumns(
        {
            "_text": F.when(F.col("_rank").isNotNull(), T.empty_to_null(text)),
            "_by_link": F.when(~F.col("_is_id") & F.contains("_whole", F.lit(path)), F.regexp_extract("_whole", "^([^?#]*)", 1)),
            "_by_id": F.when(F.col("_uuid") != "", F.concat(F.lit(f"{base}{path}"), F.col("_uuid"))),
        }
    )
    named, step = F.col("_field").isNotNull(), F.coalesce(F.col("_field") * 2, F.lit(0))

    def entity(url: str, late: int) -> Column:
        at = F.when(named, F.col("owner")).otherwise(F.col("seq"))
        return F.when(F.col(url).isNotNull(), F.struct(at.alias("at"), (step + late).alias("step"), F.col(url).alias("url"), named.alias("named")))

    # all that follows stays with its payload, so the nodes that matter are shuffled once, by key
    nodes = nodes.where("_text IS NOT NULL OR _by_link IS NOT NULL OR _by_id IS NOT NULL")
    nodes = nodes.select(key, "owner", "_text", F.when(F.col("_text").isNotNull(), F.col("_rank")).alias("_rank"), entity("_by_link", 0).alias("_link"), entity("_by_id", 1).alias("_id")).repartition(F.col(key))
    owners = nodes.groupBy(key, "owner").agg(F.min_by("_text", "_rank").alias("_name"), F.concat(F.collect_list("_link"), F.collect_list("_id")).alias("_tries"))
    found = (
        owners.select(key, "_name", F.explode("_tries").alias("_t"))
        .select(key, F.struct("_t.at", "_t.step").alias("_at"), "_t.url", F.when(F.col("_t.named"), F.col("_name")).alias("_name"))
        .groupBy(key, "url")
        .agg(F.min("_at").alias("_at"), F.min_by("_name", F.when(F.col("_name").isNotNull(), F.col("_at"))).alias("name"))
    )
    # the answer of one payload is one cell of modest size, so it is ranked inside that cell
    ranked = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", "url", "name"))).alias("_all"))
    return ranked.select(key, F.posexplode("_all").alias("_i", "_e")).select(
        key, (F.col("_i") + 1).alias("rank"), F.col("_e.url").alias("url"),
        F.coalesce(F.col("_e.name"), F.concat(F.lit(f"{label}_"), F.col("_i") + 1)).alias("name"),
    )
