r"""Chat formatting with Spark expressions only, and the way back from the formatted string.

A conversation becomes blocks ``### role: text</turn>`` with a line feed after each. Adjacent turns of
one role share a block; ``<+>`` stands between their texts. In texts and roles, backslashes, ``###``,
``</turn>``, ``<+>`` and (in roles) colons are written as two-character codes, so that no text holds a
control string and every code can be read back.

Rules for odd input: turns sort by (turn, role, text), nulls first, so ties and repeated rows have one
order and all stay; a null role or text is empty; each row without a conv_id is a conversation of its
own; an empty table gives an empty result. Only the four named columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitefacts.functions.text import let

TURN_END, BLOCK_GAP, HEAD, JOIN = "</turn>", "\n", "### ", "<+>"
ESCAPES = (("\\", "\\b"), (TURN_END, "\\e"), ("###", "\\h"), (JOIN, "\\p"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
TRAINED_ROLE = "assistant"
#: Values that are summed, and spans that are cut, at a time.
STRETCH = 256


def escaped(text: Column, codes=ESCAPES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, codes=ESCAPES) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def prefix_sums(lengths: Column) -> Column:
    """array<bigint>: of each value the sum of those before it.

    An aggregate that grows an array copies it at each step, so sums run inside stretches of STRETCH
    values, and over the stretches: linear work for arrays of any practical size.
    """
    zero = F.array(F.lit(0).cast("bigint"))
    running = lambda values, of: F.aggregate(values, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + of(x))))
    stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / STRETCH).cast("int")), lambda i: running(F.slice(lengths, i * STRETCH + 1, F.lit(STRETCH)), lambda x: x))
    shifted = lambda inside, bases: F.flatten(F.transform(inside, lambda sums, i: F.transform(F.slice(sums, F.lit(1), F.size(sums) - 1), lambda v: v + F.get(bases, i))))
    whole = let(stretches, lambda inside: let(running(inside, lambda sums: F.element_at(sums, -1)), lambda bases: shifted(inside, bases)))
    return F.when(F.size(lengths) > 0, whole).otherwise(F.array().cast("array<bigint>"))


def pieces(turns: Column) -> Column:
    """One struct (lead, text, tail, trained, opens) per sorted turn; joined in order they are the formatted string.

    A turn that has its neighbour's role shares that block: it opens none, or does not end it.
    """

    def of_turn(t: Column, i: Column) -> Column:
        opens = (i == 0) | (F.get(turns, i - 1)["role"] != t["role"])
        ends = (i == F.size(turns) - 1) | (F.get(turns, i + 1)["role"] != t["role"])
        return F.struct(
            F.when(opens, F.concat(F.lit(HEAD), escaped(t["role"], ROLE_ESCAPES), F.lit(": "))).otherwise(F.lit(JOIN)).alias("lead"),
            escaped(t["text"]).alias("text"),
            F.when(ends, F.lit(TURN_END + BLOCK_GAP)).otherwise(F.lit("")).alias("tail"),
            (t["role"] == TRAINED_ROLE).alias("trained"),
            opens.alias("opens"),
        )

    return F.transform(turns, of_turn)


def loss_spans(parts: Column) -> Column:
    """array<struct<start, end>>: code-point ranges of the trained texts in the formatted string."""
    length = lambda p: (F.length(p["lead"]) + F.length(p["text"]) + F.length(p["tail"])).cast("bigint")
    span = lambda p, start: F.when(p["trained"], F.struct((start + F.length(p["lead"])).alias("start"), (start + F.length(p["lead"]) + F.length(p["text"])).alias("end")))
    return F.filter(F.zip_with(parts, prefix_sums(F.transform(parts, length)), span), lambda s: s.isNotNull())


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans, n_blocks) from rows (conv_id, turn, role, text)."""
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    own = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    grouped = rows.select("conv_id", own.alias("own"), turn.alias("t")).groupBy("conv_id", "own").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    parts = grouped.select("conv_id", pieces(F.col("turns")).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: F.concat(p["lead"], p["text"], p["tail"])), "")
    n_blocks = F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, p: n + p["opens"].cast("bigint"))
    return parts.select("conv_id", joined.alias("formatted"), loss_spans(F.col("parts")).alias("loss_spans"), n_blocks.alias("n_blocks"))


def parsed_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted string."""
    blocks = F.filter(F.split(formatted, TURN_END + BLOCK_GAP, -1), lambda b: F.startswith(b, F.lit(HEAD)))

    def turns(b: Column) -> Column:
        role = F.substring_index(b.substr(F.lit(len(HEAD) + 1), F.length(b)), ": ", 1)
        text = b.substr(F.length(role) + len(HEAD) + 3, F.length(b))
        return F.transform(F.split(text, "<\\+>", -1), lambda t: F.struct(unescaped(role, ROLE_ESCAPES).alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, in order and with its codes read back.

    A place in a string is found by counting characters from its start, so the string is cut once per
    STRETCH spans, and the spans are cut out of that part.
    """

    def of_stretch(own: Column) -> Column:
        start = F.get(own, F.lit(0))["start"]
        cut = formatted.substr((start + 1).cast("int"), (F.element_at(own, -1)["end"] - start).cast("int"))
        return let(cut, lambda part: F.array_join(F.transform(own, lambda s: unescaped(part.substr((s["start"] - start + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), ""))

    stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / STRETCH).cast("int")), lambda i: of_stretch(F.slice(spans, i * STRETCH + 1, F.lit(STRETCH))))
    return F.when(F.size(spans) > 0, F.array_join(stretches, "")).otherwise(F.lit(""))
