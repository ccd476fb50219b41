"""Mixing sources to target weights by nested hash thresholds.

Each source gets a target number of words: all words are shared by weight, and a source that would have
to repeat its documents more than MOST times stops there, its excess reshared by weight. A document's hash
places it in a fixed order. A target that is R times the source's size and a bit takes every document R
times, and once more those whose hash lies below the source's threshold; a larger budget has a larger
threshold, so what a smaller budget takes is among what a larger one takes.

Thresholds come from histograms: words are summed by source and the hash's leading DIGIT_BITS bits, running
sums over the buckets find the one in which the budget ends, and only the rows of that bucket are counted
again by the next bits, until one hash value remains. It is taken if that brings the sum nearer to the
budget. Rows are then filtered by their hash; they are never sorted.

Rules for odd input: a null or empty text has size 0; a null source is a source of its own, last in order;
the hash is of doc_id and text, so that rows of one doc_id differ by their texts, and fully equal rows are
taken alike. Sources without words have target 0. An empty table gives an empty result. Extra columns are
not read by ``mixed``, and kept in ``row`` by ``drawn_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitefacts.functions.joins import lookup_join
from sitefacts.llm.common import land, places

WEIGHTS = (1, 2, 3)
MOST = 3
HASH_BITS, DIGIT_BITS = 60, 10
#: Sources whose plan rows (some 100 bytes each) may be broadcast; beyond it rows and plan are joined by shuffle.
BROADCAST_SOURCES = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def measured(doc_id: Column, source: Column, text: Column) -> list[Column]:
    """``grp`` (the source, nulls last), ``size`` in words, and ``h``, the hash of HASH_BITS bits."""
    told = F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text.cast("string"), F.lit("")))
    return [
        F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(">")).alias("grp"),
        F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(told), 1, HASH_BITS // 4), 16, 10).cast("long").alias("h"),
    ]


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(grp, source_size, target): landed. The driver sees three sums a round, and a round caps one source at least."""
    sums = land(sized.groupBy("grp").agg(F.sum("size").alias("source_size")), "source-sizes")
    listed = F.array(*[F.lit(w) for w in weights])
    ranked = land(places(sums.withColumn("all", F.lit(0)), "all", ["grp"], "ranked-sources").select("grp", "source_size", F.element_at(listed, (F.col("pos") % len(weights) + 1).cast("int")).alias("weight")), "weights")
    level, n_capped = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) > most * F.col("source_size")
        said = ranked.agg(
            F.sum("source_size").alias("total"), F.count_if(above).alias("n"),
            F.sum(F.when(above, most * F.col("source_size")).otherwise(0)).alias("stopped"), F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if said.n == n_capped or not said.weight:
            level = level or 0.0
            above = F.col("weight") * F.lit(level) > most * F.col("source_size")
            return ranked.select("grp", "source_size", F.when(above, (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.lit(level)).alias("target"))
        n_capped, level = said.n, (said.total - said.stopped) / said.weight


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(grp, threshold) of each source with words: the sizes of hashes below come as near to ``budget`` as they can."""
    at = Window.partitionBy("grp").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    found, prefixes, rows = None, None, sized
    for used in range(DIGIT_BITS, HASH_BITS + 1, DIGIT_BITS):
        digit = F.shiftright("h", HASH_BITS - used).alias("digit")
        counts = rows.groupBy("grp", digit).agg(F.sum("size").alias("inside"), F.min("h").alias("least"), F.max("h").alias("greatest"))
        # one row per source so far: its budget, and what lies below the buckets at hand
        so_far = budgets.withColumn("base", F.lit(0).cast("long")) if prefixes is None else prefixes.select("grp", "budget", F.col("below").alias("base"))
        cells = counts.join(so_far, "grp").withColumn("below", F.col("base") + F.coalesce(F.sum("inside").over(at), F.lit(0)))
        ending = cells.where((F.col("below") <= F.col("budget")) & (F.col("budget") < F.col("below") + F.col("inside")))
        ending = land(ending.select("grp", "budget", "digit", "below", "inside", "least", "greatest"), f"bucket-{used}")
        nearer = 2 * F.col("budget") > 2 * F.col("below") + F.col("inside")
        settled = ending.where("least = greatest").select("grp", (F.col("least") + nearer.cast("long")).alias("threshold"))
        found = settled if found is None else found.unionByName(settled)
        prefixes = ending.where("least < greatest")
        if prefixes.isEmpty():
            break
        # the boundary buckets of all sources: a thousandth of the rows; a hot source spreads by its digits
        rows = land(rows.withColumn("digit", F.shiftright("h", HASH_BITS - used)).join(prefixes.select("grp", "digit"), ["grp", "digit"], "left_semi").select("grp", "size", "h"), f"boundary-{used}")
    return found


def mix_plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(grp, source_size, target, rounds, threshold), one row per source: take all ``rounds`` times, hashes below ``threshold`` once more."""
    shared = targets(sized, weights, most)
    size = F.col("source_size")
    rounds = F.when(size > 0, F.least(F.lit(most), F.floor(F.col("target") / size))).otherwise(0).cast("long")
    budgets = land(shared.withColumn("rounds", rounds).withColumn("budget", F.col("target") - F.col("rounds") * size), "budgets")
    above = thresholds(sized, budgets.where("source_size > 0").select("grp", "budget"))
    return land(budgets.join(above, "grp", "left").select("grp", "source_size", "target", "rounds", F.coalesce("threshold", F.lit(0)).alias("threshold")), "mix-plan")


def with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (grp, size, h, ...) with their source's plan and ``copies``; broadcast only a plan of counted size."""
    joined = rows.join(F.broadcast(plan), "grp") if plan.count() <= BROADCAST_SOURCES else lookup_join(rows, plan, ["grp"], "inner", strategy="shuffle_hash")
    return joined.withColumn("copies", F.col("rounds") + (F.col("h") < F.col("threshold")).cast("long"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for each row of ``docs``."""
    sized = land(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *measured(F.col("doc_id"), F.col("source"), F.col("text"))), "sizes")
    done = with_plan(sized, mix_plan(sized.select("grp", "size", "h"), weights, most))
    return done.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def drawn_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: each taken row as a struct ``row``, once per copy, with the copy's number from 1 on."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    named = rows.select("row", *measured(F.col("row.doc_id"), F.col("row.source"), F.col("row.text")))
    plan = mix_plan(land(named.select("grp", "size", "h"), "sizes"), weights, most)
    return with_plan(named, plan).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
