"""From raw documents to token ids: quality rules, line dedup, near-dedup, decontamination, BPE.

Each stage works on what the one before has kept, written as Parquet and read again. All but the last
return the columns of their input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitefacts.llm.bpe import encode_documents
from sitefacts.llm.common import land, table
from sitefacts.llm.decontaminate import row_hits
from sitefacts.llm.line_dedup import drop_repeated_lines, text_tag
from sitefacts.llm.near_dedup import near_duplicates
from sitefacts.llm.quality_rules import judge_quality

VOCABULARY = "byte_bpe_50k.json"
#: Least similarity of near-duplicates in percent; the 85 of op5_near_dedup is of that query only.
NEAR_PERCENT = 80


def as_row(docs: DataFrame) -> Column:
    """All columns as one, so that no name of a stage's own can meet one of theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return judge_quality(docs).where("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a smaller document holds; n_chars follows the text."""
    done = drop_repeated_lines(docs)
    changed = F.col("n_dropped") > 0
    own = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("row.text")), "n_chars": F.when(changed, F.length("kept_text")).otherwise(F.col("row.n_chars")).cast("long")}
    return done.select(*[own[c].alias(c) if c in own else F.col(f"row.`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near-duplicates, once; rows without a doc_id stay."""
    kept = near_duplicates(docs, NEAR_PERCENT).where("kept").select(F.col("doc_id").alias("kept_id"))
    known, unknown = docs.where("doc_id IS NOT NULL"), docs.where("doc_id IS NULL")
    rows = known.select(as_row(known)).join(kept, F.col("row.doc_id") == F.col("kept_id"), "left_semi")
    once = rows.withColumn("n", F.row_number().over(Window.partitionBy("row.doc_id").orderBy("row.text"))).where("n = 1")
    return once.select("row.*").unionByName(unknown)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows without a doc_id are told apart by their texts."""
    key = lambda doc_id, tag: (F.coalesce(doc_id.cast("long"), tag), doc_id.isNull())
    hit_key, hit_unnamed = key(F.col("doc_id"), F.col("tag"))
    hits = row_hits(docs, table(spark, sf_dir, "benchmark")).select(hit_key.alias("hit_key"), hit_unnamed.alias("hit_unnamed")).distinct()
    own_key, own_unnamed = key(F.col("row.doc_id"), text_tag("row.text"))
    return docs.select(as_row(docs)).join(hits, (own_key == F.col("hit_key")) & (own_unnamed == F.col("hit_unnamed")), "left_anti").select("row.*")


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text): each document's ids and the text that they decode to."""
    made = encode_documents(docs, public_tokenizers.path(VOCABULARY), decode=True)
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("bpe", bpe)]
#: Distribution divergence, tiling and BPE are beyond SQL; ``tests/llm`` holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = land(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
