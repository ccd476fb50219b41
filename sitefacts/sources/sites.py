"""Tables kept by site, for any number of sites.

``write_per_site`` makes a directory per site, which any reader has to list. Here sites lie in parts by a
hash, sorted by site inside them; the hash names the part of a site and a manifest its folders, so neither
a write nor the reading of a site lists more than a few folders per part. A write replaces the rows of its
own sites and of no other: it appends them under its version, the newest version of a site stands, and
older rows go as folders are merged. A run that is killed leaves the state before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sitefacts.functions.joins import lookup_join
from sitefacts.sources.parts import PART, Manifest, PartStore

VERSION = "_written"
PARTS = 256


class SiteStore:
    """Rows of ``schema`` below ``root`` by the text column ``key``; rows without a site are a site of their own."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, key: str = "domain", n_parts: int = PARTS):
        self.spark, self.key, self.columns = spark, key, schema.fieldNames()
        self.schema = StructType([*schema.fields, StructField(VERSION, LongType())])
        self.store = PartStore(spark, root, n_parts)

    def _part(self, state: Manifest):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(state.n_parts)).cast("int").alias(PART)

    def _newest(self, rows: DataFrame) -> DataFrame:
        """The rows of each site's newest version; one row per site and task is shuffled to find it."""
        newest = rows.groupBy(self.key).agg(F.max(VERSION).alias("_newest"))
        return lookup_join(rows, newest, [self.key], "inner", null_safe=True).where(F.col(VERSION) == F.col("_newest")).drop("_newest")

    def write(self, rows: DataFrame) -> Manifest:
        """Replaces the rows of all sites in ``rows``, in one commit; a run that was overtaken gets a StoreConflict."""
        state = self.store.current()
        version = state.version + 1
        new = rows.select(*self.columns, F.lit(version).cast("long").alias(VERSION)).withColumn(PART, self._part(state))
        return self.store.append(new, state, version, self._newest, order=[self.key], replay=False)

    def read(self, state: Manifest | None = None) -> DataFrame:
        return self._newest(self.store.read(self.schema, state)).select(*self.columns)

    def read_sites(self, sites: Sequence[str | None]) -> DataFrame:
        """The rows of some sites, from their parts alone; Parquet skips the row groups of other sites."""
        state = self.store.current()
        asked = self.spark.createDataFrame([(s,) for s in sites], f"{self.key} string")
        parts = [r[0] for r in asked.select(self._part(state)).distinct().collect()]
        named = F.col(self.key).isin(*[s for s in sites if s is not None])
        here = (named | F.col(self.key).isNull()) if None in sites else named
        return self._newest(self.store.read(self.schema, state, parts).where(here)).select(*self.columns)

    def sites(self) -> DataFrame:
        """(site, rows, version of its last write): the index; reads two columns."""
        counted = self.store.read(self.schema).groupBy(self.key, VERSION).agg(F.count("*").alias("n"))
        last = F.max_by(F.struct("n", F.col(VERSION).alias("version")), VERSION).alias("_last")
        return counted.groupBy(self.key).agg(last).select(self.key, "_last.n", "_last.version")
