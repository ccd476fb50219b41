"""The company tables as a store that an import changes only where it has to.

Companies, prices and specialists lie in buckets by a hash of the company's domain in ASCII form, so
that all rows an import of a domain can change are in one bucket, under whatever form the domain is given.
An import reads the buckets of its domains, and writes them anew in one job: companies found or added,
children of imported companies gone, new children, and all other rows of those buckets as they were. The
commit of a small manifest makes it the current state; a run that is killed before leaves the old one.

Domains are never null in the store: rows without one are dropped on import.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefacts.functions import urls as U
from sitefacts.functions.joins import lookup_join
from sitefacts.operators import companies as C
from sitefacts.operators.urls import with_domain
from sitefacts.plans.import_flow import CONTACTS, imported_rows
from sitefacts.session import land
from sitefacts.sources.parts import PART, Manifest, PartStore

BUCKETS = 256
TABLES = {
    "companies": "domain string, source_url string, source_scope string, inn string, ogrn string, ogrnip string, phones string, emails string",
    "pricing": "domain string, source_url string, service string, price_raw string, currency string, price_min long, price_max long",
    "specialists": "domain string, source_url string, full_name string, role string, phone string, email string",
}
#: A stored row fills the column of its table; the others are null and take no room.
TYPES = {name: f"struct<{ddl.replace(', ', ',').replace(' ', ':')}>" for name, ddl in TABLES.items()}
SCHEMA = ", ".join(f"{name} {kind}" for name, kind in TYPES.items())
CHILDREN = ("pricing", "specialists")


def open_store(spark: SparkSession, root: str, buckets: int = BUCKETS) -> PartStore:
    """Bucket b of table number i is part b + i * buckets; ``buckets`` counts when the store is made."""
    return PartStore(spark, root, buckets * len(TABLES))


def with_bucket(rows: DataFrame, buckets: int, out: str = "_bucket") -> DataFrame:
    rows = with_domain(rows, "domain", "_d")
    form = F.when(F.col("_d") != "", U.encode_host(F.col("_d"))).otherwise(F.col("domain"))
    return rows.withColumn(out, F.pmod(F.xxhash64(form), F.lit(buckets)).cast("int")).drop("_d")


def stored_table(spark: SparkSession, root: str, name: str, state: Manifest | None = None, buckets: list[int] | None = None) -> DataFrame:
    """One table of the store, whole or of some buckets."""
    store = open_store(spark, root)
    state = state or store.current()
    n, i = state.n_parts // len(TABLES), list(TABLES).index(name)
    return store.read(SCHEMA, state, [b + i * n for b in (range(n) if buckets is None else buckets)]).select(f"{name}.*")


def _tagged(rows: DataFrame, name: str) -> DataFrame:
    fields = (f.split(" ") for f in TABLES[name].split(", "))
    own = F.struct(*[F.col(f).cast(kind).alias(f) for f, kind in fields])
    return rows.select("domain", F.lit(name).alias("_table"), *[(own if t == name else F.lit(None).cast(TYPES[t])).alias(t) for t in TABLES])


def import_to_store(spark: SparkSession, root: str, contacts: DataFrame, pricing: DataFrame, specialists: DataFrame, buckets: int = BUCKETS) -> tuple[Manifest, list[int]]:
    """Imports extracted site tables; gives the new state and the buckets that were written.

    Raises ``StoreConflict`` if another import has committed meanwhile: run it again.
    """
    store = open_store(spark, root, buckets)
    state = store.current()
    n = state.n_parts // len(TABLES)
    given, prices, people = imported_rows(*[t.where("domain IS NOT NULL") for t in (contacts, pricing, specialists)])
    incoming = land(with_bucket(given, n), "incoming")
    touched = sorted(r[0] for r in incoming.select("_bucket").distinct().collect())  # numbers of buckets
    old = {name: stored_table(spark, root, name, state, touched) for name in TABLES}
    # one row per imported domain: the name its company is stored under
    names = C.stored_names(old["companies"], incoming).withColumnRenamed("_given", "domain")
    names = land(incoming.select("domain").join(names, "domain", "left").select("domain", F.coalesce("_stored", "domain").alias("_stored")), "names")
    companies = C.upsert_companies(old["companies"], incoming.drop("_bucket"), CONTACTS)
    come = reduce(DataFrame.unionByName, [_tagged(t, name) for t, name in ((prices, "pricing"), (people, "specialists"))])
    come = lookup_join(come, names, ["domain"], "inner", landed=True)
    fields = [F.when(F.col(t).isNotNull(), F.col(t).withField("domain", F.col("_stored"))).alias(t) for t in CHILDREN]
    come = come.select(F.col("_stored").alias("domain"), "_table", "companies", *fields)
    stay = reduce(DataFrame.unionByName, [_tagged(old[name], name) for name in CHILDREN])
    stay = lookup_join(stay, names.select(F.col("_stored").alias("domain")).distinct(), ["domain"], "left_anti")
    rows = with_bucket(reduce(DataFrame.unionByName, [_tagged(companies, "companies"), stay, come]), n)
    number = reduce(lambda a, i: a.when(F.col("_table") == list(TABLES)[i], i), range(1, len(TABLES)), F.when(F.col("_table") == "companies", 0))
    made = store.replace(rows.select(*TABLES, (F.col("_bucket") + number * n).alias(PART)), state, [b + i * n for b in touched for i in range(len(TABLES))])
    return made, touched
