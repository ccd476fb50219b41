"""Stores in parts: commits, replays, merged folders, imports that touch few buckets; lookup joins with a hot key."""

from statistics import median

import pytest
from pyspark.sql import functions as F

from sitefacts.functions.joins import lookup_join
from sitefacts.operators import companies as C
from sitefacts.operators.cells import cell_parts, numbered_values
from sitefacts.plans import company_store as CS
from sitefacts.plans import import_flow
from sitefacts.session import work_path
from sitefacts.sources.parts import PART, Manifest, PartStore, StoreConflict
from sitefacts.sources.sites import SiteStore
from sitefacts.streaming import jobs as J

KIND = "id long"


def rows(spark, ids, n=4):
    return spark.createDataFrame([(i,) for i in ids], KIND).withColumn(PART, (F.col("id") % n).cast("int")).coalesce(1)


def ids_of(store, state=None):
    return sorted(r["id"] for r in store.read(KIND, state).collect())


def test_folders_are_merged_by_level(spark):
    store, root = None, work_path(spark, "store")
    for version in range(30):
        store = PartStore(spark, root, 4, most=3, keep=4)
        made = store.append(rows(spark, range(8 * version, 8 * version + 8)), store.current(), version)
        # two folders a level at most, and no more levels than the logarithm of the commits
        assert all(len(f) <= 2 * 4 for f in made.parts.values())
    assert ids_of(store) == list(range(240))
    assert len(store.versions()) == 4
    on_disk = store.fs.globStatus(store.path(f"data/*/{PART}=*"))
    named = {f for v in store.versions() for f in store.load(v).folders()}
    assert len(on_disk) == len(named)  # nothing that no manifest names


def test_a_version_can_be_replayed_but_not_taken_twice(spark):
    store = PartStore(spark, work_path(spark, "store"), 4)
    first = store.append(rows(spark, range(5)), store.current(before=0), 0)
    for _ in range(2):
        store.append(rows(spark, range(5, 9)), store.current(before=1), 1)
        assert ids_of(store) == list(range(9))
    store.replace(rows(spark, [100]), store.load(1), range(4))
    with pytest.raises(StoreConflict):
        store.replace(rows(spark, [200]), store.load(1), range(4))
    assert ids_of(store) == [100] and ids_of(store, first) == list(range(5))
    assert PartStore(spark, work_path(spark, "none"), 4).current() == Manifest(-1, 4)


def test_folded_counts_and_late_rows(spark):
    target = work_path(spark, "status")
    source, check = work_path(spark, "log"), work_path(spark, "check")
    # each file has rows of the same three days, so all but the first are late
    log = spark.sql("SELECT timestamp'2024-01-01 10:00:00' + make_dt_interval(cast(id % 3 AS int)) AS t, 'fetch' AS stage, if(id < 3, 'ok', 'bad') AS status FROM range(6)").coalesce(1)
    for _ in range(10):
        log.write.mode("append").parquet(source)
    schema = spark.read.parquet(source).schema
    J.stream_status(J.file_stream(spark, source, schema, 1), target, "t", "stage", "status", check).awaitTermination()
    got = {(str(r["window_start"])[:10], r["status"]): r["n"] for r in J.current_status(spark, target).collect()}
    assert got == {(f"2024-01-{1 + d:02}", s): 10 for d in range(3) for s in ("ok", "bad")}
    store = PartStore(spark, target)
    assert all(len(f) < 8 for f in store.current().parts.values()) and any(level for f in store.current().parts.values() for _, level in f)


def test_pending_sees_results_of_any_time(spark):
    results, target = work_path(spark, "results"), work_path(spark, "pending")
    source, check = work_path(spark, "inputs"), work_path(spark, "check")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    run = lambda: J.stream_pending(J.file_stream(spark, source, keys("a").schema), results, "key", target, check).awaitTermination()
    keys("A ", "b", None).coalesce(1).write.mode("append").parquet(source)
    run()  # no results yet
    assert sorted(map(str, (r["key"] for r in spark.read.parquet(target).collect()))) == ["A ", "None", "b"]
    for k in (" C", "d", "d"):
        J.store_results(keys(k, None), "key", results, n_parts=8)
    keys("c", "D ", "e").coalesce(1).write.mode("append").parquet(source)
    run()
    assert sorted(r["key"] for r in spark.read.parquet(f"{target}/batch_id=1").collect()) == ["e"]


CONTACTS = "domain string, pos int, source_url string, source_scope string, inn string, ogrn string, ogrnip string, phones string, emails string"
PRICING = "domain string, source_url string, service string, price_raw string, currency string, price_min string, price_max string"
PEOPLE = "domain string, source_url string, full_name string, role string, phone string, email string"


def tables_in(spark, contacts=(), pricing=(), people=()):
    return (
        spark.createDataFrame([(d, 1, "u", "", "", "", "", phone, "") for d, phone in contacts], CONTACTS),
        spark.createDataFrame([(d, "u", service, "", "", price, "") for d, service, price in pricing], PRICING),
        spark.createDataFrame([(d, "u", person, "", "", "") for d, person in people], PEOPLE),
    )


def read(spark, root):
    return {t: sorted(map(tuple, CS.stored_table(spark, root, t).collect()), key=repr) for t in CS.TABLES}


def test_import_rewrites_only_its_buckets(spark, monkeypatch):
    root = work_path(spark, "companies")
    names = [f"s{i}.ru" for i in range(60)] + ["клиника.рф", None]
    first = tables_in(spark, [(d, "1") for d in names], [(d, "old", "5") for d in names] + [("s1.ru", "x", "6")], [(d, "P") for d in names])
    _, touched = CS.import_to_store(spark, root, *first, buckets=32)
    assert len(touched) > 20
    before = CS.open_store(spark, root).current()
    plain = {t: spark.createDataFrame(rows, CS.TABLES[t]) for t, rows in read(spark, root).items()}
    assert plain["companies"].count() == 61

    # one domain: its bucket alone gets new folders, and the rows are those of the plain operators
    second = tables_in(spark, [], [("s1.ru", "new", "7")])
    want = {t: sorted(map(tuple, df.collect()), key=repr) for t, df in import_flow.import_tables(plain, *second).items()}
    made, touched = CS.import_to_store(spark, root, *second)
    assert len(touched) == 1 and {p % 32 for p in made.parts if made.parts[p] != before.parts.get(p)} == set(touched)
    assert read(spark, root) == want

    # the ASCII form finds the company, its children go, and the name stays
    ascii_form = "клиника.рф".encode("idna").decode()
    CS.import_to_store(spark, root, *tables_in(spark, [(ascii_form, "2")], [(ascii_form, "idn", "9")]))
    got = read(spark, root)
    assert [r[6] for r in got["companies"] if r[0] == "клиника.рф"] == ["2"] and len(got["companies"]) == 61
    assert [(r[0], r[2], r[5]) for r in got["pricing"] if "рф" in r[0] or "xn--" in r[0]] == [("клиника.рф", "idn", 9)]
    assert not [r for r in got["specialists"] if r[0] in ("клиника.рф", "s1.ru")] and len(got["specialists"]) == 59

    # a run that is killed before its commit leaves the old state
    def killed(self, made, replay=False):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(PartStore, "commit", killed)
        with pytest.raises(KeyboardInterrupt):
            CS.import_to_store(spark, root, *tables_in(spark, [("s2.ru", "lost")], [("s2.ru", "lost", "1")]))
    assert read(spark, root) == got


HOT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "24",
}


@pytest.fixture
def hot(spark):
    before = {k: spark.conf.get(k, None) for k in HOT}
    for k, v in HOT.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def shares(df):
    """Rows of each task that has any, of the last stage."""
    # all columns are read, since Spark splits by bytes
    tasks = df.withColumns({"_all": F.xxhash64(*df.columns), "_task": F.spark_partition_id()}).groupBy("_task").agg(F.count("*").alias("n"), F.max("_all"))
    counts = sorted(r["n"] for r in tasks.collect())
    return counts[-1], median(counts), sum(counts)


def test_a_hot_key_spreads_over_tasks(spark, hot):
    n = 60_000
    text = "if(id % 3 < 2, 'hot.ru', concat('s', id, '.ru'))"
    sites = spark.range(n).selectExpr(f"{text} AS site", f"concat('https://', {text}, '/') AS url", "uuid() AS pad").repartition(16)
    lookup = spark.range(n).selectExpr("if(id % 3 < 2, 'hot.ru', concat('s', id, '.ru')) AS site", "id AS v").groupBy("site").agg(F.max("v").alias("v"))
    companies = lookup.selectExpr("v AS id", "site AS domain")
    ids = lookup.selectExpr("site", "'7701234567' AS inn", "v AS pos")
    for made in (
        lookup_join(sites, lookup, ["site"]),
        lookup_join(sites, lookup, ["site"], "inner", strategy="shuffle_hash"),
        C.attach_tax_id(sites, "url", ids, "site", "inn", ["pos"]),
        C.join_company(sites, "url", companies, "id", "domain"),
    ):
        most, mid, total = shares(made)
        assert total == n and most <= 4 * mid, (most, mid)


def test_hot_domain_of_checks_spreads_over_tasks(spark, hot):
    probes = spark.range(60_000).selectExpr("concat('a', id div 2, '@x', uuid()) AS address", "if(id % 3 < 2, 'hot.ru', concat('d', id, '.ru')) AS domain", "if(id % 2 = 0, 'mx2', 'mx1') AS host", "250 AS code").repartition(16)
    exchangers = probes.select("domain", F.lit(10).alias("preference"), "host").distinct()
    catch_all = probes.select("domain", F.lit("accepted").alias("status")).distinct()
    most, mid, total = shares(C.join_domain_checks(probes, exchangers, catch_all))
    assert total == 60_000 and most <= 4 * mid, (most, mid)


def test_null_keys(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, x int")
    right = spark.createDataFrame([(None, "n"), ("a", "A")], "k string, y string")
    got = lambda **o: sorted((r["x"], r["y"]) for r in lookup_join(left, right, ["k"], **o).collect())
    assert got() == [(1, None), (2, "A")] and got(null_safe=True) == [(1, "n"), (2, "A")]


SITE = "domain string, v int"


def site_rows(spark, said):
    return spark.createDataFrame([(s, v) for s, vs in said.items() for v in vs], SITE)


def test_sites_are_replaced_one_by_one(spark):
    root, schema = work_path(spark, "sites"), site_rows(spark, {"a": [1]}).schema
    store = SiteStore(spark, root, schema, n_parts=4)
    assert store.read().count() == 0 and store.read_sites(["a"]).count() == 0
    store.store.most = 3
    want = {}
    for k in range(12):
        said = {f"s{i}.ru": [100 * k + i, 100 * k + i] for i in range(40) if (i + k) % 5 == 0} | {None: [k], f"only{k}.ru": [k]}
        store.write(site_rows(spark, said).withColumn("more", F.lit(1)))
        want |= said
    flat = lambda df: sorted(((r["domain"] or "", r["v"]) for r in df.collect()))
    wanted = sorted((s or "", v) for s, vs in want.items() for v in vs)
    assert flat(store.read()) == wanted
    assert flat(SiteStore(spark, root, schema).read_sites(["s3.ru", None, "none.ru"])) == sorted((s or "", v) for s in ("s3.ru", None) for v in want[s])
    assert {(r["domain"], r["n"]) for r in store.sites().collect()} == {(s, len(v)) for s, v in want.items()}
    # what a write lists does not grow with the sites or the writes, and merged folders hold no replaced rows
    current = store.store.current()
    assert all(len(f) <= 2 * 4 for f in current.parts.values())
    assert store.store.read(store.schema).count() < 12 * 18
    # one site is read from its part alone
    files = [f for f in store.read_sites(["s3.ru"]).inputFiles() if "key_part=" in f]
    assert files and len({f.split("key_part=")[1].split("/")[0] for f in files}) == 1


def test_a_killed_site_write_leaves_the_state_before_it(spark, monkeypatch):
    store = SiteStore(spark, work_path(spark, "sites"), site_rows(spark, {"a": [1]}).schema, n_parts=4)
    store.write(site_rows(spark, {"a": [1, 1], "b": [2]}))
    late = SiteStore(spark, store.store.root, site_rows(spark, {"a": [1]}).schema)
    commit = PartStore.commit

    def killed(self, *args):
        raise RuntimeError("killed")

    monkeypatch.setattr(PartStore, "commit", killed)
    with pytest.raises(RuntimeError):
        store.write(site_rows(spark, {"a": [9]}))
    monkeypatch.setattr(PartStore, "commit", commit)
    assert sorted(r["v"] for r in store.read().collect()) == [1, 1, 2]
    before = late.store.current()
    store.write(site_rows(spark, {"b": [3]}))
    monkeypatch.setattr(late.store, "current", lambda *a: before)
    with pytest.raises(StoreConflict):
        late.write(site_rows(spark, {"b": [4]}))
    assert sorted(r["v"] for r in store.read().collect()) == [1, 1, 3]


def test_values_of_a_hot_key_are_cut_into_parts(spark, hot):
    n = 40_000
    rows = spark.range(n).selectExpr("if(id % 4 < 3, null, concat('k', id % 50)) AS k", "id * 7 % 40000 AS p", "concat('v', id * 7 % 40000) AS v")
    parts = cell_parts(rows, ["k"], [F.col("p")], "v", "cell", most=500).collect()
    values = {}
    for r in sorted(parts, key=lambda r: r["part"]):
        values.setdefault(r["k"], []).append(r["cell"].split("; "))
    assert all(len(x) == 500 for cells in values.values() for x in cells[:-1]) and len(values) == len({r["k"] for r in rows.select("k").distinct().collect()})
    for k, cells in values.items():
        got = [int(v[1:]) for cell in cells for v in cell]
        assert got == sorted(got)
    assert sum(len(c) for cells in values.values() for c in cells) == n
    most, _, total = shares(numbered_values(rows, ["k"], [F.col("p")]))
    assert total == n and most <= n / 4  # three quarters of all rows have one key
    assert cell_parts(rows.limit(0), ["k"], [F.col("p")], "v", "cell").count() == 0
