"""WARC archives and chat formatting: round trips, damage, odd input."""

import hashlib
import io
import struct

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitefacts.llm import chat, common, queries, warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "refers_to", "first", "path", "payload")})


ROWS = [(5, "http://a/x", "same body"), (2, "http://b/\r\nInjected: 1", "same body"), (9, None, None), (4, "http://ü/", ""), (7, "http://c/", "é" * 50_000), (7, "http://c/", "é" * 50_000), (None, "http://n/", "same body"), (8, "u", "\r\n\r\nWARC/1.1\r\n")]


def test_archive_round_trip(spark):
    manifest = warc.write_archives(pages(spark, ROWS * 1).repartition(2), common.shared_path(spark, "warc"), archive_bytes=40_000)
    got = sorted(((r.record_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload)) for r in warc.read_archives(manifest).collect()), key=repr)
    assert len(got) == len(ROWS)
    own = {r[0]: r for r in got}
    assert own["urn:page:2"][1:3] == ("response", None) and own["urn:page:5"][1:3] == ("revisit", "urn:page:2")
    assert own["urn:page:9"][1:3] == ("revisit", "urn:page:4") and own["urn:page:4"][1] == "response"
    assert sum(r[0] == "urn:page:7" and r[1] == "response" for r in got) == 2
    assert own["urn:page:5"][3:] == (9, warc.sha1_base32(b"same body"), None)
    assert own["urn:page:7"][5] == ("é" * 50_000).encode() and own["urn:page:8"][5] == b"\r\n\r\nWARC/1.1\r\n"
    assert any(r[0].startswith("urn:uuid:") and r[1] == "response" and r[5] == b"same body" for r in got)
    few = warc.write_archives(pages(spark, ROWS), common.shared_path(spark, "warc"), min_bytes=10)
    assert {r.record_id: r.record_type for r in warc.read_archives(few, with_payload=False).collect()}["urn:page:5"] == "response"
    none = warc.write_archives(pages(spark, []), common.shared_path(spark, "warc"))
    assert warc.read_archives(none).count() == 0


def archive(records, packed=True, magic=warc.DICTIONARY_MAGIC):
    data = warc.trained_dictionary(records)
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data))
    head = zstandard.ZstdCompressor().compress(data) if packed else data
    return struct.pack("<II", magic, len(head)) + head + b"".join(packer.compress(r) for r in records)


def test_frames_and_damage():
    records = [warc.record_bytes({"page_id": i, "url": "u", "refers_to": None}, b"x" * i * 100, "2026-01-01T00:00:00Z") for i in range(30)]
    for packed in (True, False):
        found = list(warc.frames(io.BytesIO(archive(records, packed))))
        assert [d for _, d in found] == records and [o for o, _ in found] == sorted({o for o, _ in found})
    whole = archive(records)
    for broken in (whole[:-3], whole[:5], b"", archive(records, magic=1), whole[: len(whole) // 2] + b"\0" * 40 + whole[len(whole) // 2 + 40 :]):
        with pytest.raises(warc.ArchiveError):
            for _, data in warc.frames(io.BytesIO(broken)):
                warc.parsed_record(data)
    good = records[3]
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WORC/1.1"), good.replace(b"WARC-Date", b"Date"), good.replace(b"xxx", b"xyx", 1), good.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 1", 1), b""):
        with pytest.raises(warc.ArchiveError):
            warc.parsed_record(bad)


CONTROL = st.lists(st.sampled_from(["\\", "</turn>", "###", "<+>", "<", "+>", ":", "\n", " ", "b", "e", "h", "p", "c", "é", "🙂", "</turn>\n", "### assistant: "]), max_size=8).map("".join)


def test_conversations_round_trip(spark):
    found = []

    @given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a: b</turn>", ""]), CONTROL), min_size=1, max_size=6))
    @settings(max_examples=150, deadline=None)
    def gather(turns):
        found.append(turns)

    gather()
    rows = [(c, i, role, text) for c, turns in enumerate(found) for i, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).withColumns({c: F.lit(1) for c in ("turns", "blocks", "parts", "t", "pos")})
    made = chat.format_conversations(df)
    back = made.select("conv_id", "formatted", "n_blocks", chat.parsed_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    for r in back.collect():
        turns = found[r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == turns
        assert r.loss == "".join(t for role, t in turns if role == "assistant")
        assert r.n_blocks == sum(i == 0 or turns[i - 1][0] != role for i, (role, _) in enumerate(turns))


def test_odd_conversations(spark):
    rows = [(1, 2, "user", None), (1, 1, None, "first"), (1, 2, "user", None), (1, None, "assistant", "before"), (None, 1, "assistant", "x"), (2, 1, "user", "long " * 200_000)]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in made.select("conv_id", chat.parsed_turns(F.col("formatted")).alias("turns")).collect()}
    assert back == {1: [("assistant", "before"), ("", "first"), ("user", ""), ("user", "")], None: [("assistant", "x")], 2: [("user", "long " * 200_000)]}
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_added_conversation(spark):
    row = queries.op3_chat_format(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    text = queries.ADDED_TEXT
    assert row.n_turns == 2 and row.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert row.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_chat_plan_has_no_python(spark):
    plan = queries.op3_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_many_turns_are_linear_work(spark):
    """A conversation of 40,000 turns is formatted and read back in seconds, not in the square of its turns."""
    import time

    n = 40_000
    rows = spark.range(n).selectExpr("1 AS conv_id", "id AS turn", "if(id % 5 < 2, 'user', 'assistant') AS role", "concat('text ', id) AS text")
    began = time.time()
    made = chat.format_conversations(rows).select("formatted", "n_blocks", "loss_spans", chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.size(chat.parsed_turns(F.col("formatted"))).alias("turns")).first()
    assert time.time() - began < 30
    assert made.loss == "".join(f"text {i}" for i in range(n) if i % 5 >= 2)
    assert made.n_blocks == 2 * n // 5 and made.turns == n
    assert [made.formatted[s.start : s.end] for s in made.loss_spans] == [f"text {i}" for i in range(n) if i % 5 >= 2]


def test_hot_payload_spreads_over_tasks(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "24"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        pages = spark.range(30_000).selectExpr("id AS page_id", "uuid() AS url", "if(id % 3 < 2, 'the same', concat('p', id)) AS html").repartition(16)
        found = warc.with_first_pages(pages, 0).withColumns({"_all": F.xxhash64("page_id", "url", "html", "refers_to"), "_task": F.spark_partition_id()}).groupBy("_task").agg(F.count("*").alias("n"), F.max("_all"))
        counts = sorted(r.n for r in found.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert sum(counts) == 30_000 and counts[-1] <= 4 * counts[len(counts) // 2]


def test_rows_without_a_conversation(spark):
    rows = [(None, 1, "user", "a"), (None, 1, "user", "a"), (3, 0, "user", "b"), (3, 0, "user", "b")]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.conv_id or 0, r.n_blocks, r.formatted) for r in made) == [(0, 1, "### user: a</turn>\n")] * 2 + [(3, 1, "### user: b<+>b</turn>\n")]
