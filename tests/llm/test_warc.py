import random
import zlib

from pyspark.sql import Row

from evenkeel.llm import store, warc

PAGES = "page_id long, url string, html string, digest string, size int"


def rows(spark, pages, **options):
    frame = spark.createDataFrame([Row(*p, "clash", 7) for p in pages], PAGES)
    archives = warc.write(frame, store.new_path(spark, "warc"), **options)
    return archives, warc.read(spark, archives, range_bytes=options.pop("range_bytes", 700))


def test_round_trip_with_revisits(spark):
    long = "x" * 150
    pages = [(3, "http://a/ b", long), (1, None, long), (2, "u", long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", "é😀" * 40), (None, "u", "y" * 200), (9, "u", "y" * 200)]
    _, read = rows(spark, pages)
    got = {r["page_id"]: r for r in read.collect()}
    assert len(got) == len(pages)
    assert got[1]["record_type"] == "response" and got[1]["payload"].decode() == long
    assert [(got[i]["record_type"], got[i]["refers_to"]) for i in (2, 3)] == [("revisit", 1)] * 2
    assert got[3]["payload_bytes"] == 150 and got[3]["payload_digest"] == got[1]["payload_digest"]
    assert got[4]["record_type"] == got[5]["record_type"] == "response"
    assert got[6]["payload_bytes"] == 0
    assert got[7]["payload"].decode() == "é😀" * 40
    assert got[None]["record_type"] == "response" and (got[9]["record_type"], got[9]["refers_to"]) == ("revisit", None)


def test_repeated_rows_hold_one_payload(spark):
    _, read = rows(spark, [(1, "u", "z" * 300)] * 3)
    kinds = sorted((r["record_type"], r["refers_to"]) for r in read.collect() if r["record_type"] == "revisit")
    assert kinds == [("revisit", 1)] * 2 and read.count() == 3


def test_repeated_rows_in_one_large_group(spark):
    html = "w" * 120
    pages = [(None, None, html)] * 3 + [(None, "u", html)] * 200 + [(5, "v", html)] * 40 + [(7, "x", None), (7, "x", "")]
    _, read = rows(spark, pages)
    got = [(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["url"]) for r in read.collect()]
    assert len(got) == len(pages) and [g for g in got if g[1] == "response" and g[3]] == [(None, "response", None, 120, None)]
    assert sum(g[0] == 5 and g[1] == "revisit" for g in got) == 40 and sum(g[4] == "u" for g in got) == 200


def test_every_range_size_reads_each_record_once(spark):
    rng = random.Random(5)
    # payloads that hold the magic themselves, and a long one that passes many ranges
    pages = [(i, f"http://h/{i}", "".join(rng.choice("ab\x1f\x08 ") for _ in range(rng.choice([0, 5, 400, 3000])))) for i in range(60)] + [(99, "u", "".join(chr(rng.randrange(32, 1000)) for _ in range(60_000)))]
    frame = spark.createDataFrame([Row(*p, "clash", 7) for p in pages], PAGES)
    archives = warc.write(frame, store.new_path(spark, "warc"), archive_bytes=20_000)
    for size in (2_000, 50_000, 1 << 24):
        got = {r["page_id"]: r["payload"] for r in warc.read(spark, archives, range_bytes=size).where("record_type = 'response'").collect()}
        assert warc.read(spark, archives, range_bytes=size).count() == len(pages)
        assert all(got[i] == text.encode() for i, _, text in pages if i in got)


def test_false_magic_is_not_a_record(tmp_path):
    import pyarrow as pa

    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    inner = packer.compress(b"not a record") + packer.flush()
    record = warc._record(1, "u", b"p" * 200, 200, "d", None, False)
    data = inner + warc.MAGIC + b"junk" + record + record[:50]
    found = list(warc.records_in(pa.BufferReader(data), len(data), 0, len(data)))
    assert len(found) == 1 and found[0][1].endswith(b"p" * 200)


def test_header_of_any_length():
    import pyarrow as pa

    rng = random.Random(3)
    url = "data:," + "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=2 << 20))
    data = warc._record(1, "u", b"p", 1, "d", None, False) + warc._record(2, url, b"q" * 200, 200, "d", None, False) + warc._record(3, "v", b"r", 1, "d", None, False)
    found = list(warc.records_in(pa.BufferReader(data), len(data), 0, len(data)))
    assert [f["warc-record-id"] for f, _ in found] == ["<urn:page:1>", "<urn:page:2>", "<urn:page:3>"]
    assert found[1][0]["warc-target-uri"] == url and found[1][1].endswith(b"q" * 200)


def test_empty_table(spark):
    _, read = rows(spark, [])
    assert read.count() == 0
