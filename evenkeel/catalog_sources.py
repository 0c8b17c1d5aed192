"""Queries of sources, sinks, sampled intervals, samplers and jobs, over the driver's tables, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import functions as fx
from . import operators as op
from . import sources
from .catalog import SQL_LINE_BYTES, line_bytes, query, rounded, t
from .operators import intervals, partitioners, samplers, statistics
from .plans import cost, reactive

# ------------------------------------------------------------ readers


@query("""
    WITH l AS (SELECT n_nationkey AS k, n_nationkey || '|' || n_name || '|' || repeat('x', n_regionkey * 7) AS line FROM nation),
    o AS (SELECT *, CAST(coalesce(sum(strlen(line) + 1) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM l)
    SELECT "offset", line FROM o WHERE strlen(line) <= 40
""")
def text_line_offsets(spark, d):
    """Lines with their byte offsets; lines over 40 bytes are skipped but count."""
    path = sources.scratch(spark, "lines")
    line = F.concat_ws("|", F.col("n_nationkey").cast("string"), "n_name", F.repeat(F.lit("x"), F.col("n_regionkey") * 7))
    t(spark, d, "nation").coalesce(1).sortWithinPartitions("n_nationkey").select(line.alias("value")).write.text(path)
    return sources.text_lines(spark, path, 40).select("offset", F.col("value").alias("line"))


@query("SELECT n_nationkey, lower(hex(n_name)) AS value FROM nation")
def sequence_file_round_trip(spark, d):
    """Text records through Hadoop sequence files."""
    path = sources.scratch(spark, "sequence")
    sources.write_sequence(t(spark, d, "nation"), path, "n_nationkey", "n_name")
    return sources.sequence_records(spark, path).select(F.col("key").cast("string").cast("int").alias("n_nationkey"), F.lower(F.hex("value")).alias("value"))


@query("SELECT lower(hex(encode(CAST(r_regionkey AS VARCHAR)))) || chr(9) || lower(hex(encode(r_name || chr(233)))) AS line FROM region UNION ALL SELECT lower(hex(encode(CAST(n_nationkey AS VARCHAR)))) || chr(9) || lower(hex(encode(n_name || chr(233)))) FROM nation")
def sequence_binary_concat_dump(spark, d):
    """Byte records of two sets of sequence files, joined into one and dumped."""
    paths = []
    for name, key, value in (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name")):
        paths.append(sources.scratch(spark, name))
        rows = t(spark, d, name).select(F.encode(F.col(key).cast("string"), "UTF-8").alias("key"), F.encode(F.concat(value, F.lit("é")), "UTF-8").alias("value"))
        sources.write_sequence(rows, paths[-1], "key", "value")
    whole = sources.scratch(spark, "whole")
    sources.concatenated(spark, paths, whole)
    return sources.dumped(sources.sequence_records(spark, whole))


@query("""
    WITH r AS (SELECT doc_id % 8 AS stream, doc_id, strlen(source) AS k, strlen(coalesce(text, '')) AS v FROM documents),
    p AS (SELECT *, CAST(coalesce(sum(k + v + CASE WHEN doc_id % 5 = 0 THEN 20 ELSE 0 END) OVER (PARTITION BY stream ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM r)
    SELECT stream, pos AS "offset", CAST(k AS BIGINT) AS key_len, CAST(v AS BIGINT) AS val_len, CAST(k + v AS BIGINT) AS rec_len, doc_id % 5 <> 0 OR lead(pos) OVER (PARTITION BY stream ORDER BY pos) IS NULL AS splitable FROM p
""")
def sequence_scan(spark, d):
    """Offsets and lengths of records of eight streams, with one record of lookahead; a marker of 20 bytes stands behind every fifth."""
    size = F.octet_length("source") + F.octet_length(F.coalesce("text", F.lit("")))
    w = Window.partitionBy("stream").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = t(spark, d, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 8).alias("stream"))
    rows = rows.withColumn("pos", F.coalesce(F.sum(size + F.when(F.col("doc_id") % 5 == 0, 20).otherwise(0)).over(w), F.lit(0)).cast("long"))
    # contents are dropped by the scan, so the stream is carried in the offset's order
    kept = rows.select("stream", "pos", F.octet_length("source").cast("long").alias("key_len"), F.octet_length("text").cast("long").alias("val_len"))
    following = F.lead("pos").over(Window.partitionBy("stream").orderBy("pos"))
    scanned = kept.withColumn("rec_len", F.col("key_len") + F.col("val_len"))
    return scanned.select("stream", F.col("pos").alias("offset"), "key_len", "val_len", "rec_len", F.coalesce(following == F.col("pos") + F.col("rec_len"), F.lit(True)).alias("splitable"))


@query("""
    WITH h AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size FROM documents),
    p AS (SELECT *, CAST(sum(size) OVER (ORDER BY doc_id) - size AS BIGINT) AS pos FROM h)
    SELECT count(*) FILTER (WHERE pos < 400000) AS processed_records, CAST(coalesce(sum(size) FILTER (WHERE pos < 400000), 0) AS BIGINT) AS processed_bytes, CAST(coalesce(max(pos + size) FILTER (WHERE pos < 400000), 0) AS BIGINT) AS stopped_at,
           count(*) FILTER (WHERE pos >= 400000) AS rest_records, CAST(coalesce(sum(size) FILTER (WHERE pos >= 400000), 0) AS BIGINT) AS rest_bytes FROM p
""")
def wrapped_reader(spark, d):
    """A reader that is stopped at 400,000 bytes: what it processed, where it stands, and what a scan of the rest finds."""
    placed = statistics.less_than_key(statistics.key_histogram(t(spark, d, "documents"), ["doc_id"], fx.record_bytes("text")), "doc_id")
    return sources.stopped_at(placed, "lt_bytes", "bytes", 400_000)[1]


SQL_RAW = "CASE WHEN event_id % 41 IN (7, 8, 9) THEN 'damaged ' || event_id WHEN event_id % 97 = 0 THEN NULL ELSE CAST(event_id * 3 AS VARCHAR) END"


def raw_events(spark, d):
    e = F.col("event_id")
    raw = F.when((e % 41).isin(7, 8, 9), F.concat(F.lit("damaged "), e.cast("string"))).when(e % 97 == 0, None).otherwise((e * 3).cast("string"))
    return sources.parsed(t(spark, d, "events").select("event_id", (e % 4).alias("stream"), raw.alias("raw")).withColumn("place", F.floor(e / 4)), "raw", "long")


@query(f"SELECT event_id % 4 AS stream, count(*) AS records, count(*) FILTER (WHERE raw IS NOT NULL AND TRY_CAST(raw AS BIGINT) IS NULL) AS skipped, CAST(sum(TRY_CAST(raw AS BIGINT)) AS BIGINT) AS total FROM (SELECT event_id, {SQL_RAW} AS raw FROM events) GROUP BY 1")
def skipping_reader(spark, d):
    return raw_events(spark, d).groupBy("stream").agg(F.count(F.lit(1)).alias("records"), F.count_if("bad").alias("skipped"), F.sum("value").alias("total"))


@query(f"""
    WITH r AS (SELECT event_id % 2 AS stream, event_id // 2 AS place, {SQL_RAW} AS raw FROM events),
    b AS (SELECT *, place - row_number() OVER (PARTITION BY stream ORDER BY place) AS island FROM r WHERE raw IS NOT NULL AND TRY_CAST(raw AS BIGINT) IS NULL)
    SELECT stream, min(place) AS start, count(*) AS length FROM b GROUP BY stream, island
""")
def skipped_ranges(spark, d):
    """Ranges of records that a skipping reader leaves out."""
    rows = raw_events(spark, d).withColumn("stream", F.col("event_id") % 2).withColumn("place", F.floor(F.col("event_id") / 2))
    return sources.bad_ranges(rows, ["stream"], "place")


# ------------------------------------------------------------ map output and splits


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 4 = 2 AND l_partkey > 100 AND l_partkey <= 300")
def reactive_map_output(spark, d):
    """Of written map output one reduce partition's keys behind 100, up to 300."""
    path = sources.scratch(spark, "map-output")
    sources.write_map_output(t(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber"), path, F.col("l_partkey") % 4, ["l_partkey"])
    return sources.read_map_output(spark, path, 2, "l_partkey", 100, 300)


@query(f"SELECT l_partkey, CAST({SQL_LINE_BYTES} AS BIGINT) AS rec_bytes FROM lineitem WHERE l_partkey % 4 = 1 AND l_partkey <= 500")
def reactive_map_output_keys(spark, d):
    """The same, keys and sizes only: no other column is read."""
    path = sources.scratch(spark, "map-output")
    rows = t(spark, d, "lineitem").select("l_partkey", line_bytes().cast("long").alias("rec_bytes"), "l_extendedprice")
    sources.write_map_output(rows, path, F.col("l_partkey") % 4, ["l_partkey"])
    return sources.read_map_output(spark, path, 1, "l_partkey", None, 500, ["l_partkey", "rec_bytes"])


@query("SELECT o_custkey, o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'tracker' ELSE 'reactive' END AS source FROM orders WHERE o_custkey % 3 < 2 AND o_custkey > 40")
def map_output_input(spark, d):
    """A reduce's input by split: partition 0 as the first run kept it, partition 1 as a later run wrote it."""
    rows = t(spark, d, "orders").select("o_custkey", "o_orderkey")
    tracker = sources.materialized(partitioners.place(rows, F.col("o_custkey") % 3, 3))
    path = sources.scratch(spark, "map-output")
    sources.write_map_output(rows, path, F.col("o_custkey") % 3, ["o_custkey"])
    read = [sources.map_output(spark, tracker, path, source, pid, "o_custkey", 40).withColumn("source", F.lit(source)) for pid, source in ((0, "tracker"), (1, "reactive"))]
    return sources.merged_outputs(*read)


@query("""
    WITH RECURSIVE s AS (SELECT s_nationkey % 3 AS host, s_suppkey AS name, 1000 + s_suppkey * 7919 % 60000 AS bytes, row_number() OVER (PARTITION BY s_nationkey % 3 ORDER BY s_suppkey) AS i FROM supplier),
    c AS (SELECT host, i, name, 0 AS chunk, bytes AS held FROM s WHERE i = 1 UNION ALL
          SELECT s.host, s.i, s.name, CASE WHEN c.held + s.bytes > 100000 THEN c.chunk + 1 ELSE c.chunk END, CASE WHEN c.held + s.bytes > 100000 THEN s.bytes ELSE c.held + s.bytes END FROM c JOIN s ON s.host = c.host AND s.i = c.i + 1)
    SELECT CAST(host AS INTEGER) AS host, CAST(chunk AS INTEGER) AS chunk, CAST(name AS BIGINT) AS name FROM c
""")
def combined_splits(spark, d):
    """Outputs of each host gathered into chunks of at most 100,000 bytes (a bounded list, on the driver)."""
    rows = t(spark, d, "supplier").select((F.col("s_nationkey") % 3).alias("host"), F.col("s_suppkey").alias("name"), (1000 + F.col("s_suppkey") * 7919 % 60000).alias("bytes")).orderBy("host", "name").collect()
    chunks = sources.chunks_by_host([(r["host"], r["name"], r["bytes"]) for r in rows], 100_000)
    return spark.createDataFrame([(h, i, n) for h, lists in chunks.items() for i, names in enumerate(lists) for n in names], "host int, chunk int, name long")


@query("""
    WITH n AS (SELECT CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS total FROM documents),
    p AS (SELECT CAST(i AS INTEGER) AS index, total // 7 + CASE WHEN i < total % 7 THEN 1 ELSE 0 END AS size FROM n, range(0, 7) AS r(i))
    SELECT index, CAST(coalesce(sum(size) OVER (ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", CAST(sum(size) OVER (ORDER BY index) AS BIGINT) AS last_offset FROM p
""")
def cached_splits(spark, d):
    """Seven equal splits of an input, handed over as rows."""
    total = t(spark, d, "documents").agg(F.sum(fx.record_bytes("text"))).first()[0]
    return sources.splits_frame(spark, sources.equal_splits(int(total), 7))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 4000")
def delegate_input(spark, d):
    """An explicit split under the original reader: a range filter that reaches the scan."""
    return t(spark, d, "orders").where(sources.in_split(F.col("o_orderkey"), sources.Split(1000, 3000))).select("o_orderkey", "o_custkey")


@query("SELECT printf('r-%05d.%d', CAST(l_suppkey % 4 AS INTEGER), CAST(l_linenumber % 2 AS INTEGER)) AS output, count(*) AS n, round(sum(l_quantity), 4) AS qty FROM lineitem GROUP BY 1")
def file_output(spark, d):
    """Compressed output in directories named as recursive outputs are, read back."""
    path = sources.scratch(spark, "output")
    name = F.format_string("r-%05d.%d", (F.col("l_suppkey") % 4).cast("int"), (F.col("l_linenumber") % 2).cast("int"))
    sources.write_output(t(spark, d, "lineitem").select("l_quantity", name.alias("output")), path, partitions=["output"])
    return spark.read.parquet(path).groupBy("output").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("l_quantity")).alias("qty"))


@query("SELECT count(*) AS records, count(*) FILTER (WHERE l_quantity < 10) AS small, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem")
def null_output_counters(spark, d):
    """Counters that fill as a by-product while all rows go to the null sink."""
    rows, seen = sources.observed(t(spark, d, "lineitem"), records=F.count(F.lit(1)), small=F.count_if(F.col("l_quantity") < 10), keys=F.sum("l_orderkey"))
    sources.discard(rows)
    found = seen.get
    return spark.createDataFrame([(found["records"], found["small"], found["keys"])], "records long, small long, keys long")


BUCKETS_SQL = """
    WITH h AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes FROM documents),
    c AS (SELECT *, CAST((sum(bytes) OVER (ORDER BY doc_id) - 1) AS BIGINT) // 131072 AS bucket FROM h)
    SELECT bucket, min(doc_id) AS min_key, max(doc_id) AS max_key, count(*) AS num_keys, count(*) AS num_recs, CAST(sum(bytes) AS BIGINT) AS tot_bytes FROM c GROUP BY bucket
"""


@query(BUCKETS_SQL)
def partition_statistics_file(spark, d):
    """Statistics of partitions, written for a planner and read back."""
    path = sources.scratch(spark, "statistics")
    sources.write_statistics(statistics.byte_buckets(statistics.key_histogram(t(spark, d, "documents"), ["doc_id"], fx.record_bytes("text")), "doc_id", 131072), path)
    return sources.read_statistics(spark, path)


# ------------------------------------------------------------ sampled intervals


@query("""
    WITH RECURSIVE r AS (SELECT doc_id % 4 AS split, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, doc_id % 3 = 0 AS may, row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) AS i FROM documents),
    p AS (SELECT *, CAST(sum(size) OVER (PARTITION BY split ORDER BY i) - size AS BIGINT) AS pos FROM r),
    s AS (SELECT split, i, pos, size, may, 0 AS slice, size AS held FROM p WHERE i = 1 UNION ALL
          SELECT p.split, p.i, p.pos, p.size, p.may, CASE WHEN s.may AND (p.size >= 16384 OR s.held >= 16384) THEN s.slice + 1 ELSE s.slice END, CASE WHEN s.may AND (p.size >= 16384 OR s.held >= 16384) THEN p.size ELSE s.held + p.size END
          FROM s JOIN p ON p.split = s.split AND p.i = s.i + 1)
    SELECT CAST(split AS BIGINT) AS split, min(pos) AS "offset", max(pos + size) AS last_offset, count(*) AS num_recs FROM s GROUP BY split, slice
""")
def record_intervals(spark, d):
    """Slices of about 16 KiB of four splits of documents, cut only behind splitable records (every third is)."""
    import pandas as pd

    def run(batches):
        now, rows, offset = None, [], 0

        def slices():
            return pd.DataFrame([{"split": now} | vars(s) for s in intervals.RecordPool(16_384, start=16_384).slices(rows)], columns=["split", "offset", "last_offset", "num_recs"])

        for pdf in batches:
            for split, doc, size in zip(pdf["split"], pdf["doc_id"], pdf["size"]):
                if now is not None and split != now:
                    yield slices()
                    rows, offset = [], 0
                now = split
                rows.append((offset, int(size), doc % 3 == 0))
                offset += int(size)
        if rows:
            yield slices()

    sized = t(spark, d, "documents").select("doc_id", fx.record_bytes("text").alias("size"), (F.col("doc_id") % 4).alias("split"))
    return sized.repartition("split").sortWithinPartitions("split", "doc_id").mapInPandas(run, "split long, offset long, last_offset long, num_recs long")


#: Intervals of about 256 bytes of four runs of orders, by the rule of the streaming mode, one key group after the other.
KEY_INTERVALS_SQL = """
    WITH RECURSIVE h AS (SELECT o_orderkey % 4 AS run, o_custkey AS k, count(*) AS r, CAST(sum(strlen(CAST(o_orderkey AS VARCHAR)) + strlen(CAST(o_custkey AS VARCHAR))) AS BIGINT) AS b FROM orders GROUP BY 1, 2),
    p AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY k) AS i FROM h),
    s AS (SELECT run, i, k, r, b, 0 AS slice, b AS held FROM p WHERE i = 1 UNION ALL
          SELECT p.run, p.i, p.k, p.r, p.b, CASE WHEN p.b >= 256 OR s.held >= 256 THEN s.slice + 1 ELSE s.slice END, CASE WHEN p.b >= 256 OR s.held >= 256 THEN p.b ELSE s.held + p.b END
          FROM s JOIN p ON p.run = s.run AND p.i = s.i + 1),
    e AS (SELECT *, row_number() OVER (PARTITION BY run, slice ORDER BY i) AS up, row_number() OVER (PARTITION BY run, slice ORDER BY i DESC) AS down FROM s)
"""


def order_runs(spark, d):
    h = t(spark, d, "orders").groupBy((F.col("o_orderkey") % 4).alias("run"), F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("records"), F.sum(fx.record_bytes("o_orderkey", "o_custkey")).alias("bytes"))
    return intervals.sample_runs(h, "run", "key", 256, start=256)


@query(KEY_INTERVALS_SQL + """
    SELECT run, max(k) FILTER (WHERE up = 1) AS begin, CAST(sum(r) FILTER (WHERE up = 1) AS BIGINT) AS begin_recs, CAST(sum(b) FILTER (WHERE up = 1) AS BIGINT) AS begin_bytes,
           count(*) FILTER (WHERE up > 1 AND down > 1) AS mid_keys, CAST(coalesce(sum(r) FILTER (WHERE up > 1 AND down > 1), 0) AS BIGINT) AS mid_recs, CAST(coalesce(sum(b) FILTER (WHERE up > 1 AND down > 1), 0) AS BIGINT) AS mid_bytes,
           max(k) FILTER (WHERE up > 1 AND down = 1) AS "end", CAST(coalesce(sum(r) FILTER (WHERE up > 1 AND down = 1), 0) AS BIGINT) AS end_recs, CAST(coalesce(sum(b) FILTER (WHERE up > 1 AND down = 1), 0) AS BIGINT) AS end_bytes
    FROM e GROUP BY run, slice
""")
def key_intervals(spark, d):
    """Every bound and sum of the sampled intervals of four runs."""
    return order_runs(spark, d)


@query(KEY_INTERVALS_SQL + "SELECT run, min(k) AS min_key, max(k) AS max_key, count(*) AS num_keys, CAST(sum(r) AS BIGINT) AS num_recs, CAST(sum(b) AS BIGINT) AS tot_bytes FROM e GROUP BY run, slice")
def local_scan_output(spark, d):
    """The same as closed ranges."""
    return intervals.closed_ranges(order_runs(spark, d))


LESS_SQL = """
    WITH h AS (SELECT o_orderkey % 3 AS run, o_custkey, count(*) AS records, CAST(sum(strlen(CAST(o_orderkey AS VARCHAR))) AS BIGINT) AS bytes FROM orders GROUP BY 1, 2),
    l AS (SELECT *, row_number() OVER w - 1 AS lt_keys, sum(records) OVER w - records AS lt_records, sum(bytes) OVER w - bytes AS lt_bytes FROM h WINDOW w AS (PARTITION BY run ORDER BY o_custkey))
    SELECT o_custkey, CAST(sum(records) AS BIGINT) AS records, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(lt_records) AS BIGINT) AS lt_records, CAST(sum(lt_bytes) AS BIGINT) AS lt_bytes, CAST({f}(lt_keys) AS BIGINT) AS lt_keys FROM l GROUP BY o_custkey
"""


def less_than_runs(spark, d):
    h = t(spark, d, "orders").groupBy((F.col("o_orderkey") % 3).alias("run"), "o_custkey").agg(F.count(F.lit(1)).alias("records"), F.sum(fx.record_bytes("o_orderkey")).alias("bytes"))
    w = Window.partitionBy("run").orderBy("o_custkey").rowsBetween(Window.unboundedPreceding, -1)
    below = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    return h.withColumn("lt_keys", F.count(F.lit(1)).over(w)).withColumn("lt_records", below("records")).withColumn("lt_bytes", below("bytes"))


@query(LESS_SQL.format(f="max"))
def lessthan_merge_max(spark, d):
    return statistics.merge_less_than(less_than_runs(spark, d), "o_custkey")


@query(LESS_SQL.format(f="sum"))
def lessthan_merge_sum(spark, d):
    return statistics.merge_less_than(less_than_runs(spark, d), "o_custkey", "sum")


# ------------------------------------------------------------ samplers


@query("SELECT l_partkey, count(*) AS sampled FROM lineitem WHERE ((l_orderkey * 8 + l_linenumber) % 1000003 * 48271 + 11) % 1000003 % 1000 < 100 GROUP BY l_partkey")
def row_sampling_reduce(spark, d):
    return statistics.sampled_key_counts(t(spark, d, "lineitem"), "l_partkey", statistics.bernoulli(F.col("l_orderkey") * 8 + F.col("l_linenumber"), 11, 100))


@query("""
    WITH RECURSIVE o AS (SELECT o_orderkey, o_custkey % 6 AS split, (o_orderkey * 7919 + 13) % 10007 / CAST(10007 AS DOUBLE) AS chance, CAST(o_orderkey * 31 % 12 AS INTEGER) AS place FROM orders),
    c AS (SELECT * FROM o WHERE chance <= CAST(0.03 AS DOUBLE)),
    n AS (SELECT split, count(*) AS chosen, row_number() OVER (ORDER BY split * 7919 % 104729, split) AS turn FROM c GROUP BY split),
    b AS (SELECT split, turn, coalesce(sum(chosen) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n),
    q AS (SELECT c.*, row_number() OVER (ORDER BY turn, o_orderkey) AS i FROM c JOIN b ON c.split = b.split WHERE turn <= 3 OR before < 12),
    s AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS held, CAST(0.03 AS DOUBLE) AS rate UNION ALL
          SELECT q.i, CASE WHEN chance > rate THEN held WHEN len(held) < 12 THEN list_append(held, o_orderkey) ELSE list_concat(held[1:place], [o_orderkey], held[place + 2:]) END,
                 CASE WHEN chance > rate OR len(held) < 12 THEN rate ELSE rate * (11 / CAST(12 AS DOUBLE)) END FROM s JOIN q ON q.i = s.i + 1)
    SELECT unnest(held) AS o_orderkey FROM s WHERE i = (SELECT max(i) FROM s)
""")
def random_sampler(spark, d):
    """Twelve orders by the falling rate, over shuffled splits; chances and places come from the keys, so that the sample can be repeated."""
    key = F.col("o_orderkey")
    rows = samplers.random_sample(t(spark, d, "orders"), "o_orderkey", F.col("o_custkey") % 6, (key * 7919 + 13) % 10007 / F.lit(10007.0), key * 31 % 12, ["o_orderkey"], 0.03, 12, 3)
    return rows.select("o_orderkey")


# ------------------------------------------------------------ order and jobs


@query("SELECT o_custkey % 5 AS pid, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_custkey, o_orderkey) AS place FROM orders")
def sort_by_partition_and_key(spark, d):
    """What a map hands over: rows in their partition, in key order."""
    rows = op.sorted_by_partition(t(spark, d, "orders").select("o_custkey", "o_orderkey"), F.col("o_custkey") % 5, ["o_custkey", "o_orderkey"])
    return rows.select(F.col("pid").cast("long").alias("pid"), "o_orderkey", (F.col("place") + 1).alias("place"))


@query("SELECT CAST(l_partkey % 4 AS BIGINT) AS pid, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey % 4 ORDER BY l_partkey, l_orderkey, l_linenumber, l_suppkey) AS place FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01'")
def force_sort(spark, d):
    """The part of a map's input that a reactive map-only job gets, sorted with the original partitioner."""
    rest = t(spark, d, "lineitem").where("l_shipdate >= timestamp '1996-01-01'").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey")
    rows = op.sorted_by_partition(rest, F.col("l_partkey") % 4, ["l_partkey", "l_orderkey", "l_linenumber", "l_suppkey"])
    return rows.select(F.col("pid").cast("long").alias("pid"), "l_orderkey", "l_linenumber", (F.col("place") + 1).alias("place"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) - 1 AS place FROM events")
def secondary_sort_stream(spark, d):
    """Whole groups as a reducer streams them, in an order finer than the groups."""
    rows = op.secondary_sorted(t(spark, d, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id")], ["user_id", "event_id"]).withColumn("at", F.monotonically_increasing_id())
    return rows.select("user_id", "event_id", (F.col("at") - F.min("at").over(Window.partitionBy("user_id"))).alias("place"))


@query("SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 4) AS qty FROM lineitem GROUP BY l_suppkey")
def secondary_partitioner(spark, d):
    """A reduce placed by the user's own partitioner."""
    job = op.Job(group=["l_suppkey"], reduce=[F.count(F.lit(1)).alias("n"), rounded(F.sum("l_quantity")).alias("qty")], partition=F.col("l_suppkey") % 3, partitions=3)
    return job.run(t(spark, d, "lineitem"))


@query("SELECT count(DISTINCT o_custkey) AS keys, CAST(0 AS BIGINT) AS divided, count(*) AS records, true AS in_range FROM orders")
def default_hash_partition(spark, d):
    """No key is divided over two partitions, and ids lie in range."""
    pid = partitioners.default_id(7, F.col("o_custkey"))
    per_key = t(spark, d, "orders").groupBy("o_custkey").agg(F.count_distinct(pid).alias("parts"), F.count(F.lit(1)).alias("n"), F.min(pid).alias("low"), F.max(pid).alias("high"))
    return per_key.agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("parts") > 1).alias("divided"), F.sum("n").alias("records"), F.bool_and((F.col("low") >= 0) & (F.col("high") < 7)).alias("in_range"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def submitted_job(spark, d):
    """A job that runs beside the caller and is waited for."""
    job = op.Job(group=["event_type"], reduce=[F.count(F.lit(1)).alias("n"), rounded(F.sum("value")).alias("total")])
    path = sources.scratch(spark, "submitted")
    job.submit(t(spark, d, "events"), lambda df: df.write.parquet(path)).result()
    return spark.read.parquet(path)


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def split_job(spark, d):
    """A job that the user splits in five parts."""
    return op.Job(group=["l_suppkey"], reduce=[F.count(F.lit(1)).alias("n")]).split(t(spark, d, "lineitem"), line_bytes(), 5)


@query("SELECT user_id, count(*) AS n, list_aggregate(list(event_type ORDER BY ts, event_id)[1:5], 'string_agg', '>') AS path FROM events GROUP BY user_id")
def reduce_arbitrary(spark, d):
    """A reducer that reads its group in order and stops early, which aggregates don't say: the first five events of each user."""
    import pandas as pd

    def first_five(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [rows["user_id"].iloc[0]], "n": [len(rows)], "path": [">".join(rows["event_type"].iloc[:5])]})

    job = op.Job(group=["user_id"], sort=["ts", "event_id"], reducer=first_five, reducer_schema="user_id long, n long, path string")
    return job.run(t(spark, d, "events").select("user_id", "event_id", "ts", "event_type"))


@query("SELECT event_type, round(favg(value), 6) AS mean FROM events GROUP BY event_type")
def compensated_average(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(rounded(fx.exact_mean(F.col("value"), 12), 6).alias("mean"))


@query("SELECT user_id, event_id, value FROM (SELECT *, max(CASE WHEN value < 80 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS failed FROM events) WHERE failed = 0")
def bounded_head_filter(spark, d):
    """Each user's events up to the first that reaches 80: a prefix, not a filter."""
    return fx.head_while(t(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.col("value") < 80).select("user_id", "event_id", "value")


@query("SELECT user_id, count(*) AS items, CAST(sum(w) AS BIGINT) AS weight, round(sum(value * w) / sum(w), 6) AS mean FROM (SELECT *, 1 + event_id % 4 AS w, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 16 GROUP BY user_id")
def circular_weight_buffer(spark, d):
    held = fx.weighted_last_rows(t(spark, d, "events").withColumn("w", 1 + F.col("event_id") % 4), ["user_id"], ["ts", "event_id"], 16, "value", "w")
    return held.withColumn("mean", rounded(F.col("mean"), 6))


# ------------------------------------------------------------ cost log


@query("""
    WITH o AS (SELECT *, (SELECT max(o_orderkey) + 1 FROM orders) AS top FROM orders),
    l AS (SELECT 't' || o_custkey % 2 AS tracker, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'r' ELSE 'm' END AS type, 1 + o_orderkey * 37 % 5000 AS bytes, o_orderkey * 11 % 400 AS records,
                 CASE WHEN o_orderkey * 10 < top * 4 THEN 'A' WHEN o_orderkey * 10 < top * 7 THEN 'B' ELSE 'A' END AS class FROM o),
    n AS (SELECT *, CASE WHEN class IS NOT DISTINCT FROM lag(class) OVER w THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY tracker ORDER BY seq)),
    r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY tracker ORDER BY seq) AS BIGINT) AS run, CAST(2 + records * 0.25 + bytes * 0.125 + seq % 7 AS DOUBLE) AS y, CAST(records AS DOUBLE) AS a, CAST(bytes AS DOUBLE) AS b FROM n),
    m AS (SELECT tracker, run, class, count(*) AS observations, avg(y) AS ym, avg(a) AS am, avg(b) AS bm, covar_pop(a, a) AS aa, covar_pop(b, b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy
          FROM r WHERE type = 'm' AND records > 0 GROUP BY tracker, run, class),
    s AS (SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS s1, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS s2 FROM m)
    SELECT tracker, run, class, observations, round(ym - s1 * am - s2 * bm, 4) AS intercept, round(s1, 6) AS per_record, round(s2, 6) AS per_byte FROM s
""")
def cost_log_models(spark, d):
    """A cost log written as text, in files that follow each other, and read by its lines: a model for each stretch of one class, as a class that comes back begins anew."""
    top = t(spark, d, "orders").agg(F.max("o_orderkey")).first()[0] + 1
    k = F.col("o_orderkey")
    bytes_, records = 1 + k * 37 % 5000, k * 11 % 400
    seconds = 2 + records * 0.25 + bytes_ * 0.125 + k % 7
    kind = F.when(k % 3 == 0, "r").otherwise("m")
    fields = [F.concat(F.lit("t"), (F.col("o_custkey") % 2).cast("string")), F.lit("job"), kind, k.cast("string"), seconds.cast("string"), bytes_.cast("string"), records.cast("string"), F.when(k % 3 == 0, "9").otherwise(""), F.when((k * 10 >= top * 4) & (k * 10 < top * 7), "B").otherwise("A")]
    path = sources.scratch(spark, "cost-log")
    # files' names are in the order of the ranges
    t(spark, d, "orders").select("o_orderkey", "o_custkey").repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").select(F.concat_ws(",", *fields).alias("value")).write.text(path)
    runs = cost.log_runs(cost.parse_cost_log(sources.text_lines(spark, path)), "file", "offset")
    found = cost.map_models(cost.observations(runs))
    return found.select("tracker", "run", "class", "observations", rounded(F.col("intercept"), 4).alias("intercept"), rounded(F.col("per_record"), 6).alias("per_record"), rounded(F.col("per_byte"), 6).alias("per_byte"))


@query("""
    WITH m AS (SELECT avg(l_extendedprice) AS y, avg(l_quantity) AS a, avg(l_discount) AS b, covar_pop(l_quantity, l_quantity) AS aa, covar_pop(l_discount, l_discount) AS bb, covar_pop(l_quantity, l_discount) AS ab,
               covar_pop(l_quantity, l_extendedprice) AS ay, covar_pop(l_discount, l_extendedprice) AS byy FROM lineitem),
    s AS (SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS s1, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS s2 FROM m)
    SELECT round(y - s1 * a - s2 * b, 2) AS intercept, round(s1, 3) AS per_quantity, round(s2, 2) AS per_discount FROM s
""")
def ols_multi(spark, d):
    """Coefficients by the normal equations of distributed sums."""
    b = cost.fit(t(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    return spark.createDataFrame([(round(b[0], 2), round(b[1], 3), round(b[2], 2))], "intercept double, per_quantity double, per_discount double")


@query("""
    WITH m AS (SELECT avg(l_extendedprice) AS y, avg(l_quantity) AS a, avg(l_discount) AS b, avg(l_tax) AS c, covar_pop(l_quantity, l_quantity) AS aa, covar_pop(l_discount, l_discount) AS bb, covar_pop(l_tax, l_tax) AS cc,
               covar_pop(l_quantity, l_discount) AS ab, covar_pop(l_quantity, l_tax) AS ac, covar_pop(l_discount, l_tax) AS bc, covar_pop(l_quantity, l_extendedprice) AS ay, covar_pop(l_discount, l_extendedprice) AS byy, covar_pop(l_tax, l_extendedprice) AS cy FROM lineitem),
    d AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS whole FROM m),
    s AS (SELECT *, (ay * (bb * cc - bc * bc) - ab * (byy * cc - bc * cy) + ac * (byy * bc - bb * cy)) / whole AS s1, (aa * (byy * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - byy * ac)) / whole AS s2,
                 (aa * (bb * cy - byy * bc) - ab * (ab * cy - byy * ac) + ay * (ab * bc - bb * ac)) / whole AS s3 FROM d)
    SELECT round(y - s1 * a - s2 * b - s3 * c, 2) AS intercept, round(s1, 3) AS per_quantity, round(s2, 2) AS per_discount, round(s3, 2) AS per_tax FROM s
""")
def ols_three_regressors(spark, d):
    """The same with three, as for a reduce."""
    b = cost.fit(t(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return spark.createDataFrame([(round(b[0], 2), round(b[1], 3), round(b[2], 2), round(b[3], 2))], "intercept double, per_quantity double, per_discount double, per_tax double")


@query("SELECT c % 50 AS span, round(2.7861694 + 2.4023880e-6 * sum(n) + 9.1139572e-8 * sum(b), 9) AS seconds FROM (SELECT o_custkey AS c, count(*) AS n, sum(strlen(CAST(o_orderkey AS VARCHAR))) AS b FROM orders GROUP BY o_custkey) GROUP BY 1")
def incremental_cost(spark, d):
    """The cost of ranges of partitions, the intercept once a range."""
    parts = statistics.key_histogram(t(spark, d, "orders"), ["o_custkey"], fx.record_bytes("o_orderkey")).withColumn("span", F.col("o_custkey") % 50)
    return parts.groupBy("span").agg(rounded(cost.PRESETS["pagerank-reduce"].column(F.sum("records"), F.sum("bytes")), 9).alias("seconds"))


# ------------------------------------------------------------ planned execution


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def fallback_redo(spark, d):
    """A task that stopped without saying where is done again as a whole; what it had written is left out."""
    rows, counts = t(spark, d, "orders"), [F.count(F.lit(1)).alias("n")]
    done = rows.where("o_custkey < 30").groupBy("o_custkey").agg(*counts)
    return reactive.resumed_or_redone(done, rows, "o_custkey", None, counts)


@query("SELECT l_partkey, count(*) AS n, round(sum(l_quantity), 4) AS qty FROM lineitem GROUP BY l_partkey")
def recursive_split(spark, d):
    """Ranges that are still too long are split again; the result is that of one aggregation."""
    found = reactive.aggregate_split_again(t(spark, d, "lineitem"), "l_partkey", [F.count(F.lit(1)).alias("n"), rounded(F.sum("l_quantity")).alias("qty")], line_bytes(), [0.0, 0.0, 0.0], 40_000)
    return found.drop("output")


@query("SELECT l_partkey, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem GROUP BY l_partkey")
def aggregate_if_skewed(spark, d):
    """Planned only where hashing would be uneven."""
    aggregates = [F.count(F.lit(1)).alias("n"), rounded(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("revenue")]
    return reactive.aggregate_if_skewed(t(spark, d, "lineitem"), "l_partkey", aggregates, line_bytes(), [0.0] * 4)
