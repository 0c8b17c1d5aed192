"""One query for each operator, over the driver's tables, with equivalent SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import functions as fx
from . import operators as op
from .operators import intervals, partitioners, samplers, statistics
from .plans import cost, planner, reactive
from .sources import materialized
from .streaming import progress, straggler

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def line_bytes():
    return fx.record_bytes("l_orderkey", "l_partkey", "l_linenumber")


SQL_LINE_BYTES = "strlen(CAST(l_orderkey AS VARCHAR)) + strlen(CAST(l_partkey AS VARCHAR)) + strlen(CAST(l_linenumber AS VARCHAR))"


def rounded(x, n: int = 4):
    return F.round(x, n)


# ------------------------------------------------------------ map, filter


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS revenue FROM lineitem")
def map_project(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rounded(revenue()).alias("revenue"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 10 AND l_shipdate >= TIMESTAMP '1995-01-01'")
def map_filter(spark, d):
    return t(spark, d, "lineitem").where("l_quantity < 10 and l_shipdate >= timestamp '1995-01-01'").select("l_orderkey", "l_linenumber")


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def map_flatmap_words(spark, d):
    words = t(spark, d, "documents").select(F.explode(F.split(F.lower("text"), " ", -1)).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM nation")
def identity_map(spark, d):
    return t(spark, d, "nation")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey > 100 AND l_partkey <= 300")
def key_range_filter(spark, d):
    return t(spark, d, "lineitem").where(op.key_range(F.col("l_partkey"), 100, 300)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT count(*) FILTER (WHERE l_partkey > 100 AND l_partkey <= 300) AS kept, count(*) FILTER (WHERE NOT (l_partkey > 100 AND l_partkey <= 300)) AS skipped FROM lineitem")
def skipped_counter(spark, d):
    return op.kept_and_skipped(t(spark, d, "lineitem"), op.key_range(F.col("l_partkey"), 100, 300))


@query("SELECT CAST(strlen(text) AS BIGINT) AS length, count(*) AS n FROM documents GROUP BY 1")
def line_lengths(spark, d):
    return t(spark, d, "documents").groupBy(F.octet_length("text").cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CAST(strlen(coalesce(source, '')) AS BIGINT) AS key_len, CAST(strlen(coalesce(text, '')) AS BIGINT) AS val_len, CAST(strlen(coalesce(source, '')) + strlen(coalesce(text, '')) AS BIGINT) AS rec_len FROM documents")
def record_lengths(spark, d):
    size = lambda c: F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    return t(spark, d, "documents").select("doc_id", size("source").alias("key_len"), size("text").alias("val_len"), (size("source") + size("text")).alias("rec_len"))


@query(f"SELECT l_partkey, CAST({SQL_LINE_BYTES} AS BIGINT) AS rec_bytes FROM lineitem")
def key_only_scan(spark, d):
    from .sources import key_sizes

    return key_sizes(t(spark, d, "lineitem"), ["l_partkey"], line_bytes())


# ------------------------------------------------------------ reduce


@query("SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem GROUP BY l_suppkey")
def reduce_sum(spark, d):
    return op.Job(group=["l_suppkey"], reduce=[rounded(F.sum(revenue())).alias("revenue")]).run(t(spark, d, "lineitem"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, min(l_discount) AS min_disc, max(l_tax) AS max_tax, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def reduce_multi_agg(spark, d):
    job = op.Job(group=["l_returnflag", "l_linestatus"], reduce=[rounded(F.sum("l_quantity")).alias("sum_qty"), rounded(F.avg("l_extendedprice")).alias("avg_price"), F.min("l_discount").alias("min_disc"), F.max("l_tax").alias("max_tax"), F.count(F.lit(1)).alias("n")])
    return job.run(t(spark, d, "lineitem"))


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def reduce_count_distinct(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def combiner_two_stage(spark, d):
    return op.combined(t(spark, d, "lineitem"), ["l_returnflag"], 16, F.col("l_orderkey"), [F.sum("l_extendedprice").alias("s"), F.count(F.lit(1)).alias("c")], [rounded(F.sum("s"), 2).alias("total"), F.sum("c").alias("n")])


@query("SELECT user_id, arg_min(event_type, ts_id) AS first_value, arg_max(event_type, ts_id) AS last_value, count(*) AS n FROM (SELECT *, struct_pack(ts := ts, event_id := event_id) AS ts_id FROM events) GROUP BY user_id")
def secondary_sort_first_last(spark, d):
    return op.first_and_last(t(spark, d, "events"), ["user_id"], F.struct("ts", "event_id"), "event_type")


@query("SELECT o_custkey % 100 AS bucket, count(*) AS n, min(o_custkey) AS low, max(o_custkey) AS high FROM orders GROUP BY 1")
def group_override_compare(spark, d):
    rows = t(spark, d, "orders").withColumn("bucket", F.col("o_custkey") % 100)
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("o_custkey").alias("low"), F.max("o_custkey").alias("high"))


@query("""
    WITH c AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM c)
    SELECT user_id, run, event_type, count(*) AS n FROM r GROUP BY user_id, run, event_type
""")
def consecutive_groups(spark, d):
    rows = op.consecutive_groups(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return rows.groupBy("user_id", "run", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS place FROM orders")
def total_order_rank(spark, d):
    """Ranges in order, ranks inside each, and the counts of the ranges before: no task sees all rows."""
    rows = materialized(t(spark, d, "orders").select("o_orderkey", "o_totalprice").repartitionByRange("o_totalprice", "o_orderkey").withColumn("slice", F.spark_partition_id()))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("slice").count().select("slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    w = Window.partitionBy("slice").orderBy("o_totalprice", "o_orderkey")
    return rows.join(F.broadcast(base), "slice").select("o_orderkey", (F.col("base") + F.row_number().over(w)).cast("long").alias("place"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk_bounded(spark, d):
    return op.top_k(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 10)


@query("SELECT l_returnflag, l_orderkey, l_linenumber, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rank FROM lineitem) WHERE rank <= 5")
def topk_per_group(spark, d):
    rows = op.top_k_per_group(t(spark, d, "lineitem"), ["l_returnflag"], [F.col("l_extendedprice").desc(), *map(F.col, ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))], 5)
    return rows.select("l_returnflag", "l_orderkey", "l_linenumber", "rank")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 3")
def circular_buffer_last_n(spark, d):
    return fx.last_rows(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], 3).select("user_id", "event_id")


# ------------------------------------------------------------ statistics


@query(f"SELECT l_partkey, count(*) AS records, CAST(sum({SQL_LINE_BYTES}) AS BIGINT) AS bytes FROM lineitem GROUP BY l_partkey")
def key_histogram(spark, d):
    return statistics.key_histogram(t(spark, d, "lineitem"), ["l_partkey"], line_bytes())


@query("SELECT source, count(*) AS records, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes FROM documents GROUP BY source")
def byte_histogram_by_source(spark, d):
    return statistics.key_histogram(t(spark, d, "documents"), ["source"], fx.record_bytes("text"))


@query("""
    WITH h AS (SELECT o_custkey, count(*) AS records, CAST(sum(strlen(CAST(o_orderkey AS VARCHAR))) AS BIGINT) AS bytes FROM orders GROUP BY o_custkey)
    SELECT o_custkey, records, bytes, CAST(row_number() OVER (ORDER BY o_custkey) - 1 AS BIGINT) AS lt_keys,
           CAST(sum(records) OVER (ORDER BY o_custkey) - records AS BIGINT) AS lt_records, CAST(sum(bytes) OVER (ORDER BY o_custkey) - bytes AS BIGINT) AS lt_bytes FROM h
""")
def lessthan_key_agg(spark, d):
    return statistics.less_than_key(statistics.key_histogram(t(spark, d, "orders"), ["o_custkey"], fx.record_bytes("o_orderkey")), "o_custkey")


@query("""
    WITH h AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes FROM documents),
    c AS (SELECT *, CAST((sum(bytes) OVER (ORDER BY doc_id) - 1) AS BIGINT) // 65536 AS bucket FROM h)
    SELECT bucket, min(doc_id) AS min_key, max(doc_id) AS max_key, count(*) AS num_keys, count(*) AS num_recs, CAST(sum(bytes) AS BIGINT) AS tot_bytes FROM c GROUP BY bucket
""")
def interval_buckets(spark, d):
    return statistics.byte_buckets(statistics.key_histogram(t(spark, d, "documents"), ["doc_id"], fx.record_bytes("text")), "doc_id", 65536)


INTERVAL_SQL = """SELECT o_custkey // 50 AS run, o_custkey % 50 // 10 AS begin, o_custkey % 50 // 10 + 10 AS "end", count(*) AS n, CAST(sum(o_orderkey % 97) AS BIGINT) AS b FROM orders GROUP BY 1, 2, 3"""


@query(f"""SELECT begin, "end", CAST(sum(n) AS BIGINT) AS begin_recs, CAST(sum(b) AS BIGINT) AS begin_bytes, CAST(sum(2 * n) AS BIGINT) AS mid_recs, CAST(sum(2 * b) AS BIGINT) AS mid_bytes,
        CAST(sum(n) AS BIGINT) AS end_recs, CAST(sum(b) AS BIGINT) AS end_bytes, CAST(max(n) AS BIGINT) AS mid_keys FROM ({INTERVAL_SQL}) GROUP BY begin, "end" """)
def interval_merge_max(spark, d):
    key = F.col("o_custkey")
    runs = t(spark, d, "orders").groupBy(F.floor(key / 50).alias("run"), F.floor(key % 50 / 10).alias("begin"), (F.floor(key % 50 / 10) + 10).alias("end")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_orderkey") % 97).alias("b"))
    n, b = F.col("n"), F.col("b")
    return statistics.merge_intervals(runs.select("begin", "end", n.alias("begin_recs"), b.alias("begin_bytes"), (2 * n).alias("mid_recs"), (2 * b).alias("mid_bytes"), n.alias("end_recs"), b.alias("end_bytes"), n.alias("mid_keys")))


@query("SELECT count(*) AS records, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes FROM documents")
def interval_sampling(spark, d):
    """Sampled intervals of the documents' sizes add up to all records and bytes."""
    found = intervals.sample_keys(statistics.key_histogram(t(spark, d, "documents"), ["doc_id"], fx.record_bytes("text")), "doc_id", 1 << 20)
    return found.agg(F.sum(F.expr("begin_recs + mid_recs + end_recs")).alias("records"), F.sum(F.expr("begin_bytes + mid_bytes + end_bytes")).alias("bytes"))


# ------------------------------------------------------------ samplers


@query("SELECT o_orderkey FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey % 8 ORDER BY o_orderkey) AS r, o_custkey % 8 AS s FROM orders) WHERE s % 2 = 0 AND r <= 25")
def split_sampler_n(spark, d):
    return samplers.split_sample(t(spark, d, "orders"), F.col("o_custkey") % 8, ["o_orderkey"], 100, 4).select("o_orderkey")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey % 8 ORDER BY o_orderkey) AS i FROM orders) WHERE (i + 7) // 8 > (i - 1 + 7) // 8")
def interval_sampler(spark, d):
    rows = t(spark, d, "orders").withColumn("split", F.col("o_custkey") % 8)
    return samplers.interval_sample(rows, ["split"], ["o_orderkey"], 1, 8).select("o_orderkey")


@query("""
    WITH s AS (SELECT o_custkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
    SELECT CAST(k AS INTEGER) AS part, o_custkey AS point FROM s, range(1, 8) AS r(k) WHERE i = CAST(floor(n * k / 8.0 + 0.5) AS BIGINT)
""")
def split_points(spark, d):
    """Points that cut all orders evenly by customer."""
    points = samplers.split_points_of(t(spark, d, "orders"), "o_custkey", 8)
    return spark.createDataFrame([(i + 1, p) for i, p in enumerate(points)], "part int, point long")


# ------------------------------------------------------------ partitioners


def _load(df, pid):
    return df.groupBy(pid.alias("pid")).agg(F.count(F.lit(1)).alias("records"))


@query("SELECT CAST(((o_custkey % 101) + 101) % 101 % 4 AS INTEGER) AS pid, count(*) AS records FROM orders GROUP BY 1")
def partition_double_hash(spark, d):
    return _load(t(spark, d, "orders"), partitioners.double_hash_id(F.col("o_custkey"), 101, 4))


@query("SELECT CASE WHEN o_custkey % 101 < 40 THEN 2 WHEN o_custkey % 101 < 81 THEN 0 ELSE 1 END AS pid, count(*) AS records FROM orders GROUP BY 1")
def partition_rehash_weighted(spark, d):
    made = planner.rehash([0.0, 0.0, 10.0], 50.0, 50)
    return _load(t(spark, d, "orders"), partitioners.rehash_id(F.col("o_custkey"), made.prime, made.cumulative, [2, 0, 1]))


@query("SELECT CAST(o_custkey % 16 % 5 AS INTEGER) AS pid, count(*) AS records FROM orders GROUP BY 1")
def partition_delegate(spark, d):
    return _load(t(spark, d, "orders"), partitioners.delegate_id(F.col("o_custkey"), 16, 5))


@query("SELECT 3 AS pid, count(*) AS records FROM orders")
def partition_single(spark, d):
    return _load(t(spark, d, "orders"), partitioners.single_id(4))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey <= 50 THEN 3 WHEN l_partkey < 100 THEN 0 WHEN l_partkey <= 150 THEN 1 ELSE 2 END AS pid FROM lineitem")
def partition_range_exclusive(spark, d):
    pid = partitioners.range_id(F.col("l_partkey"), [50, 100, 150], {0, 2}, [3, 0, 1, 2])
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", pid.alias("pid"))


@query(f"SELECT CAST(l_partkey % 103 % 7 AS INTEGER) AS pid, count(*) AS records, CAST(sum({SQL_LINE_BYTES}) AS BIGINT) AS bytes FROM lineitem GROUP BY 1")
def partition_load_report(spark, d):
    return partitioners.load(t(spark, d, "lineitem"), partitioners.double_hash_id(F.col("l_partkey"), 103, 7), line_bytes())


@query("SELECT CAST(o_custkey % 5 AS INTEGER) AS pid, CAST(o_custkey % 5 AS INTEGER) AS place, count(*) AS n FROM orders GROUP BY 1, 2")
def partition_placement(spark, d):
    rows = partitioners.place(t(spark, d, "orders"), F.col("o_custkey") % 5, 5)
    return rows.select("pid", F.spark_partition_id().alias("place")).groupBy("pid", "place").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------ cost and plans


@query(f"SELECT l_partkey, round(5e-7 * sum({SQL_LINE_BYTES}), 9) AS seconds FROM lineitem GROUP BY l_partkey")
def cost_time_per_byte(spark, d):
    return statistics.key_histogram(t(spark, d, "lineitem"), ["l_partkey"], line_bytes()).select("l_partkey", rounded(cost.LinearCost(planner.FALLBACK).column(F.col("records"), F.col("bytes")), 9).alias("seconds"))


@query(f"SELECT l_partkey, round(8.1152477 + 1.3161168e-3 * count(*) + 4.5103178e-6 * sum({SQL_LINE_BYTES}), 6) AS seconds FROM lineitem GROUP BY l_partkey")
def cost_linear_map(spark, d):
    return statistics.key_histogram(t(spark, d, "lineitem"), ["l_partkey"], line_bytes()).select("l_partkey", rounded(cost.PRESETS["alignment-map"].column(F.col("records"), F.col("bytes")), 6).alias("seconds"))


@query(f"SELECT l_suppkey, round(2.7861694 + 2.4023880e-6 * count(*) + 9.1139572e-8 * sum({SQL_LINE_BYTES}) + 1.6168926e-7 * count(DISTINCT l_partkey), 6) AS seconds FROM lineitem GROUP BY l_suppkey")
def cost_linear_reduce(spark, d):
    rows = t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("r"), F.sum(line_bytes()).alias("b"), F.count_distinct("l_partkey").alias("k"))
    return rows.select("l_suppkey", rounded(cost.PRESETS["pagerank-reduce"].column(F.col("r"), F.col("b"), F.col("k")), 6).alias("seconds"))


@query("SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem")
def ols_single(spark, d):
    b = cost.fit(t(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    return spark.createDataFrame([(round(b[0], 4), round(b[1], 4))], "intercept double, slope double")


@query("SELECT round(sum(l_quantity * l_discount), 4) AS s_qd, round(sum(l_quantity * l_quantity), 4) AS s_qq, round(sum(l_discount * l_discount), 4) AS s_dd, round(sum(l_quantity * l_extendedprice), 2) AS t_q FROM lineitem")
def ols_moments(spark, d):
    """The sums that the normal equations need."""
    return cost.moments(t(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"]).select(rounded(F.col("s_1_2")).alias("s_qd"), rounded(F.col("s_1_1")).alias("s_qq"), rounded(F.col("s_2_2")).alias("s_dd"), rounded(F.col("t_1"), 2).alias("t_q"))


@query("SELECT l_partkey, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem GROUP BY l_partkey")
def skew_planned_aggregate(spark, d):
    return reactive.aggregate(t(spark, d, "lineitem"), "l_partkey", [F.count(F.lit(1)).alias("n"), rounded(F.sum(revenue())).alias("revenue")], line_bytes(), [0.0] * 4)


@query("SELECT doc_id, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes FROM documents GROUP BY doc_id")
def skew_planned_text_bytes(spark, d):
    size = fx.record_bytes("text")
    return reactive.aggregate(t(spark, d, "documents").select("doc_id", "text"), "doc_id", [F.sum(size).alias("bytes")], size, [0.0] * 8, "LONGEST2")


@query("SELECT 1 + least(l_partkey, 40) AS key, count(*) AS n FROM lineitem GROUP BY 1")
def skew_planned_hot_key(spark, d):
    """One key holds almost all rows: it gets a range of its own."""
    rows = t(spark, d, "lineitem").withColumn("key", 1 + F.least(F.col("l_partkey"), F.lit(40)))
    return reactive.aggregate(rows, "key", [F.count(F.lit(1)).alias("n")], line_bytes(), [0.0] * 4, "LONGEST")


@query("SELECT l_partkey, CAST(sum(l_quantity) AS DOUBLE) AS qty FROM lineitem GROUP BY l_partkey")
def resume_from_key(spark, d):
    rows, sums = t(spark, d, "lineitem"), [F.sum("l_quantity").alias("qty")]
    done = rows.where(op.key_range(F.col("l_partkey"), None, 120)).groupBy("l_partkey").agg(*sums)
    return reactive.resumed(done, rows, "l_partkey", 120, sums)


# ------------------------------------------------------------ progress and stragglers

STATUS_SQL = """
    SELECT event_id % 7 AS job, event_id % 199 AS task, CASE WHEN event_id % 199 % 3 = 0 THEN 'r' ELSE 'm' END AS type, event_id AS attempt,
           (event_id * 37 % 100) / 100.0 AS progress, CAST(30000 + event_id * 7919 % 600000 AS BIGINT) AS passed_ms, CAST(1000 + event_id * 31 % 5000 AS BIGINT) AS processed,
           CASE event_id % 3 WHEN 0 THEN 'SHUFFLE' WHEN 1 THEN 'SORT' ELSE 'REDUCE' END AS phase, event_id % 3 AS phase_rank,
           CASE WHEN event_id % 11 = 0 THEN 'COMPLETE' WHEN event_id % 13 = 0 THEN 'TAKEOVER' WHEN event_id % 17 = 0 THEN 'PENDING' ELSE 'RUNNING' END AS state
    FROM events
"""


def status(spark, d) -> DataFrame:
    e = F.col("event_id")
    return t(spark, d, "events").select(
        (e % 7).alias("job"), (e % 199).alias("task"), F.when(e % 199 % 3 == 0, "r").otherwise("m").alias("type"), e.alias("attempt"), ((e * 37 % 100) / 100).alias("progress"),
        (30000 + e * 7919 % 600000).alias("passed_ms"), (1000 + e * 31 % 5000).alias("processed"), F.when(e % 3 == 0, "SHUFFLE").when(e % 3 == 1, "SORT").otherwise("REDUCE").alias("phase"), (e % 3).alias("phase_rank"),
        F.when(e % 11 == 0, "COMPLETE").when(e % 13 == 0, "TAKEOVER").when(e % 17 == 0, "PENDING").otherwise("RUNNING").alias("state"),
    )


SQL_LEFT = "(CAST(passed_ms AS DOUBLE) / 1000 / greatest(CAST(1e-5 AS DOUBLE), CAST(progress AS DOUBLE)) - CAST(passed_ms AS DOUBLE) / 1000)"


@query(f"""SELECT attempt, round(CASE phase WHEN 'SHUFFLE' THEN {SQL_LEFT} + 2 * (CAST(passed_ms AS DOUBLE) / 1000 + {SQL_LEFT}) WHEN 'SORT' THEN {SQL_LEFT} + (CAST(passed_ms AS DOUBLE) / 1000 + {SQL_LEFT}) ELSE {SQL_LEFT} END, 3) AS remaining FROM ({STATUS_SQL})""")
def remaining_time_phases(spark, d):
    return status(spark, d).select("attempt", rounded(progress.by_phase(F.col("phase"), F.col("passed_ms") / 1000, F.col("progress")), 3).alias("remaining"))


@query(f"SELECT type, round(coalesce(avg(CASE WHEN processed = 0 THEN 0 ELSE CAST(passed_ms AS DOUBLE) / processed * 0.001 END), 0), 6) AS per_byte FROM ({STATUS_SQL}) GROUP BY type")
def time_per_byte_avg(spark, d):
    return status(spark, d).groupBy("type").agg(rounded(fx.mean_or_zero(progress.time_per_byte(F.col("passed_ms"), F.col("processed"))), 6).alias("per_byte"))


@query(f"SELECT attempt, round(CASE WHEN passed_ms = 0 THEN 0.0 ELSE (passed_ms - (400000 - processed)) * CAST(0.001 AS DOUBLE) END, 3) AS remaining FROM ({STATUS_SQL})")
def remaining_now(spark, d):
    return status(spark, d).select("attempt", rounded(progress.remaining_now(F.col("passed_ms"), F.col("processed"), F.lit(400000)), 3).alias("remaining"))


@query(f"SELECT attempt, CAST(floor(CAST(10000 - processed AS DOUBLE) / CAST(processed AS DOUBLE) * (CAST(passed_ms AS DOUBLE) / 1000) + 1e-6) AS BIGINT) AS reduce_left, CAST(floor(CAST(passed_ms AS DOUBLE) / CAST(processed AS DOUBLE) * 0.001 * (10000 - processed) + CASE WHEN phase_rank > 1 THEN 4.0 WHEN phase_rank > 0 THEN 2.0 ELSE 0.5 END + 1e-6) AS BIGINT) AS map_left FROM ({STATUS_SQL})")
def remaining_map_and_reduce(spark, d):
    sort = progress.sort_estimate(F.col("phase_rank"), 1, F.lit(2.0), F.lit(1000.0), F.lit(0.0005))
    left = progress.map_phase(progress.time_per_byte(F.col("passed_ms"), F.col("processed")), 10000 - F.col("processed"), sort)
    return status(spark, d).select("attempt", F.floor(progress.reduce_phase(F.col("passed_ms") / 1000, F.lit(10000), F.col("processed"), F.col("processed")) + 1e-6).alias("reduce_left"), F.floor(left + 1e-6).alias("map_left"))


def attempts(spark, d) -> DataFrame:
    rows = status(spark, d).withColumn("remaining", progress.generic(F.col("passed_ms") / 1000, F.col("progress")))
    return rows.withColumn("reactive", F.col("task") % 23 == 0).withColumn("large_factor", F.when(F.col("task") % 5 == 0, (F.col("task") % 4).cast("double")))


CANDIDATES_SQL = f"""
    SELECT job, task, type, min({SQL_LEFT}) AS remaining FROM ({STATUS_SQL})
    WHERE state = 'RUNNING' AND task % 23 <> 0 AND passed_ms > 60000 AND (type <> 'm' OR task % 5 <> 0 OR task % 4 >= 2)
    GROUP BY job, task, type HAVING min({SQL_LEFT}) > 60
"""


@query(f"SELECT job, task, type, round(remaining, 3) AS remaining FROM ({CANDIDATES_SQL})")
def straggler_candidates(spark, d):
    return straggler.candidates(attempts(spark, d)).withColumn("remaining", rounded(F.col("remaining"), 3))


@query(f"SELECT job, type, task, round(remaining, 3) AS remaining FROM (SELECT *, row_number() OVER (PARTITION BY job, type ORDER BY round(remaining, 6) DESC, task) AS r FROM ({CANDIDATES_SQL})) WHERE r = 1")
def straggler_slowest(spark, d):
    found = straggler.candidates(attempts(spark, d)).withColumn("remaining", rounded(F.col("remaining"), 6))
    return straggler.slowest(found).select("job", "type", "task", rounded(F.col("remaining"), 3).alias("remaining"))


@query(f"WITH s AS ({STATUS_SQL}), m AS (SELECT job, bool_and(type <> 'm' OR state = 'COMPLETE') AS maps_done FROM s GROUP BY job) SELECT s.job, type, bool_and(state <> 'PENDING') AND (type = 'm' OR bool_and(maps_done)) AS ready FROM s JOIN m ON s.job = m.job GROUP BY s.job, type")
def straggler_precondition(spark, d):
    return straggler.ready(status(spark, d))


@query(f"SELECT job, count(*) FILTER (WHERE state NOT IN ('COMPLETE', 'TAKEOVER')) AS reserved FROM ({STATUS_SQL}) GROUP BY job")
def reserved_slots(spark, d):
    return straggler.reserved(status(spark, d))


@query(f"SELECT job, task, arg_max(attempt, struct_pack(a := phase_rank, b := progress, c := attempt)) AS attempt FROM ({STATUS_SQL}) GROUP BY job, task")
def attempt_to_split(spark, d):
    return straggler.attempt_to_split(status(spark, d))


@query("""
    WITH r AS (SELECT user_id, event_id, event_id * 3 AS records, event_id // 4 AS key_groups FROM events),
    x AS (SELECT *, records - coalesce(lag(records) OVER w, 0) AS d_records, key_groups - coalesce(lag(key_groups) OVER w, 0) AS d_key_groups FROM r WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, event_id, d_records, d_key_groups FROM x WHERE d_key_groups > 0
""")
def cost_report_delta(spark, d):
    rows = t(spark, d, "events").select("user_id", "event_id", (F.col("event_id") * 3).alias("records"), F.floor(F.col("event_id") / 4).alias("key_groups"))
    return progress.cost_deltas(rows, ["user_id"], ["event_id"], ["records"], "key_groups").select("user_id", "event_id", "d_records", "d_key_groups")


@query("""
    WITH o AS (SELECT o_custkey AS map, CASE o_orderkey % 4 WHEN 0 THEN 'original' WHEN 1 THEN 'speculative' WHEN 2 THEN 'takeover' ELSE 'partial' END AS source FROM orders),
    g AS (SELECT map, bool_or(source = 'original') AS o, bool_or(source = 'speculative') AS s, bool_or(source = 'takeover') AND bool_or(source = 'partial') AS t FROM o GROUP BY map)
    SELECT map, CASE WHEN o THEN 'original' WHEN s THEN 'speculative' ELSE 'takeover' END AS source FROM g WHERE o OR s OR t
""")
def takeover_merge_logic(spark, d):
    e = F.col("o_orderkey") % 4
    rows = t(spark, d, "orders").select(F.col("o_custkey").alias("map"), F.when(e == 0, "original").when(e == 1, "speculative").when(e == 2, "takeover").otherwise("partial").alias("source"))
    return straggler.complete_outputs(rows)


@query("""
    WITH r AS (SELECT source AS task, doc_id AS "offset", 1000000.0 / greatest(strlen(coalesce(text, '')), 1) AS factor FROM documents),
    x AS (SELECT *, min(factor) OVER (PARTITION BY task ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM r)
    SELECT task, "offset", round(CAST(factor AS DOUBLE), 4) AS factor FROM x WHERE least IS NULL OR factor < least
""")
def large_record_factor(spark, d):
    rows = t(spark, d, "documents").select(F.col("source").alias("task"), F.col("doc_id").alias("offset"), F.lit(1000000.0).alias("split_len"), F.greatest(F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(1)).alias("rec_len"))
    return straggler.factors(rows).select("task", "offset", rounded(F.col("factor")).alias("factor"))


# ------------------------------------------------------------ scalars


@query("SELECT c_custkey, lower(hex(c_name)) AS hexed, c_name AS back FROM customer")
def hex_unhex(spark, d):
    return t(spark, d, "customer").select("c_custkey", fx.to_hex(F.col("c_name")).alias("hexed"), fx.from_hex(fx.to_hex(F.col("c_name"))).cast("string").alias("back"))


@query("SELECT c_custkey, to_base64(encode(c_name)) AS coded, c_name AS back FROM customer")
def base64_roundtrip(spark, d):
    return t(spark, d, "customer").select("c_custkey", F.base64(F.encode("c_name", "UTF-8")).alias("coded"), F.unbase64(F.base64(F.encode("c_name", "UTF-8"))).cast("string").alias("back"))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) * CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 1073741824 END AS bytes FROM part")
def parse_size(spark, d):
    suffix = F.element_at(F.array(*map(F.lit, ["", "K", "m", "G"])), (F.col("p_size") % 4 + 1).cast("int"))
    return t(spark, d, "part").select("p_partkey", fx.parse_size(F.concat(F.col("p_size").cast("string"), suffix)).alias("bytes"))


@query("SELECT p_partkey, round(exp(-((p_size - 25) / 10.0) * ((p_size - 25) / 10.0) / 2) / (10.0 * sqrt(2 * pi())), 8) AS density FROM part")
def gaussian_pdf(spark, d):
    return t(spark, d, "part").select("p_partkey", rounded(fx.gaussian_pdf(F.col("p_size"), 25.0, 10.0), 8).alias("density"))


@query("SELECT c_custkey, printf('%.2f', c_acctbal) AS shown FROM customer")
def decimal_format(spark, d):
    return t(spark, d, "customer").select("c_custkey", F.format_string("%.2f", F.col("c_acctbal")).alias("shown"))


# ------------------------------------------------------------ extensions (no counterpart in the surveyed engine)


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000")
def ext_salted_join(spark, d):
    orders = t(spark, d, "orders").where("o_totalprice > 100000").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return op.salted_join(orders, t(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", 4, F.col("o_orderkey")).select("o_orderkey", "c_name")


@query("SELECT n_regionkey, count(DISTINCT n_nationkey) AS nations, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_regionkey")
def ext_reduce_side_join(spark, d):
    left = t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), "n_regionkey")
    right = t(spark, d, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey")
    stream = op.cogrouped(left, right, ["k"]).groupBy("k").agg(F.max("n_regionkey").alias("n_regionkey"), F.count("c_custkey").alias("c"), F.count_if(F.col("tag") == 0).alias("left"))
    return stream.where("left > 0").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("nations"), F.sum("c").alias("customers"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_cube(spark, d):
    return t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


from . import catalog_rules, catalog_sources  # noqa: E402, F401 - they register queries of their own
