import pytest
from pyspark.sql import functions as F

from evenkeel import catalog
from evenkeel import functions as fx
from evenkeel import operators as op
from evenkeel import sources
from evenkeel.operators import partitioners, samplers
from evenkeel.plans import cost, reactive

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("strategy", ["FIRST", "LINEAR", "LONGEST", "LONGEST2"])
def test_planned_aggregate_equals_plain(spark, strategy):
    lines = catalog.t(spark, SF, "lineitem")
    got = reactive.aggregate(lines, "l_partkey", [F.count(F.lit(1)).alias("n")], catalog.line_bytes(), [0.0, 0.0, 3.0], strategy)
    assert rows(got) == rows(lines.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")))


def test_planned_aggregate_moves_rows_once(spark):
    lines = catalog.t(spark, SF, "lineitem")
    placed, _ = reactive.placed(lines, "l_partkey", catalog.line_bytes(), [0.0] * 4)
    plan = placed.groupBy("pid", "l_partkey").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") - plan.count("ReusedExchange ") == 1


def test_null_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 1), (1, 2), (1, 3), (2, 4)], "k long, v long")
    got = reactive.aggregate(df, "k", [F.sum("v").alias("s")], fx.record_bytes("v"), [0.0, 0.0])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(None, 1), (1, 5), (2, 4)], key=str)
    assert reactive.aggregate(df.limit(0), "k", [F.sum("v").alias("s")], fx.record_bytes("v"), [0.0]).count() == 0


def test_range_ids_agree_with_the_driver(spark):
    bounds, exclude = [3, 7, 9], {1}
    got = spark.range(12).select("id", partitioners.range_id(F.col("id"), bounds, exclude).alias("p")).collect()
    assert all(r["p"] == partitioners.range_index(r["id"], bounds, exclude) for r in got)


def test_placement_is_exact(spark):
    got = partitioners.place(spark.range(100), F.col("id") % 7, 7).select("pid", F.spark_partition_id().alias("at")).distinct().collect()
    assert len(got) == 7 and all(r["pid"] == r["at"] for r in got)


def test_consecutive_groups_repeat(spark):
    df = spark.createDataFrame(list(enumerate([2, 3, 3, 4, 6, 7, 9])), "i long, v long").withColumn("k", F.floor(F.col("v") / 3)).withColumn("s", F.lit(0))
    got = op.consecutive_groups(df, ["s"], ["i"], "k").groupBy("run", "k").agg(F.array_sort(F.collect_list("v")).alias("v")).orderBy("run").collect()
    assert [(r["k"], r["v"]) for r in got] == [(0, [2]), (1, [3, 3, 4]), (2, [6, 7]), (3, [9])]


def test_salted_and_plain_joins_agree(spark):
    left = spark.range(50).select((F.col("id") % 3).alias("k"), "id")
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    assert rows(op.salted_join(left, right, "k", 4, F.col("id"))) == rows(left.join(right, "k"))


def test_sources_round_trip(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.createDataFrame([("one",), ("a" * 50,), ("two",)], "value string").coalesce(1).write.text(path)
    assert [r["value"] for r in sources.text_lines(spark, path, 10).collect()] == ["one", "two"]
    assert sorted(r["length"] for r in sources.line_lengths(spark, path).collect()) == [3, 3, 50]
    pairs = str(tmp_path / "pairs")
    sources.write_sequence(spark.createDataFrame([("k", "v"), ("x", "y")], "k string, v string"), pairs, "k", "v")
    assert rows(sources.sequence_records(spark, pairs)) == [(bytearray(b"k"), bytearray(b"v")), (bytearray(b"x"), bytearray(b"y"))]


def test_every_sized_suffix(spark):
    df = spark.createDataFrame([("64",), ("8k",), ("2G",), ("1P",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(fx.parse_size(F.col("s"))).collect()] == [64, 8192, 2 << 30, 1 << 50, None, None]


def test_split_points_over_all_rows(spark):
    for values, n in (([1, 1, 1, 1, 2, 3, 4, 5], 4), ([7] * 90 + list(range(10)), 8), ([5] * 8, 4), (list(range(1000, 0, -1)), 8), ([1, 2, 2, 2, 2, 2, 2, 9], 8)):
        assert samplers.split_points_of(spark.createDataFrame([(v,) for v in values], "v long"), "v", n) == samplers.split_points(values, n)
    # keys that depend on the class of the order: one class alone has other quantiles
    orders = catalog.t(spark, SF, "orders")
    want = samplers.split_points([r[0] for r in orders.select("o_custkey").collect()], 8)
    assert [r["point"] for r in catalog.QUERIES["split_points"](spark, SF).orderBy("part").collect()] == want


def test_lines_have_their_byte_offsets_in_every_range(spark, tmp_path):
    lines = [f"line {i} " + "é" * (i % 23) for i in range(400)] + ["", "last"]
    (tmp_path / "f.txt").write_bytes("\n".join(lines).encode() + b"\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    try:
        found = sources.text_lines(spark, str(tmp_path / "f.txt")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    at, want = 0, []
    for line in lines:
        want.append((at, line))
        at += len(line.encode()) + 1
    assert sorted((r["offset"], r["value"]) for r in found) == want


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def most_in_a_task(df):
    """The largest share of the rows that one task holds."""
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("at")).count().collect()]
    return max(counts) / sum(counts)


def test_a_file_range_is_numbered_by_several_tasks(uncoalesced, tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "CHUNK", 4, raising=False)
    lines = [f"line {i} " + "é" * (i % 23) for i in range(2000)]
    (tmp_path / "f.txt").write_bytes("\n".join(lines).encode() + b"\n")
    found = sources.text_lines(uncoalesced, str(tmp_path / "f.txt"))
    at, want = 0, []
    for line in lines:
        want.append((at, line))
        at += len(line.encode()) + 1
    assert sorted((r["offset"], r["value"]) for r in found.collect()) == want
    assert most_in_a_task(found) < 0.6


def test_stretches_of_a_log_go_on_over_slices_and_files(uncoalesced):
    classes = ["A"] * 40 + ["B"] * 3 + [None] * 2 + ["A"] * 90 + ["B", "A"] * 20 + ["C"] * 200
    log = [(f"t{i % 3 % 2}", f"part-{i // 100}", i % 100 * 10, c, i) for i, c in enumerate(classes)]
    df = uncoalesced.createDataFrame(log, "tracker string, file string, offset long, class string, i long").repartition(4)
    runs, held, want = {}, {}, {}
    for tracker, _, _, c, i in log:
        if tracker not in runs or held[tracker] != c:
            runs[tracker] = runs.get(tracker, 0) + 1
        held[tracker], want[i] = c, runs[tracker]
    for slice_bytes in (10, 70, 1 << 20):
        got = cost.log_runs(df, "file", "offset", slice_bytes)
        assert {r["i"]: r["run"] for r in got.collect()} == want
    one = cost.log_runs(df.withColumn("tracker", F.lit("t")), "file", "offset", 70)
    assert most_in_a_task(one) < 0.6


def test_a_partition_is_sorted_by_several_tasks(uncoalesced):
    # half of the rows lie in one partition, and most of these have one key
    keys = [(0 if i % 2 else None if i % 6 == 0 else i % 3 - 3, 7 if i % 20 else i, i) for i in range(4000)]
    df = uncoalesced.createDataFrame(keys, "p int, k long, i long").repartition(3)
    got = op.sorted_by_partition(df, F.col("p"), ["k"]).select("p", "pid", "k", "i", "place", F.spark_partition_id().alias("at")).collect()
    assert sorted(r["i"] for r in got) == list(range(4000)) and all(r["p"] == r["pid"] for r in got)
    for pid in (None, -2, -1, 0):
        own = [r for r in got if r["pid"] == pid]
        # as handed over, partition by partition
        assert [r["place"] for r in own] == list(range(len(own)))
        assert [r["k"] for r in own] == sorted(k for p, k, _ in keys if p == pid)
    counts = {}
    for r in got:
        counts[r["at"]] = counts.get(r["at"], 0) + 1
    assert len(got) == 4000 and max(counts.values()) < 0.45 * 4000


def test_map_output_is_read_by_key(spark, tmp_path):
    path = str(tmp_path / "out")
    rows_ = spark.range(1000).select((F.col("id") % 50).alias("k"), "id")
    sources.write_map_output(rows_, path, F.col("k") % 4, ["k"])
    read = sources.read_map_output(spark, path, 2, "k", 10, 30)
    assert rows(read) == sorted((i % 50, i) for i in range(1000) if i % 50 % 4 == 2 and 10 < i % 50 <= 30)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(pid" in plan and "GreaterThan(k,10), LessThanOrEqual(k,30)" in plan


def test_map_output_is_written_by_several_tasks(uncoalesced, tmp_path):
    path = str(tmp_path / "out")
    # most rows lie in one partition, and most of these have one key
    rows_ = uncoalesced.range(6000).select(F.when(F.col("id") % 4 > 0, 8).otherwise(F.col("id") % 50).alias("k"), "id").repartition(3)
    sources.write_map_output(rows_, path, F.col("k") % 4, ["k"])
    assert rows(uncoalesced.read.parquet(path).select("k", "id")) == rows(rows_)
    files = list((tmp_path / "out" / "pid=0").glob("*.parquet"))
    held = [[r["k"] for r in uncoalesced.read.parquet(str(f)).coalesce(1).collect()] for f in files]
    assert all(k == sorted(k) for k in held) and max(map(len, held)) < 0.4 * 6000
    ends = sorted((k[0], k[-1]) for k in held)
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    assert rows(sources.read_map_output(uncoalesced, path, 0, "k", 4, 8)) == sorted((r["k"], r["id"]) for r in rows_.collect() if r["k"] == 8)


def test_ranges_of_a_hot_key_are_not_gathered_again(spark, tmp_path):
    path = str(tmp_path / "out")
    # adaptive execution may coalesce, and these rows take few bytes
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true"
    rows_ = spark.range(6000).select(F.when(F.col("id") % 4 > 0, 8).otherwise(F.col("id") % 50).alias("k"), "id").repartition(3)
    sources.write_map_output(rows_, path, F.col("k") % 4, ["k"])
    held = [spark.read.parquet(str(f)).count() for f in (tmp_path / "out" / "pid=0").glob("*.parquet")]
    assert max(held) < 0.4 * 6000
    assert rows(spark.read.parquet(path).select("k", "id")) == rows(rows_)


def test_keys_are_read_from_all_files_of_a_partition(uncoalesced, tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "scratch", lambda spark, label: str(tmp_path / label))
    uncoalesced.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = catalog.QUERIES["reactive_map_output_keys"](uncoalesced, SF)
    finally:
        uncoalesced.conf.set("spark.sql.shuffle.partitions", "4")
    files = list((tmp_path / "map-output" / "pid=1").glob("*.parquet"))
    held = [uncoalesced.read.parquet(str(f)).count() for f in files]
    assert sum(held) == catalog.t(uncoalesced, SF, "lineitem").where("l_partkey % 4 = 1").count() and max(held) < 0.75 * sum(held)
    assert "ReadSchema: struct<l_partkey:bigint,rec_bytes:bigint>" in got._jdf.queryExecution().executedPlan().toString()


def test_jobs_are_submitted_and_killed(spark):
    import time

    job = op.Job(group=["k"], reduce=[F.count(F.lit(1)).alias("n")])
    df = spark.range(10).select((F.col("id") % 2).alias("k"))
    assert sorted(map(tuple, job.submit(df, lambda x: x.collect()).result(60))) == [(0, 5), (1, 5)]
    slow = op.Job(group=["k"], reduce=[F.count(F.lit(1)).alias("n")], mapper=lambda x: x.where(F.expr("java_method('java.lang.Thread', 'sleep', 2000L) is null")))
    handle = slow.submit(spark.range(0, 40, 1, 4).select((F.col("id") % 2).alias("k")), lambda x: x.collect())
    time.sleep(3)
    handle.kill()
    with pytest.raises(Exception, match="cancel"):
        handle.result(60)


def test_a_plan_is_made_only_where_hashing_is_uneven(spark):
    even = spark.range(4000).select((F.col("id") % 500).alias("k"))
    hot = even.withColumn("k", F.when(F.col("k") < 400, 7).otherwise(F.col("k")))
    size = fx.record_bytes("k")
    assert not reactive.is_skewed(even, "k", size, 4) and reactive.is_skewed(hot, "k", size, 4)
    count = [F.count(F.lit(1)).alias("n")]
    assert rows(reactive.aggregate_if_skewed(hot, "k", count, size, [0.0] * 4)) == rows(hot.groupBy("k").agg(*count))
    assert not reactive.is_skewed(even.limit(0), "k", size, 4)


def test_ranges_that_are_too_long_are_split_again(spark):
    lines = catalog.t(spark, SF, "lineitem")
    count = [F.count(F.lit(1)).alias("n")]
    got = reactive.aggregate_split_again(lines, "l_partkey", count, catalog.line_bytes(), [0.0, 0.0], 8_000)
    assert rows(got.drop("output")) == rows(lines.groupBy("l_partkey").agg(*count))
    names = {r[0] for r in got.select("output").distinct().collect()}
    assert any(n.count(".") for n in names) and all(n.startswith("r-") for n in names)
    ends = got.groupBy("output").agg(F.min("l_partkey").alias("a"), F.max("l_partkey").alias("b")).orderBy("a").collect()
    assert all(x["b"] < y["a"] for x, y in zip(ends, ends[1:]))


def test_no_local_folder_on_a_cluster():
    class Cluster:
        master = "yarn"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Cluster
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: None)})

    with pytest.raises(RuntimeError, match="checkpoint"):
        sources.shared_dir(Session)


def test_clusters_are_sampled_by_the_falling_rate(spark):
    orders = catalog.t(spark, SF, "orders")
    got = samplers.random_sample(orders, "o_orderkey", F.col("o_custkey") % 6, F.rand(1), F.floor(F.rand(2) * 20), ["o_orderkey"], 0.5, 20, 2).collect()
    assert len({r["o_orderkey"] for r in got}) == 20


@pytest.fixture(scope="module")
def tables():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    return con


def plain(value):
    import decimal

    return float(value) if isinstance(value, decimal.Decimal) else bytes(value) if isinstance(value, bytearray) else value


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_its_sql(spark, tables, name):
    df = catalog.QUERIES[name](spark, SF)
    want = tables.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    norm = lambda rows_: sorted((tuple(plain(v) for v in r) for r in rows_), key=str)
    assert norm(df.select(*[f"`{c}`" for c in columns]).collect()) == norm(want.fetchall())
