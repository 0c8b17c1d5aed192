"""Queries of the planner's and the scheduler's rules: worked examples by hand, and rules over tables of status reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import functions as fx
from .catalog import STATUS_SQL, attempts, query, rounded, status, t
from .operators import intervals, partitioners, statistics
from .plans import cost, planner
from .streaming import progress, straggler


def values(*rows: str, columns: str) -> str:
    """SQL of a table of constants that were worked out by hand."""
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS v({columns})"


def parts(*sizes: int) -> list[planner.Part]:
    return [planner.Part(s, 1) for s in sizes]


# ------------------------------------------------------------ alignment


@query(values(
    "('k003', 'k003', false, false, 1, 4, 8)", "('k003', 'k007', true, true, 9, 9, 18)", "('k007', 'k007', false, false, 1, 4, 8)", "('k007', 'k050', true, true, 3, 3, 5)", "('k050', 'k050', false, false, 1, 3, 6)",
    "('k050', 'k095', true, true, 14, 17, 33)", "('k095', 'k095', false, false, 1, 6, 12)", "('k095', 'k100', true, true, 3, 3, 5)", "('k100', 'k100', false, false, 1, 2, 4)",
    columns="min_key, max_key, min_excl, max_excl, num_keys, num_recs, tot_bytes"))
def interval_alignment(spark, d):
    """Three overlapping intervals as disjoint partitions, against the trace that was worked out by hand."""
    given = [("k003", 4, 8, 9, 9, 18, "k007", 3, 6), ("k007", 1, 2, 10, 10, 20, "k100", 2, 4), ("k050", 2, 4, 14, 14, 28, "k095", 5, 10)]
    found = intervals.align([intervals.Interval(*x) for x in given])
    return spark.createDataFrame([tuple(vars(p).values()) for p in found], "min_key string, max_key string, min_excl boolean, max_excl boolean, num_keys int, num_recs int, tot_bytes int")


@query("""
    WITH h AS (SELECT count(*) AS n, CAST(sum(strlen(CAST(o_orderkey AS VARCHAR)) + strlen(CAST(o_custkey AS VARCHAR))) AS BIGINT) AS b, min(o_custkey) AS low, max(o_custkey) AS high FROM orders)
    SELECT low, high, true AS disjoint, true AS all_records, true AS all_bytes FROM h
""")
def interval_alignment_of_runs(spark, d):
    """Two runs of orders, sampled in some forty intervals each whatever their size, and aligned: nothing is lost but by rounding."""
    size = fx.record_bytes("o_orderkey", "o_custkey")
    rows = t(spark, d, "orders")
    h = rows.groupBy((F.col("o_orderkey") % 2).alias("run"), F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("records"), F.sum(size).alias("bytes"))
    total, n = rows.agg(F.sum(size), F.count(F.lit(1))).first()
    target = max(1, total // 80)
    found = intervals.align([intervals.Interval(*r[1:]) for r in intervals.sample_runs(h, "run", "key", target, start=target).collect()])
    order = [(p.min_key, p.min_excl) for p in found]
    near = lambda a, b: abs(a - b) <= len(found)
    row = (found[0].min_key, found[-1].max_key, order == sorted(set(order)), near(sum(p.num_recs for p in found), n), near(sum(p.tot_bytes for p in found), total))
    return spark.createDataFrame([row], "low long, high long, disjoint boolean, all_records boolean, all_bytes boolean")


# ------------------------------------------------------------ plans

#: Six partitions of 10, 10, 40, 10, 10 and 20 bytes over two idle slots, a second a byte: the optimal finish is 50.
#: FIRST and LINEAR take 10 + 10 + 40 (60 is nearer to 50 than 20) and leave 40. LONGEST begins with the 40, adds a 10,
#: begins with the 20, grows back over a 10, and leaves 10 + 10; LONGEST2 puts what is left on the slot done first (30).
#: LONGEST_MODEL adds 5 seconds a range, so it finishes at 52.5: 40 and a 10 make 55, and 50 at least is reached.
#: REHASH deals 211 (the prime above twice the 100 seconds of room) as 106 and 105.
PLANS_SQL = values(
    "('FIRST', 0, 0, 3, 60, 60.0, 0)", "('FIRST', 1, 3, 6, 40, 40.0, 1)", "('LINEAR', 0, 0, 3, 60, 60.0, 0)", "('LINEAR', 1, 3, 6, 40, 40.0, 1)",
    "('LONGEST', 0, 0, 2, 20, 20.0, 2)", "('LONGEST', 1, 2, 4, 50, 50.0, 0)", "('LONGEST', 2, 4, 6, 30, 30.0, 1)",
    "('LONGEST2', 0, 0, 2, 20, 20.0, 2)", "('LONGEST2', 1, 2, 4, 50, 50.0, 0)", "('LONGEST2', 2, 4, 6, 30, 30.0, 1)",
    "('LONGEST_MODEL', 0, 0, 2, 20, 25.0, 2)", "('LONGEST_MODEL', 1, 2, 4, 50, 55.0, 0)", "('LONGEST_MODEL', 2, 4, 6, 30, 35.0, 1)",
    "('MAXSLOTS', 0, 0, 1, 50, 50.0, 0)", "('MAXSLOTS', 1, 1, 2, 50, 50.0, 1)", "('REHASH', 0, 0, 1, 50, 50.2, 0)", "('REHASH', 1, 1, 2, 50, 49.8, 1)",
    columns="strategy, range, first, last, bytes, seconds, place")


@query(PLANS_SQL)
def plan_strategies(spark, d):
    """Every strategy's ranges of one example (`PLANS_SQL` says how they come about)."""
    out = []
    for name in planner.STRATEGIES:
        made = planner.plan(parts(10, 10, 40, 10, 10, 20), [0.0, 0.0], name, 1.0, cost.LinearCost(1.0, intercept=5.0), 2)
        out += [(name, i, r.start, r.end, r.bytes, round(r.time, 1), made.order.index(i)) for i, r in enumerate(made.ranges)]
    return spark.createDataFrame(out, "strategy string, range int, first int, last int, bytes int, seconds double, place int")


@query(values("(0, 0, 1, 10, 0.0, 0)", "(1, 1, 2, 60, 0.0, 1)", "(2, 2, 5, 30, 10.0, 0)", columns='range, first, last, bytes, "at", slot'))
def plan_isolated(spark, d):
    """LONGEST2 with a partition over the share of a slot (50): it gets a slot alone; the finish of the rest is estimated anew (40, on the other slot), the first 10 begins there, and what is left follows it at 10."""
    made = planner.plan(parts(10, 60, 10, 10, 10), [0.0, 0.0], "LONGEST2", 1.0)
    # slots that are free at the same time are told apart by number: the large partition takes slot 0
    rows = [(i, r.start, r.end, r.bytes, r.at, 1 - r.slot) for i, r in enumerate(made.ranges)]
    return spark.createDataFrame(rows, "range int, first int, last int, bytes int, at double, slot int")


@query(values("('forward', 0, 2)", "('passes', 0, 3)", "('stops', 0, 2)", "('back', 1, 4)", "('cost', 0, 3)", "('cost further', 0, 4)", "('cost back', 1, 4)", columns="example, low, high"))
def plan_segments(spark, d):
    """Ranges that are cut from partitions of 10, 10, 15 and 10 bytes.

    forward: 20 of a target of 20. passes: of a target of 28 the 35 is 7 over, 20 would be 8 under. stops: of a target of
    27 the 35 is 8 over, 20 is 7 under. back: from the 15 on to the end (25), then a 10 to the left (35 of 35).
    cost, with 5 a range: 20 is below 30, 5 + 35 passes it; further: the next one stays below 60; back: as before.
    """
    sizes, model = planner.Sizes(parts(10, 10, 15, 10), 1.0), planner.Sizes(parts(10, 10, 15, 10), 1.0, cost.LinearCost(1.0, intercept=5.0))
    whole = (0, 4)
    found = [
        ("forward", planner.segment(sizes, whole, 0, 20, 20)), ("passes", planner.segment(sizes, whole, 0, 28, 28)), ("stops", planner.segment(sizes, whole, 0, 27, 27)), ("back", planner.segment(sizes, whole, 2, 35, 35, True)),
        ("cost", planner.segment_by_cost(model, whole, 0, 30, 30)), ("cost further", planner.segment_by_cost(model, whole, 0, 30, 60)), ("cost back", planner.segment_by_cost(model, whole, 2, 35, 35, True)),
    ]
    return spark.createDataFrame([(n, *r) for n, r in found], "example string, low int, high int")


@query(values("(0, 2, 5)", "(1, 7, 9)", "(2, 2, 9)", "(4, 4, 9)", "(5, 2, 8)", columns="example, low, high"))
def plan_fragments(spark, d):
    """What is left of the gap [2, 9) without [5, 7); [9, 9); all; [2, 4); [8, 9)."""
    gap = (2, 9)
    left = [planner.without(gap, 5, 7), planner.without(gap, 9, 9), planner.without(gap, 2, 9), planner.without(gap, 2, 4), planner.without(gap, 8, 9)]
    rows = [(i, *g) for i, g in enumerate([*left[0], *left[1], *left[2]])] + [(4, *left[3][0]), (5, *left[4][0])]
    return spark.createDataFrame(rows, "example int, low int, high int")


@query(values("('idle and busy', 20.0, 3)", "('all busy', 10.0, 2)", "('too late', 10.0, 1)", "('nothing to do', 0.0, 2)", columns="example, finish, slots"))
def plan_optimal_time(spark, d):
    """Work 50 on slots free at 0, 0 and 10: 20 for the first two by then, 10 each for three. Work 10 on slots free at 5: 5 each. Work 10 before a slot free at 100. No work."""
    given = [("idle and busy", [0.0, 0.0, 10.0], 50.0), ("all busy", [5.0, 5.0], 10.0), ("too late", [0.0, 100.0], 10.0), ("nothing to do", [0.0, 0.0], 0.0)]
    return spark.createDataFrame([(n, *map(float, planner.optimal(a, w)[:1]), planner.optimal(a, w)[1]) for n, a, w in given], "example string, finish double, slots int")


@query(values("('map', 0, 40.0)", "('map', 1, 45.0)", "('map', 2, 60.0)", "('reduce', 0, 100.0)", "('reduce', 1, 90.0)", "('reduce', 2, 110.0)", columns="kind, place, finish"))
def plan_expected_finish(spark, d):
    """Ranges of 30, 20 and 20 seconds, longest first, on slots free at 0 and 25; a map starts after 10 seconds, a reduce after 70.

    Maps: 10 + 30, 25 + 20, and 40 + 20 on the slot done first. Reduces: 70 + 30, 70 + 20, 90 + 20.
    """
    made = planner.Plan("LINEAR", [planner.Range(0, 1, 30, 30.0), planner.Range(1, 2, 20, 20.0), planner.Range(2, 3, 20, 20.0)], [0, 1, 2])
    rows = [(kind, i, x) for kind in ("map", "reduce") for i, x in enumerate(planner.expected_finish(made, [0.0, 25.0], kind == "reduce"))]
    return spark.createDataFrame(rows, "kind string, place int, finish double")


@query(values("(0, 0.25)", "(1, 0.5)", "(2, 0.5)", "(3, 5e-7)", "(4, 5e-7)", columns="example, rate"))
def plan_fallback_rate(spark, d):
    """A measured rate; no rate, zero and infinity are replaced by the job's average; without one by the fallback."""
    given = [(0.25, 0.5), (0.0, 0.5), (float("inf"), 0.5), (None, None), (float("nan"), 0.0)]
    return spark.createDataFrame([(i, planner.rate(*g)) for i, g in enumerate(given)], "example int, rate double")


@query(values("(0, 0, 60, 'c,a,b')", "(1, 60, 40, 'b,c,a')", columns="split, \"offset\", bytes, hosts"))
def plan_map_splits(spark, d):
    """File slices of the LINEAR example, hosts a, b and c turned by one from slice to slice."""
    made = planner.plan(parts(10, 10, 40, 10, 10, 20), [0.0, 0.0], "LINEAR", 1.0)
    rows = [(i, o, b, ",".join(h)) for i, (o, b, h) in enumerate(planner.map_splits(made, [0, 10, 20, 60, 70, 80], ["a", "b", "c"]))]
    return spark.createDataFrame(rows, "split int, offset int, bytes int, hosts string")


@query("SELECT source, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes, CAST(row_number() OVER (ORDER BY sum(strlen(coalesce(text, ''))) DESC, source) AS INTEGER) AS turn FROM documents GROUP BY source")
def plan_longest_first(spark, d):
    """The order in which ranges of one source each would start."""
    rows = statistics.key_histogram(t(spark, d, "documents"), ["source"], fx.record_bytes("text"))
    return rows.select("source", "bytes", F.row_number().over(Window.orderBy(F.col("bytes").desc(), "source")).alias("turn"))


@query("""
    WITH p AS (SELECT DISTINCT p_size AS n FROM part), k AS (SELECT CAST(i AS INTEGER) AS i FROM range(2, 200) AS r(i)),
    primes AS (SELECT a.i FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.i < a.i AND a.i % b.i = 0))
    SELECT n, min(i) AS prime FROM p JOIN primes ON i > n GROUP BY n
""")
def prime_lookup(spark, d):
    """The smallest prime above each part size (fifty numbers, on the driver)."""
    sizes = sorted(r[0] for r in t(spark, d, "part").select("p_size").distinct().collect())
    return spark.createDataFrame([(n, fx.next_prime(n)) for n in sizes], "n int, prime int")


@query(values("('ffee400001', 3, 2)", "('6639400001', 1, 3)", "('ffef400001', 4, 1)", "('00', 0, 4)", "('ffffff', 5, 5)", "('6639c00001', 1, 3)", "('a534400001', 3, 2)", columns="probe, bucket, pid"))
def range_buckets_codec(spark, d):
    """Probes of raw keys among buckets that went through their text form; the second and fourth bound belong to the left."""
    bounds = [bytes.fromhex(x) for x in ("14d7400001", "6639c00001", "a534400001", "ffee400001", "ffffc00001")]
    low, exclude, mapping = partitioners.decoded_buckets(partitioners.encoded_buckets(bounds, {1, 3}, [4, 3, 0, 2, 1, 5]))
    probes = spark.createDataFrame([(x,) for x in ("ffee400001", "6639400001", "ffef400001", "00", "ffffff", "6639c00001", "a534400001")], "probe string")
    key = F.unhex("probe")
    return probes.select("probe", partitioners.range_id(key, low, exclude).alias("bucket"), partitioners.range_id(key, low, exclude, mapping).alias("pid"))


@query("SELECT l_orderkey, l_linenumber, CAST(least(l_partkey // 10, 60) AS INTEGER) AS pid FROM lineitem")
def partition_many_ranges(spark, d):
    """Sixty bounds, looked up by halves."""
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", partitioners.range_id(F.col("l_partkey"), list(range(10, 610, 10))).alias("pid"))


@query(values("(0, 2)", "(1, 0)", "(2, 3)", "(3, 1)", columns="partition, task"))
def schedule_order(spark, d):
    """Partitions that start in the order 1, 3, 0, 2 as task numbers."""
    return spark.createDataFrame(list(enumerate(partitioners.inverse([1, 3, 0, 2]))), "partition int, task int")


# ------------------------------------------------------------ queues and scalars


@query(values("(0, 3)", "(1, 7)", "(2, 8)", "(3, 9)", "(4, 9)", "(5, 11)", "(6, 15)", "(7, 21)", columns="place, item"))
def priority_queue(spark, d):
    """9, 7, 15, 3 and 21 are added, two are taken, 9, 8 and 11 are added, and the rest is taken."""
    queue = fx.DrainingQueue([9, 7, 15, 3, 21])
    out = queue.take(2)
    queue.add(9, 8, 11)
    return spark.createDataFrame(list(enumerate([*out, *queue])), "place int, item int")


@query("""
    WITH a AS (SELECT p_partkey, [p_size, p_partkey % 7, 3] AS v FROM part), s AS (SELECT *, list_sum(v) AS total, list_max(v) AS top FROM a)
    SELECT p_partkey, round(v[1] / total, 9) AS share, CAST(list_position(v, top) - 1 AS INTEGER) AS place, round(exp(v[2] - top) / (exp(v[1] - top) + exp(v[2] - top) + exp(v[3] - top)), 9) AS probability FROM s
""")
def array_scalars(spark, d):
    """Shares, the place of the largest, and probabilities from logarithms."""
    v = F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 7).cast("double"), F.lit(3.0))
    return t(spark, d, "part").select("p_partkey", rounded(fx.normalized_array(v)[0], 9).alias("share"), fx.arg_max_array(v).alias("place"), rounded(fx.probabilities_from_logs_array(v)[1], 9).alias("probability"))


@query("""
    WITH z AS (SELECT p_partkey, (p_size - 25) / 10.0 / sqrt(2) AS z FROM part), u AS (SELECT *, 1 / (1 + 0.3275911 * abs(z)) AS u FROM z),
    e AS (SELECT *, 1 - ((((1.061405429 * u - 1.453152027) * u + 1.421413741) * u - 0.284496736) * u + 0.254829592) * u * exp(-z * z) AS e FROM u)
    SELECT p_partkey, round((1 + sign(z) * e) / 2, 6) AS below FROM e
""")
def gaussian_cdf(spark, d):
    return t(spark, d, "part").select("p_partkey", rounded(fx.gaussian_cdf(F.col("p_size"), 25.0, 10.0), 6).alias("below"))


@query(values("(0.5, 0.0)", "(0.841344746, 1.0)", "(0.975, 1.959964)", "(0.158655254, -1.0)", "(0.998650102, 3.0)", columns="p, point"))
def gaussian_inverse(spark, d):
    """Known points of the standard normal distribution."""
    return spark.createDataFrame([(p, round(fx.gaussian_quantile(p), 6) + 0.0) for p in (0.5, 0.841344746, 0.975, 0.158655254, 0.998650102)], "p double, point double")


# ------------------------------------------------------------ progress and stragglers


@query(f"""
    WITH s AS ({STATUS_SQL}), r AS (SELECT *, CAST(passed_ms AS DOUBLE) / 1000 AS e, CAST(progress AS DOUBLE) AS p FROM s),
    l AS (SELECT *, greatest(1 - p, CAST(1e-4 AS DOUBLE)) / greatest(p / greatest(e, CAST(0.001 AS DOUBLE)), CAST(1e-9 AS DOUBLE)) AS l FROM r)
    SELECT attempt, CAST(floor(l + (e + l) * (2 - phase_rank) + 1e-6) AS BIGINT) AS remaining FROM l WHERE p > 0
""")
def phase_weighted_progress(spark, d):
    """Later phases are taken to last as long as the present one."""
    left = progress.phase_weighted(F.col("progress"), F.col("passed_ms") / 1000, 2 - F.col("phase_rank"))
    return status(spark, d).where("progress > 0").select("attempt", F.floor(left + 1e-6).alias("remaining"))


@query("""
    WITH c AS (SELECT DISTINCT event_id // 100 AS round, user_id AS task FROM events WHERE value > 60), r AS (SELECT *, task % 10 = 0 AS required, lag(round) OVER (PARTITION BY task ORDER BY round) AS before FROM c)
    SELECT round, task, required FROM r WHERE required OR coalesce(before = round - 1, false)
""")
def straggler_confirmation(spark, d):
    """Candidates of two rounds in a row, or required ones."""
    rounds = t(spark, d, "events").where("value > 60").select(F.floor(F.col("event_id") / 100).alias("round"), F.col("user_id").alias("task")).distinct()
    return straggler.confirmed_rounds(rounds.withColumn("required", F.col("task") % 10 == 0))


@query(f"SELECT attempt, type = 'r' OR processed % 9 < 5 AS required FROM ({STATUS_SQL})")
def straggler_required(spark, d):
    """Reduces always; maps while fewer than five outputs are missing."""
    return status(spark, d).select("attempt", straggler.required(F.col("type"), F.col("processed") % 9).alias("required"))


@query(f"SELECT attempt, CAST(CASE WHEN task % 5 <> 0 THEN 8 ELSE greatest(1, least(8, task % 4)) END AS BIGINT) AS parts, processed * 1000000 / 31457280.0 < 60 AS local FROM ({STATUS_SQL})")
def straggler_split_and_scan(spark, d):
    """Into how many parts a task is split at most, and whether its rest is scanned where it is."""
    return attempts(spark, d).select("attempt", straggler.split_counts(F.lit(8).cast("long"), F.col("large_factor")).alias("parts"), straggler.local_scan(F.col("processed") * 1_000_000).alias("local"))


@query("""
    WITH RECURSIVE rules AS (SELECT * FROM (VALUES ('RUNNING', 'selected', 'PREPARE_TAKEOVER'), ('RUNNING', 'finished', 'COMPLETE'), ('PREPARE_TAKEOVER', 'stopped', 'WAIT_TAKEOVER'), ('PREPARE_TAKEOVER', 'planned', 'TAKEOVER'), ('PREPARE_TAKEOVER', 'finished', 'COMPLETE'),
        ('PREPARE_TAKEOVER', 'refused', 'CANCEL_TAKEOVER'), ('WAIT_TAKEOVER', 'planned', 'TAKEOVER'), ('WAIT_TAKEOVER', 'refused', 'CANCEL_TAKEOVER'), ('CANCEL_TAKEOVER', 'restarted', 'RUNNING'), ('CANCEL_TAKEOVER', 'finished', 'COMPLETE'),
        ('TAKEOVER', 'all parts finished', 'COMPLETE'), ('TAKEOVER', 'part failed', 'RUNNING')) AS v(state, event, next)),
    names AS (SELECT ['selected', 'finished', 'stopped', 'planned', 'refused', 'restarted', 'all parts finished', 'part failed'] AS n),
    e AS (SELECT user_id, n[1 + CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id * 5 % 8 END] AS event, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events, names QUALIFY i <= 12),
    s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, 'RUNNING' AS state FROM e UNION ALL
          SELECT e.user_id, e.i, coalesce(r.next, s.state) FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1 LEFT JOIN rules r ON r.state = s.state AND r.event = e.event)
    SELECT user_id, arg_max(state, i) AS state FROM s GROUP BY user_id
""")
def straggler_state_machine(spark, d):
    """The states that each user's first twelve events lead to."""
    names = F.array(*map(F.lit, ["selected", "finished", "stopped", "planned", "refused", "restarted", "all parts finished", "part failed"]))
    e = F.col("event_id")
    event = F.element_at(names, (1 + F.when(e % 3 == 0, 0).otherwise(e * 5 % 8)).cast("int"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    first = t(spark, d, "events").withColumn("i", F.row_number().over(w)).where("i <= 12").select("user_id", "i", event.alias("event"))
    listed = first.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "event"))), lambda x: x["event"]).alias("events"))
    return listed.select("user_id", straggler.final_state(F.col("events")).alias("state"))


@query(values("(1, '')", "(2, 'b,r1')", "(3, '')", "(4, 'a')", "(5, '')", columns="round, chosen"))
def scheduler_rounds(spark, d):
    """Rounds of one scheduler.

    1: a and b are new, so they wait, but the reduce r1 too, for it isn't said to be required. 2: b is slower than a and was
    a candidate before, so it is chosen, and r1, which is required. 3: a takeover is pending. 4: a waited since round 2's
    candidates; it is required. 5: every slot is reserved.
    """
    s = straggler.Scheduler()
    given = [
        ([("a", "m", 90.0), ("b", "m", 80.0), ("r1", "r", 70.0)], set(), 0, 0), ([("b", "m", 95.0), ("a", "m", 90.0), ("r1", "r", 70.0)], {"r1"}, 0, 0), ([("a", "m", 90.0)], {"a"}, 1, 0), ([("a", "m", 85.0), ("c", "m", 99.0)], {"a"}, 0, 1), ([("a", "m", 85.0)], {"a"}, 0, 4),
    ]
    rows = [(i + 1, ",".join(s.round(c, required, pending, reserved, 4))) for i, (c, required, pending, reserved) in enumerate(given)]
    return spark.createDataFrame(rows, "round int, chosen string")


@query(values("('task_1_m_3', 4)", "('task_1_m_4', 2)", "('task_1_r_5', 9)", "('task_1_r_6', 2)", columns="task, parts"))
def split_command(spark, d):
    """`split <task> [n]` with nine and one free map slots, with n of nine and of one."""
    given = [(["split", "task_1_m_3"], 9), (["split", "task_1_m_4"], 1), (["split", "task_1_r_5", "9"], 0), (["split", "task_1_r_6", "1"], 8)]
    return spark.createDataFrame([straggler.split_request(*g) for g in given], "task string, parts int")


@query(values("('some busy', '0.0,0.0,5.0,30.0')", "('planned too', '5.0,12.0,30.0')", "('late', '0.0,0.0')", columns="example, seconds"))
def cluster_availability(spark, d):
    """Seconds until slots are free: four with two busy ones; three with two busy ones and a planned one; two with a task that should be done."""
    given = [("some busy", [30.0, 5.0], [], 4), ("planned too", [30.0, 5.0], [12.0], 3), ("late", [-4.0], [], 2)]
    return spark.createDataFrame([(n, ",".join(map(str, straggler.available(r, p, k)))) for n, r, p, k in given], "example string, seconds string")
