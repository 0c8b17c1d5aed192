import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evenkeel import functions as fx
from evenkeel.operators.intervals import Interval, KeyPool, RecordPool, align
from evenkeel.operators.partitioners import inverse, range_index
from evenkeel.operators import samplers
from evenkeel.operators.samplers import split_points
from evenkeel.plans import cost, planner
from evenkeel.sources import chunked, chunks_by_host, equal_splits, output_name
from evenkeel.streaming import straggler


def parts(*sizes):
    return [planner.Part(s, 1) for s in sizes]


def test_optimal_time():
    assert planner.optimal([0, 0, 10], 50) == (20.0, 3)
    assert planner.optimal([5, 5], 10) == (10.0, 2)
    assert planner.optimal([0, 100], 10) == (10.0, 1)


def test_linear_by_hand():
    made = planner.plan(parts(10, 10, 40, 10, 10, 20), [0, 0], "LINEAR", 1.0)
    assert [(r.start, r.end, r.bytes) for r in made.ranges] == [(0, 3, 60), (3, 6, 40)] and made.order == [0, 1]


def test_a_range_grows_to_the_left_at_the_end():
    sizes = planner.Sizes(parts(10, 10, 15, 10), 1.0)
    assert planner.segment(sizes, (0, 4), 2, 35, 35, True) == (1, 4)
    assert planner.segment(sizes, (2, 4), 2, 35, 35, True) == (2, 4)
    assert planner.without((2, 9), 5, 7) == [(2, 5), (7, 9)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=30), st.integers(1, 6))
def test_isolated_ranges_and_their_schedule(sizes, n):
    made = planner.plan(parts(*sizes), [0.0] * n, "LONGEST2", 1.0)
    share = sum(sizes) / n
    for r in made.ranges:
        if sizes[r.start] >= share:
            assert r.end == r.start + 1
    by_slot: dict = {}
    for r in made.ranges:
        by_slot.setdefault(r.slot, []).append((r.at, r.time))
    for taken in by_slot.values():
        taken.sort()
        assert all(a + x <= b + 1e-9 for (a, x), (b, _) in zip(taken, taken[1:]))


def test_reservoir_by_hand():
    held = samplers.Reservoir(0.5, 2)
    for item, chance, place in ((1, 0.9, 0), (2, 0.5, 0), (3, 0.1, 0), (4, 0.3, 1), (5, 0.3, 0), (6, 0.2, 0)):
        held.offer(item, chance, place)
    # 1 is over the rate; 4 replaces 3 and the rate falls to 0.25; 5 is over that; 6 replaces 2
    assert held.items == [6, 4] and held.rate == 0.125


def test_queues():
    queue = fx.DrainingQueue([5, 1, 9, 3])
    assert queue.take_while(lambda x: x < 4) == [1, 3] and queue.take_while(lambda x: x > 6) == []
    queue.add(2)
    assert list(queue) == [2, 5, 9] and list(queue) == []


def test_rehash_and_max_slots_by_hand():
    made = planner.rehash([0, 0, 10], 50, 100)
    assert (made.prime, made.cumulative) == (101, [40, 81, 101])
    assert [r.bytes for r in planner.max_slots([0, 0, 0], 1, 100).ranges] == [34, 33, 33]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=40), st.lists(st.floats(0, 50), min_size=1, max_size=8), st.sampled_from(["FIRST", "LINEAR", "LONGEST", "LONGEST2", "LONGEST_MODEL"]))
def test_plans_cover_every_partition_once(sizes, slots, name):
    made = planner.plan(parts(*sizes), slots, name, 1.0, cost.LinearCost(1.0, 0.1, 0.0, 2.0))
    covered = [i for r in made.ranges for i in range(r.start, r.end)]
    assert covered == list(range(len(sizes)))
    assert sorted(made.order) == list(range(len(made.ranges)))
    assert len(planner.expected_finish(made, slots)) == len(made.ranges)


def test_alignment_by_hand():
    found = align([Interval("k003", 4, 8, 9, 9, 18, "k007", 3, 6), Interval("k007", 1, 2, 10, 10, 20, "k100", 2, 4), Interval("k050", 2, 4, 14, 14, 28, "k095", 5, 10)])
    assert [(p.num_keys, p.num_recs, p.tot_bytes) for p in found] == [(1, 4, 8), (9, 9, 18), (1, 4, 8), (3, 3, 5), (1, 3, 6), (14, 17, 33), (1, 6, 12), (3, 3, 5), (1, 2, 4)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 5), st.integers(1, 400)), max_size=200), st.integers(1, 3000))
def test_key_pool_loses_nothing(groups, target):
    pool, out = KeyPool(target, 3, 16), []
    for k, (r, b) in enumerate(groups):
        out += pool.add(k, r, b)
    out += pool.finish()
    assert sum(i.begin_recs + i.mid_recs + i.end_recs for i in out) == sum(r for r, _ in groups)
    assert sum(i.length for i in out) == sum(b for _, b in groups)
    assert sum(1 + i.mid_keys + (i.end is not None) for i in out) == len(groups)
    assert [i.begin for i in out] == sorted(i.begin for i in out)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 400), st.booleans()), max_size=200), st.integers(1, 3000))
def test_record_pool_cuts_after_splitable_records(records, target):
    rows, at = [], 0
    for size, splitable in records:
        rows.append((at, size, splitable))
        at += size
    out = RecordPool(target, 3, 16).slices(rows)
    assert sum(s.num_recs for s in out) == len(rows) and sum(s.length for s in out) == at
    ends = {o + n for o, n, s in rows if s} | {at}
    assert all(s.last_offset in ends for s in out)


def test_range_partitioner_probes():
    bounds = [bytes.fromhex(x) for x in ("14d7400001", "6639c00001", "a534400001", "ffee400001", "ffffc00001")]
    probes = [range_index(bytes.fromhex(x), bounds, {1, 3}) for x in ("ffee400001", "6639400001", "ffef400001")]
    assert probes == [3, 1, 4] and [[4, 3, 0, 2, 1, 5][p] for p in probes] == [2, 3, 1]
    assert inverse([2, 0, 1]) == [1, 2, 0]


def test_ols_needs_independent_regressors():
    assert [round(x, 9) for x in cost.solve([[2.0, 1.0], [1.0, 3.0]], [5.0, 10.0])] == [1.0, 3.0]
    with pytest.raises(ValueError):
        cost.solve([[1.0, 2.0], [2.0, 4.0]], [1.0, 2.0])


def test_running_cost_counts_the_intercept_once():
    running = cost.RunningCost(cost.LinearCost(1.0, intercept=5.0))
    running.add(1, 10)
    assert running.add(1, 10) == 25.0


def test_scalars():
    assert fx.next_prime(100) == 101 and fx.next_prime(101) == 103 and fx.next_prime(0) == 2
    assert abs(fx.gaussian_quantile(0.975) - 1.959963985) < 1e-6
    assert fx.arg_max([1, 3, 3]) == 1 and fx.compensated_mean([]) == 0.0
    assert math.isclose(sum(fx.probabilities_from_logs([-1000.0, -1001.0])), 1.0)


def test_splits_and_chunks():
    assert [(s.start, s.length) for s in equal_splits(100, 3)] == [(0, 34), (34, 33), (67, 33)]
    assert chunked([("a", 100), ("b", 50), ("c", 20)], 128) == [["a"], ["b", "c"]]
    assert chunks_by_host([("h", "a", 1), ("g", "b", 1), ("h", "c", 1)], 10) == {"g": [["b"]], "h": [["a", "c"]]}
    assert output_name("map", 1) == "m-00001" and output_name("reduce", 2, 0, 3) == "r-00002.0.3"


def test_split_points_step_past_repeats():
    assert split_points([1, 1, 1, 1, 2, 3, 4, 5], 4) == [1, 2, 4]
    with pytest.raises(ValueError):
        split_points([1], 2)


def test_straggler_driver_rules():
    S = straggler.State
    assert straggler.advance(S.RUNNING, "selected") == S.PREPARE_TAKEOVER
    assert straggler.advance(S.COMPLETE, "selected") == S.COMPLETE
    assert straggler.confirmed({"a", "b", "c"}, {"a"}, {"c"}) == {"a", "c"}
    assert straggler.available([30.0, 5.0], [], 4) == [0.0, 0.0, 5.0, 30.0]
    assert straggler.split_count(5, 2.7) == 2 and straggler.scans_locally(1 << 20)
