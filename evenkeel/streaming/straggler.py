"""Choice of the task to split, its states, and the slots that will be free."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_ELAPSED_MS, LEAST_REMAINING = 60_000, 60.0
DISK_BYTES, SCAN_SECONDS = 30 << 20, 60.0
LAST_MAPS = 5


def candidates(attempts: DataFrame) -> DataFrame:
    """Tasks whose best running attempt still needs over a minute.

    attempts: job, task, type, attempt, passed_ms, remaining (seconds), state,
    reactive (a job has taken the task over) and large_factor (how often a split
    holds its largest record; null if no large record was seen).
    """
    running = attempts.where((F.col("state") == "RUNNING") & ~F.col("reactive") & (F.col("passed_ms") > LEAST_ELAPSED_MS))
    cuttable = (F.col("type") != "m") | F.col("large_factor").isNull() | (F.col("large_factor") >= 2)
    best = running.where(cuttable).groupBy("job", "task", "type").agg(F.min("remaining").alias("remaining"))
    return best.where(F.col("remaining") > LEAST_REMAINING)


def slowest(found: DataFrame) -> DataFrame:
    """At most one map and one reduce of each job: the ones that need longest."""
    w = Window.partitionBy("job", "type").orderBy(F.col("remaining").desc(), "task")
    return found.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def ready(tasks: DataFrame) -> DataFrame:
    """Per job and type whether splitting may begin: every task is scheduled, and for reduces every map is done."""
    done = tasks.groupBy("job").agg(F.bool_and((F.col("type") != "m") | (F.col("state") == "COMPLETE")).alias("maps_done"))
    scheduled = tasks.groupBy("job", "type").agg(F.bool_and(F.col("state") != "PENDING").alias("all_scheduled"))
    return scheduled.join(done, "job").select("job", "type", (F.col("all_scheduled") & ((F.col("type") == "m") | F.col("maps_done"))).alias("ready"))


def required(kind: Column, outputs_missing: Column) -> Column:
    return (kind == "r") | (outputs_missing < LAST_MAPS)


def confirmed(now: set[str], before: set[str], needed: set[str]) -> set[str]:
    """Candidates of two rounds in a row, or required ones."""
    return now & (before | needed)


def confirmed_rounds(rounds: DataFrame) -> DataFrame:
    """rounds: round, task, required, a row for each candidate. Those that were candidates a round before, or are required."""
    w = Window.partitionBy("task").orderBy("round")
    again = F.lag("round").over(w) == F.col("round") - 1
    return rounds.withColumn("_again", F.coalesce(again, F.lit(False))).where(F.col("_again") | F.col("required")).drop("_again")


def reserved(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("job").agg(F.count_if(~F.col("state").isin("COMPLETE", "TAKEOVER")).alias("reserved"))


def attempt_to_split(attempts: DataFrame) -> DataFrame:
    """Of a task's attempts the furthest one: highest phase, then progress."""
    return attempts.groupBy("job", "task").agg(F.max_by("attempt", F.struct("phase_rank", "progress", "attempt")).alias("attempt"))


def factors(reports: DataFrame) -> DataFrame:
    """split_len / rec_len of a task's largest records so far: rows that set a new minimum."""
    w = Window.partitionBy("task").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    rows = reports.withColumn("factor", F.col("split_len") / F.col("rec_len"))
    return rows.withColumn("_least", F.min("factor").over(w)).where(F.col("_least").isNull() | (F.col("factor") < F.col("_least"))).drop("_least")


def split_count(asked: int, factor: float | None) -> int:
    return asked if factor is None else max(1, min(asked, int(factor)))


def split_counts(asked: Column, factor: Column) -> Column:
    """The same for a column."""
    return F.when(factor.isNull(), asked).otherwise(F.greatest(F.lit(1), F.least(asked, F.floor(factor)))).cast("long")


def scans_locally(remaining_bytes: int) -> bool:
    return remaining_bytes / DISK_BYTES < SCAN_SECONDS


def local_scan(remaining_bytes: Column) -> Column:
    return remaining_bytes / F.lit(float(DISK_BYTES)) < SCAN_SECONDS


def complete_outputs(outputs: DataFrame) -> DataFrame:
    """Maps whose output is whole: the original's or a speculative one; a takeover needs both parts.

    outputs: map, source (original, speculative, takeover, partial: what the original had written when it was stopped).
    """
    has = lambda s: F.bool_or(F.col("source") == s)
    rows = outputs.groupBy("map").agg(has("original").alias("o"), has("speculative").alias("s"), (has("takeover") & has("partial")).alias("t"))
    return rows.where("o or s or t").select("map", F.when(F.col("o"), "original").when(F.col("s"), "speculative").otherwise("takeover").alias("source"))


class State(Enum):
    RUNNING = 1
    PREPARE_TAKEOVER = 2
    TAKEOVER = 3
    CANCEL_TAKEOVER = 4
    COMPLETE = 5
    WAIT_TAKEOVER = 6


#: state, event -> next state; other events leave the state as it is
TRANSITIONS = {
    (State.RUNNING, "selected"): State.PREPARE_TAKEOVER,
    (State.RUNNING, "finished"): State.COMPLETE,
    (State.PREPARE_TAKEOVER, "stopped"): State.WAIT_TAKEOVER,
    (State.PREPARE_TAKEOVER, "planned"): State.TAKEOVER,
    (State.PREPARE_TAKEOVER, "finished"): State.COMPLETE,
    (State.PREPARE_TAKEOVER, "refused"): State.CANCEL_TAKEOVER,
    (State.WAIT_TAKEOVER, "planned"): State.TAKEOVER,
    (State.WAIT_TAKEOVER, "refused"): State.CANCEL_TAKEOVER,
    (State.CANCEL_TAKEOVER, "restarted"): State.RUNNING,
    (State.CANCEL_TAKEOVER, "finished"): State.COMPLETE,
    (State.TAKEOVER, "all parts finished"): State.COMPLETE,
    (State.TAKEOVER, "part failed"): State.RUNNING,
}


def advance(state: State, event: str) -> State:
    return TRANSITIONS.get((state, event), state)


def final_state(events: Column) -> Column:
    """The state that an array of event names leads to from RUNNING, by name."""
    table = F.create_map(*[F.lit(x) for (state, event), to in TRANSITIONS.items() for x in (f"{state.name} {event}", to.name)])
    return F.aggregate(events, F.lit(State.RUNNING.name), lambda state, event: F.coalesce(F.try_element_at(table, F.concat_ws(" ", state, event)), state))


class Scheduler:
    """Rounds of choosing tasks to split: at most one map and one reduce at a time, the slowest first.

    A task is chosen when it was a candidate in the round before too, or is required. Nothing is chosen while a takeover
    is pending or every slot is reserved.
    """

    def __init__(self) -> None:
        self.before: set[str] = set()

    def round(self, candidates: list[tuple[str, str, float]], required: set[str] = frozenset(), pending: int = 0, reserved: int = 0, capacity: int = 1) -> list[str]:
        """candidates: task, type (m or r) and remaining seconds; returns the chosen tasks."""
        if pending or reserved >= capacity:
            return []
        chosen: dict[str, str] = {}
        waiting = set()
        for task, kind, _ in sorted(candidates, key=lambda c: (-c[2], c[0])):
            if kind in chosen:
                continue
            if task in self.before or task in required:
                chosen[kind] = task
            else:
                waiting.add(task)
        self.before = waiting
        return sorted(chosen.values())


def split_request(words: list[str], free_map_slots: int) -> tuple[str, int]:
    """The task and number of parts of `split <task> [n]`: half the free map slots if n isn't given, and two at least."""
    if len(words) not in (2, 3) or words[0] != "split":
        raise ValueError("usage: split <task> [parts]")
    return words[1], max(2, int(words[2]) if len(words) == 3 else free_map_slots // 2)


def available(remaining: list[float], planned: list[float], slots: int) -> list[float]:
    """Seconds until each slot is free: busy ones by their tasks' remaining time or plan, the others now."""
    busy = sorted(max(0.0, x) for x in [*remaining, *planned])[-slots:] if slots else []
    return [0.0] * (slots - len(busy)) + busy
