"""Minimum-cost role repair of conversations, then rendering.

A legal conversation is an optional system turn, then user and assistant turns in alternation,
from user to assistant. Each turn keeps its role or is relabelled; a turn with the role before it
is merged into it; an empty turn is inserted where one is missing. Dynamic programming over the
automaton of last roles finds the repair of least cost.

Its step is a matrix product in the (min, +) algebra, which is associative. So the turns are dealt
by range of (conv_id, turn, role, text) and each task treats its stretch alone: first it reduces the parts of
conversations that cross its ends to 4 x 4 cost matrices (at most two a task), the driver
chains those, one small row a task, and in later passes each task repairs its stretch between
known states. A conversation of any length is spread over tasks and never gathered.

Defined cases: a null or unknown role has to be relabelled; null text is rendered as empty; turns with equal
numbers are ordered by role and text (null first), repeated rows stay; of repairs with equal cost the one whose
earliest differing turn has the first role in the order system, user, assistant is taken; rows with a null conv_id form
one conversation; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stored

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: (state before, role) -> roles inserted between; None: illegal. Merges (same role) are apart.
_BETWEEN = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
    (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (), (ASSISTANT, USER): (),
}
_INF = float("inf")


@dataclass(frozen=True)
class Costs:
    """What a repair costs: a merged turn, a relabelled turn, an empty turn."""

    merge: float = 1.0
    relabel: float = 2.0
    insert: float = 3.0


def step_matrix(role: str | None, costs: Costs) -> np.ndarray:
    """cost[before, after] of one turn; after is the role that the turn gets."""
    m = np.full((4, 4), _INF)
    for after in (SYSTEM, USER, ASSISTANT):
        relabel = 0.0 if role == ROLES[after - 1] else costs.relabel
        m[after, after] = relabel + costs.merge
        for (before, to), between in _BETWEEN.items():
            if to == after:
                m[before, after] = relabel + costs.insert * len(between)
    return m


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product in the (min, +) algebra."""
    return (a[:, :, None] + b[None, :, :]).min(1)


def closing(costs: Costs) -> np.ndarray:
    """What each last state costs: a conversation ends with the assistant; one of a system turn alone lacks both."""
    return np.array([0.0, 2 * costs.insert, costs.insert, 0.0])


def greedy(steps: list[np.ndarray], start: int, ends: np.ndarray) -> list[int]:
    """The states after each turn: from the front, the first of those that a cheapest way goes through; ends[s] is
    what follows state s. The choice doesn't depend on where a conversation is cut."""
    rest = [ends]
    for m in reversed(steps):
        rest.append((m + rest[-1][None, :]).min(1))
    out, state = [], start
    for m, after in zip(steps, reversed(rest[:-1])):
        state = int((m[state] + after).argmin())
        out.append(state)
    return out


def _dealt(turns: DataFrame) -> DataFrame:
    """Turns in range order, stored with their task and place: the second pass sees the same stretches."""
    cols = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")]
    sorted_turns = turns.select(*cols).repartitionByRange("conv_id", "turn", "role", F.xxhash64("text")).sortWithinPartitions("conv_id", "turn", "role", F.xxhash64("text"))
    return stored(sorted_turns.withColumn("task", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "chat-turns")


def repair(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """A row per turn: conv_id, turn, place, role, text, new_role, merged, inserted_before (roles), inserted_after, cost,
    opens and closes (whether the turn is its conversation's first or last)."""
    spark = turns.sparkSession
    dealt = _dealt(turns)
    ordered = dealt.select("task", "place", "conv_id", "role").repartition("task").sortWithinPartitions("task", "place")

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each stretch: its first and last conversation and their cost matrices."""
        for task, rows in _stretches(batches):
            convs, roles = rows["conv_id"], rows["role"]
            head, tail = _run_end(convs), _last_run(convs)
            first, last = (_product(roles[a:b], costs) for a, b in ((0, head), (tail, len(convs))))
            yield pa.RecordBatch.from_pydict({"task": [task], "first": [convs[0]], "last": [convs[-1]], "one": [head == len(convs)], "head": [first.ravel().tolist()], "tail": [last.ravel().tolist()]}, schema=_SUMMARY)

    summary = ordered.mapInArrow(summarise, "task int, first bigint, last bigint, one boolean, head array<double>, tail array<double>")
    rows = summary.orderBy("task").collect()  # one small row a task
    leave = _leave(rows, costs)
    known = spark.createDataFrame([(r["task"], x.tolist(), i + 1 < len(rows) and rows[i + 1]["first"] == r["last"]) for i, (r, x) in enumerate(zip(rows, leave))], "task int, leave array<double>, goes_on boolean")
    aimed = ordered.join(F.broadcast(known), "task").sortWithinPartitions("task", "place")

    def go_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each stretch: the state after its last turn for each state before the last conversation's part."""
        for task, rows in _stretches(batches):
            tail = _last_run(rows["conv_id"])
            steps, ends = [step_matrix(r, costs) for r in rows["role"][tail:]], np.array(rows["leave"][0])
            yield pa.RecordBatch.from_pydict({"task": [task], "ends": [[greedy(steps, s, ends)[-1] for s in range(4)]]}, schema=pa.schema([("task", pa.int32()), ("ends", pa.list_(pa.int32()))]))

    ends = {r["task"]: r["ends"] for r in aimed.mapInArrow(go_through, "task int, ends array<int>").collect()}
    enters = spark.createDataFrame(_enter(rows, ends), "task int, enter int")
    ways = aimed.join(F.broadcast(enters), "task").sortWithinPartitions("task", "place")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _stretches(batches):
            yield _decide(rows, costs)

    decided = ways.mapInArrow(decide, "place bigint, new_role string, merged boolean, inserted_before array<string>, inserted_after array<string>, cost double, opens boolean, closes boolean")
    return dealt.join(decided, "place").select("conv_id", "turn", "place", "role", "text", "new_role", "merged", "inserted_before", "inserted_after", "cost", "opens", "closes")


_SUMMARY = pa.schema([("task", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("one", pa.bool_()), ("head", pa.list_(pa.float64())), ("tail", pa.list_(pa.float64()))])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, list]]]:
    """The rows that each task of the sort held, without texts: one partition's share at once."""
    key, rows = None, None
    for batch in batches:
        columns = batch.to_pydict()
        names = list(columns)
        for row in zip(*columns.values()):
            if row[0] != key:
                if rows:
                    yield key, rows
                key, rows = row[0], {n: [] for n in names}
            for n, x in zip(names, row):
                rows[n].append(x)
    if rows:
        yield key, rows


def _run_end(xs: list, i: int = 0) -> int:
    """Where the run of equal values that begins at i ends."""
    n = i + 1
    while n < len(xs) and xs[n] == xs[i]:
        n += 1
    return n


def _last_run(xs: list) -> int:
    """Where the last run of equal values begins."""
    n = len(xs) - 1
    while n and xs[n - 1] == xs[-1]:
        n -= 1
    return n


def _product(roles: list, costs: Costs) -> np.ndarray:
    m = np.where(np.eye(4) > 0, 0.0, _INF)
    for r in roles:
        m = chain(m, step_matrix(r, costs))
    return m


def _leave(rows: list, costs: Costs) -> list[np.ndarray]:
    """For each stretch: the cost of all that follows each state after its last turn, in that conversation."""
    end = closing(costs)
    out = [end] * len(rows)
    for i in range(len(rows) - 2, -1, -1):
        after = rows[i + 1]
        if rows[i]["last"] == after["first"]:
            out[i] = (np.array(after["head"]).reshape(4, 4) + (out[i + 1] if after["one"] else end)[None, :]).min(1)
    return out


def _enter(rows: list, ends: dict[int, list[int]]) -> list[tuple[int, int]]:
    """For each stretch: the state before its first turn."""
    out, state = [], START
    for i, r in enumerate(rows):
        state = state if i and rows[i - 1]["last"] == r["first"] else START
        out.append((r["task"], state))
        state = ends[r["task"]][state if r["one"] else START]
    return out


def _decide(rows: dict[str, list], costs: Costs) -> pa.RecordBatch:
    n = len(rows["place"])
    new, merged, before, after, cost, opens, closes = [], [], [], [], [], [], []
    i = 0
    while i < n:
        j = _run_end(rows["conv_id"], i)
        start = rows["enter"][0] if i == 0 else START
        goes_on = j == n and rows["goes_on"][0]
        ends = np.array(rows["leave"][0]) if j == n else closing(costs)
        steps = [step_matrix(r, costs) for r in rows["role"][i:j]]
        states = greedy(steps, start, ends)
        for k, (a, b) in enumerate(zip([start, *states], states)):
            last = k == len(states) - 1 and not goes_on
            tail = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}[b] if last else ()
            new.append(ROLES[b - 1])
            merged.append(a == b)
            before.append([ROLES[x - 1] for x in (() if a == b else _BETWEEN[a, b])])
            after.append([ROLES[x - 1] for x in tail])
            cost.append(float(steps[k][a, b] + costs.insert * len(tail)))
            opens.append(a == START)
            closes.append(last)
        i = j
    return pa.RecordBatch.from_arrays(
        [pa.array(rows["place"], pa.int64()), pa.array(new), pa.array(merged), pa.array(before, pa.list_(pa.string())), pa.array(after, pa.list_(pa.string())), pa.array(cost), pa.array(opens), pa.array(closes)],
        names=["place", "new_role", "merged", "inserted_before", "inserted_after", "cost", "opens", "closes"],
    )


def render(repaired: DataFrame, opening: str = "<|{role}|>\n", closing_mark: str = "<|end|>\n", joint: str = "\n\n") -> DataFrame:
    """repaired with `rendered`: what each turn adds. The pieces of a conversation in the order of place, after one another, are its text.

    A turn's closing mark stands before whatever follows it, as a merged turn may go on; the last piece closes itself and the
    turns inserted after it.
    """
    mark = lambda role: F.replace(F.lit(opening), F.lit("{role}"), role)
    empty = lambda roles: F.array_join(F.transform(roles, lambda r: F.concat(mark(r), F.lit(closing_mark))), "")
    lead = F.when(F.col("merged"), F.lit(joint)).otherwise(F.concat(F.when(F.col("opens"), "").otherwise(closing_mark), empty(F.col("inserted_before")), mark(F.col("new_role"))))
    tail = F.when(F.col("closes"), F.concat(F.lit(closing_mark), empty(F.col("inserted_after")))).otherwise("")
    return repaired.withColumn("rendered", F.concat(lead, F.coalesce("text", F.lit("")), tail))
