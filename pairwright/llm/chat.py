"""Chat formatting with minimum-cost role repair.

The legal sequences are: an optional system turn, then user and assistant by turns, assistant last. Dynamic programming
over that automaton chooses, turn by turn, to keep a turn, merge it into the one before, change its role,
or insert an empty turn, at the least total cost. The repaired turns are then rendered.

A result row is a fragment: FRAGMENT turns of a conversation, or what is left of it at its end, for conversations of every length. A
fragment is a min-plus matrix between automaton states; matrices are multiplied in runs of GROUP fragments, the runs of a
conversation are chained, and so each fragment's two states are known, between which it is then solved and rendered by itself.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .storage import materialize, owner

ROLES = ["start", "system", "user", "assistant"]
START, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 40
#: Turns in a fragment, and fragments in a run whose matrices one task holds.
FRAGMENT, GROUP = 4096, 4096
#: So many ids are 16 MB; more are joined by shuffle.
MAX_BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class Costs:
    merge: int = 1
    relabel: int = 2
    insert: int = 3


@dataclass(frozen=True)
class Template:
    """What stands before a turn's text (role put in for {role}) and after it."""

    before: str = "<|{role}|>\n"
    after: str = "<|end|>\n"
    between_merged: str = "\n"


def _moves(costs: Costs) -> list[list[tuple[int, int, bool, tuple[int, ...]]]]:
    """For each state: (next state, cost, merged, roles of empty turns put between)."""
    insert = costs.insert
    return [
        [(SYSTEM, 0, False, ()), (USER, 0, False, ()), (ASSISTANT, insert, False, (USER,))],
        [(SYSTEM, costs.merge, True, ()), (USER, 0, False, ()), (ASSISTANT, insert, False, (USER,))],
        [(USER, *min((costs.merge, True, ()), (insert, False, (ASSISTANT,)))), (ASSISTANT, 0, False, ())],
        [(ASSISTANT, *min((costs.merge, True, ()), (insert, False, (USER,)))), (USER, 0, False, ())],
    ]


def _ending(costs: Costs) -> list[tuple[int, tuple[int, ...]]]:
    return [(0, ()), (2 * costs.insert, (USER, ASSISTANT)), (costs.insert, (ASSISTANT,)), (0, ())]


def _role(name: str | None) -> int:
    name = (name or "").strip().lower()
    return ROLES.index(name) if name in ROLES[1:] else START


def forward(roles: list[int], entry: list[int], costs: Costs) -> tuple[list[int], list[list[tuple[int, int] | None]]]:
    """Least cost of each state after all turns, and for each turn and state (state before, number of the move)."""
    moves, cost, back = _moves(costs), entry, []
    for role in roles:
        reached: list[int] = [FAR] * 4
        via: list[tuple[int, int] | None] = [None] * 4
        for state in range(4):
            if cost[state] < FAR:
                for k, (to, price, _, _) in enumerate(moves[state]):
                    total = cost[state] + price + (0 if to == role else costs.relabel)
                    if total < reached[to]:
                        reached[to], via[to] = total, (state, k)
        cost = reached
        back.append(via)
    return cost, back


def _only(state: int) -> list[int]:
    return [0 if s == state else FAR for s in range(4)]


def solve(roles: list[int], costs: Costs, entry: int = START, exit_: int | None = None) -> tuple[int, list[tuple[int, bool, tuple[int, ...]]], int]:
    """Cost, (role, merged, empty turns before) of each turn, and the last state.

    Without exit_ the conversation ends here and the ending's cost counts. Ties go to the state that comes first.
    """
    cost, back = forward(roles, _only(entry), costs)
    if exit_ is None:
        exit_ = min(range(4), key=lambda s: (cost[s] + _ending(costs)[s][0], s))
        total = cost[exit_] + _ending(costs)[exit_][0]
    else:
        total = cost[exit_]
    moves, state, out = _moves(costs), exit_, []
    for via in reversed(back):
        before, k = via[state]
        _, _, merged, empty = moves[before][k]
        out.append((state, merged, empty))
        state = before
    return total, out[::-1], exit_


def render(roles: list[int], texts: list[str | None], costs: Costs, template: Template, entry: int = START, exit_: int | None = None, at_start: bool = True) -> dict:
    """A fragment's repair and its rendering; fragments of one conversation are joined as they are.

    A turn is closed where the next begins, and the last one by the fragment in which the conversation ends.
    """
    total, path, last = solve(roles, costs, entry, exit_)
    parts: list[str] = []
    open_ = not at_start
    names: list[str] = []
    merged_n = relabelled = inserted = 0

    def begin(role: int) -> None:
        nonlocal open_
        parts.append((template.after if open_ else "") + template.before.format(role=ROLES[role]))
        names.append(ROLES[role])
        open_ = True

    for (role, merged, empty), given, text in zip(path, roles, texts):
        relabelled += role != given
        if merged:
            merged_n += 1
            parts.append(template.between_merged)
        else:
            for e in empty:
                begin(e)
                inserted += 1
            begin(role)
        parts.append(text or "")
    if exit_ is None:
        for e in _ending(costs)[last][1] if path or not at_start else ():
            begin(e)
            inserted += 1
        if open_:
            parts.append(template.after)
    return {"cost": total, "n_in": len(roles), "n_out": len(names), "n_merged": merged_n, "n_relabelled": relabelled, "n_inserted": inserted, "roles": " ".join(names), "rendered": "".join(parts)}


def _fragments(batches):
    """(none, conv, fragment), entry, exit, roles, texts of rows with these that come in order; fragments may cross batches."""
    key, states, roles, texts = None, None, [], []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(7)]
        for none, conv, fragment, entry, exit_, role, text in zip(*columns):
            if (none, conv, fragment) != key:
                if key is not None:
                    yield key, states, roles, texts
                key, states, roles, texts = (none, conv, fragment), (entry, exit_), [], []
            roles.append(_role(role))
            texts.append(text)
    if key is not None:
        yield key, states, roles, texts


def _matrices(costs: Costs):
    """The least costs between states over each fragment, as 16 numbers."""
    def run(batches):
        for (none, conv, fragment), _, roles, _ in _fragments(batches):
            cells = [c for s in range(4) for c in forward(roles, _only(s), costs)[0]]
            yield pa.RecordBatch.from_arrays([pa.array([none]), pa.array([conv], pa.string()), pa.array([fragment], pa.int64()), pa.array([cells], pa.list_(pa.int64()))], ["none", "conv", "nth", "cells"])

    return run


def _times(one: list[int], two: list[int]) -> list[int]:
    return [min(min(one[4 * s + k] + two[4 * k + t] for k in range(4)), FAR) for s in range(4) for t in range(4)]


def chain(cells: list[list[int]], costs: Costs, entry: int = START, exit_: int | None = None) -> list[tuple[int, int | None]]:
    """Entry and exit state of each matrix in a row of them, by the least total cost; the last exit is None where the conversation ends."""
    cost, backs = _only(entry), []
    for c in cells:
        backs.append([min(range(4), key=lambda s: (cost[s] + c[4 * s + t], s)) for t in range(4)])
        cost = [min(min(cost[s] + c[4 * s + t] for s in range(4)), FAR) for t in range(4)]
    state = min(range(4), key=lambda s: (cost[s] + _ending(costs)[s][0], s)) if exit_ is None else exit_
    out: list[tuple[int, int | None]] = []
    for i in range(len(cells) - 1, -1, -1):
        before = backs[i][state]
        out.append((before, exit_ if i == len(cells) - 1 else state))
        state = before
    return out[::-1]


def _each(act, names: list[str], kinds: list):
    """Runs act on every row, as a dict; it gives rows of these columns."""
    def run(batches):
        for batch in batches:
            rows = [x for i in range(batch.num_rows) for x in act(batch.slice(i, 1).to_pylist()[0])]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return run


KEY = ["none", "conv"]


def _states(matrices: DataFrame, costs: Costs) -> DataFrame:
    """KEY, fragment, entry and exit of the fragments of matrices (KEY, nth, cells)."""
    runs = matrices.withColumn("run", F.floor(F.col("nth") / GROUP)).groupBy(*KEY, "run").agg(F.array_sort(F.collect_list(F.struct("nth", "cells"))).alias("of"))
    runs, _ = materialize(runs, "runs")
    whole = [pa.bool_(), pa.string(), pa.int64()]
    products = runs.select(*KEY, "run", F.col("of.cells").alias("cells")).mapInArrow(
        _each(lambda r: [(r["none"], r["conv"], r["run"], reduce(_times, r["cells"]))], [*KEY, "run", "cells"], [*whole, pa.list_(pa.int64())]), "none boolean, conv string, run long, cells array<long>")
    of = products.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("run", "cells"))).alias("of"))

    def outer(r):
        return [(r["none"], r["conv"], x["run"], *ends) for x, ends in zip(r["of"], chain([x["cells"] for x in r["of"]], costs))]

    def inner(r):
        return [(r["none"], r["conv"], x["nth"], *ends) for x, ends in zip(r["of"], chain([x["cells"] for x in r["of"]], costs, r["entry"], r["exit"]))]

    ends = of.mapInArrow(_each(outer, [*KEY, "run", "entry", "exit"], [*whole, pa.int32(), pa.int32()]), "none boolean, conv string, run long, entry int, exit int")
    return runs.join(ends, [*KEY, "run"]).mapInArrow(_each(inner, [*KEY, "fragment", "entry", "exit"], [*whole, pa.int32(), pa.int32()]), "none boolean, conv string, fragment long, entry int, exit int")


def _long_turns(turns: DataFrame, long: DataFrame, n: int, per: int) -> DataFrame:
    """The turns of the long conversations with their fragments: turns are range-partitioned, and counts of the parts tell a turn's number."""
    ordered = turns.join(long, KEY).repartitionByRange(n, *KEY, "turn", "h").sortWithinPartitions(*KEY, "turn", "h")
    ordered, _ = materialize(ordered.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "long")
    parts = ordered.groupBy(*KEY, "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*KEY).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*KEY, "part", (before - F.col("first")).alias("shift"))
    nth = F.col("at") + F.col("shift")
    return ordered.join(parts, [*KEY, "part"]).withColumn("fragment", F.floor(nth / per).cast("long")).withColumn("nth", nth).select(*KEY, "fragment", "nth", "turn", "h", "role", "text")


SCHEMA = "conv string, fragment long, cost long, n_in long, n_out long, n_merged long, n_relabelled long, n_inserted long, roles string, rendered string"


@owner
def format_chats(df: DataFrame, costs: Costs = Costs(), template: Template = Template(), partitions: int | None = None, per: int = FRAGMENT,
                 conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for every `per` turns of a conversation: conv_id, fragment (from 0), the repair's figures, roles, rendered; no other columns.

    A conversation's rendering is that of its fragments by number, joined, and its cost the sum of theirs. Turns go by turn_col, nulls first,
    and those that tie by a hash of role and text. A null id is a conversation of its own; roles count without case and outer blanks, and a null or unknown one is relabelled at cost; null texts
    are empty turns. An empty table gives no rows. Repeated turns are turns of their own. One text is never cut.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = df.schema[conv_col].dataType
    conv = F.col(f"`{conv_col}`").cast("string")
    turns = df.select(conv.isNull().alias("none"), F.coalesce(conv, F.lit("")).alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.col(f"`{role_col}`").cast("string").alias("role"), F.col(f"`{text_col}`").cast("string").alias("text"))
    turns = turns.withColumn("h", F.xxhash64("role", "text"))
    long, _ = materialize(turns.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > per).select(*KEY), "long")
    none = F.lit(None).cast("int")
    rows = turns.select(*KEY, F.lit(0).cast("long").alias("fragment"), none.alias("entry"), none.alias("exit"), "role", "text", F.lit(0).cast("long").alias("nth"), "turn", "h")
    columns = [*KEY, "fragment", "entry", "exit", "role", "text"]

    def in_order(of: DataFrame) -> DataFrame:
        return of.repartition(n, *KEY, "fragment").sortWithinPartitions(*KEY, "fragment", "nth", "turn", "h").select(*columns)

    if many := long.count():
        small = F.broadcast(long) if many <= MAX_BROADCAST_IDS else long
        cut = _long_turns(turns, small, n, per)
        blank = cut.select(*KEY, "fragment", none.alias("entry"), none.alias("exit"), "role", F.lit(None).cast("string").alias("text"), "nth", "turn", "h")
        matrices = in_order(blank).mapInArrow(_matrices(costs), "none boolean, conv string, nth long, cells array<long>")
        states, _ = materialize(_states(matrices, costs), "states")
        states = F.broadcast(states) if states.count() <= MAX_BROADCAST_IDS else states
        rows = rows.join(small, KEY, "left_anti").unionByName(cut.join(states, [*KEY, "fragment"]).select(*rows.columns))

    def run(batches):
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        held: list[dict] = []
        size = 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], pa.string() if k in ("conv", "roles", "rendered") else pa.int64()) for k in names], names)

        for (none, conv, fragment), (entry, exit_), roles, texts in _fragments(batches):
            held.append({"conv": None if none else conv, "fragment": fragment, **render(roles, texts, costs, template, entry or START, exit_, fragment == 0)})
            size += len(held[-1]["rendered"])
            if size > 4_000_000 or len(held) >= 5000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    done = in_order(rows).mapInArrow(run, SCHEMA)
    return done.select(F.col("conv").cast(kind).alias(conv_col), F.col("fragment").cast("int").alias("fragment"), *[c for c in done.columns if c not in ("conv", "fragment")])


def digest(conversations: DataFrame) -> DataFrame:
    return format_chats(conversations)
