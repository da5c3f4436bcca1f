"""Operator 2, chat formatting with minimum-cost role repair.

Legal turns form an automaton: start -> system or user, system -> user, user -> assistant, assistant -> user. A message is
kept, relabelled, merged into the turn before it, or preceded by empty turns, each at a cost; the cheapest path through the
automaton is the repair. The path is found by dynamic programming over 4 x 4 cost matrices, which multiply (min, +): a
conversation is cut into blocks of 1024 messages, blocks into blocks of blocks, so one of any length is many small groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import numbered, partitions, salted_join
from planloom.staging import Stage

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Costs of a merge, of a relabelled role, of a missing or unknown role that becomes user or assistant, of one that becomes
#: system (never the cheapest where a conversation may begin with the user), and of an empty turn.
MERGE, RELABEL, NAME, AS_SYSTEM, EMPTY = 1, 2, 1, 4, 3
#: States in which a conversation may end.
FINAL = (START, USER, ASSISTANT)
FAR = 1 << 40
BLOCK_BITS = 10
HEADER, FOOTER = "<|{role}|>\n", "<|end|>\n"


def empties() -> dict[tuple[int, int], list[int]]:
    """For states s and x the fewest empty turns (roles in order) that lead from s to a point where x is legal."""
    out = {}
    for s in range(4):
        paths, seen = [[s]], {s}
        while paths:
            path = paths.pop(0)
            for x in LEGAL[path[-1]]:
                if (s, x) not in out:
                    out[s, x] = path[1:]
                if x not in seen:
                    seen.add(x)
                    paths.append([*path, x])
    return out


INSERTED = empties()


def step_costs() -> np.ndarray:
    """cost[role, s, x]: from state s by a message of ``role`` (0 for an unknown one) to state x."""
    out = np.full((4, 4, 4), FAR, np.int64)
    for role in range(4):
        for s in range(4):
            for x in (SYSTEM, USER, ASSISTANT):
                label = 0 if role == x else RELABEL if role else AS_SYSTEM if x == SYSTEM else NAME
                ways = [EMPTY * len(INSERTED[s, x])] if (s, x) in INSERTED else []
                out[role, s, x] = min([FAR, *ways, *([MERGE] if s == x else [])]) + label
    return np.minimum(out, FAR)


STEP = step_costs()
END = np.array([0 if s in FINAL else EMPTY for s in range(4)], np.int64)  # an ending after the system message gets an empty user turn


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


def product(steps: np.ndarray) -> np.ndarray:
    """(min, +) product of matrices, in pairs."""
    while len(steps) > 1:
        odd = steps[-1:] if len(steps) % 2 else steps[:0]
        a, b = steps[0 : len(steps) - len(odd) : 2], steps[1::2]
        steps = np.concatenate([np.minimum((a[:, :, :, None] + b[:, None, :, :]).min(axis=2), FAR), odd])
    return steps[0]


def follow(steps: np.ndarray, start: int, after: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """For each step the state after it and the costs that remain from each state then; ``after`` are the costs that remain
    after the last step. Of equally cheap states the first one is taken."""
    remain = [after]
    for m in steps[:0:-1]:
        remain.append(np.minimum((m + remain[-1][None, :]).min(axis=1), FAR))
    out, state = [], start
    for m, rest in zip(steps, remain[::-1]):
        state = int(np.argmin(m[state] + rest))
        out.append((state, rest))
    return out


MATS = "array<long>"


def multiply(blocks: DataFrame) -> DataFrame:
    """(conv, block, matrix) of (conv, block, items): the product of a block's matrices (16 numbers each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [product(np.array(items, np.int64).reshape(-1, 4, 4)).ravel().tolist() for items in batch.column("items").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("block"), pa.array(out, pa.list_(pa.int64()))], names=["conv", "block", "matrix"])

    return ordered_items(blocks).select("conv", "block", F.col("mats").alias("items")).mapInArrow(run, f"conv string, block long, matrix {MATS}")


def ordered_items(blocks: DataFrame) -> DataFrame:
    flat = blocks.withColumn("items", F.array_sort("items"))
    return flat.withColumns({"ats": F.transform("items", lambda r: r["at"]), "mats": F.flatten(F.transform("items", lambda r: r["matrix"]))}).drop("items")


def states(blocks: DataFrame) -> DataFrame:
    """(conv, at, before, state, remain) of every item of (conv, block, start, after, items(at, matrix))."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conv, start, after, ats, mats in zip(batch["conv"], batch["start"], batch["after"], batch["ats"], batch["mats"]):
                state = int(start)
                for at, (new, rest) in zip(ats, follow(np.array(mats, np.int64).reshape(-1, 4, 4), state, np.array(after, np.int64))):
                    rows.append((conv, int(at), state, new, rest.tolist()))
                    state = new
            yield pd.DataFrame(rows, columns=["conv", "at", "before", "state", "remain"])

    return ordered_items(blocks).select("conv", "start", "after", "ats", "mats").mapInPandas(run, f"conv string, at long, before int, state int, remain {MATS}")


def ways(blocks: DataFrame) -> DataFrame:
    """(conv, at, matrix) of blocks (conv, block, after, items): cost 0 from each state to the one that its path ends in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conv, block, after, mats in zip(batch["conv"], batch["block"], batch["after"], batch["mats"]):
                steps, way = np.array(mats, np.int64).reshape(-1, 4, 4), np.full((4, 4), FAR, np.int64)
                for s in range(4):
                    way[s, follow(steps, s, np.array(after, np.int64))[-1][0]] = 0
                rows.append((conv, int(block), way.ravel().tolist()))
            yield pd.DataFrame(rows, columns=["conv", "at", "matrix"])

    return ordered_items(blocks).select("conv", "block", "after", "mats").mapInPandas(run, f"conv string, at long, matrix {MATS}")


def solve(items: DataFrame, stage: Stage) -> DataFrame:
    """(conv, at, before, state, remain) of staged items (conv, at, matrix), ``at`` ascending within a conversation.

    Items whose numbers agree but for the last ten bits are one block: 1024 at most. Where a conversation has several blocks,
    their products are solved the same way for the costs that remain after each block, and then the ways that the blocks'
    paths take for the state that each begins in. So the path does not depend on where blocks begin."""
    blocks = stage.write(items.groupBy("conv", F.shiftright("at", BLOCK_BITS).alias("block")).agg(F.collect_list(F.struct("at", "matrix")).alias("items")))
    several = stage.write(blocks.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("conv"))
    end = F.array(*[F.lit(int(x)).cast("long") for x in END])
    if several.isEmpty():
        return states(blocks.withColumns({"start": F.lit(START), "after": end}))
    # only what belongs to a conversation of several blocks takes part in the next level
    split = stage.write(blocks.join(several, "conv", "left_semi"))
    remain = solve(stage.write(multiply(split).withColumnRenamed("block", "at")), stage).select("conv", F.col("at").alias("block"), F.col("remain").alias("after"))
    split = stage.write(split.join(remain, ["conv", "block"]))
    begins = solve(stage.write(ways(split)), stage).select("conv", F.col("at").alias("block"), F.col("before").alias("start"))
    known = split.select("conv", "block", "after").join(begins, ["conv", "block"])
    return states(blocks.join(stage.write(known), ["conv", "block"], "left").withColumns({"start": F.coalesce("start", F.lit(START)), "after": F.coalesce("after", end)}))


def repair(messages: DataFrame) -> DataFrame:
    """One row for each message, with its repaired place and its part of the rendered conversation.

    Returns conv_id, turn, role, new_role, action (keep, relabel, merge, relabel+merge), inserted (roles of empty turns put
    before it), first and last (of its conversation), and ``fragment``. The fragments of a conversation, strung together in
    the order of ``position``, are the rendered text; it is not put into one row, as a conversation has no bound.

    Messages go by turn; equal turns by role and a hash of the text. Roles are read without regard to case and outer blanks;
    null and others are unknown and get the role that costs least. Null texts count as empty. A null conv_id is a
    conversation, repeated rows are messages of their own. Markers within a text (``<|``) are broken by a space. Of equally
    cheap repairs the one with the earlier role (system, user, assistant) at the first difference is taken.
    """
    stage = Stage(messages.sparkSession, "chat")
    conv = F.to_json(F.struct(F.col("conv_id").alias("c")))
    known = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.lower(F.trim("role"))).cast("int")
    order = ["conv_id", "turn", "role", F.xxhash64("text")]
    rows = messages.select("conv_id", "turn", "role", "text").repartitionByRange(partitions(messages.sparkSession), *order).sortWithinPartitions(*order)
    rows = stage.write(rows.withColumns({"position": F.monotonically_increasing_id(), "conv": conv, "code": F.coalesce(known, F.lit(0))}))
    tables = F.array(*[F.array(*[F.lit(int(x)).cast("long") for x in STEP[r].ravel()]) for r in range(4)])
    # messages are counted within their conversation, so only one of over 1024 has several blocks
    counted = stage.write(numbered(rows.select("position", "conv", "code"), ["position"], stage))
    counted = stage.write(salted_join(counted, counted.groupBy("conv").agg(F.min("base").alias("first")), "conv").withColumn("at", F.col("base") - F.col("first")))
    path = stage.write(solve(stage.write(counted.select("conv", "at", tables[F.col("code")].alias("matrix"))), stage))
    path = counted.select("conv", "at", "position").join(path, ["conv", "at"]).select("position", "before", "state")
    ends = rows.groupBy("conv").agg(F.max("position").alias("end"))
    marks = stage.write(ends.select(F.col("end").alias("position"), F.lit(True).alias("last")))
    out = rows.join(path, "position").join(marks, "position", "left").withColumn("last", F.coalesce("last", F.lit(False)))
    return render(out)


def render(rows: DataFrame) -> DataFrame:
    name = lambda c: F.element_at(F.array(*[F.lit(r) for r in ROLES]), c)
    before, state = F.col("before"), F.col("state")
    merged = (before == state) & (F.lit(MERGE) <= F.lit(EMPTY)) & (before != START)
    lists = F.array(*[F.array(*[F.lit(ROLES[r - 1]) for r in INSERTED.get((s, x), [])]).cast("array<string>") for s in range(4) for x in range(4)])
    inserted = F.when(merged, F.array().cast("array<string>")).otherwise(lists[before * 4 + state])
    changed = F.col("code") != state
    action = F.when(merged & changed, "relabel+merge").when(merged, "merge").when(changed, "relabel").otherwise("keep")
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
    head = lambda role: F.concat(F.lit(HEADER.split("{role}")[0]), role, F.lit(HEADER.split("{role}")[1]))
    opened = F.concat(F.when(before == START, "").otherwise("\n" + FOOTER), F.array_join(F.transform(inserted, lambda r: F.concat(head(r), F.lit("\n" + FOOTER))), ""), head(name(state)))
    tail = F.when(F.col("last") & ~state.isin(*FINAL), F.lit("\n" + FOOTER + HEADER.format(role="user") + "\n" + FOOTER)).when(F.col("last"), "\n" + FOOTER).otherwise("")
    return rows.select("conv_id", "turn", "role", name(state).alias("new_role"), action.alias("action"), inserted.alias("inserted"), (before == START).alias("first"), "last",
                       F.concat(F.when(merged, "\n").otherwise(opened), text, tail).alias("fragment"), "position")
