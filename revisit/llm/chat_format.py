"""Chat formatting: minimum-cost role repair, then rendering.

Legal turns: an optional system turn first, then user and assistant in turn,
starting with user.  Each turn is kept, relabelled, merged into the turn
before it, or preceded by an inserted empty turn; a dynamic program over the
automaton's states (role of the last turn written) finds the cheapest
repair.  Turn costs are small matrices over states and the program is their
(min, +) product, so a conversation of any length is cut into blocks of
``BLOCK`` turns: blocks yield their matrix, one light pass over the matrices
of a conversation fixes the states between blocks, and every block then
traces its own turns.

The result has one row per input turn with its piece of the rendered text;
the pieces of a conversation, by ``position``, concatenate to its text.

Defined cases: roles are trimmed and lower-cased, a few usual names are read
as user or assistant, null or other roles are unknown and may take any role
cheaply; null text is empty; template markers inside texts are broken up;
turns are ordered by turn (null first), then role and text, so repeated rows
are turns of their own; rows with a null conv_id are one conversation; no
rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revisit.llm.store import stored

BLOCK = 4096
START, SYSTEM, USER, ASSISTANT = range(4)
UNKNOWN = 0                                   # as the role of an input turn
NAMES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
ROLES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER,
         "assistant": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT}
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
RELABEL, RELABEL_UNKNOWN, MERGE, MERGE_OTHER, INSERT = 4, 1, 2, 7, 3
NEVER = 1 << 40
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def options(role: int, state: int) -> dict[int, tuple[int, str, int]]:
    """{next state: (cost, action, inserted role or 0)}, cheapest first."""
    found: dict[int, tuple[int, str, int]] = {}
    for new in (SYSTEM, USER, ASSISTANT):
        cost, action = (0, "keep") if new == role else (RELABEL_UNKNOWN if role == UNKNOWN else RELABEL, "relabel")
        if new in FOLLOWS[state]:
            found[new] = (cost, action, 0)
        else:
            for between in FOLLOWS[state]:
                if between != SYSTEM and new in FOLLOWS[between]:
                    found[new] = (cost + INSERT, action, between)
    if state != START:
        cost = MERGE if role in (state, UNKNOWN) else MERGE_OTHER
        if cost < found.get(state, (NEVER,))[0]:
            found[state] = (cost, "merge", 0)
    return found


OPTIONS = [[options(role, state) for state in range(4)] for role in range(4)]
COST = np.array([[[OPTIONS[r][s].get(t, (NEVER,))[0] for t in range(4)] for s in range(4)] for r in range(4)], np.int64)
IDENTITY = np.where(np.eye(4, dtype=bool), 0, NEVER).astype(np.int64)


def role_code(role: str | None) -> int:
    return ROLES.get((role or "").strip().lower(), UNKNOWN)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), NEVER)


def trace(roles: list[int], entry: int, leave: int) -> tuple[int, list[tuple[int, str, int, int]]]:
    """(cost, per turn (new role, action, inserted, cost)) of the cheapest
    repair from state ``entry`` to state ``leave`` (smallest state on ties)."""
    cost = {entry: 0}
    back: list[dict[int, int]] = []
    for role in roles:
        nxt: dict[int, int] = {}
        came: dict[int, int] = {}
        for state in sorted(cost):
            for new, (c, _, _) in OPTIONS[role][state].items():
                if cost[state] + c < nxt.get(new, NEVER):
                    nxt[new], came[new] = cost[state] + c, state
        cost = nxt
        back.append(came)
    steps, state = [], leave
    for role, came in zip(reversed(roles), reversed(back)):
        before = came[state]
        c, action, inserted = OPTIONS[role][before][state]
        steps.append((state, action, inserted, c))
        state = before
    return cost[leave], steps[::-1]


def clean(text: str | None) -> str:
    return (text or "").replace("<|im_", "<| im_")


def piece(step: tuple[int, str, int, int], text: str | None, first: bool, last: bool) -> str:
    """Rendered part of one turn; a turn closes the one before it."""
    role, action, inserted, _ = step
    close = "" if first else CLOSE
    if action == "merge":
        out = "\n" + clean(text)
    else:
        gap = f"{OPEN}{NAMES[inserted]}\n{CLOSE}" if inserted else ""
        out = f"{close}{gap}{OPEN}{NAMES[role]}\n{clean(text)}"
    return out + (CLOSE if last else "")


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of rows that agree on the first ``width`` columns (sorted input)."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            if row[:width] != key and rows:
                yield key, rows
                rows = []
            key = row[:width]
            rows.append(row[width:])
    if rows:
        yield key, rows


def format_chats(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Repaired and rendered turns of every conversation."""
    spark = turns.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text_hash")]
    ranged = (turns.select("conv_id", "turn", "role", "text").withColumn("text_hash", F.xxhash64("text"))
              .repartitionByRange(parts, *order).sortWithinPartitions(*order, F.asc_nulls_first("text")))
    # Written once, the ids are fixed and ascend in conversation order.
    rows = stored(ranged.drop("text_hash").withColumn("row", F.monotonically_increasing_id()), "turns")
    rows = rows.withColumn("block", F.floor(F.col("row") / block))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, b), found in _blocks(batches, 2):
            total = IDENTITY
            for _, role in found:
                total = product(total, COST[role_code(role)])
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], pa.int64()), "block": pa.array([b], pa.int64()),
                                              "n": pa.array([len(found)], pa.int64()), "matrix": pa.array([total.ravel().tolist()], pa.list_(pa.int64()))})
    dealt = rows.select("conv_id", "block", "row", "role").repartition(parts, "conv_id", "block").sortWithinPartitions("conv_id", "block", "row")
    summary = dealt.mapInArrow(matrices, "conv_id long, block long, n long, matrix array<long>")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv,), blocks in _blocks(batches, 1):
            cost = np.full(4, NEVER)
            cost[START] = 0
            came = []
            for _, _, m in blocks:
                step = cost[:, None] + np.array(m).reshape(4, 4)
                came.append(step.argmin(axis=0))
                cost = np.minimum(step.min(axis=0), NEVER)
            state, out = int(cost.argmin()), []
            for (b, n, _), back in zip(reversed(blocks), reversed(came)):
                out.append((b, int(back[state]), state, n))
                state = int(back[state])
            number = 0
            ends = []
            for i, (b, entry, leave, n) in enumerate(reversed(out)):
                ends.append({"conv_id": conv, "block": b, "entry": entry, "leave": leave, "before": number, "final": i + 1 == len(out)})
                number += n
            yield pa.RecordBatch.from_pylist(ends, pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("entry", pa.int32()),
                                                              ("leave", pa.int32()), ("before", pa.int64()), ("final", pa.bool_())]))
    states = (summary.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "block")
              .mapInArrow(settle, "conv_id long, block long, entry int, leave int, before long, final boolean"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, _), found in _blocks(batches, 2):
            _, entry, leave, before, final = (found[0][i] for i in (0, 4, 5, 6, 7))
            _, steps = trace([role_code(r[2]) for r in found], entry, leave)
            out = []
            for i, (r, step) in enumerate(zip(found, steps)):
                out.append({"conv_id": conv, "position": before + i, "turn": r[1], "role": r[2], "action": step[1], "new_role": NAMES[step[0]],
                            "inserted": NAMES.get(step[2]), "cost": step[3],
                            "rendered": piece(step, r[3], before + i == 0, final and i + 1 == len(found))})
            yield pa.RecordBatch.from_pylist(out, pa.schema([
                ("conv_id", pa.int64()), ("position", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("action", pa.string()),
                ("new_role", pa.string()), ("inserted", pa.string()), ("cost", pa.int32()), ("rendered", pa.string())]))
    same = rows["conv_id"].eqNullSafe(states["conv_id"]) & (rows["block"] == states["block"])
    joined = (rows.join(states, same).select(rows["conv_id"], rows["block"], "row", F.col("turn").cast("long").alias("turn"), "role", "text",
                                             "entry", "leave", "before", "final")
              .repartition(parts, "conv_id", "block").sortWithinPartitions("conv_id", "block", "row"))
    return joined.mapInArrow(write, "conv_id long, position long, turn long, role string, action string, new_role string, "
                                    "inserted string, cost int, rendered string")
