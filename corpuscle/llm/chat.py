"""Chat formatting with minimum-cost role repair.

A legal conversation has an optional system turn first and then user and assistant turns by turns, a user's first. Any
other is repaired: a turn keeps its role or is relabelled, is merged into the turn before it, or gets empty turns put
before it. Dynamic programming over the automaton of legal turns finds the cheapest repair; each turn is a small
min-plus matrix over the automaton's states, and a stretch of turns is the product of theirs.

So a conversation need not be in one place: turns are sorted over all partitions by conversation and turn and cut into
blocks of ``BLOCK`` rows and ``BLOCK_BYTES`` of text at most (a longer turn is a block by itself). Conversations inside a block are solved there. Of one that crosses blocks, each block gives
the matrix of its stretch; the stretches, one for each block, are solved for the states at the borders, and
each block then repairs its stretch between those.

The result has a row for each turn: its role after repair, what was done, empty turns put before it, its cost, and its
part of the rendered text (the parts of a conversation in order make the whole). Roles are read in any case, with usual
aliases; any other role, null included, costs a relabelling. Null texts are empty; null conversations make one
conversation; turns with equal numbers are ordered by role and the text's hash; null turns come first. Marks of the template inside texts are
broken by blanks. Ties prefer keeping, then merging, then relabelling, then inserting. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK, BLOCK_BYTES = 8192, 16_000_000
STATES = ("start", "system", "user", "assistant")
LEGAL = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
ALIASES = {"system": "system", "developer": "system", "user": "user", "human": "user", "prompter": "user", "assistant": "assistant", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant"}
#: Costs of the repairs (a merge of unlike roles costs both).
MERGE, RELABEL, INSERT = 1.0, 2.0, 3.0
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
NEVER = float("inf")


def _paths() -> dict[tuple[int, int], tuple[str, ...]]:
    """For a state and the state after the next turn: the empty turns to put between, as few as possible."""
    out = {}
    for s, name in enumerate(STATES):
        reach, seen = [((), name)], set()
        while reach:
            inserted, at = reach.pop(0)
            for to in LEGAL[at]:
                if to not in seen:
                    seen.add(to)
                    out[s, STATES.index(to)] = inserted
                    reach.append(((*inserted, to), to))
    return out


PATHS = _paths()


def moves(role: str | None) -> dict[tuple[int, int], tuple[float, int, str]]:
    """For each state before and after a turn of this role: the cheapest cost, its rank among ties, and what is done."""
    out: dict[tuple[int, int], tuple[float, int, str]] = {}
    for s, name in enumerate(STATES):
        for q in (1, 2, 3):
            choices = []
            if (s, q) in PATHS:
                cost = INSERT * len(PATHS[s, q]) + (0 if STATES[q] == role else RELABEL)
                choices.append((cost, (0 if STATES[q] == role else 2) + 3 * bool(PATHS[s, q]), "keep" if STATES[q] == role else "relabel"))
            if q == s:
                choices.append((MERGE + (0 if name == role else RELABEL), 1, "merge"))
            if choices:
                out[s, q] = min(choices)
    return out


MOVES = {role: moves(role) for role in (*STATES[1:], None)}


def stretch(roles: list[str | None]) -> list[list[float]]:
    """Cheapest cost from each state to each over these turns."""
    out = []
    for s in range(4):
        now = [0.0 if k == s else NEVER for k in range(4)]
        for role in roles:
            now = [min((now[a] + MOVES[role][a, q][0] for a in range(4) if (a, q) in MOVES[role]), default=NEVER) for q in range(4)]
        out.append(now)
    return out


def solve(roles: list[str | None], entry: int = 0, leave: int | None = None) -> list[tuple[int, int]]:
    """(state before, state after) of each turn in the cheapest repair between two states (any legal last one)."""
    now, back = [0.0 if k == entry else NEVER for k in range(4)], []
    for role in roles:
        step = MOVES[role]
        best = [min(((now[a] + step[a, q][0], step[a, q][1], a) for a in range(4) if (a, q) in step and now[a] < NEVER), default=(NEVER, 0, 0)) for q in range(4)]
        back.append([b[2] for b in best])
        now = [b[0] for b in best]
    at = leave if leave is not None else min((2, 3, 1), key=lambda q: (now[q], q == 1))
    out = []
    for step in reversed(back):
        out.append((step[at], at))
        at = step[at]
    return out[::-1]


def _clean(text: str) -> str:
    return text.replace("<|im_", "<| im_")


def _blocks(turns: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """Turns in order, numbered, with blocks; stored, so that numbers stay."""
    alias = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    rows = turns.select(
        F.concat(F.when(F.col("conv_id").isNull(), "n").otherwise("v"), common.text_or_empty(F.col("conv_id"))).alias("conv"),
        "conv_id", "turn", F.col("role").alias("given"), F.try_element_at(alias, F.lower(F.trim("role"))).alias("role"), common.text_or_empty(F.col("text")).alias("text"),
    )
    # a range shuffle samples its keys on the driver, so texts are none of them
    order = ["conv", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "tie"]
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    rows = rows.withColumn("seq", F.monotonically_increasing_id())
    at = rows.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, taken = None, 0, 0
        for batch in batches:
            out = []
            for seq, size in zip(batch.column(len(batch.columns) - 1).to_pylist(), pc.binary_length(batch.column(at)).to_pylist()):
                if here is None or held >= block or taken + size > block_bytes:
                    here, held, taken = seq, 0, 0
                held, taken = held + 1, taken + size
                out.append(here)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "block"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return common.stored(rows.mapInArrow(cut, f"{fields}, block long"), "turns")


def _borders(rows: DataFrame) -> DataFrame:
    """(block, conv, entry, leave) of the stretches of conversations that cross blocks."""
    span = rows.groupBy("conv").agg(F.min("block").alias("first"), F.max("block").alias("last")).where("first <> last").select("conv")
    span = common.stored(span, "crossing")

    def matrix(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        m = stretch([None if pd.isna(r) else r for r in pdf["role"]])
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "conv": [pdf["conv"].iloc[0]], "m": [[x for row in m for x in row]]})

    # at most two conversations of a block cross its borders
    parts = rows.join(span, "conv", "left_semi").select("block", "conv", "seq", "role").groupBy("block", "conv").applyInPandas(matrix, "block long, conv string, m array<double>")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        now, back = [0.0, NEVER, NEVER, NEVER], []
        for m in pdf["m"]:
            best = [min((now[a] + m[4 * a + q], a) for a in range(4)) for q in range(4)]
            back.append([b[1] for b in best])
            now = [b[0] for b in best]
        at, states = min((2, 3, 1), key=lambda q: (now[q], q == 1)), []
        for step in reversed(back):
            states.append((step[at], at))
            at = step[at]
        states.reverse()
        return pd.DataFrame({"block": pdf["block"], "conv": pdf["conv"], "entry": [s[0] for s in states], "leave": [s[1] for s in states], "whole": [k == len(states) - 1 for k in range(len(states))]})

    return parts.groupBy("conv").applyInPandas(chain, "block long, conv string, entry int, leave int, whole boolean")


def repair(turns: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """conv_id, turn, given, role, action, inserted, cost, rendered: a row for each turn, in repaired form."""
    rows = _blocks(turns, block, block_bytes)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn", "given")}
    borders = common.stored(_borders(rows), "borders")
    rows = rows.join(borders, ["block", "conv"], "left")

    def fix(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq").reset_index(drop=True)
        role, action, inserted, cost, rendered = [], [], [], [], []
        for _, part in pdf.groupby("conv", sort=False):
            roles = [None if pd.isna(r) else r for r in part["role"]]
            crossing = pd.notna(part["entry"].iloc[0])
            entry, leave = (int(part["entry"].iloc[0]), int(part["leave"].iloc[0])) if crossing else (0, None)
            done = solve(roles, entry, leave)
            for k, (given, text, (a, q)) in enumerate(zip(roles, part["text"], done)):
                price, _, what = MOVES[given][a, q]
                empty = () if what == "merge" else PATHS[a, q]
                before = "" if a == 0 else CLOSE + "\n"
                if what == "merge":
                    piece = "\n" + _clean(text)
                else:
                    piece = before + "".join(f"{OPEN}{r}\n{CLOSE}\n" for r in empty) + f"{OPEN}{STATES[q]}\n" + _clean(text)
                if k == len(roles) - 1 and (not crossing or bool(part["whole"].iloc[0])):
                    piece += CLOSE + "\n"
                role.append(STATES[q])
                action.append(what + "+insert" * bool(empty))
                inserted.append(",".join(empty))
                cost.append(price)
                rendered.append(piece)
        return pdf[["conv_id", "turn", "given"]].assign(role=role, action=action, inserted=inserted, cost=cost, rendered=rendered)

    return rows.groupBy("block").applyInPandas(fix, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, given {kinds['given']}, role string, action string, inserted string, cost double, rendered string")
