"""Clips inside candidates: runs of children, offsets, planned lengths.

A candidate's children are an array in time order; a section takes from the chosen child
onwards. All rules are folds over that array inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most clips of one candidate, and for roles that show steps.
MOST, MOST_STEPS, STEP_ROLES = 2, 4, ("proof", "packaging")
#: How far before its anchor a plan begins, how late a proof leans without one, the least room to move in.
LEAD, LATE, ROOM = 0.28, 0.65, 0.45
#: How near a child's place must be to an anchor, and what nearness is worth.
NEAR_ORDER, NEAR_PROOF, LEAN = (0.42, 0.45), (0.62, 0.9), (0.9, 0.4)


def child_run(children: Column, chosen: Column, budget: Column, role: Column, least: Column, packaging: Column | None = None) -> Column:
    """(shot_id, offset_s, planned_s, short) of children from the chosen one on, until the budget is used.

    Children shorter than ``least`` are passed over while more than that is to be filled;
    a child may be cut by what is left. Where nothing else is there, the first one that was
    passed over stands in, marked as short. Packaging sections begin with the first child.
    """
    starts_first = F.coalesce(packaging, F.lit(False)) if packaging is not None else F.lit(False)
    most = F.when(role.isin(*STEP_ROLES) | starts_first, MOST_STEPS).otherwise(MOST)
    found = F.array_position(F.transform(children, lambda c: c["shot_id"]), chosen).cast("int")
    at = F.when(starts_first, 1).otherwise(F.greatest(F.coalesce(found, F.lit(1)), F.lit(1)))
    item = "struct<shot_id:string,offset_s:double,planned_s:double,short:boolean>"
    kind = f"struct<left_s:double,out:array<{item}>,passed:array<{item}>>"
    none = F.array().cast(f"array<{item}>")
    start = F.struct(budget.cast("double").alias("left_s"), none.alias("out"), none.alias("passed")).cast(kind)

    def step(acc: Column, c: Column) -> Column:
        take = F.least(c["duration_s"], acc["left_s"])
        one = lambda short: F.array(
            F.struct(c["shot_id"].alias("shot_id"), F.lit(0.0).alias("offset_s"), F.round(take, 3).alias("planned_s"), F.lit(short).alias("short")).cast(item)
        )
        over = (acc["left_s"] <= 0.03) | (F.size(acc["out"]) >= most) | (take <= 0)
        brief = (take + 0.08 < least) & (acc["left_s"] > least + 0.08)
        waits = F.struct(acc["left_s"].alias("left_s"), acc["out"].alias("out"), F.concat(acc["passed"], one(True)).alias("passed"))
        used = F.struct(F.greatest(F.lit(0.0), acc["left_s"] - take).alias("left_s"), F.concat(acc["out"], one(False)).alias("out"), acc["passed"].alias("passed"))
        return F.when(over, acc).when(brief, waits.cast(kind)).otherwise(used.cast(kind))

    rest = F.slice(children, at, F.greatest(F.size(children) - at + 1, F.lit(0)))
    return F.aggregate(rest, start, step, lambda a: F.when(F.size(a["out"]) > 0, a["out"]).otherwise(F.slice(a["passed"], 1, 1)))


def clip_run(
    children: Column, chosen: Column, budget: Column, role: Column, least: Column, packaging: Column,
    parent: Column, parent_duration: Column, parent_offset: Column, inner_offset: Column,
) -> Column:
    """The clips of a candidate: one of its own file from where the chosen child begins, else a run of children.

    ``parent`` is null for candidates without a file. Offsets are of the chosen child in
    the file and of the plan in the child; packaging sections begin at the file's start.
    """
    base = F.when(packaging & (parent_duration >= 0.3), 0.0).otherwise(parent_offset)
    at = F.least(base + inner_offset, F.greatest(parent_duration, F.lit(0.0)))
    own = F.struct(
        parent.alias("shot_id"), F.round(at, 3).alias("offset_s"),
        F.round(F.least(F.greatest(budget, F.lit(0.0)), F.greatest(parent_duration - at, F.lit(0.0))), 3).alias("planned_s"), F.lit(False).alias("short"),
    ).cast("struct<shot_id:string,offset_s:double,planned_s:double,short:boolean>")
    usable = parent.isNotNull() & (parent_duration > 0) & (base < parent_duration - 0.03)
    run = child_run(children, chosen, budget, role, least, packaging)
    return F.when(budget <= 0, F.slice(run, 1, 0)).when(F.coalesce(usable, F.lit(False)), F.array(own)).otherwise(run)


def start_offset(duration: Column, planned: Column, anchor: Column, role: Column, has_action: Column) -> Column:
    """Where in a clip the plan begins: a lead before the anchor (0 to 1); a proof without one leans late.

    The start stays at 0 where there is little room or the section asks for no action.
    """
    d = F.greatest(F.lit(0.0), duration)
    take = F.least(F.greatest(F.coalesce(planned, F.lit(0.0)), F.lit(0.0)), d)
    room = F.greatest(F.lit(0.0), d - take)
    wanted = F.when(anchor.isNotNull(), anchor * d - LEAD * take).when(role == "proof", LATE * room).otherwise(0.0)
    moves = (room > ROOM) & has_action
    return F.when(moves, F.round(F.greatest(F.lit(0.0), F.least(room, wanted)), 3)).otherwise(0.0)


def parent_clip(start: Column, end: Column, usable_start: Column, usable_end: Column, planned: Column) -> Column:
    """(source_start_s, source_end_s, planned_s) inside the usable range, which is held to the interval."""
    a = F.greatest(start, F.coalesce(usable_start, start))
    b = F.least(end, F.coalesce(usable_end, end))
    take = F.least(F.greatest(b - a, F.lit(0.0)), planned)
    return F.struct(F.round(a, 3).alias("source_start_s"), F.round(a + take, 3).alias("source_end_s"), F.round(take, 3).alias("planned_s"))


def _near(i: Column, n: Column, anchor: Column, reach: tuple[float, float]) -> Column:
    off = F.abs((i + 0.5) / n - anchor)
    return F.when((n > 1) & anchor.isNotNull(), F.greatest(F.lit(0.0), reach[0] - off) * reach[1]).otherwise(0.0)


def order_hint(i: Column, n: Column, anchor: Column) -> Column:
    """What it is worth that child i (from 0) of n lies near where its terms stand in the text (0 to 1)."""
    return _near(i, n, anchor, NEAR_ORDER)


def proof_order(i: Column, n: Column, anchor: Column) -> Column:
    """The same for where a proof's actions stand in the parent's text."""
    return _near(i, n, anchor, NEAR_PROOF)


def late_lean(i: Column, n: Column) -> Column:
    """Later children are likelier to show what only their parent's text names."""
    late = i / F.greatest(F.lit(1), n - 1)
    return F.when(n > 1, late * LEAN[0] - (1 - late) * LEAN[1]).otherwise(0.0)


def notes(**tests: Column) -> Column:
    """Notes on a selection, by the conditions that hold."""
    return F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())
