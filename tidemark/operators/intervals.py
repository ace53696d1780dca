"""Intervals on time axes: running axes, islands, snapping, overlaps, splits, budgets.

Half-open intervals [start, end). What can be said with windows or joins is; steps that
depend on their own earlier choices are folds over one entity's sorted array, in the JVM.
Running values go through scan.Sliced, so that no task has to hold a very large key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import ISLAND_GAP_S, ISLAND_SPAN_S, MIN_CAPTION_S, OVERLAP_S
from .scan import Sliced, running_sum


def _all(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def running_axis(df: DataFrame, keys: list[str], order: list[str], duration: str) -> DataFrame:
    """start_s is the sum of the durations before, end_s adds the row's own."""
    s = Sliced(df, keys, order)
    rows = running_sum(s, s.rows, duration, "_start")
    rows = rows.withColumn("start_s", F.round("_start", 3)).withColumn("end_s", F.round(F.col("_start") + F.col(duration), 3))
    return s.done(rows, "_start")


def proportional_axis(df: DataFrame, keys: list[str], order: list[str], units: str, total: str) -> DataFrame:
    """Shares of a total by units; the last row ends at the total."""
    s = Sliced(df, keys, order)
    parts = {"_sum": F.sum(units), "_n": F.count("*")}
    rows = s.carry(s.rows, parts, lambda before, behind: {"_before": F.sum("_sum").over(before), "_behind": F.sum("_sum").over(behind), "_later": F.sum("_n").over(behind)})
    zero = F.lit(0)
    upto = F.coalesce("_before", zero) + F.sum(units).over(s.running())
    whole = F.coalesce("_before", zero) + F.sum(units).over(Window.partitionBy(*keys, "_slice")) + F.coalesce("_behind", zero)
    last = F.lead(F.lit(1)).over(s.window()).isNull() & (F.coalesce("_later", zero) == 0)
    rows = rows.withColumns({"_upto": upto, "_whole": whole, "_last": last})
    # Rounded as SQL engines do, by thousandths: the shortest decimal of a double may be a tie that its thousandfold is not.
    share = lambda u: F.round(F.col(total) * u / F.col("_whole") * 1000) / 1000
    rows = rows.withColumn("start_s", share(F.col("_upto") - F.col(units))).withColumn("end_s", F.when(F.col("_last"), F.round(total, 3)).otherwise(share(F.col("_upto"))))
    return s.done(rows, "_before", "_behind", "_later", "_upto", "_whole", "_last")


def monotonic(df: DataFrame, keys: list[str], order: list[str], least: float = MIN_CAPTION_S) -> DataFrame:
    """Repair start_s and end_s: no start before the last end, no row shorter than ``least``.

    The running rule has a closed form: with b = max(end, max(start, 0) + least), row i
    ends at max over j <= i of (b_j - least j), plus least i. So a slice passes on how many
    rows it has and its largest b_j - least j.
    """
    s = Sliced(df, keys, ["start_s", *order])
    b = F.greatest(F.col("end_s"), F.greatest(F.col("start_s"), F.lit(0.0)) + least)
    rows = s.rows.withColumn("_i", F.row_number().over(s.window())).withColumn("_b", b - F.col("_i") * F.lit(least))

    # Two steps over the slices' rows: where each begins, then the largest value so far.
    rows = s.carry(rows, {"_rows": F.count("*")}, lambda before, _: {"_n": F.sum("_rows").over(before)})
    rows = rows.withColumn("_n", F.coalesce("_n", F.lit(0)))
    rows = s.carry(rows, {"_top": F.max(F.col("_b") - F.col("_n") * F.lit(least))}, lambda before, _: {"_most": F.max("_top").over(before)})
    i = F.col("_n") + F.col("_i")
    upto = lambda w: F.greatest(F.max(F.col("_b") - F.col("_n") * F.lit(least)).over(w), F.col("_most"))
    rows = rows.withColumns({"_e": upto(s.running()) + i * F.lit(least), "_p": upto(s.earlier()) + (i - 1) * F.lit(least)})
    start = F.greatest(F.col("start_s"), F.coalesce("_p", F.lit(0.0)))
    rows = rows.withColumn("_s", start)
    rows = (
        rows.withColumn("adjusted", (F.abs(F.col("_s") - F.col("start_s")) > 0.001) | (F.abs(F.col("_e") - F.col("end_s")) > 0.001))
        .withColumn("start_s", F.round("_s", 3))
        .withColumn("end_s", F.round("_e", 3))
    )
    return s.done(rows, "_i", "_b", "_n", "_most", "_e", "_p", "_s")


def overlaps_before(df: DataFrame, keys: list[str], order: list[str], tolerance: float = 0.04, last_only: bool = False) -> DataFrame:
    """overlap: a row starts before an earlier end (or only the last one), beyond a tolerance."""
    s = Sliced(df, keys, order)
    if last_only:
        end, rows = F.lag("end_s").over(s.window()), _before_slices(s, s.rows, "end_s")
        end = F.when(F.row_number().over(s.window()) == 1, F.col("_carry")).otherwise(end)
    else:
        rows = s.carry(s.rows, {"_part": F.max("end_s")}, lambda before, _: {"_carry": F.max("_part").over(before)})
        end = F.greatest(F.max("end_s").over(s.earlier()), F.col("_carry"))
    return s.done(rows.withColumn("overlap", F.coalesce(F.col("start_s") < end - tolerance, F.lit(False))), "_carry")


def _before_slices(s: Sliced, rows: DataFrame, value: str) -> DataFrame:
    """_carry: the value of the last row in the slices before."""
    at = F.struct(*[F.col(c) for c in s.order])
    return s.carry(rows, {"_part": F.max_by(F.struct(F.col(value).alias("v")), at)}, lambda before, _: {"_carry": F.last("_part", ignorenulls=True).over(before)["v"]})


def points_to_intervals(df: DataFrame, keys: list[str], point: str, shortest: float = OVERLAP_S) -> DataFrame:
    """Neighbouring points as intervals; short ones are left out."""
    s = Sliced(df.select(*keys, F.col(point).alias("start_s")), keys, ["start_s"])
    rows = s.carry(s.rows, {"_part": F.min("start_s")}, lambda _, behind: {"_carry": F.min("_part").over(behind)})
    end = F.coalesce(F.lead("start_s").over(s.window()), F.col("_carry"))
    return s.done(rows.withColumn("end_s", end), "_carry").filter(F.col("end_s") - F.col("start_s") > shortest)


def gap_islands(df: DataFrame, keys: list[str], order: list[str], gap: float | Column) -> DataFrame:
    """island: number of the run of rows whose gaps to all before are at most ``gap``."""
    s = Sliced(df, keys, order)
    rows = s.carry(s.rows, {"_part": F.max("end_s")}, lambda before, _: {"_carry": F.max("_part").over(before)})
    reach = F.greatest(F.max("end_s").over(s.earlier()), F.col("_carry"))
    rows = rows.withColumn("_new", F.coalesce((F.col("start_s") - reach > gap).cast("int"), F.lit(1))).drop("_carry")
    return s.done(running_sum(s, rows, "_new", "island", own=True), "_new")


def capped_islands(df: DataFrame, keys: list[str], gap: float = ISLAND_GAP_S, span: float = ISLAND_SPAN_S) -> DataFrame:
    """Runs of an entity's intervals with small gaps and a bounded span: keys, island, start_s, end_s, n.

    A run's span depends on where it began, so rows fold in order. A gap that is too wide
    begins a run in any case: an entity's rows are cut there first, by running values,
    and only the stretches between are gathered for the fold.
    """
    s = Sliced(df.select(*keys, "start_s", "end_s"), keys, ["start_s", "end_s"])
    last = F.when(F.row_number().over(s.window()) == 1, F.col("_carry")).otherwise(F.lag("end_s").over(s.window()))
    rows = _before_slices(s, s.rows, "end_s").withColumn("_new", F.coalesce((F.col("start_s") - last > gap).cast("int"), F.lit(1))).drop("_carry")
    rows = s.done(running_sum(s, rows, "_new", "_part", own=True))
    rows = rows.groupBy(*keys, "_part").agg(F.array_sort(F.collect_list(F.struct("start_s", "end_s"))).alias("rows"))
    kind = "array<struct<start_s:double,last_s:double,end_s:double,n:int>>"
    new = lambda x: F.array(F.struct(x["start_s"].alias("start_s"), x["end_s"].alias("last_s"), x["end_s"].alias("end_s"), F.lit(1).alias("n")))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (x["start_s"] - last["last_s"] <= gap) & (x["end_s"] - last["start_s"] <= span)
        longer = F.array(
            F.struct(
                last["start_s"].alias("start_s"), x["end_s"].alias("last_s"),
                F.greatest(last["end_s"], x["end_s"]).alias("end_s"), (last["n"] + 1).alias("n"),
            )
        )
        return F.when(F.size(acc) == 0, new(x)).when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), longer)).otherwise(F.concat(acc, new(x)))

    folded = F.aggregate("rows", F.array().cast(kind), step)
    out = rows.select(*keys, "_part", F.posexplode(folded).alias("_p", "_g"))
    number = F.row_number().over(_all(keys, ["_part", "_p"]))
    return out.select(*keys, number.alias("island"), "_g.start_s", "_g.end_s", "_g.n")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def merge_short(bounds: Column, shortest: float, forward: bool = False) -> Column:
    """Sorted bounds as segments, short ones joined to a neighbour: array of (start_s, end_s).

    The first short segment is merged each time, into its shorter neighbour (the left one
    on a tie), or always into the next with ``forward``; then the search starts anew. What
    is left of the first short segment is never short again, so one pass is enough: the
    segment at hand grows to the right until it is long enough, or goes into the last
    finished one. The fold keeps the starts of finished segments, in blocks, so that a step
    copies few of them.
    """
    block = 64
    kind = "struct<done:array<array<double>>,some:array<double>,left:double,start:double>"

    def step(acc: Column, x: Column) -> Column:
        start, end, right = acc["start"], x["end"], x["right"]
        put = lambda done, some, left, start: F.struct(done.alias("done"), some.alias("some"), left.alias("left"), start.alias("start"))
        same = lambda at: put(acc["done"], acc["some"], acc["left"], at)
        full = F.size(acc["some"]) >= block
        finished = put(
            F.when(full, F.concat(acc["done"], F.array(acc["some"]))).otherwise(acc["done"]),
            F.when(full, F.array(start)).otherwise(F.concat(acc["some"], F.array(start))), start, end,
        )
        to_left = F.lit(False) if forward else start - acc["left"] <= right
        return (
            F.when((end - start >= shortest) | (right.isNull() & acc["left"].isNull()), finished)
            .when(acc["left"].isNotNull() & (right.isNull() | to_left), same(end))
            .otherwise(same(start))
        )

    def segments(b: Column) -> Column:
        ends, later = F.slice(b, 2, F.size(b) - 1), F.slice(b, 3, F.greatest(F.size(b) - 2, F.lit(0)))
        steps = F.zip_with(ends, F.transform(F.arrays_zip(ends, later), lambda p: p["1"] - p["0"]), lambda e, r: F.struct(e.alias("end"), r.alias("right")))
        begin = F.struct(F.array().cast("array<array<double>>").alias("done"), F.array().cast("array<double>").alias("some"), F.lit(None).cast("double").alias("left"), b[0].alias("start"))
        folded = F.aggregate(steps, begin.cast(kind), step, lambda acc: F.concat(F.flatten(acc["done"]), acc["some"]))
        whole = _let(folded, lambda s: F.zip_with(s, F.concat(F.slice(s, 2, F.size(s) - 1), F.slice(b, -1, 1)), lambda x, y: F.struct(F.round(x, 3).alias("start_s"), F.round(y, 3).alias("end_s"), (y - x).alias("n"))))
        kept = F.filter(whole, lambda s: s["n"] > OVERLAP_S)
        return F.transform(kept, lambda s: F.struct(s["start_s"].alias("start_s"), s["end_s"].alias("end_s")))

    none = F.array().cast("array<struct<start_s:double,end_s:double>>")
    return _let(bounds, lambda b: F.when(F.size(b) >= 2, segments(b)).otherwise(none))


def inner_bounds(start: Column, end: Column, cuts: Column, padding: float = 0.25) -> Column:
    """start, the cuts well inside, end."""
    inside = lambda low, high: F.filter(cuts, lambda c: (c > low) & (c < high))
    kept = _let(start + padding, lambda low: _let(end - padding, lambda high: inside(low, high)))
    return F.concat(F.array(start), F.array_sort(kept), F.array(end))


def split_by_cuts(df: DataFrame, start: str = "start_s", end: str = "end_s", cuts: str = "cuts", shortest: float = 1.2, padding: float = 0.25) -> DataFrame:
    """A row for each piece of an interval between its cuts: piece, n_pieces, piece_start_s, piece_end_s."""
    df = df.withColumn("_bounds", inner_bounds(F.col(start), F.col(end), F.col(cuts), padding))
    df = df.withColumn("_segs", merge_short(F.col("_bounds"), shortest))
    # Outer, and filtered behind: a plain explode asks first whether there is anything, by computing it again.
    return (
        df.withColumn("n_pieces", F.size("_segs"))
        .select("*", F.posexplode_outer("_segs").alias("_p", "_g"))
        .filter("_p IS NOT NULL")
        .withColumns({"piece": F.col("_p") + 1, "piece_start_s": F.col("_g.start_s"), "piece_end_s": F.col("_g.end_s")})
        .drop("_bounds", "_segs", "_p", "_g")
    )


def nearest(points: Column, value: Column, tolerance: float) -> Column:
    """The nearest point within a tolerance, the earlier of two as near; null without one."""
    near = F.filter(points, lambda c: F.abs(c - value) <= tolerance)
    return F.array_min(F.transform(near, lambda c: F.struct(F.abs(c - value).alias("d"), c.alias("c"))))["c"]


def snap_to_cuts(df: DataFrame, keys: list[str], order: list[str], cuts: str, tolerance: float = 0.95, shortest: float = 1.2) -> DataFrame:
    """Inner boundaries of a row of intervals moved to cuts: snapped_start_s, snapped_end_s.

    The first start and the last end stay. Two neighbours whose boundaries come to lie
    within the tolerance share one: the earlier row's if it was snapped, else the later's.
    Rows that would get too short keep their own bounds.
    """
    w = _all(keys, order)
    first, last = F.lag("start_s").over(w).isNull(), F.lead("start_s").over(w).isNull()
    df = df.withColumns({"_first": first, "_last": last})
    df = df.withColumns(
        {
            "_cs": F.when(~F.col("_first"), nearest(F.col(cuts), F.col("start_s"), tolerance)),
            "_ce": F.when(~F.col("_last"), nearest(F.col(cuts), F.col("end_s"), tolerance)),
        }
    )
    df = df.withColumns({"_s": F.coalesce("_cs", "start_s"), "_e": F.coalesce("_ce", "end_s")})
    df = df.withColumns(
        {"_ns": F.lead("_s").over(w), "_pe": F.lag("_e").over(w), "_pce": F.lag("_ce").over(w)}
    )
    end = F.when((F.abs(F.col("_e") - F.col("_ns")) <= tolerance) & F.col("_ce").isNull(), F.col("_ns")).otherwise(F.col("_e"))
    start = F.when((F.abs(F.col("_pe") - F.col("_s")) <= tolerance) & F.col("_pce").isNotNull(), F.col("_pe")).otherwise(F.col("_s"))
    df = df.withColumns({"_fs": start, "_fe": end})
    ok = F.col("_fe") - F.col("_fs") >= shortest
    out = df.withColumns(
        {
            "snapped_start_s": F.round(F.when(ok, F.col("_fs")).otherwise(F.col("start_s")), 3),
            "snapped_end_s": F.round(F.when(ok, F.col("_fe")).otherwise(F.col("end_s")), 3),
            "snapped": ok,
        }
    )
    return out.drop("_first", "_last", "_cs", "_ce", "_s", "_e", "_ns", "_pe", "_pce", "_fs", "_fe")


def overlap_join(left: DataFrame, right: DataFrame, key: str, least: float = OVERLAP_S, slot: float | None = None) -> DataFrame:
    """Pairs of l_ and r_ intervals of one key that share more than ``least``.

    With ``slot`` both sides are dealt to time slots of that width as well, so that a key
    with very many intervals is spread; a pair is kept in the slot where it begins.
    """
    share = F.least("l_end", "r_end") - F.greatest("l_start", "r_start")
    if slot is None:
        return left.join(right, key).withColumn("overlap_s", share).filter(F.col("overlap_s") > least)
    slots = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / slot), F.floor(F.col(e) / slot)))
    pairs = left.withColumn("_slot", slots("l_start", "l_end")).join(right.withColumn("_slot", slots("r_start", "r_end")), [key, "_slot"])
    here = F.floor(F.greatest("l_start", "r_start") / slot) == F.col("_slot")
    return pairs.filter(here).withColumn("overlap_s", share).filter(F.col("overlap_s") > least).drop("_slot")


def nearest_start(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_at: str, right_at: str, keys: list[str] | None = None) -> DataFrame:
    """For each left row the right row that starts nearest (the smaller id on a tie): an as-of join.

    Both sides are laid on one axis; the nearest before and after are running values, so
    a key's rows are sorted once and no pairs are made. Slices of a large key pass on their
    last and first right row.
    """
    keys = keys or []
    if dict(left.dtypes)[left_at] == "timestamp_ntz":  # distances need instants
        left, right = left.withColumn(left_at, F.col(left_at).cast("timestamp")), right.withColumn(right_at, F.col(right_at).cast("timestamp"))
    kind = lambda df, at, i: df.select(*keys, F.col(at).alias("_at"), i.alias("_right"), F.col(left_id if df is left else right_id).alias("_id"))
    both = kind(left, left_at, F.lit(False)).unionByName(kind(right, right_at, F.lit(True)))
    s = Sliced(both, keys, ["_at"])
    w = s.window()
    latest = F.when(F.col("_right"), F.struct(F.col("_at").alias("t"), (-F.col("_id")).alias("i"), F.col("_id").alias("id")))
    first = F.when(F.col("_right"), F.struct(F.col("_at").alias("t"), F.col("_id").alias("i"), F.col("_id").alias("id")))
    rows = s.carry(s.rows, {"_l": F.max(latest), "_f": F.min(first)}, lambda before, behind: {"_cb": F.max("_l").over(before), "_ca": F.min("_f").over(behind)})
    # Rows of one instant are peers in a range frame, so both sides see each other.
    before = F.coalesce(F.max(latest).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.col("_cb"))
    # From the end backwards: a frame up to the end would be summed anew for every row.
    back = Window.partitionBy(*keys, "_slice").orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = F.coalesce(F.min(first).over(back), F.col("_ca"))
    # Whole microseconds, so that two rows as near are equally near; they become seconds at the end.
    instants = dict(both.dtypes)["_at"].startswith("timestamp")
    place = F.unix_micros if instants else lambda x: x.cast("double")
    d = lambda x: F.abs(place(x["t"]) - place(F.col("_at")))
    out = rows.withColumns({"_b": before, "_a": after}).filter(~F.col("_right"))
    near = F.least(
        F.when(F.col("_b").isNotNull(), F.struct(d(F.col("_b")).alias("d"), F.col("_b.id").alias("id"))),
        F.when(F.col("_a").isNotNull(), F.struct(d(F.col("_a")).alias("d"), F.col("_a.id").alias("id"))),
    )
    distance = near["d"] / 1e6 if instants else near["d"]
    return out.select(*keys, F.col("_id").alias(left_id), near["id"].alias(right_id), distance.alias("distance_s"))


def contiguous(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Whether the indexes of each group make a full range."""
    return df.groupBy(*keys).agg(
        (F.max(index) - F.min(index) + 1 == F.countDistinct(index)).alias("contiguous"), F.min(index).alias("first"), F.max(index).alias("last")
    )


def trim_end(start: Column, end: Column, fps: Column) -> Column:
    """The end less one frame, where enough is left."""
    frame = F.coalesce(F.try_divide(F.lit(1.0), F.when(fps > 0, fps)), F.lit(0.0))
    return F.when((frame > 0) & (end - start > frame + 0.05), end - frame).otherwise(end)


def fill_budget(df: DataFrame, keys: list[str], order: list[str], duration: str, budget: str, done: float = 0.03) -> DataFrame:
    """Rows in order take from a budget until at most ``done`` is left: taken_s, left_s."""
    s = Sliced(df, keys, order)
    rows = s.done(running_sum(s, s.rows, duration, "_used"))
    return (
        rows.withColumn("_left", F.greatest(F.lit(0.0), F.col(budget) - F.col("_used")))
        .filter(F.col("_left") > done)
        .withColumn("taken_s", F.round(F.least(F.col("_left"), F.col(duration)), 3))
        .withColumn("left_s", F.round(F.greatest(F.lit(0.0), F.col("_left") - F.col(duration)), 3))
        .drop("_left", "_used")
    )


def milliseconds_guess(value: Column, duration: Column) -> Column:
    """Values above three times the duration are milliseconds."""
    return F.round(F.when((duration > 0) & (value > 3 * duration), value / 1000).otherwise(value), 3)


def is_stalled(updated: Column, now: Column, after_s: float = 120) -> Column:
    return F.coalesce(now.cast("double") - updated.cast("double") > after_s, F.lit(False))
