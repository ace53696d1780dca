"""Running values over keys of any size: a key with very many rows is cut into slices of its axis.

A window holds a whole key in one task. Here keys that hold more than a share of all rows
are cut where quantiles of the axis say, so that a slice is about as large as any other
task's work. A window over (keys, slice) gives the running value inside; one row a slice
says what the slice adds, and a small window over these rows carries it on to the later
(or earlier) slices. Rows are shuffled once, as by the plain window; the rows that say
what slices add are at most twice ``slices`` in all, and so are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .dedupe import _ensure_checkpoint_dir

#: Slices for each shuffle partition that all rows would make, and rows below which no key is cut.
PER_PARTITION = 4
LEAST_ROWS = 4096

SLICE, SPLIT = "_slice", "_split"


class Sliced:
    """Rows with their slice, and what other slices carry into it.

    ``order`` begins with the axis, a number or a time; the rest breaks ties. Rows of one
    axis value are never parted, so frames by range see all their peers. Null axis values
    come first. Axes of other types aren't cut. The rows are read up to three times: to
    count keys, for the quantiles of large ones, and for the work itself. Approximate
    quantiles depend on the order in which partitions meet, and a plan names the cuts more
    than once, so they are found once and written to the folder of ``spark.checkpoint.dir``.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], slices: int | None = None, least_rows: int | None = None):
        self.keys, self.order = keys, order
        kind = dict(df.dtypes)[order[0]]
        if kind.startswith("timestamp"):
            axis = F.unix_micros(F.col(order[0]).cast("timestamp")).cast("double")
        elif kind.startswith(("decimal", "date")):
            axis = F.col(order[0]).cast("double") if kind != "date" else F.unix_date(order[0]).cast("double")
        else:
            axis = F.col(order[0]).cast("double") if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") else None
        slices = slices or PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        if axis is None:
            self.rows = df.withColumns({SLICE: F.lit(0), SPLIT: F.lit(False)})
            return
        sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
        total, largest = (x or 0 for x in sizes.agg(F.sum("_n"), F.max("_n")).first())
        most = max(LEAST_ROWS if least_rows is None else least_rows, -(-total // slices))
        if largest <= most:
            self.rows = df.withColumns({SLICE: F.lit(0), SPLIT: F.lit(False)})
            return
        large = sizes.filter(F.col("_n") > most)  # fewer than ``slices`` keys
        fractions = [i / slices for i in range(1, slices)]
        found = self._with(df.select(*keys, axis.alias("_x")), large, "inner").groupBy(*keys, "_n")
        marks = found.agg(F.percentile_approx("_x", fractions, max(10_000, 10 * slices)).alias("_q"))
        # As many of the marks as the key's rows need; neighbouring equal marks are one.
        wanted = F.ceil(F.col("_n") / most)
        some = F.filter("_q", lambda _, i: F.floor((i + 1) * wanted / slices) > F.floor(i * wanted / slices))
        some = F.array_distinct(some)
        width = F.ceil(F.sqrt(F.size("_b"))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size("_b") / width).cast("int") - 1), lambda i: F.slice("_b", i * width + 1, width))
        _ensure_checkpoint_dir(df.sparkSession)
        marks = marks.withColumn("_b", some).filter(F.size("_b") > 0).select(*keys, blocks.alias("_blocks")).checkpoint()
        rows = self._with(df.withColumn("_x", axis), marks, "left")
        block = F.size(F.filter("_blocks", lambda b: b[0] < F.col("_x")))
        inside = F.size(F.filter(F.get("_blocks", F.greatest(block - 1, F.lit(0))), lambda v: v < F.col("_x")))
        at = F.when(block > 0, (block - 1) * F.size(F.get("_blocks", F.lit(0))) + inside).otherwise(0)
        split = F.col("_blocks").isNotNull()
        self.rows = rows.withColumns({SLICE: F.when(split, at).otherwise(0), SPLIT: split}).drop("_x", "_blocks")

    def _with(self, rows: DataFrame, few: DataFrame, how: str, also: tuple[str, ...] = ()) -> DataFrame:
        """``few``'s columns beside the rows; it has at most a few rows a slice, whatever the input."""
        on = [*self.keys, *also]
        names = {k: f"_k_{k}" for k in on}
        few = F.broadcast(few.withColumnsRenamed(names))
        same = None
        for k, v in names.items():
            one = rows[k].eqNullSafe(few[v])
            same = one if same is None else same & one
        if same is None:  # no keys: one group
            return rows.join(few, how=how) if how == "inner" else rows.join(few, F.lit(True), how)
        return rows.join(few, same, how).drop(*names.values())

    def window(self) -> WindowSpec:
        """A slice's rows in order."""
        return Window.partitionBy(*self.keys, SLICE).orderBy(*self.order)

    def running(self) -> WindowSpec:
        """The slice's rows up to the current one."""
        return self.window().rowsBetween(Window.unboundedPreceding, 0)

    def earlier(self) -> WindowSpec:
        """The slice's rows before the current one."""
        return self.window().rowsBetween(Window.unboundedPreceding, -1)

    def carry(self, rows: DataFrame, sums: dict[str, Column], carried: Callable[[WindowSpec, WindowSpec], dict[str, Column]]) -> DataFrame:
        """``rows`` (of self.rows, with more columns) beside what the slices around add.

        ``sums`` are aggregates of one slice's rows; ``carried`` makes the new columns from
        them, given a window over the slices before and one over those behind. Keys that are
        not cut get nulls.
        """
        parts = rows.filter(SPLIT).groupBy(*self.keys, SLICE).agg(*[c.alias(k) for k, c in sums.items()])
        before = Window.partitionBy(*self.keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        behind = Window.partitionBy(*self.keys).orderBy(SLICE).rowsBetween(1, Window.unboundedFollowing)
        found = carried(before, behind)
        own = parts.select(*self.keys, SLICE, *[c.alias(k) for k, c in found.items()])
        return self._with(rows, own, "left", (SLICE,))

    def done(self, rows: DataFrame, *drop: str) -> DataFrame:
        return rows.drop(SLICE, SPLIT, *drop)


def running_sum(s: Sliced, rows: DataFrame, value: str, name: str, own: bool = False) -> DataFrame:
    """``name``: the sum of a column over the rows before (0 without any), with ``own`` also the row's.

    Whole numbers and what is left of them are summed apart where values have fractions:
    the first sum is exact, and errors of the second don't grow with the total.
    """
    v = F.col(value)
    parts = {"_sum0": v}
    if dict(rows.dtypes)[value] in ("double", "float"):
        v = v.cast("double")
        parts = {"_sum0": F.rint(v), "_sum1": F.when(F.abs(v) < float("inf"), v - F.rint(v)).otherwise(0.0)}
    rows = rows.withColumns(parts)
    rows = s.carry(rows, {f"_of{c}": F.sum(c) for c in parts}, lambda before, _: {f"_carry{c}": F.sum(f"_of{c}").over(before) for c in parts})
    w = s.running() if own else s.earlier()
    upto = [F.coalesce(F.col(f"_carry{c}"), F.lit(0)) + F.coalesce(F.sum(c).over(w), F.lit(0)) for c in parts]
    return rows.withColumn(name, sum(upto[1:], upto[0])).drop(*parts, *[f"_carry{c}" for c in parts])


def positions(df: DataFrame, keys: list[str], order: list[str], name: str, first: int = 0, **how: int) -> DataFrame:
    """``name``: the row's place in its key, counted from ``first``."""
    s = Sliced(df, keys, order, **how)
    rows = s.carry(s.rows, {"_part": F.count("*")}, lambda before, _: {"_carry": F.sum("_part").over(before)})
    at = F.coalesce(F.col("_carry"), F.lit(0)) + F.row_number().over(s.window()) + (first - 1)
    return s.done(rows.withColumn(name, at), "_carry")
