"""Near duplicates of fingerprint rows: blocked pairs, components, canonical rows.

A pair without equal file hashes needs several close frames, and a close frame differs in
at most BITS bits of its first hash. Keys for so wide a radius are so short that most rows
share one, so rows are dealt to blocks and each pair of blocks is compared in one task, by
bits, in bounded memory. All pairs are returned, so a group of m copies gives m (m - 1) / 2
of them; equal file hashes alone give a star. For large groups of copies fold equal hash
lists first. Groups need no more than linking_pairs().
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.vectors import hamming
from ..session import ship

#: Most differing bits of a close frame.
BITS = max(p for p, _ in K.CLOSE_FRAMES)

#: Close frames without which no pair is a duplicate.
ENOUGH = min(K.NEAR[0], K.STRONG[0])

#: Partners of a row that a first look takes from a block.
PARTNERS = 3

#: Rows of a block, and rows of one block that are compared with the other at a time.
BLOCK_ROWS, STRIP_ROWS = 8192, 64


def bands(value: Column, n: int = BITS + 1, width: int = 64) -> Column:
    """The lowest ``width`` bits in n bands: (number, bits)."""
    edges = [width * i // n for i in range(n + 1)]
    parts = []
    for i in range(n):
        mask = ((1 << edges[i + 1]) - (1 << edges[i])) & ((1 << 64) - 1)
        parts.append(F.struct(F.lit(i).alias("band"), value.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bits")))
    return F.array(*parts)


def _close_rows(x: pd.DataFrame, y: pd.DataFrame, least: int, bits: int, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of rows of two ids that are within ``bits`` in ``least`` frames or more; of each row of x the ``most`` closest, if given."""
    names = pd.factorize(pd.concat([x["shot_id"], y["shot_id"]]))[0]
    own, others = names[: len(x)], names[len(x) :]
    n = min(x["phash"].map(len).max(), y["phash"].map(len).max())
    frames = lambda s, i: pd.Series([v[i] if len(v) > i else None for v in s], dtype="Int64")
    sides = [[(f.fillna(0).to_numpy("int64").view("uint64"), f.notna().to_numpy()) for f in (frames(s["phash"], i) for i in range(n))] for s in (x, y)]
    found = [(np.zeros(0, "int64"), np.zeros(0, "int64"))]
    for at in range(0, len(x), STRIP_ROWS):
        strip = slice(at, at + STRIP_ROWS)
        close = np.zeros((len(own[strip]), len(y)), np.min_scalar_type(n))
        for (p, has_p), (q, has_q) in zip(*sides, strict=True):
            same = np.bitwise_count(p[strip, None] ^ q[None, :]) <= bits
            if not (has_p.all() and has_q.all()):
                same &= has_p[strip, None] & has_q[None, :]
            close += same
        a, b = np.nonzero(close >= least)
        other = own[a + at] != others[b]
        a, b = a[other], b[other]
        if most:
            order = np.lexsort((b, -close[a, b].astype("int64"), a))
            order = order[np.arange(len(a)) - np.searchsorted(a, a) < most]  # places in the runs of each row
            a, b = a[order], b[order]
        found.append((a + at, b))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _hashed(f: DataFrame) -> DataFrame:
    return f.filter("status = 'ok' AND shot_id <> '' AND size(phash) > 0").select("shot_id", "phash")


def _blocks(rows: DataFrame, block_rows: int | None) -> int:
    return max(1, -(-rows.count() // (block_rows or BLOCK_ROWS)))


def _block(n: int) -> Column:
    return F.pmod(F.xxhash64("shot_id"), F.lit(n))


def _compared(cells: DataFrame, least: int, bits: int, most: int | None = None) -> DataFrame:
    """Close pairs (a < b) of rows (shot_id, phash, i, j, x, y): in each cell (i, j) those of side x with those of side y."""
    ship(cells.sparkSession)

    def work(cell: pd.DataFrame) -> pd.DataFrame:
        x, y = cell[cell["x"]], cell[cell["y"]]
        if x.empty or y.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype="str")
        a, b = _close_rows(x, y, least, bits, most)
        return pd.DataFrame({"a": x["shot_id"].to_numpy()[a], "b": y["shot_id"].to_numpy()[b]})

    met = cells.groupBy("i", "j").applyInPandas(work, "a string, b string")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _within(rows: DataFrame, n: int, meets: Column) -> DataFrame:
    """Cells of rows in n blocks; ``meets`` says in which cells (i, j) a row of block _b is."""
    dealt = rows.withColumn("_b", _block(n)).withColumn("_m", F.explode(meets))
    return dealt.select("shot_id", "phash", "_m.i", "_m.j", (F.col("_b") == F.col("_m.j")).alias("x"), (F.col("_b") == F.col("_m.i")).alias("y"))


def close_pairs(f: DataFrame, least: int, bits: int = BITS, block_rows: int | None = None) -> DataFrame:
    """Pairs (a < b) of shot_id whose phash is within ``bits`` in at least ``least`` frames; all pairs, by blocks."""
    rows = _hashed(f)
    n = _blocks(rows, block_rows)
    meets = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda o: F.struct(F.least("_b", o).alias("i"), F.greatest("_b", o).alias("j")))
    return _compared(_within(rows, n, meets), least, bits)


def _close_between(f: DataFrame, g: DataFrame, least: int, block_rows: int | None) -> DataFrame:
    """close_pairs() of a row of f and one of g."""
    x, y = _hashed(f), _hashed(g)
    nx, ny = _blocks(x, block_rows), _blocks(y, block_rows)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    left = x.select("shot_id", "phash", _block(nx).alias("i"), each(ny).alias("j"), F.lit(True).alias("x"), F.lit(False).alias("y"))
    right = y.select("shot_id", "phash", each(nx).alias("i"), _block(ny).alias("j"), F.lit(False).alias("x"), F.lit(True).alias("y"))
    return _compared(left.unionByName(right), least, BITS)


def _copies(f: DataFrame) -> DataFrame:
    """Rows of one file hash as a star on the smallest, which loses no link."""
    sha = f.filter("status = 'ok' AND clip_sha256 <> ''").select("shot_id", "clip_sha256")
    first = sha.groupBy("clip_sha256").agg(F.min("shot_id").alias("a"))
    return sha.join(first, "clip_sha256").filter("shot_id > a").select("a", F.col("shot_id").alias("b"))


def candidate_pairs(f: DataFrame) -> DataFrame:
    """Pairs (a < b) with enough close frames by the first hash, or the same file hash."""
    return close_pairs(f, ENOUGH).unionByName(_copies(f)).distinct()


def pair_score(df: DataFrame) -> DataFrame:
    """Score pairs whose sides are structs x and y of fingerprint rows: status, confidence, close_frames, ...

    Pairs that are no duplicates are left out.
    """
    n = F.least(F.size("x.phash"), F.size("y.phash"), F.size("x.dhash"), F.size("y.dhash"))
    side = lambda c: F.zip_with(F.slice(f"x.{c}", 1, F.col("n")), F.slice(f"y.{c}", 1, F.col("n")), hamming)
    gap = F.abs(F.col("x.duration_s") - F.col("y.duration_s"))
    may = F.greatest(F.lit(K.DURATION_GAP[0]), F.lit(K.DURATION_GAP[1]) * F.greatest("x.duration_s", "y.duration_s"))
    known = (F.coalesce("x.duration_s", F.lit(0.0)) > 0) & (F.coalesce("y.duration_s", F.lit(0.0)) > 0)
    df = df.withColumn("n", n).filter((F.col("n") > 0) & (~known | (gap <= may)))
    df = df.withColumns({"p": side("phash"), "d": side("dhash")})

    def close(p: Column, d: Column) -> Column:
        out = F.lit(False)
        for most_p, most_d in K.CLOSE_FRAMES:
            out = out | ((p <= most_p) & (d <= most_d))
        return out

    mean = lambda c: F.try_divide(F.aggregate(c, F.lit(0.0), lambda s, v: s + v), F.col("n"))  # noqa: E731  no frames: left out, but computed first
    df = df.withColumns(
        {
            "close_frames": F.size(F.filter(F.zip_with("p", "d", close), lambda x: x)),
            "mean_phash": mean("p"),
            "mean_dhash": mean("d"),
            "exact": F.coalesce((F.col("x.clip_sha256") != "") & (F.col("x.clip_sha256") == F.col("y.clip_sha256")), F.lit(False)),
        }
    )
    conf = 1 - F.least(F.lit(1.0), F.col("mean_phash") / 18 * 0.58 + F.col("mean_dhash") / 20 * 0.42)
    df = df.withColumn("_c", conf)
    strong = F.col("exact") | ((F.col("close_frames") >= K.STRONG[0]) & (F.col("_c") >= K.STRONG[1]))
    near = (F.col("close_frames") >= K.NEAR[0]) & (F.col("_c") >= K.NEAR[1])
    return (
        df.withColumn("status", F.when(strong, "strong_duplicate").when(near, "near_duplicate_candidate"))
        .filter("status IS NOT NULL")
        .select(
            F.col("x.shot_id").alias("a"), F.col("y.shot_id").alias("b"), "status", F.bround("_c", 3).alias("confidence"),
            "exact", "close_frames", F.col("n").alias("frames"), F.bround("mean_phash", 3).alias("mean_phash"),
            F.bround("mean_dhash", 3).alias("mean_dhash"),
            F.coalesce((F.col("x.asset_id") != "") & (F.col("x.asset_id") == F.col("y.asset_id")), F.lit(False)).alias("same_asset"),
        )
    )


def _scored(f: DataFrame, pairs: DataFrame) -> DataFrame:
    row = F.struct("shot_id", "asset_id", "duration_s", "clip_sha256", "phash", "dhash")
    one = f.select(F.col("shot_id").alias("_id"), row.alias("_r"))
    return pair_score(
        pairs.join(one.select(F.col("_id").alias("a"), F.col("_r").alias("x")), "a")
        .join(one.select(F.col("_id").alias("b"), F.col("_r").alias("y")), "b")
        .select("x", "y")
    )


def duplicate_pairs(f: DataFrame) -> DataFrame:
    """All duplicate pairs of fingerprint rows, found by keys and scored exactly."""
    return _scored(f, candidate_pairs(f))


def _folded(f: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without later copies of all that is scored, and those copies as pairs with the first; hashes with nulls are not folded."""
    key = ["phash", "dhash", "duration_s", "clip_sha256"]
    whole = F.col("status") == "ok"
    for c in key[:2]:
        whole &= F.coalesce(F.forall(c, lambda x: x.isNotNull()), F.lit(False))
    named = [F.col(c).alias(f"_{c}") for c in key]
    firsts = f.filter(whole & (F.col("shot_id") != "")).groupBy(*named).agg(F.min("shot_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    same = F.col("_whole")
    for c in key:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    marked = f.withColumn("_whole", whole).join(firsts, same, "left").select(*f.columns, "_first").checkpoint()
    copies = marked.filter("shot_id > _first").select(F.col("_first").alias("a"), F.col("shot_id").alias("b"))
    return marked.filter("_first IS NULL OR shot_id <= _first").drop("_first"), copies


def linking_pairs(f: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Links (a, b, status) that join what duplicate_pairs() joins; a group's are all strong if and only if its pairs are.

    Copies of all that is scored are links of the first, which then stands for them. Each
    row first meets its own block and one other, and its closest partners there are
    scored. Dense tables then have nearly all rows in one group that some pair makes a
    near one: nothing more can be learnt from pairs inside it. All rows outside of it are
    compared with all rows. So time follows the rows times those outside; where there is
    no such group (few rows, or few duplicates) all pairs are compared.
    """
    _ensure_checkpoint_dir(f.sparkSession)
    f = f.select("shot_id", "asset_id", "duration_s", "clip_sha256", "phash", "dhash", "status").checkpoint()
    rows, copies = _folded(f)
    copies = copies.unionByName(_copies(f)).distinct()
    n = _blocks(_hashed(rows), block_rows)
    every = lambda: _scored(f, close_pairs(rows, ENOUGH, block_rows=block_rows).unionByName(copies).distinct()).select("a", "b", "status")
    if n < 3:
        return every()
    cell = lambda i, j: F.struct(F.lit(i).cast("long").alias("i"), j.alias("j"))
    first = F.transform(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"), lambda o: cell(0, o))
    own = F.struct(F.col("_b").alias("i"), F.col("_b").alias("j"))
    look = _compared(_within(_hashed(rows), n, F.when(F.col("_b") == 0, first).otherwise(F.array(cell(0, F.col("_b")), own))), ENOUGH, BITS, PARTNERS)
    found = _scored(f, look.unionByName(copies).distinct()).select("a", "b", "status").checkpoint()
    comp = least_reachable(found)
    strong = found.join(comp, found["a"] == comp["node"]).groupBy("component").agg(F.bool_and(F.col("status") == "strong_duplicate").alias("strong"))
    groups = comp.groupBy("component").agg(F.count("*").alias("n")).join(strong, "component").checkpoint()
    most = groups.filter("NOT strong").orderBy(F.desc("n"), "component").first()
    if most is None:
        return every()
    settled = comp.filter(F.col("component") == most["component"]).select(F.col("node").alias("shot_id"))
    rest, held = rows.join(settled, "shot_id", "left_anti").checkpoint(), rows.join(settled, "shot_id", "left_semi")
    more = close_pairs(rest, ENOUGH, block_rows=block_rows).unionByName(_close_between(rest, held, ENOUGH, block_rows)).distinct()
    # What was found first, as a star of each group.
    status = F.when(F.col("strong"), "strong_duplicate").otherwise("near_duplicate_candidate")
    stars = comp.join(groups, "component").filter("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"), status.alias("status"))
    return stars.unionByName(_scored(f, more).select("a", "b", "status"))


def least_reachable(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """node, component (its smallest node) of all nodes with an edge.

    Each round takes the smallest label around and then the label's own label, which
    halves paths; it ends when no label changed, and fails if ``rounds`` don't settle them. Rounds are cut by checkpoint() in the
    folder of ``spark.checkpoint.dir``.
    """
    spark = edges.sparkSession
    _ensure_checkpoint_dir(spark)
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().checkpoint()
    labels = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")).checkpoint()
    for _ in range(rounds):
        around = both.join(labels.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        near = labels.join(around, "u").select("u", "l", F.least("l", "m").alias("m"))
        jump = near.join(labels.select(F.col("u").alias("m"), F.col("l").alias("ll")), "m", "left")
        after = jump.select("u", "l", F.least("m", F.coalesce("ll", "m")).alias("n")).checkpoint()
        changed = after.filter("n <> l").isEmpty()
        labels = after.select("u", F.col("n").alias("l"))
        if changed:
            break
    else:
        raise RuntimeError(f"labels still change after {rounds} rounds")
    return labels.select(F.col("u").alias("node"), F.col("l").alias("component"))


def _ensure_checkpoint_dir(spark) -> None:
    """The session's folder; on one machine a temporary one where none is set, as in tests."""
    import tempfile

    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)


def canonical(df: DataFrame, keys: list[str], duration: str = "duration_s", row_id: str = "shot_id") -> DataFrame:
    """The longest row of each group, then the greatest id."""
    best = F.max_by(row_id, F.struct(F.coalesce(duration, F.lit(0.0)), F.col(row_id)))
    return df.groupBy(*keys).agg(best.alias("canonical_id"))


def duplicate_groups(f: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per component of pairs: group_id, status, canonical_id, n_members, n_assets, members.

    A group is strong if all its pairs are. Ids count up in the order of the smallest
    members, before groups are sorted for show.
    """
    _ensure_checkpoint_dir(pairs.sparkSession)
    pairs = pairs.checkpoint()  # read by the components and for their statuses
    comp = least_reachable(pairs)
    rows = f.join(comp, f["shot_id"] == comp["node"]).drop("node")
    strong = (
        pairs.join(comp, pairs["a"] == comp["node"]).groupBy("component")
        .agg(F.bool_and(F.col("status") == "strong_duplicate").alias("strong"))
    )
    groups = rows.groupBy("component").agg(
        F.count("*").alias("n_members"),
        F.countDistinct(F.when(F.col("asset_id") != "", F.col("asset_id"))).alias("n_assets"),
        F.max_by("shot_id", F.struct(F.coalesce("duration_s", F.lit(0.0)), "shot_id")).alias("canonical_id"),
        F.array_sort(F.collect_list("shot_id")).alias("members"),
    )
    return groups.join(strong, "component").select(
        F.concat(F.lit("dup_"), F.col("component")).alias("group_id"),
        F.when(F.col("strong"), "strong_duplicate").otherwise("near_duplicate_candidate").alias("status"),
        "canonical_id", "n_members", "n_assets", "members",
    )


def annotate(rows: DataFrame, groups: DataFrame, row_id: str = "shot_id") -> DataFrame:
    """Rows with what their group says of them; old marks are replaced."""
    names = ["duplicate_group_id", "duplicate_status", "duplicate_role", "canonical_id"]
    member = groups.select(
        F.explode("members").alias("_m"), F.col("group_id").alias(names[0]), F.col("status").alias(names[1]), F.col("canonical_id").alias(names[3])
    )
    out = rows.drop(*names).join(member, F.col(row_id) == F.col("_m"), "left").drop("_m")
    role = F.when(F.col(names[3]) == F.col(row_id), "canonical").when(F.col(names[3]).isNotNull(), "duplicate")
    return out.withColumn(names[2], role)


def frame_hashes(pixels: DataFrame) -> DataFrame:
    """phash (63 bits) and dhash (64 bits) of grey frames.

    Rows are shot_id, frame, grey (32 x 32 values, row by row) and small (8 x 9 values).
    The first compares the 8 x 8 lowest cosine terms, the constant one left out, with
    their median; the second compares neighbours in a row. Both in Spark's own functions.
    """
    import math

    def term(u: int, v: int) -> Column:
        w = [math.cos((2 * x + 1) * u * math.pi / 64) * math.cos((2 * y + 1) * v * math.pi / 64) for y in range(32) for x in range(32)]
        lits = F.array(*[F.lit(x) for x in w])
        return F.aggregate(F.zip_with("grey", lits, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)

    terms = F.array(*[term(u, v) for v in range(8) for u in range(8) if u or v])
    middle = F.array_sort("_t")[31]
    bit = lambda test, i: F.when(test, F.lit(1).cast("long") if i == 0 else F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
    ored = lambda xs: F.aggregate(F.array(*xs), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))
    out = pixels.withColumn("_t", terms).withColumn("_m", middle)
    phash = ored([bit(F.col("_t")[i] > F.col("_m"), 62 - i) for i in range(63)])
    dhash = ored([bit(F.col("small")[r * 9 + c] > F.col("small")[r * 9 + c + 1], 63 - (r * 8 + c)) for r in range(8) for c in range(8)])
    return out.withColumns({"phash": phash, "dhash": dhash}).drop("_t", "_m", "grey", "small")
