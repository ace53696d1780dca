"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source starts with the same number of copies, target / source size.
The whole part is taken for certain. The fractions are settled in pairs: words of one
document's fraction move to another's, in a random direction whose expectation is zero,
until one of the two is 0 or 1, and the other goes on to the next pair. A source's words
so stay the same through every step. Pairs are formed in blocks of about BLOCK documents
in parallel; what each block leaves over (one document at most) enters the next level of
the tree, until one document is left per source, which is rounded to the nearer end.

A document of over 1/LARGE of its source's words could end as that last one and leave
the source far from its target. Such documents (fewer than LARGE a source, by their
definition) are settled before the tree, each against the pool of all that are smaller:
it becomes 0 or 1, and the pool takes over the words that this gives or takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, unit_hash, words

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_COPIES = 2
BLOCK = 128
LARGE = 50


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST_COPIES) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources in code point order, null last, get the weights in turn. What lies above
    ``most`` times a source's size goes to the others by weight until none is above.
    The driver sees a few sums a round, never the sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = materialize(
        totals.orderBy(F.col("source").isNull(), "source").withColumn("_id", F.monotonically_increasing_id()), "mix-sources"
    )
    part = F.shiftright("_id", 33).cast("int")
    counts = ranked.groupBy(part.alias("p")).count().collect()  # one row per partition
    before, starts = 0, []
    for p, n in sorted((r["p"], r["count"]) for r in counts):
        starts.append((p, before))
        before += n
    offsets = sizes.sparkSession.createDataFrame(starts, "p int, before long")
    rank = F.col("before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    weighed = ranked.join(offsets, part == F.col("p")).select("source", "source_size", weight.alias("weight"))
    cap = most * F.col("source_size")
    whole = weighed.agg(F.sum("source_size")).collect()[0][0] or 0
    level, held = 0.0, -1
    while True:
        over = F.lit(level) * F.col("weight") > cap
        r = weighed.agg(
            F.sum(F.when(over, cap).otherwise(0)).alias("capped"),
            F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.sum(over.cast("long")).alias("n"),
        ).collect()[0]
        if r["n"] == held or not r["open"]:
            break
        held, level = r["n"], (share * whole - r["capped"]) / r["open"]
    return weighed.select(
        "source", "source_size", F.least(F.lit(level) * F.col("weight"), cap.cast("double")).alias("target")
    )


def _fold(level: int, seed: int) -> Column:
    """Settle the pairs of one block: its documents, each with done and mass (words of its fraction)."""
    item = "struct<size:bigint,tie:bigint,doc_id:bigint,copy:int,mass:double>"
    done = "struct<size:bigint,tie:bigint,doc_id:bigint,copy:int,mass:double,done:boolean>"

    def settled(x: Column, mass: Column, is_done: bool) -> Column:
        return F.struct(
            x["size"].alias("size"), x["tie"].alias("tie"), x["doc_id"].alias("doc_id"), x["copy"].alias("copy"),
            mass.alias("mass"), F.lit(is_done).alias("done"),
        )

    def moved(x: Column, mass: Column) -> Column:
        return F.struct(
            x["size"].alias("size"), x["tie"].alias("tie"), x["doc_id"].alias("doc_id"), x["copy"].alias("copy"),
            mass.alias("mass"),
        )

    def step(acc: Column, x: Column) -> Column:
        c = acc["carry"]
        room_c, room_x = c["size"] - c["mass"], x["size"] - x["mass"]
        up, down = F.least(room_c, x["mass"]), F.least(c["mass"], room_x)
        u = unit_hash(F.lit(seed), F.lit(level), c["doc_id"], c["copy"], x["doc_id"], x["copy"], c["tie"], x["tie"])
        go_up = u * (up + down) < down
        # The end that is reached is written as such, so rounding leaves no crumbs.
        c_mass = F.when(go_up, F.when(room_c <= x["mass"], c["size"].cast("double")).otherwise(c["mass"] + up)).otherwise(
            F.when(c["mass"] <= room_x, F.lit(0.0)).otherwise(c["mass"] - down)
        )
        x_mass = F.when(go_up, F.when(room_c >= x["mass"], F.lit(0.0)).otherwise(x["mass"] - up)).otherwise(
            F.when(c["mass"] >= room_x, x["size"].cast("double")).otherwise(x["mass"] + down)
        )

        def after(m: Column) -> Column:
            cm, xm = m["cm"], m["xm"]
            c_end = (cm <= 0) | (cm >= c["size"])
            x_end = (xm <= 0) | (xm >= x["size"])
            gone = F.when(c_end & x_end, F.array(settled(c, cm, True), settled(x, xm, True))).when(
                c_end, F.array(settled(c, cm, True))
            ).otherwise(F.array(settled(x, xm, True)))
            left = F.when(c_end & x_end, F.lit(None).cast(item)).when(c_end, moved(x, xm)).otherwise(moved(c, cm))
            return F.struct(left.alias("carry"), F.concat(acc["out"], gone).alias("out"))

        paired = F.transform(F.array(F.struct(c_mass.alias("cm"), x_mass.alias("xm"))), after)[0]
        first = F.struct(moved(x, x["mass"]).alias("carry"), acc["out"].alias("out"))
        return F.when(c.isNull(), first).otherwise(paired)

    start = F.struct(F.lit(None).cast(item).alias("carry"), F.array().cast(f"array<{done}>").alias("out"))
    return F.aggregate(
        "items",
        start,
        step,
        lambda a: F.when(a["carry"].isNull(), a["out"]).otherwise(
            F.concat(a["out"], F.array(settled(a["carry"], a["carry"]["mass"], False)))
        ),
    )


def _large_first(seed: int) -> Column:
    """Settle a source's large documents, largest first: struct of mass and pool left, and out.

    out has copies 1 or 0 for what is settled, and -1 for what the pool can't take the
    words of: that goes into the tree.
    """

    def step(acc: Column, x: Column) -> Column:
        mass, pool, size = acc["mass"], acc["pool"], (-x["neg"])
        up_fits, down_fits = mass >= size, mass <= pool - size
        u = unit_hash(F.lit(seed), F.lit("large"), x["tie"], x["doc_id"], x["copy"])
        copies = (
            F.when(up_fits & down_fits, (u * pool < mass).cast("int"))
            .when(up_fits, F.lit(1)).when(down_fits, F.lit(0)).otherwise(F.lit(-1))
        )
        return F.transform(
            F.array(copies),
            lambda c: F.struct(
                F.when(c == 1, mass - size).otherwise(mass).alias("mass"),
                F.when(c == -1, pool).otherwise(pool - size).alias("pool"),
                F.concat(
                    acc["out"],
                    F.array(F.struct(size.alias("size"), x["tie"].alias("tie"), x["doc_id"].alias("doc_id"), x["copy"].alias("copy"), c.alias("copies"))),
                ).alias("out"),
            ),
        )[0]

    start = F.struct(
        F.col("mass").alias("mass"), F.col("source_size").alias("pool"),
        F.array().cast("array<struct<size:bigint,tie:bigint,doc_id:bigint,copy:int,copies:int>>").alias("out"),
    )
    return F.aggregate("large", start, step)


def mix(docs: DataFrame, seed: int = 17, weights=WEIGHTS, share=SHARE, most=MOST_COPIES) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, source.

    size counts words (null text: 0), taken is copies times size. A null source is a
    source of its own, last in order. Documents without words take no part in the
    rounding and get one copy when their source's ratio is at least a half. Repeated rows
    are documents of their own. Empty tables give no rows. The same rows give the same
    mix in any order and partitioning.
    """
    sized = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    # Repeated rows fold before the shuffle and come out numbered, so that each has a key.
    sizes = materialize(sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("times")), "mix-sizes")
    spread = sizes.select("source", (F.col("size") * F.col("times")).alias("size"))
    targets = source_targets(spread, weights, share, most)
    counted = sizes.groupBy(F.col("source").alias("t_source")).agg(F.sum("times").alias("n"))
    targets = materialize(
        targets.join(counted, F.col("source").eqNullSafe(F.col("t_source"))).select(
            "t_source", "source_size", "target", F.greatest(F.ceil(F.col("n") / BLOCK), F.lit(1)).alias("blocks"),
            F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("ratio"),
        ),
        "mix-targets",
    )
    most_blocks = targets.agg(F.max("blocks")).collect()[0][0] or 1
    rows = (
        sizes.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
        .join(targets, F.col("source").eqNullSafe(F.col("t_source")))
        .withColumn("base", F.floor("ratio"))
        .withColumn("mass", (F.col("ratio") - F.col("base")) * F.col("size"))
    )
    fractional = (F.col("size") > 0) & (F.col("ratio") > F.col("base"))
    certain = rows.filter(~fractional).select(
        "source", "doc_id", "size",
        F.when(F.col("size") > 0, F.col("base")).otherwise(F.floor(F.col("ratio") + 0.5)).alias("copies"),
    )
    open_rows = rows.filter(fractional).withColumn("tie", F.xxhash64(F.lit(seed), "doc_id", "copy"))
    is_large = F.col("size") * LARGE > F.col("source_size")
    large = materialize(
        open_rows.filter(is_large)
        .groupBy("source", "blocks", "source_size", "ratio", "base")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("neg"), "tie", "doc_id", "copy"))).alias("large"))
        .withColumn("mass", (F.col("ratio") - F.col("base")) * F.col("source_size"))
        .withColumn("end", _large_first(seed))
        .select("source", "blocks", F.when(F.col("end.pool") > 0, F.col("end.mass") / F.col("end.pool")).otherwise(0.0).alias("p"), "end.out"),
        "mix-large",
    )
    out = large.select("source", "blocks", "p", F.inline("out"))
    parts = [out.filter("copies >= 0").select("source", "doc_id", "size", F.col("copies").cast("long"))]
    small = (
        open_rows.filter(~is_large)
        .join(large.select(F.col("source").alias("l_source"), "p"), F.col("source").eqNullSafe(F.col("l_source")), "left")
        .withColumn("mass", F.coalesce(F.col("p") * F.col("size"), F.col("mass")))
    )
    level, blocks = 0, most_blocks
    names = ["source", "blocks", "size", "tie", "doc_id", "copy", "mass"]
    items = small.select(*names).unionByName(
        out.filter("copies < 0").withColumn("mass", F.col("p") * F.col("size")).select(*names)
    )
    while True:
        block = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "copy", "size"), F.col("blocks"))
        # Largest first: an ascending sort of the negated key, turned back.
        keyed = F.struct((-F.col("size")).alias("neg"), F.col("tie"), F.col("doc_id"), F.col("copy"), F.col("mass"))
        back = lambda x: F.struct(
            (-x["neg"]).alias("size"), x["tie"].alias("tie"), x["doc_id"].alias("doc_id"), x["copy"].alias("copy"), x["mass"].alias("mass")
        )
        solved = materialize(
            items.withColumn("block", block)
            .groupBy("source", "blocks", "block")
            .agg(F.sort_array(F.collect_list(keyed)).alias("keyed"))
            .select("source", "blocks", F.transform("keyed", back).alias("items"))
            .select("source", "blocks", F.inline(_fold(level, seed))),
            f"mix-level{level}",
        )
        last = blocks <= 1
        over = solved if last else solved.filter("done")
        parts.append(
            over.select("source", "doc_id", "size", (F.col("mass") * 2 >= F.col("size")).cast("long").alias("copies"))
        )
        if last:
            break
        items = solved.filter("not done").select(
            "source", F.ceil(F.col("blocks") / BLOCK).alias("blocks"), "size", "tie", "doc_id", "copy", "mass"
        )
        level, blocks = level + 1, -(-blocks // BLOCK)
    rounded = parts[0]
    for p in parts[1:]:
        rounded = rounded.unionByName(p)
    both = rounded.withColumn("fraction", F.lit(True)).unionByName(certain.withColumn("fraction", F.lit(False)))
    copies = F.when(F.col("fraction"), F.floor("ratio")).otherwise(F.lit(0)) + F.col("copies")
    return (
        both.join(targets, F.col("source").eqNullSafe(F.col("t_source")))
        .withColumn("copies", copies.cast("long"))
        .select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")
    )


def mixed_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The documents as the mix takes them: each row as often as its copies, with its own columns.

    Rows that agree in id, source and size share their copies: their sum is dealt evenly,
    the first rows (in the order of their texts) getting what does not divide.
    """
    total = mix(docs, seed).groupBy(
        F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), F.col("size").alias("m_size")
    ).agg(F.sum("copies").alias("m_copies"), F.count("*").alias("m_rows"))
    # The documents' own columns travel in one, so that none of their names can clash.
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    joined = own.join(
        total,
        F.col("row.doc_id").eqNullSafe(F.col("m_id"))
        & F.col("row.source").eqNullSafe(F.col("m_source"))
        & (F.size(words(F.col("row.text"))) == F.col("m_size")),
    )
    single = joined.filter("m_rows = 1").select("row", F.col("m_copies").alias("n"))
    order = Window.partitionBy("m_id", "m_source", "m_size").orderBy("row.text")
    several = joined.filter("m_rows > 1").select(
        "row",
        (F.floor(F.col("m_copies") / F.col("m_rows")) + (F.row_number().over(order) <= F.col("m_copies") % F.col("m_rows")).cast("int")).alias("n"),
    )
    return (
        single.unionByName(several)
        .withColumn("copy", F.explode(F.array_repeat(F.lit(True), F.col("n").cast("int"))))
        .select("row.*")
    )
