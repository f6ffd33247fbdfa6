"""Train, validation and test splits that keep linked records together.

Records are linked by shared values of two columns (publisher and session). The links form a graph
over the left values only: of each right value, every left value is tied to the smallest one. Its
components come from rounds of hooking (the larger root of a tie takes the smaller as its parent)
and shortcutting (a parent becomes its parent's parent) on tables of (node, parent); each round is
one written table, and the number of rounds follows the logarithm of the longest chain.

Whole components are then dealt to the splits: the sizes are a histogram (at most sqrt(2 n) distinct
values), and bitsets of reachable sums over size multiplicities name how many components of each size
bring test and then validation closest to their share. The rest is train.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatewarden.functions.text import clean_id
from gatewarden.workspace import stored


def session_key(c: Column) -> Column:
    """Session id if it names a session: 32 hexadecimal digits that are not all the same."""
    s = clean_id(c)
    return F.when(s.rlike("^[0-9a-f]{32}$") & ~s.rlike(r"^(.)\1{31}$"), s)


def ties(pairs: DataFrame) -> DataFrame:
    """(u, v), u > v, tying every left value of a right value to the smallest one.

    ``pairs`` has columns left and right. Pairs are made distinct first, so a right value with a third
    of all rows counts by its distinct left values only; the smallest is found by a map-side minimum.
    """
    distinct = pairs.where("left is not null and right is not null").distinct()
    roots = distinct.groupBy("right").agg(F.min("left").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    return distinct.join(roots, "right").where("left > v").select(F.col("left").alias("u"), "v").distinct()


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) of every node of the links (u, v); root is the smallest node of the component.

    No links give an empty table. Repeated and self links are allowed. Raises if not done after
    ``max_rounds`` rounds (2^64 nodes in a chain).
    """
    links = stored(links.select("u", "v").where("u <> v").distinct(), "ties")
    parents = stored(
        links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")).select("node", F.least("node", "least").alias("parent")),
        "parents",
    )
    for _ in range(max_rounds):
        grand = parents.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
        short = parents.join(grand, "parent").select("node", F.col("up").alias("parent"))  # shortcut
        at_u = links.join(short.select(F.col("node").alias("u"), F.col("parent").alias("pu")), "u")
        at_both = at_u.join(short.select(F.col("node").alias("v"), F.col("parent").alias("pv")), "v").where("pu <> pv")
        hooks = at_both.groupBy(F.greatest("pu", "pv").alias("node")).agg(F.min(F.least("pu", "pv")).alias("hook"))
        # a hook lowers the parent of a root or of an inner node alike, so the smallest label always flows on
        hooked = short.join(hooks, "node", "left").select("node", F.least("parent", "hook").alias("parent"))
        after = stored(hooked, "parents")
        changed = after.join(parents.withColumnRenamed("parent", "old"), "node").where("parent <> old").limit(1).count()
        pending = 0 if changed else after.join(after.select(F.col("node").alias("parent"), F.col("parent").alias("up")), "parent").where("up <> parent").limit(1).count()
        parents = after
        if not changed and not pending:
            return parents.select("node", F.col("parent").alias("root"))
    raise RuntimeError("components did not settle")


def linked_pairs(comps: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of different nodes of one component: the form the result is stated in."""
    a = comps.select("root", F.col("node").alias("a"))
    return a.join(comps.select("root", F.col("node").alias("b")), "root").where("a < b").select("a", "b")


def closest_sum(sizes: Sequence[tuple[int, int]], target: float, max_bits: int = 1 << 20) -> dict[int, int]:
    """How many items of each (size, multiplicity) bring the sum closest to ``target``.

    Multiplicities are taken in powers of two. Reachable sums are the set bits of one integer per
    item kept for the way back. Sums of over ``max_bits`` are first counted in units of
    ``ceil(limit / max_bits)`` rows, larger sizes first; then a second bitset, of the differences that
    putting in and taking out items of up to ``max_bits / 2`` rows can make, removes the error.
    """
    limit = int(min(sum(s * m for s, m in sizes), 2 * target + 1))
    unit = max(1, -(-limit // max_bits))
    items = []
    for size, many in sorted(sizes, reverse=True):
        if size > limit:
            continue
        many = min(many, limit // size)
        block = 1
        while many > 0:
            take = min(block, many)
            items.append((size, take, max(1, round(size * take / unit))))
            many, block = many - take, block * 2
    top, reach, history = limit // unit + 1, 1, []
    mask = (1 << (top + 1)) - 1
    for _, _, weight in items:
        history.append(reach)
        reach |= (reach << weight) & mask
    goal = target / unit
    below, above = int(goal), int(goal) + 1
    while below > 0 and not reach >> below & 1:
        below -= 1
    while above <= top and not reach >> above & 1:
        above += 1
    best = above if above <= top and above - goal < goal - below else below
    out: dict[int, int] = {}
    for (size, take, weight), before in zip(reversed(items), reversed(history)):
        if best and not before >> best & 1:
            out[size] = out.get(size, 0) + take
            best -= weight
    return out if unit == 1 else _repaired(out, dict(sizes), target, max_bits // 2)


def _repaired(taken: dict[int, int], sizes: dict[int, int], target: float, reach_rows: int) -> dict[int, int]:
    """The selection with items put in or taken out so that its sum is as close to the target as a change of
    ``reach_rows`` rows at most makes it."""
    error = target - sum(s * n for s, n in taken.items())
    mask, reach, steps = (1 << (2 * reach_rows + 1)) - 1, 1 << reach_rows, []
    for size, many in sorted(sizes.items(), reverse=True):
        if size > reach_rows:
            continue
        for sign, left in ((1, many - taken.get(size, 0)), (-1, taken.get(size, 0))):
            left, block = min(left, 2 * reach_rows // size), 1
            while left > 0:
                n = min(block, left)
                steps.append((size, sign * n, reach))
                reach |= (reach << size * n) & mask if sign > 0 else reach >> size * n
                left, block = left - n, block * 2
    goal = reach_rows + error
    below, above = min(int(goal), 2 * reach_rows), max(0, int(goal) + 1)
    while below >= 0 and not reach >> below & 1:
        below -= 1
    while above <= 2 * reach_rows and not reach >> above & 1:
        above += 1
    best = above if above <= 2 * reach_rows and (below < 0 or above - goal < goal - below) else below
    if best < 0:
        return taken
    out = dict(taken)
    for size, n, before in reversed(steps):
        if not before >> best & 1:
            out[size] = out.get(size, 0) + n
            best -= size * n
    return {s: n for s, n in out.items() if n}


def assign_splits(rows: DataFrame, key: str, left: Column, right: Column, shares: Sequence[tuple[str, float]] = (("test", 0.1), ("validation", 0.1)), rest: str = "train") -> DataFrame:
    """(key, component, split) of every row; no left and no right value is found in two splits.

    Rows with a left value go with its component. Rows without one go with the component of their
    right value, or with all other such rows of that right value. Rows with neither are dealt one by
    one by the hash of their key. A component larger than a share stays in ``rest``, so with a giant
    component the shares are met as far as the others allow. Empty tables give no rows.
    """
    base = rows.select(F.col(key), left.alias("left"), right.alias("right"))
    pairs = base.select("left", "right")
    comps = components(ties(pairs))
    # distinct pairs first: the joins below carry one row per pair, whatever the rows of a hot value
    known = pairs.distinct().join(comps.withColumnRenamed("node", "left"), "left", "left").withColumn("root", F.coalesce("root", "left"))
    known = stored(known, "roots")
    of_left = known.where("left is not null").select("left", "root").distinct()
    of_right = known.where("left is not null and right is not null").groupBy("right").agg(F.min("root").alias("right_root"))
    pair_root = (
        known.select("left", "right").join(of_left, "left", "left").join(of_right, "right", "left")
        .select("left", "right", F.coalesce(F.concat(F.lit("l:"), F.coalesce("root", "right_root")), F.concat(F.lit("r:"), "right")).alias("component"))
    )
    counts = base.groupBy("left", "right").agg(F.count("*").alias("n"))
    same = lambda a, b: a["left"].eqNullSafe(b["left"]) & a["right"].eqNullSafe(b["right"])
    sized = counts.alias("c").join(pair_root.alias("p"), same(counts, pair_root)).select("p.left", "p.right", "component", "n")
    sized = stored(sized, "sized")
    members = stored(sized.where("component is not null").groupBy("component").agg(F.sum("n").alias("size")).repartitionByRange(F.col("size"), F.xxhash64("component")).withColumn("pid", F.spark_partition_id()), "members")
    histogram = [(r["size"], r["m"]) for r in members.groupBy("size").agg(F.count("*").alias("m")).collect()]
    total = sum(s * m for s, m in histogram)
    left_over, bounds = dict(histogram), []
    used: dict[int, int] = {}
    for name, share in shares:
        for size, take in closest_sum(list(left_over.items()), share * total).items():
            bounds.append((name, size, used.get(size, 0), used.get(size, 0) + take))
            used[size] = used.get(size, 0) + take
            left_over[size] -= take
    spark = rows.sparkSession
    # rank of a component among those of its size: offset of its range partition plus its place in it
    inside = members.withColumn("place", F.row_number().over(Window.partitionBy("pid", "size").orderBy("component")))
    per_pid = members.groupBy("size", "pid").agg(F.count("*").alias("m"))
    offsets = per_pid.withColumn("offset", F.sum("m").over(Window.partitionBy("size").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))).select("size", "pid", F.coalesce("offset", F.lit(0)).alias("offset"))
    ranked = inside.join(offsets, ["size", "pid"]).withColumn("rank", F.col("place") + F.col("offset"))
    cuts = spark.createDataFrame(bounds, "split string, size bigint, low bigint, high bigint")
    dealt = ranked.join(cuts, (ranked["size"] == cuts["size"]) & (F.col("rank") > F.col("low")) & (F.col("rank") <= F.col("high")), "left").select("component", F.coalesce("split", F.lit(rest)).alias("split"))
    by_pair = stored(sized.drop("n").where("component is not null").join(dealt, "component"), "dealt")
    out = base.join(by_pair, same(base, by_pair), "left").select(base[key], "component", "split")
    at, single = 0.0, F.lit(rest)
    place = F.pmod(F.xxhash64(key), F.lit(1_000_000)) / 1_000_000
    for name, share in shares:
        single, at = F.when((place >= at) & (place < at + share), name).otherwise(single), at + share
    return out.select(key, F.coalesce("component", F.concat(F.lit("k:"), F.col(key).cast("string"))).alias("component"), F.coalesce("split", single).alias("split"))
