"""Connected components of verified links between members of candidate buckets, without forming all pairs of a bucket.

A bucket may hold a third of all rows. In each round it names a few pivots; every member of another component is
paired with them, the pairs are verified, and components merge. A pivot has then met everyone it could still add
something to, and leaves the bucket; a bucket whose members all lie in one component is done. So each pair that shares
a bucket is either verified or found to be connected already: no link between components is lost. In the first rounds
pivots come from large components and from the middle of a group, so that stragglers meet a few of the many they may be
linked to. Then they come from
small ones, in growing numbers, and meet all of the rest. From the second round on counting rules pairs out: two sets of a given Jaccard
similarity have a least number of elements in common, elements that no other live member has are in common with none, and
a bit set for an element of one member but for none of the other's is an element they do not share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

PIVOTS, GATHER, GROWTH = (1, 4), 2, 8  # pivots of a bucket in the first rounds; how many rounds those are; growth after that
COUNTED = 2  # the round from which counts rule pairs out
WORDS_OF_BITS = 16  # 64 bits each
ONE_TASK = 50_000  # counted rows up to which a step is not dealt over more tasks


def shared(members: DataFrame) -> DataFrame:
    """The (bucket, id) rows whose bucket has more than one id."""
    several = members.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("bucket")
    return members.join(several.hint("shuffle_hash"), "bucket")


def classes(scratch: Scratch, members: DataFrame, verify: Callable[[DataFrame], DataFrame],
            elements: Callable[[DataFrame], DataFrame], similar: float) -> DataFrame:
    """`id`, `root` for each id that has a link; the root is the least id of its component.

    `members`: `bucket`, `id` (long), without repeats, at least two in a bucket. `verify` takes pairs `a`, `b`, `ca`, `cb` with a < b and
    returns those that are links, same columns. `elements` gives `id`, `element` for each of a member's distinct
    elements, for some ids; a link is a Jaccard similarity of at least `similar` between those.
    """
    live, pivots, found, spent, turn = _weighted(members), PIVOTS[0], [], [], 0
    while True:
        if turn:  # at first each member is a component, and `members` has no bucket of one
            several = live.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("bucket")
            live = live.join(several.hint("shuffle_hash"), "bucket")
        now = _few(scratch.table(live, "live"))
        if now.isEmpty():
            scratch.drop(now, *spent)
            break
        turn += 1
        if turn == COUNTED:
            now = _counted(scratch, now, elements)
        ranked, size = now, F.lit(1).cast("long")
        if turn > 1:
            ranked, size = now.join(now.groupBy("comp").agg(F.count("*").alias("rows")), "comp"), F.col("rows")
        ranked = ranked.select("bucket", F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(pivots)).alias("slot"),
                               F.struct((-size if turn <= GATHER else size).alias("rows"), -F.col("weight"), F.xxhash64("id"), F.struct(now.columns[1:]).alias("own")).alias("p"))
        chosen = ranked.groupBy("bucket", "slot").agg(F.min("p").alias("p"))
        chosen = _few(scratch.table(chosen.select("bucket", *(F.col(f"p.own.{c}").alias(f"p{c}") for c in now.columns[1:])), "pivots"))
        pairs = now.join(chosen, "bucket").filter("comp <> pcomp")
        if turn >= COUNTED:
            pairs = pairs.filter(_possible(similar))
        pairs = pairs.select(F.least("id", "pid").alias("a"), F.greatest("id", "pid").alias("b"),
                             F.expr("if(id < pid, comp, pcomp)").alias("ca"), F.expr("if(id < pid, pcomp, comp)").alias("cb"))
        links = scratch.table(verify(pairs.distinct()).select("ca", "cb").distinct(), "links")
        merged = components(scratch, links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        found.append(merged)
        left = now.join(chosen.select("bucket", F.col("pid").alias("id")), ["bucket", "id"], "left_anti")
        left = left.join(merged.withColumnRenamed("id", "comp"), "comp", "left")
        live = left.select("bucket", "id", F.coalesce("root", "comp").alias("comp"), *now.columns[3:])
        scratch.drop(links, *spent)
        spent = [now, chosen]
        pivots = PIVOTS[turn] if turn < GATHER else pivots * GROWTH
    if not found:
        return members.select("id", F.col("id").alias("root")).limit(0)
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    out = components(scratch, edges.select(F.col("id").alias("a"), F.col("root").alias("b"))) if len(found) > 1 else found[0]
    if len(found) > 1:
        scratch.drop(*found)
    return out


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """`id`, `root` (the least id of its component, itself included) for each end of an edge `a`, `b`.

    Alternates between linking a node's larger neighbours to its least one and its smaller neighbours to their least,
    until nothing changes. Only minima are gathered, so a hub with very many edges is a pre-summed row.
    """
    now = _few(scratch.table(_down(edges.filter("a <> b")).distinct(), "edges"))
    seen = _digest(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = _few(scratch.table(small.unionByName(floor.select("u", F.col("m").alias("v"))).distinct(), "edges"))
        was, seen = seen, _digest(new)
        scratch.drop(now)
        now = new
        if was == seen:
            break
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    out = scratch.table(now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots), "components")
    scratch.drop(now)
    return out


def _weighted(members: DataFrame) -> DataFrame:
    """`bucket`, `id`, `comp` (the id itself), `weight` (how many members its buckets have: most for the middle of a group)."""
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"))
    weight = members.join(sizes, "bucket").groupBy("id").agg(F.sum("n").alias("weight"))
    return members.join(weight, "id").select("bucket", "id", F.col("id").alias("comp"), "weight")


def _counted(scratch: Scratch, live: DataFrame, elements: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Live rows with `size` (elements of the member) and `common` (those that another live member has too)."""
    parts = elements(live.select("id").distinct())
    own = parts.groupBy("element").agg(F.min("id").alias("id"), F.count("*").alias("n")).filter("n = 1").groupBy("id").agg(F.count("*").alias("own"))
    cell = f"shiftright(element, 6) & {WORDS_OF_BITS - 1}"
    bits = [F.expr(f"bit_or(if({cell} = {k}, shiftleft(1L, cast(element & 63 as int)), 0L))").alias(f"bits{k}") for k in range(WORDS_OF_BITS)]
    sizes = parts.groupBy("id").agg(F.count("*").alias("size"), *bits).join(own, "id", "left")
    sizes = sizes.select("id", "size", (F.col("size") - F.coalesce("own", F.lit(0))).alias("common"), F.array(*(f"bits{k}" for k in range(WORDS_OF_BITS))).alias("bits"))
    return _few(scratch.table(live.join(sizes, "id").select("bucket", "id", "comp", "weight", "size", "common", "bits"), "counted"))


def _possible(similar: float) -> Column:
    """Whether counts leave room for a link: enough elements in common, and few enough bits of one side alone."""
    needed = similar / (1 + similar) * (F.col("size") + F.col("psize")) - 1e-6
    alone = lambda x, y: F.expr(" + ".join(f"bit_count({x}[{k}] & ~{y}[{k}])" for k in range(WORDS_OF_BITS)))
    return ((F.least("common", "pcommon") >= needed) & (F.col("size") - alone("bits", "pbits") >= needed)
            & (F.col("psize") - alone("pbits", "bits") >= needed))


def _few(table: DataFrame) -> DataFrame:
    """A written table; in one partition, which needs no exchange, if its counted rows are few."""
    if table.count() > ONE_TASK:
        return table
    out = table.coalesce(1)
    out._scratch_path = table._scratch_path
    return out


def _down(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))


def _digest(edges: DataFrame) -> tuple:
    """Number of edges and an order-free sum of their fingerprints."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], row[1]
