"""Graph operators over edge tables: chains, ancestors, cycles and strong components.

All are rounds of joins whose tables are written between rounds; chains double their reach in each
round, so a chain of 100,000 needs 17. Nothing but counts comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausula.plans.tables import cut

DEPTH_LIMIT = 256


def resolve_chain(refs: DataFrame, declared: DataFrame, depth: int = DEPTH_LIMIT) -> DataFrame:
    """Follow each node's one reference to the end: node, terminal, hops, status.

    refs: src, dst (one a src); declared: node, of all declarations. status: resolved, unresolved
    (the chain ends at no declaration), cycle, depth (more than `depth` hops).
    """
    # Each node that refers points `hops` steps ahead, twice as far in each round, until all point to ends or only chains without one are left.
    refs = refs.where("dst IS NOT NULL")
    nodes = declared.select("node").distinct()
    now = cut(nodes.join(refs.toDF("node", "to"), "node").withColumn("hops", F.lit(1).cast("long")), "chain")
    left = None
    while (n := _unfinished(now, refs)) and n != left:
        left, ahead = n, now.toDF("to", "next", "more")
        now = cut(now.join(ahead, "to", "left").select("node", F.coalesce("next", "to").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")), "chain")
    goes_on = refs.select(F.col("src").alias("to"), F.lit(True).alias("on"))
    known = nodes.select(F.col("node").alias("to"), F.lit(True).alias("known"))
    ended = now.join(goes_on, "to", "left").join(known, "to", "left")
    status = F.when(F.col("on"), "cycle").when(F.col("hops") > depth, "depth").when(F.col("known"), "resolved").otherwise("unresolved")
    moved = ended.select("node", F.when(~F.coalesce("on", F.lit(False)), F.col("to")).alias("terminal"), F.when(~F.coalesce("on", F.lit(False)), F.col("hops")).alias("hops"), status.alias("status"))
    still = nodes.join(refs.select(F.col("src").alias("node")), "node", "left_anti")
    return moved.unionByName(still.select("node", F.col("node").alias("terminal"), F.lit(0).cast("long").alias("hops"), F.when(F.col("node").isNotNull(), "resolved").otherwise("unresolved").alias("status")))


def _unfinished(now: DataFrame, refs: DataFrame) -> int:
    """How many nodes of `now` (to) do not yet point to an end.

    A chain of n steps has chains of all shorter lengths within it, so a round of doubling after which as many are left as before
    leaves only chains that never end: rounds go by the longest chain that ends, not by the number of nodes.
    """
    return now.join(refs.select(F.col("src").alias("to")), "to", "left_semi").count()


def closure(edges: DataFrame, rounds: int = DEPTH_LIMIT) -> DataFrame:
    """src, dst, distance (the shortest) of all that reach each other. The number of pairs is that of the answer."""
    now = cut(edges.select("src", "dst").distinct().withColumn("distance", F.lit(1)), "closure")
    size = now.count()
    for _ in range(rounds):
        longer = now.alias("a").join(now.select(F.col("src").alias("dst"), F.col("dst").alias("far"), F.col("distance").alias("more")), "dst").select("src", F.col("far").alias("dst"), (F.col("distance") + F.col("more")).alias("distance"))
        now = cut(now.unionByName(longer).groupBy("src", "dst").agg(F.min("distance").alias("distance")), "closure")
        new = now.agg(F.count("*").alias("n"), F.sum("distance").alias("s")).first()
        if (new.n, new.s) == size:
            break
        size = (new.n, new.s)
    return now


def ancestors(edges: DataFrame) -> DataFrame:
    """node, ancestor, distance: all supertypes, with the longest way to each, so that the farthest come first in falling order. Edges of cycles are left out first.

    Ways double their length in each round, so a depth of d takes about log2(d) rounds.
    """
    ring = cycle_nodes(edges)
    tree = edges.join(ring.withColumnRenamed("node", "src"), "src", "left_anti").select("src", "dst").distinct()
    now = cut(tree.select(F.col("src").alias("node"), F.col("dst").alias("ancestor"), F.lit(1).alias("distance")), "ancestors")
    size = None
    while True:
        sums = now.agg(F.count("*").alias("n"), F.sum("distance").alias("s")).first()
        if (sums.n, sums.s) == size or not sums.n:
            return now
        size = (sums.n, sums.s)
        longer = now.join(now.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"), F.col("distance").alias("more")), "ancestor").select("node", F.col("next").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance"))
        now = cut(now.unionByName(longer).groupBy("node", "ancestor").agg(F.max("distance").alias("distance")), "ancestors")


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges left after nodes with no way in or no way out are taken away again and again."""
    now = cut(edges.select("src", "dst").distinct(), "trim")
    n = now.count()
    while n:
        kept = now.join(now.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(now.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        now = cut(kept.select("src", "dst"), "trim")
        n, before = now.count(), n
        if n == before:
            break
    return now


def _colouring(edges: DataFrame) -> DataFrame:
    """node, colour of all nodes on cycles: the smallest node that reaches each node colours it; a root reaches itself, and its component is what reaches it within its colour."""
    left, out = edges, None
    while left.limit(1).count():
        nodes = left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct()
        colour = cut(nodes.withColumn("colour", F.col("node")), "colour")
        moved = True
        while moved:
            offers = left.join(colour.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "colour")
            new = cut(colour.unionByName(offers).groupBy("node").agg(F.min("colour").alias("colour")), "colour")
            moved = new.join(colour, ["node", "colour"], "left_anti").limit(1).count() > 0
            colour = new
        inside = cut(left.join(colour.toDF("src", "a"), "src").join(colour.toDF("dst", "b"), "dst").where("a = b").select("src", "dst", F.col("a").alias("colour")), "inside")
        reached = cut(colour.where("node = colour"), "reached")
        while True:
            more = inside.join(reached.select(F.col("node").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour")
            new = cut(reached.unionByName(more).distinct(), "reached")
            if new.count() == reached.count():
                break
            reached = new
        loops = left.where("src = dst").select(F.col("src").alias("node"))
        sized = reached.join(reached.groupBy("colour").count(), "colour")
        found = cut(sized.where("count > 1").select("node", "colour").unionByName(sized.where("count = 1").join(loops, "node", "left_semi").select("node", "colour")), "components")
        out = found if out is None else out.unionByName(found)
        done = reached.select("node")
        left = trimmed(left.join(done.withColumnRenamed("node", "src"), "src", "left_anti").join(done.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    return edges.select(F.col("src").alias("node"), F.col("src").alias("colour")).limit(0) if out is None else out


def _passed(left: DataFrame, single: DataFrame) -> DataFrame:
    """node, to, last, low of single nodes: the first other node on the way from each, the last single node before it, and the least single node from it on. On a ring of single nodes `to` is one of them."""
    on = single.withColumnRenamed("node", "to")
    now = cut(left.join(single.withColumnRenamed("node", "src"), "src").select(F.col("src").alias("node"), F.col("dst").alias("to"), F.col("src").alias("last"), F.col("src").alias("low"), F.lit(True).alias("moved")), "passed")
    # A round that no chain ends in leaves only rings (see _unfinished), and one that no `low` falls in has found the least of each ring.
    before = None
    while True:
        rings = now.join(on, "to", "left_semi").agg(F.count("*").alias("n"), F.bool_or("moved").alias("moved")).first()
        if not rings.n or (rings.n == before and not rings.moved):
            return now.drop("moved")
        before, ahead = rings.n, now.drop("moved").toDF("to", "next", "end", "less")
        now = cut(now.join(ahead, "to", "left").select("node", F.coalesce("next", "to").alias("to"), F.coalesce("end", "last").alias("last"), F.least("low", "less").alias("low"), F.coalesce(F.col("less") < F.col("low"), F.lit(False)).alias("moved")), "passed")


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all nodes on cycles, self-loops included. Edges with a null end are left out.

    Trees and chains are taken away by raking and compressing in turn: nodes with no way in or no way out go, and each chain of nodes
    with one way in and one way out becomes an edge, found by doubling. A tail or a tree of n nodes takes about log n turns. What is left
    is coloured; then chains are put back, the last first: a chain's nodes lie on a cycle if both its ends lie on one.
    """
    left = cut(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct(), "edges")
    node = lambda df, c: df.select(F.col(c).alias("node"))
    loops = [cut(node(left.where("src = dst"), "src"), "loops")]
    left, chains, rings, before = left.where("src <> dst"), [], None, None
    while True:
        left = left.join(node(left, "dst").distinct().toDF("src"), "src", "left_semi").join(node(left, "src").distinct().toDF("dst"), "dst", "left_semi")
        left = cut(left.select("src", "dst"), "raked")
        n = left.count()
        if not n or n == before:
            break
        ins, outs = left.groupBy(F.col("dst").alias("node")).count(), left.groupBy(F.col("src").alias("node")).count()
        single = cut(node(ins.where("count = 1"), "node").join(node(outs.where("count = 1"), "node"), "node"), "single")
        if not single.limit(1).count():
            before = n
            continue
        way = _passed(left, single)
        ring = cut(way.join(single.withColumnRenamed("node", "to"), "to", "left_semi").select("node", F.col("low").alias("component")), "rings")
        rings = ring if rings is None else rings.unionByName(ring)
        chain = way.join(single.withColumnRenamed("node", "to"), "to", "left_anti")
        free = left.join(single.withColumnRenamed("node", "src"), "src", "left_anti")  # edges that no chain begins with
        heads = free.join(chain.select(F.col("node").alias("dst"), "last", "to"), "dst").select("last", F.col("src").alias("u"), F.col("to").alias("v"))  # each chain by its first edge
        through = cut(chain.select("node", "last").join(heads, "last").select("node", "u", "v"), "chains")
        chains.append(through)
        left = cut(free.join(single.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst").unionByName(heads.select(F.col("u").alias("src"), F.col("v").alias("dst"))).distinct(), "branches")
        loops.append(cut(node(left.where("src = dst"), "src"), "loops"))
        left, before = left.where("src <> dst"), None
    known = _colouring(left).select("node", F.col("colour").alias("component"))
    if rings is not None:
        known = known.unionByName(rings)
    for own in reversed(range(len(loops))):
        # Loops of this turn that lie on no larger cycle, then the chains of the turn before.
        known = known.unionByName(loops[own].join(known.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))
        known = cut(known, "components")
        if own:
            ends = chains[own - 1].join(known.toDF("u", "component"), "u").join(known.toDF("v", "other"), "v").where("component = other")
            known = known.unionByName(ends.select("node", "component"))
    least = known.groupBy("component").agg(F.min("node").alias("least"))
    return known.join(least, "component").select("node", F.col("least").alias("component"))


def cycle_nodes(edges: DataFrame) -> DataFrame:
    return strong_components(edges).select("node")


def cycles(edges: DataFrame) -> DataFrame:
    """One row a cyclic component: component (its least member), members in order, n. For reports of bounded components; rules need the least member alone (cycle_heads)."""
    c = strong_components(edges)
    return c.groupBy("component").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("node")).alias("members"))


def cycle_heads(edges: DataFrame) -> DataFrame:
    """component: the least member of each cyclic component."""
    return strong_components(edges).select("component").distinct()


def carried(refs: DataFrame, values: DataFrame, declared: DataFrame) -> DataFrame:
    """node, terminal, n, first: where each node's chain ends, how many nodes of it (ends included) have a value, and the nearest value.

    refs: src, dst (one a src); values: node, value (one a node); declared: node. Chains double in each round with what they carry, so a
    chain of n takes log2(n) rounds, and only nodes that refer take part. A node whose chain goes round in a cycle, or ends at no
    declaration, has a null terminal; in a cycle it has no n and no first value either.
    """
    refs = refs.where("dst IS NOT NULL")
    nodes = declared.select("node").distinct()
    at = nodes.join(refs.toDF("node", "to"), "node").join(values, "node", "left")
    has = F.when(F.col("value").isNotNull(), 1).otherwise(0).cast("long")
    now = cut(at.select("node", "to", has.alias("n"), F.col("value").alias("first")), "carried")
    left = None
    while (n := _unfinished(now, refs)) and n != left:
        left, ahead = n, now.toDF("to", "next", "more", "then")
        now = cut(now.join(ahead, "to", "left").select("node", F.coalesce("next", "to").alias("to"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.coalesce("first", "then").alias("first")), "carried")
    still = nodes.join(refs.select(F.col("src").alias("node")), "node", "left_anti").join(values, "node", "left")
    ends = still.select(F.col("node").alias("to"), "value", F.lit(True).alias("known"))
    x = now.join(ends, "to", "left").join(refs.select(F.col("src").alias("to"), F.lit(True).alias("on")), "to", "left")
    moved = x.select("node", F.when(F.col("known"), F.col("to")).alias("terminal"), F.when(F.col("on").isNull(), F.col("n") + has).alias("n"), F.when(F.col("on").isNull(), F.coalesce("first", "value")).alias("first"))
    return moved.unionByName(still.select("node", F.col("node").alias("terminal"), has.alias("n"), F.col("value").alias("first")))
