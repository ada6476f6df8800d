"""Graphs of shore lines as tables of edges (u, v, weight).

Every loop writes its tables to the shared folder (see `shared.written`). None walks a line node by node: labels, walks
and tours are followed by pointer doubling, so the rounds grow with the logarithm of a line's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import discard, written


def build_edges(edges: DataFrame) -> DataFrame:
    """One undirected edge per pair of nodes: of parallel ones the heaviest; loops go."""
    return edges.where("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("weight").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v", "weight").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight"))


def flat_roots(parents: DataFrame) -> DataFrame:
    """node, root: every pointer (node, root) of a forest followed to its end, by doubling; roots have no row."""
    while True:
        further = parents.select(F.col("node").alias("root"), F.col("root").alias("far"))
        moved = written(parents.join(further, "root", "left").select("node", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("is_moved")), "roots")
        done = moved.where("is_moved").isEmpty()
        discard(parents)
        parents = moved.select("node", "root")
        parents._written_to = moved._written_to
        if done:
            return parents


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of edges (u, v); a loop is a component of its node.

    Each round hooks every node to its smallest neighbour, if that is smaller, flattens the trees which that makes, and
    goes on with the edges between their roots. A node that is not hooked is smaller than all its neighbours.
    """
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    links = written(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    labels = written(nodes.select("node", F.col("node").alias("component")), "labels")
    while not links.isEmpty():
        roots = flat_roots(written(links.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root")), "hooks"))
        named = roots.select(F.col("node").alias("component"), "root")
        renamed = written(labels.join(named, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
        a, b = roots.select(F.col("node").alias("u"), F.col("root").alias("ru")), roots.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        across = links.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("ru", "u").alias("a"), F.coalesce("rv", "v").alias("b")).where("a <> b")
        left = written(across.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "links")
        discard(links, labels, roots)
        links, labels = left, renamed
    discard(links)
    return labels


def main_component(edges: DataFrame) -> DataFrame:
    """Edges of the component with the most edges (of equals that with the smallest node)."""
    labelled = edges.join(components(edges).withColumnRenamed("node", "u"), "u")
    best = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("component", F.struct("n", (-F.col("component")).alias("c"))).alias("component"))
    return labelled.join(F.broadcast(best), "component").select("u", "v", "weight")


def maximum_spanning_forest(edges: DataFrame) -> DataFrame:
    """Boruvka's rounds: every component takes its heaviest edge to another one (ties by the edge's nodes)."""
    spark = edges.sparkSession
    # cu and cv are the components of u and v
    crossing = written(build_edges(edges).select("u", "v", "weight", F.col("u").alias("cu"), F.col("v").alias("cv")), "crossing")
    chosen = spark.createDataFrame([], crossing.select("u", "v", "weight").schema)
    order = F.struct("weight", (-F.col("u")).alias("nu"), (-F.col("v")).alias("nv"))
    while not crossing.isEmpty():
        ends = crossing.select("u", "v", "weight", "cu", "cv", F.explode(F.array("cu", "cv")).alias("c"))
        picked = written(ends.groupBy("c").agg(F.max_by(F.struct("u", "v", "weight", "cu", "cv"), order).alias("e")).select("e.*").distinct(), "picked")
        chosen = chosen.unionByName(picked.select("u", "v", "weight"))  # a union for each round; they are few
        names = components(picked.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
        a, b = names.select(F.col("node").alias("cu"), F.col("component").alias("a")), names.select(F.col("node").alias("cv"), F.col("component").alias("b"))
        left = written(crossing.join(a, "cu").join(b, "cv").where("a <> b").select("u", "v", "weight", F.col("a").alias("cu"), F.col("b").alias("cv")), "crossing")
        discard(crossing, names)
        crossing = left
    discard(crossing)
    return chosen


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def crossings(edges: DataFrame, least: int = 3) -> DataFrame:
    return degrees(edges).where(F.col("degree") >= least)


def walks(edges: DataFrame) -> DataFrame:
    """a, b, length, x, y, a_degree, y_degree of every way a -> b along nodes of degree 2 to the last one, x -> y.

    y is the first node of another degree. Ways round a ring of such nodes have no end and no row.
    """
    ways = written(both_ways(edges), "ways")
    degree = degrees(edges)
    of = lambda n: degree.select(F.col("node").alias(n), F.col("degree").alias(f"{n}_degree"))
    arcs = written(ways.select(F.col("u").alias("a"), F.col("v").alias("b"), "weight").join(of("a"), "a").join(of("b"), "b"), "arcs")
    discard(ways)
    onward = arcs.where("a_degree = 2").select(F.col("a").alias("b"), F.col("b").alias("c"))
    first = arcs.where("b_degree = 2").join(onward, "b").where("c <> a")
    # from each way the one to go on with, and the length before that; a way without a row is the last
    jumps = written(first.select("a", "b", F.col("b").alias("x"), F.col("c").alias("y"), F.col("weight").alias("before")), "jumps")
    for _ in range(max(1, jumps.count()).bit_length()):  # a ring would go on for ever
        further = jumps.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("x").alias("fx"), F.col("y").alias("fy"), F.col("before").alias("more"))
        moved = jumps.join(further, ["x", "y"], "left").select(
            "a", "b", F.coalesce("fx", "x").alias("x"), F.coalesce("fy", "y").alias("y"), (F.col("before") + F.coalesce("more", F.lit(0.0))).alias("before"), F.col("fx").isNotNull().alias("is_moved")
        )
        moved = written(moved, "jumps")
        discard(jumps)
        jumps = moved.drop("is_moved")
        jumps._written_to = moved._written_to
        if moved.where("is_moved").isEmpty():
            break
    last = arcs.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("weight").alias("own"), F.col("b_degree").alias("y_degree")).where("y_degree <> 2")
    alone = arcs.where("b_degree <> 2").select("a", "b", F.col("weight").alias("length"), F.col("a").alias("x"), F.col("b").alias("y"), "a_degree", F.col("b_degree").alias("y_degree"))
    far = jumps.join(last, ["x", "y"]).join(of("a"), "a").select("a", "b", (F.col("before") + F.col("own")).alias("length"), "x", "y", "a_degree", "y_degree")
    return alone.unionByName(far)


def leaf_branches(edges: DataFrame) -> DataFrame:
    """leaf, end, length: from every leaf along nodes of degree 2 to the first node of another degree."""
    return walks(edges).where("a_degree = 1").select(F.col("a").alias("leaf"), F.col("y").alias("end"), "length")


def prune_short_leaves(edges: DataFrame, short: float = 80.0, rounds: int = 30) -> DataFrame:
    """Per round all leaf branches of a length in (0, short) go, until none is left or the rounds are over."""
    held = written(build_edges(edges), "held")
    for _ in range(rounds):
        if held.isEmpty():
            return held
        found = written(walks(held), "walks")
        gone = found.where((F.col("a_degree") == 1) & (F.col("length") > 0) & (F.col("length") < short)).select(F.col("a").alias("leaf"))
        # a node of a branch is the leaf, or has degree 2 and walks into the leaf
        inside = found.where("a_degree = 2 and y_degree = 1").select(F.col("y").alias("leaf"), F.col("a").alias("node")).join(gone, "leaf").select("node")
        doomed = written(gone.select(F.col("leaf").alias("node")).union(inside).distinct(), "doomed")
        if doomed.isEmpty():
            return held
        left = held.join(doomed.select(F.col("node").alias("u")), "u", "left_anti").join(doomed.select(F.col("node").alias("v")), "v", "left_anti").select("u", "v", "weight")
        left = written(left, "held")
        discard(held, found, doomed)
        held = left
    return held


def euler_tour(edges: DataFrame, source: int) -> DataFrame:
    """u, v, weight, at: the ways of the source's tree in the order of a walk round it that starts there, counted from 0.

    The way after x -> u goes from u to its neighbour after x, in a ring. Places are found by doubling.
    """
    by_node = Window.partitionBy("u").orderBy("v")
    ring = both_ways(edges).withColumn("next", F.coalesce(F.lead("v").over(by_node), F.first("v").over(by_node.rowsBetween(Window.unboundedPreceding, 0))))
    ring = written(ring, "ring")
    start = ring.where(F.col("u") == source).agg(F.min("v")).first()[0]
    ends = (F.col("u") == source) & (F.col("next") == F.lit(start))  # after the way into the source from its last neighbour comes the first way
    after = lambda c: F.when(~ends, F.col(c))
    left = written(ring.select(F.col("v").alias("a"), F.col("u").alias("b"), after("u").alias("x"), after("next").alias("y"), F.when(ends, 0).otherwise(1).cast("long").alias("steps")), "tour")
    for _ in range(left.count().bit_length()):
        further = left.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("x").alias("fx"), F.col("y").alias("fy"), F.col("steps").alias("more"))
        moved = left.join(further, ["x", "y"], "left").select("a", "b", F.col("fx").alias("x"), F.col("fy").alias("y"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        moved = written(moved, "tour")
        discard(left)
        left = moved
    whole = left.where("x is null")  # ways of other trees go round for ever
    n = whole.count()
    out = whole.select(F.col("a").alias("u"), F.col("b").alias("v"), (F.lit(n - 1) - F.col("steps")).alias("at"))
    return written(out.join(ring.select("u", "v", "weight"), ["u", "v"]), "tour")


def visits(tour: DataFrame, source: int, block: int = 100_000) -> DataFrame:
    """node, distance, parent, first, last: places in the tour at which a node is entered and left, seen from the source.

    Distances are sums of weights along the tour, plus on the way down and minus on the way up, added up in blocks.
    """
    n = tour.count()
    begin = tour.where(F.col("u") == source).agg(F.min("at")).first()[0]
    turned = tour.withColumn("at", F.pmod(F.col("at") - F.lit(begin), F.lit(n)))
    back = turned.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("at").alias("back_at"))
    signed = turned.join(back, ["u", "v"]).withColumn("down", F.col("at") < F.col("back_at")).withColumn("signed", F.when(F.col("down"), F.col("weight")).otherwise(-F.col("weight")))
    signed = written(signed.withColumn("block", F.floor(F.col("at") / block)), "signed")
    upto = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    before = signed.groupBy("block").agg(F.sum("signed").alias("sum")).select("block", F.coalesce(F.sum("sum").over(upto), F.lit(0.0)).alias("before"))
    inside = Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    run = signed.join(before, "block").withColumn("distance", F.col("before") + F.sum("signed").over(inside))
    found = run.where("down").select(F.col("v").alias("node"), "distance", F.col("u").alias("parent"), F.col("at").alias("first"), F.col("back_at").alias("last"))
    root = tour.sparkSession.createDataFrame([(source, 0.0, None, -1, n)], "node long, distance double, parent long, first long, last long")
    return root.unionByName(found)


def distances(edges: DataFrame, source: int) -> DataFrame:
    """node, distance, parent: along the only path of a tree from the source."""
    return visits(euler_tour(edges, source), source).select("node", "distance", "parent")


def tree_diameter(edges: DataFrame) -> tuple[int, int, float, DataFrame]:
    """Ends and length of a tree's longest path, and the visits from its first end."""
    start = edges.agg(F.min(F.least("u", "v"))).first()[0]
    tour = euler_tour(edges, start)
    far = lambda df: df.orderBy(F.desc("distance"), "node").first()
    a = far(visits(tour, start))["node"]
    reach = visits(tour, a)
    b = far(reach)
    return a, b["node"], b["distance"], reach


def diameter_path(edges: DataFrame) -> DataFrame:
    """node, distance of the nodes of a tree's longest path: those entered no later, and left no earlier, than its end."""
    _, end, _, reach = tree_diameter(edges)
    at = F.broadcast(reach.where(F.col("node") == end).select(F.col("first").alias("f"), F.col("last").alias("l")))  # one row
    return reach.crossJoin(at).where("first <= f and last >= l").select("node", "distance")
