"""Shore lines: vertices (line_id, pos, x, y), clipping, merging, simplifying, normals and points along them."""

from __future__ import annotations


from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def along() -> WindowSpec:
    return Window.partitionBy("line_id").orderBy("pos")


def near_pairs(a: DataFrame, b: DataFrame, within: float, keep_a: list[str], keep_b: list[str]) -> DataFrame:
    """Pairs of points not farther apart than `within`, with their distance: equi-join on square cells of that size.

    Neither side is broadcast: of coordinates that are computed from small columns Spark expects far fewer bytes than come.
    """
    cell = lambda c: F.floor(F.col(c) / within).cast("bigint")
    around = F.explode(F.array(*[F.struct((cell("x") + i).alias("cx"), (cell("y") + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    left = a.select(*[F.col(c).alias(f"a_{c}") for c in keep_a], F.col("x").alias("ax"), F.col("y").alias("ay"), around.alias("c")).select("*", "c.cx", "c.cy").drop("c")
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in keep_b], F.col("x").alias("bx"), F.col("y").alias("by"), cell("x").alias("cx"), cell("y").alias("cy"))
    d = F.sqrt((F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by")))
    return left.join(right.hint("merge"), ["cx", "cy"]).withColumn("d", d).where(F.col("d") <= within).drop("cx", "cy")


def snap_vertices(vertices: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Every vertex moved to the nearest vertex of another line within the tolerance (ties by line and position)."""
    pairs = near_pairs(vertices, vertices, tolerance, ["line_id", "pos"], ["line_id", "pos"]).where("a_line_id <> b_line_id")
    best = pairs.groupBy(F.col("a_line_id").alias("line_id"), F.col("a_pos").alias("pos")).agg(F.min_by(F.struct("bx", "by"), F.struct("d", "b_line_id", "b_pos")).alias("to"))
    return vertices.join(best.hint("merge"), ["line_id", "pos"], "left").select("line_id", "pos", F.coalesce("to.bx", "x").alias("x"), F.coalesce("to.by", "y").alias("y"), F.col("to").isNotNull().alias("is_snapped"))


def segments_of(vertices: DataFrame) -> DataFrame:
    """line_id, pos, x0, y0, x1, y1, length, start (distance along the line)."""
    nxt = vertices.withColumns({"x1": F.lead("x").over(along()), "y1": F.lead("y").over(along())}).where("x1 is not null")
    s = nxt.select("line_id", "pos", F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1").withColumn("length", F.sqrt(F.pow(F.col("x1") - F.col("x0"), F.lit(2.0)) + F.pow(F.col("y1") - F.col("y0"), F.lit(2.0))))
    return s.withColumn("start", F.sum("length").over(along()) - F.col("length"))


def node_key(x: Column | str, y: Column | str, decimals: int = 3) -> Column:
    return F.concat_ws("/", F.format_string(f"%.{decimals}f", x), F.format_string(f"%.{decimals}f", y))


def protected_vertices(vertices: DataFrame, anchors: DataFrame, buffer: float = 0.05) -> DataFrame:
    """Vertices within the buffer of an anchor (x, y)."""
    hit = near_pairs(vertices, anchors.withColumn("_n", F.lit(1)), buffer, ["line_id", "pos"], ["_n"]).select(F.col("a_line_id").alias("line_id"), F.col("a_pos").alias("pos")).distinct()
    return vertices.join(hit.hint("merge"), ["line_id", "pos"], "left_semi")


def bend_deg() -> Column:
    """Change of bearing at a vertex, folded into [0, 90]; null at the ends."""
    bearing = lambda dx, dy: F.degrees(F.atan2(dy, dx))
    before = bearing(F.col("x") - F.lag("x").over(along()), F.col("y") - F.lag("y").over(along()))
    after = bearing(F.lead("x").over(along()) - F.col("x"), F.lead("y").over(along()) - F.col("y"))
    turn = F.pmod(F.abs(after - before), F.lit(180.0))
    return F.least(turn, 180.0 - turn)


def simplify_by_anchors(vertices: DataFrame, protected: DataFrame, angle_deg: float = 1.0) -> DataFrame:
    """Ends, protected vertices and bends stay; a vertex that repeats its kept predecessor goes."""
    marked = vertices.withColumn("bend", bend_deg()).join(protected.select("line_id", "pos", F.lit(True).alias("is_protected")).hint("merge"), ["line_id", "pos"], "left")
    kept = marked.where(F.col("bend").isNull() | (F.col("bend") > angle_deg) | F.coalesce("is_protected", F.lit(False)))
    same = (F.col("x") == F.lag("x").over(along())) & (F.col("y") == F.lag("y").over(along()))
    return kept.withColumn("same", F.coalesce(same, F.lit(False))).where("not same").select("line_id", "pos", "x", "y")


def line_summary(vertices: DataFrame) -> DataFrame:
    """line_id, n_vertices, length_m and box."""
    lengths = segments_of(vertices).groupBy("line_id").agg(F.sum("length").alias("length_m"))
    boxes = vertices.groupBy("line_id").agg(F.count(F.lit(1)).alias("n_vertices"), F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"))
    return boxes.join(lengths, "line_id", "left")


def tag_main(vertices: DataFrame) -> DataFrame:
    """line_id, coastline_role: main for the longest line (ties: the smallest id), other for the rest."""
    s = line_summary(vertices)
    best = s.agg(F.max_by("line_id", F.struct("length_m", (-F.col("line_id")).alias("i"))).alias("main"))
    return s.crossJoin(F.broadcast(best)).select("line_id", "n_vertices", "length_m", F.when(F.col("line_id") == F.col("main"), "main").otherwise("other").alias("coastline_role"))


def join_mode(a_head, a_tail, b_head, b_tail) -> Column:
    """struct(d, mode): how two chains meet at their nearest ends; modes 0 tail-head, 1 tail-tail, 2 head-head, 3 head-tail."""
    dist = lambda p, q: F.sqrt(F.pow(p[0] - q[0], F.lit(2.0)) + F.pow(p[1] - q[1], F.lit(2.0)))
    ways = (dist(a_tail, b_head), dist(a_tail, b_tail), dist(a_head, b_head), dist(a_head, b_tail))
    return F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("mode")) for i, d in enumerate(ways)]))


def line_ends(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("line_id").agg(F.min_by(F.struct("x", "y"), "pos").alias("head"), F.max_by(F.struct("x", "y"), "pos").alias("tail"))


def chain_lines(vertices: DataFrame, gap: float = 150.0, passes: int = 20) -> DataFrame:
    """line_id, chain_id. In each pass every chain, in order of id, takes the nearest free chain whose end is within the gap.

    A chain has the smallest id of its lines. Passes go on until one joins nothing, `passes` at most. Candidates meet by
    cells, the choices of a pass are made by greedy_pairs(); a chain is one row, with its two tips.
    """
    from ..shared import discard, written

    tips = written(line_ends(vertices).select(F.col("line_id").cast("long").alias("chain_id"), "head", "tail"), "tips")
    members = written(tips.select(F.col("chain_id").alias("line_id"), "chain_id"), "members")
    for _ in range(passes):
        every = tips.select("chain_id", F.posexplode(F.array("head", "tail")).alias("is_tail", "p")).select("chain_id", "is_tail", "p.x", "p.y")
        pairs = near_pairs(every, every, gap, ["chain_id", "is_tail"], ["chain_id", "is_tail"]).where("a_chain_id < b_chain_id")
        # ways in the order tail-head, tail-tail, head-head, head-tail
        mode = F.when(F.col("a_is_tail") == 1, F.col("b_is_tail")).otherwise(F.col("b_is_tail") + 2)
        best = pairs.groupBy(F.col("a_chain_id").alias("a"), F.col("b_chain_id").alias("b")).agg(F.min(F.struct("d", mode.alias("mode"))).alias("way"))
        found = greedy_pairs(best.select("a", "b", "way.d", "way.mode"))
        if found.isEmpty():
            break
        left = tips.select(F.col("chain_id").alias("a"), F.col("head").alias("ah"), F.col("tail").alias("at"))
        right = tips.select(F.col("chain_id").alias("b"), F.col("head").alias("bh"), F.col("tail").alias("bt"))
        merged = found.join(left, "a").join(right, "b")
        head = F.when(F.col("mode") < 2, F.col("ah")).when(F.col("mode") == 2, F.col("at")).otherwise(F.col("bh"))
        tail = F.when(F.col("mode") == 0, F.col("bt")).when(F.col("mode") == 1, F.col("bh")).when(F.col("mode") == 2, F.col("bt")).otherwise(F.col("at"))
        taken = found.select(F.explode(F.array("a", "b")).alias("chain_id"))
        new_tips = written(tips.join(taken, "chain_id", "left_anti").unionByName(merged.select(F.col("a").alias("chain_id"), head.alias("head"), tail.alias("tail"))), "tips")
        new_members = written(members.join(found.select(F.col("b").alias("chain_id"), "a"), "chain_id", "left").select("line_id", F.coalesce("a", "chain_id").alias("chain_id")), "members")
        discard(tips, members)
        tips, members = new_tips, new_members
    return members


def clip_segments(segments: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """segments with t0, t1: the share of each inside the box (Liang-Barsky); segments wholly outside go."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    t0, t1, ok = F.lit(0.0), F.lit(1.0), F.lit(True)
    for p, q in ((-dx, F.col("x0") - xmin), (dx, xmax - F.col("x0")), (-dy, F.col("y0") - ymin), (dy, ymax - F.col("y0"))):
        r = F.try_divide(q, p)
        ok = ok & ((p != 0) | (q >= 0))
        t0, t1 = F.when(p < 0, F.greatest(t0, r)).otherwise(t0), F.when(p > 0, F.least(t1, r)).otherwise(t1)
    return segments.withColumn("t0", t0).withColumn("t1", t1).where(ok & (F.col("t0") <= F.col("t1")))


def erase_box(segments: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Parts (t0, t1) of segments outside the box."""
    inside = clip_segments(segments, xmin, ymin, xmax, ymax).select("seg_id", F.col("t0").alias("a"), F.col("t1").alias("b"))
    rows = segments.join(inside, "seg_id", "left")
    parts = F.when(F.col("a").isNull(), F.array(F.struct(F.lit(0.0).alias("t0"), F.lit(1.0).alias("t1")))).otherwise(F.array(F.struct(F.lit(0.0).alias("t0"), F.col("a").alias("t1")), F.struct(F.col("b").alias("t0"), F.lit(1.0).alias("t1"))))
    return rows.select(*segments.columns, F.explode(parts).alias("p")).select(*segments.columns, "p.t0", "p.t1").where("t1 > t0")


def merge_with_replacement(outer: DataFrame, inner: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """outer without the box, and inner inside it."""
    a = erase_box(outer, *box).withColumn("origin", F.lit("outer"))
    b = clip_segments(inner, *box).where("t1 > t0").withColumn("origin", F.lit("inner"))
    return a.unionByName(b, allowMissingColumns=True)


def open_ends(ends: DataFrame, box: tuple[float, float, float, float], tolerance: float = 2.0) -> DataFrame:
    """Ends (origin, end_id, x, y) near the box's edge that have no end of another origin within the tolerance, with the side."""
    xmin, ymin, xmax, ymax = box
    sides = F.array_min(F.array(*[F.struct(F.abs(F.col(c) - v).alias("d"), F.lit(n).alias("side")) for n, c, v in (("west", "x", xmin), ("east", "x", xmax), ("south", "y", ymin), ("north", "y", ymax))]))
    near = ends.withColumn("s", sides).where(F.col("s.d") <= tolerance).select("origin", "end_id", "x", "y", F.col("s.side").alias("side"))
    met = near_pairs(near, near, tolerance, ["origin", "end_id"], ["origin"]).where("a_origin <> b_origin").select(F.col("a_origin").alias("origin"), F.col("a_end_id").alias("end_id")).distinct()
    return near.join(met, ["origin", "end_id"], "left_anti")


def _shrunken(box: tuple[float, float, float, float], tolerance: float) -> tuple[float, float, float, float]:
    return box[0] + tolerance / 4, box[1] + tolerance / 4, box[2] - tolerance / 4, box[3] - tolerance / 4


def bridge_candidates(ends: DataFrame, tolerance: float, max_gap: float, box: tuple[float, float, float, float] | None = None, choosers: DataFrame | None = None) -> DataFrame:
    """a_end_id < b_end_id, d of ends of different origins more than the tolerance and at most max_gap apart; a is one of the
    choosers, any end if they are None.

    With a box a bridge may not run through its inside, from which a quarter of the tolerance is taken all round.
    """
    pairs = near_pairs(ends if choosers is None else choosers, ends, max_gap, ["origin", "end_id"], ["origin", "end_id"])
    pairs = pairs.where((F.col("a_origin") != F.col("b_origin")) & (F.col("a_end_id") < F.col("b_end_id")) & (F.col("d") > tolerance))
    if box is None:
        return pairs
    xmin, ymin, xmax, ymax = _shrunken(box, tolerance)
    if xmin >= xmax or ymin >= ymax:
        return pairs
    low, high, inside = F.lit(0.0), F.lit(1.0), F.lit(True)
    for a, b, least, most in (("ax", "bx", xmin, xmax), ("ay", "by", ymin, ymax)):
        step = F.col(b) - F.col(a)
        enter, leave = F.try_divide(least - F.col(a), step), F.try_divide(most - F.col(a), step)
        level = step == 0
        low, high = F.greatest(low, F.when(~level, F.least(enter, leave))), F.least(high, F.when(~level, F.greatest(enter, leave)))
        inside = inside & (~level | ((F.col(a) > least) & (F.col(a) < most)))
    return pairs.where(~(inside & (low < high)))


#: So many choosers are decided in one task, in order.
CHUNK = 50_000


def greedy_pairs(candidates: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The rows (a, b, d, ...) that a loop over a, in order, chooses: its nearest free b (ties: the smaller); each is used once.

    candidates: a < b, a row per pair. In rounds: a chooser decides at once if no undecided one before it could take it or
    its nearest free partner, for then the loop would choose the same; what it takes is out of reach for all others. The
    first chooser always can, but where all choices hang on the one before, few others can. Then, and when no more than
    `chunk` are left, the first `chunk` choosers are decided in order in one task: they depend on no others.
    """
    from ..shared import discard, written

    left = written(candidates, "candidates")
    chosen = []
    while not left.isEmpty():
        best = left.groupBy("a").agg(F.min(F.struct("d", "b")).alias("best"))
        first = left.groupBy("b").agg(F.min("a").alias("first"))
        n = left.select("a").distinct().count()
        found = None
        if n > chunk:
            ready = best.select("a", F.col("best.b").alias("b")).join(first, "b").where("first = a").drop("first")
            found = written(left.join(ready.join(first.select(F.col("b").alias("a")), "a", "left_anti"), ["a", "b"]), "chosen")
            if found.count() * 64 < n:
                discard(found)
                found = None
        if found is None:
            last = left.select("a").distinct().orderBy("a").limit(max(chunk, 1)).agg(F.max("a").alias("last"))
            firsts = left.join(F.broadcast(last), F.col("a") <= F.col("last")).drop("last")  # one row
            found = written(firsts.repartition(1).sortWithinPartitions("a", "d", "b").mapInPandas(_in_order, left.schema), "chosen")
        chosen.append(found)
        used = found.select(F.explode(F.array("a", "b")).alias("used"))
        rest = left.join(used, left["a"] == used["used"], "left_anti").join(used, left["b"] == used["used"], "left_anti")
        if n <= chunk:
            break
        done = left
        if chosen[-1].isEmpty():  # choosers without a free partner
            rest = rest.join(F.broadcast(last), F.col("a") > F.col("last")).drop("last")
        left = written(rest, "candidates")
        discard(done)
    out = chosen[0] if chosen else left
    for more in chosen[1:]:
        out = out.unionByName(more)
    return out


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows sorted by a, d, b those whose a and b are both still free."""
    used = set()
    for batch in batches:
        kept = []
        for i, (a, b) in enumerate(zip(batch["a"].tolist(), batch["b"].tolist(), strict=True)):
            if a not in used and b not in used:
                used |= {a, b}
                kept.append(i)
        yield batch.iloc[kept]


#: Nearest partners that a chooser gets at first; how many times as many they are after a round that they did not suffice.
PARTNERS, MORE_PARTNERS = 32, 8
#: So many ends choose in one task, in order.
BRIDGE_CHUNK = 200_000


def bridges(ends: DataFrame, tolerance: float = 2.0, max_gap: float = 100.0, box: tuple[float, float, float, float] | None = None, chunk: int = BRIDGE_CHUNK) -> DataFrame:
    """a_end_id, b_end_id, d: in order, each end takes its nearest later end of another origin that a bridge may reach.

    In rounds: the first `chunk` ends that are left get their nearest free partners only, and choose in order in one task.
    Where an end finds all of them taken and may have others, the round stops before it, and the next one gives more. Ends
    that have chosen and ends that were taken leave, so what is looked at is bounded by the chunk, not by all that lie within max_gap.
    """
    from ..shared import discard, written

    left = ends.select("origin", "end_id", "x", "y")
    if box is not None:  # whatever sets out from inside runs through it
        xmin, ymin, xmax, ymax = _shrunken(box, tolerance)
        left = left.where(~((F.col("x") > xmin) & (F.col("x") < xmax) & (F.col("y") > ymin) & (F.col("y") < ymax)))
    left, chosen, partners = written(left, "ends"), [], PARTNERS
    while True:
        last = left.select("end_id").distinct().orderBy("end_id").limit(max(chunk, 1)).agg(F.max("end_id")).first()[0]
        if last is None:
            break
        lists = _partner_lists(left, left.where(F.col("end_id") <= last), tolerance, max_gap, box, partners)
        firsts = lists.repartition(1).sortWithinPartitions("a", "d", "b")
        found = written(firsts.mapInPandas(lambda batches, n=partners: _choices(batches, n), "a long, b long, d double, stopped boolean"), "chosen")
        discard(lists)
        stop = found.where("stopped").agg(F.min("a")).first()[0]
        chosen.append(found.where("not stopped").select(F.col("a").alias("a_end_id"), F.col("b").alias("b_end_id"), "d"))
        taken = chosen[-1].select(F.col("b_end_id").alias("end_id")).unionByName(chosen[-1].select(F.col("a_end_id").alias("end_id")))
        rest = written(left.where(F.col("end_id") > last if stop is None else F.col("end_id") >= stop).join(taken, "end_id", "left_anti"), "ends")
        discard(left)
        left, partners = rest, PARTNERS if stop is None else partners * MORE_PARTNERS
    out = chosen[0] if chosen else left.select(F.col("end_id").alias("a_end_id"), F.col("end_id").alias("b_end_id"), F.col("x").alias("d"))
    for more in chosen[1:]:
        out = out.unionByName(more)
    return out


def _partner_lists(ends: DataFrame, choosers: DataFrame, tolerance: float, max_gap: float, box: tuple[float, float, float, float] | None, partners: int) -> DataFrame:
    """a, b, d, nth: the nearest partners of each chooser, so many at most.

    They are looked for where some four times as many ends lie at the density that ends themselves see, and for the choosers
    that have fewer there within max_gap.
    """
    from ..shared import discard, written

    def within(some: DataFrame, radius: float) -> DataFrame:
        pairs = bridge_candidates(ends, tolerance, radius, box, some).select(F.col("a_end_id").cast("long").alias("a"), F.col("b_end_id").cast("long").alias("b"), "d")
        return pairs.withColumn("nth", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).where(F.col("nth") <= partners)

    n = F.col("n").cast("double")
    dense = ends.groupBy(F.floor(F.col("x") / max_gap).alias("cx"), F.floor(F.col("y") / max_gap).alias("cy")).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(n * n) / F.sum(n)).first()[0]
    radius = max_gap * (4 * partners / 3.14 / dense) ** 0.5
    if radius >= max_gap:
        return written(within(choosers, max_gap), "partners")
    near = written(within(choosers, radius), "partners")
    whole = near.where(F.col("nth") == partners).select("a")
    lacking = choosers.join(whole, choosers["end_id"] == whole["a"], "left_anti")
    lists = written(near.join(whole, "a", "left_semi").unionByName(within(lacking, max_gap)), "partners")
    discard(near)
    return lists


def _choices(batches: Iterator[pd.DataFrame], partners: int) -> Iterator[pd.DataFrame]:
    """Of rows sorted by a, d, b those whose a and b are both still free, as far as the lists go: the first row of a chooser
    all of whose partners are taken, and whose list may have been cut, is the last one, and stopped is true there."""
    used, stopped = set(), False
    for batch in batches:
        kept, last = [], None
        for i, (a, b, nth) in enumerate(zip(batch["a"].tolist(), batch["b"].tolist(), batch["nth"].tolist(), strict=True)):
            if stopped:
                break
            if a in used:
                continue
            if b not in used:
                used |= {a, b}
                kept.append(i)
            elif nth == partners:
                stopped, last = True, i
                kept.append(i)
        yield batch.iloc[kept][["a", "b", "d"]].assign(stopped=np.array([i == last for i in kept], bool))


def contract_chains(edges: DataFrame) -> DataFrame:
    """Pieces of linework joined where just two meet: chain_id, n_edges, length per maximal run through nodes of degree 2."""
    from .graph import components, degrees

    twos = degrees(edges).where("degree = 2").select("node")
    e = edges.withColumn("edge_id", F.xxhash64("u", "v"))
    at = e.select("edge_id", F.explode(F.array("u", "v")).alias("node")).join(twos, "node")
    pairs = at.groupBy("node").agg(F.min("edge_id").alias("u"), F.max("edge_id").alias("v")).where("u <> v").select("u", "v", F.lit(0.0).alias("weight"))
    runs = components(pairs).withColumnRenamed("node", "edge_id")
    return e.join(runs, "edge_id", "left").groupBy(F.coalesce("component", "edge_id").alias("chain_id")).agg(F.count(F.lit(1)).alias("n_edges"), F.sum("weight").alias("length"))


def douglas_peucker(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Which vertices stay."""
    keep = np.zeros(len(x), bool)
    if len(x):
        keep[[0, -1]] = True
    stack = [(0, len(x) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        length2 = dx * dx + dy * dy
        t = np.clip((px * dx + py * dy) / length2, 0, 1) if length2 else np.zeros(len(px))
        u, v = px - t * dx, py - t * dy
        d = np.sqrt(u * u + v * v)
        i = int(np.argmax(d))
        if d[i] > tolerance:
            keep[a + 1 + i] = True
            stack += [(a, a + 1 + i), (a + 1 + i, b)]
    return keep


#: Stretches of so many vertices are simplified in one task (80 bytes each). Where vertices lie equally far from the line
#: between the ends, the first is split off, so a level may shorten a stretch by a few vertices only; a level is some jobs.
STRETCH = 2_000_000


def simplify_lines(vertices: DataFrame, tolerance: float, stretch: int = STRETCH) -> DataFrame:
    """Douglas-Peucker: line_id, pos, x, y of the vertices that stay.

    Level by level: each round finds the farthest vertex of every open stretch of every line by one aggregate, which
    combines in each task first, and splits there; so a line's vertices are spread over all tasks. Stretches that have
    come down to `stretch` vertices are finished in a task each. Ties go to the first vertex; positions are unique.
    """
    from ..shared import discard, written

    if tolerance < 0:
        raise ValueError("the tolerance is not negative")
    rows = vertices.select(F.col("line_id").cast("long").alias("line_id"), F.col("pos").cast("long").alias("pos"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    ends = rows.groupBy("line_id").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.min_by(F.struct("x", "y"), "pos").alias("pa"), F.max_by(F.struct("x", "y"), "pos").alias("pb"))
    kept = [rows.join(ends.select("line_id", "a", "b"), "line_id").where("pos = a or pos = b").drop("a", "b")]
    left = written(rows.join(ends, "line_id").where("pos > a and pos < b"), "open-vertices")
    finished = []
    dx, dy = F.col("pb.x") - F.col("pa.x"), F.col("pb.y") - F.col("pa.y")
    px, py, length2 = F.col("x") - F.col("pa.x"), F.col("y") - F.col("pa.y"), dx * dx + dy * dy
    t = F.coalesce(F.greatest(F.least(F.try_divide(px * dx + py * dy, length2), F.lit(1.0)), F.lit(0.0)), F.lit(0.0))
    far = F.sqrt((px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy))
    while True:
        best = left.groupBy("line_id", "a", "b").agg(F.count("*").alias("n"), F.max(F.struct(far.alias("d"), (-F.col("pos")).alias("before"), "x", "y")).alias("far"))
        splits = written(best.where(F.col("far.d") > tolerance).select("line_id", "a", "b", "n", (-F.col("far.before")).alias("m"), F.struct("far.x", "far.y").alias("pm")), "splits")
        if splits.isEmpty():
            break
        small = left.join(splits.where(F.col("n") <= stretch).select("line_id", "a", "b"), ["line_id", "a", "b"])
        flat = small.select("line_id", "a", "b", "pos", "x", "y", *[F.col(f"{p}.{c}").alias(f"{p}{c}") for p in ("pa", "pb") for c in ("x", "y")])
        finished.append(written(flat.groupBy("line_id", "a", "b").applyInPandas(_finished(tolerance), rows.schema), "simplified"))
        large = splits.where(F.col("n") > stretch)
        kept.append(large.select("line_id", F.col("m").alias("pos"), "pm.x", "pm.y"))
        at = left.join(large.drop("n"), ["line_id", "a", "b"]).where("pos <> m")
        below = F.col("pos") < F.col("m")
        parts = at.select("line_id", "pos", "x", "y", F.when(below, F.col("a")).otherwise(F.col("m")).alias("a"), F.when(below, F.col("m")).otherwise(F.col("b")).alias("b"), F.when(below, F.col("pa")).otherwise(F.col("pm")).alias("pa"), F.when(below, F.col("pm")).otherwise(F.col("pb")).alias("pb"))
        done = left
        left = written(parts, "open-vertices")
        discard(done)
    out = kept[0]
    for more in kept[1:] + finished:
        out = out.unionByName(more)
    return out


def _finished(tolerance: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Simplifies a stretch (rows between its ends, whose places each row carries) and returns what stays of its inside."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[["line_id", "pos", "x", "y", "pax", "pay", "pbx", "pby"]].sort_values("pos")
        x, y = (np.concatenate([pdf[f"pa{c}"].iloc[:1], pdf[c], pdf[f"pb{c}"].iloc[:1]]) for c in ("x", "y"))
        return pdf[douglas_peucker(x, y, tolerance)[1:-1]][["line_id", "pos", "x", "y"]]

    return run


def points_at(vertices: DataFrame, chainages: DataFrame, block_m: float = 50_000.0) -> DataFrame:
    """chainages (line_id, chainage_m, ...) with x, y on the line; beyond its ends, the ends.

    Chainages and segments are put into one order along each line, and a chainage takes the last segment that starts at
    or before it. The order is made in stretches of block_m, so a line of any length is many groups, not one.
    """
    s = segments_of(vertices)
    block = lambda c: F.floor(c / block_m).cast("bigint")
    total = s.groupBy("line_id").agg(F.max(F.col("start") + F.col("length")).alias("_total"))
    marks = chainages.join(total, "line_id").withColumn("_key", F.greatest(F.least("chainage_m", "_total"), F.lit(0.0)))
    marks = marks.select("line_id", block(F.col("_key")).alias("_block"), "_key", F.lit(None).cast("bigint").alias("pos"), F.struct(*chainages.columns).alias("_mark"))
    held = s.select("line_id", F.explode(F.sequence(block(F.col("start")), block(F.col("start") + F.col("length")))).alias("_block"), F.col("start").alias("_key"), "pos", F.struct("start", "length", "x0", "y0", "x1", "y1").alias("_seg"))
    order = Window.partitionBy("line_id", "_block").orderBy("_key", F.col("pos").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    at = held.unionByName(marks, allowMissingColumns=True).withColumn("_seg", F.last("_seg", ignorenulls=True).over(order)).where("_mark is not null")
    share = F.try_divide(F.col("_key") - F.col("_seg.start"), F.col("_seg.length"))
    t = F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0))
    on = lambda a, b: (F.col(f"_seg.{a}") + t * (F.col(f"_seg.{b}") - F.col(f"_seg.{a}"))).alias(a[0])
    return at.select("_mark.*", on("x0", "x1"), on("y0", "y1"))


def equal_step_points(vertices: DataFrame, step: float, include_ends: bool = True) -> DataFrame:
    """line_id, point_order, chainage_m, x, y every `step` metres along each line, and at its end."""
    total = segments_of(vertices).groupBy("line_id").agg(F.sum("length").alias("total"))
    marks = F.transform(F.sequence(F.lit(0), F.floor(F.col("total") / step).cast("int")), lambda i: i * step)
    if include_ends:
        marks = F.array_distinct(F.concat(marks, F.array("total")))
    rows = total.select("line_id", F.posexplode(marks).alias("point_order", "chainage_m"))
    return points_at(vertices, rows)


def node_points(vertices: DataFrame, ends_only: bool = False, decimals: int = 8) -> DataFrame:
    """Vertices (or ends), one per rounded place: the first by line and position."""
    v = vertices
    if ends_only:
        v = v.withColumns({"_f": F.lag("pos").over(along()).isNull(), "_l": F.lead("pos").over(along()).isNull()}).where("_f or _l").drop("_f", "_l")
    nth = F.row_number().over(Window.partitionBy(F.round("x", decimals), F.round("y", decimals)).orderBy("line_id", "pos"))
    return v.withColumn("nth", nth).where("nth = 1").drop("nth")


def combine_points(*named: tuple[str, DataFrame]) -> DataFrame:
    """The points of several strategies, tagged; of points at one place that of the first strategy stays."""
    parts = [df.select("line_id", "x", "y", F.lit(name).alias("source_strategy"), F.lit(i).alias("_i")) for i, (name, df) in enumerate(named)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    nth = F.row_number().over(Window.partitionBy(F.round("x", 8), F.round("y", 8)).orderBy("_i", "line_id"))
    return whole.withColumn("nth", nth).where("nth = 1").drop("nth", "_i")


def equal_radius_rows(radius: float, include_end: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        line, xs, ys = int(pdf.line_id.iloc[0]), pdf.x.to_numpy(float), pdf.y.to_numpy(float)
        px, py = xs[0], ys[0]
        out, i, t0 = [(px, py)], 0, 0.0
        while i < len(xs) - 1:
            dx, dy = xs[i + 1] - xs[i], ys[i + 1] - ys[i]
            fx, fy = xs[i] - px, ys[i] - py
            a, b, c = dx * dx + dy * dy, 2 * (fx * dx + fy * dy), fx * fx + fy * fy - radius * radius
            disc = b * b - 4 * a * c
            t = (-b + np.sqrt(disc)) / (2 * a) if a > 0 and disc >= 0 else -1.0
            if t0 < t <= 1.0 and t > t0 + 1e-12:
                px, py, t0 = xs[i] + t * dx, ys[i] + t * dy, t
                out.append((px, py))
            else:
                i, t0 = i + 1, 0.0
        if include_end and np.hypot(out[-1][0] - xs[-1], out[-1][1] - ys[-1]) > 1e-6:
            out.append((xs[-1], ys[-1]))
        return pd.DataFrame({"line_id": line, "point_order": range(len(out)), "x": [p[0] for p in out], "y": [p[1] for p in out]})

    return run


def equal_radius_points(vertices: DataFrame, radius: float = 200.0, include_end: bool = True) -> DataFrame:
    """Each next point is where the line first leaves the circle of the radius around the point before it."""
    if radius <= 0:
        raise ValueError("the radius is positive")
    rows = vertices.select(F.col("line_id").cast("long").alias("line_id"), F.col("pos").cast("long").alias("pos"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return rows.groupBy("line_id").applyInPandas(equal_radius_rows(radius, include_end), "line_id long, point_order long, x double, y double")


def shore_normals(vertices: DataFrame, points: DataFrame, sea_side: str = "right", delta: float = 5.0) -> DataFrame:
    """points (line_id, chainage_m, ...) with tx, ty, nx, ny, normal_azimuth_deg: the tangent between chainage -+ delta."""
    if sea_side not in ("left", "right"):
        raise ValueError("sea_side is left or right")
    total = segments_of(vertices).groupBy("line_id").agg(F.sum("length").alias("_total"))
    base = points.join(total, "line_id").select(*points.columns, F.greatest(F.col("chainage_m") - delta, F.lit(0.0)).alias("_a"), F.least(F.col("chainage_m") + delta, F.col("_total")).alias("_b"))
    end = lambda c: points_at(vertices, base.select("line_id", F.col("chainage_m").alias("_c"), F.col(c).alias("chainage_m")).distinct()).select("line_id", F.col("_c").alias("chainage_m"), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y"))
    j = base.join(end("_a"), ["line_id", "chainage_m"]).join(end("_b"), ["line_id", "chainage_m"])
    dx, dy = F.col("_bx") - F.col("_ax"), F.col("_by") - F.col("_ay")
    n = F.sqrt(dx * dx + dy * dy)
    j = j.withColumns({"tx": F.try_divide(dx, n), "ty": F.try_divide(dy, n)})
    nx, ny = (F.col("ty"), -F.col("tx")) if sea_side == "right" else (-F.col("ty"), F.col("tx"))
    return j.select(*points.columns, "tx", "ty", nx.alias("nx"), ny.alias("ny"), F.pmod(F.degrees(F.atan2(nx, ny)), F.lit(360.0)).alias("normal_azimuth_deg"), F.lit(sea_side).alias("sea_side"))


def validate_normals(normals: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One row of counts: nulls, vectors not of unit length, azimuths out of range, repeated ids; is_valid, is_monotone."""
    need = ("point_id", "chainage_m", "tx", "ty", "nx", "ny", "normal_azimuth_deg")
    null = F.lit(False)
    for c in need:
        null = null | F.col(c).isNull()
    unit = lambda a, b: F.abs(F.sqrt(F.col(a) * F.col(a) + F.col(b) * F.col(b)) - 1) > tolerance
    checked = normals.withColumn("_before", F.lag("chainage_m").over(Window.partitionBy("line_id").orderBy("point_id")))
    out = checked.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(null).alias("n_null"), F.count_if(unit("tx", "ty")).alias("n_bad_tangent"), F.count_if(unit("nx", "ny")).alias("n_bad_normal"),
        F.count_if((F.col("normal_azimuth_deg") < 0) | (F.col("normal_azimuth_deg") >= 360)).alias("n_bad_azimuth"), (F.count(F.lit(1)) - F.countDistinct("point_id")).alias("n_repeated"),
        F.coalesce(F.min(F.col("_before").isNull() | (F.col("chainage_m") >= F.col("_before"))), F.lit(True)).alias("is_monotone"),
    )
    return out.withColumn("is_valid", F.expr("n_null + n_bad_tangent + n_bad_normal + n_bad_azimuth + n_repeated = 0"))


def normals_summary(normals: DataFrame) -> DataFrame:
    return normals.agg(F.count(F.lit(1)).alias("n"), F.min("chainage_m").alias("chainage_min"), F.max("chainage_m").alias("chainage_max"), F.avg("normal_azimuth_deg").alias("azimuth_mean"), F.array_join(F.array_sort(F.collect_set("sea_side")), ",").alias("sea_sides"))


def normal_lines(points: DataFrame, length_m: float = 200.0) -> DataFrame:
    """point_id and both ends of a line of the length along the normal."""
    if length_m <= 0:
        raise ValueError("the length is positive")
    return points.select("point_id", "x", "y", (F.col("x") + F.col("nx") * length_m).alias("end_x"), (F.col("y") + F.col("ny") * length_m).alias("end_y"))


def parts_of(lines: DataFrame, least: int = 2) -> DataFrame:
    """line_id, part, coords for every part (array of coordinates) of at least so many vertices of multi-part lines."""
    return lines.select("line_id", F.posexplode("parts").alias("part", "coords")).where(F.size("coords") >= least)


