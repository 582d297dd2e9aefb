"""Point in polygon, nearest neighbour and merged outlines, by grid cells, exact tests and joins on edges."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import discard, staged

#: Targets, or else sources, up to so many are held as one array in every task.
FEW = 2048
#: Beyond it, cells split until none holds more targets than LEAF, by 4 to the power of STEPS at a time.
LEAF, STEPS = 16, 2


def _edges(ring: Column) -> Column:
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))


def inside(x: Column, y: Column, edges: Column) -> Column:
    """Strictly inside: an odd number of crossings with the edges of all rings (parts and holes), and on no edge."""

    def crosses(e: Column) -> Column:
        return ((e["y1"] > y) != (e["y2"] > y)) & (x < e["x1"] + (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0).cast("double")))

    def touches(e: Column) -> Column:
        flat = (e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"])
        return flat & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))

    odd = F.size(F.filter(edges, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1
    return odd & ~F.exists(edges, touches)


def point_in_polygon(points: DataFrame, polygons: DataFrame, side: float, x: str = "x", y: str = "y", rings: str = "rings") -> DataFrame:
    """Points joined with every polygon that strictly contains them. Rings are closed.

    Both sides are dealt to square cells of the given side: a polygon to all cells of its box, a
    point to its own. The exact test sees only pairs of one cell whose polygon has the point in its
    box; boxes and edges are made once a polygon. No column names may be shared.
    """
    flat = F.flatten(rings)
    along = {c: F.transform(flat, lambda p: p[c]) for c in "xy"}  # noqa: B023
    ends = {f"__{n}{c}": f(along[c]) for c in "xy" for n, f in (("lo", F.array_min), ("hi", F.array_max))}
    cells = lambda c: F.explode(F.sequence(F.floor(F.col(f"__lo{c}") / side), F.floor(F.col(f"__hi{c}") / side)))
    cover = polygons.withColumns({**ends, "__edges": F.flatten(F.transform(rings, _edges))}).withColumn("__cx", cells("x")).withColumn("__cy", cells("y"))
    placed = points.withColumn("__px", F.floor(F.col(x) / side)).withColumn("__py", F.floor(F.col(y) / side))
    pairs = placed.join(cover, (F.col("__px") == F.col("__cx")) & (F.col("__py") == F.col("__cy")))
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    boxed = pairs.filter(px.between(F.col("__lox"), F.col("__hix")) & py.between(F.col("__loy"), F.col("__hiy")))
    return boxed.filter(inside(px, py, F.col("__edges"))).drop("__px", "__py", "__cx", "__cy", "__edges", *ends)


def _named(groups: Sequence[str] | dict[str, Column] | None) -> dict[str, Column]:
    """Each group's condition on the targets; without groups one that takes all."""
    if groups is None:
        return {"": F.lit(True)}
    return groups if isinstance(groups, dict) else {f"_{g}": F.col("target_group") == g for g in groups}


def _nearest_of_few(sources: DataFrame, targets: np.ndarray, carry: list[str], to: list[str]) -> DataFrame:
    """Distances to a bounded array of targets (x, y, and whether each group has it), which goes to every task; sources stream by in Arrow batches, once for all groups."""
    sets = [targets[targets[:, 2 + k] > 0, :2] for k in range(len(to))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y"))
            near = [np.full(len(x), np.nan) for _ in sets]
            for held, found in zip(sets, near, strict=True):
                at_once = max(1, (1 << 20) // max(1, len(held)))
                for k in range(0, len(x) if len(held) else 0, at_once):
                    part = slice(k, k + at_once)
                    found[part] = ((x[part, None] - held[:, 0]) ** 2 + (y[part, None] - held[:, 1]) ** 2).min(1)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), *(pa.array(np.sqrt(n) / 1000, from_pandas=True) for n in near)], names=[*carry, *to])

    rows = sources.select(*carry, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return rows.mapInArrow(run, T.StructType([*rows.select(*carry).schema.fields, *[T.StructField(c, T.DoubleType()) for c in to]]))


def _nearest_to_few(rows: DataFrame, held: pa.Table, t: DataFrame, key: str, to: list[str], carry: list[str]) -> DataFrame:
    """Distances of a bounded table of sources (key, __x, __y), which goes to every task; targets stream by in Arrow batches, once for all groups, and a task returns a row a source."""
    keys, (x, y) = held.column(0).combine_chunks(), (held.column(c).to_numpy().astype(float) for c in ("__x", "__y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, at_once = np.full((len(to), len(x)), np.inf), max(1, (1 << 20) // max(1, len(x)))
        for b in batches:
            tx, ty = (b.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
            for k, found in enumerate(near):
                own = b.column(f"g{k}").to_numpy(zero_copy_only=False).astype(bool)
                gx, gy = tx[own], ty[own]
                for i in range(0, len(gx), at_once):
                    part = slice(i, i + at_once)
                    np.minimum(found, ((x - gx[part, None]) ** 2 + (y - gy[part, None]) ** 2).min(0), out=found)
        near[np.isinf(near)] = np.nan  # no target of the group
        yield pa.RecordBatch.from_arrays([keys, *(pa.array(n, from_pandas=True) for n in near)], names=["__key", *to])

    types = T.StructType([T.StructField("__key", rows.schema[key].dataType), *[T.StructField(c, T.DoubleType()) for c in to]])
    found = t.mapInArrow(run, types).groupBy("__key").agg(*[(F.sqrt(F.min(c)) / 1000).alias(c) for c in to])
    return rows.join(F.broadcast(found), rows[key].eqNullSafe(found["__key"]), "left").select(key, *carry, *to)


def _nearest_by_descent(rows: DataFrame, t: DataFrame, key: str, to: list[str], leaf: int, carry: list[str]) -> DataFrame:
    """(key, carry, to): dual descent of blocks of sources in a tree of nested cells of targets, for any number of either.

    `rows` are written sources with their position as __x and __y. `t` has x, y and a boolean column g<k> for each group of `to`. Cells split until none holds more
    than `leaf` different targets, so crowded places have deep cells. Sources that share a cell of
    half a level's side are one block. A cell is known by one of its targets in each group: the
    farthest corner of a block's box from it bounds what the block need look at, and cells whose boxes
    are farther from the block's than the least bound of every group that they hold are left out at
    every level. Blocks split as cells do, so that few are on the levels above the last. The last
    cells' targets are held against the block's box in the same way, and only those that are left meet
    single sources.
    """
    box = t.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("n")).first()
    spread = max(box.x1 - box.x0, box.y1 - box.y0, 1e-3) * (1 + 1e-9)
    depth = max(1, math.ceil(math.log(max(box.n / leaf, 1), 4)))
    marks = [f"g{k}" for k in range(len(to))]

    def placed(level: int) -> DataFrame:
        cell = lambda c, c0: F.least(F.floor((F.col(c) - c0) / (spread / 2**level)), F.lit(2**level - 1)).cast("long")
        return t.select("x", "y", *marks, cell("x", box.x0).alias("cx"), cell("y", box.y0).alias("cy"))

    while depth < 2 * STEPS * 8 and placed(depth).groupBy("cx", "cy").count().filter(F.col("count") > leaf).limit(1).count():
        depth += STEPS
    lowest = staged(placed(depth), "targets-placed")
    # the targets are read once for the last cells, and every level's cells are made from those
    known = [F.min(F.when(F.col(g), F.struct("x", "y"))).alias(f"t{g}") for g in marks]
    last = staged(lowest.groupBy("cx", "cy").agg(*known), "last-cells")
    block = lambda c, c0: F.floor((F.col(f"__{c}") - c0) / (spread / 2 ** (depth + 1))).alias(f"__b{c}")
    rows = rows.select("*", block("x", box.x0), block("y", box.y0))
    ends = {f"{n}{c}": f for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))}
    fine = rows.filter("__x IS NOT NULL AND __y IS NOT NULL").groupBy(F.col("__bx").alias("bx"), F.col("__by").alias("by"))
    fine = staged(fine.agg(*[f(f"__{e[-1]}").alias(e) for e, f in ends.items()]), "blocks")

    def blocks(level: int) -> DataFrame:
        """The boxes of the sources that share a cell of half the side of a level's cells."""
        up = lambda c: F.shiftright(c, depth - level).alias(c)
        return fine.groupBy(up("bx"), up("by")).agg(*[f(e).alias(e) for e, f in ends.items()])

    beside = lambda c, v0, v1: F.greatest(v0 - F.col(f"hi{c}"), F.col(f"lo{c}") - v1, F.lit(0.0))
    far = lambda c, v: F.greatest(F.abs(F.col(f"lo{c}") - v), F.abs(F.col(f"hi{c}") - v))
    length = lambda x, y: F.sqrt(x * x + y * y)

    def within(met: DataFrame) -> DataFrame:
        """The rows whose `least` distance from the block is at most the block's least bound m<g> of a group (null where the row has none of it)."""
        bounds = {f"w{g}": F.min(f"m{g}").over(Window.partitionBy("bx", "by")) for g in marks}
        wanted = reduce(lambda a, b: a | b, [F.coalesce(F.col("least") <= F.col(f"w{g}"), F.lit(False)) & F.col(f"m{g}").isNotNull() for g in marks])
        return met.withColumns(bounds).filter(wanted)

    def near(met: DataFrame, level: int) -> DataFrame:
        """The pairs of blocks and cells of a level that a block need look at."""
        side = spread / 2**level
        outside = lambda c, c0: beside(c, F.lit(c0) + F.col(f"c{c}") * side, F.lit(c0) + (F.col(f"c{c}") + 1) * side)
        least = length(outside("x", box.x0), outside("y", box.y0)) - 1e-6 * side
        bounds = [length(far("x", F.col(f"t{g}.x")), far("y", F.col(f"t{g}.y"))) for g in marks]
        bounds = [F.when(F.col(f"t{g}").isNotNull(), m).alias(f"m{g}") for g, m in zip(marks, bounds, strict=True)]
        return within(met.select("bx", "by", *ends, "cx", "cy", *[f"t{g}" for g in marks], least.alias("least"), *bounds))

    first = (depth - 1) % STEPS + 1
    found = blocks(first).withColumns({"px": F.lit(0).cast("long"), "py": F.lit(0).cast("long")})
    for level in range(first, depth + 1, STEPS):
        if level > first:
            # smaller blocks leave out some of the larger one's cells before these split
            parts = blocks(level).withColumns({"pbx": F.shiftright("bx", STEPS), "pby": F.shiftright("by", STEPS)})
            whole = found.select(F.col("bx").alias("pbx"), F.col("by").alias("pby"), "cx", "cy", *[f"t{g}" for g in marks])
            found = near(parts.join(whole, ["pbx", "pby"]), level - STEPS).select("bx", "by", *ends, F.col("cx").alias("px"), F.col("cy").alias("py"))
        up = lambda c: F.shiftright(c, depth - level).alias(c)  # noqa: E731, B023
        cells = last.groupBy(up("cx"), up("cy")).agg(*[F.min(f"t{g}").alias(f"t{g}") for g in marks])
        down = STEPS if level > first else level
        cells = cells.withColumns({"px": F.shiftright("cx", down), "py": F.shiftright("cy", down)})
        kept = near(found.join(cells, ["px", "py"]), level)
        found = staged(kept.select("bx", "by", *ends, "cx", "cy", *[f"t{g}" for g in marks]), "nearest-cells")
    found = found.select("bx", "by", *ends, "cx", "cy")
    held = found.join(lowest.select("cx", "cy", F.col("x").alias("tx"), F.col("y").alias("ty"), *marks), ["cx", "cy"])
    tx, ty = F.col("tx"), F.col("ty")
    least = length(beside("x", tx, tx), beside("y", ty, ty)) * (1 - 1e-9)
    bounds = [F.when(F.col(g), length(far("x", tx), far("y", ty))).alias(f"m{g}") for g in marks]
    held = within(held.select("bx", "by", "tx", "ty", *marks, least.alias("least"), *bounds)).select("bx", "by", "tx", "ty", *marks)
    met = rows.join(held, (F.col("__bx") == F.col("bx")) & (F.col("__by") == F.col("by")), "left")
    apart = (F.col("__x") - tx) * (F.col("__x") - tx) + (F.col("__y") - ty) * (F.col("__y") - ty)
    return met.groupBy(key, *carry).agg(*[(F.sqrt(F.min(F.when(F.col(g), apart))) / 1000).alias(c) for g, c in zip(marks, to, strict=True)])


def nearest_km(sources: DataFrame, targets: DataFrame, key: str, groups: Sequence[str] | dict[str, Column] | None = None, to: str = "dist_km", few: int = FEW, leaf: int = LEAF, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carry, to): distance of each source (key, x, y; metres) to the nearest target (x, y); null without targets or position.

    With `groups`, one distance column to<suffix> is made for each group, all in one pass over the
    sources: a list names values of the targets' column `target_group` (suffix _<value>), a dictionary
    has a condition on the targets for each suffix, and a target may belong to several. Up to `few`
    targets are held as one array in every task; where there are more, up to `few` sources are; more of
    both meet by descent in a tree of cells. `key` is unique among the sources; `carry` names columns of
    theirs to keep.
    """
    named = _named(groups)
    columns, marks = [f"{to}{suffix}" for suffix in named], [f"g{k}" for k in range(len(named))]
    belongs = [F.coalesce(condition, F.lit(False)).alias(m) for m, condition in zip(marks, named.values(), strict=True)]
    t = targets.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *belongs)
    t = staged(t.groupBy("x", "y").agg(*[F.bool_or(m).alias(m) for m in marks]), "targets").filter("x IS NOT NULL AND y IS NOT NULL")
    held = t.limit(few + 1).toPandas()
    if len(held) <= few:
        return _nearest_of_few(sources, held.astype(float).to_numpy().reshape(-1, 2 + len(marks)), [key, *carry], columns)
    # filtered and counted once written: before it, positions would be computed a second time
    rows = staged(sources.select(key, *carry, F.col("x").cast("double").alias("__x"), F.col("y").cast("double").alias("__y")), "sources-placed")
    alone = rows.select(key, "__x", "__y").limit(few + 1).toArrow()
    if alone.num_rows <= few:
        return _nearest_to_few(rows, alone, t, key, columns, list(carry))
    return _nearest_by_descent(rows, t, key, columns, leaf, list(carry))


def _points(ring: Column) -> Column:
    """A closed ring's directed edges as (a, b)."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def outline_edges(parts: DataFrame, code: str, rings: str = "rings") -> DataFrame:
    """(code, a, b): the directed edges of all parts of a code that no other part of it shares, a once for each occurrence left over.

    Every part's rings are turned counter-clockwise first (holes too: a hole's edge lies on the other
    side of its neighbours'), so that a shared edge occurs once in each direction and cancels out.
    """

    def turned(ring: Column) -> Column:
        edges = _points(ring)
        twice = F.aggregate(edges, F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))
        return F.when(twice >= 0, edges).otherwise(F.transform(edges, lambda e: F.struct(e["b"].alias("a"), e["a"].alias("b"))))

    edges = parts.select(code, F.explode(F.flatten(F.transform(rings, turned))).alias("e")).select(code, "e.a", "e.b").filter("a <> b")
    forward = F.col("a") < F.col("b")
    both = edges.select(code, F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"), F.when(forward, 1).otherwise(-1).alias("way"))
    left = both.groupBy(code, "p", "q").agg(F.sum("way").alias("way")).filter("way <> 0")
    return left.select(code, F.when(F.col("way") > 0, F.col("p")).otherwise(F.col("q")).alias("a"), F.when(F.col("way") > 0, F.col("q")).otherwise(F.col("p")).alias("b"))


def dissolved(parts: DataFrame, code: str, rings: str = "rings") -> DataFrame:
    """(code, rings): the parts of each code merged to closed rings: outer ones counter-clockwise, holes and gaps between parts clockwise.

    Parts share whole edges (the same two vertices). Edges that two parts share cancel out; the rest
    are chained to rings by pointer jumping: rounds of joins, as many as the logarithm of the longest
    ring, whatever the number of edges of a code. Where parts touch in a vertex only, its edges are
    paired by direction, which leaves areas as they are. Each ring starts at its smallest edge.
    """
    edges = outline_edges(parts, code, rings)
    # the edges that leave a vertex are paired with those that arrive, in order
    leaves, arrives = Window.partitionBy(code, "a").orderBy("b"), Window.partitionBy(code, "b").orderBy("a")
    edges = staged(edges.withColumns({"no": F.xxhash64(code, "a", "b"), "out": F.row_number().over(leaves), "in": F.row_number().over(arrives)}), "edges")
    after = edges.select(code, F.col("a").alias("b"), F.col("out").alias("in"), F.struct("a", "b").alias("next"))
    at = edges.select(code, F.struct("a", "b").alias("e"), "b", "in").join(after, [code, "b", "in"]).select(code, "e", "next")
    # the smallest edge that can be reached: pointers twice as long in each round
    now = staged(at.select(code, "e", "next", F.least("e", "next").alias("first")), "chains")
    while True:
        there = now.select(code, F.col("e").alias("next"), F.col("next").alias("far"), F.col("first").alias("seen"))
        after_now = staged(now.join(there, [code, "next"]).select(code, "e", F.col("far").alias("next"), F.least("first", "seen").alias("first"), (F.col("seen") < F.col("first")).alias("moved")), "chains")
        done = not after_now.filter("moved").limit(1).count()
        discard(now)
        now = after_now.drop("moved")
        if done:
            break
    # the distance to the end of each ring, which is the edge before its first one
    ring = at.join(now.select(code, "e", "first"), [code, "e"])
    steps = staged(ring.select(code, "e", "first", F.when(F.col("next") != F.col("first"), F.col("next")).alias("next"), F.when(F.col("next") != F.col("first"), 1).otherwise(0).alias("left")), "steps")
    while steps.filter("next IS NOT NULL").limit(1).count():
        there = steps.select(code, F.col("e").alias("next"), F.col("next").alias("far"), F.col("left").alias("more"))
        longer = staged(steps.join(there, [code, "next"], "left").select(code, "e", "first", F.col("far").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")), "steps")
        discard(steps)
        steps = longer
    each = steps.groupBy(code, "first").agg(F.array_sort(F.collect_list(F.struct((-F.col("left")).alias("k"), F.col("e.a").alias("p")))).alias("r"))
    closed = F.concat(F.transform("r", lambda v: v["p"]), F.array(F.get("r", F.lit(0))["p"]))
    return each.groupBy(code).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", closed.alias("ring")))), lambda v: v["ring"]).alias("rings"))
