"""Distance joins, nearest neighbours and polygons as equi-joins on grid cells.

A distance predicate alone would be planned as a nested loop.  Every join here
first meets on an integer cell, then applies the exact test.  Points at the
same place are merged before the join.  The cell joins are plain sort-merge
equi-joins followed by another exchange, the form in which adaptive execution
splits the partition of a crowded cell over several tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketgrid.functions.columns import METRES_PER_MILE
from marketgrid.functions.geo import CONUS, miles
from marketgrid.operators import relational
from marketgrid.session import materialise

_BASE_METRES = 1.5625         # finest level of the nearest-neighbour search
_WIDTH = f"greatest(_r.radius_miles * {METRES_PER_MILE}D, 1D)"
_LEVELS = 12                  # 1.5625 m * 4^12 is wider than the projected plane


def _cell(v: str, size: str) -> str:
    """Cell number of a coordinate, as SQL text."""
    return f"cast(floor(({v}) / ({size})) as bigint)"


def _block(cx: str, cy: str) -> Column:
    """The 3x3 block of cells around a cell, one row each."""
    cells = ", ".join(
        f"named_struct('cx', {cx} + {i}L, 'cy', {cy} + {j}L)" for i in (-1, 0, 1) for j in (-1, 0, 1)
    )
    return F.expr(f"explode(array({cells}))")


def radius_join(
    circles: DataFrame, points: DataFrame, radii: DataFrame
) -> DataFrame:
    """Pairs with distance <= the radius of the circle's tier.

    circles: ``cx0, cy0, tier`` and payload; points: ``px, py`` and payload
    with other names; radii: ``tier, radius_miles``, one row per tier (three).
    Cells are as wide as the circle's own radius, so a small tier is not
    searched on the grid of a large one.  Adds ``radius_miles``, ``miles``.
    """
    sizes = radii.agg(
        F.collect_list(F.struct(F.col("tier"), F.col("radius_miles"))).alias("r")
    ).scalar()
    width = f"greatest(radius_miles * {METRES_PER_MILE}D, 1D)"
    ring = (
        circles.filter(F.col("cx0").isNotNull() & F.col("cy0").isNotNull())
        .join(F.broadcast(radii.select("tier", "radius_miles")), "tier")
        .withColumn("_cell", _block(_cell("cx0", width), _cell("cy0", width)))
        .selectExpr("*", "_cell.cx as _cx", "_cell.cy as _cy")
        .drop("_cell")
    )
    located = (
        points.filter(F.col("px").isNotNull() & F.col("py").isNotNull())
        .withColumn("_r", F.explode(sizes))
        .selectExpr(
            "*", "_r.tier as tier", f"{_cell('px', _WIDTH)} as _cx", f"{_cell('py', _WIDTH)} as _cy"
        ).drop("_r")
    )
    return (
        located.join(ring, ["tier", "_cx", "_cy"])
        .withColumn("miles", miles("cx0", "cy0", "px", "py"))
        .filter(F.col("miles") <= F.col("radius_miles"))
        .drop("_cx", "_cy")
    )


def _child_cells(cx: str, cy: str, split: int) -> Column:
    """The split x split cells of the next finer grid inside a cell, one row each."""
    return F.expr(
        f"explode(flatten(transform(sequence(0L, {split - 1}L), i -> transform(sequence(0L, {split - 1}L),"
        f" j -> named_struct('cx', {cx} * {split} + i, 'cy', {cy} * {split} + j)))))")


def radius_sums(
    circles: DataFrame, points: DataFrame, radii: DataFrame, ids: Sequence[str], sums: Sequence[str],
    crowded: int = 64, levels: int = 4,
) -> DataFrame:
    """Per circle, sums of point weights within the radius.

    Copies of a place are merged on both sides first, and the merged points are
    stored, so that no level works out the points again. A cell that lies inside
    the circle as a whole gives its sums unseen; single places are tested only
    in cells on the rim, and a rim cell with more than `crowded` places is cut
    into 16 finer ones first, `levels` times at most (cells from 1/4 down to
    1/256 of the radius). So the tests of a circle follow the places along its
    rim, not those in its area. Circles without a point are absent.
    """
    places = materialise(points.filter(F.col("px").isNotNull() & F.col("py").isNotNull()).groupBy("px", "py").agg(
        *[F.sum(c).alias(c) for c in sums]))
    sizes = radii.agg(F.collect_list(F.struct("tier", "radius_miles")).alias("r")).scalar()
    located = places.withColumn("_r", F.explode(sizes)).selectExpr("*", "_r.tier as tier", f"{_WIDTH} as _w").drop("_r")
    spots = circles.filter(F.col("cx0").isNotNull() & F.col("cy0").isNotNull()).select("cx0", "cy0", "tier").distinct()
    key = ["cx0", "cy0", "tier", "radius_miles", "_w"]
    wide = spots.join(radii.select("tier", "radius_miles"), "tier").withColumn(
        "_w", F.greatest(F.col("radius_miles") * METRES_PER_MILE, F.lit(1.0)))
    frontier = wide.withColumn("_c", _block(_cell("cx0", "_w"), _cell("cy0", "_w"))).select(
        *key, F.col("_c.cx").alias("_cx"), F.col("_c.cy").alias("_cy"))
    found = []
    for level in range(1, levels + 1):
        size = f"(_w / {4**level}.0D)"
        frontier = frontier.withColumn("_c", _child_cells("_cx", "_cy", 4)).select(
            *key, F.col("_c.cx").alias("_cx"), F.col("_c.cy").alias("_cy"))
        # distances of the nearest and the farthest corner, with a millimetre for rounding
        for axis, center in (("x", "cx0"), ("y", "cy0")):
            low, high = f"(_c{axis} * {size} - 0.001D)", f"((_c{axis} + 1) * {size} + 0.001D)"
            frontier = frontier.withColumns({
                f"_n{axis}": F.expr(f"greatest({low} - {center}, {center} - {high}, 0D)"),
                f"_f{axis}": F.expr(f"greatest(abs({low} - {center}), abs({high} - {center}))"),
            })
        reach = F.col("radius_miles") * METRES_PER_MILE
        frontier = frontier.filter(F.sqrt(F.col("_nx") ** 2 + F.col("_ny") ** 2) <= reach + 0.001).withColumn(
            "_inside", F.sqrt(F.col("_fx") ** 2 + F.col("_fy") ** 2) <= reach - 0.001)
        here = located.selectExpr("*", f"{_cell('px', size)} as _cx", f"{_cell('py', size)} as _cy")
        cells = here.groupBy("tier", "_cx", "_cy").agg(
            *[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("_places"))
        met = materialise(frontier.select(*key, "_cx", "_cy", "_inside").join(cells, ["tier", "_cx", "_cy"]))
        found.append(met.filter("_inside").select("cx0", "cy0", "tier", *sums))
        rim = met.filter("not _inside").select(*key, "_cx", "_cy", "_places")
        few = rim if level == levels else rim.filter(F.col("_places") <= crowded)
        tested = few.drop("_places").join(here.drop("_w"), ["tier", "_cx", "_cy"]).filter(
            miles("cx0", "cy0", "px", "py") <= F.col("radius_miles"))
        found.append(tested.select("cx0", "cy0", "tier", *sums))
        frontier = rim.filter(F.col("_places") > crowded).select(*key, "_cx", "_cy")
        if level == levels or frontier.isEmpty():
            break
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    at_spot = every.groupBy("cx0", "cy0", "tier").agg(*[F.sum(c).alias(c) for c in sums])
    return circles.select(*ids, "cx0", "cy0", "tier").join(at_spot, ["cx0", "cy0", "tier"]).select(*ids, *sums)


# -- nearest neighbour --------------------------------------------------------
def _levels(x: str, y: str) -> Column:
    """All (level, cell) a point lies in, finest first."""
    cells = ", ".join(
        f"named_struct('lv', {i}, 'cx', {_cell(x, size)}, 'cy', {_cell(y, size)})"
        for i, size in ((i, f"{_BASE_METRES * 4**i!r}D") for i in range(_LEVELS + 1))
    )
    return F.expr(f"explode(array({cells}))")


def _tested(spots: DataFrame, places: DataFrame, exclude_self: bool, crowded: int) -> DataFrame:
    """(qx, qy, px, py, _copies): the places each query spot is measured against; the nearest is among them.

    A pyramid of cells that grow by a factor of 4 per level. The finest level
    whose 3x3 block holds a target bounds the distance by 2*sqrt(2) cells, less
    than one cell of the next level, so the nearest target is in the 3x3 block
    there. From these cells the search goes down: the box around the targets of
    a cell bounds their distances from below and above, a cell whose nearest
    possible target is farther than another cell's farthest is dropped, cells of
    at most `crowded` targets are measured, others are replaced by their 16
    children. So a query meets a number of cells that does not depend on how
    many targets a far town holds.
    """
    by_cell = places.withColumn("_l", _levels("px", "py")).select("px", "py", "_copies", "_l.*")
    cells = materialise(by_cell.groupBy("lv", "cx", "cy").agg(
        F.count(F.lit(1)).alias("_places"), F.min("px").alias("_x0"), F.max("px").alias("_x1"),
        F.min("py").alias("_y0"), F.max("py").alias("_y1")))
    around = (
        cells.withColumn("_b", _block("cx", "cy"))
        .groupBy("lv", F.col("_b.cx").alias("cx"), F.col("_b.cy").alias("cy"))
        .agg(F.sum("_places").alias("_around"))
    )
    need = 2 if exclude_self else 1
    level = (
        spots.select("qx", "qy").withColumn("_l", _levels("qx", "qy")).select("qx", "qy", "_l.*")
        .join(around.filter(F.col("_around") >= need), ["lv", "cx", "cy"], "left_semi")
        .groupBy("qx", "qy").agg(F.least(F.min("lv") + 1, F.lit(_LEVELS)).alias("lv"))
    )
    size = f"{_BASE_METRES}D * pow(4D, lv)"
    frontier = level.withColumn("_b", _block(_cell("qx", size), _cell("qy", size))).select(
        "qx", "qy", "lv", F.col("_b.cx").alias("cx"), F.col("_b.cy").alias("cy"))
    found = []
    while True:
        near_x = F.greatest(F.col("_x0") - F.col("qx"), F.col("qx") - F.col("_x1"), F.lit(0.0))
        near_y = F.greatest(F.col("_y0") - F.col("qy"), F.col("qy") - F.col("_y1"), F.lit(0.0))
        far_x = F.greatest(F.abs(F.col("_x0") - F.col("qx")), F.abs(F.col("_x1") - F.col("qx")))
        far_y = F.greatest(F.abs(F.col("_y0") - F.col("qy")), F.abs(F.col("_y1") - F.col("qy")))
        far = far_x * far_x + far_y * far_y
        # the only place of a cell may be the query itself: it promises no other one
        sure = F.when((F.col("_places") > 1) | (far > 0), far) if exclude_self else far
        met = frontier.join(cells, ["lv", "cx", "cy"]).withColumns({
            "_near": near_x * near_x + near_y * near_y, "_far": sure}).drop("_x0", "_x1", "_y0", "_y1")
        limit = met.groupBy("qx", "qy").agg(F.min("_far").alias("_limit"))
        # a millionth more, so that rounding never drops the nearest
        open_cells = materialise(met.join(limit, ["qx", "qy"]).filter(
            F.col("_limit").isNull() | (F.col("_near") <= F.col("_limit") * 1.000001)).select(
            "qx", "qy", "lv", "cx", "cy", "_places"))
        few = (F.col("_places") <= crowded) | (F.col("lv") == 0)
        found.append(open_cells.filter(few).join(by_cell, ["lv", "cx", "cy"]).select("qx", "qy", "px", "py", "_copies"))
        crowds = open_cells.filter(~few)
        if crowds.isEmpty():
            return relational.union_all(found)
        frontier = crowds.withColumn("_c", _child_cells("cx", "cy", 4)).select(
            "qx", "qy", (F.col("lv") - 1).alias("lv"), F.col("_c.cx").alias("cx"), F.col("_c.cy").alias("cy"))


def nearest_distance(
    queries: DataFrame, targets: DataFrame, ids: Sequence[str], exclude_self: bool = False, crowded: int = 32
) -> DataFrame:
    """Distance in miles from each query point (px, py) to the nearest target; NULL without a target.

    Exact; see `_tested` for the search. With ``exclude_self`` queries and
    targets are the same set and a point does not count as its own neighbour;
    two points at one place are 0 apart.
    """
    places = targets.filter(F.col("px").isNotNull() & F.col("py").isNotNull()).groupBy("px", "py").agg(
        F.count(F.lit(1)).alias("_copies")
    )
    spots = queries.filter(F.col("px").isNotNull() & F.col("py").isNotNull()).select(
        F.col("px").alias("qx"), F.col("py").alias("qy")).distinct()
    gap = miles("qx", "qy", "px", "py")
    own = (F.col("qx") == F.col("px")) & (F.col("qy") == F.col("py"))
    counted = F.when(~own | (F.col("_copies") > 1), gap) if exclude_self else gap
    best = _tested(spots, places, exclude_self, crowded).groupBy("qx", "qy").agg(F.min(counted).alias("nearest_miles"))
    return (
        queries.join(best, (F.col("px") == F.col("qx")) & (F.col("py") == F.col("qy")), "left")
        .select(*ids, "nearest_miles")
    )


# -- polygons -------------------------------------------------------------------
def edges(vertices: DataFrame) -> DataFrame:
    """Directed edges of rings given as (poly_id, ring_id, seq, lon, lat).

    Rings may be closed explicitly or not.  A self join on the sequence number
    keeps long rings distributed.
    """
    last = vertices.groupBy("poly_id", "ring_id").agg(F.max("seq").alias("_last"), F.min("seq").alias("_first"))
    start = vertices.join(last, ["poly_id", "ring_id"]).withColumn(
        "_next", F.when(F.col("seq") == F.col("_last"), F.col("_first")).otherwise(F.col("seq") + 1)
    )
    end = vertices.select(
        "poly_id", "ring_id", F.col("seq").alias("_next"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2")
    )
    return (
        start.join(end, ["poly_id", "ring_id", "_next"])
        .select("poly_id", "ring_id", "seq", F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), "lon2", "lat2")
        .filter((F.col("lon1") != F.col("lon2")) | (F.col("lat1") != F.col("lat2")))
    )


# A cell's reference point stands at these shares of its width: odd ones, so that it lies on no edge and below no vertex.
_ASIDE = (0.6180339887, 0.7548776662)
_DEEPEST = 12                 # levels of an edge tree; a cell is cut into 4 x 4
_NODE = ["tree_id", "lv", "cx", "cy"]
_ROOT = ["_x0", "_y0", "_w0"]


def _flips(x: str, y: str, to_x: str, to_y: str) -> Column:
    """1 if the way from (x, y) up to to_y and then across to to_x changes sides of the edge, as SQL.

    The steps across follow the half-open rule of a ray to the right: an edge counts if one end is above the ray and
    the other is not, and the ray starts left of it.
    """
    meets_x = f"(y1 + ({x} - x1) * (y2 - y1) / nullif(x2 - x1, 0D))"
    meets_y = f"(x1 + ({to_y} - y1) * (x2 - x1) / nullif(y2 - y1, 0D))"
    up = f"((x1 > {x}) <> (x2 > {x}) and ({meets_x} > {y}) <> ({meets_x} > {to_y}))"
    across = f"((y1 > {to_y}) <> (y2 > {to_y}) and ({x} < {meets_y}) <> ({to_x} < {meets_y}))"
    return F.expr(f"cast({up} as int) + cast({across} as int)")


def _corner(axis: str, lv: str = "lv", cell: str | None = None) -> str:
    """Lower edge of a cell of the tree on an axis, as SQL text."""
    return f"(_{axis}0 + {cell or 'c' + axis} * (_w0 / pow(4D, {lv})))"


def _aside(axis: str, lv: str = "lv", cell: str | None = None) -> str:
    """Coordinate of a cell's reference point, as SQL text."""
    share = _ASIDE[axis == "y"]
    return f"({_corner(axis, lv, cell)} + {share}D * (_w0 / pow(4D, {lv})))"


def edge_tree(lines: DataFrame, crowded: int = 32) -> tuple[DataFrame, DataFrame]:
    """A tree of cells over the edges of each figure: its nodes, and the edges of its leaves.

    lines: ``tree_id, x1, y1, x2, y2``. A cell that more than `crowded` edges touch is cut into 16, so depth follows
    the density of edges: a short figure is one cell, a long one has small cells along its line and large ones beside.
    nodes: ``tree_id, lv, cx, cy``, the root square ``_x0, _y0, _w0``, ``edges``, ``leaf``, and ``side``, 1 where the
    cell's reference point is inside the figure (by parity, so holes and parts are right). Cells without edges are
    leaves too: what lies in them is known without a test.
    """
    lines = lines.select("tree_id", "x1", "y1", "x2", "y2")
    box = lines.groupBy("tree_id").agg(
        F.min(F.least("x1", "x2")).alias("_x0"), F.max(F.greatest("x1", "x2")).alias("_x9"),
        F.min(F.least("y1", "y2")).alias("_y0"), F.max(F.greatest("y1", "y2")).alias("_y9"),
    ).withColumn("_w", F.greatest(F.col("_x9") - F.col("_x0"), F.col("_y9") - F.col("_y0")))
    # a little wider than the box, so that no edge lies on its rim
    square = box.selectExpr(
        "tree_id", "_x0 - _w * 1e-6D - 1e-9D as _x0", "_y0 - _w * 1e-6D - 1e-9D as _y0", "_w * 1.000002D + 2e-9D as _w0")
    here = materialise(lines.join(square, "tree_id").selectExpr("*", "0 as lv", "0L as cx", "0L as cy"))
    right = f"({_corner('x')} + 2 * _w0)"
    level = here.groupBy(*_NODE, *_ROOT).agg(
        F.count(F.lit(1)).alias("edges"),
        (F.sum(_flips(right, _aside("y"), _aside("x"), _aside("y"))) % 2).cast("int").alias("side"))
    edge = ["x1", "y1", "x2", "y2"]
    child = _child_cells("cx", "cy", 4)
    width, rim = "(_w0 / pow(4D, lv + 1))", "(_w0 * 1e-9D)"
    mid = {axis: f"({_corner(axis, 'lv + 1', '_c.c' + axis)} + {width} / 2)" for axis in "xy"}
    touches = F.expr(
        " and ".join(f"abs(({a}1 + {a}2) / 2 - {mid[a]}) <= {width} / 2 + {rim} + abs({a}2 - {a}1) / 2" for a in "xy")
        + f" and abs((x2 - x1) * ({mid['y']} - y1) - (y2 - y1) * ({mid['x']} - x1))"
          f" <= ({width} / 2 + {rim}) * (abs(x2 - x1) + abs(y2 - y1))")
    way = _flips(_aside("x"), _aside("y"), _aside("x", "lv + 1", "_c.cx"), _aside("y", "lv + 1", "_c.cy"))
    nodes, held = [], []
    for depth in range(_DEEPEST + 1):
        leaf = F.lit(True) if depth == _DEEPEST else F.col("edges") <= crowded
        level = materialise(level.withColumn("leaf", leaf))
        nodes.append(level)
        held.append(here.join(level.filter("leaf").select(*_NODE), _NODE, "left_semi").select(*_NODE, *edge))
        crowds = level.filter("not leaf")
        if crowds.isEmpty():
            break
        met = materialise(
            here.select(*_NODE, *edge).join(crowds.select(*_NODE, *_ROOT), _NODE).withColumn("_c", child)
            .withColumns({"_touches": touches, "_flips": way}).filter("_touches or _flips % 2 = 1")
            .selectExpr("tree_id", "lv + 1 as lv", "_c.cx as cx", "_c.cy as cy", *_ROOT, *edge, "_touches", "_flips"))
        here = met.filter("_touches").select(*_NODE, *edge)
        sums = met.groupBy(*_NODE).agg(
            F.count(F.when(F.col("_touches"), 1)).alias("_edges"), F.sum("_flips").alias("_flips"))
        level = crowds.withColumn("_c", child).selectExpr(
            "tree_id", "lv + 1 as lv", "_c.cx as cx", "_c.cy as cy", *_ROOT, "side as _above").join(
            sums, _NODE, "left").selectExpr(
            *_NODE, *_ROOT, "coalesce(_edges, 0L) as edges", "cast((_above + coalesce(_flips, 0L)) % 2 as int) as side")
    return relational.union_all(nodes), relational.union_all(held)


def _trees(nodes: DataFrame) -> DataFrame:
    """One row per figure: its root square and depth."""
    return nodes.groupBy("tree_id", *_ROOT).agg(F.max("lv").alias("_deep"))


def _inside(candidates: DataFrame, nodes: DataFrame, held: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The (ids, tree_id) whose point (lon, lat) is inside the figure; candidates carry the columns of `_trees`.

    A point lies in one leaf, and only the edges that touch this leaf are tested, on the way to its reference point.
    """
    width = "(_w0 / pow(4D, lv))"
    place = {a: f"least(greatest(cast(floor(({v} - _{a}0) / {width}) as bigint), 0L), cast(pow(4D, lv) as bigint) - 1)"
             for a, v in (("x", "lon"), ("y", "lat"))}
    placed = (
        candidates.select(*ids, "tree_id", "lon", "lat", *_ROOT, "_deep").distinct()
        .filter("lon between _x0 and _x0 + _w0 and lat between _y0 and _y0 + _w0")
        .selectExpr("*", "explode(sequence(0, _deep)) as lv")
        .selectExpr("*", f"{place['x']} as cx", f"{place['y']} as cy")
        .join(nodes.filter("leaf").select(*_NODE, "side"), _NODE)
    )
    flips = F.coalesce(_flips(_aside("x"), _aside("y"), "lon", "lat"), F.lit(0))
    return (
        placed.join(held, _NODE, "left").groupBy(*ids, "tree_id", "lon", "lat", "side")
        .agg(F.sum(flips).alias("_flips")).filter("(side + _flips) % 2 = 1").select(*ids, "tree_id")
    )


def point_in_polygon(points: DataFrame, vertices: DataFrame, point_id: str, crowded: int = 32) -> DataFrame:
    """(point_id, poly_id) for every polygon that contains the point.

    Points carry ``lon, lat``; without them they are in no polygon. Points meet the root squares of polygons on cells
    of the square's own size (a square lies in at most four), then one leaf of the polygon's `edge_tree`: the number
    of edges tested does not depend on the length of the outline. The half-open crossing rule gives a point on a
    shared edge to one side; holes and parts work by parity.
    """
    lines = edges(vertices).select(
        F.col("poly_id").alias("tree_id"), F.col("lon1").alias("x1"), F.col("lat1").alias("y1"),
        F.col("lon2").alias("x2"), F.col("lat2").alias("y2"))
    nodes, held = edge_tree(lines, crowded)
    trees = materialise(_trees(nodes).withColumn("_size", F.ceil(F.log2("_w0")).cast("int")))
    size = "pow(2D, _size)"

    def span(axis: str) -> Column:
        return F.expr(f"explode(sequence({_cell(f'_{axis}0', size)}, {_cell(f'_{axis}0 + _w0', size)}))")

    cells = trees.withColumn("_px", span("x")).withColumn("_py", span("y"))
    sizes = trees.agg(F.collect_set("_size")).scalar()       # doublings between the least and the greatest square
    located = (
        points.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()).select(point_id, "lon", "lat")
        .withColumn("_size", F.explode(sizes))
        .selectExpr("*", f"{_cell('lon', size)} as _px", f"{_cell('lat', size)} as _py")
    )
    candidates = located.join(cells, ["_size", "_px", "_py"])
    return _inside(candidates, nodes, held, [point_id]).select(point_id, F.col("tree_id").alias("poly_id"))


def one_polygon(matches: DataFrame, point_id: str) -> DataFrame:
    """Keep one polygon per point (least id) and the number of matches."""
    return matches.groupBy(point_id).agg(F.min("poly_id").alias("poly_id"), F.count(F.lit(1)).alias("n_matches"))


def centroids(vertices: DataFrame) -> DataFrame:
    """Equal-area centroid per polygon, back in degrees; holes subtract by winding."""
    lines = edges(vertices)
    ax, ay = CONUS.forward("lon1", "lat1")
    bx, by = CONUS.forward("lon2", "lat2")
    lines = lines.withColumns({"ax": ax, "ay": ay, "bx": bx, "by": by})
    cross = F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")
    sums = lines.groupBy("poly_id").agg(
        F.sum(cross).alias("a2"),
        F.sum((F.col("ax") + F.col("bx")) * cross).alias("sx"),
        F.sum((F.col("ay") + F.col("by")) * cross).alias("sy"),
    )
    lon, lat = CONUS.inverse("(sx / (3D * a2))", "(sy / (3D * a2))")
    return sums.filter(F.col("a2") != 0).select(
        "poly_id", lon.alias("centroid_lon"), lat.alias("centroid_lat"),
        (F.abs(F.col("a2")) / 2 / METRES_PER_MILE**2).alias("square_miles"),
    )


def dissolve(vertices: DataFrame, group: Column) -> DataFrame:
    """Outline edges of groups of polygons: edges two members share are dropped."""
    forward = (F.col("lon1") < F.col("lon2")) | ((F.col("lon1") == F.col("lon2")) & (F.col("lat1") < F.col("lat2")))
    a = F.struct(F.col("lon1").alias("lon"), F.col("lat1").alias("lat"))
    b = F.struct(F.col("lon2").alias("lon"), F.col("lat2").alias("lat"))
    return (
        edges(vertices).withColumn("group_id", group)
        .withColumns({"_a": F.when(forward, a).otherwise(b), "_b": F.when(forward, b).otherwise(a)})
        .groupBy("group_id", "_a", "_b").agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") % 2 == 1)
        .select(
            "group_id", F.col("_a.lon").alias("lon1"), F.col("_a.lat").alias("lat1"),
            F.col("_b.lon").alias("lon2"), F.col("_b.lat").alias("lat2"),
        )
    )


def touching_groups(outline: DataFrame) -> DataFrame:
    """Pairs of groups whose outlines share a vertex, each pair once (a < b)."""
    ends = outline.select("group_id", F.col("lon1").alias("lon"), F.col("lat1").alias("lat")).unionByName(
        outline.select("group_id", F.col("lon2").alias("lon"), F.col("lat2").alias("lat"))
    ).distinct()
    left = ends.withColumnRenamed("group_id", "group_a")
    right = ends.withColumnRenamed("group_id", "group_b")
    return left.join(right, ["lon", "lat"]).filter(F.col("group_a") < F.col("group_b")).select(
        "group_a", "group_b"
    ).distinct()


def _nearest_leaves(spots: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree_id, qx, qy, lv, cx, cy): leaves of the spot's figure of which one holds the edge nearest to it.

    From the root down: an edge touches its cell, so the cell's farthest corner bounds the distance from above, and a
    cell whose nearest point is farther than that is dropped with all below it.
    """
    spot = ["tree_id", "qx", "qy"]
    used = nodes.filter("edges > 0").select(*_NODE, *_ROOT, "leaf")
    frontier = spots.select(*spot).selectExpr("*", "0 as lv", "0L as cx", "0L as cy", "cast(null as double) as _limit")
    rim, width = "(_w0 * 1e-8D)", "(_w0 / pow(4D, lv))"
    gaps = {a: (f"({_corner(a)} - {rim} - q{a})", f"(q{a} - {_corner(a)} - {width} - {rim})") for a in "xy"}
    near = " + ".join(f"pow(greatest({lo}, {hi}, 0D), 2)" for lo, hi in gaps.values())
    far = " + ".join(f"pow(greatest(abs({lo}), abs({hi})), 2)" for lo, hi in gaps.values())
    found = []
    while True:
        met = frontier.join(used, _NODE).selectExpr(
            *spot, "lv", "cx", "cy", "leaf", "_limit", f"{near} as _near", f"{far} as _far")
        limit = met.groupBy(*spot).agg(F.least(F.min("_limit"), F.min("_far")).alias("_limit"))
        # a millionth more, so that rounding never drops the nearest
        kept = materialise(met.drop("_limit").join(limit, spot).filter("_near <= _limit * 1.000001D").select(
            *spot, "lv", "cx", "cy", "leaf", "_limit"))
        found.append(kept.filter("leaf").select(*spot, "lv", "cx", "cy"))
        rest = kept.filter("not leaf")
        if rest.isEmpty():
            return relational.union_all(found)
        frontier = rest.withColumn("_c", _child_cells("cx", "cy", 4)).selectExpr(
            *spot, "lv + 1 as lv", "_c.cx as cx", "_c.cy as cy", "_limit")


def miles_to_outline(points: DataFrame, outline: DataFrame, point_id: str, group: str, crowded: int = 32) -> DataFrame:
    """Distance from each point (lon, lat) to the outline of its named group, one row per id and group.

    0 for a point inside, by the parity of the same edges; NULL without a position. Points of a group without an
    outline are left out. Both tests go through an `edge_tree`, one in degrees and one in the plane, so the edges
    tested for a point do not grow with the outline.
    """
    degrees = outline.select(
        F.col("group_id").alias("tree_id"), F.col("lon1").alias("x1"), F.col("lat1").alias("y1"),
        F.col("lon2").alias("x2"), F.col("lat2").alias("y2"))
    ax, ay = CONUS.forward("lon1", "lat1")
    bx, by = CONUS.forward("lon2", "lat2")
    plane = outline.select(
        F.col("group_id").alias("tree_id"), ax.alias("x1"), ay.alias("y1"), bx.alias("x2"), by.alias("y2"))
    qx, qy = CONUS.forward("lon", "lat")
    asked = points.select(point_id, F.col(group).alias("tree_id"), "lon", "lat").withColumns({"qx": qx, "qy": qy})
    nodes, held = edge_tree(degrees, crowded)
    inside = _inside(asked.join(_trees(nodes), "tree_id"), nodes, held, [point_id]).distinct().withColumn(
        "_within", F.lit(True))
    flat, drawn = edge_tree(plane, crowded)
    spots = asked.filter("qx is not null and qy is not null").select("tree_id", "qx", "qy").distinct()
    ux, uy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = ((F.col("qx") - F.col("x1")) * ux + (F.col("qy") - F.col("y1")) * uy) / (ux * ux + uy * uy)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    gap = miles("qx", "qy", F.col("x1") + t * ux, F.col("y1") + t * uy)
    best = _nearest_leaves(spots, flat).join(drawn, _NODE).groupBy("tree_id", "qx", "qy").agg(F.min(gap).alias("_gap"))
    known = asked.join(_trees(flat).select("tree_id"), "tree_id", "left_semi")
    return (
        known.join(best, ["tree_id", "qx", "qy"], "left").join(inside, [point_id, "tree_id"], "left")
        .groupBy(point_id, F.col("tree_id").alias(group))
        .agg(F.min(F.when(F.col("_within"), F.lit(0.0)).otherwise(F.col("_gap"))).alias("miles_off"))
    )
