"""Point-in-polygon join (J8) and its uses.

Spark has no containment join, so the layer is indexed by a quadtree over its bounding square:

1. a polygon enters at the level whose cells are as wide as it, in four cells at most, and
   only cells that one of its edges touches are divided further, until they are a small part
   of its extent and hold few edges.  Each cell keeps its own level and only the edges that
   matter for its points, clipped from its parent's; cells wholly inside stay whole.  So the
   rows follow a polygon's outline and not its area;
2. the leaves of the tree over all polygons' cells divide the square; a leaf takes the
   candidates of the cells above it, so a point meets exactly one leaf;
3. a directory of at most ``4 ** DIRECTORY`` coarse squares tells which levels occur there; a
   point probes one key for each of these levels, and an equi-join on (level, cell) finds its leaf;
4. leaves wholly inside their lowest polygon carry the answer as a plain column; only points
   of the others go through the ring test (boundary points count as inside), against the
   edges near their cell.

A leaf row holds ``CANDS`` candidates at most; where more polygons overlap, the leaf has
several rows, and a point's answers from them are merged by an aggregate.  The index is
written once, so the planner knows its size when it chooses the join.  With ``how="first"`` a
point gets the lowest containing zone id (one row per point, no fan-out); with ``how="all"``
it gets one row per containing polygon (overlapping boxes).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from odflow.functions.geo import crossing_count, inside_ring, on_ring_edge
from odflow.operators._broadcast import materialize
from odflow.operators.filters import present
from odflow.session import shared_dir

# A round divides a cell into 4 x 4, so it goes down STEP levels; a polygon's cells go down
# ROUNDS rounds, and further while one holds more than EDGES edges, to level DEEPEST at most.
STEP, ROUNDS, EDGES, DEEPEST = 2, 2, 64, 24
CANDS = 64
DIRECTORY = 7
# Keys for points outside the square: no cell has this level; spread over so many rows.
_OUTSIDE, _SPREAD = -1, 64
_KEY = ("_level", "_gx", "_gy")
_KNOWN: dict[tuple, LayerIndex] = {}


@dataclass(frozen=True)
class LayerIndex:
    """A written index: leaf rows, the directory of levels, the square and the leaf rows a point may meet."""

    leaves: DataFrame
    directory: DataFrame
    x0: float
    y0: float
    side: float
    rows: int


def _classified(cells: DataFrame, x0: float, y0: float, side: float, eps: float) -> DataFrame:
    """``_kind`` of each cell (of level ``_level``): 1 touched by an edge, 2 wholly inside.

    In the even-odd ray test (ray towards +x) an edge counts only when its y-range holds the
    point's y.  Of a cell's edges those outside its horizontal strip and those wholly left of
    it never count; those wholly right of it that span the strip always count once and are
    folded into ``par``.  The kept edges go through the same arithmetic as a test of the whole
    ring.  Cells that no edge touches lie inside or outside as their centre does; outside
    ones are dropped, inside ones keep no edges.
    """
    # As SQL text: one expression each, instead of a Python call for every operator.  The
    # rectangle is widened by a hair: rounding of a point's cell never moves it out.
    w = f"({side!r}D / shiftleft(1L, _level))"
    e = f"({w} * 1e-7D + {eps!r}D)"
    rect = cells.select("*", F.expr(f"""inline(array(struct(
        {x0!r}D + _gx * {w} - {e} AS x0, {x0!r}D + (_gx + 1) * {w} + {e} AS x1, {x0!r}D + (_gx + 0.5D) * {w} AS xm,
        {y0!r}D + _gy * {w} - {e} AS y0, {y0!r}D + (_gy + 1) * {w} + {e} AS y1, {y0!r}D + (_gy + 0.5D) * {w} AS ym)))"""))
    spans = "(least(e.x1, e.x2) > x1 AND least(e.y1, e.y2) < y0 AND greatest(e.y1, e.y2) > y1)"
    near = "greatest(e.y1, e.y2) >= y0 AND least(e.y1, e.y2) <= y1 AND greatest(e.x1, e.x2) >= x0"
    # The generators keep the optimizer from inlining the filters into every later use.
    kept = rect.select(*[x for x in rect.columns if x not in ("_edges", "_par")], F.expr(f"""inline(array(struct(
        filter(_edges, e -> {near} AND NOT {spans}) AS _edges,
        (_par + size(filter(_edges, e -> {spans}))) % 2 AS _par)))"""))

    def away(x, y):
        return f"(e.x2 - e.x1) * ({y} - e.y1) - (e.y2 - e.y1) * ({x} - e.x1)"

    corners = [away(x, y) for x in ("x0", "x1") for y in ("y0", "y1")]
    touch = (f"exists(_edges, e -> greatest(e.x1, e.x2) >= x0 AND least(e.x1, e.x2) <= x1 AND greatest(e.y1, e.y2) >= y0 "
             f"AND least(e.y1, e.y2) <= y1 AND NOT ({' AND '.join(f'{x} > 0' for x in corners)}) "
             f"AND NOT ({' AND '.join(f'{x} < 0' for x in corners)}))")
    crossings = ("aggregate(_edges, 0, (n, e) -> n + CASE WHEN (e.y1 > ym) != (e.y2 > ym) THEN "
                 "CASE WHEN xm < (e.x2 - e.x1) * (ym - e.y1) / (e.y2 - e.y1) + e.x1 THEN 1 ELSE 0 END ELSE 0 END)")
    rest = [x for x in cells.columns if x not in ("_edges", "_kind")]
    cells = kept.select(*rest, "_edges", F.expr(
        f"explode(array(CASE WHEN _kind = 2 THEN 2 WHEN {touch} THEN 1 WHEN ({crossings} + _par) % 2 = 1 THEN 2 ELSE 0 END))")
        .alias("_now")).where("_now > 0")
    return cells.select(*rest, F.when(F.col("_now") == 1, F.col("_edges")).otherwise(F.array()).alias("_edges"),
                        F.col("_now").alias("_kind"))


def _divided(cells: DataFrame, condition: str) -> DataFrame:
    """Touched cells that meet the condition replaced by their descendants ``STEP`` levels down."""
    n = 1 << STEP
    down = f"CASE WHEN _kind = 1 AND {condition} THEN {STEP} ELSE 0 END"
    cells = cells.select("*", F.expr(f"explode(CASE WHEN _kind = 1 AND {condition} THEN sequence(0, {n * n - 1}) ELSE array(0) END)").alias("_i"),
                         F.expr(down).alias("_down"))
    return cells.withColumns({
        "_gx": F.expr(f"shiftleft(_gx, _down) + _i % {n}"), "_gy": F.expr(f"shiftleft(_gy, _down) + CAST(floor(_i / {n}) AS INT)"),
        "_level": F.expr("_level + _down")}).drop("_i", "_down")


def _polygon_cells(layer: DataFrame, carry: Sequence[str], square: tuple, cell: float | None, most_edges: int) -> DataFrame:
    """The cells of every polygon, each at its own level, written."""
    x0, y0, side, eps = square
    finest = DEEPEST if cell is None else max(0, min(DEEPEST, _level_of(side, cell)))
    extent = "greatest(maxx - minx, maxy - miny)"
    entry = f"least({finest}, CASE WHEN {extent} > 0 THEN CAST(floor(log2({side!r}D / {extent})) AS INT) ELSE {finest} END)"

    def span(lo, hi, at):
        to = lambda v: f"CAST(floor(({v} - {at!r}D) / {side!r}D * shiftleft(1L, _level)) AS BIGINT)"
        return F.expr(f"explode(sequence({to(lo)}, {to(hi)}))")

    # Unclassified cells count as touched, so the first round divides them all.
    cells = layer.select("zone_id", *carry, "minx", "maxx", "miny", "maxy", F.lit(1).alias("_kind"), F.lit(0).alias("_par"),
                         F.col("edges").alias("_edges"), F.expr(entry).alias("_level"), F.expr(entry).alias("_entry"))
    cells = cells.select("*", span("minx", "maxx", x0).alias("_gx")).select("*", span("miny", "maxy", y0).alias("_gy"))
    cells = cells.repartition("_gx", "_gy", "zone_id")
    room = f"_level + {STEP} <= {finest}"
    for i in range(ROUNDS):
        cells = _classified(_divided(cells, f"{room} AND _level <= _entry + {STEP * i}"), *square)
    cells = materialize(cells)
    # Outlines with many vertices go on, by their number of edges.
    while most_edges > EDGES and not cells.where(f"_kind = 1 AND size(_edges) > {EDGES} AND {room}").isEmpty():
        cells = materialize(_classified(_divided(cells.repartition(*_KEY, "zone_id"), f"{room} AND size(_edges) > {EDGES}"), *square))
    return cells


def _level_of(side: float, width: float) -> int:
    """Deepest level whose cells are at least so wide."""
    level = 0
    while level < DEEPEST and side / (1 << (level + 1)) >= width:
        level += 1
    return level


def _up(column: str, level: str) -> str:
    return f"shiftright({column}, _level - {level})"


def _leaves(cells: DataFrame) -> DataFrame:
    """The undivided cells of the tree that holds all polygons' cells: they divide the square."""
    inner = (cells.select(*_KEY).distinct().where("_level > 0")
             .select("*", F.expr("explode(sequence(0, _level - 1))").alias("_l"))
             .select(F.col("_l").alias("_level"), F.expr(_up("_gx", "_l")).alias("_gx"), F.expr(_up("_gy", "_l")).alias("_gy"))
             .distinct())
    below = inner.select(F.expr("""inline(transform(sequence(0, 3), i -> struct(_level + 1 AS _level,
        shiftleft(_gx, 1) + i % 2 AS _gx, shiftleft(_gy, 1) + CAST(i > 1 AS INT) AS _gy)))"""))
    root = cells.sparkSession.range(1).select(F.lit(0).alias("_level"), F.lit(0).cast("bigint").alias("_gx"), F.lit(0).cast("bigint").alias("_gy"))
    return below.unionByName(root).join(inner, list(_KEY), "left_anti")


def cell_index(layer: DataFrame, cell: float | None = None, carry: Mapping[str, str] | Sequence[str] | None = None) -> LayerIndex:
    """The written index of a layer, carrying the ``carry`` columns.

    A leaf row ``(_level, _gx, _gy, _sure, _cands, _rows)`` lists ``CANDS`` of its polygons at
    most, by zone id; ``_sure`` is the lowest one's answer if the leaf lies wholly inside it,
    ``_rows`` the number of the leaf's rows.  Work is spread by cells.  With ``cell`` no cell
    narrower than that is made.  An index is written once for a layer's content (rows and a
    128-bit hash of them) and used again by later calls of the application.
    """
    carry = list(dict.fromkeys(carry or []))
    own = ["zone_id", "edges", "minx", "maxx", "miny", "maxy"]
    held = layer.select(*own, *[c for c in carry if c not in own])
    hashed = [F.sum(F.xxhash64(F.lit(seed), *held.columns).cast("decimal(38,0)")) for seed in (1, 2)]
    *box, polygons, most_edges, h1, h2 = held.agg(
        F.min("minx"), F.max("maxx"), F.min("miny"), F.max("maxy"), F.count("*"), F.max(F.size("edges")), *hashed).first()
    spark = layer.sparkSession
    version = (spark.sparkContext.applicationId, shared_dir(spark), tuple(held.columns), tuple(carry), polygons, h1, h2, cell)
    if version in _KNOWN:
        return _KNOWN[version]
    if box[0] is None:
        box = (0.0, 0.0, 0.0, 0.0)
    side = (max(box[1] - box[0], box[3] - box[2]) or 1.0) * (1 + 1e-6)
    square = (box[0] - side * 2.5e-7, box[2] - side * 2.5e-7, side, 1e-15 * (max(map(abs, box)) + side))
    cells = _polygon_cells(held, carry, square, cell, most_edges or 0)
    leaves = _leaves(cells)
    own = cells.withColumnsRenamed({k: f"_of{k}" for k in _KEY})
    above = leaves.select("*", F.expr("explode(sequence(0, _level))").alias("_l")).select(
        *_KEY, F.col("_l").alias("_of_level"), F.expr(_up("_gx", "_l")).alias("_of_gx"), F.expr(_up("_gy", "_l")).alias("_of_gy"))
    reached = above.join(own, [f"_of{k}" for k in _KEY]).drop(*[f"_of{k}" for k in _KEY], "_entry")
    reached = _classified(reached, *square)
    # ``o`` is the row a hit contributes, ready-made so no per-point transform is needed.
    o = F.struct(F.col("zone_id").alias("_hit_zone"), *[F.col(c).alias(f"_hit_{c}") for c in carry])
    fields = F.struct(F.col("zone_id"), (F.col("_kind") == 2).alias("full"), F.col("minx"), F.col("maxx"), F.col("miny"),
                      F.col("maxy"), F.col("_par").alias("par"), F.col("_edges").alias("edges"), o.alias("o"))
    place = Window.partitionBy(*_KEY).orderBy("zone_id")
    cands = (reached.select(*_KEY, F.floor((F.row_number().over(place) - 1) / CANDS).alias("_slot"), fields.alias("_c"))
             .groupBy(*_KEY, "_slot").agg(F.array_sort(F.collect_list("_c")).alias("_cands")))
    lowest = F.col("_cands")[0]
    cands = cands.select(*_KEY, F.when(lowest["full"], lowest["o"]).alias("_sure"), "_cands", "_slot")
    cands = cands.withColumn("_rows", F.count("*").over(Window.partitionBy(*_KEY)))
    spread = leaves.sparkSession.range(_SPREAD).select(F.lit(_OUTSIDE).alias("_level"), F.col("id").alias("_gx"),
                                                       F.lit(0).cast("bigint").alias("_gy"))
    # Leaves without a polygon, and the places of points outside, have a row with no candidates.
    every = leaves.unionByName(spread).join(cands, list(_KEY), "left").select(
        *_KEY, "_sure", F.coalesce("_cands", F.array()).alias("_cands"), F.coalesce("_rows", F.lit(1)).alias("_rows"))
    every = materialize(every)
    coarse = f"""CASE WHEN _level >= {DIRECTORY} THEN array(struct({_up('_gx', str(DIRECTORY))} AS _dx, {_up('_gy', str(DIRECTORY))} AS _dy))
        ELSE flatten(transform(sequence(shiftleft(_gx, {DIRECTORY} - _level), shiftleft(_gx + 1, {DIRECTORY} - _level) - 1), x ->
          transform(sequence(shiftleft(_gy, {DIRECTORY} - _level), shiftleft(_gy + 1, {DIRECTORY} - _level) - 1), y -> struct(x AS _dx, y AS _dy)))) END"""
    directory = materialize(every.where("_level >= 0").select("_level", F.expr(f"inline({coarse})")).groupBy("_dx", "_dy")
                            .agg(F.collect_set("_level").alias("_levels")))
    # So few polygons never overflow a leaf's list.
    rows = 1 if polygons <= CANDS else every.agg(F.max("_rows")).first()[0]
    _KNOWN[version] = LayerIndex(every, directory, square[0], square[1], side, rows)
    return _KNOWN[version]


def locate(points: DataFrame, layer: DataFrame, lon: str, lat: str, out: str = "zone_id",
           carry: Mapping[str, str] | None = None, how: str = "first",
           keep_unmatched: bool = False, cell: float | None = None,
           index: LayerIndex | None = None, spread: Sequence[str] = ()) -> DataFrame:
    """Attach the polygon containing each point.

    ``carry`` maps layer columns to output names (e.g. ``{"cx": "orig_lon"}``) so zone
    attributes ride along without a second join.  Unmatched points (outside every polygon,
    or a coordinate NULL or not a number) are dropped unless ``keep_unmatched``.  A caller
    locating several point sets in one layer passes a prebuilt ``index`` (:func:`cell_index`
    of the same layer, carrying the ``carry`` columns).  Kept points without a place in the
    square are spread by a hash of the coordinates and of the ``spread`` columns, which should
    be read anyway; no other column is needed.
    """
    if how not in ("first", "all"):
        raise ValueError("how must be 'first' or 'all'")
    carry = dict(carry or {})
    index = index or cell_index(layer, cell, carry)
    px, py = F.col(lon), F.col(lat)
    # A multiple of a power of two is exact, so a point's cells are nested over the levels.
    u, v = (px - F.lit(index.x0)) / F.lit(index.side), (py - F.lit(index.y0)) / F.lit(index.side)
    inside = present(lon) & present(lat) & (u >= 0) & (u < 1) & (v >= 0) & (v < 1)
    if not keep_unmatched:
        points = points.where(inside)
    coarse = lambda x: F.when(inside, F.floor(x * (1 << DIRECTORY)))
    # At most 4 ** DIRECTORY rows, whatever the layer.
    tagged = points.withColumns({"_dx": coarse(u), "_dy": coarse(v)}).join(
        F.broadcast(index.directory), ["_dx", "_dy"], "left").drop("_dx", "_dy")
    tagged = tagged.select("*", F.explode(F.coalesce("_levels", F.array(F.lit(_OUTSIDE)))).alias("_level")).drop("_levels")
    there, width = F.col("_level") >= 0, F.expr("shiftleft(1L, greatest(_level, 0))")
    away = F.pmod(F.xxhash64(lon, lat, *spread), F.lit(_SPREAD))
    tagged = tagged.withColumns({"_gx": F.when(there, F.floor(u * width)).otherwise(away),
                                 "_gy": F.when(there, F.floor(v * width)).otherwise(F.lit(0).cast("bigint"))})
    # A point in a "full" cell of a polygon is inside it; elsewhere the bounding box and
    # then the exact ring test decide.
    hits = F.filter("_cands", lambda z: z["full"] | (
        px.between(z["minx"], z["maxx"]) & py.between(z["miny"], z["maxy"])
        & (((crossing_count(z["edges"], px, py) + z["par"]) % 2 == 1)
           | on_ring_edge(z["edges"], px, py))))
    if how == "first":
        # Candidates are sorted by zone id: the lowest wins, and a whole cell's needs no test.
        tested = F.slice(hits, 1, 1)["o"]
        picked = F.when(F.col("_sure").isNotNull(), F.array("_sure")).otherwise(tested)
    else:
        picked = hits["o"]
    # One generator evaluates the (interpreted) ring test once per point; a projection of
    # struct fields would let the optimizer inline it into every field and the filter.
    gen = F.inline_outer(picked) if keep_unmatched else F.inline(picked)
    names = {"_hit_zone": out, **{f"_hit_{c}": o for c, o in carry.items()}}
    found = list(names)
    if index.rows == 1:
        return tagged.join(index.leaves, list(_KEY)).select(*points.columns, gen).withColumnsRenamed(names)
    # Some leaves have several rows: points there are merged by a number of their own.
    one = tagged.join(index.leaves.where("_rows = 1"), list(_KEY)).select(*points.columns, gen)
    several = (tagged.withColumn("_point", F.monotonically_increasing_id()).join(index.leaves.where("_rows > 1"), list(_KEY))
               .select(*points.columns, "_point", (F.inline_outer if keep_unmatched else F.inline)(picked)))
    if how == "first" or keep_unmatched:
        hit = F.when(F.col("_hit_zone").isNotNull(), F.struct(*found))
        best = F.array(F.min(hit)) if how == "first" else F.collect_list(hit)
        merged = several.groupBy("_point").agg(F.first(F.struct(*points.columns)).alias("_p"), best.alias("_h")).select(
            "_p.*", F.explode_outer(F.filter("_h", lambda h: h.isNotNull())).alias("_h"))
        several = merged.where("_h IS NOT NULL") if not keep_unmatched else merged
        several = several.select(*points.columns, *[F.col("_h").getField(c).alias(c) for c in found])
    else:
        several = several.drop("_point")
    return one.unionByName(several).withColumnsRenamed(names)


def occupied_zones(layer: DataFrame, points: DataFrame, ends: Sequence[tuple[str, str]],
                   cell: float | None = None) -> DataFrame:
    """Polygons that contain at least one of the given points (J9 with U6).

    ``ends`` names the (lon, lat) column pairs of ``points``, e.g. trip origins and
    destinations; each row gives one point per pair, in one pass over the table.
    """
    pairs = F.array(*[F.struct(F.col(lo).alias("_lon"), F.col(la).alias("_lat")) for lo, la in ends])
    each = points.select(F.inline(pairs))
    located = locate(each, layer, "_lon", "_lat", out="_zone", cell=cell).select(F.col("_zone").alias("zone_id")).distinct()
    return layer.join(located, "zone_id", "left_semi")


def zone_at(spark: SparkSession, lon: float, lat: float, layer: DataFrame) -> DataFrame:
    """Zone under one clicked point (J14): zero or one row ``zone_id``.

    One point needs no index: the layer is scanned once, and only polygons whose bounding box
    holds the point are tested.
    """
    x, y = F.lit(float(lon)), F.lit(float(lat))
    hit = layer.where(x.between(F.col("minx"), F.col("maxx")) & y.between(F.col("miny"), F.col("maxy"))).where(inside_ring("edges", x, y))
    return hit.agg(F.min("zone_id").alias("zone_id")).where("zone_id IS NOT NULL")


def located_in(points: DataFrame, layer: DataFrame, selected: DataFrame, lon: str, lat: str,
               out: str = "zone_id") -> DataFrame:
    """Points whose zone is one of the ``selected`` ones (column ``zone_id``), with that zone.

    Only points inside the selected zones' common bounding box are located, and only in the
    polygons that reach into it; where zones overlap the lowest id still wins.
    """
    chosen = layer.join(selected.select("zone_id").distinct(), "zone_id", "left_semi")
    x0, x1, y0, y1 = chosen.agg(F.min("minx"), F.max("maxx"), F.min("miny"), F.max("maxy")).first()
    if x0 is None:
        return points.limit(0).withColumn(out, F.lit(None).cast(layer.schema["zone_id"].dataType))
    near = layer.where((F.col("minx") <= x1) & (F.col("maxx") >= x0) & (F.col("miny") <= y1) & (F.col("maxy") >= y0))
    inside = points.where(F.col(lon).between(x0, x1) & F.col(lat).between(y0, y1))
    found = locate(inside, near, lon, lat, out=out)
    ids = selected.select(F.col("zone_id").alias("_zone")).distinct()
    return found.join(ids, F.col(out) == F.col("_zone"), "left_semi")
