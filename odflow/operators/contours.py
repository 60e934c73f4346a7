"""Density surfaces with an estimated bandwidth, and their levels as closed rings.

The points are read once.  Everything after the cell counts works on a lattice of ``per``
cells a bandwidth, so its size follows the extent in bandwidths and not the points: the
kernel is applied along one axis and then along the other (2 (2r + 1) copies of a cell, not
(2r + 1)^2), a level's crossings are found in each square of four lattice nodes by itself,
and they are linked to rings by doubling jumps, in as many rounds as the longest ring has
binary digits.  Four scalars reach the driver: the number of points, the two bandwidths and
the highest density.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflow.operators._broadcast import materialize
from odflow.operators.filters import has_point
from odflow.operators.quantile import exact_quantiles


def bandwidths(points: DataFrame, lon: str, lat: str) -> DataFrame:
    """One row ``n, hx, hy``: the normal-reference bandwidth of each axis.

    It is 1.06 times the smaller of the standard deviation and the interquartile range over
    1.34 (the deviation alone where the middle half has no spread), times n to the power -1/5,
    rounded to 9 decimals so that every order of summation gives the same lattice.  Points
    with a missing or not-a-number coordinate do not count.  An axis without spread has 0,
    fewer than two points have null.
    """
    axes = has_point(points, lon, lat).select(F.inline(F.array(
        F.struct(F.lit("x").alias("axis"), F.col(lon).cast("double").alias("v")),
        F.struct(F.lit("y").alias("axis"), F.col(lat).cast("double").alias("v")))))
    m = axes.groupBy("axis").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd"))
    m = m.join(exact_quantiles(axes, "v", 0.25, ["axis"], "q1"), "axis").join(exact_quantiles(axes, "v", 0.75, ["axis"], "q3"), "axis")
    iqr = (F.col("q3") - F.col("q1")) / F.lit(1.34)
    h = F.round(F.lit(1.06) * F.when(iqr > 0, F.least("sd", iqr)).otherwise(F.col("sd")) * F.pow(F.col("n"), F.lit(-0.2)), 9)
    return m.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.max(F.when(F.col("axis") == "x", h)).alias("hx"),
                 F.max(F.when(F.col("axis") == "y", h)).alias("hy"))


def _along(cells: DataFrame, axis: str, other: str, per: int, reach: int) -> DataFrame:
    kernel = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(math.exp(-d * d / (2.0 * per * per))).alias("k"))
                       for d in range(-reach * per, reach * per + 1)])
    spread = cells.select(axis, other, "v", F.explode(kernel).alias("_k"))
    return spread.select((F.col(axis) + F.col("_k.d")).alias(axis), other, (F.col("v") * F.col("_k.k")).alias("v")) \
        .groupBy(axis, other).agg(F.sum("v").alias("v"))


def density_surface(points: DataFrame, lon: str, lat: str, per: int = 2, reach: int = 3) -> tuple[DataFrame, float, float]:
    """``gx, gy, density`` on the lattice, and the lattice's two cell sizes.

    A point counts at the middle of its cell; the kernel is Gaussian, cut ``reach`` bandwidths
    away along each axis.  The density is one of probability (its sum times the area of a cell
    is close to one).  Nodes the kernel does not reach have no row.  Without points, or without
    spread on an axis, there are no rows and the sizes are 0.
    """
    here = materialize(has_point(points, lon, lat).select(F.col(lon).cast("double").alias("x"), F.col(lat).cast("double").alias("y")))
    b = bandwidths(here, "x", "y").first()
    if not b.hx or not b.hy:
        return here.sparkSession.createDataFrame([], "gx bigint, gy bigint, density double"), 0.0, 0.0
    cx, cy = b.hx / per, b.hy / per
    counts = here.groupBy(F.floor(F.col("x") / F.lit(cx)).alias("gx"), F.floor(F.col("y") / F.lit(cy)).alias("gy")) \
        .agg(F.count(F.lit(1)).cast("double").alias("v"))
    both = _along(_along(counts, "gx", "gy", per, reach), "gy", "gx", per, reach)
    return both.select("gx", "gy", (F.col("v") / F.lit(b.n * 2 * math.pi * b.hx * b.hy)).alias("density")), cx, cy


def _crossings(nodes: DataFrame, step: float, bins: int, cx: float, cy: float) -> DataFrame:
    """Directed pieces of every level: ``bin, key, next, lon, lat``.

    A key is a lattice edge that the level crosses.  Pieces keep the denser side on their left,
    so each crossing starts one piece and ends one: a square's corners are walked
    counter-clockwise, a piece starts on the side that leaves the level and ends on one that
    enters it.  Where two corners lie opposite each other above the level, the mean of the
    four says whether they are connected.
    """
    corners = [(0, 0), (1, 0), (1, 1), (0, 1)]
    each = F.array(*[F.struct(F.lit(i).alias("i"), (F.col("gx") - ox).alias("gx"), (F.col("gy") - oy).alias("gy"), "density")
                     for i, (ox, oy) in enumerate(corners)])
    squares = nodes.select(F.inline(each)).groupBy("gx", "gy").agg(
        *[F.coalesce(F.max(F.when(F.col("i") == i, F.col("density"))), F.lit(0.0)).alias(f"v{i}") for i in range(4)])
    v = [F.col(f"v{i}") for i in range(4)]
    lo, hi = F.least(*v), F.greatest(*v)
    first = F.greatest(F.floor(lo / F.lit(step)), F.lit(1).cast("bigint"))
    last = F.least(F.ceil(hi / F.lit(step)), F.lit(bins - 1).cast("bigint"))
    held = F.filter(F.sequence(first, last), lambda b: (lo < b * F.lit(step)) & (hi >= b * F.lit(step)))
    lev = squares.where(first <= last).withColumn("bin", F.explode(held)).withColumn("level", F.col("bin") * F.lit(step))

    def side(a: Column, b: Column, dx: int, dy: int, upright: bool) -> Column:
        t = (F.col("level") - a) / F.when(a != b, b - a)
        x, y = F.col("gx") + F.lit(dx), F.col("gy") + F.lit(dy)
        key = x * F.lit(1 << 32) + F.pmod(y, F.lit(1 << 31)) * 2 + F.lit(int(upright))
        px, py = x + F.lit(0.5), y + F.lit(0.5)
        return F.named_struct(F.lit("key"), key, F.lit("lon"), (px if upright else px + t) * F.lit(cx),
                              F.lit("lat"), (py + t if upright else py) * F.lit(cy))

    sides = F.array(side(v[0], v[1], 0, 0, False), side(v[1], v[2], 1, 0, True), side(v[3], v[2], 0, 1, False), side(v[0], v[3], 0, 0, True))
    inside = [c >= F.col("level") for c in v]
    leaves = [inside[i] & ~inside[(i + 1) % 4] for i in range(4)]
    enters = [~inside[i] & inside[(i + 1) % 4] for i in range(4)]
    opposite = (inside[0] == inside[2]) & (inside[1] == inside[3])
    joined = sum(v[1:], v[0]) / 4 >= F.col("level")
    to = F.coalesce(*[F.when(e, F.lit(i)) for i, e in enumerate(enters)])
    pieces = F.filter(F.array(*[F.when(out, F.named_struct(
        F.lit("a"), F.lit(i), F.lit("b"), F.when(~opposite, to).when(joined, F.lit((i + 1) % 4)).otherwise(F.lit((i + 3) % 4))))
        for i, out in enumerate(leaves)]), lambda p: p.isNotNull())
    cut = lev.select(F.col("bin").cast("int").alias("bin"), sides.alias("s"), F.explode(pieces).alias("p"))
    a, b = F.col("s")[F.col("p.a")], F.col("s")[F.col("p.b")]
    return cut.select("bin", a["key"].alias("key"), b["key"].alias("next"), a["lon"].alias("lon"), a["lat"].alias("lat"))


def _link(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``ring`` (the smallest key on it) and ``vertex`` (0 at that key).

    After a round with jumps of k pieces, a row knows the smallest key among its next 2k and how
    far it is.  When a round changes nothing, the windows cover every ring.
    """
    at = materialize(pieces.select("bin", "key", "next", F.col("key").alias("least"), F.lit(0).cast("bigint").alias("off")))
    jump, changed = 1, True
    while changed:
        far = at.select(F.col("bin").alias("_b"), F.col("key").alias("_k"), F.col("next").alias("_n"), F.col("least").alias("_l"), F.col("off").alias("_o"))
        less = F.col("_l") < F.col("least")
        at = materialize(at.join(far, (F.col("bin") == F.col("_b")) & (F.col("next") == F.col("_k"))).select(
            "bin", "key", F.col("_n").alias("next"), F.least("least", "_l").alias("least"),
            F.when(less, F.col("_o") + F.lit(jump)).otherwise(F.col("off")).alias("off"), less.alias("changed")))
        changed = not at.where("changed").isEmpty()
        jump *= 2
    size = at.groupBy("bin", "least").agg(F.count(F.lit(1)).alias("size"))
    number = at.join(size, ["bin", "least"]).select(
        "bin", "key", F.col("least").alias("ring"), F.pmod(F.col("size") - F.col("off"), F.col("size")).alias("vertex"), "size")
    return pieces.join(number, ["bin", "key"])


def density_levels(points: DataFrame, lon: str, lat: str, bins: int = 16, per: int = 2, reach: int = 3) -> DataFrame:
    """Outlines of the density's levels as vertices of closed rings.

    The range from 0 to the highest density is divided into ``bins`` equal parts; bin b (1 to
    ``bins`` - 1) is outlined where the density reaches b / bins of the highest.  Rows:
    ``bin, level, ring, vertex, size, lon, lat``.  Vertices count from 0 along the ring, ``size``
    is their number, and the last is followed by the first.  Rings keep the denser side on
    their left: counter-clockwise around a peak, clockwise around a hollow.  ``ring`` is a
    lattice key, unique within its bin for grids up to 2^30 cells from zero.  Without points or
    spread (see ``density_surface``) there are no rows.
    """
    surface, cx, cy = density_surface(points, lon, lat, per, reach)
    nodes = materialize(surface)
    top = nodes.agg(F.max("density")).first()[0]
    if top is None:
        return points.sparkSession.createDataFrame([], "bin int, level double, ring bigint, vertex bigint, size bigint, lon double, lat double")
    step = top / bins
    pieces = materialize(_crossings(nodes, step, bins, cx, cy))
    return _link(pieces).select("bin", (F.col("bin") * F.lit(step)).alias("level"), "ring", "vertex", "size", "lon", "lat")
