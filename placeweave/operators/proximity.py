"""Points near other points, and points in regions.

Both operators cover the searched area with grid cells and turn the search into an equi-join on cell ids. Cells that lie
wholly inside the area accept their points without a test; only points in cells that the border crosses are tested.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.session import materialize, ship, small_side

EARTH_M = 6371008.8
#: Cell id = band * 2^_SHIFT + column.
_SHIFT = 30


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along the sphere."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def usable_point(lat: Column, lon: Column) -> Column:
    """Both finite, lat within ±90, not both exactly zero."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return finite(lat) & finite(lon) & lat.between(-90, 90) & ~((lat == 0) & (lon == 0))


def wrap_360(lon: Column) -> Column:
    """Longitude in [0, 360)."""
    w = F.pmod(lon, F.lit(360.0))
    return F.when(w >= 360.0, F.lit(0.0)).otherwise(w)


def _reach_deg(lat_far: Column, radius_m: float) -> Column:
    """Degrees of longitude that a disc of the radius spans at most, if no point of it is farther from the equator than
    ``lat_far``; 180 where it may hold a pole."""
    c = F.cos(F.radians(F.least(lat_far, F.lit(90.0))))
    s = math.sin(radius_m / 2 / EARTH_M)
    return F.when(c <= s, F.lit(180.0)).otherwise(F.degrees(2 * F.asin(F.least(F.lit(s) / c, F.lit(1.0)))) * (1 + 1e-9))


def _half_cover(radius_m: float, band_deg: float, cells_in: Callable[[Column], Column]) -> Column:
    """The cells that cover the half of a point's disc that it has to search: ``array<struct<cell, inside, even>>`` from the
    columns ``lat, lon, band, n, col``.

    Of its own band these are its own cell and those to the right, up to half the way round; of the bands above, those
    between the longitudes the disc reaches. A cell is ``inside`` if its farthest corner is within the radius, whatever
    point of it is meant, and left out if its nearest is not: both by bounds of the haversine formula, with a margin, so
    what is neither is a border cell and measured. ``even`` marks cells that see each other (the own one, and the one
    half the way round): their pairs count from the lesser id only."""
    limit = math.sin(min(radius_m / 2 / EARTH_M, math.pi / 2)) ** 2
    lat, lon, band = F.col("lat"), F.col("lon"), F.col("band")
    rad = lambda x: x * (math.pi / 180)

    def judged(j: int, n: Column, col: Column, even: Column) -> Column:
        low, high = (band + j) * band_deg - 90, (band + j + 1) * band_deg - 90
        turn = F.abs(F.pmod(lon - (col + 0.5) * (360.0 / n) + 180, F.lit(360.0)) - 180)  # to the cell's middle
        near_lon, far_lon = F.greatest(turn - 180.0 / n, F.lit(0.0)), F.least(turn + 180.0 / n, F.lit(180.0))
        near_lat, far_lat = F.greatest(low - lat, lat - high, F.lit(0.0)), F.greatest(lat - low, high - lat)
        most, least = F.least(F.abs(low), F.abs(high)), F.greatest(F.abs(low), F.abs(high))
        wide = F.when((low <= 0) & (high >= 0), F.lit(1.0)).otherwise(F.cos(rad(F.least(most, F.lit(90.0)))))
        narrow = F.cos(rad(F.least(least, F.lit(90.0))))
        own = F.cos(rad(lat))
        bound = lambda dlat, dlon, other: F.pow(F.sin(rad(dlat) / 2), 2) + own * other * F.pow(F.sin(rad(dlon) / 2), 2)
        inside = bound(far_lat, far_lon, wide) <= limit * (1 - 1e-9)
        outside = bound(near_lat, near_lon, narrow) > limit * (1 + 1e-9) + 1e-30
        return F.when(~outside, F.struct((F.shiftleft(band + j, _SHIFT) + col).alias("cell"), inside.alias("inside"), even.alias("even")))

    def reach(j: int) -> Column:
        low, high = (band + (0 if j == 0 else j - 1)) * band_deg - 90, (band + j + 1) * band_deg - 90
        return _reach_deg(F.greatest(F.abs(low), F.abs(high), F.abs(band * band_deg - 90)), radius_m)

    n = F.col("n")
    steps = F.least(F.ceil(reach(0) / 360 * n), F.floor(n / 2))
    parts = [F.transform(F.sequence(F.lit(0).cast("bigint"), steps.cast("bigint")), lambda k: judged(0, n, F.pmod(F.col("col") + k, n), (k == 0) | (2 * k == n)))]
    above = math.ceil(radius_m * (1 + 1e-9) / (EARTH_M * math.radians(band_deg)))

    def row(j: int) -> Column:
        m = cells_in(band + j)
        left = F.floor((lon - reach(j)) / 360 * m)
        right = F.least(F.floor((lon + reach(j)) / 360 * m), left + m - 1)
        return F.when((band + j) * band_deg < 180, F.transform(F.sequence(left.cast("bigint"), right.cast("bigint")), lambda c: judged(j, m, F.pmod(c, m), F.lit(False))))

    parts += [row(j) for j in range(1, above + 1)]
    return F.array_compact(F.flatten(F.array_compact(F.array(*parts))))


def near_pairs(points: DataFrame, radius_m: float, key: str = "uid", lat: str = "lat", lon: str = "lon", hot_share: float = 1e-3, hot_points: int = 20_000) -> DataFrame:
    """Pairs ``<key>_a < <key>_b`` of points at most ``radius_m`` apart.

    Rows with a null key or an unusable location (null, NaN, infinite, lat beyond ±90, 0/0) have no partner; of several
    usable rows of one key the greatest (lat, lon) counts. Longitude counts modulo 360, so the antimeridian and the poles are no borders. Points at equal
    places are pairs like any others; an empty table gives no pairs; other columns are ignored, whatever their names.

    The sphere is cut into bands of seven tenths of the radius, each band into cells whose diagonal is under the radius
    anywhere. A point's disc is covered by cells, as many as its latitude and its place in its own cell ask for, and only
    the half of it that has not looked at the point itself (:func:`_half_cover`): each pair is met once. Two equi-joins
    follow: the points of interior cells are accepted at once; those of border cells alone are measured.

    Cells of ``hot_share`` of all points (1,000 at least) or of ``hot_points`` are split: their points are dealt over salts, and whoever looks into
    such a cell looks into each salt."""
    band_deg = math.degrees(radius_m / EARTH_M) * 0.7
    p = points.select(F.col(key).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon0"))
    p = p.filter(F.col("id").isNotNull() & usable_point(F.col("lat"), F.col("lon0")))
    p = p.groupBy("id").agg(F.max(F.struct("lat", "lon0")).alias("at")).select("id", "at.lat", "at.lon0")

    def cells_in(band: Column) -> Column:
        low, high = band * band_deg - 90, (band + 1) * band_deg - 90
        widest = F.when((low <= 0) & (high >= 0), F.lit(1.0)).otherwise(F.cos(F.radians(F.least(F.abs(low), F.abs(high), F.lit(90.0)))))
        return F.greatest(F.ceil(F.lit(360.0 / band_deg) * widest), F.lit(1)).cast("bigint")

    # Whatever the last band holds beyond the pole is no point's.
    p = p.select("id", "lat", wrap_360(F.col("lon0")).alias("lon"), F.floor((F.col("lat") + 90) / band_deg).alias("band"))
    p = p.withColumn("n", cells_in(F.col("band")))
    p = p.withColumn("col", F.least(F.floor(F.col("lon") / 360 * F.col("n")), F.col("n") - 1))
    p = materialize(p, "points")
    own = (F.shiftleft("band", _SHIFT) + F.col("col")).alias("cell")
    home = p.select("id", "lat", "lon", own)
    looks = p.select("id", "lat", "lon", F.explode(_half_cover(radius_m, band_deg, cells_in)).alias("x")).select("id", "lat", "lon", "x.cell", "x.inside", "x.even")

    sizes = p.groupBy(own).agg(F.count("*").alias("k"))
    most = F.least(F.greatest(p.agg(F.count("*")).scalar() * hot_share, F.lit(1000)), F.lit(hot_points))
    hot = small_side(sizes.filter(F.col("k") >= most).select("cell", F.ceil(F.col("k") / most).alias("salts")), "hot-cells")
    at = ["cell"]
    if not hot.isEmpty():
        at = ["cell", "salt"]
        home = home.join(hot, "cell", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("salts")), F.lit(0))).drop("salts")
        looks = looks.join(hot, "cell", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("salts") - 1, F.lit(0)).cast("bigint")))).drop("salts")

    def met(a: DataFrame, *columns: str) -> DataFrame:
        b = home.select(F.col("id").alias("other"), *[F.col(c).alias(f"other_{c}") for c in columns], *at)
        return a.select("id", "even", *columns, *at).join(b, at).filter(~F.col("even") | (F.col("id") < F.col("other")))

    accepted = met(looks.filter("inside"))
    tested = met(looks.filter("NOT inside"), "lat", "lon").filter(haversine_m(F.col("lat"), F.col("lon"), F.col("other_lat"), F.col("other_lon")) <= radius_m)
    both = accepted.select("id", "other").unionByName(tested.select("id", "other"))
    return both.select(F.least("id", "other").alias(f"{key}_a"), F.greatest("id", "other").alias(f"{key}_b"))


def _crosses(ring: list[tuple[float, float]], x0: float, y0: float, x1: float, y1: float) -> bool:
    """Whether an edge of the ring meets the closed rectangle."""
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        if max(ax, bx) < x0 or min(ax, bx) > x1 or max(ay, by) < y0 or min(ay, by) > y1:
            continue
        t0, t1, dx, dy = 0.0, 1.0, bx - ax, by - ay
        for d, low, high, at in ((dx, x0, x1, ax), (dy, y0, y1, ay)):
            if d == 0:
                if at < low or at > high:
                    t0, t1 = 1.0, 0.0
            else:
                s, e = sorted(((low - at) / d, (high - at) / d))
                t0, t1 = max(t0, s), min(t1, e)
        if t0 <= t1:
            return True
    return False


def _holds(ring: list[tuple[float, float]], x: float, y: float) -> bool:
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
            odd = not odd
    return odd


def cover_polygon(ring: list[tuple[float, float]], max_level: int = 16, max_cells: int = 256) -> list[tuple[int, int, int, bool]]:
    """Quad-tree cells ``(level, x, y, interior)`` that cover a closed ring of (lon, lat): the coarsest border cell is
    split first, until ``max_level`` or ``max_cells`` is reached, so large regions get large cells and small ones small."""
    todo, done = [(0, 0, 0)], []
    while todo:
        level, i, j = todo.pop(0)
        w, h = 360 / 2**level, 180 / 2**level
        x0, y0 = -180 + i * w, -90 + j * h
        if not _crosses(ring, x0, y0, x0 + w, y0 + h):
            if _holds(ring, x0 + w / 2, y0 + h / 2):
                done.append((level, i, j, True))
        elif level >= max_level or len(todo) + len(done) >= max_cells:
            done.append((level, i, j, False))
        else:
            todo += [(level + 1, 2 * i + di, 2 * j + dj) for di in (0, 1) for dj in (0, 1)]
    return done


def points_in_regions(points: DataFrame, regions: DataFrame, key: str = "uid", lat: str = "lat", lon: str = "lon", region: str = "region", ring: str = "ring", max_level: int = 16, max_cells: int = 256) -> DataFrame:
    """``(key, region)`` for each point and each region that contains it.

    ``regions`` has ``ring``: an array of [lon, lat] vertices within ±180/±90, closed or not, no edge over the antimeridian;
    null rings and rings of fewer than three vertices contain nothing. A point on a border belongs to the side the even-odd
    rule gives. Unusable points belong nowhere. Each region is covered adaptively on the executors; a point is joined at
    each level that any cover uses, interior matches count at once, border matches take the even-odd test."""

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, vertices in zip(b["region"], b["ring"]):
                at = [(float(v[0]), float(v[1])) for v in (vertices if vertices is not None else [])]
                if len(at) < 3:
                    continue
                if at[0] != at[-1]:
                    at.append(at[0])
                flat = [c for v in at for c in v]
                rows += [(name, level, i, j, inside, None if inside else flat) for level, i, j, inside in cover_polygon(at, max_level, max_cells)]
            yield pd.DataFrame(rows, columns=["region", "level", "i", "j", "inside", "flat"])

    ship(points.sparkSession)
    cells = regions.select(F.col(region).alias("region"), F.col(ring).alias("ring")).mapInPandas(cover, f"region {regions.schema[region].dataType.simpleString()}, level int, i bigint, j bigint, inside boolean, flat array<double>")
    cells = materialize(cells, "region-cells")
    levels = sorted(r[0] for r in cells.select("level").distinct().collect())  # at most max_level + 1
    if not levels:
        return points.select(F.col(key), F.lit(None).cast(regions.schema[region].dataType).alias("region")).limit(0)
    p = points.select(F.col(key).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon0")).filter(F.col("id").isNotNull() & usable_point(F.col("lat"), F.col("lon0")))
    turned = wrap_360(F.col("lon0") + 180) - 180
    # A point appears at the levels that some cover uses, not at all of them.
    p = p.select("id", "lat", turned.alias("lon"), F.explode(F.array(*[F.lit(x) for x in levels])).alias("level"))
    side = F.pow(F.lit(2.0), F.col("level"))
    at = lambda c, low, width: F.least(F.floor((c - low) / width * side), side.cast("bigint") - 1)
    p = p.select("id", "lat", "lon", "level", at(F.col("lon"), -180, 360).alias("i"), at(F.col("lat"), -90, 180).alias("j"))
    # Interior cells accept by the join alone, and carry no ring; adaptive execution splits the points of a hot cell.
    inner = small_side(cells.filter("inside").select("level", "i", "j", "region"), "region-interiors")
    accepted = p.join(inner, ["level", "i", "j"]).select("id", "region")
    border = cells.filter("NOT inside").select("level", "i", "j", "region", "flat")
    met = p.join(border, ["level", "i", "j"])
    n = (F.size("flat") / 2).cast("int")
    v = lambda k: F.element_at("flat", k)
    odd = F.aggregate(
        F.sequence(F.lit(0), n - 2),
        F.lit(False),
        lambda acc, k: acc
        != (((v(2 * k + 2) > F.col("lat")) != (v(2 * k + 4) > F.col("lat"))) & (F.col("lon") < v(2 * k + 1) + (F.col("lat") - v(2 * k + 2)) / F.coalesce(F.nullif(v(2 * k + 4) - v(2 * k + 2), F.lit(0.0)), F.lit(1.0)) * (v(2 * k + 3) - v(2 * k + 1)))),
    )
    # Covers do not overlap, so a point meets a region once; repeated rows of a point or of a region are made one.
    return accepted.unionByName(met.filter(odd).select("id", "region")).select(F.col("id").alias(key), F.col("region")).distinct()
