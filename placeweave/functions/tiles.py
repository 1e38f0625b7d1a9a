"""Geohash tiles as integers: a tile is (x, y) at a precision of p letters, 5p bits, longitude first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LETTERS = "0123456789bcdefghjkmnpqrstuvwxyz"


def bits(precision: int) -> tuple[int, int]:
    """Bits of x and of y."""
    return (5 * precision + 1) // 2, 5 * precision // 2


def tile_xy(lat: Column, lon: Column, precision: int) -> tuple[Column, Column]:
    xb, yb = bits(precision)
    cut = lambda c, n: F.least(F.greatest(F.floor(c), F.lit(0)), F.lit(2**n - 1))
    return cut((lon + 180) / 360 * 2**xb, xb), cut((lat + 90) / 180 * 2**yb, yb)


def tile_id(x: Column, y: Column, precision: int) -> Column:
    """x and y in one long."""
    return x * 2 ** bits(precision)[1] + y


def tile(lat: Column, lon: Column, precision: int) -> Column:
    return tile_id(*tile_xy(lat, lon, precision), precision)


def around(tile: Column, precision: int) -> Column:
    """A tile and the up to eight around it: x wraps, rows beyond a pole do not exist."""
    xb, yb = bits(precision)
    x, y = F.shiftright(tile, yb), F.pmod(tile, F.lit(2**yb))
    near = [F.when((y + dy).between(0, 2**yb - 1), tile_id(F.pmod(x + dx, F.lit(2**xb)), y + dy, precision)) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    return F.array_distinct(F.array_compact(F.array(*near)))


def tile_and_neighbors(lat: Column, lon: Column, precision: int) -> Column:
    """The tiles of :func:`around` for a location."""
    return around(tile(lat, lon, precision), precision)


def coarse_cells(tile: Column, precision: int, around: bool) -> Column:
    """The cell of four by four tiles that a tile lies in, as an array; ``around``: those of all tiles of :func:`around`, four at most."""
    xb, yb = bits(precision)
    x, y = F.shiftright(tile, yb), F.pmod(tile, F.lit(2**yb))
    cell = lambda x, y: F.shiftright(x, 2) * 2**yb + F.shiftright(y, 2)
    if not around:
        return F.when(tile.isNotNull(), F.array(cell(x, y)))
    corners = [cell(F.pmod(x + dx, F.lit(2**xb)), F.least(F.greatest(y + dy, F.lit(0)), F.lit(2**yb - 1))) for dx in (-1, 1) for dy in (-1, 1)]
    return F.when(tile.isNotNull(), F.array_distinct(F.array(*corners)))


def near_tiles(a: Column, b: Column, precision: int) -> Column:
    """Whether one tile is among those :func:`around` the other."""
    xb, yb = bits(precision)
    dx = F.pmod(F.shiftright(a, yb) - F.shiftright(b, yb) + 1, F.lit(2**xb))
    return (dx <= 2) & (F.abs(F.pmod(a, F.lit(2**yb)) - F.pmod(b, F.lit(2**yb))) <= 1)


def geohash(lat: Column, lon: Column, precision: int) -> Column:
    """The usual text of the tile."""
    xb, yb = bits(precision)
    x, y = tile_xy(lat, lon, precision)
    letters = []
    for i in range(precision):
        value = F.lit(0)
        for k in range(5 * i, 5 * i + 5):
            source, place = (x, xb - 1 - k // 2) if k % 2 == 0 else (y, yb - 1 - k // 2)
            value = value * 2 + F.shiftright(source, place).bitwiseAND(F.lit(1))
        letters.append(F.substring(F.lit(_LETTERS), 1, 32).substr((value + 1).cast("int"), F.lit(1)))
    return F.concat(*letters)
