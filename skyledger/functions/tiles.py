"""Tile and ground-scale arithmetic on columns: the geographic (CRS84) matrix with 256-pixel tiles,
2^(zoom+1) columns and 2^zoom rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TILE = 256.0  # fixed value: pixels per tile side
TILES_PER_BLOCK = 4  # fixed value: a block image spans four tiles each way

# Fixed value: block image names.
BLOCK_NAME = r"(?i)^block_z(\d+)_br(\d+)_bc(\d+)_r(\d+)_c(\d+)\.png$"


def is_block(name: Column) -> Column:
    return name.rlike(BLOCK_NAME)


def block_fields(name: Column) -> Column:
    """zoom, block_row, block_col, tile_row, tile_col of a name that is known to be a block name."""
    numbers = F.split(name, r"\D+")
    fields = ("zoom", "block_row", "block_col", "tile_row", "tile_col")
    return F.struct(*[F.get(numbers, F.lit(i + 1)).try_cast("int").alias(f) for i, f in enumerate(fields)])


def parse_block(name: Column) -> Column:
    """The same for any name; null for names of another form."""
    return F.when(is_block(name), block_fields(name))


def geo_cell(block_row: Column, block_col: Column, size: int = 32) -> Column:
    """Coarse cell of a block."""
    index = lambda c: F.floor(c / size).cast("string")
    return F.concat(index(block_row), F.lit(":"), index(block_col))


def longitude(zoom: Column, col: Column) -> Column:
    return col / F.pow(F.lit(2.0), zoom + 1) * 360.0 - 180.0


def latitude(zoom: Column, row: Column) -> Column:
    return F.lit(90.0) - row / F.pow(F.lit(2.0), zoom) * 180.0


def pixel_to_lonlat(zoom: Column, row: Column, col: Column, x: Column, y: Column):
    """Longitude and latitude of a pixel inside the block that starts at tile (row, col)."""
    return longitude(zoom, col + x / TILE), latitude(zoom, row + y / TILE)


def lonlat_to_pixel(zoom: Column, row: Column, col: Column, lon: Column, lat: Column, bounded: bool = True):
    """The inverse; null outside the valid range of degrees. With bounded=False the grid goes on beyond it, as pixel_to_lonlat()'s does for
    blocks past its last row or column."""
    x = ((lon + 180.0) / 360.0 * F.pow(F.lit(2.0), zoom + 1) - col) * TILE
    y = ((F.lit(90.0) - lat) / 180.0 * F.pow(F.lit(2.0), zoom) - row) * TILE
    if not bounded:
        return x, y
    ok = lon.between(-180, 180) & lat.between(-90, 90)
    return F.when(ok, x), F.when(ok, y)


def block_bounds(block: Column, span: int = TILES_PER_BLOCK):
    """West, south, east, north of a parsed block."""
    z, r, c = block["zoom"], block["tile_row"], block["tile_col"]
    return longitude(z, c), latitude(z, r + span), longitude(z, c + span), latitude(z, r)


def _gsd_checked(value: Column, status: Column) -> Column:
    return (
        F.when(~status.isin("observed", "derived"), F.raise_error(F.lit("GSD is unknown")))
        .when(value < 0, F.raise_error(F.lit("pixel measurements must be non-negative")))
    )


def pixels_to_metres(dx: Column, dy: Column, gsd_x: Column, gsd_y: Column, status: Column):
    """Each axis by its own ground scale; unknown scale and negative lengths are errors."""
    x = _gsd_checked(dx, status).otherwise(dx * gsd_x)
    y = _gsd_checked(dy, status).otherwise(dy * gsd_y)
    return x, y


def pixel_area_to_m2(area: Column, gsd_x: Column, gsd_y: Column, status: Column) -> Column:
    return _gsd_checked(area, status).otherwise(area * gsd_x * gsd_y)


def dms_to_degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Degrees, minutes, seconds and a hemisphere letter as signed degrees with seven digits."""
    value = F.round(d + m / 60.0 + s / 3600.0, 7)
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)


def signed_altitude(altitude: Column, ref: Column) -> Column:
    """Reference 1 means below sea level."""
    return F.when(F.coalesce(ref, F.lit(0)) == 1, -altitude).otherwise(altitude)


def exif_time(text: Column) -> Column:
    """The first 14 digits of a camera time as YYYY-MM-DDTHH:MM:SS, or null when there are fewer."""
    digits = F.regexp_replace(text, r"\D", "")
    part = lambda start, n: F.substring(digits, start, n)
    day = F.concat_ws("-", part(1, 4), part(5, 2), part(7, 2))
    return F.when(F.length(digits) >= 14, F.concat(day, F.lit("T"), F.concat_ws(":", part(9, 2), part(11, 2), part(13, 2))))


def spatial_state(lon: Column, lat: Column) -> Column:
    """georeferenced or independent_scene; one coordinate without the other is an error."""
    return (
        F.when(lon.isNull() != lat.isNull(), F.raise_error(F.lit("longitude and latitude must be given together")))
        .when(lon.isNotNull(), "georeferenced")
        .otherwise("independent_scene")
    )
