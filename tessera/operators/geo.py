"""Points as 52-bit interleaved cells, distances and radius searches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bounds of the cell grid, bits a coordinate, the two earth radii in metres, and the hash alphabet.
LAT_MIN, LAT_MAX = -85.05112878, 85.05112878
LON_MIN, LON_MAX = -180.0, 180.0
STEPS = 26
RADIUS = 6372797.560856
SEARCH_RADIUS = 6371000.0
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
UNITS = {"m": 1.0, "km": 1000.0, "mi": 1609.34, "ft": 0.3048}


def _spread(x: Column) -> Column:
    """Bits of a 26-bit number moved to even places."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def _gather(x: Column) -> Column:
    x = x.bitwiseAND(F.lit(0x5555555555555555))
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = x.bitwiseOR(F.shiftright(x, shift)).bitwiseAND(F.lit(mask))
    return x


def encode(lat: Column, lon: Column) -> Column:
    """Interleaved cell of a point, longitude in the even bits; null outside the grid."""
    cell = lambda x, lo, hi: F.floor((x - lo) / (hi - lo) * (1 << STEPS)).cast("long")
    ok = lat.between(LAT_MIN, LAT_MAX) & lon.between(LON_MIN, LON_MAX)
    both = _spread(cell(lon, LON_MIN, LON_MAX)).bitwiseOR(F.shiftleft(_spread(cell(lat, LAT_MIN, LAT_MAX)), 1))
    return F.when(ok, both)


def decode(cell: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a cell's centre."""
    centre = lambda i, lo, hi: lo + (i + 0.5) / (1 << STEPS) * (hi - lo)
    return centre(_gather(F.shiftright(cell, 1)), LAT_MIN, LAT_MAX), centre(_gather(cell), LON_MIN, LON_MAX)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = RADIUS) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(a))


def search(points: DataFrame, lat: float, lon: float, distance: float, unit: str = "m", count: int | None = None, radius: float = RADIUS) -> DataFrame:
    """points (lat, lon, …) within a distance, with dist in the unit, nearest first.

    A latitude band is tested before the distance, so it can reach the scan.
    """
    metres = distance * UNITS[unit]
    band = metres / radius * 57.29577951308232 * 1.0001
    near = points.where(F.col("lat").between(lat - band, lat + band))
    dist = haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"), radius)
    found = near.withColumn("dist", dist / UNITS[unit]).where(F.col("dist") <= distance)
    return found.orderBy("dist", "member").limit(count) if count else found


def _unit(lat: Column, lon: Column) -> list[Column]:
    """The point on the unit sphere."""
    return [F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))]


def _band_facts(band: Column, height: float) -> tuple[Column, Column, Column, Column]:
    """A latitude band's ends, the least cosine in it, and how many cells of about its height go round it."""
    low, high = band * height, (band + 1) * height
    cosine = F.greatest(F.cos(F.least(F.greatest(F.abs(low), F.abs(high)), F.lit(math.pi / 2))), F.lit(0.0))
    return low, high, cosine, F.greatest(F.floor(cosine * (2 * math.pi / height)), F.lit(1))


def pairs_within(left: DataFrame, right: DataFrame, metres: float, radius: float = RADIUS) -> DataFrame:
    """Pairs (a, b, dist) of two point sets within a distance, by an equi-join on cells of half that height and width.

    A right point names all cells of a band that the distance can reach from it, so each pair meets once. Chords of the
    unit sphere settle nearly all pairs; those too close to the limit to tell are settled by haversine().
    """
    angle = min(metres / radius + 1e-9, math.pi)
    height = angle / 2
    chord = 2 * math.sin(min(metres / radius, math.pi) / 2)
    sure, open_ = max(chord - 1e-12, 0.0) ** 2, (chord + 1e-12) ** 2
    x, y, z = (F.col(c) for c in ("x", "y", "z"))
    phi, lam = F.atan2(z, F.sqrt(x * x + y * y)), F.atan2(y, x) + math.pi

    def placed(points: DataFrame) -> DataFrame:
        ux, uy, uz = _unit(F.col("lat"), F.col("lon"))
        rows = points.where("lat is not null and lon is not null").select("member", "lat", "lon", ux.alias("x"), uy.alias("y"), uz.alias("z"))
        return rows.select("*", phi.alias("phi"), lam.alias("lam")).where("not isnan(phi) and not isnan(lam)")

    def named(points: DataFrame, s: str) -> list[Column]:
        return [F.col("member").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("lat", "lon", "x", "y", "z")]]

    a = placed(left).withColumn("band", F.floor(F.col("phi") / height))
    round_a = _band_facts(F.col("band"), height)[3]
    a = a.select(*named(a, "a"), "band", F.floor(F.col("lam") / (2 * math.pi) * round_a).alias("at")).withColumn("at", F.pmod("at", round_a))

    # few bytes make many pairs: the points are dealt to all cores, however small their file is
    b = placed(right.repartition(4 * right.sparkSession.sparkContext.defaultParallelism))
    b = b.withColumn("band", F.explode(F.sequence(F.floor((F.col("phi") - angle) / height), F.floor((F.col("phi") + angle) / height))))
    low, high, cosine, cells = _band_facts(F.col("band"), height)
    gap = F.greatest(low - F.col("phi"), F.col("phi") - high, F.lit(0.0))
    # haversine solved for the longitudes, at the band's nearest latitude and least cosine
    reach = (math.sin(angle / 2) ** 2 - F.pow(F.sin(gap / 2), 2)) / (cosine * F.cos("phi"))
    reach = F.when(cosine * F.cos("phi") <= 1e-15, 1.0).otherwise(F.least(F.greatest(reach, F.lit(0.0)), F.lit(1.0)))
    b = b.select("*", cells.alias("cells"), (2 * F.asin(F.sqrt(reach)) + 1e-9).alias("dl"))
    first, last = (F.floor((F.col("lam") + d) / (2 * math.pi) * F.col("cells")) for d in (-F.col("dl"), F.col("dl")))
    last = F.least(last, first + F.col("cells") - 1)
    b = b.select(*named(b, "b"), "band", "cells", F.explode(F.sequence(first, last)).alias("at")).withColumn("at", F.pmod("at", "cells")).drop("cells")

    apart = sum((F.col(f"{c}_a") - F.col(f"{c}_b")) * (F.col(f"{c}_a") - F.col(f"{c}_b")) for c in ("x", "y", "z"))
    dist = haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"), radius)
    near = (apart <= open_) & ((apart < sure) | (dist <= metres))
    return a.join(b, ["band", "at"]).where(near).select("a", "b", dist.alias("dist"))


def geohash(lat: Column, lon: Column, size: int = 11) -> Column:
    """Base-32 text of a point in the usual world-wide grid."""
    bits = 5 * size
    lon_bits, lat_bits = (bits + 1) // 2, bits // 2
    x = F.floor((lon + 180) / 360 * (1 << lon_bits)).cast("long")
    y = F.floor((lat + 90) / 180 * (1 << lat_bits)).cast("long")
    text = []
    for k in range(size):
        digit = F.lit(0).cast("long")
        for j in range(5):
            at = k * 5 + j  # even places are longitude
            source, left = (x, lon_bits - 1 - at // 2) if at % 2 == 0 else (y, lat_bits - 1 - at // 2)
            digit = digit * 2 + F.shiftright(source, left).bitwiseAND(1)
        text.append(F.substring(F.lit(ALPHABET), digit.cast("int") + 1, 1))
    return F.concat(*text)


def search_store(points: DataFrame, target: str, lat: float, lon: float, distance: float, unit: str = "m", count: int | None = None) -> DataFrame:
    """search() as a ranked set (key, member, score) whose scores are the distances."""
    return search(points, lat, lon, distance, unit, count).select(F.lit(target).alias("key"), "member", F.col("dist").alias("score"))
