"""Pairs within a distance against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import geo

RNG = random.Random(3)
POINTS = [(i, RNG.uniform(-90, 90), RNG.uniform(-180, 180)) for i in range(300)]
POINTS += [(i, lat, lon) for i, (lat, lon) in enumerate(((90.0, 0.0), (90.0, 77.0), (-90.0, 5.0), (89.0, 10.0), (89.0, -170.0), (0.0, 180.0), (0.0, -180.0), (0.0, 179.9), (1.0, -179.5), (0.0, 0.0), (0.0, 0.0)), 300)]
POINTS += [(400 + i, 60 + RNG.uniform(-3, 3), 179 + RNG.uniform(-4, 4)) for i in range(60)] + [(500, None, 1.0), (501, 1.0, float("nan"))]


@pytest.mark.parametrize("metres", [0, 1, 300_000, 6_000_000, 19_900_000, 21_000_000])
def test_pairs_within(spark, metres):
    points = spark.createDataFrame(POINTS, "member int, lat double, lon double").repartition(3)
    found = geo.pairs_within(points, points, metres).collect()
    side = lambda s: points.select(F.col("member").alias(s), F.col("lat").alias(f"lat_{s}"), F.col("lon").alias(f"lon_{s}"))
    dist = geo.haversine(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    want = side("a").crossJoin(side("b")).where((dist <= metres) & ~F.isnan(dist)).select("a", "b").collect()
    assert sorted((r.a, r.b) for r in found) == sorted((r.a, r.b) for r in want)


def test_candidates_keep_to_cells(spark):
    """Points on one latitude: only those near in longitude meet."""
    rows = spark.range(3600).select(F.col("id").alias("member"), F.lit(10.0).alias("lat"), (F.col("id") / 10.0 - 180).alias("lon"))
    plan = geo.pairs_within(rows, rows, 300_000)._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    assert "Join Inner" in text and "(band#" in text and "(at#" in text
