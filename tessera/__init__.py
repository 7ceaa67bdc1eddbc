"""Tessera: search, ranking, time-series, sketch and text analytics as Spark DataFrame transformations."""
