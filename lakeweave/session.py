"""Session settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC so that dates don't depend on the machine; ANSI so that silent overflow can't happen; AQE for skew and coalescing.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(name: str = "lakeweave", **settings: str) -> SparkSession:
    """A session with the engine's settings; ``settings`` add to or override them."""
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
