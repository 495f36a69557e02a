"""Session settings this package relies on at scale."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Re-planning at run time: joins switch to broadcast only when the measured
#: size of a side allows it, partitions that hold a hot key are split, and
#: small shuffle partitions are merged.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Add the settings above to a session builder."""
    for key, value in ADAPTIVE.items():
        builder = builder.config(key, value)
    return builder
