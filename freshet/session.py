"""Settings that suit these jobs, for a session builder."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Every Column call of Python otherwise looks up and sends its place in the source: half the time that a large plan takes to build.
SETTINGS = {
    "spark.python.sql.dataFrameDebugging.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.showConsoleProgress": "false",
}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    """The builder with SETTINGS; what is set on it afterwards wins."""
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    return builder
