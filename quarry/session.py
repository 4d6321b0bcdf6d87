"""SparkSession factory with the settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings every Quarry session carries; cluster sizing stays with the deployment.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.speculation": "false",
}


def build_session(master: str = "local[*]", app: str = "quarry", **extra: str) -> SparkSession:
    """A session on `master`; `extra` holds further settings, dots written as `__`."""
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in {**CONF, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
