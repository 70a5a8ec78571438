"""Sessions with the settings that the languages' semantics rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.ansi.enabled": "false",  # integers wrap, division by zero is absent
    "spark.sql.session.timeZone": "UTC",  # every instant is UTC
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}
_sessions: dict[str, SparkSession] = {}


def engine_session(spark: SparkSession) -> SparkSession:
    """A session of the same application with these settings; the caller's own stays as it is."""
    key = f"{spark.sparkContext.applicationId}/{id(spark)}"
    if key not in _sessions:
        own = spark.newSession()
        for name, value in SETTINGS.items():
            own.conf.set(name, value)
        for name in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes"):
            if (value := spark.conf.get(name, None)) is not None:
                own.conf.set(name, value)
        _sessions[key] = own
    own = _sessions[key]
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    return own
