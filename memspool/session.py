"""Session settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; model calls are never speculated."""
    builder = SparkSession.builder.appName("memspool")
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.speculation": "false",
        # a block's lines of one length are limited below the shuffle for budgets up to this
        "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in {**conf, **settings}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
