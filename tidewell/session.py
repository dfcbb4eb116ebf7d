"""Session settings that the results rely on."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])
#: Days are UTC days, and of repeated JSON keys the last counts.
REQUIRED = {"spark.sql.session.timeZone": "UTC", "spark.sql.variant.allowDuplicateKeys": "true"}


def importable(spark: SparkSession) -> SparkSession:
    """Lets the session's Python workers import this package."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and the executors share: spark.checkpoint.dir. Only a local session gets a folder of its own."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir", "") or sc.getCheckpointDir():
        return found
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all hosts share")
    return tempfile.mkdtemp(prefix="tidewell-")


def configured(spark: SparkSession) -> SparkSession:
    for k, v in REQUIRED.items():
        spark.conf.set(k, v)
    return importable(spark)
