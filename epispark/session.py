"""Session settings and the shared folder for materialised data."""

from __future__ import annotations

import os
import tempfile
import uuid
from typing import Optional

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_LOCAL_FALLBACK: dict = {}

# The recodes are wide expression trees. A fused stage whose generated method
# is above HotSpot's 8,000-bytecode JIT limit would run interpreted; below
# this limit Spark evaluates such a stage expression by expression instead.
HUGE_METHOD_LIMIT = "8000"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "epispark",
                  extra: Optional[dict] = None) -> SparkSession:
    """A session with the settings this library is tested under: AQE on,
    UTC session zone, UI off, no generated methods that the JIT refuses."""
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.sql.codegen.hugeMethodLimit", HUGE_METHOD_LIMIT))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A deployment sets it to a folder that driver and executors share. Only
    a local session without it gets one of its own; elsewhere that raises.
    """
    d = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if not d:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by the driver and all executors")
        if "dir" not in _LOCAL_FALLBACK:
            _LOCAL_FALLBACK["dir"] = tempfile.mkdtemp(prefix="epispark-ckpt-")
        d = _LOCAL_FALLBACK["dir"]
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
