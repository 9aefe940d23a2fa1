"""Session helpers: a local session for tests and benchmarks, and the shared
folder for lineage cuts.

The library itself never creates or configures a session; every operator takes
and returns DataFrames. On a cluster the caller's session configuration wins.
"""
from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the library is designed around. On a cluster they belong in the job
# configuration; `local_session` applies them for tests and the benchmark.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Coalesce small post-shuffle partitions to the advisory size instead of
    # keeping one per core: fewer tiny tasks (Spark's advice for busy clusters).
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "stockboard") -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(app_name)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", "8g"))
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    Read from ``spark.checkpoint.dir`` (or the context's checkpoint folder);
    a folder of our own is chosen only when the session names none, which
    happens in local tests, never on a cluster configured for the job. A
    remote (Spark Connect) session must name the folder in its config.
    """
    from stockboard.sources.tables import _jvm_context
    sc = _jvm_context(spark)
    path = spark.conf.get("spark.checkpoint.dir", None)
    if sc is None:
        if not path:
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        return path
    if not path:
        jdir = sc._jsc.sc().getCheckpointDir()
        path = jdir.get() if jdir.isDefined() else None
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = tempfile.mkdtemp(prefix="stockboard-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        # The config key itself cannot be changed at run time; the context's
        # checkpoint folder can, and it is what later calls read back.
        sc.setCheckpointDir(path)
    return path
