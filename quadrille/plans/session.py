"""Session settings and lineage cutting.

The library never creates a session itself; ``local_session`` is for tests,
the bench and examples.  ``materialize`` cuts lineage with a reliable
checkpoint in the shared folder the cluster names in
``spark.checkpoint.dir`` (read from the session, never invented), so a lost
executor does not force the whole upstream plan to rerun.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.driver.memory": "16g",
}


def local_session(cpus: int | str = "*", app: str = "quadrille", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in {**LOCAL_CONF, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Use the session's ``spark.checkpoint.dir``; set one only where unset.

    A temporary folder is made only for a ``local`` / ``local[n]`` master, where
    driver and tasks are one process (tests, bench).  Any other master must name
    a shared folder in ``spark.checkpoint.dir``.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if not configured and re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        configured = tempfile.mkdtemp(prefix="quadrille-ckpt-")
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize_dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """``materialize`` the rows dealt out and sorted by ``keys``, so that joins on
    them neither exchange nor sort these rows again.  Spark forgets how a
    checkpoint is dealt out if adaptive execution planned it, so that is off here."""
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        return materialize(df.repartition(parts, *keys).sortWithinPartitions(*keys))
    finally:
        conf.set(name, before)


TARGET_BYTES = 64 * 1024 * 1024


def materialize_with_stats(df: DataFrame, *aggs):
    """``materialize`` plus global aggregates of the same rows, computed in
    the checkpoint job itself (``observe``) instead of a second pass."""
    from pyspark.sql import Observation
    ensure_checkpoint_dir(df.sparkSession)
    obs = Observation("quadrille_stats")
    out = df.observe(obs, *aggs).checkpoint(eager=True)
    return out, obs.get


def shuffle_partitions_for(spark: SparkSession, total_bytes: int, target: int = TARGET_BYTES) -> int:
    """Partitions so each holds about ``target`` bytes, never fewer than the
    session's ``spark.sql.shuffle.partitions``."""
    base = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(base, -(-int(total_bytes) // int(target)))


def shared_output_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for written results under the shared checkpoint dir."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/quadrille-out/{name}-{uuid.uuid4().hex}"
