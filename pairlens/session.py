"""Session construction and the shared folder used to cut lineage.

On a cluster the checkpoint folder comes from ``spark.checkpoint.dir`` (or a
``SparkContext.setCheckpointDir`` call made by the job owner) and points at
shared storage.  Only when nothing is configured -- local runs and tests --
do we create a private folder ourselves.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Codec of files that are written to be read again by the same application.
SCRATCH_CODEC = "zstd"

# Settings every session of this package wants.  Adaptive execution lets the
# planner pick broadcast versus sort-merge joins from measured sizes, split
# skewed join partitions and coalesce small shuffle partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app_name: str = "pairlens",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local") and "spark.sql.warehouse.dir" not in (extra or {}):
        # Local runs keep the catalog's folder out of the working directory.
        conf["spark.sql.warehouse.dir"] = tempfile.mkdtemp(prefix="pairlens-warehouse-")
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder.

    Taken from the session (``SparkContext.setCheckpointDir`` or
    ``spark.checkpoint.dir``).  Only a local-mode session without one gets a
    private temporary folder; on a cluster a machine-local folder would not
    be visible to the executors, so an unset folder is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder on shared storage")
        configured = tempfile.mkdtemp(prefix="pairlens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the checkpoint location for files a job writes."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/pairlens-scratch/{name}-{uuid.uuid4().hex[:12]}"


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the shared checkpoint folder and cut lineage.

    Used where two branches of a plan must see exactly the same rows (range
    boundaries, row numbering); a recomputation could sample differently.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
