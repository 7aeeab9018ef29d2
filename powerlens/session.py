"""SparkSession settings every powerlens job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the operators assume: UTC wall clock (timestamps are UTC without a
# zone), ANSI arithmetic (hence try_divide / try_cast in the operators), AQE for
# runtime coalescing and skew splitting of shuffles.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.parquet.filterPushdown": "true",
}


def get_session(master: str | None = None, app: str = "powerlens", conf: dict | None = None) -> SparkSession:
    """Return (or create) a session with the powerlens defaults applied."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULT_CONF, **(conf or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    for k, v in DEFAULT_CONF.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)
    return spark


def local_session(cores: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """Local test/bench session."""
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions or cores),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    spark = get_session(f"local[{cores}]", conf=conf)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session (or the context's
    checkpoint directory).  When neither is set, a run in one process (tests)
    gets a scratch folder; on a cluster, where executors would each write to
    their own disk, this is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = None
    try:
        sc = spark.sparkContext
        d = d or sc.getCheckpointDir()
    except Exception:  # noqa: BLE001  (no context available, e.g. a remote session)
        sc = None
    if not d:
        if sc is None or not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="powerlens-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # noqa: BLE001
            pass
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for materialised tables."""
    return os.path.join(checkpoint_dir(spark), name)


def materialize(df, spark: SparkSession | None = None):
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared
    ``spark.checkpoint.dir`` (never a local checkpoint).

    Use it for an intermediate read by several outputs (a multi-dataset
    report): it is computed once, and a lost executor later re-reads the
    checkpoint files instead of recomputing the whole plan.
    """
    checkpoint_dir(spark or df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df, name: str):
    """``df`` written once as Parquet under the shared checkpoint folder and read back.

    For an intermediate that is small but costly: unlike ``checkpoint`` it is computed
    a single time, and readers know its size."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
