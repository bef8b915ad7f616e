"""Session construction and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


# Runtime settings the engine works best with. Expressions over many columns
# make generated methods beyond 8000 bytes, which the JVM would interpret; below
# that limit Spark falls back to split methods that do get compiled.
# Arrow batches of long texts must stay small beside several Python workers.
RUNTIME = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session built elsewhere."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "datumgate", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine relies on.

    ANSI mode stays on (casts that may fail use ``try_cast``) and AQE sizes the
    shuffles, so no partition count is fixed here.
    """
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        # Recording the call site of every column expression doubles planning time.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **RUNTIME,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder name below the checkpoint folder the cluster shares.

    Only a local master may fall back to this machine's temporary folder; on a
    cluster the executors could not see it.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors share")
        root = tempfile.mkdtemp(prefix="datumgate-")
        spark.conf.set(CHECKPOINT_KEY, root)
    return os.path.join(root, f"{label}-{uuid.uuid4().hex}")
