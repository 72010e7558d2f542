"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
_LOCAL: dict[str, str] = {}


def build_session(app: str = "pixelloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (AQE and UTC)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # hash joins only where the measured build side of every task stays small
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the session.

    Only a local master may fall back to a temporary folder: on a cluster such a
    folder would vanish with its machine.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors can reach")
    if "folder" not in _LOCAL:
        _LOCAL["folder"] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL["folder"]


class StoredTable:
    """A DataFrame written once to the shared folder, so its lineage ends there.

    ``metrics`` are aggregates read back from the stored columns.
    """

    def __init__(self, df: DataFrame, **metrics):
        spark = df.sparkSession
        self.path = f"{shared_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)
        self.metrics: dict[str, int] = {}
        if metrics:
            exprs = [F.coalesce(expr, F.lit(0)).alias(name) for name, expr in metrics.items()]
            self.metrics = self.df.agg(*exprs).first().asDict()

    def drop(self) -> None:
        """Remove the files; call only when nothing reads the table any more."""
        spark = self.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
