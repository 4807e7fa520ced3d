"""Session helpers: the shared scratch folder and lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("threadlake")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@lru_cache(maxsize=1)
def _own_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="threadlake-")


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where unset in a local session (tests), one of our own, the same as long as the process lives."""
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{CHECKPOINT_CONF} is not set: on a cluster it has to name a folder that all executors share")
        root = _own_root()
    return root.rstrip("/")


class Scratch:
    """Written tables that cut lineage. Each operator run has a folder of its own below the shared one."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark)}/threadlake/{name}-{uuid.uuid4().hex}"
        self.made: list[str] = []

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write ``df`` and read it back; later stages recompute from the files, not from the plan."""
        path = self.path(name)
        df.write.mode("overwrite").option("compression", codec).parquet(path)
        self.made.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def append(self, df: DataFrame, name: str) -> None:
        df.write.mode("append").option("compression", "zstd").parquet(self.path(name))

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per context, for clusters where it isn't installed."""
    context = spark.sparkContext
    if getattr(context, "_threadlake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="threadlake-"), f"threadlake-{uuid.uuid4().hex}.zip")  # served to the executors as long as the context lives
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, Path("threadlake", file.relative_to(root)))
    context.addPyFile(str(path))
    context._threadlake_shipped = True
