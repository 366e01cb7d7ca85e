"""Session helpers: shared folder, written tables that cut lineage, checked broadcast."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary one is set only on a local master that has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="cellframe-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_WRITTEN: list[tuple[SparkSession, str]] = []


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def text(spark: SparkSession, path: str, content: str) -> None:
    """Writes one small file through the cluster's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(content.encode()))
    out.close()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def clear_scratch() -> None:
    """Deletes the tables this process wrote to the shared folder; results not yet read are lost. Runs at exit, too."""
    while _WRITTEN:
        try:
            delete(*_WRITTEN.pop())
        except Exception:  # the session may be gone
            pass


atexit.register(clear_scratch)


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive the loss of executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        _WRITTEN.append((spark, self.root))

    def save(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{self.root}/{label}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, label: str) -> None:
        delete(self.spark, f"{self.root}/{label}")


def join_checked(big: DataFrame, small: DataFrame, on: list[str], how: str, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with `small` broadcast only if its counted `rows` are within the limit; otherwise a shuffle join under AQE."""
    return big.join(F.broadcast(small) if rows <= limit else small, on, how)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Names made from the stems that no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    names = []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names
