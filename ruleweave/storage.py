"""Tables in the folder that all executors share, to cut lineage and to share results between jobs."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys with at least this share of the rows are hot; there are at most so many of them as the share's inverse.
HOT = 1_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a local session gets a temporary folder; a cluster has to set it."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='ruleweave-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once per context, so that Python functions import there as here."""
    context = spark.sparkContext
    if getattr(context, "_ruleweave_shipped", None):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="ruleweave-code-")) / "ruleweave_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(str(target))
    context._ruleweave_shipped = True


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/ruleweave/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete all that this application wrote below the shared folder; results that still read it are gone too."""
    delete(spark, f"{shared_dir(spark)}/ruleweave/{spark.sparkContext.applicationId}")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder from whatever store it is in."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Stored:
    """A table that grows by parts, each written once."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name, self.paths, self.schema = spark, name, [], None

    def add(self, df: DataFrame) -> DataFrame:
        """Write a part; returns it as read back."""
        path = scratch_path(self.spark, self.name)
        df.write.parquet(path)
        self.paths.append(path)
        self.schema = df.schema
        return self.spark.read.schema(df.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)

    def drop(self) -> None:
        """Delete all parts; nothing may read them any more."""
        for path in self.paths:
            delete(self.spark, path)
        self.paths = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once and read back from the shared folder."""
    stored = Stored(df.sparkSession, name)
    out = stored.add(df)
    out._ruleweave_stored = stored
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` gave, once all that reads them is written itself."""
    for df in tables:
        df._ruleweave_stored.drop()


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of finished jobs, which it does once the driver's JVM has found that nothing refers to them."""
    spark._jvm.System.gc()


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], total: int, how: str = "left") -> DataFrame:
    """``left`` joined with ``right``, which has one row per key and in ``rows`` how many rows of ``left`` have it.

    Keys with a ``HOT``-th of the ``total`` rows or more would fill a task each. There are at most ``HOT`` of them, so
    that part of ``right`` is broadcast and the rows stay where they are; all other keys meet by a shuffle. ``right`` should be
    a written table or cheap, as it is read twice. Parts are told apart by a hash of the key, on both sides alike.
    """
    of = F.hash(*keys)
    hot = [r[0] for r in right.where(F.col("rows") * HOT >= F.lit(total)).select(of).distinct().collect()]
    right = right.drop("rows")
    if not hot:
        return left.join(right, keys, how)
    near = of.isin(hot)
    return left.where(near).join(F.broadcast(right.where(near)), keys, how).unionByName(left.where(~near).join(right.where(~near), keys, how))
