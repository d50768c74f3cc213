"""What the operators share: scratch tables in the cluster's shared folder, word counts, row keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, spelt out since \s differs between regex engines.
WORD = r"[^ \t\n\x0B\f\r]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else (tests, one machine) a folder of our own. A cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="seekmill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors.

    Writing is Spark's own commit protocol, so a retried task never leaves half a table. What isn't dropped before goes when the
    application ends, as results may be read until then.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        jvm = spark.sparkContext._jvm
        base = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}")
        fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(base)
        fs.deleteOnExit(base)
        self.root = fs.makeQualified(base).toString().replace("file:/", "file:///").replace("file://///", "file:///")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Remove tables that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(conf).delete(p, True)

    def release(self) -> None:
        """Have the shuffle files of finished writes removed now: Spark does so when the driver's JVM has collected their plans."""
        self.spark.sparkContext._jvm.System.gc()



def word_count(text: Column) -> Column:
    """Words between white space in the whole text, 0 for NULL; the token measure of the mixing and packing queries."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that clashes with none of df's (Spark resolves names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
